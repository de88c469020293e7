"""Status reports: checks chosen by tag, projected into one report, and folded into what a dashboard shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.settings import shown_status

_CHECK = "struct<name:string,status:string,durationMs:double,description:string>"
REPORT = f"struct<status:string,totalDurationMs:double,checks:array<{_CHECK}>>"
_RANK = {"Unhealthy": 0, "Degraded": 1, "Healthy": 2}


def tagged(checks: DataFrame, tag: str) -> DataFrame:
    return checks.filter(F.array_contains("tags", tag))


def report(checks: DataFrame) -> DataFrame:
    """One row with `json`: the worst status, the time taken and the checks by `place`; missing texts are left out.
    Checks are a handful; rows (place, name, status, duration_ms, description)."""
    rank = F.coalesce(*(F.when(F.col("status") == k, v) for k, v in _RANK.items()))
    one = F.struct("place", F.struct("name", "status", F.col("duration_ms").alias("durationMs"), "description").alias("check"))
    whole = checks.agg(F.min(rank).alias("r"), F.sum("duration_ms").alias("totalDurationMs"), F.array_sort(F.collect_list(one)).alias("all"))
    status = F.element_at(F.array(*map(F.lit, _RANK)), F.coalesce("r", F.lit(2)) + 1)
    return whole.select(F.to_json(F.struct(status.alias("status"), F.coalesce("totalDurationMs", F.lit(0.0)).alias("totalDurationMs"), F.transform("all", lambda x: x["check"]).alias("checks"))).alias("json"))


def parsed(reports: DataFrame) -> DataFrame:
    """reports with `report` read from `json`; null where status or checks are missing."""
    got = F.from_json("json", REPORT)
    return reports.withColumn("report", F.when(got["status"].isNotNull() & got["checks"].isNotNull(), got))


def services(parsed_reports: DataFrame, names: list[str]) -> DataFrame:
    """(service, status, detail) for each row of (live: boolean, report) and each name: unknown without the service
    itself being reachable."""
    each = parsed_reports.withColumn("service", F.explode(F.array(*map(F.lit, names))))
    check = F.filter("report.checks", lambda c: c["name"] == F.col("service"))
    own = each.withColumn("check", F.get(check, 0))
    return own.select("service", shown_status(F.col("check.status"), F.col("live")).alias("status"), F.col("check.description").alias("detail"))
