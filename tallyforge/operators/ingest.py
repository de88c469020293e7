"""Ingest of bars: validation, dedupe, lineage, limits by venue and quality (an extension with definitions of our own)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Daily price limits by venue, and the bound where a venue has none.
LIMITS = {"HOSE": 0.07, "HNX": 0.10, "UPCOM": 0.15}
ANY_VENUE = 0.30


def sane() -> Column:
    """Whether a bar can be: its prices above 0 and bounded by high and low, no negative volume."""
    c = F.col
    return (c("high") >= F.greatest("open", "close")) & (c("low") <= F.least("open", "close")) & (c("volume") >= 0) & (F.least("open", "high", "low", "close") > 0)


def judged(raw: DataFrame, key: list[str], newest: list[str]) -> DataFrame:
    """Raw bars with `fault`: null, "invalid" (a bar that can't be, or a null in the key), or "duplicate" (the key's
    newest valid row stays). Raw rows are all kept, so that what is canonical can be derived anew."""
    c = F.col
    whole = F.lit(True)
    for k in key:
        whole = whole & c(k).isNotNull()
    rows = raw.withColumn("_good", F.coalesce(sane(), F.lit(False)) & whole)
    # Rows that can't be are strewn, so that those with a null key don't meet in one task.
    apart = F.when(~F.col("_good"), F.xxhash64(*raw.columns))
    turn = F.row_number().over(Window.partitionBy(*key, apart).orderBy(*(F.desc_nulls_last(n) for n in newest)))
    return rows.withColumn("fault", F.when(~c("_good"), F.lit("invalid")).when(turn > 1, F.lit("duplicate"))).drop("_good")


def with_lineage(rows: DataFrame, source: str, at: Column, *, validation: str, transformation: str) -> DataFrame:
    """rows with the four columns that tell where they came from and what was done to them."""
    return rows.withColumns({"source": F.lit(source), "ingested_at": at, "validation_version": F.lit(validation), "transformation_version": F.lit(transformation)})


def beyond_limits(rows: DataFrame, limits: dict[str, float] | None = None, other: float = ANY_VENUE) -> DataFrame:
    """(instrument, venue, start, gap, bound): opens further from the close before than the venue allows."""
    bound = F.lit(other)
    for venue, most in (LIMITS if limits is None else limits).items():
        bound = F.when(F.col("venue") == venue, F.lit(most)).otherwise(bound)
    before = F.lag("close").over(Window.partitionBy("instrument").orderBy("start"))
    moved = rows.withColumns({"gap": F.col("open") / F.nullif(before, F.lit(0.0)) - 1, "bound": bound})
    return moved.filter(F.abs("gap") > F.col("bound")).select("instrument", "venue", "start", "gap", "bound")


def quality(judged_rows: DataFrame, expected: DataFrame, reliability: float, weights: tuple[float, float, float, float] = (1, 1, 1, 1)) -> DataFrame:
    """By instrument, as percentages: completeness (distinct valid sessions of those `expected` (instrument, n)),
    consistency (rows that are no duplicates), validity (rows that are valid), the source's reliability, and their mean
    by `weights`. An instrument without rows scores 0 in the first three."""
    of = lambda a, b: 100 * a / F.nullif(b, F.lit(0))
    c = F.col
    seen = judged_rows.groupBy("instrument").agg(F.count(F.lit(1)).alias("rows"), F.count_if(c("fault").isNull()).alias("good"), F.count_if(c("fault") == "duplicate").alias("twice"), F.count_if(c("fault") == "invalid").alias("bad"))
    both = expected.join(seen, "instrument", "left").fillna(0, ["rows", "good", "twice", "bad"])
    parts = {
        "completeness": F.coalesce(F.least(F.lit(100.0), of(c("good"), c("n"))), F.lit(0.0)), "consistency": F.coalesce(of(c("rows") - c("twice"), c("rows")), F.lit(0.0)),
        "validity": F.coalesce(of(c("rows") - c("bad"), c("rows")), F.lit(0.0)), "reliability": F.lit(float(reliability)),
    }
    overall = sum((c(p) * w for p, w in zip(parts, weights, strict=True)), F.lit(0.0)) / sum(weights)
    return both.withColumns(parts).withColumn("overall", overall).select("instrument", *parts, "overall")
