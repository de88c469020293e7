"""Append-only records of experiments (an extension with definitions of our own).

A record's key is a digest of the experiment's name, its parameters, the version of its code and the versions of its inputs,
and a version of an input is a digest of a table's rows. So a run that is repeated finds its record and adds nothing, and one on other data or parameters is
another record. A record is written beside the others and then renamed, whole.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.codes import utc_now
from tallyforge.sources import files


def version(table: DataFrame) -> str:
    """A digest of a table's columns and rows, whatever their order: their number, and the exclusive-or and the sum of their
    128-bit hashes. Repeated rows count. One pass, one row an executor."""
    hashes = [F.xxhash64(F.lit(seed), F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias(f"h{seed}") for seed in (0, 1)]
    sums = [x for h in ("h0", "h1") for x in (F.bit_xor(h), F.sum(F.col(h).cast("decimal(20,0)")))]
    said = [F.coalesce(F.lit(None), x.cast("string"), F.lit("")) for x in (F.count(F.lit(1)), *sums)]
    one = table.select(*hashes).agg(F.concat_ws(":", *said)).first()[0]
    return hashlib.sha256(f"{table.schema.simpleString()}|{one}".encode()).hexdigest()


def key_of(name: str, parameters: dict[str, Any], inputs: dict[str, str], code: str = "") -> str:
    """The key of a record, from values that JSON has; the order of names doesn't matter."""
    return hashlib.sha256(json.dumps([name, parameters, inputs, code], sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def recorded(spark: SparkSession, folder: str, name: str, parameters: dict[str, Any], inputs: dict[str, str], results: Callable[[], DataFrame], *, code: str = "", clock: Column | None = None) -> tuple[str, bool]:
    """The record's key, and whether it was added. results() gives the rows to keep; it isn't called if there is a record.

    Of two runs at once the one that is renamed last changes nothing.
    """
    key = key_of(name, parameters, inputs, code)
    path = f"{folder}/records/key={key}"
    if files.exists(spark, path):
        return key, False
    made = results().withColumns({"experiment": F.lit(name), "parameters": F.lit(json.dumps(parameters, sort_keys=True, ensure_ascii=False)), "inputs": F.lit(json.dumps(inputs, sort_keys=True)), "code_version": F.lit(code), "recorded_at": utc_now(clock)})
    draft = f"{folder}/drafts/{uuid.uuid4().hex}"
    made.write.parquet(draft)
    return key, files.renamed(spark, draft, path)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of all records, with their key."""
    return spark.read.option("mergeSchema", "true").parquet(f"{folder}/records")
