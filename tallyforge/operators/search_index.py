"""Search over instruments by an inverted index of character grams (an extension with definitions of our own).

Postings (field, gram, id) hold the grams of one to three characters of codes and names, as search compares them. They are
partitioned by their gram's bucket and sorted by gram, so that a search reads the row groups of its own grams alone; rows are
partitioned by their id's bucket. Candidates have all grams of the text in one field, and are then judged as `directory.search` judges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators import directory

#: Characters of a gram at most.
GRAM = 3


def _bucket(x: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")


def build(rows: DataFrame, folder: str, *, key: str, code: str = "ticker", name: str = "name", buckets: int = 64) -> None:
    """Writes the index of rows in a folder. Texts that are null or blank have no grams."""
    fields = F.array(*(F.struct(F.lit(k).alias("field"), directory.alias_key(F.col(c)).alias("text")) for k, c in enumerate((code, name))))
    texts = rows.select(F.col(key).alias("id"), F.explode(fields).alias("x")).select("id", "x.*").filter("text IS NOT NULL")
    sized = texts.select("id", "field", "text", F.explode(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("text")))).alias("size"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - F.col("size") + 1), lambda i: F.substring(F.col("text"), i, F.col("size"))))
    postings = sized.select("field", F.explode(grams).alias("gram"), "id").withColumn("bucket", _bucket(F.col("gram"), buckets))
    # By ranges of bucket and gram: the postings of a common gram are several files, not one task.
    postings.repartitionByRange("bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    rows.limit(0).write.mode("overwrite").parquet(f"{folder}/shape")  # there may be no row, and then no other file
    rows.withColumn("bucket", _bucket(F.col(key), buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows")


def _table(spark: SparkSession, folder: str, table: str, key: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/shape").schema
    shape = rows if table == "rows" else T.StructType().add("field", "integer").add("gram", "string").add("id", rows[key].dataType)
    return spark.read.schema(T.StructType([*shape.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{folder}/{table}")


def candidates(spark: SparkSession, folder: str, text: str, *, key: str, buckets: int = 64) -> DataFrame:
    """(id): rows of which one field has all grams of a text, by an intersection of posting lists; none for a blank text."""
    wanted = spark.range(1).select(directory.alias_key(F.lit(text)).alias("x")).first().x or ""
    size = min(GRAM, len(wanted))
    grams = sorted({wanted[i : i + size] for i in range(len(wanted) - size + 1)}) if wanted else []
    postings = _table(spark, folder, "postings", key)
    if not grams:
        return postings.select("id").limit(0)
    # The buckets are looked up first, so that the scan is of these partitions and grams.
    at = spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"), buckets).alias("b")).distinct().collect()
    own = postings.filter(F.col("bucket").isin([r.b for r in at]) & F.col("gram").isin(grams))
    return own.groupBy("id", "field").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select("id").distinct()


def search(spark: SparkSession, folder: str, text: str, *, key: str, code: str = "ticker", name: str = "name", buckets: int = 64) -> DataFrame:
    """As directory.search over the indexed rows: rows that the text may mean, with `place`."""
    found = candidates(spark, folder, text, key=key, buckets=buckets).withColumnRenamed("id", key).withColumn("bucket", _bucket(F.col(key), buckets))
    rows = _table(spark, folder, "rows", key)
    return directory.search(rows.join(found, ["bucket", key], "left_semi").drop("bucket"), text, code=code, name=name)
