"""Shards by extendible hashing.

A document's bucket is named by the first bits of a 60-bit hash of its id. Only buckets over the byte limit are split,
on one more bit, until each fits; the directory is the set of the shallowest fitting prefixes. One histogram of the
corpus at a depth a little beyond what the total needs gives the sizes of all prefixes above it at once; only prefixes
that still are too large there are counted again, deeper. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm._common import documents, written

#: Bits of the hash; bytes of text a shard may have; bits by which a histogram goes beyond the mean depth; bits of which
#: prefixes are summed at once.
BITS, LIMIT, BEYOND, STEP = 60, 64 << 20, 4, 8
#: Cells of a map that may be broadcast (40 bytes each).
SMALL = 1_000_000


def id_hash(doc_id: Column) -> Column:
    """First 60 bits of the MD5 of an id's decimal text, as a bigint; a null id counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _prefix(hashed: Column, depth: int) -> Column:
    return F.shiftright(hashed, BITS - depth)


def _settled(cells: DataFrame, depth: int, top: int, limit: int) -> DataFrame:
    """(cell, n, own) of cells (cell, n) at a depth; own: the shallowest of a cell's prefixes below depth `top` (-1: of all)
    that has at most `limit` bytes, as (depth, prefix, shard_bytes); null where the cell itself has more.

    Runs of at most 2 ** STEP cells share a prefix: prefixes within a run are summed by windows over one shuffle and one sort, and
    what lies above comes from the runs' own sums in the same way. So a cell is one row throughout.
    """
    low = max(top + 1, depth - STEP)
    at = range(low, depth + 1)
    rows = cells.select("cell", "n", *(F.shiftright("cell", depth - d).alias(f"p{d}") for d in at))
    rows = rows.repartition(f"p{low}").sortWithinPartitions(*(f"p{d}" for d in at))
    sums = {d: F.sum("n").over(Window.partitionBy(*(f"p{e}" for e in range(low, d + 1)))) for d in at if d < depth}
    rows = rows.withColumns({f"s{d}": s for d, s in sums.items()} | {f"s{depth}": F.col("n")})
    own = [F.when(F.col(f"s{d}") <= limit, F.struct(F.lit(d).alias("depth"), F.col(f"p{d}").alias("prefix"), F.col(f"s{d}").alias("shard_bytes"))) for d in at]
    if low > top + 1:
        runs = cells.groupBy(F.shiftright("cell", depth - low).alias("cell")).agg(F.sum("n").alias("n"))
        above = _settled(runs, low, top, limit).filter("own is not null").select(F.col("cell").alias(f"p{low}"), F.col("own").alias("above"))
        rows = rows.join(above, f"p{low}", "left")
        own = [F.col("above"), *own]
    return rows.select("cell", "n", F.coalesce(*own).alias("own"))


def directory(sized: DataFrame, *, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """From rows (hash, n_bytes): the shards (depth, prefix, shard_bytes, fits), and for each histogram cell its shard
    (cell_depth, cell, depth, prefix, shard_bytes, fits).

    A prefix of all 60 bits that is still too large (one text over the limit, or one id repeated) can't be split: it
    stays one shard with fits false.
    """
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total) / limit)) + BEYOND)) if limit > 0 else BITS
    rest, parts = sized, []
    # Depths grow by 8 bits a round over what is still too large: 8 rounds at most.
    while True:
        cells, _ = written(rest.groupBy(_prefix(F.col("hash"), depth).alias("cell")).agg(F.sum("n_bytes").alias("n")), "shard-cells")
        # In a later round each prefix down to the last depth was too large.
        own = _settled(cells, depth, parts[-1][0] if parts else -1, limit)
        if depth == BITS:
            own = own.withColumn("own", F.coalesce("own", F.struct(F.lit(BITS).alias("depth"), F.col("cell").alias("prefix"), F.col("n").alias("shard_bytes"))))
        own = own.filter("own is not null").select("cell", "own.*")
        found, _ = written(own.withColumn("fits", F.col("shard_bytes") <= limit).withColumn("cell_depth", F.lit(depth)), "shard-map")
        parts.append((depth, found))
        large = cells.filter(F.col("n") > limit).select("cell")
        if depth == BITS or large.isEmpty():
            break
        rest = rest.join(large, _prefix(F.col("hash"), depth) == F.col("cell"), "left_semi")
        depth = min(BITS, depth + 8)
    cells = parts[0][1]
    for _, more in parts[1:]:
        cells = cells.unionByName(more)
    return cells.select("depth", "prefix", "shard_bytes", "fits").distinct(), cells


def bits(depth: Column, prefix: Column) -> Column:
    """A shard's name: its prefix as `depth` binary digits; the whole corpus in one shard has the empty name."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2), depth, "0"))


def assigned(docs: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, shard, depth, shard_bytes and fits; columns of those names are replaced.

    A null text has no bytes. Repeated rows each count and share a shard.
    """
    names = ["n_bytes", "shard", "depth", "shard_bytes", "fits"]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    _, cells = directory(docs.select(id_hash(F.col("doc_id")).alias("hash"), size.alias("n_bytes")), limit=limit)
    rows = docs.drop(*names).withColumns({"n_bytes": size, "_tf_hash": id_hash(F.col("doc_id"))})
    depths = sorted(r[0] for r in cells.select("cell_depth").distinct().collect())
    own = [F.col(c).alias(f"_tf_{c}") for c in ("cell", "depth", "prefix", "shard_bytes", "fits")]
    out = None
    for d in depths or [BITS]:  # one, or one more for each round of splitting beyond the histogram
        own_cells = cells.filter(F.col("cell_depth") == d).select(*own)
        # By their number: a map compresses to next to nothing, so its size on disk must not make it a broadcast.
        own_cells = own_cells.hint("broadcast" if own_cells.count() <= SMALL else "merge")
        here = rows.join(own_cells, _prefix(F.col("_tf_hash"), d) == F.col("_tf_cell"))
        out = here if out is None else out.unionByName(here)
    shard = bits(F.col("_tf_depth"), F.col("_tf_prefix"))
    out = out.withColumns({"shard": shard, "depth": F.col("_tf_depth"), "shard_bytes": F.col("_tf_shard_bytes"), "fits": F.col("_tf_fits")})
    return out.drop("_tf_hash", "_tf_cell", "_tf_depth", "_tf_prefix", "_tf_shard_bytes", "_tf_fits")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = assigned(documents(spark, sf_dir).select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "fits")


#: A limit at which small tables are split too, for the second query.
SMALL_LIMIT = 64 << 10


def small_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with shards of 64 KiB."""
    got = assigned(documents(spark, sf_dir).select("doc_id", "text"), limit=SMALL_LIMIT)
    return got.select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "fits")


ORACLE = f"""
WITH rows AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(strlen(text), 0) AS n_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
nodes AS (SELECT rid, n_bytes, CAST(d AS INTEGER) AS depth, h >> ({BITS} - d) AS prefix FROM rows, range(0, {BITS} + 1) t(d)),
sums AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM nodes GROUP BY ALL),
picked AS (
  SELECT rid, arg_min(depth, depth) AS depth, arg_min(prefix, depth) AS prefix, arg_min(shard_bytes, depth) AS shard_bytes
  FROM nodes JOIN sums USING (depth, prefix) WHERE shard_bytes <= {LIMIT} OR depth = {BITS} GROUP BY rid)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth, shard_bytes,
       shard_bytes <= {LIMIT} AS fits
FROM rows JOIN picked USING (rid)
"""
