"""Mixing sources to target weights by temperature.

Token shares are raised to an exponent and normalised. The exponent is bisected (63 exponents are tried in one pass over
the sources, so a round is worth six halvings) to the smallest that meets a target entropy and keeps every source within a
repetition limit. The weights are then realised against a token budget as blocks: a source's documents stand in one
permutation after another until its due tokens are reached, and this row is cut into as many equal parts as the mixture
has blocks. So each block has the target weights, to within a bin (1 / BINS of a permutation) of each source.

A permutation orders the bins of an id's hash by an affine map of its own, and a bin's documents by the hash; so sums by
(source, bin) from one pass over the texts place every document of every permutation, and texts are never sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm._common import BLANKS, documents, written
from tallyforge.llm.sharding import BITS, id_hash

#: Times a source may be seen; how far from the sources' own entropy to that of equal weights the target lies.
REPETITIONS, EVENNESS = 2.0, 0.5
#: Rounds of 63 exponents (2 ** -48 is left of the range); bins of a permutation, a power of two; blocks of the mixture.
ROUNDS, BINS, BLOCKS = 8, 1 << 10, 16
#: Permutation p sends bin b to (b * (1 + 2 * p * TURN) + p * SHIFT) modulo BINS.
TURN, SHIFT = 211, 389


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("bigint")


def exponent(sources: DataFrame, *, entropy: float | None = None, evenness: float | None = None, repetitions: float | None = REPETITIONS, budget: float | None = None) -> float:
    """From (source, n): the smallest exponent in [0, 1] whose weights have the wanted entropy (in nats) at most and see no
    source more often than the limit; 1 if none does.

    evenness gives the entropy as a part of the way from the sources' own to that of equal weights. Without a budget,
    repetition counts against the budget at which every document is seen once at least.
    """
    known, _ = written(sources.filter("n > 0").select(F.col("n").cast("double").alias("n")), "mix-sources")
    ends = known.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("n").alias("k")).first()
    lo, hi = 0.0, 1.0
    for turn in range(ROUNDS):
        tries = [lo + (hi - lo) * i / 64 for i in range(65)]
        tried = known.select("n", F.posexplode(F.lit(tries)).alias("i", "a"))
        sums = tried.groupBy("i").agg(F.sum(F.pow("n", "a")).alias("z"), F.sum(F.pow("n", "a") * F.log("n") * F.col("a")).alias("e"))
        got = {r["i"]: (r["z"], math.log(r["z"]) - r["e"] / r["z"]) for r in sums.collect()}
        if not got:
            return 1.0
        if not turn and evenness is not None:
            entropy = got[64][1] + evenness * (math.log(ends["k"]) - got[64][1])

        def met(i: int) -> bool:
            z, own = got[i]  # noqa: B023
            # The smallest source is repeated most: its weight is least ** a / z.
            seen = (ends["most"] / ends["least"]) ** (1 - tries[i]) if budget is None else budget * ends["least"] ** (tries[i] - 1) / z  # noqa: B023
            return (entropy is None or own <= entropy) and (repetitions is None or seen <= repetitions)

        at = next((i for i in range(65) if met(i)), 64)
        if at == 0:
            return tries[0]
        lo, hi = tries[at - 1], tries[at]
    return hi


def _place(b: Column, p: Column) -> Column:
    return (b * (1 + 2 * p * TURN) + p * SHIFT) % BINS


def plan(counted: DataFrame, *, blocks: int = BLOCKS, budget: float | None = None, **aims) -> DataFrame:
    """From rows (source, bin, n): (source, bin, p, block, room) of every bin that permutation p of a source gives to the
    mixture; room: null if it gives the whole bin, or the tokens that it may give. Written.

    A source without tokens has no weight and is given once.
    """
    bins, _ = written(counted.groupBy("source", "bin").agg(F.sum("n").alias("n")), "mix-bins")
    sources = bins.groupBy("source").agg(F.sum("n").alias("n"))
    a = exponent(sources, budget=budget, **aims)
    raised = F.when(F.col("n") > 0, F.pow(F.col("n").cast("double"), F.lit(a))).otherwise(0.0)
    all_ = sources.agg(F.sum(raised).alias("z"), F.max("n").alias("most")).first()
    z = all_["z"] or 1.0
    whole = budget if budget is not None else (all_["most"] or 0) ** (1 - a) * z
    due = sources.select("source", F.col("n").alias("total"), F.round(raised / z * whole).cast("bigint").alias("due"))
    due = due.withColumn("turns", F.when(F.col("total") > 0, F.greatest(F.ceil(F.col("due") / F.col("total")), F.lit(1))).otherwise(1).cast("bigint"))
    slots = bins.join(due, "source").withColumn("p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("turns") - 1)))
    # BINS rows at most in each part.
    before = Window.partitionBy("source", "p").orderBy(_place(F.col("bin"), F.col("p"))).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("at", F.col("p") * F.col("total") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    fits = F.col("at") + F.col("n") <= F.col("due")
    block = F.when(F.col("due") > 0, F.least(F.floor(F.col("at") * blocks / F.col("due")), F.lit(blocks - 1))).otherwise(0).cast("bigint")
    slots = slots.filter(fits | (F.col("at") < F.col("due"))).select("source", "bin", "p", block.alias("block"), F.when(~fits, F.col("due") - F.col("at")).alias("room"))
    return written(slots, "mix-slots")[0]


def mixed(docs: DataFrame, *, blocks: int = BLOCKS, budget: float | None = None, **aims) -> DataFrame:
    """docs, each row as often as its source's weight asks for, with `mix_block` and `mix_order` (place within it): sort by
    both to read the mixture. Columns of those names are replaced. aims: see `exponent`.

    Tokens are words. Without a budget the most abundant source is seen once and no document is left out; with one, a
    source that is due less than it has is cut to a prefix of its permutation. In the bin where a source's due ends, its
    ids are given by their hashes as far as the tokens reach; rows that share an id stay together. A null source counts as
    the empty one, a null id as the empty text, a null text has no tokens.
    """
    own = {"_tf_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "_tf_hash": id_hash(F.col("doc_id"))}
    rows = docs.drop("mix_block", "mix_order").withColumns(own).withColumn("_tf_bin", F.shiftright("_tf_hash", BITS - int(math.log2(BINS))).cast("int"))
    tokens = n_words(F.col("text"))
    slots = plan(rows.select(F.col("_tf_source").alias("source"), F.col("_tf_bin").alias("bin"), tokens.alias("n")), blocks=blocks, budget=budget, **aims)
    # One bin of a source at most is cut: how far its hashes go.
    cut = slots.filter("room is not null").select(F.col("source").alias("_tf_source"), F.col("bin").alias("_tf_bin"), "room")
    part = rows.join(cut, ["_tf_source", "_tf_bin"]).groupBy("_tf_source", "_tf_hash").agg(F.sum(tokens).alias("n"), F.max("room").alias("room"))
    upto = F.sum("n").over(Window.partitionBy("_tf_source").orderBy("_tf_hash"))
    last = part.withColumn("upto", upto).filter("upto <= room").groupBy(F.col("_tf_source").alias("source")).agg(F.max("_tf_hash").alias("last"))
    given = slots.join(last, "source", "left").groupBy(F.col("source").alias("_tf_source"), F.col("bin").alias("_tf_bin")).agg(F.collect_list(F.struct("p", "block", F.when(F.col("room").isNotNull(), F.coalesce("last", F.lit(-1))).alias("last"))).alias("_tf_slots"))
    given, _ = written(given, "mix-plan")
    out = rows.join(given, ["_tf_source", "_tf_bin"]).withColumn("_tf_slot", F.explode("_tf_slots"))
    out = out.filter(F.col("_tf_slot.last").isNull() | (F.col("_tf_hash") <= F.col("_tf_slot.last")))
    order = id_hash(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("_tf_slot.p").cast("string")))
    return out.withColumns({"mix_block": F.col("_tf_slot.block"), "mix_order": order}).drop("_tf_source", "_tf_hash", "_tf_bin", "_tf_slots", "_tf_slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixed(documents(spark, sf_dir).select("doc_id", "text", "source"), evenness=EVENNESS)
    return got.select("doc_id", "source", "mix_block", "mix_order")


_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"

ORACLE = f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(source, '') AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n,
         {_HASH.format("coalesce(CAST(doc_id AS VARCHAR), '')")} AS h
  FROM documents),
binned AS (SELECT *, h >> {BITS - int(math.log2(BINS))} AS b FROM rows),
bins AS (SELECT s, b, sum(n)::BIGINT AS n FROM binned GROUP BY ALL),
sources AS (SELECT s, sum(n)::BIGINT AS total FROM bins GROUP BY s),
known AS (SELECT total::DOUBLE AS n FROM sources WHERE total > 0),
own AS (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) AS e, ln(count(*)) AS flat FROM known),
aim AS (SELECT e + {EVENNESS} * (flat - e) AS entropy FROM own),
search AS (
  SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN met THEN lo ELSE (lo + hi) / 2 END, CASE WHEN met THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT i, lo, hi, ln(sum(pow(n, (lo + hi) / 2))) - sum(pow(n, (lo + hi) / 2) * ln(n) * (lo + hi) / 2) / sum(pow(n, (lo + hi) / 2)) <= max(entropy)
               AND pow(max(n) / min(n), 1 - (lo + hi) / 2) <= {REPETITIONS} AS met
        FROM search, known, aim WHERE i < 48 GROUP BY i, lo, hi)),
picked AS (SELECT coalesce((SELECT hi FROM search ORDER BY i DESC LIMIT 1), 1) AS a),
budget AS (SELECT a, sum(pow(n, a)) AS z, pow(max(n), 1 - a) * sum(pow(n, a)) AS whole FROM known, picked GROUP BY a),
due AS (SELECT s, total, CASE WHEN total > 0 THEN round(pow(total::DOUBLE, a) / z * whole)::BIGINT ELSE 0 END AS due FROM sources, budget),
turned AS (SELECT *, unnest(range(0, CASE WHEN total > 0 THEN greatest(CAST(ceil(due / total) AS BIGINT), 1) ELSE 1 END)) AS p FROM due),
placed AS (
  SELECT s, b, p, n, due,
         p * total + coalesce(sum(n) OVER (PARTITION BY s, p ORDER BY (b * (1 + 2 * p * {TURN}) + p * {SHIFT}) % {BINS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun
  FROM bins JOIN turned USING (s)),
slots AS (
  SELECT s, b, p, CASE WHEN due > 0 THEN least(begun * {BLOCKS} // due, {BLOCKS - 1}) ELSE 0 END AS block, CASE WHEN begun + n > due THEN due - begun END AS room
  FROM placed WHERE begun + n <= due OR begun < due),
part AS (SELECT s, h, sum(n) AS n, max(room) AS room FROM binned JOIN (SELECT s, b, room FROM slots WHERE room IS NOT NULL) USING (s, b) GROUP BY s, h),
last AS (SELECT s, max(h) AS last FROM (SELECT s, h, room, sum(n) OVER (PARTITION BY s ORDER BY h) AS upto FROM part) WHERE upto <= room GROUP BY s)
SELECT doc_id, source, CAST(block AS BIGINT) AS mix_block,
       {_HASH.format("concat_ws(':', CAST(doc_id AS VARCHAR), CAST(p AS VARCHAR))")} AS mix_order
FROM binned JOIN slots USING (s, b) LEFT JOIN last USING (s)
WHERE room IS NULL OR h <= coalesce(last, -1)
"""
