"""Quality rules: base statistics of each text, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into a fixed number of bins. Two multinomials are counted: one over
trusted documents (a bounded sample of the labelled ones, `max_trusted`), one over every document of the corpus. A
document's score is the mean over its n-grams of log(p_trusted / p_corpus); it passes at `threshold` or above. A bin's
trusted count is drawn towards what the corpus lets expect, so that a bin that trusted text is too scarce to show scores
about 0. Labelled documents are scored without the trusted ones of their own fold, and the threshold comes from these
scores. The tables of ratios are bounded by the number of bins. DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm._common import BLANKS, documents, let, words_of, written

#: Bins of the hashed n-grams; documents of a label at most (lowest hashes of their ids); added to each bin's count.
BINS, MAX_TRUSTED, SMOOTHING = 1 << 14, 20_000, 1.0
#: Parts of the labelled documents, each scored without its own.
FOLDS = 4
#: Words under which the base rule rejects.
LEAST_WORDS = 50


def _bin(hashed: Column, bins: int) -> Column:
    return F.pmod(hashed, F.lit(bins)).cast("int")


def _runs(hashes: Column, size: int) -> Column:
    """Hashes of all runs of `size` words, from the words' hashes."""
    run = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))
    return let(hashes, lambda h: F.when(F.size(h) >= size, run(h)).otherwise(F.array().cast("array<bigint>")))


def grams(hashes: Column, bins: int) -> Column:
    """Bins of the words, then of the pairs of neighbouring words."""
    return F.concat(F.transform(hashes, lambda x: _bin(x, bins)), F.transform(_runs(hashes, 2), lambda x: _bin(x, bins)))


def repeat_words(words: Column, windows: Column) -> Column:
    """How many words lie in a 3-word window that the text has twice or more; windows: hashes of all windows.

    Texts without an equal pair of hashes are done. In others, windows whose hash comes twice are compared by their words,
    so the count is exact at any length.
    """

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")))["n"]

    def beside(sorted_: Column, same: Callable[[Column, Column], Column]) -> Column:
        """The elements that are the same as the one before or after."""
        either = lambda s, e, j: F.coalesce(same(e, F.get(s, j - 1)), F.lit(False)) | F.coalesce(same(e, F.get(s, j + 1)), F.lit(False))
        return let(sorted_, lambda s: F.filter(s, lambda e, j: either(s, e, j)))

    def starts(h: Column, w: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        likely = beside(placed, lambda a, b: a["h"] == b["h"])
        spelt = F.sort_array(F.transform(likely, lambda e: F.struct(F.struct(*(F.get(w, e["i"] + k).alias(f"w{k}") for k in range(3))).alias("w"), e["i"].alias("i"))))
        return F.sort_array(F.transform(beside(spelt, lambda a, b: a["w"] == b["w"]), lambda e: e["i"]))

    some = lambda h, w: F.when(F.size(F.array_distinct(h)) < F.size(h), let(starts(h, w), covered)).otherwise(F.lit(0))
    return let(windows, lambda h: let(words, lambda w: some(h, w))).cast("bigint")


def statistics(text: Column, words: Column, hashes: Column) -> dict[str, Column]:
    """Base statistics by name, from a text, its words and their hashes; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeat_words(words, _runs(hashes, 3)),
    }


def trusted_ids(labels: DataFrame, most: int = MAX_TRUSTED) -> DataFrame:
    """doc_id of labelled good documents, `most` at most, by the lowest hashes."""
    ids = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("trusted_id")).distinct()
    return ids.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(most)


def marked(labels: DataFrame, most: int = MAX_TRUSTED) -> DataFrame:
    """(marked_id, good, fold) of labelled documents, `most` of each label at most; good wins. Folds count from 1."""
    good = trusted_ids(labels, most).select(F.col("trusted_id").alias("marked_id"), F.lit(1).alias("good"))
    bad = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("marked_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"))
    bad = bad.filter("good = 0").orderBy(F.xxhash64("marked_id"), "marked_id").limit(most)
    return good.unionByName(bad).withColumn("fold", (F.pmod(F.xxhash64("marked_id", F.lit(FOLDS)), F.lit(FOLDS)) + 1).cast("int"))


def ratios(rows: DataFrame, marks: DataFrame, *, bins: int = BINS, smoothing: float = SMOOTHING) -> list[list[float]]:
    """From rows (doc_id, _tf_bins): log(p_trusted / p_corpus) of each bin, by all trusted documents, then without each
    fold. Without trusted text all are 0, and nothing is rejected.

    The ratio is (t + smoothing) / (e + smoothing) for t n-grams counted and e expected at the corpus's share.
    """
    flagged = rows.join(F.broadcast(marks.filter("good = 1")), F.col("doc_id").cast("bigint") == F.col("marked_id"), "left")
    counted = flagged.select("fold", F.explode("_tf_bins").alias("bin"))
    sums = [F.count(F.when(F.col("fold") == k, 1)).alias(f"t{k}") for k in range(1, FOLDS + 1)]
    counts = {r["bin"]: (r["n"], *(r[f"t{k}"] for k in range(1, FOLDS + 1))) for r in counted.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    none = (0,) * (FOLDS + 1)
    every, out = sum(x[0] for x in counts.values()), []
    for left_out in range(FOLDS + 1):
        used = [k for k in range(1, FOLDS + 1) if k != left_out]
        good = sum(x[k] for x in counts.values() for k in used)
        both = ((sum(x[k] for k in used), x[0]) for x in (counts.get(b, none) for b in range(bins)))
        out.append([math.log((t + smoothing) / (good * n / every + smoothing)) if good else 0.0 for t, n in both])
    return out


def held(spark: SparkSession, tables: list[list[float]]) -> DataFrame:
    """Tables of ratios, one after another, as the one value of a written row. As a literal their 1.6 MB of text would stand
    in each description of each plan that the driver keeps."""
    return written(spark.createDataFrame([([x for table in tables for x in table],)], "ratios array<double>"), "quality-ratios")[0]


def score(own: Column, tables: Column, bins: int, fold: Column) -> Column:
    """Mean log ratio of a text's n-grams (their bins) in their order, by the table (of those in `tables`, one after another)
    of its fold (null: by all); 0 without."""
    start = F.coalesce(fold, F.lit(0)) * bins
    total = lambda t, b: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(t, start + x))
    return let(tables, lambda t: let(own, lambda b: F.when(F.size(b) > 0, total(t, b) / F.size(b)).otherwise(F.lit(0.0))))


def parting(good: list[float], bad: list[float]) -> float:
    """The threshold that best parts held-out scores: the one with the largest sum of the share of good ones that it
    keeps and of bad ones that it rejects, in the middle of its gap; of equal ones the lowest. Without bad ones, the
    lowest good score; without good ones nothing is rejected."""
    if not good or not bad:
        return min(good, default=-math.inf)
    best, at, won = 0.0, -math.inf, 0.0
    scores = sorted([(x, 1) for x in good] + [(x, 0) for x in bad])
    for k, (x, is_good) in enumerate(scores):
        won += -1 / len(good) if is_good else 1 / len(bad)
        above = scores[k + 1][0] if k + 1 < len(scores) else math.inf
        if above > x and won > best + 1e-12:
            best, at = won, (x + above) / 2
    return at


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def assessed(docs: DataFrame, labels: DataFrame, *, threshold: float | None = None, bins: int = BINS, max_trusted: int = MAX_TRUSTED, texts: bool = True) -> DataFrame:
    """docs with the base statistics, `base_failed`, `llr` and `kept`; columns of those names are replaced. `texts`: whether
    the text is among the columns.

    A null text is empty: no words, so it fails the base rule (under 50 words). Null ids are never trusted but are
    assessed. Each repeated row is assessed by itself. Without a threshold, the one that best parts the held-out scores of
    labelled documents of 50 words or more is taken. Texts are read once: statistics and bins are written, and corpus
    counts, threshold and scores come from there.
    """
    marks, _ = written(marked(labels, max_trusted), "quality-marks")
    rows = docs.drop(*_NAMES, "_tf_words", "_tf_hashes", "_tf_bins", "_tf_ratios").withColumn("_tf_words", words_of(F.col("text")))
    rows = rows.withColumn("_tf_hashes", F.transform("_tf_words", lambda w: F.xxhash64(w)))
    rows = rows.withColumns(statistics(F.col("text"), F.col("_tf_words"), F.col("_tf_hashes")) | {"_tf_bins": grams(F.col("_tf_hashes"), bins)})
    rows, _ = written(rows.drop("_tf_words", "_tf_hashes", *([] if texts else ["text"])), "quality-statistics")
    tables = held(docs.sparkSession, ratios(rows.select("doc_id", "_tf_bins"), marks, bins=bins))
    # A column of its own, as analysis allows no subquery among a function's lambdas; it is named once, so that it is put in
    # there again and no row carries it.
    scored = lambda df: df.withColumn("_tf_ratios", tables.scalar()).withColumn("llr", score(F.col("_tf_bins"), F.col("_tf_ratios"), bins, F.col("_tf_fold"))).drop("_tf_ratios")
    known = F.broadcast(marks.toDF("_tf_id", "_tf_good", "_tf_fold"))
    same = rows["doc_id"].cast("bigint") == known["_tf_id"]
    if threshold is None:
        seen = scored(rows.filter(F.col("n_words") >= LEAST_WORDS).join(known, same)).select("_tf_good", "llr").collect()
        threshold = parting([r["llr"] for r in seen if r["_tf_good"]], [r["llr"] for r in seen if not r["_tf_good"]])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = scored(rows.join(known, same, "left").withColumn("base_failed", failed))
    return judged.drop("_tf_bins", "_tf_id", "_tf_good", "_tf_fold").withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), texts=False)


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the base rule, from the operator."""
    return query(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
parts AS (SELECT rid, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS line FROM docs),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM parts GROUP BY rid),
places AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM places),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM windows, range(0, 3) t(k) WHERE n > 1 GROUP BY rid)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
       coalesce(covered.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(w) AS base_failed
FROM docs LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)
"""
