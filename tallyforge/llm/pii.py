"""Personal data: patterns propose spans, validators confirm them, nearby words adjust the score.

Each kind has a pattern, a validator (digit counts, Luhn, mod-97, octet range), a score of its own and context words
that raise it. A span stands when its score reaches the threshold. The base kinds (email, ip, card, phone) have a score
that stands alone; further kinds need a checksum or a context word. DataFrame functions only; positions are code points.

A pattern's matches come with their places from one split: the pieces between matches and the matches alternate, so a
running sum of their lengths is each span's start. Patterns are written without nested repetition, so that neither long
digit runs nor long words make matching slow or deep.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm._common import documents, let

#: A span stands from this score; code points before and after it in which context words count.
THRESHOLD, BEFORE, AFTER = 0.5, 40, 20
#: Stands for a blank or hyphen between two digits of a number, so that a number is one run of one class.
_JOIN = "\ue000"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def _luhn(x: Column) -> Column:
    """Whether the digits of x pass the Luhn check."""
    figures = F.transform(F.split(F.reverse(_digits(x)), ""), lambda d: d.try_cast("int"))
    known = F.filter(figures, lambda d: d.isNotNull())
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(known, lambda d, i: F.when(i % 2 == 1, double(d)).otherwise(d)), F.lit(0), lambda a, d: a + d) % 10 == 0


def _mod97(x: Column) -> Column:
    """Whether an account number (two letters, two check digits, the rest) leaves 1 at division by 97."""
    plain = F.regexp_replace(x, "[^A-Z0-9]+", "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    turned = F.filter(F.split(F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(F.transform(turned, value), F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda x: F.length(_digits(x)).between(low, high)


class Kind(NamedTuple):
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    bonus: float
    joined: bool = False  # matched where _JOIN stands for separators within numbers


_OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
_LOCAL = "[A-Za-z0-9._%+-]"

#: In the order in which kinds of one start are listed. The first four are the base and always reach the threshold.
KINDS = (
    # \G: right after a match, where a new one may begin within a run of the first class.
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda x: F.lit(True), 0.9, "e-?mail|contact|mailto", 0.1),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda x: x.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"), 0.6, r"\bip\b|host|server|address|login", 0.3),
    Kind("card", rf"(?<![0-9{_JOIN}])[0-9][0-9{_JOIN}]{{13,37}}+(?![0-9{_JOIN}])", lambda x: F.length(_digits(x)).between(14, 19) & _luhn(x), 0.7, "card|visa|master|amex|credit|debit|pay", 0.3, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _between(10, 15), 0.7, "phone|tel|call|mobile|fax|whatsapp", 0.3),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", lambda x: F.length(F.regexp_replace(x, " ", "")).between(15, 34) & _mod97(x), 0.8, "iban|account|bank|konto|compte|cuenta", 0.2),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda x: F.lit(True), 0.3, r"\bssn\b|social security|tax id", 0.5),
    Kind("local_phone", r"(?<![0-9+(])(?<!\+[0-9]{1,3}\x20)\(?[0-9]{3}(?:\)\x20?|[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])", _between(10, 10), 0.3, "phone|tel|call|mobile|fax|whatsapp", 0.4),
    Kind("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[A-Za-z0-9_]{24,64})(?![0-9A-Za-z_])", lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]"), 0.2, "token|secret|passw|api.?key|access.?key|credential", 0.5),
)
BASE = ("email", "ip", "card", "phone")

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _matches(text: Column, pattern: str) -> Column:
    """array<(start, end, match)> of a pattern's matches from the left, without overlaps."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def places(pieces: Column, found: Column) -> Column:
        pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("match")))

        def step(a: Column, p: Column) -> Column:
            start = a["at"] + p["gap"]
            return F.struct((start + p["size"]).alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), (start + p["size"]).alias("end"), p["match"].alias("match")))).alias("out"))

        return F.aggregate(pairs, zero, step)["out"]

    some = lambda found: F.when(F.size(found) > 0, places(F.split(text, pattern, -1), found)).otherwise(zero["out"])
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def _spans(text: Column, joined: Column, rank: int) -> Column:
    kind = KINDS[rank]

    def scored(m: Column) -> Column:
        near = F.lower(F.concat(F.substring(text, F.greatest(m["start"] - BEFORE + 1, F.lit(1)), F.least(m["start"], F.lit(BEFORE))), F.lit(" "), F.substring(text, m["end"] + 1, F.lit(AFTER))))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), kind.bonus).otherwise(0.0)
        return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind.name).alias("kind"), F.round(score, 2).alias("score"))

    found = F.filter(_matches(joined if kind.joined else text, kind.pattern), lambda m: kind.valid(m["match"]))
    return F.filter(F.transform(found, scored), lambda s: s["score"] >= THRESHOLD).cast(_SPAN)


def found(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with `pii`: array of (start, rank, end, kind, score) by start, then kind as listed; a column of that name is
    replaced. A null or empty text has none. A further kind's span that overlaps a base one is left out."""
    one = F.col("_tf_text")
    base, more = range(len(BASE)), range(len(BASE), len(KINDS))
    rows = docs.drop("pii", "_tf_text", "_tf_joined", "_tf_base", "_tf_more").withColumn("_tf_text", F.coalesce(F.col(text), F.lit("")))
    free = F.when(F.contains(one, F.lit(_JOIN)), F.translate(one, _JOIN, "\ue001")).otherwise(one)
    rows = rows.withColumn("_tf_joined", F.regexp_replace(free, r"[\x20-](?=[0-9])(?<=[0-9][\x20-])", _JOIN))
    rows = rows.withColumn("_tf_base", F.concat(*(_spans(one, F.col("_tf_joined"), k) for k in base)))
    rows = rows.withColumn("_tf_more", F.concat(*(_spans(one, F.col("_tf_joined"), k) for k in more)))
    apart = F.filter("_tf_more", lambda s: ~F.exists("_tf_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.withColumn("pii", F.when(F.size("_tf_base") + F.size("_tf_more") > 0, F.array_sort(F.concat("_tf_base", apart))).otherwise(F.col("_tf_base"))).drop("_tf_text", "_tf_joined", "_tf_base", "_tf_more")


def masked(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs whose text has each span replaced by its kind in angle brackets; of overlapping spans the first one counts."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    one = F.col(text)
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(one, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out")))
    end = F.aggregate("pii", zero, step)
    return found(docs, text=text).withColumn("_tf_end", end).withColumn(text, F.when(F.size("pii") > 0, F.concat("_tf_end.out", F.substring(one, F.col("_tf_end.at") + 1, F.length(one)))).otherwise(one)).drop("_tf_end")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii")
    own = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k.name)).cast("bigint").alias(f"n_{k.name}")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    return rows.select("doc_id", *map(own, KINDS[: len(BASE)]), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.size("pii").cast("bigint").alias("n_pii"), *map(own, KINDS[len(BASE) :]))


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the base kinds, from the operator."""
    return query(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256")


#: Base patterns as the contract has them: matches from the left, then those that fail are dropped.
_BASE_PATTERNS = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+",
    "ip": "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)",
    "card": "[0-9](?:[\\x20-]?[0-9])+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}


def _base_sql(rank: int, kind: str) -> str:
    """Matches of a kind with their places: pieces between matches and matches alternate."""
    pattern = _BASE_PATTERNS[kind]
    return f"""
  SELECT rid, {rank} AS rank, '{kind}' AS kind, m, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS begun
  FROM (SELECT rid, gaps, found, unnest(found) AS m, unnest(range(1, len(found) + 1)) AS k
        FROM (SELECT rid, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS found FROM docs))"""


BASE_ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({" UNION ALL ".join(_base_sql(k, kind) for k, kind in enumerate(BASE))}),
figured AS (SELECT *, regexp_replace(m, '[^0-9]+', '', 'g') AS figures FROM matches),
checked AS (
  SELECT *, CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) <= 255))
    WHEN 'phone' THEN length(figures) BETWEEN 10 AND 15
    ELSE length(figures) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(figures) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN CAST(substr(figures, length(figures) - i + 1, 1) AS INTEGER)
           ELSE (2 * CAST(substr(figures, length(figures) - i + 1, 1) AS INTEGER)) // 10 + (2 * CAST(substr(figures, length(figures) - i + 1, 1) AS INTEGER)) % 10 END)) % 10 = 0 END AS good
  FROM figured),
listed AS (
  SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
         count(*) FILTER (kind = 'phone') AS n_phone, string_agg(kind || ':' || CAST(begun AS BIGINT) || ':' || CAST(begun + length(m) AS BIGINT), ',' ORDER BY begun, rank) AS spans
  FROM checked WHERE good GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM docs LEFT JOIN listed USING (rid)
"""
