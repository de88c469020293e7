"""Conversation prefix trie by heavy-path decomposition.

Every conversation is rebuilt (`rebuilt`), and a node is a distinct sequence of its first turns. Nodes are named by 128
bits: two exclusive-ors of hashes of (place, turn) over the turns, which running sums along a conversation give at every
depth. The conversations that begin with a node are its members; (smallest member, depth) names it from then on.

A node's heavy child has the most members (ties: the smallest member). Heavy children continue the path of their parent,
light ones begin a path; as a light child has at most half of its parent's members, no node lies under more than log2 of
the members' number of light ones. Totals of whole paths go up to the nodes that they hang from, one level of light
children a round, and one suffix sum along all paths then gives every node the sum over its subtree.

Running sums along conversations and paths are taken within pieces of 4096 places and over the totals of pieces, so that a
conversation or a path of any length is many small groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm._common import partitions, words_of, written

#: Powers of two: places of a piece of a conversation or path, ids of a piece of a digest.
RUN_BITS, ID_BITS = 12, 12
#: The first turns of a group of conversations come from its first: those of ids that are equal but for their rest by GROUP.
GROUP, SHARED = 20, 4
_KEY = ["k1", "k2"]


def _xor(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0).cast("bigint")).bitwiseXOR(F.coalesce(b, F.lit(0).cast("bigint")))


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0).cast("bigint")) + F.coalesce(b, F.lit(0).cast("bigint"))


#: Aggregates, and how two of their values (null: of no row) add up.
_KINDS: dict[str, tuple[Callable, Callable]] = {"bit_xor": (F.bit_xor, _xor), "max": (F.max, F.greatest), "sum": (F.sum, _plus)}


def earlier(df: DataFrame, group: list[str], at: str, totals: dict[str, tuple[str, Column]], *, back: bool = False) -> DataFrame:
    """df with totals over the rows of a group before each one (after, if back) by the whole number `at`, which is unique
    there: a name to the kind of aggregate and what it is over. df is read twice."""
    placed = df.withColumn("_tf_piece", F.shiftright(at, RUN_BITS) * (-1 if back else 1))
    inside = Window.partitionBy(*group, "_tf_piece").orderBy(F.desc(at) if back else F.asc(at)).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy("_tf_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*group, "_tf_piece").agg(*(_KINDS[kind][0](x).alias(f"_tf_{name}") for name, (kind, x) in totals.items()))
    sums = sums.withColumns({f"_tf_{name}": _KINDS[kind][0](f"_tf_{name}").over(across) for name, (kind, _) in totals.items()})
    rows = placed.withColumns({name: _KINDS[kind][0](x).over(inside) for name, (kind, x) in totals.items()}).join(sums, [*group, "_tf_piece"])
    return rows.withColumns({name: _KINDS[kind][1](F.col(name), F.col(f"_tf_{name}")) for name, (kind, _) in totals.items()}).drop("_tf_piece", *(f"_tf_{name}" for name in totals))


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place from 1, t1, t2, words) in order of turn (null first), role, text, and (conv_id, n). Rows
    without conv_id are left out. Turns are sorted by ranges, so that a long conversation is several of them."""
    spark = conversations.sparkSession
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), F.substring(text, 1, 32).alias("begins"))
    ordered = rows.repartitionByRange(partitions(spark), "conv_id", "turn", "role", "begins").sortWithinPartitions("conv_id", "turn", "role", "text")
    # A row's number in its partition goes by the order there.
    made = ordered.select("conv_id", F.monotonically_increasing_id().alias("at"), F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "role", "text").alias("t2"), F.size(words_of(F.col("text"))).cast("bigint").alias("words"))
    turns, _ = written(made, "trie-turns")
    turns = turns.withColumn("range", F.shiftright("at", 33))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = turns.groupBy("conv_id", "range").agg(F.min("at").alias("begun"), F.count(F.lit(1)).alias("n"))
    starts = ranges.select("conv_id", "range", "begun", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("held"))
    placed = turns.join(starts, ["conv_id", "range"]).select("conv_id", (F.col("at") - F.col("begun") + F.col("held") + 1).alias("place"), "t1", "t2", "words")
    return placed, ranges.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, t1, t2, words, last) of the rebuilt conversations, and their ids with lengths (conv_id,
    length): the first h = crc32(conv_id as text) mod 4 turns of conversation conv_id - conv_id % 20 (as many as it has),
    then one's own after the first h."""
    turns, sizes = numbered(conversations)
    turns, _ = written(turns, "trie-places")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    sizes = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", h)
    heads = sizes.select(F.col("conv_id").alias("base"), F.least("n", F.lit(SHARED - 1)).alias("base_n"))
    whole = sizes.join(heads, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
    whole, _ = written(whole.select("conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-conversations")
    first = turns.filter((F.col("place") < SHARED) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    lent = whole.join(first, "base").filter("place <= lent").select("conv_id", F.col("place").alias("depth"), "t1", "t2", "words", "length")
    own = turns.join(whole, "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("depth"), "t1", "t2", "words", "length")
    every = lent.unionByName(own).select("conv_id", "depth", "t1", "t2", "words", (F.col("depth") == F.col("length")).alias("last"))
    return every, whole.select("conv_id", "length")


def _digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) from (conv_id, depth, member). Members are packed in pieces by their upper bits, of 4096 ids at most; the pieces of a
    node then stream through its digest in order."""
    pieces = ends.groupBy("conv_id", "depth", F.shiftright("member", ID_BITS).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda x: x.cast("string")), ",").alias("ids"))
    dealt = pieces.repartition(partitions(ends.sparkSession), "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "piece")
    names = ["conv_id", "depth", "ends_sha256"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in it:
            done = []
            for conv, depth, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (conv, depth) == now:
                    digest.update(b",")
                else:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = (conv, depth), hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, digest.hexdigest())], names)

    return dealt.select("conv_id", "depth", "ids").mapInArrow(run, "conv_id bigint, depth bigint, ends_sha256 string")


def _nodes(turns: DataFrame, root: int) -> tuple[DataFrame, DataFrame]:
    """Nodes under the root: (conv_id, depth, parent, n_convs, own, leaf, n_children, level, path, path_depth), and
    (conv_id, depth, member) of the conversations that end in them. `level` counts the light nodes down to a node; a path is
    named by its first node."""
    hashed = turns.select("conv_id", F.col("depth").cast("bigint").alias("depth"), F.xxhash64("t1", "t2", "depth").alias("x1"), F.xxhash64("t2", "t1", "depth").alias("x2"), "words", "last")
    hashed, _ = written(hashed, "trie-hashed")
    chain = earlier(hashed, ["conv_id"], "depth", {"p1": ("bit_xor", F.col("x1")), "p2": ("bit_xor", F.col("x2"))})
    chain, _ = written(chain.select("conv_id", "depth", "p1", "p2", _xor(F.col("p1"), F.col("x1")).alias("k1"), _xor(F.col("p2"), F.col("x2")).alias("k2"), "words", "last"), "trie-chain")
    nodes = chain.groupBy("depth", *_KEY).agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes, _ = written(nodes, "trie-nodes")
    best = F.max(F.struct("n_convs", (-F.col("node")).alias("low"), *_KEY)).alias("heavy")
    parents = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"), best)
    parents, _ = written(parents, "trie-parents")
    heavy = parents.select((F.col("depth") + 1).alias("depth"), F.col("heavy.k1").alias("k1"), F.col("heavy.k2").alias("k2"), F.lit(False).alias("light"))
    known = nodes.join(heavy, ["depth", *_KEY], "left").join(parents.drop("heavy"), ["depth", *_KEY], "left")
    told = known.select("depth", *_KEY, "node", "n_convs", (F.col("words") * (F.col("n_convs") - 1)).alias("own"), F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("light", F.lit(True)).alias("light"))
    along, _ = written(chain.select("conv_id", "depth", *_KEY, "last").join(told, ["depth", *_KEY]).drop(*_KEY), "trie-along")
    at = F.struct("depth", "node")
    above = earlier(along, ["conv_id"], "depth", {"parent": ("max", at), "head": ("max", F.when(F.col("light"), at)), "lights": ("sum", F.col("light").cast("bigint"))})
    top = F.struct(F.lit(0).cast("bigint").alias("depth"), F.lit(root).cast("bigint").alias("node"))
    # Each node once, as its smallest member sees it.
    seen = above.filter("conv_id = node").withColumns({"head": F.coalesce("head", top), "parent": F.coalesce("parent", top)})
    seen = seen.select("conv_id", "depth", F.col("parent.node").alias("parent"), "n_convs", "own", "n_children", "light", (_plus(F.col("lights"), F.col("light").cast("bigint"))).alias("level"), F.when(F.col("light"), F.col("conv_id")).otherwise(F.col("head.node")).alias("path"), F.when(F.col("light"), F.col("depth")).otherwise(F.col("head.depth")).alias("path_depth"), F.col("head.node").alias("from_path"), F.col("head.depth").alias("from_depth"))
    out, _ = written(seen, "trie-seen")
    return out, along.filter("last").select(F.col("node").alias("conv_id"), "depth", F.col("conv_id").alias("member"))


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    Turns are ordered by turn (null first), equal ones by role, then text (UTF-8 bytes); null role or text is empty; equal
    rows are turns of their own. Rows without conv_id are left out; without others, there is no node, and no row. Other
    columns don't matter.
    """
    turns, convs = rebuilt(conversations)
    none = hashlib.sha256().hexdigest()
    root, members = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if root is None:
        return convs.select(*(F.lit(None).cast("string" if c == "ends_sha256" else "bigint").alias(c) for c in names)).limit(0)
    nodes, ends = _nodes(turns, root)
    children = nodes.filter("depth = 1").count()
    given = {"conv_id": root, "depth": 0, "parent": None, "n_convs": members, "own": 0, "n_children": children, "level": 0, "path": root, "path_depth": 0, "from_path": None, "from_depth": None}
    top = conversations.sparkSession.range(1).select(*(F.lit(x).cast("bigint").alias(c) for c, x in given.items()), F.lit(True).alias("light"))
    every = nodes.unionByName(top).withColumn("leaves", (F.col("n_children") == 0).cast("bigint"))
    every, _ = written(every, "trie-every")
    hung = _hung(every)
    sums = every.join(hung, ["conv_id", "depth"], "left").withColumns({"own": _plus(F.col("own"), F.col("hung_own")), "leaves": _plus(F.col("leaves"), F.col("hung_leaves"))})
    sums, _ = written(sums.select("conv_id", "depth", "parent", "n_convs", "n_children", "own", "leaves", "path", "path_depth"), "trie-sums")
    below = earlier(sums, ["path", "path_depth"], "depth", {"more": ("sum", F.col("own")), "more_leaves": ("sum", F.col("leaves"))}, back=True)
    at_root = convs.filter("length = 0").select(F.lit(root).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), F.col("conv_id").alias("member"))
    made = below.join(_digests(ends.unionByName(at_root)), ["conv_id", "depth"], "left")
    return made.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", _plus(F.col("leaves"), F.col("more_leaves")).alias("n_leaves"), _plus(F.col("own"), F.col("more")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def _hung(every: DataFrame) -> DataFrame:
    """(conv_id, depth, hung_own, hung_leaves): what the light children of a node hold in all of their subtrees. Rounds go
    from the deepest level of light nodes to the root's path."""
    paths = every.groupBy("path", "path_depth").agg(F.max("level").alias("level"), F.sum("own").alias("own"), F.sum("leaves").alias("leaves"), F.max(F.when(F.col("light"), F.struct("parent", "from_path", "from_depth"))).alias("above"))
    paths = paths.select("path", "path_depth", "level", "own", "leaves", F.col("above.parent").alias("parent"), "above.from_path", "above.from_depth")
    deepest = every.agg(F.max("level")).first()[0]
    paths, _ = written(paths, "trie-paths", by="level")
    hung: list[DataFrame] = []
    sent = None  # totals of the level below, for the paths that they hang from
    for level in range(deepest, 0, -1):
        here = paths.filter(F.col("level") == level)
        if sent is not None:
            here = here.join(sent, ["path", "path_depth"], "left").withColumns({"own": _plus(F.col("own"), F.col("sent_own")), "leaves": _plus(F.col("leaves"), F.col("sent_leaves"))})
        here, _ = written(here.select("path", "path_depth", "parent", "from_path", "from_depth", "own", "leaves"), f"trie-level-{level}")
        sent = here.groupBy(F.col("from_path").alias("path"), F.col("from_depth").alias("path_depth")).agg(F.sum("own").alias("sent_own"), F.sum("leaves").alias("sent_leaves"))
        hung.append(here.select(F.col("parent").alias("conv_id"), (F.col("path_depth") - 1).alias("depth"), "own", "leaves"))
    if not hung:
        return every.select("conv_id", "depth", F.lit(0).cast("bigint").alias("hung_own"), F.lit(0).cast("bigint").alias("hung_leaves")).limit(0)
    out = hung[0]
    for x in hung[1:]:
        out = out.unionByName(x)
    return out.groupBy("conv_id", "depth").agg(F.sum("own").alias("hung_own"), F.sum("leaves").alias("hung_leaves"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: For small tables: prefixes as lists. crc32 by a table of 256 values, which a rule makes.
_STEP = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
ORACLE = f"""
WITH RECURSIVE
bits AS (SELECT i, CAST(i AS BIGINT) AS x, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, {_STEP.format(x="x")}, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(x ORDER BY i) AS t FROM bits WHERE k = 8),
turns AS (SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list(v ORDER BY place) AS own FROM turns GROUP BY conv_id),
hashed AS (
  SELECT conv_id, own, xor(list_reduce([CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(conv_id AS VARCHAR), '')], lambda x, b: xor(t[(xor(x, b) & 255) + 1], x >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % {SHARED} AS h
  FROM lists, crc),
whole AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h], h.own[h + 1:]) AS v FROM hashed h LEFT JOIN lists b ON b.conv_id = h.conv_id - h.conv_id % {GROUP}),
spread AS (SELECT conv_id, v, unnest(range(0, len(v) + 1)) AS depth FROM whole),
prefixes AS (SELECT conv_id, depth, v[1:depth] AS p, v[1:depth - 1] AS above, depth = len(v) AS last FROM spread),
nodes AS (
  SELECT depth, p, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends
  FROM prefixes GROUP BY depth, p),
tied AS (
  SELECT n.*, m.conv_id AS parent_conv_id, (n.n_convs - 1) * len(list_filter(string_split_regex(coalesce(n.p[n.depth].t, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS own
  FROM nodes n LEFT JOIN nodes m ON n.depth > 0 AND m.depth = n.depth - 1 AND m.p = n.above),
children AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS c FROM tied WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT t.*, coalesce(c, 0) AS n_children FROM tied t LEFT JOIN children USING (depth, conv_id)),
up AS (
  SELECT conv_id AS top, depth AS top_depth, parent_conv_id, depth, own, CAST(n_children = 0 AS BIGINT) AS leaf FROM counted
  UNION ALL SELECT t.conv_id, t.depth, t.parent_conv_id, t.depth, u.own, u.leaf FROM up u JOIN counted t ON u.depth > 0 AND t.depth = u.depth - 1 AND t.conv_id = u.parent_conv_id),
sums AS (SELECT top AS conv_id, top_depth AS depth, CAST(sum(own) AS BIGINT) AS saved_tokens, CAST(sum(leaf) AS BIGINT) AS n_leaves FROM up GROUP BY ALL)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
FROM counted JOIN sums USING (conv_id, depth)
"""
