"""Near-duplicate linking shared by documents and lines.

Items are texts. A text's name is 128 bits (`names`); banding runs on its first half, and what shares a band is told apart
by both, so that no two texts are taken for one. Steps:

1. `blobs` packs each item's banded MinHash keys by bucket; `groups` finds the keys that several items share. Blobs are
   read one after another, and a bucket keeps one item a key; buckets are as many as keep each at ENTRIES keys.
2. `Linker` compares each item with the first item of the groups that it is in, with the one that it shares most groups
   with (star pairs, not all pairs). Groups that then still hold several components are open: of up to FEW items all pairs
   between components are tried, each pair once however many groups it is in; of more, the items outside the largest
   component meet the others in cells of BLOCK by BLOCK items, behind a 64-bit sketch. No link is lost between items that
   share a band.
3. Each pair is verified sequentially: batches of the signature narrow the posterior of the similarity (uniform prior),
   and a pair is dropped as soon as P(similarity >= threshold) falls under `miss`; survivors are compared on full sets.
4. `components` is a distributed union-find (alternating large and small stars) over the links, at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm._common import partitions, remove, written
from tallyforge.llm.hashing import BASE, mixed

#: Of a band key, 48 bits beside its bucket: two keys of a bucket of ENTRIES meet by chance with probability 0.007.
_ENTRY = np.dtype([("low", "<u4"), ("more", "<u2"), ("id", "<i8")])
_KEY = np.dtype([("key", "<u8"), ("id", "<i8")])
_U = np.uint64

#: Hashes of a chunk that stays in the cache; entries of a bucket; entries that are sorted at once; items of a side of a
#: cell; edges that a task unites before it hands them on; items of a group whose pairs are tried one by one.
CHUNK, ENTRIES, AT_ONCE, BLOCK, EDGES, FEW = 1 << 15, 2_000_000, 2_000_000, 512, 1_000_000, 16
#: Hashes that are looked at together when pairs of a cell are compared, and such pairs: in the first part, at most.
BITS, FIRST, PAIRS = 1 << 13, 1 << 12, 1 << 15
#: Where bands are made `by_class`: classes of the hashes of a set, each with its own part of the bands, and hashes of a chunk.
CLASSES, LONG = 2, 1 << 16
#: Pairs whose texts are held as sets at once; pairs of a cell that are compared one by one.
AT_HAND, LITTLE = 512, 64
#: Ids that may be broadcast (16 bytes each); more are joined by two shuffles.
SMALL = 1_000_000


def names(text: Column) -> list[Column]:
    """A text's name: two 64-bit hashes of different seeds, as columns id and chk."""
    return [F.xxhash64(text).alias("id"), F.xxhash64(F.lit(1), text).alias("chk")]


def bucket_count(spark: SparkSession, items: int, bands: int) -> int:
    return max(partitions(spark), -(-items * bands // ENTRIES))


def multipliers(n: int) -> np.ndarray:
    """Odd multipliers of the hash family (as many as asked for, from one rule)."""
    return (mixed(np.arange(1, n + 1, dtype=np.uint64) * _U(BASE)) >> _U(32)).astype(np.uint32) | np.uint32(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash signatures (rows of n uint32) of non-empty sets of 64-bit hashes."""
    out, at = np.empty((len(sets), n), np.uint32), 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= CHUNK):
            size += len(sets[to])
            to += 1
        out[at:to] = flat_signatures(np.concatenate(sets[at:to]), np.cumsum([0, *(len(s) for s in sets[at : to - 1])]), n)
        at = to
    return out


def flat_signatures(flat: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Signatures of sets that lie one after another, each from its start; hashes may repeat within a set."""
    out, family = np.empty((len(starts), n), np.uint32), multipliers(n)
    high = (flat >> _U(32)).astype(np.uint32)
    held = np.empty_like(high)
    for k in range(n):
        np.multiply(high, family[k], out=held)
        out[:, k] = np.minimum.reduceat(held, starts)
    return out


def by_class(flat: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures for banding of sets of 32-bit hashes that lie one after another (hashes may repeat), and which of the
    CLASSES parts of a signature come from any hash at all.

    A hash's last bits are its class, and each class alone makes its own part of the signature: half of the products. More
    classes spare more, but let more short lines of little likeness share a band. A pair's similarity is the mean of those of its classes, by their sizes; as log(1 - x ** rows) is concave, classes that
    differ in similarity make it less likely, not more, that all bands miss the pair. A class of which a set has no hash
    has no say. Matches over a whole signature are no binomial count, so the sequential test has `flat_signatures`.
    """
    part = n // CLASSES
    family, out, some = multipliers(part), np.zeros((n, len(starts)), np.uint32), np.zeros((CLASSES, len(starts)), bool)
    kind = flat.astype(np.uint8) & np.uint8(CLASSES - 1)
    for c in range(CLASSES):
        own = np.flatnonzero(kind == c)
        begun = np.searchsorted(own, starts)
        some[c] = np.diff(np.append(begun, len(own))) > 0
        begun, own = begun[some[c]], flat[own]
        held, whole = np.empty_like(own), some[c].all()
        for k in range(part if len(own) else 0):
            np.multiply(own, family[k], out=held)
            if whole:
                np.minimum.reduceat(held, begun, out=out[c * part + k])
            else:
                out[c * part + k, some[c]] = np.minimum.reduceat(held, begun)
    return out.T, some.T


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """64-bit keys (items x bands) of signatures cut into bands of equal rows."""
    rows = sig.shape[1] // bands
    h = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
    for r in range(rows):
        h = mixed(h * _U(BASE) + sig[:, r : rows * bands : rows].astype(np.uint64))
    return h


def sketch(sig: np.ndarray) -> np.ndarray:
    """One bit of each of the first 64 MinHashes, as int64."""
    bits = (mixed(sig[:, :64].astype(np.uint64) + _U(1)) & _U(1)) << np.arange(min(64, sig.shape[1]), dtype=np.uint64)
    return bits.sum(axis=1, dtype=np.uint64).view(np.int64)


def blobs(ids: np.ndarray, keys: np.ndarray, buckets: int, some: np.ndarray | None = None) -> list[tuple[int, bytes]]:
    """Entries (key, id) by bucket of the key; some: which of the keys count (all)."""
    ids, keys = np.repeat(ids, keys.shape[1]), keys.ravel()
    if some is not None and not some.all():
        ids, keys = ids[some.ravel()], keys[some.ravel()]
    flat = np.empty(keys.size, _ENTRY)
    flat["low"], flat["more"], flat["id"] = keys & _U(0xFFFFFFFF), (keys >> _U(32)) & _U(0xFFFF), ids
    # 16-bit numbers are sorted by radix.
    bucket = (mixed(keys) % _U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    flat, cuts = flat[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, flat[cuts[b] : cuts[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(cuts)).tolist()]


def _grouped(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs in order of bucket to (g, id, rep): the members of each key that several items share."""
    now: int | None = None
    held: list[bytes] = []
    size = 0
    keys, reps, told = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)

    def absorb() -> Iterator[pa.RecordBatch]:
        nonlocal keys, reps, told, held, size
        x = np.frombuffer(b"".join(held), _ENTRY)
        held, size = [], 0
        key = x["more"].astype(np.uint64) << _U(32) | x["low"]
        order = np.argsort(key)
        key, ids = key[order], x["id"][order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        low = np.minimum.reduceat(ids, first)  # a new key's item is its smallest id
        at = np.searchsorted(keys, key[first])
        old = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == key[first]) if len(keys) else np.zeros(len(first), bool)
        several = np.repeat(old | (np.diff(np.append(first, len(key))) > 1), np.diff(np.append(first, len(key))))
        if len(keys):
            keys, reps, told = np.concatenate((keys, key[first][~old])), np.concatenate((reps, low[~old])), np.concatenate((told, np.zeros((~old).sum(), bool)))
            order = np.argsort(keys)
            keys, reps, told = keys[order], reps[order], told[order]
        else:
            keys, reps, told = key[first], low, np.zeros(len(first), bool)
        x = np.empty(several.sum(), _KEY)
        x["key"], x["id"] = key[several], ids[several]
        x = x[np.lexsort((x["id"], x["key"]))]
        x = x[np.concatenate(([True], (x["key"][1:] != x["key"][:-1]) | (x["id"][1:] != x["id"][:-1])))[: len(x)]]
        at = np.searchsorted(keys, x["key"])
        other = x["id"] != reps[at]
        g, ids, to = at[other], x["id"][other], reps[at[other]]
        begun = np.unique(g)
        begun = begun[~told[begun]]
        told[begun] = True
        g, ids, to = np.concatenate((g, begun)), np.concatenate((ids, reps[begun])), np.concatenate((to, reps[begun]))
        if len(g):
            yield pa.RecordBatch.from_arrays([pa.array((keys[g] ^ _U((now << 48) % (1 << 64))).view(np.int64)), pa.array(ids), pa.array(to)], ["g", "id", "rep"])

    for batch in it:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != now or size > AT_ONCE:
                if held:
                    yield from absorb()
                if bucket != now:
                    now, keys, reps, told = bucket, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
            held.append(data.as_py())
            size += len(held[-1]) // _ENTRY.itemsize
    if held:
        yield from absorb()


def groups(entries: DataFrame) -> DataFrame:
    """(g, id, rep) from blobs (bucket, data), which Spark sorts by bucket and streams."""
    dealt = entries.select("bucket", "data").repartition(partitions(entries.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_grouped, "g bigint, id bigint, rep bigint")


def least_matches(m: int, threshold: float, miss: float) -> int:
    """Fewest matches among m hashes at which P(similarity >= threshold | matches) is still `miss` or more."""
    # With a uniform prior the posterior is Beta(k + 1, m - k + 1); its upper tail is a binomial sum.
    total = 0.0
    for k in range(m + 1):
        total += comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
        if total >= miss:
            return k
    return m


def survivors(a: np.ndarray, b: np.ndarray, *, threshold: float, miss: float, step: int = 20) -> np.ndarray:
    """Which rows of two signature matrices outlast every batch of the sequential test."""
    alive, got = np.arange(len(a)), np.zeros(len(a), np.int64)
    for at in range(0, a.shape[1], step):
        to = min(at + step, a.shape[1])
        got = got + (a[alive, at:to] == b[alive, at:to]).sum(axis=1)
        keep = got >= least_matches(to, threshold, miss)
        alive, got = alive[keep], got[keep]
    return alive


def commons(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many hashes sets a[k] and b[k] (not the same one) have in common, for each k. Hashes that several sets hold are bits, BITS of them
    at a time."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))[: len(flat)]
    shared = ~new | np.append(~new[1:], False)[: len(flat)]
    owner, bit = owner[shared], np.cumsum(new[shared]) - 1
    out = np.zeros(len(a), np.int64)
    for low in range(0, int(bit[-1]) + 1 if len(bit) else 0, BITS):
        own = slice(*np.searchsorted(bit, (low, low + BITS)))
        held = np.zeros((len(sets), BITS), bool)
        held[owner[own], bit[own] - low] = True
        words = np.packbits(held, axis=1).view(np.uint64)
        for at in range(0, len(a), 2048):
            out[at : at + 2048] += np.bitwise_count(words[a[at : at + 2048]] & words[b[at : at + 2048]]).sum(axis=1, dtype=np.int64)
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sorted distinct sets have in common."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")  # two runs are merged
    return int(np.count_nonzero(both[1:] == both[:-1]))


class Union:
    """Union-find over whole numbers; the smallest of a set is its root."""

    def __init__(self):
        self.own: dict[int, int] = {}

    def find(self, x: int) -> int:
        own = self.own
        own.setdefault(x, x)
        while own[x] != x:
            own[x] = own[own[x]]
            x = own[x]
        return x

    def unite(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.own[max(a, b)] = min(a, b)
        return a != b


def _contracted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task to stars (u, v) with v the smallest node that u reaches there; at most EDGES nodes are held."""
    held = Union()

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in held.own if (r := held.find(x)) != x]
        held.own.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch in it:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.unite(u, v)
        if len(held.own) > EDGES:
            yield stars()
    if held.own:
        yield stars()


def components(links: DataFrame, *, x: str = "x", y: str = "y") -> DataFrame:
    """(id, root) of every linked id; root is the smallest id of its component.

    Alternating large and small stars; each task contracts its edges to stars first, so rounds are few, and each round
    is written to the shared folder. A node of any degree is handled by aggregation and an equi-join, which adaptive
    execution can split.
    """
    spark = links.sparkSession
    shape = "u bigint, v bigint"
    edges, path = written(links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter("u <> v").mapInArrow(_contracted, shape), "edges")
    while True:
        # Done when the edges are stars: each node has one root, and no root has one itself.
        roles = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        if roles.groupBy("n").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 or up = 1 and root = 1").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v")
        edges, new = written(small.mapInArrow(_contracted, shape), "edges")
        remove(spark, path)
        path = new
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _one_by_one(texts: pa.Array, n: int, shingles: Callable[[str], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sets = [shingles(x.as_py()) for x in texts]
    return np.array([len(s) for s in sets], np.int64), signatures(sets, n) if sets else np.empty((0, n), np.uint32)


class Linker:
    """Links the items of `found` (see `groups`) whose exact similarity is the threshold or more.

    texts: (id, text) of all items, rows may repeat. shingles: sorted distinct 64-bit hashes of a text. described:
    set sizes and signatures of many texts; many: their sets. n: hashes of a signature; linked(common, a, b): the exact rule on the sizes of
    the common part and both sets, whole numbers or arrays of them. Within, an item has a number of its own, `no`: its id, or
    where two items share an id (each pair by chance once in 2 ** 64), a number that Spark counts.
    """

    def __init__(self, found: DataFrame, texts: DataFrame, shingles: Callable[[str], np.ndarray], *, n: int, linked: Callable, described: Callable[[pa.Array, int], tuple[np.ndarray, np.ndarray]] | None = None, many: Callable[[pa.Array], list[np.ndarray]] | None = None, threshold: float = 0.8, miss: float = 1e-7):
        self.flat = described or (lambda texts, n: _one_by_one(texts, n, shingles))
        self.many = many or (lambda texts: [shingles(x.as_py()) for x in texts])
        self.n, self.linked, self.threshold, self.miss = n, linked, threshold, miss
        self.spark, self.paths = found.sparkSession, []
        # Beyond SMALL two plain shuffles, which adaptive execution can split where one text is very common.
        wanted = self._written(found.select("id").distinct(), "wanted")
        some = texts.select("id", "text").join(wanted.hint("broadcast" if wanted.count() <= SMALL else "merge"), "id", "left_semi")
        some = self._written(some.select("id", names(F.col("text"))[1], "text"), "wanted-texts")
        one = some.groupBy("id", "chk").agg(F.first("text").alias("text"))
        self.items = self._written(one.mapInArrow(self._described(), "id bigint, chk bigint, text string, size bigint, sketch bigint, sig binary"), "candidates")
        if self.items.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            self.items = self.items.withColumn("no", F.col("id"))
            self.found = found.select("g", F.col("id").alias("no"), "rep")
        else:
            self.items = self._written(self.items.withColumn("no", F.monotonically_increasing_id()), "numbered")
            named = self.items.select("id", "no")
            found = found.join(named, "id").select("g", "no", "rep").join(named.toDF("rep", "rep_no"), "rep").select("g", "no", F.col("rep_no").alias("rep"))
            self.found = self._written(found, "numbered-groups")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        self.paths.append(path)
        return out

    def _described(self):
        flat, n = self.flat, self.n

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                col = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
                sizes, sig = flat(col["text"], n)
                short = sig.astype(np.uint8)  # unlike hashes agree once in 256: a pair may last longer for that, none is lost
                yield pa.RecordBatch.from_arrays([col["id"], col["chk"], col["text"], pa.array(sizes, pa.int64()), pa.array(sketch(sig)), pa.array([r.tobytes() for r in short], pa.binary())], ["id", "chk", "text", "size", "sketch", "sig"])

        return run

    def _both(self, pairs: DataFrame, *cols: str) -> DataFrame:
        for side in "xy":
            own = self.items.select(F.col("no").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in cols))
            pairs = pairs.join(own, side)
        return pairs

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links among pairs (x, y), written."""
        n, threshold, miss, many, linked = self.n, self.threshold, self.miss, self.many, self.linked

        def prune(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                a, b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint8).reshape(-1, n) for c in ("sig_x", "sig_y"))
                keep = pa.array(survivors(a, b, threshold=threshold, miss=miss))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).take(keep) for c in "xy"], ["x", "y"])

        def exact(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in it:
                for batch in (whole.slice(at, AT_HAND) for at in range(0, whole.num_rows, AT_HAND)):
                    x, y, tx, ty = (batch.column(batch.schema.get_field_index(c)) for c in ("x", "y", "text_x", "text_y"))
                    _, first, at = np.unique(np.concatenate((x.to_numpy(), y.to_numpy())), return_index=True, return_inverse=True)
                    own = many(pa.concat_arrays([tx, ty]).take(pa.array(first)))
                    size = np.array([len(s) for s in own], np.int64)
                    one, two = at[: len(x)], at[len(x) :]
                    shared = np.array([common(own[i], own[j]) for i, j in zip(one.tolist(), two.tolist(), strict=True)], np.int64)
                    keep = pa.array(linked(shared, size[one], size[two]), pa.bool_())
                    yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (x, y)], ["x", "y"])

        near = self._both(pairs, "size", "sig").filter(F.least("size_x", "size_y") >= (threshold - 1e-9) * F.greatest("size_x", "size_y"))
        left, path = written(near.select("x", "y", "sig_x", "sig_y").mapInArrow(prune, "x bigint, y bigint"), "survivors")
        links = self._written(self._both(left, "text").mapInArrow(exact, "x bigint, y bigint"), "links")
        remove(self.spark, path)
        return links

    def _open(self, labels: DataFrame) -> DataFrame:
        """(g, no, label, most) of the members of groups that hold several components; most: the largest one's label."""
        named = self.found.join(labels.toDF("no", "label"), "no", "left").select("g", "no", F.coalesce("label", "no").alias("label")).distinct()
        named = self._written(named, "labelled-groups")
        # Copies of one text with small edits share many bands: of groups with the same members (128 bits of them) one stays.
        marks = [F.xxhash64("no"), F.xxhash64(F.lit(1), "no")]
        sizes = named.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"), *(F.bit_xor(m).alias(f"m{k}") for k, m in enumerate(marks)))
        sizes = sizes.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"), F.bit_xor("m0").alias("m0"), F.bit_xor("m1").alias("m1"))
        several = sizes.filter("k > 1").select("g", F.col("most.label").alias("most"), F.col("n").alias("whole"), (F.col("n") - F.col("most.n")).alias("rest"), "m0", "m1")
        several = several.groupBy("m0", "m1", "whole").agg(F.min(F.struct("g", "most", "rest")).alias("one")).select("one.*", "whole")
        return self._written(named.join(several, "g"), "open-groups")

    def _pairs(self, rows: DataFrame) -> DataFrame:
        """(x, y), x below y, of different components of an open group of FEW items at most, each pair once."""
        own = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("no", "label"))).alias("own"))
        later = lambda a, i: F.filter(F.slice("own", i + 2, FEW), lambda b: b.label != a.label)
        pairs = F.flatten(F.transform("own", lambda a, i: F.transform(later(a, i), lambda b: F.struct(a.no.alias("x"), b.no.alias("y")))))
        return own.select(F.explode(pairs).alias("p")).select("p.x", "p.y").distinct()

    def _cells(self, rows: DataFrame) -> DataFrame:
        """The members of open groups (g, no, label, most, whole, rest), dealt into cells (g, i, j): on side 0 a block of
        those outside the largest component, on side 1 a block of the whole group, each block of about BLOCK items. Every
        two items of different components of a group meet in a cell."""
        block = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
        place = lambda n: F.pmod(F.xxhash64("no"), block(n)).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), block(n) - 1))
        left = rows.filter("label <> most").select("g", place("rest").alias("i"), upto("whole").alias("j"), F.lit(0).alias("side"), "no", "label")
        right = rows.select("g", upto("rest").alias("i"), place("whole").alias("j"), F.lit(1).alias("side"), "no", "label")
        return left.unionByName(right)

    def _across(self, rows: DataFrame) -> DataFrame:
        """Links between the components of each open group. A first pass over sketches and signatures finds the items of
        a cell that some other one may be linked with; only these meet again, with their texts."""
        threshold, miss, n, many, linked, bits = self.threshold, self.miss, self.n, self.many, self.linked, min(64, self.n)
        # Bits agree with probability (1 + similarity) / 2; six standard deviations below that for a pair at the threshold.
        p = (1 + threshold) / 2
        most = bits * (1 - p) + 6 * (bits * p * (1 - p)) ** 0.5

        def pairs(cell: dict, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Pairs of a cell (side 0, side 1) that outlast the sketch and the sequential test, part by part. A part is
            strewn over the cell, so that early ones touch every item; `wanted` tells which pairs still matter."""
            left, right = np.flatnonzero(cell["side"] == 0), np.flatnonzero(cell["side"] == 1)
            fit = cell["label"][left][:, None] != cell["label"][right]
            size = cell["size"]
            fit &= np.minimum(size[left][:, None], size[right]) >= (threshold - 1e-9) * np.maximum(size[left][:, None], size[right])
            marks = cell["sketch"].view(np.uint64)
            fit &= np.bitwise_count(marks[left][:, None] ^ marks[right]) <= most
            i, j = np.nonzero(fit)
            strewn = np.argsort(np.arange(len(i)) % max(1, -(-len(i) // FIRST)), kind="stable")
            a, b = left[i[strewn]], right[j[strewn]]
            sig = np.frombuffer(b"".join(cell["sig"]), np.uint8).reshape(-1, n)
            at, part = 0, FIRST
            while at < len(a):
                one, two = a[at : at + part], b[at : at + part]
                at, part = at + part, min(2 * part, PAIRS)
                still = wanted(one, two)
                one, two = one[still], two[still]
                keep = survivors(sig[one], sig[two], threshold=threshold, miss=miss)
                yield one[keep], two[keep]

        def first(cell: dict) -> list[tuple]:
            """The items that some pair needs; pairs of items that are both known to be needed tell nothing more."""
            needed = np.zeros(len(cell["no"]), bool)
            for one, two in pairs(cell, lambda one, two: ~(needed[one] & needed[two])):
                needed[one] = needed[two] = True
            return [(int(cell["g"][k]), int(cell["i"][k]), int(cell["j"][k]), int(cell["side"][k]), int(cell["no"][k]), int(cell["label"][k])) for k in np.flatnonzero(needed).tolist()]

        def second(cell: dict) -> list[tuple]:
            """Links that join components; pairs whose components met in an earlier part are not compared."""
            held, out = Union(), []
            sets: dict[int, np.ndarray] = {}
            names, label = np.unique(cell["label"], return_inverse=True)
            root = names

            for x, y in pairs(cell, lambda x, y: root[label[x]] != root[label[y]]):
                some, at = np.unique(np.concatenate((x, y)), return_inverse=True)
                if lacking := [k for k in some.tolist() if k not in sets]:
                    sets.update(zip(lacking, many(pa.array([cell["text"][k] for k in lacking], pa.string())), strict=True))
                own = [sets[k] for k in some.tolist()]
                size = np.array([len(s) for s in own], np.int64)
                one, two = at[: len(x)], at[len(x) :]
                # Bit sets of all are worth making only for many pairs.
                shared = commons(own, one, two) if len(x) > LITTLE else np.array([common(own[i], own[j]) for i, j in zip(one.tolist(), two.tolist(), strict=True)], np.int64)
                good = linked(shared, size[one], size[two])
                for i, j in zip(x[good].tolist(), y[good].tolist(), strict=True):
                    if held.unite(int(cell["label"][i]), int(cell["label"][j])):
                        out.append((int(cell["no"][i]), int(cell["no"][j])))
                root = np.array([held.find(v) for v in names.tolist()], np.int64)
            return out

        def by_cell(rows: DataFrame, names: list[str], each: Callable[[dict], list[tuple]], shape: str) -> DataFrame:
            made = [x.split()[0] for x in shape.split(", ")]

            def closed(held: list[tuple]) -> dict:
                return {c: v if c in ("sig", "text") else np.array(v, np.int64) for c, v in zip(names, zip(*held, strict=True), strict=True)}

            def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                now, held, out = None, [], []
                for batch in it:
                    for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
                        if row[:3] != now:
                            if held:
                                out += each(closed(held))
                            now, held = row[:3], []
                        held.append(row)
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], made)
                        out = []
                if held and (out := out + each(closed(held))):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], made)

            return rows.select(*names).repartition(partitions(self.spark), "g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, shape)

        key, drawn = ["g", "i", "j", "side", "no", "label"], ["size", "sketch", "sig"]
        some = by_cell(self._cells(rows).join(self.items.select("no", *drawn), "no"), [*key, *drawn], first, "g bigint, i bigint, j bigint, side bigint, no bigint, label bigint")
        some = self._written(some, "cells")
        return self._written(by_cell(some.join(self.items.select("no", *drawn, "text"), "no"), [*key, *drawn, "text"], second, "x bigint, y bigint"), "links")

    def named(self) -> DataFrame:
        """(id, chk, rid, rchk) of every item that has links, written: its name, and that of the smallest name of its
        component. Links within what others connect may not have been looked at."""
        shared = self.found.filter("no <> rep").groupBy("no", "rep").agg(F.count(F.lit(1)).alias("n"))
        most = shared.groupBy("no").agg(F.max_by("rep", F.struct("n", "rep")).alias("rep"))
        stars = self._written(most.select(F.least("no", "rep").alias("x"), F.greatest("no", "rep").alias("y")).distinct(), "stars")
        labels = components(self.verified(stars))
        rest = self._open(labels)
        more = self.verified(self._pairs(rest.filter(F.col("whole") <= FEW)).join(stars, ["x", "y"], "left_anti"))
        # The components so far are edges too, so that those of all links start from stars.
        labels = components(labels.toDF("x", "y").unionByName(more).unionByName(self._across(rest.filter(F.col("whole") > FEW))))
        own = self.items.select("id", "chk", "no").join(labels.toDF("no", "root"), "no").select("id", "chk", "root")
        low = own.groupBy("root").agg(F.min(F.struct("id", "chk")).alias("low")).select("root", F.col("low.id").alias("rid"), F.col("low.chk").alias("rchk"))
        out, _ = written(own.join(low, "root").select("id", "chk", "rid", "rchk"), "components")
        remove(self.spark, *self.paths)
        return out
