"""Near-duplicate documents by a grouped prefix join on word shingles.

Two documents link when the Jaccard similarity of their shingle sets is at least a threshold. Shingles are put in one
global order, rare ones first; documents that link share a shingle among the first few of each (the prefix filter).

1. A counting pass finds the shingles that very many documents hold; they come last in the order. The order decides
   what is compared, not what links.
2. Documents with the same set become one class; classes with the same prefix and size become one group.
3. Groups that share prefix shingles are counted against each other; pairs whose shared prefix and remaining sizes
   cannot reach the threshold fall away. Shingles that many groups hold are not paired there: each of their groups
   meets the first one only.
4. The likeliest pairs are expanded to classes and verified on whole sets; components of verified links follow. Members
   of crowded lists then meet another one of their list, which joins most of what belongs together.
5. What is left are lists whose classes are still of different components: crowded shingles, large groups, and pairs of
   large groups. Lists of much the same classes, as the shingles of one passage have them, become one. Each is dealt in
   tiles of bounded size: the classes outside the list's largest component meet each other and that component's, and a
   tile counts their overlaps on whole sets with one matrix product. It hands on the components that its links join, not
   the links. The sets that go to tiles grow with the square of a list's length, as that product does, so they go in
   rounds, each with no more than a bounded part of what all sets hold.

Nothing is sampled or capped. Sets are computed again from the text where they are needed, not kept for all documents.
Tables of a step leave the shared folder, and its shuffle files the executors, as soon as no later step reads them.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraspan.llm.common import checked_broadcast, counted, discard, shuffles_removed, staged, table
from terraspan.llm.components import components


@dataclass(frozen=True)
class Params:
    words: int = 5  # of a shingle
    percent: int = 75  # of the union that two sets must share
    frequent: int = 8  # documents from which a shingle may come last in the order
    most_frequent: int = 500_000  # shingles that come last at most, the commonest ones; they are broadcast
    crowded: int = 32  # groups from which a shingle's groups are not all paired at first
    pairs: int = 16  # pairs of classes up to which a pair of groups is expanded into pairs and not into a list
    tile: int = 131_072  # shingles of one side of a tile, about
    sent: int = 1 << 28  # shingles up to which all tiles are filled at once; more go in rounds


def need(size, percent: int):
    """Least overlap with any set that links to one of this size."""
    return -(-percent * size // 100)


# ---- sets of shingles, inside tasks ----------------------------------------------------------------------------------


class Shingler:
    """Sets of 64-bit shingle hashes. Words are hashed once each and remembered."""

    def __init__(self, words: int, cache: int = 250_000):
        import xxhash

        self.words, self.cache, self.digest = words, cache, xxhash.xxh3_64_intdigest
        self.at: dict[bytes, int] = {}
        self.hashes = np.zeros(1 << 16, np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; empty without words. ASCII letters are folded and ASCII white space separates."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.words:
            return np.array([self.digest(b" ".join(words), seed=1)], np.uint64)
        if len(self.at) > self.cache:
            self.at = {}
        at = self.at
        ids = np.fromiter((at[w] if w in at else self.learn(w) for w in words), np.int64, len(words))
        h, n = self.hashes[ids], len(words) - self.words + 1
        out = np.zeros(n, np.uint64)
        for k in range(self.words):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        out ^= out >> np.uint64(33)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(33)
        return np.unique(out)

    def learn(self, word: bytes) -> int:
        k = len(self.at)
        if k >= len(self.hashes):
            self.hashes = np.append(self.hashes, np.zeros_like(self.hashes))
        self.hashes[k] = self.digest(word)
        self.at[word] = k
        return k


# ---- the global order ------------------------------------------------------------------------------------------------


def segment_bits(docs: DataFrame) -> int:
    parts = docs.select("doc_id").rdd.getNumPartitions()  # ids alone, since this runs the shuffles of a plan that has some
    return max(4, (4 * parts - 1).bit_length())  # an empty plan may have no partition


def common_shingles(docs: DataFrame, params: Params, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (their upper ``bits`` + 32 bits, sorted) of the shingles in the most documents, and their numbers of documents.

    All shingles of all documents are counted. Tasks send sorted runs of 32-bit keys for each segment of the hash
    space; the number of segments follows the number of scan tasks, so a segment stays bounded."""
    low = np.uint64(64 - bits - 32)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, n = Shingler(params.words), [], 0

        def sent() -> pa.RecordBatch:
            keys, count = np.unique(np.concatenate(held) >> low, return_counts=True)
            edges = np.searchsorted(keys >> np.uint64(32), np.arange((1 << bits) + 1, dtype=np.uint64))
            parts = [(s, keys[a:b].astype("<u4"), count[a:b].astype("<u4")) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            planes = lambda x: x.view(np.uint8).reshape(-1, 4).T.tobytes()  # noqa: E731  equal bytes side by side compress
            arrays = [pa.array([p[0] for p in parts], pa.int32()), pa.array([planes(np.diff(p[1], prepend=np.uint32(0))) for p in parts], pa.binary()), pa.array([planes(p[2]) for p in parts], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["segment", "keys", "counts"])

        for batch in batches:
            for text in batch.column(0):
                held.append(shingler.of(text.as_py()))
                n += len(held[-1])
                if n >= 1_000_000:
                    yield sent()
                    held, n = [], 0
        if n:
            yield sent()

    def merged(key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
        whole = lambda x: np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
        keys = np.concatenate([np.cumsum(whole(x), dtype=np.uint32) for x in runs["keys"]])
        count = np.concatenate([whole(x) for x in runs["counts"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, count = keys[order], count[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(count, first)
        often = total >= params.frequent
        return pd.DataFrame({"key": (int(key[0]) << 32) + keys[first][often].astype(np.int64), "docs": total[often]})

    with shuffles_removed(docs.sparkSession):
        counts = docs.select("text").mapInArrow(runs, "segment int, keys binary, counts binary").groupBy("segment").applyInPandas(merged, "key long, docs long")
        top = counts.orderBy(F.desc("docs"), "key").limit(params.most_frequent).toPandas().sort_values("key")
    return (top["key"].to_numpy(np.uint64) << low) if len(top) else np.zeros(0, np.uint64), top["docs"].to_numpy(np.int64)


DESCRIBED = "doc_id long, n long, set_hash binary, sig binary, rare array<long>, common array<long>"


def described(docs: DataFrame, params: Params) -> DataFrame:
    """Size, hash of the set, hash of prefix and size, and the prefix in two parts, rare and common shingles, of each
    document; written to the shared folder."""
    bits = segment_bits(docs)
    keys, df = common_shingles(docs, params, bits)
    mask = np.uint64((1 << 64) - (1 << (32 - bits)))
    shared = docs.sparkSession.sparkContext.broadcast((keys, df))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(params.words)
        keys, df = shared.value
        for batch in batches:
            n, sets, sigs, rare, common = [], [], [], [], []
            for text in batch.column(1):
                s = shingler.of(text.as_py())
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s & mask), len(keys) - 1)
                    s_df = np.where(keys[at] == s & mask, df[at], 0)
                    ordered, few = s[np.argsort(s_df, kind="stable")], int((s_df == 0).sum())
                else:
                    ordered, few = s, len(s)
                prefix = ordered[: len(s) - need(len(s), params.percent) + 1] if len(s) else s
                n.append(len(s))
                sets.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sigs.append(hashlib.blake2b(prefix.tobytes() + len(s).to_bytes(8, "little"), digest_size=16).digest())
                rare.append(prefix[:few].view(np.int64))
                common.append(prefix[few:].view(np.int64))
            lists = []
            for each in (rare, common):
                ends = np.append(0, np.cumsum([len(p) for p in each])).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each) if each else np.zeros(0, np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary()), *lists], ["doc_id", "n", "set_hash", "sig", "rare", "common"])

    return staged(docs.select("doc_id", "text").mapInArrow(describe, DESCRIBED), "prefixes")


# ---- candidates ------------------------------------------------------------------------------------------------------


def _close(a: str, b: str, percent: int):
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _reachable(shared, a: str, b: str, percent: int):
    """Whether so many shared prefix shingles, and all that follows the prefixes, can make the needed overlap."""
    rest = lambda n: F.expr(f"{n} - ({n} - ceil({percent} * {n} / 100.0) + 1)")
    return (100 + percent) * (shared + F.greatest(rest(a), rest(b))) >= percent * (F.col(a) + F.col(b))


#: Whether some class of group a and some class of group b are of different components.
UNLIKE = "a_low <> b_low or a_high <> b_high or a_low <> a_high"


def _paired(lists: DataFrame, params: Params) -> DataFrame:
    """Pairs of groups (a < b) that share tokens, with the number ``c`` of tokens shared in ``lists``."""
    side = lambda x: lists.select("token", *[F.col(c).alias(f"{x}_{c}") for c in ("g", "n", "many")])
    pairs = side("a").join(side("b"), "token").where(F.expr("a_g < b_g") & _close("a_n", "b_n", params.percent))
    return pairs.groupBy("a_g", "b_g", "a_n", "b_n", "a_many", "b_many").agg(F.count("*").alias("c"))


def _sets(docs: DataFrame, ids: DataFrame, params: Params) -> DataFrame:
    """``id`` and ``set`` (its shingles' hashes, sorted) of the documents in ``ids`` (doc_id, distinct); no two of
    ``docs`` share an id."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(params.words)
        for batch in batches:
            each = [shingler.of(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(each, pa.binary())], ["id", "set"])

    texts = docs.select("doc_id", "text").join(checked_broadcast(ids, counted(ids)), "doc_id")
    return staged(texts.mapInArrow(sets, "id long, set binary"), "sets")


def _linked(pairs: DataFrame, docs: DataFrame, params: Params) -> DataFrame:
    """The pairs (a, b of classes) that link, by their whole sets."""
    pairs = staged(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i) for i in (2, 3))
            linked = []
            for k in range(batch.num_rows):
                p, q = (np.frombuffer(s[k].as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append((100 + params.percent) * both >= params.percent * (len(p) + len(q)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    own = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), params)
    with_a = pairs.join(own.select(F.col("id").alias("a"), F.col("set").alias("a_set")), "a")
    with_b = with_a.join(own.select(F.col("id").alias("b"), F.col("set").alias("b_set")), "b").select("a", "b", "a_set", "b_set")
    links = staged(with_b.mapInArrow(compared, "a long, b long"), "links")
    discard(pairs, own)
    return links


# ---- lists of classes, in tiles --------------------------------------------------------------------------------------


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets. Values that many hold are counted by a matrix product, the others by their
    own pairs."""
    n, m = len(left), len(right)
    size = [len(x) for x in (*left, *right)]
    values, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row, cut = np.repeat(np.arange(n + m), size), sum(size[:n])
    of_left, of_right = (np.bincount(x, minlength=len(values)) for x in (at[:cut], at[cut:]))
    weight = of_left * of_right
    out = np.zeros((n, m), np.float32)
    dense = np.flatnonzero(weight * 100 > n * m)
    column = np.full(len(values), -1)
    for start in range(0, len(dense), 2048):
        chosen = dense[start : start + 2048]
        column[:] = -1
        column[chosen] = np.arange(len(chosen))
        held = np.zeros((n + m, len(chosen)), np.float32)
        there = column[at] >= 0
        held[row[there], column[at[there]]] = 1
        out += held[:n] @ held[n:].T
    sparse = (weight > 0) & (weight * 100 <= n * m)
    order = np.argsort(at[cut:], kind="stable")
    other, first = row[cut:][order] - n, np.cumsum(of_right) - of_right
    mine = np.flatnonzero(sparse[at[:cut]])
    for start in range(0, len(mine), 65_536):
        own = mine[start : start + 65_536]
        times = of_right[at[own]]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[at[own]], times)
        out += np.bincount(np.repeat(row[own], times) * m + other[place], minlength=n * m).reshape(n, m)
    return out


#: Of a class in a tile; with a constant, so that a tile's rows are bounded too.
WEIGHT = "n + 128"


def _work(members: DataFrame, by: str) -> DataFrame:
    """What comparing a list takes: the weight outside its largest component, times all; ``by`` names the lists."""
    size = members.groupBy(by, "component").agg(F.sum(F.expr(WEIGHT)).cast("double").alias("size"))
    return size.groupBy(by).agg(((F.sum("size") - F.max("size")) * F.sum("size")).alias("work"))


def _merged(members: DataFrame) -> DataFrame:
    """``members`` (list, node, n, component; distinct) without lists of one component. Lists whose nodes have the same
    least hash, as most lists of much the same nodes do, become one where that takes no more work than they do apart."""
    keys = members.groupBy("list").agg(F.min(F.xxhash64("node")).alias("key"))
    alone = staged(_work(members, "list").where("work > 0").join(keys, "list"), "alone")
    n = counted(alone)
    union = members.join(checked_broadcast(alone.select("list", "key"), n), "list").select("key", "node", "n", "component").distinct()
    apart = alone.groupBy("key").agg(F.sum("work").alias("apart"))
    chosen = _work(union, "key").join(apart, "key").select("key", (F.col("work") <= F.col("apart")).alias("one"))
    into = staged(alone.join(chosen, "key").select("list", F.when(F.col("one"), F.xxhash64("key", F.lit("lists"))).otherwise(F.col("list")).alias("into")), "into")
    out = members.join(checked_broadcast(into, n), "list").select(F.col("into").alias("list"), "node", "n", "component").distinct()
    out = staged(out, "merged")
    discard(alone, into)
    return out


def _across(members: DataFrame, docs: DataFrame, params: Params, shingles: int) -> DataFrame:
    """Links between components (``a``, ``b``) that the lists of ``members`` (list, node, n, component) hold, enough of
    them to join all that links inside a list. A repeated member counts once. shingles: of all sets."""
    each = staged(members.dropDuplicates(["list", "node"]), "members")
    merged = _merged(each)
    discard(each)
    size = merged.groupBy("list", "component").agg(F.sum(F.expr(WEIGHT)).alias("size"))
    lists = size.groupBy("list").agg(
        F.max_by("component", F.struct("size", -F.col("component"))).alias("main"), F.max("size").alias("inside"), (F.sum("size") - F.max("size")).alias("beyond"),
    )
    lists = lists.withColumns({"main_parts": F.ceil(F.col("inside") / params.tile), "parts": F.ceil(F.col("beyond") / params.tile)}).where("parts > 0")
    lists = staged(lists, "tiled")
    with shuffles_removed(docs.sparkSession):
        sent = lists.agg(F.sum(F.expr("cast(beyond as double) * (parts + main_parts) + cast(inside as double) * parts"))).first()[0]
    rounds = math.ceil((sent or 1) / max(params.sent, shingles // 4))
    members = staged(merged.join(checked_broadcast(lists, counted(lists)), "list"), "members")
    discard(merged, lists)
    outside = F.col("component") != F.col("main")
    deal = lambda n: F.pmod(F.xxhash64("node", "list"), F.col(n))
    side = F.when(outside, deal("parts")).otherwise(F.col("parts") + deal("main_parts"))
    all_parts = F.sequence(F.lit(0).cast("long"), F.col("parts") + F.col("main_parts") - 1)
    met = F.when(outside, all_parts).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    tile = F.transform(met, lambda j: F.struct(F.least(j, F.col("side")).alias("i"), F.greatest(j, F.col("side")).alias("j")))
    keys = ["list", "i", "j"]

    def met_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for *key, side, component, data in zip(*columns, batch.column(5), strict=True):
                if key != now:
                    yield tile_of(now, held)
                    now, held = key, []
                held.append((side, component, np.frombuffer(data.as_buffer(), np.uint64)))
        yield tile_of(now, held)

    def tile_of(key: list | None, rows: list[tuple]) -> pa.RecordBatch:
        found: set[tuple[int, int]] = set()
        if rows:
            left, right = ([r for r in rows if r[0] == k] for k in key[1:])
            if left and right:
                both = overlaps([r[2] for r in left], [r[2] for r in right])
                n, m = (np.array([len(r[2]) for r in x]) for x in (left, right))
                a, b = (np.array([r[1] for r in x]) for x in (left, right))
                p, q = np.nonzero(((100 + params.percent) * both.astype(np.int64) >= params.percent * (n[:, None] + m)) & (a[:, None] != b))
                found = spanning(np.unique(np.sort(np.stack([a[p], b[q]], 1), axis=1), axis=0).tolist())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    own = _sets(docs, members.select(F.col("node").alias("doc_id")).distinct(), params)
    dealt = members.withColumn("side", side).select("list", "node", "component", "side", F.inline(tile))
    links = []
    for k in range(rounds):
        now = dealt.where(F.pmod(F.xxhash64(*keys), F.lit(rounds)) == k) if rounds > 1 else dealt
        with_sets = now.join(own.select(F.col("id").alias("node"), "set"), "node").select(*keys, "side", "component", "set")
        links.append(staged(with_sets.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(met_in, "a long, b long"), "links"))
    found = staged(reduce(DataFrame.unionByName, links), "links")
    discard(members, own, *links)
    return found


def spanning(links: list[list[int]]) -> set[tuple[int, int]]:
    """A star for each component of the links: at most one pair for each end."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {(x, top(x)) for x in root if top(x) != x}


# ---- the operator ----------------------------------------------------------------------------------------------------


def _odd_ids(docs: DataFrame) -> tuple[DataFrame, int]:
    """The null id and those of several rows, and their number."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").select("doc_id")
    ids = staged(ids, "odd_ids")
    if not (n := counted(ids)):
        discard(ids)
    return ids, n


def _apart(docs: DataFrame, ids: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of an id of their own, rows that share one, and rows without."""
    repeated = checked_broadcast(ids.where("doc_id is not null"), n)
    known = docs.where("doc_id is not null")
    plain, shared = (known.join(repeated, "doc_id", how).select(*docs.columns) for how in ("left_anti", "left_semi"))
    return plain, shared, docs.where("doc_id is null")


def _last_id(docs: DataFrame) -> int | None:
    with shuffles_removed(docs.sparkSession):
        return docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]


def near_duplicates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``doc_id``, ``n_shingles`` (size of its set) and ``component_id`` (smallest doc_id reachable by links).

    Every row is a document of its own and comes out once, also where rows share a doc_id, with one text or several, or
    have none; a component whose rows all lack an id has a null component_id. A null text and one without words has
    size 0 and links with nothing. Whole texts count; other columns are not read. Exact copies are one class, so their
    number adds no pairs. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    ids, n_odd = _odd_ids(docs)
    if not n_odd:
        return _components(docs, params)
    plain, shared, without = _apart(docs, ids, n_odd)
    last = _last_id(docs)
    above = F.lit(-1 if last is None else last)  # such rows get keys beyond all ids
    odd = staged(shared.unionByName(without).withColumn("key", F.monotonically_increasing_id() + above + 1), "odd_rows")
    keyed = plain.select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(odd.select(F.col("key").alias("doc_id"), "text"))
    keys = _components(keyed, params)
    found = keys.withColumnRenamed("doc_id", "key")
    own = odd.select("key", F.col("doc_id").cast("long").alias("own"))
    least = found.select("key", "component_id").join(own, "key").groupBy("component_id").agg(F.min("own").alias("least"))
    kind = docs.schema["doc_id"].dataType
    first = F.least("least", F.when(F.col("component_id") <= above, F.col("component_id")))
    out = found.join(own, "key", "left").join(least, "component_id", "left").select(
        F.when(F.col("key") <= above, F.col("key")).otherwise(F.col("own")).cast(kind).alias("doc_id"), "n_shingles", first.cast(kind).alias("component_id")
    )
    out = staged(out, "found")
    discard(ids, odd, keys)
    return out


def _components(docs: DataFrame, params: Params) -> DataFrame:
    """As :func:`near_duplicates`, for rows (doc_id, text) whose ids are unique and not null; a staged table."""
    rows = described(docs, params)
    sizes = staged(rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set_hash")).alias("set_hash")), "sizes")
    classes = rows.where("n > 0").groupBy("set_hash", "sig", "n").agg(F.min("doc_id").alias("node"))
    groups = classes.groupBy("sig").agg(F.min("node").alias("g"), F.count("*").alias("classes"))
    classes = staged(classes.join(groups, "sig").select("node", "g", "n", "classes", "set_hash"), "classes")

    reps = classes.where("node = g").select(F.col("g").alias("doc_id"))
    reps = rows.join(checked_broadcast(reps, counted(reps)), "doc_id").select(F.col("doc_id").alias("g"), "n", "rare", "common")
    # A rare shingle's groups are few, so they may share a task; a common one's are counted before they meet the count.
    rare = reps.select("g", "n", F.explode("rare").alias("token")).withColumn("held", F.count("*").over(Window.partitionBy("token")))
    common = staged(reps.select("g", "n", F.explode("common").alias("token")), "common")
    counts = common.groupBy("token").agg(F.count("*").alias("held"))
    lists = staged(rare.where("held > 1").unionByName(common.join(counts.where("held > 1"), "token").select("g", "n", "token", "held")), "lists")
    discard(rows, common)
    crowded = lists.where(F.col("held") > params.crowded)
    n_crowded = crowded.groupBy("g").agg(F.count("*").alias("many"))

    some = lists.where(F.col("held") <= params.crowded).join(n_crowded, "g", "left").na.fill(0, ["many"])
    pairs = _paired(some, params)
    pairs = staged(pairs.where(_reachable(F.col("c") + F.least("a_many", "b_many"), "a_n", "b_n", params.percent)), "candidates")

    # First the likeliest: every group with the partner it shares most with, every class with the first group of each
    # crowded list and with its own group's first.
    best = pairs.groupBy("b_g").agg(F.max_by("a_g", F.struct("c", -F.col("a_g"))).alias("a")).select("a", F.col("b_g").alias("b"))
    of_list = lambda x, near: x.join(near, [c for c in near.columns if c != "hub"]).where("g <> hub").select("hub", "g").distinct()
    spokes = of_list(crowded, crowded.groupBy("token").agg(F.min("g").alias("hub")))
    stars = spokes.join(classes.select("g", "node"), "g").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    inner = classes.where("node <> g").select(F.col("g").alias("a"), F.col("node").alias("b"))
    links = _linked(best.unionByName(stars).unionByName(inner), docs, params)
    first = components(links)

    # In crowded lists of several components a group then meets one of those that a hash puts beside it, another one in
    # every list.
    def placed_in(found: DataFrame) -> DataFrame:
        return classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def labels(placed: DataFrame) -> DataFrame:
        """The component of each group's first class, and the least and the largest one of all its classes."""
        own = F.max(F.when(F.col("node") == F.col("g"), F.col("component")))
        return placed.groupBy("g").agg(own.alias("component"), F.min("component").alias("low"), F.max("component").alias("high"))

    def mixed_lists(label: DataFrame) -> DataFrame:
        labelled = crowded.join(label, "g")
        mixed = labelled.groupBy("token").agg((F.min("low") != F.max("high")).alias("mixed")).where("mixed").select("token")
        return labelled.join(mixed, "token", "left_semi")

    near = mixed_lists(labels(placed_in(first))).withColumn("bucket", F.pmod(F.xxhash64("token", "g"), F.ceil(F.col("held") / params.crowded)))
    beside = near.groupBy("token", "bucket").agg(F.min_by(F.struct(F.col("g").alias("hub"), F.col("component").alias("hub_component")), F.xxhash64("g", "token")).alias("of"))
    beside = near.join(beside.select("token", "bucket", "of.*"), ["token", "bucket"]).where("hub_component <> component").select(F.col("hub").alias("a"), F.col("g").alias("b"))
    more = _linked(beside, docs, params)
    discard(first)
    first = components(links.unionByName(more))
    discard(links, more)

    # Then all that is left between different components: pairs of a few classes one by one, the others as lists.
    placed = staged(placed_in(first), "placed")
    label = labels(placed)
    kinds = classes.where("node = g").select("g", "classes")
    a, b = (label.join(kinds, "g").select(*[F.col(c).alias(f"{x}_{c}") for c in ("g", "low", "high", "classes")]) for x in "ab")
    early = staged(pairs.join(a, "a_g").join(b, "b_g").where(UNLIKE).select("a_g", "b_g", F.col("a_classes").cast("double") * F.col("b_classes") <= params.pairs).toDF("a_g", "b_g", "few"), "early")
    discard(pairs)
    member = lambda x: placed.select(F.col("g").alias(f"{x}_g"), F.col("node").alias(x), F.col("component").alias(f"{x}_c"))
    single = early.where("few").join(member("a"), "a_g").join(member("b"), "b_g").where("a_c <> b_c").select("a", "b")
    wide = early.where("not few").select(F.xxhash64("a_g", "b_g").alias("list"), F.explode(F.array("a_g", "b_g")).alias("g"))
    several = placed.where("classes > 1").select(F.xxhash64("g").alias("list"), "g").distinct()
    mixed = mixed_lists(label).select(F.col("token").alias("list"), "g")
    members = wide.unionByName(several).unionByName(mixed).join(placed.select("g", "node", "n", "component"), "g")
    a, b = (first.select(F.col("node").alias(x), F.col("component").alias(f"{x}_c")) for x in "ab")
    links = _linked(single, docs, params)
    more = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
    with shuffles_removed(docs.sparkSession):
        shingles = placed.agg(F.sum("n")).first()[0] or 0
    lasting = _across(members, docs, params, shingles)
    joined = components(more.unionByName(lasting))
    discard(classes, lists, early, first, links, lasting)
    second = joined.select(F.col("node").alias("component"), F.col("component").alias("final"))
    final = placed.join(second, "component", "left").select("set_hash", F.coalesce("final", "component").alias("component_id"))
    found = sizes.join(final, "set_hash", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    found = staged(found, "found")
    discard(sizes, placed, joined)
    return found


def keep_one(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``docs`` without all but the first document (smallest doc_id) of each component; all columns stay.

    Every row is a document of its own: one with a null doc_id comes after those with one, and so does every row but one
    of a repeated doc_id. They are kept unless their component holds a document before them. Rows that repeat a doc_id
    and its text come out once, also without words; unlike texts under one doc_id all stay."""
    ids, n_odd = _odd_ids(docs)
    mark = uuid.uuid4().hex
    plain, key, own = docs, f"key_{mark}", f"own_{mark}"
    if n_odd:
        plain, shared, without = _apart(docs, ids, n_odd)
        odd = without.unionByName(shared.dropDuplicates(["doc_id", "text"]))
        odd = numbered = staged(odd.withColumn(key, F.monotonically_increasing_id()), "odd_rows")
        last = _last_id(docs)
        owners = odd.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(own)).agg(F.min(key).alias(key))
        odd = odd.join(owners, key, "left").withColumn(key, F.coalesce(own, F.col(key) + F.lit(-1 if last is None else last) + 1)).drop(own)
        odd = staged(odd, "odd_rows")
        discard(numbered)
    keyed = plain.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if n_odd:
        keyed = keyed.unionByName(odd.select(F.col(key).alias("doc_id"), "text"))
    others = _components(keyed, params).where("doc_id <> component_id").select("doc_id")
    others = checked_broadcast(others, counted(others))  # all ids have a row there, and those to go are the fewer
    kept = plain.join(others, "doc_id", "left_anti").select(*docs.columns)
    if not n_odd:
        return kept
    return kept.unionByName(odd.join(others.withColumnRenamed("doc_id", key), key, "left_anti").select(*docs.columns))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = {
    "op8_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n"""
}
