"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, held against every window of every
document; hits are verified word by word.

Words are runs of digits, letters and anything beyond ASCII, with A-Z lower-cased. A window is ``SIZE`` consecutive words
of an item; an item of fewer words is one window by itself. Since every byte beyond ASCII belongs to a word, a batch of
texts is cut, hashed and looked up as one array of UTF-8 bytes.

The set is broadcast in blocks of a bounded number of bytes. One block is the rule, and then documents are neither moved
nor read twice. A larger benchmark takes a scan of the documents for each block; what the blocks find meets by document.

Nulls and repeats: a null or empty text has no words, in items as in documents. Items that repeat an item_id are one
item with the windows of all of them. Windows of items without an id mark words, but such items are neither counted nor
listed. Repeated rows of documents are judged each. An empty benchmark hits nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.llm.common import small_batches, staged, table

SIZE = 10
#: Bytes of items (texts, and 24 for each id) in one broadcast block, and the hash buckets that blocks are made of.
BLOCK, BUCKETS = 8 << 20, 1024
#: Bytes of text that are hashed at a time.
PIECE = 1 << 20
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPANS = "array<struct<start:int,stop:int,first:int,last:int>>"
FOUND = f"n_words long, n_hit long, items array<string>, spans {SPANS}"
#: By byte: the lower-cased byte of a word, or 0 between words.
FOLDED = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 0 for c in range(256)], np.uint8)


def normalised(text: Column) -> Column:
    """The words of a text, separated by a space."""
    upper = "".join(map(chr, range(65, 91)))
    return F.array_join(F.array_remove(F.split(F.translate(text, upper, upper.lower()), BETWEEN), ""), " ")


def powers(of: int, n: int) -> np.ndarray:
    """of ** 0, 1, ... modulo 2 ** 64."""
    out = np.full(n, of, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Cutter:
    """Words of byte arrays and their 64-bit hashes."""

    def __init__(self, seed: int = 0):
        base = 0x9E3779B97F4A7C15 + 2 * seed  # odd, so that it has an inverse
        self.up, self.down = powers(base, PIECE + 1), powers(pow(base, -1, 1 << 64), PIECE + 1)

    def words(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of each word; no word crosses one of ``cuts``."""
        inside = FOLDED[data] > 0
        edge = np.zeros(len(data) + 1, bool)
        edge[cuts] = edge[0] = edge[-1] = True
        starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
        ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        hashes = np.zeros(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
            first, last = int(starts[at]), int(ends[to - 1])
            if last - first > PIECE:  # a single word of more than a piece
                hashes[at] = np.uint64(int.from_bytes(blake2b(FOLDED[data[first:last]].tobytes(), digest_size=8).digest()))
            else:
                sums = np.zeros(last - first + 1, np.uint64)
                np.cumsum(FOLDED[data[first:last]] * self.up[: last - first], out=sums[1:])
                s, e = starts[at:to] - first, ends[at:to] - first
                h = (sums[e] - sums[s]) * self.down[s]
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                hashes[at:to] = h ^ (h >> np.uint64(32))
            at = to
        return starts, ends, hashes

    @staticmethod
    def windows(hashes: np.ndarray, size: int) -> np.ndarray:
        """Hash of each run of ``size`` words."""
        n = max(0, len(hashes) - size + 1)
        out = hashes[:n].copy()
        for k in range(1, size):
            out *= np.uint64(0x94D049BB133111EB)
            out += hashes[k : k + n]
        return out


@dataclass
class Block:
    """Windows of some items. Window k of ``size`` has hash ``keys[k]`` and the words ``text[at[k]:to[k]]``, and belongs to
    the classes ``of[first[k]:first[k + 1]]``; ``ids`` are the item ids of each class of equal texts."""

    seed: int
    text: bytes
    sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    ids: list[list[str]]


def block_of(classes: list[tuple[str, list[str]]], seed: int = 0) -> Block:
    """classes: normalised text (not empty), item ids. Two different windows never share a key: the seed is changed then."""
    texts = [t.encode() for t, _ in classes]
    whole = b" ".join(texts)
    cuts = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, ends, hashes = Cutter(seed).words(np.frombuffer(whole, np.uint8), np.array([], int))
    first = np.searchsorted(starts, cuts)  # first word of each class
    number: dict[bytes, int] = {}
    word = np.array([number.setdefault(whole[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    sizes = {}
    lengths = np.diff(first)
    for size in sorted({*np.minimum(lengths, SIZE).tolist()}):
        keys = Cutter.windows(hashes, size)
        at = np.arange(len(keys))
        holder = owner[at]
        good = (holder == owner[at + size - 1]) & (lengths[holder] == size if size < SIZE else lengths[holder] >= SIZE)
        at = at[good][np.argsort(keys[good], kind="stable")]
        keys = keys[at]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]
        same = np.flatnonzero(~new)
        if any((word[at[same] + k] != word[at[same - 1] + k]).any() for k in range(size)):
            return block_of(classes, seed + 1)
        lead = at[new]
        group = np.cumsum(new) - 1
        pairs = np.unique(group * len(texts) + owner[at])  # a class once for each window
        sizes[size] = (keys[new], starts[lead], ends[lead + size - 1], np.searchsorted(pairs, np.arange(len(lead) + 1) * len(texts)), pairs % len(texts))
    return Block(seed, whole, sizes, [ids for _, ids in classes])


class Scanner:
    """Finds a block's windows in batches of texts."""

    def __init__(self, block: Block):
        self.block, self.cutter = block, Cutter(block.seed)
        self.filters = {}
        for size, (keys, *_) in block.sizes.items():
            bits = min(26, max(12, math.ceil(math.log2(16 * len(keys)))))
            seen = np.zeros(1 << bits, bool)
            seen[keys >> np.uint64(64 - bits)] = True
            self.filters[size] = seen, np.uint64(64 - bits)

    def scan(self, texts: pa.Array) -> pa.RecordBatch:
        """n_words, n_hit, items, spans of each text; spans in code points (start, stop) and words (first, last), both
        ends exclusive."""
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if n else None
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        starts, ends, hashes = self.cutter.words(data, offsets)
        first = np.searchsorted(starts, offsets)  # first word of each text
        last = np.repeat(first[1:], np.diff(first))  # by word: where its text's words end
        marks, pairs = np.zeros(len(starts) + 1, np.int64), []
        for size, (keys, at, to, begin, of) in self.block.sizes.items():
            found = Cutter.windows(hashes, size)
            seen, shift = self.filters[size]
            near = np.flatnonzero(seen[found >> shift])
            near = near[near + size <= last[near]]
            k = np.minimum(np.searchsorted(keys, found[near]), len(keys) - 1)
            near, k = near[keys[k] == found[near]], k[keys[k] == found[near]]
            true = [self.same(data, starts[i], ends[i + size - 1], at[j], to[j]) for i, j in zip(near.tolist(), k.tolist(), strict=True)]
            near, k = near[true], k[true]
            np.add.at(marks, near, 1)
            np.add.at(marks, near + size, -1)
            held = np.unique((np.searchsorted(first, near, "right") - 1) * len(keys) + k)  # a window once for each text
            doc, k = held // len(keys), held % len(keys)
            many = begin[k + 1] - begin[k]
            place = np.repeat(begin[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
            pairs.append(np.stack([np.repeat(doc, many), of[place]]))
        hit = np.cumsum(marks)[:-1] > 0
        items, spans = [[] for _ in range(n)], [[] for _ in range(n)]
        if hit.any():
            doc, kind = np.unique(np.concatenate(pairs, axis=1), axis=1)
            for d, kinds in zip((u := np.unique(doc, return_index=True))[0].tolist(), np.split(kind, u[1][1:]), strict=True):
                items[d] = sorted({x for k in kinds.tolist() for x in self.block.ids[k]})
            edge = np.isin(np.arange(len(hit)), first)  # no span crosses from text to text
            open_ = np.flatnonzero(hit & (edge | ~np.concatenate(([False], hit[:-1]))))
            close = np.flatnonzero(hit & (np.concatenate((edge[1:], [True])) | ~np.concatenate((hit[1:], [False]))))
            point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            for d, a, b in zip((np.searchsorted(first, open_, "right") - 1).tolist(), open_.tolist(), close.tolist(), strict=True):
                zero = int(point[offsets[d]])
                spans[d].append({"start": int(point[starts[a]]) - zero, "stop": int(point[ends[b]]) - zero, "first": a - int(first[d]), "last": b + 1 - int(first[d])})
        total = np.concatenate(([0], np.cumsum(hit)))
        return pa.RecordBatch.from_arrays([
            pa.array(np.diff(first), pa.int64()), pa.array(total[first[1:]] - total[first[:-1]], pa.int64()), pa.array(items, pa.list_(pa.string())),
            pa.array(spans, pa.list_(pa.struct([(x, pa.int32()) for x in ("start", "stop", "first", "last")]))),
        ], ["n_words", "n_hit", "items", "spans"])

    def same(self, data: np.ndarray, start: int, end: int, at: int, to: int) -> bool:
        return b" ".join(FOLDED[data[start:end]].tobytes().replace(b"\0", b" ").split()) == self.block.text[at:to]


def blocks(benchmark: DataFrame, most: int = BLOCK) -> Iterator[Block]:
    """The items (item_id, text) as blocks of about ``most`` bytes, one at a time on the driver. Equal texts are one class.
    A hash bucket of more than that, which takes a benchmark of about ``BUCKETS`` blocks, is a block by itself."""
    named = benchmark.select(normalised(F.col("text")).alias("t"), F.col("item_id").cast("string").alias("i")).where("t <> ''")
    classes = named.groupBy("t").agg(F.collect_set("i").alias("ids")).withColumn("bucket", F.pmod(F.xxhash64("t"), F.lit(BUCKETS)))
    classes = staged(classes, "items")
    sizes = classes.groupBy("bucket").agg(F.sum(F.octet_length("t") + 24 * F.size("ids")).alias("n")).orderBy("bucket").collect()
    chosen, total = [], 0
    for bucket, n in [*sizes, (None, 0)]:
        if chosen and (bucket is None or total + n > most):
            yield block_of([(r.t, r.ids) for r in classes.where(F.col("bucket").isin(chosen)).select("t", "ids").collect()])
            chosen, total = [], 0
        chosen.append(bucket)
        total += n


def scanned(rows: DataFrame, block: Block) -> DataFrame:
    """``rows`` (row, text) with what the block finds in each text; the text is left out."""
    sent = rows.sparkSession.sparkContext.broadcast(block)  # of bounded size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value)
        for b in batches:
            found = scanner.scan(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("row"), *found.columns], ["row", *found.schema.names])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(scan, f"row {kind}, {FOUND}")


def matches(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, most: int = BLOCK) -> DataFrame:
    """``row`` (a struct of ``columns`` of docs, by default all), n_words, n_hit (words inside a window of some item), items
    (ids, sorted as strings) and spans (runs of hit words: start, stop in code points, first, last in words)."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns])
    found = list(blocks(benchmark, most)) or [block_of([])]
    if len(found) == 1:
        return scanned(docs.select(row.alias("row"), text.alias("text")), found[0])
    key = F.struct("doc_id", F.sha2(text, 256).alias("digest"))
    keyed = docs.select(key.alias("row"), text.alias("text"))
    parts = [scanned(keyed, b).where("n_hit > 0").select("row", "items", "spans") for b in found]
    hits = reduce(DataFrame.unionByName, parts).distinct().groupBy("row")
    hits = hits.agg(F.flatten(F.collect_list("items")).alias("items"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    hits = hits.select(F.col("row.doc_id").alias("doc"), F.col("row.digest").alias("sum"), F.array_sort(F.array_distinct("items")).alias("items"), merged("spans").alias("spans"))
    all_rows = scanned(docs.select(F.struct(row.alias("row"), key.alias("key")).alias("row"), text.alias("text")), block_of([])).select("row.*", "n_words")
    together = all_rows.join(hits, F.col("key.doc_id").eqNullSafe(F.col("doc")) & (F.col("key.digest") == F.col("sum")), "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"])
    return together.select(
        "row", "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"),
    )


def merged(spans: str) -> Column:
    """Sorted spans, those that overlap or touch as one."""

    def add(done: Column, x: Column) -> Column:
        end = F.try_element_at(done, F.lit(-1))
        longer = F.struct(end["start"].alias("start"), F.greatest(end["stop"], x["stop"]).alias("stop"), end["first"].alias("first"), F.greatest(end["last"], x["last"]).alias("last"))
        return F.when(x["first"] <= end["last"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.expr(f"cast(array() as {SPANS})"), add)


def decontaminate(docs: DataFrame, benchmark: DataFrame, whole: bool = False, least: int = 1) -> DataFrame:
    """``docs`` without the passages that the benchmark holds. whole: documents of ``least`` hit words or more go; else the
    hit spans are cut out of their texts. Other columns stay as they are, null texts too."""
    found = matches(docs, benchmark)
    if whole:
        return found.where(F.col("n_hit") < least).select("row.*")
    text, spans = F.col("row.text"), F.col("spans")
    begin = lambda i: F.when(i > 0, F.get(spans, i - 1).stop).otherwise(0)
    piece = lambda i: text.substr(begin(i) + 1, F.coalesce(F.get(spans, i).start, F.char_length(text)) - begin(i))
    cut = F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), piece), "")
    kept = F.when(F.col("n_hit") >= least, cut).otherwise(text)
    return found.select(*[kept.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op11_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op11_decontaminate": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), {SIZE}) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT row_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b))),
hits AS (SELECT row_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT row_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT row_id, i, n FROM hits), range({SIZE}) AS r(k) WHERE k < n GROUP BY row_id),
items AS (SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_id) LEFT JOIN items USING (row_id)"""
}
