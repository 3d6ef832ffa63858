"""Token ids in grammar-compressed shards.

Within a block of documents, frequent pairs of neighbouring ids are replaced by nonterminals again and again (Re-Pair).
A block stores the rules, the length each nonterminal expands to, and each document's symbols, so that any stretch of
any document is decoded by itself. No rule crosses the end of a document.

Format of a block, little-endian: the magic ``RPG1``; five uint32: terminals, rules, symbols, documents, crc32 of all
that follows; then the arrays left uint16[rules], right uint16[rules], length uint32[rules], first symbol of each
document uint32[documents + 1], doc_id int64[documents], whether there is one uint8[documents], symbols
uint16[symbols]. Symbols take two bytes, so a block has 65,536 of them at most, terminals included. Blocks are the
binary column of a Parquet table, written by Spark's committer into the shared folder, so a lost executor leaves no
half-written file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraspan.llm.common import checked_broadcast, staged, table
from terraspan.llm.tokens import WordEncoder, encoder_of

MAGIC = b"RPG1"


@dataclass(frozen=True)
class Params:
    block_tokens: int = 1_000_000  # a block closes at the first document that reaches so many
    rules: int = 4096  # new rules in a pass at most, the most frequent pairs; the others have their turn in the next one
    least: int = 5  # occurrences of a pair that repay a rule of eight bytes


#: An odd number near the golden section of 2 ** 32.
SPREAD = np.uint32(2654435761)

# ---- Re-Pair ---------------------------------------------------------------------------------------------------------


def compress(ids: np.ndarray, last: np.ndarray, terminals: int, params: Params = Params()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (pairs of symbols; rule k is nonterminal terminals + k) and the marks of documents' last symbols.

    Each pass counts all pairs, makes rules of the most frequent ones and replaces their occurrences from left to
    right; an occurrence that overlaps the one before it waits for the next pass. It ends when no pair repays its rule,
    or the symbols are used up. Of equally frequent pairs the smaller one comes first.
    """
    seq, last = ids.astype(np.uint32), last.copy()
    rules = np.zeros((0, 2), np.uint32)
    while True:
        room = min(params.rules, (1 << 16) - terminals - len(rules))
        if len(seq) < 2 or room <= 0:
            break
        code = (seq[:-1] << np.uint32(16)) | seq[1:]
        inner = ~last[:-1]
        ordered = np.sort(code[inner])
        if not len(ordered):
            break
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        count = np.diff(np.append(first, len(ordered)))
        often = np.flatnonzero(count >= params.least)
        if not len(often):
            break
        often = often[np.argsort(-count[often], kind="stable")[:room]]
        chosen = np.sort(ordered[first[often]])
        seen = np.zeros(1 << 20, bool)  # by hash: few pairs that are not chosen are looked for among the chosen ones
        seen[chosen * SPREAD >> np.uint32(12)] = True
        at = np.flatnonzero(seen[code * SPREAD >> np.uint32(12)] & inner)
        found = np.searchsorted(chosen, code[at])
        hit = chosen[np.minimum(found, len(chosen) - 1)] == code[at]
        at, found = at[hit], found[hit]
        begins = np.append(True, np.diff(at) > 1)  # of a run of overlapping occurrences: every other one is replaced
        place = np.arange(len(at)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        at, found = at[place % 2 == 0], found[place % 2 == 0]
        seq[at] = terminals + len(rules) + found
        last[at] = last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last = seq[stay], last[stay]
        rules = np.concatenate([rules, np.stack([chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)], 1)])
    return seq, rules, last


def lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Terminals that each rule expands to. A rule only uses earlier ones, so passes settle from the first on."""
    size = np.ones(terminals + len(rules), np.int64)
    while True:
        new = size[rules[:, 0]] + size[rules[:, 1]] if len(rules) else np.zeros(0, np.int64)
        if np.array_equal(new, size[terminals:]):
            return new
        size[terminals:] = new


def expand(seq: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    while len(rules) and (deep := seq >= terminals).any():
        size = np.where(deep, 2, 1)
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        out[at] = np.where(deep, rules[np.where(deep, seq.astype(np.int64) - terminals, 0), 0], seq)
        out[at[deep] + 1] = rules[seq[deep].astype(np.int64) - terminals, 1]
        seq = out
    return seq


# ---- the file format -------------------------------------------------------------------------------------------------


def write_block(doc_ids: list[int | None], ids: list[np.ndarray], terminals: int, params: Params = Params()) -> bytes:
    """Documents with one id at least each."""
    whole = np.concatenate(ids)
    last = np.zeros(len(whole), bool)
    last[np.cumsum([len(x) for x in ids]) - 1] = True
    seq, rules, last = compress(whole, last, terminals, params)
    first = np.append(0, np.flatnonzero(last) + 1).astype("<u4")
    arrays = [rules[:, 0].astype("<u2"), rules[:, 1].astype("<u2"), lengths(rules, terminals).astype("<u4"), first, np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is not None for x in doc_ids], "u1"), seq.astype("<u2")]
    body = b"".join(a.tobytes() for a in arrays)
    return MAGIC + struct.pack("<5I", terminals, len(rules), len(seq), len(doc_ids), zlib.crc32(body)) + body


class Block:
    """A block read back: ``doc_ids`` (where ``named``), ``document(i)`` and ``stretch(i, a, b)`` without decoding anything
    else."""

    def __init__(self, data: bytes):
        terminals, n_rules, n_symbols, n_docs, crc = struct.unpack_from("<5I", data, 4)
        body = memoryview(data)[24:]
        if data[:4] != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("not a block, or a damaged one")
        at, parts = 0, []
        for kind, n in (("<u2", n_rules), ("<u2", n_rules), ("<u4", n_rules), ("<u4", n_docs + 1), ("<i8", n_docs), ("|u1", n_docs), ("<u2", n_symbols)):
            parts.append(np.frombuffer(body, kind, n, at))
            at += n * int(kind[2])
        left, right, length, self.first, self.doc_ids, named, self.symbols = parts
        self.named = named.astype(bool)
        self.terminals, self.rules = terminals, np.stack([left, right], 1).astype(np.uint32)
        self.size = np.append(np.ones(terminals, np.int64), length.astype(np.int64))

    def tokens(self) -> np.ndarray:
        return expand(self.symbols.astype(np.uint32), self.rules, self.terminals)

    def bounds(self) -> np.ndarray:
        """Where each document's ids start in ``tokens()``, and the end."""
        ends = np.append(0, np.cumsum(self.size[self.symbols]))
        return ends[self.first]

    def document(self, i: int) -> np.ndarray:
        return expand(self.symbols[self.first[i] : self.first[i + 1]].astype(np.uint32), self.rules, self.terminals)

    def stretch(self, i: int, a: int, b: int) -> np.ndarray:
        own = self.symbols[self.first[i] : self.first[i + 1]]
        ends = np.cumsum(self.size[own])
        lo, hi = np.searchsorted(ends, a, side="right"), np.searchsorted(ends, b, side="left") + 1
        before = int(ends[lo - 1]) if lo else 0
        return expand(own[lo:hi].astype(np.uint32), self.rules, self.terminals)[a - before : b - before]


# ---- operators -------------------------------------------------------------------------------------------------------

BLOCKS = "part int, block int, before long, n_tokens long, data binary"


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int = 2, params: Params = Params()) -> DataFrame:
    """Encode ``docs`` (doc_id, text), put ``end_id`` behind each document, and write blocks in ascending ``doc_id``
    order. Returns the written table: part (in order), block in the part, ids of the part before the block, ids, data.

    A null or empty text has the end id alone. Repeated ids and rows stay, in the order of a hash of their texts, by which
    ranges may split them; those without an id come first and stay without one. Whole texts are encoded; other columns are not read. One shuffle by range.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(WordEncoder, tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint16)
        doc_ids: list[int] = []
        ids: list[np.ndarray] = []
        n = before = block = 0

        def closed() -> pa.RecordBatch:
            data = write_block(doc_ids, ids, encoder.size, params)
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, block, before, n, data), types, strict=True)], names)

        names = ["part", "block", "before", "n_tokens", "data"]
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                encoded = encoder.encode_all(rows.column(1).to_pylist())
                for doc_id, x in zip(rows.column(0).to_pylist(), encoded, strict=True):
                    doc_ids.append(doc_id)
                    ids.append(np.append(np.frombuffer(x, "<u2"), end))
                    n += len(ids[-1])
                    if n >= params.block_tokens:
                        yield closed()
                        doc_ids, ids, before, block, n = [], [], before + n, block + 1, 0
        if doc_ids:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.withColumn("mark", F.when(F.col("text").isNotNull(), F.xxhash64("text"))).repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").select("doc_id", "text")
    return staged(ordered.mapInArrow(blocks, BLOCKS), "token_blocks")


def read_documents(blocks: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids_crc32`` from the written blocks."""
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    n_parts = totals.count()
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, not for each document
    base = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, before, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                block = Block(data)
                ids, at = block.tokens().astype("<u4"), block.bounds()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                arrays = [pa.array(block.doc_ids, mask=~block.named), pa.array(at[:-1] + (base + before)), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = blocks.join(checked_broadcast(base, n_parts), "part").select("base", "before", "data")
    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_documents(write_blocks(docs, public_tokenizers.path("word_bpe_49k.json")))
