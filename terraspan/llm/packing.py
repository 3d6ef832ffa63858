"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' ids. Round after round, every queue is granted its quantum, the window's
tokens times its share of the mixture; it emits as many whole tokens as its deficit counter allows and carries the
rest into the next window. The counter of queue q before window w is the fraction that ``rate_q * w / windows`` leaves
behind, so what a queue has emitted before any window is known in closed form: tasks place their documents without
waiting for each other, and deficits carry across windows and partitions exactly.

Sources beyond the largest ones are sub-queues of one shared queue. There deficit round-robin goes by whole documents:
each source's documents have times at which its counter affords them, in closed form again, and the shared queue holds
them in the order of these times. So every stretch of it holds each source's part to about one document, tokens of a
rare source are not scattered one by one, and nothing about these sources is held in one place.

Windows follow each other and are cut into sequences every ``length`` ids. What is left at the very end fills
sequences of powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraspan.llm.common import checked_broadcast, hand_back, staged, table
from terraspan.llm.tokens import ByteEncoder, encoder_of


@dataclass(frozen=True)
class Params:
    length: int = 1024  # ids in a sequence
    window: int = 64  # sequences in a window, about
    queues: int = 256  # sources with a queue of their own, the largest ones and all that the mixture names; the others share one
    end_id: int = 0



@dataclass(frozen=True)
class Plan:
    """What every task needs to know: the queues' totals, their rates and the number of windows."""

    totals: list[int]
    rates: list[int]
    windows: int
    length: int

    @classmethod
    def of(cls, totals: list[int], shares: list[float] | None, params: Params) -> Plan:
        """shares: the wanted mixture; None: that of the corpus. A queue that runs dry leaves the later windows to the
        others, so every token is emitted whatever the mixture."""
        windows = max(1, -(-sum(totals) // (params.length * params.window)))
        if shares is None:
            return cls(totals, [max(t, 1) for t in totals], windows, params.length)
        rounds = max((t / s for t, s in zip(totals, shares, strict=True) if t), default=1.0)
        return cls(totals, [max(t, 1, int(s * rounds)) for t, s in zip(totals, shares, strict=True)], windows, params.length)

    def served(self, queue: int, window: int) -> int:
        """Tokens that the queue has emitted before the window."""
        return min(self.totals[queue], self.rates[queue] * window // self.windows)

    def window_of(self, queue: int, token: int) -> int:
        return ((token + 1) * self.windows - 1) // self.rates[queue]

    def starts(self, window: int) -> list[int]:
        """Place of each queue's first token of the window in the order of all tokens."""
        before = [self.served(q, window) for q in range(len(self.totals))]
        at, out = sum(before), []
        for q, b in enumerate(before):
            out.append(at - b)
            at += self.served(q, window + 1) - b
        return out

    def place(self, at: int) -> tuple[int, int, int]:
        """Sequence, offset and ids left in the sequence for a place in the order of all tokens."""
        full, rest = divmod(sum(self.totals), self.length)
        if at < full * self.length:
            return at // self.length, at % self.length, self.length - at % self.length
        at, sequence = at - full * self.length, full
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                if at < 1 << bit:
                    return sequence, at, (1 << bit) - at
                at, sequence = at - (1 << bit), sequence + 1
        raise ValueError("beyond the last token")


def encoded(docs: DataFrame, tokenizer: str, sources: list[str | None], params: Params) -> DataFrame:
    """Ids of each document with its queue, its source if that has no queue of its own, its scan task and its place in
    that task's part of the queue, written to the shared folder so that places cannot change. A queue takes its documents
    in the order of tasks and rows."""
    number = {s: i for i, s in enumerate(sources)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(ByteEncoder, tokenizer), TaskContext.get().partitionId()
        end = np.array([params.end_id], "<u2").tobytes()
        done = [0] * (len(sources) + 1)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = batch.slice(start, 512)
                ids = [x + end for x in encoder.encode_all(rows.column(1).to_pylist())]
                names = rows.column(2).to_pylist()
                queue = [number.get(s, len(sources)) for s in names]
                names = [s if q == len(sources) else None for s, q in zip(names, queue, strict=True)]
                before = []
                for q, x in zip(queue, ids, strict=True):
                    before.append(done[q])
                    done[q] += len(x) // 2
                arrays = [rows.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(queue, pa.int32()), pa.array(before, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(names, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "part", "queue", "before", "n", "ids", "source"])
        encoder.rest(10_000)  # other stages share the worker's memory
        hand_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    return staged(rows.mapInArrow(encode, "doc_id long, part int, queue int, before long, n long, ids binary, source string"), "packing")


def shared_places(rest: DataFrame, alike: bool) -> DataFrame:
    """``part`` and ``before`` of the shared queue's documents, and ``first``, their first token's place in that queue.

    A source's document is due when a fraction of it (the source's own, from a hash, so that sources of one document do
    not all come at once) and all before it are paid for. alike: every source is paid alike, else in proportion to its
    tokens. Documents are sorted by range and places are sums over ranges, so no task holds all."""
    own = Window.partitionBy("source")
    earlier = own.orderBy("part", "before").rowsBetween(Window.unboundedPreceding, -1)
    phase = (F.pmod(F.xxhash64("source"), F.lit(1 << 24)) + 0.5) / float(1 << 24)
    paid = F.coalesce(F.sum("n").over(earlier), F.lit(0)) + phase * F.col("n")
    due = rest.select("part", "before", "n", "source", (paid if alike else paid / F.sum("n").over(own)).alias("due"))
    ranges = staged(due.repartitionByRange("due", "source", "part", "before").withColumn("range", F.spark_partition_id()), "packing_due")
    totals = ranges.groupBy("range").agg(F.sum("n").alias("total"))
    lower = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = totals.select("range", F.coalesce(F.sum("total").over(lower), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy("due", "source", "part", "before").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(base), "range")
    return staged(placed.select("part", "before", (F.col("base") + F.col("inside")).alias("first")), "packing_places")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int, window_id long"


def pack(docs: DataFrame, tokenizer: str, params: Params = Params(), mixture: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents (doc_id, text, source): see ``PIECES``.

    mixture: wanted share of each source; sources it leaves out share what it leaves over (in equal parts, 0 if it adds
    up to 1); a source it names has a queue of its own whatever its rank. None: the corpus' own shares. A null or empty text is the end id alone; a null source is a queue like
    others. Repeated rows are packed each. No row in, no row out.
    """
    sizes = docs.groupBy("source").count().orderBy(F.desc("count"), F.col("source").asc_nulls_first()).limit(params.queues)
    sources = [r["source"] for r in sizes.collect()]
    sources += [s for s in mixture or () if s not in set(sources)]
    ids = encoded(docs, tokenizer, sources, params)
    by_part = ids.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("queue", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    totals = [0] * (len(sources) + 1)  # the queues' number is bounded
    for r in by_part.groupBy("queue").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).collect():
        totals[r["queue"]] = r["n"]
    shares, rest = None, ids.where(F.col("queue") == len(sources))
    if mixture is not None:
        sharing = rest.select("source").distinct().count()
        left_out = sum(s not in mixture for s in sources) + sharing
        spare = max(0.0, 1.0 - sum(mixture.values())) / max(1, left_out)
        shares = [*[max(mixture.get(s, spare), 1e-6) for s in sources], max(spare, 1e-6) * max(1, sharing)]
    plan = Plan.of(totals, shares, params)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: dict[int, list[int]] = {}
        for batch in batches:
            out: list[tuple] = []
            rows = [batch.column(i).to_pylist() for i in range(4)]
            data = batch.column(4)
            for k, (doc_id, queue, first, n) in enumerate(zip(*rows, strict=True)):
                own = np.frombuffer(data[k].as_buffer(), "<u2").astype("<u4")
                done = 0
                while done < n:
                    window = plan.window_of(queue, first + done)
                    if window not in starts:
                        if len(starts) > 4096:
                            starts.clear()
                        starts[window] = plan.starts(window)
                    stop = min(n, plan.served(queue, window + 1) - first)
                    while done < stop:
                        sequence, offset, room = plan.place(starts[window][queue] + first + done)
                        size = min(stop - done, room)
                        out.append((doc_id, done, size, zlib.crc32(own[done : done + size]), n, sequence, offset, queue, window))
                        done += size
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "window_id"]
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if x == "queue" else pa.int64()) for x, c in zip(names, columns, strict=True)], names)

    columns = ["doc_id", "queue", "first", "n", "ids"]
    own = ids.where(F.col("queue") < len(sources)).join(checked_broadcast(base, by_part.count()), ["queue", "part"])
    placed = own.withColumn("first", F.col("base") + F.col("before")).select(*columns)
    if totals[-1]:
        placed = placed.unionByName(rest.join(shared_places(rest, mixture is not None), ["part", "before"]).select(*columns))
    return placed.mapInArrow(pieces, PIECES)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
