"""Structure repair of conversations by signatures.

A conversation's roles and faults are one short string, its signature: a character for each row. Very many conversations
share one, so each distinct signature is solved once, by recursion over its halves with a memory of pieces seen before,
and the audit (the initials of the cheapest edits) is joined back and replayed over the rows.

Rows of a conversation reach the tasks in Python as a sorted stream: neither a row of a table nor a worker holds a
conversation's texts together, however many rows it has. Its signature and audit take a byte a row. A digest over a whole
repaired conversation has to be taken in one task, row after row; nothing else is.

Nulls and ties: a null role or text is one space; a row of an empty role has no initial and cannot be kept as it is. Rows of equal turn (nulls first) run by role, then by the SHA-256 of the
text. Rows with a null conv_id are one conversation. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraspan.llm.common import small_batches, staged, table

#: Where a repair can stand: nothing given yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What comes next by place when a role is put in (reroled or inserted), and its name.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = ("", "", "user", "assistant")
#: Where a kept role leads.
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
KEEP_COST, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
END = (0, 2 * INSERT, INSERT, 0)
#: Pieces of signatures up to this length are remembered, and how many of them.
SHORT, REMEMBERED = 64, 1 << 16
ORDER = ["turn", "role", "digest", "copy"]


def closed(costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from each place with insertions allowed before anything else."""
    for _ in NEXT:
        costs = tuple(min(c, INSERT + costs[n]) for c, n in zip(costs, NEXT, strict=True))
    return costs


def options(symbol: str, place: int) -> list[tuple[str, int, int]]:
    """Edits of a row at a place, the least letter first: letter, cost, next place. Symbols are the initials s, u and a, o
    for others, in upper case if truncated; x must be deleted."""
    out = [("D", DELETE, place)]
    if symbol != "x":
        more = TRUNCATED * symbol.isupper()
        if (to := KEPT.get((symbol.lower(), place))) is not None:
            out.append(("K", KEEP_COST + more, to))
        out.append(("R", REROLE + more, NEXT[place]))
    return out


def ahead(piece: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs from each place before ``piece`` on, given those after it."""
    least = min(after)
    known = short_ahead if len(piece) <= SHORT else halves_ahead
    return tuple(c + least for c in known(piece, tuple(c - least for c in after)))


def halves_ahead(piece: str, after: tuple[int, ...]) -> tuple[int, ...]:
    if len(piece) == 1:
        return closed(tuple(min(cost + after[to] for _, cost, to in options(piece, place)) for place in range(4)))
    half = len(piece) // 2
    return ahead(piece[:half], ahead(piece[half:], after))


short_ahead = lru_cache(REMEMBERED)(halves_ahead)


def edits(piece: str, place: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The ASCII-least of the cheapest audits of ``piece`` from ``place`` on, and where it leads. A cheapest audit is never
    the beginning of another, so the least letter can be taken at each step."""
    least = min(after)
    known = short_edits if len(piece) <= SHORT else halves_edits
    return known(piece, place, tuple(c - least for c in after))


def halves_edits(piece: str, place: int, after: tuple[int, ...]) -> tuple[str, int]:
    if len(piece) > 1:
        half = len(piece) // 2
        first, place = edits(piece[:half], place, ahead(piece[half:], after))
        second, place = edits(piece[half:], place, after)
        return first + second, place
    now, letters = ahead(piece, after), ""
    while True:
        for letter, cost, to in sorted([*options(piece, place), ("I", INSERT, NEXT[place])]):
            if now[place] == cost + (now if letter == "I" else after)[to]:
                letters, place = letters + letter, to
                break
        if letter != "I":
            return letters, place


short_edits = lru_cache(REMEMBERED)(halves_edits)


def solve(signature: str) -> tuple[int, str]:
    """Least cost of a repair, and the ASCII-least of its audits."""
    if not signature:
        return 0, ""
    letters, place = edits(signature, START, END)
    return ahead(signature, END)[START], letters + "I" * (END[place] // INSERT)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy after damage by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space)."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), (F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn"))) % 20).alias("r")).where("r <> 0")
    text = F.when(F.col("r") == 1, "").when(F.col("r") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("r") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("r") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, copy and ``fault``: the first of blank, duplicate, truncated, or null. The texts stay
    behind; rows are dealt by conversation once, for this and for ``signatures``."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\v\f\r")), -1, 1)
    slim = with_digest(rows).select("conv_id", *ORDER, (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "digest").orderBy("turn", "copy")
    marked = slim.withColumn("place", F.row_number().over(same))
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > 1, "duplicate").when(F.col("open"), "truncated")
    return marked.select("conv_id", *ORDER, fault.alias("fault"))


def symbol(role: Column, fault: Column) -> Column:
    initial = F.substring(role, 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(letter)).otherwise(letter)


def signatures(faulty: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal (adjacent initials) and signature.
    The rows of a conversation share a partition, as ``faults`` leaves them."""
    kind = faulty.schema["conv_id"].dataType.simpleString()
    n = lambda f: F.coalesce(F.col("fault") == f, F.lit(False)).alias(f)
    rows = faulty.select("conv_id", *ORDER, F.substring("role", 1, 1).alias("initial"), symbol(F.col("role"), F.col("fault")).alias("symbol"), n("blank"), n("duplicate"), n("truncated"))
    rows = rows.sortWithinPartitions("conv_id", *ORDER).select("conv_id", "turn", "initial", "symbol", "blank", "duplicate", "truncated")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = {}, None  # of the conversation at hand

        def done(out: list) -> None:
            if seen is not None:
                out.append({"conv_id": seen[0], **{c: sums[c] for c in counts}, "signature": sums["signature"].decode()})

        for b in batches:
            out: list[dict] = []
            for conv, turn, initial, mark, *marks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if seen != (conv,):
                    done(out)
                    seen, sums = (conv,), dict.fromkeys(counts, 0) | {"signature": bytearray(), "turn": None, "before": None}
                if turn is not None and turn != sums["turn"]:
                    sums["gaps"] += 0 if sums["turn"] is None else turn - sums["turn"] - 1
                    sums["turn"] = turn
                for c, m in zip(counts[1:4], marks, strict=True):
                    sums[c] += m
                sums["illegal"] += sums["before"] is not None and sums["before"] + initial not in ("su", "ua", "au")
                sums["before"] = initial
                sums["signature"] += mark.encode()
            yield pa.RecordBatch.from_pylist(out, schema)
        out = []
        done(out)
        yield pa.RecordBatch.from_pylist(out, schema)

    conv = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    schema = pa.schema([("conv_id", conv), *[(c, pa.int64()) for c in counts], ("signature", pa.string())])
    return rows.mapInArrow(read, f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, signature string")


def solved(found: DataFrame) -> DataFrame:
    """signature, cost, audit of each distinct signature."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            costs, audits = zip(*map(solve, texts), strict=True) if texts else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["signature", "cost", "audit"])

    return found.select("signature").distinct().mapInArrow(read, "signature string, cost long, audit string")


def replayed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The edits over the rows, in order: conv_id, place, edit, role, text of all rows of the repaired conversations.
    audits: conv_id, audit. The audit of a conversation comes before its rows in one sorted stream."""
    return streamed(rows, audits, digest=False)


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of the repaired rows, ``role:text`` joined by line feeds."""
    return streamed(rows, audits, digest=True)


def streamed(rows: DataFrame, audits: DataFrame, digest: bool) -> DataFrame:
    kind = rows.schema["conv_id"].dataType
    nothing = {"turn": "long", "role": "string", "digest": "binary", "copy": "int"}
    heads = audits.select("conv_id", F.lit(0).alias("part"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], F.col("audit").alias("text"))
    body = with_digest(rows).select("conv_id", F.lit(1).alias("part"), *[F.col(c).cast(t).alias(c) for c, t in nothing.items()], "text")
    both = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", *ORDER).select("conv_id", "part", "role", "text")
    conv = pa.string() if kind.simpleString() == "string" else pa.int32() if kind.simpleString() == "int" else pa.int64()
    fields = [("repaired_sha256", pa.string())] if digest else [("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    schema = pa.schema([("conv_id", conv), *fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        player: Player | None = None
        for b in batches:
            out: list[tuple] = []
            for c, part, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if part == 0:
                    if player:
                        player.end(out)
                    player = Player(c, text, digest)
                else:
                    player.row(role, text, out)
            yield batch(out)
        out = []
        if player:
            player.end(out)
        yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return both.mapInArrow(read, ", ".join(["conv_id " + kind.simpleString(), *(["repaired_sha256 string"] if digest else ["place long", "edit string", "role string", "text string"])]))


class Player:
    """Applies an audit to the rows of one conversation as they come."""

    def __init__(self, conv, audit: str, digest: bool):
        self.conv, self.audit, self.at, self.place, self.n = conv, audit, 0, START, 0
        self.sum = sha256() if digest else None

    def give(self, edit: str, role: str, text: str, out: list) -> None:
        if self.sum is None:
            out.append((self.conv, self.n, edit, role, text))
        else:
            self.sum.update(("\n" * (self.n > 0) + f"{role}:{text}").encode())
        self.n += 1

    def insertions(self, out: list) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.place = NEXT[self.place]
            self.give("I", NAMES[self.place], "", out)
            self.at += 1

    def row(self, role: str, text: str, out: list) -> None:
        self.insertions(out)
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.place = KEPT[role[:1], self.place]
            self.give(edit, role, text, out)
        elif edit == "R":
            self.place = NEXT[self.place]
            self.give(edit, NAMES[self.place], text, out)

    def end(self, out: list) -> None:
        self.insertions(out)
        if self.sum is not None:
            out.append((self.conv, self.sum.hexdigest()))


def audited(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of ``rows`` (conv_id, turn,
    role, text, copy; no nulls in role and text)."""
    found = staged(signatures(faults(rows)), "signatures")
    return found.join(solved(found), "signature").drop("signature")


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations of ``rows`` (conv_id, turn, role, text): conv_id, place, edit (K, R or I), role, text."""
    filled = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(0).alias("copy"))
    small_batches(rows.sparkSession)
    return replayed(filled, audited(filled).select("conv_id", "audit"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    rows = damaged(original)
    audits = staged(audited(rows), "audits")
    sums = digests(rows, audits.select("conv_id", "audit"))
    whole = audits.join(sums.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
    ids = original.select(F.col("conv_id").alias("id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return ids.join(whole, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"),
    )


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({s}, ''), lambda c: ord(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""
#: Costs and audits from each place, as structs that order by cost, then by audit.
_CLOSED = "list_transform(range(4), lambda p: least({c}[p + 1], {{'c': {c}[{n}[p + 1] + 1].c + 5, 'a': 'I' || {c}[{n}[p + 1] + 1].a}}))"
_NEXT = "[2, 2, 3, 2]"
_KEPT = "CASE WHEN symbol = 's' AND p = 0 THEN 1 WHEN symbol = 'u' AND p <> 2 THEN 2 WHEN symbol = 'a' AND p = 2 THEN 3 END"
_STEP = f"""list_transform(range(4), lambda p: least({{{{'c': costs[p + 1].c + 2, 'a': 'D' || costs[p + 1].a}}}},
    CASE WHEN must THEN NULL ELSE {{{{'c': costs[{_NEXT}[p + 1] + 1].c + 1 + more, 'a': 'R' || costs[{_NEXT}[p + 1] + 1].a}}}} END,
    CASE WHEN must OR ({_KEPT}) IS NULL THEN NULL ELSE {{{{'c': costs[({_KEPT}) + 1].c + more, 'a': 'K' || costs[({_KEPT}) + 1].a}}}} END))"""


def _sql() -> str:
    return f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hurt AS (SELECT *, {_CRC.format(s="name")} % 20 AS r FROM raw),
rows AS (SELECT conv_id, turn, CASE WHEN r = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN r = 1 THEN '' WHEN r = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN r = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hurt WHERE r <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
  regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) AS ending FROM rows),
marked AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before,
  CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
f AS (SELECT *, initial AS symbol, coalesce(fault IN ('blank', 'duplicate'), false) AS must, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM marked),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
solved(conv_id, i, costs) AS (
  SELECT conv_id, n, [{{'c': 0, 'a': ''}}, {{'c': 10, 'a': 'II'}}, {{'c': 5, 'a': 'I'}}, {{'c': 0, 'a': ''}}] FROM counts
  UNION ALL
  SELECT conv_id, i, {_CLOSED.format(c="c2", n=_NEXT)} FROM (SELECT conv_id, i, {_CLOSED.format(c="c1", n=_NEXT)} AS c2 FROM (SELECT conv_id, i, {_CLOSED.format(c="c0", n=_NEXT)} AS c1 FROM (
    SELECT s.conv_id, s.i - 1 AS i, {_STEP.format()} AS c0 FROM solved s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i)))),
best AS (SELECT conv_id, costs[1].c AS cost, costs[1].a AS audit FROM solved WHERE i = 0),
letters AS (SELECT conv_id, audit[k] AS letter, k, count(*) FILTER (audit[k] <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i
  FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS k FROM best)),
given AS (SELECT l.conv_id, l.letter, f.role, f.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY k) - 1 AS k
  FROM letters l LEFT JOIN f ON l.letter <> 'I' AND f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE l.letter <> 'D'),
headed AS (SELECT *, bool_or(k = 0 AND letter = 'K' AND left(role, 1) = 's') OVER (PARTITION BY conv_id) AS headed FROM given),
named AS (SELECT conv_id, k, CASE WHEN letter = 'K' THEN role WHEN (k - headed::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END AS line FROM headed),
sums AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS sum FROM named GROUP BY conv_id)
SELECT o.conv_id, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))},
  coalesce(audit, '') AS audit, coalesce(sum, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLE = {"op12_conversation_repair": _sql()}
