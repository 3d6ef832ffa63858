"""Secret scans over a trigram inverted index.

A Boolean trigram query is derived from each rule's regular expression: every text the expression can match must
satisfy it. The documents of an Arrow batch form one shard of the index: postings (trigram -> documents of the shard)
for the trigrams that any rule asks for. Postings are intersected and united as the query says, and only the
candidates are verified with the expression itself. A rule without mandatory trigrams scans every document.

Shards are independent, so nothing is shuffled, memory is bounded by a batch, and a lost executor costs its shards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.llm.common import table

try:
    from re import _parser as sre
except ImportError:  # before Python 3.11
    import sre_parse as sre

#: A query is True (no demand), a trigram, or ("and" | "or", {queries}).
Query = bool | str | tuple


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # of ``group``, in characters
    group: int = 0
    ignore_case: bool = False
    base: bool = False

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: In the order in which spans of equal start are listed. Hexadecimal runs ask for their least length in the
#: expression itself; leftmost greedy runs of 24 or more are the same matches.
RULES = (
    Rule("assign", r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
)

#: A private key from its first line on: up to the END line or, if there is none before the next BEGIN, over header fields and
#: lines in base64. The gaps between lines may be white space, line ends written as \\n, and signs of quoting.
_GAP = r"""(?:[\s>|"',]|\\[nrt])+"""
_BODY = rf"""(?:{_GAP}(?:Proc-Type|DEK-Info):[^\n\\]*)*(?:{_GAP}[A-Za-z0-9+/]{{16,}}={{0,2}})*(?:{_GAP}[A-Za-z0-9+/]+={{1,2}}|(?:[^\S\n]*\n|\\n)[\x20\t>|]*[A-Za-z0-9+/]+(?=["',\x20\t\r]*(?:\n|\\n|\Z)))?"""
WHOLE_KEY = rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:(?!-----BEGIN |-----END [A-Z ]*PRIVATE KEY-----)-[^-]*)*-----END [A-Z ]*PRIVATE KEY-----|{_BODY})"
#: The rules of redaction. The spans that :func:`find_secrets` lists mark a private key by its first line alone, as the SQL does.
MASKED = tuple(replace(r, pattern=WHOLE_KEY) if r.kind == "private_key" else r for r in RULES)


# ---- trigram queries -------------------------------------------------------------------------------------------------


def _all_of(parts: list[Query]) -> Query:
    parts = {p for p in parts if p is not True}
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _any_of(parts: list[Query]) -> Query:
    parts = set(parts)
    return True if True in parts else next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _grams(text: str) -> Query:
    return _all_of([text[i : i + 3] for i in range(len(text) - 2)])


def trigram_query(pattern: str, most: int = 64) -> Query:
    """The query every match of ``pattern`` satisfies, over lower-cased ASCII. Stretches that can spell at most
    ``most`` strings are spelled out, so optional characters and alternatives keep their trigrams."""

    def spell(node) -> list[str] | None:
        op, arg = str(node[0]), node[1]
        if op == "LITERAL":
            return [chr(arg).lower()] if arg < 128 else None
        if op == "IN" and all(str(x) == "LITERAL" and y < 128 for x, y in arg) and len(arg) <= 8:
            return sorted({chr(y).lower() for _, y in arg})
        if op == "SUBPATTERN":
            return spell_all(list(arg[-1]))
        if op == "BRANCH":
            each = [spell_all(list(b)) for b in arg[1]]
            return None if None in each else sorted({s for e in each for s in e})
        if op == "MAX_REPEAT" and arg[1] <= 3:
            one = spell_all(list(arg[2]))
            out, now = [], [""]
            for k in range(arg[1] + 1):
                if k >= arg[0]:
                    out += now
                now = [a + b for a in now for b in one] if one else []
            return sorted(set(out)) if one and len(out) <= most else None
        return None

    def spell_all(nodes) -> list[str] | None:
        out = [""]
        for n in nodes:
            s = spell(n)
            if s is None or len(out) * len(s) > most:
                return None
            out = [a + b for a in out for b in s]
        return out

    def of(nodes) -> Query:
        parts, run = [], [""]
        for n in nodes:
            s = spell(n)
            if s is not None and len(run) * len(s) <= most:
                run = [a + b for a in run for b in s]
                continue
            parts.append(_any_of([_grams(r) for r in run]))
            run = [""]
            if str(n[0]) == "SUBPATTERN":
                parts.append(of(list(n[1][-1])))
            elif str(n[0]) == "BRANCH":
                parts.append(_any_of([of(list(b)) for b in n[1][1]]))
            elif str(n[0]) == "MAX_REPEAT" and n[1][0] >= 1:
                parts.append(of(list(n[1][2])))
        return _all_of([*parts, _any_of([_grams(r) for r in run])])

    return of(list(sre.parse(pattern)))


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


# ---- one shard -------------------------------------------------------------------------------------------------------


def postings(values: np.ndarray, offsets: np.ndarray, grams: list[str]) -> dict[str, np.ndarray]:
    """Ordinals of the shard's documents by trigram. values: the texts' bytes, end to end; case is folded."""
    codes = np.array([int.from_bytes(g.encode(), "big") for g in grams], dtype=np.uint32)
    wanted = np.zeros(1 << 24, dtype=bool)
    wanted[codes] = True
    found_at, found_code = [], []
    for start in range(0, max(len(values) - 2, 0), 1 << 22):  # so that the codes of a stretch stay small
        b = values[start : start + (1 << 22) + 2]
        b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        at = np.flatnonzero(wanted[code])
        found_at.append(at + start)
        found_code.append(code[at])
    at = np.concatenate(found_at) if found_at else np.zeros(0, np.int64)
    code = np.concatenate(found_code) if found_code else np.zeros(0, np.uint32)
    doc = np.searchsorted(offsets, at, side="right") - 1
    whole = at + 3 <= offsets[np.minimum(doc + 1, len(offsets) - 1)]  # not across two texts
    return {g: np.unique(doc[whole & (code == c)]) for g, c in zip(grams, codes, strict=True)}


def candidates(query: Query, lists: dict[str, np.ndarray], n: int) -> np.ndarray:
    if query is True:
        return np.arange(n)
    if isinstance(query, str):
        return lists[query]
    each = sorted((candidates(q, lists, n) for q in query[1]), key=len)
    out = each[0]
    for x in each[1:]:
        out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
    return out


def scan(texts: pa.Array, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """Per text of the shard, its matches as (start, rule number, end) in code points, sorted."""
    texts = pa.array(texts.fill_null("").cast(pa.large_string()))
    n = len(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    if not n:
        return found
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    queries = [trigram_query(r.pattern) for r in rules]
    lists = postings(values, offsets - offsets[0], sorted(set().union(*map(trigrams_of, queries))))
    read: dict[int, str] = {}
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        regex = rule.regex
        for i in candidates(query, lists, n).tolist():
            if query is True:
                text = read.get(i) or texts[i].as_py()
            else:
                text = read[i] = read.get(i) or texts[i].as_py()
            for m in regex.finditer(text):
                if len(m[rule.group]) >= rule.least:
                    found[i].append((m.start(), k, m.end()))
    return [sorted(x) for x in found]


# ---- operators -------------------------------------------------------------------------------------------------------

SPANS = "array<struct<start:int,kind:string,end:int>>"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``secrets``, the spans in order of start and then of the rules.

    A null text holds no secret, nor does an empty one. Very long texts are scanned whole. Repeated rows are scanned
    each; other columns are not read. Matches of one rule do not overlap; matches of two rules may.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"start": s, "kind": rules[k].kind, "end": e} for s, k, e in x] for x in scan(batch.column(1), rules)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["id", "secrets"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(shards, f"id {id_type}, secrets {SPANS}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = MASKED, mask: str = "[{}]") -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by its kind, private keys with their bodies. Overlapping spans
    are masked as one, under the kind that starts first. Rows, their number and all other columns stay; a null text stays null; ``n_chars``, if
    there, follows the new text."""
    schema = docs.schema

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            spans = scan(batch.column(at), rules)
            if any(spans):
                texts = batch.column(at).to_pylist()
                for i, found in enumerate(spans):
                    if found:
                        texts[i] = masked(texts[i], found)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch

    def masked(text: str, found: list[tuple[int, int, int]]) -> str:
        out, done = [], 0
        for start, k, end in found:
            if start >= done:
                out += [text[done:start], mask.format(rules[k].kind)]
            done = max(done, end)
        return "".join([*out, text[done:]])

    out = docs.mapInArrow(shards, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The digest of :func:`find_secrets` over all documents."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long")
    base = [r.kind for r in RULES if r.base]
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("secrets", lambda s: s.kind.isin(base))), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def _sql() -> str:
    return r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds(k, kind, re) AS (VALUES
 (0, 'assign', '(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
 (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'private_key', '-----BEGIN [A-Z ]*PRIVATE KEY-----'),
 (4, 'git_token', 'gh[pousr]_[A-Za-z0-9]{36,}'), (5, 'chat_token', 'xox[abprs]-[A-Za-z0-9-]{10,}'),
 (6, 'map_key', 'AIza[A-Za-z0-9_-]{35}'), (7, 'pay_key', '[sr]k_(?:live|test)_[A-Za-z0-9]{16,}'),
 (8, 'web_token', 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*')),
lists AS (SELECT doc_id, t, k, kind, CASE k
   WHEN 0 THEN regexp_extract_all(t, '(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
   WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+')
   WHEN 2 THEN list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)
   WHEN 3 THEN regexp_extract_all(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----')
   WHEN 4 THEN regexp_extract_all(t, 'gh[pousr]_[A-Za-z0-9]{36,}')
   WHEN 5 THEN regexp_extract_all(t, 'xox[abprs]-[A-Za-z0-9-]{10,}')
   WHEN 6 THEN regexp_extract_all(t, 'AIza[A-Za-z0-9_-]{35}')
   WHEN 7 THEN regexp_extract_all(t, '[sr]k_(?:live|test)_[A-Za-z0-9]{16,}')
   ELSE regexp_extract_all(t, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*') END AS ms FROM d, kinds),
step AS (
  SELECT doc_id, t, k, kind, ms, 0 AS i, 0::BIGINT AS done, NULL::BIGINT AS s, NULL::VARCHAR AS m FROM lists WHERE len(ms) > 0
  UNION ALL
  SELECT doc_id, t, k, kind, ms, i + 1, done + instr(t[done + 1:], ms[i + 1]) - 1 + length(ms[i + 1]),
         done + instr(t[done + 1:], ms[i + 1]) - 1, ms[i + 1] FROM step WHERE i < len(ms)),
hit AS (SELECT doc_id, k, kind, s, s + length(m) AS e FROM step WHERE i > 0 AND CASE k
   WHEN 0 THEN length(regexp_extract(m, '^(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6
   WHEN 1 THEN length(m) >= 20 ELSE true END),
agg AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS b,
   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS a FROM hit GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN agg ON agg.doc_id = d.doc_id"""


ORACLE = {"op2_secret_scan": _sql()}
