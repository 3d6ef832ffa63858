"""Rule bitmask ledger for document quality.

Every rule is evaluated once per document. Its verdict is one bit of ``failed_bits`` and the measurements it used stay
beside it, so that any later policy (a set of rules) is a bitwise test and any ablation is one aggregation over the
ledger; the texts are not read again.

Everything here is native: array functions inside the row, no shuffle for the ledger and one small aggregation for an
ablation.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.llm.common import BLANK, shared_dir, table

#: Bit k of the ledger is the k-th rule. Rules are only ever appended, so that old ledgers keep their meaning.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "100 * n_symbols > 3 * word_chars",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "long_words": "word_chars > 12 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules; a document is kept if it fails none of them."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


POLICIES = {
    p.version: p
    for p in (
        Policy("v1-base", ("too_few_words", "repeated_words")),
        Policy("v2", ("too_few_words", "repeated_words", "symbol_heavy", "duplicate_lines", "long_words", "short_words")),
    )
}


def _let(value: Column, body) -> Column:
    """Bind ``value`` once and use it any number of times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Number of words covered by three-word windows that occur twice or more. Windows are compared by 64-bit hash.

    The windows' hashes are sorted with their places. Where the upper 44 bits tell as many windows apart as the whole
    hash does, hash and place share one long, which sorts without objects; otherwise pairs are sorted.
    """
    place = (1 << 20) - 1
    upper = lambda x: F.shiftright(x, 20)
    whole = lambda x: x

    def marked(keys: Column, key, place_of) -> Column:
        def same(x: Column, other: Column) -> Column:
            return F.coalesce(key(x) == key(other), F.lit(False))

        twins = F.filter(keys, lambda x, k: same(x, F.get(keys, k - 1)) | same(x, F.get(keys, k + 1)))
        return F.sort_array(F.transform(twins, place_of))

    def packed(hashes: Column) -> Column:
        joined = F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long")))
        return _let(F.sort_array(joined), lambda keys: marked(keys, upper, lambda x: x.bitwiseAND(F.lit(place)).cast("int")))

    def paired(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return _let(F.sort_array(pairs), lambda keys: marked(keys, lambda x: x.h, lambda x: x.i))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda a, i: F.struct((a.n + F.least(F.lit(3), i - a.last)).alias("n"), i.alias("last"))
        return F.aggregate(places, start, step, lambda a: a.n)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def counted(hashes: Column) -> Column:
        kinds = lambda key: F.size(F.array_distinct(hashes if key is whole else F.transform(hashes, key)))
        fits = (F.size(hashes) <= place) & (kinds(upper) == kinds(whole))
        found = F.when(fits, packed(hashes)).otherwise(paired(hashes))
        return F.when(kinds(whole) == F.size(hashes), F.lit(0)).otherwise(covered(found))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(words, lambda w: _let(windows(w), counted)))


def measure(docs: DataFrame) -> DataFrame:
    """Add the measurements to ``doc_id`` and ``text`` (long columns).

    A null text has no words and no lines, as an empty one. Very long texts are measured whole. Other columns of
    ``docs`` are not read, so names that clash with the measurements do no harm. Repeated rows are measured each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    words = F.array_remove(F.split(F.col("t"), BLANK), "")

    def of_words(w: Column) -> Column:
        chars = F.char_length(F.array_join(w, ""))
        return F.struct(F.size(w).alias("n_words"), chars.alias("word_chars"), _repeat_words(w).alias("n_repeat_words"))

    measured = docs.select("doc_id", text.alias("t")).select(
        "doc_id",
        _let(words, of_words).alias("w"),
        F.char_length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("own"))).alias("l"),
    )
    return measured.select(
        "doc_id",
        F.col("w.n_words").cast("long").alias("n_words"),
        F.col("w.word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("l.all").cast("long").alias("n_lines"),
        (F.col("l.all") - F.col("l.own")).cast("long").alias("n_dup_lines"),
        F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements plus ``failed_bits`` (long): bit k is set if the k-th rule of ``RULES`` fails."""
    bits = [F.shiftleft(F.expr(test).cast("long"), k) for k, test in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(docs).withColumn("failed_bits", failed)


#: Paths of the ledgers that this process has written, by application and the state of the documents' files.
_WRITTEN: dict[tuple, str] = {}


def files_of(docs: DataFrame) -> tuple:
    """Names, sizes and times of the files that a table is read from, as its store tells them."""
    jvm, conf = docs.sparkSession._jvm, docs.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in sorted(docs.inputFiles())]
    states = [p.getFileSystem(conf).getFileStatus(p) for p in paths]
    return tuple((p.toString(), s.getLen(), s.getModificationTime()) for p, s in zip(paths, states, strict=True))


def stored_ledger(spark, sf_dir: str) -> DataFrame:
    """The ledger of ``documents`` as a table in the shared folder: the texts are read once a session, whatever number of
    policies and ablations follows. It belongs to the files it was measured on: when one of them has changed, or the
    ledger has been cleared away, it is written again."""
    docs = table(spark, sf_dir, "documents")
    key = (spark.sparkContext.applicationId, files_of(docs))
    if key in _WRITTEN:
        try:
            return spark.read.parquet(_WRITTEN[key])
        except AnalysisException:
            pass
    path = f"{shared_dir(spark)}/terraspan/ledger-{uuid.uuid4().hex}"
    ledger(docs).write.option("compression", "zstd").parquet(path)
    _WRITTEN[key] = path
    return spark.read.parquet(path)


def passes(policy: Policy) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    return rows.withColumn("kept", passes(policy)).withColumn("policy", F.lit(policy.version))


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """One row per rule of ``policy``: documents that fail it, that fail it alone (and would come back without it),
    and what the policy would keep without it. One partial aggregation over the ledger; empty ledgers give zeros."""
    hit = F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    aggs = [F.count_if(hit == 0).alias("kept")]
    for rule in policy.rules:
        bit = F.lit(1 << list(RULES).index(rule)).cast("long")
        aggs += [F.count_if(hit.bitwiseAND(bit) != 0).alias(f"f_{rule}"), F.count_if(hit == bit).alias(f"o_{rule}")]
    one = rows.agg(*aggs)
    each = [
        F.struct(
            F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only"),
            (F.col("kept") + F.col(f"o_{r}")).alias("kept_without"),
        )
        for r in policy.rules
    ]
    return one.select(F.inline(F.array(*each)))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = apply_policy(stored_ledger(spark, sf_dir), POLICIES["v2"])
    base = F.col("failed_bits").bitwiseAND(F.lit(POLICIES["v1-base"].mask).cast("long")) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "n_lines", "failed_bits",
    )


def op1_ablations(spark, sf_dir: str) -> DataFrame:
    return ablations(stored_ledger(spark, sf_dir), POLICIES["v2"])


_MEASURED_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x09-\x0D\x20]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
r AS (SELECT *, """ + " | ".join(f"(({test})::BIGINT << {k})" for k, test in enumerate(RULES.values())) + r""" AS failed_bits FROM m)
"""

ORACLE = {
    "op1_quality_rules": _MEASURED_SQL
    + f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        failed_bits & {POLICIES["v1-base"].mask} <> 0 AS base_failed, failed_bits & {POLICIES["v2"].mask} = 0 AS kept,
        n_lines, failed_bits::BIGINT AS failed_bits FROM r""",
    "op1_ablations": _MEASURED_SQL
    + " UNION ALL ".join(
        f"SELECT '{x}' AS rule, count(*) FILTER (h & {1 << k} <> 0) AS n_failed, count(*) FILTER (h = {1 << k}) AS n_only, "
        f"count(*) FILTER (h = 0 OR h = {1 << k}) AS kept_without FROM (SELECT failed_bits & {POLICIES['v2'].mask} AS h FROM r)"
        for k, x in enumerate(RULES)
    ),
}
