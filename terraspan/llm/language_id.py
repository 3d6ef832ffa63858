"""Language identification by word-first backoff.

A word the model knows is scored by its log frequency in each language. A word it does not know falls back to its
character n-grams, the longest length first: the first length at which the model knows any n-gram of the word scores
it. Counts are Spark aggregations over a bounded sample of labelled rows; scoring is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.llm.common import bounded_rows, counts_by, fold_of, hand_back, letter_words, staged, table, words_of

UNDETERMINED = "und"


@dataclass(frozen=True)
class Params:
    sample_docs: int = 400  # labelled rows for each language that the model is fitted on, about
    longest: int = 5  # n-grams of a word, its start and end marked
    prior: float = 0.5  # added to every count
    evidence: float = 20.0  # words beyond which a score gets no surer
    cache: int = 50_000  # unknown words a task remembers


@dataclass(frozen=True)
class Model:
    """``words`` and ``grams``, all of the sample, map to rows of log probabilities; a row is centred, so that it only
    compares."""

    langs: list[str]
    words: list[str]
    word_rows: np.ndarray
    grams: list[str]
    gram_rows: np.ndarray
    params: Params


def fit(docs: DataFrame, params: Params = Params()) -> Model:
    """Fit on rows of ``docs`` (doc_id, text, lang) that have both text and lang. No such row: a model without languages."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = counts_by(labelled, "lang")
    langs = sorted(counts)
    if not langs:
        return Model([], [], np.zeros((0, 0)), [], np.zeros((0, 0)), params)
    sample = bounded_rows(labelled, "lang", params.sample_docs, seed=5, counts=counts)
    words = staged(sample.select("lang", F.explode(letter_words(F.col("text"))).alias("word")).groupBy("lang", "word").count(), "lang_words")
    marked = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.char_length(marked) - (n - 1)), lambda i: F.substr(marked, i, F.lit(n)))
    some = lambda n: F.when(F.char_length(marked) >= n, cut(n)).otherwise(F.array().cast("array<string>"))
    grams = words.select(
        "lang", F.explode(F.flatten(F.array(*[some(n) for n in range(2, params.longest + 1)]))).alias("word")
    ).groupBy("lang", "word").count()

    at = {x: i for i, x in enumerate(langs)}

    def table_of(found: pd.DataFrame, by_length: bool) -> tuple[list[str], np.ndarray]:
        """Words or n-grams with their log probabilities; n-grams have those among n-grams of their length."""
        row, names = pd.factorize(found["word"].astype(object), sort=True)
        c = np.full((len(names), len(langs)), params.prior)
        np.add.at(c, (row, found["lang"].map(at).to_numpy(int)), found["count"].to_numpy(float))
        group = np.array([len(x) if by_length else 0 for x in names])
        for g in np.unique(group):
            c[group == g] /= c[group == g].sum(0)
        p = np.log(c)
        return list(names), (p - p.max(1, keepdims=True)).astype(np.float32) if len(p) else p

    return Model(langs, *table_of(words.toPandas(), False), *table_of(grams.toPandas(), True), params)


class _Scorer:
    """Languages and scores of texts; remembers words, up to a bound."""

    def __init__(self, model: Model):
        self.m = model
        self.gram_at = {g: i for i, g in enumerate(model.grams)}
        self.forget()

    def forget(self) -> None:
        self.known = {w: i for i, w in enumerate(self.m.words)}
        self.new: list[np.ndarray] = []

    def row(self, word: str) -> int:
        at = self.known.get(word)
        if at is None:
            self.new.append(self.backoff(word))
            at = self.known[word] = len(self.m.words) + len(self.new) - 1
        return at

    def backoff(self, word: str) -> np.ndarray:
        marked = f"<{word}>"
        for size in range(min(self.m.params.longest, len(marked)), 1, -1):
            at = [k for i in range(len(marked) - size + 1) if (k := self.gram_at.get(marked[i : i + size])) is not None]
            if at:
                row = self.m.gram_rows[at].sum(0)
                return row - row.max()
        return np.zeros(len(self.m.langs), np.float32)

    def __call__(self, texts: list) -> tuple[list[str], np.ndarray]:
        p, n = self.m.params, len(self.m.langs)
        if len(self.new) > p.cache:
            self.forget()
        lang, sure = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        at: list[int] = []
        parts: list[tuple[int, int, int]] = []
        for i, text in enumerate(texts):
            words = words_of(text) if n and isinstance(text, str) else []
            if words and any(map(str.isalpha, words)):
                parts.append((i, len(at), len(words)))
                at += map(self.row, words)
        if parts:
            rows = np.concatenate([self.m.word_rows, np.array(self.new, np.float32).reshape(-1, n)])[np.array(at)]
            total = np.add.reduceat(rows, [first for _, first, _ in parts], axis=0, dtype=np.float64)
            size = np.array([k for _, _, k in parts], float)
            z = total / size[:, None] * np.minimum(size, p.evidence)[:, None]
            z = np.exp(z - z.max(1, keepdims=True))
            best = z.argmax(1)
            share = z[np.arange(len(best)), best] / z.sum(1)
            for (i, _, _), b, s in zip(parts, best, share, strict=True):
                lang[i], sure[i] = self.m.langs[b], s
        return lang, sure


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (0 to 1) for every row.

    A null text, an empty one and one without a letter give ``und`` with score 0; so does a model without languages.
    Ties go to the first language in the alphabet. Whole texts are read, repeated rows each, other columns never.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            lang, sure = scorer(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": lang, "score": sure})
        del scorer
        hand_back()

    return docs.select("doc_id", "text").mapInPandas(score, "doc_id long, lang_pred string, score double")


def keep_recognised(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of ``least`` or more, all columns as they are; every
    row if the model knows no language."""
    if not model.langs:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            lang, sure = scorer(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(lang, sure, strict=True)], pa.bool_()))
        del scorer
        hand_back()

    return docs.mapInArrow(kept, docs.schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold_of(F.col("doc_id")) != 0))
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return predict(docs, model).select("doc_id", held_out, "lang_pred", "score")
