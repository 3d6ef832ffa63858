"""Toxicity by class-conditional Kneser-Ney models.

One interpolated bigram model is fitted on texts labelled toxic and one on ordinary texts, on continuation counts, so
that copies of a text add nothing. Absolute discounting takes from a count a constant and what the other class leads to
expect of it; what is left is the class's own, and the freed mass backs off, from pairs to words and from words to the
counts that both classes share. So an expression that is rare, or alike in both, is smoothed to the same value in both.

A text's score compares its log-likelihoods under the two models, normalised by its number of words; a logistic curve
set by labelled rows that the counts have not seen turns the difference into a number from 0 to 1, and the same rows
choose the constant of the discount.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.llm.common import bounded_rows, checked_broadcast, counts_by, fold_of, hand_back, letter_words, staged, table, words_of


@dataclass(frozen=True)
class Params:
    sample_docs: int = 4000  # labelled rows of each class that the model is fitted on, about
    discounts: tuple[float, ...] = (1.0, 2.0, 4.0, 8.0, 16.0)  # constants to choose from
    alike: float = 3.0  # times the count that the other class leads to expect, which the discount takes too
    even: float = 0.1  # part of the shared backoff that goes to all words alike
    by: int = 4  # labelled rows of this remainder choose the discount and fit the curve, the others the counts


@dataclass(frozen=True)
class Model:
    """Log ratios, toxic to ordinary, relative to that of a word which neither class has of its own. Words, histories
    and pairs that are not listed have 0."""

    words: list[str]
    word_gain: np.ndarray  # p(w)
    history_gain: np.ndarray  # backoff weight of a history
    pair_keys: np.ndarray  # sorted: history * (number of words) + word
    pair_gain: np.ndarray  # p(w | v)
    slope: float = 1.0
    shift: float = 0.0


@dataclass(frozen=True)
class _Totals:
    n: dict[int, float]  # continuation counts of a class
    kinds: float  # distinct words
    common: float  # sum of the smaller ones of each word's relative frequencies


def _shared(c1, c0, t: _Totals, params: Params, least):
    """Shared backoff of a word, for columns or arrays."""
    return (1 - params.even) * least(c1 / t.n[1], c0 / t.n[0]) / max(t.common, 1e-300) + params.even / (t.kinds + 1)


def _excess(x: int, c1, c0, t: _Totals, discount: float, params: Params, least):
    """What a class has of a word beyond the discount, as a part of all; may be negative."""
    return ((c1 if x else c0) - discount) / t.n[x] - params.alike * least(c1 / t.n[1], c0 / t.n[0])


def _counts(sample: DataFrame, params: Params) -> tuple[pd.DataFrame, pd.DataFrame, _Totals, dict] | None:
    """Counts of the words and of the pairs that a class may have of its own under the smallest discount, and the part
    of each class's words that every discount leaves. A pair counts once for each word before it and a word once for
    each word before it. All else in the sample is counted but has no ratio, so it stays in Spark."""
    w = sample.select("toxic", F.concat(F.array(F.lit("")), letter_words(F.col("text"))).alias("w"))
    triple = F.transform(
        F.sequence(F.lit(1), F.size("w") - 1),
        lambda i: F.struct(F.coalesce(F.get("w", i - 2), F.lit("")).alias("u"), F.col("w")[i - 1].alias("v"), F.col("w")[i].alias("w")),
    )
    triples = w.where(F.size("w") > 1).select("toxic", F.inline(triple)).distinct()
    each = lambda f, c: [f(x).alias(f"{c}{x}") for x in (1, 0)]
    pairs = staged(triples.groupBy("v", "w").agg(*each(lambda x: F.count_if(F.col("toxic") == x), "c")), "pairs")
    single = staged(pairs.groupBy("w").agg(*each(lambda x: F.count_if(F.col(f"c{x}") > 0), "n")), "words")
    sums = single.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count("*").alias("kinds")).first()
    if not sums["n1"] or not sums["n0"]:
        return None
    n = {1: float(sums["n1"]), 0: float(sums["n0"])}
    common = single.agg(F.sum(F.least(F.col("n1") / n[1], F.col("n0") / n[0]))).first()[0]
    t = _Totals(n, float(sums["kinds"]), float(common))
    own = lambda x, d: _excess(x, F.col("n1"), F.col("n0"), t, d, params, F.least)
    taken = single.agg(*[F.sum(F.greatest(own(x, d), F.lit(0.0))).alias(f"{x}_{i}") for x in (1, 0) for i, d in enumerate(params.discounts)]).first().asDict()
    low = min(params.discounts)
    words = single.where((own(1, low) > 0) | (own(0, low) > 0)).toPandas()
    history = pairs.groupBy("v").agg(F.sum("c1").alias("h1"), F.sum("c0").alias("h0"))
    strong = pairs.where(F.greatest("c1", "c0") > low).join(history, "v").join(single, "w")
    most = max(taken[f"{x}_{i}"] for x in (1, 0) for i in range(len(params.discounts)))
    expected = (1 - most) * _shared(F.col("n1"), F.col("n0"), t, params, F.least)  # by the other class, at least
    beyond = [F.col(f"c{x}") - low > params.alike * F.col(f"h{x}") * F.greatest(expected, F.try_divide(f"c{1 - x}", f"h{1 - x}")) for x in (1, 0)]
    return words, strong.where(beyond[0] | beyond[1]).toPandas(), t, taken


def _model(words: pd.DataFrame, pairs: pd.DataFrame, t: _Totals, taken: dict, k: int, params: Params) -> Model:
    """The ratios under the k-th discount."""
    d, least = params.discounts[k], np.minimum
    left = {x: 1 - taken[f"{x}_{k}"] for x in (1, 0)}

    def p(x: int, rows: pd.DataFrame) -> np.ndarray:
        c1, c0 = rows["n1"].to_numpy(float), rows["n0"].to_numpy(float)
        return np.maximum(_excess(x, c1, c0, t, d, params, least), 0) + left[x] * _shared(c1, c0, t, params, least)

    names = sorted({*words["w"], *pairs["v"], *pairs["w"]})
    at = {w: i for i, w in enumerate(names)}
    base = np.log(left[1] / left[0])
    word_gain = np.zeros(len(names) + 1)
    word_gain[words["w"].map(at).to_numpy(int)] = np.log(p(1, words) / p(0, words)) - base
    v, w = pairs["v"].map(at).to_numpy(int), pairs["w"].map(at).to_numpy(int)
    c, h = ({x: pairs[f"{name}{x}"].to_numpy(float) for x in (1, 0)} for name in "ch")
    own, rest = {}, {}
    for x in (1, 0):
        y = 1 - x
        expected = np.maximum(p(y, pairs), np.divide(c[y], h[y], out=np.zeros_like(c[y]), where=h[y] > 0))
        own[x] = np.maximum(c[x] - d - params.alike * h[x] * expected, 0) / np.maximum(h[x], 1)
        rest[x] = 1 - np.bincount(v, own[x], len(names) + 1)
    some = (own[1] > 0) | (own[0] > 0)
    under = {x: own[x] + rest[x][v] * p(x, pairs) for x in (1, 0)}
    keys = v * np.int64(len(names)) + w
    order = np.argsort(keys)[some[np.argsort(keys)]]
    return Model(names, word_gain, np.log(rest[1] / rest[0]), keys[order], (np.log(under[1] / under[0]) - base)[order])


def fit(labelled: DataFrame, params: Params = Params(), share: float | None = None) -> Model | None:
    """Fit on rows with ``doc_id``, ``text`` and ``toxic`` (0 or 1); others are ignored. None if a class has no word.
    The counts are of as many rows of either class, the curve is of all rows of the sample that are set aside for it;
    share is the toxic one's share of all labelled rows, if known. The discount with the fewest expected errors is
    taken, of several the one that puts the fewest rows the wrong way round, then the first."""
    known = labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).where("text is not null and toxic in (0, 1)")
    sample = bounded_rows(known, "toxic", params.sample_docs, seed=6).withColumn("fold", F.coalesce(fold_of(F.col("doc_id")), F.lit(0)))
    sample = staged(sample, "toxicity_sample")
    counted = sample.where(F.col("fold") != params.by)
    of_class = counts_by(counted, "toxic")
    if len(of_class) < 2:
        return None
    found = _counts(bounded_rows(counted, "toxic", params.sample_docs, seed=8, even=True, counts=of_class), params)
    if found is None:
        return None
    models = [_model(*found, k, params) for k in range(len(params.discounts))]
    seen = _ratios(sample.where(F.col("fold") == params.by), models, "toxic").toPandas()
    if seen["toxic"].nunique() < 2:  # too few rows to set some aside
        seen = _ratios(sample, models, "toxic").toPandas()
    share = share if share is not None and 0 < share < 1 else 0.5
    y = seen["toxic"].to_numpy(float)
    ratios = [seen[f"ratio{k}"].to_numpy(float) for k in range(len(models))]
    curves = [_curve(x, y, share) for x in ratios]
    best = min(range(len(models)), key=lambda k: (round(curves[k][2], 9), _mixed(ratios[k], y)))
    return replace(models[best], slope=curves[best][0], shift=curves[best][1])


class _Scorer:
    """Differences of the two log-likelihoods, normalised by the number of words; 0 without words."""

    def __init__(self, model: Model, like: _Scorer | None = None):
        """like: the scorer of another model of the same words, which are then held once."""
        self.m, self.n = model, len(model.words)
        self.at = like.at if like else {w: i for i, w in enumerate(model.words)}
        self.start = self.at.get("", self.n)
        self.keys = np.append(model.pair_keys, np.iinfo(np.int64).max)

    def __call__(self, texts: list) -> np.ndarray:
        ids: list[int] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if isinstance(text, str):
                ids += [self.at.get(w, self.n) for w in words_of(text)]
            ends[i + 1] = len(ids)
        w = np.array(ids, np.int64)
        v = np.append(self.start, w[:-1])[: len(w)]
        begin = ends[:-1][np.diff(ends) > 0]
        v[begin] = self.start
        value = self.m.word_gain[w] + self.m.history_gain[v]
        pair = v * self.n + w
        k = np.searchsorted(self.keys, pair)
        hit = (self.keys[k] == pair) & (v < self.n) & (w < self.n)
        value[hit] = self.m.pair_gain[k[hit]]
        out = np.zeros(len(texts))
        if len(begin):
            out[np.diff(ends) > 0] = np.add.reduceat(value, begin)
        return out / np.maximum(np.diff(ends), 1)


def _ratios(docs: DataFrame, models: list[Model], *more: str) -> DataFrame:
    """``doc_id``, ``more`` and ``ratio0`` on, one for each model."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = _Scorer(shared.value[0])
        scorers = [first, *[_Scorer(m, first) for m in shared.value[1:]]]
        for batch in batches:
            texts = batch["text"].tolist()
            yield batch[["doc_id", *more]].assign(**{f"ratio{k}": scorer(texts) for k, scorer in enumerate(scorers)})
        del first, scorers
        hand_back()

    extra = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)
    ratios = "".join(f", ratio{k} double" for k in range(len(models)))
    return docs.select("doc_id", "text", *more).mapInPandas(score, f"doc_id long{extra}{ratios}")


def _mixed(x: np.ndarray, y: np.ndarray) -> float:
    """Part of the pairs of a toxic and an ordinary text whose ratios are the wrong way round; half of those that tie."""
    ordinary, toxic = np.sort(x[y == 0]), x[y == 1]
    below = np.searchsorted(ordinary, toxic - 1e-9) + np.searchsorted(ordinary, toxic + 1e-9)
    return float(1 - below.mean() / 2 / len(ordinary)) if len(ordinary) and len(toxic) else 1.0


def _curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float, float]:
    """Slope and shift of the logistic curve, and its expected errors. It crosses 0.5 at the cut with the fewest expected errors when a text is toxic with probability ``share``, in the
    widest gap of such cuts: labels that the words do not bear out then cannot drag the curve along. Its slope comes
    from the spread of the ratios."""
    at = np.unique(np.append(x[x > 1e-9], 0.0))  # a text that is no likelier under the toxic model is never above the cut
    if len(at) < 2:
        return 1.0, float(np.log(share / (1 - share))), 1.0
    cuts = (at[1:] + at[:-1]) / 2
    missed = np.searchsorted(np.sort(x[y == 1]), cuts) / max((y == 1).sum(), 1)
    alarms = 1 - np.searchsorted(np.sort(x[y == 0]), cuts) / max((y == 0).sum(), 1)
    errors = share * missed + (1 - share) * alarms
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    widest = best[np.argmax(np.diff(at)[best])]
    slope = 4 / max(float(x.std()), 1e-9)
    return slope, float(-slope * cuts[widest]), float(errors.min())


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (1 if score >= 0.5) for every row.

    A null or empty text has no words and gets the curve's value at 0. A score of exactly 0.5 counts as toxic. Without a model every score is 0. Whole texts
    are read, repeated rows each, other columns never.
    """
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    z = F.col("ratio0") * F.lit(model.slope) + F.lit(model.shift)
    scored = _ratios(docs, [model]).select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_ordinary(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, all columns as they are; every row without a model."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            ratio = scorer(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array(ratio * model_slope + model_shift < 0))
        del scorer
        hand_back()

    model_slope, model_shift = model.slope, model.shift
    return docs.mapInArrow(kept, docs.schema)


def fit_labels(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model | None:
    """Fit on the rows of ``docs`` that ``labels`` (doc_id, toxic) covers, of remainders 1 to 4 only. ``labels`` is cut
    to a bounded sample of ids before it meets the texts, so that the texts are not moved. Of several labels of one
    document the largest holds."""
    marks = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(fold_of(F.col("doc_id")) != 0)
    share = marks.agg(F.avg("toxic")).first()[0]
    sample = bounded_rows(marks, "toxic", params.sample_docs, seed=7)
    return fit(docs.select("doc_id", "text").join(checked_broadcast(sample, sample.count()), "doc_id"), params, share)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_labels(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return predict(docs, model).select("doc_id", held_out, "score", "predicted")
