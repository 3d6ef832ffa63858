import random
import re

import pytest
from oracle import compare
from pyspark.sql import functions as F

from terraspan.llm import decontaminate as D

DIR = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words_of(t)
        n = min(len(w), D.SIZE)
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= ids - {None}
        out.append((d, len(w), len(hit), sorted(map(str, found))))
    return out


@pytest.mark.parametrize("most", [D.BLOCK, 1500])
def test_brute_force(spark, most, monkeypatch):
    docs, items = [], []
    for seed in range(3 if most == D.BLOCK else 1):
        rng = random.Random(seed)
        word = lambda: rng.choice(["a", "Bc", "é", "x9", "日本", "dd", "e" * 40])  # noqa: B023, E731
        text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", ".\u0001", "-"]) for _ in range(n))  # noqa: B023, E731
        items = [(k, text(rng.choice([1, 3, 9, 10, 11, 25]))) for k in range(30)] + [(7, text(12)), (None, text(10)), (90, None), (91, " .,"), (92, "É É")]
        items += [(k, items[0][1]) for k in range(100, 140)]
        some = lambda: rng.choice([t for _, t in items if t])  # noqa: B023, E731
        docs = [(k, text(rng.randint(0, 60)) + (some() if rng.random() < 0.6 else "") + "!" + text(rng.randint(0, 9))) for k in range(40)]
        docs += [(None, some()), (None, items[3][1]), (None, items[3][1]), (5, None), (6, ""), (7, "ééé"), (8, "z" * 3_000_000 + " " + some()), (9, items[6][1])]
        monkeypatch.setattr(D, "PIECE", 1 << 20 if seed else 64)
        a = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_words": F.lit("x"), "spans": F.lit(1), "row": F.lit(2), "key": F.lit(None)})
        found = D.matches(a, spark.createDataFrame(items, "item_id long, text string"), most=most)
        got = [(r.row.doc_id, r.n_words, r.n_hit, r["items"], [(s["first"], s["last"]) for s in r.spans]) for r in found.collect()]
        order = lambda x: (str(x[0]), x[1:4])
        want = brute(docs, items)
        assert sorted((x[:4] for x in got), key=order) == sorted(want, key=order)
        assert all(sum(b - a for a, b in x[4]) == x[2] for x in got)


def test_spans_go(spark):
    passage = "one two Three four five six seven eight nine ten"
    docs = [(1, f"Früh, {passage}. Ende"), (2, passage), (3, "nothing here"), (4, None), (5, f"{passage} eleven; again: one two three four five six seven eight nine TEN")]
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("x"))
    b = spark.createDataFrame([(1, passage.upper())], "item_id long, text string")
    got = {r.doc_id: r.text for r in D.decontaminate(a, b).collect()}
    assert got == {1: "Früh, . Ende", 2: "", 3: "nothing here", 4: None, 5: " eleven; again: "}
    assert D.decontaminate(a, b).columns == a.columns
    assert sorted(r.doc_id for r in D.decontaminate(a, b, whole=True).collect()) == [3, 4]
    assert sorted(r.doc_id for r in D.decontaminate(a, b, whole=True, least=11).collect()) == [1, 2, 3, 4]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(docs, none).first()[1:] == (2, 0, [], [])
    assert D.matches(docs.limit(0), none).count() == 0


def test_keys_that_meet(monkeypatch):
    """Different windows of equal hash lead to another seed."""
    tried, real = [], D.Cutter.words

    def words(self, data, cuts):
        s, e, h = real(self, data, cuts)
        tried.append(1)
        return s, e, h * 0 if len(tried) == 1 else h

    monkeypatch.setattr(D.Cutter, "words", words)
    block = D.block_of([("a b c", ["1"]), ("d e f", ["2"])])
    assert block.seed == 1 and len(tried) == 2 and len(block.sizes[3][0]) == 2


def test_sql(spark):
    compare(spark, DIR, D.op11_decontaminate, D.ORACLE["op11_decontaminate"])
