import os
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest

from terraspan.llm import jaccard_join as J
from terraspan.llm import vector_dedup as V
from terraspan.llm.components import components


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(500, k) for k in range(300, 340)] + [(7, 7), (None, 3)]
    sets = Sets()
    for a, b in edges:
        if a is not None and a != b:
            sets.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for x in sets.up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def corpus(seed):
    """Copies, near copies of varying closeness, a passage that unlike texts share, chains, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    passage, out = [word() for _ in range(40)], []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([8, 30, 80]))]
        out += [" ".join(base)] * rng.randint(1, 3)
        for _ in range(rng.randint(0, 9)):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = word()
            out.append("\t".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
            base = copy if rng.random() < 0.4 else base
    out += [" ".join([*passage, *(word() for _ in range(rng.randint(1, 60)))]) for _ in range(25)]
    out += [None, "", " \n", "a", "a", "a b c d", "A b  c d", "a b c d e", "é É", "É é"]
    rng.shuffle(out)
    return out


def few_passages(seed):
    """Texts made of the same few passages, so that many unlike sets share their prefixes and groups hold several classes."""
    rng = random.Random(seed)
    passage = lambda n: ["".join(rng.choices("abcdefgh", k=4)) for _ in range(n)]
    parts = [passage(rng.choice([6, 12, 25])) for _ in range(7)]
    heads = [passage(rng.choice([5, 9, 20])) for _ in range(4)]
    out = []
    for _ in range(150):
        words = list(rng.choice(heads))
        for part in rng.sample(parts, rng.randint(1, 4)):
            words += part[: rng.choice([len(part), len(part) - rng.randint(0, 4)])]
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = "other"
        out.append(" ".join(words))
    return out


def test_overlaps():
    rng = np.random.default_rng(5)
    for top in (30, 3000):
        sets = [np.unique(rng.integers(0, top, rng.integers(0, 200))).astype(np.uint64) for _ in range(70)]
        want = [[len(np.intersect1d(a, b)) for b in sets[40:]] for a in sets[:40]]
        assert J.overlaps(sets[:40], sets[40:]).tolist() == want


@pytest.mark.parametrize("seed, crowded, pairs, tile, make", [(1, 32, 16, 1 << 17, corpus), (3, 1, 4, 300, corpus), (5, 4, 1, 700, few_passages)])
def test_join_against_brute_force(spark, seed, crowded, pairs, tile, make):
    texts = make(seed)
    own, links = [shingles(t) for t in texts], Sets()
    for a in range(len(own)):
        links.find(a)
        for b in range(a):
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                links.join(a, b)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n long").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df, J.Params(crowded=crowded, frequent=3, pairs=pairs, tile=tile)).collect()}
    assert got == {i: (len(s), links.find(i)) for i, s in enumerate(own)}


def test_join_of_classes_in_crowded_lists(spark):
    """Groups of two unlike classes, whose first ones are of another component or at another distance than the others."""
    rng = random.Random(4)
    passage = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    head, tail, x1, x2 = passage(60), passage(20), passage(60), passage(60)
    texts = {i: [*head, *tail, *x1, f"own{i}"] for i in range(40)}
    texts |= {100: [*head, *tail, *x1], 200: [*head, *tail, *x2], 101: ["z", *head, *tail, *x1], 201: ["z", *head, *tail, *x2], 300: [*head, *tail, *x2, "own"]}
    texts |= {1000 + i: [*tail[-4:], *(x1, x2)[i % 2], *passage(100)] for i in range(140)}  # so that x1 and x2 come last in the order
    own, links = {i: shingles(" ".join(t)) for i, t in texts.items()}, Sets()
    for a in own:
        links.find(a)
        for b in own:
            if a < b and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                links.join(a, b)
    assert [links.find(i) for i in (100, 101, 200, 201, 300)] == [0, 0, 200, 200, 200]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in J.near_duplicates(df).collect()} == {i: links.find(i) for i in own}


@pytest.mark.parametrize("both", [False, True])
def test_join_of_classes_far_from_the_first_one(spark, both):
    """Two classes of one group, the first of which is near the list's first group and the second far from it."""
    rng = random.Random(14)
    passage = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    r, c1, c2 = passage(124), passage(320), passage(320)
    texts = {i: [*r, *c1[: 280 + i]] for i in range(1, 41)} | {50: [*r, *c1[:280]], 51: [*r, *c2[:280]], 52: [*r, *c2[:270]]}
    texts |= {1000 + i: [*r[-4:], *(c1, c2)[i % 2]] for i in range(200)}
    if both:
        texts[45] = [*r, *c1[:270]]
    own, links = {i: shingles(" ".join(t)) for i, t in texts.items()}, Sets()
    for a in own:
        links.find(a)
        for b in own:
            if a < b and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                links.join(a, b)
    assert links.find(52) == links.find(51) == 51
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in J.near_duplicates(df).collect()} == {i: links.find(i) for i in own}


def test_rows_without_an_id_of_their_own(spark):
    base = [f"w{i}" for i in range(40)]
    one, near, other, third = " ".join(base), " ".join([*base, "x"]), " ".join(f"v{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    rows = [(5, one, "a"), (5, one, "a"), (9, one, "b"), (None, near, "c"), (None, other, "d"), (None, other, "d"), (7, third, "e"), (7, "unlike text", "f"), (8, None, "g"), (8, None, "g"), (None, None, "h"), (11, "alone", "i"), (12, near, "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = J.keep_one(df)
    assert got.columns == df.columns
    want = [(5, one, "a"), (None, other, "d"), (7, third, "e"), (7, "unlike text", "f"), (8, None, "g"), (None, None, "h"), (11, "alone", "i")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("seed, nulls, ids", [(2, 0.0, 40), (6, 0.2, 60), (8, 1.0, 1)])
def test_rows_that_share_an_id_are_linked_each(spark, seed, nulls, ids):
    rng = random.Random(seed)
    rows = [(None if rng.random() < nulls else rng.randrange(ids), t) for t in [*few_passages(seed)[:90], None, "", "few words", "few words"]]
    own, links = [shingles(t or "") for _, t in rows], Sets()
    for a in range(len(rows)):
        links.find(a)
        for b in range(a):
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                links.join(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[links.find(i)] = min(doc_id, least.get(links.find(i), doc_id))
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, own int").repartition(3)
    got = J.near_duplicates(df, J.Params(frequent=3))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = [(d, len(s), least.get(links.find(i))) for i, ((d, _), s) in enumerate(zip(rows, own, strict=True))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_texts_under_one_id_keep_their_links(spark):
    a, v = " ".join(f"a{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(1, a), (1, v), (3, f"{v} more")], "doc_id int, text string")
    assert sorted(tuple(r) for r in J.near_duplicates(df).collect()) == [(1, 26, 1), (1, 26, 1), (3, 27, 1)]


def test_join_with_tiles_in_rounds(spark):
    texts = few_passages(9)
    own, links = [shingles(t) for t in texts], Sets()
    for a in range(len(own)):
        links.find(a)
        for b in range(a):
            if 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                links.join(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in J.near_duplicates(df, J.Params(crowded=4, frequent=3, pairs=1, tile=700, sent=100_000)).collect()}
    assert got == {i: links.find(i) for i in range(len(own))}


def written(spark):
    """Bytes of shuffle files so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_lists_of_one_passage_are_compared_once(spark):
    """The shingles of a passage that many unlike texts share have a list of the same texts each."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    passage = [word() for _ in range(180)]
    texts = [[*passage, *(word() for _ in range(32))] for _ in range(200)]
    texts += [[*t[:-3], word()] for t in texts[:150:10]]
    own, links = [shingles(" ".join(t)) for t in texts], Sets()
    for a in range(len(own)):
        links.find(a)
        for b in range(a):
            if 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                links.join(a, b)
    assert len({links.find(i) for i in range(len(own))}) == 200
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    before = written(spark)
    got = {r.doc_id: r.component_id for r in J.near_duplicates(df, J.Params(tile=8000)).collect()}
    assert got == {i: links.find(i) for i in range(len(own))}
    assert written(spark) - before < 20e6


def kept(spark):
    """Folders of staged tables, and shuffles with files."""
    root = Path(spark.conf.get("spark.checkpoint.dir"), "terraspan")
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return {*(os.listdir(root) if root.is_dir() else ())}, {*re.findall(r"shuffle_\d+", files)}


@pytest.mark.parametrize("run", [J.near_duplicates, J.keep_one])
@pytest.mark.parametrize("odd", [False, True])
def test_only_the_result_stays_on_disk(spark, run, odd):
    rows = [(k, t) for k, t in enumerate(few_passages(7))] + [(None, "text without an id"), (3, "other text")] * odd
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folders, shuffles = kept(spark)
    out = run(df, J.Params(frequent=3, crowded=4, pairs=1, tile=700))
    for _ in range(50):  # files go a moment after their execution
        now = kept(spark)
        if not now[1] - shuffles:
            break
        time.sleep(0.2)
    assert not now[1] - shuffles
    assert len(now[0] - folders) <= (1 if run is J.near_duplicates or not odd else 3) and out.count() > 0


def test_join_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert J.near_duplicates(df).count() == 0 and J.keep_one(df).columns == df.columns


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = V.units(list(rng.normal(size=(60, 32)))), V.units(list(rng.normal(size=(60, 32))))
    b = V.units(list(b + rng.uniform(0, 3, (60, 1)) * a))
    true, guesses, outside = a @ b.T, [], 0
    for seed in range(60):
        turn = V.rotation(256, seed)
        guess, error = V.estimate(*V.encode(a, turn), b @ turn[:32], 4.0)
        guesses.append(guess)
        outside += (np.abs(guess - true) > error).sum()
    assert np.abs(np.mean(guesses, 0) - true).max() < 0.06 and np.abs(np.mean(guesses, 0) - true).mean() < 0.01
    assert outside / (60 * true.size) < 1e-3


def test_steps_leave_estimates_without_bias():
    """With vectors in steps of four bits as the other side, of odd length and with most of the weight on one component."""
    rng = np.random.default_rng(5)
    a, b = V.units(list(rng.normal(size=(40, 31)))), rng.normal(size=(40, 31))
    b[::4, 0] += 20
    b = V.units(list(b + rng.uniform(0, 3, (40, 1)) * a))
    true, guesses, outside = a @ b.T, [], 0
    for seed in range(80):
        turn = V.rotation(256, seed)
        codes, factors = V.encode(a, turn)
        steps, sizes = V.step_codes(b, rng)
        back = V.unpacked_steps(steps, sizes)[:, :31]
        assert steps.shape == (40, 16) and np.abs(back - b).max() <= sizes.max() * 1.001
        guess = V.decoded(codes, factors, 256) @ turn[:31].T @ back.T
        guesses.append(guess)
        outside += (np.abs(guess - true) > V.spread(factors, 256, 4.0, sizes.max())[:, None]).sum()
    assert np.abs(np.mean(guesses, 0) - true).max() < 0.06 and np.abs(np.mean(guesses, 0) - true).mean() < 0.01
    assert outside / (80 * true.size) < 1e-3


def test_recall_at_the_threshold_with_production_parameters():
    """Pairs with a cosine of 0.90 to 0.92 share a bucket in one of the tables, at any number of vectors."""
    rng, params = np.random.default_rng(7), V.Params()
    x, y = rng.standard_normal((2, 3000, 64))
    x = V.units(list(x))
    y = V.units(list(y - np.einsum("ij,ij->i", x, y)[:, None] * x))
    cos = rng.uniform(0.9, 0.92, (3000, 1))
    y = cos * x + np.sqrt(1 - cos**2) * y
    for n in (1000, 50_000, 10**6):
        axes, tables = V.shape_of(n, 64, params)
        met = (V.table_codes(x, axes, tables, params.seed) == V.table_codes(y, axes, tables, params.seed)).any(1).mean()
        assert met >= 0.985 and tables <= 40


@pytest.mark.parametrize("part", [1024, 8])
def test_vectors_against_brute_force(spark, part):
    rng = np.random.default_rng(2)
    x = [rng.normal(size=24) for _ in range(150)]
    x += [x[k] + rng.normal(size=24) * s for k, s in zip(rng.integers(0, 20, 120), rng.uniform(0.02, 0.6, 120), strict=True)]
    rows = [(i + 10, [float(np.float32(v)) for v in y], 1) for i, y in enumerate(x)]
    rows += [(1, rows[0][1], 0), (2, rows[0][1], 0), (3, None, 0), (4, [], 0), (5, [0.0] * 24, 0), (6, [float("nan")] * 24, 0), (7, [None] * 24, 0), (8, [float("inf")] + [1.0] * 23, 0), (9, [1.0, 2.0], None), (900, [2.0, 4.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, links int")
    got = {r.vec_id: r for r in V.near_duplicates(df, V.Params(part=part, bucket=8, recall=0.999)).collect()}
    good = {i: np.array(np.float32(v), float) for i, v, _ in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    true, n, sets = 0, 0, Sets()
    for a in good:
        near = [b for b in good if b != a and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9]
        true, n = true + len(near), n + got[a].n_links
        assert got[a].n_links <= len(near)
        sets.find(a)
        for b in near:
            sets.join(a, b)
    assert n >= 0.97 * true > 100 and len(got) == len(rows)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (3, 4, 5, 6, 7, 8))
    assert sum(got[i].component_id == sets.find(i) for i in good) >= 0.97 * len(good)
    assert V.near_duplicates(df.limit(0)).count() == 0
