import hashlib
import random
import zlib

import pytest
from oracle import compare
from pyspark.sql import functions as F

from terraspan.llm import prefix_trie as T

DIR = "/root/testdata/sf0.01"


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in by.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(c - 20 * int(c / 20)), [])[:h] + ts[h:])
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = []
    for v, convs in members.items():
        below = [w for w in members if w[: len(v)] == v]
        leaves = [w for w in below if not any(len(x) == len(w) + 1 and x[: len(w)] == w for x in members)]
        ended = sorted(c for c in convs if built[c] == v)
        out.append((
            min(convs), len(v), min(members[v[:-1]]) if v else None, len(convs), sum(len(w) == len(v) + 1 for w in below), len(leaves),
            sum((len(members[w]) - 1) * len(w[-1][1].split()) for w in below if w), hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rows_of(seed):
    rng = random.Random(seed)
    text = lambda: rng.choice(["a b", "c", "d e f", "", None, "a\tb", "  "])
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 4]) if seed else k, rng.choice(["user", "assistant", None]), text()) for c in range(-30, 90) if c % 7 for k in range(rng.randint(1, 6))]
    rows += [(c, k, "user", "same turn") for c in range(200, 260) for k in range(3)]
    rows += [(c, k, "user", f"t {k}") for c in range(301, 340) for k in range(c - 300)]  # snapshots of one that grows
    return rows + [(None, 1, "user", "nobody"), (500, 1, "system", "x y"), (500, 1, "system", "x y"), (10**17, 0, "user", "far")]


@pytest.mark.parametrize("seed", range(2))
def test_brute_force(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 7)
    rows = rows_of(seed)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"node": F.lit(1), "depth": F.lit("z")}).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in T.op13_prefix_trie(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


def test_intervals(spark):
    """Positions run from 1 without gaps, and subtrees are nested intervals that begin with their top."""
    turns = T.turns_of(spark.createDataFrame(rows_of(0), "conv_id long, turn long, role string, text string"))
    nodes = T.trie(T.prefixes(T.headed(turns, F.lit(0), 0))).orderBy("position").collect()
    assert [n.position for n in nodes] == list(range(1, len(nodes) + 1))
    open_ = []
    for n in nodes:
        while open_ and open_[-1].last < n.position:
            open_.pop()
        assert len(open_) == n.depth and n.last >= n.position and (not open_ or n.last <= open_[-1].last)
        open_.append(n)


def test_empty(spark, tmp_path):
    spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert T.op13_prefix_trie(spark, str(tmp_path)).count() == 0


def test_sql(spark):
    compare(spark, DIR, T.op13_prefix_trie, T.ORACLE["op13_prefix_trie"])
