import hashlib
import itertools
import random
import re
import zlib

import pytest
from oracle import compare
from pyspark.sql import functions as F

from terraspan.llm import conversation_repair as R

DIR = "/root/testdata/sf0.01"


def all_audits(rows):
    """Least (cost, audit) by trying every sequence of edits, with at most three insertions in a row."""

    def legal(roles):
        return re.fullmatch("s?(ua)*u?", roles) is not None

    states = {"": (0, "")}

    def insert(states):
        for _ in range(3):
            for roles, (c, a) in list(states.items()):
                for x in "ua":
                    if legal(roles + x):
                        key = roles + x
                        states[key] = min(states.get(key, (10**9, "")), (c + 5, a + "I"))
        return states

    for initial, fault in rows:
        initial = initial or "?"  # a row without a role cannot be kept
        new, states = {}, insert(states)
        for roles, (c, a) in states.items():
            more = 5 * (fault == "truncated")
            moves = [(roles, c + 2, a + "D")]
            if fault not in ("blank", "duplicate"):
                moves += [(roles + initial, c + more, a + "K")] + [(roles + x, c + 1 + more, a + "R") for x in "ua"]
            for key, cost, audit in moves:
                if legal(key):
                    new[key] = min(new.get(key, (10**9, "")), (cost, audit))
        states = new
    states = insert(states)
    return min(v + (k,) for k, v in states.items() if re.fullmatch("(s?(ua)+)?", k))


@pytest.mark.parametrize("n", range(5))
def test_solver(n):
    rng = random.Random(n)
    symbols = [("s", None), ("u", None), ("a", None), ("t", None), ("u", "truncated"), ("a", "truncated"), ("s", "truncated"), ("", "truncated"), ("u", "blank")]
    tried = list(itertools.product(symbols, repeat=n)) if n < 4 else [tuple(rng.choices(symbols, k=rng.randint(4, 7))) for _ in range(300)]
    for rows in tried:
        signature = "".join("x" if f == "blank" else (i if i in ("s", "u", "a") else "o").upper() if f else (i if i in ("s", "u", "a") else "o") for i, f in rows)
        assert R.solve(signature) == all_audits(rows)[:2], rows


def test_long_signature():
    """Halves and memory give what one piece gives, and depth stays small."""
    rng = random.Random(3)
    long = "".join(rng.choices("suaotSUAx", k=20_000)).replace("t", "o")
    cost, audit = R.solve(long)
    assert len(audit.replace("I", "")) == len(long)
    total = sum({"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and s.isupper()) for e, s in zip(audit.replace("I", ""), long, strict=True)) + 5 * audit.count("I")
    assert total == cost
    assert R.solve("ua" * 50_000) == (0, "K" * 100_000)


def fault_of(seen, role, text):
    body = re.sub(r"[\x20\x09-\x0d]", "", text)
    fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
    seen.add((role, text))
    return fault


def brute(conversations):
    by = {}
    for conv, turn, role, text in conversations:
        rows = by.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        r = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if r == 0:
            continue
        text = "" if r == 1 else re.sub("[.!?]", "", text) if r == 2 else text
        rows += [(turn, "user" if r == 4 else role, text)] * (1 + (r == 3))
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()))
        turns = {t for t, _, _ in rows if t is not None}
        seen, faults = set(), []
        for _, role, text in rows:
            faults.append(fault_of(seen, role, text))
        cost, audit, roles = all_audits([(role[:1], f) for (_, role, _), f in zip(rows, faults, strict=True)])
        given, todo = [], iter(rows)
        for e in audit:
            row = next(todo) if e != "I" else None
            if e == "D":
                continue
            name = {"u": "user", "a": "assistant"}.get(roles[len(given)])
            given.append(f"{row[1]}:{row[2]}" if e == "K" else f"{name}:{row[2] if row else ''}")
        initials = [r[:1] for _, r, _ in rows]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(given).encode()).hexdigest(),
        )
    return out


def odd_rows(seed):
    rng = random.Random(seed)
    text = lambda: rng.choice(["Yes.", "No!", "Why? ", "open", "", " \n", None, "é.", "a.\t", "x" * 50_000 + "."])
    role = lambda: rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
    rows = [(c, rng.choice([None, *range(9)]), role(), text()) for c in range(60) for _ in range(rng.randint(1, 8))]
    return rows + [(None, k, role(), text()) for k in range(5)] + [(c, k, ["user", "assistant"][k % 2], f"{k}.") for c in range(100, 140) for k in range(6)] + [(200, 3, "user", "a.")] * 3


@pytest.mark.parametrize("seed", range(2))
def test_brute_force(spark, tmp_path, seed):
    rows = odd_rows(seed)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"audit": F.lit(1), "copy": F.lit("z")}).write.parquet(f"{tmp_path}/conversations.parquet")
    found = R.op12_conversation_repair(spark, str(tmp_path)).collect()
    got = {r.conv_id: tuple(r)[1:] for r in found}
    assert len(got) == len(found)
    assert got == brute(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Well."), (2, 0, "system", "Be."), (2, 1, "assistant", "Yes."), (3, 0, "user", "open"), (3, 1, "user", None)]
    got = {}
    for r in R.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert got == {1: [("K", "user", "Hi."), ("R", "assistant", "Well.")], 2: [("R", "user", "Be."), ("K", "assistant", "Yes.")]}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert R.op12_conversation_repair(spark, str(tmp_path)).count() == 0


def test_sql(spark):
    compare(spark, DIR, R.op12_conversation_repair, R.ORACLE["op12_conversation_repair"])
