import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from terraspan.llm import packing, piece_sampling, token_files, tokens
from terraspan.llm.common import table

DIR = "/root/testdata/sf0.01"
WORD, BYTE, PIECE = (P.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "", " ", "  a  b \n\n c\t d ", "a \x1c b  c　 d\x85 e", "\n\n a", "it's  we'll\n x", "a b  ", "a<|endoftext|>b <|endoftext|> c", "Σας ΣΑΣ. ÀÉ, don't. it'S.",
    "x.. y,, z., 1. 2, 3.5", "İ, TARİHİ, 1923 BELEDİYESİ.", "a\n\n\nb\n\n c\n", "a\n \n b \nc", "\x00 a \x00b", "é É. ﬁ Ǆ ², ½ x² 日本語。 🙂🙂 é,", "Word,word. Word , .",
]


def fuzzed(n: int) -> list[str]:
    """Texts of words, signs and white space with code points that case, composition or the classes treat in ways of their own."""
    rng = random.Random(12)
    special = [chr(c) for c in range(0x3000) if len(chr(c).lower()) > 1 or chr(c).lower() != chr(c).casefold() or not unicodedata.is_normalized("NFC", chr(c))]
    pools = [special, list("abcXYZ"), list("0123456789²½"), list(".,;:!?'\"-–…«»&%$"), list("  \n\t\u00a0\u2003\x1c\x85"), ["\u0301", "\u0307", "\u0327", "İ", "ß", "ŉ", "ǅ", "σ", "Σ", "ﬁ", "가", "日", "🙂", "'s", "'LL", "<|endoftext|>", "<|startoftext|>"], [chr(c) for c in range(0xA0, 0x250)]]
    return ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("special_as_text", [False, True])
@pytest.mark.parametrize("kind, path", [(tokens.WordEncoder, WORD), (tokens.ByteEncoder, BYTE)])
def test_ids_are_the_librarys(spark, kind, path, special_as_text):
    texts = ODD + fuzzed(4000) + [r.text for r in table(spark, DIR, "documents").limit(300).collect()]
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = special_as_text
    encoder = kind(path, cache=3000, special_as_text=special_as_text)  # so that it forgets now and then
    for text, got, want in zip(texts, encoder.encode_all(texts), whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == want.ids, text
    assert encoder.encode_all([None]) == [b""]


@pytest.mark.parametrize("seed", range(4))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    words = [rng.integers(0, 40, rng.integers(1, 6)) for _ in range(12)]
    docs = [np.concatenate([*(words[k] for k in rng.integers(0, 12, rng.integers(0, 200))), [2]]).astype(np.uint16) for _ in range(30)] + [np.array([2], np.uint16), np.full(500, 7, np.uint16)]
    params = token_files.Params(least=3, rules=20)
    block = token_files.Block(token_files.write_block(list(range(len(docs))), docs, 60_000, params))
    assert len(block.rules) and len(block.symbols) < sum(map(len, docs))
    assert block.tokens().tolist() == np.concatenate(docs).tolist()
    assert block.bounds().tolist() == np.append(0, np.cumsum([len(d) for d in docs])).tolist()
    for i, d in enumerate(docs):
        assert block.document(i).tolist() == d.tolist()
        a = int(rng.integers(0, len(d)))
        b = int(rng.integers(a + 1, len(d) + 1))
        assert block.stretch(i, a, b).tolist() == d[a:b].tolist()
    with pytest.raises(ValueError):
        data = bytearray(token_files.write_block([1], [docs[0]], 60_000))
        data[-1] ^= 1
        token_files.Block(bytes(data))


def test_files_keep_rows_without_ids_and_repeated_rows(spark):
    rows = [(None, "a b", "x"), (-1, "c", "x"), (None, None, "x"), (5, "a b", "x"), (5, "a b", "x"), (0, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = token_files.read_documents(token_files.write_blocks(df, WORD)).orderBy("start").collect()
    library = Tokenizer.from_file(WORD)
    ids = lambda t: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
    want = [(None, ""), (None, "a b"), (-1, "c"), (0, ""), (5, "a b"), (5, "a b")]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(ids(t)), zlib.crc32(ids(t))) for i, t in want]
    assert [r.start for r in got] == np.cumsum([0, *(len(ids(t)) for _, t in want)])[:-1].tolist()


def test_samples_of_rows_without_ids(spark):
    df = spark.createDataFrame([(None, "hello there"), (None, "hello there"), (-1, "hello there")], "doc_id long, text string")
    got = piece_sampling.sample(df, PIECE).collect()
    assert sorted(str(r.doc_id) for r in got) == ["-1"] * 2 + ["None"] * 4 and len({tuple(r.ids) for r in got}) == 2


def some(spark, extra=()):
    rows = [(r.doc_id, r.text, r.source) for r in table(spark, DIR, "documents").limit(120).collect()]
    rows += [(100_000, None, None), (100_001, "", "src0"), (100_002, "a b", None), (100_003, "word " * 9000, "src1"), *extra]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("source", "source").repartition(5)


def ids_of(rows, path, end):
    library = Tokenizer.from_file(path)
    return {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4") for i, t, _ in rows}


def test_token_files(spark):
    rows, df = some(spark)
    want = ids_of(rows, WORD, 2)
    blocks = token_files.write_blocks(df, WORD, params=token_files.Params(block_tokens=20_000))
    got = sorted(token_files.read_documents(blocks).collect())
    start = 0
    for r, key in zip(got, sorted(want), strict=True):
        assert tuple(r) == (key, start, len(want[key]), zlib.crc32(want[key]))
        start += r.n_tokens
    assert token_files.read_documents(token_files.write_blocks(df.limit(0), WORD)).count() == 0


@pytest.mark.parametrize("mixture", [None, {"src1": 0.5}])
def test_packing(spark, mixture):
    rows, df = some(spark)
    want = ids_of(rows, BYTE, 0)
    params = packing.Params(window=4, queues=6)
    got = packing.pack(df, BYTE, params, mixture).toPandas()
    for r in got.itertuples():
        own = want[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length])
    for i, g in got.sort_values("start").groupby("doc_id"):
        assert (g.start == g.length.cumsum() - g.length).all() and g.length.sum() == len(want[i])
    sizes = []
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all()
        sizes.append(g.length.sum())
    assert set(got.doc_id) == set(want) and max(sizes) <= 1024 and all(s & (s - 1) == 0 for s in sizes)
    by = got.groupby(["window_id", "queue"]).length.sum().unstack(fill_value=0)
    totals = by.sum()
    if mixture is None:  # every window holds the corpus' own shares, to a token
        assert ((by - totals / len(by)).abs() < 1.001).all().all()
    else:
        assert by.iloc[0].max() / by.iloc[0].sum() == pytest.approx(0.5, abs=0.01)
    assert packing.pack(df.limit(0), BYTE).count() == 0


def test_packing_is_the_plain_deficit_loop(spark):
    """Counters that grow by a quantum in every window, one token at a time, clashing columns and repeated rows included."""
    from fractions import Fraction

    rng = random.Random(9)
    rows = [(i, " ".join(["word"] * rng.randint(0, 40)) if i % 9 else None, rng.choice(["b", "a", None, "c", "a"]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, queue int").coalesce(1)
    params = packing.Params(length=16, window=4)
    sizes = {s: sum(r[2] == s for r in rows) for s in {r[2] for r in rows}}
    order = sorted(sizes, key=lambda s: (-sizes[s], s is not None, s or ""))
    encoder = tokens.ByteEncoder(BYTE)
    queues = [[(i, k) for i, t, s, _ in rows if s == q for k in range(len(encoder.encode_all([t])[0]) // 2 + 1)] for q in order]
    total = sum(map(len, queues))
    windows = -(-total // (params.length * params.window))
    quanta, counters, placed = [Fraction(len(q), windows) for q in queues], [Fraction(0)] * len(queues), []
    for _ in range(windows):
        for q, quantum in enumerate(quanta):
            counters[q] += quantum
            take = int(counters[q])
            counters[q] -= take
            placed += queues[q][:take]
            del queues[q][:take]
    assert len(placed) == total and not any(queues)
    ends = [params.length] * (total // params.length) + [1 << b for b in reversed(range(params.length)) if total % params.length >> b & 1]
    want, at = {}, 0
    for sequence, size in enumerate(ends):
        want |= {token: (sequence, offset) for offset, token in enumerate(placed[at : at + size])}
        at += size
    got = {(r.doc_id, r.start + k): (r.sequence_id, r.offset + k) for r in packing.pack(df, BYTE, params).collect() for k in range(r.length)}
    assert got == want
    again = packing.pack(df.unionByName(df.limit(5)), BYTE, params)
    assert again.agg({"length": "sum"}).first()[0] == total + sum(len(encoder.encode_all([t])[0]) // 2 + 1 for _, t, _, _ in rows[:5])


def shared_queue(spark, mixture):
    rows = [(i, " ".join(["word"] * (5 + i % 7)), "big") for i in range(300)]
    rows += [(1000 + 100 * k + i, " ".join(["word"] * (4 + i % 5)), f"tail{k}" if k else None) for k in range(4) for i in range(80)]
    rows += [(2000 + i, "word word", f"single{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(3)
    return packing.pack(df, BYTE, packing.Params(length=16, window=8, queues=1), mixture).toPandas(), {r[0]: r[2] for r in rows}


def test_packing_keeps_shares_in_the_shared_queue(spark):
    got, source = shared_queue(spark, None)
    assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all() and set(got.doc_id) == set(source)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all()
    got["source"] = got.doc_id.map(source).fillna("none")
    tail = got[got.queue == 1]
    by = tail.groupby(["window_id", "source"]).length.sum().unstack(fill_value=0)
    part = by.sum(axis=1).cumsum() / by.sum().sum()
    for s in ("none", "tail1", "tail2", "tail3"):
        assert (by[s].cumsum() - part * by[s].sum()).abs().max() < 30  # about a document or two of 9 to 17 tokens
    singles = by[[c for c in by if c.startswith("single")]].sum(axis=1)
    assert (singles.cumsum() - part * singles.sum()).abs().max() < 40


def test_packing_honours_a_mixture_beyond_the_largest_sources(spark):
    got, source = shared_queue(spark, {"big": 0.5, "tail2": 0.3, "absent": 0.1})
    assert set(got.doc_id) == set(source)
    first = got[got.window_id == 0]
    shares = first.groupby(first.doc_id.map(source).fillna("none")).length.sum() / first.length.sum()
    assert shares["tail2"] == pytest.approx(0.3 / 0.9, abs=0.02)  # the absent source's queue is dry from the start
    assert first[first.doc_id.map(source) == "tail2"].queue.nunique() == 1 and got[got.doc_id.map(source) == "tail2"].queue.iloc[0] == 1


def test_samples(spark):
    texts = [None, "", " ", "Hello  world\nfoo é 日本 \t x", "  lead", "🙂".encode("utf-16", "surrogatepass").decode("utf-16") + " a", "word " * 5000, "ab"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, sample int")
    got = piece_sampling.sample(df, PIECE, piece_sampling.Params(samples=3)).collect()
    vocabulary = piece_sampling.Vocabulary(PIECE, piece_sampling.Params())
    assert {r.doc_id for r in got} == set(range(1, len(texts)))
    for i in range(1, len(texts)):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r["sample"])
        assert len({tuple(r.ids) for r in own}) == len(own) and [r.perturbed for r in own] == sorted((r.perturbed for r in own), reverse=True)
        assert all(r.decoded and piece_sampling.decode(np.array(r.ids, int), vocabulary) == texts[i] and r.log_inclusion <= 0 for r in own)
    again = piece_sampling.sample(df.repartition(3), PIECE, piece_sampling.Params(samples=3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))  # seeded by key, whatever the partitions


def test_samples_follow_the_distribution():
    import collections
    import itertools

    params = piece_sampling.Params(samples=2)
    lattices = piece_sampling.Lattices(piece_sampling.Vocabulary(PIECE, params))
    two = lattices.words("then ab")
    lattices.grow()

    def all_of(place, end):
        if place == end:
            yield (), 0.0
            return
        for e in range(lattices.edges[place], lattices.edges[place + 1]):
            for rest, x in all_of(place + lattices.length[e], end):
                yield (e, *rest), lattices.logp[e] + x

    words = [list(all_of(lattices.first[k], lattices.first[k + 1])) for k in (0, 1)]
    p = {a + b: np.exp(x + y) for (a, x), (b, y) in itertools.product(*words)}
    assert sum(p.values()) == pytest.approx(1)
    n, first, second = 4000, collections.Counter(), collections.Counter()
    paths, _ = piece_sampling.Sampler(lattices, [two] * n, list(range(n)), params).search()
    for key in range(n):
        first[tuple(paths[0].edges[key])] += 1
        second[tuple(paths[1].edges[key])] += 1
    q = {b: sum(p[a] * p[b] / (1 - p[a]) for a in p if a != b) for b in p}
    assert sum(abs(first[k] / n - p[k]) for k in p) / 2 < 0.02 and sum(abs(second[k] / n - q[k]) for k in p) / 2 < 0.02
    every, left = piece_sampling.Sampler(lattices, [two], [1], piece_sampling.Params(samples=10**6)).search()
    assert {tuple(x.edges[0]) for x in every if x.edges} == set(p) and left == [-np.inf]
    values = [x.value[0] for x in every if x.edges]
    assert values == sorted(values, reverse=True)


def test_samples_of_a_row_do_not_depend_on_other_rows(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, DIR, "documents").where("text is not null").limit(60).collect()]
    params = piece_sampling.Params(samples=4)
    vocabulary = piece_sampling.Vocabulary(PIECE, params)

    def found(chosen):
        lattices = piece_sampling.Lattices(vocabulary)
        words = [lattices.words(t) for _, t in chosen]
        lattices.grow()
        some = [k for k, w in enumerate(words) if len(w)]
        paths, left = piece_sampling.Sampler(lattices, [words[k] for k in some], [chosen[k][0] for k in some], params).search()
        return {chosen[k][0]: [(x.logp[j], x.value[j], lattices.length[x.edges[j]].tolist()) for x in paths if j in x.edges] + [left[j]] for j, k in enumerate(some)}

    alone = {}
    for row in rows:
        alone |= found([row])
    assert found(rows) == alone == found(rows[::-1])


def test_query_digests_what_the_operator_returns(spark, tmp_path):
    texts = [None, "", "hello there", "a ▁ sign▁▁ of  spaces ", "word " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r["sample"]): r for r in piece_sampling.op9_piece_sampling(spark, str(tmp_path)).collect()}
    assert sorted(got) == [(0, 0), (1, 0), *((i, k) for i in (2, 3, 4) for k in (0, 1))]  # a null text is an empty one
    vocabulary = piece_sampling.Vocabulary(PIECE, piece_sampling.Params())
    for r in piece_sampling.sample(docs.where("doc_id > 0"), PIECE).collect():
        ids, own = np.array(r.ids, "<u4"), got.pop((r.doc_id, r["sample"]))
        assert (own.n_pieces, own.ids_crc32, own.log_prob, own.perturbed) == (len(ids), zlib.crc32(ids), r.log_prob, r.perturbed)
        assert own.decoded and piece_sampling.decode(ids, vocabulary) == texts[r.doc_id]
    assert [(r.n_pieces, r.ids_crc32, r.decoded) for r in got.values()] == [(0, 0, True)]


def test_words_used_most_keep_their_lattices():
    params = piece_sampling.Params(samples=3)
    vocabulary = piece_sampling.Vocabulary(PIECE, params)
    texts = [f"the common words and 日 {k:04}unlikely{k} then the common words" for k in range(60)]
    built = []

    def found(lattices, key):
        words = [lattices.words(texts[key])]
        built.extend(lattices.number.new)
        lattices.grow(words)
        paths, left = piece_sampling.Sampler(lattices, words, [key], params).search()
        return [(piece_sampling.ids_of(lattices, p.edges[0])[0].tolist(), p.logp[0], p.value[0]) for p in paths], left

    alone = [found(piece_sampling.Lattices(vocabulary), k) for k in range(60)]
    built.clear()
    few = piece_sampling.Lattices(vocabulary, 120)
    for k in range(60):
        few.shed()
        assert few.places <= 120
        assert found(few, k) == alone[k]
    assert len(built) == 60 + 6  # no word that recurs is built anew


@pytest.mark.parametrize("size", [65_534, 65_535, 65_536])
def test_samples_of_words_of_about_65536_characters(size):
    params = piece_sampling.Params()
    lattices = piece_sampling.Lattices(piece_sampling.Vocabulary(PIECE, params))
    text = "ab" * (size // 2) + "c" * (size % 2)
    words = [lattices.words(text)]
    lattices.grow(words)
    edges = lattices.edges[: lattices.places + 1]
    assert np.add.reduceat(np.exp(lattices.logp[: edges[-1]]), edges[:-1]) == pytest.approx(np.ones(lattices.places))
    paths, _ = piece_sampling.Sampler(lattices, words, [1], params).search()
    assert [piece_sampling.decode(piece_sampling.ids_of(lattices, p.edges[0])[0], lattices.vocabulary) for p in paths] == [text] * 2
