"""Sampled segmentations into word pieces, without replacement, and decoding.

A text's segmentations form a lattice. A segmentation has the probability that its pieces' scores give it; the scores
are those of the vocabulary file turned into log-probabilities by the rank of a piece (Zipf's law), since the file
ranks its pieces. The k segmentations of largest Gumbel-perturbed log-probability are a sample without replacement.
They are found by A-star search from the top: a node is a set of segmentations with a common beginning, its bound the
largest perturbed value inside, which is drawn exactly given that of the node above, and whose best segmentation
carries the same value. So the search never steps back: it takes the node with the largest bound, completes it, and
leaves the untaken branches of the path behind as new nodes.

No piece of the vocabulary reaches over the start of a word, so the lattice is a chain of words. Each distinct word's
lattice is built once and kept for the batches that follow, up to a bound, beyond which the words used most stay. All
words of a batch's rows take their steps together, as arrays, for the first samples of all rows and then for all second
ones, and so on. The vocabulary's sign for a space is spelled in bytes where a text itself holds it.
Random numbers are a hash of the seed, the row's key, the sample and the place, so a row's samples do not depend on
the rows beside it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from terraspan.llm.common import hand_back, table

SPACE = "▁"
UNIT = re.compile(" *[^ ]+| +")
AT_ONCE = 1 << 16  # characters of new words whose lattices are built together
SIGN = 0x110000  # stands for the sign for a space in a text: no character, so no piece


@dataclass(frozen=True)
class Params:
    samples: int = 2  # distinct segmentations of a row, or all where there are fewer
    seed: int = 9
    offset: float = 100.0  # log p(piece) = -sharpness * log(rank + offset), up to a constant
    sharpness: float = 3.0
    batch_chars: int = 500_000  # characters of the rows that go together; a longer text goes alone
    places: int = 1_000_000  # characters of words whose lattices are kept; beyond that those used most stay, in half of it


# ---- the vocabulary --------------------------------------------------------------------------------------------------


class Vocabulary:
    """Pieces as a trie over characters, in arrays; characters without a piece fall back to their bytes."""

    def __init__(self, path: str, params: Params):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.bytes_at = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        plain = [i for i in range(self.size) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        pieces = [(model.id_to_piece(i), i) for i in plain]
        score = np.array([model.get_score(i) for i in plain])
        rank = np.empty(len(plain))
        rank[np.argsort(-score, kind="stable")] = np.arange(len(plain))
        logp = -params.sharpness * np.log(rank + params.offset)
        self.logp = np.full(self.size, -params.sharpness * np.log(len(plain) + params.offset))
        self.logp[plain] = logp - np.log(np.exp(logp).sum())
        self.text = [b""] * self.size
        for i, b in enumerate(self.bytes_at):
            self.text[b] = bytes([i])
        for s, i in pieces:
            self.text[i] = s.replace(SPACE, " ").encode()
        nodes: dict[tuple[int, str], int] = {}
        ends = [-1]
        for s, i in pieces:
            node = 0
            for c in s:
                if (node, c) not in nodes:
                    nodes[node, c] = len(ends)
                    ends.append(-1)
                node = nodes[node, c]
            ends[node] = i
        self.ends = np.array(ends)
        self.top = np.full(SIGN + 1, -1, np.int32)  # children of the root
        for (n, c), child in nodes.items():
            if n == 0:
                self.top[ord(c)] = child
        # Children by open addressing: a table at least four times as long as the trie, so that a miss mostly ends at once.
        keys = np.array([(n << 21) | ord(c) for n, c in nodes], np.int64)
        self.mask = (1 << int(np.ceil(np.log2(4 * len(keys) + 16)))) - 1
        self.keys, self.next = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int64)
        left, values, slot, self.probes = keys, np.array(list(nodes.values())), self.slot(keys), 0
        while len(left):
            self.probes += 1
            free = np.flatnonzero(self.keys[slot] < 0)
            _, chosen = np.unique(slot[free], return_index=True)
            put = free[chosen]
            self.keys[slot[put]], self.next[slot[put]] = left[put], values[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, values, slot = left[rest], values[rest], (slot[rest] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64) & self.mask

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes below, -1 where there is none."""
        key = (node << 21) | char
        slot = self.slot(key)
        out = np.full(len(key), -1, np.int64)
        at = np.arange(len(key))
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == key
            out[at[hit]] = self.next[slot[hit]]
            more = (there >= 0) & ~hit
            if not more.any():
                break
            at, key, slot = at[more], key[more], (slot[more] + 1) & self.mask
        return out


# ---- lattices of words -----------------------------------------------------------------------------------------------


class _Numbers(dict):
    """Numbers of words in the order in which they are first asked for; ``new`` holds those without a lattice yet. Words go
    without the space that each begins with."""

    def __init__(self, words: list[str] | None = None) -> None:
        super().__init__(zip(words or [], range(len(words or [])), strict=True))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class _Growing:
    """An array that grows at its end."""

    def __init__(self, kind: type, *first):
        self.data, self.n = np.empty(1 << 18, kind), 0
        self.extend(np.array(first, kind))

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            grown = np.empty(2 * (self.n + len(more)), self.data.dtype)  # what is never written takes no memory
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as size says."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class Lattices:
    """Lattices of distinct words. A place is a character of a word; its edges are the pieces that start there, each
    with the probability of being the next piece of a random segmentation of what follows. An edge's piece is -1 - n
    where it is the n-th character found that is no piece and is spelled in bytes."""

    KINDS = {"left": np.int32, "length": np.int32, "piece": np.int32, "logp": np.float64, "others": np.float64, "upto": np.float64}

    def __init__(self, vocabulary: Vocabulary, most: int = Params.places):
        self.most = most
        self.vocabulary, self.number = vocabulary, _Numbers()
        self.kept = {"first": _Growing(np.int64, 0), "edges": _Growing(np.int64, 0)} | {x: _Growing(kind) for x, kind in self.KINDS.items()}
        self.uses = np.zeros(0, np.int64)
        self.spelled: dict[int, int] = {}  # characters by their numbers
        self.bytes = np.zeros((0, 4), np.int32)  # ids of the bytes of each
        self.size = np.zeros(0, np.int64)  # number of bytes

    def shed(self) -> None:
        """Where there are more places than ``most``, keep the words used most, of those used more than once, in half of it."""
        if self.places <= self.most:
            return
        first, edges = (self.kept[x].data[: self.kept[x].n] for x in ("first", "edges"))
        size = np.diff(first)
        order = np.argsort(-self.uses, kind="stable")
        order = order[self.uses[order] > 1]
        stay = np.sort(order[np.cumsum(size[order]) <= self.most // 2])
        words = list(self.number)
        self.number, self.uses = _Numbers([words[k] for k in stay.tolist()]), self.uses[stay] >> 1
        at = ranges(first[stay], size[stay])
        edge = ranges(edges[first[stay]], edges[first[stay + 1]] - edges[first[stay]])
        new = {"first": np.append(0, np.cumsum(size[stay])), "edges": np.append(0, np.cumsum(edges[at + 1] - edges[at])), "left": self.kept["left"].data[at]}
        new |= {x: self.kept[x].data[edge] for x in self.KINDS if x != "left"}
        for name, x in new.items():
            self.kept[name].n = 0
            self.kept[name].extend(x)

    def words(self, text: str) -> np.ndarray:
        """Numbers of the words of a text; ``grow`` before they are used."""
        if not text:
            return np.zeros(0, np.int64)
        words = [w[1:] for w in UNIT.findall(" " + text)] if text[0] == " " or "  " in text else text.split(" ")
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def grow(self, words: list[np.ndarray] | None = None) -> None:
        """Build what is new; count the uses of the words."""
        part, n = [], 0
        for word in self.number.new:
            part.append(word)
            n += len(word) + 1
            if n >= AT_ONCE:
                self._build(part)
                part, n = [], 0
        if part:
            self._build(part)
        self.number.new = []
        self.uses = np.append(self.uses, np.zeros(len(self.number) - len(self.uses), np.int64))
        if words:
            self.uses += np.bincount(np.concatenate(words), minlength=len(self.uses))
        for name, x in self.kept.items():
            setattr(self, name, x.data)

    @property
    def places(self) -> int:
        return self.kept["left"].n

    def _spell(self, chars: np.ndarray) -> np.ndarray:
        """Numbers of characters that are no piece."""
        found, which = np.unique(chars, return_inverse=True)
        for c in found.tolist():
            if c not in self.spelled:
                raw = (SPACE if c == SIGN else chr(c)).encode("utf-8", "surrogatepass")
                self.spelled[c] = len(self.spelled)
                row = np.zeros((1, 4), np.int32)
                row[0, : len(raw)] = self.vocabulary.bytes_at[list(raw)]
                self.bytes, self.size = np.append(self.bytes, row, axis=0), np.append(self.size, len(raw))
        return np.array([self.spelled[c] for c in found.tolist()], np.int64)[which]

    def _build(self, words: list[str]) -> None:
        vocabulary, base, base_edge = self.vocabulary, self.places, self.kept["piece"].n
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(size)
        chars = np.frombuffer((" " + " ".join(words)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        chars[chars == ord(SPACE)] = SIGN
        chars[chars == ord(" ")] = ord(SPACE)
        n = len(chars)
        left = np.repeat(ends, size) - np.arange(n)  # characters to the word's end
        many = np.ones(n, np.int64)  # the first edge is the piece of one character, or its bytes
        node = vocabulary.top[chars].astype(np.int64)
        single = vocabulary.ends[node]
        single[node < 0] = -1
        alone = np.flatnonzero(single < 0)
        single[alone] = -1 - self._spell(chars[alone])
        longer, k = [], 1
        at = np.flatnonzero((node >= 0) & (left > 1))
        node = node[at]
        while len(at):
            node = vocabulary.step(node, chars[at + k])
            live = node >= 0
            at, node = at[live], node[live]
            k += 1
            piece = vocabulary.ends[node]
            done = piece >= 0
            begins = at[done]
            longer.append((begins, k, piece[done], many[begins]))
            many[begins] += 1
            more = left[at] > k
            at, node = at[more], node[more]
        heads = np.cumsum(many) - many
        e = int(many.sum())  # edges by place, then by length
        length, piece = np.ones(e, np.int64), np.empty(e, np.int64)
        piece[heads] = single
        for begins, k, pieces, rank in longer:
            to = heads[begins] + rank
            length[to], piece[to] = k, pieces
        score = vocabulary.logp[piece]
        score[heads[alone]] = self.size[-1 - single[alone]] * vocabulary.logp[vocabulary.bytes_at[0]]
        # Log of the sum over all segmentations of what follows a place, from the words' ends backwards, all words together.
        to_end = left if left.max() + 1 >= 1 << 16 else left.astype(np.uint16)  # short keys are sorted in linear time
        places = np.argsort(to_end, kind="stable")
        count = many[places]
        by_left = ranges(heads[places], count)
        begin = np.cumsum(count) - count
        cuts = np.searchsorted(to_end[places], np.arange(1, left.max() + 2).astype(to_end.dtype))
        owner = np.repeat(places, count)
        after = owner + length[by_left]
        after[length[by_left] == left[owner]] = n
        ahead, p = score[by_left], np.empty(e)
        total = np.zeros(n + 1)
        sums = np.empty(n)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            x, z = int(begin[a]), int(begin[b]) if b < n else e
            own, heads_here = ahead[x:z], begin[a:b] - x
            own += total[after[x:z]]
            most = np.maximum.reduceat(own, heads_here)
            np.exp(own - np.repeat(most, count[a:b]), out=p[x:z])
            sums[a:b] = np.add.reduceat(p[x:z], heads_here)
            total[places[a:b]] = most + np.log(sums[a:b])
        best = np.flatnonzero(p == 1.0)  # the likeliest of its place; one for each comes first, since most draws end there
        best = best[np.append(True, np.diff(owner[best]) != 0)]
        p /= np.repeat(sums, count)
        ahead -= total[owner]
        chance, logp = np.empty(e), np.empty(e)
        chance[by_left], logp[by_left] = p, ahead
        best, head = by_left[best], heads[owner[best]]
        p = chance
        for x in (length, piece, logp, p):
            x[head], x[best] = x[best], x[head]
        others = 1.0 - p  # no number near 1 is taken from 1: a place's largest comes first
        rest = p.copy()
        rest[heads] = 0
        others[heads] = np.add.reduceat(rest, heads)
        upto, k = p, 1  # sums within a place
        more = np.flatnonzero(many > 1)
        while len(more):
            to = heads[more] + k
            upto[to] += upto[to - 1]
            k += 1
            more = more[many[more] > k]
        upto[heads + many - 1] = 2.0
        with np.errstate(divide="ignore"):
            others = np.log(others)
        new = {"first": ends + base, "left": left, "edges": np.append(heads[1:], e) + base_edge, "length": length, "piece": piece, "logp": logp, "others": others, "upto": upto}
        for name, x in new.items():
            self.kept[name].extend(x)

    def draw(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each place, at random by u."""
        edge = self.edges[place]
        more = np.flatnonzero(self.upto[edge] <= u)
        while len(more):
            edge[more] += 1
            more = more[self.upto[edge[more]] <= u[more]]
        return edge


MASK = (1 << 64) - 1


def seed_of(*parts: int) -> int:
    h = 0x243F6A8885A308D3
    for p in parts:
        h = ((h ^ (p & MASK)) * 0x9E3779B97F4A7C15) & MASK
        h ^= h >> 31
    return h


def uniform(seed: int | np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from a hash of the seed and the place."""
    h = at.astype(np.uint64)
    h += np.asarray(seed, np.uint64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    h >>= np.uint64(11)
    u = h.astype(np.float64)
    u += 0.5
    u *= 1.0 / (1 << 53)
    return u


def one_uniform(seed: int, at: int = 0) -> float:
    h = ((at + seed) * 0x9E3779B97F4A7C15) & MASK
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return min((((h ^ (h >> 31)) >> 11) + 0.5) / (1 << 53), 1 - 0.5**53)


# ---- the search, for one batch of rows -------------------------------------------------------------------------------


@dataclass
class Paths:
    """One more segmentation of each of some rows. The steps are those after the one at which the path left another, or
    all: only there do other paths leave this one."""

    edges: dict[int, np.ndarray]
    logp: dict[int, float]
    value: dict[int, float]  # perturbed log-probability
    steps: dict[int, tuple]  # log-probabilities before the steps, Gumbel values of what else begins so, steps up to each word's end, first word


def gumbel(mean: float, u: float) -> float:
    return mean - math.log(-math.log(u))


def below(bound: float, value: float) -> float:
    """A Gumbel value of some location, moved to where it is on condition of being under ``bound``; the larger the value
    was, the larger it stays."""
    return min(bound, value) - math.log1p(math.exp(-abs(bound - value)))


class Sampler:
    """The search for a batch of rows: ``words`` are the numbers of each row's words, ``keys`` the rows' keys."""

    def __init__(self, lattices: Lattices, words: list[np.ndarray], keys: list[int], params: Params):
        self.l, self.words, self.keys, self.params = lattices, words, keys, params

    def seed(self, row: int, tag: int) -> int:
        return seed_of(self.params.seed, self.keys[row], tag)

    def ahead(self, word: np.ndarray, index: np.ndarray, place: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of random segmentations from places of words to the words' ends, and the number of edges of each."""
        live, here, steps = np.arange(len(word)), place, []
        count = np.zeros(len(word), np.int64)
        seed = seed + ((index << 24) - self.l.first[word]).astype(np.uint64)
        while len(live):
            edge = self.l.draw(here, uniform(seed, here))
            steps.append((live, edge))
            length = self.l.length[edge]
            more = np.flatnonzero(self.l.left[here] > length)
            count[live] += 1
            live, here, seed = live[more], here[more] + length[more], seed[more]
        out, begin = np.zeros(count.sum(), np.int64), np.cumsum(count) - count
        for k, (live, edge) in enumerate(steps):
            out[begin[live] + k] = edge
        return out, count

    def completed(self, rows: list[int], heads: list[np.ndarray], before: list[float], since: list[tuple[int, int | None]], tag: int, values: list[float]) -> Paths:
        """Paths of the rows: heads (edges, whose log-probability is ``before``), then drawn steps from word ``since`` on,
        there from a place inside it or from its start."""
        each = [self.words[r][w:] for r, (w, _) in zip(rows, since, strict=True)]
        size = np.array([len(x) for x in each], np.int64)
        word = np.concatenate(each)
        begin = np.cumsum(size) - size
        index = ranges(np.array([w for w, _ in since], np.int64), size)
        place = self.l.first[word]
        for b, (_, inside) in zip(begin.tolist(), since, strict=True):
            if inside is not None:
                place[b] = inside
        edges, count = self.ahead(word, index, place, np.repeat(np.array([self.seed(r, tag) for r in rows], np.uint64), size))
        cuts = np.append(0, np.cumsum(count))
        a, z = cuts[begin], cuts[begin + size]
        run, past, spans = self.l.logp[edges], np.empty(len(edges)), list(zip(a.tolist(), z.tolist(), strict=True))
        out = Paths({}, {}, {}, {})
        for r, x, (i, j) in zip(rows, before, spans, strict=True):
            out.logp[r] = x
            if i < j:
                past[i], run[i] = x, run[i] + x
                np.cumsum(run[i:j], out=run[i:j])
                past[i + 1 : j] = run[i : j - 1]
                out.logp[r] = float(run[j - 1])
        other = self.l.others[edges]
        other += past
        # Places are counted from the path's beginning.
        u = uniform(np.repeat(np.array([self.seed(r, (2 << 40) + tag) for r in rows], np.uint64), z - a), ranges(np.array([len(x) for x in heads], np.int64), z - a))
        for f in (np.log, np.negative, np.log):
            f(u, out=u)
        other -= u
        for r, head, b, n, (i, j), (w, _), value in zip(rows, heads, begin.tolist(), size.tolist(), spans, since, values, strict=True):
            out.edges[r], out.value[r] = np.concatenate([head, edges[i:j]]) if len(head) else edges[i:j], value
            out.steps[r] = past[i:j], other[i:j], cuts[b + 1 : b + n + 1] - i, w
        return out

    def search(self) -> tuple[list[Paths], list[float]]:
        """The segmentations of largest perturbed log-probability, in order, and for each row the largest value left
        out. Every row has a word at least."""
        rows, l = list(range(len(self.words))), self.l
        values = [gumbel(0.0, one_uniform(self.seed(r, 1 << 40))) for r in rows]
        nothing = np.zeros(0, np.int64)
        found = [self.completed(rows, [nothing] * len(rows), [0.0] * len(rows), [(0, None)] * len(rows), 0, values)] if rows else []
        used: dict[tuple[int, int, int], list[int]] = {}
        # What else begins as a path does before a step, by its bound; of those that were never taken, the path's best only.
        waiting: list[list[tuple[float, int, int, bool]]] = [[] for _ in rows]

        def offer(r: int, k: int) -> None:
            other = found[k].steps[r][1]
            at = int(other.argmax()) if len(other) else 0
            if len(other) and other[at] > -np.inf:
                heappush(waiting[r], (-below(found[k].value[r], float(other[at])), k, at, True))

        edge_ends = l.edges[: l.places + 1]
        while True:
            for r in rows:
                offer(r, len(found) - 1)
            if len(found) >= self.params.samples or not rows:
                return found, [-x[0][0] if x else -np.inf for x in waiting]
            tag, rows = len(found), [r for r in rows if waiting[r]]
            heads, before, since, values = [], [], [], []
            for r in rows:
                top, k, at, fresh = heappop(waiting[r])
                path, top = found[k], -top
                past, other, words, word = path.steps[r]
                if fresh:
                    other[at] = -np.inf
                    offer(r, k)
                own = path.edges[r]
                step = len(own) - len(other) + at
                edge = int(own[step])
                place = int(np.searchsorted(edge_ends, edge, "right")) - 1
                first, last = int(edge_ends[place]), int(edge_ends[place + 1])
                taken = used.setdefault((r, k, at), [edge])
                options = [e for e in range(first, last) if e not in taken]
                chances = [math.exp(x) for x in l.logp[first:last].tolist()]
                weight = sum(chances[e - first] for e in options) * one_uniform(self.seed(r, (3 << 40) + tag), step)
                pick, *_ = [e for e in options if (weight := weight - chances[e - first]) < 0] or options[-1:]
                taken.append(pick)
                rest = sum(chances[e - first] for e in options if e != pick)
                if rest > 0:
                    value = gumbel(float(past[at]) + math.log(rest), one_uniform(self.seed(r, (4 << 40) + tag), step))
                    heappush(waiting[r], (-below(top, value), k, at, False))
                word += int(np.searchsorted(words, at, "right"))
                heads.append(np.append(own[:step], pick))
                before.append(float(past[at]) + float(l.logp[pick]))
                whole = l.left[place] == l.length[pick]
                since.append((word + 1, None) if whole else (word, place + int(l.length[pick])))
                values.append(top)
            found.append(self.completed(rows, heads, before, since, tag, values) if rows else Paths({}, {}, {}, {}))


def ids_of(lattices: Lattices, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that the edges stand for, and how many ids lie before each edge and before the end."""
    piece = lattices.piece[edges]
    odd = np.flatnonzero(piece < 0)
    if not len(odd):
        return piece, np.arange(len(piece) + 1)
    char = -1 - piece[odd]
    size = np.ones(len(piece), np.int64)
    size[odd] = lattices.size[char]
    before = np.append(0, np.cumsum(size))
    ids = np.repeat(piece, size)
    for k in range(4):
        spelled = np.flatnonzero(lattices.size[char] > k)
        ids[before[odd[spelled]] + k] = lattices.bytes[char[spelled], k]
    return ids, before


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of a segmentation, without the space that encoding puts before it."""
    return b"".join([vocabulary.text[i] for i in ids.tolist()])[1:].decode("utf-8", "surrogatepass")


# ---- the operator ----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def lattices_of(model_path: str, params: Params) -> Lattices:
    """Those of one worker process: what one task has built serves the next one there."""
    return Lattices(Vocabulary(model_path, params), params.places)


SAMPLES = "id long, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, decoded boolean"


def sample(docs: DataFrame, model_path: str, params: Params = Params(), with_ids: bool = True) -> DataFrame:
    """Up to ``params.samples`` distinct segmentations of each text (doc_id, text), in falling order of ``perturbed``.

    ids: the pieces (null unless with_ids); log_prob: log-probability; log_inclusion: log of the probability that a
    sample of this size holds the segmentation, given the largest perturbed value left out (0 if none is left);
    decoded: whether the ids decode to the text. A null text has no row; an empty one has the one empty segmentation.
    A text with fewer segmentations than asked for has as many rows. Repeated rows are sampled alike; so are rows without
    an id that have one text (their key counts as -1), and they stay without an id. Perturbed values are drawn from a
    continuum; should two tie, the path found first comes first. Other columns are not read; whole texts are segmented.
    """

    def rows_of(lattices: Lattices, keys: list[int | None], texts: list[str]) -> pa.RecordBatch:
        words = [lattices.words(t) for t in texts]
        lattices.grow(words)
        some = [i for i, w in enumerate(words) if len(w)]
        none = [i for i, w in enumerate(words) if not len(w)]
        found, limits = Sampler(lattices, [words[i] for i in some], [-1 if keys[i] is None else keys[i] for i in some], params).search()
        raw = [(" " + texts[i]).encode("utf-8", "surrogatepass") for i in some]
        key, number, decoded = [keys[i] for i in none], [0] * len(none), [True] * len(none)
        logp, value, limit = [0.0] * len(none), [0.0] * len(none), [-np.inf] * len(none)
        ids, sizes, text = [np.zeros(0, np.int32)], [np.zeros(len(none), np.int64)], lattices.vocabulary.text
        for k, paths in enumerate(found):
            rows = list(paths.edges)
            if not rows:
                break
            own, before = ids_of(lattices, np.concatenate([paths.edges[r] for r in rows]))
            cuts = before[np.append(0, np.cumsum([len(paths.edges[r]) for r in rows]))]
            ids.append(own)
            sizes.append(np.diff(cuts))
            spelled = list(map(text.__getitem__, own.tolist()))
            decoded += [b"".join(spelled[a:z]) == raw[r] for r, a, z in zip(rows, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            key += [keys[some[r]] for r in rows]
            number += [k] * len(rows)
            logp += [paths.logp[r] for r in rows]
            value += [paths.value[r] for r in rows]
            limit += [limits[r] for r in rows]
        over = np.array(logp) - np.array(limit)
        chance = -np.expm1(-np.exp(np.minimum(over, 700)))
        with np.errstate(divide="ignore"):
            inclusion = np.where(chance > 0, np.log(chance), over)
        if with_ids:
            pieces = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(sizes))), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
        else:
            pieces = pa.nulls(len(key), pa.list_(pa.int32()))
        columns = [pa.array(key, pa.int64()), pa.array(number, pa.int32()), pieces, *(pa.array(x, pa.float64()) for x in (logp, value, inclusion)), pa.array(decoded, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["id", "sample", "ids", "log_prob", "perturbed", "log_inclusion", "decoded"])

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(model_path, params)
        for batch in batches:
            keys, texts, n = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if text is None:
                    continue
                keys.append(key)
                texts.append(text)
                n += len(text)
                if n >= params.batch_chars:
                    lattices.shed()
                    yield rows_of(lattices, keys, texts)
                    keys, texts, n = [], [], 0
            if keys:
                lattices.shed()
                yield rows_of(lattices, keys, texts)
        hand_back()

    picked = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return picked.mapInArrow(sampled, SAMPLES).withColumnRenamed("id", "doc_id")


@F.arrow_udf(LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """crc32 of a row's ids as little-endian unsigned 32-bit integers."""
    flat, cuts = ids.values.to_numpy().astype("<u4"), ids.offsets.to_pylist()
    return pa.array([zlib.crc32(flat[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64())


def op9_piece_sampling(spark, sf_dir: str) -> DataFrame:
    """Digest of the segmentations that :func:`sample` returns, over all documents; a null text counts as empty."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = sample(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), ids_crc32("ids").alias("ids_crc32"), "log_prob", "perturbed", "log_inclusion", "decoded")
