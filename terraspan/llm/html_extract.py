"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A leaf block is a run of text between two block-level tags. Its features are the tags of its ancestors, the words of
their classes and ids, properties of its text, and what the section or cell that it stands in holds besides it;
neighbouring labels are tied by transition weights. The weights are
the maximum of the penalised likelihood of labelled pages, and a page is labelled by Viterbi decoding.

The labelled pages are composed here, from a seed: articles of many layouts among menus, notices, adverts, forms and
reader comments, with the label of every block known by construction. Labelled pages of one's own go in as well.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.llm.common import table

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript title svg iframe object canvas audio video select textarea".split())
#: A start tag of the key closes an open element of the values.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: An open element of the values keeps what is outside from being closed.
KEEPS = frozenset("table ul ol dl select body html div section article main aside nav header footer form".split())
SECTIONS = frozenset("article main aside nav header footer section form div".split())
#: Elements whose blocks are looked at together.
HOMES = SECTIONS | {"body", "td", "th"}
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    marks: frozenset[str]  # features of the ancestors
    parent: str
    home: int = 0  # number of the nearest section or cell


class _Blocks(HTMLParser):
    """Leaf blocks in page order. Malformed pages are read as far as they make sense; nothing is refused. A comment or a
    tag that the page leaves open reaches to its end, as in browsers.

    known: features of ancestors that a model has; others are left out, so that deep pages cost no more than flat ones."""

    def __init__(self, known: Container[str] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.known = known
        self.stack: list[tuple[str, frozenset[str], str, int]] = [("", frozenset(), "", 0)]  # tag, marks, nearest block-level tag, home
        self.open: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.held: list[str] = []
        self.linked = self.silent = self.links = self.homes = 0

    def whole(self, html: str) -> list[Block]:
        self.feed(html)
        if re.match(r"<[!/?a-zA-Z]", self.rawdata):
            self.rawdata = ""
        self.close()
        self.flush()
        return self.blocks

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)  # the base class refuses unknown ones

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.blocks.append(Block(text, self.linked, *self.stack[-1][1:]))
        self.held, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag in {"br", "hr"}:
                self.held.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            if any(self.open[t] for t in CLOSES.get(tag, ())):
                for k in range(len(self.stack) - 1, 0, -1):
                    if self.stack[k][0] in CLOSES[tag]:
                        self.pop(k)
                        break
                    if self.stack[k][0] in KEEPS:
                        break
        _, marks, parent, home = self.stack[-1]
        named = {w for k, v in attrs if k in ("class", "id", "role") and v for w in re.split(r"[^a-z]+", v.lower()) if w}
        words = {f"c:{w}" for w in named} | {f"g:{kind}" for w in named for kind in GROUPS.get(w, ())}
        new = {f"t:{tag}", *words} if tag not in INLINE or words else set()
        if tag in SECTIONS and not any(m.startswith("top:") for m in marks):
            new.add(f"top:{tag}")
        if self.known is not None:
            new = {m for m in new if m in self.known}
        if not new <= marks:
            marks = marks | new
        if tag in HOMES:
            self.homes += 1
            home = self.homes
        self.stack.append((tag, marks, parent if tag in INLINE else tag, home))
        self.open[tag] += 1
        self.silent += tag in SILENT
        self.links += tag == "a"

    def pop(self, k: int) -> None:
        for tag, *_ in self.stack[k:]:
            self.open[tag] -= 1
            self.silent -= tag in SILENT
            self.links -= tag == "a"
        del self.stack[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if self.open[tag] <= 0:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self.pop(k)
                break
            if tag in INLINE and self.stack[k][0] not in INLINE:
                break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.held.append(data)
            if self.links:
                self.linked += len(data)


def blocks_of(html: str | None, known: Container[str] | None = None) -> list[Block]:
    return _Blocks(known).whole(html or "")


def features(blocks: list[Block]) -> list[list[str]]:
    sizes = [b.text.count(" ") + 1 for b in blocks]
    ending = [b.text[-1] in ".!?…:;\"'”»" for b in blocks]
    long = [n > 12 and e for n, e in zip(sizes, ending, strict=True)]
    words, prose, linked, chars = (Counter() for _ in range(4))  # by home
    for b, n, is_long in zip(blocks, sizes, long, strict=True):
        words[b.home] += n
        prose[b.home] += is_long
        linked[b.home] += b.linked
        chars[b.home] += len(b.text)
    told = [[kind for kind, cues in CUES.items() if any(w in cues for w in WORD.findall(b.text.lower()))] if n <= 5 else [] for b, n in zip(blocks, sizes, strict=True)]
    under: dict[int, set[str]] = {}
    for b, kinds in zip(blocks, told, strict=True):
        if kinds:
            under.setdefault(b.home, set()).update(kinds)
    most, all_long, before, out = max(words.values(), default=0), sum(long), 0, []
    for b, n, ends, is_long, kinds in zip(blocks, sizes, ending, long, told, strict=True):
        size, home = len(b.text), b.home
        own = [
            "bias", f"own:{b.parent}", f"words:{min(n.bit_length(), 7)}", f"links:{min(int(4 * b.linked / size), 4)}",
            f"ends:{ends}", f"long:{is_long}", f"stops:{min(sum(b.text.count(c) for c in '.,') * 20 // n, 4)}",
            f"home:{min(words[home].bit_length(), 8)}", f"prose:{min(prose[home], 2)}", f"linked:{min(int(4 * linked[home] / chars[home]), 4)}",
            f"largest:{words[home] == most}", f"place:{before > 0}:{before + is_long < all_long}:{is_long}",
        ]
        before += is_long
        if "©" in b.text or "copyright" in b.text.lower():
            own.append("copyright")
        own += [f"cue:{kind}" for kind in kinds] + [f"under:{kind}" for kind in under.get(home, ())]
        out.append([*own, *b.marks])
    return out


# ---- the field -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    names: dict[str, int]
    weights: np.ndarray  # features x labels (0 other, 1 main)
    moves: np.ndarray  # label before x label
    first: np.ndarray

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        known = [[self.names[x] for x in r if x in self.names] for r in rows]
        flat = [x for r in known for x in r]
        return np.add.reduceat(self.weights[flat], np.cumsum([0, *map(len, known[:-1])]), axis=0) if rows else np.zeros((0, 2))

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels. Equal scores go to label 0."""
        score = self.scores(features(blocks)).tolist()
        if not score:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = score[0][0] + self.first[0], score[0][1] + self.first[1]
        back = []
        for x, y in score[1:]:
            back.append((a + m00 < b + m10, a + m01 < b + m11))
            a, b = max(a + m00, b + m10) + x, max(a + m01, b + m11) + y
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def train(pages: Iterable[tuple[list[Block], list[int]]], rounds: int = 300, penalty: float = 0.02, rate: float = 0.1) -> Model:
    """Maximum of the penalised log-likelihood, by Adam over all pages at once; gradients by forward and backward sums.
    Blocks of equal features are summed once, and a step touches only the pages that are long enough."""
    pages = sorted(((features(b), y) for b, y in pages if b), key=lambda x: -len(x[0]))
    names: dict[str, int] = {}
    for rows, _ in pages:
        for r in rows:
            for x in r:
                names.setdefault(x, len(names))
    n, longest = len(pages), max(len(r) for r, _ in pages)
    kinds: dict[tuple[int, ...], int] = {}
    at = [(i, t, kinds.setdefault(tuple(sorted(names[x] for x in r)), len(kinds))) for i, (rows, _) in enumerate(pages) for t, r in enumerate(rows)]
    page, step, kind = np.array(at).T
    where = (page, step)
    many = np.array([len(k) for k in kinds])
    feature, block = np.concatenate([np.array(k) for k in kinds]), np.append(0, np.cumsum(many)[:-1])
    active = np.bincount(step, minlength=longest)  # pages that have a block of this number
    there = np.zeros((n, longest), bool)
    truth = np.zeros((n, longest, 2))
    for i, (rows, y) in enumerate(pages):
        there[i, : len(rows)] = True
        truth[i, np.arange(len(rows)), y] = 1
    moved = np.einsum("itj,itk->jk", truth[:, :-1], truth[:, 1:])
    theta = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)]
    mean, spread = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for turn in range(1, rounds + 1):
        w, m, f = theta
        s = np.zeros((n, longest, 2))
        s[where] = np.add.reduceat(w[feature], block, axis=0)[kind]
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0] + f
        for t in range(1, longest):
            k = active[t]
            alpha[:k, t] = np.logaddexp(alpha[:k, t - 1, 0, None] + m[0], alpha[:k, t - 1, 1, None] + m[1]) + s[:k, t]
        for t in range(longest - 2, -1, -1):
            k = active[t + 1]
            ahead = beta[:k, t + 1] + s[:k, t + 1]
            beta[:k, t] = np.logaddexp(ahead[:, 0, None] + m[:, 0], ahead[:, 1, None] + m[:, 1])
        last = alpha[np.arange(n), there.sum(1) - 1]
        total = np.logaddexp(last[:, 0], last[:, 1])[:, None, None]
        p = np.exp(np.minimum(alpha + beta - total, 0)) * there[:, :, None]
        pair = alpha[:, :-1, :, None] + m + (s + beta)[:, 1:, None, :] - total[..., None]
        expected = (np.exp(np.minimum(pair, 0)) * there[:, 1:, None, None]).sum((0, 1))
        off = np.stack([np.bincount(kind, (truth - p)[where][:, y], len(kinds)) for y in (0, 1)], axis=1)
        g = np.stack([np.bincount(feature, np.repeat(off[:, y], many), len(names)) for y in (0, 1)], axis=1)
        grads = [g - penalty * w, moved - expected - penalty * m, (truth - p)[:, 0].sum(0) - penalty * f]
        for j, d in enumerate(grads):
            mean[j] = 0.9 * mean[j] + 0.1 * d
            spread[j] = 0.999 * spread[j] + 0.001 * d * d
            theta[j] = theta[j] + rate * (mean[j] / (1 - 0.9**turn)) / (np.sqrt(spread[j] / (1 - 0.999**turn)) + 1e-8)
    return Model(names, *theta)


# ---- labelled pages --------------------------------------------------------------------------------------------------

MAIN_WORDS = "content main post entry story article body text page copy prose read detail document single hentry markdown paragraph column primary inhalt artikel contenu contenido".split()
ASIDE_WORDS = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar tabs pagination pager toc links navi menue".split(),
    "header": "header masthead logo brand site banner top hero kopf kopfzeile entete cabecera".split(),
    "footer": "footer foot bottom colophon copyright legal credits imprint fuss fusszeile pied pie".split(),
    "sidebar": "sidebar side aside widget related recommended trending popular tags archive secondary rail more teaser promo seitenleiste lateral".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay paywall warning disclaimer message newsletter subscribe signup hinweis".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promotion banner dfp commercial adslot adbox werbung anzeige publicite publicidad".split(),
    "form": "form search login register contact subscribe signin signup suche".split(),
    "comments": "comment comments reply replies respond disqus discussion reader feedback commentlist thread responses reviews kommentar kommentare commentaires comentarios".split(),
    "share": "share social sharing follow author byline meta tools print teilen".split(),
}
#: The kinds that a name stands for, so that names seen seldom share what is learnt of their kind.
GROUPS = {w: [k for k, ws in {**ASIDE_WORDS, "main": MAIN_WORDS}.items() if w in ws] for w in {*MAIN_WORDS, *(w for ws in ASIDE_WORDS.values() for w in ws)}}
#: Words of short lines that tell what follows.
CUES = {
    "comments": "comments comment replies responses discussion kommentare commentaires comentarios".split(),
    "sidebar": "related recommended trending popular archive".split(),
    "notice": "cookies newsletter subscribe consent".split(),
    "advert": "advertisement sponsored werbung anzeige publicité publicidad".split(),
    "share": "share follow tweet".split(),
    "footer": "imprint impressum datenschutz privacy terms rights".split(),
}
ASIDE_TAGS = {"menu": ["nav", "div", "ul", "section"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "section", "aside", "p"], "advert": ["div", "aside", "section", "ins"], "form": ["form"], "comments": ["section", "div", "ol", "aside"], "share": ["div", "ul"]}


def labelled_pages(n: int = 400, seed: int = 10) -> list[tuple[list[Block], list[int]]]:
    """Composed pages as blocks and labels (1: main text)."""
    rng = random.Random(seed)
    syllables = "an ber chi da en fo gra hel is ka lo mi nu or pa qui re sta ti um ver wa xo zen".split()

    def words(k: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(k))

    def prose(k: int) -> str:
        out = []
        while k > 0:
            size = min(k, rng.randint(1, 18))
            out.append(words(size).capitalize() + rng.choice("...,..?!") )
            k -= size
        return " ".join(out)

    def odd() -> str:
        """Main text is not always prose: lone words, notes of rights, lists of words, repeated lines."""
        one = words(1)
        return rng.choice([one, words(rng.randint(2, 40)), f"{one} " * rng.randint(2, 30), f"Copyright {rng.randint(1990, 2030)} {words(2)}.", f"&copy; {words(3)}", prose(2), " | ".join(words(1) for _ in range(9)), f"{words(1)}@{words(1)}.example {rng.getrandbits(40):x}"])

    def named(options: list[str], sure: float) -> str:
        if rng.random() > sure:
            return ""
        key, picked = rng.choice(["class", "class", "id"]), rng.sample(options, rng.randint(1, min(2, len(options))))
        return f' {key}="{rng.choice([" ", "-", "_"]).join(picked)}"'

    def short() -> str:
        return rng.choice([words(rng.randint(1, 5)), f'<a href="#">{words(rng.randint(1, 4))}</a>', prose(rng.randint(3, 12))])

    def cue(kind: str) -> str:
        return " ".join(rng.sample([rng.choice(CUES[kind]), words(rng.randint(1, 2))], 2)).capitalize()

    def other(kind: str) -> str:
        tag = rng.choice(ASIDE_TAGS[kind])
        bare = rng.random() < 0.15  # without a name, or one never seen: the text and its place tell
        attr = named(ASIDE_WORDS[kind] + ASIDE_WORDS[kind][:2], 1.0 if tag in ("div", "section", "ul", "ol", "p", "ins") else 0.5)
        if bare and kind == "menu":
            attr = ""
        elif bare and kind == "footer":
            line = rng.choice([cue(kind), f"&copy; {words(2)}", f'<a href="/i">{cue(kind)}</a> <a href="/p">{words(1)}</a>'])
            return f"\x01<{tag}>{line}</{tag}>\x02"
        elif bare and kind == "header":
            return f"\x01<{tag}>{words(rng.randint(1, 3))}</{tag}>\x02"
        elif bare and kind in ("comments", "sidebar"):
            told = "".join(f"<p>{prose(rng.randint(3, 40))}</p>" for _ in range(rng.randint(1, 3)))
            return f"\x01<{tag}><h3>{cue(kind)}</h3>{told}</{tag}>\x02"
        if kind == "menu" or (kind in ("sidebar", "share", "footer") and rng.random() < 0.5):
            inner = "".join(f'<li><a href="/x">{words(rng.randint(1, 3))}</a></li>' for _ in range(rng.randint(2, 8)))
            inner = inner if tag in ("ul", "ol") else f"<ul>{inner}</ul>"
            if tag not in ("ul", "ol") and rng.random() < 0.4:
                inner = rng.choice([" ", "<br>", " | "]).join(f'<a href="/x">{words(rng.randint(1, 3))}</a>' for _ in range(rng.randint(1, 6)))
        elif kind == "form":
            inner = f"<label>{words(2)}</label><input><button>{words(1)}</button>" + (f"<p>{prose(8)}</p>" if rng.random() < 0.4 else "")
        elif kind == "comments":
            inner = (f"<h3>{cue(kind) if rng.random() < 0.5 else words(2)}</h3>" if rng.random() < 0.6 else "") + "".join(f"<{t}{named(['comment', 'reply', 'reader'], 0.5)}><p>{prose(rng.randint(3, 60))}</p></{t}>" for t in [rng.choice(["div", "li", "article"])] * rng.randint(1, 5))
        elif kind == "footer":
            inner = rng.choice([f"&copy; {words(3)} &middot; {prose(rng.randint(3, 12))}", f"Copyright {rng.randint(1990, 2030)} {words(rng.randint(1, 3))}", f"<p>{prose(rng.randint(4, 25))}</p>"])
        elif kind == "header" and rng.random() < 0.6:
            title = words(rng.randint(1, 4))
            inner = rng.choice([f"<h1>{title}</h1>", f"<h2>{title}</h2>", f'<h1><a href="/">{title}</a></h1>', f"<h2>{title}</h2><p>{prose(rng.randint(2, 9))}</p>", f'<a href="/"><b>{title}</b></a>'])
        elif kind == "advert":
            inner = rng.choice([prose(rng.randint(3, 20)), f"<p>{prose(rng.randint(3, 20))}</p>", f'<a href="#">{prose(6)}</a>'])
        else:
            inner = rng.choice([short(), words(rng.randint(1, 3)), prose(rng.randint(3, 30)), f"<p>{prose(rng.randint(3, 40))}</p>", f"<h3>{words(3)}</h3><p>{prose(rng.randint(3, 25))}</p>"])
        if tag == "ins":  # block-level inside, so that it never shares a block with the text around it
            inner = f"<div>{inner}</div>"
        return f"\x01<{tag}{attr}>{inner}</{tag}>\x02"

    def main() -> str:
        parts = [f"<h1>{words(rng.randint(2, 9))}</h1>"] if rng.random() < 0.7 else []
        loose, nested = rng.random() < 0.2, rng.random() < 0.1
        for k in range(rng.choice([1, 1, 1, 2, 2, *range(3, 15)])):
            kind = rng.random()
            if loose and (kind < 0.72 or k == 0):  # text right in the container
                parts.append(f"{prose(rng.choice([8, 18, 30, 60]))}{rng.choice(['', '<br>', '<br><br>'])}")
            elif nested and kind < 0.72:
                parts.append(rng.choice(["<div>{}</div>", "<div><p>{}</p></div>", "<section>{}</section>", "<section><p>{}</p></section>"]).format(prose(rng.choice([5, 18, 30, 60]))))
            elif kind < 0.15 and k:
                parts.append(f"<p>{odd()}</p>")
            elif kind < 0.72 or k == 0:
                parts.append(f"<p>{prose(rng.choice([2, 5, 12, 30, 60, 120]))}</p>" if rng.random() < 0.9 else f"<p><b>{prose(9)}<br>")
            elif kind < 0.8:
                parts.append(f"<h2>{words(rng.randint(1, 6))}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{prose(rng.randint(1, 14))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{prose(20)}</p></blockquote>")
            elif kind < 0.93:
                parts.append(f"<table><tr><td>{words(2)}</td><td>{words(1)}</td></tr></table>")
            else:
                parts.append(other(rng.choice(["advert", "advert", "sidebar", "notice", "share", "form", "comments", "menu"])))
        if rng.random() < 0.35:
            parts.append(other("comments"))
        if rng.random() < 0.12:
            return "".join(parts)  # right in the body
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        text = f"<{tag}{named(MAIN_WORDS, 0.6 if tag == 'div' else 0.4)}>{''.join(parts)}</{tag}>"
        if rng.random() < 0.35:
            outer = rng.choice(["main", "div", "section"])
            after = other(rng.choice(["comments", "sidebar", "advert", "share"])) if rng.random() < 0.6 else ""
            text = f"<{outer}{named(MAIN_WORDS + ['wrapper', 'container', 'layout'], 0.7)}>{text}{after}</{outer}>"
        return text

    out = []
    for _ in range(n):
        before = [other(k) for k in ("header", "menu", "notice", "advert", "form", "sidebar") if rng.random() < 0.5]
        after = [other(k) for k in ("share", "sidebar", "comments", "advert", "form", "notice", "footer") if rng.random() < 0.5]
        rng.shuffle(before)
        text, kind = main(), rng.random()
        if kind < 0.1:  # a plain page
            before, after = [], after[:1] if rng.random() < 0.3 else []
        elif kind < 0.2:  # a plainer one
            before, after = [], []
            text = "".join(rng.choice([f"<p>{x}</p>", f"<p>{x}", f"{x}<br>", x]) for x in (prose(rng.randint(8, 80)) for _ in range(rng.randint(1, 3))))
        if 0.2 < kind < 0.3:  # laid out by a table
            links = lambda: rng.choice([" ", "<br>", " | "]).join(f'<a href="/x">{words(rng.randint(1, 2))}</a>' for _ in range(rng.randint(1, 6)))
            aside = lambda kinds: f"<td>{rng.choice([other(rng.choice(kinds)), f'{chr(1)}<p>{links()}</p>{chr(2)}'])}</td>" if rng.random() < 0.5 else f"<td>\x01{links()}\x02</td>"
            cells = [aside(["menu"]), f"<td{named(MAIN_WORDS, 0.3)}>{text}</td>"]
            cells += [aside(["sidebar", "advert"])] if rng.random() < 0.4 else []
            above = f"<tr>{aside(['header', 'menu'])}</tr>" if rng.random() < 0.5 else ""
            below = f"<tr><td>\x01{rng.choice([cue('footer'), words(2), links()])}\x02</td></tr>" if rng.random() < 0.5 else ""
            text = f"<table>{above}<tr>{''.join(cells)}</tr>{below}</table>"
        text = f"{''.join(before)}{text}{''.join(after)}"
        for _ in range(rng.choice([0, 0, 0, 1, 2, 5])):
            text = f"<div>{text}</div>"
        page = f"<html><head><title>\x01{words(4)}\x02</title></head><body>{text}</body></html>" if kind < 0.15 or kind > 0.2 else text
        blocks, labels, depth = [], [], 0
        for b in blocks_of(page):  # the marks \x01 and \x02 enclose what is not main text
            outside = False
            for bit in re.split("([\x01\x02])", b.text):
                outside |= depth == 0 and bit.strip("\x01\x02 ") != ""
                depth += (bit == "\x01") - (bit == "\x02")
            text = " ".join(b.text.replace("\x01", "").replace("\x02", "").split())
            if text:
                blocks.append(Block(text, b.linked, b.marks, b.parent, b.home))
                labels.append(int(outside))
        out.append((blocks, labels))
    return out


# ---- the operator ----------------------------------------------------------------------------------------------------


def extract(pages: DataFrame, model: Model, id_col: str = "page_id") -> DataFrame:
    """``id_col``, ``url``, ``text`` (main blocks in page order, joined by a space) and ``n_chars`` (its code points).

    A null or empty page, and one without main text, gives an empty text. Character references are decoded and white
    space inside a block becomes one space. Whole pages are read at any depth, repeated rows each; other columns are not
    read. Where two labellings of a page are equally likely, a block goes to what is not main text.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html in batch.column(2):
                blocks = blocks_of(html.as_py(), shared.value.names)
                texts.append(" ".join(b.text for b, y in zip(blocks, shared.value.decode(blocks), strict=True) if y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    picked = pages.select(F.col(id_col).cast("long").alias("id"), "url", "html")
    out = picked.mapInArrow(read, "id long, url string, text string")
    return out.select(F.col("id").alias(id_col), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@lru_cache(maxsize=4)
def composed_model(pages: int = 800, seed: int = 10) -> Model:
    """The model of composed pages, trained once in a session: its size and effort do not depend on the tables."""
    return train(labelled_pages(pages, seed))


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), composed_model())
