"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is read into blocks (text between block-level tags) with their open ancestors.
Features are ancestor tags, words of their classes and ids, and signs of the text. The
field has two labels, main text and the rest; it is trained on labelled pages and
decoded by Viterbi. Labelled pages are generated ones, and given pages whose
``article`` or ``main`` element says what the main text is.
"""

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import chunks, least_places

#: Given pages the field is trained on at most, and generated ones.
FIT_PAGES, MADE_PAGES = 200, 400

# Element names of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
    + "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover".split()
    + "mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text of the page.
SILENT = frozenset("script style noscript template head title svg iframe textarea select button canvas datalist".split())
#: What may stand in a head; anything else ends a head left open.
IN_HEAD = frozenset("title meta link style script base noscript template basefont bgsound".split())
RAW = frozenset("script style textarea title noscript iframe".split())
#: An opening tag on the left closes an open element of the same kind first.
CLOSED_BY_SAME = frozenset("p li dt dd tr td th option".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li".split()
)
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
PART = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^>]*(?:>|\Z))", re.S)
NAMED = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int  # characters inside links
    heading_seen: bool


def _unclosed(page: str) -> set[int]:
    """Places after the opening tags of silent elements that no end tag of their own belongs to."""
    opened: dict[str, list[int]] = {}
    at = 0
    while found := PART.search(page, at):
        at = found.end()
        name = (found.group(2) or "").lower()
        if name not in SILENT:
            continue
        if found.group(1):
            if opened.get(name):
                opened[name].pop()
            continue
        if name in RAW and (end := RAW_END[name].search(page, at)):
            at = end.end()
        else:
            opened.setdefault(name, []).append(at)
    return {place for places in opened.values() for place in places}


@lru_cache(maxsize=4096)
def _words(attributes: str) -> tuple[str, ...]:
    """Lower-case words of class, id and role."""
    found = (x[1] or x[2] or x[3] for x in NAMED.findall(attributes))
    return tuple(dict.fromkeys(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(found)).lower())))


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks with text, in page order. Never fails on broken markup: stray ends are ignored, a cut tag is dropped.

    A head without an end ends at what cannot stand in one. Another silent element without an
    end, other than a script or style, ends at the next opening tag of a block.
    """
    out: list[Block] = []
    open_: list[tuple[str, tuple[str, ...]]] = []
    starts: list[int] = []  # of each open element, the place after its tag
    unclosed: set[int] | None = None  # read once it is needed
    silent, links, heading = 0, 0, False
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal parts, linked, links
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(text, tuple(open_), linked, heading))
            parts = []
        linked = links = 0

    def cut_to(k: int) -> None:
        nonlocal silent
        silent -= sum(n in SILENT for n, _ in open_[k:])
        del open_[k:], starts[k:]

    def end_unclosed() -> None:
        nonlocal unclosed
        if unclosed is None:
            unclosed = _unclosed(page)
        while silent:
            k = max(k for k, (n, _) in enumerate(open_) if n in SILENT)
            if open_[k][0] == "head" or starts[k] not in unclosed:
                return
            cut_to(k)

    def close(name: str) -> None:
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] == name:
                cut_to(k)
                return

    def say(raw: str) -> None:
        nonlocal linked
        if silent and open_[-1][0] == "head" and raw.strip():
            cut_to(len(open_) - 1)
        if raw and not silent:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text)

    at, size = 0, len(page)
    while at < size:
        found = PART.search(page, at)
        if not found:
            rest = page[at:]
            cut = re.search(r"<[A-Za-z/!?][^<]*\Z", rest)  # a tag the page ends in
            say(rest[: cut.start()] if cut else rest)
            break
        say(page[at : found.start()])
        at = found.end()
        name = (found.group(2) or "").lower()
        if not name:
            continue
        if silent and not found.group(1):
            if name == "body" or name in CLOSES_P:
                end_unclosed()
            if silent and (name == "body" or open_[-1][0] == "head" and name not in IN_HEAD):
                close("head")
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if found.group(1) else 1))
            continue
        if name == "br":
            say(" ")
            continue
        flush()
        if found.group(1):
            close(name)
            continue
        if name in CLOSES_P and open_ and open_[-1][0] == "p":
            cut_to(len(open_) - 1)
        if name in CLOSED_BY_SAME and open_ and open_[-1][0] == name:
            cut_to(len(open_) - 1)
        if name in VOID or (found.group(3) or "").endswith("/") and name in ("svg", "iframe"):
            continue
        if name in ("h1", "h2"):
            heading = True
        open_.append((name, _words(found.group(3) or "")))
        starts.append(at)
        silent += name in SILENT
        if name in RAW and ((end := RAW_END[name].search(page, at)) or name in ("script", "style")):
            at = end.end() if end else size
            close(name)
    flush()
    return out


@lru_cache(maxsize=8192)
def _path_features(path: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[str, ...]:
    found = []
    inner = [x for x in path if x[0] not in ("html", "body")]
    for k, (name, words) in enumerate(reversed(inner)):
        if k < 3:
            found.append(f"tag{k}={name}")
            found += [f"word{k}={w}" for w in words]
        found.append(f"in={name}")
        found += [f"about={w}" for w in words]
    if not inner:
        found.append("bare")
    nearest = next((name for name, _ in reversed(inner) if name in _SECTIONS), "none")
    found.append(f"section={nearest}")
    return tuple(dict.fromkeys(found))


_SECTIONS = frozenset("article main nav footer header aside form section".split())


def features(block: Block, first: bool, last: bool, headed: bool) -> list[str]:
    words = block.text.count(" ") + 1
    found = [
        *_path_features(block.path),
        f"words={'1-3' if words < 4 else '4-9' if words < 10 else '10-29' if words < 30 else '30+'}",
        f"links={'none' if not block.linked else 'some' if 2 * block.linked < len(block.text) else 'most'}",
        f"end={'stop' if block.text[-1] in '.!?:\"”' else 'open'}",
        "after-heading" if block.heading_seen else "before-heading" if headed else "no-heading",
    ]
    if "©" in block.text:
        found.append("copyright")
    if first:
        found.append("first")
    if last:
        found.append("last")
    return found


@dataclass
class Field:
    """Weights for main text against the rest; ``move[a][b]`` for label b after label a."""

    weights: dict[str, float] = field(default_factory=dict)
    move: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    bias: float = 0.0

    def _scores(self, page: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [self.bias + sum(get(f, 0.0) for f in found) for found in page]

    def decode(self, page: list[list[str]]) -> list[int]:
        """Best labels by Viterbi."""
        if not page:
            return []
        scores, move = self._scores(page), self.move
        rest, main = 0.0, scores[0]
        back = []
        for s in scores[1:]:
            to_rest = (rest + move[0][0], main + move[1][0])
            to_main = (rest + move[0][1], main + move[1][1])
            back.append((int(to_rest[1] > to_rest[0]), int(to_main[1] > to_main[0])))
            rest, main = max(to_rest), max(to_main) + s
        labels = [int(main > rest)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def train(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3, seed: int = 5) -> None:
        """Gradient ascent on the log-likelihood page by page, with a step per weight that shrinks."""
        r = np.random.default_rng(seed)
        square: dict[object, float] = {}

        def add(key: object, value: float, g: float) -> float:
            g -= decay * value
            square[key] = square.get(key, 1e-6) + g * g
            return value + rate * g / square[key] ** 0.5

        for _ in range(rounds):
            for k in r.permutation(len(pages)):
                page, gold = pages[k]
                if not page:
                    continue
                scores, m, n = self._scores(page), self.move, len(page)
                ahead = [(0.0, scores[0])]
                for s in scores[1:]:
                    a, b = ahead[-1]
                    ahead.append((_total(a + m[0][0], b + m[1][0]), _total(a + m[0][1], b + m[1][1]) + s))
                behind = [(0.0, 0.0)]
                for s in reversed(scores[1:]):
                    a, b = behind[-1]
                    behind.append((_total(m[0][0] + a, m[0][1] + s + b), _total(m[1][0] + a, m[1][1] + s + b)))
                behind.reverse()
                z = _total(*ahead[-1])
                moved = [[0.0, 0.0], [0.0, 0.0]]
                for t in range(1, n):
                    for x in (0, 1):
                        for y in (0, 1):
                            moved[x][y] -= exp(ahead[t - 1][x] + m[x][y] + y * scores[t] + behind[t][y] - z)
                    moved[gold[t - 1]][gold[t]] += 1
                for t, found in enumerate(page):
                    g = gold[t] - exp(ahead[t][1] + behind[t][1] - z)
                    if abs(g) > 1e-4:
                        for f in found:
                            self.weights[f] = add(f, self.weights.get(f, 0.0), g)
                        self.bias = add(None, self.bias, g)
                for x in (0, 1):
                    for y in (0, 1):
                        m[x][y] = add((x, y), m[x][y], moved[x][y])


def _total(a: float, b: float) -> float:
    return max(a, b) + log(1 + exp(-abs(a - b)))


def page_features(blocks: list[Block]) -> list[list[str]]:
    headed = any(b.heading_seen for b in blocks)
    return [features(b, k == 0, k == len(blocks) - 1, headed) for k, b in enumerate(blocks)]


#: Words that classes and ids of such parts are commonly made of; the generated pages use them.
PARTS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toc topnav links pager pagination skip".split(),
    "header": "header masthead site top logo brand topbar hero".split(),
    "footer": "footer foot copyright legal colophon bottom imprint".split(),
    "aside": "sidebar aside side widget rail related popular trending recommended tags archive teaser more".split(),
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay warning banner privacy message".split(),
    "ad": "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion promoted adslot commercial".split(),
    "form": "form search login signup contact subscribe newsletter register".split(),
    "comments": "comments comment commentlist replies reply discussion respond responses thread feedback reader".split(),
    "social": "share social follow sharing bookmark".split(),
}
MAIN = "article content main post entry story body text page blog prose copy news".split()


def generated(r: np.random.Generator) -> tuple[str, list[int]]:
    """A page and the label of each of its blocks."""
    out, labels = ["<html><head><title>t</title></head><body>"], []

    def pick(options):
        return options[int(r.integers(len(options)))]

    def words(low: int, high: int) -> str:
        return " ".join("".join(pick("aeinorstuldcmp") for _ in range(r.integers(2, 9))) for _ in range(r.integers(low, high)))

    def sentence(low: int = 5, high: int = 60) -> str:
        text = words(low, high)
        if r.random() < 0.2:
            text = f"{text} <{(i := pick(['b', 'em', 'a', 'span']))}>{words(1, 4)}</{i}> {words(1, 9)}"
        return text + (pick([".", ".", ".", "!", ""]))

    def named(kind: str) -> str:
        options = PARTS.get(kind, MAIN)
        name = pick(options) + pick(["", "", "-" + pick(["box", "wrap", "area", "list", "inner", pick(options)])])
        return f' {pick(["class", "class", "id"])}="{name}"'

    def part(kind: str) -> None:
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6 else pick(["div", "div", "section", "ul" if kind == "nav" else "div"])
        named_tag = tag == kind and r.random() < 0.5
        out.append(f"<{tag}{'' if named_tag else named(kind)}>")
        style = pick(["links", "text", "mixed"]) if kind not in ("comments", "nav") else {"comments": "talk", "nav": "links"}[kind]
        for _ in range(r.integers(1, 6)):
            if style == "links":
                out.append(f'<li><a href="/x">{words(1, 4)}</a></li>')
            elif style == "talk":
                out.append(pick(["<p>{}</p>", '<div class="comment">{}</div>', "<li>{}</li>"]).format(sentence()))
            elif style == "text":
                out.append(pick(["<p>{}</p>", "<div>{}</div>", "<span>{}</span><hr>"]).format(sentence(2, 25)))
            else:
                out.append(f'<p><a href="#">{words(1, 3)}</a> {words(1, 6)}</p>')
            labels.append(0)
        out.append(f"</{tag}>")

    plain = r.random() < 0.1  # nothing but text
    for kind, chance in () if plain else (("header", 0.5), ("nav", 0.8), ("notice", 0.4), ("ad", 0.4), ("aside", 0.2), ("form", 0.2)):
        if r.random() < chance:
            part(kind)
    wrap = "" if plain else pick(["article", "article", "main", "div", "section", ""])
    if wrap:
        out.append(f"<{wrap}{named('') if wrap in ('div', 'section') or r.random() < 0.2 else ''}>")
    if r.random() < 0.3:
        out.append(f"<div{pick(['', named('')])}>")
    if r.random() < (0.3 if plain else 0.8):
        title = f"<h1>{words(2, 9)}</h1>"
        out.append(f"<header>{title}</header>" if wrap and r.random() < 0.15 else title)
        labels.append(1)
    for _ in range(r.integers(1, 12)):
        chance = r.random()
        if chance < 0.72:
            out.append(f"<p>{sentence(1, 80)}" + pick(["</p>", "</p>", ""]))
        elif chance < 0.8:
            out.append(f"<h2>{words(1, 6)}</h2>")
        elif chance < 0.87:
            out.append(pick(["<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<table><tr><td>{}</td></tr></table>", "<div>{}</div>", "<pre>{}</pre>"]).format(sentence(1, 20)))
        else:
            part(pick(["ad", "aside", "notice", "form", "social"]))
            continue
        labels.append(1)
    if r.random() < 0.25:
        part("comments")
    if wrap:
        out.append(f"</{wrap}>")
    for kind, chance in () if plain else (("comments", 0.3), ("aside", 0.4), ("ad", 0.2), ("social", 0.2), ("form", 0.2), ("notice", 0.2), ("footer", 0.8)):
        if r.random() < chance:
            part(kind)
    return "".join(out), labels


def told(blocks: list[Block]) -> list[int] | None:
    """Labels by the page's own article or main element; None if it has none."""
    outside = {w for words in PARTS.values() for w in words}
    labels, any_ = [], False
    for b in blocks:
        names = [name for name, _ in b.path]
        start = max((k for k, n in enumerate(names) if n in ("article", "main")), default=None)
        any_ |= start is not None
        inner = b.path[start + 1 :] if start is not None else ()
        labels.append(int(start is not None and not any(n in ("nav", "aside", "footer", "form") or outside & set(w) for n, w in inner)))
    return labels if any_ else None


def train(pages: DataFrame, html_col: str = "html") -> Field:
    """A field fitted to ``MADE_PAGES`` generated pages and up to ``FIT_PAGES`` of the given ones.

    The given pages are those with the least hash among the ones with an article or main
    element, so the choice is the same in every run.
    """
    some = pages.select(F.coalesce(F.col(html_col), F.lit("")).alias("page")).filter(F.col("page").rlike("(?i)<(article|main)[ >]"))
    some = least_places(some.select("page", F.xxhash64("page").alias("place")), "place", FIT_PAGES, "page").select("page").collect()
    r = np.random.default_rng(2)
    labelled = []
    for page, labels in (generated(r) for _ in range(MADE_PAGES)):
        blocks = blocks_of(page)
        if len(blocks) == len(labels):
            labelled.append((page_features(blocks), labels))
    for row in some:
        blocks = blocks_of(row["page"])
        if (labels := told(blocks)) is not None:
            labelled.append((page_features(blocks), labels))
    model = Field()
    model.train(labelled)
    return model


def main_text(model: Field, page: str) -> str:
    blocks = blocks_of(page)
    return " ".join(b.text for b, label in zip(blocks, model.decode(page_features(blocks))) if label)


def extract(pages: DataFrame, model: Field, html_col: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with column ``into``: the main text of the whole page.

    Character references are decoded, white space in a block becomes one blank, blocks are
    joined by one blank in page order. Null or empty pages, and pages without main text,
    give the empty text. Other columns are kept; one already named ``into`` is replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(shared.value, page) for run in chunks(x.as_py() for x in batch) for page in run], pa.string())

    return pages.withColumn(into, text(F.coalesce(F.col(html_col), F.lit(""))))
