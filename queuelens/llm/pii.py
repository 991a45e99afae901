"""Personal data: patterns, and a character-level bidirectional LSTM with a CRF that adds spans.

The tagger is trained from labelled spans: what the patterns find in a bounded sample
of documents, and generated examples of other spellings. A text is cut into
overlapping windows; the scores of windows that overlap are averaged, weighted by the
distance to the window's edge, and each stretch of windows is decoded as a whole.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import chunks, fresh, give_back, least_places, whole_text
from queuelens.llm.tagger import Tagger, codes_of

KINDS = ("email", "ip", "card", "phone")
#: Characters in a window, and from one window to the next.
WINDOW, STRIDE = 64, 32
#: Documents with a match whose windows the tagger is trained on at most, and windows of each.
FIT_DOCS, FIT_WINDOWS = 400, 4
#: Generated training windows of each kind.
MADE = 150

# The base patterns. A look-behind keeps long digit runs linear and changes no match.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What every span of the four kinds holds: a digit, or an at-sign, also spelt "at" by itself or "AT" between small
#: letters. The same in Java and Python.
TRIGGER = re.compile(r"[0-9@]|(?<![A-Za-z])[Aa][Tt](?![A-Za-z])|(?<=[a-z0-9])AT(?=[a-z0-9])")
#: Spellings of the at-sign in generated addresses.
SPELT = ("[at]", " (at) ", " [at] ", " at ", "(at)", "AT")
#: What an address with a spelt sign goes on with behind the part the tagger found.
REST = re.compile(r"[A-Za-z0-9-]*(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]+)*")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each at-sign, so a long run of letters is read once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """Pattern matches by kind, then start; leftmost and non-overlapping within a kind."""
    if not TRIGGER.search(text):
        return []
    spans: list[Span] = [(0, a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                spans.append((3, *m.span()))
    return spans


def _stretches(text: str) -> list[tuple[int, int]]:
    """First and last window (by number) of each run of windows that hold a trigger."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    runs: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        low, high = max(0, -(-(m.start() - WINDOW + 1) // STRIDE)), min(last, m.start() // STRIDE)
        if runs and low <= runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], max(runs[-1][1], high))
        else:
            runs.append((low, high))
    return runs


_WEIGHT = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(float)


def tagged_spans(tagger: Tagger, texts: list[str], most: int = 2048) -> list[list[Span]]:
    """Spans the tagger finds in each text. At most ``most`` windows are held at once."""
    spans: list[list[Span]] = [[] for _ in texts]
    stretches = [(i, a, b) for i, t in enumerate(texts) for a, b in _stretches(t)]
    at = 0
    while at < len(stretches):
        some, windows = [], 0
        while at < len(stretches) and (not some or windows + stretches[at][2] - stretches[at][1] < most):
            some.append(stretches[at])
            windows += stretches[at][2] - stretches[at][1] + 1
            at += 1
        places, rows = [], []
        for i, a, b in some:
            start, end = a * STRIDE, min(len(texts[i]), b * STRIDE + WINDOW)
            codes = np.zeros((b - a) * STRIDE + WINDOW, np.int64)
            codes[: end - start] = codes_of(texts[i][start:end])
            places.append((i, start, end))
            rows.append(codes[np.arange(b - a + 1)[:, None] * STRIDE + np.arange(WINDOW)])
        every = np.concatenate(rows)
        found = np.concatenate([tagger.emissions(every[k : k + most]) for k in range(0, len(every), most)])
        scores, first = [], 0
        for (_, start, end), own in zip(places, rows):
            total = np.zeros(((len(own) - 1) * STRIDE + WINDOW, tagger.tags))
            weight = np.zeros((len(total), 1))
            for k in range(len(own)):
                total[k * STRIDE : k * STRIDE + WINDOW] += found[first + k] * _WEIGHT[:, None]
                weight[k * STRIDE : k * STRIDE + WINDOW] += _WEIGHT[:, None]
            scores.append((total / weight)[: end - start])
            first += len(own)
        for (i, start, _), tags in zip(places, tagger.decode(scores)):
            edges = np.flatnonzero(np.concatenate(([True], tags[1:] != tags[:-1], [True])))
            for a, b in zip(edges[:-1], edges[1:]):
                if tags[a]:
                    spans[i].append((int(tags[a]) - 1, start + int(a), start + int(b)))
    return spans


def plausible(kind: int, found: str) -> bool:
    """Checks that follow the tagger: what no number of the kind can be is not added."""
    digits = re.sub("[^0-9]", "", found)
    if kind == 0:
        if re.search("[0-9@]", found):
            return "@" in found or "at" in found.lower()
        return bool(TRIGGER.search(found)) and bool(re.search(r"\.|dot", found, re.I))  # a host has a dot
    if kind == 1:
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def all_spans(tagger: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans: those of the tagger are added where no base span is."""
    out = []
    for text, added in zip(texts, tagged_spans(tagger, texts)):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        every = list(base)
        for kind, a, b in added:
            while a < b and text[a].isspace():
                a += 1
            while b > a and (text[b - 1].isspace() or text[b - 1] in ",.;:"):
                b -= 1
            if kind == 0:  # to its ends: the tagger may stop inside a word, or between words
                b = REST.match(text, b).end()
                while a and text[a - 1] in _LOCAL_CHARS and text[a - 1] != ".":
                    a -= 1
                if every[len(base) :] and every[-1][0] == 0 and a < every[-1][2]:
                    continue
            if plausible(kind, text[a:b]) and not any(x < b and a < y for x, y in taken):
                every.append((kind, a, b))
        out.append((base, sorted(every)))
    return out


def _generated(r: np.random.Generator) -> list[tuple[str, list[Span]]]:
    """Windows with one span each in spellings the patterns may miss, and windows with digits that are none."""

    def word() -> str:
        return "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), r.integers(2, 9)))

    def digits(n: int) -> str:
        return "".join(map(str, r.integers(0, 10, n)))

    def spelt() -> str:
        dot = r.choice([".", ".", " dot ", " (dot) "])
        return f"{word()}{r.choice(['', '.' + word()])}{r.choice(SPELT)}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}"

    def email() -> str:
        own, host = (digits(r.integers(1, 3)), digits(1)) if r.random() < 0.5 else (r.choice(["", word()]), "")
        dot = r.choice([".", ".", ".", " dot ", " (dot) ", "[dot]"])
        at = r.choice(["@", "(at)", " @ ", "[at]"])
        parts = [word() + host, *([word()] if r.random() < 0.5 else []), r.choice(["com", "org", "net", "de"])]
        return f"{word()}{r.choice(['.', '_', ''])}{own}{at}{dot.join(parts)}"

    def ip() -> str:
        return r.choice([".", ".", "[.]"]).join(str(x) for x in r.integers(1, 255, 4))

    def card() -> str:
        number = "4" + digits(14)
        number += next(c for c in "0123456789" if luhn(number + c))
        return str(r.choice(["", " ", "-", "."])).join(number[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        return f"{r.choice(['+1 ', '', '+49 ', '001 '])}({digits(3)}) {digits(3)}-{digits(4)}"

    def none() -> str:
        return str(r.choice([f"key={digits(3)}{word()}{digits(5)}", f"{digits(2)}.{digits(1)}", f"AK{word().upper()}{digits(2)}", digits(r.integers(1, 6)), f"version {digits(1)}.{digits(1)}."]))

    def prose() -> str:
        a, b = r.choice(["we met", "sat", "look", "was", "stay", word()]), r.choice(["noon", "home", "the door", "all", "last", "once", word()])
        return f"{a}{r.choice([' at ', ' at ', ' at ', ', at ', '. At ', ' (at '])}{b}{r.choice(['.', ',', ' ', '. '])}"

    out = []
    for kind, make in ((0, email), (1, ip), (2, card), (3, phone), (4, none), (4, prose), (0, spelt)):
        for _ in range(MADE):
            before = " ".join(word() for _ in range(r.integers(0, 2 if make is spelt else 5))) + " "
            span = make()
            text = f"{before}{span} {' '.join(word() for _ in range(8))}"
            out.append((text[:WINDOW], [(kind, len(before), min(WINDOW, len(before) + len(span)))] if kind < 4 else []))
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled windows of the sampled documents: around base spans, and around other digits."""
    for batch in batches:
        texts, marks = [], []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text)
            places = [a for _, a, _ in spans[:FIT_WINDOWS]] + [m.start() for m, _ in zip(TRIGGER.finditer(text), range(FIT_WINDOWS))]
            for k, place in enumerate(places):
                start = max(0, place - (7 * k + 5) % (WINDOW // 2))
                window = text[start : start + WINDOW]
                mark = bytearray(len(window))
                for kind, a, b in spans:
                    for at in range(max(a, start), min(b, start + len(window))):
                        mark[at - start] = kind + 1
                texts.append(window)
                marks.append(bytes(mark))
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(marks, pa.binary())], ["window", "marks"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """A tagger fitted on windows of up to ``FIT_DOCS`` documents, and on generated ones.

    The documents are those with the least hash of their id among the ones with a
    trigger, so the choice is the same in every run.
    """
    triggered = (
        docs.select(F.col(id_col).alias("d_id"), whole_text(text_col).alias("d_text"))
        .filter(F.col("d_text").rlike(TRIGGER.pattern))
        .select("d_text", F.xxhash64("d_id", "d_text").alias("place"))
    )
    sample = least_places(triggered, "place", FIT_DOCS, "d_text").select("d_text")
    rows = sample.mapInArrow(_windows, "window string, marks binary").distinct().orderBy("window", "marks").collect()
    made = _generated(np.random.default_rng(3))
    codes = np.zeros((len(rows) + len(made), WINDOW), np.int64)
    gold = np.zeros_like(codes)
    for k, row in enumerate(rows):
        codes[k, : len(row["window"])] = codes_of(row["window"])
        gold[k, : len(row["marks"])] = np.frombuffer(row["marks"], np.uint8)
    for k, (text, spans) in enumerate(made, len(rows)):
        codes[k, : len(text)] = codes_of(text)
        for kind, a, b in spans:
            gold[k, a:b] = kind + 1
    tagger = Tagger(1 + len(KINDS))
    tagger.train(codes, gold)
    return tagger


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def with_spans(docs: DataFrame, tagger: Tagger, text_col: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with column ``into``: struct of ``base`` (what the patterns find) and ``spans`` (all).

    Spans are in code points, end exclusive, by kind as listed in ``KINDS``, then start.
    Null and empty texts have none. Other columns are kept; one already named ``into``
    is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    @F.arrow_udf(f"struct<base:{SPANS},spans:{SPANS}>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def shown(spans: list[Span]) -> list[dict]:
            return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

        for batch in batches:
            found = [x for texts in chunks(t.as_py() for t in batch) for x in all_spans(shared.value, texts)]
            yield pa.StructArray.from_arrays(
                [pa.array([shown(x[k]) for x in found], pa.list_(kind)) for k in (0, 1)], ["base", "spans"]
            )

    return docs.withColumn(into, find(whole_text(text_col)))


def masked(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """``docs`` with each span in the text replaced by its kind in angle brackets; null stays null.

    Of spans that overlap, the one that starts first gives the name, and all are covered.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    @F.arrow_udf("string")
    def mask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        for batch in batches:
            found = (x for texts in chunks(t.as_py() for t in batch) for x in zip(texts, all_spans(shared.value, texts)))
            yield pa.array([_masked(text, spans) for text, (_, spans) in found], pa.string())
        give_back()

    name = fresh(docs, "masked")
    out = docs.withColumn(name, mask(whole_text(text_col)))
    text = F.when(F.col(text_col).isNull(), F.col(text_col)).otherwise(F.col(name))
    return out.withColumn(text_col, text).drop(name)


def _masked(text: str, spans: list[Span]) -> str:
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join((*parts, text[at:]))
