"""Exact encoding and decoding with merge-type SentencePiece models, by backtracking.

A sequence of pieces is the one that merging would give exactly if each pair of
neighbours is what merging gives for the text of the two. So the encoder takes the
longest piece at each position (all matches come from an Aho-Corasick automaton),
checks it against its neighbour by merging the two again, tries the next shorter
piece where they do not agree, and marks positions that lead nowhere in a bit field.

Merging two pieces again needs no merge of their texts: each was made from two halves, in an order that ranks
tell, so only the pieces on both sides of the seam are looked at, from the whole ones down to characters.
"""

import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import chunks, per_process, whole_text

#: Fixed value: the character that stands for a blank inside pieces.
BLANK = "▁"
#: Words (of either generation) and pairs a worker process remembers; what is forgotten is worked out again.
REMEMBERED = 220_000
#: Characters encoded at once.
AT_ONCE = 500_000
_NEVER = float("inf")


class Pieces:
    """The model's pieces, and the decoder over them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.normalize(" Ａ  ") != f"{BLANK}{BLANK}Ａ{BLANK}{BLANK}":
            raise ValueError("only models without normalisation, with a blank put in front, are supported")
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.rank: dict[str, tuple[float, int]] = {}
        self.bytes: dict[int, int] = {}
        self.shown: list[str] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not model.is_control(i) and not model.is_unknown(i):
                self.rank[piece] = (-model.get_score(i), i)
            self.shown.append(" ⁇ " if model.is_unknown(i) else "" if model.is_control(i) else piece.replace(BLANK, " "))
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.is_byte = np.zeros(len(self.shown), bool)
        self.is_byte[list(self.byte_of)] = True

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: byte pieces are read as UTF-8, what is no UTF-8 gives U+FFFD per byte."""
        flags = self.is_byte[ids]
        if not flags.any():
            text = "".join(map(self.shown.__getitem__, ids.tolist()))
        else:
            edges = np.flatnonzero(np.diff(flags)) + 1
            parts = []
            for run in np.split(ids, edges):
                if self.is_byte[run[0]]:
                    parts.append(_utf8(bytes(map(self.byte_of.__getitem__, run.tolist()))))
                else:
                    parts.append("".join(map(self.shown.__getitem__, run.tolist())))
            text = "".join(parts)
        first = next((i for i in ids.tolist() if self.shown[i]), None)  # the blank put in front goes again
        return text[1:] if first is not None and not self.is_byte[first] and self.shown[first][0] == " " and self.shown[first] != " ⁇ " else text


class Merger(Pieces):
    """The encoder, with what it remembers."""

    def __init__(self, path: str):
        import ahocorasick

        super().__init__(path)
        self.matches = ahocorasick.Automaton()
        for piece in self.rank:
            if len(piece) > 1:  # a single character always matches itself
                self.matches.add_word(piece, (len(piece) - 1, 1 << len(piece)))
        self.matches.make_automaton()
        self.single = frozenset(p for p in self.rank if len(p) == 1)
        self.inside = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        # Texts are cut where no piece reaches across: before a blank behind another character, and
        # around a line feed that is in no piece. The stretches repeat, and each is encoded once.
        self.by_word = not any(b[1] == BLANK and b[0] != BLANK for b in self.inside)
        self.by_line = not any("\n" in p for p in self.rank)
        # The same holds before a sign at the end of a stretch, but for the characters some piece has before it.
        self.signs = {c: [b[0] for b in self.inside if b[1] == c] for c in ",."}
        self.words = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n" if self.by_line else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.agreed: dict[tuple[str, str], bool] = {}
        # The two halves each piece is merged from last; None for a piece that merging never gives.
        self.order = {p: -1.0 if len(p) == 1 else score for p, (score, _) in self.rank.items()}
        self.halves: dict[str, tuple[str, str] | None] = {}
        for piece in self.rank:
            if len(piece) > 1:
                self.halves[piece] = self._last if self.merge(piece) == [piece] else None
        # Halves come before what they make, and no two pieces have one score; where that does not hold texts are merged in full.
        shared = {score for score, n in Counter(self.order.values()).items() if n > 1 and score >= 0}
        self.plain = frozenset(
            p
            for p, h in self.halves.items()
            if self.order[p] < 0 or self.order[p] in shared or h and max(self.order.get(x, 0.0) for x in h) >= self.order[p]
        )
        # Ids of the stretches met lately, as bytes: two generations, of which the older one goes.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of ``text`` by merging: best score first, leftmost among equals."""
        n = len(text)
        part, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.rank[text[i : i + 2]], i, 2) for i in range(n - 1) if text[i : i + 2] in self.rank]
        heap = [(score, i, size) for score, _, i, size in heap]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                both = part[i] + part[after[i]]
                if both in self.rank:
                    heapq.heappush(heap, (self.rank[both][0], i, len(both)))

        while heap:
            _, i, size = heapq.heappop(heap)
            if not part[i] or after[i] >= n or len(part[i]) + len(part[after[i]]) != size:
                continue
            j = after[i]
            self._last = part[i], part[j]
            part[i] += part[j]
            part[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p]

    def agree(self, left: str, right: str) -> bool:
        """Whether merging the text of both gives these two; ``left`` is empty at the start."""
        key = (left, right)
        known = self.agreed.get(key)
        if known is None:
            if len(self.agreed) >= REMEMBERED:
                self.agreed.clear()
            known = self.agreed[key] = self._seam_holds(left, right) if left else self._is_made(right)
        return known

    def _is_made(self, piece: str) -> bool:
        return len(piece) == 1 or self.halves[piece] is not None

    def _seam_holds(self, left: str, right: str) -> bool:
        """Whether no merge across the seam comes before those that make ``left`` and ``right``.

        While ``a`` ends the left side and ``b`` begins the right one, they merge if nothing that takes
        either of them comes first: what takes ``a`` lies further left and wins a tie, what takes ``b`` loses it.
        """
        if not (self._is_made(left) and self._is_made(right)):
            return False
        order, halves, plain = self.order, self.halves, self.plain
        if left in plain or right in plain:
            return self.merge(left + right) == [left, right]
        a, b, takes_a, takes_b = left, right, _NEVER, _NEVER
        while True:
            both = order.get(a + b)
            if both is not None and both < takes_a and both <= takes_b:
                return a + b in plain and self.merge(left + right) == [left, right]
            made_a, made_b = order[a], order[b]
            if made_a > made_b:  # the later one is taken apart
                takes_a, a = made_a, halves[a][1]
            elif made_b >= 0:
                takes_b, b = made_b, halves[b][0]
            else:
                return True

    def _choices(self, text: str) -> list[int]:
        """By position, the sizes of the pieces that start there, as bits; the character alone is always one."""
        choices = [2] * len(text)
        for last, (back, bit) in self.matches.iter(text):
            choices[last - back] |= bit
        return choices

    def backtrack(self, text: str, choices: list[int]) -> list[str]:
        """Pieces of a text of known characters."""
        n = len(text)
        agreed = self.agreed
        failed = bytearray(n // 8 + 1)
        pieces: list[str] = []
        at, left = 0, ""
        sizes = choices[0]
        open_: list[int] = []  # by depth, what is left to try at its position
        while True:
            while sizes:
                size = sizes.bit_length() - 1
                sizes ^= 1 << size
                to = at + size
                if failed[to >> 3] >> (to & 7) & 1:
                    continue
                right = text[at:to]
                known = agreed.get((left, right))
                if known is None:
                    known = self.agree(left, right)
                if known:
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not pieces:
                    return self.merge(text)
                at -= len(pieces.pop())
                left = pieces[-1] if pieces else ""
                sizes = open_.pop()
                continue
            pieces.append(right)
            if to == n:
                return pieces
            open_.append(sizes)
            at, left, sizes = to, right, choices[to]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of stretches each of which merges with nothing around it; one pass of the automaton finds all pieces."""
        choices = self._choices("\0".join(words))
        out, at = [], 0
        known, rank = self.single.issuperset, self.rank
        for word in words:
            if len(word) > 1 and known(word):
                out.append([rank[p][1] for p in self.backtrack(word, choices[at : at + len(word)])])
                at += len(word) + 1
                continue
            ids: list[int] = []
            start = 0
            for i, c in enumerate(word):
                if c not in self.rank:
                    if i > start:
                        ids += self._known(word[start:i], choices[at + start : at + i])
                    ids += [self.bytes[b] for b in c.encode()]
                    start = i + 1
                elif i > start and word[i - 1 : i + 1] not in self.inside:  # in no piece: never merged across
                    ids += self._known(word[start:i], choices[at + start : at + i])
                    start = i
            if len(word) > start:
                ids += self._known(word[start:], choices[at + start : at + len(word)])
            out.append(ids)
            at += len(word) + 1
        return out

    def _known(self, text: str, choices: list[int]) -> list[int]:
        if len(text) == 1:
            return [self.rank[text][1]]
        return [self.rank[p][1] for p in self.backtrack(text, choices)]

    def _learn(self, words: set[str]) -> None:
        """Makes sure that all ``words`` are among the young."""
        if len(self.young) + len(words) > REMEMBERED and self.young:
            self.old, self.young = self.young, {}
        fresh = []
        for word in words:
            if word in self.young:
                continue
            known = self.old.get(word)
            if known is None:
                fresh.append(word)
            else:
                self.young[word] = known
        for k in range(0, len(fresh), 2_000):
            some = fresh[k : k + 2_000]
            self.young.update(zip(some, (struct.pack(f"<{len(ids)}I", *ids) for ids in self.encode_words(some))))

    def _stretches(self, text: str) -> list[str]:
        if not self.by_word:
            return [text]
        if BLANK + BLANK in text or "\x01" in text:
            return self.words.findall(text)
        text = text.replace(BLANK, f"\x01{BLANK}")
        if self.by_line:
            text = text.replace("\n", "\x01\n\x01")
        for sign, held in self.signs.items():
            text = text.replace(f"{sign}\x01", f"\x01{sign}\x01")
            for c in held:
                if c in text:
                    text = text.replace(f"{c}\x01{sign}\x01", f"{c}{sign}\x01")
        return text.split("\x01")  # an empty stretch has no ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit numbers."""
        split = [self._stretches(BLANK + text.replace(" ", BLANK)) if text else [] for text in texts]
        missing = set().union(*split).difference(self.young)
        if missing:
            if len(self.young) + len(missing) > REMEMBERED:
                missing = set().union(*split)  # the young may go, and all of this call's are needed
            self._learn(missing)
        ids = self.young.__getitem__
        begin, end = (struct.pack("<I", i) for i in (self.begin, self.end))
        return [b"".join((begin, *map(ids, words), end)) for words in split]


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


def encode(docs: DataFrame, model: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with column ``into``: all ids as little-endian unsigned 32-bit numbers.

    Begin and end ids are included. Null text is empty: begin and end only. All other
    columns are kept; one already named ``into`` is replaced.
    """

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merger = per_process(("merger", model), lambda: Merger(model))
        for batch in batches:
            for texts in chunks((t.as_py() for t in batch), AT_ONCE):  # results leave in small parts
                yield pa.array(merger.encode(texts), pa.binary())

    return docs.withColumn(into, ids(whole_text(text_col)))


def decode(docs: DataFrame, model: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with column ``into``: the text of the ids in ``ids_col``; null ids give null."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = per_process(("pieces", model), lambda: Pieces(model))
        for batch in batches:
            for first in range(0, len(batch), 500):
                part = (b.as_py() for b in batch.slice(first, 500))
                yield pa.array([None if x is None else pieces.decode(np.frombuffer(x, "<u4")) for x in part], pa.string())

    return docs.withColumn(into, text(F.col(ids_col)))
