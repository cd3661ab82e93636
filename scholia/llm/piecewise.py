"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda.

Every adjacent pair of symbols that is a piece stands on an agenda, the highest
score first, ties leftmost. The first entry that still holds is merged and its new
neighbours are entered, until the agenda is empty: O(n log n) for n symbols. Symbols
that are no piece become bytes, or the unknown id in a vocabulary without bytes.

A character that stands in no piece of two characters or more never merges, and
no piece holds a blank after another character, so a text falls into segments that
no merge can cross; segments are encoded once and kept. A vocabulary that breaks
this, or has fixed symbols, takes each text as one segment.

``round_trip`` also asks the sentencepiece library in each Arrow batch, for the segments
new there or for the whole texts, and says for every text whether both agree.

The vocabulary is a model file of public format, named by its path; every executor
must see it there. Texts are taken as they are: a model with its own table of
character replacements is refused.

Defined results: a null or empty text has no ids and decodes to the empty text;
other columns pass through, those named like a made one are replaced; repeated rows
are encoded each; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.hashed import mapped

#: The mark that stands for a blank in pieces.
BLANK = "▁"
#: Encoded segments kept per Python worker, in each of two generations: when the younger is full, it becomes the older.
KEPT = 400_000
#: Longer segments are encoded but not kept.
KEPT_LENGTH = 48
#: Marks a symbol that never merges; Spark's texts may hold it, pieces do not.
FIXED = "\0"
#: Low bits of an agenda entry, for the place in the segment.
PLACE_BITS = 40
PLACE = (1 << PLACE_BITS) - 1
#: Kinds of pieces in the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Number of the merge type among model types of the file format (fixed value).
MERGE_TYPE = 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of one message of the model file."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
            yield key >> 3, value
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else number(at)
            yield key >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """Pieces, scores and settings of one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.unused: set[str] = set()
        self.fixed: list[str] = []
        self.bytes: dict[int, int] = {}
        self.control: set[int] = set()
        self.unknown, self.dummy, self.trims, self.unknown_text = 0, True, True, " ⁇ "
        pieces: list[str] = []
        for field, value in fields(data):
            if field == 1:
                self._piece(len(pieces), dict(fields(value)), pieces)
            elif field == 2:
                trainer = dict(fields(value))
                if trainer.get(3, 1) != MERGE_TYPE:
                    raise ValueError("not a merge-type model")
                self.unknown_text = trainer.get(44, self.unknown_text.encode()).decode()
            elif field == 3:
                rules = dict(fields(value))
                if rules.get(2) or not rules.get(5, 1):
                    raise ValueError("models that replace characters are not supported")
                self.dummy, self.trims = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        if self.trims:
            raise ValueError("models that remove blanks are not supported")
        self.pieces = pieces
        place = {x: i for i, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.ranks = {p: place[x] << PLACE_BITS for p, x in self.scores.items()}
        self.by_byte = {i: b for b, i in self.bytes.items()}
        self.apart = not self.fixed and not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        joined = sorted({c for p in self.ids if len(p) > 1 for c in p} - {BLANK})
        runs = f"{BLANK}*[{''.join(map(re.escape, joined))}]+|{BLANK}+|(?s:.)" if joined else f"{BLANK}+|(?s:.)"
        self.segments = re.compile(runs)
        self.marks = re.compile("|".join(re.escape(x) for x in sorted(self.fixed, key=len, reverse=True))) if self.fixed else None
        #: Decimal id and text of each piece that symbols merge to.
        self.shown = {p: (str(i), p.replace(BLANK, " ")) for p, i in self.ids.items()}
        self.lines = self.apart and "\n" not in joined
        #: Whether some segment so far decoded to another text, as unknown symbols do.
        self.lossy = False
        self.known = Segments(self._segment)

    def _piece(self, place: int, message: dict, pieces: list[str]) -> None:
        text, kind = message[1].decode(), message.get(3, NORMAL)
        pieces.append(text)
        if kind == BYTE:
            self.bytes[int(text[3:5], 16)] = place
        elif kind == CONTROL:
            self.control.add(place)
        elif kind == UNKNOWN:
            self.unknown = place
        else:
            self.ids.setdefault(text, place)
            self.scores[text] = float(np.frombuffer(message.get(2, b"\0\0\0\0"), "<f4")[0])
            if kind == UNUSED:
                self.unused.add(text)
            if kind == USER_DEFINED:
                self.fixed.append(text)

    def merged(self, segment: str) -> list[str]:
        """Symbols left when no pair on the agenda holds any more.

        An entry is the pair's rank with the place of its left symbol in the low bits.
        """
        symbols = self._symbols(segment) if self.marks else list(segment)
        n, get = len(symbols), self.ranks.get
        agenda = [r | i for i in range(n - 1) if (r := get(symbols[i] + symbols[i + 1])) is not None]
        if not agenda:
            return [s.removeprefix(FIXED) for s in symbols] if self.marks else symbols
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        made_of: dict[str, tuple[str, str]] = {}
        while agenda:
            entry = heappop(agenda)
            i = entry & PLACE
            j = after[i]
            if j >= n or not (a := symbols[i]):
                continue
            # an entry holds while the two symbols still make its piece
            pair = a + symbols[j]
            if get(pair) != entry - i:
                continue
            if pair in self.unused:
                made_of.setdefault(pair, (a, symbols[j]))
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(pair + symbols[k])) is not None:
                    heappush(agenda, r | i)
            if (h := before[i]) >= 0 and (r := get(symbols[h] + pair)) is not None:
                heappush(agenda, r | h)
        left = [s for s in symbols if s]
        if self.marks:
            left = [s.removeprefix(FIXED) for s in left]
        return self._without_unused(left, made_of) if made_of else left

    def _symbols(self, segment: str) -> list[str]:
        """Characters and fixed symbols; a fixed one is marked, so that it is part of no piece."""
        out, at = [], 0
        for m in self.marks.finditer(segment):
            out += [*segment[at : m.start()], FIXED + m.group()]
            at = m.end()
        return out + list(segment[at:])

    def _without_unused(self, symbols: list[str], made_of: dict[str, tuple[str, str]]) -> list[str]:
        """Unused pieces fall back into what they were made of."""
        out, open_ = [], symbols[::-1]
        while open_:
            s = open_.pop()
            if s in made_of:
                open_ += made_of[s][::-1]
            else:
                out.append(s)
        return out

    def numbers(self, segment: str) -> list[int]:
        """Ids of the symbols of a segment."""
        out: list[int] = []
        was_unknown = False
        for symbol in self.merged(segment):
            found = self.ids.get(symbol)
            unknown = found is None
            if not unknown:
                out.append(found)
            elif self.bytes:
                out += [self.bytes[b] for b in symbol.encode("utf-8", "replace")]
            elif not was_unknown:
                out.append(self.unknown)
            was_unknown = unknown
        return out

    def _segment(self, segment: str) -> str:
        """Decimal ids of a segment, joined by commas; one that decodes to another text is noted."""
        try:
            found = [self.shown[s] for s in self.merged(segment)]
            ids, text = ",".join([f[0] for f in found]), "".join([f[1] for f in found])
        except KeyError:
            numbers = self.numbers(segment)
            ids, text = ",".join(map(str, numbers)), self._text(numbers)
        if text != segment.replace(BLANK, " "):
            self.lossy = True
        return ids

    def prepared(self, text: str) -> str:
        text = text.replace(" ", BLANK)
        return BLANK + text if self.dummy else text

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        if not text:
            return []
        text = self.prepared(text)
        if not self.apart:
            return self.numbers(text)
        return [int(i) for s in self.segments.findall(text) for i in self.known[s].split(",")]

    def joined(self, text: str | None) -> tuple[str, int, str]:
        """Decimal ids joined by commas, their number, and the text they decode to."""
        if not text:
            return "", 0, ""
        text = self.prepared(text)
        ids = ",".join(map(self.known.__getitem__, self.segments.findall(text))) if self.apart else self._segment(text)
        # the ids of every segment were decoded when it was made
        decoded = self.decode(list(map(int, ids.split(",")))) if self.lossy else text[self.dummy :].replace(BLANK, " ")
        return ids, ids.count(",") + 1, decoded

    def _text(self, ids: list[int]) -> str:
        """Text of ids, blanks at the beginning included."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if (byte := self.by_byte.get(i)) is not None:
                run.append(byte)
                continue
            if run:
                out.append(run_text(run))
                run = bytearray()
            if i == self.unknown:
                out.append(self.unknown_text)
            elif i not in self.control:
                out.append(self.pieces[i].replace(BLANK, " "))
        if run:
            out.append(run_text(run))
        return "".join(out)

    def decode(self, ids: list[int] | None) -> str:
        """Text of ids; the blank that encoding puts first goes, control ids have no text."""
        shown = [i for i in ids or [] if i not in self.control]
        text = self._text(shown)
        first = bool(shown) and self.pieces[shown[0]].startswith(BLANK) and shown[0] not in self.by_byte
        return text[1:] if self.dummy and first else text


def run_text(run: bytearray) -> str:
    """Text of a run of byte ids; each byte that is part of no character becomes one replacement mark."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                size = 1
            at += size
        return "".join(out)


class Segments(dict):
    """Decimal ids by segment, made when first asked for and kept in two generations."""

    def __init__(self, make: Callable[[str], str]):
        self.make, self.older = make, {}
        #: Segments made since they were last taken, for the check.
        self.fresh: dict[str, str] = {}

    def __missing__(self, segment: str) -> str:
        if (found := self.older.get(segment)) is None:
            found = self.fresh[segment] = self.make(segment)
        if len(segment) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[segment] = found
        return found

    def forget(self) -> None:
        """Lets go of what was made, at the end of a task."""
        self.clear()
        self.older, self.fresh = {}, {}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def library(path: str):
    """The public library on the same file."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of the ids of every whole text (array of ints) in place of the text."""

    def run(texts: list[str | None]) -> dict[str, list]:
        return {ids: [vocabulary(path).encode(t) for t in texts]}

    return mapped(docs, text, {ids: ("array<int>", pa.list_(pa.int32()))}, run, lambda: vocabulary(path).known.forget()).drop(text)


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the text that ids stand for in place of the ids."""

    def run(rows: list[list[int] | None]) -> dict[str, list]:
        return {decoded: [vocabulary(path).decode(r) for r in rows]}

    return mapped(docs, ids, {decoded: ("string", pa.string())}, run).drop(ids)


def differs(path: str, fresh: dict[str, str]) -> bool:
    """Whether the library encodes new segments, each on a line of one text, to other ids. No merge crosses a line's end."""
    known = vocabulary(path)
    end = known.known["\n"]
    ours = ",".join([f"{ids},{end}" for ids in fresh.values()])
    theirs = library(path).encode("\n" + "".join([f"{s}\n" for s in fresh]).replace(BLANK, " "))
    return known.joined("\n")[0] + "," + ours != ",".join(map(str, theirs))


def agreeing(path: str, texts: list[str | None], found: list[tuple[str, int, str]]) -> list[bool]:
    """For each whole text, whether the library gives the same ids and decodes them to the same text."""
    asked = library(path)
    theirs = asked.encode([t or "" for t in texts], num_threads=1)
    back = asked.decode(theirs, num_threads=1)
    return [f[0] == ",".join(map(str, i)) and f[2] == d for f, i, d in zip(found, theirs, back)]


def round_trip(docs: DataFrame, path: str, text: str = "text", check: str = "segments") -> DataFrame:
    """docs with ``ids`` (decimal, joined by commas), ``n_tokens`` and ``decoded`` in place of the text.

    check: adds ``agrees``, whether the library gives the same. "segments" asks it for
    the segments that are new in an Arrow batch, and for its whole texts where one
    differs; "texts" asks for all whole texts and their decoding; "" asks nothing.
    """
    made = {"ids": ("string", pa.string()), "n_tokens": ("long", pa.int64()), "decoded": ("string", pa.string())}
    made |= {"agrees": ("boolean", pa.bool_())} if check else {}

    def run(texts: list[str | None]) -> dict[str, list]:
        known = vocabulary(path)
        found = [known.joined(t) for t in texts]
        fresh, known.known.fresh = known.known.fresh, {}
        out = {"ids": [f[0] for f in found], "n_tokens": [f[1] for f in found], "decoded": [f[2] for f in found]}
        if check:
            whole = check == "texts" or not known.lines or (fresh and differs(path, fresh))
            out["agrees"] = agreeing(path, texts, found) if whole else [True] * len(texts)
        return out

    return mapped(docs, text, made, run, lambda: vocabulary(path).known.forget()).drop(text)


def digests(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key, number of ids, digests of ids and decoded text of every whole text, and whether the library agrees."""
    out = round_trip(docs.select(key, "text"), path)
    return out.select(key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")
