"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree hold the merge rank of each adjacent pair of symbols, an
inner node the smaller of its children, so the root is the leftmost pair of the
lowest rank. A merge changes three leaves, each in logarithmic time, until the
root says that no pair can merge. A word of n symbols takes O(n log n) however
long it is. The trees of the new words of a batch stand side by side in one array
and take their merges in step; a long word has a tree of its own.

The vocabulary is a tokenizer file of public format, named by its path; every
executor must see it there. Its normalisation (composed form, lower case) and
splitting rules (contractions, letter runs, single digits, other runs) are those
of word-end vocabularies. Special tokens in a text become their own ids.

Defined results: a null or empty text has no tokens and decodes to the empty
text; other columns pass through; repeated rows are encoded each.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.hashed import few, mapped, tidied

SHIFT = 24
MASK = (1 << SHIFT) - 1
NONE = 1 << 62
#: Encoded pieces between blanks kept per Python worker in each of two generations: when the younger is full, it becomes the older.
KEPT_PIECES = 100_000
#: Words whose trees are in one array, and the most symbols of such a word.
SIDE_BY_SIDE, SHORT = 8192, 64
#: Rows handled at once, so that texts, ids and copies of few rows are held.
ROWS = 256
#: Longer pieces are encoded but not kept.
KEPT_LENGTH = 64
#: Fixed rule of the vocabulary family: contractions, letter runs, single digits, other runs.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    place = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [place[b] for b in range(256)]


def merge(symbols: list[int], pairs: dict[int, int]) -> list[int]:
    """Merge adjacent symbols, lowest rank first, ties leftmost.

    pairs: ``rank << SHIFT | merged symbol`` by ``left symbol << SHIFT | right symbol``.
    Node 1 of the tree is its root, the leaves begin at node ``leaves``.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    symbols, get = [*symbols], pairs.get
    leaves = 1 << (n - 2).bit_length()
    tree = [NONE] * (2 * leaves)
    for i in range(n - 1):
        tree[leaves + i] = get(symbols[i] << SHIFT | symbols[i + 1], NONE)
    for i in range(leaves - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (low := tree[1]) != NONE:
        # the leftmost leaf that holds the root's value
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] != low:
                at += 1
        i = at - leaves
        j = after[i]
        made = symbols[i] = low & MASK
        symbols[j] = -1
        after[i] = k = after[j]
        tree[at] = NONE
        if k < n:
            before[k] = i
            tree[at] = get(made << SHIFT | symbols[k], NONE)
            other = j + leaves
            tree[other] = NONE
            while other > 1:
                a, b = tree[other], tree[other ^ 1]
                other >>= 1
                a = a if a <= b else b
                if tree[other] == a:
                    break
                tree[other] = a
        h = before[i]
        if h >= 0:
            other = h + leaves
            tree[other] = get(symbols[h] << SHIFT | made, NONE)
            while other > 1:
                a, b = tree[other], tree[other ^ 1]
                other >>= 1
                a = a if a <= b else b
                if tree[other] == a:
                    break
                tree[other] = a
        while at > 1:
            a, b = tree[at], tree[at ^ 1]
            at >>= 1
            a = a if a <= b else b
            if tree[at] == a:
                break
            tree[at] = a
    return [s for s in symbols if s >= 0]


def merge_all(symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """merge for many short words at once: the symbols that are left of all, and how many of each word.

    symbols: those of all words in a row; sizes: how many each has. keys and made: the pairs
    of merge as sorted arrays. Each step merges one pair of every word that has one.
    """
    words, leaves = len(sizes), 1 << max(1, int(sizes.max(initial=0)) - 1).bit_length()
    wide, nodes = leaves + 1, 2 * leaves

    def rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        asked = left << SHIFT | right
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, made[at], NONE)

    # column sizes[i] of row i and those behind it stay -1, which is in no pair
    held = np.full((words, wide), -1, np.int64)
    held[np.arange(wide) < sizes[:, None]] = symbols
    tree = np.full((words, nodes), NONE, np.int64)
    if len(keys):
        tree[:, leaves:] = rank(held[:, :-1], held[:, 1:])
    low = leaves // 2
    while low:
        np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2], out=tree[:, low : 2 * low])
        low //= 2
    after = np.tile(np.arange(1, wide + 1), words)
    before = np.tile(np.arange(-1, wide - 1), words)
    held, tree = held.ravel(), tree.ravel()
    open_ = np.flatnonzero(tree[1::nodes] != NONE)
    while len(open_):
        row, root = open_ * wide, open_ * nodes
        least = tree[root + 1]
        # the leftmost leaf that holds the root's value
        at = np.ones(len(open_), np.int64)
        while at[0] < leaves:
            at *= 2
            at += tree[root + at] != least
        i = at - leaves
        j = after[row + i]
        k = after[row + j]
        h = before[row + i]
        joined = least & MASK
        held[row + i] = joined
        held[row + j] = -1
        after[row + i] = k
        before[row + k] = i
        tree[root + at] = rank(joined, held[row + k])
        tree[root + leaves + j] = NONE
        # a first symbol has no pair before it: its own leaf stands in
        first = h < 0
        ahead = np.where(first, at, h + leaves)
        tree[root + ahead] = np.where(first, tree[root + at], rank(held[row + np.where(first, 0, h)], joined))
        ways = np.concatenate((at, leaves + j, ahead))
        roots = np.concatenate((root, root, root))
        while ways[0] > 1:
            ways >>= 1
            left = roots + 2 * ways
            tree[roots + ways] = np.minimum(tree[left], tree[left + 1])
        open_ = open_[tree[root + 1] != NONE]
    stays = held >= 0
    return held[stays], stays.reshape(words, wide).sum(axis=1)


class Pieces(dict):
    """What pieces of text encode to, in two generations."""

    def __init__(self, most: int):
        self.most, self.older = most, {}

    def learn(self, pieces: set[str], encode: Callable[[list[str]], list]) -> None:
        """From now until the next call, each of the pieces is there; new ones are encoded at once."""
        if len(self) >= self.most:
            self.older.clear()
            self.older.update((p, made) for p, made in self.items() if len(p) <= KEPT_LENGTH)
            self.clear()
        new = []
        for piece in pieces.difference(self):
            if (known := self.older.get(piece)) is None:
                new.append(piece)
            else:
                self[piece] = known
        self.update(zip(new, encode(new)))

    def known(self, piece: str) -> tuple[bytes, str] | None:
        return self.get(piece) or self.older.get(piece)

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Vocabulary:
    """Symbols, merges and special tokens of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pairs.setdefault(self.ids[a] << SHIFT | self.ids[b], rank << SHIFT | self.ids[a + b])
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        alphabet = byte_alphabet()
        self.inner = [self.ids.get(c, -1) for c in alphabet]
        self.last = [self.ids.get(c + self.end, -1) for c in alphabet]
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.words = regex.compile(WORDS)
        self.first_symbols, self.last_symbols = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        self.kept = Pieces(KEPT_PIECES)

    def forget(self) -> None:
        """Lets go of what was encoded, at the end of a task."""
        self.kept.forget()

    def encoded(self, pieces: list[str]) -> list[tuple[bytes, str]]:
        """Packed ids of the words of each piece and the text they decode to; no word crosses a blank."""
        # letters alone are one word
        parts = [None if piece.isalpha() else self.words.findall(piece) for piece in pieces]
        words = {w for some in parts if some for w in some}
        words.update([piece for piece, some in zip(pieces, parts) if some is None])
        # a word that was a piece of its own need not be merged again
        known = {w: made for w in words if (made := self.kept.known(w))}
        known |= self.word_ids([w for w in words if w not in known])
        out = []
        for piece, some in zip(pieces, parts):
            if some is None:
                out.append(known[piece])
            else:
                made = [known[w] for w in some]
                out.append((b"".join([x[0] for x in made]), " ".join([x[1] for x in made if x[0]])))
        return out

    def word_ids(self, words: list[str]) -> dict[str, tuple[bytes, str]]:
        """Ids of words as packed little-endian unsigned 32-bit integers, and the texts they decode to."""
        data = [w.encode("utf-8", "replace") for w in words]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        # words of like length stand together, so that no tree is much too wide
        order = np.argsort(lengths, kind="stable")
        inside = int(np.searchsorted(lengths[order], SHORT, "right"))
        out = {}
        for i in order[inside:].tolist():
            ids = self.long_word(data[i])
            out[words[i]] = ids, self.decode(ids)
        # trees of 2, 4, 8, .. leaves
        steps = np.searchsorted(lengths[order[:inside]], [1 << k for k in range(1, SHORT.bit_length())], "right")
        bounds = sorted({*range(0, inside, SIDE_BY_SIDE), *steps.tolist(), inside})
        for low, high in zip(bounds, bounds[1:]):
            some = order[low:high].tolist()
            sizes = lengths[some]
            codes = np.frombuffer(b"".join([data[i] for i in some]), np.uint8)
            symbols = self.first_symbols[codes]
            ends = np.cumsum(sizes) - 1
            symbols[ends] = self.last_symbols[codes[ends]]
            if (symbols < 0).any():
                # bytes without a symbol have no part in their word
                sizes = np.add.reduceat(symbols >= 0, ends - sizes + 1, dtype=np.int64)
                symbols = symbols[symbols >= 0]
            left, counts = merge_all(symbols, sizes, self.keys, self.made)
            packed, tokens, at = left.astype("<u4").tobytes(), list(map(self.texts.__getitem__, left.tolist())), 0
            for i, n in zip(some, counts.tolist()):
                out[words[i]] = packed[4 * at : 4 * (at + n)], " ".join(tokens[at : at + n])
                at += n
        return out

    def long_word(self, data: bytes) -> bytes:
        ids = [self.inner[b] for b in data[:-1]]
        ids.append(self.last[data[-1]])
        return array("I", merge([i for i in ids if i >= 0], self.pairs)).tobytes()

    def pieces(self, text: str | None) -> list[list[str]]:
        """The pieces of a whole text: a list of those between blanks and one with a special token by turns."""
        if not text:
            return []
        out = self.marks.split(text) if self.marks else [text]
        # each character lowers on its own: a final sigma is not special
        return [[part] if k % 2 else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower().replace("\n", " ").split(" ") if part else [] for k, part in enumerate(out)]

    def all(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Packed ids of whole texts and the texts they decode to, by one look-up a piece."""
        # copies of a text, which a mix puts side by side, are encoded once
        distinct = list(dict.fromkeys(texts))
        split = [self.pieces(t) for t in distinct]
        self.kept.learn(set().union(*[part for parts in split for part in parts[::2]]), self.encoded)
        known, made = self.kept.__getitem__, []
        for parts in split:
            out: list[tuple[bytes, str]] = []
            for k, part in enumerate(parts):
                if k % 2:
                    out.append((self.special[part[0]].to_bytes(4, "little"), part[0]))
                else:
                    out += map(known, part)
            made.append((b"".join([x[0] for x in out]), " ".join([x[1] for x in out if x[0]])))
        by_text = dict(zip(distinct, made))
        return [by_text[t] for t in texts]

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a whole text."""
        return self.all([text])[0][0]

    def decode(self, ids: bytes | None) -> str:
        """Tokens of packed ids, joined by blanks as a file without decoder asks for; special tokens stay, unknown ids go."""
        if not ids:
            return ""
        tokens = memoryview(ids).cast("I")
        try:
            return " ".join(map(self.texts.__getitem__, tokens))
        except KeyError:
            return " ".join([self.texts[i] for i in tokens if i in self.texts])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _mapped(df: DataFrame, name: str, kind: str, of: str, arrow: pa.DataType, path: str, method: str) -> DataFrame:
    """df with column name made by a method of the vocabulary from column of; replaces a column of that name."""
    place = df.columns.index(of)
    taken = [c.lower() for c in df.columns]
    kept = [i for i, c in enumerate(taken) if c != name.lower()]
    plain = df.toDF(*[f"c{i}" for i in range(len(taken))])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for i, f in enumerate(plain.schema) if i in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = getattr(vocabulary(path), method)
        for batch in few(batches, ROWS):
            made = pa.array([call(x.as_py()) for x in batch.column(place)], arrow)
            columns = [batch.column(i) for i in kept]
            yield pa.RecordBatch.from_arrays([*columns, made], [*(f"c{i}" for i in kept), "made"])

    out = plain.mapInArrow(lambda batches: tidied(run(batches), lambda: vocabulary(path).forget()), f"{fields}{', ' if fields else ''}`made` {kind}")
    return out.toDF(*[df.columns[i] for i in kept], name)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column of packed ids (little-endian unsigned 32-bit) of every whole text."""
    return _mapped(docs, ids, "binary", text, pa.binary(), path, "encode")


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the text that packed ids stand for."""
    return _mapped(docs, decoded, "string", ids, pa.string(), path, "decode")


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode and decode in one pass, so that a task needs one Python worker: docs with both columns in place of the text."""

    def run(texts: list[str | None]) -> dict[str, list]:
        made = vocabulary(path).all(texts)
        return {ids: [m[0] for m in made], decoded: [m[1] for m in made]}

    return mapped(docs, text, {ids: ("binary", pa.binary()), decoded: ("string", pa.string())}, run, lambda: vocabulary(path).forget()).drop(text)


def n_tokens(ids: str = "ids"):
    """Number of tokens in a column of packed ids."""
    return (F.octet_length(ids) / 4).cast("long")
