"""Sets against sets in a grid of cells, without a row for any pair of them.

The left sets are cut into chunks and the right sets into blocks by hash, and every
chunk meets every block in a cell of bounded size, whatever the sets hold: a token of
all sets or a large group of copies makes no cell larger. In a cell the sets of the block
that hold a token are one list, and a frequent token is one line of marks, so that all
shared tokens of one left set and the block are counted by adding up a few arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Right sets of a block, tokens of a block, left sets of a chunk, and the most chunks: right sets are copied to each.
BLOCK, BLOCK_TOKENS, CHUNK, MOST_CHUNKS = 131_072, 8_000_000, 1024, 16
#: Cells that keep a cluster busy: with many blocks fewer chunks do.
CELLS = 64
#: A token in more than one of so many sets of a block has a line of marks.
FREQUENT = 32
#: Lists that hold more than one of so many sets together are no quicker than adding up all.
FEW = 8

#: What a cell keeps: number of a left set, right sets, shared tokens of each.
Kept = Iterator[tuple[int, np.ndarray, np.ndarray]]


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All tokens of a list column, and how many each row has."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


class Block:
    """The right sets of a cell by token, for the tokens of the cell's left sets."""

    def __init__(self, left: pa.ChunkedArray, right: pa.ChunkedArray):
        words, self.left_sizes = _flat(left)
        coded = words.dictionary_encode()
        self.words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.left_sizes)])
        tokens, self.right_sizes = _flat(right)
        codes = pc.index_in(tokens, value_set=coded.dictionary)
        met = codes.is_valid().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(self.right_sizes), dtype=np.int64), self.right_sizes)[met]
        keys = (codes.drop_null().to_numpy(zero_copy_only=False).astype(np.int64) << 32) | rows
        keys.sort()
        # a set is in a list once, however often it holds the token
        keys = keys[np.flatnonzero(np.diff(keys, prepend=-1))]
        bounds = np.searchsorted(keys, np.arange(len(coded.dictionary) + 1, dtype=np.int64) << 32)
        rows = (keys & 0xFFFFFFFF).astype(np.int32)
        self.lists = [rows[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        size = len(self.right_sizes)
        kind = np.uint8 if self.left_sizes.max(initial=0) < 256 else np.int32
        self.marks: dict[int, np.ndarray] = {}
        for token in np.flatnonzero(np.diff(bounds) * FREQUENT > size).tolist():
            line = np.zeros(size, dtype=np.uint8)
            line[self.lists[token]] = 1
            self.marks[token] = line
        self.shared = np.zeros(size, dtype=kind)

    def each(self, of: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Number of a left set, and its shared tokens with every right set; the array is used again."""
        shared, at, words = self.shared, self.at.tolist(), self.words.tolist()
        for i in range(len(self.left_sizes)) if of is None else of:
            shared[:] = 0
            for token in words[at[i] : at[i + 1]]:
                line = self.marks.get(token)
                if line is None:
                    shared[self.lists[token]] += 1
                else:
                    np.add(shared, line, out=shared)
            yield i, shared

    def top(self, n: int, least: np.ndarray) -> Kept:
        """The n right sets that share most with each left set, of those that share ``least`` tokens of it or more.

        A set that shares ``least`` of m tokens holds one of any m - least + 1, so only the
        lists of the rarest so many are read. Sets are looked up in the other lists, the
        rarer first, and dropped as soon as too few are left.
        """
        every: list[int] = []
        self.looked, size = 0, len(self.right_sizes)
        for i in range(len(self.left_sizes)):
            tokens = [t for t in self.words[self.at[i] : self.at[i + 1]].tolist() if len(self.lists[t])]
            tokens.sort(key=lambda t: len(self.lists[t]))
            need = max(1, int(least[i]))
            first = len(tokens) - need + 1
            if first < 1:
                continue
            read = [self.lists[t] for t in tokens[:first]]
            if sum(map(len, read)) * FEW > size:
                every.append(i)
                continue
            rows, shared = np.unique(np.concatenate(read), return_counts=True)
            self.looked += sum(map(len, read))
            for at in range(first, len(tokens)):
                if not len(rows):
                    break
                line = self.marks.get(tokens[at])
                shared = shared + (line[rows] if line is not None else _holds(self.lists[tokens[at]], rows))
                likely = shared >= need - (len(tokens) - at - 1)
                rows, shared = rows[likely], shared[likely]
            best = np.argsort(-shared, kind="stable")[:n]
            yield i, rows[best], shared[best]
        for i, shared in self.each(every):
            self.looked += size
            found = highest(shared, n)
            found = found[shared[found] >= max(1, int(least[i]))]
            yield i, found, shared[found].astype(np.int64)


def _holds(ordered: np.ndarray, rows: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, rows)
    at[at == len(ordered)] = 0
    return ordered[at] == rows


def highest(shared: np.ndarray, n: int) -> np.ndarray:
    """The n right sets that share most, the earlier ones of equals, best first; none that share nothing."""
    least = int(shared.max(initial=0))
    if not least:
        return np.empty(0, dtype=np.int64)
    while least > 1 and np.count_nonzero(shared >= least) < n:
        least -= 1
    above = np.flatnonzero(shared > least)
    above = above[np.argsort(-shared[above].astype(np.int64), kind="stable")]
    return np.concatenate([above, np.flatnonzero(shared == least)[: n - len(above)]])


def blocks_of(sets: int, tokens: int, block: int = BLOCK) -> int:
    return max(1, -(-sets // block), -(-tokens // BLOCK_TOKENS))


def in_cells(
    left: DataFrame, right: DataFrame, keys: tuple[str, str], sets: tuple[str, str],
    choose: Callable[[Block, pa.Table], Kept], block: int = BLOCK, chunk: int = CHUNK, cells: int | None = None,
) -> DataFrame:
    """``(left key, right key, shared)`` of the pairs that ``choose`` keeps, cell by cell.

    ``left(key, set)`` and ``right(key, set)`` hold arrays of distinct tokens and are read
    twice. Right sets of a cell are in the order of their keys; ``choose`` also gets the cell's
    left rows with their other columns. Where so many ``cells`` are enough, chunks are larger.
    """
    (l, r), (l_set, r_set) = keys, sets
    one = F.lit(1).cast("long")
    size = right.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(r_set)), one).alias("t")).first()
    blocks = blocks_of(size["n"], size["t"], block)
    most = MOST_CHUNKS if cells is None else min(MOST_CHUNKS, -(-cells // blocks))
    chunks = max(1, min(most, -(-left.count() // chunk)))
    pick = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lhs = left.select(pick(l, chunks).alias("_c"), all_of(blocks).alias("_b"), *left.columns)
    rhs = right.select(all_of(chunks).alias("_c"), pick(r, blocks).alias("_b"), r, r_set)
    kinds = dict(left.dtypes)[l], dict(right.dtypes)[r]

    def cell(lefts: pa.Table, rights: pa.Table) -> pa.Table:
        rights = rights.sort_by(r)
        chosen, counts, of = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if lefts.num_rows and rights.num_rows:
            for i, found, shared in choose(Block(lefts[l_set], rights[r_set]), lefts):
                chosen.append(found)
                counts.append(shared.astype(np.int64))
                of.append(np.full(len(found), i, dtype=np.int64))
        return pa.table({
            l: lefts[l].take(pa.array(np.concatenate(of))), r: rights[r].take(pa.array(np.concatenate(chosen))),
            "shared": pa.array(np.concatenate(counts).astype(np.int32)),
        })

    return lhs.groupBy("_c", "_b").cogroup(rhs.groupBy("_c", "_b")).applyInArrow(
        cell, f"`{l}` {kinds[0]}, `{r}` {kinds[1]}, shared int"
    )
