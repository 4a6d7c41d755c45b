"""Byte-level BPE encoding and decoding from a rank file.

A word (a match of the split pattern) starts as its bytes; the adjacent pair whose
concatenation has the lowest rank is merged, leftmost first, until none has a rank. Words
do not affect each other, so every distinct word is folded once per task and remembered.
Decoding concatenates the binary piece of each id.

``fold_merges`` states the same fold with Spark's higher-order functions and a literal rank
map, for tables of distinct words. On whole corpora it is not the main path: joining the
words' ids back to a corpus shuffles every word of every text (see README for figures), so
``encode`` folds the distinct words where the texts are.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from contextlib import suppress
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import Memo, id_type, let, slices


class _Edge(Exception):
    """White space at the end of a part."""


_loaded: dict[tuple[str, str], BpeCoder] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank of every pair of pieces (by their ranks, packed into one number) whose bytes together have one."""
    return {a << 17 | b: r for piece, r in ranks.items() for i in range(1, len(piece)) if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None}


class BpeCoder:
    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern = read_ranks(path), regex.compile(pattern)
        self.bytes, self.pairs = [self.ranks[bytes([b])] for b in range(256)], pair_ranks(self.ranks)
        self.words, self.spaced = Memo(self._word, 24 << 20), Memo(self._spaced, 24 << 20)

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return array("i", (whole,)).tobytes()
        return array("i", self.merge_long(raw) if len(raw) > 64 else self.merge(raw)).tobytes()

    def merge(self, word: bytes) -> list[int]:
        """Ranked merges of one word, the ranks of its neighbours in a list."""
        ids, pairs = [self.bytes[b] for b in word], self.pairs
        never = 1 << 30
        best = [pairs.get(a << 17 | b, never) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while best and (low := min(best)) != never:
            i = best.index(low)
            ids[i : i + 2] = (low,)  # an id is its piece's rank
            del best[i]
            if i < len(best):
                best[i] = pairs.get(low << 17 | ids[i + 1], never)
            if i:
                best[i - 1] = pairs.get(ids[i - 1] << 17 | low, never)
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        """The same by a heap of pairs over a linked list: n log n for words of any length."""
        ids, pairs = [self.bytes[b] for b in word], self.pairs
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 17 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of them was merged meanwhile
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := pairs.get(ids[k] << 17 | ids[after[k]])) is not None:
                    heappush(heap, (r, k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]

    def _spaced(self, part: str) -> bytes:
        """Ids of a space and the part after it, which must have no white space at its ends."""
        if part.isalpha():
            return self.words[" " + part]
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Edge
        if part[-1] in ".,;:!?" and part[:-1].isalpha():
            return self.words[" " + part[:-1]] + self.words[part[-1]]
        return self.split(" " + part)

    def split(self, text: str) -> bytes:
        words = self.words
        return b"".join([words[w] for w in self.pattern.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit ints.

        A single space between two characters that are not white space always starts a
        match, so what lies between such spaces is encoded (and remembered) by itself;
        stretches with other white space beside a space are split as a whole.
        """
        head, *parts = text.split(" ")
        spaced = self.spaced
        if head and not head[-1].isspace():
            with suppress(_Edge):
                return self.split(head) + b"".join([spaced[p] for p in parts])
        out, held = [], [head]
        for p in parts:
            if p and held[-1] and not held[-1][-1].isspace() and not p[0].isspace():
                out.append(self.split(" ".join(held)))
                held = [" " + p]
            else:
                held.append(p)
        return b"".join([*out, self.split(" ".join(held))])


def coder(path: str, pattern: str) -> BpeCoder:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = BpeCoder(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text, without special tokens.

    A null text is empty, an empty text has no ids. One row per input row, nulls and
    repeats among the ids included; other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kinds = StructType.fromDDL(f"_id {id_type(src, '_id')}, ids array<int>")
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for b in slices(batches):
            coded = [bpe.encode(t) if t else b"" for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")), type=arrow.field(1).type)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow.field(0).type), ids], schema=arrow)

    return src.mapInArrow(run, kinds).withColumnRenamed("_id", id_col)


def decode(coded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ("ids",)) -> DataFrame:
    """(id, kept columns, decoded): the bytes of every list of ids, its binary pieces concatenated.

    A null or empty list gives empty bytes; a null or unknown id in a list is an error.
    """
    src = coded.select(F.col(id_col).alias("_id"), *keep, F.col(ids_col).alias("_ids"))
    kinds = StructType([*src.schema.fields[:-1]]).add("decoded", "binary")
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        flat, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
        starts = np.cumsum(sizes) - sizes
        for b in slices(batches):
            out = []
            for ids in b.column(b.num_columns - 1):
                i = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int32)
                n = sizes[i]
                out.append(flat[np.repeat(starts[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes())
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns[:-1], arrow, strict=False)] + [pa.array(out, arrow.field("decoded").type)], schema=arrow)

    return src.mapInArrow(run, kinds).withColumnRenamed("_id", id_col)


def _literal(values, kind: str) -> Column:
    """A constant array; Catalyst folds the parsing away."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), f"array<{kind}>")


class RankMap:
    """Ranks of token pairs as literal arrays with constant-time lookup (Spark's own map literals are scanned).

    Pairs hash to a bucket, the bucket's displacement to a slot of its own, which packs pair and rank.
    """

    SLOTS, BUCKETS, MULT, SPREAD = 1 << 18, 1 << 15, 0x5BD1E995, 0x7FEB352D

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {(k >> 17) << 16 | k & 0x1FFFF: r for k, r in pair_ranks(ranks).items()}
        buckets: dict[int, list[int]] = {}
        for pair in pairs:
            buckets.setdefault((pair * self.MULT >> 17) % self.BUCKETS, []).append(pair)
        slots, moves = [-1] * self.SLOTS, [0] * self.BUCKETS
        for bucket, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            at = [(p * self.SPREAD >> 13) % self.SLOTS for p in members]
            if len(set(at)) < len(at):
                raise ValueError("two pairs share both hashes; change a multiplier")
            while any(slots[a ^ moves[bucket]] >= 0 for a in at):
                moves[bucket] += 1
            for a, p in zip(at, members, strict=True):
                slots[a ^ moves[bucket]] = p << 17 | pairs[p]
        self.slots, self.moves = _literal(slots, "bigint"), _literal(moves, "int")
        self.bytes = _literal([ranks[bytes([i])] for i in range(256)], "int")

    def rank(self, a: Column, b: Column) -> Column:
        big = lambda n: F.lit(n).cast("long")

        def found(pair: Column) -> Column:
            move = F.get(self.moves, F.shiftright(pair * big(self.MULT), 17).bitwiseAND(big(self.BUCKETS - 1)).cast("int"))
            slot = F.shiftright(pair * big(self.SPREAD), 13).bitwiseAND(big(self.SLOTS - 1)).cast("int").bitwiseXOR(move)
            return let(F.get(self.slots, slot), lambda v: F.when(F.shiftright(v, 17) == pair, v.bitwiseAND(big((1 << 17) - 1)).cast("int")))

        return let(F.shiftleft(a.cast("long"), 16).bitwiseOR(b.cast("long")), found)


def fold_merges(word_bytes: Column, ranks: RankMap) -> Column:
    """Token ids of a word given as an array of its byte values (0-255), by higher-order functions alone."""

    def step(acc: Column, _: Column) -> Column:
        def merged(rank_of: Column) -> Column:
            def at(best: Column) -> Column:
                joined = lambda p: F.concat(F.slice(acc["ids"], F.lit(1), p - 1), F.array(best), F.slice(acc["ids"], p + 2, F.size(acc["ids"])))
                cut = lambda p: F.struct(joined(p).alias("ids"), F.lit(False).alias("done"))
                return F.when(best.isNull(), F.struct(acc["ids"].alias("ids"), F.lit(True).alias("done"))).otherwise(let(F.array_position(rank_of, best).cast("int"), cut))

            return let(F.array_min(rank_of), at)

        pairs = F.transform(acc["ids"], lambda x, i: F.when(i + 1 < F.size(acc["ids"]), ranks.rank(x, F.get(acc["ids"], i + 1))))
        return F.when(acc["done"], acc).otherwise(let(pairs, merged))

    ids = F.transform(word_bytes, lambda c: F.get(ranks.bytes, c))
    start = F.struct(ids.alias("ids"), F.lit(False).alias("done"))
    return F.when(F.size(word_bytes) < 2, ids).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(word_bytes)), start, step, lambda s: s["ids"]))
