"""Packing token sequences: bounded-space online best fit.

Each partition tokenizes its documents and keeps a fixed number of open windows. A document
gives full windows of its own and a rest; the rest goes to the open window that it fits most
tightly. If it fits none, the fullest window is emitted: if it still has more than
``max_gap`` free, the head of the rest tops it up first (documents may be cut freely). The
windows left open at the end of a partition go, tokens and all, through one shuffle to
fewer merging tasks, which refill them one after the other. Memory is bounded by the open
windows and one document; no sequence number or window needs another partition.
"""

from __future__ import annotations

import json
import os
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, id_type, map_rows, materialize

_PIECES = "_id {id}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean"
_tokenizers: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """A lower-casing word tokenizer file, with white-space words and their parts remembered.

    The file's own steps (NFC, lower case, split into letter runs, single digits and other
    runs, white space dropped) treat each white-space word alone, so a text's ids are those
    of its words in order. A new word is split here by the file's pattern and only new parts
    go through the model; words with letters beyond Latin go through the whole tokenizer.
    Strings of special tokens in a text are ordinary text. Ids are kept as little-endian
    unsigned 32-bit bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        steps = json.loads(self.tok.to_str())
        self.pattern = regex.compile(steps["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.spelling = {b: 256 + i for i, b in enumerate(hidden)}  # one printable character a byte
        self.words, self.parts = Memo(self._word, 68 << 20), Memo(self._part, 24 << 20)

    def _part(self, part: str) -> bytes:
        spelt = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.spelling)
        return array("I", [t.id for t in self.tok.model.tokenize(spelt)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if not text.isascii() and max(text) >= "\u0250":
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        text = text.lower()
        if text.isalpha():
            return self.parts[text]
        if text[-1] in ".,;:!?" and text[:-1].isalpha():
            return self.parts[text[:-1]] + self.parts[text[-1]]
        return b"".join([self.parts[p] for p in self.pattern.findall(text)])

    def encode(self, text: str) -> bytes:
        words = self.words
        return b"".join([words[w] for w in text.encode("utf-8", "replace").split()])


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Windows:
    """A fixed number of open windows, kept sorted by their fill."""

    def __init__(self, size: int, most: int, max_gap: int, task: int):
        self.size, self.most, self.max_gap, self.next = size, most, max_gap, task << 33
        self.open: list[tuple[int, int]] = []  # (fill, number), ascending
        self.held: dict[int, list] = {}
        self.out: list[tuple] = []

    def emit(self, pieces: list, still_open: bool = False) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, total, self.next, offset, ids, still_open))
            offset += n
        self.next += 1

    def put(self, doc, start: int, total: int, ids: bytes) -> None:
        """Place a piece shorter than a window."""
        n = len(ids) // 4
        at = bisect_left(self.open, (self.size - n + 1, -1)) - 1  # the fullest that still has room
        if at >= 0:
            fill, number = self.open.pop(at)
            self.held[number].append((doc, start, total, ids))
            return self._keep(fill + n, number)
        if len(self.open) < self.most:
            number = self.next
            self.next += 1
            self.held[number] = [(doc, start, total, ids)]
            return self._keep(n, number)
        fill, number = self.open.pop()
        gap = self.size - fill
        pieces = self.held.pop(number)
        if gap > self.max_gap:
            pieces.append((doc, start, total, ids[: 4 * gap]))
            start, ids = start + gap, ids[4 * gap :]
        self.emit(pieces)
        self.put(doc, start, total, ids)

    def _keep(self, fill: int, number: int) -> None:
        if fill == self.size:
            self.emit(self.held.pop(number))
        else:
            insort(self.open, (fill, number))

    def add(self, doc, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.size
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self.emit([(doc, at // 4, total, ids[at : at + step])])
        if whole < len(ids):
            self.put(doc, whole // 4, total, ids[whole:])

    def rest(self) -> None:
        for _, number in self.open:
            self.emit(self.held[number], still_open=True)
        self.open, self.held = [], {}

    def taken(self) -> list[list]:
        out, self.out = self.out, []
        return [list(c) for c in zip(*out, strict=True)] or [[] for _ in range(8)]


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2, open_windows: int = 64, max_gap: int = 16, merge_rows: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens.

    Returns one row per piece: id, start (the document's tokens before it), length,
    doc_tokens (with ``end_id``), sequence_id, offset (in the sequence, without gaps),
    ids (binary: little-endian unsigned 32-bit token ids). Every token lies in exactly one
    piece. A null or empty text is the end id alone; repeated rows are packed each; rows
    with a null id keep it. Ties between equally full windows go to the one opened last.
    Which documents share a sequence depends on how the input is partitioned.
    Other columns are not read; an empty table gives no rows.
    """
    end = np.array([end_id], "<u4").tobytes()
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = _PIECES.format(id=id_type(src, "_id"))

    def first(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        tok, win = tokenizer(tokenizer_path), Windows(size, open_windows, max_gap, TaskContext.get().partitionId())
        for b in batches:
            for doc, text in zip(*b, strict=True):
                win.add(doc, (tok.encode(text) if text else b"") + end)
                if len(win.out) >= 2000:
                    yield win.taken()
            yield win.taken()
        win.rest()
        yield win.taken()

    packed = materialize(map_rows(src, first, kind), "packed")
    done, left = packed.where("NOT open"), packed.where("open")
    # a merging task takes the open windows of many partitions; their number only grows with that of partitions
    tasks = max(1, left.count() // merge_rows)

    def merge(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        win = Windows(size, 1, 0, (1 << 28) + TaskContext.get().partitionId())
        for b in batches:
            for doc, start, _, total, _, _, ids, _ in zip(*b, strict=True):
                fill(win, doc, start, total, ids)
            yield win.taken()
        win.rest()
        yield win.taken()

    def fill(win: Windows, doc, start: int, total: int, ids: bytes) -> None:
        win.put(doc, start, total, ids) if len(ids) < 4 * size else win.emit([(doc, start, total, ids)])

    merged = map_rows(left.repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id", "offset"), merge, kind)
    return done.unionByName(merged).drop("open").withColumnRenamed("_id", id_col)
