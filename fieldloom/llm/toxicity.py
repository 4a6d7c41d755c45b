"""Toxicity by multiple-instance learning.

Only documents are labelled, but a few sentences make a document toxic. A document is a bag
of sentences; each sentence has a logistic score over its words, and a document is toxic
with probability 1 - prod(1 - p) (noisy-or). Training from document labels alone therefore
learns which sentences offend, and scoring reports where they are. Words count by
themselves and by their beginnings, so that inflected or unseen forms of a stem are known.

The fit uses a bounded, documented sample of labelled rows in one task; its model is a
bounded weight table. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_type, map_rows, materialize

_SENTENCE = re.compile(r"[^.!?\n]+")
CACHE_WORDS = 300_000


def _in_word(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def word_features(token: str) -> list[str]:
    """The bare lower-case word and its beginnings of 3 to 8 letters."""
    word = token.lower()
    a, b = 0, len(word)
    while a < b and not _in_word(word[a]):
        a += 1
    while a < b and not _in_word(word[b - 1]):
        b -= 1
    word = word[a:b]
    return ["=" + word, *(word[:n] for n in range(3, 9) if n <= len(word))] if word else []


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans between full stops, question and exclamation marks and line ends."""
    return (m.span() for m in _SENTENCE.finditer(text))


def _telling(seen: tuple[Counter, Counter], n: tuple[int, int], least: float) -> dict[str, int]:
    """Features whose documents are label 1 more often than chance would have it (signed root of G2), numbered in order."""
    kept = []
    for f, a in seen[1].items():
        b = seen[0][f]
        at_chance = (a + b) * n[1] / (n[0] + n[1]), (a + b) * n[0] / (n[0] + n[1])
        g2 = 2 * sum(o * math.log(o / e) for o, e in zip((a, b), at_chance, strict=True) if o)
        if a > at_chance[0] and g2 >= least * least:
            kept.append(f)
    return {f: i for i, f in enumerate(sorted(kept))}


def fit_bags(texts: list[str], labels: list[int], least: float = 4.0, rounds: int = 300, rate: float = 0.15, decay: float = 1e-4, shares: tuple[float, float] | None = None) -> dict[str, float]:
    """Feature weights (bias under "") that maximize the noisy-or likelihood; full-batch Adam, no randomness.

    ``shares``: documents with label 0 and 1 that the texts stand for; texts are weighted to these.

    Only features that tell toxic documents from others beyond chance are weighted, as a
    rare word of a single toxic document would fit that document and nothing else.
    """
    seen = Counter(), Counter()
    bags = []
    for text, label in zip(texts, labels, strict=True):
        bag = [s for s in ({t for t in text[a:b].split()} for a, b in sentences(text)) if s]
        bags.append(bag)
        seen[label].update({f for t in set().union(*bag) for f in word_features(t)})
    index = _telling(seen, (labels.count(0), labels.count(1)), least)
    words: dict[str, int] = {}
    word_rows: list[int] = []
    word_cols: list[int] = []
    flat: list[int] = []
    ends: list[int] = []
    owner: list[int] = []
    for d, bag in enumerate(bags):
        for s in bag:
            for t in sorted(s):
                if t not in words:
                    words[t] = len(words)
                    for f in word_features(t):
                        if f in index:
                            word_rows.append(words[t])
                            word_cols.append(index[f])
                flat.append(words[t])
            ends.append(len(flat))
            owner.append(d)
    y, who = np.array(labels, float), np.array(owner, int)
    each = np.ones(len(y))
    if shares:
        each = np.where(y > 0, shares[1] / labels.count(1), shares[0] / labels.count(0)) * len(y) / sum(shares)
    wr, wc, fl = np.array(word_rows, int), np.array(word_cols, int), np.array(flat, int)
    sent = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
    weights, bias = np.zeros(len(index)), -4.0
    m, v, mb, vb = np.zeros(len(index)), np.zeros(len(index)), 0.0, 0.0
    for i in range(1, rounds + 1):
        value = np.bincount(wr, weights[wc], len(words))
        z = bias + np.bincount(sent, value[fl], len(ends))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        total = np.bincount(who, np.logaddexp(0, z), len(y))
        dz = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0)[who] * p * each[who]
        per_word = np.bincount(fl, dz[sent], len(words))
        g = np.bincount(wc, per_word[wr], len(index)) / len(y) + decay * weights
        gb = dz.sum() / len(y)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**i, 1 - 0.999**i
        weights = weights - rate * (m / c1) / (np.sqrt(v / c2) + 1e-4)
        bias -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-4)
    keep = np.flatnonzero(np.abs(weights) > 1e-3)
    names = list(index)
    return {names[i]: float(weights[i]) for i in keep} | {"": float(bias)}


class Scorer:
    def __init__(self, model: dict[str, float]):
        self.model, self.bias = model, model.get("", -4.0)
        self.known: set[str] = set()
        self.weighted: dict[str, float] = {}
        self.plain = math.log1p(math.exp(self.bias))

    def meet(self, tokens: set[str]) -> None:
        if len(self.known) + len(tokens) > CACHE_WORDS:
            self.known.clear()
            self.weighted.clear()
        self.known |= tokens
        for t in tokens:
            if v := sum(self.model.get(f, 0.0) for f in word_features(t)):
                self.weighted[t] = v

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability and the spans of sentences that are toxic rather than not."""
        miss, spans = 0.0, []
        for a, b in sentences(text or ""):
            tokens = set(text[a:b].split())
            if not tokens:
                continue
            if not tokens <= self.known:
                self.meet(tokens - self.known)
            hits = tokens & self.weighted.keys()
            if not hits:
                miss += self.plain
                continue
            z = min(self.bias + sum(self.weighted[t] for t in sorted(hits)), 30.0)
            miss += math.log1p(math.exp(z))
            if z >= 0:
                spans.append((a, b, 1 / (1 + math.exp(-z))))
        return -math.expm1(-miss), spans


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 2000, max_other: int = 4000, max_chars: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[str, float]:
    """Fit on at most ``max_toxic`` documents labelled 1 and ``max_other`` labelled 0, of any length, ``max_chars`` characters of each label in all.

    The sample is the documents of smallest hashed id, so it does not depend on
    partitioning, and is weighted to the share of the labels among all labelled documents.
    The first document of a label is taken at any length. Of two labels of one id the
    greater counts. Rows with a null text, id or label are left out. Without one label of
    each kind the model is a constant.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    there = materialize(src.groupBy("_id").agg(F.max(F.length("_text")).alias("_n")).join(known, "_id"), "toxic-labelled")  # ids and lengths only: no text is shuffled
    total = {r[0]: r[1] for r in there.groupBy("_y").count().collect()}
    shares = (float(total.get(0, 0)), float(total.get(1, 0)))
    so_far = F.sum("_n").over(Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, -1))

    def pick(y: int, most: int) -> DataFrame:
        first = there.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        return first.withColumn("_before", so_far).where(F.col("_before").isNull() | (F.col("_before") + F.col("_n") <= max_chars)).select("_id", "_y")

    chosen = pick(0, max_other).unionByName(pick(1, max_toxic))  # max_other + max_toxic rows at most, hence the broadcast
    rows = src.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).select("_id", "_text", "_y")

    def train(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        texts, ys = [], []
        for _, t, y in batches:
            texts += t
            ys += y
        model = fit_bags(texts, ys, shares=shares) if len(set(ys)) == 2 else {"": -4.0}
        yield [list(model), list(model.values())]

    sample = rows.coalesce(1).sortWithinPartitions("_id")
    return {r[0]: r[1] for r in map_rows(sample, train, "feature string, weight double").collect()} or {"": -4.0}


def score(docs: DataFrame, model: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans): probability of label 1 and the offending sentences of every whole text.

    spans: array of (start, end, score), code point offsets of sentences scored 0.5 or
    more. Null and empty texts have score 0 and no spans. One row per input row.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's sample

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        scorer = Scorer(shared.value)
        for ids, texts in batches:
            got = [scorer.score(t) for t in texts]
            yield [ids, [g[0] for g in got], [[{"start": a, "end": b, "score": p} for a, b, p in g[1]] for g in got]]

    return map_rows(src, run, f"_id {id_type(src, '_id')}, score double, spans array<struct<start:int,end:int,score:double>>").withColumnRenamed("_id", id_col)
