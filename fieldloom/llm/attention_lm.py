"""Language-model scores of texts: causal self-attention over subword ids, together with word counts of the whole corpus.

Words (A-Z lower-cased, an end after the last one) become subword ids by the first merges of
a public byte-level vocabulary, so that every text has ids. The attention model, trained
here in numpy, gives each id a probability from the ids before it. A text is scored in
overlapping windows: the first ids of a window only give context, each of the others is
scored in this window and no other, and windows of many texts go through masked attention as
one batch. The next id's probability is that of its class, that of a part of the class and
that within the part, so the cost of a large vocabulary is three small softmax layers.

A word's probability is that of its ids in a row, mixed with its share of all training words:
attention knows how words are spelt and what they follow, the counts know every word of the
corpus. How much the counts weigh is fitted on stretches of text that attention was not
trained on, each word counted without itself. Counts are summed per task and then by word. Words that are frequent
(``HEAD`` at most) go to every task; all others of a text join their counts in Spark, word by
word, so nothing is left out and the tables grow with the corpus.

Training takes all training text: one stretch in twenty, drawn by the text's hash, fits the
weight of the counts, all others the attention model, once or as often as makes ``LEAST``
windows. Windows are dealt to shards, up to ``ROW_WINDOWS`` of a text together, each shard steps from the same weights over its windows,
and Spark averages the shards' weights entry by entry before the next round.
"""

from __future__ import annotations

import base64
import math
import os
from collections import Counter
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

#: Ids: the vocabulary's first merges and the end. FAN classes of FAN parts of FAN ids each.
BITS = 4
FAN = 1 << BITS
IDS = FAN**3
END = IDS - 1
#: Ids that a window scores, and those before them that it sees.
SCORED, CONTEXT = 24, 8
SEEN = CONTEXT + SCORED - 1
#: Width of a position's vectors, and of the layer before the output.
WIDTH, HIDDEN = 16, 32
#: Weights of a word's share in the corpus, beside the attention model, of which the best is taken.
SHARES = np.arange(0.05, 0.96, 0.05)
#: Most frequent words, at most, whose counts go to every task.
HEAD = 1 << 19
#: Share of the training text's stretches that attention is trained on (the others fit the weight of the counts), and windows that it sees at least.
TRAINED, LEAST = 0.95, 120_000
#: Rounds of training, least number of shards, windows that a shard takes at most in a round.
ROUNDS, SHARDS, SHARD_WINDOWS, RATE = 5, 2, 100_000, 3e-3
#: Windows a step, least and most, and steps a shard and round between them.
STEP, LARGE_STEP, STEPS = 32, 256, 375
#: Words of a stretch of text that is trained on or not.
STRETCH = 64
#: Different words that a task remembers.
REMEMBERED = 150_000
#: Windows of a text that make a row, at most, and rows whose windows a step's are drawn from.
ROW_WINDOWS, MIXED = 64, 128
#: Ids that are scored together.
TOGETHER = 1 << 16
#: Windows of a step whose attention is worked out at once, and weights that are stepped at once: small enough for the cache.
PART, WEIGHTS = 64, 1 << 13
#: Weights that leave a shard in one row.
SENT = 1 << 10
#: Rows whose three softmax layers are worked out at once: small enough for the cache.
BLOCK = 4096
#: Scores before an exponential are cut here, so that none overflows.
TOP = 60
F4 = np.float32


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lower-cased: ``bytes`` know ASCII only, in case and white space."""
    return text.encode().lower().split() if text else []


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def word_keys(words: Collection[bytes]) -> np.ndarray:
    """``word_key`` of each word."""
    return (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) ^ np.uint64(1 << 63)).view(np.int64)


# The model

SHAPES = {
    "embed": (IDS, WIDTH), "place": (SEEN, 4 * WIDTH), "parts": (WIDTH, 4 * WIDTH), "inner": (2 * WIDTH, HIDDEN), "inner_bias": (HIDDEN,),
    "out0": (1, HIDDEN, FAN), "bias0": (1, FAN), "out1": (FAN, HIDDEN, FAN), "bias1": (FAN, FAN), "out2": (FAN * FAN, HIDDEN, FAN), "bias2": (FAN * FAN, FAN),
}
#: Places that a scored place sees: none ahead of it.
BEFORE = np.arange(SEEN)[None] <= np.arange(CONTEXT - 1, SEEN)[:, None]


def initial(counts: np.ndarray, seed: int = 13) -> dict[str, np.ndarray]:
    """Weights before training: small and random; the biases are the logarithms of the ids' shares, so that they start as unigrams."""
    rng = np.random.default_rng(seed)
    scale = {"embed": 0.3, "place": 0.1, "parts": WIDTH**-0.5, "inner": (2 * WIDTH) ** -0.5, **{f"out{i}": 0.1 * HIDDEN**-0.5 for i in range(3)}}
    w = {name: (rng.standard_normal(shape) * scale.get(name, 0)).astype(F4) for name, shape in SHAPES.items()}
    for i in range(3):
        share = (counts + 0.1).reshape(FAN**i, FAN, -1).sum(2)
        w[f"bias{i}"] = np.log(share / share.sum(1, keepdims=True)).astype(F4)
    return w


def levels(target: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(softmax, entry) of each id on the three levels."""
    return [(target >> BITS * (3 - i), target >> BITS * (2 - i) & FAN - 1) for i in range(3)]


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, start) of each run of equal values."""
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    return ordered[first], first


class Room:
    """Arrays that are made once and used again, by name: a step would spend much of its time on fresh memory. What they hold at first is what the last use left."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int, like: np.ndarray) -> np.ndarray:
        n, held = math.prod(shape), self.held.get(name)
        if held is None or len(held) < n or held.dtype != like.dtype:
            held = self.held[name] = np.zeros(n, like.dtype)
        return held[:n].reshape(shape)


def gradients(w: dict[str, np.ndarray], windows: np.ndarray, counts: np.ndarray, room: Room | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """(mean log-probability, gradients of the mean loss) of windows (ids, n x (SEEN + 1)) of which the first ``counts`` scored places are text.

    Attention is worked out for ``PART`` windows at a time, the output for all of them. With
    ``room`` the gradients hold until its next use.
    """
    like, n = w["embed"], len(windows)
    use = lambda name, *shape: (room if room is not None else fresh)(name, *shape, like=like)
    fresh = Room()
    # a place's vectors side by side: query, key, value, own
    value, own_at, wide = 2 * WIDTH, 3 * WIDTH, 4 * WIDTH
    scale = np.ones(wide, like.dtype)
    scale[:WIDTH] = WIDTH**-0.5
    parts, place, ones = w["parts"] * scale, w["place"] * scale, np.ones((SEEN, 1), like.dtype)
    mask, inner, bias = BEFORE.astype(like.dtype), w["inner"], w["inner_bias"]
    ids = windows[:, :SEEN].astype(np.uint16).ravel()
    embed, g, a = use("embed", n * SEEN, WIDTH), use("g", n, SEEN, wide), use("a", n, SCORED, SEEN)
    both, weight, z = use("both", n, SCORED, 2 * WIDTH), use("weight", n, SCORED, 1), use("z", n * SCORED, HIDDEN + 1)
    np.take(w["embed"], ids, 0, out=embed, mode="clip")
    z[:, HIDDEN] = 1  # takes the bias
    for at in range(0, n, PART):
        these, rows = slice(at, at + PART), slice(at * SCORED, (at + PART) * SCORED)
        gs, a_s, seen_own, zs = g[these], a[these], both[these], z[rows, :HIDDEN]
        np.matmul(embed[at * SEEN : (at + PART) * SEEN], parts, out=gs.reshape(-1, wide))
        gs += place
        np.matmul(gs[:, CONTEXT - 1 :, :WIDTH], gs[..., WIDTH:value].transpose(0, 2, 1), out=a_s)
        np.minimum(a_s, TOP, out=a_s)
        np.exp(a_s, out=a_s)
        a_s *= mask
        np.matmul(a_s, ones, out=weight[these])
        np.divide(a_s @ gs[..., value:own_at], weight[these], out=seen_own[..., :WIDTH])
        seen_own[..., WIDTH:] = gs[:, CONTEXT - 1 :, own_at:]
        np.matmul(seen_own.reshape(-1, 2 * WIDTH), inner, out=zs)
        zs += bias
        np.maximum(zs, 0, out=zs)

    # rows by target id, so that those of one softmax lie together
    real = np.flatnonzero((np.arange(SCORED)[None] < counts[:, None]).ravel())
    target = windows[:, CONTEXT:].ravel()[real]
    order = np.argsort(target.astype(np.uint16), kind="stable")
    real, target, m = real[order], target[order], len(real)
    zr, dz_real, more = np.take(z, real, 0, out=use("zr", m, HIDDEN + 1), mode="clip"), use("dz_real", m, HIDDEN), use("more", m, HIDDEN)
    p, hit, spans, outs, grads = use("p", 3, m, FAN), np.empty((3, m), np.int64), [], [], {}
    for i, (which, entry) in enumerate(levels(target)):
        softmax, first = runs(which)
        spans.append(list(zip(softmax.tolist(), map(slice, first.tolist(), [*first[1:].tolist(), m]), strict=False)))
        outs.append(np.concatenate((w[f"out{i}"], w[f"bias{i}"][:, None]), 1))
        for c, rows in spans[i]:
            np.matmul(zr[rows], outs[i][c], out=p[i, rows])
        np.add(np.arange(i * m, (i + 1) * m) * FAN, entry, out=hit[i])
    np.minimum(p, TOP, out=p)
    logp = p.ravel().take(hit).sum(dtype=float)
    np.exp(p, out=p)
    total = p.reshape(-1, FAN) @ np.ones((FAN, 1), like.dtype)
    logp -= np.log(total).sum(dtype=float)
    p /= total.reshape(3, m, 1)
    p.reshape(-1)[hit] -= 1
    for i in range(3):
        d_out, d_z = use(f"out{i}", FAN**i, HIDDEN + 1, FAN), more if i else dz_real
        d_out.fill(0)
        for c, rows in spans[i]:
            np.matmul(zr[rows].T, p[i, rows], out=d_out[c])
            np.matmul(p[i, rows], outs[i][c, :HIDDEN].T, out=d_z[rows])
        if i:
            dz_real += more
        grads |= {f"out{i}": d_out[:, :HIDDEN], f"bias{i}": d_out[:, HIDDEN]}

    dz, d_both = use("dz", n * SCORED, HIDDEN), use("d_both", n, SCORED, 2 * WIDTH)
    dz.fill(0)
    dz_real *= zr[:, :HIDDEN] > 0
    dz[real] = dz_real
    np.matmul(dz, inner.T, out=d_both.reshape(-1, 2 * WIDTH))
    d_seen = d_both[..., :WIDTH]
    d_seen /= weight
    dot = np.einsum("nij,nij->ni", d_seen, both[..., :WIDTH])[..., None]
    d_parts, d_place, d_embeds = np.zeros_like(parts), np.zeros_like(place), use("d_embeds", n * SEEN, WIDTH)
    d_gs, d_as = use("d_gs", PART, SEEN, wide), use("d_as", PART, SCORED, SEEN)
    d_gs.fill(0)
    for at in range(0, n, PART):
        these, rows = slice(at, at + PART), slice(at * SEEN, (at + PART) * SEEN)
        gs, a_s, d_s = g[these], a[these], d_seen[these]
        d_g, d_a = d_gs[: len(gs)], d_as[: len(gs)]
        np.matmul(d_s, gs[..., value:own_at].transpose(0, 2, 1), out=d_a)
        d_a -= dot[these]
        d_a *= a_s
        np.matmul(d_a, gs[..., WIDTH:value], out=d_g[:, CONTEXT - 1 :, :WIDTH])
        np.matmul(d_a.transpose(0, 2, 1), gs[:, CONTEXT - 1 :, :WIDTH], out=d_g[..., WIDTH:value])
        np.matmul(a_s.transpose(0, 2, 1), d_s, out=d_g[..., value:own_at])
        d_g[:, CONTEXT - 1 :, own_at:] = d_both[these, :, WIDTH:]
        np.matmul(d_g.reshape(-1, wide), parts.T, out=d_embeds[rows])
        d_parts += embed[rows].T @ d_g.reshape(-1, wide)
        d_place += d_g.sum(0)
    by_id = np.argsort(ids, kind="stable")
    used, first = runs(ids[by_id].astype(np.int32))
    d_embed = use("d_embed", *like.shape)
    d_embed.fill(0)
    d_embed[used] = np.add.reduceat(d_embeds.take(by_id, 0), first)
    flat_both = both.reshape(-1, 2 * WIDTH)
    grads |= {"inner": flat_both.T @ dz, "inner_bias": dz.sum(0), "embed": d_embed}
    grads |= {"place": d_place * scale, "parts": d_parts * scale}
    size = max(m, 1)
    for d in grads.values():
        d /= like.dtype.type(size)
    return float(logp) / size, grads


class Scorer:
    """Scores windows with fixed weights; tables of what each id brings are worked out once."""

    def __init__(self, w: dict[str, np.ndarray]):
        table, place = w["embed"] @ w["parts"], w["place"]
        cut = lambda x, i: np.ascontiguousarray(x[:, i * WIDTH : (i + 1) * WIDTH])
        self.w, inner = w, w["inner"]
        self.query, self.query_place = cut(table, 0) * F4(WIDTH**-0.5), cut(place, 0)[CONTEXT - 1 :] * F4(WIDTH**-0.5)
        self.key, self.key_place, self.value, self.value_place = cut(table, 1), cut(place, 1), cut(table, 2), cut(place, 2)
        self.own, self.own_place = cut(table, 3) @ inner[WIDTH:], cut(place, 3)[CONTEXT - 1 :] @ inner[WIDTH:] + w["inner_bias"]
        self.seen, self.mask = np.ascontiguousarray(inner[:WIDTH]), BEFORE.astype(F4)
        self.ones = np.ones((SEEN, 1), F4)

    def hidden(self, windows: np.ndarray) -> np.ndarray:
        """The hidden vector of each scored place of some windows; a place meets all places up to it, the others are masked."""
        at, last = windows[:, :SEEN], windows[:, CONTEXT - 1 : SEEN]
        k = self.key.take(at, 0)
        k += self.key_place
        v = self.value.take(at, 0)
        v += self.value_place
        q = self.query.take(last, 0)
        q += self.query_place
        a = q @ k.transpose(0, 2, 1)
        if len(a) and a.max() > TOP:
            np.minimum(a, TOP, out=a)
        np.exp(a, out=a)
        a *= self.mask
        seen = a @ v
        seen /= a @ self.ones
        z = seen.reshape(-1, WIDTH) @ self.seen
        z = z.reshape(len(windows), SCORED, HIDDEN)
        z += self.own.take(last, 0)
        z += self.own_place
        return np.maximum(z, 0, out=z).reshape(-1, HIDDEN)

    def outputs(self, z: np.ndarray, place: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target id, whose hidden vector is ``z[place]``; ids are ordered, so that the rows of one softmax are one product."""
        order = np.argsort(target.astype(np.uint16), kind="stable")
        place, path, total = place[order], levels(target[order]), np.empty(len(target), F4)
        bounds = [np.searchsorted(which, np.arange(FAN**i + 1)).tolist() for i, (which, _) in enumerate(path)]
        for a in range(0, len(target), BLOCK):
            rows = order[a : a + BLOCK]
            n, zs = len(rows), z.take(place[a : a + BLOCK], 0)
            x, found, at = np.empty((3, n, FAN), F4), np.zeros(n, F4), np.arange(n) * FAN
            for i, (which, entry) in enumerate(path):
                out, bias, part = self.w[f"out{i}"], self.w[f"bias{i}"], x[i]
                for c in range(int(which[a]), int(which[a + n - 1]) + 1):
                    lo, hi = max(bounds[i][c] - a, 0), min(bounds[i][c + 1] - a, n)
                    if lo < hi:
                        np.matmul(zs[lo:hi], out[c], out=part[lo:hi])
                        part[lo:hi] += bias[c]
                if part.max() > TOP:
                    np.minimum(part, TOP, out=part)
                found += part.ravel().take(at + entry[a : a + n])
            np.exp(x, out=x)
            total[rows] = found - np.log(x.reshape(3 * n, FAN) @ self.ones[:FAN]).reshape(3, n).sum(0)
        return total

    def log10(self, windows: np.ndarray, counts: np.ndarray, batch: int = 64) -> np.ndarray:
        """log10 of the probability of every scored id of the windows, in order."""
        z = np.empty((len(windows) * SCORED, HIDDEN), F4)
        for at in range(0, len(windows), batch):
            z[at * SCORED : (at + batch) * SCORED] = self.hidden(windows[at : at + batch])
        real = np.flatnonzero((np.arange(SCORED, dtype=np.int32)[None] < counts[:, None]).ravel())
        return self.outputs(z, real, windows[:, CONTEXT:].ravel()[real]) / F4(math.log(10))


class Steps:
    """Adam steps from given weights."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.flat = flat(weights)
        self.w = shaped(self.flat)  # views
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.n, self.rate, self.room = 0, rate, Room()

    def step(self, windows: np.ndarray, counts: np.ndarray) -> None:
        grads = flat(gradients(self.w, windows, counts, self.room)[1])
        self.n += 1
        rate = self.rate * min(1.0, self.n / 20)
        for at in range(0, len(grads), WEIGHTS):
            w, m, v, d = (x[at : at + WEIGHTS] for x in (self.flat, self.first, self.second, grads))
            t = np.multiply(d, d)
            t -= v
            t *= F4(0.01)
            v += t
            d -= m
            d *= F4(0.1)
            m += d
            np.multiply(v, F4(1 / (1 - 0.99**self.n)), out=t)
            np.sqrt(t, out=t)
            t += F4(1e-8)
            np.divide(m, t, out=t)
            t *= F4(rate / (1 - 0.9**self.n))
            w -= t


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[name].ravel() for name in SHAPES])


def shaped(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = math.prod(shape)
        out[name] = np.asarray(v[at : at + n], F4).reshape(shape)
        at += n
    return out


# Words and windows within a task

_spellers: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def speller(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The vocabulary's first ``END`` ranks, and which of them begin with a blank. Words are cut after 64 characters, so that no word is slow to merge."""
    if path not in _spellers:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("first-merges", pat_str=r" [^ ]{0,63}|[^ ]{1,64}", mergeable_ranks={k: r for k, r in ranks.items() if r < END}, special_tokens={})
        first = np.zeros(IDS, bool)
        first[[r for k, r in ranks.items() if r < END and k.startswith(b" ")]] = True
        _spellers[path] = enc, first
    return _spellers[path]


def spell(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the vocabulary in a row, ids a word) of words, many in a call: a word begins with the only blank before it, and so do its ids."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    enc, first = speller(path)
    parts = (words[at : at + TOGETHER // 4] for at in range(0, len(words), TOGETHER // 4))
    ids = np.concatenate([np.array(enc.encode_ordinary((b" " + b" ".join(part)).decode()), np.int32) for part in parts])
    return ids, np.diff(np.flatnonzero(first[ids]), append=len(ids)).astype(np.int32)


class Words:
    """Numbers of different words with their ids, keys and counts as growing arrays; forgets all of them when there are too many."""

    def __init__(self, path: str, code: np.ndarray | None = None, keys: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.path, self.code, self.head, self.head_counts = path, code, keys, counts
        self.forget()

    def __len__(self) -> int:
        return len(self.number)

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.letters = 0
        self.flat, self.size, self.start = (np.zeros(1 << 10, np.int32) for _ in range(3))
        self.key, self.count = (np.zeros(1 << 10, np.int64) for _ in range(2))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        fresh = list(set(words).difference(self.number))
        if fresh:
            self._learn(fresh)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def _learn(self, fresh: list[bytes]) -> None:
        ids, size = spell(self.path, fresh)
        ids = ids if self.code is None else self.code[ids]
        key = word_keys(fresh)
        count = np.full(len(key), -1)
        if self.head is not None and len(self.head):
            at = np.minimum(np.searchsorted(self.head, key), len(self.head) - 1)
            count = np.where(self.head[at] == key, self.head_counts[at], -1)
        known = len(self.number)
        for name, values, at in (("start", self.letters + np.cumsum(size) - size, known), ("size", size, known), ("key", key, known), ("count", count, known), ("flat", ids, self.letters)):
            held = getattr(self, name)
            if at + len(values) > len(held):
                setattr(self, name, held := np.concatenate((held, np.zeros(len(held) + len(values), held.dtype))))
            held[at : at + len(values)] = values
        self.number.update(zip(fresh, range(known, known + len(fresh)), strict=True))
        self.letters += len(ids)

    def spelt(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, ids a word)."""
        sizes = self.size.take(numbers)
        ends = np.cumsum(sizes, dtype=np.int32)
        at = np.repeat(self.start.take(numbers) - ends + sizes, sizes)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat.take(at), sizes


def windows_of(before: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, scored places of each): all ids, each in the scored part of one window; ``before`` are the ids ahead of them, ends where there are none."""
    k = -(-len(ids) // SCORED)
    s = np.full(CONTEXT + k * SCORED, end, np.int32)
    tail = before[-CONTEXT:]
    s[CONTEXT - len(tail) : CONTEXT], s[CONTEXT : CONTEXT + len(ids)] = tail, ids
    return np.lib.stride_tricks.sliding_window_view(s, CONTEXT + SCORED)[::SCORED], np.minimum(SCORED, len(ids) - np.arange(k) * SCORED)


class Rows:
    """Sums over the words of a batch of texts; words outside of the head are kept for the join with their counts."""

    def __init__(self, n: int):
        self.sums, self.n = np.zeros((5, n)), n
        self.rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held: list[tuple] = []
        self.size = 0

    def add(self, row: int, windows: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> None:
        self.held.append((*windows, sizes, counts, keys, np.full(len(sizes), row, np.int32)))
        self.size += int(windows[1].sum())

    def settle(self, scorer: Scorer, measure: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """Score what is held. ``measure``: five numbers a word from its log-probability and its count."""
        if not self.held:
            return
        windows, n, sizes, counts, keys, row = (np.concatenate(x) for x in zip(*self.held, strict=True))
        logp = np.add.reduceat(scorer.log10(windows, n).astype(float), np.cumsum(sizes) - sizes)
        here = counts >= 0
        self.sums[0] += np.bincount(row, minlength=self.n)
        self.sums[3] += np.bincount(row, logp, self.n)
        for i, v in enumerate(measure(logp[here], counts[here])):
            if i not in (0, 3):
                self.sums[i] += np.bincount(row[here], v, self.n)
        self.rest.append((row[~here], keys[~here], logp[~here].astype(F4)))
        self.held, self.size = [], 0

    def columns(self) -> list[pa.Array]:
        """n_tokens, known, base, attention, score, and the other words' keys and log-probabilities."""
        row, keys, logs = (np.concatenate(x) for x in zip(*self.rest, strict=True)) if self.rest else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, F4))
        offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=self.n)))), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (keys, logs)]
        return [pa.array(self.sums[i].astype(np.int64)) if i < 2 else pa.array(self.sums[i]) for i in range(5)] + lists


# On Spark


def count_words(texts: DataFrame) -> DataFrame:
    """(key, n) of all words of texts (_text), summed per task and then by word; words are told by 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(word_keys(held)), pa.array(list(held.values()), pa.int64())], names=["key", "n"])
            held.clear()
            return out

        for part in slices(batches):
            for text in part.column(0).to_pylist():
                held.update(words_of(text))
                if len(held) > REMEMBERED:
                    yield rows()
        yield rows()

    return texts.select("_text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = HEAD) -> int:
    """The least count such that at most ``most`` words have it or more, from a histogram of some hundred classes of counts."""
    sizes = counts.groupBy(F.floor(F.log2("n") * 8).alias("c")).agg(F.count("*").alias("size"), F.min("n").alias("n")).orderBy(F.desc("c")).collect()
    least, total = 1 << 62, 0
    for r in sizes:
        total += r["size"]
        if total > most:
            break
        least = r["n"]
    return least


def training_windows(texts: DataFrame, path: str, share: float = TRAINED) -> DataFrame:
    """(ids binary: unsigned 16-bit, places binary: a byte a window, n) of the stretches of text that are trained on: those whose number, drawn from the text's hash, is below ``share``.

    A row holds ``ROW_WINDOWS`` windows of one text at most, the scored places of each and
    their sum. Ids are those of the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out, places, counts = [], [], []
            for text in part.column(0).to_pylist():
                for before, ids in trained_runs(text, path, share):
                    w, n = windows_of(before, ids, END)
                    w = w.astype("<u2")
                    for at in range(0, len(w), ROW_WINDOWS):
                        out.append(w[at : at + ROW_WINDOWS].tobytes())
                        places.append(n[at : at + ROW_WINDOWS].astype(np.uint8).tobytes())
                        counts.append(int(n[at : at + ROW_WINDOWS].sum()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(places, pa.binary()), pa.array(counts, pa.int32())], names=["ids", "places", "n"])

    return texts.select("_text").mapInArrow(run, "ids binary, places binary, n int")


def draws_of(text: str | None, n_words: int) -> np.ndarray:
    """A number from 0 to 1 for each stretch of a text, from the text's hash."""
    return np.random.default_rng(xxhash.xxh64_intdigest(text or "")).random(n_words // STRETCH + 1)


def trained_runs(text: str | None, path: str, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids before, ids) of the stretches below ``share``, those that follow each other together; the same ids as by ``stretches``."""
    words = words_of(text)
    ids, sizes = spell(path, words)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], draws_of(text, len(words)) < share, [False]))))
    for low, high in edges.reshape(-1, 2) * STRETCH:
        first, last = ends[low], ends[min(high, len(words))]
        own = ids[first:last] if high <= len(words) else np.append(ids[first:last], np.int32(END))
        if len(own):
            yield ids[max(first - CONTEXT, 0) : first], own


def stretches(text: str | None, seen: Words, low: float, high: float, end: int) -> Iterator[tuple]:
    """(ids before, ids, their number a word, words' numbers) of a text's stretches whose draws lie between ``low`` and ``high``; the end belongs to the last one."""
    words = words_of(text)
    draws = draws_of(text, len(words))
    for at in np.flatnonzero((draws >= low) & (draws < high)) * STRETCH:
        if len(seen) > REMEMBERED:
            seen.forget()
        number = seen.numbers(words[max(at - CONTEXT, 0) : at + STRETCH])
        ids, sizes = seen.spelt(number)
        ahead = min(at, CONTEXT)
        own = int(sizes[ahead:].sum())
        before, ids, sizes = ids[: len(ids) - own], ids[len(ids) - own :], sizes[ahead:]
        if at + STRETCH > len(words):
            ids, sizes = np.append(ids, end), np.append(sizes, 1)
        if len(ids):
            yield before, ids, sizes, number[ahead:]


def _windows(part: pa.RecordBatch, code: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(b"".join(part.column(0).to_pylist()), "<u2").reshape(-1, CONTEXT + SCORED)
    return ids if code is None else code[ids], np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8)


def id_counts(windows: DataFrame) -> np.ndarray:
    """How often each id is a scored place of the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(IDS, np.int64)
        for part in slices(batches):
            if part.num_rows:
                ids, n = _windows(part)
                total += np.bincount(ids[:, CONTEXT:][np.arange(SCORED)[None] < n[:, None]], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["id", "n"])

    found = windows.select("ids", "places").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row an id
    out = np.zeros(IDS)
    out[found["id"]] = found["n"]
    return out


def train(windows: DataFrame, rounds: int = ROUNDS, least: int = LEAST, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """(weights in a row, code): the attention model and the number that each id of the vocabulary has in it, by falling frequency.

    Windows are used once, or as often as makes ``least`` of them. Each round deals its
    windows to shards, whose weights are averaged; without windows the weights stay random.
    """
    windows = materialize(windows, "lm-windows")
    counts = id_counts(windows)
    code = np.empty(len(counts), np.int32)
    order = np.argsort(-counts, kind="stable")
    code[order] = np.arange(len(counts))
    weights, have = flat(initial(counts[order], seed)), windows.agg(F.coalesce(F.sum(F.length("places")), F.lit(0))).first()[0]
    if not have:
        return weights, code
    uses = max(1, -(-least // have))
    shards = max(SHARDS, -(-have * uses // (rounds * SHARD_WINDOWS)))
    size = min(LARGE_STEP, max(STEP, have * uses // (rounds * shards * STEPS)))
    mixed = windows.withColumn("_use", F.explode(F.sequence(F.lit(1), F.lit(uses)))).withColumn("_h", F.xxhash64("ids", "_use"))
    dealt = mixed.select("ids", "places", F.pmod("_h", F.lit(rounds)).alias("_round"), F.pmod(F.shiftrightunsigned("_h", 20), F.lit(shards)).cast("int").alias("_shard"), "_h")
    for r in range(rounds):
        rate = RATE * (1 - r / rounds)

        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = weights, rate: float = rate) -> Iterator[pa.RecordBatch]:
            state, rng = Steps(shaped(start), rate), np.random.default_rng(seed)
            rest: list[tuple] = []
            for part in slices(batches, MIXED):
                if not part.num_rows:
                    continue
                rest.append(_windows(part, code))
                ids, n = (np.concatenate(x) for x in zip(*rest, strict=True))
                mix = rng.permutation(len(ids))  # a step takes windows of many texts
                ids, n = ids[mix], n[mix]
                whole = len(ids) // size * size
                for at in range(0, whole, size):
                    state.step(ids[at : at + size], n[at : at + size])
                rest = [(ids[whole:], n[whole:])]
            if rest and len(rest[0][0]):
                state.step(*rest[0])
            if state.n:
                yield in_rows(state.flat)

        # by number, not by its hash, which would leave some tasks several shards in a row and others none
        shard = dealt.where(F.col("_round") == r).repartitionById(shards, "_shard").sortWithinPartitions("_h").select("ids", "places")
        mean = averaged(shard.mapInArrow(run, "i int, w binary"))
        if len(mean):
            weights = mean
    return weights, code


def in_rows(v: np.ndarray) -> pa.RecordBatch:
    """(i, w binary): weights as rows of ``SENT``."""
    parts = [v[at : at + SENT].astype("<f4").tobytes() for at in range(0, len(v), SENT)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["i", "w"])


def averaged(rows: DataFrame) -> np.ndarray:
    """The mean, entry by entry, of the shards' weights (``in_rows``); empty without shards."""

    def mean(same: pa.Table) -> pa.Table:
        total = np.zeros(len(same["w"][0].as_py()) // 4)
        for w in same["w"]:
            total += np.frombuffer(w.as_py(), "<f4")
        return pa.table({"i": same["i"][:1], "w": pa.array([(total / same.num_rows).astype("<f4").tobytes()], pa.binary())})

    found = rows.groupBy("i").applyInArrow(mean, "i int, w binary").orderBy("i").collect()  # the weights of one model
    return np.frombuffer(b"".join(r["w"] for r in found), "<f4").astype(F4)


def mixed_log(logp: np.ndarray, count: np.ndarray, total: int, share: float) -> np.ndarray:
    """log10 of the mix of a word's spelling (its log10) and its share in the corpus."""
    spelt = logp + math.log10(1 - share)
    counted = np.log(np.maximum(count, 1e-300) * share / max(total, 1))
    return np.where(count > 0, np.logaddexp(counted, spelt * math.log(10)) / math.log(10), spelt)


def fit_share(texts: DataFrame, path: str, weights: np.ndarray, code: np.ndarray, sent: Broadcast, total: int, n_texts: int) -> float:
    """The weight of counts under which the stretches of text that attention was not trained on are likeliest, each word counted without itself.

    Words outside of the head count as unseen; only sums, one a weight, leave a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, seen, end = Scorer(shaped(weights)), Words(path, code, *sent.value), int(code[END])
        sums, held = np.zeros(len(SHARES)), []

        def settle() -> None:
            windows, n, sizes, count = (np.concatenate(x) for x in zip(*held, strict=True))
            logp = np.add.reduceat(scorer.log10(windows, n).astype(float), np.cumsum(sizes) - sizes)
            sums[:] += [mixed_log(logp, count, total - 1, s).sum() for s in SHARES]
            held.clear()

        for part in slices(batches):
            for text in part.column(0).to_pylist():
                for before, ids, sizes, number in stretches(text, seen, TRAINED, 1.0, end):
                    held.append((*windows_of(before, ids, end), sizes, np.append(seen.count[number], n_texts)[: len(sizes)] - 1))
                    if len(held) * STRETCH > TOGETHER // 4:  # scored together, as each call has its price
                        settle()
        if held:
            settle()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], names=["i", "v"])

    found = texts.select("_text").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # a row a weight
    best = max(found, key=lambda r: (r["v"], -r["i"]), default=None)
    return float(SHARES[best["i"]]) if best and best["v"] < 0 else 0.25


def score(docs: DataFrame, training: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), head: int = HEAD, rounds: int = ROUNDS, least: int = LEAST) -> DataFrame:
    """(id, keep, n_tokens, n_known, train_tokens, base_score, attention_score, score, count_weight) of every row of ``docs`` by the model of ``training``.

    base_score: words by their smoothed counts. attention_score: log10 probability of the
    subword ids alone. score: with the word counts mixed in. count_weight: theirs in it. A null or empty text is an end
    alone; rows with null or repeated ids are scored each; columns other than ``keep`` are
    not read; an empty table gives no rows. Without training text the model is untrained and
    no word is known.
    """
    texts = training.select(F.col(text_col).alias("_text"))
    vocabulary = materialize(count_words(texts), "lm-words")
    n_words, n_different = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_texts = texts.count()
    total, different = n_words + n_texts, n_different + (n_texts > 0)
    limit = frequent(vocabulary, head)
    top = vocabulary.where(F.col("n") >= limit).toPandas().sort_values("key")  # ``head`` rows at most
    sent = docs.sparkSession.sparkContext.broadcast((top["key"].to_numpy(), top["n"].to_numpy()))
    weights, code = train(training_windows(texts, path), rounds, least)
    share = fit_share(texts, path, weights, code, sent, total, n_texts)

    norm = math.log10(total + 0.1 * (different + 1))
    src = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    measures = "_key long, n_tokens long, _known long, _base double, attention_score double, _score double, _words array<long>, _logs array<float>"
    kept = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in src.columns[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        scorer, seen = Scorer(shaped(weights)), Words(path, code, *sent.value)
        key = TaskContext.get().partitionId() << 33
        for part in slices(batches, 128):
            rows = Rows(part.num_rows)
            for i, text in enumerate(part.column(part.num_columns - 1)):
                words = words_of(text.as_py())
                before = np.zeros(0, np.int32)
                for at in range(0, len(words) + 1, TOGETHER // 4):  # a long text in stretches, each after the ids of the last
                    if len(seen) > REMEMBERED:
                        rows.settle(scorer, score_words)
                        seen.forget()
                    number = seen.numbers(words[at : at + TOGETHER // 4])
                    ids, sizes = seen.spelt(number)
                    counts, keys = seen.count.take(number), seen.key.take(number)
                    if at + TOGETHER // 4 > len(words):
                        ids, sizes, counts, keys = np.append(ids, end), np.append(sizes, 1), np.append(counts, n_texts), np.append(keys, 0)
                    if len(ids):
                        rows.add(i, windows_of(before, ids, end), sizes, counts, keys)
                        before = ids[-CONTEXT:]
                    if rows.size > TOGETHER:
                        rows.settle(scorer, score_words)
            rows.settle(scorer, score_words)
            keyed = pa.array(range(key, key + part.num_rows), pa.int64())
            key += part.num_rows
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], keyed, *rows.columns()], names=[*part.schema.names[:-1], *names])

    end, names = int(code[END]), [c.split()[0] for c in measures.split(", ")]

    def score_words(logp: np.ndarray, count: np.ndarray) -> np.ndarray:
        known = np.where(count > 0, count, 0).astype(float)
        return np.stack((np.ones(len(count)), count > 0, np.log10(known + 0.1) - norm, logp, mixed_log(logp, known, total, share)))

    first = materialize(src.mapInArrow(run, f"{kept}, {measures}"), "lm-scored")

    # words outside of the head meet their counts one by one
    rest = first.select("_key", F.explode(F.arrays_zip("_words", "_logs")).alias("_o")).select("_key", F.col("_o._words").alias("_w"), F.col("_o._logs").cast("double").alias("_lp"))
    met = rest.join(vocabulary.where(F.col("n") < limit), F.col("_w") == F.col("key"), "left")
    c = F.coalesce("n", F.lit(0))
    spelt = F.col("_lp") + math.log10(1 - share)
    both = F.when(c > 0, F.log10(c * (share / max(total, 1)) + F.pow(F.lit(10.0), spelt))).otherwise(spelt)
    sums = met.select("_key", (c > 0).cast("long").alias("_rk"), (F.log10(c + 0.1) - norm).alias("_rb"), both.alias("_rs"))
    sums = sums.groupBy(F.col("_key").alias("_of")).agg(F.sum("_rk").alias("_rk"), F.sum("_rb").alias("_rb"), F.sum("_rs").alias("_rs"))
    out = first.drop("_words", "_logs").join(sums, F.col("_key") == F.col("_of"), "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select(
        F.col("_id").alias(id_col), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", plus("_known", "_rk").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("_base", "_rb").alias("base_score"), "attention_score", plus("_score", "_rs").alias("score"), F.lit(share).alias("count_weight"),
    )
