"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``r`` (even) bits exactly if some value lies within
``r/2`` bits of both. Every distinct fingerprint therefore emits all variants within half
the radius (1 + 64 of them at radius 2) and variants are shuffled; fingerprints that meet
on a variant are within ``r`` of each other. A variant holds no more fingerprints than the
half ball has values, so no group is large, and each links to the smallest one only: links
stay linear and lose no connection. Copies share a fingerprint and collapse before that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import LOWER, UPPER, id_type, map_rows, materialize, spotted

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle of the text, repeats included (uint64).

    A-Z are lower-cased, words are runs without ASCII white space, a shingle is ``size``
    words joined by a space; fewer words give one shingle of them all, none give none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; no hashes give 0. As a signed 64-bit int."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # long texts in bounded steps
        ones += np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit SimHash of every whole text. Null and word-less texts: 0."""

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for ids, texts in batches:
            yield [ids, [fingerprint(shingle_hashes(t, shingle)) for t in texts]]

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_rows(src, run, f"_id {id_type(src, '_id')}, fp long").withColumnRenamed("_id", id_col)


def ball_masks(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of ``bits`` bits, as signed 64-bit ints."""
    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def ball_links(fps: DataFrame, radius: int = 2, bits: int = 64) -> DataFrame:
    """Links (a, b), a > b, among distinct values ``fp`` that connect all within ``radius`` bits."""
    if radius % 2:
        raise ValueError("the radius must be even: members of a half ball are then within it of each other")
    masks = F.array(*[F.lit(m) for m in ball_masks(bits, radius // 2)])
    # the number of the mask says which fingerprint a variant comes from, and takes less of the shuffle than it
    met = fps.select("fp", F.posexplode(masks).alias("_i", "_m")).select(F.col("fp").bitwiseXOR(F.col("_m")).alias("_variant"), "_i")
    own = met.repartition(F.col("_variant")).withColumn("fp", F.col("_variant").bitwiseXOR(F.get(masks, F.col("_i")))).select("_variant", "fp")
    least = F.min("fp").over(Window.partitionBy("_variant"))
    linked = own.select("fp", least.alias("_least")).where("fp != _least").select(F.col("fp").alias("a"), F.col("_least").alias("b"))
    return linked.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row.

    fingerprint: 16 lowercase hex digits. component_id: smallest id reachable over links of
    at most ``radius`` differing bits, the row's own included. Null or word-less texts have
    fingerprint zero and link like any other. Repeated rows each give a row; rows with a
    null id share their fingerprint's component and count for no minimum. Other columns are
    not read.
    """
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    groups = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("_low")), "simhash-groups")
    roots = materialize(components(ball_links(groups.select("fp"), radius), "simhash-cc"), "simhash-roots")
    rooted = groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "_low", F.coalesce("root", "fp").alias("_root"))
    lowest = rooted.groupBy("_root").agg(F.min("_low").alias("component_id"))
    of_fp = rooted.join(lowest, "_root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near duplicates: tables of 32 bits each, shingle of the fingerprints, shingle and least similarity of the check.
TABLES, TABLE_BITS, FP_SHINGLE, CHECK_SHINGLE, SIMILARITY = 6, 32, 2, 5, 0.8
#: Pivots that differ in more of the 192 bits are not tried; similar texts among them are found by the prefix filter.
FAR_BITS = 48
#: Most shingles whose frequency is known to the order of prefixes.
FREQUENT = 200_000
#: Pairs that one copy of a text's shingles serves, and parts that a text's pairs are dealt into before.
SHARE, SALTS = 256, 8
#: Rounds of stars at most, and pairs a row that are few enough to do without.
ROUNDS, FEW = 1, 4
#: Texts of a shingle beyond which not all of its pairs are made.
LARGE = 64
_MIX, _FINISH = np.uint64(0xBF58476D1CE4E5B9), (np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, A-Z lower-cased. None is remembered: workers go on to other stages and would keep it."""
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w, 42) for w in text.encode("utf-8", "surrogatepass").translate(_LOWER).split()]), "<u8")


def mixed(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` word hashes, repeats included; fewer words give one of them all, none give none."""
    size = min(size, len(words))
    n = len(words) - size + 1 if size else 0
    found = np.full(n, size, np.uint64)
    for i in range(size):
        found = (found ^ words[i : i + n]) * _MIX
        found ^= found >> np.uint64(29)
    return found


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct shingles by which near duplicates are checked."""
    return np.unique(mixed(word_hashes(text), CHECK_SHINGLE))


def table_fingerprints(text: str) -> list[int]:
    """Three fingerprints of 64 bits, each two tables."""
    base = mixed(word_hashes(text), FP_SHINGLE)
    turned = ((base ^ (base >> np.uint64(31))) * m for m in _FINISH)
    return [fingerprint(t ^ (t >> np.uint64(32))) for t in turned]


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two sets given as sorted distinct little-endian hashes; two empty sets are equal."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _candidates(reps: DataFrame) -> DataFrame:
    """(x, y, bits): distinct texts and the pivots that they meet, with the bits in which they differ.

    Per table, values link to the least value of each variant they emit. A text meets the
    least text of its own value and that of every value its own links to: at most as many as
    the half ball has values, however large the group.
    """
    word = lambda i: F.shiftright(F.col(f"fp{i // 2}"), 32 * (i % 2)).bitwiseAND(F.lit(0xFFFFFFFF))
    fps = F.struct("fp0", "fp1", "fp2")
    nodes = reps.select("no", fps.alias("fps"), F.explode(F.array(*[F.shiftleft(F.lit(i).cast("long"), 32).bitwiseOR(word(i)) for i in range(TABLES)])).alias("fp"))
    values = materialize(nodes.groupBy("fp").agg(F.min(F.struct("no", "fps")).alias("pivot"), F.count("*").alias("n")), "neardup-values")
    links = materialize(ball_links(values.select("fp"), 2, TABLE_BITS), "neardup-links")
    met = links.hint("merge").join(values.select(F.col("fp").alias("b"), "pivot"), "b").select(F.col("a").alias("fp"), "pivot")
    met = met.unionByName(values.where("n > 1").select("fp", "pivot"))
    differ = lambda i: F.bit_count(F.col(f"fps.fp{i}").bitwiseXOR(F.col(f"pivot.fps.fp{i}")))
    pairs = nodes.hint("merge").join(met, "fp").where(F.col("no") != F.col("pivot.no")).withColumn("bits", differ(0) + differ(1) + differ(2))
    return pairs.where(F.col("bits") <= FAR_BITS).select(F.col("no").alias("x"), F.col("pivot.no").alias("y"), "bits").distinct()


def prefix(hashes: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of the distinct shingles in the order of ``counts`` (0 outside of ``often``, which is sorted), then hash.

    Of two sets with a Jaccard similarity of 0.8 or more, each holds four fifths of the other
    at least, so the fifth that comes first in a common order, and one more, have one in common.
    """
    at = np.searchsorted(often, hashes)
    at[at == len(often)] = 0
    count = np.where(often[at] == hashes, counts[at], 0) if len(often) else np.zeros(len(hashes), np.int64)
    n = len(hashes)
    return hashes[np.lexsort((hashes, count))[: n - (4 * n + 4) // 5 + 1]] if n else hashes


def _frequent(keyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of an eighth of the texts, sorted, and their counts. They only set the order of ``prefix``, so no result depends on them."""

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for (texts,) in batches:
            for t in texts:
                yield [shingle_set(t).view(np.int64).tolist()]

    counts = map_rows(keyed.where("key < '2'").select("_text"), run, "token long").groupBy("token").count().where("count > 2")
    top = counts.orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()
    tokens, n = top["token"].to_numpy().astype(np.int64).view(np.uint64), top["count"].to_numpy().astype(np.int64)
    order = np.argsort(tokens)
    return tokens[order], n[order]


def _once(keys: list[str], seen: set[str]) -> list[int]:
    """Places of the keys that this task has not met lately; copies that remain are dropped after the shuffle."""
    if len(seen) > 100_000:
        seen.clear()
    new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
    return new


def _shared(keyed: DataFrame, reps: DataFrame) -> DataFrame:
    """(token, no, n, i, pivot): the prefix shingles that several texts have, with the size of the text's set, their place in it and the least text that has them."""
    shared = keyed.sparkSession.sparkContext.broadcast(_frequent(keyed))  # FREQUENT rows at most

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        seen: set[str] = set()
        for keys, texts in batches:
            new = _once(keys, seen)
            sets = [shingle_set(texts[i]) for i in new]
            yield [[keys[i] for i in new], [len(s) for s in sets], [prefix(s, *shared.value).view(np.int64).tolist() for s in sets]]

    first = map_rows(keyed, run, "key string, n long, tokens array<long>").dropDuplicates(["key"]).hint("merge").join(reps.select("key", "no"), "key")
    rows = first.select("no", "n", F.posexplode("tokens").alias("i", "token")).select("token", "no", F.shiftleft("n", 32).bitwiseOR(F.col("i").cast("long")).alias("_ni"))
    of = Window.partitionBy("token")
    several = rows.withColumn("_low", F.min("no").over(of)).withColumn("_high", F.max("no").over(of)).where("_low < _high")
    return several.select("token", "no", F.shiftright("_ni", 32).alias("n"), F.col("_ni").bitwiseAND(F.lit(0xFFFFFFFF)).alias("i"), F.col("_low").alias("pivot"))


def _rooted(shared: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """(token, no, n, i, root): the rows of ``shared`` whose shingle lies in texts of several roots."""
    rows = shared.hint("merge").join(roots.select(F.col("node").alias("no"), "root"), "no", "left").select("token", "no", "n", "i", F.coalesce("root", "no").alias("root"))
    of = Window.partitionBy("token")
    return materialize(rows.withColumn("_low", F.min("root").over(of)).withColumn("_high", F.max("root").over(of)).where("_low < _high").drop("_low", "_high"), f"neardup-rooted{name}")


def _crowds(rooted: DataFrame, name: str) -> DataFrame:
    """(token, n, pairs): rows of each shingle, and pairs of them with different roots."""
    by_root = rooted.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"))
    return materialize(by_root.select("token", "n", ((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs")), f"neardup-crowds{name}")


def _pairs_left(crowds: DataFrame) -> tuple[int, int]:
    """Rows, and pairs of rows of one shingle and different roots."""
    rows, pairs = crowds.agg(F.sum("n"), F.sum("pairs")).first()
    return rows or 0, int(pairs or 0)


def _crowded(rooted: DataFrame, crowds: DataFrame) -> DataFrame:
    """The rows of shingles that make more than ``FEW`` pairs a row; all others together make few enough."""
    return rooted.hint("merge").join(crowds.where(F.col("pairs") > FEW * F.col("n")).select("token"), "token")


def _starred(rooted: DataFrame) -> DataFrame:
    """(x, y): for each text the most central text of another root that it shares shingles with.

    Central is the text whose prefix shingles are in most texts on average: among near copies
    the one that the others were made from, as each edit puts shingles of its own first. A
    shingle's most central text is the pivot of all that have it; of several pivots the one
    with most shingles in common counts.
    """
    of = Window.partitionBy("token")
    centre = rooted.withColumn("_c", F.count("*").over(of)).groupBy("no").agg((F.sum("_c") / F.max("n")).alias("central"))
    pick = F.max(F.struct("central", "no", "n", "root")).over(of)
    met = rooted.hint("merge").join(centre, "no").withColumn("_p", pick).where("root != _p.root AND 5 * least(n, _p.n) >= 4 * greatest(n, _p.n)")
    often = met.groupBy(F.col("no").alias("x"), F.col("_p.no").alias("y")).agg(F.count("*").alias("count"))
    return often.groupBy("x").agg(F.max(F.struct("count", "y")).alias("_n")).select("x", F.col("_n.y").alias("y"))


def _apart(rooted: DataFrame) -> DataFrame:
    """(x, y), x < y: all pairs of different roots that have a prefix shingle in common and whose sizes allow the similarity.

    A similarity of 0.8 is an overlap of 4/9 of the two sizes. Behind the first shingle in
    common, the one of least place in both, the sets must hold that many; and shingles in
    common lie in both prefixes or behind that prefix which ends first.

    Of a shingle of more than ``LARGE`` texts only pairs are made whose first shingle in
    common it can be, by the same bound on what lies behind it; how many such shingles two
    texts share is then known as no more than either has, which leaves the bounds true.
    """
    sized = rooted.withColumn("large", (F.count("*").over(Window.partitionBy("token")) > LARGE).cast("int"))
    sized = sized.hint("merge").join(rooted_large(sized), "no")
    x, y = (sized.select("token", "large", *[F.col(c).alias(f"{c}_{s}") for c in ("no", "n", "i", "root", "l")]) for s in "xy")
    alike = F.expr("no_x < no_y AND root_x != root_y AND 5 * least(n_x, n_y) >= 4 * greatest(n_x, n_y)")
    first = F.expr("9 * least(n_x - i_x, n_y - i_y) >= 4 * (n_x + n_y)")
    met = x.hint("merge").join(y.drop("large"), "token").where(alike & ((F.col("large") == 0) | first)).groupBy(F.col("no_x").alias("x"), F.col("no_y").alias("y"))
    firsts = met.agg(F.sum(1 - F.col("large")).alias("c"), *[F.min(c).alias(c) for c in ("n_x", "n_y", "i_x", "i_y", "l_x", "l_y")])
    most = "c + least(l_x, l_y) + greatest((4 * n_x + 4) DIV 5, (4 * n_y + 4) DIV 5) - 1"
    return firsts.where(f"9 * least(n_x - i_x, n_y - i_y, {most}) >= 4 * (n_x + n_y)").select("x", "y")


def rooted_large(sized: DataFrame) -> DataFrame:
    """(no, l): how many of a text's shingles are of many texts."""
    return sized.groupBy("no").agg(F.sum("large").alias("l"))


def _verified(pairs: DataFrame, keyed: DataFrame, reps: DataFrame, name: str) -> DataFrame:
    """Links (a, b) of the pairs (x, y) whose shingle sets are similar enough.

    Only texts of a pair are read into sets (the map of ``spotted`` keeps nearly all others
    back, the joins are exact). The set of a text with many pairs is sent to them in a copy
    for each ``SHARE``, so that no task takes all.
    """

    def hashed(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        seen: set[str] = set()
        for keys, texts in batches:
            new = _once(keys, seen)
            yield [[keys[i] for i in new], [shingle_set(texts[i]).astype("<u8").tobytes() for i in new]]

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for xs, ys, us, vs in batches:
            fine = [i for i in range(len(xs)) if jaccard(us[i], vs[i]) >= SIMILARITY]
            yield [[xs[i] for i in fine], [ys[i] for i in fine]]

    def named(c: str) -> DataFrame:
        """c, its key and the copies that its pairs need, for each of ``SALTS`` parts of them."""
        ends = pairs.groupBy(c).agg(F.floor(F.count("*") / SHARE).alias(f"n{c}")).hint("merge").join(reps.select(F.col("no").alias(c), F.col("key").alias(f"k{c}")), c)
        return ends.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))

    salt = F.pmod(F.xxhash64("x", "y"), F.lit(SALTS).cast("long"))
    pairs = materialize(pairs, f"neardup-pairs{name}").withColumn("_salt", salt)
    pairs = materialize(pairs.hint("merge").join(named("x"), ["x", "_salt"]).hint("merge").join(named("y"), ["y", "_salt"]), f"neardup-named{name}")
    ends = pairs.select(F.col("kx").alias("end")).unionByName(pairs.select(F.col("ky").alias("end")))
    near = spotted(keyed, "key", ends).where("_spotted").select("key", "_text")
    sets = map_rows(near, hashed, "key string, hashes binary").dropDuplicates(["key"])

    def copied(c: str, hashes: str) -> DataFrame:
        parts = pairs.groupBy(f"k{c}").agg(F.max(f"n{c}").alias("_n"))
        some = sets.select(F.col("key").alias(f"k{c}"), F.col("hashes").alias(hashes)).hint("merge").join(parts, f"k{c}")
        return some.select(f"k{c}", F.explode(F.sequence(F.lit(0).cast("long"), "_n")).alias(f"_p{c}"), hashes)

    dealt = pairs.select("x", "y", "kx", "ky", F.pmod(F.xxhash64("y"), F.col("nx") + 1).alias("_px"), F.pmod(F.xxhash64("x"), F.col("ny") + 1).alias("_py"))
    both = dealt.hint("merge").join(copied("x", "_u"), ["kx", "_px"]).hint("merge").join(copied("y", "_v"), ["ky", "_py"]).select("x", "y", "_u", "_v")
    return materialize(map_rows(both, run, "a long, b long"), f"neardup-links{name}")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, root): for every distinct text (by its MD5) in a group of several, the group's root text.

    Groups are connected by pairs whose sets of five-word shingles have a Jaccard similarity
    of 0.8 or more, all of them. A first pass checks each text with one pivot found by ball
    hashing (radius 2, six tables of 32 bits from two-word shingles: one 64-bit fingerprint of
    five-word shingles would differ in about ten bits at that similarity, out of reach of any
    small ball) and with one found by prefix shingles. The last pass checks every pair still
    in different groups that a prefix filter, which is exact, leaves: no pair is lost. Before
    it, while shingles' texts make many pairs (a large group of near copies in several
    pieces), rounds of stars with other pivots join the pieces of these shingles' texts.
    """

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        seen: set[str] = set()
        for keys, texts in batches:
            new = _once(keys, seen)
            fps = [table_fingerprints(texts[i]) for i in new]
            yield [[keys[i] for i in new], *([f[j] for f in fps] for j in range(3))]

    keyed = docs.select(F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # written, so that the numbers stay
    reps = materialize(map_rows(keyed, run, "key string, fp0 long, fp1 long, fp2 long").distinct().withColumn("no", F.monotonically_increasing_id()), "neardup-fp")
    near = _candidates(reps).groupBy("x").agg(F.min(F.struct("bits", "y")).alias("_n")).select("x", F.col("_n.y").alias("y"))
    shared = materialize(_shared(keyed, reps), "neardup-shared")
    often = shared.where("no != pivot").groupBy(F.col("no").alias("x"), F.col("pivot").alias("y")).agg(F.count("*").alias("count"), F.min("n").alias("n")).where("20 * count >= n")
    most = often.groupBy("x").agg(F.max(F.struct("count", "y")).alias("_n")).select("x", F.col("_n.y").alias("y"))
    links = _verified(near.unionByName(most).distinct(), keyed, reps, "1")
    rooted = _rooted(shared, components(links, "neardup-cc1"), "1")
    for i in range(2, ROUNDS + 2):
        crowds = _crowds(rooted, str(i))
        rows, left = _pairs_left(crowds)
        if left <= FEW * rows:
            break
        found = _verified(_starred(_crowded(rooted, crowds)), keyed, reps, f"-star{i}")
        if found.isEmpty():
            break
        links = links.unionByName(found)
        rooted = _rooted(rooted.drop("root"), components(links, f"neardup-cc{i}"), str(i))  # shingles only drop out
    more = _verified(_apart(rooted), keyed, reps, "2")
    grouped = materialize(components(links.unionByName(more), "neardup-cc"), "neardup-roots")
    names = reps.select("no", "key")
    found = grouped.hint("merge").join(names.withColumnRenamed("no", "node"), "node").select("key", F.col("root").alias("no"))
    return found.hint("merge").join(names.withColumnRenamed("key", "root"), "no").select("key", "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of exact or near copies: that of the smallest id. Columns as in ``docs``.

    Null texts count as empty and are copies of each other. A null id comes after all
    others; of rows that repeat id and text the one whose other columns come first as JSON
    text stays. Documents whose text is alone are kept where they are; only the others are
    shuffled, by text and id, so that a text with a third of all rows spreads.
    """
    groups = materialize(near_duplicate_groups(docs, id_col, text_col), "neardup-groups")
    keyed = docs.select(F.struct("*").alias("_row"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"), F.col(id_col).alias("_rid"))
    first = materialize(keyed.groupBy("_key").agg(F.min("_rid").alias("_low"), F.count("*").alias("_n")), "neardup-keys")
    doubted = first.where("_n > 1").select("_key").unionByName(groups.select(F.col("key").alias("_key")))
    best = first.hint("merge").join(groups, F.col("_key") == F.col("key"), "left").groupBy(F.coalesce("root", "_key").alias("_root"))
    best = best.agg(F.min(F.struct(F.col("_low").isNull(), "_low", "_key")).alias("_best"))
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    stay = best.select(F.col("_best._key").alias("_key"), text("_best._low").alias("_id"))
    rows = spotted(keyed, "_key", doubted)
    met = rows.where("_spotted").select("_row", "_key", text("_rid").alias("_id")).hint("merge").join(stay, ["_key", "_id"])
    kept = met.groupBy("_key", "_id").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return rows.where("NOT _spotted").select("_row.*").unionByName(kept.select("_row.*"))
