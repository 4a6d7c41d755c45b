"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over n-grams of ``ORDER`` UTF-16 code units, so every script and character has
units of its own and an n-gram is one 64-bit number. Counts of all trusted documents are
summed per task and then by (language, n-gram); continuation counts, discounts, context
totals, backoff weights and the probabilities of every order are joins of those sharded
tables, which grow with the corpus. Languages have a model each and share one of all
trusted text (``ALL``).

Scoring counts the n-grams of all documents in the same way and joins the distinct ones
with the tables, so that each gets its loss once, seen or backed off. The ``HEAD`` most
frequent of them, a fixed number, are sent to the tasks; the other n-grams of a document are
joined with their shards and summed. An n-gram outside of the head holds less than one part
in ``HEAD`` of the corpus, so none of these joins has a hot key.

A document is rejected if its perplexity lies beyond a limit that comes from quantiles of
the trusted documents of its language. The perplexity is the lower one under the model of
its language and that of all languages (a quoted passage may be foreign), and is smoothed
with ``PRIOR`` units of usual text, as a few words tell little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_rows, materialize, spotted

ORDER, UNIT_BITS = 3, 16
#: N-grams whose losses go to every task.
HEAD = 1 << 18
ALL = "*"
#: Units of usual text that every document's mean is smoothed with.
PRIOR = 100
#: Parts that the rows of one rejected text are dealt into.
SALTS = 16
#: N-grams of texts that a task holds before it sums them, and rows that it sends at once.
PENDING, SENT = 1 << 18, 1 << 15


def trusted_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_id: str = "doc_id") -> DataFrame:
    """Documents labelled as good; the text that the model trusts. The join is by id and exact; a map of ids spares most others the shuffle."""
    good = labels.where("quality = 1").select(F.col(label_id).alias("_good")).where("_good IS NOT NULL").distinct()
    likely = spotted(docs, id_col, good).where("_spotted").drop("_spotted")
    # an inner join (ids of ``good`` are distinct), as a semi-join would be moved below the map
    return likely.hint("merge").join(good, F.col(id_col) == F.col("_good")).drop("_good")


def grams(text: str) -> np.ndarray:
    """The n-gram that ends at each unit of the text, as a number; before the text there are zeros."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    n = len(units)
    s = np.zeros(n + ORDER - 1, np.uint64)
    s[ORDER - 1 :] = units
    code = s[:n].copy()
    for i in range(1, ORDER):
        code = code << np.uint64(UNIT_BITS) | s[i : i + n]
    return code.view(np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, g, n): n-gram counts of documents (_lang, _text) by language and, under ``ALL``, of all of them; summed per task and then by n-gram."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(n, first)

    def rows(held: dict[str | None, list]) -> Iterator[list]:
        sums = {lang: summed(parts) for lang, parts in held.items()}
        if sums:
            sums[ALL] = summed(list(sums.values()))
        for lang, (keys, n) in sums.items():
            for at in range(0, len(keys) if lang is not None else 0, SENT):  # as arrays and in parts: a batch is held by the worker and by the JVM
                yield [[lang] * len(keys[at : at + SENT]), keys[at : at + SENT], n[at : at + SENT]]

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        held: dict[str | None, list] = {}
        size = 0
        for langs, texts in batches:
            for lang, text in zip(langs, texts, strict=True):
                if text:
                    held.setdefault(lang, []).append(np.unique(grams(text), return_counts=True))
                    size += len(held[lang][-1][0])
                if size >= PENDING:
                    held, size = {lang: [summed(parts)] for lang, parts in held.items()}, 0
                    if sum(len(parts[0][0]) for parts in held.values()) > 1_000_000:  # partial sums of many different n-grams go out early
                        yield from rows(held)
                        held = {}
        yield from rows(held)

    return map_rows(docs.select("_lang", "_text"), run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def _low(g: Column, order: int) -> Column:
    """The last ``order`` units of an n-gram."""
    return g.bitwiseAND(F.lit((1 << UNIT_BITS * order) - 1)) if order * UNIT_BITS < 64 else g


def _context(g: Column) -> Column:
    return F.shiftrightunsigned(g, UNIT_BITS)


def discounted(counts: DataFrame) -> DataFrame:
    """(lang, g, x, n, p, rest): the context x of an n-gram, the discounted share p of its count in the context, and the share that the context leaves to the lower order.

    Modified Kneser-Ney: discounts for counts 1, 2 and 3 or more, from the counts of counts
    of the language. Where these are too few to give a positive one, discounts are 0.5, 0.75 and 1.
    """
    n_of = lambda k: F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double").alias(f"n{k}")
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def d(k: int, usual: float) -> Column:
        low, high = F.col(f"n{k}"), F.col(f"n{k + 1}")
        own = F.when((F.col("n1") > 0) & (low > 0), k - (k + 1) * y * high / low)
        return F.when(own > 0, F.least(F.lit(float(k)), own)).otherwise(F.lit(usual))

    by_lang = counts.groupBy("lang").agg(*[n_of(k) for k in (1, 2, 3, 4)]).select("lang", d(1, 0.5).alias("d1"), d(2, 0.75).alias("d2"), d(3, 1.0).alias("d3"))
    cut = counts.withColumn("x", _context(F.col("g"))).join(F.broadcast(by_lang), "lang")
    cut = cut.withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
    totals = cut.groupBy("lang", "x").agg(F.sum("n").alias("total"), F.sum("d").alias("mass"))
    return cut.join(totals, ["lang", "x"]).select("lang", "g", "x", "n", ((F.col("n") - F.col("d")) / F.col("total")).alias("p"), (F.col("mass") / F.col("total")).alias("rest"))


class Model:
    """By order, 1 to ``ORDER``, tables of n-grams (lang, g, x, n, p, rest) with their probability p and the backoff weight of their context x; and (lang, usual, least): a unit's mean loss on trusted text and the probability of one never seen."""

    def __init__(self, tables: dict[int, DataFrame], usual: DataFrame):
        self.tables, self.usual = tables, usual


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", label_id: str = "doc_id") -> Model:
    """The model of all trusted rows, as tables; their texts are shuffled once, to their labels."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text")).where(F.length("_text") > 0)
    counts = {ORDER: materialize(count_grams(trusted_documents(rows, labels, "_id", label_id)), "lm-counts")}
    for k in range(ORDER - 1, 0, -1):  # an n-gram of lower order counts the different units before it
        counts[k] = counts[k + 1].groupBy("lang", _low(F.col("g"), k).alias("g")).agg(F.count("*").alias("n"))
    tables: dict[int, DataFrame] = {}
    for k in range(1, ORDER + 1):
        whole = discounted(counts[k])
        if k == 1:
            whole = whole.withColumn("q", F.lit(1 / (1 << UNIT_BITS)))
        else:
            whole = whole.withColumn("low", _low(F.col("g"), k - 1)).join(tables[k - 1].select("lang", F.col("g").alias("low"), F.col("p").alias("q")), ["lang", "low"])
        tables[k] = materialize(whole.select("lang", "g", "x", "n", (F.col("p") + F.col("rest") * F.col("q")).alias("p"), "rest"), f"lm-{k}")
    seen = tables[ORDER].groupBy("lang").agg((F.sum(-F.col("n") * F.ln("p")) / F.sum("n")).alias("usual"))
    least = tables[1].groupBy("lang").agg((F.max("rest") / (1 << UNIT_BITS)).alias("least"))
    return Model(tables, materialize(seen.join(least, "lang"), "lm-usual"))


def losses(counts: DataFrame, model: Model) -> DataFrame:
    """(lang, g, n, loss): minus the log probability of every n-gram (lang, g, n), backed off as far as it must be."""
    found = counts.join(F.broadcast(model.usual.select("lang", "least")), "lang")  # a row a language
    for k in range(1, ORDER + 1):
        found = found.withColumn(f"g{k}", _low(F.col("g"), k)).withColumn(f"x{k}", _context(F.col(f"g{k}")))
    value = F.col("least")
    for k in range(1, ORDER + 1):
        found = found.join(model.tables[k].select("lang", F.col("g").alias(f"g{k}"), F.col("p").alias(f"p{k}")), ["lang", f"g{k}"], "left")
        if k > 1:
            rest = model.tables[k].groupBy("lang", F.col("x").alias(f"x{k}")).agg(F.max("rest").alias(f"r{k}"))  # one value a context
            found = found.join(rest, ["lang", f"x{k}"], "left")
            value = F.coalesce(F.col(f"r{k}"), F.lit(1.0)) * value
        value = F.coalesce(F.col(f"p{k}"), value)
    return found.select("lang", "g", "n", (-F.ln(value)).alias("loss"))


def _head(scored: DataFrame) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], int]:
    """Sorted n-grams and losses by language of the most frequent rows, ``HEAD`` at most, and the least level of frequency among them."""
    by_level = {r[0]: r[1] for r in scored.groupBy(_level("n").alias("level")).count().collect()}  # a few hundred rows
    total, cut = 0, 1 << 30
    for level in sorted(by_level, reverse=True):
        total += by_level[level]
        if total > HEAD:
            break
        cut = level
    top = scored.where(_level("n") >= cut).select("lang", "g", "loss").toArrow()
    langs, g, loss = np.array(top["lang"].to_pylist(), object), top["g"].to_numpy(), top["loss"].to_numpy()
    out = {}
    for lang in set(langs):
        mine = np.flatnonzero(langs == lang)
        mine = mine[np.argsort(g[mine])]
        out[lang] = g[mine], loss[mine]
    return out, cut


def _level(n: str) -> Column:
    return F.floor(F.log2(n) * 8).cast("int")


def perplexity(docs: DataFrame, model: Model, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, model_lang, perplexity) of every whole text; null for an empty or null text.

    A row per input row. Kept columns should be small; texts are read twice (to count all
    n-grams and to score) and not shuffled.
    """
    known = [r[0] for r in model.usual.select("lang").collect() if r[0] != ALL]  # a row a language
    lang = F.col(lang_col).cast("string")
    used = F.when(lang.isin(known), lang).otherwise(ALL) if known else F.lit(ALL)
    src = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep_{c}") for c in keep], used.alias("_lang"), F.col(text_col).alias("_text"))
    scored = materialize(losses(count_grams(src.where(F.length("_text") > 0)), model), "lm-losses")
    head, cut = _head(scored)
    shared = docs.sparkSession.sparkContext.broadcast(head)  # HEAD rows at most
    none = np.zeros(0, np.int64), np.zeros(0)

    def of(lang: str, g: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss of the n-grams in the head, and which are not in it."""
        keys, loss = shared.value.get(lang, none)
        if not len(keys):
            return 0.0, np.ones(len(g), bool)
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        hit = keys[at] == g
        return float((loss[at] * n)[hit].sum()), ~hit

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for *kept, langs, texts in batches:
            cols: list[list] = [[] for _ in range(6)]
            for lang, text in zip(langs, texts, strict=True):
                g, n = np.unique(grams(text or ""), return_counts=True)
                own, rare = of(lang, g, n)
                every, rare_all = (own, rare) if lang == ALL else of(ALL, g, n)
                # the two models may hold different n-grams in the head: 0 there takes the n-gram out of the sum
                either = rare | rare_all
                row = int(n.sum()), own, every, g[either], np.where(rare, n, 0)[either], np.where(rare_all, n, 0)[either]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield [*kept, langs, *cols]

    kinds = ", ".join(f"{c} {id_type(src, c)}" for c in src.columns[:-1])
    rows = map_rows(src, run, f"{kinds}, _n long, _own double, _every double, _g array<long>, _a array<long>, _b array<long>")
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "lm-rows")  # written, so that the numbers stay
    rare = rows.select("_row", "_lang", F.explode(F.arrays_zip("_g", "_a", "_b")).alias("_t"))
    rest = scored.where(_level("n") < cut).select(F.col("lang").alias("_of"), F.col("g").alias("_at"), "loss")
    both = rare.select("_row", F.col("_lang").alias("_of"), F.col("_t._g").alias("_at"), F.col("_t._a").alias("_c"), F.lit(0).alias("_which")).unionByName(
        rare.select("_row", F.lit(ALL).alias("_of"), F.col("_t._g").alias("_at"), F.col("_t._b").alias("_c"), F.lit(1).alias("_which"))
    )
    part = lambda i: F.sum(F.when(F.col("_which") == i, F.col("_c") * F.col("loss")).otherwise(0.0))
    sums = both.where("_c > 0").join(rest, ["_of", "_at"]).groupBy("_row").agg(part(0).alias("_more"), part(1).alias("_more_all"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    loss = F.least(F.col("_own") + zero("_more"), F.col("_every") + zero("_more_all"))
    out = rows.drop("_g", "_a", "_b").join(sums, "_row", "left").join(F.broadcast(model.usual.select(F.col("lang").alias("_lang"), "usual")), "_lang", "left")  # a row a language
    value = F.when(F.col("_n") > 0, F.exp((loss + PRIOR * F.col("usual")) / (F.col("_n") + PRIOR)))
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_keep_{c}").alias(c) for c in keep], F.col("_lang").alias("model_lang"), value.alias("perplexity"))


def limits(scored: DataFrame, labels: DataFrame, quantile: float = 0.99, spread: float = 2.0, least: float = 1.25, id_col: str = "doc_id", label_id: str = "doc_id") -> DataFrame:
    """(model_lang, max_perplexity) by quantiles of the trusted ones of the scored documents, by language.

    The limit is the median times (upper quantile / median) ** ``spread``, and ``least``
    times the median at least: the model has seen these documents, others score higher.
    """
    own = trusted_documents(scored, labels, id_col, label_id).where("perplexity IS NOT NULL").select("model_lang", "perplexity")
    both = own.where(F.col("model_lang") != ALL).unionByName(own.withColumn("model_lang", F.lit(ALL)))
    q = F.percentile_approx("perplexity", [0.5, quantile], 10_000)
    return both.groupBy("model_lang").agg(q.alias("_q")).select("model_lang", (F.col("_q")[0] * F.greatest(F.lit(least), F.pow(F.col("_q")[1] / F.col("_q")[0], F.lit(spread)))).alias("max_perplexity"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", keep: tuple[str, ...] = (), label_id: str = "doc_id") -> DataFrame:
    """(id, kept columns, model_lang, perplexity, max_perplexity, kept) for every document.

    kept: false if the perplexity exceeds the limit of the language. Empty and null texts
    have no perplexity and are rejected; without any trusted text all are kept. A null
    language, or one without trusted text, is judged by the model of all trusted text.
    Repeated rows give a row each.
    """
    model = train(docs, labels, id_col, lang_col, text_col, label_id)
    scored = materialize(perplexity(docs, model, id_col, lang_col, text_col, keep), "lm-scores")
    bounds = limits(scored, labels, id_col=id_col, label_id=label_id)
    judged = scored.join(F.broadcast(bounds), "model_lang", "left")  # a row a language
    fine = F.coalesce(F.col("perplexity") <= F.col("max_perplexity"), F.lit(model.usual.isEmpty()))
    return judged.select(*scored.columns, "max_perplexity", fine.alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The documents that the classifier keeps, with the columns of ``docs``, whatever their names.

    The verdict depends on language and text alone. Rows that may have a rejected one (by
    the map of ``spotted``) are joined with these, dealt by id too; all others stay in place.
    """
    key = F.md5(F.concat(F.coalesce(F.col(lang_col).cast("string"), F.lit("\0")), F.lit("\0"), F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.select(F.struct("*").alias("_all"), F.col(id_col).alias("_rid"), F.col(lang_col).alias("_rlang"), F.col(text_col).alias("_rtext"), key.alias("_key"))
    judged = classify(rows, labels, "_rid", "_rlang", "_rtext", ("_key",), id_col)
    out = materialize(judged.where("NOT kept").select("_key").distinct(), "lm-rejected")
    marked = spotted(rows.select("_all", "_rid", "_key"), "_key", out)
    copies = out.select("_key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    doubted = marked.where("_spotted").withColumn("_salt", F.pmod(F.xxhash64("_rid"), F.lit(SALTS)))
    fine = doubted.hint("merge").join(copies, ["_key", "_salt"], "left_anti")
    return marked.where("NOT _spotted").select("_all.*").unionByName(fine.select("_all.*"))
