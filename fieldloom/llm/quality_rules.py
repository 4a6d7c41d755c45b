"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit
per failed rule. A policy is a version name and a mask: a document is kept if none of the
policy's bits failed. What a rule alone would change (an ablation) is bitwise aggregation
over the ledger, never another pass over the texts. Only DataFrame functions are used; no
shuffle is needed to fill the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, let

#: Failure bits by rule, in order of the bit.
RULES = ("few_words", "repeated_words", "many_symbols", "many_upper", "repeated_lines", "word_length")
#: Versioned policies: the rules each applies.
POLICIES = {"base": ("few_words", "repeated_words"), "v1": ("few_words", "repeated_words", "many_symbols", "many_upper", "repeated_lines", "word_length")}
SYMBOLS = "#*$%&|<>"


def mask_of(rules) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WS + "+", -1), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first finding included."""

    def positions(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def doubled(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, j: F.coalesce(F.get(s, j - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["w"] == x["w"], F.lit(False)),
            )
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        return let(ordered, doubled)

    def covered(at: Column) -> Column:
        """Each window covers three words, or as many as lie before the next such window."""
        return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, n: a + n)

    def count(words: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
        some = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(positions(w), covered))
        return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, some))

    return count(words)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Measurements of every whole text; a null text counts as no words. One row per input row.

    ``keep``: columns to carry along besides the id, under ``_keep_`` and their name.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: F.length(F.regexp_replace(x, WS, "")) > 0), lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup")))
    squeezed = F.regexp_replace(text, WS, "")
    counted = let(_words(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("rep")))
    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
        .select(
            "_id",
            *[f"_keep_{c}" for c in keep],
            counted.alias("_w"),
            lines.alias("_l"),
            F.length(squeezed).alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[\p{Lu}]", ""))).alias("n_upper"),
        )
        .select(
            F.col("_id").alias(id_col),
            *[f"_keep_{c}" for c in keep],
            *[c.cast("long").alias(n) for c, n in ((F.col("_w.n"), "n_words"), (F.col("word_chars"), "word_chars"), (F.col("n_symbols"), "n_symbols"), (F.col("_l.dup"), "n_dup_lines"), (F.col("_w.rep"), "n_repeat_words"), (F.col("_l.n"), "n_lines"), (F.col("n_upper"), "n_upper"))],
        )
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Measurements and ``fail_bits`` (bit i: ``RULES[i]`` failed) of every document.

    few_words: under 50 words. repeated_words: over half the words lie in repeated windows.
    many_symbols: more than 3 symbols to 10 words. many_upper: upper-case letters are over
    half the characters. repeated_lines: over half the lines repeat an earlier one, of 4
    lines or more. word_length: under 2 or over 20 characters a word on average. Empty and null texts fail few_words
    alone. Extra columns are not read.
    """
    failed = {
        "few_words": F.expr("n_words < 50"),
        "repeated_words": F.expr("100 * n_repeat_words > 50 * n_words"),
        "many_symbols": F.expr("10 * n_symbols > 3 * n_words"),
        "many_upper": F.expr("2 * n_upper > word_chars AND word_chars > 0"),
        "repeated_lines": F.expr("n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
        "word_length": F.expr("n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    }
    bits = None
    for i, rule in enumerate(RULES):
        bit = F.when(failed[rule], F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs, id_col, text_col, keep).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, version: str = "v1", column: str = "kept") -> DataFrame:
    """Add whether the policy keeps each document."""
    return led.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[version])).cast("long")) == 0)


def ablations(led: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that only it rejects.

    The ledger is first counted by distinct bit pattern (at most 2 to the number of rules
    rows), so a pattern that a third of all rows share is one partial sum per task.
    """
    mask = F.lit(mask_of(POLICIES[version])).cast("long")
    by_bits = led.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[version]])).alias("r")
    hit = by_bits.select("bits", "n", rules).where(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)
    return hit.groupBy(F.col("r.rule").alias("rule")).agg(F.sum("n").alias("n_failed"), F.sum(F.when(F.bit_count("bits") == 1, F.col("n")).otherwise(0)).alias("n_only_this"))


def passing(docs: DataFrame, version: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with the columns of ``docs``."""
    led = apply_policy(ledger(docs, id_col, text_col, tuple(docs.columns)), version, "_kept")
    return led.where("_kept").select(*[F.col(f"_keep_{c}").alias(c) for c in docs.columns])
