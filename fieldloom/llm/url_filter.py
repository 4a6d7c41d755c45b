"""URL filters: a sort-merge range join over reversed-host keys.

A rule ``example.net/en/`` becomes the key ``net.example/en/``. Every url gives one key
for each suffix of its host (``a.example.net/en/1``: ``net/en/1``, ``net.example/en/1``,
``net.example.a/en/1``), so a rule fits a url exactly if the rule's key is a prefix of one
of them: a prefix is the interval of keys that start with it, and such intervals nest. In
key order the deepest interval that holds a key is therefore on the stack of the rule that
was met last, which a running ``last`` carries along the sorted sweep.

The sweep is salted by url row, not by host, so a host with a third of all rows spreads
over all tasks; each salt sweeps the whole rule list, which costs rules x salts rows.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """One row per rule key: the rules whose intervals hold it, outermost first, itself last."""
    host = ascii_lower(F.trim(F.coalesce(F.col("host"), F.lit(""))))
    path = F.when(F.col("path") != "", F.col("path")).otherwise("/")  # a bare host stops at its end
    keyed = (
        rules.select(host.alias("_h"), path.alias("_p"), F.col("verdict").alias("_v"))
        .select(
            F.concat(F.array_join(_labels(F.col("_h")), "."), F.col("_p")).alias("_key"),
            F.concat("_h", "_p").alias("_rule"),
            "_v",
        )
        .groupBy("_key")
        .agg(F.max(F.struct("_v", "_rule")).alias("_r"))  # of two verdicts for one rule "block" wins
        .select("_key", F.col("_r._rule").alias("_rule"), F.col("_r._v").alias("_v"))
    )
    prefixes = keyed.select(
        "_key",
        F.explode(F.transform(F.sequence(F.lit(1), F.length("_key")), lambda n: F.substring(F.col("_key"), F.lit(1), n))).alias("_prefix"),
    )
    held = keyed.select(F.col("_key").alias("_prefix"), F.struct(F.length("_key").alias("n"), F.col("_key").alias("key"), F.col("_rule").alias("rule"), F.col("_v").alias("verdict")).alias("_of"))
    return prefixes.join(held, "_prefix").groupBy("_key").agg(F.sort_array(F.collect_list("_of")).alias("_stack"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """Judge every url by its longest fitting rule.

    ``rules``: host, path (null or empty: ``/``), verdict (``block`` or ``allow``). Returns one row per input row:
    id, url, host, path, rule (null if none fits), verdict (``default`` if none fits).
    A null url, or one without ``://``, has empty host and path and takes the default, as a
    url with an empty path fits no rule that starts with ``/``. Longest: most characters of
    host and path. Repeated rows, also of the same id, each give a row; other columns of
    ``pages`` are not read. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_path(F.col("_url"))
    urls = (
        pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
        .select("_id", "_url", host.alias("_host"), path.alias("_path"))
        .withColumn("_labels", _labels(F.col("_host")))
        .select(
            F.pmod(F.xxhash64("_id", "_url"), F.lit(salts)).cast("int").alias("_salt"),
            "_id", "_url", "_host", "_path",
            F.posexplode(F.transform("_labels", lambda _, i: F.concat(F.array_join(F.slice("_labels", F.lit(1), i + 1), "."), F.col("_path")))).alias("_pos", "_key"),
        )
    )
    swept_rules = _rule_stacks(rules).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    events = urls.unionByName(swept_rules, allowMissingColumns=True)
    sweep = Window.partitionBy("_salt").orderBy("_key", F.col("_pos").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    active = F.filter("_active", lambda s: F.startswith(F.col("_key"), s["key"]))
    best = F.when(F.size("_fits") > 0, F.element_at("_fits", -1))
    judged = (
        events.withColumn("_active", F.last("_stack", ignorenulls=True).over(sweep))
        .where(F.col("_pos").isNotNull())
        .withColumn("_fits", F.coalesce(active, F.array().cast("array<struct<n:int,key:string,rule:string,verdict:string>>")))
        .withColumn("_best", best)
        .groupBy("_salt", "_id", "_url", "_host", "_path")
        .agg(
            F.max(F.when(F.col("_best").isNotNull(), F.struct(F.length("_best.rule").alias("n"), F.col("_best.verdict").alias("verdict"), F.col("_best.rule").alias("rule")))).alias("_win"),
            F.count(F.when(F.col("_pos") == 0, 1)).alias("_copies"),
        )
    )
    return judged.select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_win.rule").alias("rule"), F.coalesce("_win.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"),
    ).drop("_copy")
