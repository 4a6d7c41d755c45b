"""Registered queries of the operators for training-data pipelines, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, bpe, chat, lm_quality, merkle, toxicity, whitening
from .ann import nearest
from .common import table
from .html_extract import extract_text
from .packing import pack
from .quality_rules import POLICIES, RULES, ablations, apply_policy, ledger
from .simhash import simhash_components
from .url_filter import filter_urls

#: (host, path, verdict) of the url query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=("lang",))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_offending"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles are learnt from four fifths of the conversations and recovered for all from their lines."""
    lines = table(spark, sf_dir, "conversations")
    held_out = F.crc32(F.col("conv_id").cast("string")) % 5 == 0
    return chat.format_chats(lines, chat.fit(lines.where(~held_out)))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(apply_policy(ledger(table(spark, sf_dir, "documents")), "base", "base_kept"), "v1")
    return led.withColumn("base_failed", ~F.col("base_kept")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op5_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule: the documents that fail it, and those that it alone rejects."""
    return ablations(ledger(table(spark, sf_dir, "documents")))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row folds its own path with its leaf, altered where 5 divides the id's checksum."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    led = merkle.manifest(table(spark, sf_dir, "documents"))
    folded = merkle.fold(F.when(tampered, F.col("altered")).otherwise(F.col("leaf")), F.col("path"))
    out = led.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors, 8)
    error = whitening.identity_error(vectors, model) if model else 0.0
    out = whitening.whiten(vectors, model).withColumn("identity_error", F.lit(error))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model learns from nine tenths of the documents and scores all of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    docs = docs.select("doc_id", held_out.alias("held_out"), "text")
    return attention_lm.score(docs, docs.where("NOT held_out"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep=("held_out",))


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
    length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN lines ON lines.doc_id = w.doc_id
), bits AS (
  SELECT *, ((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_upper > word_chars AND word_chars > 0 THEN 8 ELSE 0 END)
    + (CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 32 ELSE 0 END))::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM bits
"""

#: The bits of the policy's rules, unnested.
_BITS = ", ".join(f"{{'rule': '{r}', 'bit': {1 << RULES.index(r)}}}" for r in POLICIES["v1"])
ABLATIONS_SQL = f"""
SELECT r.rule AS rule, count(*) AS n_failed, count(*) FILTER (fail_bits = r.bit) AS n_only_this
FROM (SELECT fail_bits, unnest([{_BITS}]) AS r FROM ({OP5_SQL})) WHERE (fail_bits & r.bit) <> 0 GROUP BY 1
"""

OP10_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'allow'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'block'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'block' ELSE 'allow' END AS verdict
FROM hp
"""

def _crc32_sql(text: str) -> str:
    """CRC-32 of a short ASCII text in SQL: a byte enters with its first bit step."""
    bits = f"list_concat([4294967295::UBIGINT], flatten(list_transform(range(1, length({text}) + 1), lambda i: list_concat([ascii(substr({text}, i, 1))::UBIGINT], [0::UBIGINT for k in range(7)]))))"
    return f"xor(list_reduce({bits}, lambda c, b: xor(xor(c, b) >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)), 4294967295::UBIGINT)"


def _levels_sql(name: str, first: str, levels: int) -> str:
    """CTEs name0, name1, ...: nodes (tree, idx, h, n) of each level with the hashes l and r of their run, and name_root (tree, root)."""
    out = [f"{name}0 AS (SELECT tree, idx, h, count(*) OVER (PARTITION BY tree) AS n FROM ({first}))"]
    run = "PARTITION BY tree, idx // 16 ORDER BY idx ROWS BETWEEN"
    for i in range(levels):
        out.append(f"""{name}s{i} AS (SELECT *, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{i} WHERE n > 1)""")
        out.append(f"{name}{i + 1} AS (SELECT tree, idx // 16 AS idx, sha256(l || h || r) AS h, (n + 15) // 16 AS n FROM {name}s{i} WHERE idx % 16 = 0)")
    out.append(f"{name}_root AS (" + " UNION ALL ".join(f"SELECT tree, h AS root FROM {name}{i} WHERE n = 1" for i in range(levels + 1)) + ")")
    return ", ".join(out)


def _joins_sql(name: str, tree: str, idx: str, levels: int) -> str:
    return " ".join(f"LEFT JOIN {name}s{i} {name}j{i} ON {name}j{i}.tree = {tree} AND {name}j{i}.idx = {idx} // {16**i}" for i in range(levels))


def op11_sql(levels: int = 5) -> str:
    """The Merkle query, level by level; ``levels`` bounds the trees (16 to that power rows a source)."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([part("doc_id"), part("source"), part("lang"), part("n_chars"), part(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"{n}j{i}" for n in "ab" for i in range(levels)]
    proof = " || ".join(f"coalesce({s}.l || {s}.r, '')" for s in steps)
    folded = "CASE WHEN hit THEN altered ELSE leaf END"
    chain = [f"f0 AS (SELECT rows.*, suba.root AS subroot, {', '.join(f'{s}.l AS {s}l, {s}.r AS {s}r' for s in steps)}, sha256({proof}) AS proof_sha256, {folded} AS f FROM rows JOIN a_root suba USING (tree) {_joins_sql('a', 'rows.tree', 'rows.idx', levels)} {_joins_sql('b', '0', 'rows.tree', levels)})"]
    for i, s in enumerate(steps):
        chain.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN {s}l IS NULL THEN f ELSE sha256({s}l || f || {s}r) END AS f) FROM f{i})")
    return f"""
WITH leaves AS (
  SELECT doc_id, source, {leaf("text")} AS leaf, {leaf(lower)} AS altered, coalesce({_crc32_sql("doc_id::VARCHAR")} % 5 = 0, false) AS hit FROM documents
), rows AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM leaves
), {_levels_sql("a", "SELECT tree, idx, leaf AS h FROM rows", levels)}, {_levels_sql("b", "SELECT 0 AS tree, tree AS idx, root AS h FROM a_root", levels)}, {", ".join(chain)}
SELECT doc_id, leaf, subroot, b_root.root, proof_sha256, f AS folded_root, f = b_root.root AS verified FROM f{len(steps)}, b_root
"""


QUERIES = {"op1_packing": op1_packing, "op2_quality_classifier": op2_quality_classifier, "op3_toxicity": op3_toxicity, "op4_byte_bpe": op4_byte_bpe, "op6_nearest_vectors": op6_nearest_vectors, "op7_chat_format": op7_chat_format, "op9_html_text": op9_html_text, "op5_quality_rules": op5_quality_rules, "op5_rule_ablations": op5_rule_ablations, "op8_simhash_dedup": op8_simhash_dedup, "op10_url_filter": op10_url_filter, "op11_merkle": op11_merkle, "op12_whitening": op12_whitening, "op13_lm_score": op13_lm_score}
ORACLE_SQL = {"op5_quality_rules": OP5_SQL, "op5_rule_ablations": ABLATIONS_SQL, "op10_url_filter": OP10_SQL, "op11_merkle": op11_sql()}
