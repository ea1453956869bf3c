"""Registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lupa.llm import (
    edit_counts, infill, leaks, lines, long_bpe, near_dups, quality, substring, token_files, toxicity, urls, warc, whitening,
)

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
END = 1
RULES = (
    urls.Rule("block", "net/"), urls.Rule("allow", "example.net/en/"), urls.Rule("block", "example.com/de/"), urls.Rule("allow", "org/fr/"),
)
#: Words that mark the examples of ``block``; there are no labelled pages.
SEEDS = (
    "ads", "adult", "bet", "bets", "betting", "casino", "escort", "gambling", "loan", "loans", "lottery", "pharma", "pills", "poker",
    "porn", "sex", "slots", "spam", "viagra", "xxx",
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of equal words and near-duplicate group of every document."""
    return near_dups.groups(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written to token files and read back."""
    folder = token_files.new_folder(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), folder, WORDS, end_id=END)
    return token_files.checksums(token_files.read(spark, folder))


def op3_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    found = long_bpe.encode_decode(_table(spark, sf_dir, "documents"), BYTES)
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark found in every document."""
    found = leaks.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of the rule cascade for every document."""
    return quality.judged(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source."""
    found = lines.without_boilerplate(_table(spark, sf_dir, "documents"), "source", "text")
    return found.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"),
        F.col("text").alias("kept_text"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows that start earlier in the corpus."""
    found = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of the categories and verdict for every document."""
    documents = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    chain = toxicity.fit(documents, labels, ("low_quality", "toxic"))
    return toxicity.score(documents, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after addresses are masked."""
    trees = _stored(edit_counts.build(_table(spark, sf_dir, "documents"), BYTES))
    return edit_counts.recount(trees, None, BYTES, edits_of=edit_counts.masking_edits).select(
        "doc_id", "n_tokens_before", "n_edits", "n_tokens", "n_bytes_encoded"
    )


def _stored(trees: DataFrame) -> DataFrame:
    """The trees as they are kept between edits."""
    folder = token_files.new_folder(trees.sparkSession, "trees")
    trees.write.option("compression", "zstd").parquet(folder)
    return trees.sparkSession.read.schema(trees.schema).parquet(folder)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    folder = token_files.new_folder(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.payload_sizes(warc.read(spark, folder))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for the URL of every page."""
    pages = _table(spark, sf_dir, "pages")
    words = urls.words_model(urls.word_counts(pages), SEEDS)
    model = urls.fit(pages, words, urls.weak_label(SEEDS))
    return urls.judge(pages, model, RULES).select("page_id", "host", "path", "rule", "verdict")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding."""
    return whitening.components(_table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored in frames, transformed, and rebuilt from the transformed texts."""
    folder = token_files.new_folder(spark, "infill")
    infill.store(_table(spark, sf_dir, "documents"), f"{folder}/texts")
    infill.transform(spark, f"{folder}/texts", f"{folder}/transformed")
    return infill.read(spark, f"{folder}/transformed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_token_files, op3_bpe_tree, op4_decontamination, op5_quality_rules, op6_line_dedup,
        op7_substring_dedup, op8_toxicity, op9_edit_counts, op10_warc, op11_url_filters, op12_embedding_whitening,
        op13_fill_in_middle,
    )
}

#: Only where SQL expresses the whole result and is fast on whole tables; the rest has brute-force tests.
ORACLE_SQL = {
    "op6_line_dedup": rf"""
WITH hosts AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
held AS (SELECT source, line, count(*) AS n
         FROM (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents)
         WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line),
dropped AS (SELECT held.source, list(line) AS gone FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source
            WHERE n >= {lines.PAGES} AND n > {lines.RATIO} * pages GROUP BY held.source)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(list_filter(string_split(text, chr(10)), lambda x: list_contains(coalesce(gone, []), x))), 0) AS BIGINT) AS n_dropped,
       array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(gone, []), x)), chr(10)) AS kept_text
FROM documents LEFT JOIN dropped ON documents.source IS NOT DISTINCT FROM dropped.source""",
    "op10_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
h AS (SELECT payload_digest, max(page_id) AS held FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN held IS NOT NULL AND page_id IS DISTINCT FROM held THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM held THEN held END AS refers_to
FROM d LEFT JOIN h ON payload_bytes >= 1000 AND d.payload_digest = h.payload_digest""",
    "op13_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS v, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS w FROM d),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR v >= 90 THEN 'plain'
                  WHEN w < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p""",
}
