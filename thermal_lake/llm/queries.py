"""One query for each operator, with the parameters meant for production, and its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermal_lake.session import cut, scratch_path

from . import bpe, decontamination, html_extraction, jaccard_join, language_id, multi_index, prefix_trie, quality_classifier, quality_rules, secrets, sharding, token_files, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the files written."""
    path = scratch_path(spark, "tokens")
    parts = token_files.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, path, parts)


@query()
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count, class of equal sets and component of linked documents of every document."""
    return jaccard_join.join(table(spark, sf_dir, "documents"))


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the two thirds of labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    model = language_id.train(docs.where(~F.col("held_out")))
    out = language_id.label(docs, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


@query()
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document: the fixed patterns and the randomness tests."""
    found = secrets.find(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("all").alias("spans"))


@query()
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from two co-trained views."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(sharding.SQL)
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document and the slots of the directory that lead to it."""
    return sharding.assign(table(spark, sf_dir, "documents"))


@query()
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, with their edit distances."""
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as checksums."""
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query()
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and risk-controlled verdict of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    measured = cut(quality_rules.measure(docs, ["doc_id", "lang"]))  # a few numbers a row, used twice
    cutoffs = quality_rules.fit(measured, labels)
    out = quality_rules.judge(measured, cutoffs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_extraction.label(pages, html_extraction.train(pages), ["page_id", "url"])


@query(prefix_trie.SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, each begun with the first turns of the first conversation of its five."""
    conv = F.col("conv")
    turns = prefix_trie.positions(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.regrafted(turns, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8))


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query()
def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every embedding whose id is divisible by 20, among all others."""
    entries, book = multi_index.build(table(spark, sf_dir, "embeddings"))
    return multi_index.search(entries, book, lambda i: i % 20 == 0)
