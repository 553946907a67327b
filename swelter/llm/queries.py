"""The subpackage's queries, opN_<name>(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swelter.llm import ann, convnet, fim, license, linededup, minhash, mixing, packing, quality, toxicity, urlfilter, variants, warc
from swelter.llm.common import new_path, owning, table, written
from swelter.llm.oracle import SQL  # noqa: F401


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of all pages through WARC archives, one row per capture."""
    done = warc.round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return done.select(
        warc.capture_key().cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        warc.capture_key("original.metadata").cast("long").alias("refers_to"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document."""
    out = linededup.deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.md5("_text").alias("kept_md5"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at weights 5, 2, 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.mixed(docs)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(toxicity.fold_of(F.col("doc_id")) != 0))
    out = toxicity.scored(docs, model)
    return out.select(
        "doc_id", F.coalesce(toxicity.fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.size("_passages").alias("n_passages"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    rules = spark.sql("VALUES " + ", ".join(map(str, urlfilter.RULES))).toDF("host", "path", "verdict")
    out = urlfilter.judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, and whether it stands for it."""
    out = minhash.classified(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_class").alias("class_id"), F.col("_first").alias("stands_for_class"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the risk-controlled verdict of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    narrow = written(quality.features(docs.select("doc_id", "text", "lang")).select("doc_id", "lang", "_q"), "quality")
    out = quality.apply_cutoffs(narrow, quality.thresholds(narrow, labels, "lang"))
    return out.select(
        "doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words",
        F.col("_base_failed").alias("base_failed"),
        (~F.col("_base_failed") & (F.size("_rules") == 0)).alias("kept"),
        F.array_join("_rules", ",").alias("rejected_by"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, labels and score of every document."""
    out = license.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), *[c.alias(n) for n, c in license.digest(F.col("_spans")).items()])


def op10_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.searched(rows, rows.where(F.col("vec_id") % 20 == 0))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of the documents."""
    return variants.grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fill-in-the-middle form, by hashes of its output and of the text put back."""
    out = fim.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda text: F.sha2(text, 256)
    return out.select(
        "doc_id", F.col("_n").alias("n"), F.col("_form").alias("form"), F.length("_prefix").cast("long").alias("prefix_chars"), F.length("_middle").cast("long").alias("middle_chars"),
        sha(F.col("_output")).alias("output_sha256"), sha(fim.restored(F.col("_output"), F.col("_form"))).alias("restored_sha256"),
    )


def op13_quality_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    net = convnet.fit(docs, labels.where(convnet.fold_of(F.col("doc_id")) != convnet.HELD_OUT))
    out = convnet.scored(docs, net)
    held_out = F.coalesce(convnet.fold_of(F.col("doc_id")) == convnet.HELD_OUT, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {
    f.__name__: owning(f)
    for f in (op1_warc_transactions, op2_line_dedup, op3_mixing, op4_packing, op5_toxicity, op6_url_filter, op7_order_minhash, op8_quality_rules, op9_license_scan, op10_forest_search, op11_spelling_variants, op12_fill_in_middle, op13_quality_convnet)
}
