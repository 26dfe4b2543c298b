"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm import decontaminate, flac, mixing, pii, quality, repair, simhash, suffix, toxicity, urls
from loamwork.llm.common import read_table, stage, table_path


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_values and their kinds and places, for every document."""
    out = pii.pseudonymize(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_values"), "pii")


def op2_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from Re-Pair shards; end id 2."""
    path = table_path(spark, "token-shards")
    repair.write_tokens(read_table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return repair.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken over all documents."""
    docs = read_table(spark, sf_dir, "documents")
    sized = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", mixing.word_count(F.col("text")).alias("size")), "sizes")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _held_out(folds: int, held: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held


def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", _held_out(toxicity.FOLDS, toxicity.HELD_OUT).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 over all documents, strings of 200 bytes."""
    out = suffix.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, and the share of good text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", _held_out(quality.FOLDS, quality.HELD_OUT).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"), "good_share")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return urls.judge_urls(read_table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op8_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a FLAC stream of 8-bit samples, stored, read back and decoded; digests and features of both."""
    media = stage(flac.encode_column(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "flac", level=9)
    out = flac.decode_column(media, keep=("doc_id", "n_bytes"))
    return out.select(
        "doc_id", "n_bytes", F.length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pcm, -32)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.format_string("samples=%d;crossings=%d;energy=%d", "n_samples", "crossings", "energy").alias("feature"),
    )


def op9_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id and the distance of each benchmark item found in a document."""
    out = decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "item_words", "distance", F.round("similarity", 6).alias("similarity"), F.col("start").alias("first_word"), F.col("end").alias("end_word"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id over all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.hamming_components(simhash.fingerprints(docs, shingle_words=3))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict:
    found = (
        op1_feistel_pseudonyms, op2_repair_token_ids, op3_mix_sources, op4_counterfactual_toxicity, op5_suffix_array_dedup,
        op6_crf_quality, op7_url_filter, op8_flac_media, op9_cgk_decontamination, op10_simhash_near_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": mixing.ORACLE, "op7_url_filter": urls.ORACLE}
