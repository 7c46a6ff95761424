"""The queries opN_<name> over the whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary file of the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.llm.line_dedup import dedup_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.length("kept_text").cast("long").alias("n_kept_chars"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.llm.license_scan import license_scan

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan(docs).select("doc_id", "n_known_sentences", F.array_join("rules", ",").alias("rules"), F.array_join("licenses", ",").alias("licenses"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.llm import bpe

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizer_path(), decoded="decoded", keep=["doc_id"]).select(
        "doc_id",
        bpe.token_count().alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.llm.html_extract import extract_main_text

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.llm.quality_rules import quality_rules

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.llm.decontaminate import matched_items

    return matched_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.llm import toxicity as tox

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    grammar = tox.fit(docs, labels.where(~tox.held_out()))
    scored = tox.toxicity(docs, grammar)
    return scored.select("doc_id", tox.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.llm.sharding import assign_shards, number_slots

    docs = _table(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    dealt = assign_shards(assign_shards(sized), weights=(1.0,) * 9, to="grown_shard")
    return number_slots(dealt, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.llm.chat_format import format_chat, read_chat

    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = read_chat(format_chat(turns, tokenizer_path()), tokenizer_path())
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.llm.fill_in_middle import fill_in_middle

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle(docs).select("doc_id", *[f"fim.{c}" for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracklake.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """The others are held against brute force, a round trip or held-out labels in tests/llm."""
    from tracklake.llm import sql

    return {"op1_line_dedup": sql.line_dedup(), "op2_license_scan": sql.license_scan(), "op3_minhash": sql.minhash(), "op6_suffix_dedup": sql.suffix_dedup(), "op7_quality_rules": sql.quality_rules(), "op8_decontaminate": sql.decontaminate(), "op10_sharding": sql.sharding(), "op11_chat_format": sql.chat_format(), "op12_fill_in_middle": sql.fill_in_middle(), "op13_hard_negatives": sql.hard_negatives()}
