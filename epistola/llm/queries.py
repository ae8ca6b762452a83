"""The registered queries of this subpackage; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epistola.llm import conversations, decontaminate, exact_dedup, html_text, line_dedup, ngram_join, personal, pieces, quality, sharding, token_counts, urls, vector_codes
from epistola.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), arrays=False, keep=["doc_id"])


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find(table(spark, sf_dir, "documents"), personal.labelled_table(spark), keep=["doc_id"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    names = F.array_join("hit_items", ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document counted, then counted again after three edits that its own text gives."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", sample_edits("text").alias("edits"))
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.count_edited(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"])


def sample_edits(text: str) -> Column:
    """Insert a phrase in the middle, delete up to 17 characters at the third, replace up to 5 at the start."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")

    def edit(position: Column, deleted: int, inserted: str) -> Column:
        return F.struct(position.cast("long").alias("position"), F.lit(deleted).cast("long").alias("deleted"), F.lit(inserted).alias("inserted"))

    return F.array(edit(F.floor(n / 2), 0, " see also the 2nd note's"), edit(F.floor(n / 3), 17, ""), edit(F.lit(0), 5, "Draft: "))


def damaged(df: DataFrame) -> DataFrame:
    """The contract's damage: crc32 of conv_id:turn, modulo 20, drops, empties, strips ends, repeats or makes a user turn; nulls are one space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = df.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        *("conv_id", "turn"),
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("code") != 0).alias("present"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time"),
    ).drop("time")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = conversations.repair(damaged(table(spark, sf_dir, "conversations")), present="present")
    figures = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    rows = repaired.select(*figures, "part", "parts", "audit", F.size(lines).alias("n_lines"), F.array_join(lines, "\n").alias("lines"))
    whole = rows.where("parts = 1").select(*figures, "audit", F.sha2(F.col("lines").cast("binary"), 256).alias("repaired_sha256"))
    return whole.unionByName(conversations.digest_parts(rows.where("parts > 1"), figures))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    left = line_dedup.apply(docs, line_dedup.bitmaps(docs), keep=["doc_id"])
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    told = vector_codes.with_label_errors(rows)
    return told.select(F.col("key").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_html_text": op3_html_text,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_url_filters": op5_url_filters,
    "op6_personal_data": op6_personal_data,
    "op7_decontamination": op7_decontamination,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_line_dedup": op12_line_dedup,
    "op13_vector_codes": op13_vector_codes,
}
