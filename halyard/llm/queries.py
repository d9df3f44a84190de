"""The registered queries of the training-data operators.

Each applies its operator, with production parameters, to the whole of its
table, and derives the digest columns that its result is compared by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import lines
from halyard.llm.jaccard import jaccard_components
from halyard.llm.language import identify_documents, held_out
from halyard.llm.mixing import mixed_summary
from halyard.llm.packing import best_fit_packing
from halyard.llm.privacy import KINDS, TERM, find_personal_data, named
from halyard.llm.substrings import dedup_substrings
from halyard.llm.suffixes import dedup_bytes
from halyard.llm.vectors import near_duplicates, top_k, usable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_summary(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify_documents(docs, public_tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(named(KINDS).cast("binary"), 256).alias("base_sha256"), named((*KINDS, TERM)).alias("spans"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.when(usable(F.col("embedding")), whole).alias("vector"))
    return top_k(vectors.where("vec_id % 20 = 0"), vectors)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return best_fit_packing(docs, public_tokenizer("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_language_id": op2_language_id,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_personal_data": op4_personal_data,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_threshold_topk": op6_threshold_topk,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_near_vectors": op9_near_vectors,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": lines.ORACLE_SQL}
