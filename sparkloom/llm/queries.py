"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, lines, resample, substring, suffixes
from .common import crc_bucket, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import digests, pack

    return digests(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_quality(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digests, scan

    return digests(scan(table(spark, sf_dir, "documents")))


def op7_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    known = table(spark, sf_dir, "conversations")
    model = chat.fit(known, crc_bucket("conv_id", 5) != 0)
    # half of the transcripts are in styles that the model wasn't fitted on
    found = chat.parse(chat.transcripts(known, styles=chat.STYLES + chat.UNSEEN), model)
    return found.select("conv_id", (F.col("part") * chat.PART_TURNS + F.col("seq")).alias("turn"), "role", "text", "rendered")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score

    return score(table(spark, sf_dir, "documents"), crc_bucket("doc_id", 7) == 2)


def op10_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .forest import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digests(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_retrieval_packing": op2_retrieval_packing,
    "op3_line_frequency": op3_line_frequency,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_transcripts": op7_transcripts,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_ppm": op9_ppm,
    "op10_hash_prefix_forest": op10_hash_prefix_forest,
    "op11_resample": op11_resample,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_frequency": lines.oracle(),
    "op4_substring_dedup": substring.oracle(),
    "op11_resample": resample.oracle(),
    "op12_suffix_dedup": suffixes.oracle(),
    "op13_vector_codes": codes.oracle(),
}
