"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLES as ORACLES


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_docs(spark, sf_dir)).select("doc_id", "fingerprint", "component_id", "group_size")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_docs(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score, training_rows

    docs = _docs(spark, sf_dir)
    out = score(docs, fit(*training_rows(docs, _labels(spark, sf_dir))), locate=True)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import round_trip

    return round_trip(_docs(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op5_substring_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chaining import passages

    return passages(_docs(spark, sf_dir))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_exact import remove_repeats

    return remove_repeats(_docs(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(_docs(spark, sf_dir), _labels(spark, sf_dir), keep=("doc_id",))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_docs(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules, labelled_sample, learn_rules

    docs = _docs(spark, sf_dir)
    rules = learn_rules(labelled_sample(docs, _labels(spark, sf_dir)))
    return apply_rules(docs.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_packing, op3_toxicity, op4_sentencepiece, op5_substring_chaining, op6_suffix_array, op7_quality_classifier, op8_embeddings, op9_sharding, op10_quality_rules)}
