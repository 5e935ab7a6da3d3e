"""One query per operator of this package over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.collocations import collocations
from millrace.llm.jaccard import jaccard_components
from millrace.llm.language_model import cross_entropy_difference
from millrace.llm.licenses import license_scan
from millrace.llm.line_runs import line_dedup
from millrace.llm.near_vectors import near_vectors
from millrace.llm.oracles import ORACLES
from millrace.llm.packing import pack_documents
from millrace.llm.prefix_trie import conversation_trie
from millrace.llm.quality_rules import judge, learn
from millrace.llm.sentencepiece import encode_documents
from millrace.llm.substring import substring_dedup
from millrace.llm.topk import top_k, usable
from millrace.llm.toxicity import score, train

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return encode_documents(documents, tokenizer_path("piece_bpe_32k.model"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pack_documents(documents, tokenizer_path("word_bpe_49k.json"))


def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("places")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts without later copies of runs of three lines, or of twenty words in fewer."""
    found = line_dedup(table(spark, sf_dir, "documents"), min_lines=3, min_words=20)
    return found.select(
        "doc_id", "n_lines", "n_removed", "longest_run", F.sha2("text", 256).alias("kept_sha256")
    )


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels of four fifths of the ids and scores all texts."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train(documents, labels.filter(~held_out))
    return score(documents, model).select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more the texts are like those labelled as good than like all texts."""
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all, by inner product of whole numbers."""
    embeddings = table(spark, sf_dir, "embeddings").filter(usable("embedding"))
    vectors = embeddings.select(
        F.col("vec_id").alias("id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("terms"),
    )
    return top_k(vectors, vectors.filter("id % 50 = 0"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labelled texts and judges all of them."""
    documents = table(spark, sf_dir, "documents")
    rules = learn(documents, table(spark, sf_dir, "labels"))
    return judge(documents, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule",
    )


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": substring,
    "op2_sentencepiece": sentencepiece,
    "op3_best_fit_packing": best_fit_packing,
    "op4_license_scans": license_scans,
    "op5_line_dedup": lines,
    "op6_embedding_near_dedup": embedding_near_dedup,
    "op7_toxicity": toxicity,
    "op8_lm_scoring": language_model,
    "op9_exact_top_k": exact_top_k,
    "op10_ngram_jaccard_join": jaccard_join,
    "op11_quality_rules": quality_rules,
    "op12_phrase_collocations": phrase_collocations,
    "op13_conversation_prefix_trie": prefix_trie,
}
