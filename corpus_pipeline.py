"""The corpus pipeline: documents pass one operator after the other."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, numbered
from millrace.llm.jaccard import jaccard_components
from millrace.llm.line_runs import line_dedup
from millrace.llm.packing import pack_documents
from millrace.llm.queries import table, tokenizer_path
from millrace.llm.substring import substring_dedup
from millrace.llm.toxicity import drop_toxic, train

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier does not reject; it learns as op7 does."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf_dir, "labels").filter(~held_out)
    return drop_toxic(docs, train(docs, labels))


def _shortened(docs: DataFrame, found: DataFrame, text: str, changed: Column) -> DataFrame:
    """Documents with what is left of their texts.

    ``found`` has a row per document, with its columns beside the text as fields of ``row``. One
    of which nothing but white space is left goes; others keep all their columns.
    """
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        n_chars = F.length(text).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed, n_chars).otherwise(F.col("row.n_chars"))
    rest = found.filter(~changed | F.rlike(text, F.lit(r"\S")))
    return rest.select(
        *(new.get(name, F.col("row").getField(name)).alias(name) for name in docs.columns)
    )


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of runs of three lines or twenty words; what was only copies goes."""
    others = [name for name in docs.columns if name != "text"]
    found = line_dedup(docs, min_lines=3, min_words=20, keep=others)
    return _shortened(docs, found, "text", F.col("n_removed") > 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the first stays, by id and text.

    Repeated rows are one document; a row without an id stays.
    """
    number = f"n{uuid.uuid4().hex}"
    docs_of = numbered(docs, number)
    groups = jaccard_components(docs_of, size=5, percent=80, id_column=number)
    gone = groups.filter("doc_id is not null and component_id != doc_id")
    gone = gone.select(F.col("doc_id").alias(number)).distinct()
    return docs_of.join(gone, number, "left_anti").select(*(docs_of[c] for c in docs.columns))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut word sequences of 20 words or more that stand earlier; others keep their text."""
    number = f"n{uuid.uuid4().hex}"
    others = [name for name in docs.columns if name != "text"]
    found = substring_dedup(numbered(docs, number), window=20, id_column=number, keep=others)
    return _shortened(docs, found, "kept_text", F.col("changed"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 ids."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_runs),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substrings),
    ("best_fit_packing", packing),
]

#: No SQL gives the classifier's rows; the tests compare with stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each one's rows are written before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
