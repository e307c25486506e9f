"""A training-corpus pipeline over ``documents``: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stressline.llm import registry
from stressline.llm.exact_dedup import keep_one_of_each
from stressline.llm.jaccard_join import keep_one_of_component
from stressline.llm.packing import pack_documents
from stressline.llm.quality import keep_good
from stressline.llm.source_mixing import mixed_texts
from stressline.llm.storage import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null, empty and blank texts are rejected; repeated rows
    and rows with nulls elsewhere go or stay by their text alone; a score at the threshold stays; very long texts are scored whole; an empty table
    stays empty; all columns pass through, whatever their names."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: most code points, then smallest doc_id (nulls last), then smallest text digest; of
    wholly repeated rows one. Null, empty and blank texts are one group; very long texts count like others; an empty table stays empty; all columns
    pass through."""
    return keep_one_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the smallest doc_id (nulls last), then the smallest text digest, of each near-duplicate component; of wholly
    repeated rows one. Rows without words link with nothing and all stay; very long texts are compared whole; an empty table stays empty; all columns pass through."""
    return keep_one_of_component(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each run of words that a draw takes from a document, with the document's columns. Rows without words are
    never drawn; a null source is a source of its own; repeated rows are separate documents; a very long text gives many rows; an empty table stays empty."""
    return mixed_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed windows of tokens: a row for each piece of a mixed text, with its token ids. Null and empty texts are one end id; repeated rows
    are packed once each; a very long text gives many pieces; an empty table gives none."""
    return pack_documents(docs, tokenizer=registry.tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: The stages hold models and tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
