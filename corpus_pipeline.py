"""A corpus pipeline of five stages; each works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import bpe, decontaminate, quality, simhash, substring
from gridspark.llm.common import checkpointed, table_of
from gridspark.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF predicts to be good; it is fitted on labels outside the held-out fifth.

    A null or empty text is scored as one empty line; repeated rows are scored alike.
    """
    model = quality.trained(table_of(spark, sf_dir, "documents"), table_of(spark, sf_dir, "labels"))
    return quality.kept(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts whose five-word shingles are 0.8 alike or more.

    Texts without words are one group; rows with a null id stay, as do all rows that share a kept id.
    """
    return simhash.without_similar(docs)


def drop_repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start earlier elsewhere; a document that loses all its words goes.

    A text that had none, null or empty, stays. A column n_chars is counted anew.
    """
    out = substring.cleaned(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate; a text without words is clean."""
    return decontaminate.decontaminated(docs, table_of(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their digest, and the digest of the text decoded from them; a null text has no tokens."""
    return bpe.encoded(docs, tokenizer_path()).drop("text")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_windows),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding", encode),
]

#: The quality model and SimHash can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared checkpoint folder and read again.

    Columns beyond those of documents pass through all stages with their values,
    except that the last replaces those of its results' names. Null, empty and
    very long texts, ties and repeated rows are taken as each stage says; an empty
    table gives no rows.
    """
    docs = table_of(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
