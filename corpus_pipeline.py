"""A corpus pipeline of five stages: toxicity, line dedup, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import decontam, line_templates, near_dup, packing, toxicity
from cohortlab.llm.common import materialise, quoted, table
from cohortlab.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier chain rejects go. Every row is judged by its own text, so a repeated or null doc_id
    doesn't matter; null and empty texts are judged by their shape. No labels: nothing goes. Other columns pass as they are."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but their first; documents that had text and have none left go too.

    n_chars, if there, follows the text. Null and empty texts stay; repeated rows count as one document and are treated
    alike; null doc_ids come first; an empty table gives an empty one; other columns may have any name."""
    out = line_templates.drop_recurring_lines(docs)
    left = (quoted(out.columns[-1]) == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return out.where(left).select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else quoted(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least doc_id: five words a shingle, 0.8 or more alike.

    Rows are told apart by doc_id and text; equal rows are one document, of which one row stays. Null and empty texts
    and null doc_ids stay; an empty table gives an empty one; other columns may have any name."""
    return near_dup.drop_near_duplicates(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text overlaps with a benchmark item go, each by its own text. Null and empty texts stay, no benchmark
    leaves all; other columns pass as they are."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 2048 tokens. Null and empty texts are one piece with the end id."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), length=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: toxicity is a fitted model and packing needs a tokenizer: SQL expresses neither
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
