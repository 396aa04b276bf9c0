"""A corpus-cleaning pipeline of the operators in schemaloom.llm.

Each stage takes the documents that its predecessor kept. All but the last return the columns of documents; the last returns the encoded texts.

What holds for every stage: texts are read whole, however long; further columns of documents, whatever their names, are passed on by all stages but the
last; an empty table gives an empty table. Each docstring says what becomes of rows without an id, null and empty texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from schemaloom.llm.decontaminate import without_benchmark
from schemaloom.llm.ngram_join import one_of_each_group
from schemaloom.llm.pieces import encoded
from schemaloom.llm.pii import redacted
from schemaloom.llm.scratch import saved, table
from schemaloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, trained on labelled ones, finds toxic. Rows are judged one by one by their text alone, also repeated ids and
    rows without an id; null and empty texts get the model's bias; a score of exactly 0.5 is toxic."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of similar texts the document of the smallest id. Rows that repeat id and text stay once, all texts of a kept id stay; null and
    empty texts and rows without an id stay; a similarity of exactly 80 % links."""
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item. Rows are judged one by one by their text alone, also repeated ids and rows without an id; null
    and empty texts stay; a score or overlap of exactly the threshold counts as contained."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by its kind; n_chars follows the text. Null texts stay null; of overlapping spans the one that begins first, or of
    these the first kind, names all; repeated rows and rows without an id are treated like others."""
    return redacted(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece_ids) of every row, also repeated ones and those without an id. Null and empty texts have no pieces; of equally good segmentations
    the one with the longest last pieces is taken."""
    return encoded(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: Learned stages can't be expressed in SQL; tests/llm/test_pipeline.py holds the pipeline against plain Python over all pairs and passages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
