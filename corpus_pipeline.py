"""From raw documents to packed training sequences: five stages, each one operator.

Every stage but the last returns the columns it got, whatever their names; an empty table stays
empty; rows are only dropped for the reason that the stage names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loopwright.llm.common import session, stored, table
from loopwright.llm.decontamination import drop_leaks
from loopwright.llm.near_dedup import keep_one
from loopwright.llm.packing import pack_documents
from loopwright.llm.pii import redact
from loopwright.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the fences of their language and source.

    NULL, empty and blank texts have no words and go, as all texts of fewer than ten words do.  A NULL
    language or source is a group of its own.  Repeated rows stay or go together.
    """
    session(spark)
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Of rows that repeat an id and its text one stays.  Rows without words have no duplicates and all
    stay.  A row with a NULL id goes if another document has its shingles, else it stays.
    """
    session(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``.

    NULL and empty texts hold none.  Repeated rows go together, those with a NULL id by their text.
    Without test items all documents stay.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked.

    NULL texts stay NULL.  ``n_chars`` is set anew where a text changed and is left as it is, NULL too,
    elsewhere.  Repeated rows are masked alike.
    """
    session(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, in place of the documents.

    NULL and empty texts are their end mark alone.  Repeated rows are packed each; NULL ids stay NULL.
    """
    session(spark)
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

# No SQL: the stages hold learned models and hashed candidate search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
