"""A corpus pipeline of the training-data operators: (name, function) stages over documents.

Each function takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents, with ``n_chars`` counted anew where texts change.

Every stage takes null doc_ids, sources and texts, repeated rows, tables without rows and further columns of any name. What a stage makes of
texts without words is said in its docstring; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm.line_dedup import remove_boilerplate
from fairlead.llm.mixing import MixRules, mixed_documents
from fairlead.llm.packing import pack
from fairlead.llm.shingle_join import JoinRules, one_of_each_group
from fairlead.llm.tokens import tokenizer_file
from fairlead.llm.toxicity import fitted, without_toxic
from fairlead.sources.tables import Staging

#: Longer blocks than in the report of the mix: most documents are then taken whole or not at all.
MIX = MixRules(block_words=256)
#: Word shingles of five, similarity 0.8.
NEAR = JoinRules(width=5, percent=80)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the severity model, fitted on the labels of ``sf_dir``, rejects.

    A null or empty text has no features, so it is judged by the thresholds alone and stays. Without labels of two grades all stay.
    """
    return without_toxic(docs, fitted(spark, sf_dir, docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines that many sources share stay only in the first document that has them.

    A null text stays null and an empty one empty; a document may become empty. Rows of one doc_id and text are treated alike.
    """
    return _counted(remove_boilerplate(docs, Staging(spark)).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked by similar sets of shingles.

    Documents without words are linked with nothing and stay, repeated rows of them too; of other repeated rows one stays.
    """
    return one_of_each_group(docs, Staging(spark), NEAR)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes; a document taken more than once gives more than one row.

    Documents without words are not part of a mix; without any words there is no row.
    """
    return _counted(mixed_documents(docs, Staging(spark), MIX))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. Every document has at least its end token; null counts as empty."""
    return pack(docs, tokenizer_file(), Staging(spark))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

# No SQL twin: SQL cannot express the fitted model, the seeded draw or the token ids; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    staging = Staging(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staging.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
