"""The corpus pipeline: five stages over documents, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents.

Edge cases, in every stage: null and empty texts are kept by the filters and unchanged by the rest; rows with a
null doc_id are documents like others; rows that are equal in id and text are one document to drop_near_duplicates,
which keeps one of them, and are treated alike elsewhere; documents of any length are read whole; an empty table
gives an empty one; other columns stay as they are, whatever their names. Only hide_secrets changes a text, and
n_chars with it. mix_sources returns a row for every row it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm._common import arrow_rows, plainly, row_key, stored, table
from mercadia.llm.decontamination import decontaminate
from mercadia.llm.jaccard_join import keep_one
from mercadia.llm.mixing import mix
from mercadia.llm.secrets import redact
from mercadia.llm.toxicity import ROWS_AT_ONCE, fit, score

#: What the stages know of a document. Other columns pass through them under plain names.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go."""
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))

    def keep(rows: DataFrame) -> DataFrame:
        scored = score(rows, model, *[c for c in rows.columns if c != "text"], with_text=True, name="__m_score")
        # written here: few rows at a time go to Python, and the later stages' executors don't hold the model
        with arrow_rows(spark, ROWS_AT_ONCE):
            kept = stored(scored.where("__m_score < 0.5").select(*rows.columns), "ordinary")
        model.unship()
        return kept

    return plainly(docs, DOCUMENT, keep)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return plainly(docs, DOCUMENT, keep_one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).where("contaminated")
    leaks = stored(found.select(F.col("row_key").alias("__m_key")).distinct(), "leaks")
    keep = lambda rows: rows.withColumn("__m_key", row_key(rows["doc_id"], rows["text"])).join(leaks, "__m_key", "left_anti").select(*rows.columns)
    return plainly(docs, DOCUMENT, keep)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return plainly(docs, DOCUMENT, redact)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes."""
    return mix(docs.select("doc_id", "text", "source")).drop("sources")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
]

#: The first stage's model can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
