"""A corpus pipeline: documents in, token ids out.

Toxic documents go, then those of no clear language, then all but one of each
group of near copies, then those that hold benchmark items; what remains is
encoded.  Every stage gets the table that the one before has written.

Null ids, null and empty texts, ties, repeated rows and further columns are
handled as the operators say.  Toxicity, language and benchmark items are judged
row by row, whatever the id; among near copies rows with one id stay or go
together and rows without an id all stay.  A text without a letter has no
language and goes.  An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, langid, ngram_join, pieces, toxicity
from sluice.llm.common import drop_path, table, written
from sluice.llm.queries import residue

#: A stage on word shingles takes five words and a similarity of 0.8 or more.
NEAR = {"width": 5, "num": 80, "den": 100}


def _packed(docs: DataFrame) -> DataFrame:
    """Each row as one column beside its id, its text and a key of both, so that an operator's columns clash with none of it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def _without(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """The packed rows of which the column is not in gone; gone is written first, so that its size is known when the join is planned."""
    gone, _ = written(gone.select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return rows.join(gone, F.col(column) == F.col("_gone"), "left_anti").select("_row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), residue("doc_id", 5) != 0)
    return toxicity.predict(_packed(docs), model).filter(F.col("predicted") == 0).select("_row.*")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dictionaries = langid.train(docs, residue("doc_id", 3) != 1)
    return langid.predict(_packed(docs), dictionaries).filter(~F.col("rejected")).select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join.join(docs, **NEAR)
    return _without(_packed(docs), "doc_id", groups.filter(F.col("component_id") != F.col("doc_id")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _packed(docs)
    return _without(rows, "key", decontaminate.matches(rows.select("key", "text"), table(spark, sf_dir, "benchmark"), id_col="key"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(spark, docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids", "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]
#: SQL cannot express the trained stages; tests hold every stage against a plain version on a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents of a data folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before:
            drop_path(spark, before)
        before = path
    return docs
