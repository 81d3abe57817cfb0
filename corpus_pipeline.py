"""The corpus pipeline: stages over documents, each written as Parquet and read back as the next one's input.

Toxic documents go, one document of each near-duplicate group stays, documents with benchmark passages go, secrets are
masked, and sources are mixed to their target weights. All stages but the last return the columns of documents; the last
returns them once for each time that the mix takes the document, with the copy's number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideflow.llm.common import checkpointed, shared_folder, small_or_shuffled, table
from tideflow.llm.decontamination import contamination
from tideflow.llm.mixing import mix
from tideflow.llm.ngram_join import shingle_components
from tideflow.llm.secret_scan import redact
from tideflow.llm.toxicity import toxicity_scores

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _same() -> F.Column:
    return F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row"))


def _without(docs: DataFrame, rows: DataFrame, *hashed: str) -> DataFrame:
    """docs but for those in rows (doc_id, row), where row is a hash of the named columns: other rows of a doc_id stay."""
    bad = small_or_shuffled(checkpointed(rows.select(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row")).distinct()))
    return docs.select(*COLUMNS, F.xxhash64(*hashed).alias("row")).join(bad, _same(), "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't flag as toxic at their language's threshold.

    Each row is judged by its own text and language, also where doc_ids repeat or are null; null and empty texts have the
    score of no words; an empty table gives an empty one.
    """
    scores = toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scores.where("flagged"), "text", "lang")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the least doc_id (null last), then the least hash of its text.

    Of equal rows of that kind the first by language, source and length stays. Texts without words link with nothing, so
    all of them stay.
    """
    classes = checkpointed(shingle_components(docs).where("n_shingles > 0"))
    own = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("row") == F.col("lead.row"))
    kept = _without(docs, classes.where(~own).select("doc_id", "row"), "text")
    repeated = classes.where(own).groupBy("doc_id", "row").count().where("count > 1").select(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row"))
    repeated = small_or_shuffled(checkpointed(repeated))
    keyed = kept.withColumn("row", F.xxhash64("text"))
    first = Window.partitionBy("doc_id", "row").orderBy("lang", "source", "n_chars")
    once = keyed.join(repeated, _same(), "left_semi").withColumn("n", F.row_number().over(first)).where("n = 1")
    return keyed.join(repeated, _same(), "left_anti").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window, each row by its own text; rows without words stay."""
    return _without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"), "text")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew where any was; other texts, null ones too, as they are."""
    return redact(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, equal rows alike; null sources are a source, rows without words weigh nothing."""
    return mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
]

#: A trained classifier is a stage, so SQL can't express the rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns; what stages write goes to the shared checkpoint folder."""
    shared = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared}/pipeline-{uuid.uuid4().hex}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
