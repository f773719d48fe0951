"""Cleaning and packing of the document corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. ``run`` writes every stage's result as Parquet in the shared checkpoint folder and hands what
it reads back to the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.lines import drop_recurring_lines
from emberline.llm.packing import pack_notes
from emberline.llm.passages import drop_repeated_passages
from emberline.llm.quality import fit_quality, keep_reliable
from emberline.llm.queries import notes_of, vocabulary
from emberline.llm.resemblance import keep_one_of_resembling
from emberline.llm.samples import in_fold
from emberline.session import cut_lineage


def _notes(docs: DataFrame) -> DataFrame:
    """Documents as observations; the other columns come along in one struct, whatever their names."""
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(F.col("doc_id").alias("obs_id"), F.col("text").alias("note"), F.struct(*others, F.lit(0).alias("__")).alias("rest"))


def _docs(notes: DataFrame, like: DataFrame) -> DataFrame:
    """Back to the columns of ``like``, with the length of the text as it is now."""
    place = {"doc_id": F.col("obs_id"), "text": F.col("note"), "n_chars": F.length("note").cast("bigint")}
    return notes.select(*[place.get(c, F.col(f"rest.`{c}`")).alias(c) for c in like.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled rows outside the held-out fold."""
    ratings = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("obs_id"), F.col("quality").alias("reliable"))
    model = fit_quality(notes_of(spark, sf_dir), ratings.where(~in_fold("obs_id")))
    return _docs(keep_reliable(_notes(docs), model, keep_from=0.3), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of templates that recur across documents."""
    return _docs(drop_recurring_lines(_notes(docs), carry=["rest"]), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash or by shared five-word shingles: that of the smallest doc_id."""
    return _docs(keep_one_of_resembling(_notes(docs), shingle_words=4, radius=4, share_words=5, least_share=0.8), docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 words or more that stand elsewhere too."""
    return _docs(drop_repeated_passages(_notes(docs), window=35, keep_gaps=True, carry=["rest"]), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences of 4096 tokens; less is held at once than alone, workers of earlier stages are still there."""
    packed = pack_notes(_notes(docs), vocabulary("word_bpe_49k.json"), end_id=2, room=4096, slice_bytes=1 << 19, cache=50_000)
    return packed.withColumnRenamed("obs_id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("packing", packing),
]

# A boosted classifier and its fit are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
