"""The corpus pipeline: toxicity, exact and near copies, benchmark leaks, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``.  All stages but the last
return the columns of ``documents``, further ones included and whatever their names;
their decisions take effect.  Null texts count as empty: they are not toxic, copies
of each other, and leak nothing.  An empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.llm import decontamination, exact_dedup, near_dedup, sentencepiece_codec, toxicity
from confluo.llm.common import discard, fresh, stored, table, text_of


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.5; a null text has no words and stays."""
    score = fresh(docs, "score")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, model, score).filter(F.col(score) < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id."""
    return near_dedup.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    items, cover = fresh(docs, "item_ids"), fresh(docs, "cover")
    marked = decontamination.with_leaks(docs, table(spark, sf_dir, "benchmark"), items_column=items, cover_column=cover)
    return marked.filter(F.size(items) == 0).select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document left, and whether they decode to its text."""
    import public_tokenizers

    tables = sentencepiece_codec.load(public_tokenizers.path("piece_bpe_32k.model"))
    coded = sentencepiece_codec.encode(docs.select("doc_id", "text"), tables, decoded_column="decoded")
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", (F.col("decoded") == text_of(coded)).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", to_pieces),
]

#: A fitted classifier and an aligned sketch join have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written out and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return docs
