"""Quality classifier: supervised subword embeddings; case is kept, as shouting is a sign."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import subword

SETTINGS = subword.Settings(lower=False)
THRESHOLD = 0.7


def held_out(doc_id="doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def model(docs: DataFrame, labels: DataFrame, settings: subword.Settings = SETTINGS):
    """The model of the labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(~held_out())
    return subword.learn(docs, known, settings)


def keep(docs: DataFrame, labels: DataFrame, settings: subword.Settings = SETTINGS, threshold: float = THRESHOLD, learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of docs that are predicted to be good, as they are; rows without an id too."""
    scored = subword.with_score(docs, model(docs if learn_from is None else learn_from, labels, settings), settings, name="_score")
    return scored.where(F.col("_score") >= threshold).drop("_score")


def classify(docs: DataFrame, labels: DataFrame, settings: subword.Settings = SETTINGS, threshold: float = THRESHOLD, learn_from: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted): the chance that labels.quality marks a document
    with 1, learnt from the rows that are not held out, with the texts of learn_from (docs, if none).

    Only texts are inputs. Null and empty texts get the score of no tokens; without labels
    of both classes every score is their share of 1, or one half without any. Rows without
    an id take no part, repeated rows each give a row, other columns are ignored."""
    scored = subword.score(docs, model(docs if learn_from is None else learn_from, labels, settings), settings)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
