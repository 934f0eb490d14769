"""Panels that follow a stream of documents: the incremental update as micro-batches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lexicons import Lexicons
from ..operators.scoring import sentiment


def scored_stream(corpus: DataFrame, lexicons: Lexicons | Mapping[str, Lexicons], how: str = "proportional", watermark: str = "30 days") -> DataFrame:
    """Sentiment of a streaming corpus, its date a timestamp under the watermark; of documents with the same id within the watermark the first counts.

    Weights by word frequency need all documents and aren't offered.
    """
    if how == "TFIDF":
        raise ValueError("TFIDF needs the whole corpus")
    once = corpus.withColumn("date", F.col("date").cast("timestamp")).withWatermark("date", watermark).dropDuplicatesWithinWatermark(["id"])
    return sentiment(once, lexicons, how)


def sums_by_period(scored: DataFrame, window: str = "1 day") -> DataFrame:
    """Mean score and documents by window, lexicon and feature, zeros left out; a window is given out once the watermark has passed it (mode append)."""
    rows = scored.where("score <> 0").groupBy(F.window("date", window).alias("w"), "lexicon", "feature").agg(F.avg("score").alias("value"), F.count("*").alias("documents"))
    return rows.select(F.col("w.start").cast("date").alias("date"), "lexicon", "feature", "value", "documents")


def store_new(corpus: DataFrame, lexicons: Lexicons, path: str, checkpoint: str, how: str = "proportional") -> StreamingQuery:
    """Appends the sentiment of documents whose ids aren't stored yet to the Parquet table at ``path``; a batch that is repeated after a failure adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        try:
            known = spark.read.parquet(path).select("id").distinct()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        new = df.dropDuplicates(["id"])
        if known is not None:
            new = new.join(known, "id", "left_anti")
        sentiment(new, lexicons, how).write.mode("append").parquet(path)

    return corpus.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
