"""Reading corpora from frames and files, writing panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, panel


def from_frame(df: DataFrame, columns: Mapping[str, str] | None = None, dates: Mapping[str, str] | DataFrame | None = None, clean: bool = False) -> DataFrame:
    """A corpus from any frame; ``columns`` maps id, date and texts to its names, ``dates`` is a frame (id, date) if it has none."""
    for to, name in (columns or {}).items():
        df = df.withColumnRenamed(name, to)
    if isinstance(dates, DataFrame):
        df = df.drop("date").join(dates.select("id", "date"), "id", "left")
    return corpus.build(df, clean)


def from_documents(spark: SparkSession, path: str, clean: bool = False) -> DataFrame:
    """From JSON lines of documents {"content": ..., "meta": {"id": ..., "datetimestamp": ..., features...}}; a document's lines of content are joined by blanks."""
    df = spark.read.json(path)
    kinds = dict(df.dtypes)
    text = F.concat_ws(" ", "content") if kinds["content"].startswith("array") else F.col("content")
    more = [f.name for f in df.schema["meta"].dataType.fields if f.name not in ("id", "datetimestamp")]
    flat = df.select(F.col("meta.id").cast("string").alias("id"), F.substring(F.col("meta.datetimestamp").cast("string"), 1, 10).alias("date"), text.alias("texts"), *(F.col(f"meta.{c}").alias(c) for c in more))
    return corpus.build(flat, clean)


def from_files(spark: SparkSession, path: str, dates: DataFrame, clean: bool = False) -> DataFrame:
    """From a folder of text files, a document each, named by file; ``dates`` is (id, date)."""
    df = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("id"), F.col("value").alias("texts"))
    return corpus.build(df.join(dates.select("id", "date"), "id"), clean)


def as_corpus(x: DataFrame | str, spark: SparkSession | None = None, **options) -> DataFrame:  # noqa: ANN003
    """From a frame, a folder or pattern of .json/.jsonl files, or one of text files (with ``dates``)."""
    if isinstance(x, DataFrame):
        return from_frame(x, **options)
    if x.rstrip("/").endswith((".json", ".jsonl")):
        return from_documents(spark, x, **options)
    return from_files(spark, x, **options)


def write_panel(p: DataFrame, path: str, names: Sequence[str] | None = None, form: str = "long") -> None:
    """As Parquet, long or wide (wide names hold '--' and '.': quote them with back-ticks when reading)."""
    (p if form == "long" else panel.wide(p, names)).write.mode("overwrite").parquet(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df if "lexicon" in df.columns else panel.long(df)
