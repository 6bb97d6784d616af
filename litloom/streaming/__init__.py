"""Growing collections of exports as streams.

The batch operators read finished files; these read a folder that files are
still added to and apply the stateless screens and the key-based
de-duplication with bounded state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.functions import text
from litloom.operators import corpus


def papers_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Rows of a folder of parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def screened_stream(rows: DataFrame) -> DataFrame:
    """The screens of ``corpus.screened``: stateless, the same for streams and tables."""
    return corpus.screened(rows)


def first_rows(rows: DataFrame, at: str = "exported_at", delay: str = "30 days", order: str = "record_id") -> DataFrame:
    """The first row of every DOI or title key within the watermark's delay; state is dropped beyond it."""
    keyed = rows.withColumn("key", text.dedup_key(F.col("doi"), F.col("title"), F.col(order)))
    return keyed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["key"])


def yearly_counts(rows: DataFrame, at: str = "exported_at", delay: str = "30 days", window: str = "30 days") -> DataFrame:
    """Rows per export window and source; late rows within the delay still count."""
    return rows.withWatermark(at, delay).groupBy(F.window(at, window).alias("w"), "source_db").agg(F.count("*").alias("n")).select("w.start", "source_db", "n")
