"""Sinks: per-series JSON records, bounded nested export, Parquet by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_series_json(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SK1: JSON records (date as ISO text), one folder per category."""
    (panel.select("category", "date", "value", "series_id")
          .write.mode(mode).option("dateFormat", "yyyy-MM-dd")
          .partitionBy("category").json(path))


def write_panel_parquet(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SK3: one Parquet dataset partitioned by category; series_id stays a
    column (never a partition folder per series)."""
    panel.write.mode(mode).partitionBy("category").parquet(path)


def write_series_files(panel: DataFrame, path: str, key: str = "key") -> None:
    """One Parquet file for each value of ``key``, named by it (``<key>.parquet``), as file-per-series consumers and
    :func:`sources.observations.read_series_files` expect them. Files are written by the executors, one task for
    each key, and only renamed here; for many series :func:`write_panel_parquet` is the better layout."""
    spark = panel.sparkSession
    staged = f"{path.rstrip('/')}/_staged"
    panel.repartition(key).write.mode("overwrite").partitionBy(key).parquet(staged)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    top = where(staged)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(top):
        if folder.isDirectory() and "=" in (name := folder.getPath().getName()):
            parts = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().endswith(".parquet")]
            for i, part in enumerate(parts):
                stem = name.split("=", 1)[1] + (f".{i}" if i else "")
                fs.rename(part, where(f"{path.rstrip('/')}/{stem}.parquet"))
    fs.delete(top, True)


def write_bucketed(panel: DataFrame, table: str, path: str, buckets: int = 64, mode: str = "overwrite") -> DataFrame:
    """SK3 / SC5 for repeated use: a table bucketed by (entity_id, series_id) and sorted by date within. Windows per series and joins on
    the series key read it without an exchange; with ``spark.sql.requireAllClusterKeysForCoPartition=false``
    so do joins that also match the date. One file for each bucket, so that its order is known. ``buckets`` is for the caller to
    choose by size (a bucket is a task); two tables join in place if they have the same number."""
    keys = ["entity_id", "series_id"]
    (panel.repartition(buckets, *keys).sortWithinPartitions(*keys, "date").write.mode(mode)
     .bucketBy(buckets, *keys).sortBy(*keys, "date").option("path", path).saveAsTable(table))
    return panel.sparkSession.table(table)


def nested_blocks(panel: DataFrame, block_size: int = 512) -> DataFrame:
    """SK2: the nested ``{category: {series: [records]}}`` export as bounded
    blocks. Each output row holds at most ``block_size`` date-ordered records
    of one series, so no row or task ever holds a whole category or series;
    concatenating a series' blocks by ``block`` rebuilds its record list."""
    w = Window.partitionBy("category", "series_id").orderBy("date")
    blk = (F.row_number().over(w) - 1).cast("bigint")
    rec = F.struct(F.col("date"), F.col("value"), F.col("series_id"))
    return (panel.select("category", "series_id", "date",
                         F.floor(blk / block_size).cast("bigint").alias("block"),
                         rec.alias("rec"))
            .groupBy("category", "series_id", "block")
            .agg(F.count(F.lit(1)).alias("n_records"),
                 F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                 F.sum("rec.value").alias("value_sum"),
                 F.array_sort(F.collect_list("rec")).alias("records"))
            .withColumn("records_json", F.to_json(F.col("records"))))


def write_nested(blocks: DataFrame, path: str, mode: str = "overwrite") -> None:
    blocks.select("category", "series_id", "block", "records").write.mode(mode) \
        .option("dateFormat", "yyyy-MM-dd").partitionBy("category").json(path)
