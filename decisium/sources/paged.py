"""A paged row source: one task per page, read through a fetcher; and a read-through cache.

``PagedSource`` is a Python data source. Its ``pages`` option names a folder of page
files (``<offset>.json``, lists of rows) for offline use; a subclass with another
``fetch`` reads an endpoint that its options must name.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Page(InputPartition):
    def __init__(self, offset: int, n: int):
        self.offset, self.n = offset, n


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["pages"]
        self.rows = int(options.get("max_rows", 1000))
        self.size = int(options.get("page_size", 100))

    def partitions(self):
        return [_Page(at, min(self.size, self.rows - at)) for at in range(0, self.rows, self.size)]

    def fetch(self, offset: int) -> list[dict]:
        path = os.path.join(self.folder, f"{offset}.json")
        if not os.path.exists(path):
            return []
        with open(path) as f:
            return json.load(f)

    def read(self, partition):
        for i, row in enumerate(self.fetch(partition.offset)[: partition.n]):
            yield partition.offset + i, json.dumps(row)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "seq long, value string"

    def reader(self, schema):
        return _Reader(self.options)


def cached(spark: SparkSession, path: str, fetch: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The Parquet table at ``path``, partitioned by pub_split; fetched and written if it isn't there or untagged."""
    if not refresh:
        try:
            df = spark.read.parquet(path)
            if "pub_split" in df.columns:
                return df
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    fetch().write.mode("overwrite").partitionBy("pub_split").parquet(path)
    return spark.read.parquet(path)


def half_counts(df: DataFrame, name: str = "pub_set") -> DataFrame:
    return df.groupBy(name).agg(F.count_if(F.col("pub_split") == "train-half").alias("train_half"), F.count_if(F.col("pub_split") == "eval-half").alias("eval_half"))
