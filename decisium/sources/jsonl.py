"""JSON Lines scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decisium.operators.validate import validate_json
from decisium.runtime import materialise


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): the lines that aren't blank. Files are split, so lines of one file may be read by many tasks."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").filter(F.trim("value") != "")


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) with line numbers from 1, blank lines counted and left out.

    Files are split: the lines of each piece are counted first, and a line's number is
    its place in its piece behind the pieces before. A piece is read in order by one
    task, so places are differences of row ids; no line is sorted or moved.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("row_no"), "value"
    )
    pieces = lines.groupBy("path", "piece").agg(F.count("*").alias("n"), F.min("row_no").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(F.col("path").alias("own_path"), F.col("piece").alias("own_piece"), "first", F.coalesce(before, F.lit(0)).alias("before"))
    rows = lines.join(pieces, (F.col("path") == F.col("own_path")) & (F.col("piece") == F.col("own_piece")))
    line = F.col("before") + F.col("row_no") - F.col("first") + 1
    return rows.select("path", line.alias("line"), "value").filter(F.trim("value") != "")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of ``schema``; a malformed line aborts the read."""
    return read_lines(spark, path).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def read_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines)."""
    parsed = read_lines(spark, path).withColumn("ok", F.try_parse_json("value").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{")))
    good = parsed.filter("ok").select(F.from_json("value", schema).alias("row")).select("row.*")
    return good, parsed.filter(~F.col("ok")).select("path", "value")


def read_rows(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid canonical rows, rejected (path, line, value, errors)); ``strict`` raises on the first bad row, named by file and line."""
    checked = validate_json(read_numbered(spark, path))
    if strict:
        label = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.col("errors"))
        checked = checked.withColumn("row", F.when(F.col("errors").isNotNull(), F.raise_error(label)).otherwise(F.col("row")))
    valid = checked.filter(F.col("row").isNotNull()).select("path", "line", "row.*")
    return valid, checked.filter(F.col("errors").isNotNull()).select("path", "line", "value", "errors")


def read_pages(spark: SparkSession, path: str, tolerant: bool = False, max_scan: int | None = None) -> DataFrame:
    """(title, seq, redirect_target, text) of encyclopedia lines: no redirects, 80 to 40,000 characters.

    ``max_scan`` counts scanned lines, also those that are left out. ``tolerant`` skips
    malformed lines and titles that aren't of 3 to 80 characters.
    """
    lines = read_numbered(spark, path).withColumnRenamed("line", "seq")
    if max_scan is not None:
        lines = lines.filter(F.col("seq") <= max_scan)
    mode = "PERMISSIVE" if tolerant else "FAILFAST"
    rows = lines.select("seq", F.from_json("value", "title string, text string, redirect_target string", {"mode": mode}).alias("p")).select("p.title", "seq", "p.redirect_target", "p.text")
    rows = rows.filter(F.col("redirect_target").isNull() & F.length("text").between(80, 40_000))
    return rows.filter(F.length(F.trim("title")).between(3, 80)) if tolerant else rows


def headlines(spark: SparkSession, path: str, cap: int) -> DataFrame:
    """Titles of 3 to 60 plain characters among the first ``cap`` lines, redirects left out."""
    rows = read_numbered(spark, path).filter(F.col("line") <= cap)
    rows = rows.select(F.from_json("value", "title string, redirect_target string").alias("p")).filter("p.redirect_target is null")
    return rows.select(F.trim("p.title").alias("title")).filter(F.length("title").between(3, 60) & F.col("title").rlike(r"\A[\p{L}\p{N} .,'()&-]+\z"))


def finished_counts(spark: SparkSession, path: str, families: list[str]) -> DataFrame:
    """(family, n) of whole rows written so far; a torn last line doesn't count, absent families are 0."""
    rows = read_lines(spark, path).select(F.try_variant_get(F.try_parse_json("value"), "$.meta.family", "string").alias("family"))
    found = rows.filter("family is not null").groupBy("family").agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame([(f,) for f in families], "wanted string")
    return wanted.join(found, F.col("wanted") == F.col("family"), "left").select(F.col("wanted").alias("family"), F.coalesce("n", F.lit(0)).alias("n"))


def write_split(df: DataFrame, path: str) -> None:
    """Rewrite one split."""
    df.write.mode("overwrite").json(path)


def write_by_family(df: DataFrame, path: str, family: str = "family") -> None:
    """One folder per family."""
    df.write.mode("overwrite").partitionBy(family).json(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key isn't there yet; a rerun after a crash adds only what is missing."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(place) and any(f.getLen() for f in store.listStatus(place)):
        done = spark.read.json(path).select(F.col(key).alias("done_key")).distinct()
        df = df.join(done, F.col(key) == F.col("done_key"), "left_anti")
    new = materialise(df, "new")
    n = new.count()
    if n:
        new.write.mode("append").json(path)
    return n


def write_status(counts: DataFrame, path: str, need: int) -> dict[str, int]:
    """A JSON snapshot of how far each family is (one number each, ``need`` at most); ``path`` may be of any file system."""
    import json

    from pyarrow import fs

    status = {r["family"]: min(r["n"], need) for r in counts.select("family", "n").toLocalIterator()}
    store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_output_stream(place) as f:
        f.write(json.dumps(status, indent=1, sort_keys=True).encode())
    return status
