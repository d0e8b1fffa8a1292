"""Tables, reports and ledgers on storage: what one step writes and a later one reads."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a report for people may have.
REPORT_ROWS = 10_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; only a local session has one of its own instead."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file:///tmp/checkpoints/panelith"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table or a file is there, in whatever file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(place) and (system.getFileStatus(place).isFile() or system.exists(spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made and written first if no finished one is there: panels, labels, daily statistics, predictions."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table or a folder of them, in whatever file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_features(features: DataFrame, names: list[str], path: str) -> None:
    """``date, ticker, target`` and 32-bit features, a folder a year, so that readers of some years and names read no more."""
    rows = features.select("date", "ticker", F.col("target").cast("float").alias("target"), *[F.col(n).cast("float").alias(n) for n in names], F.year("date").alias("year"))
    rows.repartition("year").sortWithinPartitions("date", "ticker").write.mode("overwrite").partitionBy("year").parquet(path)


def read_features(spark: SparkSession, path: str, names: list[str], first: int | None = None, last: int | None = None) -> DataFrame:
    """Some features of some years; both prune the scan."""
    rows = spark.read.parquet(path)
    for bound, keep in ((first, F.col("year") >= (first or 0)), (last, F.col("year") <= (last or 0))):
        rows = rows.where(keep) if bound is not None else rows
    return rows.select("date", "ticker", "target", *names)


def read_prices(spark: SparkSession, path: str, tickers: list[str] | None = None, since: str | None = None) -> DataFrame:
    """Bars from a file of prices; the tickers and the first date are pushed into the scan."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("ticker").isin(tickers)) if tickers else rows
    return rows.where(F.col("date") >= F.lit(since).cast("date")) if since else rows


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    """``ticker`` from a CSV file with a header; blank ones are left out."""
    return spark.read.csv(path, header=True, schema="ticker string").where("trim(ticker) <> ''").select(F.trim("ticker").alias("ticker"))


def read_pages(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    """``offset, place, value``: the items of a paged listing kept as files ``<offset>.json``, each a JSON list of at most ``limit`` items.

    A listing ends with its first short page; what lies beyond it is left out. A page is one value, which ``limit`` bounds.
    """
    pages = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).try_cast("long").alias("offset"), F.from_json("value", "array<string>").alias("items")).where("offset is not null")
    end = pages.where(F.coalesce(F.size("items"), F.lit(0)) < limit).agg(F.coalesce(F.min("offset"), F.lit(1 << 62)).alias("last_offset"))
    # One row.
    held = pages.join(F.broadcast(end), F.col("offset") <= F.col("last_offset"))
    return held.select("offset", F.posexplode("items").alias("place", "value"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of each file below a path. A file's bytes are one value, of 2 GB at most."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_report(table: DataFrame, folder: str, name: str, title: str = "") -> None:
    """A small result as CSV and JSON lines, one file each, and as a Markdown table. More than ``REPORT_ROWS`` rows are no report and raise an error."""
    held = table.limit(REPORT_ROWS + 1).toPandas()
    if len(held) > REPORT_ROWS:
        raise ValueError(f"{name} has more than {REPORT_ROWS} rows")
    small = table.sparkSession.createDataFrame(held, table.schema).coalesce(1)
    small.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    small.write.mode("overwrite").json(f"{folder}/{name}.json")
    cell = lambda x: "" if x is None or x != x else f"{x:.3f}" if isinstance(x, float) else str(x)
    lines = [f"# {title or name}", "", "| " + " | ".join(held.columns) + " |", "|" + "---|" * len(held.columns)]
    lines += ["| " + " | ".join(map(cell, row)) + " |" for row in held.itertuples(index=False)]
    table.sparkSession.createDataFrame([("\n".join(lines),)], "value string").write.mode("overwrite").text(f"{folder}/{name}.md")


# --- ledgers ------------------------------------------------------------------


def load_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger of JSON lines; empty where none has been written."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def save_ledger(rows: DataFrame, path: str) -> None:
    """Replaces a ledger, which ``rows`` may have been read from: the new one is whole before the old one goes."""
    spark = rows.sparkSession
    fresh = f"{path}.{uuid.uuid4().hex}"
    rows.write.json(fresh)
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, path))
    system = old.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(old, True)
    if not system.rename(new, old):
        raise OSError(f"{fresh} could not be moved to {path}")


# --- the frozen choice --------------------------------------------------------


def freeze(ranked: DataFrame, path: str) -> dict:
    """Writes the best configuration of a ranking (``config, val_sharpe, ...``, best first) once; a choice already made stays and is returned."""
    spark = ranked.sparkSession
    if not exists(spark, path):
        best = ranked.where("val_sharpe is not null").orderBy(F.col("val_sharpe").desc(), "config").limit(1)
        if best.isEmpty():
            raise ValueError("no configuration has a ratio")
        best.coalesce(1).write.json(path)
    return frozen(spark, path)


def frozen(spark: SparkSession, path: str) -> dict:
    """The frozen choice; without one there is no final evaluation."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no configuration is frozen at {path}: run the validation first")
    return json.loads(spark.read.text(path).first()["value"])


def unseen(rows: DataFrame, path: str, *keys: str) -> DataFrame:
    """Rows whose keys the table at ``path`` doesn't hold, one a key."""
    fresh = rows.dropDuplicates(list(keys))
    return fresh.join(rows.sparkSession.read.parquet(path).select(*keys), list(keys), "left_anti") if exists(rows.sparkSession, path) else fresh


def ingest(rows: DataFrame, path: str, *keys: str) -> None:
    """Appends what is new; running it again appends nothing."""
    unseen(rows, path, *keys).write.mode("append").parquet(path)


def at_point(table: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key, by a predicate that reaches the scan."""
    return table.where(F.col(key) == (value if isinstance(value, Column) else F.lit(value)))
