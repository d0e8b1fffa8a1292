"""The same operators over files that keep arriving: ingestion, replay and the ledger as Structured Streaming jobs.

Each job runs until it has read what is there and can be run again; its checkpoint remembers what it has read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.operators import exchange
from panelith.operators import markets as mk
from panelith.sources import store


def arriving(spark: SparkSession, folder: str, schema: str, kind: str = "json", files: int | None = None) -> DataFrame:
    """Rows of files in a folder, each file once; ``files`` bounds a batch."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(folder)


def run(rows: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Hands every batch of what has arrived to ``each``, and returns."""
    rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest(rows: DataFrame, path: str, checkpoint: str, *keys: str) -> None:
    """Appends rows of new keys to a table. A batch that runs again after a failure, or a key that comes again, appends nothing."""
    run(rows, checkpoint, lambda batch, number: store.ingest(batch, path, *keys))


def replay(lines: DataFrame, path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """A stream of an exchange's messages (``market_id, pos, value``) as final definitions and prices, as ``markets.replay`` gives them for all lines.

    Lines are kept by market and place, which makes a repeated batch harmless; the state is what the table folds to.
    """
    ingest(lines, path, checkpoint, "market_id", "pos")
    return mk.replay(lines.sparkSession.read.parquet(path))


def settle(books: DataFrame, ledger: str, checkpoint: str, now: str) -> None:
    """Settles a ledger of JSON lines against every batch of books (``exchange.parse_books`` of lines): open rows become settled once, settled ones stay."""

    def each(batch: DataFrame, number: int) -> None:
        rows = store.load_ledger(batch.sparkSession, ledger, exchange.LEDGER)
        store.save_ledger(exchange.settle(rows, exchange.parse_books(batch), F.lit(now).cast("timestamp")), ledger)

    run(books, checkpoint, each)


def ticks(rows: DataFrame, path: str, checkpoint: str, late: str = "1 day", window: str = "1 day") -> None:
    """Last price and number of ticks of each market and window (``market_id, ts, price``), late rows within the watermark included."""
    held = rows.withWatermark("ts", late).groupBy(F.window("ts", window), "market_id").agg(F.max_by("price", "ts").alias("last_price"), F.count(F.lit(1)).alias("n"))
    flat = held.select("market_id", F.col("window.start").alias("start"), "last_price", "n")
    flat.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
