"""What the operators of this subpackage share: scratch tables, words and window hashes."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct words a Python worker remembers before it starts afresh.
CACHE_ENTRIES = 300_000
#: The odd multiplier of the polynomial window hashes, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where driver and executors are one process is there one of our own instead."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get().rstrip("/")
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file:///tmp/checkpoints/panelith"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: it survives lost executors and cuts lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["scratch"] = path
    return out


def delete(spark: SparkSession, *paths: str | None) -> None:
    """Deletes scratch folders, in whatever file system they are."""
    for path in paths:
        if path:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop(*tables: DataFrame | None) -> None:
    """Deletes ``stored`` tables that nothing reads any more: what was made of them must be stored itself."""
    for table in tables:
        if table is not None:
            delete(table.sparkSession, table.__dict__.pop("scratch", None))


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with as many underscores behind it as make it differ from all ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """64-bit hashes of words, remembered for the words met so far."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


WORDS = WordHashes()
#: What a worker remembers from task to task; modules add their own.
CACHES: list[dict] = [WORDS]
#: Text bytes that a worker takes apart at once; a longer text is taken alone.
PIECE_BYTES = 4_000_000


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` bytes of ``column``, or of one row."""
    if not batch.num_rows:
        return
    held = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(held), 0).to_numpy(zero_copy_only=False)
    sums = np.cumsum(sizes)
    start = 0
    while start < len(sums):
        before = sums[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sums, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def release(keep: bool = False) -> None:
    """Gives a worker's caches, unless they are to be kept, and freed memory back to the system."""
    if not keep:
        for cache in CACHES:
            cache.clear()
        _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # other C libraries than GNU's have no such call
        pass


Batches = Iterator[pa.RecordBatch]


def frugal(run: Callable[[Batches], Batches], column: str | None = None, limit: int = PIECE_BYTES, keep: bool = False) -> Callable[[Batches], Batches]:
    """``run`` for ``mapInArrow`` that gets its batches in ``pieces`` of a column, if one is named, and whose worker,
    which Spark keeps for later tasks, holds nothing when the task is over; ``keep`` leaves it what is dear to make anew, such as a codec."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches if column is None else (piece for batch in batches for piece in pieces(batch, column, limit)))
        finally:
            release(keep)

    return wrapped


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def word_hashes(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and the offset of each text's first word.

    Words are maximal runs of bytes other than ASCII space and 9 to 13, which is what
    ``bytes.split`` takes as white space.
    """
    words: list[bytes] = []
    ends = [0]
    for text in texts:
        words += text.split()
        ends.append(len(words))
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words)), np.array(ends, np.int64)


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, from a table whose size is a power of two."""
    return _powers(base, 1 << max(12, int(n - 1).bit_length()))[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which all bits look random."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of every ``width`` consecutive values; entry i is the window that starts at i.

    Prefix sums of value * BASE^i give each window's polynomial by one subtraction, and a
    multiplication by BASE^-i makes it independent of its place.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(BASE, len(hashes)), out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * powers(BASE_INVERSE, n))


def inside(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start .. start+length-1 of every run, one run after the other."""
    lengths = np.maximum(lengths, 0)
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    if total == 0:
        return out
    full = lengths > 0
    starts, lengths = starts[full], lengths[full]
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    out[heads] = starts
    out[heads[1:]] -= starts[:-1] + lengths[:-1] - 1
    return np.cumsum(out)


def text_only(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column of the input can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
