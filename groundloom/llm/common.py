"""What the text operators share: table reads, row-safe column selection, the shared folder, batches of bounded size, Python workers' memory."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundloom.session import ensure_checkpoint_dir

#: Characters of text handled at once in a Python task.
SLICE_CHARS = 2_000_000
#: What this Python worker remembers from task to task, by name: how to drop it.
DROPS: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def body(docs: DataFrame) -> Column:
    """The text column, null read as empty."""
    return F.coalesce(docs["text"], F.lit(""))


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the folder that all executors share and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(texts: Iterable[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters in all (a longer text is a range of its own)."""
    first = size = at = 0
    for at, t in enumerate(texts, 1):
        size += len(t) + 1
        if size >= most:
            yield first, at
            first, size = at, 0
    if first < at:
        yield first, at


def give_back(keeps: str = "") -> None:
    """Drop what this Python worker remembers, but for ``keeps``, and hand memory that Arrow and the C library hold unused to the system."""
    for name, drop in DROPS.items():
        if name != keeps:
            drop()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries may not
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """``run`` for mapInPandas, with ``give_back`` before and after: Spark hands a Python worker on to the tasks of other stages, with all it holds."""

    def task(batches: Iterator) -> Iterator:
        give_back(keeps)
        yield from run(batches)
        give_back(keeps)

    return task


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]
