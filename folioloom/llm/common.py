"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.session import ship

#: White space as the contracts define it, for Java's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"

#: Bits of one bitmap as bitmap_construct_agg makes them.
_BITS = 32768


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(name: str = "text") -> Column:
    """Number of maximal runs of characters that aren't white space; null counts 0."""
    spaced = F.regexp_replace(text_or_empty(name), SPACES, " ")
    inner = F.trim(spaced)
    return F.when(F.length(inner) == 0, F.lit(0)).otherwise(F.octet_length(inner) - F.octet_length(F.replace(inner, F.lit(" "), F.lit(""))) + 1).cast("long")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish`` or the first variant of it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    name, n = wish, 0
    while name.lower() in taken:
        n += 1
        name = f"{wish}_{n}"
    return name


def key_bitmap(keys: DataFrame, columns: list[str], bits_log2: int) -> DataFrame:
    """A Bloom-style bitmap of the keys: at most 2**bits_log2 / 8 bytes, whatever the input.

    Rows (_bucket, _bitmap) of 4096 bytes each, ``2**bits_log2 / 32768`` rows at
    most, so that a broadcast of it has a proven bound.
    """
    h = F.pmod(F.xxhash64(*columns), F.lit(1 << bits_log2))
    return (
        keys.select(F.floor(h / _BITS).cast("int").alias("_bucket"), F.pmod(h, F.lit(_BITS)).cast("long").alias("_bit"))
        .groupBy("_bucket")
        .agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    )


def flag_members(df: DataFrame, columns: list[Column], bitmap: DataFrame, bits_log2: int, flag: str) -> DataFrame:
    """Add ``flag``: false where a row's key is certainly none of the bitmap's keys."""
    h, bucket, bits = free_name(df, "_h"), free_name(df, "_bucket"), free_name(df, "_bitmap")
    hashed = df.withColumn(h, F.pmod(F.xxhash64(*columns), F.lit(1 << bits_log2)))
    small = bitmap.select(F.col("_bucket").alias(bucket), F.col("_bitmap").alias(bits))
    joined = hashed.join(F.broadcast(small), F.floor(F.col(h) / _BITS).cast("int") == F.col(bucket), "left")
    pos = F.pmod(F.col(h), F.lit(_BITS))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.pmod(pos, F.lit(8)).cast("int")).bitwiseAND(F.lit(1))
    return joined.withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop(h, bucket, bits)


def row_key(doc_id: str, text: str) -> Column:
    """A key of a row by its doc_id and text, never null; rows that repeat both share it."""
    return F.concat_ws(":", F.col(doc_id).cast("string"), F.xxhash64(F.col(text)).cast("string"))


def drop_keys(df: DataFrame, key: str, keys: DataFrame, bits_log2: int = 24) -> DataFrame:
    """Rows of ``df`` whose ``key`` isn't among ``keys`` (one column of that name).

    A bitmap of bounded size lets rows that can't match pass without a shuffle;
    the rest go through an exact anti join. Rows with a null key stay.
    """
    flag = free_name(df, "_maybe")
    marked = flag_members(df, [F.col(key)], key_bitmap(keys, [key], bits_log2), bits_log2, flag)
    untouched = marked.filter(~F.col(flag)).drop(flag)
    looked_up = marked.filter(F.col(flag)).drop(flag).join(keys.select(key).distinct(), key, "left_anti")
    return untouched.unionByName(looked_up.select(*untouched.columns))


def prepare(spark: SparkSession) -> None:
    """Before Python functions over texts: this package to the executors, and Arrow batches of
    1,000 rows where the session has the default of 10,000, since texts can be long."""
    ship(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, "1000")


def input_partitions(spark: SparkSession) -> int:
    """Partitions for a shuffle that this library asks for by number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of an Arrow batch that are Python objects at a time.
_ROWS = 250


def texts(column) -> Iterator[str | None]:
    """The strings of an Arrow column, few of them as Python objects at a time."""
    for at in range(0, len(column), _ROWS):
        yield from column.slice(at, _ROWS).to_pylist()


def released(batches: Iterator) -> Iterator:
    """Passes batches on; at a task's end the worker, which Spark keeps for the next task, gives memory back."""
    yield from batches
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)
