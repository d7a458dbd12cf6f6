"""Shared helpers: reading, word rules, tables in the shared folder, size-checked joins."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word, once A-Z are lower-cased: everything but ASCII that is no digit and no lower-case letter.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for Spark's expressions: Java's engine looks singly listed ASCII up in a table, but tests ranges one after the other.
LISTED_WORD = "[^" + "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isdigit() and not chr(c).islower()) + "]+"
#: Rows and bytes that a broadcast may hold.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Rows with texts that go to Python at once.
BATCH_ROWS = 1000
#: Bytes of a table's rows that a writing task holds in the heap before they go to the file.
ROW_GROUP = 16 << 20
#: With it Spark removes the shuffle files of a query as soon as the query ends, not when they happen to be collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Where stored() has put the tables that are still in use.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

#: bytes -> bytes table with the same word rule: separators become blanks, A-Z lower case.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_list(text: str | None) -> list[bytes]:
    """Words by WORD as UTF-8 bytes; bytes above 0x7F always belong to a word."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Spark's lower() has a fast path for ASCII, translate() handles the rest exactly."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(LISTED_WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where a local session names none (tests) a temporary one is made."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    known = spark.conf.get("wattloom.shared.dir", None)
    if not known and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not known:
        known = "file://" + tempfile.mkdtemp(prefix="wattloom-shared-")
        spark.conf.set("wattloom.shared.dir", known)
    return known


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage is cut, lost executors lose nothing.

    The shuffle files of the write go at once; what reads df again would make them anew."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Frees the disk of tables that stored() wrote and nothing reads any more: an empty table takes their place."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            empty = df.sparkSession.range(0)  # an empty list of rows would start Python on executors, in a pool of its own
            empty.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]).write.mode("overwrite").parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `rows` rows and BROADCAST_BYTES bytes, measured; stops just beyond that many rows."""
    width = F.lit(0)
    for f in df.schema.fields:
        own = F.col(f"`{f.name}`")
        long = isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))
        text = own if isinstance(f.dataType, T.BinaryType) else own.cast("string")
        width = width + (F.coalesce(F.octet_length(text), F.lit(0)) + 8 if long else F.lit(8))
    n, size = df.select(width.alias("w")).limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    return n <= rows and size <= BROADCAST_BYTES


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted size allows it, else as it is (Spark then shuffles both sides)."""
    return F.broadcast(df) if small(df, rows) else df


def shielded(df: DataFrame, *need: str):
    """(df with all columns but `need` renamed, restore): no column of the caller can clash with a name used inside.

    restore(out, *new) gives the caller's columns, less those that bear a new one's name, and the new ones."""
    names = df.columns
    inner = {c: c if c in need else f"_in{i}" for i, c in enumerate(names)}

    def restore(out: DataFrame, *new: str) -> DataFrame:
        return out.select(*[F.col(inner[c]).alias(c) for c in names if c not in new], *new)

    return df.select(*[F.col(f"`{c}`").alias(inner[c]) for c in names]), restore


def short_batches(spark: SparkSession) -> None:
    """From now on Spark sends at most BATCH_ROWS rows at once to Python: buffers outside the heap hold a batch of whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def trim() -> None:
    """Gives back to the system what this process has freed: Spark keeps idle workers, and all count in their executor's memory."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts: what a worker holds as Python objects at once stays small, whatever the batch size."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        del b
        trim()


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of results that are stored and no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
