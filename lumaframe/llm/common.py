"""What the operators share: cutting lineage, joins that survive a hot key, bounded broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..shipping import ship_code  # noqa: F401

#: ASCII white space [\x20\x09-\x0D], the separators of words.
SPACES = " \t\n\x0b\x0c\r"
#: A key with over 1 / HOT_SHARE of all rows counts as hot; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 512
#: Rows that may be broadcast, each of a few dozen bytes.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where that is unset and all is one machine."""
    context = spark.sparkContext
    if at := context.getConf().get("spark.checkpoint.dir"):
        return at.rstrip("/")
    found = context._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-shared-"))
        found = context._jsc.sc().getCheckpointDir()
    return found.get().rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; release() deletes what is there."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_llm_scratch", []).append(path)
    return path


def made(spark: SparkSession) -> int:
    """How many scratch tables of this context there are; release() takes it as a mark."""
    return len(spark.sparkContext.__dict__.get("_llm_scratch", []))


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> int:
    """Deletes the tables that operators wrote for this context, but for the first `since` and the one named, and how many.
    Results read from them must be done with."""
    paths = spark.sparkContext.__dict__.setdefault("_llm_scratch", [])
    gone, paths[since:] = [x for x in paths[since:] if x != keep], [x for x in paths[since:] if x == keep]
    for at in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again: its lineage ends, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@lru_cache(1)
def _libc() -> ctypes.CDLL | None:
    """The C library where it is glibc, told to give every block of over a megabyte back as soon as it is freed."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which otherwise grows with what is freed
        libc.malloc_trim  # noqa: B018
        return libc
    except (OSError, AttributeError):
        return None


def trimmed() -> None:
    """Gives what this process has freed back to the system: a worker that waits for its next task, of whichever operator, shares its
    machine with the JVM's heap."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of so many rows, and of so many bytes where a row is no larger, of the batches that a worker gets: what a task holds
    does not hang on the session's Arrow settings, which nothing here changes. Each batch and its results are given back before the
    next is read."""
    trimmed()
    for b in batches:
        step = max(1, min(rows, b.num_rows * most // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
        b = None
        trimmed()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_classes(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with classes, which has one row a key, with the number of that key's rows in column size.

    Hot keys number fewer than HOT_SHARE and are broadcast; the rest meet in a shuffle, at most total / HOT_SHARE rows a key.
    A null key meets no class."""
    most = total // HOT_SHARE
    hot = F.broadcast(classes.where(F.col(size) > most))
    cold = classes.where(F.col(size) <= most)
    out = rows.join(hot, key)
    return out.unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, how).select(*out.columns))


def without(df: DataFrame, key: str, drop: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df without the rows whose key is in drop's only column; broadcast up to `most` keys, else shuffled. Null keys stay."""
    drop = drop.where(F.col(drop.columns[0]).isNotNull()).toDF(key)
    return df.join(F.broadcast(drop) if drop.count() <= most else drop, key, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def one_row(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """df without its column key, and one row for each key: that with the longest text, then by text and a hash of the other columns."""
    names = [c for c in df.columns if c != key]
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if c != key and "map<" not in kind])
    order = F.struct(F.length(F.coalesce(text_col, F.lit(""))).alias("n"), F.col(text_col).alias("text"), hashed.alias("hash"))
    best = df.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in names]), order).alias("best"))
    return best.select(*[F.col("best").getField(c).alias(c) for c in names])


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
