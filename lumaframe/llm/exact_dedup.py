"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

Rows are logged in batches. A batch is a memtable: it is flushed as one run of distinct digests, sorted, with the row that stays and
the number of rows of each, and with a filter, a bitmap of hashed digests. Compaction merges runs level by level: a digest that no
other run's filter may hold goes over as it is, the rest meet in a shuffle, where the smallest identifier is kept. Hits (digests
of several rows) are verified byte by byte."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import BROADCAST_ROWS, SPACES, cut, fresh, join_classes, one_row, scratch

#: Batches that exact_groups() logs, and runs that one step of compaction merges.
BATCHES, FAN_IN = 4, 4
#: Bits of a filter's bitmap (of the bitmap functions), bits for each digest, and bytes of the filters that may be broadcast at once.
BITMAP, BITS, FILTER_BYTES = 32_768, 16, 64 << 20


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


@dataclass(frozen=True)
class Run:
    """A run in the shared folder: its table, its filter (bucket, bits), and how many digests and buckets these have."""

    path: str
    level: int
    digests: int
    buckets: int


class DigestIndex:
    """Runs of distinct digests under a folder of the shared storage. A run's row: digest, less (minus the code points), no_id,
    doc_id of the row that stays, and n, the rows of that digest."""

    def __init__(self, spark: SparkSession, id_type: str = "bigint", path: str | None = None, digest_bits: int = 256):
        self.spark, self.bytes, self.id_type = spark, digest_bits // 8, id_type
        self.path = path or scratch(spark, "lsm")
        self.runs: list[Run] = []
        self.made = 0

    def digest(self, text: Column) -> Column:
        return F.substring(F.unhex(F.sha2(normalised(text), 256)), 1, self.bytes)

    def log(self, rows: DataFrame, batches: int = BATCHES) -> list[DataFrame]:
        """rows (digest, n_cp, doc_id) written once, in as many batches, each the rows of some of the scan's partitions."""
        at = f"{self.path}/log-{self.made}"
        self.made += 1
        rows.withColumn("batch", F.pmod(F.spark_partition_id(), F.lit(batches))).write.partitionBy("batch").parquet(at)
        logged = self.spark.read.schema(f"digest binary, n_cp int, doc_id {self.id_type}, batch int").parquet(at)
        return [logged.where(F.col("batch") == k).drop("batch") for k in range(batches)]

    def flush(self, rows: DataFrame) -> Run:
        """A batch of rows (digest, n_cp, doc_id) as a run of level 0."""
        ready = rows.select("digest", (-F.col("n_cp")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", F.lit(1).cast("long").alias("n"))
        return self._write(self._merge(ready), 0)

    @staticmethod
    def _merge(rows: DataFrame) -> DataFrame:
        """For each digest the smallest (less, no_id, doc_id), so a null id comes last, and all its rows."""
        best = rows.groupBy("digest").agg(F.min(F.struct("less", "no_id", "doc_id")).alias("best"), F.sum("n").alias("n"))
        return best.select("digest", "best.*", "n")

    def _write(self, rows: DataFrame, level: int) -> Run:
        at = f"{self.path}/level={level}/{self.made}"
        self.made += 1
        rows.sortWithinPartitions("digest").write.parquet(f"{at}/digests")
        digests = self._table(at).count()
        run = Run(at, level, digests, max(1, -(-digests * BITS // BITMAP)))
        bucket, bit = self._place(run)
        self._table(at).groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits")).write.parquet(f"{at}/filter")
        self.runs.append(run)
        return run

    def _table(self, at: str) -> DataFrame:
        return self.spark.read.schema(f"digest binary, less int, no_id boolean, doc_id {self.id_type}, n long").parquet(f"{at}/digests")

    @staticmethod
    def _place(run: Run) -> tuple[Column, Column]:
        slot = F.pmod(F.xxhash64("digest"), F.lit(run.buckets * BITMAP))
        return F.floor(slot / BITMAP), slot % BITMAP

    def probe(self, rows: DataFrame, others: list[Run], name: str = "maybe") -> DataFrame:
        """rows with a column more: whether one of these runs may hold the digest, by their filters. Filters of over FILTER_BYTES
        in all are not broadcast: then any digest may be held."""
        if sum(r.buckets for r in others) * (BITMAP // 8) > FILTER_BYTES:
            return rows.withColumn(name, F.lit(True))
        kept, maybe = rows.columns, F.lit(False)
        for k, run in enumerate(others):
            bucket, bit = self._place(run)
            filter_ = self.spark.read.schema("bucket long, bits binary").parquet(f"{run.path}/filter").toDF(f"bucket{k}", f"bits{k}")
            rows = rows.withColumn(f"bucket{k}", bucket).withColumn(f"bit{k}", bit).join(F.broadcast(filter_), f"bucket{k}", "left")
            byte = F.conv(F.hex(F.substring(f"bits{k}", F.floor(F.col(f"bit{k}") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
            maybe = maybe | F.coalesce(F.getbit(byte, (F.col(f"bit{k}") % 8).cast("int")) == 1, F.lit(False))
        return rows.select(*kept, maybe.alias(name))

    def find(self, digests: DataFrame) -> DataFrame:
        """The rows of runs that hold one of the digests (a column), each run asked only for those that its filter may hold."""
        found = [self._table(r.path).join(self.probe(digests.select("digest").distinct(), [r]).where("maybe").select("digest"), "digest", "left_semi") for r in self.runs]
        return reduce(DataFrame.unionByName, found)

    def compact(self) -> DataFrame:
        """digest, keep_id, group_size of all that was flushed: FAN_IN runs of the lowest levels become one of the next, until one is left."""
        while len(self.runs) > 1:
            self.runs.sort(key=lambda r: r.level)
            some, self.runs = self.runs[:FAN_IN], self.runs[FAN_IN:]
            rows = reduce(DataFrame.unionByName, [self.probe(self._table(r.path), [x for x in some if x is not r]) for r in some])
            alone, shared = rows.where("not maybe").drop("maybe"), rows.where("maybe").drop("maybe")
            self._write(alone.unionByName(self._merge(shared)), some[-1].level + 1)
        return self._table(self.runs[0].path).select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after white space (SPACES) is deleted; null counts as empty. Of equal texts the
    row with the most code points before that, then the smallest id, stays; a null id is the largest. Rows that repeat
    an id and a text are counted each and agree in kept. An empty table gives no rows; other columns are not read."""
    spark = docs.sparkSession
    index = DigestIndex(spark, dict(docs.dtypes)[id_col], digest_bits=digest_bits)
    text = F.col(text_col)
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    batches = index.log(docs.select(index.digest(F.col("text")).alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("n_cp"), "doc_id"))
    for batch in batches:
        index.flush(batch)
    hits = index.compact().where("group_size > 1")
    rows = reduce(DataFrame.unionByName, batches).select("digest", "doc_id")
    found = cut(join_classes(rows, hits, "digest", "group_size", rows.count()))
    collided = _verify(docs, found, index)
    out = found.select(
        "digest", "doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    sha = F.lower(F.hex("digest"))
    if digest_bits == 256 and not collided.head(1):
        return out.select("doc_id", "keep_id", "group_size", "kept", sha.alias("text_sha256"))
    return _by_text(docs, out, collided, index)


def _verify(docs: DataFrame, found: DataFrame, index: DigestIndex) -> DataFrame:
    """Digests under which hits have texts that differ in a byte. Equal texts collapse in the task that reads them."""
    ids = found.where("group_size > 1 and doc_id is not null").select("doc_id").distinct()
    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    texts = texts.select(index.digest(F.col("text")).alias("digest"), normalised(F.col("text")).alias("bytes"))
    return cut(texts.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"))


def _by_text(docs: DataFrame, out: DataFrame, collided: DataFrame, index: DigestIndex) -> DataFrame:
    """The result where digests collide: groups under such a digest go by the text itself."""
    rows = docs.select("doc_id", index.digest(F.col("text")).alias("digest"), normalised(F.col("text")).alias("bytes"), F.length(F.coalesce("text", F.lit(""))).alias("n_cp"))
    rows = rows.withColumn("text_sha256", F.sha2("bytes", 256))
    clear = rows.join(collided, "digest", "left_anti").select("digest", "text_sha256").distinct()
    whole = out.join(collided, "digest", "left_anti").join(clear, "digest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    rows = rows.join(collided, "digest", "left_semi")
    best = F.min(F.struct((-F.col("n_cp")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("best")
    groups = rows.groupBy("text_sha256", "bytes").agg(best, F.count(F.lit(1)).alias("group_size"))
    split = rows.join(groups, ["text_sha256", "bytes"]).withColumn("keep_id", F.col("best.doc_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return whole.unionByName(split.select(*whole.columns))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were; ids decide which row stays, not whether.

    The row that stays is that of exact_groups; of several with its id, that with the most code points, then by text and a hash."""
    groups = cut(exact_groups(docs, id_col, text_col))
    sha, keep, same = fresh(docs, "text_sha256", "keep_id", "same")
    hits = groups.where("group_size > 1").groupBy("text_sha256").agg(F.first("keep_id").alias(keep), F.count_if("kept").alias(same), F.count(F.lit(1)).alias("n"))
    hits = cut(hits.withColumnRenamed("text_sha256", sha))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    if hits.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(hits.drop("n")), sha, "left")
    else:
        rows = join_classes(rows, hits.withColumnRenamed("n", fresh(rows, "n")[0]), sha, fresh(rows, "n")[0], groups.count())
    rows = rows.where(F.col(same).isNull() | F.col(id_col).eqNullSafe(F.col(keep)))
    alone = rows.where(F.coalesce(same, F.lit(1)) == 1).select(*names)
    if not hits.where(F.col(same) > 1).head(1):
        return alone
    return alone.unionByName(one_row(rows.where(F.col(same) > 1).select(*names, sha), sha, text_col))
