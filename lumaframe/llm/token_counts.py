"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer questions about any context limit.

Each distinct length is one row, so the table has as many rows as there are lengths, however many documents. Suffix sums
go by blocks of lengths: sums of whole blocks first, then those within a block."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, ship_code, sliced

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which the public byte-level vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Lengths in a block of the suffix sums.
BLOCK = 4096


def byte_pair_counter(vocabulary: bytes, pattern: str = PATTERN) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of whole texts. vocabulary: the lines of a file of ranks."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda texts: [len(encode(t)) if t else 0 for t in texts]


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens: one row per row of docs; null and empty texts have none. The vocabulary is read on the driver."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = byte_pair_counter(shared.value, pattern)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count(b.column(1).to_pylist()), pa.int64())], ["doc_id", "n_tokens"])

    ship_code(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, docs: how many rows have each length."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length: docs; docs_from and tokens_from (documents of that length or more, and their tokens); share_up_to
    (the quantile that the length reaches); tokens_cut (all tokens if every text is cut to this length).

    An empty histogram gives no rows. Documents of no tokens are a length like any other."""
    hist = cut(hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)))
    sums = hist.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row a block: the longest text / BLOCK at most
    whole = Window.partitionBy(F.lit(0))
    sums = sums.select("block", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"], *[F.sum(c).over(whole).alias(f"all_{c}") for c in "dt"])
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.join(sums, "block")
    docs_from = F.sum("docs").over(within) + F.col("d_after")
    tokens_from = F.sum(F.col("docs") * F.col("n_tokens")).over(within) + F.col("t_after")
    rows = rows.select("n_tokens", "docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), "all_d", "all_t")
    return rows.select(
        "n_tokens", "docs", "docs_from", "tokens_from",
        ((F.col("all_d") - F.col("docs_from") + F.col("docs")) / F.col("all_d")).alias("share_up_to"),
        (F.col("all_t") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("tokens_cut"),
    )


class LengthTable:
    """Answers from suffix_sums(): each asks the table for one row, whatever the number of documents."""

    def __init__(self, sums: DataFrame):
        self.sums = sums

    def _from(self, limit: int):
        return self.sums.where(F.col("n_tokens") >= limit).orderBy("n_tokens").limit(1).select("docs_from", "tokens_from").head() or (0, 0)

    def total(self) -> int:
        return self._from(0)[1]

    def truncated_total(self, limit: int) -> int:
        """All tokens if every text is cut to limit."""
        docs, tokens = self._from(limit)
        return self.total() - tokens + docs * limit

    def longer(self, limit: int) -> int:
        """How many texts have more tokens than limit."""
        return self._from(limit + 1)[0]

    def quantile(self, q: float) -> int | None:
        """The least length that a share q of the documents does not exceed; None without documents."""
        row = self.sums.where(F.col("share_up_to") >= q).orderBy("n_tokens").select("n_tokens").head()
        return row and row[0]


def length_table(docs: DataFrame, **columns) -> DataFrame:
    """suffix_sums of the histogram of the encoded lengths of whole texts."""
    return suffix_sums(histogram(token_lengths(docs, **columns)))
