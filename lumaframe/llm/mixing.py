"""Mixing sources to target weights by Poisson replication, in DataFrame operations.

A document of source s is repeated k times, k drawn from a Poisson distribution of mean rate[s] by inverting its
distribution function at a number in [0, 1) that md5(seed, doc_id) gives. The copies are shuffled over all partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, fresh, join_classes

SEED = "mix-1"
BITS = 52
#: Sources whose tables of the distribution function (some hundred numbers each) may be broadcast.
SOURCES = 10_000
#: Characters that a partition of the mixture is expected to hold at most.
PARTITION_CHARS = 64_000_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that is the same wherever it is drawn: the first 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, BITS // 4), 16, 10).cast("long") / F.lit(float(1 << BITS))


def poisson_cdf(rate: Column) -> tuple[Column, Column]:
    """(k0, values): the distribution function at k0, k0 + 1, ..., to where the rest is far under 2^-52.

    k0 is 0 up to a rate of 500; beyond, what lies under k0 is as small as that rest, and P(k0) is by Stirling's series."""
    wide = F.floor(rate - 12 * F.sqrt(rate) - 40).cast("int")
    k0 = F.when(rate > 500, wide).otherwise(0)
    log_factorial = wide * F.log(wide) - wide + F.log(2 * F.pi() * wide) / 2 + 1 / (12 * wide)
    p0 = F.when(rate > 500, F.exp(-rate + wide * F.log(rate) - log_factorial)).otherwise(F.exp(-rate))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        return F.struct(p.alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + p)).alias("cdf"))

    top = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    values = F.aggregate(F.sequence(k0 + 1, top), F.struct(p0.alias("p"), F.array(p0).alias("cdf")), step)["cdf"]
    return k0, F.when(rate > 0, values).otherwise(F.array().cast("array<double>"))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """mix_source (null: a source of its own), rows, chars, rate: one row a source. weights: target shares of characters, on any
    positive scale; None: the same for each source that has a character.

    Sources that weights does not name, and those without a character, get rate 0. The expected total is the total there is."""
    sums = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length(F.coalesce(F.col(text_col), F.lit("")))).alias("chars"))
    weight = F.lit(1.0) if weights is None else F.lit(0.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("mix_source") == name, F.lit(float(w))).otherwise(weight)
    sums = cut(sums.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0)))
    all_chars, all_weight = sums.agg(F.sum("chars"), F.sum("weight")).head()
    rate = F.when(F.col("weight") > 0, F.col("weight") * float(all_chars or 0) / (F.col("chars") * float(all_weight or 1))).otherwise(0.0)
    return sums.select("mix_source", "rows", "chars", rate.alias("rate"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, table: DataFrame | None = None) -> DataFrame:
    """docs, each row as often as drawn, with two columns more: copy (1, 2, ...) and mix_key, by which rows are in random order.

    A null source is a source of its own; null and empty texts count no characters but are drawn as others of their source;
    a source without a character has rate 0. A null id draws as the text ''. Rows that repeat an id draw alike.
    Columns named copy or mix_key make the added names longer by an underscore. An empty table stays empty. table: what rates()
    gave for these documents, if that is known."""
    source_key, rows, k0, cdf, copy, key = fresh(docs, "mix_source", "rows", "k0", "cdf", "copy", "mix_key")
    known = lambda c: F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c.cast("string")))
    table = rates(docs, weights, source_col, text_col) if table is None else table
    first, values = poisson_cdf(F.col("rate"))
    table = cut(table.select(known(F.col("mix_source")).alias(source_key), F.col("rows").alias(rows), first.alias(k0), values.alias(cdf)))
    drawn = docs.withColumn(source_key, known(F.col(f"`{source_col}`")))
    small, total = table.agg(F.count(F.lit(1)) <= SOURCES, F.sum(rows)).head()
    drawn = drawn.join(F.broadcast(table), source_key) if small else join_classes(drawn, table, source_key, rows, total, "inner")
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    u = uniform(F.lit(seed), ident)
    times = F.when(F.size(cdf) > 0, F.col(k0) + F.size(F.filter(cdf, lambda c: c <= u))).otherwise(0)
    drawn = drawn.withColumn(copy, F.explode(F.when(times > 0, F.sequence(F.lit(1), times))))
    drawn = drawn.withColumn(key, uniform(F.lit(seed), F.lit("order"), ident, F.col(copy).cast("string")))
    return drawn.select(*[F.col(f"`{c}`") for c in docs.columns], copy, key)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, partitions: int | None = None, source_col: str = "source", text_col: str = "text", **columns) -> DataFrame:
    """replicate() dealt over all partitions by a hash of mix_key and sorted by it there: a global shuffle, alike at every run.

    Partitions are as many as a shuffle has, or more: a partition is expected to hold PARTITION_CHARS characters at most."""
    table = rates(docs, weights, source_col, text_col)
    expected = table.agg(F.sum(F.col("chars") * F.col("rate"))).head()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = replicate(docs, weights, source_col=source_col, text_col=text_col, table=table, **columns)
    key = out.columns[-1]
    return out.repartition(partitions or max(least, int(-(-expected // PARTITION_CHARS))), key).sortWithinPartitions(key)
