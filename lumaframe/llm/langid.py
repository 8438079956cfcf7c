"""Language identification: each document as a mixture of languages.

Per language, a table of letter n-gram probabilities. A document's n-grams are drawn from a mixture of the languages;
expectation-maximisation estimates the proportions, and the set of languages is that of least penalised likelihood
(-2 log likelihood + penalty * log(n-grams) for each language beyond the first). The prediction is the largest proportion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from .common import held_out, ship_code, sliced

#: Hash buckets of n-grams, their lengths, and the weight that smoothing gives to the pool of all languages.
BUCKETS, LENGTHS, SMOOTHING = 1 << 15, (1, 2, 3), 0.05
#: Labelled documents that training reads of each language on average.
PER_LANGUAGE = 1000
#: Expectation-maximisation ends where the log likelihood is within TOLERANCE of its greatest, or after STEPS.
STEPS, TOLERANCE, PENALTY = 1000, 0.02, 2.0
#: Code points whose n-grams are hashed at once.
CHUNK = 1 << 20
UNDETERMINED = "und"


@lru_cache(1)
def letter_table() -> np.ndarray:
    """For each code point: that of its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            out[c] = ord(low) if len(low := ch.lower()) == 1 else c
    return out


def has_letter(text: str) -> bool:
    """Whether a code point has general category L; str.isalpha tells the same."""
    return any(map(str.isalpha, text))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the n-grams of the letters of a whole text; a run of other characters is one word boundary."""
    codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0  # the first other character after a letter stays, as 0
    codes = np.concatenate((np.zeros(1, np.uint32), codes[keep], np.zeros(1, np.uint32))).astype(np.uint64)
    total = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(codes), CHUNK):
        part = codes[start : start + CHUNK + max(LENGTHS) - 1]
        for n in LENGTHS:
            size = min(CHUNK, len(part) - n + 1)
            if size <= 0:
                continue
            h, letters = np.full(size, n, np.uint64), np.zeros(size, bool)
            for k in range(n):
                h = (h ^ part[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
                letters |= part[k : k + size] > 0
            h = (h >> np.uint64(64 - 15))[letters].astype(np.int64)
            total += np.bincount(h, minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


class Model:
    """languages, and logp: for each bucket and language, the log of the n-gram's probability."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: n-grams by language and bucket."""
        pool = counts.sum(0) + 1.0
        pool /= pool.sum()
        own = counts / np.maximum(1.0, counts.sum(1, keepdims=True))
        self.languages = languages
        self.prob = np.ascontiguousarray(((1 - SMOOTHING) * own + SMOOTHING * pool).T)
        self.logp = np.log(self.prob)

    def mixture(self, prob: np.ndarray, n: np.ndarray, share: np.ndarray, enough: float = -np.inf) -> tuple[np.ndarray, float, float]:
        """Proportions, log likelihood, and an upper bound of what any proportions reach, by expectation-maximisation; it ends
        early where that bound is at most `enough`. prob: n-grams by languages; n: their counts."""
        total = n.sum()
        for _ in range(STEPS):
            mixed = prob @ share
            gain = (n / mixed) @ prob / total
            # the log likelihood is concave: by Jensen's inequality no proportions gain more than this
            over = total * np.log(gain.max())
            if over < TOLERANCE or (enough > -np.inf and n @ np.log(mixed) + over <= enough):
                break
            share = share * gain
        else:
            mixed = prob @ share
            over = total * np.log(((n / mixed) @ prob).max() / total)
        likelihood = float(n @ np.log(mixed))
        return share, likelihood, likelihood + max(0.0, float(over))

    def shares(self, text: str) -> dict[str, float]:
        """Language to proportion, the largest first; {} for a text without a letter or where no language was learned."""
        if not self.languages or not has_letter(text):
            return {}
        buckets, n = ngram_counts(text)
        n = n.astype(float)
        alone = n @ self.logp[buckets]
        best = int(alone.argmax())
        cost = PENALTY * np.log(max(2.0, n.sum()))
        chosen, least = [best], -2 * alone[best]
        if len(self.languages) > 1:
            prob = self.prob[buckets]
            share, _, most = self.mixture(prob, n, np.full(len(self.languages), 1 / len(self.languages)), -(least - cost) / 2)
            # `most` bounds what any set can reach: often no set of two can pay its penalty, and none of more than this can
            sizes = int(np.clip(np.ceil((least + 2 * most) / cost), 1, len(self.languages)))
            order, best_share = np.argsort(-share), np.ones(1)
            for size in range(2, sizes + 1):
                own, likelihood, _ = self.mixture(prob[:, order[:size]], n, share[order[:size]] / share[order[:size]].sum())
                if (value := -2 * likelihood + cost * (size - 1)) < least:
                    chosen, least, best_share = order[:size].tolist(), value, own
            while sizes > 1 and len(chosen) < len(self.languages):
                # what a language can add is bounded in the same way; those that may pay are tried, the best one is taken
                reach = 2 * n.sum() * np.log((n / (prob[:, chosen] @ best_share)) @ prob / n.sum())
                found = None
                for k in np.flatnonzero(reach + 2 * TOLERANCE > cost).tolist():
                    if k in chosen:
                        continue
                    trial = [*chosen, k]
                    own, likelihood, _ = self.mixture(prob[:, trial], n, np.append(best_share * 0.99, 0.01))
                    if (value := -2 * likelihood + cost * (len(trial) - 1)) < least:
                        found, least = (trial, own), value
                if found is None:
                    break
                chosen, best_share = found
        if len(chosen) == 1:
            return {self.languages[chosen[0]]: 1.0}
        return {self.languages[chosen[k]]: float(best_share[k]) for k in np.argsort(-best_share)}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model of rows that have a text and a language and aren't held out: about per_language whole documents of each.

    Rows are chosen by a hash of id and language. Every language counts; the model holds half a megabyte for each."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").agg(F.count("doc_id").alias("n")).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    rate = spark.createDataFrame([Row(lang=r["lang"], rate=min(1.0, per_language / max(1, r["n"]))) for r in sizes], "lang string, rate double")
    chosen = F.pmod(F.xxhash64("doc_id", "lang", F.lit("train")), F.lit(1 << 20)) < F.col("rate") * (1 << 20)
    sample = rows.join(F.broadcast(rate), "lang").where(chosen & F.col("text").isNotNull()).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in sliced(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if has_letter(text):
                    found, n = ngram_counts(text)
                    total.setdefault(lang, np.zeros(BUCKETS, np.int64))[found] += n
        for lang, n in total.items():
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found), pa.array(n[found])], ["lang", "bucket", "n"])

    ship_code(spark)
    sums = sample.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    counts[sums["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(int), sums["bucket"].to_numpy(int)] = sums["n"].to_numpy(float)
    keep = counts.sum(1) > 0
    return Model([x for x, k in zip(languages, keep) if k], counts[keep])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (its proportion), shares (map of the chosen languages).

    Null texts and those without a letter are 'und', score 0; so are all if no language was learned. Ties go to the language
    that sorts first. Whole texts are read, each row by itself."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in sliced(batches):
            found = [own.shares(t or "") for t in b.column(2).to_pylist()]
            first = [next(iter(x.items()), (UNDETERMINED, 0.0)) for x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x for x, _ in first], pa.string()), pa.array([min(1.0, y) for _, y in first], pa.float64()), pa.array([list(x.items()) for x in found], pa.map_(pa.string(), pa.float64()))],
                ["doc_id", "held_out", "lang_pred", "score", "shares"],
            )

    ship_code(spark)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, shares map<string,double>")


def identify(docs: DataFrame, **columns) -> DataFrame:
    """predict() by a model that train() makes of the same table."""
    return predict(docs, train(docs, **columns), **{k: v for k, v in columns.items() if k in ("id_col", "text_col")})


#: A document whose largest proportion is under this is rejected by keep_identified().
LEAST_SCORE = 0.3


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE, **columns) -> DataFrame:
    """docs without the rows that are undetermined or whose main language has a proportion under least_score.

    Where train() learned no language, only null texts and those without a letter are rejected. A row is judged where it is
    read: all its columns pass through, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, **columns))
    at = docs.columns.index(columns.get("text_col", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in sliced(batches):
            texts = b.column(at).to_pylist()
            stays = [max(own.shares(t or "").values(), default=-1.0) >= least_score for t in texts] if own.languages else [has_letter(t or "") for t in texts]
            yield b.filter(pa.array(stays, pa.bool_()))

    ship_code(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
