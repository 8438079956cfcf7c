"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics of the whole text. Each partition sums its part of
the normal equations; the sums are added and solved. Labelled rows that the fit does not see calibrate the scores."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, held_out, ship_code, sliced

#: Random features, width of the kernel in standard deviations, ridge, and the seed of the features.
FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 20240229
#: Labelled rows that fitting and calibration read on average, and the tasks that sum their part of the normal equations.
FIT_ROWS, CALIBRATION_ROWS, SUMS = 20_000, 10_000, 16
THRESHOLD = 0.3
#: The classes of characters that are counted.
UPPER, LOWER, OTHER_LETTER, DIGIT, SPACE, LINE, STOP, MARK, SYMBOL, REST = range(10)
NAMES = ("log_words", "word_length", "distinct_words", "repeated_next", "log_longest", "distinct_lines", "log_line_words", "upper", "digit", "space", "line", "stop", "mark", "symbol", "rest", "other_letter")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    by = {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER, "Lm": OTHER_LETTER, "Lo": OTHER_LETTER, "Nd": DIGIT, "Zs": SPACE, "Sm": SYMBOL, "Sc": SYMBOL, "Sk": SYMBOL, "So": SYMBOL}
    out = np.array([by.get(unicodedata.category(chr(c)), REST) for c in range(0x110000)], np.uint8)
    for chars, kind in (("\t \x0b\x0c\r", SPACE), ("\n", LINE), (".,;:'\"()-", STOP), ("!?", MARK), ("#*%&|<>$@^~_=+\\/{}[]", SYMBOL)):
        out[[ord(c) for c in chars]] = kind
    return out


def statistics(text: str | None) -> list[float]:
    """The statistics NAMES of a whole text; all 0 for a null or empty one."""
    if not text:
        return [0.0] * len(NAMES)
    n = np.bincount(classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=10)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    total, letters, many = len(text), max(1, n[UPPER] + n[LOWER] + n[OTHER_LETTER]), max(1, len(words))
    lengths = list(map(len, words))
    again = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(len(words)), min(40.0, sum(lengths) / many), len(set(words)) / many, again / many, np.log1p(max(lengths, default=0)), len(set(lines)) / max(1, len(lines)), np.log1p(len(words) / max(1, len(lines))),
        n[UPPER] / letters, n[DIGIT] / total, n[SPACE] / total, n[LINE] / total, n[STOP] / many, n[MARK] / many, n[SYMBOL] / many, n[REST] / total, n[OTHER_LETTER] / letters,
    ]


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stats (array of floats), one row per row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            stats = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(stats, pa.list_(pa.float32()))], ["doc_id", "stats"])

    ship_code(docs.sparkSession)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, stats array<float>")


@dataclass
class Model:
    """score() of an array of statistics, a row a document."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the random features and, last, the constant
    knots: np.ndarray  # raw scores, ascending
    levels: np.ndarray  # calibrated scores at the knots, ascending

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return features(stats, self.mean, self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0.0, 1.0)


def features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant 1."""
    draw = np.random.default_rng(SEED)
    d = len(mean)
    frequency, phase = draw.normal(0.0, 1.0 / (WIDTH * np.sqrt(d) / 2), (d, FEATURES)), draw.uniform(0.0, 2 * np.pi, FEATURES)
    z = np.clip((stats.reshape(-1, d) - mean) / scale, -8.0, 8.0)
    return np.concatenate((np.sqrt(2.0 / FEATURES) * np.cos(z @ frequency + phase), np.ones((len(z), 1))), axis=1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the monotone least-squares fit of y on x, by pooling neighbours that fall."""
    at = np.unique(x)
    order = np.argsort(x, kind="stable")
    sums, sizes = np.add.reduceat(y[order], np.searchsorted(x[order], at)), np.diff(np.append(np.searchsorted(x[order], at), len(x)))
    blocks: list[list[float]] = []  # sum, size, least x, greatest x
    for s, n, v in zip(sums.tolist(), sizes.tolist(), at.tolist()):
        blocks.append([s, n, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], high]
    ends = [(v, s / n) for s, n, low, high in blocks for v in ((low, high) if low < high else (low,))]
    return np.array([v for v, _ in ends]), np.array([level for _, level in ends])


def labelled_sample(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, stats, label, calibrates: about FIT_ROWS rows that fit and CALIBRATION_ROWS others that calibrate, in the shared folder.

    labels: doc_id, label, one row an id. Ids are chosen by a hash before they meet their documents, so the chosen labels are few
    enough to broadcast and nothing is shuffled by id; rows that repeat an id and statistics teach once. Where ids repeat so
    often, with different texts, that there are more than twice as many rows, these are thinned by a hash of the row."""
    fold = F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string")).cast("binary")) % 4
    most, unit = {False: FIT_ROWS, True: CALIBRATION_ROWS}, 1 << 20

    def thinned(rows: DataFrame, sizes: dict[bool, int], *key: str) -> DataFrame:
        below = lambda k: int(min(1.0, most[k] / max(1, sizes.get(k, 0))) * unit)
        return rows.where(F.pmod(F.xxhash64(*key, F.lit("fit")), F.lit(unit)) < F.when(F.col("calibrates"), below(True)).otherwise(below(False)))

    labels = cut(labels.withColumn("calibrates", fold == 0))
    chosen = thinned(labels, dict(labels.groupBy("calibrates").count().collect()), "doc_id")
    rows = cut(stats.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "stats"]))
    sizes = dict(rows.groupBy("calibrates").count().collect())
    return rows if all(n <= 2 * most[k] for k, n in sizes.items()) else thinned(rows, sizes, "doc_id", "stats")


def fit(labelled: DataFrame) -> Model:
    """A model of the rows of labelled_sample(), few as they are: those that don't calibrate are fitted.

    With no labels every score is 0.5; with labels of one class, that class."""
    flat = lambda level: Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(FEATURES + 1), np.array([0.0]), np.array([level]))
    part = lambda calibrates: labelled.where(F.col("calibrates") == calibrates).select("stats", F.col("label").cast("double").alias("label"))
    fitting, calibrating = part(False), part(True)
    columns = [F.col("stats")[i].cast("double") for i in range(len(NAMES))]
    summed = fitting.agg(F.count("label"), F.avg("label"), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).head()
    if not summed[0]:
        return flat(0.5)
    if summed[1] in (0.0, 1.0):
        return flat(summed[1])
    mean = np.array(summed[2 : 2 + len(NAMES)], float)
    scale = np.maximum(np.array(summed[2 + len(NAMES) :], float), 1e-4)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in sliced(batches):
            z = features(np.array(b.column(0).to_pylist(), float), mean, scale)
            both += z.T @ np.concatenate((z, b.column(1).to_numpy().reshape(-1, 1)), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], ["sums"])

    total = sum(np.frombuffer(r[0]).reshape(FEATURES + 1, FEATURES + 2) for r in fitting.coalesce(SUMS).mapInArrow(equations, "sums binary").collect())  # SUMS matrices
    penalty = RIDGE * summed[0] * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    model = Model(mean, scale, np.linalg.solve(total[:, :-1] + penalty, total[:, -1]), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    rows = calibrating.toPandas()
    if len(rows):
        x = model.raw(np.array(rows["stats"].tolist(), float))
        model.knots, model.levels = isotonic(np.round(x, 6), rows["label"].to_numpy(float))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (score at least THRESHOLD).

    Rows with a null id or label teach nothing; of several labels of an id the mean, at least one half, counts. Null and empty
    texts are scored as texts of zero statistics. Repeated rows are scored each; an empty table gives no rows."""
    stats = cut(statistics_table(docs, id_col, text_col))
    labels = labels.select(F.col("doc_id"), F.col(label_col).alias("label")).where("doc_id is not null and label is not null")
    labels = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    model = fit(labelled_sample(stats, labels))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            score = shared.value.score(np.array(b.column(2).to_pylist(), float).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "stats")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
