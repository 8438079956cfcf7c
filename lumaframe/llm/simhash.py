"""SimHash near-duplicates: fingerprints, tiled exact comparison, connected classes.

Distinct fingerprints are dealt into tiles by their population count (set bits). Two fingerprints within the radius have
counts that differ by the radius at most, so only tiles of such counts meet; inside a pair of tiles the same bound, on the
counts of the four 16-bit quarters, skips sub-tiles. What is left is compared by exclusive-or and bit counts in numpy.
A pair of tiles gives a spanning forest of its links, not the links: the classes are the same.

drop_similar() finds every pair of texts with a Jaccard similarity: two such sets of shingles, put in one order, share one of their
first few. Fingerprints choose which of these candidates is compared first; all that could still join two classes are compared, unless
parities of their shingles' hashes prove that they share too few: only texts of pairs that are very likely similar are moved."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import BROADCAST_ROWS, cut, fresh, join_classes, one_row, ship_code, sliced, trimmed, without

RADIUS, SHINGLE = 4, 4
#: drop_similar(): words of a shingle, and least Jaccard similarity.
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: Values of a sketch, one a bin of hashes, and how many values there are but for 0.
SKETCH, VALUES = 128, 15
#: A key orders shingles: how often the sample has it (at most 255; 0 for once) above KEY_BITS bits of the hash. The order decides
#: how many candidates there are, not what is found. Least and most texts sampled for it, and shingles it ranks at most.
KEY_BITS, SAMPLE_LEAST, SAMPLE_MOST, COMMON = 56, 10_000, 40_000, 1_000_000
#: Shingles that a task deals out at once, and about as many that meet in a part; texts that share a key before they count as dense,
#: and how many before it a text of those is compared with by fingerprint.
DEALT, DENSE, WINDOW = 1 << 20, 32, 4096
#: Least and most parities that stand for a text; in between, the power of two from twice its shingles.
PARITIES_LEAST, PARITIES_MOST = 64, 1 << 16
#: Least and most rows of a dense key's tile, and about as many bytes of parities and texts as it holds at most.
DENSE_LEAST, DENSE_MOST, DENSE_BYTES = 512, 16_384, 8 << 20
#: Least and most fingerprints of a tile, and how many tiles are aimed at between the two.
TILE_LEAST, TILE_MOST, TILES = 2048, 262_144, 48
#: Comparisons made at once in numpy, and shingles whose bits are counted at once.
BLOCK, CHUNK = 1 << 16, 1 << 14


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """The unsigned XXH64 of each shingle of a whole text, repeats included, CHUNK at a time; no array for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if 0 < len(words) <= shingle:
        yield np.array([digest(line, 42)], np.uint64)
    if len(words) <= shingle:
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    for i in range(0, len(starts), CHUNK):
        yield np.array([digest(line[a:b], 42) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])], np.uint64)


def _majority(chunks: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for hashes in chunks:
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 for one without words."""
    return _majority(shingle_hashes(text, shingle))


def profile(text: str | None, shingle: int = SIMILAR_SHINGLE) -> tuple[int, bytes]:
    """A text's fingerprint, and its sketch: of the hashes in each bin (by their leading bits) four bits of the least, 0 for an empty
    bin, two bins a byte."""
    least, shift = np.full(SKETCH, np.iinfo(np.uint64).max), np.uint64(64 - (SKETCH - 1).bit_length())
    chunks = list(shingle_hashes(text, shingle))
    for hashes in chunks:
        sort = np.sort(hashes)
        bins, first = np.unique(sort >> shift, return_index=True)
        at = bins.astype(np.int64)
        least[at] = np.minimum(least[at], sort[first])
    values = np.where(least == np.iinfo(np.uint64).max, 0, least % np.uint64(VALUES) + np.uint64(1)).astype(np.uint8)
    return _majority(chunks), (values[::2] | values[1::2] << 4).tobytes()


def unpacked(sketches: list[bytes]) -> np.ndarray:
    """A row of values for each sketch."""
    both = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH // 2, 1)
    return np.concatenate((both & 15, both >> 4), axis=2).reshape(-1, SKETCH)


def jaccard(a: str | None, b: str | None, shingle: int = SIMILAR_SHINGLE) -> float:
    """Of the distinct shingles of two whole texts, the share that both have; 1 for two texts without words."""

    def shingles(text: str | None) -> set[tuple[bytes, ...]]:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return set(zip(*(words[k:] for k in range(shingle)))) if len(words) > shingle else {tuple(words)} - {()}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint of shingles of so many words as a signed long), one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    ship_code(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


class Forest:
    """Classes of n nodes under links that come in arrays; label[i] is the smallest node of i's class."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            if not (open_ := a != b).any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = up


def compare(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of all pairs within the radius, array by array. Quarters whose bit counts differ too much are skipped."""

    def meet(i: np.ndarray, j: np.ndarray, quarter: int, left: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(i) * len(j) <= BLOCK or quarter == 4:
            step = max(1, BLOCK // max(1, len(j)))
            for k in range(0, len(i), step):
                x, y = np.nonzero(np.bitwise_count(a[i[k : k + step], None] ^ b[j][None, :]) <= radius)
                if len(x):
                    yield i[k + x], j[y]
            return
        p, q = (np.bitwise_count((v >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)) for v in (a[i], b[j]))
        by_p, by_q = ({c: v[n == c] for c in range(17) if (n == c).any()} for v, n in ((i, p), (j, q)))
        for c, x in by_p.items():
            for d in range(c - left, c + left + 1):
                if d in by_q:
                    yield from meet(x, by_q[d], quarter + 1, left - abs(c - d))

    yield from meet(np.arange(len(a)), np.arange(len(b)), 0, radius)


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest node of its class) that span the classes of two tiles, or of one where b is None."""
    nodes = a if b is None else np.concatenate((a, b))
    forest = Forest(len(nodes))
    for i, j in compare(a, a if b is None else b, radius):
        forest.link(i, j if b is None else j + len(a))
    inner = np.flatnonzero(forest.label != np.arange(len(nodes)))
    return nodes[inner].view(np.int64), nodes[forest.label[inner]].view(np.int64)


def tile_pairs(distinct: DataFrame, radius: int, aimed: int, columns: list[str], band: int = 1) -> DataFrame:
    """a, b, and a list of each column: the tiles of rows (column fp among them) that must meet, dealt to tasks by (a, b). A tile
    has rows of so many neighbouring population counts as a band is wide.

    A tile that meets another comes as a row from each side, one that meets itself as one row."""
    spark = distinct.sparkSession
    bits, bands = F.floor(F.bit_count("fp") / band).cast("int").alias("bits"), 64 // band + 1
    counts = dict(distinct.groupBy(bits).count().collect())  # 65 rows at most
    total = sum(counts.values())
    tile = min(TILE_MOST, max(TILE_LEAST, -(-total // aimed)))
    chunks = [-(-counts.get(c, 0) // tile) for c in range(bands)]
    first = np.concatenate(([0], np.cumsum(chunks))).tolist()  # the tiles of band c are first[c] to first[c + 1] - 1
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("bits") + 1)
    tiles = distinct.select(*columns, bits).withColumn("tile", at(first[:bands]) + F.pmod(F.xxhash64(*columns), at([max(1, n) for n in chunks])))
    tiles = tiles.groupBy("tile", "bits").agg(*[F.collect_list(c).alias(c) for c in columns])
    low = [first[max(0, (c * band - radius) // band)] for c in range(bands)]
    high = [first[min(bands, (c * band + band - 1 + radius) // band + 1)] - 1 for c in range(bands)]
    pairs = tiles.select("tile", *columns, F.explode(F.sequence(at(low), at(high))).alias("other"))
    pairs = pairs.select(F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), *columns)
    return pairs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, first[bands])), "a", "b")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: links that span the classes of fingerprints (column fp, distinct) within the radius of each other."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [np.asarray(x, np.int64).view(np.uint64) for x in pdf["fp"]]
        u, v = tile_forest(sides[0], sides[1] if len(sides) > 1 else None, radius)
        return pd.DataFrame({"u": u, "v": v})

    return tile_pairs(distinct, radius, TILES, ["fp"]).groupBy("a", "b").applyInPandas(run, "u long, v long")


def sketch_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimate that pairs of sketches (rows of values) give of their texts' Jaccard similarity; one in VALUES of the least
    hashes that differ agree by chance."""
    some = ((a | b) > 0).sum(1)
    agree = ((a == b) & (a > 0)).sum(1) / np.maximum(1, some)
    return np.where(some > 0, (agree * VALUES - 1) / (VALUES - 1), 1.0)


def shingle_codes(text: str | None, shingle: int) -> np.ndarray:
    """A 64-bit hash of each shingle of a whole text, repeats included, made of its words' hashes: for drop_similar(), which is free
    in how it hashes and reads most shingles of a table."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(shingle, len(words))
    codes = np.full(len(words) - k + 1, k, np.uint64)
    for at in range(k):
        codes ^= own[at : at + len(codes)]
        codes *= np.uint64(0x9E3779B97F4A7C15)
        codes ^= codes >> np.uint64(29)
    codes *= np.uint64(0xBF58476D1CE4E5B9)
    return codes ^ codes >> np.uint64(32)


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each remainder of distinct hashes by a power of two: whether an odd number of them has it."""
    size = min(PARITIES_MOST, max(PARITIES_LEAST, 1 << (2 * len(hashes) - 1).bit_length()))
    return np.packbits((np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool), bitorder="little").tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """At least how many hashes only one of two sets has, by their parities: each changes one of them."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    x, y, n = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(b)
    while n > 8 * len(a):
        n //= 2
        y = (y & ((1 << n) - 1)) ^ (y >> n)
    return (x ^ y).bit_count()


def least_common(x, y, similarity: float):
    """How many shingles two sets of these sizes share at least if they have that Jaccard similarity."""
    return np.ceil((np.asarray(x, np.float64) + y) * (similarity / (1 + similarity)) - 1e-6)


def may_meet(size: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets of rows i and j can be similar if the key that they share is the first: it and what follows must suffice.
    Similar sets pass at the first key that they share."""
    rest = np.minimum(size[i] - pos[i], size[j] - pos[j])
    return (rest >= least_common(size[i], size[j], similarity)) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-6)


def low_bits(keys: np.ndarray) -> np.ndarray:
    return keys & np.uint64((1 << KEY_BITS) - 1)


def ordered(hashes: np.ndarray, common: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """The sorted keys of distinct hashes. common: keys of what the sample has repeatedly, sorted by lows, their hashes' bits."""
    low = low_bits(hashes)
    if not len(common):
        return np.sort(low)
    at = np.minimum(np.searchsorted(lows, low), len(common) - 1)
    return np.sort(np.where(lows[at] == low, common[at], low))


def first_keys(text: str | None, common: np.ndarray, lows: np.ndarray, similarity: float, shingle: int) -> tuple[int, int, bytes, bytes, bytes]:
    """Of a whole text: fingerprint, number of distinct shingles, a digest of their set, the least keys: so many that any similar set
    has one of them among its own, and the set's parities."""
    codes = shingle_codes(text, shingle)
    hashes = np.unique(codes)
    n = len(hashes)
    keys = ordered(hashes, common, lows)[: n - int(np.ceil(similarity * n - 1e-6)) + 1]
    fp = _majority(codes[k : k + CHUNK] for k in range(0, len(codes), CHUNK))
    return fp, n, xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes()), keys.astype("<u8").tobytes(), parities(hashes)


def by_part(columns: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of a key (the first column) and more, as bytes of each column, one record a part."""
    part = (low_bits(columns[0]) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    found, at = np.unique(part[order], return_index=True)
    spans = list(zip(at.tolist(), [*at[1:].tolist(), len(part)]))
    sides = [c[order] for c in columns]
    for k in range(0, len(spans), 1024):
        cells = [pa.array([c[a:b].tobytes() for a, b in spans[k : k + 1024]], pa.binary()) for c in sides]
        yield pa.RecordBatch.from_arrays([pa.array(found[k : k + 1024], pa.int32()), *cells], ["part", *[f"c{i}" for i in range(len(sides))]])


def common_keys(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """Keys of the shingles that a sample of the texts has more than once, sorted by hash; the most frequent if they are too many."""
    total = docs.count()
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    most = max(SAMPLE_LEAST, min(SAMPLE_MOST, total // 8))
    texts = texts.sample(most / total, seed=9) if total > most else texts
    parts = max(1, min(total, most) // 1000)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in sliced(batches):
            for t in b.column(0):
                held.append(np.unique(shingle_codes(t.as_py(), shingle)))
                n += len(held[-1])
            if n > DEALT:
                yield from by_part([np.concatenate(held)], parts)
                held, n = [], 0
        if n:
            yield from by_part([np.concatenate(held)], parts)
        held = []
        trimmed()

    def repeated(table: pa.Table) -> pa.Table:
        low = low_bits(np.frombuffer(b"".join(table.column("c0").to_pylist()), "<u8"))
        keys, n = np.unique(low, return_counts=True)
        keys = keys[n > 1] | np.minimum(n[n > 1], 255).astype(np.uint64) << np.uint64(KEY_BITS)
        keys = np.sort(keys)[::-1][:COMMON]
        return pa.table({"keys": pa.array([keys.astype("<u8").tobytes()], pa.binary())})

    found = texts.mapInArrow(shingles, "part int, c0 binary").groupBy("part").applyInArrow(repeated, "keys binary").collect()
    keys = np.sort(np.frombuffer(b"".join(bytes(r["keys"]) for r in found), "<u8"))[::-1][:COMMON]
    return keys[np.argsort(low_bits(keys))]


def nearest_before(fp: np.ndarray, size: np.ndarray, pos: np.ndarray, root: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rows that share a key: each with the row before it, WINDOW away at most, that may meet it, is of another class and has the
    nearest fingerprint."""
    out, step = [], max(1, (BLOCK << 4) // min(len(fp), WINDOW))
    for k in range(0, len(fp), step):
        j, i = np.arange(k, min(len(fp), k + step)), np.arange(max(0, k - WINDOW), min(len(fp), k + step))
        apart = np.bitwise_count(fp[j, None] ^ fp[None, i])
        apart[(i[None, :] >= j[:, None]) | (root[j, None] == root[None, i]) | ~may_meet(size, pos, i[None, :], j[:, None], similarity)] = 255
        best = apart.argmin(1)
        some = apart[np.arange(len(j)), best] < 255
        out.append((i[best[some]], j[some]))
    return tuple(np.concatenate(x) for x in zip(*out))


def run_pairs(el: np.ndarray, fp: np.ndarray, size: np.ndarray, pos: np.ndarray, similarity: float, dense: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Positions of pairs of rows sorted by key that share one and may meet, and whether each row's key is dense: more rows have it.
    Of a dense key's rows, pairs of neighbours in fingerprint only."""
    starts = np.flatnonzero(np.concatenate(([True], el[1:] != el[:-1])))
    many = np.diff(np.concatenate((starts, [len(el)])))
    out = []
    for m in np.unique(many[(many > 1) & (many <= dense)]).tolist():
        x, y = np.triu_indices(m, 1)
        at, step = starts[many == m], max(1, (BLOCK << 4) // len(x))
        for k in range(0, len(at), step):
            i, j = ((at[k : k + step, None] + z).ravel() for z in (x, y))
            ok = may_meet(size, pos, i, j, similarity)
            out.append((i[ok], j[ok]))
    for a, m in zip(starts[many > dense].tolist(), many[many > dense].tolist()):
        i, j = nearest_before(fp[a : a + m], size[a : a + m], pos[a : a + m], np.arange(m), similarity)
        out.append((a + i, a + j))
    return out, np.repeat(many > dense, many)


def sharing(nodes: DataFrame, similarity: float) -> DataFrame:
    """From nodes (node, fp, size, keys): pairs u < v that share a key and may meet, with the bits that their fingerprints are apart
    and a null key; and the rows (v, fp, size, pos) of each dense key, of whose pairs only neighbours are there."""
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), (nodes.agg(F.sum(F.length("keys"))).head()[0] or 0) // 8 // DEALT)
    dense = DENSE

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows() -> list[np.ndarray]:
            node, fp, size, many, keys = (np.concatenate(x) for x in zip(*held))
            pos = np.arange(len(keys)) - np.repeat(np.cumsum(many) - many, many)
            return [keys, *[np.repeat(x, many) for x in (node, fp, size)], pos.astype("<u4")]

        for b in sliced(batches):
            lists = b.column(3).to_pylist()
            many = np.array([len(x) // 8 for x in lists], np.int64)
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().astype("<u4"), many, np.frombuffer(b"".join(lists), "<u8")))
            n += len(held[-1][4])
            if n > DEALT:
                yield from by_part(rows(), parts)
                held, n = [], 0
        if n:
            yield from by_part(rows(), parts)
        held = []
        trimmed()

    def meet(table: pa.Table) -> pa.Table:
        trimmed()  # the part before
        el, node, fp, size, pos = (np.frombuffer(b"".join(table.column(f"c{k}").to_pylist()), t) for k, t in enumerate(("<u8", "<i8", "<u8", "<u4", "<u4")))
        order = np.argsort(el, kind="stable")
        same = el[order][1:] == el[order][:-1]
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        order = order[np.lexsort((node[order], el[order]))]
        el, node, fp, size, pos = el[order], node[order], fp[order], size[order].astype(np.int64), pos[order].astype(np.int64)
        pairs, crowd = run_pairs(el, fp, size, pos, similarity, dense) if len(el) else ([], np.zeros(0, bool))
        i, j = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        i, j = (x[np.unique(np.stack((node[i], node[j])), axis=1, return_index=True)[1]] for x in (i, j)) if len(i) else (i, j)
        none, n = np.zeros(len(i), np.int64), int(crowd.sum())
        columns = {
            "u": np.concatenate((node[i], np.full(n, -1))), "v": np.concatenate((node[j], node[crowd])), "apart": np.concatenate((np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64), np.zeros(n, np.int64))),
            "fp": np.concatenate((none, fp[crowd].view(np.int64))), "size": np.concatenate((none, size[crowd])), "pos": np.concatenate((none, pos[crowd])),
        }
        keys = pa.array(np.concatenate((none, el[crowd].view(np.int64))), pa.int64(), mask=np.arange(len(i) + n) < len(i))
        return pa.table({"el": keys, **{k: pa.array(x, pa.int64()) for k, x in columns.items()}})

    dealt = nodes.select("node", "fp", "size", "keys").mapInArrow(deal, "part int, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary")
    return dealt.groupBy("part").applyInArrow(meet, "el long, u long, v long, apart long, fp long, size long, pos long")


def similar_links(nodes: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """u, v: pairs of nodes (node, fp, size, keys) whose texts (node, size, parities, text) are similar, so many that they span the
    classes of all.

    Only pairs that parities leave are candidates. First each node is compared with the candidate nearest by fingerprint; then all
    candidates that are still of two classes, where a key is dense only the nearest again; last all pairs of dense keys that are
    still of two classes, in tiles: no table has a row for each of those."""
    found = cut(sharing(nodes, similarity))
    pairs = cut(plausible(found.where("el is null").select("u", "v", "apart").distinct(), texts, similarity))
    crowd = found.where("el is not null").select("el", F.col("v").alias("node"), "fp", "size", "pos")
    tested = cut(pairs.groupBy("v").agg(F.min_by("u", F.struct("apart", "u")).alias("u")).select("u", "v"))
    links = cut(confirmed(tested, texts, similarity, shingle))
    crowded = bool(crowd.head(1))

    def parted(rows: DataFrame, roots: DataFrame, *ends: str) -> DataFrame:
        for c in ends:
            rows = rows.join(roots.toDF(c, f"root_{c}"), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
        return rows

    def nearest(table: pa.Table) -> pa.Table:
        node, fp, size, pos, root = (table.column(c).to_numpy() for c in ("node", "fp", "size", "pos", "root_node"))
        order = np.argsort(node)
        i, j = nearest_before(fp[order].view(np.uint64), size[order], pos[order], root[order], similarity)
        return pa.table({"u": pa.array(node[order][i], pa.int64()), "v": pa.array(node[order][j], pa.int64())})

    def unsettled(roots: DataFrame) -> DataFrame:
        rows = cut(parted(crowd, roots, "node"))
        mixed = rows.groupBy("el").agg(F.min("root_node").alias("a"), F.max("root_node").alias("b")).where("a < b").select("el")
        return cut(rows.join(mixed, "el", "left_semi"))

    roots = cut(connected(links))
    new = parted(pairs.select("u", "v"), roots, "u", "v").where("root_u <> root_v").select("u", "v")
    if crowded:
        near = unsettled(roots).groupBy("el").applyInArrow(nearest, "u long, v long").distinct()
        new = new.unionByName(plausible(near, texts, similarity))
    new = cut(new.distinct().join(tested, ["u", "v"], "left_anti"))
    if new.head(1):
        links = cut(links.unionByName(confirmed(new, texts, similarity, shingle)))
    if not crowded:
        return links
    return cut(links.unionByName(dense_links(unsettled(cut(connected(links))), texts, similarity, shingle)))


def folded(odds: np.ndarray, words: int) -> np.ndarray:
    """Rows of parities (64 a word) as those of fewer remainders, so many words a row."""
    while odds.shape[1] > words:
        odds = odds[:, : odds.shape[1] // 2] ^ odds[:, odds.shape[1] // 2 :]
    return odds


def open_pairs(size: np.ndarray, pos: np.ndarray, root: np.ndarray, odds: list[bytes], first: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows that share a key, array by array: positions of pairs of two classes that may meet and that their parities leave, those
    least apart first; one of the first so many rows with one of the others, or any two rows if that is 0."""
    n, words = len(size), np.fromiter(map(len, odds), np.int64, len(odds)) // 8
    at, rows = np.zeros(n, np.int64), {}
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        at[own], rows[w] = np.arange(len(own)), np.frombuffer(b"".join(odds[k] for k in own.tolist()), "<u8").reshape(-1, w)
    j = np.arange(first, n)
    step = max(1, (BLOCK << 2) // max(1, len(j)))
    for k in range(0, first or n, step):
        i = np.arange(k, min(first or n, k + step))
        meet = (i[:, None] < j[None, :]) & (root[i, None] != root[None, j]) & may_meet(size, pos, i[:, None], j[None, :], similarity)
        x, y = np.nonzero(meet)
        x, y = i[x], j[y]
        lengths = words[x] << 32 | words[y]
        for both in np.unique(lengths).tolist():
            own, v, w = np.flatnonzero(lengths == both), both >> 32, both & 0xFFFFFFFF
            a, b = folded(rows[v], min(v, w)), folded(rows[w], min(v, w))
            for c in range(0, len(own), part := max(1, (BLOCK << 4) // min(v, w))):
                p, q = x[own[c : c + part]], y[own[c : c + part]]
                apart = np.bitwise_count(a[at[p]] ^ b[at[q]]).sum(1, dtype=np.int64)
                ok = np.flatnonzero((size[p] + size[q] - apart) / 2 >= least_common(size[p], size[q], similarity))
                if len(ok := ok[np.argsort(apart[ok], kind="stable")]):
                    yield p[ok], q[ok]


def dense_tiles(rows: DataFrame) -> DataFrame:
    """rows (el, node, size, pos, root_node, parities and maybe text) in tiles of a key, dealt by (el, a, b), the tiles that meet: a row
    as often as its key has tiles. Tiles have DENSE_LEAST to DENSE_MOST rows, fewer where they would hold more than DENSE_BYTES."""
    rows = cut(rows)
    held = sum((F.length(c) for c in ("parities", "text") if c in rows.columns), F.lit(48))
    sums = rows.groupBy("el").agg(F.count(F.lit(1)).alias("many"), F.sum(held).alias("held"))
    tile = F.least(F.lit(DENSE_MOST), F.greatest(F.lit(DENSE_LEAST), F.ceil(F.col("many") / TILES)))
    sums = cut(sums.select("el", "many", F.greatest(F.ceil(F.col("many") / tile), F.ceil(F.col("held") / DENSE_BYTES)).cast("int").alias("tiles")))
    total, pairs = sums.agg(F.sum("many"), F.sum(F.expr("tiles * (tiles + 1L) div 2"))).head()
    dealt = join_classes(rows, sums, "el", "many", total or 0, "inner").withColumn("tile", F.expr("cast(pmod(xxhash64(node), tiles) as int)"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).drop("many", "tiles")
    dealt = dealt.withColumn("a", F.least("tile", "other")).withColumn("b", F.greatest("tile", "other")).drop("other")
    return dealt.repartition(max(1, min(20_000, pairs or 0)), "el", "a", "b")


def dense_links(rows: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """u, v: pairs of similar texts (node, size, parities, text) that share a dense key (rows: el, node, size, pos, root_node) and are of
    two classes; so many that with the classes they span those of all.

    Pairs are compared where the rows of two tiles meet, and are no rows: first by parities, which leaves the rows that could still
    be linked, then those on their texts, where tiles give a spanning forest of their links."""

    def sides(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], int]:
        tile = table.column("tile").to_numpy()
        order = np.lexsort((table.column("node").to_numpy(), tile))
        tile, columns = tile[order], [table.column(c).to_numpy()[order] for c in ("node", "size", "pos", "root_node")]
        return order, columns, int(np.count_nonzero(tile == tile[0])) % len(tile)

    def active(table: pa.Table) -> pa.Table:
        trimmed()
        order, (node, size, pos, root), first = sides(table)
        odds, some = table.column("parities").take(order).to_pylist(), np.zeros(len(node), bool)
        if table.column("a")[0] == table.column("b")[0] or first:
            for i, j in open_pairs(size, pos, root, odds, first, similarity):
                some[i] = some[j] = True
        return pa.table({"el": table.column("el")[: int(some.sum())], "node": pa.array(node[some], pa.int64())})

    def forest(table: pa.Table) -> pa.Table:
        trimmed()
        order, (node, size, pos, root), first = sides(table)
        odds, said = (table.column(c).take(order).to_pylist() for c in ("parities", "text"))
        classes, codes, out = Forest(len(np.unique(root))), {}, []
        at = np.unique(root, return_inverse=True)[1]
        if table.column("a")[0] == table.column("b")[0] or first:
            for i, j in open_pairs(size, pos, root, odds, first, similarity):
                two = classes.label[at[i]] != classes.label[at[j]]
                for x, y in zip(i[two].tolist(), j[two].tolist()):
                    if classes.label[at[x]] == classes.label[at[y]]:
                        continue
                    for k in (x, y):
                        if k not in codes:
                            codes[k] = np.unique(shingle_codes(said[k], shingle))
                    both = len(np.intersect1d(codes[x], codes[y], assume_unique=True))
                    if both >= least_common(size[x], size[y], similarity) and jaccard(said[x], said[y], shingle) >= similarity:
                        classes.link(at[[x]], at[[y]])
                        out.append((x, y))
        u, v = (node[[p[k] for p in out]] if out else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"u": pa.array(np.minimum(u, v), pa.int64()), "v": pa.array(np.maximum(u, v), pa.int64())})

    ship_code(rows.sparkSession)
    rows = rows.select("el", "node", "size", "pos", "root_node").join(texts.select("node", "parities"), "node")
    left = cut(dense_tiles(rows).groupBy("el", "a", "b").applyInArrow(active, "el long, node long").distinct())
    ends = cut(left.select("node").distinct())
    said = cut(texts.select("node", "text").join(F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends, "node"))
    rows = rows.join(left, ["el", "node"]).join(said, "node")
    return dense_tiles(rows).groupBy("el", "a", "b").applyInArrow(forest, "u long, v long").distinct()


def plausible(edges: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The edges (u, v and more) but for those whose texts (node, size, parities) cannot have that Jaccard similarity, by parities."""
    names = edges.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            x, y, p, q = (b.column(k).to_pylist() for k in ("size_u", "size_v", "parities_u", "parities_v"))
            apart = np.fromiter(map(least_apart, p, q), np.float64, b.num_rows)
            x, y = np.array(x, np.float64), np.array(y, np.float64)
            yield b.select(names).filter(pa.array((x + y - apart) / 2 >= least_common(x, y, similarity)))

    ship_code(edges.sparkSession)
    rows = edges
    for c in "uv":
        rows = rows.join(texts.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("parities").alias(f"parities_{c}")), c)
    return rows.mapInArrow(run, edges.schema)


def confirmed(edges: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """The edges (u, v) whose texts (node, text) have at least that Jaccard similarity. Of all texts those of an end are picked where
    they are, unless there are over BROADCAST_ROWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield b.select(["u", "v"]).filter(pa.array([jaccard(x, y, shingle) >= similarity for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_()))

    ship_code(edges.sparkSession)
    ends = cut(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct())
    texts = cut(texts.select("node", "text").join(F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends, "node"))
    pairs = edges.join(texts.toDF("u", "one"), "u").join(texts.toDF("v", "other"), "v").select("u", "v", "one", "other")
    return pairs.mapInArrow(run, "u long, v long")


def connected(edges: DataFrame) -> DataFrame:
    """node, root: each node of the edges (u, v) with the smallest node of its class.

    Each round hooks every node to its smallest smaller neighbour, doubles pointers until they reach roots, and contracts the
    graph; at least half of the nodes that are left go in each. All of it is joins and sums over tables in the shared folder."""
    e = cut(edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a < b").distinct())
    labels = None
    while e.head(1):
        up = cut(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            up = cut(up.join(above, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
            if not up.where("moved").head(1):
                break
            up = up.select("node", "root")
        up = up.select("node", "root")
        if labels is None:
            labels = up
        else:
            moved = labels.join(up.toDF("root", "higher"), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
            labels = cut(moved.unionByName(up))
        for c in ("a", "b"):
            e = e.join(up.toDF(c, "higher"), c, "left").withColumn(c, F.coalesce("higher", c)).drop("higher")
        e = cut(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels if labels is not None else e.toDF("node", "root")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), class_size.

    Null and empty texts, and those of white space, have fingerprint 0 and are linked like any other. A null id is never
    the smallest; a class without any id has a null component_id. Repeated rows are rows of one class. Comparison is
    quadratic in distinct fingerprints, as the method is; classes and tiles lose no link."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    out = join_classes(fps, _classes(fps, radius).select("fp", "n", "component_id", "class_size"), "fp", "n", fps.count(), "inner")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size")


def _classes(fps: DataFrame, radius: int) -> DataFrame:
    """For each fingerprint: fp, its rows n and least_id, component_id, class_size, and first: whether the row that stays of its
    class, that with the smallest id and then fingerprint, a null id last, has this fingerprint (and least_id)."""
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    roots = connected(links(distinct, radius))
    linked = distinct.join(roots.toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = F.min(F.struct(F.col("least_id").isNull().alias("no_id"), "least_id", "fp")).alias("best")
    sums = linked.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("fps"), best)
    sums = sums.withColumn("first_fp", F.col("best.fp")).drop("best")
    linked = cut(linked)
    sums = cut(sums)
    classes = join_classes(linked.select("fp", "n", "least_id", "root"), sums, "root", "fps", linked.count())
    return cut(classes.withColumn("first", F.col("fp") == F.col("first_fp")).drop("first_fp"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """docs with exactly one row of each class, whatever its id: that with the smallest id, then fingerprint, a null id last; of
    several alike in both, that of common.one_row(). All columns as they were.

    A row whose id no other row has is judged by its id; only the others are read and fingerprinted again."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = _classes(fps, radius)
    total = fps.count()
    rows = join_classes(fps, classes.select("fp", "n", "least_id", "first"), "fp", "n", total, "inner")
    rows = rows.select("doc_id", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("least_id"))).alias("stays"))
    ids = cut(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("stays").alias("stays")))
    again = ids.where("n > 1").select("doc_id")
    own = without(docs, id_col, ids.where("n > 1 or not stays").select("doc_id")).where(F.col(id_col).isNotNull())
    if not again.head(1) and not fps.where("doc_id is null").head(1):
        return own
    judged = docs.join(F.broadcast(again) if again.count() <= BROADCAST_ROWS else again, docs[id_col] == again["doc_id"], "left_semi")
    judged = judged.unionByName(docs.where(F.col(id_col).isNull()))
    at, (fp, least, n) = docs.columns.index(text_col), fresh(docs, "fp", "least_id", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.int64())], [*b.schema.names, fp])

    judged = judged.mapInArrow(run, StructType([*docs.schema.fields, StructField(fp, LongType())]))
    firsts = classes.where("first").select(F.col("fp").alias(fp), F.col("n").alias(n), F.col("least_id").alias(least))
    judged = join_classes(judged, firsts, fp, n, total, "inner").where(F.col(id_col).eqNullSafe(F.col(least)))
    return own.unionByName(one_row(judged.drop(least, n), fp, text_col))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """docs with exactly one row of each class of similar texts: that with the smallest id, a null id last, then the longest text.
    All columns as they were.

    Two texts are linked if their shingles (lower-cased A-Z) have at least that Jaccard similarity (over 0), and classes are what
    links reach. No link is lost: shingles are put in one order, rare ones first as far as a sample tells, and two similar texts share
    one of their first; those that do are candidates unless parities rule them out, nearest fingerprints first, confirmed on the texts
    unless they are of one class already. Null and empty texts, and those of white space, are alike. Texts that share an id, and rows without one, are judged each;
    rows that repeat in all columns leave one. An empty table stays empty. Work grows with the texts and the pairs that share a rare
    shingle; it is quadratic only in texts of different classes that share one of their rarest fifth."""
    fp, size, digest, keys, odd, row = fresh(docs, "fp", "size", "digest", "keys", "parities", "row")
    at = docs.columns.index(text_col)
    ship_code(docs.sparkSession)
    common = common_keys(docs, text_col, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = low_bits(common)  # once a task: there may be a million
        for b in sliced(batches):
            fps, sizes, digests, first, odds = zip(*[first_keys(t.as_py(), common, lows, similarity, shingle) for t in b.column(at)])
            made = [pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(first, pa.binary()), pa.array(odds, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, fp, size, digest, keys, odd])

    more = [StructField(fp, LongType()), StructField(size, LongType()), StructField(digest, BinaryType()), StructField(keys, BinaryType()), StructField(odd, BinaryType())]
    marked = docs.mapInArrow(run, StructType([*docs.schema.fields, *more]))
    marked = cut(marked.withColumn(row, F.monotonically_increasing_id()))
    total = marked.count()
    ident, length = F.col(f"`{id_col}`"), F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = marked.select(F.col(digest).alias("digest"), F.struct(ident.isNull().alias("no_id"), ident.alias("id"), (-length).alias("less"), F.col(row).alias("row")).alias("best"))
    sets = cut(rows.groupBy("digest").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n")))
    again = sets.where("n > 1").select("digest", "n", F.col("best.row").alias("node"))
    again = cut(join_classes(rows.select("digest", "best.row"), again, "digest", "n", total, "inner").where("row <> node").select("row"))
    nodes = without(marked.select(F.col(row).alias("node"), F.col(fp).alias("fp"), F.col(size).alias("size"), F.col(keys).alias("keys")), "node", again).where("size > 0")
    texts = marked.select(F.col(row).alias("node"), F.col(size).alias("size"), F.col(odd).alias("parities"), F.col(f"`{text_col}`").alias("text"))
    roots = connected(similar_links(nodes, texts, similarity, shingle))
    linked = cut(sets.withColumn("node", F.col("best.row")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    sums = cut(linked.groupBy("root").agg(F.min("best").alias("first"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("many")).where("rows > 1"))
    classes = cut(join_classes(linked.select("root", "digest", "n"), sums.select("root", F.col("first.row").alias("stays"), "many"), "root", "many", linked.count(), "inner"))
    judged = join_classes(rows.select("digest", "best.row"), classes.select("digest", "n", "stays"), "digest", "n", total, "inner")
    out = without(marked, row, cut(judged.where("row <> stays").select("row")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
