"""SentencePiece encoding and decoding in numpy, id for id what the library gives.

Words of equal length advance together through a Viterbi lattice. At each position the substrings that end there are hashed
and probed in the sorted keys of the pieces; the score of a path to a candidate is that of the path before it plus the step's,
the vectorised maximum over candidates is stored with its back-pointer, and a word whose end no path reaches is an error. In a
model of unigrams a step scores what the piece does. In a model of merges it scores its length where the two pieces stay side by
side after all merges, and minus infinity where they may not, which leaves the library's segmentation; the plain sum of scores
would give another. A word longer than LONG advances alone: the same lattice, probed by blocks of positions."""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship_code, sliced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
BASE, LENGTH_KEY = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
NEVER = np.int64(1) << 40
#: Words longer than LONG advance alone; words kept in a worker's cache; words that advance together at most; positions of
#: a long word that are probed at once; bytes of text whose words are met together.
LONG, CACHE, TOGETHER, POSITIONS, TOGETHER_BYTES = 400, 50_000, 8192, 4096, 1 << 20
#: What the score of a character that is no piece lies under the least of a model of unigrams. Fixed value.
UNKNOWN_PENALTY = 10.0
#: Sizes of the filter before the sorted keys, and of the table of seams between two pieces.
FILTER_BITS, SEAM_BITS = 20, 20
_UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Pieces:
    """A model's pieces: sorted keys to probe, merge times, the two parts of each piece, and bytes to decode to."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], unigrams: bool = False):
        """kinds: normal, byte or control, of each piece. unigrams: the scores add up; else pieces are merged in their order."""
        self.n, self.unigrams = len(pieces), unigrams
        self.pieces = pieces
        self.bytes = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(SPACE, " ").encode() if k == "normal" else b"" for p, k in zip(pieces, kinds)]
        sizes = np.array([len(x) for x in self.bytes])
        self.surface = np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(self.bytes), np.uint8)
        self.byte_ids = {self.bytes[i][0]: i for i, k in enumerate(kinds) if k == "byte"}
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        self.ids = {pieces[i]: i for i in normal}
        order = {s: r for r, s in enumerate(sorted({-scores[i] for i in normal}))}
        self.rank = np.full(self.n + 1, NEVER)
        self.rank[normal] = [order[-scores[i]] for i in normal]
        self.length = np.ones(self.n + 1, np.int64)
        self.length[: self.n] = [len(p) for p in pieces]
        least = min((scores[i] for i in normal), default=0.0)
        # sums of scores are of single precision, as the library's, but begin with the word: where the same pieces in another
        # order have the same sum, the library's order may be another
        self.weight = np.array([*scores, least - UNKNOWN_PENALTY], np.float32) if unigrams else self.length.astype(np.float64)
        self.longest = int(max((len(pieces[i]) for i in normal), default=1))
        self.power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(2 * self.longest, BASE))), dtype=np.uint64)
        self.hash = np.zeros(self.n + 1, np.uint64)
        for i in normal:
            self.hash[i] = self._prefixes(np.array([[ord(c) for c in pieces[i]]], np.uint64))[0, -1]
        keys = self._key(self.hash[normal], self.length[normal])
        sort = np.argsort(keys)
        self.keys, self.key_ids = keys[sort], np.array(normal, np.int64)[sort]
        self.some = np.zeros(1 << FILTER_BITS, bool)  # which leading bits the keys have: most substrings go no further
        self.some[self.keys >> np.uint64(64 - FILTER_BITS)] = True
        self.seams, self.seam_ok = np.full(1 << SEAM_BITS, -1, np.int64), np.zeros(1 << SEAM_BITS, bool)
        assert len(np.unique(keys)) == len(keys), "two pieces have one key"
        if unigrams:
            self.reached = np.ones(self.n + 1, bool)
        else:
            self._trees(normal)
            self._parts = [x.tolist() for x in (self.rank, self.left, self.right, self.time)]

    def _prefixes(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * BASE + codes[:, k] + np.uint64(1)
        return out

    @staticmethod
    def _key(hashes: np.ndarray, lengths) -> np.ndarray:
        return (hashes ^ np.asarray(lengths).astype(np.uint64)) * LENGTH_KEY

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each key, or -1."""
        out = np.full(keys.shape, -1, np.int64)
        maybe = self.some[keys >> np.uint64(64 - FILTER_BITS)]
        keys = keys[maybe]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[at] == keys, self.key_ids[at], -1)
        return out

    def _trees(self, normal: list[int]) -> None:
        """The two parts that a piece is merged from, when (never before its parts), and whether merging reaches it at all."""
        self.left, self.right, self.time = (np.full(self.n + 1, -1, np.int64) for _ in range(3))
        self.reached = np.zeros(self.n + 1, bool)
        self.reached[self.n] = True
        for i in sorted(normal, key=lambda i: self.length[i]):
            merges: dict[str, tuple[str, str]] = {}
            self.reached[i] = self.merge(self.pieces[i], merges) == [i]
            if self.length[i] > 1 and self.reached[i]:
                a, b = (self.ids[x] for x in merges[self.pieces[i]])
                self.left[i], self.right[i], self.time[i] = a, b, max(self.rank[i], self.time[a], self.time[b])

    def merge(self, word: str, merges: dict[str, tuple[str, str]] | None = None) -> list[int]:
        """The ids of one word by merging pairs, the best rank first and of equals the leftmost. Characters that aren't pieces get the id n."""
        part, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(part) and (k := self.ids.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (int(self.rank[k]), i, part[i] + part[j]))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if not part[i] or (j := after[i]) >= len(part) or part[i] + part[j] != joined:
                continue
            if merges is not None:
                merges[joined] = (part[i], part[j])
            part[i], part[j], after[i] = joined, "", after[j]
            if after[i] < len(part):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ids.get(p, self.n) for p in part if p]

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """seam() of pairs, kept in a table with a place for each hash of a pair; a later pair takes the place of an earlier."""
        pair = a * (self.n + 1) + b
        slot = ((pair.astype(np.uint64) * LENGTH_KEY) >> np.uint64(64 - SEAM_BITS)).astype(np.int64)
        ok, new = self.seam_ok[slot], np.flatnonzero(self.seams[slot] != pair)
        if len(new):
            ok[new] = self.seam(a[new], b[new])
            self.seams[slot[new]], self.seam_ok[slot[new]] = pair[new], ok[new]
            held = new[self.seams[slot[new]] == pair[new]]  # of new pairs in one place one holds it: its answer must stand there
            self.seam_ok[slot[held]] = ok[held]
        return ok

    def seam(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay side by side: undoing their merges from the last, no pair across the seam was due before."""
        out, at, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), 2 * NEVER)
        while len(at):
            joined = self.probe(self._key(self.hash[a] * self.power[self.length[b]] + self.hash[b], self.length[a] + self.length[b]))
            due = (joined >= 0) & (2 * self.rank[joined] < limit) & (a != self.n) & (b != self.n)
            out[at[due]] = False
            ta, tb = self.time[a], self.time[b]
            on = ~due & ((ta >= 0) | (tb >= 0))
            at, a, b, ta, tb = at[on], a[on], b[on], ta[on], tb[on]
            undo = ta > tb
            limit = np.where(undo, 2 * ta, 2 * tb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out

    def _candidates(self, piece: np.ndarray) -> np.ndarray:
        """probe()'s answers with a character that is no piece standing alone, and without pieces that merging never reaches."""
        piece[:, -1] = np.where(piece[:, -1] < 0, self.n, piece[:, -1])
        return np.where((piece >= 0) & self.reached[piece], piece, -1)

    def viterbi(self, codes: np.ndarray) -> np.ndarray:
        """Back-pointers of words of one length, a row of code points each: the piece that ends at each position."""
        words, size = codes.shape
        prefix = self._prefixes(codes.astype(np.uint64))
        last, path = np.full((words, size + 1), -1, np.int64), np.full((words, size + 1), -np.inf, self.weight.dtype)
        path[:, 0] = 0.0
        for end in range(1, size + 1):
            lengths = np.arange(min(self.longest, end), 0, -1)  # of equal paths that with the longer last piece is taken
            piece = self._candidates(self.probe(self._key(prefix[:, end, None] - prefix[:, end - lengths] * self.power[lengths], lengths)))
            w, k = np.nonzero(piece >= 0)
            here, before = piece[w, k], last[w, end - lengths[k]]
            total = path[w, end - lengths[k]] + self.weight[here]
            if not self.unigrams:
                inner = np.flatnonzero(before >= 0)
                total[inner[~self.may_follow(before[inner], here[inner])]] = -np.inf
            score = np.full(piece.shape, -np.inf, path.dtype)
            score[w, k] = total
            best = score.argmax(1)
            rows = np.arange(words)
            path[:, end], last[:, end] = score[rows, best], piece[rows, best]
        if not np.isfinite(path[:, size]).all():
            raise ValueError("a word that no path of pieces covers")
        return last

    def viterbi_alone(self, codes: np.ndarray) -> np.ndarray:
        """viterbi() of one word of any length: substrings are hashed and probed for POSITIONS ends at once, paths compared end by end."""
        size = codes.shape[1]
        # a prefix's hash is BASE^k times a sum of codes times powers of BASE's inverse, modulo 2^64
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, BASE))), dtype=np.uint64)
        inverse = np.cumprod(np.full(size, np.uint64(pow(int(BASE), -1, 1 << 64))), dtype=np.uint64)
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes[0].astype(np.uint64) + np.uint64(1)) * inverse, dtype=np.uint64))) * power
        lengths = np.arange(self.longest, 0, -1)
        last, path, weight, seams = [-1] * (size + 1), [0.0] * (size + 1), self.weight.tolist(), {}
        for first in range(1, size + 1, POSITIONS):
            ends = np.arange(first, min(size + 1, first + POSITIONS))[:, None]
            starts = np.maximum(0, ends - lengths)
            piece = self.probe(self._key(prefix[ends] - prefix[starts] * self.power[lengths], lengths))
            piece = self._candidates(np.where(ends >= lengths, piece, -1))
            at, k = np.nonzero(piece >= 0)
            bounds = np.searchsorted(at, np.arange(len(ends) + 1)).tolist()
            pieces, back = piece[at, k].tolist(), lengths[k].tolist()
            for row, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
                end, best, found = first + row, float("-inf"), -1
                for c in range(lo, hi):
                    here, before = pieces[c], last[end - back[c]]
                    total = path[end - back[c]] + weight[here]
                    if self.unigrams:
                        total = float(np.float32(total))
                    if total <= best:
                        continue
                    if before >= 0 and not self.unigrams:
                        pair = before * (self.n + 1) + here
                        if (stays := seams.get(pair)) is None:
                            if len(seams) > CACHE:
                                seams.clear()
                            stays = seams[pair] = self._stay(before, here)
                        if not stays:
                            continue
                    best, found = total, here
                last[end], path[end] = found, best
        if path[size] == float("-inf"):
            raise ValueError("a word that no path of pieces covers")
        return np.array([last], np.int64)

    def _stay(self, a: int, b: int) -> bool:
        """seam() of one pair."""
        rank, left, right, time = self._parts
        limit = 2 * int(NEVER)
        while True:
            if a != self.n and b != self.n and (joined := self.ids.get(self.pieces[a] + self.pieces[b])) is not None and 2 * rank[joined] < limit:
                return False
            ta, tb = time[a], time[b]
            if ta < 0 and tb < 0:
                return True
            if ta > tb:
                limit, a = 2 * ta, right[a]
            else:
                limit, b = 2 * tb + 1, left[b]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, as bytes of 32-bit numbers; characters that are no piece become the pieces of their bytes."""
        out: dict[str, bytes] = {}
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        for size, some in by_size.items():
            step = TOGETHER if size <= LONG else 1
            for start in range(0, len(some), step):
                part = some[start : start + step]
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), size)
                last, at, rows = (self.viterbi if size <= LONG else self.viterbi_alone)(codes), np.full(len(part), size), []
                while (at > 0).any():
                    token = np.where(at > 0, last[np.arange(len(part)), at], -1)
                    rows.append(token)
                    at = np.where(at > 0, at - self.length[token], 0)
                ids = np.array(rows[::-1], np.int32).T
                found = ids >= 0
                flat, ends = np.ascontiguousarray(ids[found]).tobytes(), (4 * np.cumsum(found.sum(1))).tolist()
                out.update(zip(part, map(flat.__getitem__, map(slice, [0, *ends[:-1]], ends))))
                for k in np.flatnonzero((ids == self.n).any(1)):
                    out[part[k]] = self._with_bytes(part[k], ids[k][found[k]].tolist())
        return out

    def _with_bytes(self, word: str, ids: list[int]) -> bytes:
        out, at = [], 0
        for i in ids:
            size = int(self.length[i])
            out += [self.byte_ids[x] for x in word[at : at + size].encode("utf-8", "replace")] if i == self.n else [i]
            at += size
        return np.array(out, np.int32).tobytes()


class Codec:
    """Encodes and decodes whole texts; words that were met are kept, up to CACHE of them and those of the last texts."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.known: dict[str, bytes] = {}  # as long as a task: a worker that waits keeps no words

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        units = [_UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        met = set(chain.from_iterable(units))
        if len(self.known) + len(met) > CACHE:
            self.known = {w: self.known[w] for w in met & self.known.keys()}
        self.known |= self.pieces.encode_words(list(met - self.known.keys()))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, u)), np.int32) for u in units]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids, without the space that stands before every text."""
        starts, sizes, flat = self.pieces.surface
        ids = np.asarray(ids, np.int64)
        n = sizes[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        text = flat[np.repeat(starts[ids] - ends + n, n) + np.arange(total)].tobytes()
        return text.removeprefix(b" ").decode("utf-8", "replace")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a serialised message: number, and value (an integer, or bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + size]
            at += size


#: Numbers of the fields of a model file, of its kinds of model, and of the kinds of its pieces.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, SPACE_AS_SUFFIX, CHARACTER_MAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 3, 24, 2, 3, 4, 5
UNIGRAM_MODEL, MERGES_MODEL = 1, 2
KINDS = {1: "normal", 2: "control", 3: "control", 5: "control", 6: "byte"}


def parse_model(data: bytes) -> Pieces:
    """The pieces of a model file; ValueError for one that this codec would encode otherwise than the library does: it must hold
    merges or unigrams and all byte pieces, normalise nothing, put a space before each text and keep spaces at the front of words."""
    pieces, scores, kinds, trainer, normalizer = [], [], [], {}, {}
    for number, value in fields(data):
        if number == PIECE:
            held = dict(fields(value))
            pieces.append(held.get(1, b"").decode())
            scores.append(struct.unpack("<f", held[2])[0] if 2 in held else 0.0)
            kinds.append(KINDS.get(held.get(3, 1), "other"))
        elif number == TRAINER:
            trainer = dict(fields(value))
        elif number == NORMALIZER:
            normalizer = dict(fields(value))
    refused = [
        (trainer.get(MODEL_TYPE, UNIGRAM_MODEL) not in (UNIGRAM_MODEL, MERGES_MODEL), "is neither of merges nor of unigrams"), (normalizer.get(CHARACTER_MAP), "normalises characters"),
        (not normalizer.get(DUMMY_PREFIX, 1), "puts no space before a text"), (normalizer.get(EXTRA_SPACES, 1), "removes spaces"), (not normalizer.get(ESCAPE_SPACES, 1), "keeps plain spaces"),
        (trainer.get(SPACE_AS_SUFFIX, 0), "has spaces at the end of words"), ("other" in kinds, "has pieces of the user"), (kinds.count("byte") != 256, "lacks byte pieces"),
        (any(k == "normal" and not _UNIT.fullmatch(p) for p, k in zip(pieces, kinds)), "has pieces that reach beyond a word"),
    ]
    for holds, why in refused:
        if holds:
            raise ValueError(f"this codec takes no model that {why}")
    return Pieces(pieces, scores, kinds, trainer.get(MODEL_TYPE, UNIGRAM_MODEL) == UNIGRAM_MODEL)


@lru_cache(2)
def load(path: str = MODEL) -> Pieces:
    """parse_model() of a file, read where this is called."""
    with open(path, "rb") as f:
        return parse_model(f.read())


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined until their bytes exceed TOGETHER_BYTES: the more words are new at once, the longer numpy's arrays."""
    some: list[pa.RecordBatch] = []
    for b in sliced(batches, most=TOGETHER_BYTES):
        some.append(b)
        if sum(x.nbytes for x in some) > TOGETHER_BYTES:
            yield pa.concat_batches(some)
            some = []
    if some:
        yield pa.concat_batches(some)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, token_ids, round_trip (decoding gives the text back).

    Null and empty texts have no tokens; a word of any length goes whole through the lattice. A text that holds U+2581 itself decodes to spaces there, as with the library, and is
    no round trip. Repeated rows are encoded each. The model file is read on the driver; whole texts are encoded."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(model))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for b in gathered(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = codec.encode(texts)
            same = [codec.decode(x) == t for x, t in zip(ids, texts)]
            sizes = np.array([len(x) for x in ids], np.int32)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.ListArray.from_arrays(offsets, flat), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    ship_code(spark)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens int, token_ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", model: str = MODEL) -> DataFrame:
    """doc_id, text: the texts of arrays of ids; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model))
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else codec.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    ship_code(encoded.sparkSession)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
