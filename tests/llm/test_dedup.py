"""Exact dedup and SimHash against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from lumaframe.llm import exact_dedup, simhash
from lumaframe.llm.simhash import compare, connected, fingerprint

TEXTS = ["a b c", "a  b c", "abc\n", None, "", " \t", "é1", "e1", "a b c", "word " * 20_000, "word " * 20_000 + "\n", "\x0b\x0c\r", "a\xa0b"]


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[n])
        keep = None if best[1] else best[2]
        out.append((i, keep, len(groups[n]), keep == i, hashlib.sha256(n.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("bits", [256, 8])
def test_groups(make_docs, bits):
    """Digests of 8 bits collide; byte verification must part them."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "abc"), (7, "e1"), *((100 + i, f"t{i}") for i in range(60))]
    docs = make_docs([(i, t, "en", "s") for i, t in rows])
    got = [tuple(r) for r in exact_dedup.exact_groups(docs, digest_bits=bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_groups(rows)))


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_index_in_batches(monkeypatch, spark, make_docs, most):
    """Batches flushed, compacted, and more flushed later give what all rows give at once; filters miss nothing, also unused ones."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", most)
    monkeypatch.setattr(exact_dedup, "FAN_IN", 2)
    rnd = random.Random(6)
    rows = [(rnd.choice([None, rnd.randrange(4000)]), f"t{rnd.randrange(1500)}" + " " * rnd.randrange(3)) for _ in range(3000)]
    docs = make_docs([(i, t, "en", "s") for i, t in rows])
    index = exact_dedup.DigestIndex(spark)
    batches = index.log(docs.select(index.digest(F.col("text")).alias("digest"), F.length("text").alias("n_cp"), "doc_id"), 3)
    index.flush(batches[0])
    index.flush(batches[1])
    assert index.compact().where("group_size > 0").count() == batches[0].unionByName(batches[1]).select("digest").distinct().count() and [r.level for r in index.runs] == [1]
    new = batches[2].select("digest").distinct()
    maybe = {bytes(r.digest): r.maybe for r in index.probe(new, index.runs).collect()}
    held = {bytes(r.digest) for r in index._table(index.runs[0].path).collect()}
    assert all(maybe[x] for x in maybe.keys() & held) and (most == 0 or sum(maybe[x] for x in maybe.keys() - held) < 0.2 * len(maybe.keys() - held) + 3)
    assert {bytes(r.digest) for r in index.find(new).collect()} == held & maybe.keys()
    index.flush(batches[2])
    got = {bytes(r.digest).hex(): (r.keep_id, r.group_size) for r in index.compact().collect()}
    assert got == {sha: (keep, size) for _, keep, size, _, sha in brute_groups(rows)}


def test_drop_copies(make_docs):
    docs = make_docs([(1, "x y", "en", "s"), (2, "xy", "en", "s"), (1, "x y", "en", "s"), (3, None, "en", "s"), (4, "", "en", "s"), (5, "z", "en", "s")])
    kept = exact_dedup.drop_copies(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5] and kept.columns == docs.columns


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_drop_copies_by_row(monkeypatch, make_docs, broadcast):
    """Texts that share an id both stay, a copy goes whatever else has its id, and null ids leave one row a text."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", broadcast)
    rows = [(1, "a"), (1, "b"), (2, "c"), (3, "c"), (3, "d"), (None, "e"), (None, "e "), (None, "e"), (None, "a"), (None, "f"), (5, "g g"), (5, "gg"), (6, "h"), (6, "h")]
    kept = exact_dedup.drop_copies(make_docs([(i, t, "en", "s") for i, t in rows]))
    want = [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e "), (None, "f"), (5, "g g"), (6, "h")]
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, want))


def test_drop_near_by_row(make_docs):
    """One row a class: texts that share an id both stay, and so does one of those without an id."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(1, a), (1, b), (2, c), (3, c.upper()), (3, d), (None, e), (None, e.upper()), (None, a), (7, d.upper())]
    docs = make_docs([(i, t, "en", "s") for i, t in rows])
    kept = simhash.drop_near(docs)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(str((i, t.lower())) for i, t in got) == sorted(map(str, [(1, a), (1, b), (2, c), (3, d), (None, e)]))
    assert simhash.drop_near(docs.where("false")).count() == 0


def test_empty(make_docs):
    docs = make_docs(["x"]).where("false")
    assert exact_dedup.exact_groups(docs).count() == 0 and simhash.near_classes(docs).count() == 0
    assert exact_dedup.drop_copies(docs).count() == 0 and simhash.drop_near(docs).count() == 0


def brute_fingerprint(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_rows(n=120):
    rnd = random.Random(3)
    words = [f"w{i}É" for i in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 300))] for _ in range(n)]
    out = [" ".join(b) for b in base]
    for b in base[: n // 2]:
        b = list(b)
        b[rnd.randrange(len(b))] = "CHANGED"
        out.append("\t".join(b).upper())
    return out + TEXTS + ["a", "A", "a b", "a b c d", "a b c d e"]


def test_fingerprints():
    for t in near_rows():
        assert fingerprint(t) == brute_fingerprint(t)


def test_near_classes(make_docs):
    rows = [(i, t, "en", "s") for i, t in enumerate(near_rows())] + [(None, "a b c", "en", "s"), (3, "a b c", "en", "s")]
    fps = np.array([brute_fingerprint(t) for _, t, *_ in rows], np.uint64)
    label = np.arange(len(rows))
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    while (new := np.array([label[c].min() for c in close])).tolist() != label.tolist():
        label = new
    least = {k: min((rows[i][0] for i in np.flatnonzero(label == k) if rows[i][0] is not None), default=None) for k in set(label)}
    want = sorted((str(r[0]), f"{f:016x}", str(least[k])) for r, f, k in zip(rows, fps, label))
    got = simhash.near_classes(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    kept = simhash.drop_near(make_docs(rows).where("doc_id is not null"))
    classes = {k for k, r in zip(label, rows) if r[0] is not None}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least[k] for k in classes)


def test_shingle_and_radius(make_docs):
    """Near copies over 4 bits apart in shingles of 5 words are found at their distance, and not under it."""
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join([*words[:20], "x", *words[21:]])]
    a, b = (fingerprint(t, 5) for t in texts)
    apart = (a ^ b).bit_count()
    assert apart > 4 and [r.fp for r in simhash.fingerprints(make_docs(texts), shingle=5).sort("doc_id").collect()] == np.array([a, b], np.uint64).view(np.int64).tolist()
    for radius, n in ((apart - 1, 2), (apart, 1)):
        assert simhash.drop_near(make_docs(texts), radius=radius, shingle=5).count() == n


@pytest.mark.parametrize("n,m,block", [(700, 900, 1 << 10), (5, 0, 1 << 18), (300, 300, 64)])
def test_compare_loses_nothing(monkeypatch, n, m, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    draw = np.random.default_rng(5)
    a = draw.integers(0, 1 << 63, n, dtype=np.uint64)
    b = a[draw.integers(0, n, m)] ^ (np.uint64(1) << draw.integers(0, 64, m).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, m).astype(np.uint64))
    got = {(int(x), int(y)) for i, j in compare(a, b) for x, y in zip(i, j)}
    assert got == {tuple(map(int, p)) for p in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= 4))}


def test_connected_chain_and_star(spark):
    """A long chain in bad order, a star and a ring: the classes need several rounds."""
    rnd = random.Random(1)
    chain = list(range(100, 180))
    rnd.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(5, i) for i in range(6, 40)] + [(i, 201 + (i - 200) % 9) for i in range(201, 210)] + [(7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 100 for i in range(101, 180)) and all(got[i] == 5 for i in range(6, 40)) and all(got[i] == 201 for i in range(202, 210))
    assert not got.keys() & {100, 5, 201}


def similar_rows():
    """Texts with near copies of many similarities, a chain of copies of copies, a large group, and short texts."""
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(900)]
    out = []
    for k in range(60):
        base = [rnd.choice(words) for _ in range(rnd.randint(6, 400))]
        out.append(" ".join(base))
        for n in (1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(n):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out.append("\n".join(copy).upper() if n == 2 else " ".join(copy))
    chain = [rnd.choice(words) for _ in range(150)]
    for k in range(12):
        chain = [*chain[:k * 10], "new", str(k), *chain[k * 10 + 2:]]
        out.append(" ".join(chain))
    base = [rnd.choice(words) for _ in range(120)]
    out += [" ".join([*base[:k], "x", *base[k + 1:]]) for k in range(120)]
    return out + ["a", "A", "a b c d e", "a b c d e f", "a b c d f", None, "", " \n"]


def brute_similar(texts, least=0.8):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, label, links = [shingles(t) for t in texts], list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i):
            if not sets[i] and not sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) > 0:
                links.append((j, i))
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label, links


def test_drop_similar(make_docs):
    """Against brute force: whatever is dropped has a row that stays in its class, and nearly all that should go is gone."""
    texts = similar_rows()
    label, links = brute_similar(texts)
    docs = make_docs(texts)
    kept = simhash.drop_similar(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids))
    least = set(label)
    assert least <= set(ids)  # the smallest id of each class stays: nothing is dropped without a link
    assert len(set(ids) - least) <= 0.02 * (len(texts) - len(least)), sorted(set(ids) - least)


def test_drop_similar_by_row(make_docs):
    """Texts that share an id are judged each, null ids too; copies of all columns leave one; empty tables stay empty."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " tail"), (None, c), (None, c.upper() + " tail"), (3, b), (1, a), (4, None), (5, ""), (6, c + " end")]
    docs = make_docs([(i, t, "en", "s") for i, t in rows])
    got = sorted(str((r.doc_id, r.text)) for r in simhash.drop_similar(docs).collect())
    assert got == sorted(map(str, [(1, a), (1, b), (4, None), (6, c + " end")]))
    assert simhash.drop_similar(docs.where("false")).count() == 0


@pytest.mark.parametrize("dense", [32, 3])
def test_drop_similar_loses_no_link(monkeypatch, make_docs, dense):
    """Exactly the classes of brute force: at the least similarity, with fingerprints far apart, and where many texts share keys."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = similar_rows()
    for _ in range(200):
        base = [rnd.choice(words) for _ in range(13)]
        texts += [" ".join(base), " ".join([*base[:-1], "other"])]
    line = [rnd.choice(words) for _ in range(40)]
    texts += [" ".join([*line, *(rnd.choice(words) for _ in range(rnd.choice([3, 5, 9])))]) for _ in range(80)]
    far = [(simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() for a, b in zip(texts[-480:-80:2], texts[-479:-80:2])]
    assert max(far) > 16
    assert sorted(r.doc_id for r in simhash.drop_similar(make_docs(texts)).collect()) == sorted(set(brute_similar(texts)[0]))


def test_sketch_estimates_similarity():
    texts = similar_rows()[:360]
    made = [simhash.profile(t) for t in texts]
    assert all(fp == fingerprint(t, 5) for (fp, _), t in zip(made, texts))
    sketches = simhash.unpacked([x for _, x in made])
    i, j = np.triu_indices(len(texts), 1)
    off = [abs(e - simhash.jaccard(texts[a], texts[b])) for a, b, e in zip(i, j, simhash.sketch_similarity(sketches[i], sketches[j])) if a // 6 == b // 6]
    assert np.mean(off) < 0.03 and np.quantile(off, 0.99) < 0.1


def test_only_plausible_pairs_move_texts(monkeypatch, make_docs):
    """Texts that share a rare passage but too few shingles are candidates by keys; parities rule them out before texts are moved."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(100_000)]
    texts = [" ".join(rnd.choices(words, k=60)) for _ in range(60)]
    texts += [f"{t} {' '.join(rnd.choices(words, k=25))}" for t in texts]
    seen, confirmed = [], simhash.confirmed
    monkeypatch.setattr(simhash, "confirmed", lambda edges, *a: (seen.append(edges.count()), confirmed(edges, *a))[1])
    texts += [f"{t} last" for t in texts[:10]]
    assert simhash.drop_similar(make_docs(texts)).count() == 120
    assert 10 <= sum(seen) <= 15


def test_parities_bound_what_is_apart():
    rnd = np.random.default_rng(3)
    for n, own in [(0, 0), (1, 0), (1, 1), (40, 9), (500, 60), (500, 400), (3000, 90), (60_000, 20_000)]:
        pool = np.unique(rnd.integers(0, 1 << 64, 2 * n + own, np.uint64))
        a, b = pool[:n], np.concatenate((pool[: n - n // 3], pool[n : n + own]))
        bound, apart = simhash.least_apart(simhash.parities(a), simhash.parities(b)), len(np.setxor1d(a, b))
        assert bound <= apart and simhash.least_apart(simhash.parities(b), simhash.parities(a)) == bound
        assert n > 1000 or bound >= 0.4 * apart


@pytest.mark.parametrize("least, held", [(512, 8 << 20), (150, 8 << 20)])
def test_pairs_of_a_dense_group_are_no_rows(monkeypatch, make_docs, least, held):
    """A large group of near copies, many of them of no class: what is joined and moved does not grow with its square, whatever the
    tiles, and no link is lost."""
    monkeypatch.setattr(simhash, "DENSE_LEAST", least)
    monkeypatch.setattr(simhash, "DENSE_BYTES", held)
    rnd = random.Random(17)
    words = [f"w{i}" for i in range(5000)]
    base, texts = [rnd.choice(words) for _ in range(150)], []
    for k in range(400):
        copy = list(base)
        for at in rnd.sample(range(150), rnd.choice([1, 2, 2, 3, 5, 6])):
            copy[at] = rnd.choice(words[:40])
        texts.append(" ".join(copy[rnd.randrange(6) : 150 - rnd.randrange(6)]))
    texts += [" ".join(copy[:n]) for n in (125, 128, 132, 136, 140)]
    seen = []
    for name in ("plausible", "confirmed"):
        monkeypatch.setattr(simhash, name, lambda edges, *a, f=getattr(simhash, name): (seen.append(edges.count()), f(edges, *a))[1])
    label, links = brute_similar(texts)
    assert sorted(r.doc_id for r in simhash.drop_similar(make_docs(texts)).collect()) == sorted(set(label))
    assert 20 < len(set(label)) < 300 and len(links) > 5 * len(texts) and sum(seen) < 8 * len(texts), (len(set(label)), len(links), seen)


def test_open_pairs():
    """All similar pairs of two classes, of texts whose parities differ in length too, within one tile and between two."""
    rnd = np.random.default_rng(4)
    pool = np.unique(rnd.integers(0, 1 << 64, 600, np.uint64))
    sets = [np.setdiff1d(pool[: rnd.choice([30, 36, 60, 70, 500, 560])], rnd.choice(pool, rnd.choice([1, 20, 60]))) for _ in range(150)]
    size, root, odds = np.array([len(s) for s in sets]), rnd.integers(0, 9, 150), [simhash.parities(s) for s in sets]
    assert len({len(o) for o in odds}) > 3
    similar = {(i, j) for i in range(150) for j in range(i + 1, 150) if root[i] != root[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    for first, block in ((0, simhash.BLOCK), (70, simhash.BLOCK), (0, 40), (70, 40)):
        simhash.BLOCK, was = block, simhash.BLOCK
        got = [(int(i), int(j)) for x, y in simhash.open_pairs(size, np.zeros(150, np.int64), root, odds, first, 0.8) for i, j in zip(x, y)]
        simhash.BLOCK = was
        wanted = {(i, j) for i, j in similar if not first or i < first <= j}
        assert len(got) == len(set(got)) and wanted <= set(got) and all(root[i] != root[j] and i < j and (not first or i < first <= j) for i, j in got)
        assert len(wanted) > 50 and len(got) < 3 * len(wanted)
