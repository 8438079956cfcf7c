"""Language ID against brute force, and ties, repeated rows and ids, null ids and very long texts where operators meet them."""

import collections
import itertools
import math
import random
import zlib

import numpy as np

from lumaframe.llm import exact_dedup, langid, mixing, quality_model, sentencepiece_viterbi, simhash, token_counts

WORDS = {"xx": "the of and that with from this was".split(), "yy": "der und die ist nicht ein wir über".split(), "zz": "ñandú qué los las para una cómo está".split()}


def some_text(parts, rnd):
    return " ".join(rnd.choice(WORDS[lang]) for lang, n in parts for _ in range(n))


def brute_counts(text):
    """Buckets of the 1- to 3-grams of letters, one character at a time: a run of other characters is one boundary, as are both ends."""
    runs, run = [], []
    for ch in text + " ":
        if ch.isalpha():
            run.append(ord(ch.lower()) if len(ch.lower()) == 1 else ord(ch))
        elif run:
            runs.append(run)
            run = []
    codes = [0]
    for run in runs:
        codes += [*run, 0]
    if runs and not text[-1].isalpha():
        codes.append(0)  # the text's end is a boundary of its own after a last run of other characters
    out = collections.Counter()
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            if any(codes[i : i + n]):
                h = n
                for c in codes[i : i + n]:
                    h = ((h ^ c) * 0x9E3779B97F4A7C15) % 2**64
                out[h >> 49] += 1
    return out


def brute_model(docs):
    sums = collections.defaultdict(collections.Counter)
    for _, text, lang in docs:
        sums[lang].update(brute_counts(text))
    pool = collections.Counter()
    for c in sums.values():
        pool.update(c)
    whole = sum(pool.values()) + langid.BUCKETS
    return {lang: lambda b, c=c, n=sum(c.values()): 0.95 * c[b] / n + 0.05 * (pool[b] + 1) / whole for lang, c in sums.items()}


def brute_shares(model, text):
    """The proportions of the set of least penalised likelihood of all sets of languages, each by 3,000 plain steps."""
    counts, best = brute_counts(text), (math.inf, {})
    cost = 2.0 * math.log(max(2, sum(counts.values())))
    for size in range(1, len(model) + 1):
        for chosen in itertools.combinations(sorted(model), size):
            p = [[model[k](b) for k in chosen] for b in counts]
            n, share = list(counts.values()), [1 / size] * size
            for _ in range(3000 if size > 1 else 0):
                new = [0.0] * size
                for row, m in zip(p, n):
                    mixed = sum(map(float.__mul__, row, share))
                    for k in range(size):
                        new[k] += m * row[k] * share[k] / mixed
                new = [x / sum(n) for x in new]
                moved, share = max(abs(a - b) for a, b in zip(new, share)), new
                if moved < 1e-9:
                    break
            value = -2 * sum(m * math.log(sum(map(float.__mul__, row, share))) for row, m in zip(p, n)) + cost * (size - 1)
            best = min(best, (value, dict(zip(chosen, share))), key=lambda x: x[0])
    return best[1]


def test_ngrams_against_brute_force():
    for text in ("the of", "The, OF!", "  x", "x  ", "12 ab 3", "é", "İx ß", "a-b", "", "日本 語"):
        found, n = langid.ngram_counts(text)
        assert dict(zip(found.tolist(), n.tolist())) == dict(brute_counts(text)), text


def test_languages_against_brute_force(make_docs):
    rnd = random.Random(11)
    docs = [(k, some_text([(lang, 30)], rnd), lang) for k, lang in enumerate(sorted(WORDS) * 20)]
    model = langid.train(make_docs([(*d, "s") for d in docs]))
    brute = brute_model([d for d in docs if zlib.crc32(str(d[0]).encode()) % 5])
    assert model.languages == sorted(brute)
    bucket = langid.ngram_counts("the und")[0]
    assert np.allclose(model.prob[bucket], [[brute[k](b) for k in model.languages] for b in bucket.tolist()])
    for parts in ([("xx", 20)], [("yy", 3)], [("xx", 30), ("zz", 30)], [("yy", 50), ("zz", 8)], [("xx", 20), ("yy", 20), ("zz", 20)], [("zz", 60), ("xx", 1)]):
        text = some_text(parts, rnd)
        got, want = model.shares(text), brute_shares(brute, text)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 0.02 for k in want), parts


def test_language_ties_repeats_and_long(make_docs):
    rnd = random.Random(3)
    same = some_text([("xx", 40)], rnd)
    docs = make_docs([(k, same, lang, "s") for k in range(20) for lang in ("b", "a")] + [(1, same, None, "s")] * 2 + [(50, some_text([("xx", 200_000)], rnd), None, "s")])
    rows = langid.identify(docs).collect()
    assert len(rows) == 43 and {(r.lang_pred, r.score) for r in rows} == {("a", 1.0)}  # two languages alike: the one that sorts first


def test_quality_of_repeated_rows_and_ties(spark, make_docs):
    rnd = random.Random(5)
    texts = ["words and more " * rnd.randint(1, 9) if k % 2 else "$$ ## !! " * rnd.randint(1, 9) for k in range(200)]
    docs = make_docs([(k, t, "en", "s") for k, t in enumerate(texts)] * 2 + [(None, texts[1], "en", "s"), (7, texts[0], "en", "s")])
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(8, 1), (8, 0)], "doc_id long, quality int")
    rows = quality_model.quality_scores(docs, labels).collect()
    again = quality_model.quality_scores(docs, labels).collect()
    assert len(rows) == 402 and sorted(map(str, rows)) == sorted(map(str, again))
    by_text = collections.defaultdict(set)
    for r in rows:
        if r.doc_id is not None and r.doc_id != 7:
            by_text[texts[r.doc_id]].add(r.score)
    assert all(len(v) == 1 for v in by_text.values())  # equal texts have equal scores


def test_encoding_of_repeated_rows_and_null_ids(make_docs):
    out = sentencepiece_viterbi.encode(make_docs([(3, "some words", "en", "s")] * 3 + [(None, "some words", None, None), (3, "others", "en", "s")])).collect()
    assert len(out) == 5 and sorted(collections.Counter(tuple(r.token_ids) for r in out).values()) == [1, 4] and all(r.round_trip for r in out)


def test_mixing_of_repeated_ids_and_long_texts(make_docs):
    rows = [(5, "t" * 10, "en", "a")] * 3 + [(k, "u" * 10, "en", "a") for k in range(100, 200)] + [(900, "v" * 1_000_000, "en", "b"), (None, "w", "en", "a"), (None, "w", "en", "a")]
    docs = make_docs(rows)
    out = mixing.mix(docs).select("doc_id", "text", "source", "copy_").collect()
    times = collections.Counter(r.doc_id for r in out)
    assert times[5] % 3 == 0 and times[None] % 2 == 0  # rows that repeat an id draw alike
    assert all(len(r.text) == 1_000_000 for r in out if r.source == "b")
    rate = {r.mix_source: r.rate for r in mixing.rates(docs).collect()}
    assert math.isclose(rate["b"], 1_001_032 / 2 / 1_000_000) and math.isclose(rate["a"], 1_001_032 / 2 / 1032)


def test_classes_without_any_id(make_docs):
    """A class of null ids alone: its rows are there, and one of them stays."""
    docs = make_docs([(None, "one two three four five six", "en", "s")] * 3 + [(4, "quite another text of its own words", "en", "s"), (None, None, None, None)])
    rows = simhash.near_classes(docs).collect()
    assert len(rows) == 5 and sorted(r.component_id for r in rows if r.doc_id is not None) == [4]
    for kept in (simhash.drop_near(docs), simhash.drop_similar(docs), exact_dedup.drop_copies(docs)):
        assert sorted(str(r.text) for r in kept.collect()) == ["None", "one two three four five six", "quite another text of its own words"]


def test_token_counts_of_repeated_rows(make_docs):
    table = token_counts.length_table(make_docs([(1, "one two", "en", "s")] * 4 + [(None, None, None, None)] * 2)).collect()
    assert sum(r.docs for r in table) == 6 and min(r.n_tokens for r in table) == 0
