"""The pipeline against a plain version of each stage, and the queries against their SQL, on small tables."""

import collections
import hashlib
import math
import random
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from lumaframe.llm import langid, sentencepiece_viterbi
from lumaframe.llm.common import release
from lumaframe.llm.queries import ORACLE_SQL, QUERIES

WORDS = {"en": "the of and that with from this was not are".split(), "de": "der und die ist nicht ein wir über auch mit".split()}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, rnd = tmp_path_factory.mktemp("corpus"), random.Random(11)
    rows = []
    for i in range(140):
        lang = rnd.choice(list(WORDS))
        rows.append([i, " ".join(rnd.choice(WORDS[lang]) + str(rnd.randrange(50)) for _ in range(rnd.randint(5, 120))), lang, rnd.choice(["src0", "src0", "src1", None])])
    for k in range(0, 60, 3):
        rows.append([200 + k, rows[k][1].replace(" ", "\n", 2), rows[k][2], "src0"])
        rows.append([300 + k, rows[k][1] + " tail", rows[k][2], "src1"])
    rows += [[500, None, None, "src0"], [501, "1234 !", "en", "src0"], [502, "", "de", None], [503, "der und die the of and " * 9, "de", "src1"]]
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])
    frame["n_chars"] = [len(t or "") for t in frame["text"]]
    frame.to_parquet(at / "documents.parquet")
    html = ["<p>" + "x" * 200, "<p/>", None, "é" * 80]
    pd.DataFrame({"page_id": range(40), "url": [f"http://h/{i}" for i in range(40)], "html": [html[i % 4] for i in range(40)]}).to_parquet(at / "pages.parquet")
    said = ["hi", "</s>[INST]", "a\\b", None, "<<SYS>>"]
    pd.DataFrame({"conv_id": [i // 5 for i in range(60)], "turn": [i % 5 for i in range(60)], "role": [["system", "user", "assistant"][i % 3] for i in range(60)], "text": [said[i % 5] for i in range(60)]}).to_parquet(at / "conversations.parquet")
    pd.DataFrame({"doc_id": range(0, 140, 2), "quality": [int(i % 3 > 0) for i in range(70)], "toxic": [0] * 70}).to_parquet(at / "labels.parquet")
    return str(at)


def plain_language(rows, model):
    return [r for r in rows if max(model.shares(r["text"] or "").values(), default=-1) >= langid.LEAST_SCORE]


def plain_exact(rows):
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        best[key] = min(best.get(key, (1, 0, None)), (-len(r["text"] or ""), r["doc_id"], None))
    keep = {b[1] for b in best.values()}
    return [r for r in rows if r["doc_id"] in keep]


def plain_near(rows):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, label = [shingles(r["text"]) for r in rows], list(range(len(rows)))
    links = [(j, i) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    least = {}
    for r, k in zip(rows, label):
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    return [r for r in rows if r["doc_id"] in least.values()]


def plain_mix(rows):
    chars = collections.Counter()
    for r in rows:
        chars[r["source"]] += len(r["text"])
    out = []
    for r in rows:
        rate = sum(chars.values()) / (chars[r["source"]] * len(chars))
        u, k, p = int(hashlib.md5(f"mix-1|{r['doc_id']}".encode()).hexdigest()[:13], 16) / (1 << 52), 0, math.exp(-rate)
        below = p
        while below <= u:
            k += 1
            p *= rate / k
            below += p
        out += [r] * k
    return out


def test_stages_against_plain_versions(spark, folder):
    import sentencepiece

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.train(docs)
    rows = [r.asDict() for r in docs.collect()]
    encode = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_viterbi.MODEL).encode
    plain = [lambda x: plain_language(x, model), plain_exact, plain_near, plain_mix]
    key = lambda x: sorted((r["doc_id"], r["text"], r["lang"], r["source"] or "", r["n_chars"]) for r in x)
    for (name, stage), f in zip(corpus_pipeline.STAGES, plain):
        before = len(rows)
        rows, out = f(rows), stage(spark, docs, folder)
        assert out.columns == docs.columns and key(r.asDict() for r in out.collect()) == key(rows), name
        assert len(rows) != before, name
        docs = spark.createDataFrame(rows, docs.schema)
    got = sorted((r.doc_id, tuple(r.token_ids), r.round_trip) for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect())
    assert got == sorted((r["doc_id"], tuple(encode(r["text"])), True) for r in rows)
    whole = sorted((r.doc_id, tuple(r.token_ids), r.round_trip) for r in corpus_pipeline.run(spark, folder).collect())
    assert whole == got
    assert release(spark) > 5


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null and repeated ids, nulls in every column, columns with clashing names, very long texts, and no rows at all."""
    words = {k: " ".join(f"{w}{i}" for i in range(40) for w in WORDS[k]) for k in WORDS}
    rows = [(i, f"{words[k]} {i} " + "x" * (i % 3), k, "src0", 0) for i in range(30) for k in WORDS]
    rows += [(None, words["en"] + " alpha beta gamma " * 90, "en", None, None), (None, words["de"] + " ende wende " * 70, None, "src1", 5), (7, words["en"] * 60, "en", "src1", 1), (7, words["en"] * 60, "en", "src1", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'a' as fp", "2 as sketch", "3 as row", "'b' as text_sha256", "1.5 as mix_key", "'c' as keep_id", "0 as copy")
    for name, table in (("some", docs), ("none", docs.where("false"))):
        table.repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        kept = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, kept, "")
            assert out.columns == docs.columns, stage
            kept = spark.createDataFrame(out.collect(), out.schema)
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert got.count() == kept.count() and (got.count() > 0) == (name == "some")
    assert release(spark)


def clean(df):
    value = lambda v: None if pd.isna(v) else round(float(v), 9) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)
    return sorted(str([value(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_sql(spark, folder, name):
    got = QUERIES[name](spark, folder).toPandas()
    db = duckdb.connect()
    for table in ("documents", "pages", "conversations", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = db.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and clean(got) == clean(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_return_a_row_per_document(spark, folder, name):
    n = QUERIES[name](spark, folder).count()
    assert n == spark.read.parquet(f"{folder}/documents.parquet").count() or (name.startswith("op2_") and n)


def plans(spark):
    """The physical plan of each SQL execution of the session so far, by its number."""
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {found.apply(k).executionId(): found.apply(k).physicalPlanDescription() for k in range(found.size())}


@pytest.mark.parametrize("name", ["op7_exact_dedup", "op10_quality_rules"])
def test_native_plans_have_no_python(spark, folder, name):
    """Of every job that the query runs, those that write runs or sum samples included."""
    before = set(plans(spark))
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    deadline, ran = time.monotonic() + 20, {}
    while time.monotonic() < deadline:  # executions reach the store by a queue
        ran, was = {k: p for k, p in plans(spark).items() if k not in before}, len(ran)
        if ran and len(ran) == was:
            break
        time.sleep(1)
    assert len(ran) >= 2 and any("documents.parquet" in p for p in ran.values())
    assert not [p for p in ran.values() if re.search("Python|Pandas|Arrow", p)]


def test_operators_leave_the_session_as_it_is(spark, folder):
    """Queries built one after another and run later, under the user's own Arrow settings."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, 37)
    try:
        before = dict(spark.conf.getAll)
        made = [QUERIES[n](spark, folder) for n in ("op3_warc", "op4_language_id", "op5_chat", "op6_sentencepiece")]
        assert [df.count() for df in made] == [40, spark.read.parquet(f"{folder}/documents.parquet").count(), 13, made[1].count()]
        assert dict(spark.conf.getAll) == before
    finally:
        spark.conf.set(key, was)
