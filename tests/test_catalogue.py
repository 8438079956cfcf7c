"""Every query of the entry point with SQL, held against that SQL on a small folder of tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from lumaframe.plans import catalogue, source_queries


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, draw, n = tmp_path_factory.mktemp("tables"), np.random.default_rng(7), 300
    pick = lambda values, size=n: draw.choice(values, size)
    ids = np.arange(n)
    words = np.array(["ink", "Base", "é", "#tag", "of", "and"])
    text = [" ".join(draw.choice(words, draw.integers(0, 30))) for _ in ids]
    tables = {
        "region": {"r_regionkey": np.arange(5, dtype="int32"), "r_name": list("abcde")},
        "nation": {"n_nationkey": np.arange(25, dtype="int32"), "n_name": [f"N{i}" for i in range(25)], "n_regionkey": (np.arange(25) % 5).astype("int32")},
        "supplier": {"s_suppkey": ids, "s_name": [f"S{i}" for i in ids]},
        "part": {"p_partkey": ids, "p_name": text, "p_size": (ids % 50).astype("int32")},
        "orders": {"o_orderkey": ids, "o_custkey": ids % 40, "o_orderstatus": pick(["F", "O"]), "o_totalprice": draw.random(n), "o_orderpriority": pick(["1", "2"])},
        "lineitem": {"l_orderkey": pick(ids), "l_partkey": pick(ids), "l_suppkey": pick(ids), "l_linenumber": (ids % 7).astype("int32"), "l_quantity": ids % 50 * 1.0, "l_discount": ids % 11 / 100, "l_returnflag": pick(["R", "A"])},
        "events": {"event_id": ids, "user_id": ids % 20, "event_type": pick(["click", "view", "error"]), "value": draw.random(n) * 100, "props": [f'{{"k": {i % 90}}}' for i in ids], "ts": pd.date_range("2024-01-01", periods=n, freq="min")},
        "documents": {"doc_id": ids, "text": text, "lang": pick(["en", "de"]), "source": pick(["src0", "src1"]), "n_chars": [len(t) for t in text]},
        "embeddings": {"vec_id": ids, "embedding": list(draw.random((n, 16), dtype="float32")), "label": (ids % 3).astype("int32")},
        "pages": {"page_id": ids, "url": [f"http://h/{i}" for i in ids], "html": pick(["<p>" + "x" * 200, "<p/>", ""])},
        "labels": {"doc_id": ids[::2], "quality": (ids[::2] % 4 > 0).astype("int32"), "toxic": (ids[::2] % 5 == 0).astype("int32")},
        "conversations": {"conv_id": ids // 6, "turn": ids % 6, "role": pick(["user", "assistant", "system"]), "text": [t or "x" for t in text]},
        "benchmark": {"item_id": ids, "text": text}, "customer": {"c_custkey": ids},
    }
    for name, columns in tables.items():
        pd.DataFrame(columns).to_parquet(at / f"{name}.parquet", coerce_timestamps="us")
    return at


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)
    return sorted(str([clean(v) for v in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, folder, name):
    got = catalogue.QUERIES[name](spark, str(folder)).toPandas()
    if name not in catalogue.ORACLE_SQL:
        assert len(got)
        return
    db = duckdb.connect()
    for table in folder.glob("*.parquet"):
        db.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    want = db.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_table_values(spark, tmp_path):
    """Addresses and texts of the tables, long and null ones too, reach the operators."""
    urls = [None, "", "http://h/a/b.PNG", "http://h/a/../b.gif", "http://h//x", "dir/c.json", "http://h/" + "x" * 70_000, "http://h/a\\b", "/abs.psd"]
    texts = [None, "", "QQ==", "QR==", "QQ==\n", "word é " * 40_000, "A" * 400_000, "A" * 400_001]
    pd.DataFrame({"page_id": range(len(urls)), "url": urls}).to_parquet(tmp_path / "pages.parquet")
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    for name, of in (("page_urls", "pages"), ("document_base64", "documents")):
        db = duckdb.connect()
        db.execute(f"CREATE VIEW {of} AS SELECT * FROM '{tmp_path}/{of}.parquet'")
        got = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()
        assert rows(got) == rows(db.sql(catalogue.ORACLE_SQL[name]).df())


def test_entry_point():
    assert source_queries.gif_files.__name__ in catalogue.QUERIES
    names = entry.queries()
    assert set(catalogue.QUERIES) <= set(names) and set(entry.oracle_sql()) <= set(names)
