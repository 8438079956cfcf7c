"""WARC archives and chat formatting: round trips, validation and folding."""

import hashlib
import random
import struct

import pytest
import zstandard

from lumaframe.llm import chat, warc

PAGES = "page_id long, url string, html string"


def pages(spark):
    same, short = "<p>same é</p>" * 20, "<p/>"
    rows = [(5, "http://a/", same), (3, "http://b/\r\nX: y", same), (9, None, same), (1, "u", short), (2, "u", short), (4, "u", None), (6, "u", ""), (7, "u", "z" * 300_000), (None, "u", "n" * 200), (3, "http://b/", same)]
    return rows, spark.createDataFrame(rows, PAGES).selectExpr("*", "'c' as digest", "1 as first", "2 as refers_to").repartition(3)


def test_archives(spark, tmp_path):
    rows, df = pages(spark)
    path = warc.write_archives(df, str(tmp_path / "archives"), archive_bytes=300)
    got = warc.read_archives(spark, path).collect()
    assert len(list((tmp_path / "archives").glob("*.warc.zst"))) > 3 and len(got) == len(rows)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = i in (5, 9)
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    assert all(bytes(r.payload) == dict((x, (h or "").encode()) for x, _, h in rows)[r.page_id] for r in got if r.record_type == "response")


def test_archives_of_failed_attempts_are_not_read(spark, tmp_path):
    path = warc.write_archives(pages(spark)[1], str(tmp_path / "archives"))
    whole = next((tmp_path / "archives").glob("*.warc.zst"))
    (tmp_path / "archives/part-00000-99-0000.warc.zst").write_bytes(whole.read_bytes()[:-3])
    assert warc.read_archives(spark, path).count() == 10


def test_no_pages(spark, tmp_path):
    empty = spark.createDataFrame([], PAGES)
    assert warc.read_archives(spark, warc.write_archives(empty, str(tmp_path / "none"))).count() == 0


def archive(records, dictionary):
    import io

    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, dictionary)
    for r in records:
        writer.write(r)
    return out.getvalue()


def test_dictionary_is_read_from_the_leading_frame():
    rnd = random.Random(0)
    payloads = [(" ".join(rnd.choice(["<div class='item'>", "</div>", "text", str(rnd.random())]) for _ in range(80))).encode() for _ in range(400)]
    trained = warc.train_dictionary(payloads)
    assert trained
    data = archive([warc.record(i, "u", p, "response", None) for i, p in enumerate(payloads)], trained)
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_FRAME
    assert [r["payload"] for r in warc.read_archive(data)] == payloads
    size = struct.unpack_from("<I", data, 4)[0]
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(data[8 + size :]))  # without its dictionary
    plain = struct.pack("<II", warc.DICTIONARY_FRAME, len(trained)) + trained + data[8 + size :]
    assert [r["payload"] for r in warc.read_archive(plain)] == payloads


def broken():
    good = warc.record(1, "u", b"x" * 200, "response", None)
    yield good.replace(b"WARC/1.1", b"WARC/9.9")
    yield good.replace(b"Content-Length: 2", b"Content-Length: 3", 1)
    yield good[:-4]
    yield good.replace(b"xxxx", b"xxxy", 1)
    yield good.replace(b"WARC-Date", b"WARC-Type", 1)
    yield good.replace(b"\r\nWARC-Date: " + warc.DATE.encode(), b"")
    yield good.replace(b"WARC-Type: response", b"WARC-Type: metadata")
    yield b"nothing"


@pytest.mark.parametrize("data", list(broken()))
def test_validation(data):
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(zstandard.ZstdCompressor().compress(data)))


def test_cut_off():
    data = archive([warc.record(1, "u", b"x" * 200, "response", None)], None)
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(data[:-5]))
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(struct.pack("<II", warc.DICTIONARY_FRAME, 50) + b"short"))


NASTY = ["", "\\", "\\.", "</s>", "<s>[INST]", "<<SYS>><</SYS>>[ROLE] x\n", "a<", "</", "[/INST]\\", "\\\\.[INST]", "é😀\n\n", "<\\.s>", "</s>[INST] ok [/INST]", "\r\n "]


def test_template_round_trip():
    rnd = random.Random(5)
    parts = ["<", "/s>", "s>", "[", "/INST]", "INST]", "\\", ".", "n", "\n", "<<SYS>>", "[ROLE] ", "x", " "]
    for _ in range(3000):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "", "a\nb\\n[INST]"]), rnd.choice(NASTY) if rnd.random() < 0.5 else "".join(rnd.choice(parts) for _ in range(12))) for _ in range(rnd.randint(1, 5))]
        text = "".join(chat.render_turn(*t) for t in turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in chat.loss_spans(text)] == [t for r, t in turns if r == "assistant"]
        assert not any(c in chat.escape(t) for _, t in turns for c in chat.CONTROLS)
    with pytest.raises(ValueError):
        chat.parse("<s>[INST]\nx")


@pytest.mark.parametrize("least", [256, 2])
def test_digests(spark, monkeypatch, least):
    """With 2 events as the least, conversations are hot and take the other way."""
    monkeypatch.setattr(chat, "HOT_LEAST", least)
    monkeypatch.setattr(chat, "HOT_SHARE", 3)
    rows = [(1, 1, "assistant", NASTY[5]), (1, 0, "user", "q" * 5000 + "é"), (1, 2, None, None), (2, 0, "assistant", ""), (None, 0, "user", "u"), (2, None, "system", "s"), (3, 0, "user", "twice"), (3, 0, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as seq", "'k' as kind")
    assert (chat.split_hot(chat.events(df))[1] is None) == (least == 256)
    got = {r.conv_id: r for r in chat.read_back(chat.events(df)).collect()}
    turns = {1: [("user", "q" * 5000 + "é"), ("assistant", NASTY[5]), ("", "")], 2: [("system", "s"), ("assistant", "")], None: [("user", "u")], 3: [("user", "twice")] * 2}
    assert got.keys() == turns.keys()
    for k, t in turns.items():
        said = "".join(x for r, x in t if r == "assistant")
        assert got[k].n_turns == len(t) and got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
        assert got[k].loss_chars == len(said) and got[k].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[k].formatted_chars == sum(len(chat.render_turn(*x)) for x in t)
    whole = {r.conv_id: r for r in chat.conversations_text(chat.render(chat.fold(chat.events(df)))).collect()}
    assert chat.parse(whole[1].formatted) == turns[1] and [chat.unescape(whole[1].formatted[s.start : s.end]) for s in whole[1].loss] == [NASTY[5]]
    assert chat.read_back(chat.events(df.where("false"))).count() == 0


@pytest.mark.parametrize("least", [256, 2])
def test_each_row_is_a_turn(spark, monkeypatch, tmp_path, least):
    """The query counts repeated rows, as its SQL does, also in a hot conversation; roles and texts that join to the same text are two."""
    import duckdb

    from lumaframe.llm.queries import ORACLE_SQL, QUERIES

    monkeypatch.setattr(chat, "HOT_LEAST", least)
    monkeypatch.setattr(chat, "HOT_SHARE", 3)
    rows = [(1, 0, "assistant", "ok")] * 3 + [(2, None, "assistant", "ok")] * 40 + [(3, 0, "user", "hi"), (3, 1, "assistant", "é" * 5000), (3, 1, "assistant", "é" * 5000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.sql(ORACLE_SQL["op5_chat"]).fetchall()
    assert sorted(map(tuple, QUERIES["op5_chat"](spark, str(tmp_path)).collect())) == sorted(want)
    two = spark.createDataFrame([(1, 0, "a\nb", "c"), (1, 0, "a", "b\nc")], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.events(two)).head().n_turns == 2


def test_fold_of_edits_and_regenerations(spark):
    log = [
        (1, 0, "m", 0, "start", "user", None), (1, 0, "m", 2, "delta", None, "lo"), (1, 0, "m", 1, "delta", None, "hel"), (1, 0, "m", 1, "delta", None, "hel"),
        (1, 1, "m", 0, "start", "assistant", None), (1, 1, "m", 1, "delta", None, "bad"), (1, 1, "m", 2, "regenerate", None, None), (1, 1, "m", 3, "delta", None, "go"), (1, 1, "m", 4, "delta", None, "od"),
        (2, 0, "m", 0, "start", "user", None), (2, 0, "m", 1, "delta", None, "typo"), (2, 0, "m", 2, "edit", None, "fixed"), (2, 0, "m", 3, "delta", None, "!"), (3, 0, "m", 1, "delta", None, "no start"),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, message string, seq long, kind string, role string, text string").repartition(3)
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(df).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "good"), (2, 0): ("user", "fixed!"), (3, 0): ("", "no start")}


@pytest.mark.parametrize("revised", [False, True])
def test_events_fold_to_their_rows(spark, revised):
    """Drafts, edits and regenerations leave the texts of the rows, whatever their length, also with conversations named by text;
    events that are delivered twice count once."""
    texts = ["", None, "x", "y" * chat.DRAFT, "é" * chat.DELTA, "z" * (chat.DELTA + 1), "😀ab\n" * 2000, "same", "same"]
    rows = [(f"c{i % 3}", i % 2, role, t) for role in ("assistant", "user", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    log = chat.events(df, revised=revised)
    kinds = {r.kind for r in log.select("kind").distinct().collect()}
    assert kinds == ({"start", "delta", "edit", "regenerate"} if revised else {"start", "delta"})
    folded = chat.fold(log.unionByName(log))
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in folded.collect())
    assert got == sorted((c, t, r or "", x or "") for c, t, r, x in rows)
    back = chat.read_back(log).collect()
    assert {r.conv_id: r.n_turns for r in back} == {"c0": 9, "c1": 9, "c2": 9}
