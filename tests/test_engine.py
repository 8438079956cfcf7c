"""Tables, validation, edits, export, compositing, data sources, streams and scalars on Spark."""

import json
import struct
import zlib

import encoders as e
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.functions import scalars as s, schemas, status
from lumaframe.operators import compositing, geometry, relational as r, structure, updates, validation
from lumaframe.sources import convert, datasource, png, reader, timeline_file
from lumaframe.sources.document import Cel, Document, Layer, Tag
from lumaframe.streaming import ingest

A = e.image([e.RED, e.GREEN], [e.BLUE, e.CLEAR])
SHEET = np.arange(2 * 4 * 4, dtype=np.uint8).reshape(2, 4, 4)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("sources")
    files = {
        "a.gif": e.gif(2, 1, [(0, 0, 0), (255, 0, 0)], [(0, 0, 2, 1, [1, 0], 7, 0, None), (0, 0, 1, 1, [0], 0, 0, None)]), "b.APNG": e.apng(2, 2, [(0, 0, A, 1, 10, 0, 0)]), "c.ora": e.ora([('x="1" y="-1"', A)]),
        "d.pxo": e.pxo(e.pxo_json()), "e.kra": e.kra([('opacity="9"', A)]), "f.psd": e.psd([("l", 0, 0, A, 255, False, b"norm", True, [])]), "g.piskel": e.piskel([e.piskel_layer([[0]], A)]).encode(),
        "h.pixil": e.pixil([(75, [("u", "Ink", 1, A)])]).encode(), "bad.gif": b"GIF87a", "odd.txt": b"x", "dir/i.png": png.encode(A),
    }
    for name, data in files.items():
        (at / name).parent.mkdir(exist_ok=True)
        (at / name).write_bytes(data)
    return at


@pytest.fixture(scope="module")
def model(spark, folder, tmp_path_factory):
    return reader.import_sources(spark, str(folder), str(tmp_path_factory.mktemp("out") / "rows"))


def name(project_id):
    return project_id.rpartition("/")[2]


def test_tables(model):
    projects = {name(p.project_id): (p.source_format, p.width, p.height, p.color_mode) for p in model["projects"].collect()}
    assert projects == {
        "a.gif": ("gif", 2, 1, "rgba"), "b.APNG": ("apng", 2, 2, "rgba"), "c.ora": ("ora", 4, 3, "rgba"), "d.pxo": ("pxo", 2, 2, "rgba"), "e.kra": ("kra", 2, 2, "rgba"),
        "f.psd": ("psd", 4, 3, "rgba"), "g.piskel": ("piskel", 2, 2, "rgba"), "h.pixil": ("pixil", 2, 2, "rgba"), "i.png": ("png", 2, 2, "rgba"),
    }
    assert {name(x.project_id): x.code for x in model["import_errors"].collect()} == {"bad.gif": "unsupported-version", "odd.txt": "unsupported-source"}
    assert sorted((x.frame_index, x.duration_ms) for x in model["frames"].where("project_id like '%d.pxo'").collect()) == [(0, 100), (1, 250)]
    assert model["cels"].where("octet_length(rgba) <> w * h * 4").count() == 0
    for table, ddl in schemas.TABLES.items():
        assert [f"{f.name} {f.dataType.simpleString()}" for f in model[table].schema] == ddl.split(", ")


def test_sizes_are_checked_before_content_is_read(spark):
    rows = [("p", "x.gif", "gif", 1 << 30, b"")]
    files = spark.createDataFrame(rows, "project_id string, name string, kind string, length long, content binary")
    assert reader.tables(reader.decode(files))["import_errors"].head().code == "file-too-large"


def test_violations_of_imported_documents(model):
    got = {(name(v.project_id), v.code, v.path) for v in validation.violations(model).collect()}
    assert got == {("c.ora", "invalid_cel_y", "layers[0].cels[0].y")}
    assert validation.valid_projects(model).count() == 8


def test_every_violation_in_order(spark):
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    tables = {
        "projects": make([("a", "x", 2, 0, "grey"), ("b", "x", 2, 2, "rgba")], schemas.PROJECTS),
        "frames": make([("a", 0, 100), ("a", 2, 0)], schemas.FRAMES),
        "frame_tags": make([("a", 0, "t", 0, 2, "up"), ("a", 1, "t", -1, 0, "forward"), ("a", 2, " ", 0, 0, "reverse")], schemas.FRAME_TAGS),
        "layers": make([("a", 0, "l", "ok", True, 255), ("a", 1, "l", " ", None, 256)], schemas.LAYERS),
        "cels": make([("a", 0, 0, 1, 0, 2, 1, "srgb", bytes(8)), ("a", 0, 0, -1, 0, 1, 1, "srgb", bytes(3)), ("a", 1, 5, 0, 0, 1, 1, "p3", bytes(4))], schemas.CELS),
    }
    rows = validation.violations(tables).orderBy("project_id", "ordinal").collect()
    assert [x.code for x in rows if x.project_id == "a"] == [
        "invalid_height", "invalid_color_mode", "invalid_frame_index", "invalid_frame_duration", "invalid_frame_tag_reference", "invalid_frame_tag_direction", "duplicate_frame_tag_name", "invalid_frame_tag_from",
        "invalid_frame_tag_name", *[x.code for x in rows if x.path.startswith("layers[0].cels")], "duplicate_layer_id", "invalid_layer_name", "invalid_layer_visibility", "invalid_layer_opacity",
        "invalid_cel_frame_reference", "invalid_cel_image_data",
    ]
    assert sorted(x.code for x in rows if x.path.startswith("layers[0].cels")) == ["cel_out_of_bounds", "duplicate_cel_frame", "invalid_cel_image_data", "invalid_cel_x"]
    assert [(x.code, x.path) for x in rows if x.project_id == "b"] == [("invalid_frames", "frames"), ("invalid_layers", "layers")]


def test_edits(model):
    layers, frames = model["layers"], model["frames"]
    project = layers.where("project_id like '%h.pixil'").head().project_id
    assert [x.name for x in updates.rename_layer(layers, project, "pixil-layer-0", "New").where(F.col("project_id") == project).collect()] == ["New"]
    assert [x.duration_ms for x in updates.update_duration(frames, project, 0, 9).where(F.col("project_id") == project).collect()] == [9]
    for bad in (lambda: updates.rename_layer(layers, project, "none", " "), lambda: updates.rename_layer(layers, project, "none", "x"), lambda: updates.update_duration(frames, project, 0, 1.5), lambda: updates.update_duration(frames, project, 7, 5)):
        with pytest.raises(updates.EditError):
            bad()


def test_document_bytes_by_the_layout():
    """Two layers, a tag, and a frame without cels; every field packed here, one by one."""
    ink = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    doc = Document(5, 4, [40, 65535], [Layer("a", "Grün", True, 200, [Cel(0, ink, 1, -2)]), Layer("b", "", False, 255)], [Tag("walk", 0, 1, "reverse")])
    word, half = (lambda v: struct.pack("<I", v)), (lambda v: struct.pack("<h" if v < 0 else "<H", v))
    text = lambda t: half(len(t.encode())) + t.encode()
    chunk = lambda kind, body: word(6 + len(body)) + half(kind) + body
    layer = lambda flags, opacity, name: chunk(0x2004, half(flags) + bytes(10) + bytes([opacity]) + bytes(3) + text(name))
    tag = chunk(0x2018, half(1) + bytes(8) + half(0) + half(1) + bytes([1]) + bytes(2) + bytes(6) + bytes(3) + bytes(1) + text("walk"))
    raw = ink.tobytes()
    stored = bytes([0x78, 0x01, 0x01]) + half(len(raw)) + half(0xFFFF - len(raw)) + raw + struct.pack(">I", zlib.adler32(raw))
    cel = chunk(0x2005, half(0) + half(1) + half(-2) + bytes([255]) + half(2) + half(0) + bytes(5) + half(3) + half(2) + stored)
    frame = lambda ms, chunks: word(16 + sum(map(len, chunks))) + half(0xF1FA) + half(len(chunks)) + half(ms) + bytes(2) + word(0 if not chunks else 0) + b"".join(chunks)
    frames = frame(40, [layer(3, 200, "Grün"), layer(2, 255, ""), tag, cel]) + frame(65535, [])
    head = word(128 + len(frames)) + half(0xA5E0) + half(2) + half(5) + half(4) + half(32) + word(1) + half(0) + bytes(8) + bytes(1) + bytes(3) + half(0) + bytes([1, 1]) + bytes(8) + bytes(84)
    assert len(head) == 128 and timeline_file.write(doc).hex() == (head + frames).hex()


def test_documents_round_trip():
    image = np.random.default_rng(0).integers(0, 256, (150, 150, 4), dtype=np.uint8)
    doc = Document(150, 150, [1, 65535], [Layer("a", "Base", True, 3, [Cel(1, image), Cel(0, image[:1])]), Layer("b", "", False, 0)], [Tag("t", 0, 1, "ping-pong"), Tag("ü", 1, 1, "reverse")])
    back = timeline_file.read(timeline_file.write(doc))
    assert back.durations == doc.durations and back.tags == doc.tags and [(x.name, x.visible, x.opacity) for x in back.layers] == [("Base", True, 3), ("", False, 0)]
    assert {c.frame: c.pixels.tobytes() for c in back.layers[0].cels} == {1: image.tobytes(), 0: image[:1].tobytes()}


def test_export_refusals():
    good = lambda **k: Document(**({"width": 1, "height": 1, "durations": [1], "layers": [Layer("a", "A")]} | k))
    cel = Cel(0, np.zeros((1, 1, 4), np.uint8))
    timeline_file.write(good())
    for bad in (
        {"width": 0}, {"height": 70000}, {"durations": []}, {"durations": [0]}, {"layers": []}, {"layers": [Layer("a", "A", opacity=256)]}, {"layers": [Layer("a", "x" * 70000)]}, {"layers": [Layer("a", "A", cels=[cel, cel])]},
        {"layers": [Layer("a", "A", cels=[Cel(1, cel.pixels)])]}, {"layers": [Layer("a", "A", cels=[Cel(0, cel.pixels, 40000)])]}, {"tags": [Tag("t", 0, 1, "forward")]}, {"tags": [Tag(" ", 0, 0, "forward")]}, {"tags": [Tag("t", 0, 0, "up")]},
    ):
        with pytest.raises(timeline_file.ExportError):
            timeline_file.write(good(**bad))


def test_store():
    for n in (0, 1, 65535, 65536, 140_000):
        assert zlib.decompress(timeline_file.store(bytes(n)) if n else timeline_file.store(b"")[:2] + b"\1\0\0\xff\xff" + timeline_file.store(b"")[2:]) == bytes(n)


def test_export_and_sink(spark, model, tmp_path):
    out = reader.export(model)
    rows = {name(x.project_id): x for x in out.collect()}
    assert len(rows) == 9 and all(x.error is None for x in rows.values())
    doc = timeline_file.read(bytes(rows["c.ora"].content))
    assert (doc.layers[0].cels[0].x, doc.layers[0].cels[0].y) == (1, -1) and np.array_equal(doc.layers[0].cels[0].pixels, A)
    datasource.register(spark)
    out.select("project_id", "content").write.format("timeline").mode("append").save(str(tmp_path / "files"))
    assert sorted(p.name for p in (tmp_path / "files").iterdir()) == sorted(f"{n.partition('.')[0]}.aseprite" for n in rows)


def test_sink_keeps_every_file(spark, tmp_path):
    """Sources of one base name each have a file; a file that is there is kept; rows without content have none."""
    datasource.register(spark)
    rows = [("/x/a.gif", b"1"), ("/x/a.apng", b"2"), ("/y/A.gif", b"3"), ("/y/b.gif", b"4"), ("/y/c.gif", None)]
    df = spark.createDataFrame(rows, "project_id string, content binary").repartition(3)
    write = lambda df, mode: df.write.format("timeline").mode(mode).save(str(tmp_path / "out"))
    write(df, "append")
    made = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    assert sorted(made.values()) == [b"1", b"2", b"3", b"4"] and made["b.aseprite"] == b"4"
    with pytest.raises(Exception, match="there already"):
        write(spark.createDataFrame([("/z/b.gif", b"5")], "project_id string, content binary"), "append")
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == made
    write(spark.createDataFrame([("/z/b.gif", b"5")], "project_id string, content binary"), "overwrite")
    assert (tmp_path / "out/b.aseprite").read_bytes() == b"5"


def test_names_in_order_of_their_numbers():
    assert sorted(["f10.png", "f9.png", "f2.png", "a.png", "f02.png", "1.png"], key=reader.natural) == ["1.png", "a.png", "f02.png", "f2.png", "f9.png", "f10.png"]


def test_source_format(spark, folder, model):
    datasource.register(spark)
    rows = spark.read.format("sprite").option("files", 3).load(str(folder))
    assert {name(x.project_id) for x in reader.tables(rows)["projects"].collect()} == {name(x.project_id) for x in model["projects"].collect()}


def test_sequences_grids_and_atlases(spark, tmp_path):
    for i, image in enumerate((A, A[::-1])):
        (tmp_path / f"f{i}.png").write_bytes(png.encode(image))
    files = reader.sources(spark, str(tmp_path))
    cels = reader.tables(reader.sequences(files, 40))["cels"].orderBy("frame_index").collect()
    assert [bytes(c.rgba) for c in cels] == [A.tobytes(), A[::-1].tobytes()]
    (tmp_path / "sheet").mkdir()
    (tmp_path / "sheet/x.png").write_bytes(png.encode(SHEET))
    (tmp_path / "sheet/x.json").write_text(json.dumps({"frames": [{"frame": {"x": 2, "y": 0, "w": 2, "h": 2}}]}))
    (tmp_path / "sheet/y.json").write_text("{}")
    files = reader.sources(spark, str(tmp_path / "sheet"))
    grid = reader.tables(reader.grids(files, 2, 2, 1, 2))
    assert bytes(grid["cels"].where("frame_index = 1").head().rgba) == SHEET[:, 2:].tobytes()
    atlas = reader.tables(reader.atlases(files))
    assert bytes(atlas["cels"].head().rgba) == SHEET[:, 2:].tobytes() and atlas["import_errors"].head().code == "invalid-png"


def test_stream(spark, folder, model, tmp_path):
    ingest.ingest(spark, str(folder), str(tmp_path / "rows"), str(tmp_path / "state")).awaitTermination()
    got = reader.tables(spark.read.schema(reader.ROWS).parquet(str(tmp_path / "rows")))
    assert got["cels"].count() == model["cels"].count() and got["import_errors"].count() == 2


def test_duration_windows(spark):
    rows = spark.sql("SELECT timestamp '2024-01-01 00:00:01' AS ts, 1L AS user_id, 1.2D AS value UNION ALL SELECT timestamp '2024-01-01 00:04:59', 1L, 2.4D UNION ALL SELECT timestamp '2024-01-01 00:05:00', 1L, 0.0D")
    assert sorted((x.frames, x.total_ms) for x in ingest.duration_windows(rows).collect()) == [(1, 1), (2, 300)]


def test_composite(spark):
    colour = lambda *c: bytes(c)
    base = {"project_id": "p", "width": 2, "height": 1, "top": 0, "h": 1, "blend": False, "background": None}
    rows = [
        base | {"frame_index": 1, "left": 0, "w": 1, "rgba": colour(0, 0, 255, 255), "dispose": "previous"}, base | {"frame_index": 0, "left": 0, "w": 2, "rgba": colour(255, 0, 0, 255) * 2, "dispose": "keep"},
        base | {"frame_index": 2, "left": 1, "w": 1, "rgba": colour(0, 255, 0, 128), "dispose": "background", "blend": True, "background": colour(9, 9, 9, 255)}, base | {"frame_index": 3, "left": 0, "w": 1, "rgba": colour(0, 0, 0, 0), "dispose": "clear"},
    ]
    df = spark.createDataFrame(rows, "project_id string, width int, height int, frame_index int, left int, top int, w int, h int, rgba binary, dispose string, blend boolean, background binary")
    got = [list(bytes(x.rgba)) for x in compositing.composite(df).orderBy("frame_index").collect()]
    red = [255, 0, 0, 255]
    assert got == [red * 2, [0, 0, 255, 255, *red], [*red, 127, 128, 0, 255], [0, 0, 0, 0, 9, 9, 9, 255]]


def test_geometry(spark):
    df = spark.createDataFrame([(SHEET.tobytes(), 4, 2)], "rgba binary, w int, h int")
    lit = F.lit
    row = df.select(
        geometry.crop("rgba", "w", "h", lit(1), lit(0), lit(2), lit(2)).alias("crop"), geometry.unrotate("rgba", "w", "h").alias("turn"), geometry.place("rgba", "w", "h", lit(1), lit(1), lit(6), lit(4)).alias("place"), geometry.swap_red_blue("rgba").alias("swap")
    ).head()
    placed = np.zeros((4, 6, 4), np.uint8)
    placed[1:3, 1:5] = SHEET
    assert [bytes(x) for x in row] == [SHEET[:, 1:3].tobytes(), np.rot90(SHEET).tobytes(), placed.tobytes(), SHEET[..., [2, 1, 0, 3]].tobytes()]


def values(spark, column, rows, ddl):
    return [x[0] for x in spark.createDataFrame(rows, ddl).select(column).collect()]


def test_durations(spark):
    assert values(spark, s.normalize_duration(F.col("v")), [(0.4,), (2.5,), (1e9,), (float("nan"),), (None,), (-3.0,)], "v double") == [1, 3, 65535, None, None, 1]
    assert values(spark, s.gif_delay(F.col("v")), [(0,), (1,), (12,), (60000,)], "v int") == [100, 20, 120, 65535]
    assert values(spark, s.apng_delay(F.col("a"), F.col("b")), [(0, 100), (1, 60), (1, 0), (70000, 1)], "a int, b int") == [1, 17, 10, 65535]
    assert values(spark, s.piskel_duration(F.col("v")), [(12.0,), (20.0,)], "v double") == [83, 50]
    assert values(spark, s.opacity_byte(F.col("v")), [(0.5,), (1.0,), (0.0,)], "v double") == [128, 255, 0]
    assert values(spark, s.psd_opacity(F.col("v")), [(0.5,), (1.0,), (128.0,), (300.0,), (1.5,)], "v double") == [128, 255, 128, None, None]


def test_sizes(spark):
    assert values(spark, s.format_file_size(F.col("v")), [(0,), (1,), (1023,), (1024,), (1280,), (10240,), (1 << 20,), (3 << 30,)], "v long") == ["0 bytes", "1 byte", "1023 bytes", "1.0 KB", "1.3 KB", "10 KB", "1.0 MB", "3.0 GB"]
    assert values(spark, s.format_bytes(F.col("v")), [(1,), (1025,), (1 << 20,), (1572864,)], "v long") == ["1 KiB", "2 KiB", "1 MiB", "1.5 MiB"]
    assert values(spark, s.decoded_bytes(F.col("a"), F.col("b")), [(2, 3), (0, 1), (1 << 40, 1 << 40), (1 << 26, 1 << 26)], "a long, b long") == [24, None, None, None]


def test_divisors(spark):
    assert values(spark, s.nearest_divisor(F.col("n"), F.col("t")), [(12, 5.0), (12, 7.0), (7, 100.0), (0, 1.0), (12, -1.0), (16, 6.0)], "n long, t double") == [6, 6, 7, None, None, 8]


def test_names_and_paths(spark):
    assert values(spark, s.valid_name(F.col("v")), [("a",), (" \t ﻿　",), ("",), (None,)], "v string") == [True, False, False, False]
    assert values(spark, s.unsafe_path(F.col("v")), [("a/b",), ("a/",), ("../a",), ("a\\b",), ("x:y",), ("",), ("a/../b",), ("/a",)], "v string") == [False, False, True, True, True, True, True, True]
    assert values(spark, s.strict_base64(F.col("v")), [("QQ==",), ("QR==",), ("QUI=",), ("QUJ=",), ("QUJD",), ("QUJ",), ("",)], "v string") == [True, False, True, False, True, False, True]
    assert values(spark, s.utf16_length(F.col("v")), [("a😀",), ("",)], "v string") == [3, 0]
    assert values(spark, s.slug(F.col("v")), [("Hello, World!",)], "v string") == ["hello-world"]
    assert values(spark, s.signed_integer(F.col("v")), [("-5",), ("05",), (None,), ("40000",), ("-0",)], "v string") == [-5, None, 0, None, None]


def test_atlas_labels(spark):
    rows = [("aseprite", "array"), ("texturepacker", "hash"), ("phaser-pixi", "multiatlas"), ("phaser-pixi", "array"), ("unknown", "unknown")]
    assert values(spark, s.atlas_label(F.col("f"), F.col("v")), rows, "f string, v string") == ["Aseprite JSON", "TexturePacker Hash", "Phaser Multi-Atlas", "Phaser/Pixi-compatible atlas", "Atlas JSON"]


def test_ranges(spark):
    frames = spark.range(0, 500).withColumnRenamed("id", "frame_index")
    ranges = spark.createDataFrame([("a", 3, 3), ("b", 60, 200), ("c", 499, 900)], "tag string, low long, high long")
    got = r.in_ranges(frames, ranges, "frame_index", "low", "high", 64).groupBy("tag").count().collect()
    assert {x.tag: x["count"] for x in got} == {"a": 1, "b": 141, "c": 1}


def test_struct_sizes():
    assert timeline_file.HEADER.size == 128 and timeline_file.FRAME.size == 16 and struct.calcsize("<HHHHHHB3xH") == 18


def test_modes(spark, folder):
    files = reader.sources(spark, str(folder))
    for mode, want in (("gif", {"a.gif": None, "bad.gif": "unsupported-version"}), ("krita", {"e.kra": None}), ("apng", {"b.APNG": None, "i.png": "not-animated"})):
        tables = reader.tables(convert.convert(files, mode))
        got = {name(x.project_id): None for x in tables["projects"].collect()} | {name(x.project_id): x.code for x in tables["import_errors"].collect()}
        assert {k: v for k, v in got.items() if v != "invalid-selection"} == want and len(got) == files.count()  # files of other kinds are errors, not left out
    rows = [("a", "png"), ("a", "png"), ("b", "png"), ("b", "json"), ("c", None), ("d", "gif")]
    df = spark.createDataFrame(rows, "project_id string, kind string")
    ok = lambda mode: {x.project_id for x in convert.selections(df, mode).where("error is null").collect()}
    assert ok("png-sequence") == {"a"} and ok("spritesheet-json") == {"b"} and ok("gif") == {"d"} and ok("psd") == set()


def test_summary(model):
    got = {name(x.project_id): tuple(x[1:]) for x in convert.summary(model).collect()}
    assert got["d.pxo"] == (2, 2, 4, 350) and got["c.ora"] == (1, 1, 1, 100)


def test_structure_of_json(spark):
    """Null, empty, broken and repeated texts, other columns, and order within a document."""
    texts = [
        None, "", "no", "7", "null", "[]", '{"frames": [{}], "layers": [{"cels": []}]}', '{"frames": [{}], "layers": [{"cels": []}]}', '{"frames": [1, {}, null], "frameTags": null, "layers": ["x", {"cels": [3, {}, null]}, {}, []]}',
        '{"frames": {}, "frameTags": ["t", {}], "layers": []}', '{"a": 1, "a": 2}',
    ]
    rows = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "id int, json string, code string")
    out = structure.structure_violations(rows, "id").orderBy("project_id", "ordinal").collect()
    found = {k: [(r.code, r.path) for r in out if r.project_id == k] for k in range(len(texts))}
    none = [("invalid_project", "project")]
    assert all(found[k] == none for k in (0, 1, 2, 3, 4, 10)) and found[6] == found[7] == []
    assert found[5] == [("invalid_frames", "frames"), ("invalid_layers", "layers")]
    assert found[8] == [
        ("invalid_frame", "frames[0]"), ("invalid_frame", "frames[2]"), ("invalid_frame_tags", "frameTags"), ("invalid_layer", "layers[0]"), ("invalid_cel", "layers[1].cels[0]"),
        ("invalid_cel", "layers[1].cels[2]"), ("invalid_cels", "layers[2].cels"), ("invalid_cels", "layers[3].cels"),
    ]
    assert found[9] == [("invalid_frames", "frames"), ("invalid_frame_tag", "frameTags[0]"), ("invalid_layers", "layers")]
    assert all(r.message == structure.MESSAGES[r.code] for r in out)
    assert structure.structure_violations(rows.limit(0), "id").count() == 0


def test_status_texts(spark):
    rows = spark.createDataFrame([("krita", 1, 2, "bad-tile", " a\n tile ", ["json", "kra"]), ("png-sequence", 3, 0, None, "trace", ["png", "png2"]), ("spritesheet-grid", 1, 1, "c", " ", ["png"]), (None, 0, 0, "c", None, [])], "m string, f int, l int, c string, t string, k array<string>")
    m, f, n = F.col("m"), F.col("f"), F.col("l")
    got = rows.select(status.selection_status(m, f), status.success_status(m, f, n), status.failure_status(m, F.col("c"), F.col("t")), status.mode_of(F.col("k"))).collect()
    assert tuple(got[0]) == ("Selected 1 Krita project.", "Converted a Krita project of 1 frame and 2 layers.", "Could not convert the Krita project: a tile", "krita")
    assert tuple(got[1])[:2] == ("Selected 3 files.", "Converted a PNG sequence of 3 frames.") and "trace" not in got[1][2] and got[1][3] == "png-sequence"
    assert got[2][0] == "Selected 1 file." and got[2][2].endswith("check that the frames of the grid lie within the image.") and got[2][3] is None
    assert tuple(got[3]) == ("Selected 0 files.", "Converted a PNG image of 0 frames.", "Could not convert the PNG image: check that it is a PNG image.", None)
