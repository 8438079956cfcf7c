"""Every importer: what it decodes, and what it refuses."""

import json
import struct
import zlib

import encoders as e
import numpy as np
import pytest

from lumaframe.sources import animated, archive, layered, png, sheets
from lumaframe.sources.document import SourceError

A = e.image([e.RED, e.GREEN], [e.BLUE, e.CLEAR])
B = e.image([e.GREEN, e.GREEN], [e.CLEAR, e.RED])
ONE = e.image([e.RED])


def refused(f, code):
    with pytest.raises(SourceError) as error:
        f()
    assert error.value.code == code


# PNG


def encode_png(values, kind, depth, interlaced=0, filters=(0,), extra=b""):
    """A PNG image of sample values (height, width, samples), each row by one of the filters in turn."""
    height, width, samples = values.shape
    parts = []
    for x0, y0, dx, dy in png.PASSES if interlaced else ((0, 0, 1, 1),):
        part = values[y0::dy, x0::dx]
        if not part.size:
            continue
        step = max(1, samples * depth // 8)
        above = None
        for k, row in enumerate(part):
            flat = row.reshape(-1)
            if depth == 16:
                line = flat.astype(">u2").tobytes()
            elif depth == 8:
                line = flat.astype(np.uint8).tobytes()
            else:
                line = np.packbits(((flat[:, None] >> np.arange(depth - 1, -1, -1)) & 1).reshape(-1).astype(np.uint8)).tobytes()
            above = above if above is not None else bytes(len(line))
            f = filters[k % len(filters)]
            out = bytearray()
            for i, v in enumerate(line):
                left, up, corner = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
                near = min((left, up, corner), key=lambda c: (abs(left + up - corner - c), (left, up, corner).index(c)))
                out.append((v - (0, left, up, (left + up) // 2, near)[f]) & 255)
            parts.append(bytes([f]) + bytes(out))
            above = line
    head = struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, interlaced)
    return png.SIGNATURE + png.chunk(b"IHDR", head) + extra + png.chunk(b"IDAT", zlib.compress(b"".join(parts))) + png.chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [0, 1])
@pytest.mark.parametrize("kind,depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (6, 8), (6, 16)])
def test_png_kinds(kind, depth, interlaced):
    draw = np.random.default_rng(kind * 20 + depth)
    n, height, width = png.SAMPLES[kind], 9, 11
    values = draw.integers(0, 1 << min(depth, 8 if kind != 3 else depth), (height, width, n)) * (257 if depth == 16 else 1)
    palette = draw.integers(0, 256, (256, 3), dtype=np.uint8)
    extra = png.chunk(b"PLTE", palette.tobytes()) + png.chunk(b"tRNS", bytes([7, 9])) if kind == 3 else b""
    got = png.decode(encode_png(values, kind, depth, interlaced, (0, 1, 2, 3, 4), extra))
    scaled = values >> 8 if depth == 16 else values * 255 // ((1 << depth) - 1) if kind != 3 else values
    want = np.full((height, width, 4), 255, np.uint8)
    if kind == 3:
        want[..., :3] = palette[values[..., 0]]
        want[..., 3] = np.where(values[..., 0] == 0, 7, np.where(values[..., 0] == 1, 9, 255))
    else:
        want[..., :3] = scaled[..., : 1 if kind in (0, 4) else 3]
        want[..., 3] = scaled[..., -1] if kind in (4, 6) else 255
    assert np.array_equal(got, want)


def test_png_round_trip_and_damage():
    data = png.encode(A)
    assert np.array_equal(png.decode(data), A)
    for bad in (data[:20], data[:-1], data.replace(b"IDAT", b"IDAX"), b"no", data[:40] + bytes([data[40] ^ 1]) + data[41:]):
        with pytest.raises((ValueError, struct.error)):
            png.decode(bad)


# animations

PALETTE = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)]


def test_gif_timing_transparency_offsets():
    doc = animated.import_gif(e.gif(3, 2, PALETTE, [(0, 0, 3, 2, [1] * 6, 10, 0, None), (1, 0, 2, 1, [0, 2], 1, 1, 0), (2, 1, 1, 1, [3], 0, 0, None), (0, 0, 1, 1, [2], 60000, 0, None)]))
    assert doc.durations == [100, 20, 100, 65535] and (doc.width, doc.height, doc.layers[0].id, doc.layers[0].name) == (3, 2, "gif-layer-0", "GIF frames")
    second, third = doc.layers[0].cels[1].pixels, doc.layers[0].cels[2].pixels
    assert second[0, 1].tolist() == [255, 0, 0, 255] and second[0, 2].tolist() == [0, 255, 0, 255] and third[1, 2].tolist() == [0, 0, 255, 255]


def test_gif_disposals():
    frames = [(0, 0, 2, 1, [1, 1], 5, 0, None), (0, 0, 1, 1, [2], 5, 2, None), (1, 0, 1, 1, [2], 5, 2, 0), (0, 0, 1, 1, [3], 5, 3, None), (1, 0, 1, 1, [3], 5, 0, None)]
    cels = [c.pixels[0].tolist() for c in animated.import_gif(e.gif(2, 1, PALETTE, frames, back=3)).layers[0].cels]
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert cels == [[red, red], [green, red], [blue, green], [blue, none], [blue, blue]]


@pytest.mark.parametrize("change,code", [
    (lambda d: d.replace(b"GIF89a", b"GIF87a"), "unsupported-version"), (lambda d: d[:-1], "missing-trailer"), (lambda d: d[:-8], "truncated-data"), (lambda d: d + b"x", "trailing-data"),
    (lambda d: d + b"\0\0", None), (lambda d: d[:12] + b"\x01" + d[13:], "unsupported-pixel-aspect-ratio"), (lambda d: d[:6] + b"\0\0" + d[8:], "allocation-limit"),
    (lambda d: d.replace(b"\x21\xf9\x04\x00", b"\x21\xf9\x04\x02"), "unsupported-user-input"), (lambda d: d.replace(b"\x21\xf9\x04\x00", b"\x21\xf9\x04\x10"), "unsupported-disposal"),
    (lambda d: d.replace(b"\x21\xf9", b"\x21\x01"), "unsupported-extension"), (lambda d: d[:-1] + b"\x21\xf9\x04\x00\x00\x00\x00\x00\x3b", "ambiguous-stream"), (lambda d: d[:-1] + b"\x99", "invalid-block"),
    (lambda d: d[:-1] + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00" * 2 + b"\x3b", "ambiguous-stream"),
])
def test_gif_refusals(change, code):
    data = change(e.gif(2, 1, PALETTE, [(0, 0, 2, 1, [1, 2], 5, 0, None)]))
    if code:
        refused(lambda: animated.import_gif(data), code)
    else:
        assert animated.import_gif(data).durations == [50]


def test_gif_frames_and_palettes_refused():
    refused(lambda: animated.import_gif(e.gif(2, 1, PALETTE, [(0, 0, 2, 1, [1, 2], 5, 0, None), (1, 0, 2, 1, [1, 1], 5, 0, None)])), "invalid-frame")
    refused(lambda: animated.import_gif(e.gif(2, 1, PALETTE, [(0, 0, 1, 1, [1], 5, 0, None)])), "invalid-frame")
    refused(lambda: animated.import_gif(e.gif(2, 1, PALETTE[:2], [(0, 0, 2, 1, [1, 3], 5, 0, None)])), "invalid-palette-index")
    refused(lambda: animated.import_gif(e.gif(2, 1, PALETTE[:2], [(0, 0, 2, 1, [1, 1], 5, 0, 3)])), "invalid-palette-index")
    refused(lambda: animated.import_gif(e.gif(2, 1, PALETTE, [], end=b"\x3b")), "invalid-frame")


def test_lzw():
    draw = np.random.default_rng(1)
    for size, n in ((8, 60_000), (2, 5000), (8, 1), (5, 4099)):
        data = draw.integers(0, min(1 << size, 7), n, dtype=np.uint8).tobytes()
        assert animated.lzw_decode(animated.lzw_encode(data, size), size, n) == data
    code = animated.lzw_encode(b"\1\2\3", 2)
    for bad, n in ((code, 2), (code, 4), (code[:-1], 3), (code + b"\0", 3), (b"\x01", 3), (b"", 1)):
        refused(lambda bad=bad, n=n: animated.lzw_decode(bad, 2, n), "invalid-lzw")


def test_apng_timing_blend_disposal():
    half = e.image([(255, 0, 0, 128)] * 2)
    doc = animated.import_apng(e.apng(2, 1, [(0, 0, e.image([e.GREEN] * 2), 0, 100, 0, 0), (0, 0, half, 1, 60, 0, 1), (1, 0, e.image([e.CLEAR]), 1, 100, 1, 0), (0, 0, e.image([e.RED]), 900, 0, 2, 0), (0, 0, e.image([e.CLEAR]), 1, 1, 0, 1)]))
    cels = [c.pixels[0].tolist() for c in doc.layers[0].cels]
    mixed = [128, 127, 0, 255]
    assert doc.durations == [1, 17, 10, 9000, 1000] and doc.layers[0].id == "apng-layer-0"
    assert cels == [[list(e.GREEN)] * 2, [mixed] * 2, [mixed, [0] * 4], [list(e.RED), [0] * 4], [mixed, [0] * 4]]


def test_apng_refusals():
    good = e.apng(2, 2, [(0, 0, A, 1, 10, 0, 0), (0, 0, ONE, 1, 10, 0, 0)])
    assert len(animated.import_apng(good).layers[0].cels) == 2
    cases = [
        (png.encode(A), "not-animated"), (good[:-3], "truncated-data"), (good + b"x", "trailing-data"), (b"\x89PNG", "truncated-data"), (b"x" * 40, "invalid-png"), (good[:60] + bytes([good[60] ^ 1]) + good[61:], "invalid-crc"),
        (e.apng(2, 2, [(0, 0, A, 1, 10, 2, 0)]), "unsupported-operation"), (e.apng(2, 2, [(0, 0, A, 1, 10, 3, 0)]), "unsupported-operation"), (e.apng(2, 2, [(0, 0, A, 1, 10, 0, 2)]), "unsupported-operation"),
        (e.apng(2, 2, [(0, 0, ONE, 1, 10, 0, 0)]), "invalid-frame"), (e.apng(2, 2, [(0, 0, A, 1, 10, 0, 0), (2, 0, ONE, 1, 1, 0, 0)]), "invalid-frame"), (e.apng(2, 2, [(0, 0, A, 1, 10, 0, 0)], declared=2), "invalid-frame"),
        (good.replace(good[good.index(b"IEND") - 4 :], png.chunk(b"tEXt", b"k\0v") + png.chunk(b"IEND", b"")), "unsupported-chunk"),
    ]
    for data, code in cases:
        refused(lambda data=data: animated.import_apng(data), code)
    body = struct.pack(">I", 2) + zlib.compress(b"\0" + ONE.tobytes())
    swapped = good.replace(png.chunk(b"fdAT", body), png.chunk(b"fdAT", struct.pack(">I", 9) + body[4:]))
    refused(lambda: animated.import_apng(swapped), "invalid-sequence")
    short = png.chunk(b"fdAT", struct.pack(">I", 2) + zlib.compress(b"\0\0"))
    refused(lambda: animated.import_apng(good.replace(png.chunk(b"fdAT", body), short)), "invalid-zlib")


# archives


def test_ora():
    doc = layered.import_ora(e.ora([('name="Top" opacity="0.5" visibility="hidden" x="1" y="-1"', A), ("", B)]))
    assert [(x.id, x.name, x.opacity, x.visible) for x in doc.layers] == [("openraster-layer-0", "Top", 128, False), ("openraster-layer-1", "Layer 2", 255, True)]
    assert (doc.width, doc.height, doc.durations) == (4, 3, [100]) and (doc.layers[0].cels[0].x, doc.layers[0].cels[0].y) == (1, -1)
    assert np.array_equal(doc.layers[0].cels[0].pixels, A) and np.array_equal(doc.layers[1].cels[0].pixels, B)


@pytest.mark.parametrize("attributes,code", [
    ('composite-op="svg:multiply"', "unsupported-feature"), ('opacity="1.5"', "invalid-stack"), ('visibility="no"', "invalid-stack"), ('x="01"', "invalid-stack"), ('x="40000"', "invalid-stack"),
    ('name=" "', "invalid-stack"), ('frames="2"', "unsupported-feature"), ('name="a" name="b"', "invalid-stack"), ('name="&bad;"', "invalid-stack"), ('name="&amp;&#65;&#x42;"', None),
])
def test_ora_layers(attributes, code):
    data = e.ora([(attributes, A)])
    if code:
        refused(lambda: layered.import_ora(data), code)
    else:
        assert layered.import_ora(data).layers[0].name == "&AB"


@pytest.mark.parametrize("stack,code", [
    ("<image w='2' h='2'><stack>", "invalid-stack"), ("<!DOCTYPE x><image/>", "invalid-stack"), ("<image w='2' h='2'><stack/></image>", "invalid-stack"), ("<image w='0' h='2'><stack/></image>", "allocation-limit"),
    ("<image w='2' h='2'>text<stack/></image>", "invalid-stack"), ("<image w='2' h='2'><stack><stack/></stack></image>", "unsupported-feature"), ("<image w='2' h='2'><animation/><stack/></image>", "unsupported-feature"),
    ("<image w='2' h='2'><stack><layer src='../x.png'/></stack></image>", "unsafe-path"), ("<image w='2' h='2'><stack><layer src='none.png'/></stack></image>", "missing-entry"),
    ("<image w='2' h='2' depth='1'><stack/></image>", "unsupported-feature"), ("<other/>", "invalid-stack"), ("", "invalid-stack"),
])
def test_ora_stacks(stack, code):
    refused(lambda: layered.import_ora(e.ora([("", A)], stack=stack or " ")), code)


def test_zip_refusals():
    good = [("mimetype", b"image/openraster", False), ("a/b.txt", b"hello" * 50, True)]
    limits = archive.Limits(10, 10_000, 100, file=5000)
    data = e.archive(good)
    assert [x.content for x in archive.read(data, limits)] == [b"image/openraster", b"hello" * 50]
    at = data.index(b"PK\5\6")
    cases = [
        (data[:-1], "invalid-container"), (b"", "invalid-container"), (data + b"x", "invalid-container"), (data.replace(b"hello"[:0] + b"PK\1\2", b"PK\1\3", 1), "invalid-container"),
        (e.archive([("../x", b"", False)]), "unsafe-path"), (e.archive([("/x", b"", False)]), "unsafe-path"), (e.archive([("c:/x", b"", False)]), "unsafe-path"), (e.archive([("a//x", b"", False)]), "unsafe-path"),
        (e.archive([("a", b"", False), ("a", b"", False)]), "invalid-container"), (e.archive([("a/", b"", False), ("a", b"", False)]), "invalid-container"), (e.archive(good, flags=1), "unsupported-zip"),
        (e.archive(good, flags=8), "unsupported-zip"), (e.archive([("a", b"x" * 20_000, True)]), "allocation-limit"), (e.archive([(str(i), b"", False) for i in range(11)]), "allocation-limit"),
        (data[: at + 4] + b"\1" + data[at + 5 :], "unsupported-zip"), (data[:50] + bytes([data[50] ^ 255]) + data[51:], "invalid-container"),
    ]
    for bad, code in cases:
        refused(lambda bad=bad: archive.read(bad, limits), code)


def test_pxo():
    doc = layered.import_pxo(e.pxo(e.pxo_json()))
    assert doc.durations == [100, 250] and [(x.name, x.opacity, x.visible, x.id) for x in doc.layers] == [("Base", 128, True, "pixelorama-layer-0"), ("Ink", 255, False, "pixelorama-layer-1")]
    assert doc.layers[1].cels[1].pixels.tolist() == [[[1, 1, 9, 255]] * 2] * 2


@pytest.mark.parametrize("data,code", [
    (lambda: e.pxo(e.pxo_json(pxo_version=5)), "unsupported-version"), (lambda: e.pxo(e.pxo_json(color_mode=1)), "unsupported-feature"), (lambda: e.pxo(e.pxo_json(size_x=2000)), "allocation-limit"),
    (lambda: e.pxo(e.pxo_json(tags=[1])), "unsupported-feature"), (lambda: e.pxo(e.pxo_json(tags=1)), "invalid-project"), (lambda: e.pxo(e.pxo_json(odd=1)), "unsupported-feature"), (lambda: e.pxo(e.pxo_json(fps=0)), "invalid-project"),
    (lambda: e.pxo(e.pxo_json(), without=["image_data/frames/2/layer_1"]), "missing-entry"), (lambda: e.pxo(e.pxo_json(), cel=lambda f, i: b"123"), "invalid-container"),
    (lambda: e.pxo(e.pxo_json(), more=[("tilesets/1", b"", False)]), "unsupported-feature"), (lambda: e.pxo(e.pxo_json(), more=[("image_data/frames/9/layer_1", b"", False)]), "unsupported-feature"),
    (lambda: e.pxo(e.pxo_json(), without=["data.json"]), "missing-entry"), (lambda: e.archive([("mimetype", b"no", False)]), "invalid-mimetype"), (lambda: e.pxo(e.pxo_json(symmetry_points=[1])), "invalid-project"),
])
def test_pxo_refusals(data, code):
    refused(lambda: layered.import_pxo(data()), code)


@pytest.mark.parametrize("field,value", [("blend_mode", 1), ("type", 2), ("effects", [1]), ("parent", 0), ("clipping_mask", True), ("new_cels_linked", True)])
def test_pxo_layers(field, value):
    project = e.pxo_json()
    project["layers"][0] |= {field: value}
    refused(lambda: layered.import_pxo(e.pxo(project)), "unsupported-feature")


def test_kra():
    big = np.random.default_rng(0).integers(0, 256, (70, 130, 4), dtype=np.uint8)
    doc = layered.import_kra(e.kra([('name="Ink" opacity="128" visible="0" x="1" y="-1"', big), ('opacity="255"', big[::-1])], width=130, height=70))
    assert [(x.id, x.name, x.opacity, x.visible, x.cels[0].x, x.cels[0].y) for x in doc.layers] == [("krita-layer-0", "Ink", 128, False, 1, -1), ("krita-layer-1", "Layer 2", 255, True, 0, 0)]
    assert np.array_equal(doc.layers[0].cels[0].pixels, big)


@pytest.mark.parametrize("data,code", [
    (lambda: e.kra([("", A)]), "invalid-maindoc"), (lambda: e.kra([('opacity="256"', A)]), "invalid-maindoc"), (lambda: e.kra([('opacity="1" compositeop="multiply"', A)]), "unsupported-feature"),
    (lambda: e.kra([('opacity="1"', A)], depth="16"), "unsupported-feature"), (lambda: e.kra([], inner=""), "unsupported-feature"), (lambda: e.kra([], inner="<layer nodetype='vectorlayer' colorspacename='RGBA'/>"), "unsupported-feature"),
    (lambda: e.kra([('opacity="1"', A)], without=["img/layers/layer0"]), "missing-entry"), (lambda: e.kra([('opacity="1"', A)], more=[("img/layers/mask1", b"", False)]), "unsupported-feature"),
    (lambda: e.kra([('opacity="1"', A)], without=["preview.png"]), "missing-entry"), (lambda: e.kra([('opacity="1" locked="1"', A)]), "unsupported-feature"),
])
def test_kra_refusals(data, code):
    refused(lambda: layered.import_kra(data()), code)


@pytest.mark.parametrize("change,code", [
    (lambda t: t.replace(b"VERSION 2", b"VERSION 3"), "unsupported-feature"), (lambda t: t + b"x", "invalid-layer-data"), (lambda t: t[:-1], "invalid-layer-data"), (lambda t: t.replace(b"0,0,LZF", b"9,0,LZF"), "invalid-layer-data"),
    (lambda t: t.replace(b",16385\n\0", b",16385\n\1"), "unsupported-feature"), (lambda t: t.replace(b"DATA 1", b"DATA 0"), "allocation-limit"),
])
def test_kra_tiles(change, code):
    refused(lambda: layered._kra_tiles(change(e.krita_tiles(A)), 2, 2), code)


def test_psd():
    blocks = [(b"luni", struct.pack(">I", 2) + "Ö!".encode("utf-16-be"))]
    doc = layered.import_psd(e.psd([("a", 0, 1, A, 128, True, b"norm", False, blocks), (" ", 1, 2, B, 255, False, b"norm", True, [])]))
    assert [(x.name, x.opacity, x.visible, x.id) for x in doc.layers] == [("Ö!", 128, False, "psd-layer-0"), ("Layer 2", 255, True, "psd-layer-1")]
    first, second = (x.cels[0].pixels for x in doc.layers)
    assert np.array_equal(first[0:2, 1:3], A) and not first[:, 0].any() and np.array_equal(second[1:3, 2:4], B)


@pytest.mark.parametrize("layer,more,code", [
    (("a", 0, 0, A, 1, False, b"mul ", False, []), {}, "unsupported-feature"), (("a", 0, 0, A, 1, False, b"norm", False, [(b"TySh", b"")]), {}, "unsupported-feature"), (("a", 0, 3, A, 1, False, b"norm", False, []), {}, "invalid-container"),
    (("a", 0, 0, A, 1, False, b"norm", False, [(b"what", b"")]), {}, "unsupported-feature"), (("a", 0, 0, A, 1, False, b"norm", False, []), {"depth": 16}, "unsupported-feature"),
    (("a", 0, 0, A, 1, False, b"norm", False, []), {"version": 2}, "unsupported-feature"), (("a", 0, 0, A, 1, False, b"norm", False, []), {"width": 5000}, "allocation-limit"),
])
def test_psd_refusals(layer, more, code):
    refused(lambda: layered.import_psd(e.psd([layer], **more)), code)


def test_psd_containers():
    good = e.psd([("a", 0, 0, A, 1, False, b"norm", False, [])])
    for bad, code in ((good[:-1], "invalid-container"), (b"8BPX" + good[4:], "invalid-container"), (good[:10], "invalid-container"), (e.psd([]), "allocation-limit")):
        refused(lambda bad=bad: layered.import_psd(bad), code)


def test_pack_bits():
    draw = np.random.default_rng(2)
    for n in (0, 1, 130, 1000):
        data = draw.integers(0, 3, n, dtype=np.uint8).tobytes() + bytes(300)
        assert layered.unpack_bits(layered.pack_bits(data), len(data)) == data
    assert layered.unpack_bits(b"\x80\x00a", 1) == b"a"
    for bad, n in ((b"\x05ab", 6), (b"\xff", 2), (b"\x00a", 2), (b"\xfea", 2)):
        refused(lambda bad=bad, n=n: layered.unpack_bits(bad, n), "invalid-container")


# JSON documents


def test_piskel():
    sheet = np.concatenate((A, B, A[::-1]), axis=1)
    doc = sheets.import_piskel(e.piskel([e.piskel_layer([[0], [1], [2]], sheet, opacity=0.5), e.piskel_layer([[2, 1, 0]], np.concatenate((A, B, B)), name="M", visible=False)], hidden=["", "1"]))
    assert doc.durations == [83, 83] and [(x.id, x.name, x.opacity, x.visible) for x in doc.layers] == [("piskel-layer-0", "L", 128, True), ("piskel-layer-1", "M", 255, False)]
    assert np.array_equal(doc.layers[0].cels[1].pixels, A[::-1]) and np.array_equal(doc.layers[1].cels[0].pixels, B) and np.array_equal(doc.layers[1].cels[1].pixels, A)
    old = sheets.import_piskel(e.piskel([{"name": "L", "frameCount": 2, "base64PNG": e.data_url(np.concatenate((A, B), axis=1))}], fps=20, hidden=""))
    assert old.durations == [50, 50] and np.array_equal(old.layers[0].cels[1].pixels, B)


LAYER = e.piskel_layer([[0]], A)


@pytest.mark.parametrize("text,code", [
    ("{", "invalid-json"), ("[]", "invalid-field"), (e.piskel([LAYER], version=3), "unsupported-model-version"), (e.piskel([LAYER], odd=1), "unsupported-field"), (e.piskel([LAYER], fps=0), "invalid-fps"),
    (e.piskel([LAYER], width=2000), "invalid-dimension"), (e.piskel([LAYER], hidden=1), "hidden-frames"), (e.piskel([LAYER], hidden=[0]), "hidden-frames"), (e.piskel([LAYER], hidden=[5]), "hidden-frames"),
    (e.piskel([e.piskel_layer([[0], [0]], A, count=2)]), "frame-coverage"), (e.piskel([e.piskel_layer([[0]], A, count=2)]), "frame-coverage"), (e.piskel([e.piskel_layer([[0], [1]], A)]), "png-dimension-mismatch"),
    (e.piskel([LAYER | {"base64PNG": ""}]), "legacy-layer-layout"), (e.piskel([{"name": "a", "frameCount": 1}]), "missing-chunks"), (e.piskel([LAYER | {"chunks": []}]), "missing-chunks"),
    (e.piskel([{"name": "a", "frameCount": 1, "base64PNG": "data:image/png;base64,AB=="}]), "invalid-png-data-url"), (e.piskel([LAYER | {"opacity": 2}]), "invalid-field"), (e.piskel([e.piskel_layer([[3]], A, count=1)]), "invalid-chunk-layout"),
    (json.dumps({"modelVersion": 2, "piskel": {"name": "p"}}), "missing-field"), (json.dumps({"modelVersion": 2, "piskel": {"name": "p", "fps": 1, "height": 1, "width": 1, "layers": ["{"]}}), "invalid-layer-json"),
])
def test_piskel_refusals(text, code):
    refused(lambda: sheets.import_piskel(text), code)


def test_pixil():
    doc = sheets.import_pixil(e.pixil([(120, [("u", "Base", "0.5", A), ("v", "Ink", 1, B)]), ("75", [("u", "Base", "0.5", B), ("v", "Ink", 1, A)])]))
    assert doc.durations == [120, 75] and [(x.id, x.name, x.opacity, x.visible) for x in doc.layers] == [("pixil-layer-0", "Base", 128, True), ("pixil-layer-1", "Ink", 255, True)]
    assert np.array_equal(doc.layers[0].cels[1].pixels, B)


def change(text, f):
    value = json.loads(text)
    f(value)
    return json.dumps(value)


P = e.pixil([(120, [("u", "Base", 1, A)]), (75, [("u", "Base", 1, B)])])


@pytest.mark.parametrize("text,code", [
    ("{", "invalid-json"), ("1", "invalid-container"), (e.pixil([], website="x"), "invalid-container"), (e.pixil([], version="3"), "unsupported-version"), (e.pixil([]), "allocation-limit"), (e.pixil([], width=0), "allocation-limit"),
    (change(P, lambda v: v["frames"][1]["layers"][0].update(unqid="w")), "invalid-project"), (change(P, lambda v: v["frames"][1]["layers"][0].update(opacity=0.5)), "invalid-project"),
    (change(P, lambda v: v["frames"][0]["layers"][0]["options"].update(blend="multiply")), "unsupported-feature"), (change(P, lambda v: v["frames"][0]["layers"][0].update(src="https://x/y.png")), "invalid-pixels"),
    (change(P, lambda v: v["frames"][0]["layers"][0].update(src=e.data_url(ONE))), "png-dimension-mismatch"), (change(P, lambda v: v["frames"][0].update(speed=0)), "invalid-project"), (change(P, lambda v: v["frames"][0].update(width=3)), "invalid-project"),
    (change(P, lambda v: v["frames"][0]["layers"].append(v["frames"][0]["layers"][0])), "invalid-project"),
])
def test_pixil_refusals(text, code):
    refused(lambda: sheets.import_pixil(text), code)


SHEET = np.arange(4 * 8 * 4, dtype=np.uint8).reshape(4, 8, 4)


def test_grid_and_sequence():
    rows = sheets.grid_sheet(SHEET, 2, 2, 2, 4)
    assert len(rows.durations) == 8 and np.array_equal(rows.layers[0].cels[5].pixels, SHEET[2:4, 2:4]) and rows.durations[0] == 100
    columns = sheets.grid_sheet(SHEET, 2, 2, 2, 4, "column-major", 40)
    assert np.array_equal(columns.layers[0].cels[5].pixels, SHEET[2:4, 4:6]) and columns.durations[0] == 40
    for bad in ((3, 2, 2, 4), (2, 2, 2, 3), (0, 2, 2, 4)):
        refused(lambda bad=bad: sheets.grid_sheet(SHEET, *bad), "invalid-grid")
    assert sheets.png_sequence([A, B]).durations == [100, 100]
    refused(lambda: sheets.png_sequence([A, ONE]), "invalid-sequence")
    refused(lambda: sheets.png_sequence([]), "invalid-sequence")


def frame(x, y, w, h, **more):
    return {"frame": {"x": x, "y": y, "w": w, "h": h}} | more


def test_atlas():
    text = json.dumps({"frames": {"b": frame(0, 0, 2, 2, duration=80), "10": frame(2, 0, 2, 2), "2": frame(4, 0, 2, 2)}})
    doc = sheets.atlas_sheet(SHEET, text, 125)
    assert doc.durations == [125, 125, 80] and np.array_equal(doc.layers[0].cels[0].pixels, SHEET[0:2, 4:6])
    turned = sheets.atlas_sheet(SHEET, json.dumps({"frames": [frame(1, 0, 2, 3, rotated=True)]}))
    assert (turned.width, turned.height) == (3, 2)
    assert turned.layers[0].cels[0].pixels.tolist() == [[SHEET[y, 1 + 2 - x - 1].tolist() for y in range(3)] for x in range(2)]
    trimmed = sheets.atlas_sheet(SHEET, json.dumps({"frames": [frame(0, 0, 2, 1, trimmed=True, sourceSize={"w": 4, "h": 4}, spriteSourceSize={"x": 1, "y": 2, "w": 2, "h": 1})]}))
    pixels = trimmed.layers[0].cels[0].pixels
    assert pixels.shape == (4, 4, 4) and np.array_equal(pixels[2, 1:3], SHEET[0, 0:2]) and not pixels[0].any()
    tags = json.dumps({"frames": [frame(0, 0, 1, 1)] * 2, "meta": {"app": "Aseprite", "frameTags": [{"name": "run", "from": 0, "to": 1, "direction": "pingpong"}]}})
    assert sheets.atlas_sheet(SHEET, tags).tags[0].direction == "ping-pong"


@pytest.mark.parametrize("value,code", [
    ([], "unknown-schema"), ({}, "unknown-schema"), ({"frames": 1}, "invalid-field"), ({"frames": []}, "invalid-field"), ({"textures": []}, "invalid-field"), ({"textures": [{"frames": []}]}, "unsupported-variant"),
    ({"frames": [frame(0, 0, 1, 1, rotated=90)]}, "invalid-field"), ({"frames": [frame(0, 0, 1, 1, trimmed=True)]}, "invalid-field"), ({"frames": [frame(7, 0, 2, 1)]}, "invalid-frame-geometry"),
    ({"frames": [frame(0, 0, 1, 1), frame(0, 0, 2, 1)]}, "invalid-frame-geometry"), ({"frames": [frame(0, 0, 1, 1, duration=0)]}, "invalid-field"), ({"frames": [frame(-1, 0, 1, 1)]}, "invalid-field"),
    ({"frames": [frame(0, 0, 1, 1)], "meta": {"app": "aseprite", "frameTags": [{"name": "a", "from": 0, "to": 3, "direction": "forward"}]}}, "invalid-field"),
])
def test_atlas_refusals(value, code):
    refused(lambda: sheets.atlas_sheet(SHEET, json.dumps(value)), code)
