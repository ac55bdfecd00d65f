import numpy as np
import pytest

from spanlight.llm import webp_lossless as webp


def pictures():
    rng = np.random.default_rng(1)
    yield rng.integers(0, 1 << 32, 35 * 21, dtype=np.uint32), 35  # noise with alpha
    y, x = np.mgrid[:40, :33]
    yield (0xFF000000 | (x * 5 % 256) << 16 | (y * 3 % 256) << 8 | (x + y)).astype(np.uint32).reshape(-1), 33
    yield np.tile(rng.integers(0, 1 << 24, 50, dtype=np.uint32) | 0xFF000000, 40), 20  # repeats
    yield np.full(1, 0xFF102030, np.uint32), 1
    yield np.full(600, 0xFF0A0A0A, np.uint32), 30
    for colours in (2, 3, 9, 17, 200):
        yield rng.choice(rng.integers(0, 1 << 32, colours, dtype=np.uint32), 29 * 13), 29


SETTINGS = [
    {},
    {"matches": False},
    {"cache_bits": 4},
    {"cache_bits": 10, "matches": False},
    {"subtract_green": True},
    {"cross": (13, -70, 101)},
    {"subtract_green": True, "predictor": 11, "cross": (-3, 7, 9), "cache_bits": 6, "block_bits": 2},
    *({"predictor": mode, "block_bits": 3} for mode in range(14)),
]


@pytest.mark.parametrize("settings", SETTINGS, ids=str)
def test_round_trip(settings):
    for pixels, width in pictures():
        wide, high, back = webp.decode(webp.encode(pixels, width, **settings))
        assert (wide, high) == (width, len(pixels) // width)
        assert np.array_equal(back, pixels)


def test_palette_round_trip():
    for pixels, width in pictures():
        if len(np.unique(pixels)) <= 256:
            for settings in ({}, {"cache_bits": 3}, {"matches": False}):
                assert np.array_equal(webp.decode(webp.encode(pixels, width, palette=True, **settings))[2], pixels)


def test_mixed_predictor_blocks():
    for pixels, width in pictures():
        high = len(pixels) // width
        modes = np.arange((-(-width // 4)) * (-(-high // 4))) % 14
        assert np.array_equal(webp.decode(webp.encode(pixels, width, predictor=modes, block_bits=2))[2], pixels)


def test_windows_join(monkeypatch):
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, 96 * 100, dtype=np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000)
    monkeypatch.setattr(webp, "WINDOW_BITS", 1000)
    for settings in ({"palette": True}, {}, {"matches": False}):
        assert np.array_equal(webp.decode(webp.encode(pixels, 96, **settings))[2], pixels)


def test_both_paths_agree(monkeypatch):
    pixels, width = list(pictures())[2]
    file = webp.encode(pixels, width)
    slow = lambda reader, codes, out, wide: webp._fill_by_words(reader, [codes], out, wide, 0, None, 0, 1)
    monkeypatch.setattr(webp, "_fill_by_windows", slow)
    assert np.array_equal(webp.decode(file)[2], pixels)


def test_known_file():
    # 1 x 1, opaque, colour (255, 0, 0): built by hand from the format's description
    writer = webp.BitWriter()
    for value, bits in ((0x2F, 8), (0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        writer.put(value, bits)
    for symbol in (0, 255, 0, 255, 0):  # green, red, blue, alpha, distance: simple codes of one symbol
        writer.put(1, 1)
        writer.put(0, 1)
        writer.put(int(symbol > 1), 1)
        writer.put(symbol, 8 if symbol > 1 else 1)
    body = writer.bytes()
    file = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    file += b"\0" * max(0, 25 - len(file))
    assert webp.decode(file)[2].tolist() == [0xFFFF0000]


def test_short_distances():
    assert webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert len(webp.NEAR) == 120 and webp.NEAR[-1] == (8, 7)


def test_damaged_files():
    file = webp.encode(np.arange(500, dtype=np.uint32) | np.uint32(0xFF000000), 25)
    for bad in (b"", b"RIFF", file[:40], b"X" + file[1:], file[:20] + b"\0" + file[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_media_columns(spark):
    from spanlight.llm.media import decode_images, encode_text_images

    texts = ["", None, "a", "x" * 576, "é" * 5000, "ab" * 40_000, "a"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, width int")
    rows = {r.doc_id: r for r in decode_images(encode_text_images(docs)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        assert bytes(rows[i].pixels).startswith(raw) and set(bytes(rows[i].pixels)[len(raw) :]) <= {255}
        assert len(rows[i].pixels) % 576 == 0 and len(rows[i].pixels) > 0 and rows[i].n_bytes == len(raw)
    assert rows[2].media == rows[6].media and rows[2].feature == rows[6].feature
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"no image"))], "doc_id long, media binary")
    assert [r.pixels for r in decode_images(odd).collect()] == [None, None]
    assert encode_text_images(docs.limit(0)).count() == 0


def test_long_payloads_are_several_files():
    from spanlight.llm.media import FILE_SAMPLES, ROW, pack_grey

    rng = np.random.default_rng(5)
    samples = rng.choice(np.frombuffer(b"some letters, a few of them", np.uint8), FILE_SAMPLES + 3 * ROW).tobytes()
    parts = webp.files(pack_grey(samples))
    assert len(parts) == 2 and webp.files(b"") == [b""]
    back = [webp.decode(p) for p in parts]
    assert {w for w, _, _ in back} == {ROW}
    assert b"".join(((a >> 8) & 255).astype(np.uint8).tobytes() for _, _, a in back) == samples
