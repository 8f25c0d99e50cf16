"""The codec: inverse pairs, exact round trips, laziness, and corruption that never raises anything else."""

import itertools

import numpy as np
import pytest

from rasterloom.operators import alpha, colour, lossless, prefix
from rasterloom.operators.bits import BitReader, BitWriter, Invalid, Unsupported
from rasterloom.sources import container as box
from rasterloom.sources import datasource, exif, media

SIZES = [(1, 1), (1, 17), (17, 1), (3, 5), (64, 48)]


def pictures(w, h):
    rng = np.random.default_rng(w * 100 + h)
    y, x = np.mgrid[0:h, 0:w]
    gradient = (255 << 24 | (4 * x % 256) << 16 | (4 * y % 256) << 8 | (x + y) % 256).reshape(-1).astype(np.uint32)
    four = np.array([0xFF102030, 0x80405060, 0xFFA0B0C0, 0x00D0E0F0], np.uint32)[((x // 3 + y // 2) % 4).reshape(-1)]
    return {"flat": np.full(w * h, 0xFF336699, np.uint32), "gradient": gradient, "noise": rng.integers(0, 1 << 32, w * h, dtype=np.uint32), "palette": four, "many": rng.choice(rng.integers(0, 1 << 32, 200, dtype=np.uint32), w * h), "rough": gradient + rng.integers(0, 3, w * h).astype(np.uint32)}


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("effort", [0, 4, 6])
def test_lossless_round_trip(size, effort):
    for name, px in pictures(*size).items():
        data = lossless.encode(px, *size, effort)
        head, got = lossless.decode(data)
        assert (head.width, head.height) == size and (got == px).all(), name
        assert head.has_alpha == bool((px >> np.uint32(24) != 255).any())


def test_word_sums():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 32, (2, 1000), dtype=np.uint32)
    assert (lossless.add(lossless.subtract(a, b), b) == a).all()
    codes = rng.integers(0, 1 << 24, 1000, dtype=np.uint32)
    assert (lossless.cross_colour(lossless.cross_colour(a, codes, False), codes, True) == a).all()
    assert (lossless.green_in(lossless.green_in(a, False), True) == a).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    """Scalar and whole-picture predictions agree, and residuals give the pixels again."""
    px = pictures(9, 7)["noise"]
    guess = lossless.predictions(px, 9)[mode]
    for i in range(10, 63):
        if i % 9:
            assert guess[i] == lossless.predict(mode, *(int(px[i - d]) for d in (1, 10, 9, 8)))
    modes = np.full(6, 0xFF000000 | mode << 8, np.uint32)
    assert (lossless.unpredict(lossless.subtract(px, guess), 9, 2, modes) == px).all()


def test_distance_codes():
    for width, distance in itertools.product((1, 2, 3, 8, 9, 40, 640), range(1, 400)):
        assert lossless.distance_of(lossless.code_of(distance, width), width) == distance
    for value in range(1, 5000):
        s, n, extra = lossless.prefix_of(value)
        w = BitWriter()
        w.write(extra, n)
        assert lossless.prefix_value(s, BitReader(w.bytes())) == value


def test_prefix_codes():
    rng = np.random.default_rng(2)
    for size, spread in ((2, 1), (19, 5), (256, 12), (300, 25)):
        counts = [int(2 ** rng.integers(0, spread)) if rng.random() < 0.7 else 0 for _ in range(size)]
        counts[int(rng.integers(size))] += 1
        lengths = prefix.code_lengths(counts)
        assert max(lengths) <= 15 and all(bool(n) == bool(c) for n, c in zip(lengths, counts))
        w = BitWriter()
        codes = prefix.write_code(w, lengths)
        message = [s for s, c in enumerate(counts) if c] * 3
        for s in message:
            w.write(*codes[s])
        r = BitReader(w.bytes())
        d = prefix.read_code(r, size)
        assert [d.read(r) for _ in message] == message
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    assert max(prefix.code_lengths(fib)) <= 15
    for bad in ([0, 0], [1, 2], [1, 1, 1]):
        with pytest.raises(Invalid):
            prefix.decoder(bad)


def test_alpha():
    plane = np.random.default_rng(1).integers(0, 256, (13, 11), dtype=np.uint8)
    for kind, coded in itertools.product(range(4), (False, True)):
        assert (alpha.decode(alpha.encode(plane, kind, coded), 11, 13) == plane).all()
    assert (alpha.decode(None, 3, 2) == 255).all()
    for bad in (b"", b"\0", b"\x40aaaa", b"\x02aaaa", b"\x20aaaa", b"\0aaa"):
        with pytest.raises(Invalid):
            alpha.decode(bad, 2, 2)


def test_containers():
    px = colour.argb_to_rgba(pictures(20, 10)["palette"], 20)
    data = media.encode(px, media.EncodeOptions(exact=True))
    c = box.parse(box.Bytes.of(data))
    assert not c.extended and c.image.fourcc == box.LOSSLESS
    assert (next(media.decode(data))[1] == px).all()
    record = exif.build({"orientation": 6, "make": "Cam"})
    whole = box.container([(box.EXTENDED, box.extended_header(20, 10, 8)), (box.XMP, b"<x/>"), (b"ODD!", b"1"), (box.EXIF, b"Exif\0\0" + record), (box.EXIF, b"second"), (box.LOSSLESS, data[20 : 20 + c.image.size])])
    src = box.Bytes.of(whole)
    assert box.metadata(src, box.XMP) == b"<x/>" and exif.orientation(box.metadata(src, box.EXIF)) == 6 and box.metadata(src, box.PROFILE) is None
    turned = next(media.decode(whole, media.DecodeOptions(auto_rotate=True)))[1]
    assert turned.shape == (20, 10, 4)
    with pytest.raises(Unsupported):
        list(media.decode(whole, media.DecodeOptions(size_limit=199)))
    for bad in (b"", b"RIFF", b"RIFX" + data[4:], data[:8] + b"WEBM" + data[12:], data[:4] + b"\3\0\0\0" + data[8:], data[:12], data[: len(data) // 2]):
        with pytest.raises(Invalid):
            list(media.decode(bad))


def test_corruption():
    """Truncations and flipped bits give an image or one of the two errors."""
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 256, (9, 12, 4), dtype=np.uint8) for _ in range(3)]
    for data in (media.encode(images[0]), media.encode_animation(images, [40, 60, 80], media.EncodeOptions(loop_count=3))):
        cut = [data[: len(data) * n // 64] for n in range(0, 64, 6)]
        flipped = [data[:i] + bytes([data[i] ^ 1 << int(rng.integers(8))]) + data[i + 1 :] for i in rng.integers(0, len(data), 150)]
        for d in cut + flipped:
            try:
                list(media.decode(d, media.DecodeOptions(size_limit=1 << 14)))
            except (Invalid, Unsupported):
                pass


def test_animation():
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 256, (6, 8, 4), dtype=np.uint8) for _ in range(3)]
    data = media.encode_animation(images, [40, 60], media.EncodeOptions(loop_count=3))
    c = box.parse(box.Bytes.of(data))
    assert c.loop_count == 3 and [f.duration_ms for f in c.frames] == [40, 60, 0] and c.flags == 18
    got = list(media.decode(data))
    assert [d for d, _ in got] == [40, 60, 0] and all((a == colour.premultiplied(b)).all() for (_, a), b in zip(got, images))


def test_lazy_headers():
    """Features read a few bytes, whatever the file's size."""
    data = media.encode(np.random.default_rng(6).integers(0, 256, (100, 100, 4), dtype=np.uint8))
    used = []

    def read(at, n):
        used.append(n)
        return data[at : at + n]

    f = box.features(box.Bytes(read, len(data)))
    assert (f.width, f.height, f.codec) == (100, 100, "lossless") and sum(used) <= 64


def test_files(spark, tmp_path):
    """Spark's own reader and the data source of headers, over the same folder."""
    from rasterloom.sources.datasource import Headers

    rng = np.random.default_rng(7)
    for k in range(5):
        (tmp_path / f"{k}.webp").write_bytes(media.encode(rng.integers(0, 256, (4 + k, 6, 4), dtype=np.uint8)))
    (tmp_path / "broken.webp").write_bytes(b"RIFF1234WEBP")
    c = media.containers(media.read(spark, str(tmp_path))).collect()
    assert sorted(r.height for r in c if not r.error_class) == [4, 5, 6, 7, 8] and [r.error_class for r in c if r.error_class] == ["INVALID"]
    assert media.pixels(media.read(spark, str(tmp_path))).filter("error_class IS NULL").count() == 5
    assert media.chunk_rows(media.read(spark, str(tmp_path))).filter("fourcc = 'VP8L'").count() == 5
    spark.dataSource.register(Headers)
    rows = spark.read.format("media_headers").load(str(tmp_path)).collect()
    assert sorted(r.height for r in rows if r.height) == [4, 5, 6, 7, 8] and max(r.bytes_read for r in rows) <= 64


def test_sink(spark, tmp_path):
    from rasterloom.sources.datasource import Files

    spark.dataSource.register(Files)
    rows = [(f"{k}.webp", bytearray(media.encode(np.full((3, 3 + k, 4), 200, np.uint8)))) for k in range(6)]
    spark.createDataFrame(rows, "name string, content binary").repartition(3).write.format("media_files").mode("append").save(str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == [n for n, _ in rows]
    assert sorted(r.width for r in media.containers(media.read(spark, str(tmp_path))).collect()) == [3, 4, 5, 6, 7, 8]


def test_parses_and_groups():
    """Every parse expands to the picture; more effort doesn't cost more; tiles of two kinds get two groups of codes."""
    rng = np.random.default_rng(11)
    y, x = np.mgrid[0:64, 0:64]
    px = np.where(x < 32, 0xFF000000 | rng.integers(0, 4, (64, 64)) << 8, rng.integers(0, 1 << 32, (64, 64))).astype(np.uint32).reshape(-1)
    words = np.tile(rng.integers(0, 50, 40), 60)[:2000].tolist()
    for refs in (lossless.matches(words, 50), lossless.cheapest_parse(lossless.matches(words, 50), words, 50)):
        out = []
        for ref in refs:
            if ref[0] == "v":
                out.append(ref[1])
            else:
                for _ in range(ref[2]):
                    out.append(out[-ref[1]])
        assert out == words
    group, _ = lossless.code_groups([("v", int(v)) for v in px], 64, 64, 0, 3)
    assert group.max() >= 1 and len(set(group.reshape(8, 8)[:, :4].reshape(-1)) & set(group.reshape(8, 8)[:, 4:].reshape(-1))) == 0
    sizes = [len(lossless.encode(px, 64, 64, e)) for e in (4, 5, 6)]
    assert sizes[2] <= sizes[1] + 8
    for e in (4, 5, 6):
        assert (lossless.decode(lossless.encode(px, 64, 64, e))[1] == px).all()


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, parts):
    rng = np.random.default_rng(8)
    files = [(k, bytearray(media.encode(rng.integers(0, 256, (5, 5, 4), dtype=np.uint8)))) for k in range(14)]
    df = spark.createDataFrame(files, "file_id long, content binary").repartition(parts)
    rows = {r.file_id: bytes(r.rgba) for r in media.pixels(df).collect()}
    assert rows == {k: next(media.decode(bytes(d)))[1].tobytes() for k, d in files}


def test_pixel_source(spark, tmp_path):
    """Stills, an animation and broken files as rows of the format."""
    rng = np.random.default_rng(8)
    spark.dataSource.register(datasource.Pixels)
    still = rng.integers(0, 256, (5, 7, 4), dtype=np.uint8)
    frames = [np.full((4, 6, 4), v, np.uint8) for v in (255, 200, 255)]
    (tmp_path / "a.webp").write_bytes(media.encode(still, media.EncodeOptions(exact=True)))
    (tmp_path / "b.webp").write_bytes(media.encode_animation(frames, [10, 20, 30], media.EncodeOptions(loop_count=1)))
    (tmp_path / "c.webp").write_bytes(b"RIFF no picture")
    rows = {(r.path[-6:], r.frame_no): r for r in spark.read.format("media_pixels").load(str(tmp_path)).collect()}
    assert set(rows) == {("a.webp", 0), ("b.webp", 0), ("b.webp", 1), ("b.webp", 2), ("c.webp", None)}
    assert bytes(rows["a.webp", 0].rgba) == still.tobytes() and rows["c.webp", None].error_class == "INVALID" and rows["b.webp", 2].delay_ms == 30
    assert spark.read.format("media_pixels").option("first_only", "true").option("size_limit", "30").load(str(tmp_path)).filter("error_class IS NULL").count() == 1
