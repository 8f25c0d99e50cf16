"""The lossy codec: the decoder gives what the encoder rebuilt; quality; corruption; the arithmetic coder."""

import numpy as np
import pytest

from rasterloom.operators import colour, lossy
from rasterloom.operators.bits import Invalid, Unsupported
from rasterloom.operators.boolcoder import BoolReader, BoolWriter
from rasterloom.sources import container as box
from rasterloom.sources import media


def picture(h, w, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    luma = np.clip(128 + 60 * np.sin(x / 7) + 50 * np.cos(y / 5) + rng.normal(0, 4, (h, w)), 0, 255).astype(np.uint8)
    yy, xx = np.mgrid[0 : (h + 1) // 2, 0 : (w + 1) // 2]
    return luma, (100 + xx % 50).astype(np.uint8), (140 - yy % 60).astype(np.uint8)


def psnr(a, b):
    return 10 * np.log10(255**2 / max(((a.astype(float) - b) ** 2).mean(), 1e-9))


@pytest.mark.parametrize("size", [(16, 16), (17, 13), (64, 48), (1, 1), (97, 121)])
@pytest.mark.parametrize("small", [False, True])
def test_round_trip(size, small):
    planes, before = picture(*size), 0
    for quality in (20, 50, 75, 95):
        data, rebuilt = lossy.Encoder(quality, small_blocks=small).encode(*planes)
        got = lossy.Decoder().decode(data)
        assert all((a == b).all() and a.shape == p.shape for a, b, p in zip(got, rebuilt, planes))
        now = psnr(got[0], planes[0])
        assert now >= 25 and now > before - 1
        before = now


def test_other_tables():
    """Any default probabilities serve, if both sides have them."""
    rng = np.random.default_rng(1)
    t = lossy.Tables(rng.integers(1, 256, (4, 8, 3, 11)), rng.integers(1, 256, (4, 8, 3, 11)), rng.integers(1, 256, (10, 10, 9)))
    planes = picture(48, 64)
    data, rebuilt = lossy.Encoder(60, t).encode(*planes)
    assert all((a == b).all() for a, b in zip(lossy.Decoder(t).decode(data), rebuilt))


def listing(t):
    """Tables as the RFC prints them: C declarations with comments, broken by page ends."""
    rfc = [lossy.DC, lossy.TM, lossy.VE, lossy.HE, lossy.LD, lossy.RD, lossy.VR, lossy.VL, lossy.HD, lossy.HU]

    def nested(v, depth=0):
        if v.ndim == 1:
            return "{ " + ", ".join(map(str, v.tolist())) + "}"
        return "{ /* block type %d */\n" % depth + ",\n".join(nested(x, k) for k, x in enumerate(v)) + "\n}"

    out = ""
    for name, of, dims in (("coeff_update_probs", t.updates, "[4] [8] [3] [11]"), ("default_coeff_probs", t.coefficients, "[BLOCK_TYPES] [COEF_BANDS] [3] [ENTROPY_NODES]"), ("kf_bmode_probs", t.small_modes[np.ix_(rfc, rfc)], "[num_intra_bmodes] [num_intra_bmodes] [num_intra_bmodes-1]")):
        out += f"   const Prob {name} {dims}; /* declared 1st */\n   text = {{1, 2}};\n   const Prob {name} {dims} =\n{nested(of)};\n"
    lines = out.split("\n")
    for k in range(50, len(lines), 61):
        lines.insert(k, "\nBankoski, et al.              Informational                    [Page 76]\n\nRFC 6386   VP8 Data Format and Decoding Guide   November 2011\n")
    return "\n".join(lines)


def test_tables_of_a_text(tmp_path):
    rng = np.random.default_rng(4)
    t = lossy.Tables(rng.integers(1, 256, (4, 8, 3, 11)), rng.integers(1, 256, (4, 8, 3, 11)), rng.integers(1, 256, (10, 10, 9)))
    (tmp_path / "rfc.txt").write_text(listing(t))
    got = lossy.Tables.read(str(tmp_path / "rfc.txt"))
    assert all((a == b).all() for a, b in ((got.coefficients, t.coefficients), (got.updates, t.updates), (got.small_modes, t.small_modes)))
    with pytest.raises(ValueError):
        lossy.Tables.of_text(listing(t).replace("kf_bmode", "other"))


def test_files_need_the_published_tables():
    """No picture is written or read with tables that aren't the format's."""
    rgba = np.full((16, 16, 4), 200, np.uint8)
    with pytest.raises(ValueError):
        media.encode(rgba, media.EncodeOptions(lossless=False))
    data = media.encode(rgba, media.EncodeOptions(lossless=False), lossy.Tables())
    with pytest.raises(Unsupported):
        list(media.decode(data))
    with pytest.raises(Unsupported):
        media.still_planes(data)


def test_effort_of_lossy_files():
    """The method chooses 4x4 modes from 3 on and the trellis from 5 on."""
    y, u, v = picture(48, 64)
    rgba = np.concatenate([colour.to_rgb(y, u, v), np.full((48, 64, 1), 255, np.uint8)], 2)
    sizes, errors = [], []
    for method in (0, 3, 5):
        data = media.encode(rgba, media.EncodeOptions(quality=92, method=method, lossless=False), lossy.Tables())
        got = next(iter(media.decode(data, tables=lossy.Tables())))[1]
        sizes.append(len(data))
        errors.append(psnr(got[..., :3], rgba[..., :3]))
    assert len(set(sizes)) == 3 and sizes[2] < sizes[1] and errors[1] > errors[0] - 0.5 and min(errors) > 25


def test_exact_keeps_hidden_colour():
    rgba = np.random.default_rng(1).integers(0, 256, (9, 7, 4)).astype(np.uint8)
    rgba[::2, ::2, 3] = 0
    kept = next(iter(media.decode(media.encode(rgba, media.EncodeOptions(exact=True)))))[1]
    free = next(iter(media.decode(media.encode(rgba))))[1]
    assert (kept == rgba).all() and (free == np.where(rgba[..., 3:] == 0, 0, rgba)).all()


def test_blocks_of_coefficients():
    rng = np.random.default_rng(2)
    odds = rng.integers(1, 255, (8, 3, 11)).tolist()
    for first in (0, 1):
        for _ in range(300):
            levels = [0] * first + [int(v) for v in rng.choice([0, 0, 0, 1, -1, 2, 3, 5, -7, 9, 11, 20, -35, 67, 500, -2047], 16 - first)]
            w = BoolWriter()
            n = lossy.write_block(lambda band, c, slot, bit: w.bit(bit, slot if band is None else odds[band][c][slot]), levels, 1, first)
            got, end = lossy.read_block(BoolReader(w.bytes()), odds, 1, first)
            assert got == levels and end == n


def test_trellis():
    """Never dearer than rounding, by its own measure; frames decode as they were rebuilt, with fewer bytes."""
    rng = np.random.default_rng(8)
    odds = rng.integers(40, 220, (8, 3, 11)).tolist()
    for _ in range(60):
        c = np.round(rng.laplace(0, 60, 16)).astype(np.int64)
        step, weight = (20, 24), 150.0
        q = np.array([step[0]] + [step[1]] * 15)
        measure = lambda lv: float(((c - np.array(lv) * q) ** 2).sum()) + weight * lossy.block_price(odds, 0, 0, list(map(int, lv)))
        got = lossy.trellis(c, step, odds, 0, 0, weight)
        rounded = np.sign(c) * ((np.abs(c) + q // 2) // q)
        assert measure(got) <= measure(rounded.tolist()) + 1e-6
    planes = picture(33, 35)
    plain, fine = lossy.Encoder(60).encode(*planes), lossy.Encoder(60, by_trellis=True).encode(*planes)
    assert all((a == b).all() for a, b in zip(lossy.Decoder().decode(fine[0]), fine[1])) and len(fine[0]) < len(plain[0])


def test_bool_coder():
    rng = np.random.default_rng(3)
    bits = [(int(rng.random() < p / 256), 256 - p) for p in rng.integers(1, 256, 20000).tolist()]
    w = BoolWriter()
    for b, p in bits:
        w.bit(b, p)
    r = BoolReader(w.bytes())
    assert [r.bit(p) for _, p in bits] == [b for b, _ in bits] and not r.past_end
    r = BoolReader(b"")
    r.bits(20)
    assert r.past_end


def test_transforms():
    rng = np.random.default_rng(4)
    d = rng.integers(-255, 256, (200, 4, 4))
    assert np.abs(lossy.inverse_dct(lossy.forward_dct(d)) - d).max() <= 2
    dc = rng.integers(-4000, 4000, (4, 4))
    assert np.abs(lossy.inverse_wht(lossy.forward_wht(dc)) - dc).max() <= 2


def test_files():
    rng = np.random.default_rng(5)
    rgba = np.concatenate([colour.to_rgb(*picture(30, 40)), rng.integers(0, 256, (30, 40, 1), dtype=np.uint8)], 2)
    data = media.encode(rgba, media.EncodeOptions(quality=90, lossless=False), lossy.Tables())
    c = box.parse(box.Bytes.of(data))
    assert c.extended and c.alpha and c.image.fourcc == box.LOSSY
    f = box.features(box.Bytes.of(data))
    assert (f.width, f.height, f.has_alpha, f.codec) == (40, 30, True, "lossy")
    got = next(media.decode(data, tables=lossy.Tables()))[1]
    assert (got[..., 3] == rgba[..., 3]).all() and psnr(got[..., :3], rgba[..., :3]) > 30


def test_corruption():
    rng = np.random.default_rng(6)
    data = lossy.encode(*picture(33, 35), 50)
    cut = [data[: len(data) * n // 64] for n in range(0, 64, 6)]
    flipped = [data[:i] + bytes([data[i] ^ 1 << int(rng.integers(8))]) + data[i + 1 :] for i in rng.integers(0, len(data), 60)]
    for d in cut + flipped:
        try:
            lossy.Decoder(limit=1 << 16).decode(d)
        except (Invalid, Unsupported):
            pass
    with pytest.raises(Unsupported):
        lossy.Decoder(limit=100).decode(data)
