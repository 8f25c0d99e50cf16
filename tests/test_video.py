"""Video: key frames and frames that predict from others, vectors, corruption."""

import numpy as np
import pytest

from rasterloom.operators import lossy, video
from rasterloom.operators.bits import Invalid, Unsupported
from rasterloom.operators.boolcoder import BoolReader, BoolWriter


def clip(h, w, n):
    rng = np.random.default_rng(h)
    big = np.clip(128 + 60 * np.sin(np.arange(w + 80) / 7)[None, :] + 50 * np.cos(np.arange(h + 80) / 5)[:, None] + rng.normal(0, 6, (h + 80, w + 80)), 0, 255)
    ch, cw = (h + 1) // 2, (w + 1) // 2
    for t in range(n):
        oy, ox = 20 + 2 * t, 30 - 3 * t
        luma = big[oy : oy + h, ox : ox + w].copy()
        luma[5 + t : 12 + t, 3 * t : 3 * t + 8] = 250
        half = big[oy : oy + 2 * ch : 2, ox : ox + 2 * cw : 2]
        yield luma.astype(np.uint8), (half * 0.5 + 60).astype(np.uint8), (200 - half * 0.4).astype(np.uint8)


@pytest.mark.parametrize("size", [(16, 16), (33, 17), (64, 80)])
@pytest.mark.parametrize("quality", [30, 80])
def test_round_trip(size, quality):
    enc, dec = video.VideoEncoder(quality), video.VideoDecoder()
    for k, planes in enumerate(clip(*size, 5)):
        data, rebuilt = (enc.encode_inter if k else enc.encode_key)(*planes)
        got = dec.decode(data)
        assert lossy.frame_tag(data)[0] == (k == 0)
        assert all((a == b).all() for a, b in zip(got, rebuilt))
        assert 10 * np.log10(255**2 / ((got[0].astype(float) - planes[0]) ** 2).mean()) > 28


def test_motion_pays():
    """A moved picture takes far fewer bytes than a key frame."""
    enc = video.VideoEncoder(70)
    frames = list(clip(96, 96, 2))
    key = enc.encode_key(*frames[0])[0]
    assert len(enc.encode_inter(*frames[1])[0]) < 0.7 * len(key)


def test_vectors():
    rng = np.random.default_rng(1)
    for p in video.VECTOR_DEFAULTS:
        values = [int(v) for v in rng.integers(-1023, 1024, 300)] + list(range(-20, 21))
        w = BoolWriter()
        for v in values:
            video.write_component(w, list(p), v)
        r = BoolReader(w.bytes())
        assert [video.read_component(r, list(p)) for _ in values] == values


def test_near_vectors():
    b = lambda v, ref=video.LAST: video.Block(ref, v)
    none = [False] * 4
    assert video.near_vectors(video.Block(), video.Block(), video.Block(), 1, none) == ([(0, 0)] * 3, [0, 0, 0, 0])
    assert video.near_vectors(b((4, 2)), b((4, 2)), b((0, 0)), 1, none) == ([(4, 2), (4, 2), (0, 0)], [1, 4, 0, 0])
    assert video.near_vectors(b((4, 2)), b((8, 8)), b((8, 8)), 1, none)[0] == [(8, 8), (8, 8), (4, 2)]
    flipped = [False, False, True, False]
    assert video.near_vectors(b((4, 2), video.GOLDEN), video.Block(), video.Block(), 1, flipped)[0][1] == (-4, -2)
    assert video.chroma_vector((3, -3)) == (2, -2) and video.chroma_vector((2, -2)) == (1, -1)
    assert video.mean_vector([(1, -1)] * 4) == (1, -1) and video.mean_vector([(1, -1), (0, 0), (0, 0), (0, 0)]) == (0, 0)


def test_whole_pixels_and_taps():
    plane = np.random.default_rng(2).integers(0, 256, (32, 32))
    assert (video.predicted(plane, 8, 8, 4, 4, (16, -8), True) == plane[10:14, 7:11]).all()
    flat = np.full((32, 32), 77)
    for six in (True, False):
        for v in ((2, 0), (0, 6), (4, 4), (-300, 300)):
            assert (video.predicted(flat, 8, 8, 16, 16, v, six) == 77).all()


def test_references():
    s = video.State()
    s.rotate(["k"], 0, 0, True, True, True)
    s.rotate(["a"], 0, 0, False, False, True)
    s.rotate(["b"], 1, 2, False, False, False)  # the alternate takes the last, golden then the new alternate
    assert s.references == {video.LAST: ["a"], video.ALTERNATE: ["a"], video.GOLDEN: ["a"]}


def test_corruption():
    enc = video.VideoEncoder(50)
    frames = list(clip(33, 33, 2))
    key, inter = enc.encode_key(*frames[0])[0], enc.encode_inter(*frames[1])[0]
    with pytest.raises(Invalid):
        video.VideoDecoder().decode(inter)
    rng = np.random.default_rng(3)
    for i in rng.integers(0, len(inter), 40):
        dec = video.VideoDecoder(limit=1 << 14)
        dec.decode(key)
        try:
            dec.decode(inter[:i] + bytes([inter[i] ^ 1 << int(rng.integers(8))]) + inter[i + 1 :])
        except (Invalid, Unsupported):
            pass
