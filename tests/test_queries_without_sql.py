"""Queries that SQL can't give: against what must hold of their rows, or trying all ways."""

import itertools

import numpy as np

from rasterloom import plans  # noqa: F401
from rasterloom.operators import lossy
from rasterloom.plans import grids
from rasterloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_frames_decode_as_they_were_rebuilt(spark):
    rows = QUERIES["k11_lossy_rebuild"](spark, SF).collect()
    assert len(rows) == 375 and all(r.exact for r in rows)
    # more quality, less error and more bytes; 384 samples a picture
    by = {q: [r for r in rows if r.quality == q] for q in (20, 75, 95)}
    assert np.mean([r.sse for r in by[95]]) < np.mean([r.sse for r in by[75]]) < np.mean([r.sse for r in by[20]])
    assert max(r.sse / 384 for r in by[95]) < 30 and np.mean([r.size for r in by[95]]) > np.mean([r.size for r in by[20]])


def test_clips_decode_as_they_were_rebuilt(spark):
    rows = QUERIES["k04_video_round_trip"](spark, SF).collect()
    assert len(rows) == 125 and all(r.exact and r.key_frame == (r.frame_no == 0) for r in rows)
    assert max(r.sse / 384 for r in rows) < 400


def test_inter_choice(spark):
    """The same picture again is taken from the one before, most negatives aren't."""
    rows = QUERIES["i03_inter_choice"](spark, SF).collect()
    assert all(r.moved == 1 for r in rows if r.place == 1) and np.mean([r.moved for r in rows if r.place == 2]) < 0.5


def test_stream_choice(spark):
    rows = QUERIES["i07_stream_choice"](spark, SF).collect()
    assert len(rows) == 25 and all(0 < r.tried <= r.plain for r in rows)


def test_trellis_is_the_best_of_all(spark):
    """Against every choice of rounding down or up, and of where to end."""
    odds = lossy.Tables().coefficients[lossy.WHOLE_LUMA].tolist()
    got, px = {}, {r.vec_id: r.px for r in grids.tiles(spark, SF).limit(12).collect()}
    for r in QUERIES["h05_trellis"](spark, SF).collect():
        got.setdefault(r.vec_id, {})[r.i] = r.level
    for i, tile in px.items():
        c = [(v - 128) >> (k // 3) for k, v in enumerate(tile[:16])]
        steps = [20] + [24] * 15

        def cost(levels):
            error = sum((abs(a) - abs(v) * q) ** 2 for a, v, q in zip(c, levels, steps))
            return error + 24**2 / 8 * lossy.block_price(odds, 0, 0, levels)

        ways = [[0] if not a else [np.sign(a) * (abs(a) // q), np.sign(a) * (abs(a) // q + 1)] for a, q in zip(c, steps)]
        ways = [[int(v) for v in w] for w in ways]
        # coefficients that could only be 0 or 1 may also be cut off at the end
        free = [k for k in range(16) if len(ways[k]) == 2][:9]
        mine = [got[i][k] for k in range(16)]
        best = min(cost([pick[free.index(k)] if k in free else mine[k] for k in range(16)]) for pick in itertools.product(*(ways[k] for k in free)))
        assert cost(mine) <= best + 1e-6
