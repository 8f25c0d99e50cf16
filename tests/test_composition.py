"""Composed clips against drawing every frame pixel by pixel."""

from rasterloom import plans  # noqa: F401
from rasterloom.plans import grids
from rasterloom.plans.registry import QUERIES


def over(src, dst):
    a = src >> 24
    if a == 255:
        return src
    return sum((((src >> s & 255) + ((dst >> s & 255) * (256 - a) >> 8)) & 255) << s for s in (0, 8, 16, 24))


def drawn(frames):
    """Canvases of (px, argb) in order."""
    prev, last, out = [0] * 64, None, []
    for px, argb in frames:
        full = px[2] % 4 == 0
        x, y, w, h = (0, 0, 8, 8) if full else (px[0] % 2 * 2, px[1] % 3, 4, 5)
        blend, dispose = px[3] % 2 == 0, px[4] % 3 == 0
        inside = lambda r, p: r[0] <= p % 8 < r[0] + r[2] and r[1] <= p // 8 < r[1] + r[3]
        key = last is None or not blend and full or last["dispose"] and (last["full"] or last["key"])
        canvas = [0] * 64 if key else prev[:]
        for p in range(64):
            if inside((x, y, w, h), p):
                keep = not blend or key or last["dispose"] and inside(last["at"], p)
                canvas[p] = argb[p] if keep else over(argb[p], prev[p])
        out.append(canvas)
        prev = [0 if dispose and inside((x, y, w, h), p) else v for p, v in enumerate(canvas)]
        last = {"dispose": dispose, "full": full, "key": key, "at": (x, y, w, h)}
    return out


def test_composition_takes_every_tile(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3), rng.uniform(-1, 1, 64).astype("float32").tolist()) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    px = {r.vec_id: r.px for r in grids.tiles(spark, str(tmp_path)).collect()}
    argb = {r.vec_id: r.argb for r in grids.argb_tiles(spark, str(tmp_path)).collect()}
    want = []
    for clip in range(3):
        ids = [i for i, _, _ in rows if i // 20 == clip]
        for i, canvas in zip(ids, drawn([(px[i], argb[i]) for i in ids])):
            want += [(i, p // 8, p % 8, v) for p, v in enumerate(canvas)]
    got = QUERIES["j02_composition"](spark, str(tmp_path)).select("vec_id", "y", "x", "argb").collect()
    assert sorted(map(tuple, got)) == sorted(want)
