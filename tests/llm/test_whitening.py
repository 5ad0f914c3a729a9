import math

import numpy as np
import pytest

from ledgerloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, v int"


def plain(rows, components=8):
    """(vec_id, deviation, |whitened| by component, explained) the direct way, over Python's own numbers."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in [*v, *[0.0] * (size - len(v))]] for _, v in kept]
    n = len(x)
    s = [sum(col) for col in zip(*x)]
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    centred = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x]).reshape(n, size)
    values, axes = np.linalg.eigh(centred.T @ centred / max(n, 1))
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return kept, deviation, centred @ axes, values, n


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], SCHEMA)
    return sorted(whitening.whiten(df, **more).collect(), key=lambda r: (r["vec_id"] is not None, r["vec_id"], r["component"]))


@pytest.mark.parametrize("size, tile", [(5, 2), (11, 4), (70, 32), (3, 32)])
def test_against_the_direct_way(spark, monkeypatch, size, tile):
    monkeypatch.setattr(whitening, "TILE", tile)
    rnd = np.random.default_rng(size)
    rows = [(k, (rnd.normal(size=size) * np.arange(1, size + 1)).tolist()) for k in range(300)]
    rows += [(900, None), (901, [None] + [0.0] * (size - 1)), (902, [math.nan] * size), (903, [math.inf] * size), (904, [-math.inf] * size)]
    rows += [(k, rows[7][1]) for k in range(400, 500)]  # one very common vector
    got = run(spark, rows)
    kept, deviation, along, values, n = plain(rows)
    want = {i: (d, a) for (i, _), d, a in zip(kept, deviation, along)}
    wide = min(size, 8)
    assert len(got) == n * wide and {r["n"] for r in got} == {n}
    signs = {}
    for r in got:
        d, a = want[r["vec_id"]]
        k = r["component"] - 1
        assert int(r["deviation"]) == d
        w = a[k] / math.sqrt(values[k])
        sign = signs.setdefault(k, math.copysign(1, w * r["whitened"]))
        assert sign * r["whitened"] == pytest.approx(w, abs=1e-9)
    white = np.array([r["whitened"] for r in got]).reshape(n, wide)
    error = np.abs((white - white.mean(0)).T @ (white - white.mean(0)) / n - np.eye(wide)).max()
    assert got[0]["identity_error"] < 1e-9 and error < 1e-9
    total = sum(plain(rows, 99)[3])
    assert [r["explained"] for r in got[:wide]] == pytest.approx((values / total).tolist(), rel=1e-9)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [math.nan]), (3, [])]) == []
    one = run(spark, [(None, [1.0, 2.0]), (None, [1.0, 2.0])])  # no variance at all
    assert [(r["vec_id"], r["component"], r["whitened"], r["deviation"], r["explained"], r["identity_error"]) for r in one] == [(None, c, 0.0, 0, 0.0, 0.0) for c in (1, 1, 2, 2)]
    flat = run(spark, [(k, [float(k), 2.0 * k]) for k in range(9)])  # one direction only
    assert {r["whitened"] for r in flat if r["component"] == 2} == {0.0} and flat[0]["explained"] == pytest.approx(1)
    ragged = run(spark, [(1, [1.0]), (2, [1.0, 5.0]), (3, [2.0, 1.0])])
    assert len(ragged) == 6


def test_sums_beyond_a_long_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e30]), (2, [1.0])])
    big = run(spark, [(k, [1e6 * k, 3.0]) for k in range(200)])  # deviations beyond a long stay exact
    assert int(big[0]["deviation"]) == plain([(k, [1e6 * k, 3.0]) for k in range(200)])[1][0]
