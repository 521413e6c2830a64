from collections import deque

import numpy as np

from deluge.operators.neighbourhood import component_sizes, connected_pixel_count, slope_degrees


def brute(values, present, cap):
    h, w = values.shape
    out = np.zeros_like(values)
    for r in range(h):
        for c in range(w):
            if not present[r, c]:
                continue
            seen = {(r, c)}
            q = deque([(r, c)])
            while q:
                a, b = q.popleft()
                for da, db in ((0, 1), (0, -1), (1, 0), (-1, 0)):
                    x, y = a + da, b + db
                    if 0 <= x < h and 0 <= y < w and present[x, y] and values[x, y] == values[r, c] and (x, y) not in seen:
                        seen.add((x, y))
                        q.append((x, y))
            out[r, c] = min(len(seen), cap)
    return out


def test_component_sizes_vs_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(20):
        v = rng.integers(0, 2, size=(12, 15))
        p = rng.random((12, 15)) < 0.85
        got = np.minimum(component_sizes(v, p), 10)
        assert (np.where(p, got, 0) == brute(v, p, 10)).all()


def test_connected_count_across_tile_borders(spark):
    rng = np.random.default_rng(3)
    h, w = 45, 50
    v = rng.integers(0, 2, size=(h, w))
    p = rng.random((h, w)) < 0.9
    # shapes from the fixture list: a line of 9 and a line of 10 ones crossing a tile edge
    v[40, 0:9], p[40, 0:9] = 1, True
    v[42, 15:25], p[42, 15:25] = 1, True
    p[39, :], p[41, :], p[43, :] = False, False, False
    p[40, 9], p[42, 14], p[42, 25] = False, False, False
    rows = [(int(r), int(c), int(v[r, c])) for r in range(h) for c in range(w) if p[r, c]]
    df = spark.createDataFrame(rows, "row int, col int, v int")
    got = {(r.row, r.col): r["count"] for r in connected_pixel_count(df, "v", 10, tile=20).collect()}
    want = brute(v, p, 10)
    assert len(got) == int(p.sum())
    assert all(got[(r, c)] == want[r, c] for (r, c) in got)
    assert got[(40, 0)] == 9 and got[(42, 15)] == 10


def test_slope_flat_and_ramp(spark):
    rows = [(r, c, float(3 * c)) for r in range(4) for c in range(4)]
    df = spark.createDataFrame(rows, "row int, col int, elevation double")
    got = {(x.row, x.col): x.slope for x in slope_degrees(df, dx=30.0, dy=30.0).collect()}
    assert got[(0, 0)] is None and got[(3, 3)] is None
    assert abs(got[(1, 1)] - np.degrees(np.arctan(6 / 60))) < 1e-9


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from hypothesis.extra.numpy import arrays  # noqa: E402


@settings(max_examples=60, deadline=None)
@given(arrays(np.int64, st.tuples(st.integers(1, 9), st.integers(1, 9)), elements=st.integers(0, 2)),
       st.integers(0, 2 ** 31 - 1))
def test_component_sizes_property(values, seed):
    present = np.random.default_rng(seed).random(values.shape) < 0.8
    got = np.where(present, np.minimum(component_sizes(values, present), 10), 0)
    assert (got == brute(values, present, 10)).all()
