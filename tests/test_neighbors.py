import numpy as np
import pandas as pd
import pytest

from assayer.operators.neighbors import distinct_points, nearest


def brute(points, ids, row, k, target=None):
    """(id, distance) of the k nearest donors of one row, distances over shared coordinates."""
    width = points.shape[1]
    diff = points - row
    ok = ~np.isnan(diff)
    with np.errstate(divide="ignore", invalid="ignore"):
        square = np.where(ok, diff**2, 0).sum(axis=1) * (width / ok.sum(axis=1))
    square[ok.sum(axis=1) == 0] = np.inf
    if target is not None:
        square[np.isnan(points[:, target])] = np.inf
    order = sorted(zip(np.sqrt(square), ids))[:k]
    return [(int(i), s) for s, i in order if np.isfinite(s)]


def frame(spark, points):
    names = [f"c{i}" for i in range(points.shape[1])]
    pdf = pd.DataFrame(points, columns=names)
    pdf.insert(0, "id", np.arange(len(pdf)))
    return spark.createDataFrame(pdf), names


def check(spark, points, k, leaf_rows, targets=None):
    df, names = frame(spark, points)
    donors = distinct_points(df, "id", names, k)
    receivers = donors.where("id = rep").select("id", "point")
    got = nearest(receivers, donors, len(names), k, targets, leaf_rows=leaf_rows).toPandas()
    ids = np.arange(len(points))
    reps = receivers.toPandas()["id"].tolist()
    searches = [(r, None) for r in reps] if targets is None else [
        (r, t) for r in reps for t in targets if np.isnan(points[r, t])
    ]
    by = {key: part.sort_values("rank") for key, part in got.groupby(["rid", "target"])}
    for r, t in searches:
        want = brute(points, ids, points[r], k, t)
        part = by.get((r, -1 if t is None else t))
        have = [] if part is None else list(zip(part["did"].astype(int), part["dist"]))
        assert [i for i, _ in have] == [i for i, _ in want], (r, t)
        np.testing.assert_allclose([d for _, d in have], [d for _, d in want], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("leaf_rows", [None, 25])
@pytest.mark.parametrize("seed", [0, 1])
def test_complete_rows(spark, leaf_rows, seed):
    rng = np.random.default_rng(seed)
    check(spark, rng.normal(size=(300, 2)) * [1, 10], 5, leaf_rows)


def test_one_point_holds_a_third_of_the_rows(spark):
    rng = np.random.default_rng(2)
    points = np.round(rng.normal(size=(300, 2)), 1)
    points[::3] = [0.5, 0.5]
    check(spark, points, 4, 20)


@pytest.mark.parametrize("leaf_rows", [None, 20])
def test_incomplete_rows(spark, leaf_rows):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(250, 3)) * [1, 5, 2]
    points[rng.random(points.shape) < 0.3] = np.nan
    points[7] = np.nan  # comparable with nothing
    check(spark, points, 5, leaf_rows, targets=[0, 1, 2])


def test_blocks_split_on_both_sides(spark, monkeypatch):
    from assayer.operators import neighbors

    monkeypatch.setattr(neighbors, "BLOCK_DONORS", 30)
    monkeypatch.setattr(neighbors, "BLOCK_RECEIVERS", 20)
    check(spark, np.random.default_rng(6).normal(size=(200, 2)), 6, 60)


def test_fewer_donors_than_k(spark):
    check(spark, np.array([[0.0], [1.0], [5.0]]), 10, 10)


def test_a_leaf_that_shares_no_coordinate_is_not_visited():
    from assayer.operators.neighbors import _Boxes, _first_leaves

    have = np.array([[0.0, 9.0], [9.0, 7.0], [9.0, 9.0]])
    boxes = _Boxes(
        np.arange(3, dtype=np.int32), np.full(3, 9.0), np.array([[0.0, 0.0], [4.0, 0.0], [7.0, 0.0]]),
        np.array([[0.0, 9.0], [6.0, 9.0], [8.0, 9.0]]), have, have == 9,
    )
    points = np.array([[5.0, np.nan], [9.0, np.nan]])
    near = boxes.bounds(points)
    assert np.isinf(near[:, 0]).all() and np.isfinite(near[:, 1:]).all()
    assert (boxes.box_bounds(points) <= near.min(axis=0)).all()
    row, leaf = _first_leaves(near, have[:, 1], 5)
    assert list(zip(row.tolist(), leaf.tolist())) == [(0, 1), (1, 2)]
