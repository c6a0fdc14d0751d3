"""Hard negatives against brute force: ties, shared ids, odd vectors, several tiles and rounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import hard_negatives as HN
from corpuslab.llm.hard_negatives import Tile, hard_negatives, labelled_vectors, spanning_tree


def brute(rows, anchors, positives=5, negatives=10, least=30, most=90):
    """Of (id, label, vector) rows; anchors by id, the least row of each."""
    asks = {}
    for i, label, v in anchors:
        asks[i] = min(asks.get(i, (label, v)), (label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, v) in asks.items():
        ranked = sorted((-dot(v, w), i, x) for i, x, w in rows if i != a)
        for s, p, _ in [x for x in ranked if x[2] == label][:positives]:
            found = [x for x in ranked if x[2] != label and least * -s <= 100 * -x[0] <= most * -s][:negatives]
            out += [(a, p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(found)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label long, v array<long>")


@pytest.mark.parametrize("sizes", [(256, 4096, 256), (3, 7, 2)])
def test_against_brute_force(spark, monkeypatch, sizes):
    for name, n in zip(("TILE", "BLOCK", "TILES"), sizes, strict=True):
        monkeypatch.setattr(HN, name, n)
    rng = random.Random(6)
    rows = []
    for i in range(400):
        c = rng.randrange(4)
        rows.append((i, c % 3, [rng.randint(-2, 2) + (9 if j == c else 0) for j in range(5)]))
    rows += [rows[10], rows[10], (20, 1, [1, 2, 3, 4, 5]), (7, 0, [9, 9]), (1000, 5, [1, 1, 1, 1, 1]), (1001, 6, []), (40, 2, [0, 0, 0, 0, 0])]
    anchors = [r for r in rows if r[0] % 10 == 0]
    want = brute(rows, anchors)
    got = hard_negatives(table(spark, rows).repartition(5), table(spark, anchors))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500


def test_empty_tables(spark):
    rows = table(spark, [(1, 0, [1, 2]), (2, 0, [1, 2])])
    assert hard_negatives(rows, rows.limit(0)).count() == 0 and hard_negatives(rows.limit(0), rows).count() == 0
    assert hard_negatives(rows, rows).count() == 0  # no other label


def test_rows_that_take_part(spark):
    data = [(7, [0.5, -0.001], 9), (8, [0.5, None], 1), (9, [float("nan")], 1), (10, [float("inf")], 1), (11, None, 1), (12, [1.0], None), (None, [1.0], 1), (14, [1.0], -1), (15, [], 2)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in ("v", "part", "seq", "round")})
    assert [tuple(r) for r in labelled_vectors(df).orderBy("vec_id").collect()] == [(7, 0, [128, -1]), (14, 0, [256]), (15, 2, [])]


def test_the_tree_spares_scores():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 100, (8, 16))
    near = lambda n: np.round(np.repeat(centres, n, axis=0) + rng.normal(0, 2, (8 * n, 16))).astype(np.int64)
    m = near(8)
    order, parent, edge = spanning_tree(m)
    assert sorted(order.tolist()) == list(range(64)) and parent[0] == -1 and all(p < i for i, p in enumerate(parent))
    row = {"ids": np.arange(64).tobytes(), "labels": np.repeat(np.arange(8), 8)[order].tobytes(), "parent": parent.astype(np.int64).tobytes(), "edge": edge.tobytes(), "matrix": m[order].tobytes(), "dims": 16}
    tile = Tile(row, None, 5)
    tile.begin()
    x = near(50)
    norm = np.sqrt((x.astype(float) ** 2).sum(1))
    scored = sum(tile.scan(np.arange(at, at + 40) + 1000, np.repeat(np.arange(8), 50)[at : at + 40], x[at : at + 40], norm[at : at + 40]) for at in range(0, 400, 40))
    assert scored < 64 * 400 / 4
    for i, (ids, s) in enumerate(f[0] for f in tile.found):
        all_s = m[order][i] @ x.T
        own = sorted((-int(v), 1000 + j) for j, v in enumerate(all_s) if j // 50 == tile.labels[i])[:5]
        assert own == [(-b, a) for a, b in zip(ids.tolist(), s.tolist(), strict=True)]
