"""Every query of the library with SQL gives the rows that DuckDB gives, on the smallest tables."""

import importlib
import itertools
from collections import Counter

import pytest

import __spark_entry__ as entry

from .oracle import connection, rows

SF = "/root/testdata/sf0.001"
QUERIES, SQL = {}, {}
for name in entry.MODULES:
    module = importlib.import_module(name)
    QUERIES |= module.QUERIES
    SQL |= module.ORACLE_SQL
#: Too many pairs for a quick run here; the driver compares them too.
SLOW = {"node_distance", "graph_overlap", "typed_similarity"}


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["svc_predict", "svc_predict_pairs", "logreg_predict", "logreg_predict_pairs", "linear_predict"])
def test_classifiers_on_held_out_rows(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    truth = [r.truth for r in rows]
    right = sum(r.truth == r.predicted for r in rows) / len(rows)
    assert right > max(truth.count(x) for x in set(truth)) / len(rows) and right > 0.75


def test_feature_classifier_and_margins(spark):
    rows = QUERIES["feature_classifier"](spark, SF).collect()
    truth = [r.truth for r in rows]
    assert sum(r.truth == r.predicted for r in rows) >= max(truth.count(x) for x in set(truth))
    m = QUERIES["svc_margins"](spark, SF).first()
    assert m.n > 0 and 1 <= m.mean_rank < 2 and m.top2 > 0.8 and m.mean_margin > 0


def test_graph_alignment_by_rows(spark, con):
    """The registered query against the best of all assignments, for the graphs with the first ids."""
    nodes = con.sql("SELECT DISTINCT l_orderkey, 's' || l_suppkey % 50, 'supplier' FROM lineitem WHERE l_suppkey % 50 <> 0 AND l_orderkey <= 40 UNION SELECT l_orderkey, 'p' || l_partkey % 40, min('part' || l_partkey % 3) FROM lineitem WHERE l_orderkey <= 40 GROUP BY ALL").fetchall()
    edges = con.sql("SELECT DISTINCT l_orderkey, 's' || l_suppkey % 50, 'p' || l_partkey % 40, l_returnflag FROM lineitem WHERE l_orderkey <= 40").fetchall()
    hist = {}
    for g, s, t, k in edges:
        hist.setdefault((g, s), Counter())[">" + k] += 1
        hist.setdefault((g, t), Counter())["<" + k] += 1
    graph = {}
    for g, i, kind in nodes:
        graph.setdefault(g, []).append((kind, hist.get((g, i), Counter())))
    cost = lambda x, y: (x[0] != y[0]) + sum(abs(x[1][k] - y[1][k]) for k in x[1] | y[1]) / (2 * max(1, x[1].total() + y[1].total()))
    got = {(r.a, r.b): r.alignment for r in QUERIES["graph_alignment"](spark, SF).filter("a <= 40").collect()}
    checked = 0
    for a, b in itertools.product(graph, [g for g in graph if g <= 4]):
        x, y = sorted((graph[a], graph[b]), key=len)
        if len(y) <= 6:
            best = min(sum(cost(p, y[j]) for p, j in zip(x, c, strict=True)) for c in itertools.permutations(range(len(y)), len(x)))
            assert abs(got[a, b] - max(0, 1 - best / len(x) / 2) * len(x) / len(y)) < 1e-5
            checked += 1
    assert checked > 20


def test_graph_retrieval(spark):
    r = QUERIES["graph_retrieval"](spark, SF).first()
    assert r.n == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count() and 0 < r.top1 <= r.top2 <= 1 and r.top1 <= r.mrr <= 1
