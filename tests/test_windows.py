"""Golden values of window functions and frames."""

import pytest

from quadrel.plans.compiler import Engine
from quadrel.sources.store import TermStore, term_frame

# The series and the averages of its frames, which any implementation has to give.
SERIES = "VALUES (?date ?value) { (1 1.0) (2 2.0) (3 3.0) (4 -2.0) (5 8.0) (6 2.7) (7 -1.7) }"
FRAMES = {
    "2 PRECEDING AND CURRENT ROW": [1.0, 1.5, 2.0, 1.0, 3.0, 2.9, 3.0],
    "3 PRECEDING AND CURRENT ROW": [1.0, 1.5, 2.0, 1.0, 2.75, 2.925, 1.75],
    "CURRENT ROW AND UNBOUNDED": [1.857, 2.0, 2.0, 1.75, 3.0, 0.5, -1.7],
    "2 PRECEDING AND 1 PRECEDING": [0.0, 1.0, 1.5, 2.5, 0.5, 3.0, 5.35],
    "CURRENT ROW AND 1 FOLLOWING": [1.5, 2.5, 0.5, 3.0, 5.35, 0.5, -1.7],
    "UNBOUNDED AND 1 PRECEDING": [0.0, 1.0, 1.5, 2.0, 1.0, 2.4, 2.45],
    "1 FOLLOWING AND UNBOUNDED": [2.0, 2.0, 1.75, 3.0, 0.5, -1.7, 0.0],
    "1 FOLLOWING AND 3 FOLLOWING": [1.0, 3.0, 2.9, 3.0, 0.5, -1.7, 0.0],
    "UNBOUNDED AND 1 FOLLOWING": [1.5, 2.0, 1.0, 2.4, 2.45, 1.857, 1.857],
    "1 PRECEDING AND 2 FOLLOWING": [2.0, 1.0, 2.75, 2.925, 1.75, 3.0, 0.5],
    "2 PRECEDING AND UNBOUNDED": [1.857, 1.857, 1.857, 2.0, 2.0, 1.75, 3.0],
    "UNBOUNDED AND UNBOUNDED": [1.857] * 7,
}


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(TermStore(term_frame(spark, []), ["http://none"]))


@pytest.mark.parametrize("frame", FRAMES)
def test_frames(engine, frame):
    got = engine.query(f"SELECT ?date (AVG(?value) OVER (ORDER BY ?date ROWS BETWEEN {frame}) AS ?x) {{ {SERIES} }} ORDER BY ?date").collect()
    assert [float(r["x"]) for r in got] == pytest.approx(FRAMES[frame], abs=1e-3)


def values(pairs):
    return "VALUES (?row ?p ?v) { " + " ".join(f"({i} {p} {v})" for i, (p, v) in enumerate(pairs)) + " }"


def column(engine, function, pairs, over="PARTITION BY ?p ORDER BY ?v"):
    return [r["x"] for r in engine.query(f"SELECT ?row ({function} OVER ({over}) AS ?x) {{ {values(pairs)} }} ORDER BY ?row").collect()]


# Ranks and tiles of tied rows.
def test_ranks(engine):
    pairs = [(1, 1), (1, 2), (1, 2), (1, 3), (2, 5), (2, 5), (2, 6)]
    assert column(engine, "RANK()", pairs) == [1, 2, 2, 4, 1, 1, 3]
    assert column(engine, "DENSE_RANK()", pairs) == [1, 2, 2, 3, 1, 1, 2]
    assert column(engine, "ROW_NUMBER()", [(1, 3), (1, 1), (2, 9)]) == [2, 1, 1]
    assert column(engine, "RANK()", [(1, 3), (1, 1)], "PARTITION BY ?p") == [1, 1]


def test_ranks_over_all_rows(engine):
    pairs = [(0, v) for v in (5, 3, 5, 1, 9, 3, 3, 8, 1, 2)]
    values_ = [v for _, v in pairs]
    down = "ORDER BY DESC(?v)"
    assert column(engine, "RANK()", pairs, "ORDER BY ?v") == [1 + sum(x < v for x in values_) for v in values_]
    assert column(engine, "DENSE_RANK()", pairs, down) == [1 + len({x for x in values_ if x > v}) for v in values_]
    assert column(engine, "ROW_NUMBER()", pairs, "ORDER BY ?v ?row") == [1 + sum((x, j) < (v, i) for j, x in enumerate(values_)) for i, v in enumerate(values_)]
    assert engine.query("SELECT ?x (RANK() OVER (ORDER BY ?x) AS ?r) { VALUES ?x { 1 } FILTER(?x > 1) }").count() == 0


def test_ntile_deals_out_peer_groups(engine):
    assert column(engine, "NTILE(2)", [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5)]) == [1, 1, 1, 2, 2]
    assert column(engine, "NTILE(3)", [(1, v) for v in (1, 1, 2, 3, 3)]) == [1, 1, 2, 3, 3]
    # ties: seven rows in five groups and five tiles
    assert column(engine, "NTILE(5)", [(1, v) for v in (10, 10, 30, 40, 20, 10, 50)]) == [1, 1, 3, 4, 2, 1, 5]
    assert column(engine, "NTILE(5)", [(1, 1), (1, 2)]) == [1, 2]


def test_window_aggregates_and_having(engine):
    pairs = [(1, 4), (1, 6), (2, 1)]
    assert column(engine, "SUM(?v)", pairs, "PARTITION BY ?p") == [10, 10, 1]
    assert column(engine, "GROUP_CONCAT(?v)", pairs, "PARTITION BY ?p ORDER BY ?v ROWS BETWEEN UNBOUNDED AND CURRENT ROW") == ["4", "4 6", "1"]
    assert column(engine, "COUNT(*)", pairs, "ORDER BY ?row ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING") == [0, 1, 1]
    got = engine.query(f"SELECT ?p (COUNT(*) AS ?n) (RANK() OVER (ORDER BY DESC(COUNT(*))) AS ?r) {{ {values(pairs)} }} GROUP BY ?p HAVING (RANK() OVER (ORDER BY DESC(COUNT(*))) < 2)").collect()
    assert [tuple(r) for r in got] == [(1, 2, 1)]
