"""The general operators against brute force, with nulls, empty tables, hot keys and clashing columns."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quadrel.operators.hierarchy import FINISH, descendants, hierarchy, links_of
from quadrel.operators.key_totals import distinct_profile, heavy_values
from quadrel.operators.orphans import INLINE_BASE, doubtful_share, orphan_references, orphan_report
from quadrel.operators.wide import Registers, cell_faults, read_value, wide_table

QUAD = "id long, subject long, predicate long, object long, graph long, loaded_at timestamp_ntz"


# ---------------------------------------------------------------- hierarchies

def brute(links):
    parent = {}
    for c, p in sorted((c, p) for c, p in links if c is not None and p is not None):
        parent.setdefault(c, p)
    out = {}
    for n in {x for link in links if None not in link for x in link}:
        path, seen, x = [n], {n}, n
        while x in parent and parent[x] not in seen:
            x = parent[x]
            path.append(x)
            seen.add(x)
        if x not in parent:
            out[n] = (x, len(path) - 1, path[::-1])
        else:
            loop, y = [x], parent[x]
            while y != x:
                loop.append(y)
                y = parent[y]
            out[n] = (min(loop), -1, None)
    return out


def sizes(links):
    """The node and everything that leads up to it."""
    parent, below = {}, {}
    for c, p in sorted((c, p) for c, p in links if c is not None and p is not None):
        parent.setdefault(c, p)
    for n in {x for link in links if None not in link for x in link}:
        x, seen = n, set()
        while x is not None and x not in seen:
            seen.add(x)
            below.setdefault(x, set()).add(n)
            x = parent.get(x)
    return {n: len(b) for n, b in below.items()}


def check_tree(spark, links):
    df = spark.createDataFrame([(c, p, "x") for c, p in links], "child long, parent long, path string")
    want = brute(links)
    for finish in (0, 20, FINISH):  # all rounds distributed, the last ones in one task, all in one task
        rows = hierarchy(df, paths=True, finish=finish).collect()
        assert {r["node"]: (r["root"], r["depth"], r["path"]) for r in rows} == want and len(rows) == len(want)
        assert {r["node"]: r["size"] for r in rows} == sizes(links)
        assert {r["node"]: (r["root"], r["depth"]) for r in hierarchy(df, finish=finish).collect()} == {n: v[:2] for n, v in want.items()}


def test_trees_with_cycles_and_a_long_chain(spark):
    r = random.Random(4)
    links = [(i, r.randrange(max(1, i - 9), i) if i % 40 else None) for i in range(2, 160)]  # a forest
    links += [(1000 + i, 1000 + i + 1) for i in range(70)]  # a chain
    links += [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2001), (2004, 2003)]  # a cycle with a tail
    links += [(3000, 3000), (3001, 3000), (4000, 4001), (4001, 4000)]  # its own parent; a pair
    links += [(1005, 1006)] * 3 + [(None, 5), (5, None)]
    links += [(5000 + i, 5000) for i in range(1, 90)]  # one parent of many
    check_tree(spark, links)


def test_tree_edge_cases(spark):
    check_tree(spark, [])
    check_tree(spark, [(1, 2)])
    check_tree(spark, [(-5, 2**40), (7, -5), (7, 3)])  # two parents: the smallest stays, the other is a root


def test_links_and_descendants(spark):
    quads = spark.createDataFrame([(1, 2, 28, 1, 9, None), (2, 1, 29, 3, None, None), (3, 2, 28, 1, 8, None), (4, 4, 28, None, 8, None), (5, 4, 30, 1, 8, None)], QUAD)
    links = links_of(quads, 28, 29)
    assert sorted(tuple(r) for r in links.collect()) == [(2, 1), (3, 1)]
    tree = hierarchy(spark.createDataFrame([(2, 1), (3, 2), (4, 2)], "child long, parent long"), paths=True)
    assert sorted(tuple(r) for r in descendants(tree).collect()) == [(1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 3, 1), (2, 4, 1)]


def test_descendants_on_and_below_cycles(spark):
    links = [(1, 2), (2, 3), (3, 1), (10, 2), (11, 10), (12, 11), (13, 10), (14, 3), (20, 20), (21, 20), (22, 21), (31, 30), (32, 31), (40, 41), (41, 40)]
    links += [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200, 104), (201, 200)]
    parent, want = dict(links), set()
    for node in parent:
        above, far, seen = parent[node], 1, {node}
        while above is not None and above not in seen:
            seen.add(above)
            want.add((above, node, far))
            above, far = parent.get(above), far + 1
    for finish in (0, 12, FINISH):
        tree = hierarchy(spark.createDataFrame(links, "child long, parent long"), paths=True, finish=finish)
        assert sorted(tuple(r) for r in descendants(tree).collect()) == sorted(want)
    assert tree.count() == len(set(parent) | set(parent.values()))


# ---------------------------------------------------------------- skewed keys

def test_heavy_values(spark):
    rows = [(1, 10 if i % 3 else None, 5 if i < 8 else i) for i in range(20)]
    df = spark.createDataFrame(rows, "n long, g long, p long")
    got = {(r["field"], r["value"], r["n"]) for r in heavy_values(df, ["p", "g"], 0.05).collect()}
    assert got == {("p", 5, 8), *(("p", i, 1) for i in range(8, 20)), ("g", 10, 13)}
    assert {r["value"] for r in heavy_values(df, ["p", "g"], 0.4).collect()} == {5, 10}
    assert heavy_values(df.limit(0), ["p", "g"], 0.05).count() == 0


def test_distinct_profile(spark):
    rows = [(1, None, 5, "a"), (1, None, 5, "b"), (1, 2, None, None), (1, 2, 7, "a")] * 3
    df = spark.createDataFrame(rows, "p long, g long, s long, n string")
    got = {tuple(r) for r in distinct_profile(df, ["g", "p"], {"s": "subjects", "n": "names"}).collect()}
    assert got == {(None, 1, 6, 1, 2), (2, 1, 6, 1, 1)}
    assert distinct_profile(df.limit(0), ["g"], {"s": "x"}).count() == 0


# ---------------------------------------------------------------- orphans

def test_orphans_against_brute_force(spark):
    r = random.Random(1)
    t0 = datetime(2021, 1, 1)
    when = lambda: t0 + timedelta(hours=r.randrange(24 * 200))
    keys = [0, 5, 32767, 32768, 40000, 70000, -3, 2**40]
    parents = []
    for k in keys[:-1]:
        for _ in range(r.randrange(0, 3)):
            a = when()
            parents.append((k, a, a + timedelta(hours=r.randrange(24 * 90)) if r.random() < 0.6 else None, "x"))
    parents += [(40000, None, None, "never"), (None, t0, None, "no id"), (5, datetime(2021, 3, 1), datetime(2021, 2, 1), "backwards")]
    quads = [(i, r.choice(keys), 1, r.choice([*keys, None, INLINE_BASE + 3]), None, when()) for i in range(300)]
    quads += [(900, 5, 1, 5, None, None), (901, None, 1, 5, None, t0)] + [(1000 + i, 70000, 1, 2**40, None, datetime(2021, 5, 5)) for i in range(200)]  # one hot missing key
    quads += [(2000, parents[0][0], 1, None, None, parents[0][1]), (2001, parents[0][0], 1, None, None, parents[0][1] - timedelta(microseconds=1))]
    live = lambda k, at: at is not None and any(p == k and a is not None and a <= at and (d is None or d > at) for p, a, d, _ in parents)
    want = sorted((q[0], n) for q in quads for n, k in (("subject", q[1]), ("object", q[3])) if k is not None and k < INLINE_BASE and not live(k, q[5]))
    qs = spark.createDataFrame(quads, QUAD).withColumn("key", F.lit("clash"))
    ps = spark.createDataFrame(parents, "id long, added_at timestamp_ntz, deleted_at timestamp_ntz, value string")
    got = orphan_references(qs, ps)
    assert sorted((r["quad_id"], r["position"]) for r in got.collect()) == want
    report = orphan_report(got, "quads").collect()
    assert sum(r["orphans"] for r in report) == len(want) and {r["table_name"] for r in report} == {"quads"}
    assert orphan_references(qs.limit(0), ps).count() == 0
    share = doubtful_share(qs, ps).first()
    assert 0 < share["doubtful"] <= share["suspects"] <= share["keys"] <= 2 * len(quads)
    every = sum(1 for q in quads for k in (q[1], q[3]) if k is not None and k < INLINE_BASE)
    assert orphan_references(qs, ps.limit(0)).count() == every


# ---------------------------------------------------------------- wide tables

@pytest.mark.parametrize(
    "kind, text, ok",
    [
        ("int", " +12\n", True), ("int", "1.0", False), ("int", "", False), ("int", "１２", False), ("int", "\xa012", False), ("decimal", "-1.50", True), ("decimal", "1.", False), ("decimal", ".5", False), ("decimal", "1e3", False), ("double", "1e-3", True), ("double", "1E+3", True),
        ("double", "1e", False), ("double", "NaN", False), ("boolean", "TRUE", True), ("boolean", "yes", False), ("date", "2020-02-29", True), ("date", "2021-02-29", False), ("date", "0000-01-01", False), ("date", "2020-2-1", False),
        ("timestamp", "2020-01-01T00:00:00", True), ("timestamp", "2020-01-01T23:59:59.123456Z", True), ("timestamp", "2020-01-01T24:00:00", False), ("timestamp", "2020-01-01T00:00:00.1234567", False), ("timestamp", "2020-01-01T00:00:00+02:00", True), ("timestamp", "2020-01-01T00:00:00+0200", False), ("timestamp", "2020-01-01 00:00:00", False),
        ("string", " any ", True), ("date", "2020-01-01\n\n", True), ("int", "12\n3", False),
    ],
)
def test_reading(kind, text, ok):
    assert (read_value(kind, text, False) is not None) is ok


def test_equal_values():
    v = lambda k, t: read_value(k, t, False)
    assert v("int", "+007") == v("int", "7") and v("decimal", "1.50") == v("decimal", "+1.5") and v("double", "1e2") == v("double", "100") and v("boolean", "1") == v("boolean", "true")
    assert v("timestamp", "2020-01-01T02:00:00.5+02:00") == v("timestamp", "2020-01-01T00:00:00.500Z") == v("timestamp", "2020-01-01T00:00:00.5")
    assert v("decimal", "1." + "0" * 60 + "1") != v("decimal", "1." + "0" * 60 + "2")
    assert v("timestamp", "0001-01-01T00:00:00+23:00") is not None
    assert read_value("iri", "http://a", True) == "http://a" and read_value("iri", "http://a", False) is None


def test_numerals_of_any_length_are_exact(spark):
    one, other = "1" * 12_000 + "2", "1" * 12_000 + "3"
    texts = {"int": [one, other, "+00" + one, "-" + one], "decimal": [one + ".50", other + ".5", "0" + one + ".5", "-" + one]}
    for kind, (a, b, same, minus) in texts.items():
        x, y, z, m = (read_value(kind, t, False) for t in (a, b, same, minus))
        assert x == z and hash(x) == hash(z) and m < x < y
    assert read_value("int", "-" + "0" * 5000 + "7", False) == -7 and read_value("int", "-0", False) == 0
    assert read_value("decimal", "0." + "0" * 11_000 + "1", False) != 0
    quads = spark.createDataFrame([(1, 5, 1, 10, None, None), (2, 5, 1, 11, None, None), (3, 6, 1, 10, None, None), (4, 6, 1, 12, None, None), (5, 5, 2, 10, None, None), (6, 5, 2, 11, None, None)], QUAD)
    attributes = spark.createDataFrame([(1, "n", "int", False), (2, "d", "decimal", False)], "predicate long, column_name string, value_type string, multi_valued boolean")
    terms = spark.createDataFrame([(10, one, 17), (11, other, 17), (12, "0" + one, 17)], "id long, value string, type int")
    assert {tuple(r) for r in cell_faults(quads, attributes, terms).collect()} == {(5, "n", "conflict"), (5, "d", "conflict")}


def test_mergers_are_associative():
    r = random.Random(3)
    ops = Registers([("a", "int", False), ("b", "string", True), ("c", "date", False)])
    cells = [(r.randrange(3), r.choice(["1", "2", "x", "2020-01-01", None]), False) for _ in range(40)]
    whole = ops.create(cells[0])
    for c in cells[1:]:
        whole = ops.add(whole, c)
    for _ in range(5):
        r.shuffle(cells)
        cut = r.randrange(1, 39)
        halves = []
        for part in (cells[:cut], cells[cut:]):
            reg = ops.create(part[0])
            for c in part[1:]:
                reg = ops.add(reg, c)
            halves.append(reg)
        assert ops.merge(*halves) == whole


def wide_input(spark):
    terms = [(1, 2, "http://a"), (2, 22, "12"), (3, 22, " 12 "), (4, 22, "x"), (5, 22, "13"), (6, 1, "b0"), (7, 22, "2020-02-30"), (8, 22, "99999999999999999999"), (10, 2, "p"), (11, 22, None)]
    attributes = [(100, "n", "int", False), (101, "tags", "string", True), (102, "link", "iri", False), (103, "day", "date", None), (104, "subject", "boolean", False)]
    quads = [
        (1, 50, 100, 2, 1), (2, 50, 100, 3, 2), (3, 50, 100, 2, None), (4, 51, 100, 2, 1), (5, 51, 100, 5, 1), (6, 51, 100, 4, 1), (7, 52, 100, INLINE_BASE + 7, 1), (8, 52, 101, INLINE_BASE + 7, 1), (9, 52, 101, 4, 1), (10, 52, 101, 4, 3),
        (11, 53, 102, 1, 1), (12, 53, 102, 4, 1), (13, 54, 102, 6, 1), (14, 54, 103, 7, 1), (15, 55, 100, None, 1), (16, 55, 101, 999, 1), (17, None, 100, 2, 1), (18, 56, 999, 2, 1), (19, 57, 100, 8, 1), (20, 58, 104, INLINE_BASE + 1, 1), (21, 59, 101, 11, 1),
    ]
    quads += [(100 + i, 60, 101, INLINE_BASE + i % 5, 1) for i in range(300)]  # a hot entity
    q = spark.createDataFrame([(*x, None) for x in quads], QUAD).withColumn("text", F.lit("clash"))
    t = spark.createDataFrame([(a, b, c, "x") for a, b, c in terms], "id long, type int, value string, subject string")
    a = spark.createDataFrame(attributes, "predicate long, column_name string, value_type string, multi_valued boolean")
    return q, a, t


def test_wide_table(spark):
    q, a, t = wide_input(spark)
    assert {tuple(r) for r in cell_faults(q, a, t).collect()} == {(51, "n", "untyped"), (51, "n", "conflict"), (53, "link", "untyped"), (54, "day", "untyped")}
    got = {r["subject"]: r for r in wide_table(q, a, t).collect()}
    assert set(got) == {50, 51, 52, 53, 54, 55, 57, 58, 59, 60}
    assert got[50]["n"] == 12 and got[51]["n"] is None and got[52]["n"] == 7 and got[52]["tags"] == ["7", "x"]
    assert got[53]["link"] == "http://a" and got[54]["link"] == "b0" and got[55]["n"] is None and got[57]["n"] is None
    assert got[58]["attr_subject"] is True and got[59]["tags"] is None and got[60]["tags"] == ["0", "1", "2", "3", "4"]
    assert wide_table(q.limit(0), a, t).count() == 0 and wide_table(q, a.limit(0), t).columns == ["subject"]
    assert cell_faults(q, a, t.limit(0)).count() == 0
