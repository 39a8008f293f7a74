"""Parent-child links to full hierarchies.

Bottom-up leaf peeling: each round removes all leaves, which send their subtree's size to the parent and leave a record
(node, the node above it, distance). A forest of height h would take h rounds; so that a chain of a million links
doesn't, each round also contracts an independent set of the nodes with a single child (those whose hash is above both
neighbours'): the child is tied to the grandparent, and its link carries the distance, the size and the nodes in
between. Both kinds of removal leave the same record, and the number of rounds grows with the logarithm of the number
of links, whatever the depth. Once what is left holds at most FINISH nodes, one task peels it to the end in the same
way. The records read in reverse order of removal assign root, depth, path and the sizes of contracted nodes. What
peeling can't remove lies on a cycle; contraction shrinks each cycle to one node tied to itself.

Until then all rows stay distributed; each round writes its tables to the shared folder. Descendants are rows
(ancestor, node, distance), never a list in one cell: one root may hold a third of all nodes. They are whole on and
below cycles too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quadrel.runtime import Scratch

#: Living nodes, with the contracted ones that their links carry, which one task peels to the end: at most this many.
FINISH = 100_000


def links_of(quads: DataFrame, child_first: int, parent_first: int) -> DataFrame:
    """(child, parent) from two predicates that state the same link in opposite directions; each link once, no nulls."""
    forth = F.col("predicate") == child_first
    stated = quads.where(F.col("predicate").isin(child_first, parent_first))
    ends = stated.select(F.when(forth, F.col("subject")).otherwise(F.col("object")).alias("child"), F.when(forth, F.col("object")).otherwise(F.col("subject")).alias("parent"))
    return ends.dropna().distinct()


def _above(node, other, turn: int):
    """Whether a node's hash in this round is above another's; nodes above both neighbours are never neighbours."""
    return F.xxhash64(node, F.lit(turn)) > F.xxhash64(other, F.lit(turn))


# actions of a record
LIVES, PEELED, CONTRACTED, ANCHOR = 0, 1, 2, 3
_KNOWN = "node long, root long, depth long"
_WALKED = ", size long, path array<long>, walk array<long>, spot long, around long"


def _finish(batches: Iterator[pa.RecordBatch], paths: bool) -> Iterator[pa.RecordBatch]:
    """Peels what is left in one task: known rows of every node in (child, parent, w, lo[, own, ext, via])."""
    rows = [tuple(r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
    link = {r[0]: r for r in rows}
    kids: dict[int, list[int]] = defaultdict(list)
    for child, parent, *_ in rows:
        if parent is not None:
            kids[parent].append(child)
    left = {n: len(kids[n]) for n in link}
    size = {r[0]: r[4] for r in rows} if paths else {}
    order = [n for n, k in left.items() if not k]  # leaves first, each node after its last child
    for n in order:
        parent = link[n][1]
        if parent is None:
            continue
        if paths:
            size[parent] += size[n] + link[n][5]
        left[parent] -= 1
        if not left[parent]:
            order.append(parent)
    # the rest lies on cycles
    found: dict[int, tuple] = {}
    peeled = set(order)
    for n in link:
        if n in peeled or n in found:
            continue
        ring = [n]
        while (above := link[ring[-1]][1]) != n:
            ring.append(above)
        root = min(min(x, link[x][3] if link[x][3] is not None else x) for x in ring)
        if not paths:
            found |= {x: (x, root, -1) for x in ring}
            continue
        around = [y for x in reversed(ring) for y in (*link[x][6], x)]  # downwards from the node n
        whole = sum(size[x] + link[x][5] for x in ring)
        found |= {x: (x, root, -1, whole, None, [x], at, len(around)) for at, x in enumerate(around)}
    for n in reversed(order):
        _, parent, w, *more = link[n]
        if parent is None:
            found[n] = (n, n, 0, size[n], [n], None, None, None) if paths else (n, n, 0)
            continue
        up = found[parent]
        depth = -1 if up[2] < 0 else up[2] + w
        if not paths:
            found[n] = (n, up[1], depth)
            continue
        below = [*more[3], n]
        found[n] = (n, up[1], depth, size[n], None if up[4] is None else up[4] + below, None if up[5] is None else up[5] + below, up[6], up[7])
    long, many = pa.int64(), pa.list_(pa.int64())
    kinds = [long] * 4 + [many, many, long, long] if paths else [long] * 3
    names = ["node", "root", "depth", "size", "path", "walk", "spot", "around"][: len(kinds)]
    out = list(found.values())
    for start in range(0, len(out), 10_000):
        part = out[start : start + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)], names=names)


def hierarchy(links: DataFrame, paths: bool = False, finish: int = FINISH) -> DataFrame:
    """(node, root, depth[, size, path, walk, spot, around]) for every id that is a child or parent in `links` (child, parent: integers).

    depth is the number of links up to the root; path runs from the root to the node, both included; size is the
    number of nodes below, the node itself included (on a cycle: all nodes on and below it). A node on or below a
    cycle has the smallest id on that cycle as root, depth -1 and a null path; a node that is its own parent is a
    cycle. Links with a null end are no links, repeated links count once, a child with several parents keeps the
    smallest, no links give no rows. Other columns of `links` are ignored.

    walk, spot and around are null but on or below a cycle: walk runs from the nearest node on the cycle to the node,
    both included, spot is that first node's place on the cycle, counted downwards, and around the cycle's length.
    """
    spark = links.sparkSession
    scratch = Scratch(spark)
    none, via = F.lit(None).cast("long"), F.array().cast("array<bigint>")
    ends = links.select(F.col("child").cast("long").alias("child"), F.col("parent").cast("long").alias("parent")).dropna()
    # every node is a row: a root's parent is null, so min() finds the parent of any other
    nodes = ends.select(F.inline(F.array(F.struct("child", "parent"), F.struct(F.col("parent").alias("child"), none.alias("parent")))))
    edges = nodes.groupBy("child").agg(F.min("parent").alias("parent"))
    extra = [F.lit(1).cast("long").alias("own"), F.lit(0).cast("long").alias("ext"), via.alias("via")] if paths else []
    cols = ["child", "parent", "w", "lo", *(["own", "ext", "via"] if paths else [])]
    counted = F.sum(F.lit(1) + F.size("via")) if paths else F.count(F.lit(1))
    told = Observation()
    first = edges.select("child", "parent", F.lit(1).cast("long").alias("w"), none.alias("lo"), *extra)
    alive, records = scratch.write(first.observe(told, counted.alias("n"))), []
    living, turn = told.get["n"] or 0, 0
    while living > finish:
        edge = scratch.read(alive)
        # peel: a node stays if it is a parent of a living one
        heads = edge.where("parent is not null").select(F.col("parent").alias("child")).distinct().withColumn("inner", F.lit(True))
        marked = edge.join(heads, "child", "left")
        sends = [F.sum(F.when(F.col("inner").isNull(), F.col("own") + F.col("ext"))).alias("gain"), F.min("ext").alias("kid_ext")] if paths else []
        only = marked.where("parent is not null").groupBy(F.col("parent").alias("child")).agg(F.count(F.lit(1)).alias("kids"), F.max("inner").alias("deep"), F.min("child").alias("kid"), *sends)
        tied_to_itself = F.col("child") == F.col("parent")
        single = (F.col("kids") == 1) & F.col("deep") & F.col("parent").isNotNull() & ~tied_to_itself
        act = (
            F.when(F.col("inner").isNull(), PEELED).when(tied_to_itself & (F.col("kids") == 1), ANCHOR)
            .when(single & _above(F.col("child"), F.col("parent"), turn) & _above(F.col("child"), F.col("kid"), turn), CONTRACTED).otherwise(LIVES)
        )
        seen = marked.join(only, "child", "left").withColumn("act", act)
        told = Observation()
        own = [F.col("own") + F.coalesce("gain", F.lit(0)), F.col("ext"), F.col("via"), F.col("kid_ext")] if paths else []
        shown = [c.alias(n) for c, n in zip(own, ("own", "ext", "via", "kid_ext"))]
        path = scratch.write(seen.select("child", "parent", "w", "lo", *shown, F.when(F.col("act") == CONTRACTED, F.col("kid")).alias("kid"), "act").observe(told, F.count_if(F.col("act") == LIVES).alias("n")))
        done = scratch.read(path)
        records.append(path)
        if not told.get["n"]:
            living = 0
            break
        # a contracted node's child is tied to the node above
        ties = done.where(F.col("act") == CONTRACTED).select(
            F.col("kid").alias("child"), F.col("parent").alias("to"), F.col("w").alias("to_w"), F.least("lo", "child").alias("to_lo"),
            *([(F.col("ext") + F.col("own")).alias("to_ext"), F.concat("via", F.array("child")).alias("to_via")] if paths else []),
        )
        moved = F.col("to").isNotNull()
        following = done.where(F.col("act") == LIVES).join(ties, "child", "left").select(
            "child", F.coalesce("to", "parent").alias("parent"), (F.col("w") + F.coalesce("to_w", F.lit(0))).alias("w"), F.when(moved, F.least("lo", "to_lo")).otherwise(F.col("lo")).alias("lo"),
            *(["own", (F.col("ext") + F.coalesce("to_ext", F.lit(0))).alias("ext"), F.when(moved, F.concat("to_via", "via")).otherwise(F.col("via")).alias("via")] if paths else []),
        )
        told = Observation()
        previous, alive = alive, scratch.write(following.observe(told, counted.alias("n")))
        living, turn = told.get["n"], turn + 1
        scratch.drop(previous)

    # reverse order: what the last task knows, cycle anchors and roots first, then each round's records find the node above
    walked = ["path", "walk", "spot", "around"] if paths else []
    known = []
    if living or not records:
        rest = scratch.read(alive).select(*cols).coalesce(1)
        known.append(scratch.write(rest.mapInArrow(lambda b: _finish(b, paths), _KNOWN + (_WALKED if paths else ""))))
    if not records:
        return scratch.read(*known)
    every = scratch.read(*records)
    anchors = every.where(F.col("act") == ANCHOR)
    loop = None
    roots = every.where((F.col("act") == PEELED) & F.col("parent").isNull()).select(F.col("child").alias("node"), F.col("child").alias("root"), F.lit(0).cast("long").alias("depth"), *([F.col("own").alias("size")] if paths else []))
    if paths:  # all nodes of a cycle start, those below it follow; an anchor's via and itself are the cycle, downwards
        nothing = [F.lit(None).cast(t).alias(c) for c, t in zip(walked, ("array<bigint>", "array<bigint>", "long", "long"))]
        around = F.concat("via", F.array("child"))
        cycle = anchors.select(F.posexplode(around).alias("spot", "node"), F.least("child", "lo").alias("root"), (F.col("own") + F.col("ext")).alias("size"), F.size(around).cast("long").alias("around"))
        cycle = cycle.select("node", "root", F.lit(-1).cast("long").alias("depth"), "size", nothing[0], F.array("node").alias("walk"), F.col("spot").cast("long").alias("spot"), "around")
        start = roots.select("*", F.array("node").alias("path"), *nothing[1:]).unionByName(cycle)
    else:
        start = roots.unionByName(anchors.select(F.col("child").alias("node"), F.least("child", "lo").alias("root"), F.lit(-1).cast("long").alias("depth")))
    known.append(scratch.write(start))
    if paths:  # cycles' nodes were found whole; their own records say nothing new
        loop = scratch.stage(scratch.read(*known).where(F.size("walk") == 1).select(F.col("node").alias("child")))
    for path in reversed(records):
        so_far = scratch.read(*known)
        taken = scratch.read(path).where(F.col("act").isin(PEELED, CONTRACTED) & F.col("parent").isNotNull())
        taken = taken if loop is None else taken.join(loop, "child", "left_anti")
        found = taken.join(so_far.select(F.col("node").alias("parent"), "root", "depth", *walked), "parent")
        size = F.col("own")
        if paths:  # a contracted node's size needs its child's, which was removed later
            found = found.join(so_far.select(F.col("node").alias("kid"), F.col("size").alias("kid_size")), "kid", "left")
            size = F.col("own") + F.when(F.col("act") == CONTRACTED, F.col("kid_ext") + F.col("kid_size")).otherwise(0)
        found = found.select(
            F.col("child").alias("node"), "root", F.when(F.col("depth") < 0, F.lit(-1).cast("long")).otherwise(F.col("depth") + F.col("w")).alias("depth"),
            *([size.alias("size"), *[F.concat(c, "via", F.array("child")).alias(c) for c in ("path", "walk")], "spot", "around"] if paths else []),
        )
        known.append(scratch.write(found))
    for path in records:
        scratch.drop(path)
    return scratch.read(*known)


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, node, distance) for every pair of hierarchy(paths=True); the node itself is not listed.

    A node on a cycle has all others on the cycle and all below it as descendants, at the least number of links.
    """
    # a walk's first node is on the cycle; it comes with the others there
    up = tree.select("node", F.posexplode(F.coalesce("path", F.slice("walk", 2, F.size("walk")))).alias("level", "ancestor"), (F.size(F.coalesce("path", "walk")) - F.when(F.col("path").isNull(), 2).otherwise(1)).cast("long").alias("last"))
    off = up.where(F.col("level") < F.col("last")).select("ancestor", "node", (F.col("last") - F.col("level")).alias("distance"))
    on = tree.where(F.size("walk") == 1).select("root", F.col("node").alias("ancestor"), F.col("spot").alias("place"))
    links = F.pmod(F.col("spot") - F.col("place"), F.col("around")) + F.size("walk") - 1
    below = tree.where(F.col("walk").isNotNull()).join(on, "root").where(F.col("ancestor") != F.col("node")).select("ancestor", "node", links.alias("distance"))
    return off.unionByName(below)
