"""Property-path closures over distributed pairs.

Open on both ends, the known pairs are joined with themselves, so that a chain of n edges takes log n rounds. From a
bound end a frontier of new pairs grows edge by edge, and only edges that it meets are joined; it stops as soon as a
bound other end is found. Each round's pairs are written to the shared folder, so lineage stays short and an executor
may be lost. Loops end when nothing new is found, after any number of rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.runtime import Scratch


def closure(edges: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """(s, o): pairs joined by one or more edges (s, o), each once; cycles are safe.

    start: a condition on s; only pairs from there are found. end: a condition on o that one found pair may satisfy to
    end the search from a start (pairs found later are left out). Edges with a null end are no edges; an empty edge
    table gives no pairs.
    """
    return _doubled(edges) if start is None else _reached(edges, start, end)


def _doubled(edges: DataFrame) -> DataFrame:
    """Pairs found in a round (new) are joined with all known ones; paths of up to 2^k edges are known after k rounds."""
    scratch = Scratch(edges.sparkSession)
    new = scratch.write(edges.select("s", "o").dropna().distinct())
    known = [new]
    while not scratch.read(new).isEmpty():
        every = scratch.read(*known)
        fresh = scratch.read(new)
        # a path that is new has one half that is: new after known, or known after new
        first = fresh.join(every.select(F.col("s").alias("via"), F.col("o").alias("next")), F.col("o") == F.col("via")).select("s", F.col("next").alias("o"))
        second = every.join(fresh.select(F.col("s").alias("via"), F.col("o").alias("next")), F.col("o") == F.col("via")).select("s", F.col("next").alias("o"))
        found = first.unionByName(second).distinct()
        new = scratch.write(_unseen(found, every))
        known.append(new)
    return scratch.read(*known)


def _reached(edges: DataFrame, start: Column, end: Column | None) -> DataFrame:
    scratch = Scratch(edges.sparkSession)
    steps = scratch.stage(edges.select("s", "o").dropna())
    hops = steps.select(F.col("s").alias("via"), F.col("o").alias("next"))
    frontier = scratch.write(steps.where(start).distinct())
    known = [frontier]
    while True:
        reach = scratch.read(frontier)
        if reach.isEmpty() or end is not None and not reach.where(end).isEmpty():
            return scratch.read(*known)
        found = reach.join(hops, F.col("o") == F.col("via")).select("s", F.col("next").alias("o")).distinct()
        frontier = scratch.write(_unseen(found, scratch.read(*known)))
        known.append(frontier)


def _unseen(found: DataFrame, known: DataFrame) -> DataFrame:
    seen = known.select(F.col("s").alias("ks"), F.col("o").alias("ko"))
    return found.join(seen, (F.col("s") == F.col("ks")) & (F.col("o") == F.col("ko")), "left_anti")
