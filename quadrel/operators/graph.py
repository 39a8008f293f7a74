"""A graph of a quad frame (s, p, o, g term structs) as vertices and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.functions.lanes import BNODE, IRI
from quadrel.plans.algebra import RDF, Term
from quadrel.runtime import Scratch


def _is(c: Column, t: Term) -> Column:
    k = {"iri": IRI, "bnode": BNODE}.get(t.kind, 3)
    same = (c["k"] == k) & (c["lex"] == t.value)
    return same if t.kind != "literal" else same & c["dt"].eqNullSafe(F.lit(t.datatype)) & c["lang"].eqNullSafe(F.lit(t.language))


class GraphView:
    """All methods return DataFrames; a null graph name views every graph."""

    def __init__(self, quads: DataFrame, graph: str | None = None):
        self.all = quads
        self.quads = quads if graph is None else quads.where(F.col("g.lex") == graph)

    def vertices(self) -> DataFrame:
        """v: distinct subjects and objects."""
        return self.quads.select(F.explode(F.array("s", "o")).alias("v")).distinct()

    def instances_of(self, kind: str) -> DataFrame:
        return self.quads.where((F.col("p.lex") == RDF + "type") & (F.col("o.k") == IRI) & (F.col("o.lex") == kind)).select(F.col("s").alias("v")).distinct()

    def extension_of(self, predicate: str) -> DataFrame:
        """(s, o) pairs of a predicate."""
        return self.quads.where(F.col("p.lex") == predicate).select("s", "o")

    def outgoing(self, vertex: Term, predicate: str | None = None) -> DataFrame:
        """Vertices that a predicate leads to, or without one the distinct predicates that lead out."""
        rows = self.quads.where(_is(F.col("s"), vertex))
        return rows.select(F.col("p.lex").alias("p")).distinct() if predicate is None else rows.where(F.col("p.lex") == predicate).select(F.col("o").alias("v"))

    def incoming(self, vertex: Term, predicate: str | None = None) -> DataFrame:
        rows = self.quads.where(_is(F.col("o"), vertex))
        return rows.select(F.col("p.lex").alias("p")).distinct() if predicate is None else rows.where(F.col("p.lex") == predicate).select(F.col("s").alias("v"))

    def edges(self, vertex: Term) -> DataFrame:
        """The triples that begin or end at a vertex."""
        return self.quads.where(_is(F.col("s"), vertex) | _is(F.col("o"), vertex)).select("s", "p", "o")

    def graphs(self, vertex: Term) -> DataFrame:
        """g: the graphs that hold a vertex."""
        return self.all.where(_is(F.col("s"), vertex) | _is(F.col("o"), vertex)).select(F.col("g.lex").alias("g")).distinct()

    def lists(self) -> DataFrame:
        """(head, items): every RDF list, in order. Cells on a cycle belong to no list.

        Positions are found by pointer doubling over the rest links, so a list of n cells takes log n rounds.
        """
        scratch = Scratch(self.quads.sparkSession)
        nil = RDF + "nil"
        first = self.quads.where(F.col("p.lex") == RDF + "first").select(F.col("s.lex").alias("cell"), F.col("o").alias("item"))
        rest = self.quads.where(F.col("p.lex") == RDF + "rest").select(F.col("s.lex").alias("cell"), F.col("o.lex").alias("next"))
        heads = rest.join(rest.select(F.col("next").alias("cell")), "cell", "left_anti").select("cell")
        # up[cell] = (ancestor, distance) towards the head
        up = scratch.stage(rest.where(F.col("next") != nil).select(F.col("next").alias("cell"), F.col("cell").alias("to"), F.lit(1).cast("long").alias("far")))
        limit = max(1, up.count())
        hops = 1
        while hops < limit:
            step = up.select(F.col("cell").alias("mid"), F.col("to").alias("to2"), F.col("far").alias("far2"))
            joined = up.join(step, F.col("to") == F.col("mid"), "left")
            moved = joined.where("mid is not null").limit(1).count()
            if not moved:
                break
            up = scratch.stage(joined.select("cell", F.coalesce("to2", "to").alias("to"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far")))
            hops *= 2
        at = up.select("cell", F.col("to").alias("head"), "far").unionByName(heads.select("cell", F.col("cell").alias("head"), F.lit(0).cast("long").alias("far")))
        placed = at.join(heads.select(F.col("cell").alias("head")), "head", "left_semi").join(first, "cell")
        items = F.transform(F.array_sort(F.collect_list(F.struct("far", "item"))), lambda x: x["item"])
        return placed.groupBy("head").agg(items.alias("items"))
