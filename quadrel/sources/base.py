"""What a store has to offer the compiler: pattern scans, and a way to turn ids into terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quadrel.functions.lanes import Val
from quadrel.operators.joins import inner
from quadrel.operators.relation import Rel, union
from quadrel.plans.algebra import Term, Var


@dataclass(frozen=True)
class Active:
    """The active graph: the default graph, one named graph, or each named graph in turn."""

    graph: Term | Var | None = None


def scanned_bytes(rel: Rel) -> float:
    """What a scan reads, as Spark measures it from the files and the columns that are left."""
    return float(str(rel.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: What a part's order begins with if no constant narrows it.
OPEN = 2


def names_of(triple: tuple) -> set[str]:
    return {x.name for x in triple if isinstance(x, Var)}


class Source:
    spark: SparkSession
    #: Variables of the query at hand that nothing but one subject position mentions: a scan need not make them.
    unused: frozenset[str] = frozenset()

    def prefetch(self, constants: list[Term]) -> None:
        """Looks up the constants of a query at once, in stores that have to look them up."""

    def scan(self, s, p, o, active: Active) -> Rel:
        raise NotImplementedError

    def matches(self, triple: tuple) -> float | None:
        """How many rows a pattern has, from stored counts; None if the store keeps none."""
        return None

    def pieces(self, triples: tuple, active: Active) -> list[tuple[set[str], tuple, Rel]]:
        """(variables, order, scan) of the parts of a basic graph pattern; stores fuse patterns here.

        Parts are ordered by their stored counts; where there are none, by how many of their ends are open.
        """
        out = []
        for t in triples:
            counted = self.matches(t)
            open_ends = len([x for x in t if isinstance(x, Var)])
            out.append((names_of(t), (0, open_ends) if counted is None else (1, counted), self.scan(*t, active)))
        return out

    def bgp(self, triples: tuple, active: Active) -> Rel:
        """Joins the parts in their order, each after one that it shares a variable with."""
        left = self.pieces(triples, active)
        if len(left) > 1:
            left = sorted(left, key=lambda x: x[1])
        first = 0
        if all(x[1] and x[1][0] is OPEN for x in left):
            first = len(left) - 1  # nothing is selective: the largest part streams through joins with the others
        names, _, rel = left.pop(first)
        seen = set(names) | set(rel.vals)
        while left:
            k = next((i for i, x in enumerate(left) if seen & x[0]), 0)
            names, _, other = left.pop(k)
            rel = inner(rel, other)
            seen |= set(names) | set(other.vals)
        return rel

    def every_triple(self, s: str, p: str, o: str, near: Val | None = None) -> Rel:
        """All triples of all graphs. Stores may leave out triples whose subject can't be in the lane `near`."""
        names = [s, p, o]
        parts = [self.scan(Var(s), Var(p), Var(o), Active(g)).select(names) for g in (None, Var(".graph"))]
        return union(*parts)

    def constant_node(self, name: str, t: Term) -> Rel | None:
        """One row with a constant in the lane that the store's scans give it; None if that is no special one."""
        return None

    def materialise(self, rel: Rel, names) -> Rel:
        """Looks up ids; other stores hold terms already."""
        return rel

    def graphs(self) -> DataFrame:
        """One column g: the named graphs."""
        raise NotImplementedError


def same_columns(rel_df: DataFrame, pairs) -> DataFrame:
    for a, b in pairs:
        rel_df = rel_df.where(a == b)
    return rel_df
