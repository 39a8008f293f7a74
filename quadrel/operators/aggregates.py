"""SPARQL aggregates as Spark aggregate expressions, plain or over a window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrel.functions.lanes import RANKS, Val, as_term, lexical, number, of_rank, order_key
from quadrel.operators.relation import fresh

Over = Callable[[Column], Column]


def plain(c: Column) -> Column:
    return c


def prepared(v: Val, what: str) -> dict[str, Column]:
    """Columns that aggregates over mixed values need: `n` the number and its rank, `k` the place in the order of terms."""
    if what == "n":
        n, rank = number(v)
        return {fresh("number"): n, fresh("rank"): rank}
    return {fresh("order"): F.when(v.col.isNotNull(), F.struct(order_key(v).alias("k"), v.col.alias("t")))}


class Prepared(Val):
    """A mixed value whose columns are in place."""

    def __init__(self, v: Val, what: str, names: list[str]):
        super().__init__(v.kind, v.col)
        object.__setattr__(self, "what", what)
        object.__setattr__(self, "columns", [F.col(n) for n in names])


def distinct_value(v: Val) -> Column:
    """What DISTINCT compares: terms, so 1 and 1.0 differ."""
    return as_term(v) if v.kind in ("lang", "term") else v.col


def aggregate(name: str, distinct: bool, separator: str, v: Val | None, row: list[Column], over: Over = plain, place: Column | None = None) -> Val:
    """An aggregate of v, or of whole rows for COUNT(*). Errors are NULL and don't count.

    place: each row's place in an ordered input, which GROUP_CONCAT keeps; without one its values are in their own order.
    """
    if name == "COUNT":
        if v is None:
            return Val("int", F.count_distinct(F.struct(*row)) if distinct and row else over(F.count(F.lit(1))))
        return Val("int", F.count_distinct(distinct_value(v)) if distinct else over(F.count(v.col)))
    if name in ("SUM", "AVG"):
        return _numeric(name, distinct, v, over)
    if name in ("MIN", "MAX"):
        f = F.min if name == "MIN" else F.max
        if v.kind in ("term", "lang"):
            t = Val("term", as_term(v))
            both = v.columns[0] if isinstance(v, Prepared) else F.when(t.col.isNotNull(), F.struct(order_key(t).alias("k"), t.col.alias("t")))
            return Val("term", over(f(both))["t"])
        return v.at(over(f(v.col)))
    if name == "SAMPLE":
        if v.kind == "lang":
            v = Val("term", as_term(v))
        return v.at(over(F.any_value(v.col, F.lit(True))))
    if name == "GROUP_CONCAT":
        text = lexical(v)
        if distinct:
            pair = F.when(text.isNotNull(), F.struct(order_key(v).alias("k"), text.alias("x")))
            return Val("str", F.array_join(F.transform(F.array_sort(F.collect_set(pair)), lambda p: p["x"]), separator))
        if over is not plain:  # a window has its order
            return Val("str", F.array_join(over(F.collect_list(text)), separator))
        at = place if place is not None else order_key(v)
        pairs = F.collect_list(F.when(text.isNotNull(), F.struct(at.alias("k"), text.alias("x"))))
        return Val("str", F.array_join(F.transform(F.array_sort(pairs), lambda p: p["x"]), separator))
    raise ValueError(f"unknown aggregate {name}")


def _numeric(name: str, distinct: bool, v: Val, over: Over) -> Val:
    """A sum over nothing is 0; a value that is no number makes the whole group unbound."""
    if v.kind in RANKS:
        if name == "SUM":
            kind = "dbl" if v.kind == "flt" else v.kind
            # integers have no bound: their sum is a decimal without a point
            cast = {"int": "decimal(38,0)", "dec": "decimal(38,18)", "dbl": "double"}[kind]
            given = v.col.cast("decimal(20,0)") if kind == "int" else v.col
            total = F.sum_distinct(given) if distinct else over(F.sum(given))
            return Val(kind, F.coalesce(total.try_cast(cast), F.lit(0).cast(cast)))
        mean = over(F.avg(v.col)) if not distinct else None
        kind = "dec" if v.kind in ("int", "dec") else "dbl"
        cast = "decimal(38,18)" if kind == "dec" else "double"
        if distinct:
            mean = F.try_divide(F.sum_distinct(v.col).cast("double"), F.count_distinct(v.col).cast("double"))
        return Val(kind, F.coalesce(mean.cast(cast), F.lit(0).cast(cast)))
    got = tuple(v.columns) if isinstance(v, Prepared) else number(v)
    if got is None:
        # no value is a number: unbound, unless there is none at all
        return Val("int", F.when(over(F.count(v.col)) == 0, F.lit(0).cast("long")))
    n, rank = got
    bad = over(F.count(v.col)) > over(F.count(n))
    top = F.coalesce(over(F.max(rank)), F.lit(1))
    if distinct:
        # values of different types are different terms, so each type adds up its own
        parts = [F.when(rank == r, n) for r in (1, 2, 3, 4)]
        total = sum((F.coalesce(F.sum_distinct(p), F.lit(0.0)) for p in parts[1:]), F.coalesce(F.sum_distinct(parts[0]), F.lit(0.0)))
        count = sum((F.count_distinct(p) for p in parts[1:]), F.count_distinct(parts[0]))
    else:
        total, count = F.coalesce(over(F.sum(n)), F.lit(0.0)), over(F.count(n))
    if name == "SUM":
        return of_rank(F.when(~bad, total), top)
    top = F.when(top == 1, F.when(count == 0, 1).otherwise(2)).otherwise(top)
    return of_rank(F.when(~bad, F.coalesce(F.try_divide(total, count.cast("double")), F.lit(0.0))), top)


