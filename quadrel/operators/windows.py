"""Window functions over solution sequences. Frames count rows; NTILE deals out peer groups, not rows."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quadrel.functions.expressions import Evaluator
from quadrel.functions.lanes import RANKS, Val, lexical, order_key
from quadrel.operators.aggregates import aggregate, distinct_value
from quadrel.operators.relation import Rel, fresh
from quadrel.plans.algebra import Expr
from quadrel.runtime import Scratch


def sort_keys(keys: tuple[tuple[Expr, bool], ...], ev: Evaluator) -> list[Column]:
    """Unbound is lowest: first ascending, last descending."""
    out = []
    for e, up in keys:
        k = order_key(ev.value(e))
        out.append(k.asc_nulls_first() if up else k.desc_nulls_last())
    return out


def window(rel: Rel, name: str, e: Expr, ev: Evaluator) -> Rel:
    """rel with one more variable. Without ORDER BY all rows of a partition are peers."""
    function, distinct, separator, partition, keys, frame = e.extra
    w = Window.partitionBy(*[distinct_value(ev.value(p)) for p in partition])
    order = sort_keys(keys, ev)
    ordered = w.orderBy(*order) if order else w.orderBy(F.lit(0))
    if function in ("RANK", "DENSE_RANK", "ROW_NUMBER") and not partition and order:
        return _global_rank(rel, name, function, order)
    if function in ("RANK", "DENSE_RANK", "ROW_NUMBER"):
        f = {"RANK": F.rank, "DENSE_RANK": F.dense_rank, "ROW_NUMBER": F.row_number}[function]
        return rel.with_val(name, Val("int", f().over(ordered).cast("long")), True)
    if function == "NTILE":
        return _ntile(rel, name, int(e.args[0].args[0].value), w, ordered)
    v = ev.value(e.args[0]) if e.args else None
    if frame is not None:
        low = Window.unboundedPreceding if frame[0] is None else frame[0]
        high = Window.unboundedFollowing if frame[1] is None else frame[1]
        w = ordered.rowsBetween(low, high)
    elif order:
        w = ordered
    if distinct and function in ("COUNT", "SUM", "AVG", "GROUP_CONCAT"):
        return rel.with_val(name, _distinct(function, separator, v, w), function == "COUNT")
    return rel.with_val(name, aggregate(function, False, separator, v, [], lambda c: c.over(w)), function == "COUNT")


def _distinct(function: str, separator: str, v: Val, w) -> Val:
    """Aggregates over a frame's different values; numbers of one native type, or texts."""
    values = F.collect_set(distinct_value(v)).over(w)
    if function == "COUNT":
        return Val("int", F.size(values).cast("long"))
    if function == "GROUP_CONCAT":
        pairs = F.collect_set(F.when(lexical(v).isNotNull(), F.struct(order_key(v).alias("k"), lexical(v).alias("x")))).over(w)
        return Val("str", F.array_join(F.transform(F.array_sort(pairs), lambda p: p["x"]), separator))
    if v.kind not in RANKS:
        raise NotImplementedError(f"{function}(DISTINCT ...) over a window of mixed terms")
    total = F.aggregate(values, F.lit(0).cast("double"), lambda a, x: a + x.cast("double"))
    if function == "AVG":
        return Val("dbl", F.coalesce(F.try_divide(total, F.size(values).cast("double")), F.lit(0.0)))
    return Val("int" if v.kind == "int" else "dbl", total.try_cast("long") if v.kind == "int" else total)


def _global_rank(rel: Rel, name: str, function: str, order: list[Column]) -> Rel:
    """A rank over all rows without a single task for them: ranges of the order are ranked apart and shifted by what lies
    before them. The rows are written once, so that a range is the same in both uses; equal keys share a range."""
    spot = fresh("range")
    scratch = Scratch(rel.df.sparkSession)
    df = rel.df.repartitionByRange(*order).withColumn(spot, F.spark_partition_id())
    df = scratch.stage(df)
    w = Window.partitionBy(spot).orderBy(*order)
    f = {"RANK": F.rank, "DENSE_RANK": F.dense_rank, "ROW_NUMBER": F.row_number}[function]
    inside = fresh("inside")
    ranked = df.withColumn(inside, f().over(w).cast("long"))
    # one row a range: how many ranks it takes
    taken = F.max(inside) if function == "DENSE_RANK" else F.count(F.lit(1))
    sizes = {r[spot]: r["n"] for r in ranked.groupBy(spot).agg(taken.alias("n")).collect()}
    at, before = 0, []
    for part in sorted(sizes):
        before += [F.lit(part), F.lit(at).cast("long")]
        at += sizes[part]
    shift = F.element_at(F.create_map(*before), F.col(spot)) if before else F.lit(0)
    out = Rel(ranked, rel.vals, rel.bound).with_val(name, Val("int", F.col(inside) + shift), True)
    return Rel(out.df.drop(spot, inside), out.vals, out.bound)


def _ntile(rel: Rel, name: str, n: int, w, ordered) -> Rel:
    """n tiles over the peer groups: the first (groups mod n) tiles hold one group more."""
    at, groups = fresh("peer"), fresh("peers")
    df = rel.df.withColumn(at, F.dense_rank().over(ordered)).withColumn(groups, F.max(at).over(w))
    size, more = F.floor(F.col(groups) / n), F.col(groups) % n
    big = more * (size + 1)
    tile = F.when(F.col(at) <= big, F.floor((F.col(at) - 1) / (size + 1)) + 1).otherwise(F.floor((F.col(at) - 1 - big) / F.greatest(size, F.lit(1))) + 1 + more)
    return Rel(df, rel.vals, rel.bound).with_val(name, Val("int", tile.cast("long")), True)
