"""Joins of solution sequences.

Two rows are compatible if every variable that both bind has the same term. Where a shared variable is bound in every
row of both sides that is an equality, and Spark hash- or merge-joins it. Where it may be unbound, both sides are split
by which of these variables are NULL, each pair of parts is joined on the keys bound in both, and the results are
unioned: no condition ever degrades to a nested loop because of an OR. A side with several such variables is written
once, and only the combinations of bound and unbound that occur in it become parts.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrel.functions.lanes import Val, as_term, unify
from quadrel.operators.relation import Rel, fresh, union
from quadrel.runtime import Scratch

Condition = Callable[[dict[str, Val]], Column]


def _all(parts: list[Column]) -> Column | None:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def _shared(a: Rel, b: Rel) -> tuple[list[str], list[str]]:
    both = [n for n in a.vals if n in b.vals]
    sure = [n for n in both if n in a.bound and n in b.bound]
    return sure, [n for n in both if n not in sure]


def _key(a: Rel, b: Rel, n: str) -> Column | None:
    got = unify(a.vals[n], b.vals[n])
    return None if got is None else got[0] == got[1]


def _free(rel: Rel, names: list[str]) -> list[str]:
    return [n for n in names if n not in rel.bound]


def _patterns(rel: Rel, names: list[str], occur: set[tuple[bool, ...]] | None = None) -> Iterator[tuple[dict[str, bool], Column | None]]:
    """Each combination of bound and unbound (of those that occur, if they are known), and the rows that have it."""
    free = _free(rel, names)
    for bits in itertools.product((True, False), repeat=len(free)):
        if occur is not None and bits not in occur:
            continue
        which = {n: True for n in names} | dict(zip(free, bits))
        yield which, _all([rel.vals[n].col.isNotNull() if b else rel.vals[n].col.isNull() for n, b in zip(free, bits)])


def _written(rel: Rel, names: list[str]) -> tuple[Rel, set[tuple[bool, ...]] | None]:
    """A side with several maybe-unbound variables, written once, and the combinations that occur: at most one row each."""
    free = _free(rel, names)
    if len(free) < 2:
        return rel, None
    rel = rel.renamed()
    rel = Rel(Scratch(rel.df.sparkSession).stage(rel.df), rel.vals, rel.bound)
    flags = [rel.vals[n].col.isNotNull().alias(f"b{i}") for i, n in enumerate(free)]
    return rel, {tuple(r) for r in rel.df.select(*flags).distinct().collect()}


def _better(a: Val, b: Val) -> Val:
    return b if a.kind == "term" and b.kind != "term" else a


def _merged(a: Rel, b: Rel) -> dict[str, Val]:
    """Lanes over a row of both sides."""
    vals = {**b.vals, **a.vals}
    sure, maybe = _shared(a, b)
    for n in sure:
        vals[n] = _better(a.vals[n], b.vals[n])
    for n in maybe:
        got = unify(a.vals[n], b.vals[n])
        if got is None or got[2].kind == "term":
            vals[n] = Val("term", F.coalesce(as_term(a.vals[n]), as_term(b.vals[n])))
        else:
            vals[n] = Val(got[2].kind, F.coalesce(got[0], got[1]), prefix=got[2].prefix if a.vals[n].prefix == b.vals[n].prefix else None)
    return vals


def inner(a: Rel, b: Rel, condition: Condition | None = None) -> Rel:
    b = b.renamed()
    sure, maybe = _shared(a, b)
    if len(maybe) > 1:
        (a, mine), (b, theirs) = _written(a, maybe), _written(b, maybe)
    else:
        mine = theirs = None
    vals = _merged(a, b)
    bound = a.bound | b.bound
    keys = [_key(a, b, n) for n in sure]
    if any(k is None for k in keys):
        return Rel(a.df.crossJoin(b.df.limit(0)), vals, bound)
    extra = [condition(vals)] if condition else []
    if not maybe:
        on = _all(keys + extra)
        return Rel(a.df.crossJoin(b.df) if on is None else a.df.join(b.df, on), vals, bound)
    out = None
    for left, lrows in _patterns(a, maybe, mine):
        for right, rrows in _patterns(b, maybe, theirs):
            more = [_key(a, b, n) for n in maybe if left[n] and right[n]]
            if any(k is None for k in more):
                continue
            x = a.df if lrows is None else a.df.where(lrows)
            y = b.df if rrows is None else b.df.where(rrows)
            on = _all(keys + more + extra)
            part = Rel(x.crossJoin(y) if on is None else x.join(y, on), vals, bound).select(list(vals))
            out = part if out is None else union(out, part)
    return out if out is not None else Rel(a.df.crossJoin(b.df.limit(0)), vals, bound)


def _split(a: Rel, b: Rel, condition: Condition | None, overlap: bool) -> tuple[Rel | None, Rel]:
    """Rows of a with and without a compatible row in b. overlap: only rows that share a bound variable count."""
    b = b.renamed()
    sure, maybe = _shared(a, b)
    if overlap and not sure and not maybe:
        return None, a
    mine = theirs = None
    if len(maybe) > 1:
        (a, mine), (b, theirs) = _written(a, maybe), _written(b, maybe)
    vals = _merged(a, b)
    keys = [_key(a, b, n) for n in sure]
    if any(k is None for k in keys):
        return None, a
    extra = [condition(vals)] if condition else []
    matched = unmatched = None
    for left, lrows in _patterns(a, maybe, mine):
        rest = a.df if lrows is None else a.df.where(lrows)
        for right, rrows in _patterns(b, maybe, theirs):
            more = [_key(a, b, n) for n in maybe if left[n] and right[n]]
            if any(k is None for k in more) or overlap and not sure and not more:
                continue
            y = b.df if rrows is None else b.df.where(rrows)
            on = _all(keys + more + extra)
            if on is None:  # nothing is compared: one row of b is as good as all
                on, y = F.lit(True), y.limit(1)
            hit = Rel(rest.join(y, on, "left_semi"), a.vals, a.bound)
            matched = hit if matched is None else union(matched, hit)
            rest = rest.join(y, on, "left_anti")
        part = Rel(rest, a.vals, a.bound)
        unmatched = part if unmatched is None else union(unmatched, part)
    return matched, unmatched if unmatched is not None else Rel(a.df.limit(0), a.vals, a.bound)


def semi(a: Rel, b: Rel, condition: Condition | None = None) -> Rel:
    got = _split(a, b, condition, False)[0]
    return got if got is not None else Rel(a.df.limit(0), a.vals, a.bound)


def anti(a: Rel, b: Rel, condition: Condition | None = None) -> Rel:
    return _split(a, b, condition, False)[1]


def minus(a: Rel, b: Rel) -> Rel:
    """Rows of a for which no row of b is compatible and shares a bound variable."""
    return _split(a, b, None, True)[1]


def flagged(a: Rel, b: Rel, condition: Condition | None = None) -> tuple[Rel, Column]:
    """a with a boolean column: whether b has a compatible row. Keys alone are looked up in one pass."""
    sure, maybe = _shared(a, b)
    if condition is None and not maybe and all(_key(a, b, n) is not None for n in sure):
        flag, keys = fresh("exists"), [unify(a.vals[n], b.vals[n])[:2] for n in sure]
        names = [fresh("key") for _ in keys]
        found = b.df.select(*[k.alias(n) for (_, k), n in zip(keys, names)]).distinct() if keys else b.df.limit(1).select(F.lit(1).alias(fresh()))
        on = [k == F.col(n) for (k, _), n in zip(keys, names)]
        df = a.df.join(found.withColumn(flag, F.lit(True)), _all(on) if on else F.lit(True), "left")
        out = Rel(df, a.vals, a.bound)
        return out, F.coalesce(F.col(flag), F.lit(False))
    yes, no = _split(a, b, condition, False)
    name = f".{fresh('exists')}"
    parts = [r.with_val(name, Val("bool", F.lit(flag)), True) for r, flag in ((yes, True), (no, False)) if r is not None]
    out = parts[0] if len(parts) == 1 else union(*parts)
    flag = out.vals[name].col
    return Rel(out.df, {n: v for n, v in out.vals.items() if n != name}, a.bound), flag


def left_outer(a: Rel, b: Rel, condition: Condition | None = None) -> Rel:
    sure, maybe = _shared(a, b)
    keys = [_key(a, b, n) for n in sure]
    if not maybe and not any(k is None for k in keys):
        b = b.renamed()
        vals = {**_merged(a, b), **{n: a.vals[n] for n in sure}}
        on = _all([_key(a, b, n) for n in sure] + ([condition(_merged(a, b))] if condition else []))
        return Rel(a.df.join(b.df, F.lit(True) if on is None else on, "left"), vals, a.bound)
    matched = inner(a, b, condition)
    alone = anti(a, b, condition)
    out = union(matched, alone)
    return Rel(out.df, out.vals, a.bound)
