"""A solution sequence: a DataFrame, the lane of each variable, and the variables that no row leaves unbound."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.functions.lanes import Val, as_term, lexical

_SERIAL = itertools.count()


def fresh(hint: str = "c") -> str:
    """A column name that no other relation uses."""
    return f"{re.sub(r'[^A-Za-z0-9_]', '', hint)}__{next(_SERIAL)}"


def put(df: DataFrame, hint: str, v: Val) -> tuple[DataFrame, Val]:
    """df with the lane's columns computed under new names."""
    name = fresh(hint)
    if v.kind == "lang":
        tag = fresh(hint)
        return df.withColumns({name: v.col, tag: v.lang}), Val("lang", F.col(name), F.col(tag))
    return df.withColumn(name, v.col), v.at(F.col(name))


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    vals: dict[str, Val]
    bound: frozenset[str] = frozenset()

    def select(self, names: list[str] | tuple[str, ...], extra: dict | None = None) -> Rel:
        """The relation under new column names, with these variables only."""
        cols, vals = [], {}
        for n in names:
            v = self.vals.get(n) or Val("str", F.lit(None).cast("string"))
            c = fresh(n.strip("."))
            cols.append(v.col.alias(c))
            if v.kind == "lang":
                t = fresh(n.strip("."))
                cols.append(v.lang.alias(t))
                vals[n] = Val("lang", F.col(c), F.col(t))
            else:
                vals[n] = v.at(F.col(c))
        for c, column in (extra or {}).items():
            cols.append(column.alias(c))
        return Rel(self.df.select(*cols) if cols else self.df.select(F.lit(1).alias(fresh())), vals, self.bound & frozenset(names))

    def renamed(self) -> Rel:
        return self.select(list(self.vals))

    def with_val(self, name: str, v: Val, bound: bool = False) -> Rel:
        df, v = put(self.df, name.strip("."), v)
        return Rel(df, {**self.vals, name: v}, self.bound | ({name} if bound else set()))


def as_lane(v: Val, kind: str, prefix: str | None) -> Val:
    if (v.kind, v.prefix) == (kind, prefix) and kind != "lang":
        return v
    if kind == "iri" and v.kind == "iri":
        return Val("iri", lexical(v))
    return Val("term", as_term(v))


def union(a: Rel, b: Rel) -> Rel:
    """Bag union; a variable that one side lacks is unbound there, one whose lanes differ goes to the term lane."""
    names = list(dict.fromkeys([*a.vals, *b.vals]))
    sides, vals = [], {}
    lanes: dict[str, tuple[str, str | None]] = {}
    for n in names:
        have = [r.vals[n] for r in (a, b) if n in r.vals]
        kinds = {(v.kind, v.prefix) for v in have}
        if len(kinds) == 1 and have[0].kind != "lang":
            lanes[n] = next(iter(kinds))
        elif {k for k, _ in kinds} == {"iri"}:
            lanes[n] = ("iri", None)
        else:
            lanes[n] = ("term", None)
    out = {n: fresh(n.strip(".")) for n in names}
    for r in (a, b):
        cols = []
        for n in names:
            kind, prefix = lanes[n]
            if n in r.vals:
                cols.append(as_lane(r.vals[n], kind, prefix).col.alias(out[n]))
            else:
                other = (b if r is a else a).vals[n]
                model = as_lane(other, kind, prefix).col
                kind_of = (b if r is a else a).df.select(model.alias("x")).schema[0].dataType
                cols.append(F.lit(None).cast(kind_of).alias(out[n]))
        sides.append(r.df.select(*cols) if cols else r.df.select(F.lit(1).alias("one")))
    for n in names:
        vals[n] = Val(lanes[n][0], F.col(out[n]), prefix=lanes[n][1])
    return Rel(sides[0].unionByName(sides[1]) if names else sides[0].union(sides[1]), vals, a.bound & b.bound)
