"""Algebra to DataFrames. The result of a query is one lazy plan. Jobs run on the way for closures, SERVICE, ids of
constants in a dictionary, default graphs that have to be found, sides that are counted before they are broadcast, and
sides that are written once (several maybe-unbound variables; EXISTS inside OPTIONAL; rank over one partition)."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, fields, is_dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrel.functions.expressions import SOLUTION, Custom, Evaluator, boolean
from quadrel.functions.lanes import BNODE, Val, as_term, constant, lexical, make, native, unify
from quadrel.operators import joins
from quadrel.operators.aggregates import Prepared, aggregate, distinct_value, prepared
from quadrel.operators.paths import closure
from quadrel.operators.relation import Rel, fresh, put, union
from quadrel.operators.windows import sort_keys, window
from quadrel.plans.algebra import (
    BGP, Aggregate, Distinct, Expr, Extend, Filter, Graph, Join, LeftJoin, Minus, Nothing, Order, Path, PathPattern, Plan, Project, QuadPattern, Query, Reduced, Service, Slice, Table, Term, Union, Unit, Var, Windows, variables,
)
from quadrel.plans.parser import parse
from quadrel.runtime import Scratch
from quadrel.plans.rewrite import simplify
from quadrel.sources.base import Active, Source


def used(e) -> set[str]:
    """Variables of an expression."""
    if not isinstance(e, Expr):
        return set()
    if e.op == "var":
        return {e.args[0]}
    if e.op == "exists":
        return set(variables(e.extra))
    out = set().union(*[used(a) for a in e.args]) if e.args else set()
    if e.op == "window":
        for p in e.extra[3]:
            out |= used(p)
        for k, _ in e.extra[4]:
            out |= used(k)
    return out


def conjuncts(e: Expr) -> list[Expr]:
    return conjuncts(e.args[0]) + conjuncts(e.args[1]) if e.op == "and" else [e]


@dataclass
class Solutions:
    """A compiled SELECT: columns in order, as native values or as terms."""

    rel: Rel
    names: tuple[str, ...]

    def frame(self) -> DataFrame:
        """Typed columns; IRIs and mixed terms as their text."""
        return self.rel.df.select(*[native(self.rel.vals[n]).alias(n) if n in self.rel.vals else F.lit(None).cast("string").alias(n) for n in self.names])

    def terms(self) -> DataFrame:
        """Term structs."""
        return self.rel.df.select(*[as_term(self.rel.vals[n]).alias(n) if n in self.rel.vals else as_term(Val("str", F.lit(None).cast("string"))).alias(n) for n in self.names])


class Compiler:
    def __init__(self, source: Source, custom: dict[str, Custom] | None = None, service=None, base: str | None = None):
        self.source, self.custom, self.service, self.base = source, custom or {}, service, base
        self.spark = source.spark

    def evaluator(self, rel: Rel, flags=None) -> Evaluator:
        return Evaluator(rel.vals, self.custom, flags, self.base)

    def ready(self, rel: Rel, *exprs) -> Rel:
        """Looks up the terms of ids whose value an expression needs; BOUND and COUNT of a variable don't."""
        names: set[str] = set()
        for e in exprs:
            if isinstance(e, Expr) and not (e.op == "BOUND" or e.op == "exists"):
                names |= {e.args[0]} if e.op == "var" else set().union(set(), *[self._needs(a) for a in e.args])
        return self.source.materialise(rel, sorted(n for n in names if n in rel.vals and rel.vals[n].kind == "id"))

    def _needs(self, e) -> set[str]:
        if not isinstance(e, Expr) or e.op in ("BOUND", "exists"):
            return set()
        if e.op == "var":
            return {e.args[0]}
        return set().union(set(), *[self._needs(a) for a in e.args])

    # ------------------------------------------------------------ algebra
    def compile(self, plan: Plan, active: Active = Active()) -> Rel:
        match plan:
            case Unit():
                return Rel(self.spark.range(1).select(F.lit(1).alias(fresh())), {}, frozenset())
            case Nothing():
                return Rel(self.spark.range(0).select(F.lit(1).alias(fresh())), {}, frozenset())
            case Table():
                return self.table(plan)
            case BGP():
                return self.source.bgp(plan.triples, active) if plan.triples else self.compile(Unit(), active)
            case QuadPattern():
                return self.source.bgp(((plan.subject, plan.predicate, plan.object),), Active(plan.graph))
            case PathPattern():
                return self.path(plan, active)
            case Join():
                if isinstance(plan.left, Unit):
                    return self.compile(plan.right, active)
                return joins.inner(*self.aligned(self.compile(plan.left, active), self.compile(plan.right, active)))
            case LeftJoin():
                return self.left_join(plan, active)
            case Minus():
                return joins.minus(*self.aligned(self.compile(plan.left, active), self.compile(plan.right, active)))
            case Union():
                a, b = self.compile(plan.left, active), self.compile(plan.right, active)
                return union(*self.aligned(a, b))
            case Filter():
                return self.filter(self.compile(plan.child, active), plan.condition, active)
            case Extend():
                rel = self.compile(plan.child, active)
                if plan.value.op == "var" and plan.value.args[0] in rel.vals:
                    v = rel.vals[plan.value.args[0]]
                    return Rel(rel.df, {**rel.vals, plan.name: v}, rel.bound | ({plan.name} if plan.value.args[0] in rel.bound else set()))
                rel = self.ready(rel, plan.value)
                if _labels(plan.value) and SOLUTION not in rel.vals:
                    rel = self._named_solutions(rel)
                rel, flags = self.lift(rel, plan.value, active)
                return rel.with_val(plan.name, self.evaluator(rel, flags).value(plan.value), plan.value.op == "term")
            case Graph():
                return self.graph(plan)
            case Service():
                return self.remote(plan)
            case Aggregate():
                return self.aggregate(plan, active)
            case Windows():
                rel = self.compile(plan.child, active)
                for name, e in plan.functions:
                    rel = self.ready(rel, *e.args, *e.extra[3], *[k for k, _ in e.extra[4]])
                    rel = window(rel, name, e, self.evaluator(rel))
                return rel
            case Project():
                rel = self.compile(plan.child, active)
                return rel.select([n for n in plan.names if n in rel.vals])
            case Distinct() | Reduced():
                return self.distinct(self.compile(plan.child, active))
            case Order():
                rel = self.compile(plan.child, active)
                rel = self.ready(rel, *[k for k, _ in plan.keys])
                return Rel(rel.df.orderBy(*sort_keys(plan.keys, self.evaluator(rel))), rel.vals, rel.bound)
            case Slice():
                return self.slice(plan, active)
        raise TypeError(f"no rule for {type(plan).__name__}")

    def _named_solutions(self, rel: Rel) -> Rel:
        """A hidden variable that names each solution by its content, and equal solutions by their number."""
        row = F.md5(F.to_json(F.struct(F.lit(1).alias("one"), *[(v.col.cast("string") if v.kind == "id" else as_term(v)).alias(n.strip(".")) for n, v in rel.vals.items()])))
        name, turn = fresh("row"), fresh("turn")
        df = rel.df.withColumn(name, row)
        df = df.withColumn(turn, F.row_number().over(Window.partitionBy(name).orderBy(name)))
        df = df.withColumn(name, F.concat_ws(".", name, F.col(turn).cast("string")))
        return Rel(df, {**rel.vals, SOLUTION: Val("str", F.col(name))}, rel.bound | {SOLUTION})

    def slice(self, plan: Slice, active: Active) -> Rel:
        child = plan.child
        # a projection between LIMIT and ORDER BY is pulled up, so that Spark sees sort and limit together
        if isinstance(child, Project) and isinstance(child.child, Order):
            rel = self.slice(Slice(child.child, plan.offset, plan.limit), active)
            return rel.select([n for n in child.names if n in rel.vals])
        rel = self.compile(child, active)
        df = rel.df
        if plan.offset:
            df = df.offset(plan.offset)
        if plan.limit is not None:
            df = df.limit(plan.limit)
        return Rel(df, rel.vals, rel.bound)

    def table(self, plan: Table) -> Rel:
        """VALUES; a column whose terms share one native type stays native."""
        cols = [fresh(n) for n in plan.names]
        vals, kinds = {}, []
        for i, n in enumerate(plan.names):
            of = {(t.kind, t.datatype) for r in plan.rows if (t := r[i]) is not None}
            sample = {constant(t).kind for r in plan.rows if (t := r[i]) is not None}
            kinds.append(next(iter(sample)) if len(of) == 1 and len(sample) == 1 and next(iter(sample)) in ("int", "str", "iri", "dbl", "bool") else "term")
            vals[n] = Val(kinds[-1], F.col(cols[i]))
        types = {"int": "long", "str": "string", "iri": "string", "dbl": "double", "bool": "boolean", "term": "struct<k:int,lex:string,dt:string,lang:string>"}
        rows = [tuple(_cell(t, k) for t, k in zip(r, kinds)) for r in plan.rows]
        if not cols:
            df = self.spark.range(len(rows)).select(F.lit(1).alias(fresh()))
        else:
            df = self.spark.createDataFrame(rows, ", ".join(f"`{c}` {types[k]}" for c, k in zip(cols, kinds)))
        return Rel(df, vals, frozenset(n for i, n in enumerate(plan.names) if all(r[i] is not None for r in plan.rows)))

    def aligned(self, a: Rel, b: Rel) -> tuple[Rel, Rel]:
        """A variable that is an id on one side only is looked up there."""
        mixed = [n for n in a.vals if n in b.vals and (a.vals[n].kind == "id") != (b.vals[n].kind == "id")]
        return self.source.materialise(a, mixed), self.source.materialise(b, mixed)

    def condition(self, e: Expr | None):
        if e is None:
            return None
        return lambda vals: boolean(Evaluator(vals, self.custom, {}, self.base).value(e))

    def left_join(self, plan: LeftJoin, active: Active) -> Rel:
        a, b = self.aligned(self.compile(plan.left, active), self.compile(plan.right, active))
        if plan.condition is None:
            return joins.left_outer(a, b)
        exists = [c for c in conjuncts(plan.condition) if _has_exists(c)]
        rest = [c for c in conjuncts(plan.condition) if not _has_exists(c)]
        for c in rest:
            a, b = self.ready(a, c), self.ready(b, c)
        a, b = self.aligned(a, b)
        if exists:
            # EXISTS may look at both sides: the matching pairs are filtered, then rows of the left without a pair are added
            # the left is written once, so that both uses see the same row numbers
            tag = fresh("row")
            a = a.renamed()
            left = Rel(Scratch(self.spark).stage(a.df.withColumn(tag, F.monotonically_increasing_id())), a.vals, a.bound)
            left = Rel(left.df, {**left.vals, f".{tag}": Val("int", F.col(tag))}, left.bound | {f".{tag}"})
            pairs = joins.inner(left, b, self.condition(_and(rest)))
            pairs = self.filter(pairs, _and(exists), active)
            return self._padded(left, pairs, b, tag)
        return joins.left_outer(a, b, self.condition(_and(rest)))

    def _padded(self, left: Rel, pairs: Rel, b: Rel, tag: str) -> Rel:
        names = [n for n in dict.fromkeys([*left.vals, *b.vals]) if n != f".{tag}"]
        alone = joins.anti(left, pairs.select([f".{tag}"]))
        out = union(pairs.select(names), alone.select([n for n in names if n in left.vals]))
        return Rel(out.df, out.vals, left.bound - {f".{tag}"})

    def filter(self, rel: Rel, e: Expr, active: Active) -> Rel:
        for c in conjuncts(e):
            if c.op == "exists":
                rel = self._exists(rel, c, active, joins.semi)
            elif c.op == "not" and c.args[0].op == "exists":
                rel = self._exists(rel, c.args[0], active, joins.anti)
            else:
                rel = self.ready(rel, c)
                rel, flags = self.lift(rel, c, active)
                rel = Rel(rel.df.where(self.evaluator(rel, flags).ebv(c)), rel.vals, rel.bound)
        return rel

    def _pattern(self, rel: Rel, e: Expr, active: Active) -> tuple[Rel, Rel, Expr | None]:
        """The pattern of an EXISTS; its filters that look at the outer row become a join condition."""
        plan, outer = e.extra, []
        while isinstance(plan, Filter) and not set(used(plan.condition)) <= set(variables(plan.child)):
            outer.append(plan.condition)
            plan = plan.child
        inner = self.compile(plan, active)
        for c in outer:
            rel, inner = self.ready(rel, c), self.ready(inner, c)
        rel, inner = self.aligned(rel, inner)
        keep = [n for n in inner.vals if n in rel.vals or any(n in used(c) for c in outer)]
        inner = inner.select(keep)
        return rel, inner, _and(outer)

    def _exists(self, rel: Rel, e: Expr, active: Active, how) -> Rel:
        rel, inner, outer = self._pattern(rel, e, active)
        return how(rel, inner, self.condition(outer))

    def lift(self, rel: Rel, e: Expr, active: Active) -> tuple[Rel, dict]:
        """EXISTS inside other expressions becomes a boolean column."""
        flags = {}
        for x in _existences(e):
            rel, inner, outer = self._pattern(rel, x, active)
            rel, flags[x] = joins.flagged(rel, inner, self.condition(outer))
        return rel, flags

    def graph(self, plan: Graph) -> Rel:
        if isinstance(plan.child, Unit):
            name = fresh("g")
            df = self.source.graphs().select(F.col("g").alias(name))
            if isinstance(plan.graph, Term):
                return Rel(df.where(F.col(name) == plan.graph.value), {}, frozenset())
            return Rel(df, {plan.graph.name: Val("iri", F.col(name))}, frozenset([plan.graph.name]))
        return self.compile(plan.child, Active(plan.graph))

    def remote(self, plan: Service) -> Rel:
        if self.service is None:
            raise RuntimeError("no SERVICE client is set")
        try:
            if not isinstance(plan.endpoint, Term):
                raise RuntimeError("SERVICE needs a constant endpoint")
            names, rows = self.service(plan.endpoint.value, plan.text)
        except Exception:
            if plan.silent:
                return self.compile(Unit())
            raise
        return self.table(Table(tuple(names), tuple(tuple(r.get(n) for n in names) for r in rows)))

    def distinct(self, rel: Rel) -> Rel:
        names = list(rel.vals)
        keyed = Rel(rel.df, {n: Val("term", as_term(v)) if v.kind == "lang" else v for n, v in rel.vals.items()}, rel.bound).select(names)
        return Rel(keyed.df.distinct(), keyed.vals, keyed.bound)

    def aggregate(self, plan: Aggregate, active: Active) -> Rel:
        rel = self.compile(plan.child, active)
        place = None
        if any(e.extra[0] == "GROUP_CONCAT" and not e.extra[1] for _, e in plan.aggregates) and _ordered(plan.child):
            # ids grow along a sorted frame
            place = fresh("place")
            rel = Rel(rel.df.withColumn(place, F.monotonically_increasing_id()), rel.vals, rel.bound)
        for e, _ in plan.groups:
            if e.op != "var":
                rel = self.ready(rel, e)
        for _, e in plan.aggregates:
            if not (e.extra[0] == "COUNT" and e.args and e.args[0].op == "var"):
                rel = self.ready(rel, *e.args)
        ev = self.evaluator(rel)
        keys, vals, bound = [], {}, set()
        df = rel.df
        for e, name in plan.groups:
            v = ev.value(e)
            v = Val("term", as_term(v)) if v.kind == "lang" else v
            df, v = put(df, name.strip("."), v)
            keys.append(v.col)
            vals[name] = v
            if e.op == "var" and e.args[0] in rel.bound:
                bound.add(name)
        row = [distinct_value(v) if v.kind in ("lang", "term") else v.col for n, v in rel.vals.items() if not n.startswith(".")]
        cols, ready = [], {}
        for name, e in plan.aggregates:
            function, distinct, separator = e.extra
            v = ev.value(e.args[0]) if e.args else None
            if v is not None and v.kind == "term" and function in ("SUM", "AVG", "MIN", "MAX"):
                # a mixed value's number and place in the order are columns of their own, computed once for all aggregates
                what = "n" if function in ("SUM", "AVG") else "k"
                if (e.args[0], what) not in ready:
                    ready[e.args[0], what] = prepared(v, what)
                    for c, column in ready[e.args[0], what].items():
                        df = df.withColumn(c, column)
                v = Prepared(v, what, list(ready[e.args[0], what]))
            v = aggregate(function, distinct, separator, v, row, place=None if place is None else F.col(place))
            c = fresh(name.strip("."))
            cols.append(v.col.alias(c))
            vals[name] = Val(v.kind, F.col(c), prefix=v.prefix)
            if function == "COUNT":
                bound.add(name)
        grouped = df.groupBy(*keys)
        out = grouped.agg(*cols) if cols else df.select(*keys).distinct()
        return Rel(out, vals, frozenset(bound))

    # ------------------------------------------------------------ paths
    def path(self, plan: PathPattern, active: Active) -> Rel:
        """A closure or negated set between two ends, either of which may be a constant."""
        s, o = plan.subject, plan.object
        pairs = self.pairs(plan.path, active, s if isinstance(s, Term) else None, o if isinstance(o, Term) else None)
        df, vals = pairs.df, dict(pairs.vals)
        for side, x in ((".s", s), (".o", o)):
            v = vals.pop(side)
            if isinstance(x, Term):
                df = df.where(_is(self.source, v, x))
            elif x.name in vals:
                a, b, _ = unify(vals[x.name], v)
                df = df.where(a == b)
            else:
                vals[x.name] = v
        names = [x.name for x in (s, o) if isinstance(x, Var)]
        bound = frozenset(vals)
        if isinstance(active.graph, Var):
            names.append(active.graph.name)
        rel = Rel(df, vals, bound).select(list(dict.fromkeys(names)))
        if not names:
            rel = Rel(rel.df.limit(1), rel.vals, rel.bound)
        return rel

    def pairs(self, p: Path, active: Active, start: Term | None = None, end: Term | None = None) -> Rel:
        s, o = Var(".s"), Var(".o")
        g = active.graph.name if isinstance(active.graph, Var) else None

        def named(rel: Rel, left: str, right: str) -> Rel:
            v = dict(rel.vals)
            a, b = v.pop(".s"), v.pop(".o")
            return Rel(rel.df, {left: a, right: b, **v}, rel.bound | {left, right})

        match p.op:
            case "link":
                return self.source.scan(s, p.args[0], o, active)
            case "inverse":
                return named(self.pairs(p.args[0], active, end, start), ".o", ".s")
            case "seq":
                a = named(self.pairs(p.args[0], active, start), ".s", ".m")
                b = named(self.pairs(p.args[1], active, None, end), ".m", ".o")
                out = joins.inner(*self.aligned(a, b))
                return out.select([".s", ".o", *([g] if g else [])])
            case "alt":
                return union(*self.aligned(self.pairs(p.args[0], active, start, end), self.pairs(p.args[1], active, start, end)))
            case "nps":
                rel = self.source.scan(s, Var(".q"), o, active)
                for t in p.args:
                    rel = Rel(rel.df.where(~_is(self.source, rel.vals[".q"], t)), rel.vals, rel.bound)
                return rel.select([".s", ".o", *([g] if g else [])])
        return self._closure(p, active, start, end, g)

    def _closure(self, p: Path, active: Active, start: Term | None, end: Term | None, g: str | None) -> Rel:
        backwards = start is None and end is not None
        if backwards:
            start, end = end, None
        both = start is not None and end is not None and g is None
        step = self.pairs(Path("inverse", p.args) if backwards else p.args[0], active)
        got = unify(step.vals[".s"], step.vals[".o"])
        if got is None:
            got = as_term(step.vals[".s"]), as_term(step.vals[".o"]), Val("term", F.lit(None))
        left, right, lane = got
        prefix = step.vals[".s"].prefix if lane.kind == "iri" and step.vals[".s"].prefix == step.vals[".o"].prefix else None
        of = lambda c: Val(lane.kind, c, prefix=prefix)
        gcol = step.vals[g].col if g else None
        pack = (lambda c: F.struct(gcol.alias("g"), c.alias("x"))) if g else (lambda c: c)
        edges = step.df.select(pack(left).alias("s"), pack(right).alias("o"))
        node = (lambda c: c["x"]) if g else (lambda c: c)
        first = None if start is None else _is(self.source, of(node(F.col("s"))), start)
        if p.op == "opt":
            reach = edges.where(first).distinct() if first is not None else edges.distinct()
        else:
            reach = closure(edges, first, _is(self.source, of(node(F.col("o"))), end) if both else None)
        if p.op in ("star", "opt"):
            if start is not None:
                const = self._constants_like(lane.kind, prefix, start)
                if const is not None and g:  # in every graph
                    graphs = edges.select(F.col("s")["g"].alias("g")).distinct()
                    only = graphs.select("g", F.explode(const).alias("x")).select(F.struct("g", "x").alias("s"))
                else:
                    only = self.spark.range(1).select(F.explode(const).alias("s")) if const is not None else None
                if only is not None:
                    reach = reach.unionByName(only.select("s", F.col("s").alias("o"))).distinct()
            else:
                nodes = self._nodes(active, lane.kind, prefix, g)
                if nodes is None:  # other lanes than the path's own: go to terms
                    return self._with_all_nodes(reach, of, node, active, g, backwards)
                reach = reach.unionByName(nodes.select(F.col("n").alias("s"), F.col("n").alias("o"))).distinct()
        a, b = fresh("s"), fresh("o")
        cols = [node(F.col("s")).alias(a), node(F.col("o")).alias(b)]
        vals = {".s": of(F.col(b if backwards else a)), ".o": of(F.col(a if backwards else b))}
        if g:
            c = fresh("g")
            cols.append(F.col("s")["g"].alias(c))
            vals[g] = step.vals[g].at(F.col(c))
        return Rel(reach.select(*cols), vals, frozenset(vals))

    def _constants_like(self, kind: str, prefix: str | None, t: Term):
        """An array of a constant in the lane of a path (a term may have several ids); None if it has no place there."""
        v = constant(t)
        if kind == "term":
            return F.array(as_term(v))
        if kind == "id":
            ids = self.source.ids(t)
            return F.array(*[F.lit(i).cast("long") for i in ids]) if ids else None
        if kind == "iri" and prefix is not None:
            rest = t.value[len(prefix) :] if t.value.startswith(prefix) else ""
            return F.array(F.lit(int(rest)).cast("long")) if rest.isdigit() else None
        return F.array(v.col) if v.kind == kind else None

    def _nodes(self, active: Active, kind: str, prefix: str | None, g: str | None) -> DataFrame | None:
        """Every subject and object of the active graph, if they have the lane of the path."""
        every = self.source.scan(Var(".s"), Var(".q"), Var(".o"), active)
        if {every.vals[".s"].kind, every.vals[".o"].kind} != {kind} or prefix is not None:
            return None
        pack = (lambda c: F.struct(every.vals[g].col.alias("g"), c.alias("x"))) if g else (lambda c: c)
        return every.df.select(F.explode(F.array(pack(every.vals[".s"].col), pack(every.vals[".o"].col))).alias("n")).distinct()

    def _with_all_nodes(self, reach: DataFrame, of, node, active: Active, g: str | None, backwards: bool) -> Rel:
        every = self.source.scan(Var(".s"), Var(".q"), Var(".o"), active)
        a, b = fresh("s"), fresh("o")
        s, o = (F.col("o"), F.col("s")) if backwards else (F.col("s"), F.col("o"))
        graph = fresh("g")
        of_graph = [lexical(Val("iri", F.col("s")["g"])).alias(graph)] if g else []
        node_graph = [lexical(every.vals[g]).alias(graph)] if g else []
        found = reach.select(as_term(of(node(s))).alias(a), as_term(of(node(o))).alias(b), *of_graph)
        nodes = every.df.select(F.explode(F.array(as_term(every.vals[".s"]), as_term(every.vals[".o"]))).alias(a), *node_graph).distinct()
        both = found.unionByName(nodes.select(a, F.col(a).alias(b), *([graph] if g else []))).distinct()
        vals = {".s": Val("term", F.col(a)), ".o": Val("term", F.col(b))}
        if g:
            vals[g] = Val("iri", F.col(graph))
        return Rel(both, vals, frozenset(vals))

    # ------------------------------------------------------------ query forms
    def solutions(self, q: Query) -> Solutions:
        rel = self.compile(simplify(q.plan))
        return Solutions(self.source.materialise(rel, [n for n in q.names if n in rel.vals]), q.names)

    def ask(self, q: Query) -> DataFrame:
        """One row with one boolean column, `result`."""
        rel = self.compile(simplify(q.plan))
        return rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("result"))

    def construct(self, q: Query) -> DataFrame:
        """(s, p, o) term structs, a set. Blank nodes of the template are named by their solution; triples with an
        unbound part, a literal subject or a predicate that is no IRI are left out."""
        rel = self.compile(q.plan)
        rel = self.source.materialise(rel, sorted({x.name for t in q.template for x in t if isinstance(x, Var) and x.name in rel.vals}))
        row = F.md5(F.to_json(F.struct(F.lit(1).alias("one"), *[as_term(v).alias(n.strip(".")) for n, v in rel.vals.items() if v.kind != "id"])))

        def cell(x):
            if isinstance(x, Term):
                return as_term(constant(x))
            if x.name.startswith(".") and x.name not in rel.vals:
                return make(BNODE, F.concat(row, F.lit(x.name)))
            return as_term(rel.vals[x.name]) if x.name in rel.vals else as_term(Val("str", F.lit(None).cast("string")))

        if not q.template:
            return self.spark.createDataFrame([], "s struct<k:int,lex:string,dt:string,lang:string>, p struct<k:int,lex:string,dt:string,lang:string>, o struct<k:int,lex:string,dt:string,lang:string>")
        triples = [F.struct(*[cell(x).alias(n) for n, x in zip("spo", t)]) for t in q.template]
        out = rel.df.select(F.inline(F.array(*triples)))
        return out.where("s is not null and p is not null and o is not null and s.k < 3 and p.k = 2").distinct()

    def describe(self, q: Query) -> DataFrame:
        """(s, p, o): the outgoing triples, in any graph, of each term described."""
        rel = self.compile(q.plan)
        targets = None
        for x in q.describe:
            if isinstance(x, Term):
                part = self.source.constant_node(".d", x) or self.table(Table((".d",), ((x,),)))
            elif x.name in rel.vals:
                part = Rel(rel.df, {".d": rel.vals[x.name]}, frozenset()).select([".d"])
                part = Rel(part.df.where(part.vals[".d"].col.isNotNull()), part.vals, frozenset([".d"]))
            else:
                continue
            targets = part if targets is None else union(*self.aligned(targets, part))
        names = [".d", ".q", ".x"]
        triples = self.source.every_triple(*names, near=None if targets is None else targets.vals[".d"])
        if targets is None:
            hits = Rel(triples.df.limit(0), triples.vals, triples.bound)
        else:
            hits = joins.semi(*self.aligned(triples, self.distinct(targets)))
        hits = self.source.materialise(hits, names)
        return hits.df.select(*[as_term(hits.vals[n]).alias(c) for n, c in zip(names, "spo")]).distinct()


def _is(source: Source, v: Val, t: Term):
    """v is the constant t."""
    if v.kind == "id":
        ids = source.ids(t)
        return v.col.isin(*ids) if ids else F.lit(False)
    got = unify(v, constant(t))
    return F.lit(False) if got is None else F.coalesce(got[0] == got[1], F.lit(False))


def _ordered(plan: Plan) -> bool:
    """Whether a plan's rows come in the order of an ORDER BY."""
    while isinstance(plan, (Project, Extend, Slice)):
        plan = plan.child
    return isinstance(plan, Order)


def mentions(q: Query) -> tuple[Counter, set[str], list[Term]]:
    """How often a query mentions each variable (as a subject once for each basic graph pattern), the variables that are
    subjects, and the constants of its patterns."""
    uses: Counter = Counter(q.names)
    subjects: set[str] = set()
    constants: dict[Term, None] = {}

    def node(x, n: int = 1) -> None:
        if isinstance(x, Var):
            uses[x.name] += n
        elif isinstance(x, Term):
            constants[x] = None

    def walk(x) -> None:
        match x:
            case BGP():
                here = {t[0] for t in x.triples}
                for s in here:
                    node(s)
                    subjects.update([s.name] if isinstance(s, Var) else [])
                for _, p, o in x.triples:
                    node(p)
                    node(o)
            case Var() | Term():
                node(x)
            case Expr():
                if x.op == "var":
                    uses[x.args[0]] += 1
                if x.op == "aggregate" and not x.args and x.extra[1]:
                    uses["*"] += 1  # COUNT(DISTINCT *) looks at every variable
                for a in (*x.args, x.extra):
                    walk(a)
            case tuple() | list():
                for a in x:
                    walk(a)
            case str():
                uses[x] += 1  # a name that a projection, VALUES or BIND gives
            case _ if is_dataclass(x):
                for f in fields(x):
                    walk(getattr(x, f.name))

    walk([q.plan, q.template, q.describe])
    return uses, set() if uses["*"] else subjects, list(constants)


def _labels(e) -> bool:
    """Whether an expression makes blank nodes from labels."""
    return isinstance(e, Expr) and (e.op == "BNODE" and bool(e.args) or any(_labels(a) for a in e.args))


def _and(parts: list[Expr]) -> Expr | None:
    return reduce(lambda a, b: Expr("and", (a, b)), parts) if parts else None


def _has_exists(e) -> bool:
    return isinstance(e, Expr) and (e.op == "exists" or any(_has_exists(a) for a in e.args))


def _existences(e) -> list[Expr]:
    if not isinstance(e, Expr):
        return []
    return [e] if e.op == "exists" else [x for a in e.args for x in _existences(a)]


def _cell(t: Term | None, kind: str):
    if t is None:
        return None
    if kind == "term":
        return ({"bnode": 1, "iri": 2}.get(t.kind, 3), t.value, t.datatype, t.language)
    return {"int": int, "dbl": float, "bool": lambda x: x == "true"}.get(kind, str)(t.value)


class Engine:
    """A store with query text in and DataFrames out."""

    def __init__(self, source: Source, service=None):
        self.source, self.service, self.custom = source, service, {}

    def register(self, name: str, function: Custom) -> None:
        """Makes a function of lanes callable as <name>(...) in queries."""
        self.custom[name] = function

    def _prepared(self, text: str) -> tuple[Compiler, Query]:
        q = parse(text)
        source = self.source
        if (q.default_graphs or q.named_graphs) and hasattr(source, "dataset"):
            source = source.dataset(q.default_graphs, q.named_graphs)
        uses, subjects, constants = mentions(q)
        source.unused = frozenset(v for v in subjects if uses[v] == 1)
        source.prefetch(constants)
        return Compiler(source, self.custom, self.service, q.base), q

    def query(self, text: str) -> DataFrame:
        """Typed columns of a SELECT, `result` of an ASK, term structs (s, p, o) of CONSTRUCT and DESCRIBE."""
        compiler, q = self._prepared(text)
        match q.form:
            case "select":
                return compiler.solutions(q).frame()
            case "ask":
                return compiler.ask(q)
            case "construct":
                return compiler.construct(q)
        return compiler.describe(q)

    def terms(self, text: str) -> DataFrame:
        """A SELECT's solutions as term structs."""
        compiler, q = self._prepared(text)
        return compiler.solutions(q).terms()

    def explain(self, text: str) -> str:
        """The algebra and Spark's physical plan."""
        from quadrel.plans.algebra import show

        compiler, q = self._prepared(text)
        df = self.query(text)
        return show(q) + df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

