"""Relational tables as a virtual RDF graph.

Each table is a class and a named graph, each column a predicate, a foreign key an IRI-valued one. Patterns with one
subject and constant predicates fuse into a single column-pruned scan (a star is a row), and IRIs of rows keep their
raw key, so joins along foreign keys are integer equi-joins; the IRI's text exists only where it is shown.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.functions.lanes import TERM_TYPE, Val, as_term, constant
from quadrel.functions.expressions import compare
from quadrel.operators.relation import Rel, fresh, union
from quadrel.plans.algebra import RDF, Term, Var
from quadrel.runtime import table
from quadrel.sources.base import OPEN, Active, Source, names_of, scanned_bytes

NAMESPACE = "http://tables.example/"
TYPE = RDF + "type"


@dataclass(frozen=True)
class Mapped:
    """key: the unique column, None if rows have none (each row is then a blank node, named by its place in the files)."""

    name: str
    key: str | None
    references: dict[str, str] = field(default_factory=dict)
    hidden: tuple[str, ...] = ()

    @property
    def prefix(self) -> str:
        return f"{NAMESPACE}{self.name}/"


TABLES = [
    Mapped("region", "r_regionkey"),
    Mapped("nation", "n_nationkey", {"n_regionkey": "region"}),
    Mapped("customer", "c_custkey", {"c_nationkey": "nation"}),
    Mapped("supplier", "s_suppkey", {"s_nationkey": "nation"}),
    Mapped("part", "p_partkey"),
    Mapped("orders", "o_orderkey", {"o_custkey": "customer"}),
    Mapped("lineitem", None, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    Mapped("events", "event_id"),
    Mapped("documents", "doc_id"),
    Mapped("eval_items", "item_id"),
    Mapped("embeddings", "vec_id", hidden=("embedding",)),
]
_LANES = {"bigint": "int", "int": "int", "smallint": "int", "double": "dbl", "float": "flt", "string": "str", "boolean": "bool", "date": "date", "timestamp": "dt", "timestamp_ntz": "dt"}


class MappedStore(Source):
    def __init__(self, spark: SparkSession, sf_dir: str, tables: list[Mapped] | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.tables = {t.name: t for t in tables or TABLES}
        self._frames: dict[str, DataFrame] = {}
        self._columns: dict[str, list[str]] = {}

    def frame(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = table(self.spark, self.sf_dir, name)
        return self._frames[name]

    def _of_predicate(self, p: Term) -> list[tuple[str, str]]:
        """(table, column) pairs that a predicate stands for: table.column, or a column that only one table has."""
        local = p.value[len(NAMESPACE) :] if p.value.startswith(NAMESPACE) else ""
        if "." in local:
            t, c = local.split(".", 1)
            return [(t, c)] if t in self.tables and c in self.frame(t).columns else []
        return [(t, local) for t in self.tables if local in self._names(t)]

    def _names(self, t: str) -> list[str]:
        if t not in self._columns:
            self._columns[t] = [c for c in self.frame(t).columns if c not in self.tables[t].hidden]
        return self._columns[t]

    def _subject(self, t: Mapped) -> Val:
        if t.key is None:
            # the place of a row is unique and costs no column; equal rows stay apart
            place = F.concat_ws("r", F.md5(F.col("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
            return Val("bnode", F.concat(F.lit("b"), place))
        return Val("iri", F.col(t.key), prefix=t.prefix)

    def _object(self, t: Mapped, column: str) -> Val:
        if column in t.references:
            return Val("iri", F.col(column).cast("long"), prefix=self.tables[t.references[column]].prefix)
        kind = _LANES[dict(self.frame(t.name).dtypes)[column]]
        return Val(kind, F.col(column).cast("long") if kind == "int" else F.col(column))

    def _graph_tables(self, active: Active) -> list[str]:
        if isinstance(active.graph, Term):
            return [t for t in self.tables if NAMESPACE + "graph/" + t == active.graph.value]
        return list(self.tables)

    def pieces(self, triples: tuple, active: Active) -> list[tuple[set[str], tuple, Rel]]:
        """Stars and single patterns: first those with a constant subject, then those with fixed values, each by the bytes that they scan."""
        stars: dict[object, list[tuple]] = defaultdict(list)
        out = []
        for t in triples:
            if isinstance(t[1], Term) and not (t[1].value == TYPE and isinstance(t[2], Var)):
                stars[t[0]].append(t)
            else:
                out.append([t])
        out += stars.values()
        pieces = []
        for group in out:
            rel = self._star(group, active) if group[0][0] in stars and group is stars[group[0][0]] else self.scan(*group[0], active)
            fixed = sum(isinstance(o, Term) for _, p, o in group if not (isinstance(p, Term) and p.value == TYPE))
            size = scanned_bytes(rel) if len(out) > 2 else 0.0  # of two parts Spark itself picks the side to build
            chosen = 0 if isinstance(group[0][0], Term) else 1 if fixed else OPEN
            pieces.append((set().union(*map(names_of, group)), (chosen, size), rel))
        return pieces

    def _star(self, group: list[tuple], active: Active) -> Rel:
        """All patterns of one subject as one scan; several tables may have the columns asked for."""
        options: set[str] | None = None
        for _, p, o in group:
            if p.value == TYPE:
                here = {t for t in self.tables if NAMESPACE + t == o.value} if isinstance(o, Term) else set(self.tables)
            else:
                here = {t for t, _ in self._of_predicate(p)}
            options = here if options is None else options & here
        names = sorted((options or set()) & set(self._graph_tables(active)))
        out = None
        for name in names:
            rel = self._scan_star(self.tables[name], group, active)
            out = rel if out is None else union(out, rel)
        if out is None:
            vals = {n: Val("term", F.col(fresh("none"))) for n in dict.fromkeys(n for t in group for n in names_of(t))}
            if isinstance(active.graph, Var):
                vals[active.graph.name] = Val("term", F.col(fresh("none")))
            cols = {n: fresh("none") for n in vals}
            schema = ", ".join(f"{c} {TERM_TYPE}" for c in cols.values()) or "none int"
            return Rel(self.spark.createDataFrame([], schema), {n: Val("term", F.col(c)) for n, c in cols.items()}, frozenset(vals))
        return out

    def _scan_star(self, t: Mapped, group: list[tuple], active: Active) -> Rel:
        df = self.frame(t.name)
        vals: dict[str, Val] = {}

        def bind(x, v: Val):
            nonlocal df
            if isinstance(x, Term):
                df = df.where(_equals(v, x))
            elif x.name in vals:
                df = df.where(compare("=", vals[x.name], v))
            else:
                vals[x.name] = v

        if t.key is not None or isinstance(group[0][0], Term) or group[0][0].name not in self.unused:
            bind(group[0][0], self._subject(t))
        for _, p, o in group:
            if p.value == TYPE:
                if isinstance(o, Var):
                    bind(o, Val("iri", F.lit(NAMESPACE + t.name)))
                continue
            column = next(c for name, c in self._of_predicate(p) if name == t.name)
            df = df.where(F.col(column).isNotNull())
            bind(o, self._object(t, column))
        if isinstance(active.graph, Var):
            bind(active.graph, Val("iri", F.lit(f"{NAMESPACE}graph/{t.name}")))
        return Rel(df, vals, frozenset(vals)).select(list(vals))

    def every_triple(self, s: str, p: str, o: str, near: Val | None = None) -> Rel:
        """The default graph is the merge of all tables' graphs, so one scan of each has everything; of one table, if
        the subjects that are wanted are its rows."""
        only = None if near is None or near.kind != "iri" or near.prefix is None else [t.name for t in self.tables.values() if t.key and t.prefix == near.prefix]
        return self.scan(Var(s), Var(p), Var(o), Active(), only).select([s, p, o])

    def constant_node(self, name: str, t: Term) -> Rel | None:
        for m in self.tables.values():
            rest = t.value[len(m.prefix) :]
            if m.key and t.kind == "iri" and t.value.startswith(m.prefix) and rest.lstrip("-").isdigit():
                column = fresh(name.strip("."))
                return Rel(self.spark.range(1).select(F.lit(int(rest)).cast("long").alias(column)), {name: Val("iri", F.col(column), prefix=m.prefix)}, frozenset([name]))
        return None

    def scan(self, s, p, o, active: Active, only: list[str] | None = None) -> Rel:
        if isinstance(p, Term):
            return self._star([(s, p, o)], active)
        # the slow path: only the columns that may match become rows of triples
        out = None
        for name in self._graph_tables(active) if only is None else only:
            t = self.tables[name]
            if isinstance(s, Term) and not (t.key and s.value.startswith(t.prefix)):
                continue
            if isinstance(o, Term) and o.kind == "iri" and o.value.startswith(NAMESPACE) and not any(o.value.startswith(self.tables[r].prefix) for r in t.references.values()) and o.value != NAMESPACE + name:
                continue
            df = self.frame(name)
            if isinstance(s, Term):
                df = df.where(_equals(self._subject(t), s))
            cells = [F.struct(F.lit(TYPE).alias("p"), as_term(Val("iri", F.lit(NAMESPACE + name))).alias("o"))]
            cells += [F.struct(F.lit(NAMESPACE + c).alias("p"), as_term(self._object(t, c)).alias("o")) for c in self._names(name)]
            subject = self._subject(t)
            key = subject.col.cast("long") if t.key and dict(df.dtypes)[t.key] in ("int", "smallint") else subject.col
            rows = df.select(key.alias("s"), F.inline(F.array(*cells))).where(F.col("o").isNotNull())
            parts = [(s, subject.at(F.col("s"))), (p, Val("iri", F.col("p"))), (o, Val("term", F.col("o")))]
            if isinstance(active.graph, Var):
                parts.append((active.graph, Val("iri", F.lit(f"{NAMESPACE}graph/{name}"))))
            vals: dict[str, Val] = {}
            for x, v in parts:
                if isinstance(x, Term):
                    rows = rows.where(_same(v, x)) if x is not s else rows
                elif x.name in vals:
                    rows = rows.where(as_term(vals[x.name]) == as_term(v))
                else:
                    vals[x.name] = v
            rel = Rel(rows, vals, frozenset(vals)).select(list(vals))
            out = rel if out is None else union(out, rel)
        return out if out is not None else self._star([(s, Term("iri", NAMESPACE + "none"), o)], active)

    def term_quads(self, names: list[str]) -> DataFrame:
        """(s, p, o, g) term structs of whole tables."""
        rel = self.scan(Var(".s"), Var(".q"), Var(".o"), Active(Var(".g")), names)
        return rel.df.select(*[as_term(rel.vals[n]).alias(c) for n, c in ((".s", "s"), (".q", "p"), (".o", "o"), (".g", "g"))])

    def graphs(self) -> DataFrame:
        return self.spark.createDataFrame([(f"{NAMESPACE}graph/{t}",) for t in self.tables], "g string")


def _equals(v: Val, t: Term) -> Column:
    """v = t for a constant; on an IRI lane the raw key is compared, so that the filter reaches the scan."""
    if v.kind == "iri" and v.prefix is not None:
        if t.kind != "iri" or not t.value.startswith(v.prefix) or not t.value[len(v.prefix) :].lstrip("-").isdigit():
            return F.lit(False)
        return v.col == int(t.value[len(v.prefix) :])
    return _same(v, t)


def _same(v: Val, t: Term) -> Column:
    c = constant(t)
    if c.kind == v.kind and c.kind not in ("lang", "term"):
        return v.col == c.col
    return F.coalesce(as_term(v) == as_term(c), F.lit(False))
