"""Quad stores over DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrel.functions.lanes import BNODE, INTEGER, IRI, LANG, LITERAL, STRING, TERM_TYPE, Val, as_term, constant
from quadrel.operators.orphans import INLINE_BASE
from quadrel.operators.relation import Rel, fresh
from quadrel.plans.algebra import RDF, XSD, Term, Var
from quadrel.runtime import Scratch, small
from quadrel.sources.base import Active, Source

def term_frame(spark: SparkSession, quads) -> DataFrame:
    """(s, p, o, g) of term structs from Python tuples of Terms; g may be None."""
    rows = [tuple(None if t is None else ({"bnode": BNODE, "iri": IRI}.get(t.kind, LITERAL), t.value, t.datatype, t.language) for t in q) for q in quads]
    return spark.createDataFrame(rows, ", ".join(f"{c} {TERM_TYPE}" for c in "spog"))


#: A constant with more copies in the dictionary is matched by a join, not by a list of its ids.
LISTED = 1000


class TermStore(Source):
    """Quads of term structs (s, p, o, g), as the readers of RDF files give them.

    A store is a set: repeated quads count once. The default graph is the merge of `default_graphs`; if none are named
    it is the first graph in order, and the named graphs are all others.
    """

    def __init__(self, quads: DataFrame, default_graphs: list[str] | None = None, named_graphs: list[str] | None = None, version: int = 0):
        self.spark = quads.sparkSession
        self.quads = quads.dropDuplicates(["s", "p", "o", "g"])
        self.version = version
        self._default, self._named = default_graphs, named_graphs

    @property
    def default_graphs(self) -> list[str]:
        if self._default is None:
            first = self.quads.agg(F.min("g.lex").alias("g")).first()["g"]
            self._default = [] if first is None else [first]
        return self._default

    def dataset(self, default_graphs, named_graphs) -> TermStore:
        out = TermStore.__new__(TermStore)
        out.spark, out.quads, out.version = self.spark, self.quads, self.version
        out._default, out._named = list(default_graphs), list(named_graphs)
        return out

    def _named_rows(self) -> Column:
        if self._named is not None:
            return F.col("g.lex").isin(*self._named)
        return ~F.col("g.lex").isin(*self.default_graphs) if self.default_graphs else F.lit(True)

    def scan(self, s, p, o, active: Active) -> Rel:
        df, vals = self.quads, {}
        if active.graph is None:
            df = df.where(F.col("g.lex").isin(*self.default_graphs) if self.default_graphs else F.col("g").isNull())
            if len(self.default_graphs) > 1:  # an RDF merge: a triple in several graphs counts once
                df = df.dropDuplicates(["s", "p", "o"])
        else:
            df = df.where(self._named_rows())
        parts = [("s", s), ("p", p), ("o", o)] + ([("g", active.graph)] if active.graph is not None else [])
        for column, x in parts:
            if isinstance(x, Term):
                df = df.where(_is_term(F.col(column), x))
        names: dict[str, str] = {}
        cols = []
        for column, x in parts:
            if isinstance(x, Var):
                if x.name in names:
                    df = df.where(F.col(column) == F.col(names[x.name]))
                else:
                    names[x.name] = column
        for n, column in names.items():
            c = fresh(n.strip("."))
            cols.append((F.col(f"{column}.lex") if column in "pg" else F.col(column)).alias(c))
            vals[n] = Val("iri" if column in "pg" else "term", F.col(c))
        df = df.select(*cols) if cols else df.select(F.lit(1).alias(fresh()))
        return Rel(df, vals, frozenset(vals))

    def graphs(self) -> DataFrame:
        return self.quads.where(self._named_rows()).select(F.col("g.lex").alias("g")).distinct()

    def description(self) -> DataFrame:
        """(graph, predicate, triples): the predicate histogram of each graph."""
        return self.quads.groupBy(F.col("g.lex").alias("graph"), F.col("p.lex").alias("predicate")).agg(F.count(F.lit(1)).alias("triples"))

    def preferring(self, accept: dict[str, float], site: dict[str, float] | None = None) -> TermStore:
        """A view that keeps, for each (s, p, g), the objects of the best language; see best_language."""
        out = TermStore.__new__(TermStore)
        out.__dict__.update(self.__dict__)
        out.quads = best_language(self.quads, accept, site)
        return out


def best_language(quads: DataFrame, accept: dict[str, float], site: dict[str, float] | None = None) -> DataFrame:
    """Quads whose object has no language, and of each (s, p, g) those in the best language.

    accept maps language ranges to the reader's quality (`*` is any other), site to the site's own (1 where it says
    nothing). The product decides; ties go to the alphabetically first language; quality 0 is dropped. An empty
    `accept` keeps everything.
    """
    if not accept:
        return quads
    lang = F.lower(F.col("o.lang"))

    def quality(table: dict[str, float], otherwise: float) -> Column:
        q = F.lit(float(table.get("*", otherwise)))
        for tag, value in sorted(table.items(), key=lambda x: len(x[0])):
            if tag != "*":
                q = F.when((lang == tag.lower()) | lang.startswith(tag.lower() + "-"), F.lit(float(value))).otherwise(q)
        return q

    q = quality(accept, 0.0) * quality(site or {}, 1.0)
    tagged = quads.withColumn("_q", F.when(lang.isNotNull(), q)).withColumn("_l", lang)
    group = Window.partitionBy("s", "p", "g", F.col("_l").isNull())
    best = F.max(F.struct("_q", F.lit(0).alias("_z"))).over(group)["_q"]
    first = F.min(F.when(F.col("_q") == F.col("_best"), F.col("_l"))).over(group)
    kept = tagged.withColumn("_best", best).withColumn("_first", first).where(F.col("_l").isNull() | (F.col("_q") > 0) & (F.col("_l") == F.col("_first")))
    return kept.drop("_q", "_l", "_best", "_first")


def _is_term(c: Column, t: Term) -> Column:
    v = as_term(constant(t)) if t.kind != "literal" else None
    if v is not None:
        return (c["k"] == (IRI if t.kind == "iri" else BNODE)) & (c["lex"] == t.value)
    same = (c["k"] == LITERAL) & (c["lex"] == t.value) & (c["dt"] == t.datatype)
    return same & (c["lang"] == t.language) if t.language else same


class DictionaryStore(Source):
    """Integer quads over a term dictionary: joins run on ids, terms are looked up only where a value is needed.

    quads: subject, predicate, object, graph; terms: id, type, value, datatype, language. A null object is no
    statement. Constants of a query match every id that holds the very term: kind, text, datatype and language. Two
    ids of one term are two terms for joins, as the stored ids say; merged() gives a store in which they are one.

    stored_set: the quads are known to hold each statement once per graph, as stored layouts do. predicates: rows of
    each predicate's id, if they are stored; the join order reads them.
    """

    def __init__(self, quads: DataFrame, terms: DataFrame, default_graphs: list[str] | None = None, stored_set: bool = False, predicates: dict[int, int] | None = None, sets: DataFrame | None = None):
        self.spark = quads.sparkSession
        self.raw = quads
        self.quads = quads.select("subject", "predicate", "object", "graph").where("subject is not null and predicate is not null and object is not null")
        self.terms = terms.where("id is not null")
        self._default, self.stored_set, self.predicates, self._sets = default_graphs, stored_set, predicates, sets

    def merged(self) -> DictionaryStore:
        """The store with every term under one id, the smallest: statements about copies of a term meet.

        Only quads that hold a copy are changed; the table of copies is joined once for each position.
        """
        t = self.term_table()
        first = t.groupBy("t").agg(F.min("id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
        copies = Scratch(self.spark).stage(t.join(first, "t").where("id <> kept").select(F.col("id").alias("copy"), "kept"))
        quads = self.raw
        for c in ("subject", "predicate", "object", "graph"):
            one = copies.select(F.col("copy").alias(f"_{c}"), F.col("kept").alias(f"_k{c}"))
            quads = quads.join(one, F.col(c) == F.col(f"_{c}"), "left").withColumn(c, F.coalesce(f"_k{c}", c)).drop(f"_{c}", f"_k{c}")
        terms = self.terms.join(copies.select(F.col("copy").alias("id")), "id", "left_anti")
        return DictionaryStore(quads, terms, self._default)

    def _rows_of(self, t: Term) -> DataFrame:
        """The dictionary's rows that hold a constant, with their id."""
        rows = self.terms.where(F.col("value") == t.value)
        if t.kind != "literal":
            return rows.where(F.col("type") == (2 if t.kind == "iri" else 1)).select("id")
        rows = self.term_table(rows)
        same = (F.col("t.k") == LITERAL) & (F.col("t.dt") == t.datatype)
        return rows.where(same & (F.col("t.lang") == t.language.lower() if t.language else F.col("t.lang").isNull()))

    def ids(self, t: Term) -> list[int]:
        """The ids of a constant: one, or as many as the dictionary has copies of the term."""
        if t not in self._ids:
            inlined = [INLINE_BASE + int(t.value)] if t.kind == "literal" and t.datatype == INTEGER and t.value.isdigit() and str(int(t.value)) == t.value else []
            self._ids[t] = inlined + [r["id"] for r in self._rows_of(t).select("id").toLocalIterator()]
        return self._ids[t]

    def prefetch(self, constants: list[Term]) -> None:
        """The ids of all IRIs of a query in one job."""
        wanted = {t.value: t for t in constants if t.kind == "iri" and t not in self._ids}
        if len(wanted) > 1:
            found: dict[Term, list[int]] = {t: [] for t in wanted.values()}
            for r in self.terms.where((F.col("type") == 2) & F.col("value").isin(*wanted)).select("value", "id").toLocalIterator():
                found[wanted[r["value"]]].append(r["id"])
            self._ids.update(found)

    @cached_property
    def _ids(self) -> dict[Term, list[int]]:
        return {}

    def _match(self, df: DataFrame, column: str, t: Term) -> DataFrame:
        """Rows whose id is one of a constant's: as a list that reaches the scan, or by a join if the copies are many."""
        ids = self.ids(t)
        if len(ids) > LISTED:
            return df.join(self._rows_of(t).select(F.col("id").alias(column)), column, "left_semi")
        return df.where(F.col(column).isin(*ids) if ids else F.lit(False))

    def matches(self, triple: tuple) -> float | None:
        """Stored rows of the predicate; a fixed subject or object leaves the rows of one term on average."""
        if self.predicates is None:
            return None
        s, p, o = triple
        every = sum(self.predicates.values())
        n = sum(self.predicates.get(i, 0) for i in self.ids(p)) if isinstance(p, Term) else every
        fixed = isinstance(s, Term) + isinstance(o, Term)
        return n / max(1, every) ** (fixed / 2)

    def scan(self, s, p, o, active: Active) -> Rel:
        df = self.quads
        parts = [("subject", s), ("predicate", p), ("object", o)]
        if active.graph is not None:
            parts.append(("graph", active.graph))
            df = df.where("graph is not null")
        elif self._default is not None:
            ids = [i for g in self._default for i in self.ids(Term("iri", g))]
            df = df.where(F.col("graph").isin(*ids) if ids else F.lit(False))
        names: dict[str, str] = {}
        for column, x in parts:
            if isinstance(x, Term):
                df = self._match(df, column, x)
            elif x.name in names:
                df = df.where(F.col(column) == F.col(names[x.name]))
            else:
                names[x.name] = column
        # a store is a set, and the default graph a merge of graphs; constants need not be compared again. A stored set
        # that is read graph by graph needs no shuffle for that
        df = df.select(*[c for c, x in parts if isinstance(x, Var)] or ["predicate"])
        if not (self.stored_set and isinstance(active.graph, Var) and _one_each(parts, self)):
            df = df.distinct()
        vals, cols = {}, []
        for n, column in names.items():
            c = fresh(n.strip("."))
            cols.append(F.col(column).alias(c))
            vals[n] = Val("id", F.col(c))
        return Rel(df.select(*cols) if cols else df.select(F.lit(1).alias(fresh())), vals, frozenset(vals))

    def effective_version(self, triples) -> DataFrame:
        """One row, `version`: the latest dataset_version of the quads that match any of the patterns; null if none does."""
        parts = []
        for t in triples:
            df = self.raw
            for column, x in zip(("subject", "predicate", "object"), t):
                if isinstance(x, Term):
                    df = self._match(df, column, x)
            parts.append(df.agg(F.max("dataset_version").alias("version")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.agg(F.max("version").alias("version"))

    def characteristic_sets(self) -> DataFrame:
        """(predicates, subjects): how many subjects have exactly these predicates; counts of stars come from it.

        A stored layout keeps them; else they are counted from the quads."""
        if self._sets is not None:
            return self._sets
        pairs = self.quads.select("subject", "predicate").distinct()
        sets = pairs.groupBy("subject").agg(F.array_sort(F.collect_list("predicate")).alias("predicates"))
        return sets.groupBy("predicates").agg(F.count(F.lit(1)).alias("subjects"))

    def star_count(self, predicates: list[Term]) -> DataFrame:
        """One row, `n`: subjects that have all these predicates, answered from the characteristic sets."""
        sets = self.characteristic_sets()
        for p in predicates:
            ids = self.ids(p)
            sets = sets.where(F.arrays_overlap("predicates", F.array(*[F.lit(i).cast("long") for i in ids])) if ids else F.lit(False))
        return sets.agg(F.coalesce(F.sum("subjects"), F.lit(0)).alias("n"))

    def best_language(self, accept: dict[str, float], site: dict[str, float] | None = None) -> DataFrame:
        """(subject, predicate, object, graph) with the objects of the best language; see best_language()."""
        tags = self.terms.where("type = 16").select(F.col("id").alias("object"), F.replace(F.trim("language"), F.lit("_"), F.lit("-")).alias("lang"))
        rows = self.quads.distinct().join(tags, "object", "left")
        shaped = rows.select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("graph").alias("g"), F.struct("object", "lang").alias("o"))
        kept = best_language(shaped, accept, site)
        return kept.select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o.object").alias("object"), F.col("g").alias("graph"))

    def term_table(self, some: DataFrame | None = None) -> DataFrame:
        """(id, t): every dictionary row, or some, as a term struct."""
        named = self._datatypes
        k = F.when(F.col("type") == 1, BNODE).when(F.col("type") == 2, IRI).otherwise(LITERAL)
        rows = (self.terms if some is None else some).join(named, F.col("datatype") == F.col("dt_id"), "left")
        dt = F.when(k == LITERAL, F.when(F.col("type") == 16, F.lit(LANG)).otherwise(F.coalesce("dt", F.lit(STRING))))
        lang = F.when(F.col("type") == 16, F.translate(F.lower(F.trim(F.col("language"))), "_", "-"))
        return rows.select("id", F.struct(k.cast("int").alias("k"), F.col("value").alias("lex"), dt.alias("dt"), lang.alias("lang")).alias("t"))

    @cached_property
    def _datatypes(self) -> DataFrame:
        """(dt_id, dt): the IRIs of the datatypes that are used, a few, found once for the store."""
        used = self.terms.where("datatype is not null").select(F.col("datatype").alias("used")).distinct()
        named = self.terms.join(small(used), F.col("id") == F.col("used")).select(F.col("used").alias("dt_id"), _expanded(F.col("value")).alias("dt"))
        return small(Scratch(self.spark).stage(named))

    def materialise(self, rel: Rel, names) -> Rel:
        for n in names:
            v = rel.vals.get(n)
            if v is None or v.kind != "id":
                continue
            rid, rt, out = fresh("id"), fresh("t"), fresh(n.strip("."))
            table = self.term_table().select(F.col("id").alias(rid), F.col("t").alias(rt))
            inline = F.struct(F.lit(LITERAL).cast("int").alias("k"), (v.col - INLINE_BASE).cast("string").alias("lex"), F.lit(INTEGER).alias("dt"), F.lit(None).cast("string").alias("lang"))
            # an id that leads nowhere stays a term: a blank node named by its id
            lost = F.struct(F.lit(BNODE).cast("int").alias("k"), F.concat(F.lit("id"), v.col.cast("string")).alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
            term = F.when(v.col >= INLINE_BASE, inline).when(v.col.isNotNull(), F.coalesce(F.col(rt), lost))
            df = rel.df.join(table, v.col == F.col(rid), "left").withColumn(out, term).drop(rid, rt)
            rel = Rel(df, {**rel.vals, n: Val("term", F.col(out))}, rel.bound)
        return rel

    def graphs(self) -> DataFrame:
        ids = self.quads.where("graph is not null").select(F.col("graph").alias("id")).distinct()
        return ids.join(self.terms, "id").select(F.col("value").alias("g"))


def _one_each(parts, store: DictionaryStore) -> bool:
    """Whether dropping the constant columns of a stored set can't make two rows equal: each constant is one id."""
    return all(not isinstance(x, Term) or len(store.ids(x)) < 2 for _, x in parts)


def _expanded(c: Column) -> Column:
    text = F.regexp_replace(F.lower(F.trim(c)), "^<(.*)>$", "$1")
    cased = F.element_at(F.create_map(*[x for n in ("string", "integer", "decimal", "double", "float", "boolean", "date", "dateTime") for x in (F.lit("xsd:" + n.lower()), F.lit(XSD + n))]), text)
    return F.coalesce(F.when(text.startswith("xsd:"), F.coalesce(cased, F.concat(F.lit(XSD), F.substring_index(text, ":", -1)))), F.when(text.startswith("rdf:"), F.concat(F.lit(RDF), F.substring_index(c, ":", -1))), c)
