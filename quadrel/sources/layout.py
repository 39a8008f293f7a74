"""A stored layout of quads: a term dictionary with dense ids, sorted integer quads, and the counts that planning reads.

    terms/run=N       id, type, value, datatype, language; one row for each different term
    quads/run=N       subject, predicate, object, graph; each statement once over all runs, range-partitioned and
                      sorted by predicate, subject, object, so that file and row-group statistics skip what a pattern
                      with a constant can't match
    predicates/run=N  predicate, n: rows per predicate, after run N
    sets/run=N        predicates, subjects: characteristic sets, after run N

Each load is a run: terms and statements that are stored already are left out by joins, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrel.functions.lanes import BNODE, IRI, LANG, LITERAL, STRING, TERM_TYPE
from quadrel.runtime import Scratch
from quadrel.sources.store import DictionaryStore

_TERMS = "id long, type int, value string, datatype long, language string"
_QUADS = "subject long, predicate long, object long, graph long"


def runs(spark: SparkSession, path: str) -> int:
    """How many loads a folder holds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/sets")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return 0
    done = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("run=")]
    return len([p for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))])


def _stored(spark: SparkSession, path: str, name: str, schema: str, n: int) -> DataFrame:
    if not n:
        return spark.createDataFrame([], schema)
    return spark.read.schema(T._parse_datatype_string(schema)).parquet(*[f"{path}/{name}/run={i}" for i in range(n)])


def _numbered(df: DataFrame, first: int) -> DataFrame:
    """df with dense ids from `first` on: rows are numbered inside their partitions, partitions by their counts."""
    rows = Scratch(df.sparkSession).stage(df.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a task
    at, offsets = first, []
    for p in sorted(sizes):
        offsets.append((p, at))
        at += sizes[p]
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, "p long, base long"))
    return rows.join(table, part == F.col("p")).withColumn("id", F.col("base") + F.expr("_place & 8589934591")).drop("_place", "p", "base")


def _iri(text: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(IRI).alias("k"), text.alias("lex"), none.alias("dt"), none.alias("lang")).cast(TERM_TYPE)


def save(quads: DataFrame, path: str) -> int:
    """Adds (s, p, o, g) term structs to a stored layout; returns the number of the run.

    Rows with a null s, p or o state nothing; g may be null. Repeated statements are stored once, whichever run they
    come from. Empty input stores an empty run.
    """
    spark = quads.sparkSession
    n, scratch = runs(spark, path), Scratch(spark)
    old_terms, old_quads = _stored(spark, path, "terms", _TERMS, n), _stored(spark, path, "quads", _QUADS, n)
    new = scratch.stage(quads.select(*[F.col(c).cast(TERM_TYPE).alias(c) for c in "spog"]).where("s is not null and p is not null and o is not null").distinct())
    cells = new.select(F.explode(F.array("s", "p", "o", "g", F.when((F.col("o.k") == LITERAL) & ~F.col("o.dt").isin(STRING, LANG), _iri(F.col("o.dt"))))).alias("t")).where("t is not null").distinct()
    known = DictionaryStore(old_quads, old_terms).term_table()
    added = _numbered(cells.join(known, "t", "left_anti"), (old_terms.agg(F.max("id")).first()[0] or 0) + 1)
    every = scratch.stage(known.unionByName(added.select("id", "t")))
    names = every.where(F.col("t.k") == IRI).select(F.col("id").alias("datatype"), F.col("t.lex").alias("dt_name"))
    kind = F.when(F.col("t.k") == BNODE, 1).when(F.col("t.k") == IRI, 2).when(F.col("t.dt") == LANG, 16).when(F.col("t.dt") == STRING, 22).otherwise(17)
    rows = added.withColumn("type", kind).withColumn("dt_name", F.when(F.col("type") == 17, F.col("t.dt"))).join(names, "dt_name", "left")
    rows.select("id", F.col("type").cast("int").alias("type"), F.col("t.lex").alias("value"), "datatype", F.col("t.lang").alias("language")).write.mode("overwrite").parquet(f"{path}/terms/run={n}")

    coded = new
    for c, name in zip("spog", ("subject", "predicate", "object", "graph")):
        coded = coded.join(every.select(F.col("t").alias(c), F.col("id").alias(name)), c, "left").drop(c)
    have = old_quads.select(*[F.col(c).alias(f"_{c}") for c in ("subject", "predicate", "object", "graph")])
    on = (F.col("subject") == F.col("_subject")) & (F.col("predicate") == F.col("_predicate")) & (F.col("object") == F.col("_object")) & F.col("graph").eqNullSafe(F.col("_graph"))
    fresh = coded.join(have, on, "left_anti").select("subject", "predicate", "object", "graph")
    fresh.repartitionByRange("predicate", "subject", "object").sortWithinPartitions("predicate", "subject", "object").write.mode("overwrite").parquet(f"{path}/quads/run={n}")

    whole = _stored(spark, path, "quads", _QUADS, n + 1)
    whole.groupBy("predicate").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/predicates/run={n}")
    DictionaryStore(whole, old_terms).characteristic_sets().write.mode("overwrite").parquet(f"{path}/sets/run={n}")
    return n


def open_store(spark: SparkSession, path: str, default_graphs: list[str] | None = None) -> DictionaryStore:
    """The store of a folder; the predicates' counts, one row each, are read for the join order."""
    n = runs(spark, path)
    quads, terms = _stored(spark, path, "quads", _QUADS, n), _stored(spark, path, "terms", _TERMS, n)
    if not n:
        return DictionaryStore(quads, terms, default_graphs, stored_set=True, predicates={})
    counts = {r["predicate"]: r["n"] for r in spark.read.parquet(f"{path}/predicates/run={n - 1}").collect()}
    return DictionaryStore(quads, terms, default_graphs, True, counts, spark.read.parquet(f"{path}/sets/run={n - 1}"))


def decoded(store: DictionaryStore) -> DataFrame:
    """(s, p, o, g) term structs of a store's quads."""
    t, out = store.term_table(), store.quads
    for c, name in zip("spog", ("subject", "predicate", "object", "graph")):
        out = out.join(t.select(F.col("id").alias(name), F.col("t").alias(c)), name, "left")
    return out.select(*[F.col(c) for c in "spog"])
