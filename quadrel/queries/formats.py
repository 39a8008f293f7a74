"""Registered queries of readers, writers, services, streams, the graph view and the stack language, each with its SQL.

They go through files in the shared folder, so what is checked is what was written and read again.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrel.functions.lanes import Val
from quadrel.operators.graph import GraphView
from quadrel.plans import stack
from quadrel.plans.algebra import Term, Var, iri
from quadrel.plans.compiler import Compiler, Engine
from quadrel.queries.sparql import CUST, PREFIX, _mapped_store
from quadrel.runtime import Scratch, shared_dir, table
from quadrel.sources import layout, ntriples, results, turtle
from quadrel.sources.base import Active
from quadrel.sources.service import EndpointStore, FragmentStore
from quadrel.sources.store import DictionaryStore, TermStore
from quadrel.streaming.push import load_stream, push

T = "http://tables.example/"


def _quads(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """(s, p, o, g) term structs of whole mapped tables."""
    return _mapped_store(spark, d).term_quads(list(names))


def _text(quads: DataFrame) -> DataFrame:
    return quads.select(F.col("s.lex").alias("s"), F.col("p.lex").alias("p"), F.col("o.lex").alias("o"), F.col("o.dt").alias("dt"))


def _place(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, gone with the session."""
    return f"{Scratch(spark).base}/{name}"


def _file(spark: SparkSession, name: str, text: str) -> str:
    """A text of bounded size as one file."""
    path = _place(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


# ---------------------------------------------------------------- readers and writers

def nquads_round_trip(spark, d):
    path = _place(spark, "quads.nq")
    ntriples.write(_quads(spark, d, "customer"), path)
    got = ntriples.read(spark, path)
    return got.where(F.col("o.dt").isNull() | ~F.col("o.dt").endswith("double")).select(F.col("s.lex").alias("s"), F.col("p.lex").alias("p"), F.col("o.lex").alias("o"), F.col("g.lex").alias("g"))


def ntriples_round_trip(spark, d):
    path = _place(spark, "triples.nt")
    ntriples.write(_quads(spark, d, "part").select("s", "p", "o"), path)
    got = results.read_rdf(spark, path, media="application/n-triples", graph="http://g")
    return got.groupBy(F.col("p.lex").alias("p"), F.col("o.dt").alias("dt"), F.col("g.lex").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s.lex").alias("subjects"))


def turtle_round_trip(spark, d):
    text = turtle.serialize(turtle.rows_of(_quads(spark, d, "nation", "region")), {"t": T})
    return _text(results.read_rdf(spark, _file(spark, "tables.ttl", text), "http://g", "text/turtle"))


def rdfxml_read(spark, d):
    body = "".join(f'<t:nation rdf:about="nation/{r["n_nationkey"]}"><t:n_name>{r["n_name"]}</t:n_name><t:n_regionkey rdf:resource="region/{r["n_regionkey"]}"/></t:nation>' for r in table(spark, d, "nation").collect())
    text = f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:t="{T}" xml:base="{T}">{body}</rdf:RDF>'
    return _text(results.read_rdf(spark, _file(spark, "tables.rdf", text), media="application/rdf+xml")).drop("dt")


_NAMES = PREFIX + "SELECT ?n ?k { ?x t:n_name ?n OPTIONAL { ?x t:n_regionkey ?r . ?r t:r_name 'ASIA' ; t:r_regionkey ?k } }"


def _bindings(spark, d) -> results.Bindings:
    return results.of_frame(Engine(_mapped_store(spark, d)).terms(_NAMES))


def _shown(spark, got: results.Bindings) -> DataFrame:
    rows = [(r["n"].value, int(r["k"].value) if "k" in r else None) for r in got.rows]
    return spark.createDataFrame(rows, "n string, k long")


def results_json(spark, d):
    return _shown(spark, results.from_json(results.to_json(_bindings(spark, d))))


def results_xml(spark, d):
    return _shown(spark, results.from_xml(results.to_xml(_bindings(spark, d))))


def results_tsv(spark, d):
    return _shown(spark, results.from_tsv(results.to_tsv(_bindings(spark, d))))


def results_distributed(spark, d):
    """A result of any size as JSON, XML and TSV rows, written by all tasks: one line a solution, told apart by form."""
    terms = Engine(_mapped_store(spark, d)).terms(PREFIX + "SELECT ?c ?s { ?c t:c_mktsegment ?s }")
    forms = [f(terms).select(F.lit(n).alias("form"), "value") for n, f in (("json", results.frame_json), ("xml", results.frame_xml), ("tsv", results.frame_tsv))]
    return forms[0].unionByName(forms[1]).unionByName(forms[2])


def negotiated(spark, d):
    """The format chosen for each kind of result and accepted type."""
    kinds = {"boolean": True, "bindings": results.Bindings([], []), "triples": results.Triples([])}
    wanted = ["*/*", "text/turtle", "text/tab-separated-values", "application/sparql-results+xml", "application/json;q=0.5"]
    rows = [(k, w, getattr(results.negotiate(r, [w]), "media", None)) for k, r in kinds.items() for w in wanted]
    return spark.createDataFrame(rows, "kind string, accept string, media string")


# ---------------------------------------------------------------- stores

def termstore_graphs(spark, d):
    store = TermStore(_quads(spark, d, "nation", "region", "customer"), [T + "graph/customer"])
    return Engine(store).query(PREFIX + "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g")


def termstore_join(spark, d):
    store = TermStore(_quads(spark, d, "nation", "region"), [T + "graph/nation", T + "graph/region"])
    return Engine(store).query(PREFIX + "SELECT ?a ?b { ?x t:n_name ?a ; t:n_regionkey ?y . ?y t:r_name ?b FILTER(?b != 'ASIA') }")


def stored_layout(spark, d):
    """Two loads that overlap: the dictionary and the quads stay sets."""
    path = _place(spark, "store")
    layout.save(_quads(spark, d, "nation", "customer"), path)
    layout.save(_quads(spark, d, "nation", "region"), path)
    return Engine(layout.open_store(spark, path)).query(PREFIX + "SELECT ?r (COUNT(*) AS ?n) { ?c t:c_nationkey ?x . ?x t:n_regionkey ?y . ?y t:r_name ?r } GROUP BY ?r")


def stored_star_count(spark, d):
    path = _place(spark, "store")
    layout.save(_quads(spark, d, "customer", "supplier"), path)
    return layout.open_store(spark, path).star_count([iri(T + "c_name"), iri(T + "c_mktsegment")])


def _remote(spark, d):
    """A stand-in for the wire: evaluates what an endpoint would get."""

    def client(endpoint: str, text: str):
        got = results.from_json(results.to_json(results.of_frame(Engine(_mapped_store(spark, d)).terms(text))))
        return got.names, got.rows

    return client


def service_join(spark, d):
    engine = Engine(_mapped_store(spark, d), _remote(spark, d))
    return engine.query(PREFIX + "SELECT ?r (COUNT(*) AS ?n) { ?c t:c_nationkey ?x SERVICE <http://far.example/sparql> { ?x t:n_regionkey/t:r_name ?r } } GROUP BY ?r")


def service_silent(spark, d):
    def broken(endpoint: str, text: str):
        raise RuntimeError("no answer")

    return Engine(_mapped_store(spark, d), broken).query(PREFIX + "SELECT ?n { ?x t:r_name ?n SERVICE SILENT <http://far.example/sparql> { ?x t:n ?y } }")


def endpoint_store(spark, d):
    return Engine(EndpointStore(spark, "http://far.example/sparql", _remote(spark, d))).query(PREFIX + "SELECT ?n ?r { ?x t:n_name ?n ; t:n_regionkey ?y . ?y t:r_name ?r }")


def fragment_store(spark, d):
    """Fragments of 10 triples a page, served from the nations' triples."""
    triples = sorted(turtle.rows_of(_quads(spark, d, "nation", "region")), key=str)

    def page(url: str, accept: str):
        number, asked = url.split("/page/")[1].split("?", 1)
        want = [unquote(part.split("=", 1)[1]) for part in asked.split("&")]
        hits = [t for t in triples if all(not w or x.value == w for x, w in zip(t, want))]
        at = int(number) * 10
        text = turtle.serialize(hits[at : at + 10])
        if len(hits) > at + 10:
            text += f"<http://far.example/f> <http://www.w3.org/ns/hydra/core#next> <http://far.example/page/{int(number) + 1}?{asked}> .\n"
        return "text/turtle", text

    return Engine(FragmentStore(spark, "http://far.example/page/0?s={subject}&p={predicate}&o={object}", page)).query(PREFIX + "SELECT ?n ?r { ?x t:n_name ?n ; t:n_regionkey ?y . ?y t:r_name ?r }")


# ---------------------------------------------------------------- streams

def stream_load(spark, d):
    """Files that arrive one after the other; one holds a line that is no statement."""
    inbox, out, mark, bad = (_place(spark, n) for n in ("in", "table", "mark", "rejects"))
    lines = ntriples.lines_of(_quads(spark, d, "customer").where("p.lex like '%c_mktsegment'").select("s", "p", "o"))
    lines.write.text(inbox)
    load_stream(spark, inbox, out, mark, rejects=bad).awaitTermination()
    spark.createDataFrame([("nonsense",), ("<http://a> <http://p> _:x .",)], "value string").coalesce(1).write.mode("append").text(inbox)
    load_stream(spark, inbox, out, mark, rejects=bad).awaitTermination()
    kept = spark.read.parquet(out).select(F.when(F.col("o.k") == 1, "blank").otherwise(F.col("o.lex")).alias("what"))
    return kept.unionByName(spark.read.parquet(bad).select(F.col("value").alias("what"))).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


def push_results(spark, d):
    """What a callback was handed, row by row."""
    seen: list[tuple] = []
    push(table(spark, d, "nation").select("n_nationkey", "n_name"), lambda r: seen.append((r["n_nationkey"], r["n_name"])))
    return spark.createDataFrame(seen, "k int, name string")


# ---------------------------------------------------------------- graph view

def _view(spark, d, *names: str) -> GraphView:
    return GraphView(_quads(spark, d, *names))


def graph_vertices(spark, d):
    return _view(spark, d, "customer").vertices().where("v.k < 3").select(F.col("v.lex").alias("v"))


def graph_instances(spark, d):
    return _view(spark, d, "customer", "nation").instances_of(T + "customer").select(F.col("v.lex").alias("v"))


def graph_extension(spark, d):
    return _view(spark, d, "customer").extension_of(T + "c_nationkey").select(F.col("s.lex").alias("s"), F.col("o.lex").alias("o"))


def graph_outgoing(spark, d):
    view, v = _view(spark, d, "nation"), iri(T + "nation/3")
    return view.outgoing(v).select(F.lit("predicate").alias("what"), F.col("p").alias("v")).unionByName(view.outgoing(v, T + "n_regionkey").select(F.lit("vertex").alias("what"), F.col("v.lex").alias("v")))


def graph_incoming(spark, d):
    view, v = _view(spark, d, "customer", "supplier"), iri(T + "nation/3")
    return view.incoming(v).select(F.lit("predicate").alias("what"), F.col("p").alias("v")).unionByName(view.incoming(v, T + "c_nationkey").select(F.lit("vertex").alias("what"), F.col("v.lex").alias("v")))


def graph_edges(spark, d):
    return _view(spark, d, "supplier", "nation").edges(iri(T + "nation/3")).select(F.col("s.lex").alias("s"), F.col("p.lex").alias("p"))


def graph_names(spark, d):
    return _view(spark, d, "supplier", "nation", "customer", "region").graphs(iri(T + "nation/3"))


def list_walk(spark, d):
    """RDF lists of each customer's orders by number, one cell an order, read back in order."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    next_ = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    none = F.lit(None).cast("string")
    node = lambda c: F.struct(F.lit(2).alias("k"), c.alias("lex"), none.alias("dt"), none.alias("lang"))
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    cell, rest = F.concat(F.lit("c"), F.col("o_orderkey").cast("string")), F.coalesce(F.concat(F.lit("c"), next_.cast("string")), F.lit(rdf + "nil"))
    item = F.struct(F.lit(3).alias("k"), F.col("o_orderkey").cast("string").alias("lex"), F.lit("http://www.w3.org/2001/XMLSchema#integer").alias("dt"), none.alias("lang"))
    linked = o.select(node(cell).alias("s"), node(rest).alias("rest"), item.alias("item"))
    triples = F.array(F.struct(node(F.lit(rdf + "first")).alias("p"), F.col("item").alias("o")), F.struct(node(F.lit(rdf + "rest")).alias("p"), F.col("rest").alias("o")))
    quads = linked.select("s", F.inline(triples)).withColumn("g", node(F.lit("http://g")))
    return GraphView(quads).lists().select("head", F.array_join(F.transform("items", lambda x: x["lex"]), " ").alias("items"))


# ---------------------------------------------------------------- stack language and custom functions

def stack_between(spark, d):
    text = f"triple ?o <{T}o_totalprice> ?p\ntriple ?o <{T}o_orderstatus> ?s\njoin\nfilter ?p 100000 200000 between\nproject o s"
    return Compiler(_mapped_store(spark, d)).solutions(stack.parse(text)).frame()


def stack_aggregate(spark, d):
    text = f"triple ?c <{T}c_nationkey> ?n\ntriple ?n <{T}n_name> ?name\njoin\nagg countall k ; ?name\nfilter ?k 5 >\nsort ?name"
    return Compiler(_mapped_store(spark, d)).solutions(stack.parse(text)).frame()


def stack_leftjoin(spark, d):
    text = f"triple ?n <{T}n_name> ?name\ntriple ?s <{T}s_nationkey> ?n\nleftjoin\nextend x ?name\ndistinct\nproject name s"
    return Compiler(_mapped_store(spark, d)).solutions(stack.parse(text)).frame()


def custom_function(spark, d):
    engine = Engine(_mapped_store(spark, d))
    engine.register("http://f.example/initial", lambda v: Val("str", F.substring(v.col, 1, 1)))
    return engine.query(PREFIX + "SELECT ?i (COUNT(*) AS ?n) { ?p t:p_name ?name } GROUP BY (<http://f.example/initial>(?name) AS ?i)")


def store_copies(spark, d):
    """Statements about copies of a term meet: names of a known thing, over one id for each term."""
    store = DictionaryStore(table(spark, d, "quads"), table(spark, d, "terms")).merged()
    return Engine(store).query("SELECT (COUNT(*) AS ?n) (COUNT(DISTINCT ?s) AS ?subjects) { ?s <rdfs:label>|<dc:subject>|<foaf:name>|<dc:title> ?o . ?t <rdfs:label>|<dc:subject>|<foaf:name>|<dc:title> ?o }")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            nquads_round_trip, ntriples_round_trip, turtle_round_trip, rdfxml_read, results_json, results_xml, results_tsv, results_distributed, negotiated, termstore_graphs, termstore_join, stored_layout, stored_star_count, service_join, service_silent, endpoint_store, fragment_store,
            stream_load, push_results, graph_vertices, graph_instances, graph_extension, graph_outgoing, graph_incoming, graph_edges, graph_names, list_walk, stack_between, stack_aggregate, stack_leftjoin, custom_function, store_copies,
        )
    }


_X = "http://www.w3.org/2001/XMLSchema#"
_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_NATION, _REGION = f"'{T}nation/' || n_nationkey", f"'{T}region/' || r_regionkey"
_NATIONS = "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"
_BOUND = "SELECT n_name AS n, CASE WHEN r_name = 'ASIA' THEN CAST(r_regionkey AS BIGINT) END AS k FROM nation JOIN region ON n_regionkey = r_regionkey"
_COPIES = """WITH dt AS (SELECT id, CASE WHEN lower(trim(value)) LIKE '<%>' THEN substr(lower(trim(value)), 2, length(trim(value)) - 2) ELSE lower(trim(value)) END AS dt FROM terms WHERE id IN (SELECT datatype FROM terms)),
  t AS (SELECT terms.id, CASE type WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS k, value, CASE WHEN type IN (1, 2) THEN '' WHEN type = 16 THEN 'lang' ELSE coalesce(dt.dt, 'xsd:string') END AS d, CASE WHEN type = 16 THEN replace(lower(trim(language)), '_', '-') END AS l FROM terms LEFT JOIN dt ON dt.id = datatype),
  m AS (SELECT id, min(id) OVER (PARTITION BY k, value, d, l) AS kept FROM t),
  q AS (SELECT DISTINCT coalesce(s.kept, subject) AS subject, coalesce(p.kept, predicate) AS predicate, coalesce(o.kept, object) AS object FROM quads LEFT JOIN m s ON s.id = subject LEFT JOIN m p ON p.id = predicate LEFT JOIN m o ON o.id = object WHERE subject IS NOT NULL AND object IS NOT NULL),
  e AS (SELECT subject, object FROM q WHERE predicate IN (SELECT kept FROM m JOIN terms USING (id) WHERE type = 2 AND value IN ('rdfs:label', 'dc:subject', 'foaf:name', 'dc:title')))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "nquads_round_trip": f"""SELECT s, p, o, '{T}graph/customer' AS g FROM (SELECT {CUST} AS s, '{_TYPE}' AS p, '{T}customer' AS o FROM customer UNION ALL SELECT {CUST}, '{T}c_custkey', CAST(c_custkey AS VARCHAR) FROM customer
            UNION ALL SELECT {CUST}, '{T}c_name', c_name FROM customer UNION ALL SELECT {CUST}, '{T}c_nationkey', '{T}nation/' || c_nationkey FROM customer UNION ALL SELECT {CUST}, '{T}c_mktsegment', c_mktsegment FROM customer) x""",
        "ntriples_round_trip": f"""SELECT p, dt, 'http://g' AS g, n, n AS subjects FROM (SELECT count(*) AS n FROM part) x, (VALUES ('{_TYPE}', NULL), ('{T}p_partkey', '{_X}integer'), ('{T}p_name', '{_X}string'), ('{T}p_brand', '{_X}string'), ('{T}p_type', '{_X}string'), ('{T}p_size', '{_X}integer'), ('{T}p_retailprice', '{_X}double')) v(p, dt)""",
        "turtle_round_trip": f"""SELECT {_NATION} AS s, '{_TYPE}' AS p, '{T}nation' AS o, NULL AS dt FROM nation UNION ALL SELECT {_NATION}, '{T}n_nationkey', CAST(n_nationkey AS VARCHAR), '{_X}integer' FROM nation UNION ALL SELECT {_NATION}, '{T}n_name', n_name, '{_X}string' FROM nation
            UNION ALL SELECT {_NATION}, '{T}n_regionkey', '{T}region/' || n_regionkey, NULL FROM nation UNION ALL SELECT {_REGION}, '{_TYPE}', '{T}region', NULL FROM region UNION ALL SELECT {_REGION}, '{T}r_regionkey', CAST(r_regionkey AS VARCHAR), '{_X}integer' FROM region UNION ALL SELECT {_REGION}, '{T}r_name', r_name, '{_X}string' FROM region""",
        "rdfxml_read": f"SELECT {_NATION} AS s, '{_TYPE}' AS p, '{T}nation' AS o FROM nation UNION ALL SELECT {_NATION}, '{T}n_name', n_name FROM nation UNION ALL SELECT {_NATION}, '{T}n_regionkey', '{T}region/' || n_regionkey FROM nation",
        "results_json": _BOUND,
        "results_xml": _BOUND,
        "results_tsv": _BOUND,
        "results_distributed": f"""SELECT 'json' AS form, '{{"c":{{"type":"uri","value":"' || {CUST} || '"}},"s":{{"datatype":"{_X}string","type":"literal","value":"' || c_mktsegment || '"}}}}' AS value FROM customer
            UNION ALL SELECT 'xml', '<result><binding name="c"><uri>' || {CUST} || '</uri></binding><binding name="s"><literal datatype="{_X}string">' || c_mktsegment || '</literal></binding></result>' FROM customer
            UNION ALL SELECT 'tsv', '<' || {CUST} || '>' || chr(9) || '"' || c_mktsegment || '"' FROM customer""",
        "negotiated": """SELECT k AS kind, a AS accept, CASE WHEN k = 'triples' THEN CASE WHEN a IN ('*/*', 'text/turtle') THEN 'application/turtle' END
              WHEN a = '*/*' OR a LIKE 'application/json%' THEN 'application/sparql-results+json' WHEN a = 'application/sparql-results+xml' THEN a WHEN a = 'text/tab-separated-values' AND k = 'bindings' THEN a END AS media
            FROM (VALUES ('boolean'), ('bindings'), ('triples')) x(k), (VALUES ('*/*'), ('text/turtle'), ('text/tab-separated-values'), ('application/sparql-results+xml'), ('application/json;q=0.5')) y(a)""",
        "termstore_graphs": f"SELECT '{T}graph/nation' AS g, 4 * count(*) AS n FROM nation UNION ALL SELECT '{T}graph/region', 3 * count(*) FROM region",
        "termstore_join": "SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'",
        "stored_layout": "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
        "stored_star_count": "SELECT count(*) AS n FROM customer",
        "service_join": "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
        "service_silent": "SELECT r_name AS n FROM region",
        "endpoint_store": _NATIONS,
        "fragment_store": _NATIONS,
        "stream_load": "SELECT c_mktsegment AS what, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'nonsense', 1 UNION ALL SELECT 'blank', 1",
        "push_results": "SELECT n_nationkey AS k, n_name AS name FROM nation",
        "graph_vertices": f"SELECT {CUST} AS v FROM customer UNION SELECT '{T}nation/' || c_nationkey FROM customer UNION SELECT '{T}customer'",
        "graph_instances": f"SELECT {CUST} AS v FROM customer",
        "graph_extension": f"SELECT {CUST} AS s, '{T}nation/' || c_nationkey AS o FROM customer",
        "graph_outgoing": f"SELECT 'predicate' AS what, unnest(['{_TYPE}', '{T}n_nationkey', '{T}n_name', '{T}n_regionkey']) AS v UNION ALL SELECT 'vertex', '{T}region/' || n_regionkey FROM nation WHERE n_nationkey = 3",
        "graph_incoming": f"SELECT DISTINCT 'predicate' AS what, '{T}c_nationkey' AS v FROM customer WHERE c_nationkey = 3 UNION ALL SELECT DISTINCT 'predicate', '{T}s_nationkey' FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'vertex', {CUST} FROM customer WHERE c_nationkey = 3",
        "graph_edges": f"SELECT '{T}supplier/' || s_suppkey AS s, '{T}s_nationkey' AS p FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT '{T}nation/3', unnest(['{_TYPE}', '{T}n_nationkey', '{T}n_name', '{T}n_regionkey'])",
        "graph_names": f"SELECT '{T}graph/nation' AS g UNION ALL SELECT DISTINCT '{T}graph/supplier' FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT DISTINCT '{T}graph/customer' FROM customer WHERE c_nationkey = 3",
        "list_walk": "SELECT 'c' || min(o_orderkey) AS head, string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderkey) AS items FROM orders GROUP BY o_custkey HAVING count(*) > 0",
        "stack_between": f"SELECT '{T}orders/' || o_orderkey AS o, o_orderstatus AS s FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000",
        "stack_aggregate": "SELECT n_name AS name, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 5",
        "stack_leftjoin": f"SELECT DISTINCT n_name AS name, '{T}supplier/' || s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey",
        "custom_function": "SELECT substr(p_name, 1, 1) AS i, count(*) AS n FROM part GROUP BY 1",
        "store_copies": _COPIES + "SELECT count(*) AS n, count(DISTINCT a.subject) AS subjects FROM e a JOIN e b ON a.object = b.object",
    }
