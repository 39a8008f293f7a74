import io
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from quadrel import __main__ as cli
from quadrel.operators.graph import GraphView
from quadrel.plans.algebra import RDF, XSD, Term, iri, literal
from quadrel.plans.compiler import Engine
from quadrel.sources import layout, results
from quadrel.sources.mapping import MappedStore
from quadrel.sources.service import Client, EndpointStore, FragmentStore
from quadrel.sources.store import DictionaryStore, TermStore, best_language, term_frame
from quadrel.runtime import shared_dir
from quadrel.streaming.push import load_stream, push

G = iri("http://g")


def test_graph_view(spark):
    cells = [Term("bnode", f"c{i}") for i in range(5)]
    items = [literal(str(x), XSD + "integer") for x in (1, 3, 9, 4, 2)]
    quads = [(c, iri(RDF + "first"), v, G) for c, v in zip(cells, items)]
    quads += [(c, iri(RDF + "rest"), n, G) for c, n in zip(cells, [*cells[1:], iri(RDF + "nil")])]
    quads += [(Term("bnode", "q"), iri(RDF + "rest"), Term("bnode", "q"), G), (iri("http://p1"), iri(RDF + "type"), iri("http://Person"), G), (iri("http://p1"), iri("http://knows"), iri("http://p2"), iri("http://h"))]
    view = GraphView(term_frame(spark, quads))
    got = view.lists().collect()
    assert len(got) == 1 and got[0]["head"] == "c0" and [x["lex"] for x in got[0]["items"]] == ["1", "3", "9", "4", "2"]
    assert view.instances_of("http://Person").count() == 1
    p1, p2 = iri("http://p1"), iri("http://p2")
    assert view.outgoing(p1).count() == 2 and view.outgoing(p1, "http://knows").first()["v"]["lex"] == "http://p2"
    assert view.incoming(p2).first()["p"] == "http://knows" and view.incoming(p2, "http://knows").count() == 1
    assert view.edges(p2).count() == 1 and {r["g"] for r in view.graphs(p1).collect()} == {"http://g", "http://h"}
    assert view.extension_of("http://knows").count() == 1
    assert GraphView(view.all, "http://h").vertices().count() == 2
    assert GraphView(term_frame(spark, [])).lists().count() == 0


def test_language_preferences(spark):
    s, p = iri("http://mars"), iri("http://nick")
    quads = term_frame(spark, [(s, iri("http://name"), literal("Mars"), G)] + [(s, p, literal(x, language=t), G) for x, t in (("Mars", "en"), ("火星", "ja"), ("Angaraka", "sa"))])
    pick = lambda accept, site=None: sorted(r["o"]["lex"] for r in best_language(quads, accept, site).collect())
    assert len(pick({})) == 4
    assert pick({"*": 1.0}) == ["Mars", "Mars"]  # a tie goes to the first tag
    assert pick({"ja": 1.0, "en": 0.5}) == ["Mars", "火星"]
    assert pick({"ja": 0.5, "en": 0.6}, {"ja": 1.0, "en": 0.1}) == ["Mars", "火星"]
    assert pick({"fr": 1.0}) == ["Mars"]
    assert TermStore(quads, ["http://g"]).preferring({"sa": 1.0}).quads.count() == 2


def test_description_and_versions(spark):
    store = TermStore(term_frame(spark, [(iri("http://a"), iri("http://p"), literal(str(i)), G) for i in (1, 1, 2)]), version=7)
    assert [tuple(r) for r in store.description().collect()] == [("http://g", "http://p", 2)]  # a store is a set
    assert store.version == 7 and store.default_graphs == ["http://g"]


def test_dictionary_store_is_safe(spark):
    quads = spark.createDataFrame([(1, 10, 2, 5), (1, 10, 2, None), (2, 10, None, 5), (None, 10, 2, 5), (1, 10, 24 * 2**56 + 7, 5), (1, 10, 99, 5)], "subject long, predicate long, object long, graph long")
    terms = spark.createDataFrame([(1, 2, "http://a", None, None), (2, 16, "hi", 8, " EN_us"), (10, 2, "p", None, None), (5, 2, "http://g", None, None), (8, 2, "rdf:langString", None, None)], "id long, type int, value string, datatype long, language string")
    e = Engine(DictionaryStore(quads, terms))
    got = {(r["o"]["k"], r["o"]["lex"]) for r in e.terms("SELECT ?o { <http://a> <p> ?o }").collect()}
    assert got == {(3, "hi"), (3, "7"), (1, "id99")}
    assert e.query("SELECT ?s { ?s <p> 7 }").count() == 1 and e.query("SELECT ?s { ?s <p> 'hi'@en_us }".replace("@en_us", "@en")).count() == 0
    assert e.query("SELECT ?o { GRAPH ?g { ?s <p> ?o } FILTER(?o > 6) }").count() == 1
    empty = Engine(DictionaryStore(quads.limit(0), terms.limit(0)))
    assert empty.query("SELECT * { ?s <p>+ ?o }").count() == 0


def test_dictionary_constants_are_exact(spark):
    terms = [(1, 2, "http://p", None, None), (2, 22, "abc", None, None), (3, 16, "abc", 9, "EN_gb "), (4, 17, "abc", 8, None), (5, 17, "abc", 10, None), (8, 2, "<XSD:String>", None, None), (9, 2, "rdf:langString", None, None), (10, 2, "ex:dt", None, None), (11, 22, "abc", None, None), (20, 2, "http://s", None, None), (21, 2, "http://s", None, None)]
    quads = [(20, 1, 2, None), (20, 1, 3, None), (20, 1, 4, None), (20, 1, 5, None), (21, 1, 11, None), (21, 1, 2, None)]
    store = DictionaryStore(spark.createDataFrame(quads, "subject long, predicate long, object long, graph long"), spark.createDataFrame(terms, "id long, type int, value string, datatype long, language string"))
    count = lambda st, q: Engine(st).query(q).count()
    assert count(store, "SELECT * { ?s <http://p> 'abc' . }") == 2 and count(store, "SELECT * { ?s <http://p> 'abc'@en-gb }") == 1 and count(store, "SELECT * { ?s <http://p> 'abc'^^<ex:dt> }") == 1
    assert count(store, "SELECT * { ?s <http://p> 'abc'@fr }") == 0 and sorted(store.ids(literal("abc"))) == [2, 4, 11]
    one = store.merged()
    assert one.ids(iri("http://s")) == [20] and one.ids(literal("abc")) == [2]
    assert count(one, "SELECT * { ?s <http://p> ?o }") == 3 and count(one, "SELECT DISTINCT ?o { ?s <http://p> ?o . ?s <http://p> 'abc' }") == 3


class _Endpoint(BaseHTTPRequestHandler):
    def do_GET(self):
        parts = urlsplit(self.path)
        if parts.path == "/tpf":
            page = parse_qs(parts.query).get("page", ["1"])[0]
            more = f'<> <http://www.w3.org/ns/hydra/core#next> <http://{self.headers["Host"]}/tpf?page=2> .' if page == "1" else ""
            self.server.seen.append(self.path)
            body, kind = f'<http://a> <http://p> "{page}" . {more}', "text/turtle"
        elif parts.path == "/data":
            body, kind = '<http://a> <http://p> "+007"^^<http://www.w3.org/2001/XMLSchema#integer> .\n<http://a> <http://q> "1.50"^^<http://www.w3.org/2001/XMLSchema#decimal> .', "application/n-triples; charset=utf-8"
        elif parts.path == "/sparql":
            self.server.seen.append(parse_qs(parts.query)["query"][0])
            body, kind = results.to_json(results.Bindings(["x", "v0", "v1"], [{"x": literal("1", XSD + "integer"), "v0": iri("http://a"), "v1": literal("one")}])), "application/sparql-results+json"
        else:
            self.send_error(500)
            return
        data = body.encode()
        self.send_response(200)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture
def endpoint():
    server = HTTPServer(("127.0.0.1", 0), _Endpoint)
    server.seen = []
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", server
    server.shutdown()


def test_services(spark, endpoint):
    address, server = endpoint
    e = Engine(TermStore(term_frame(spark, [(iri("http://a"), iri("http://p"), literal("1", XSD + "integer"), G)]), ["http://g"]), Client())
    got = e.query(f"PREFIX e: <http://e/> SELECT ?s ?x {{ ?s <http://p> ?x SERVICE <{address}/sparql> {{ ?y e:q ?x }} }}")
    assert [tuple(r) for r in got.collect()] == [("http://a", 1)]
    assert "PREFIX e: <http://e/>" in server.seen[0] and "?y e:q ?x" in server.seen[0]
    assert e.query(f"SELECT ?s {{ ?s <http://p> ?x SERVICE SILENT <{address}/broken> {{ ?y <http://q> ?x }} }}").count() == 1
    with pytest.raises(Exception):
        e.query(f"SELECT ?s {{ ?s <http://p> ?x SERVICE <{address}/broken> {{ ?y <http://q> ?x }} }}")
    remote = Engine(EndpointStore(spark, f"{address}/sparql"))
    assert [tuple(r) for r in remote.query("SELECT ?s ?o { ?s <http://p> ?o . ?o <http://q> ?z }").collect()] == [("http://a", "one")]
    pages = Engine(FragmentStore(spark, f"{address}/tpf?s={{subject}}&p={{predicate}}&o={{object}}"))
    assert sorted(r[0] for r in pages.query("SELECT ?o { <http://a> <http://p> ?o }").collect()) == ["1", "2"]


def test_loading_from_an_address(spark, endpoint):
    address, server = endpoint
    got = results.read_rdf(spark, f"{address}/data")
    assert {(r["o"]["lex"], r["g"]["lex"]) for r in got.collect()} == {("+007", f"{address}/data"), ("1.50", f"{address}/data")}
    assert {r["o"]["lex"] for r in results.read_rdf(spark, f"{address}/data", canonicalise=True).collect()} == {"7", "1.5"}
    pages = Engine(FragmentStore(spark, f"{address}/tpf?s={{subject}}&p={{predicate}}&o={{object}}"))
    server.seen.clear()
    assert pages.query("SELECT ?o ?x { <http://a> <http://p> ?o . ?s <http://p> ?x . ?s <http://r> ?o }").count() == 0
    assert any("o=%22" in x for x in server.seen)  # values that are known go into the next pattern
    assert pages.query("SELECT * { GRAPH ?g { ?s <http://p> ?x } }").count() == 0


def test_cli(spark, tmp_path, capsys, monkeypatch):
    ttl = tmp_path / "d.ttl"
    ttl.write_text("<http://a> <http://p> 1, 2 .")
    call = lambda *a: (cli.run(cli.arguments().parse_args(list(a))), capsys.readouterr().out)[1]
    base = ["-d", str(ttl), "-g", "http://g"]
    assert call(*base, "query", "SELECT (SUM(?o) AS ?n) { ?s ?p ?o }") == "?n\n3\n"
    assert call(*base, "query", "ASK { ?s ?p 1 }", "-f", "application/sparql-results+xml").endswith("<boolean>true</boolean></sparql>")
    assert call(*base, "query", "CONSTRUCT { ?s <http://q> ?o } { ?s ?p ?o }", "-f", "application/n-triples").count(" .\n") == 2
    assert call(*base, "dataset") == "default\thttp://g\n"
    assert "Physical Plan" in call(*base, "explain", "SELECT * { ?s ?p ?o }")
    assert call("parse", "SELECT * { ?s ?p ?o }").startswith("Query(")
    assert call("simplify", "SELECT * { ?s ?p ?o FILTER(true) }").startswith("Project") and "Filter" not in call("simplify", "SELECT * { ?s ?p ?o FILTER(true) }")
    assert call("tokens", "ASK {}").splitlines()[0] == "word\tASK"
    assert call("sort", '"b"\n<http://a>\n_:x\n"a"\n10\n9').split("\n")[:3] == ["_:x", "<http://a>", '"a"']
    assert call(*base, "stack", "triple ?s ?p ?o\ncountall n") == "?n\n2\n"
    stored = str(tmp_path / "store")
    call(*base, "load", stored)
    assert call("--store", stored, "dump").count("\n") == 2
    more = tmp_path / "more.ttl"
    more.write_text('<http://a> <http://p> 2, "x"@en, _:b ; <http://q> 3.5 .')
    call("-d", str(more), "-g", "http://g", "load", stored)
    assert call("--store", stored, "dump").count("\n") == 5  # one statement was there already
    assert call("--store", stored, "query", "SELECT ?o { ?s <http://p> ?o FILTER(isNumeric(?o)) } ORDER BY ?o") == "?o\n1\n2\n"
    assert call("--store", stored, "query", 'ASK { ?s <http://p> "x"@en ; <http://q> 3.5 }', "-f", "application/json") == '{"boolean":true,"head":{}}'
    held = layout.open_store(spark, stored)
    assert sorted(held.predicates.values()) == [1, 4] and held.star_count([iri("http://p"), iri("http://q")]).first()["n"] == 1
    ids = sorted(r["id"] for r in held.terms.collect())
    assert ids == list(range(1, len(ids) + 1))
    call("create", str(tmp_path / "empty"))
    assert call("--store", str(tmp_path / "empty"), "query", "SELECT * { ?s ?p ?o }").count("\n") == 1
    call(*base, "-v", "query", "SELECT ?s (COUNT(*) AS ?n) { ?s ?p ?o } GROUP BY ?s")
    monkeypatch.setattr("sys.stdin", io.StringIO("ASK { ?s ?p 1 }\nnonsense\nSELECT ?o { ?s ?p ?o } ORDER BY ?o\nquit\n"))
    told = call(*base, "repl")
    assert '"boolean":true' in told and "error:" in told and told.endswith("?o\n1\n2\n")
    with pytest.raises(SystemExit):
        call("query", "ASK {}")


def test_push_and_stream(spark, tmp_path):
    seen = []
    assert push(spark.range(5), seen.append) == 5 and len(seen) == 5
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.nq").write_text('<http://a> <http://p> _:x .\nnonsense\n# a comment\n')
    out, mark, bad = str(tmp_path / "table"), str(tmp_path / "mark"), str(tmp_path / "bad")
    load_stream(spark, str(inbox), out, mark, rejects=bad).awaitTermination(60)
    (inbox / "b.nq").write_text("<http://b> <http://p> _:x .\n")
    load_stream(spark, str(inbox), out, mark, rejects=bad).awaitTermination(60)
    got = spark.read.parquet(out)
    assert got.count() == 2 and got.select("o.lex").distinct().count() == 2  # one label in two files is two nodes
    assert [r["value"] for r in spark.read.parquet(bad).collect()] == ["nonsense"]
    (inbox / "c.nq").write_text("more nonsense\n")
    with pytest.raises(Exception, match="no N-Quads statement"):
        load_stream(spark, str(inbox), out, mark).awaitTermination(60)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_star_is_one_scan(spark, data):
    plan = Engine(MappedStore(spark, data)).explain("PREFIX t: <http://tables.example/> SELECT ?p ?s { ?o t:o_totalprice ?p ; t:o_orderstatus ?s ; t:o_orderpriority '1-URGENT' }")
    assert plan.count("Scan parquet") == 2  # once in the tree, once in its details
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderpriority:string>" in plan and "EqualTo(o_orderpriority,1-URGENT)" in plan
