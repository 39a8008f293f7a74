from quadrel.conformance import equal, run
from quadrel.plans.algebra import BGP, Distinct, Expr, Filter, Join, LeftJoin, Minus, Nothing, Project, Slice, Table, Term, Union, Unit, Var, iri, literal
from quadrel.plans.rewrite import simplify
from quadrel.sources.results import Bindings, Triples

XSD = "http://www.w3.org/2001/XMLSchema#"


def test_results_up_to_blank_nodes():
    b = lambda x: Term("bnode", x)
    rows = lambda *xs: Bindings(["x", "y"], [dict(zip("xy", x)) for x in xs])
    assert equal(rows((b("a"), b("b")), (b("b"), b("a"))), rows((b("q"), b("p")), (b("p"), b("q"))))
    assert not equal(rows((b("a"), b("a")), (b("b"), b("b"))), rows((b("q"), b("p")), (b("p"), b("q"))))
    assert not equal(rows((iri("a"), iri("b"))), rows((iri("a"), iri("c")))) and equal(True, True) and not equal(True, False)
    assert equal(Triples([(b("a"), iri("p"), literal("1"))]), Triples([(b("z"), iri("p"), literal("1"))]))


def test_rings_of_blank_nodes():
    b = lambda x: Term("bnode", f"n{x}")
    ring = lambda nodes: [(b(x), iri("p"), b(y)) for x, y in zip(nodes, [*nodes[1:], nodes[0]])]
    eight, fours = Triples(ring(list(range(8)))), Triples(ring([0, 1, 2, 3]) + ring([4, 5, 6, 7]))
    assert not equal(eight, fours) and equal(eight, Triples(ring([5, 3, 1, 0, 7, 2, 6, 4]))) and equal(fours, Triples(ring([7, 1, 3, 0]) + ring([2, 4, 6, 5])))
    many = [(b(x), iri("p"), literal(str(x % 3))) for x in range(40)] + ring(list(range(40)))
    assert equal(Triples(many), Triples([tuple(b(int(t.value[1:]) + 100) if t.kind == "bnode" else t for t in x) for x in many]))
    assert not equal(Triples(many), Triples(many[:-1] + [(b(39), iri("p"), b(1))]))


def test_manifest(spark, tmp_path):
    files = {
        "manifest.ttl": """@prefix mf: <http://www.w3.org/2001/sw/DataAccess/tests/test-manifest#> . @prefix qt: <http://www.w3.org/2001/sw/DataAccess/tests/test-query#> .
            <> mf:entries ( [ mf:name "join" ; mf:action [ qt:query <q1.rq> ; qt:data <d.ttl> ] ; mf:result <r1.srx> ]
              [ mf:name "graph" ; mf:action [ qt:query <q2.rq> ; qt:data <d.ttl> ; qt:graphData <e.ttl> ] ; mf:result <r2.srj> ]
              [ mf:name "construct" ; mf:action [ qt:query <q3.rq> ; qt:data <d.ttl> ] ; mf:result <r3.ttl> ]
              [ mf:name "wrong" ; mf:action [ qt:query <q1.rq> ; qt:data <e.ttl> ] ; mf:result <r1.srx> ]
              [ a mf:NegativeSyntaxTest11 ; mf:name "bad" ; mf:action <bad.rq> ] [ a mf:PositiveSyntaxTest11 ; mf:name "good" ; mf:action <q1.rq> ] ) .""",
        "d.ttl": "<http://a> <http://p> 1 ; <http://q> _:x . _:x <http://p> 2 .",
        "e.ttl": "<http://a> <http://p> 3 .",
        "q1.rq": "SELECT ?s ?v { ?s <http://q> ?o . ?o <http://p> ?v }",
        "q2.rq": "SELECT ?v { GRAPH ?g { ?s ?p ?v } }",
        "q3.rq": "CONSTRUCT { _:n <http://r> ?v } { ?s <http://p> ?v }",
        "bad.rq": "SELECT { ?s }",
        "r1.srx": '<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head><variable name="s"/><variable name="v"/></head><results><result><binding name="s"><uri>http://a</uri></binding><binding name="v"><literal datatype="http://www.w3.org/2001/XMLSchema#integer">2</literal></binding></result></results></sparql>',
        "r2.srj": '{"head":{"vars":["v"]},"results":{"bindings":[{"v":{"type":"literal","value":"3","datatype":"http://www.w3.org/2001/XMLSchema#integer"}}]}}',
        "r3.ttl": "_:k <http://r> 1 . _:l <http://r> 2 .",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = {o.name: o.passed for o in run(spark, str(tmp_path / "manifest.ttl"))}
    assert got == {"join": True, "graph": True, "construct": True, "wrong": False, "bad": True, "good": True}


def test_rewrites():
    a, b = BGP(((Var("s"), iri("p"), Var("o")),)), BGP(((Var("x"), iri("p"), Var("y")),))
    true, false = (Expr("term", (literal(x, XSD + "boolean"),)) for x in ("true", "false"))
    table = Table(("x",), ((iri("1"),), (iri("2"),), (iri("3"),)))
    assert simplify(Join(Unit(), a)) == a and simplify(Join(a, Nothing())) == Nothing() and simplify(Union(Nothing(), a)) == a
    assert simplify(Filter(a, true)) == a and simplify(Filter(a, false)) == Nothing() and simplify(LeftJoin(a, b, true)) == LeftJoin(a, b)
    assert simplify(LeftJoin(a, Filter(b, false))) == a and simplify(Minus(a, b)) == a and simplify(Minus(a, a)) == Minus(a, a)
    assert simplify(Slice(table, 1, 1)) == Table(("x",), ((iri("2"),),)) and simplify(Slice(a, 0, 0)) == Nothing() and simplify(Table(("x",), ())) == Nothing()
    assert simplify(Distinct(Distinct(a))) == Distinct(a) and simplify(Project(Project(a, ("s", "o")), ("s",))) == Project(a, ("s",))
    assert simplify(BGP(())) == Unit()
