import pytest
from pyspark.sql import functions as F

from quadrel.plans.algebra import RDF, XSD, Term, iri, literal
from quadrel.plans.parser import SyntaxProblem
from quadrel.sources import ntriples, rdfxml, results, turtle

NODE = Term("bnode", "cell9")
RIVER, FLEUVE, LENGTH, RANK = literal("Orvane"), literal("Orvane", language="fr"), literal("38.5E0", XSD + "double"), literal("12", XSD + "integer")
ROWS = results.Bindings(["river", "length", "rank", "dry"], [{"river": FLEUVE, "length": LENGTH}, {"river": iri("http://rivers.example/1"), "dry": literal("false", XSD + "boolean")}, {"river": NODE, "rank": RANK}, {}])


def test_json():
    got = results.to_json(results.Bindings(["river", "rank"], [{"rank": RANK, "river": RIVER}, {"river": FLEUVE}]))
    assert got == '{"head":{"vars":["river","rank"]},"results":{"bindings":[{"rank":{"datatype":"' + XSD + 'integer","type":"literal","value":"12"},"river":{"datatype":"' + XSD + 'string","type":"literal","value":"Orvane"}},{"river":{"type":"literal","value":"Orvane","xml:lang":"fr"}}]}}'
    assert results.from_json(results.to_json(ROWS)) == ROWS
    assert results.from_json(results.to_json(True)) is True and results.from_json('{"head":{},"boolean":"true"}') is True


def test_xml():
    got = results.to_xml(ROWS)
    assert '<result><binding name="dry"><literal datatype="' + XSD + 'boolean">false</literal></binding><binding name="river"><uri>http://rivers.example/1</uri></binding></result>' in got and "<bnode>cell9</bnode>" in got
    assert results.from_xml(got) == ROWS and results.from_xml(results.to_xml(False)) is False
    assert results.from_xml(results.to_xml(results.Bindings(["a"], [{"a": FLEUVE}, {}]))).rows == [{"a": FLEUVE}, {}]


def test_tsv(spark):
    lines = ["?node\t?note", '<http://rivers.example/1>\t"a \\"tab\\" here"', "_:cell9\t-4.25", "\t", '<http://rivers.example/2>\t', '\t"eau"@fr', "_:cell9\t77"]
    got = results.from_tsv("\n".join(lines) + "\n")
    assert got.names == ["node", "note"] and len(got.rows) == 6
    assert got.rows[0]["note"] == literal('a "tab" here') and got.rows[2] == {} and got.rows[5] == {"node": NODE, "note": literal("77", XSD + "integer")}
    assert got.rows[1]["note"] == literal("-4.25", XSD + "decimal") and got.rows[4] == {"note": literal("eau", language="fr")}
    assert results.from_tsv(results.to_tsv(ROWS)) == ROWS
    assert results.to_tsv(results.Bindings(["river", "n"], [{"river": RIVER, "n": LENGTH}, {"n": RANK}])) == f'?river\t?n\n"Orvane"\t"38.5E0"^^<{XSD}double>\n\t12\n'
    term = "struct<k:int,lex:string,dt:string,lang:string>"
    df = spark.createDataFrame([((3, "7", XSD + "integer", None), None), ((2, "http://a", None, None), (3, "x\ty", XSD + "string", None))], f"a {term}, b {term}")
    assert sorted(r[0] for r in results.frame_tsv(df).collect()) == ["7\t", '<http://a>\t"x\\ty"']


def test_distributed_results_equal_those_of_the_driver(spark):
    term = "struct<k:int,lex:string,dt:string,lang:string>"
    cells = [None, (1, "cell9", None, None), (2, "http://rivers.example/a&b", None, None), (3, 'q"<\\\n>', XSD + "string", None), (3, "eau", RDF + "langString", "fr"), (3, "12", XSD + "integer", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(cells, cells[::-1]))], f"i int, x {term}, y {term}").orderBy("i").drop("i")
    whole = results.of_frame(df)
    rows = results.from_json('{"head":{"vars":["x","y"]},"results":{"bindings":[' + ",".join(r["value"] for r in results.frame_json(df).collect()) + "]}}")
    assert rows == whole == results.from_json(results.to_json(whole))
    assert "".join(r["value"] for r in results.frame_xml(df).collect()) in results.to_xml(whole)


@pytest.mark.parametrize("write", [results.to_json, results.to_xml, results.to_tsv])
def test_triples_are_no_bindings(write):
    with pytest.raises(ValueError):
        write(results.Triples([]))


def test_ntriples_terms():
    fmt = lambda *t: " ".join(map(ntriples.format_term, t))
    assert fmt(NODE, iri("http://rivers.example/川"), literal("eau", language="FR-be")) == '_:cell9 <http://rivers.example/\\u5DDD> "eau"@fr-be'
    assert fmt(iri("http://rivers.example/a b"), literal('x\t\\"')) == '<http://rivers.example/a\\u0020b> "x\\t\\\\\\""'
    assert fmt(RANK) == f'"12"^^<{XSD}integer>'


LINES = [
    '<http://a> <http://p> "x\\ty\\u00E9\\U0001F600 \\\\u0041" .', "# comment", "", "_:b <http://p> <http://o\\u0041> .", '<http://a> <http://p> "t"@EN <http://g> . # end', '<http://a> <http://p> "1"^^<http://dt> .', '<http://a> <http://p> "" .', "  <http://a>\t<http://p>\t_:c _:g .",
]


def test_read_lines(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = {(r["s"]["lex"], r["o"]["k"], r["o"]["lex"], r["o"]["dt"], r["o"]["lang"], r["g"]["lex"] if r["g"] else None) for r in ntriples.read_lines(df, "http://d", F.lit("f")).collect()}
    assert got == {
        ("http://a", 3, "x\tyé😀 \\u0041", XSD + "string", None, "http://d"),
        ("fb", 2, "http://oA", None, None, "http://d"),
        ("http://a", 3, "t", RDF + "langString", "en", "http://g"),
        ("http://a", 3, "1", "http://dt", None, "http://d"),
        ("http://a", 3, "", XSD + "string", None, "http://d"),
        ("http://a", 1, "fc", None, None, "fg"),
    }
    bad = spark.createDataFrame([("<http://a> <http://p> .",)], "value string")
    with pytest.raises(Exception, match="no N-Quads statement"):
        ntriples.read_lines(bad).collect()
    assert [r[0] for r in bad.select(ntriples.is_statement(F.col('value'))).collect()] == [False]


def test_files_round_trip(spark, tmp_path):
    source = tmp_path / "a.nq"
    source.write_text("\n".join(LINES), encoding="utf-8")
    quads = results.read_rdf(spark, str(source)).cache()
    out = tmp_path / "out.nq"
    ntriples.write(quads, str(out))
    again = ntriples.read(spark, str(out))
    plain = lambda df: sorted(str((r["s"]["k"], r["p"], r["o"]["k"], r["o"]["dt"])) for r in df.collect())
    assert plain(again) == plain(quads)
    ttl = tmp_path / "b.ttl"
    ttl.write_text("@prefix e: <http://e/> . e:a e:p 1, 2 ; e:q (e:x 'y'@de) .")
    assert results.read_rdf(spark, str(ttl), "http://g").count() == 7
    assert results.read_rdf(spark, str(ttl), media="text/turtle").where("g is null").count() == 7


def test_turtle_parse():
    got = turtle.parse('@base <http://b/> .\n@prefix : <http://e/> .\nPREFIX x: <http://x/>\n<rel> a :C ; x:p true, -1.5, 1e3, """long\n"text\\u0041""" .\n[ :q _:n ] :r [] .')
    assert (iri("http://b/rel"), iri(RDF + "type"), iri("http://e/C")) in got
    assert {t[2] for t in got if t[1].value == "http://x/p"} == {literal("true", XSD + "boolean"), literal("-1.5", XSD + "decimal"), literal("1e3", XSD + "double"), literal('long\n"textA')}
    assert len(got) == 7
    for bad in ("<a> <b> ?c .", "<a> <b> .", "<a> <b> <c>", "x:a <b> <c> ."):
        with pytest.raises(SyntaxProblem):
            turtle.parse(bad)


def test_turtle_serialize():
    flows, lake, near = iri("http://rivers.example/流れる"), iri("http://rivers.example/lake"), iri("http://rivers.example/near")
    nine, ten = literal("9", XSD + "integer"), literal("10", XSD + "integer")
    assert turtle.serialize([(NODE, flows, ten), (NODE, flows, nine), (NODE, flows, FLEUVE)]) == '_:cell9 <http://rivers.example/流れる> "Orvane"@fr, 9, 10 .\n'
    assert turtle.serialize([(NODE, near, ten), (NODE, lake, nine), (NODE, lake, ten)]) == "_:cell9 <http://rivers.example/lake> 9, 10 ;\n\t<http://rivers.example/near> 10 .\n"
    assert turtle.serialize([(lake, flows, RIVER)], {"r": "http://rivers.example/"}) == '@prefix r: <http://rivers.example/> .\n\nr:lake r:流れる "Orvane" .\n'
    assert turtle.serialize([(NODE, iri("http://rivers.example/a|b"), literal('\r"'))]) == '_:cell9 <http://rivers.example/a\\u007Cb> "\\r\\"" .\n'
    triples = [(NODE, near, ten), (lake, iri(RDF + "type"), near), (lake, near, literal("x", "http://dt"))]
    assert sorted(turtle.parse(turtle.serialize(triples)), key=str)[-2:] == sorted([t for t in triples if t[0].kind == "iri"], key=str)[-2:]


def test_rdfxml():
    text = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://b/x">
    <e:C rdf:about="#a" e:attr="v" xml:lang="de"><e:p>text</e:p><e:n rdf:datatype="http://dt">1</e:n><e:r rdf:resource="other"/>
      <e:list rdf:parseType="Collection"><rdf:Description rdf:about="http://1"/><rdf:Description rdf:about="http://2"/></e:list>
      <e:res rdf:parseType="Resource"><e:inner>deep</e:inner></e:res><e:nest><rdf:Description rdf:nodeID="k"/></e:nest></e:C>
    <rdf:Seq><rdf:li>one</rdf:li><rdf:li>two</rdf:li></rdf:Seq>
    <rdf:Description rdf:about="http://s"><e:q rdf:ID="st">o</e:q></rdf:Description></rdf:RDF>"""
    got = rdfxml.parse(text, "http://doc/")
    a = iri("http://b/x#a")
    assert (a, iri(RDF + "type"), iri("http://e/C")) in got and (a, iri("http://e/attr"), literal("v", language="de")) in got
    assert (a, iri("http://e/p"), literal("text", language="de")) in got and (a, iri("http://e/n"), literal("1", "http://dt")) in got
    assert (a, iri("http://e/r"), iri("http://b/other")) in got
    assert len([t for t in got if t[1].value == RDF + "first"]) == 2 and [t[2].value for t in got if t[1].value == "http://e/inner"] == ["deep"]
    assert {t[1].value for t in got if t[2].value in ("one", "two")} == {RDF + "_1", RDF + "_2"}
    assert (iri("http://b/x#st"), iri(RDF + "predicate"), iri("http://e/q")) in got
    with pytest.raises(SyntaxProblem):
        rdfxml.parse("<a")
    with pytest.raises(SyntaxProblem):
        rdfxml.parse('<rdf:Description xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><e:x rdf:parseType="Literal"/></rdf:Description>')


def test_negotiation():
    flag, triples, rows = True, results.Triples([]), results.Bindings(["a"], [])
    pick = lambda r, *accept: getattr(results.negotiate(r, list(accept)), "media", None)
    assert (pick(flag, "*/*"), pick(triples, "*/*"), pick(rows, "*/*")) == ("application/sparql-results+json", "application/turtle", "application/sparql-results+json")
    assert (pick(flag, "text/turtle"), pick(triples, "text/turtle"), pick(rows, "text/turtle")) == (None, "application/turtle", None)
    assert (pick(flag, "text/tab-separated-values"), pick(rows, "text/tab-separated-values")) == (None, "text/tab-separated-values")
    three = ("application/n-triples", "text/tab-separated-values", "application/sparql-results+xml")
    assert (pick(flag, *three), pick(triples, *three), pick(rows, *three)) == (three[2], three[0], three[1])
    assert pick(rows, "text/plain") == "application/sparql-results+json"
    assert results.parser_for("application/sparql-results+json;charset=utf-8").media == "application/sparql-results+json"
