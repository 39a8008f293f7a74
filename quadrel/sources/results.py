"""SPARQL results as JSON, XML and TSV, and the choice of a format by media type or file name."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession

from quadrel.plans.algebra import XSD, Term, iri, literal
from quadrel.plans.parser import SyntaxProblem
from quadrel.sources import ntriples, rdfxml, turtle

_NS = "http://www.w3.org/2005/sparql-results#"


@dataclass
class Bindings:
    names: list[str]
    rows: list[dict[str, Term]]


@dataclass
class Triples:
    triples: list[tuple[Term, Term, Term]]


Result = bool | Bindings | Triples


def of_frame(terms: DataFrame) -> Bindings:
    """Term-struct columns as bindings on the driver."""
    back = {v: k for k, v in turtle.KIND.items()}
    rows = [{n: Term(back[r[n]["k"]], r[n]["lex"], r[n]["dt"], r[n]["lang"]) for n in terms.columns if r[n] is not None} for r in terms.toLocalIterator()]
    return Bindings(terms.columns, rows)


def to_json(result: Result) -> str:
    if isinstance(result, Triples):
        raise ValueError("triples have no results JSON")
    if isinstance(result, bool):
        return json.dumps({"boolean": result, "head": {}}, separators=(",", ":"))

    def cell(t: Term) -> dict:
        if t.kind != "literal":
            return {"type": "uri" if t.kind == "iri" else "bnode", "value": t.value}
        out = {"type": "literal", "value": t.value}
        return out | ({"xml:lang": t.language} if t.language else {"datatype": t.datatype})

    rows = [{n: dict(sorted(cell(t).items())) for n, t in sorted(r.items())} for r in result.rows]
    return json.dumps({"head": {"vars": result.names}, "results": {"bindings": rows}}, separators=(",", ":"), ensure_ascii=False)


def from_json(text: str) -> Result:
    data = json.loads(text)
    if "boolean" in data:
        return data["boolean"] in (True, "true")

    def cell(c: dict) -> Term:
        if c["type"] == "uri":
            return iri(c["value"])
        if c["type"] == "bnode":
            return Term("bnode", c["value"])
        return literal(c["value"], c.get("datatype", XSD + "string"), c.get("xml:lang"))

    return Bindings(data["head"].get("vars", []), [{n: cell(c) for n, c in b.items()} for b in data["results"]["bindings"]])


def to_xml(result: Result) -> str:
    if isinstance(result, Triples):
        raise ValueError("triples have no results XML")
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<sparql xmlns="{_NS}">'
    if isinstance(result, bool):
        return f"{head}<head></head><boolean>{str(result).lower()}</boolean></sparql>"

    def cell(t: Term) -> str:
        if t.kind == "iri":
            return f"<uri>{escape(t.value)}</uri>"
        if t.kind == "bnode":
            return f"<bnode>{escape(t.value)}</bnode>"
        tag = f" xml:lang={quoteattr(t.language)}" if t.language else f" datatype={quoteattr(t.datatype or XSD + 'string')}"
        return f"<literal{tag}>{escape(t.value)}</literal>"

    names = "".join(f'<variable name="{n}"></variable>' for n in result.names)
    rows = "".join("<result>" + "".join(f'<binding name="{n}">{cell(t)}</binding>' for n, t in sorted(r.items())) + "</result>" for r in result.rows)
    return f"{head}<head>{names}</head><results>{rows}</results></sparql>"


def from_xml(text: str) -> Result:
    root = ET.fromstring(text)
    flag = root.find(f"{{{_NS}}}boolean")
    if flag is not None:
        return (flag.text or "").strip() == "true"

    def cell(e) -> Term:
        x = e[0]
        kind = x.tag.split("}")[1]
        if kind == "uri":
            return iri(x.text or "")
        if kind == "bnode":
            return Term("bnode", x.text or "")
        return literal(x.text or "", x.get("datatype", XSD + "string"), x.get("{http://www.w3.org/XML/1998/namespace}lang"))

    names = [v.get("name") for v in root.iter(f"{{{_NS}}}variable")]
    rows = [{b.get("name"): cell(b) for b in r.iter(f"{{{_NS}}}binding")} for r in root.iter(f"{{{_NS}}}result")]
    return Bindings(names, rows)


def to_tsv(result: Result) -> str:
    if not isinstance(result, Bindings):
        raise ValueError("only bindings have results TSV")

    def cell(t: Term | None) -> str:
        if t is None:
            return ""
        if t.datatype == XSD + "integer" and re.fullmatch(r"[+-]?[0-9]+", t.value):
            return t.value
        return ntriples.format_term(t)

    lines = ["\t".join("?" + n for n in result.names)] + ["\t".join(cell(r.get(n)) for n in result.names) for r in result.rows]
    return "".join(x + "\n" for x in lines)


def from_tsv(text: str) -> Bindings:
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    names = [n.lstrip("?$") for n in lines[0].split("\t")]

    def cell(x: str) -> Term:
        if x[0] in '<"_':
            return ntriples.parse_nodes(x, 1)[0][0]
        if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", x):
            raise SyntaxProblem(f"no term: {x!r}")
        return literal(x, XSD + ("double" if "e" in x.lower() else "decimal" if "." in x else "integer"))

    rows = []
    for line in lines[1:]:
        rows.append({n: cell(x) for n, x in zip(names, line.split("\t")) if x})
    return Bindings(names, rows)


def frame_tsv(terms: DataFrame) -> DataFrame:
    """A result of any size as TSV lines: one column `value`, without the header."""
    from pyspark.sql import functions as F

    def cell(c):
        short = (c["dt"] == XSD + "integer") & c["lex"].rlike("^[+-]?[0-9]+$")
        return F.coalesce(F.when(short, c["lex"]).otherwise(ntriples.format_column(c)), F.lit(""))

    return terms.select(F.concat_ws("\t", *[cell(F.col(n)) for n in terms.columns]).alias("value"))


def frame_json(terms: DataFrame) -> DataFrame:
    """A result of any size as the bindings of results JSON, one a line: one column `value`."""
    from pyspark.sql import functions as F

    def cell(c):
        tag = F.when(c["lang"].isNotNull(), F.concat(F.lit('"type":"literal","value":'), _quoted(c["lex"]), F.lit(',"xml:lang":'), _quoted(c["lang"])))
        typed = F.concat(F.lit('"datatype":'), _quoted(c["dt"]), F.lit(',"type":"literal","value":'), _quoted(c["lex"]))
        named = F.concat(F.when(c["k"] == 2, '"type":"uri","value":').otherwise('"type":"bnode","value":'), _quoted(c["lex"]))
        return F.concat(F.lit("{"), F.when(c["k"] < 3, named).otherwise(F.coalesce(tag, typed)), F.lit("}"))

    cells = [F.when(F.col(n).isNotNull(), F.concat(F.lit(json.dumps(n) + ":"), cell(F.col(n)))) for n in sorted(terms.columns)]
    return terms.select(F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}")).alias("value"))


def _quoted(c):
    """A JSON string."""
    from pyspark.sql import functions as F

    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)


def frame_xml(terms: DataFrame) -> DataFrame:
    """A result of any size as the result elements of results XML, one a row: one column `value`."""
    from pyspark.sql import functions as F

    def safe(c, attribute=True):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;")] if attribute else [])):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def cell(c):
        text = safe(c["lex"], False)
        tag = F.when(c["lang"].isNotNull(), F.concat(F.lit(' xml:lang="'), safe(c["lang"]))).otherwise(F.concat(F.lit(' datatype="'), safe(c["dt"])))
        written = F.concat(F.lit("<literal"), tag, F.lit('">'), text, F.lit("</literal>"))
        return F.when(c["k"] == 2, F.concat(F.lit("<uri>"), text, F.lit("</uri>"))).when(c["k"] == 1, F.concat(F.lit("<bnode>"), text, F.lit("</bnode>"))).otherwise(written)

    cells = [F.when(F.col(n).isNotNull(), F.concat(F.lit(f"<binding name={quoteattr(n)}>"), cell(F.col(n)), F.lit("</binding>"))) for n in sorted(terms.columns)]
    return terms.select(F.concat(F.lit("<result>"), F.concat_ws("", *cells), F.lit("</result>")).alias("value"))


@dataclass(frozen=True)
class Format:
    media: str
    aliases: tuple[str, ...]
    extensions: tuple[str, ...]
    takes: tuple[type, ...]
    write: Callable[[Result], str] | None = None
    parse: Callable[[str], Result] | None = None


FORMATS = [
    Format("application/sparql-results+json", ("application/json", "text/plain"), ("srj",), (bool, Bindings), to_json, from_json),
    Format("application/sparql-results+xml", ("application/xml", "text/xml"), ("srx",), (bool, Bindings), to_xml, from_xml),
    Format("text/tab-separated-values", (), ("tsv",), (Bindings,), to_tsv, from_tsv),
    Format("application/turtle", ("text/turtle",), ("ttl", "turtle"), (Triples,), lambda r: turtle.serialize(r.triples), lambda t: Triples(turtle.parse(t))),
    Format("application/n-triples", (), ("nt",), (Triples,), lambda r: "".join(" ".join(map(ntriples.format_term, t)) + " .\n" for t in r.triples), lambda t: Triples(turtle.parse(t))),
    Format("application/n-quads", (), ("nq",), (), None, None),
    Format("application/rdf+xml", (), ("rdf", "owl"), (), None, lambda t: Triples(rdfxml.parse(t))),
]


def negotiate(result: Result, accept: list[str]) -> Format | None:
    """The first acceptable format that can hold the result; None if there is none."""
    for want in accept:
        media = want.split(";")[0].strip().lower()
        for f in FORMATS:
            if f.write and isinstance(result, f.takes) and (media in ("*/*", "") or media == f.media or media in f.aliases):
                return f
    return None


def parser_for(content_type: str) -> Format | None:
    media = content_type.split(";")[0].strip().lower()
    return next((f for f in FORMATS if f.parse and (media == f.media or media in f.aliases)), None)


def canonical(quads: DataFrame) -> DataFrame:
    """Quads whose integers, decimals, doubles, floats and booleans are written in the one canonical way; ill-typed ones stay."""
    from pyspark.sql import functions as F

    from quadrel.functions.lanes import BOOLEAN, DECIMAL, DOUBLE, FLOAT, INTEGERS, TERM_TYPE, Val, lexical

    o, lex, dt = F.col("o"), F.trim(F.col("o.lex")), F.col("o.dt")
    whole = F.regexp_replace(F.regexp_replace(lex, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
    decimal = F.when(lex.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), lexical(Val("dec", lex.try_cast("decimal(38,18)"))))
    real = F.when(lex.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), lexical(Val("dbl", lex.try_cast("double"))))
    short = (
        F.when(dt.isin(*INTEGERS) & lex.rlike(r"^[+-]?[0-9]+$"), F.when(whole == "-0", "0").otherwise(whole)).when(dt == DECIMAL, decimal).when(dt.isin(DOUBLE, FLOAT), real)
        .when(dt == BOOLEAN, F.when(lex.isin("1", "true"), "true").when(lex.isin("0", "false"), "false"))
    )
    same = F.struct(o["k"].alias("k"), F.coalesce(short, o["lex"]).alias("lex"), dt.alias("dt"), o["lang"].alias("lang")).cast(TERM_TYPE)
    return quads.withColumn("o", F.when(o.isNotNull(), same))


def read_rdf(spark: SparkSession, path: str, graph: str | None = None, media: str | None = None, canonicalise: bool = False) -> DataFrame:
    """Quads (s, p, o, g) of RDF files; the syntax follows the media type or the extension, Turtle by default.

    An http or https address is fetched by the driver, its content type is the media type if none is given, and its
    graph is the address if none is given. canonicalise: numbers and booleans are rewritten, see canonical().
    """
    if path.startswith(("http://", "https://")):
        from quadrel.runtime import Scratch
        from quadrel.sources.service import fetch

        wanted = ", ".join(f.media for f in FORMATS if f.media != "application/sparql-results+json" and (f.takes == (Triples,) or not f.takes))
        kind, text = fetch(path, wanted)
        media, graph = media or kind.split(";")[0].strip().lower() or None, graph or path
        at = f"{Scratch(spark).base}/{path.rstrip('/').rsplit('/', 1)[-1] or 'index'}"
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(at)
        path = at
    quads = _read_rdf(spark, path, graph, media)
    return canonical(quads) if canonicalise else quads


def _read_rdf(spark: SparkSession, path: str, graph: str | None, media: str | None) -> DataFrame:
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    found = next((f for f in FORMATS if media and (media == f.media or media in f.aliases)), None) or next((f for f in FORMATS if not media and extension in f.extensions), None)
    name = found.media if found else "application/turtle"
    if name in ("application/n-triples", "application/n-quads"):
        return ntriples.read(spark, path, graph)
    return (rdfxml if name == "application/rdf+xml" else turtle).read(spark, path, graph)
