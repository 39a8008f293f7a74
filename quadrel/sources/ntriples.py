"""N-Triples and N-Quads. Lines are independent, so reading and writing are plain distributed text scans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.functions.lanes import BNODE, IRI, LANG, LITERAL, STRING, TERM_TYPE
from quadrel.plans.algebra import Term, Var, iri, literal
from quadrel.plans.parser import SyntaxProblem, unescape

_IRI = r"<([^<>\"{}|^`\x00-\x20]*)>"
_BLANK = r"_:([\w](?:[\w.\-]*[\w\-])?)"
# possessive loops: Java runs them without recursion, so long literals need no stack
_LITERAL = r'"((?:[^"\\\n\r]++|\\.)*+)"(?:\^\^<([^<>]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?'
_ANY = rf"(?:{_IRI}|{_BLANK}|{_LITERAL})"
#: Groups 1-2 subject, 3 predicate, 4-8 object, 9-10 graph.
_NOTHING = r"^\s*(#.*)?$"
LINE = rf"(?U)^\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*{_ANY}\s*(?:(?:{_IRI}|{_BLANK})\s*)?\.\s*(?:#.*)?$"


def _unescaped(c: Column) -> Column:
    """ECHAR and UCHAR escapes. Texts without a backslash, nearly all, take the short way."""
    quick = {r"\t": "\t", r"\n": "\n", r"\r": "\r", r"\"": '"', r"\b": "\b", r"\f": "\f", r"\'": "'"}
    two = F.create_map(*[x for k, v in quick.items() for x in (F.lit(k), F.lit(v))])

    def code(piece: Column, digits: int) -> Column:
        n = F.conv(piece.substr(3, digits), 16, 10).cast("int")
        utf16 = F.lpad(F.hex(n), 4, "0")
        lead = F.hex(F.floor((n - 0x10000) / 1024).cast("int") + 0xD800)
        trail = F.hex(((n - 0x10000) % 1024) + 0xDC00)
        return F.decode(F.unhex(F.when(n < 0x10000, utf16).otherwise(F.concat(lead, trail))), "UTF-16BE")

    def one(piece: Column) -> Column:
        return (
            F.when(piece.rlike(r"^\\u[0-9A-Fa-f]{4}"), F.concat(code(piece, 4), piece.substr(F.lit(7), F.length(piece))))
            .when(piece.rlike(r"^\\U[0-9A-Fa-f]{8}"), F.concat(code(piece, 8), piece.substr(F.lit(11), F.length(piece))))
            .when(piece.startswith("\\"), F.concat(F.coalesce(F.element_at(two, piece.substr(1, 2)), F.lit("")), piece.substr(F.lit(3), F.length(piece))))
            .otherwise(piece)
        )

    # an escaped backslash is put aside first, so that what follows it is no escape
    aside = F.replace(c, F.lit("\\\\"), F.lit("\u0000"))
    pieces = F.split(aside, r"(?=\\)")
    return F.when(c.contains("\\"), F.replace(F.array_join(F.transform(pieces, one), ""), F.lit("\u0000"), F.lit("\\"))).otherwise(c)


def _group(n: int) -> Column:
    return F.regexp_extract("value", LINE, n)


def _resource(name: Column, blank: Column, document: Column) -> Column:
    none = F.lit(None).cast("string")
    as_iri = F.struct(F.lit(IRI).alias("k"), _unescaped(name).alias("lex"), none.alias("dt"), none.alias("lang"))
    as_blank = F.struct(F.lit(BNODE).alias("k"), F.concat(document, blank).alias("lex"), none.alias("dt"), none.alias("lang"))
    return F.when(blank != "", as_blank).otherwise(as_iri)


def is_statement(value: Column) -> Column:
    """Whether a line is a statement, or a comment or empty."""
    return value.isNull() | value.rlike(_NOTHING) | value.rlike(LINE)


def blank_prefix(file: Column) -> Column:
    """What blank-node labels of a file begin with, so that labels of different files stay apart."""
    return F.concat(F.md5(file), F.lit("x"))


def read_lines(lines: DataFrame, graph: str | None = None, document: Column | None = None) -> DataFrame:
    """(s, p, o, g) from a column `value` of N-Triples or N-Quads lines.

    Comments and empty lines give nothing; another line that is no statement raises an error when the data is read.
    Blank-node labels get `document` as a prefix, so labels of different files stay apart. Statements without a graph
    get `graph`.
    """
    document = F.lit("") if document is None else document
    kept = lines.where(F.col("value").isNotNull() & ~F.col("value").rlike(_NOTHING))
    good = F.col("value").rlike(LINE)
    kept = kept.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("no N-Quads statement: "), F.col("value"))).cast("boolean")))
    none = F.lit(None).cast("string")
    dt = F.when(_group(8) != "", LANG).when(_group(7) != "", _group(7)).otherwise(STRING)
    text = F.struct(F.lit(LITERAL).alias("k"), _unescaped(_group(6)).alias("lex"), dt.alias("dt"), F.when(_group(8) != "", F.lower(_group(8))).alias("lang"))
    # an object that opens with a quote is a literal, even an empty one
    o = F.when(F.col("value").rlike(rf"(?U)^\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*\""), text).otherwise(_resource(_group(4), _group(5), document))
    given = F.lit(graph) if graph is not None else none
    g = F.when((_group(9) != "") | (_group(10) != ""), _resource(_group(9), _group(10), document)).when(given.isNotNull(), F.struct(F.lit(IRI).alias("k"), given.alias("lex"), none.alias("dt"), none.alias("lang")))
    return kept.select(_resource(_group(1), _group(2), document).alias("s"), _resource(_group(3), F.lit(""), document).alias("p"), o.alias("o"), g.cast(TERM_TYPE).alias("g"))


def read(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """Quads of N-Triples or N-Quads files; large files are split among tasks."""
    lines = spark.read.text(path).select("value", blank_prefix(F.input_file_name()).alias("doc"))
    return read_lines(lines, graph, F.col("doc"))


_BAD_IRI = r"[\x00-\x20<>\"{}|^`\\]"


def escape_literal(text: str) -> str:
    out = text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return out


def escape_iri(text: str, ascii_only: bool) -> str:
    bad = rf"{_BAD_IRI}|[^\x00-\x7f]" if ascii_only else _BAD_IRI
    return re.sub(bad, lambda m: f"\\u{ord(m.group()):04X}" if ord(m.group()) < 0x10000 else f"\\U{ord(m.group()):08X}", text)


def format_term(t: Term, ascii_iri: bool = True) -> str:
    if t.kind == "iri":
        return f"<{escape_iri(t.value, ascii_iri)}>"
    if t.kind == "bnode":
        return f"_:{t.value}"
    text = f'"{escape_literal(t.value)}"'
    if t.language:
        return f"{text}@{t.language}"
    return text if t.datatype in (None, STRING) else f"{text}^^<{escape_iri(t.datatype, ascii_iri)}>"


def format_column(c: Column) -> Column:
    """A term struct as N-Triples text."""
    text = c["lex"]
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    literal_ = F.when(c["lang"].isNotNull(), F.concat(quoted, F.lit("@"), c["lang"])).when(c["dt"] == STRING, quoted).otherwise(F.concat(quoted, F.lit("^^<"), c["dt"], F.lit(">")))
    escaped = F.when(c["lex"].rlike(_BAD_IRI), F.array_join(F.transform(F.split(c["lex"], ""), lambda ch: F.when(ch.rlike(_BAD_IRI), F.concat(F.lit("\\u00"), F.lpad(F.hex(F.ascii(ch)), 2, "0"))).otherwise(ch)), "")).otherwise(c["lex"])
    return F.when(c["k"] == IRI, F.concat(F.lit("<"), escaped, F.lit(">"))).when(c["k"] == BNODE, F.concat(F.lit("_:"), c["lex"])).otherwise(literal_)


def lines_of(triples: DataFrame) -> DataFrame:
    """One column `value`: a line per triple (s, p, o), or per quad if there is a column g with a graph."""
    parts = [format_column(F.col(c)) for c in "spo"]
    if "g" in triples.columns:
        parts.append(F.when(F.col("g").isNotNull(), format_column(F.col("g"))))
    return triples.select(F.concat(F.concat_ws(" ", *parts), F.lit(" .")).alias("value"))


def write(triples: DataFrame, path: str) -> None:
    lines_of(triples).write.text(path)


_PATTERN = re.compile(rf"\s*(?:\?(\w+)|{_IRI}|{_BLANK}|{_LITERAL}|([+-]?\d+(?:\.\d+)?))")


def parse_nodes(text: str, count: int) -> tuple[list[Term | Var], str]:
    """`count` nodes in N-Triples form, with ?variables, and the rest of the text."""
    out: list[Term | Var] = []
    at = 0
    for _ in range(count):
        m = _PATTERN.match(text, at)
        if not m:
            raise SyntaxProblem(f"expected a node in {text[at:]!r}")
        var, name, blank, lex, dt, lang, num = m.groups()
        if var:
            out.append(Var(var))
        elif name is not None:
            out.append(iri(unescape(name)))
        elif blank:
            out.append(Term("bnode", blank))
        elif num:
            out.append(literal(num, "http://www.w3.org/2001/XMLSchema#" + ("decimal" if "." in num else "integer")))
        else:
            out.append(literal(unescape(lex), dt or STRING, lang))
        at = m.end()
    return out, text[at:]
