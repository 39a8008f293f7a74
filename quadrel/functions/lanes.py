"""How a variable or expression is held in columns.

A native lane is one typed Spark column whose RDF type is known when the query is compiled. The term lane is a struct
(k, lex, dt, lang) for values whose type differs from row to row. NULL is both "unbound" and "error" in either lane.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrel.plans.algebra import RDF, XSD, Term

BNODE, IRI, LITERAL = 1, 2, 3
TERM_TYPE = "struct<k:int,lex:string,dt:string,lang:string>"
STRING, BOOLEAN, INTEGER, DECIMAL, FLOAT, DOUBLE, DATETIME, DATE, LANG = (XSD + "string", XSD + "boolean", XSD + "integer", XSD + "decimal", XSD + "float", XSD + "double", XSD + "dateTime", XSD + "date", RDF + "langString")
#: Datatypes that are derived from xsd:integer (fixed values).
INTEGERS = [XSD + x for x in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")]
#: kind of native lane -> datatype
DATATYPES = {"str": STRING, "bool": BOOLEAN, "int": INTEGER, "dec": DECIMAL, "flt": FLOAT, "dbl": DOUBLE, "dt": DATETIME, "date": DATE}
RANKS = {"int": 1, "dec": 2, "flt": 3, "dbl": 4}
KINDS = {1: "int", 2: "dec", 3: "flt", 4: "dbl"}


@dataclass(frozen=True)
class Val:
    """kind: iri, bnode, str, lang, bool, int, dec, flt, dbl, dt, date, term, or id (of a term dictionary)."""

    kind: str
    col: Column
    lang: Column | None = None
    prefix: str | None = None  # of an iri lane that holds only what follows a constant prefix

    def at(self, column: Column) -> Val:
        return replace(self, col=column)


def constant(term: Term) -> Val:
    if term.kind == "iri":
        return Val("iri", F.lit(term.value))
    if term.kind == "bnode":
        return Val("bnode", F.lit(term.value))
    text = F.lit(term.value)
    match term.datatype:
        case d if d == STRING:
            return Val("str", text)
        case d if d == LANG:
            return Val("lang", text, F.lit(term.language))
        case d if d == BOOLEAN and term.value in ("true", "false"):
            return Val("bool", F.lit(term.value == "true"))
        case d if d == INTEGER and term.value.lstrip("+-").isdigit() and abs(int(term.value)) < 2**63 and str(int(term.value)) == term.value:
            return Val("int", F.lit(int(term.value)).cast("long"))
        case d if d == DECIMAL:
            return Val("dec", text.cast("decimal(38,18)"))
        case d if d == DOUBLE and term.value.lower() not in ("nan", "inf", "-inf"):
            return Val("dbl", F.lit(float(term.value)))
    return Val("term", F.struct(F.lit(LITERAL).alias("k"), text.alias("lex"), F.lit(term.datatype).alias("dt"), F.lit(None).cast("string").alias("lang")))


def make(k, lex: Column, dt=None, lang=None) -> Column:
    """A term struct; NULL where the lexical form is."""
    none = F.lit(None).cast("string")
    s = F.struct(F.lit(k).cast("int").alias("k") if isinstance(k, int) else k.cast("int").alias("k"), lex.alias("lex"), (F.lit(dt) if isinstance(dt, str) else none if dt is None else dt).alias("dt"), (none if lang is None else lang).alias("lang"))
    return F.when(lex.isNotNull(), s)


def trimmed_number(c: Column) -> Column:
    """A decimal as text without trailing zeros or a bare point."""
    text = c.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def lexical(v: Val) -> Column:
    """The lexical form: an IRI's text, a literal's text."""
    match v.kind:
        case "iri":
            return F.concat(F.lit(v.prefix), v.col.cast("string")) if v.prefix is not None else v.col
        case "term":
            return v.col["lex"]
        case "bool":
            return F.when(v.col, "true").when(~v.col, "false")
        case "int":
            return v.col.cast("string")
        case "dec":
            text = trimmed_number(v.col.cast("decimal(38,18)"))
            return F.when(text.contains("."), text).otherwise(F.concat(text, F.lit(".0")))
        case "flt" | "dbl":
            text = v.col.cast("string")
            return F.when(text == "Infinity", "INF").when(text == "-Infinity", "-INF").when(text.rlike("[EN]"), text).otherwise(F.concat(text, F.lit("E0")))
        case "dt":
            text = F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        case "date":
            return F.date_format(v.col, "yyyy-MM-dd")
    return v.col


def as_term(v: Val) -> Column:
    if v.kind == "term":
        return v.col
    if v.kind in ("iri", "bnode"):
        return make(IRI if v.kind == "iri" else BNODE, lexical(v))
    if v.kind == "lang":
        return make(LITERAL, v.col, LANG, F.lower(v.lang))
    if v.kind == "id":
        raise TypeError("ids are looked up in the dictionary before they become terms")
    return make(LITERAL, lexical(v), DATATYPES[v.kind])


def datatype(v: Val) -> Column:
    if v.kind == "term":
        return F.when(v.col["k"] == LITERAL, v.col["dt"])
    if v.kind in ("iri", "bnode"):
        return F.lit(None).cast("string")
    return F.when(v.col.isNotNull(), F.lit(LANG if v.kind == "lang" else DATATYPES[v.kind]))


def is_kind(v: Val, k: int) -> Column:
    if v.kind == "term":
        return v.col["k"] == k
    return F.when(v.col.isNotNull(), F.lit({"iri": IRI, "bnode": BNODE}.get(v.kind, LITERAL) == k))


def number(v: Val) -> tuple[Column, Column | int] | None:
    """(double, rank); rank 1 integer, 2 decimal, 3 float, 4 double, a column in the term lane. None: never a number."""
    if v.kind in RANKS:
        return v.col.cast("double"), RANKS[v.kind]
    if v.kind != "term":
        return None
    dt = v.col["dt"]
    rank = F.when(dt.isin(*INTEGERS), 1).when(dt == DECIMAL, 2).when(dt == FLOAT, 3).when(dt == DOUBLE, 4)
    return F.when(rank.isNotNull(), F.trim(v.col["lex"])).try_cast("double"), rank


def exact(v: Val) -> Column:
    """An integer or decimal as decimal(38,18); NULL for other numbers."""
    if v.kind in RANKS:
        return v.col.try_cast("decimal(38,18)") if RANKS[v.kind] <= 2 else F.lit(None).cast("decimal(38,18)")
    dt = v.col["dt"]
    return F.when(dt.isin(*INTEGERS, DECIMAL), F.trim(v.col["lex"])).try_cast("decimal(38,18)")


def of_rank(value: Column, rank: Column | int, decimal: Column | None = None) -> Val:
    """A number of a known or a row's own rank; decimal is the exact value of rank 2, if it is known."""
    if isinstance(rank, int):
        kind = KINDS[rank]
        cast = {"int": "long", "dec": "decimal(38,18)", "flt": "float", "dbl": "double"}[kind]
        return Val(kind, value.try_cast(cast))
    whole = lexical(Val("int", F.when(rank == 1, value).try_cast("long")))
    deci = F.when(rank == 2, value).try_cast("decimal(38,18)")
    deci = lexical(Val("dec", deci if decimal is None else F.coalesce(decimal, deci)))
    real = lexical(Val("dbl", F.when(rank >= 3, value)))
    names = F.when(rank == 1, INTEGER).when(rank == 2, DECIMAL).when(rank == 3, FLOAT).when(rank == 4, DOUBLE)
    return Val("term", make(LITERAL, F.coalesce(whole, deci, real), names))


def text_of(v: Val) -> tuple[Column, Column | None]:
    """A string literal's text and language (NULL column if none); NULL if it is no string."""
    if v.kind == "str":
        return v.col, None
    if v.kind == "lang":
        return v.col, v.lang
    if v.kind == "term":
        return F.when((v.col["dt"] == STRING) | (v.col["dt"] == LANG), v.col["lex"]), v.col["lang"]
    return F.lit(None).cast("string"), None


def like(text: Column, lang: Column | None) -> Val:
    """A string with the language of its source, if any."""
    if lang is None:
        return Val("str", text)
    return Val("term", F.when(lang.isNull(), make(LITERAL, text, STRING)).otherwise(make(LITERAL, text, LANG, lang)))


_ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})$"


def instant(v: Val) -> Column:
    """dateTime as an instant, UTC where it has no zone."""
    if v.kind == "dt":
        return v.col.cast("timestamp_ntz")
    if v.kind == "term":
        lex = F.when(v.col["dt"] == DATETIME, v.col["lex"])
        zone = F.regexp_extract(lex, _ZONE, 1)
        local = F.regexp_replace(lex, _ZONE, "").try_cast("timestamp_ntz")
        minutes = F.when(zone.rlike("^[+-]"), (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)).otherwise(0)
        return local - F.make_dt_interval(mins=minutes)
    return F.lit(None).cast("timestamp_ntz")


def order_key(v: Val) -> Column:
    """A struct that sorts as terms do: blank nodes, IRIs, literals; numbers and times by value."""
    if v.kind in RANKS or v.kind in ("str", "bool", "dt", "date", "id"):
        return v.col
    if v.kind in ("iri", "bnode"):
        return lexical(v)
    t = as_term(v)
    n = number(Val("term", t))
    key = F.struct(t["k"].alias("k"), F.coalesce(n[0], F.lit(float("-inf"))).alias("n"), instant(Val("term", t)).alias("i"), t["lex"].alias("lex"), t["dt"].alias("dt"), t["lang"].alias("lang"))
    return F.when(t.isNotNull(), key)


def native(v: Val) -> Column:
    """The column that a result shows: typed for native lanes, the lexical form for IRIs and the term lane."""
    if v.kind in ("iri", "term", "bnode"):
        return lexical(v)
    return v.col.try_cast("long") if v.kind == "int" else v.col


def unify(a: Val, b: Val) -> tuple[Column, Column, Val] | None:
    """Columns of both sides that are equal when the terms are, and the shared lane; None if they never are."""
    if a.kind == b.kind and a.kind not in ("lang", "term") and a.prefix == b.prefix:
        return a.col, b.col, a
    if a.kind == b.kind == "iri":
        if a.prefix is not None and b.prefix is not None:
            one, two = a.prefix, b.prefix
            if not (one.startswith(two) or two.startswith(one)):
                return None
        return lexical(a), lexical(b), Val("iri", a.col)
    if "term" not in (a.kind, b.kind) and a.kind != b.kind:
        return None  # two native lanes of different types hold different terms
    return as_term(a), as_term(b), Val("term", a.col)
