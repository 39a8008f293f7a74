"""Expressions to Columns. Every error is NULL: partial functions use their try_ form or a guard."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrel.functions.lanes import (
    BNODE, BOOLEAN, DATE, DATETIME, IRI, LANG, LITERAL, RANKS, STRING, Val, as_term, constant, datatype, exact, instant, is_kind, lexical, like, make, number, of_rank, text_of, trimmed_number,
)
from quadrel.plans.algebra import XSD, Expr

Custom = Callable[..., Val]
#: The hidden variable that names a solution, for BNODE with a label.
SOLUTION = ".solution"


def _null() -> Column:
    return F.lit(None)


class Evaluator:
    """Compiles expressions against the lanes of one relation."""

    def __init__(self, vals: dict[str, Val], custom: dict[str, Custom] | None = None, flags: dict[Expr, Column] | None = None, base: str | None = None):
        self.vals, self.custom, self.flags, self.base = vals, custom or {}, flags or {}, base

    def value(self, e: Expr) -> Val:
        match e.op:
            case "var":
                return self.vals.get(e.args[0]) or Val("str", _null().cast("string"))
            case "term":
                return constant(e.args[0])
            case "exists":
                return Val("bool", self.flags[e])
            case "and":
                return Val("bool", self.ebv(e.args[0]) & self.ebv(e.args[1]))
            case "or":
                return Val("bool", self.ebv(e.args[0]) | self.ebv(e.args[1]))
            case "not":
                return Val("bool", ~self.ebv(e.args[0]))
            case "=" | "!=" | "<" | ">" | "<=" | ">=":
                return Val("bool", compare(e.op, self.value(e.args[0]), self.value(e.args[1])))
            case "+" | "-" | "*" | "/":
                return arithmetic(e.op, self.value(e.args[0]), self.value(e.args[1]))
            case "neg":
                v = self.value(e.args[0])
                return v.at(-v.col) if v.kind in RANKS else _unary(v, lambda c: -c)
            case "in":
                first = self.value(e.args[0])
                out = F.lit(False)
                for a in e.args[1:]:
                    out = out | compare("=", first, self.value(a))
                return Val("bool", out)
            case "between":
                v = self.value(e.args[0])
                return Val("bool", compare(">=", v, self.value(e.args[1])) & compare("<=", v, self.value(e.args[2])))
            case "call":
                return self.call(e.extra, [self.value(a) for a in e.args])
        return self.function(e)

    def ebv(self, e: Expr) -> Column:
        return boolean(self.value(e))

    def call(self, name: str, args: list[Val]) -> Val:
        if name in self.custom:
            return self.custom[name](*args)
        if name.startswith(XSD) and len(args) == 1:
            return cast(name, args[0])
        raise ValueError(f"unknown function <{name}>")

    def function(self, e: Expr) -> Val:
        name = e.op
        if name == "BOUND":
            v = self.vals.get(e.args[0].args[0])
            return Val("bool", v.col.isNotNull() if v is not None else F.lit(False))
        if name == "IF":
            c = self.ebv(e.args[0])
            return _merge([self.value(e.args[1]), self.value(e.args[2])], lambda a: F.when(c, a[0]).when(~c, a[1]))
        if name == "COALESCE":
            return _merge([self.value(a) for a in e.args], lambda a: F.coalesce(*a))
        if name in ("IRI", "URI"):
            v = self.value(e.args[0])
            text = F.when(is_kind(v, IRI) | text_of(v)[0].isNotNull(), lexical(v))
            return Val("iri", _resolved(text, self.base) if self.base else text)
        if name == "BNODE" and e.args:
            # one node for each label and solution; the compiler adds the solution's name
            return Val("bnode", F.concat(F.lit("b"), F.md5(F.concat_ws("/", self.vals[SOLUTION].col, text_of(self.value(e.args[0]))[0]))))
        return FUNCTIONS[name](*[self.value(a) for a in e.args])


def boolean(v: Val) -> Column:
    """Effective boolean value."""
    match v.kind:
        case "bool":
            return v.col
        case "str" | "lang":
            return F.length(v.col) > 0
        case "int" | "dec":
            return v.col != 0
        case "flt" | "dbl":
            return (v.col != 0) & ~F.isnan(v.col)
        case "term":
            dt, lex = v.col["dt"], v.col["lex"]
            n = number(v)[0]
            return F.when(dt == BOOLEAN, lex.isin("true", "1")).when((dt == STRING) | (dt == LANG), F.length(lex) > 0).otherwise((n != 0) & ~F.isnan(n))
    return _null().cast("boolean")


def _apply(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def compare(op: str, a: Val, b: Val) -> Column:
    if a.kind in RANKS and b.kind in RANKS:
        return _apply(op, a.col, b.col)
    if a.kind == b.kind and a.kind in ("str", "bool", "date", "dt"):
        return _apply(op, a.col, b.col)
    if a.kind in ("iri", "bnode") and b.kind in ("iri", "bnode"):
        same = F.lit(a.kind == b.kind) & (lexical(a) == lexical(b)) if a.prefix is None or a.prefix != b.prefix else a.col == b.col
        return same if op == "=" else ~same if op == "!=" else _apply(op, lexical(a), lexical(b)) if a.kind == b.kind == "iri" else _null().cast("boolean")
    x, y = as_term(a), as_term(b)
    ta, tb = Val("term", x), Val("term", y)
    na, nb = number(ta)[0], number(tb)[0]
    both = lambda d: (x["dt"] == d) & (y["dt"] == d)
    truth = lambda t: t["lex"].isin("true", "1")
    same_kind = (x["k"] == y["k"]) & (x["k"] != LITERAL)
    out = (
        F.when(na.isNotNull() & nb.isNotNull(), _apply(op, na, nb))
        .when(both(STRING), _apply(op, x["lex"], y["lex"]))
        .when(both(BOOLEAN), _apply(op, truth(x), truth(y)))
        .when(both(DATETIME), _apply(op, instant(ta), instant(tb)))
        .when(both(DATE), _apply(op, x["lex"].try_cast("date"), y["lex"].try_cast("date")))
    )
    if op in ("=", "!="):
        same = (x["k"] == y["k"]) & (x["lex"] == y["lex"]) & x["dt"].eqNullSafe(y["dt"]) & x["lang"].eqNullSafe(y["lang"])
        # terms of different kinds, and strings of different languages, are known to differ; unknown datatypes are not
        differ = (x["k"] != y["k"]) | same_kind | both(LANG) | ((x["dt"] == STRING) & (y["dt"] == LANG)) | ((x["dt"] == LANG) & (y["dt"] == STRING))
        out = out.when(same, F.lit(op == "=")).when(differ, F.lit(op == "!="))
    else:
        out = out.when(both(LANG) & (x["lang"] == y["lang"]), _apply(op, x["lex"], y["lex"])).when((x["k"] == IRI) & (y["k"] == IRI), _apply(op, x["lex"], y["lex"]))
    return F.when(x.isNotNull() & y.isNotNull(), out)


def arithmetic(op: str, a: Val, b: Val) -> Val:
    if a.kind in RANKS and b.kind in RANKS:
        rank = max(RANKS[a.kind], RANKS[b.kind])
        if rank == 1 and op != "/":
            call = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
            return Val("int", call(a.col.try_cast("long"), b.col.try_cast("long")))
        if rank <= 2:
            x, y = a.col.try_cast("decimal(38,18)"), b.col.try_cast("decimal(38,18)")
            if op in "+-":
                return Val("dec", _sum(op, x, y))
            return Val("dec", _product(x, y) if op == "*" else _quotient(x, y))
        return Val("flt" if rank == 3 else "dbl", _double(op, a.col, b.col).cast("float" if rank == 3 else "double"))
    na, nb = number(a), number(b)
    if na is None or nb is None:
        return Val("dbl", _null().cast("double"))
    ra, rb = (F.lit(r) if isinstance(r, int) else r for r in (na[1], nb[1]))
    rank = F.when(ra.isNotNull() & rb.isNotNull(), F.greatest(ra, rb))
    if op == "/":
        rank = F.when(rank == 1, 2).otherwise(rank)
    x, y = exact(a), exact(b)
    decimal = F.when(rank == 2, {"+": lambda: _sum("+", x, y), "-": lambda: _sum("-", x, y), "*": lambda: _product(x, y), "/": lambda: _quotient(x, y)}[op]())
    return of_rank(_double(op, na[0], nb[0]), rank, decimal)


def _sum(op: str, x: Column, y: Column) -> Column:
    """decimal(38,18) of a sum or difference; one digit less before the point leaves room for the carry."""
    return (F.try_add if op == "+" else F.try_subtract)(x.try_cast("decimal(37,18)"), y.try_cast("decimal(37,18)")).cast("decimal(38,18)")


def _product(x: Column, y: Column) -> Column:
    """decimal(38,18) of a product, exact to its 18 digits: whole parts and fractions are multiplied apart."""
    wx, wy = (F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).try_cast("decimal(19,0)") for c in (x, y))
    fx, fy = ((c - w).cast("decimal(18,18)") for c, w in ((x, wx), (y, wy)))
    whole = F.try_multiply(wx, wy).try_cast("decimal(37,18)")
    mixed = [F.try_multiply(w, f).try_cast("decimal(37,18)") for w, f in ((wx, fy), (wy, fx))]
    small = F.try_multiply(fx, fy).cast("decimal(37,18)")
    return _sum("+", _sum("+", whole, mixed[0]), _sum("+", mixed[1], small))


def _quotient(x: Column, y: Column) -> Column:
    """decimal(38,18) of a quotient: a double's estimate, corrected by what it leaves over."""
    guess = F.try_divide(x.cast("double"), y.cast("double")).try_cast("decimal(38,18)")
    left = _sum("-", x, _product(guess, y))
    return _sum("+", guess, F.coalesce(F.try_divide(left.cast("double"), y.cast("double")).try_cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)")))


def _resolved(text: Column, base: str) -> Column:
    """References resolved against a base; absolute ones, nearly all, are left as they are."""
    @F.pandas_udf("string")
    def join(refs: pd.Series) -> pd.Series:
        known = {r: None if r is None else urljoin(base, r) for r in refs.unique()}
        return refs.map(known)

    return F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), text).otherwise(join(text))


def _double(op: str, a: Column, b: Column) -> Column:
    x, y = a.cast("double"), b.cast("double")
    return {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op]


def _unary(v: Val, f: Callable[[Column], Column]) -> Val:
    n = number(v)
    return Val("dbl", _null().cast("double")) if n is None else of_rank(f(n[0]), n[1])


def _merge(vals: list[Val], f: Callable[[list[Column]], Column]) -> Val:
    """One lane for values of several branches."""
    kinds = {(v.kind, v.prefix) for v in vals}
    if len(kinds) == 1 and vals[0].kind not in ("lang", "term"):
        return vals[0].at(f([v.col for v in vals]))
    if {v.kind for v in vals} == {"iri"}:
        return Val("iri", f([lexical(v) for v in vals]))
    return Val("term", f([as_term(v) for v in vals]))


def cast(name: str, v: Val) -> Val:
    """xsd constructor functions."""
    kind = name[len(XSD) :]
    literal = is_kind(v, LITERAL)
    lex = F.when(literal, F.trim(lexical(v)))
    n = number(v)
    n = n[0] if n is not None else _null().cast("double")
    truth = v.col if v.kind == "bool" else F.when(v.col["dt"] == BOOLEAN, v.col["lex"].isin("true", "1")) if v.kind == "term" else _null().cast("boolean")
    as_number = truth.cast("int").cast("double")
    match kind:
        case "string":
            if v.kind == "iri" or v.kind == "term":
                base = F.when(is_kind(v, IRI), lexical(v)).otherwise(F.when(literal, lexical(v)))
            else:
                base = lexical(v)
            if v.kind in ("dec", "dbl", "flt"):
                plain = (F.abs(v.col) >= 1e-6) & (F.abs(v.col) <= 1e6) & (v.col == F.floor(v.col)) | (v.col == 0)
                base = F.when(plain, v.col.cast("decimal(38,0)").cast("string")).when(F.lit(v.kind == "dec"), trimmed_number(v.col)).otherwise(base)
            return Val("str", base)
        case "boolean":
            return Val("bool", F.coalesce(truth, (n != 0) & ~F.isnan(n), F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False)))
        case "integer" | "int" | "long":
            if v.kind == "int":
                return v
            whole = F.when(lex.rlike(r"^[+-]?[0-9]+$"), lex).try_cast("long")
            return Val("int", F.coalesce(as_number.cast("long"), whole, F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).try_cast("long")))
        case "decimal":
            digits = F.when(lex.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), lex).try_cast("decimal(38,18)")
            exact = v.col if v.kind in ("int", "dec") else _null()
            return Val("dec", F.coalesce(exact.cast("decimal(38,18)"), as_number.try_cast("decimal(38,18)"), digits, n.try_cast("decimal(38,18)")))
        case "float" | "double":
            digits = F.when(lex.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), lex).try_cast("double")
            d = F.coalesce(n, as_number, digits)
            return Val("dbl", d) if kind == "double" else Val("flt", d.cast("float"))
        case "dateTime":
            if v.kind == "dt":
                return v
            if v.kind == "date":
                return Val("dt", v.col.cast("timestamp_ntz"))
            return Val("term", make(LITERAL, F.when(lex.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}") & F.regexp_replace(lex, r"(Z|[+-]\d\d:\d\d)$", "").try_cast("timestamp_ntz").isNotNull(), lex), DATETIME))
        case "date":
            if v.kind == "dt":
                return Val("date", v.col.cast("date"))
            return Val("date", F.substring(F.when(lex.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), lex), 1, 10).try_cast("date"))
    raise ValueError(f"no cast to {kind}")


# ------------------------------------------------------------------ functions

def _strings(f: Callable[[Column, Column], Column]) -> Callable[[Val, Val], Val]:
    def run(a: Val, b: Val) -> Val:
        (x, lx), (y, ly) = text_of(a), text_of(b)
        return Val("bool", F.when(_compatible(lx, ly), f(x, y)))

    return run


def _compatible(one: Column | None, other: Column | None) -> Column:
    """A plain second argument goes with anything, one with a language only with the same."""
    if other is None:
        return F.lit(True)
    return other.isNull() | (other == one if one is not None else F.lit(False))


def _same_string(f: Callable[[Column], Column]) -> Callable[[Val], Val]:
    def run(v: Val) -> Val:
        text, lang = text_of(v)
        return Val("lang", f(text), lang) if v.kind == "lang" else like(f(text), lang)

    return run


def _strbefore(a: Val, b: Val) -> Val:
    (x, lx), (y, ly) = text_of(a), text_of(b)
    at = F.call_function("locate", y, x)
    hit = at > 0
    text = F.when(_compatible(lx, ly), F.when(hit, x.substr(F.lit(1), at - 1)).otherwise(F.when(x.isNotNull() & y.isNotNull(), F.lit(""))))
    return like(text, None if lx is None else F.when(hit, lx))


def _strafter(a: Val, b: Val) -> Val:
    (x, lx), (y, ly) = text_of(a), text_of(b)
    at = F.call_function("locate", y, x)
    hit = at > 0
    text = F.when(_compatible(lx, ly), F.when(hit, x.substr(at + F.length(y), F.length(x))).otherwise(F.when(x.isNotNull() & y.isNotNull(), F.lit(""))))
    return like(text, None if lx is None else F.when(hit, lx))


def _concat(*vals: Val) -> Val:
    if not vals:
        return Val("str", F.lit(""))
    parts = [text_of(v) for v in vals]
    text = F.concat(*[p[0] for p in parts])
    langs = [p[1] for p in parts]
    if any(x is None for x in langs):
        return Val("str", text)
    same = langs[0]
    for x in langs[1:]:
        same = F.when(same == x, same)
    return like(text, same)


def _substr(v: Val, start: Val, length: Val | None = None) -> Val:
    """1-based code points; a start before the text cuts the length, as in XPath."""
    text, lang = text_of(v)
    s = F.floor(number(start)[0] + 0.5).cast("int")
    if length is None:
        out = text.substr(F.greatest(s, F.lit(1)), F.length(text))
    else:
        end = s + F.floor(number(length)[0] + 0.5).cast("int")
        first = F.greatest(s, F.lit(1))
        out = F.when(end > first, text.substr(first, end - first)).otherwise(F.when(text.isNotNull() & end.isNotNull(), F.lit("")))
    return like(out, lang)


def _flags(pattern: Column, flags: Val | None) -> tuple[Column, Column]:
    """The pattern with its flags in front, and whether it is quoted (flag q: every character stands for itself)."""
    if flags is None:
        return pattern, F.lit(False)
    given = flags.col if flags.kind == "str" else lexical(flags)
    quoted = given.contains("q")
    # with q only i has a meaning; a \\E inside the pattern would end the quotation
    f = F.when(quoted, F.regexp_replace(given, "[^i]", "")).otherwise(given)
    body = F.when(quoted, F.concat(F.lit("\\Q"), F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))).otherwise(pattern)
    return F.when(F.length(f) > 0, F.concat(F.lit("(?"), f, F.lit(")"), body)).otherwise(body), quoted


def _regex(v: Val, pattern: Val, flags: Val | None = None) -> Val:
    return Val("bool", F.rlike(text_of(v)[0], _flags(text_of(pattern)[0], flags)[0]))


def _replace(v: Val, pattern: Val, by: Val, flags: Val | None = None) -> Val:
    text, lang = text_of(v)
    body, quoted = _flags(text_of(pattern)[0], flags)
    by = text_of(by)[0]
    plain = F.replace(F.replace(by, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return like(F.regexp_replace(text, body, by if flags is None else F.when(quoted, plain).otherwise(by)), lang)


def _encode(v: Val) -> Val:
    text = text_of(v)[0]
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return Val("str", out)


def _round(f: Callable[[Column], Column]) -> Callable[[Val], Val]:
    def run(v: Val) -> Val:
        if v.kind == "int":
            return v
        if v.kind == "dec":
            return Val("dec", f(v.col).cast("decimal(38,18)"))
        if v.kind in ("dbl", "flt"):
            return v.at(f(v.col).cast("double" if v.kind == "dbl" else "float"))
        return _unary(v, lambda c: f(c).cast("double"))

    return run


def _abs(v: Val) -> Val:
    return v.at(F.abs(v.col)) if v.kind in RANKS else _unary(v, F.abs)


_FORM = r"^(-?[0-9]{4,})-([0-9]{2})-([0-9]{2})(?:T([0-9]{2}):([0-9]{2}):([0-9]{2})(\.[0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?$"


def _field(group: int, native: Callable[[Column], Column]) -> Callable[[Val], Val]:
    """A field of the local time as it is written, whatever the session's zone."""

    def run(v: Val) -> Val:
        if v.kind in ("dt", "date"):
            return Val("int", native(v.col).cast("long"))
        t = as_term(v)
        text = F.when((t["dt"] == DATETIME) | (t["dt"] == DATE), F.regexp_extract(t["lex"], _FORM, group))
        return Val("int", F.when(text != "", text).try_cast("long"))

    return run


def _seconds(v: Val) -> Val:
    if v.kind == "dt":
        return Val("dec", F.date_format(v.col, "ss.SSSSSS").cast("decimal(38,18)"))
    t = as_term(v)
    text = F.when(t["dt"] == DATETIME, F.concat(F.regexp_extract(t["lex"], _FORM, 6), F.regexp_extract(t["lex"], _FORM, 7)))
    return Val("dec", F.when(text != "", text).try_cast("decimal(38,18)"))


def _tz(v: Val) -> Val:
    if v.kind == "dt":
        return Val("str", F.when(v.col.isNotNull(), F.lit("")))
    t = as_term(v)
    return Val("str", F.when(t["dt"] == DATETIME, F.regexp_extract(t["lex"], _FORM, 8)))


def _timezone(v: Val) -> Val:
    zone = _tz(v).col
    h, m = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    span = F.concat(F.when(zone.startswith("-") & (h + m > 0), "-").otherwise(""), F.lit("PT"), F.when((h > 0) | (m == 0), F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    text = F.when(zone == "Z", "PT0S").when(zone.rlike("^[+-]00:00$"), "PT0S").when(zone != "", span)
    return Val("term", make(LITERAL, text, XSD + "dayTimeDuration"))


def _hash(f: Callable[[Column], Column]) -> Callable[[Val], Val]:
    def run(v: Val) -> Val:
        text, lang = text_of(v)
        return Val("str", f(text if lang is None else F.when(lang.isNull(), text)))

    return run


def _lang(v: Val) -> Val:
    if v.kind == "lang":
        return Val("str", F.lower(v.lang))
    if v.kind == "term":
        return Val("str", F.when(v.col["k"] == LITERAL, F.coalesce(v.col["lang"], F.lit(""))))
    return Val("str", F.when(is_kind(v, LITERAL), F.lit("")))


def _langmatches(tag: Val, wanted: Val) -> Val:
    a, b = F.lower(text_of(tag)[0]), F.lower(text_of(wanted)[0])
    return Val("bool", F.when(b == "*", a != "").otherwise((a == b) | a.startswith(F.concat(b, F.lit("-")))))


def _numeric(v: Val) -> Val:
    n = number(v)
    return Val("bool", F.when(v.col.isNotNull(), F.lit(False) if n is None else n[0].isNotNull()))


def _sameterm(a: Val, b: Val) -> Val:
    if a.kind == b.kind and a.kind not in ("lang", "term") and a.prefix == b.prefix:
        return Val("bool", a.col == b.col)
    x, y = as_term(a), as_term(b)
    return Val("bool", F.when(x.isNotNull() & y.isNotNull(), x.eqNullSafe(y)))


def _bnode(v: Val | None = None) -> Val:
    if v is None:
        return Val("bnode", F.uuid())
    raise ValueError("BNODE with a label needs the solution it stands in")


def _strdt(v: Val, dt: Val) -> Val:
    text, lang = text_of(v)
    plain = text if lang is None else F.when(lang.isNull(), text)
    return Val("term", make(LITERAL, plain, F.when(is_kind(dt, IRI), lexical(dt))))


def _strlang(v: Val, tag: Val) -> Val:
    text, lang = text_of(v)
    plain = text if lang is None else F.when(lang.isNull(), text)
    return Val("lang", plain, F.lower(text_of(tag)[0]))


def _is(k: int) -> Callable[[Val], Val]:
    return lambda v: Val("bool", is_kind(v, k))


FUNCTIONS: dict[str, Callable[..., Val]] = {
    "STR": lambda v: Val("str", F.when(~is_kind(v, BNODE), lexical(v))),
    "LANG": _lang,
    "LANGMATCHES": _langmatches,
    "DATATYPE": lambda v: Val("iri", datatype(v)),
    "BNODE": _bnode,
    "RAND": lambda: Val("dbl", F.rand()),
    "ABS": _abs,
    "CEIL": _round(F.ceil),
    "FLOOR": _round(F.floor),
    "ROUND": _round(lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)"))),
    "CONCAT": _concat,
    "STRLEN": lambda v: Val("int", F.length(text_of(v)[0]).cast("long")),
    "UCASE": _same_string(F.upper),
    "LCASE": _same_string(F.lower),
    "ENCODE_FOR_URI": _encode,
    "CONTAINS": _strings(lambda x, y: F.contains(x, y)),
    "STRSTARTS": _strings(lambda x, y: F.startswith(x, y)),
    "STRENDS": _strings(lambda x, y: F.endswith(x, y)),
    "STRBEFORE": _strbefore,
    "STRAFTER": _strafter,
    "YEAR": _field(1, F.year),
    "MONTH": _field(2, F.month),
    "DAY": _field(3, F.dayofmonth),
    "HOURS": _field(4, F.hour),
    "MINUTES": _field(5, F.minute),
    "SECONDS": _seconds,
    "TIMEZONE": _timezone,
    "TZ": _tz,
    "NOW": lambda: Val("dt", F.localtimestamp()),
    "UUID": lambda: Val("iri", F.concat(F.lit("urn:uuid:"), F.uuid())),
    "STRUUID": lambda: Val("str", F.uuid()),
    "MD5": _hash(F.md5),
    "SHA1": _hash(F.sha1),
    "SHA256": _hash(lambda c: F.sha2(c, 256)),
    "SHA384": _hash(lambda c: F.sha2(c, 384)),
    "SHA512": _hash(lambda c: F.sha2(c, 512)),
    "STRLANG": _strlang,
    "STRDT": _strdt,
    "SAMETERM": _sameterm,
    "ISIRI": _is(IRI),
    "ISURI": _is(IRI),
    "ISBLANK": _is(BNODE),
    "ISLITERAL": _is(LITERAL),
    "ISNUMERIC": _numeric,
    "REGEX": _regex,
    "SUBSTR": _substr,
    "REPLACE": _replace,
}
