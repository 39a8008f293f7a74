"""The logical plan of a query: terms, expressions and algebra as plain immutable values."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, NamedTuple

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"


class Term(NamedTuple):
    """An RDF term. kind: iri, bnode or literal; a literal has a datatype IRI, and a language if that is rdf:langString."""

    kind: str
    value: str
    datatype: str | None = None
    language: str | None = None


def iri(value: str) -> Term:
    return Term("iri", value)


def literal(value: str, datatype: str = XSD + "string", language: str | None = None) -> Term:
    return Term("literal", value, RDF + "langString" if language else datatype, language.lower() if language else None)


class Var(NamedTuple):
    """A variable; names that begin with a dot stand for blank nodes and never leave the pattern."""

    name: str


@dataclass(frozen=True)
class Expr:
    """op: var, term, a function or operator name, call (custom function), exists, aggregate or window."""

    op: str
    args: tuple = ()
    extra: Any = None


@dataclass(frozen=True)
class Path:
    """op: link, inverse, seq, alt, nps (negated set), plus, star, opt."""

    op: str
    args: tuple = ()


class Plan:
    """Base of all algebra nodes."""


@dataclass(frozen=True)
class Unit(Plan):
    """One empty row."""


@dataclass(frozen=True)
class Nothing(Plan):
    """No row."""


@dataclass(frozen=True)
class Table(Plan):
    names: tuple[str, ...]
    rows: tuple[tuple[Term | None, ...], ...]


@dataclass(frozen=True)
class BGP(Plan):
    triples: tuple[tuple, ...]


@dataclass(frozen=True)
class PathPattern(Plan):
    subject: Any
    path: Path
    object: Any


@dataclass(frozen=True)
class QuadPattern(Plan):
    subject: Any
    predicate: Any
    object: Any
    graph: Any


@dataclass(frozen=True)
class Join(Plan):
    left: Plan
    right: Plan


@dataclass(frozen=True)
class LeftJoin(Plan):
    left: Plan
    right: Plan
    condition: Expr | None = None


@dataclass(frozen=True)
class Union(Plan):
    left: Plan
    right: Plan


@dataclass(frozen=True)
class Minus(Plan):
    left: Plan
    right: Plan


@dataclass(frozen=True)
class Filter(Plan):
    child: Plan
    condition: Expr


@dataclass(frozen=True)
class Extend(Plan):
    child: Plan
    name: str
    value: Expr


@dataclass(frozen=True)
class Graph(Plan):
    graph: Any
    child: Plan


@dataclass(frozen=True)
class Service(Plan):
    endpoint: Any
    text: str
    names: tuple[str, ...]
    silent: bool


@dataclass(frozen=True)
class Aggregate(Plan):
    child: Plan
    groups: tuple[tuple[Expr, str | None], ...]
    aggregates: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Windows(Plan):
    child: Plan
    functions: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Project(Plan):
    child: Plan
    names: tuple[str, ...]


@dataclass(frozen=True)
class Distinct(Plan):
    child: Plan


@dataclass(frozen=True)
class Reduced(Plan):
    child: Plan


@dataclass(frozen=True)
class Order(Plan):
    child: Plan
    keys: tuple[tuple[Expr, bool], ...]


@dataclass(frozen=True)
class Slice(Plan):
    child: Plan
    offset: int
    limit: int | None


@dataclass(frozen=True)
class Query:
    form: str  # select, ask, construct, describe
    plan: Plan
    names: tuple[str, ...] = ()
    template: tuple[tuple, ...] = ()
    describe: tuple = ()
    default_graphs: tuple[str, ...] = ()
    named_graphs: tuple[str, ...] = ()
    base: str | None = None
    prefixes: dict = field(default_factory=dict)


def variables(plan: Any) -> list[str]:
    """Variables in scope of a plan, in order of appearance."""
    out: dict[str, None] = {}

    def node(x):
        if isinstance(x, Var):
            out[x.name] = None

    def walk(p):
        match p:
            case Table():
                out.update(dict.fromkeys(p.names))
            case BGP():
                for t in p.triples:
                    for x in t:
                        node(x)
            case PathPattern():
                node(p.subject), node(p.object)
            case QuadPattern():
                node(p.subject), node(p.predicate), node(p.object), node(p.graph)
            case Join() | LeftJoin() | Union():
                walk(p.left), walk(p.right)
            case Minus():
                walk(p.left)
            case Extend():
                walk(p.child)
                out[p.name] = None
            case Graph():
                node(p.graph), walk(p.child)
            case Service():
                out.update(dict.fromkeys(p.names))
            case Aggregate():
                for e, n in p.groups:
                    if n:
                        out[n] = None
                out.update(dict.fromkeys(n for n, _ in p.aggregates))
            case Windows():
                walk(p.child)
                out.update(dict.fromkeys(n for n, _ in p.functions))
            case Project():
                out.update(dict.fromkeys(p.names))
            case Query():
                walk(p.plan)
            case Filter() | Distinct() | Reduced() | Order() | Slice():
                walk(p.child)

    walk(plan)
    return list(out)


def show(plan: Any, depth: int = 0) -> str:
    """An indented tree of the plan."""
    pad = "  " * depth
    if not isinstance(plan, (Plan, Query)):
        return f"{pad}{plan}\n"
    simple, children = [], []
    for name, value in vars(plan).items():
        (children if isinstance(value, (Plan, Query)) else simple).append((name, value))
    head = ", ".join(f"{k}={v}" for k, v in simple if v not in ((), None, {}))
    return f"{pad}{type(plan).__name__}({head})\n" + "".join(show(c, depth + 1) for _, c in children)
