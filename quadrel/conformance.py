"""Runs manifests of query-evaluation tests: query, data and expected result files, compared up to blank-node names."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

from quadrel.plans.algebra import RDF, Term
from quadrel.plans.compiler import Engine
from quadrel.plans.parser import SyntaxProblem, parse
from quadrel.sources import rdfxml, results, turtle
from quadrel.sources.store import TermStore, term_frame

_MF = "http://www.w3.org/2001/sw/DataAccess/tests/test-manifest#"
_QT = "http://www.w3.org/2001/sw/DataAccess/tests/test-query#"
_RS = "http://www.w3.org/2001/sw/DataAccess/tests/result-set#"


@dataclass
class Outcome:
    name: str
    passed: bool
    why: str = ""


def _documents(path: Path) -> list[tuple[Term, Term, Term]]:
    text = path.read_text(encoding="utf-8")
    return rdfxml.parse(text, path.as_uri()) if path.suffix in (".rdf", ".owl") else turtle.parse(text, path.as_uri())


def _local(t: Term) -> Path:
    return Path(urlsplit(t.value).path)


def _rows(result: results.Result) -> list[frozenset]:
    if isinstance(result, results.Bindings):
        return [frozenset(r.items()) for r in result.rows]
    return [frozenset(zip("spo", t)) for t in result.triples]


def equal(a: results.Result, b: results.Result) -> bool:
    """Same rows, order aside, under some renaming of blank nodes; any number of them."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    return _isomorphic(Counter(_rows(a)), Counter(_rows(b)))


def _blanks(rows: Counter) -> set[Term]:
    return {t for r in rows for _, t in r if t.kind == "bnode"}


def _colours(rows: Counter, start: dict[Term, int]) -> dict[Term, int]:
    """Blank nodes coloured by the rows they stand in, refined until no colour splits any more."""
    colour = start
    while True:
        views: dict[Term, list] = {t: [] for t in colour}
        for row, n in rows.items():
            seen = {k: ("", colour[t]) if t.kind == "bnode" else (str(t), 0) for k, t in row}
            for k, t in row:
                if t.kind == "bnode":
                    views[t].append((k, n, sorted((x, seen[x], u == t) for x, u in row)))
        key = {t: hash((colour[t], str(sorted(v, key=str)))) for t, v in views.items()}
        if len(set(key.values())) == len(set(colour.values())):
            return key
        colour = key


def _isomorphic(left: Counter, right: Counter) -> bool:
    """Colour refinement, then a search that fixes one node of the smallest ambiguous colour at a time."""

    def search(mine: dict[Term, int], theirs: dict[Term, int]) -> bool:
        mine, theirs = _colours(left, mine), _colours(right, theirs)
        if Counter(mine.values()) != Counter(theirs.values()):
            return False
        sizes = Counter(mine.values())
        open_ = [c for c, n in sizes.items() if n > 1]
        if not open_:
            back = {c: t for t, c in theirs.items()}
            to = {t: back[c] for t, c in mine.items()}
            return Counter({frozenset((k, to.get(t, t)) for k, t in r): n for r, n in left.items()}) == right
        pick = min(open_, key=lambda c: (sizes[c], c))
        one = min((t for t, c in mine.items() if c == pick), key=str)
        return any(search({**mine, one: 1}, {**theirs, other: 1}) for other in sorted((t for t, c in theirs.items() if c == pick), key=str))

    if sum(left.values()) != sum(right.values()) or len(_blanks(left)) != len(_blanks(right)):
        return False
    return search(dict.fromkeys(_blanks(left), 0), dict.fromkeys(_blanks(right), 0))


def _result_graph(triples: list) -> results.Result:
    """Expected results written as RDF."""
    by = {(s, p.value): [] for s, p, _ in triples}
    for s, p, o in triples:
        by[s, p.value].append(o)
    sets = [s for s, p, o in triples if o.value == _RS + "ResultSet"]
    if not sets:
        return results.Triples(triples)
    root = sets[0]
    if (root, _RS + "boolean") in by:
        return by[root, _RS + "boolean"][0].value == "true"
    rows = []
    for solution in by.get((root, _RS + "solution"), []):
        rows.append({by[b, _RS + "variable"][0].value: by[b, _RS + "value"][0] for b in by.get((solution, _RS + "binding"), [])})
    return results.Bindings([v.value for v in by.get((root, _RS + "resultVariable"), [])], rows)


def expected(path: Path) -> results.Result:
    text = path.read_text(encoding="utf-8")
    match path.suffix:
        case ".srx":
            return results.from_xml(text)
        case ".srj":
            return results.from_json(text)
        case ".tsv":
            return results.from_tsv(text)
    return _result_graph(_documents(path))


def evaluate(spark: SparkSession, query: str, default: list[Path], named: list[Path]) -> results.Result:
    """The result of a query over files; the default graph is their merge."""
    quads = [(*t, Term("iri", "urn:default")) for p in default for t in _documents(p)]
    quads += [(*t, Term("iri", p.as_uri())) for p in named for t in _documents(p)]
    engine = Engine(TermStore(term_frame(spark, quads), ["urn:default"]))
    form = parse(query).form
    if form == "ask":
        return bool(engine.query(query).first()["result"])
    if form == "select":
        return results.of_frame(engine.terms(query))
    return results.Triples(turtle.rows_of(engine.query(query)))


def run(spark: SparkSession, manifest: str) -> list[Outcome]:
    """Outcomes of a manifest's evaluation and syntax tests, in the order of its list."""
    path = Path(manifest).resolve()
    triples = _documents(path)
    by: dict[tuple[Term, str], list[Term]] = {}
    for s, p, o in triples:
        by.setdefault((s, p.value), []).append(o)
    one = lambda s, p: (by.get((s, p)) or [None])[0]
    out = []
    for head in (o for _, p, o in triples if p.value == _MF + "entries"):
        cell = head
        while cell is not None and cell.value != RDF + "nil":
            test = one(cell, RDF + "first")
            cell = one(cell, RDF + "rest")
            name = one(test, _MF + "name")
            name = name.value if name else test.value
            kind = (one(test, RDF + "type") or test).value
            action = one(test, _MF + "action")
            try:
                if "Syntax" in kind:
                    good = True
                    try:
                        parse(_local(action).read_text(encoding="utf-8"))
                    except SyntaxProblem:
                        good = False
                    out.append(Outcome(name, good is ("Negative" not in kind)))
                    continue
                text = _local(one(action, _QT + "query")).read_text(encoding="utf-8")
                got = evaluate(spark, text, [_local(d) for d in by.get((action, _QT + "data"), [])], [_local(d) for d in by.get((action, _QT + "graphData"), [])])
                want = expected(_local(one(test, _MF + "result")))
                out.append(Outcome(name, equal(got, want), "" if equal(got, want) else f"{got} instead of {want}"))
            except Exception as e:  # a test that breaks is a failed test
                out.append(Outcome(name, False, repr(e)))
    return out
