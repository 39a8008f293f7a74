"""Turtle in and out. A document is parsed whole, one task per file; a TriG-free subset of the query grammar does it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.functions.lanes import TERM_TYPE
from quadrel.plans.algebra import XSD, Term, Var, iri
from quadrel.plans.parser import Parser, SyntaxProblem
from quadrel.sources.ntriples import escape_iri, escape_literal

KIND = {"bnode": 1, "iri": 2, "literal": 3}


class _Document(Parser):
    """Turtle is the query grammar's triples block without variables, plus directives."""

    def triples(self) -> Iterator[tuple[Term, Term, Term]]:
        while self.kind != "end":
            if self.kind == "lang" and self.value in ("@prefix", "@base"):
                self.directive(self.take()[1][1:])
                self.need(".")
                continue
            if self.is_word("PREFIX", "BASE"):
                self.directive(self.take()[1].lower())
                continue
            out: list[tuple] = []
            if self.looks("[") or self.looks("("):
                s = self.node(out)
                if not self.looks("."):
                    self.properties(s, out)
            else:
                s = self.term()
                self.properties(s, out)
            self.need(".")
            for t in out:
                yield tuple(Term("bnode", x.name.lstrip(".")) if isinstance(x, Var) else x for x in t)

    def directive(self, what: str) -> None:
        if what == "base":
            self.base = self.resolve(self.take()[1][1:-1])
        else:
            name = self.take()[1]
            if not name.endswith(":"):
                raise SyntaxProblem(f"bad prefix {name!r}")
            self.prefixes[name[:-1]] = self.resolve(self.take()[1][1:-1])

    def term(self):
        if self.kind == "var":
            raise SyntaxProblem("Turtle has no variables")
        return super().term()

    def verb(self):
        return self.link()


def parse(text: str, base: str | None = None) -> list[tuple[Term, Term, Term]]:
    """The triples of a Turtle (or N-Triples) document; SyntaxProblem if it is none."""
    return list(_Document(text, base).triples())


def cells(t: Term | None, document: str = ""):
    if t is None:
        return None
    return {"k": KIND[t.kind], "lex": document + t.value if t.kind == "bnode" else t.value, "dt": t.datatype, "lang": t.language}


def read_whole(spark: SparkSession, path: str, parser, graph: str | None = None) -> DataFrame:
    """Quads of whole-file documents: each file is parsed by one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                document = hashlib.md5(name.encode()).hexdigest() + "x"
                g = cells(iri(graph)) if graph else None
                rows = [{"s": cells(s, document), "p": cells(p), "o": cells(o, document), "g": g} for s, p, o in parser(bytes(content).decode("utf-8"), name)]
                yield pd.DataFrame(rows, columns=list("spog"))

    return files.mapInPandas(run, ", ".join(f"{c} {TERM_TYPE}" for c in "spog"))


def read(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    return read_whole(spark, path, parse, graph)


_SHORT = re.compile(r"[+-]?[0-9]+\Z")
_LOCAL = re.compile(r"[\w](?:[\w\-]*[\w])?\Z")


def _node(t: Term, prefixes: dict[str, str]) -> str:
    if t.kind == "bnode":
        return f"_:{t.value}"
    if t.kind == "iri":
        for name, start in prefixes.items():
            if t.value.startswith(start) and _LOCAL.match(t.value[len(start) :]):
                return f"{name}:{t.value[len(start):]}"
        return f"<{escape_iri(t.value, False)}>"
    if t.datatype == XSD + "integer" and _SHORT.match(t.value):
        return t.value
    text = f'"{escape_literal(t.value)}"'
    if t.language:
        return f"{text}@{t.language}"
    return text if t.datatype in (None, XSD + "string") else f"{text}^^{_node(iri(t.datatype), prefixes)}"


def serialize(triples: list[tuple[Term, Term, Term]], prefixes: dict[str, str] | None = None) -> str:
    """Turtle grouped by subject and predicate, in order; for results that fit on the driver (write N-Triples otherwise)."""
    prefixes = prefixes or {}
    rdf_type = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    order = lambda t: (KIND[t.kind], t.value, t.datatype or "", t.language or "")
    # language-tagged strings come before numbers, numbers by value
    value = lambda t: (KIND[t.kind], 0 if t.language else 1, float(t.value) if t.datatype == XSD + "integer" and _SHORT.match(t.value) else 0, t.value)
    out = "".join(f"@prefix {n}: <{i}> .\n" for n, i in prefixes.items()) + ("\n" if prefixes else "")
    by_subject: dict[Term, dict[Term, list[Term]]] = {}
    for s, p, o in sorted(set(triples), key=lambda x: (order(x[0]), x[1].value, value(x[2]))):
        by_subject.setdefault(s, {}).setdefault(p, []).append(o)
    for s, properties in by_subject.items():
        parts = [f"{'a' if p.value == rdf_type else _node(p, prefixes)} {', '.join(_node(o, prefixes) for o in objects)}" for p, objects in properties.items()]
        out += f"{_node(s, prefixes)} " + " ;\n\t".join(parts) + " .\n"
    return out


def rows_of(triples: DataFrame) -> list[tuple[Term, Term, Term]]:
    """(s, p, o) structs as Terms, on the driver."""
    back = {v: k for k, v in KIND.items()}
    return [tuple(Term(back[r[c]["k"]], r[c]["lex"], r[c]["dt"], r[c]["lang"]) for c in "spo") for r in triples.select(*[F.col(c) for c in "spo"]).toLocalIterator()]
