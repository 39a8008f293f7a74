"""RDF/XML in: a SAX handler over a stack of node and property elements."""

from __future__ import annotations

import io
import itertools
import xml.sax
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession

from quadrel.plans.algebra import RDF, Term, iri, literal
from quadrel.plans.parser import SyntaxProblem
from quadrel.sources.turtle import read_whole

_XML = "http://www.w3.org/XML/1998/namespace"
_SYNTAX = {RDF + x for x in ("RDF", "ID", "about", "parseType", "resource", "nodeID", "datatype", "Description", "li")}


class _Frame:
    def __init__(self, kind: str, base: str, lang: str | None):
        self.kind, self.base, self.lang = kind, base, lang
        self.node: Term | None = None
        self.predicate: Term | None = None
        self.text: list[str] = []
        self.datatype: str | None = None
        self.object: Term | None = None
        self.reified: Term | None = None
        self.items: list[Term] | None = None
        self.count = 0


class _Handler(xml.sax.ContentHandler):
    def __init__(self, base: str):
        super().__init__()
        self.out: list[tuple[Term, Term, Term]] = []
        self.stack = [_Frame("document", base, None)]
        self.fresh = itertools.count()

    def blank(self) -> Term:
        return Term("bnode", f"x{next(self.fresh)}")

    def emit(self, s: Term, p: Term, o: Term, reified: Term | None = None) -> None:
        self.out.append((s, p, o))
        if reified:
            for name, x in (("type", iri(RDF + "Statement")), ("subject", s), ("predicate", p), ("object", o)):
                self.out.append((reified, iri(RDF + name), x))

    def startElementNS(self, name, qname, attrs):
        tag = (name[0] or "") + name[1]
        values = {(n[0] or "") + n[1]: attrs.getValue(n) for n in attrs.getNames()}
        top = self.stack[-1]
        base = values.pop(_XML + "base", top.base)
        lang = values.pop(_XML + "lang", top.lang) or None
        values = {k: v for k, v in values.items() if not k.startswith(_XML)}
        if tag == RDF + "RDF" and top.kind == "document":
            self.stack.append(_Frame("root", base, lang))
        elif top.kind in ("document", "root", "property", "collection"):
            self.start_node(tag, values, base, lang, top)
        elif top.kind == "node":
            self.start_property(tag, values, base, lang, top)
        else:
            raise SyntaxProblem(f"unexpected element {tag}")

    def start_node(self, tag, values, base, lang, parent) -> None:
        f = _Frame("node", base, lang)
        if RDF + "about" in values:
            f.node = iri(urljoin(base, values.pop(RDF + "about")))
        elif RDF + "ID" in values:
            f.node = iri(urljoin(base, "#" + values.pop(RDF + "ID")))
        elif RDF + "nodeID" in values:
            f.node = Term("bnode", "n" + values.pop(RDF + "nodeID"))
        else:
            f.node = self.blank()
        if tag != RDF + "Description":
            self.emit(f.node, iri(RDF + "type"), iri(tag))
        self.attributes(f.node, values, base, lang)
        if parent.kind == "collection":
            parent.items.append(f.node)
        elif parent.kind == "property":
            parent.object = f.node
        self.stack.append(f)

    def attributes(self, node, values, base, lang) -> None:
        for name, value in values.items():
            if name == RDF + "type":
                self.emit(node, iri(name), iri(urljoin(base, value)))
            elif name not in _SYNTAX:
                self.emit(node, iri(name), literal(value, language=lang))

    def start_property(self, tag, values, base, lang, parent) -> None:
        f = _Frame("property", base, lang)
        if tag == RDF + "li":
            parent.count += 1
            tag = f"{RDF}_{parent.count}"
        f.predicate = iri(tag)
        if RDF + "ID" in values:
            f.reified = iri(urljoin(base, "#" + values.pop(RDF + "ID")))
        how = values.pop(RDF + "parseType", None)
        f.datatype = values.pop(RDF + "datatype", None)
        if how == "Literal":
            raise SyntaxProblem("rdf:XMLLiteral is not supported")
        if how == "Collection":
            f.kind, f.items = "collection", []
        elif how == "Resource":
            f.object = self.blank()
            inner = _Frame("node", base, lang)
            inner.node = f.object
            self.stack += [f, inner]
            return
        elif RDF + "resource" in values:
            f.object = iri(urljoin(base, values.pop(RDF + "resource")))
        elif RDF + "nodeID" in values:
            f.object = Term("bnode", "n" + values.pop(RDF + "nodeID"))
        elif values:
            f.object = self.blank()
        if values and f.object is not None:
            self.attributes(f.object, values, base, lang)
        self.stack.append(f)

    def characters(self, content):
        if self.stack[-1].kind == "property":
            self.stack[-1].text.append(content)

    def endElementNS(self, name, qname):
        f = self.stack.pop()
        if f.kind == "node" and self.stack[-1].kind == "property" and self.stack[-1].object is f.node and self._resource_ends(name):
            f = self.stack.pop()
        if f.kind == "collection":
            head = iri(RDF + "nil")
            for x in reversed(f.items):
                cell = self.blank()
                self.out += [(cell, iri(RDF + "first"), x), (cell, iri(RDF + "rest"), head)]
                head = cell
            self.emit(self.stack[-1].node, f.predicate, head, f.reified)
        elif f.kind == "property":
            o = f.object
            if o is None:
                text = "".join(f.text)
                o = literal(text, urljoin(f.base, f.datatype)) if f.datatype else literal(text, language=f.lang)
            self.emit(self.stack[-1].node, f.predicate, o, f.reified)

    def _resource_ends(self, name) -> bool:
        """parseType="Resource" has two frames for one element."""
        p = self.stack[-1].predicate.value
        return p == (name[0] or "") + name[1] or name == (RDF, "li")


def parse(text: str, base: str = "") -> list[tuple[Term, Term, Term]]:
    """The triples of an RDF/XML document; SyntaxProblem if it is none."""
    handler = _Handler(base)
    reader = xml.sax.make_parser()
    reader.setFeature(xml.sax.handler.feature_namespaces, True)
    reader.setFeature(xml.sax.handler.feature_external_ges, False)
    reader.setContentHandler(handler)
    try:
        reader.parse(io.BytesIO(text.encode("utf-8")))
    except xml.sax.SAXParseException as e:
        raise SyntaxProblem(str(e)) from e
    return handler.out


def read(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    return read_whole(spark, path, parse, graph)
