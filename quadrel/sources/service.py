"""Remote stores: SPARQL endpoints and triple-pattern fragments over HTTP, fetched by the driver."""

from __future__ import annotations

import urllib.parse
import urllib.request

from pyspark.sql import SparkSession

from quadrel.functions.lanes import as_term
from quadrel.operators.joins import inner
from quadrel.operators.relation import Rel
from quadrel.plans.algebra import Term, Var
from quadrel.sources.base import Active, Source
from quadrel.sources.ntriples import format_term
from quadrel.sources.results import Bindings, parser_for
from quadrel.sources.store import TermStore, term_frame
from quadrel.sources.turtle import parse as parse_turtle

TIMEOUT = 5.0
#: Values of a variable that are put into a pattern one by one.
BOUND = 50
ACCEPT = "application/sparql-results+json, application/sparql-results+xml, text/tab-separated-values"


def fetch(url: str, accept: str, timeout: float = TIMEOUT) -> tuple[str, str]:
    """(content type, text) of a GET."""
    if urllib.parse.urlsplit(url).scheme not in ("http", "https"):
        raise ValueError(f"not an HTTP address: {url}")
    with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": accept}), timeout=timeout) as r:  # noqa: S310
        return r.headers.get("Content-Type", ""), r.read().decode("utf-8")


class Client:
    """Called with (endpoint, query): names and rows of a remote SELECT."""

    def __init__(self, timeout: float = TIMEOUT):
        self.timeout = timeout

    def __call__(self, endpoint: str, text: str) -> tuple[list[str], list[dict[str, Term]]]:
        address = f"{endpoint}{'&' if '?' in endpoint else '?'}query={urllib.parse.quote(text)}"
        kind, body = fetch(address, ACCEPT, self.timeout)
        form = parser_for(kind)
        if form is None:
            raise RuntimeError(f"no parser for {kind}")
        got = form.parse(body)
        if not isinstance(got, Bindings):
            raise RuntimeError("the endpoint did not return bindings")
        return got.names, got.rows


class EndpointStore(Source):
    """A store behind a SPARQL endpoint; a basic graph pattern is shipped whole."""

    def __init__(self, spark: SparkSession, endpoint: str, client: Client | None = None):
        self.spark, self.endpoint, self.client = spark, endpoint, client or Client()

    def bgp(self, triples: tuple, active: Active) -> Rel:
        from quadrel.plans.algebra import Table
        from quadrel.plans.compiler import Compiler

        names: dict[str, str] = {}

        def node(x) -> str:
            if isinstance(x, Var):
                return "?" + names.setdefault(x.name, f"v{len(names)}")
            return format_term(x)

        body = " ".join(f"{node(s)} {node(p)} {node(o)} ." for s, p, o in triples)
        if active.graph is not None:
            body = f"GRAPH {node(active.graph)} {{ {body} }}"
        _, rows = self.client(self.endpoint, f"SELECT * WHERE {{ {body} }}")
        table = Table(tuple(names), tuple(tuple(r.get(c) for c in names.values()) for r in rows))
        rel = Compiler(self).table(table)
        return Rel(rel.df, rel.vals, frozenset(names))

    def scan(self, s, p, o, active: Active) -> Rel:
        return self.bgp(((s, p, o),), active)

    def graphs(self):
        _, rows = self.client(self.endpoint, "SELECT DISTINCT ?g WHERE { GRAPH ?g { ?s ?p ?o } }")
        return self.spark.createDataFrame([(r["g"].value,) for r in rows], "g string")


class FragmentStore(Source):
    """Triple-pattern fragments: the template is filled in per pattern and pages are followed."""

    def __init__(self, spark: SparkSession, template: str, get=fetch):
        """template: an address with {subject}, {predicate} and {object}."""
        self.spark, self.template, self.get = spark, template, get

    def bgp(self, triples: tuple, active: Active) -> Rel:
        """Bind join: the values that earlier patterns gave a variable, if they are at most BOUND, are put into the next
        pattern, one fragment for each; else its whole fragment is fetched. Fragments have no named graphs."""
        if active.graph is not None:
            return TermStore(term_frame(self.spark, [])).bgp(triples, active)
        left = sorted(triples, key=lambda t: sum(isinstance(x, Var) for x in t))
        rel, seen = None, set()
        while left:
            t = left.pop(next((i for i, t in enumerate(left) if seen & {x.name for x in t if isinstance(x, Var)}), 0))
            shared = [x for x in t if isinstance(x, Var) and x.name in seen]
            values = self._values(rel, shared[0].name) if shared else None
            if values is None:
                part = self.scan(*t, active)
            else:
                filled = [tuple(v if x == shared[0] else x for x in t) for v in values]
                part = self._triples([triple for f in filled for triple in self._fetch(*f)]).scan(*t, Active())
            rel = part if rel is None else inner(rel, part)
            seen |= {x.name for x in t if isinstance(x, Var)}
        return rel

    def _values(self, rel: Rel, name: str) -> list[Term] | None:
        v = rel.vals[name]
        rows = rel.df.select(as_term(v).alias("t")).where("t is not null").distinct().limit(BOUND + 1).collect()
        kinds = {1: "bnode", 2: "iri", 3: "literal"}
        found = [Term(kinds[r["t"]["k"]], r["t"]["lex"], r["t"]["dt"], r["t"]["lang"]) for r in rows]
        return None if len(found) > BOUND or any(t.kind == "bnode" for t in found) else found

    def _triples(self, data: list) -> TermStore:
        return TermStore(term_frame(self.spark, [(*t, None) for t in data]))

    def scan(self, s, p, o, active: Active) -> Rel:
        return self._triples([] if active.graph is not None else self._fetch(s, p, o)).scan(s, p, o, Active())

    def _fetch(self, s, p, o) -> list[tuple[Term, Term, Term]]:
        """The triples of a pattern's fragment, page by page."""
        def part(x):
            return urllib.parse.quote(x.value if x.kind == "iri" else format_term(x), safe="") if isinstance(x, Term) else ""

        url: str | None = self.template.format(subject=part(s), predicate=part(p), object=part(o))
        data, seen = [], set()
        while url and url not in seen:
            seen.add(url)
            _, body = self.get(url, "text/turtle, application/n-triples")
            page = parse_turtle(body, url)
            following = [t[2].value for t in page if t[1].value.rsplit("#", 1)[-1] in ("next", "nextPage")]
            controls = ("http://www.w3.org/ns/hydra/", "http://rdfs.org/ns/void#")
            data += [t for t in page if not t[1].value.startswith(controls)]
            url = following[0] if following else None
        return data

    def graphs(self):
        return self.spark.createDataFrame([], "g string")


