"""python -m quadrel [-d data file] [-g graph] COMMAND [TEXT]

query, explain, stack: evaluate; repl: queries from the input, one a line; dataset, graphs: what the data holds;
create, load, dump: stored quads; parse, simplify, tokens: how a query is read; sort: terms in order; test: run a
manifest. -v tells how long a query took."""

from __future__ import annotations

import argparse
import sys
import time
from functools import reduce

from pyspark.sql import SparkSession

from quadrel import conformance
from quadrel.functions.lanes import TERM_TYPE
from quadrel.plans import stack
from quadrel.plans.algebra import Term, show
from quadrel.plans.compiler import Engine
from quadrel.plans.parser import parse, tokens
from quadrel.plans.rewrite import simplify
from quadrel.sources import layout, ntriples, results, turtle
from quadrel.sources.mapping import MappedStore
from quadrel.sources.service import Client, EndpointStore
from quadrel.sources.store import TermStore


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quadrel", description="SPARQL over RDF files, stored quads or mapped tables on Spark.")
    p.add_argument("-d", "--data", action="append", default=[], help="an RDF file or address; its graph is its address unless -g is given")
    p.add_argument("--canonicalise", action="store_true", help="write numbers and booleans in the canonical way")
    p.add_argument("-g", "--graph", help="the graph of the data")
    p.add_argument("--store", help="a folder of stored quads; load and create write one")
    p.add_argument("--tables", help="a folder of tables to map")
    p.add_argument("--endpoint", help="a SPARQL endpoint")
    p.add_argument("--default-graph", action="append")
    p.add_argument("--named-graph", action="append")
    p.add_argument("--language", help="preferred languages, as in en,de;q=0.5")
    p.add_argument("-v", "--verbose", action="store_true", help="say how long a query took, and each operator's rows and time")
    p.add_argument("-f", "--format", default="text/tab-separated-values")
    p.add_argument("command", choices=["query", "explain", "dataset", "graphs", "create", "load", "dump", "repl", "parse", "simplify", "tokens", "sort", "stack", "test"])
    p.add_argument("text", nargs="?", default="", help="a query, a file with one (@file), or for load the folder to write")
    return p


def term_key(t: Term) -> tuple:
    """Blank nodes, IRIs, literals; numbers by value."""
    try:
        number = float(t.value) if t.kind == "literal" and t.datatype and t.datatype.rsplit("#", 1)[-1] in ("integer", "decimal", "float", "double") else float("-inf")
    except ValueError:
        number = float("-inf")
    return turtle.KIND[t.kind], number, t.value, t.datatype or "", t.language or ""


def languages(text: str) -> dict[str, float]:
    out = {}
    for part in text.split(","):
        tag, _, q = part.strip().partition(";q=")
        out[tag] = float(q or 1)
    return out


def quads(spark: SparkSession, o: argparse.Namespace):
    frames = [results.read_rdf(spark, path, o.graph or (path if "://" in path else f"file://{path}"), canonicalise=o.canonicalise) for path in o.data]
    if o.store:
        frames.append(layout.decoded(layout.open_store(spark, o.store)))
    if not frames:
        raise SystemExit("no data: give -d, --store, --tables or --endpoint")
    return reduce(lambda a, b: a.unionByName(b), frames)


def source(spark: SparkSession, o: argparse.Namespace):
    if o.tables:
        return MappedStore(spark, o.tables)
    if o.endpoint:
        return EndpointStore(spark, o.endpoint)
    if o.store and not o.data and not o.language and not o.named_graph:
        return layout.open_store(spark, o.store, o.default_graph)
    store = TermStore(quads(spark, o), o.default_graph, o.named_graph)
    return store.preferring(languages(o.language)) if o.language else store


def run(o: argparse.Namespace, out=None) -> None:
    out = out or sys.stdout
    text = open(o.text[1:], encoding="utf-8").read() if o.text.startswith("@") else o.text
    if o.command == "parse":
        out.write(show(parse(text)))
        return
    if o.command == "simplify":
        out.write(show(simplify(parse(text).plan)))
        return
    if o.command == "tokens":
        out.write("".join(f"{kind}\t{value}\n" for kind, value, _ in tokens(text)))
        return
    if o.command == "sort":
        terms = [ntriples.parse_nodes(line, 1)[0][0] for line in text.splitlines() if line.strip()]
        out.write("".join(ntriples.format_term(t, False) + "\n" for t in sorted(terms, key=term_key)))
        return
    spark = SparkSession.builder.appName("quadrel").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if o.command == "test":
        outcomes = conformance.run(spark, text)
        out.write("".join(f"{'ok' if x.passed else 'FAILED'}\t{x.name}\t{x.why}\n" for x in outcomes))
        return
    if o.command == "load":
        layout.save(quads(spark, o), text)
        return
    if o.command == "create":
        layout.save(spark.createDataFrame([], ", ".join(f"{c} {TERM_TYPE}" for c in "spog")), text)
        return
    if o.command == "dump":
        for row in ntriples.lines_of(quads(spark, o)).toLocalIterator():
            out.write(row["value"] + "\n")
        return
    src = source(spark, o)
    engine = Engine(src, Client())
    if o.command in ("graphs", "dataset"):
        if o.command == "dataset":
            out.write("".join(f"default\t{g}\n" for g in getattr(src, "default_graphs", [])))
        for row in src.graphs().orderBy("g").toLocalIterator():
            out.write(("named\t" if o.command == "dataset" else "") + row["g"] + "\n")
        return
    if o.command == "explain":
        out.write(engine.explain(text))
        return
    if o.command == "repl":
        for line in sys.stdin:
            if line.strip() in ("quit", "exit"):
                break
            if line.strip():
                try:
                    answer(o, src, engine, line, out)
                except Exception as e:  # the next line may be better
                    out.write(f"error: {e}\n")
        return
    answer(o, src, engine, text, out)


def answer(o: argparse.Namespace, src, engine: Engine, text: str, out) -> None:
    """Evaluates one query and writes its result."""
    began = time.time()
    if o.command == "stack":
        from quadrel.plans.compiler import Compiler

        frame = Compiler(src).solutions(stack.parse(text)).terms()
        result = None
    else:
        q = parse(text)
        frame = engine.terms(text) if q.form == "select" else engine.query(text)
        if q.form == "ask":
            result = bool(frame.first()["result"])
        elif q.form == "select":
            result = None
        else:
            result = results.Triples(turtle.rows_of(frame))
    if result is None and o.format == "text/tab-separated-values":
        # any number of rows, a partition at a time
        out.write("\t".join("?" + n for n in frame.columns) + "\n")
        for row in results.frame_tsv(frame).toLocalIterator():
            out.write(row["value"] + "\n")
    else:
        result = results.of_frame(frame) if result is None else result
        out.write(results.negotiate(result, [o.format, "*/*"]).write(result))
    if o.verbose:
        sys.stderr.write("".join(f"{name}\t{metrics}\n" for name, metrics in operator_metrics(frame)) + f"{time.time() - began:.3f} s\n")


def operator_metrics(frame) -> list[tuple[str, str]]:
    """(operator, its metrics) of a frame's plan after it ran: rows, times and sizes as Spark measured them."""
    frame.write.format("noop").mode("overwrite").save()
    plan = frame._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("Adaptive"):
        frame._jdf.queryExecution().executedPlan().execute().count()
        plan = plan.finalPhysicalPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        each = node.metrics().toSeq()
        shown = [f"{m._1()}={m._2().value()}" for m in (each.apply(i) for i in range(each.size())) if m._2().value() > 0]
        found.append((node.nodeName(), " ".join(shown)))
        inner = [node.plan()] if hasattr(node, "plan") and node.nodeName().endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
        todo += inner
    return found


if __name__ == "__main__":
    run(arguments().parse_args())
