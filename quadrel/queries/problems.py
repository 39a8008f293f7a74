"""Queries of the general data-processing operators over the quad store, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.operators.hierarchy import descendants, hierarchy, links_of
from quadrel.operators.key_totals import distinct_profile, heavy_values
from quadrel.operators.orphans import orphan_references, orphan_report
from quadrel.operators.wide import cell_faults, wide_table
from quadrel.runtime import table

#: terms.id of skos:broader and skos:narrower (fixed rows of terms)
BROADER, NARROWER = 28, 29


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    heavy = heavy_values(table(spark, d, "quads"), ["predicate", "graph"], 0.05)
    return heavy.select("field", F.col("value").alias("term_id"))


def p2_graph_description(spark: SparkSession, d: str) -> DataFrame:
    return distinct_profile(table(spark, d, "quads"), ["graph", "predicate"], {"subject": "subjects", "object": "objects"}).withColumnRenamed("n", "quads")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return links_of(table(spark, d, "quads"), BROADER, NARROWER)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(_links(spark, d))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy(_links(spark, d), paths=True)
    return tree.select("node", "root", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), (F.col("size") - 1).alias("descendants"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(hierarchy(_links(spark, d), paths=True))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(table(spark, d, "quads"), table(spark, d, "terms")).select("quad_id", "position")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    report = orphan_report(orphan_references(table(spark, d, "quads"), table(spark, d, "terms")), "quads")
    return report.withColumn("month", F.date_format("month", "yyyy-MM"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return cell_faults(table(spark, d, "quads"), table(spark, d, "attributes"), table(spark, d, "terms"))


def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide_table(table(spark, d, "quads"), table(spark, d, "attributes"), table(spark, d, "terms"))


def p6_wide_text(spark: SparkSession, d: str) -> DataFrame:
    """The wide table with arrays joined, decimals, dates and instants as text: the form that its SQL can give."""
    wide = p6_wide(spark, d)
    shown = []
    for f in wide.schema:
        c = F.col(f"`{f.name}`")
        match f.dataType.typeName():
            case "array":
                c = F.array_join(c, "|")
            case "timestamp":
                c = F.unix_micros(c).cast("string")
            case "decimal" | "date" | "boolean":
                c = c.cast("string")
        shown.append(c.alias(f.name))
    return wide.select(*shown)


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_graph_description, p3_found, p3_paths, p3_descendants, p5_found, p5_report, p6_found, p6_wide, p6_wide_text)}


_REACH = f"""WITH RECURSIVE l AS (SELECT child, min(parent) AS parent FROM (
    SELECT subject AS child, object AS parent FROM quads WHERE predicate = {BROADER}
    UNION ALL SELECT object, subject FROM quads WHERE predicate = {NARROWER}) x
  WHERE child IS NOT NULL AND parent IS NOT NULL GROUP BY child),
r AS (SELECT child AS node, parent AS anc FROM l UNION SELECT r.node, l.parent FROM r JOIN l ON l.child = r.anc),
loops AS (SELECT node FROM r WHERE node = anc),
nodes AS (SELECT child AS node FROM l UNION SELECT parent FROM l),
cyc AS (SELECT r.node, min(anc) AS root FROM r JOIN loops ON loops.node = r.anc GROUP BY r.node),
tree AS (SELECT n.node, coalesce(c.root, t.root, n.node) AS root,
    CASE WHEN c.root IS NOT NULL THEN -1 ELSE coalesce(t.depth, 0) END AS depth
  FROM nodes n LEFT JOIN cyc c ON c.node = n.node
  LEFT JOIN (SELECT r.node, count(*) AS depth, max(CASE WHEN l.child IS NULL THEN r.anc END) AS root FROM r LEFT JOIN l ON l.child = r.anc GROUP BY r.node) t ON t.node = n.node)
"""

_PAIRS = f"""WITH RECURSIVE l AS (SELECT child, min(parent) AS parent FROM (
    SELECT subject AS child, object AS parent FROM quads WHERE predicate = {BROADER}
    UNION ALL SELECT object, subject FROM quads WHERE predicate = {NARROWER}) x
  WHERE child IS NOT NULL AND parent IS NOT NULL GROUP BY child),
r AS (SELECT child AS node, parent AS anc, CAST(1 AS BIGINT) AS distance, [child, parent] AS seen FROM l
  UNION ALL SELECT r.node, l.parent, r.distance + 1, list_append(r.seen, l.parent) FROM r JOIN l ON l.child = r.anc WHERE NOT list_contains(r.seen, l.parent))
"""

_REFS = """WITH refs AS (SELECT id AS quad_id, 'subject' AS position, subject AS k, loaded_at FROM quads
    UNION ALL SELECT id, 'object', object, loaded_at FROM quads),
lost AS (SELECT quad_id, position, k, loaded_at FROM refs WHERE k IS NOT NULL AND k < 1729382256910270464 AND NOT EXISTS (
  SELECT 1 FROM terms t WHERE t.id = refs.k AND t.added_at <= refs.loaded_at AND (t.deleted_at IS NULL OR t.deleted_at > refs.loaded_at)))
"""

_CELLS = """WITH v AS (SELECT q.subject, a.column_name, a.value_type AS k, a.multi_valued AS many,
    CASE WHEN q.object >= 1729382256910270464 THEN CAST(q.object - 1729382256910270464 AS VARCHAR) ELSE t.value END AS txt,
    CASE WHEN q.object >= 1729382256910270464 THEN 17 ELSE t.type END AS kind
  FROM quads q JOIN attributes a ON a.predicate = q.predicate LEFT JOIN terms t ON t.id = q.object),
w AS (SELECT *, trim(txt, chr(32) || chr(9) || chr(10) || chr(13)) AS s FROM v WHERE txt IS NOT NULL AND subject IS NOT NULL),
typed AS (SELECT subject, column_name, k, many, txt,
  CASE k WHEN 'string' THEN txt
    WHEN 'iri' THEN CASE WHEN kind IN (1, 2) THEN txt END
    WHEN 'boolean' THEN CASE WHEN lower(s) IN ('true', '1') THEN 't' WHEN lower(s) IN ('false', '0') THEN 'f' END
    WHEN 'int' THEN CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN CAST(CAST(s AS HUGEINT) AS VARCHAR) END
    WHEN 'decimal' THEN CASE WHEN regexp_full_match(s, '[+-]?[0-9]+(\\.[0-9]+)?') THEN CAST(CAST(s AS DECIMAL(38, 18)) AS VARCHAR) END
    WHEN 'double' THEN CASE WHEN regexp_full_match(s, '[+-]?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?') THEN CAST(CAST(s AS DOUBLE) + 0.0 AS VARCHAR) END
    WHEN 'date' THEN CASE WHEN regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN CAST(TRY_CAST(s AS DATE) AS VARCHAR) END
    WHEN 'timestamp' THEN CASE WHEN regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})?') THEN CAST(epoch_us(TRY_CAST(s AS TIMESTAMP)) AS VARCHAR) END
  END AS val FROM w),
cells AS (SELECT subject, column_name, bool_or(val IS NULL) AS bad, NOT bool_or(many) AND count(DISTINCT val) > 1 AS clash FROM typed GROUP BY subject, column_name)
"""


#: The attributes' columns and how their text is typed in SQL (fixed rows of the table attributes).
_WIDE = {
    "label": None, "name": "VARCHAR", "amount": "VARCHAR", "title": "VARCHAR", "lat": "DOUBLE", "lon": "DOUBLE", "population": "BIGINT", "born": "VARCHAR", "modified": "VARCHAR", "active": "VARCHAR",
    "homepage": "VARCHAR", "knows": None, "keyword": None, "height": "VARCHAR", "ranking": "BIGINT", "owner_iri": "VARCHAR", "address": "VARCHAR",
}


def _wide_sql() -> str:
    cols = []
    for name, kind in _WIDE.items():
        here = f"column_name = '{name}'"
        if kind is None:
            cols.append(f"string_agg(DISTINCT val, '|' ORDER BY val) FILTER (WHERE {here}) AS {name}")
            continue
        one = f"CASE WHEN count(DISTINCT val) FILTER (WHERE {here}) = 1 THEN min(val) FILTER (WHERE {here}) END"
        if name == "active":
            one = f"CASE {one} WHEN 't' THEN 'true' WHEN 'f' THEN 'false' END"
        cols.append(f"TRY_CAST({one} AS {kind}) AS {name}")
    return _CELLS + f", p AS (SELECT subject, {', '.join(cols)} FROM typed GROUP BY subject) SELECT s.subject, {', '.join(_WIDE)} FROM (SELECT DISTINCT subject FROM v WHERE subject IS NOT NULL) s LEFT JOIN p ON p.subject = s.subject"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """SELECT 'predicate' AS field, predicate AS term_id FROM quads WHERE predicate IS NOT NULL GROUP BY predicate HAVING count(*) >= 0.05 * (SELECT count(*) FROM quads)
            UNION ALL SELECT 'graph', graph FROM quads WHERE graph IS NOT NULL GROUP BY graph HAVING count(*) >= 0.05 * (SELECT count(*) FROM quads)""",
        "p2_graph_description": "SELECT graph, predicate, count(*) AS quads, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects FROM quads GROUP BY graph, predicate",
        "p3_found": _REACH + "SELECT node, root, CAST(depth AS BIGINT) AS depth FROM tree",
        "p3_paths": _PAIRS + """, loops AS (SELECT anc AS node, min(node) AS root FROM (SELECT x.node, x.anc FROM r x JOIN r y ON y.node = x.anc AND y.anc = x.node UNION ALL SELECT child, child FROM l WHERE child = parent) z GROUP BY anc),
            ring AS (SELECT node, min(root) AS root FROM (SELECT node, least(node, root) AS root FROM loops) z GROUP BY node),
            nodes AS (SELECT child AS node FROM l UNION SELECT parent FROM l),
            low AS (SELECT n.node, min(g.root) AS root FROM nodes n LEFT JOIN r ON r.node = n.node JOIN ring g ON g.node = n.node OR g.node = r.anc GROUP BY n.node),
            up AS (SELECT node, max_by(seen, distance) AS seen FROM r GROUP BY node),
            below AS (SELECT anc AS node, count(*) FILTER (WHERE node <> anc) AS descendants FROM r GROUP BY anc)
            SELECT n.node, coalesce(low.root, list_last(up.seen), n.node) AS root, CASE WHEN low.root IS NOT NULL THEN -1 ELSE coalesce(len(up.seen) - 1, 0) END AS depth,
              CASE WHEN low.root IS NULL THEN coalesce(array_to_string(list_reverse(up.seen), '/'), CAST(n.node AS VARCHAR)) END AS path, coalesce(b.descendants, 0) AS descendants
            FROM nodes n LEFT JOIN low ON low.node = n.node LEFT JOIN up ON up.node = n.node LEFT JOIN below b ON b.node = n.node""",
        "p3_descendants": _PAIRS + "SELECT anc AS ancestor, node, distance FROM r WHERE anc <> node",
        "p5_found": _REFS + "SELECT quad_id, position FROM lost",
        "p5_report": _REFS + "SELECT 'quads' AS table_name, position, strftime(loaded_at, '%Y-%m') AS month, count(*) AS orphans, count(DISTINCT k) AS keys FROM lost GROUP BY ALL",
        "p6_wide_text": _wide_sql(),
        "p6_found": _CELLS + "SELECT subject, column_name, 'untyped' AS fault FROM cells WHERE bad UNION ALL SELECT subject, column_name, 'conflict' FROM cells WHERE clash",
    }
