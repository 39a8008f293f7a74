"""Queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.llm.leaks import leaks
from quadrel.llm.sentences import sentences
from quadrel.llm.spellings import collapsed, duplicate_ids
from quadrel.llm.term_frequency import marked_terms, term_frequencies
from quadrel.llm.tokenizer import decode_ids, encode_texts
from quadrel.runtime import table

FIELDS = ["predicate", "object"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return marked_terms(table(spark, d, "quads"), FIELDS, "subject").select("field", F.col("term").alias("term_id"), "mark")


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return term_frequencies(table(spark, d, "quads"), FIELDS, "subject").withColumnRenamed("term", "term_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_ids(table(spark, d, "terms"))


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(table(spark, d, "terms"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return decode_ids(p7_ids(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_reworded(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), reworded=True)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_frequencies, p4_found, p4_collapsed, p7_ids, p7_decoded, p8_found, p8_reworded, p9_found)}


_FREQUENCIES = """WITH cells AS (SELECT 'predicate' AS field, predicate AS term_id, subject FROM quads WHERE predicate IS NOT NULL
    UNION ALL SELECT 'object', object, subject FROM quads WHERE object IS NOT NULL),
f AS (SELECT field, term_id, count(*) AS occurrences, count(DISTINCT subject) AS records FROM cells GROUP BY field, term_id)
"""

_WINDOWS = """WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[k:k + 9], ' ') AS g FROM d, unnest(range(1, len(w) - 8)) t(k)),
iw AS (SELECT item_id, array_to_string(w[k:k + 9], ' ') AS g FROM i, unnest(range(1, len(w) - 8)) t(k))
"""


_IRI = "regexp_replace(regexp_replace(lower({0}), '[\\s\\x{{85}}\\p{{Z}}]+', '', 'g'), '^<(.*)>$', '\\1')"
#: The rule of problem 4 one character at a time: a character stays, or it separates words.
_TERMS = (
    """WITH used AS (SELECT id, min("""
    + _IRI.format("value")
    + """) AS iri FROM terms WHERE id IN (SELECT datatype FROM terms) AND value IS NOT NULL GROUP BY id),
x AS (SELECT t.id, t.type <> 2 AS literal, t.value, CASE WHEN t.type <> 2 THEN t.datatype END AS datatype, CASE WHEN t.type <> 2 THEN t.language END AS language, used.iri
  FROM terms t LEFT JOIN used ON used.id = t.datatype WHERE t.id IS NOT NULL AND t.value IS NOT NULL AND t.type IN (2, 16, 17, 22)),
k AS (SELECT *, CASE WHEN NOT literal THEN '' WHEN datatype IS NULL THEN 'xsd:string' ELSE coalesce(iri, '#' || datatype) END AS dt,
  coalesce('=' || replace(lower(regexp_replace(language, '^[\\s\\x{85}\\p{Z}]+|[\\s\\x{85}\\p{Z}]+$', '', 'g')), '_', '-'), '') AS lang,
  CASE WHEN NOT literal THEN """
    + _IRI.format("value")
    + """ WHEN NOT regexp_matches(value, '[\\p{L}\\p{N}]') THEN chr(1) || regexp_replace(value, '^[\\s\\x{85}\\p{Z}]+|[\\s\\x{85}\\p{Z}]+$', '', 'g')
  ELSE array_to_string(list_sort(list_filter(list_transform(string_split_regex(lower(value), '[;|]'), lambda f: trim(regexp_replace(array_to_string(list_transform(range(1, length(f) + 1), lambda i:
    CASE WHEN regexp_matches(f[i], '[\\p{L}\\p{N}]') OR NOT regexp_matches(f[i], '[\\s\\x{85}\\p{Z}]') AND regexp_matches(f[i - 1:i - 1], '\\p{N}') AND i > 1 AND regexp_matches(f[i + 1:i + 1], '\\p{N}')
      OR f[i] IN ('+', '-') AND regexp_matches(f[i + 1:i + 1], '\\p{N}') AND NOT (i > 1 AND regexp_matches(f[i - 1:i - 1], '[\\p{L}\\p{N}]')) THEN f[i] ELSE ' ' END), ''), ' +', ' ', 'g'))), lambda w: w <> '')), '|') END AS key FROM x),
g AS (SELECT id, value, literal, datatype, language, min(id) OVER (PARTITION BY literal, dt, lang, key) AS kept FROM k)
"""
)


#: Typed templates: words with their kind, windows of ten, runs along one diagonal, slots over the run.
_TEMPLATES = """WITH src AS (SELECT 'd' AS side, row_number() OVER () AS row, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM eval_items WHERE text IS NOT NULL),
n AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM src) x GROUP BY w),
u AS (SELECT w, count(*) AS u FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{N}\\s?(\\p{L}+)', 1)) AS w FROM src) x GROUP BY w),
kinds AS (SELECT n.w, coalesce(u, 0) >= 0.5 * n AS unit FROM n LEFT JOIN u USING (w) WHERE n >= 5 AND n >= 1e-5 * (SELECT sum(n) FROM n)),
tok AS (SELECT side, row, id, unnest(w) AS w, unnest(range(0, len(w))) AS pos FROM (SELECT side, row, id, list_transform(regexp_extract_all(regexp_replace(text, '(\\p{N})[.,](\\p{N})', '\\1\\2', 'g'), '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w FROM src) x WHERE len(w) >= 10),
typed AS (SELECT side, row, id, pos, tok.w, regexp_matches(tok.w, '\\p{N}') AS digits,
  CASE WHEN regexp_full_match(tok.w, '\\p{N}+') THEN '#n' WHEN regexp_matches(tok.w, '\\p{N}') THEN regexp_replace(tok.w, '\\p{N}+', '0', 'g') WHEN kinds.w IS NULL THEN '#a' WHEN unit THEN '#u' ELSE tok.w END AS t FROM tok LEFT JOIN kinds ON kinds.w = tok.w),
lists AS (SELECT side, row, id, list(w ORDER BY pos) AS w, list(t ORDER BY pos) AS t, list(digits OR t[1:1] = '#' ORDER BY pos) AS slot FROM typed GROUP BY side, row, id),
win AS (SELECT side, row, id, k, array_to_string(t[k:k + 9], ' ') AS t, w[k:k + 9] AS w, slot[k:k + 9] AS slot, len(list_filter(slot[k:k + 9], lambda x: NOT x)) AS fixed FROM lists, unnest(range(1, len(w) - 8)) r(k)),
theirs AS (SELECT * FROM (SELECT *, max(fixed) OVER (PARTITION BY row) AS best, count(*) OVER (PARTITION BY row) AS every FROM win WHERE side = 'i') x WHERE fixed >= 5 OR best < 5),
met AS (SELECT d.row, d.id AS doc_id, i.id AS item_id, i.row AS item_row, d.k, d.k - i.k AS shift, CASE WHEN best < 5 THEN every ELSE 1 END AS least,
  list_filter(list_transform(range(1, 11), lambda p: CASE WHEN i.slot[p] THEN i.w[p] || ' ' || d.w[p] END), lambda x: x IS NOT NULL) AS pairs FROM win d JOIN theirs i ON d.t = i.t WHERE d.side = 'd'),
runs AS (SELECT *, k - row_number() OVER (PARTITION BY row, item_id, item_row, shift ORDER BY k) AS run FROM met),
whole AS (SELECT row, doc_id, item_id, count(*) AS n, max(least) AS least, list_distinct(flatten(list(pairs))) AS pairs FROM runs GROUP BY row, doc_id, item_id, item_row, shift, run),
same AS (SELECT * FROM whole WHERE n >= least AND len(list_filter(pairs, lambda p: split_part(p, ' ', 1) <> split_part(p, ' ', 2))) > 0
  AND len(list_distinct(list_transform(pairs, lambda p: split_part(p, ' ', 1)))) = len(pairs) AND len(list_distinct(list_transform(pairs, lambda p: split_part(p, ' ', 2)))) = len(pairs))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p8_reworded": "SELECT doc_id, item_id, 'exact' AS kind, CAST(10 AS INTEGER) AS words FROM (" + _WINDOWS + "SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)) e UNION ALL SELECT doc_id, item_id, 'reworded', CAST(max(n) + 9 AS INTEGER) FROM ("
        + _TEMPLATES + "SELECT row, doc_id, item_id, n FROM same) r GROUP BY row, doc_id, item_id",
        "p4_found": _TERMS + "SELECT kept AS kept_id, id AS dup_id FROM g WHERE id <> kept",
        "p4_collapsed": _TERMS + """SELECT kept AS kept_id, count(*) AS copies, count(DISTINCT {'a': literal, 'b': value, 'c': datatype, 'd': language}) AS spellings FROM g GROUP BY kept
            UNION ALL SELECT id, 1, 1 FROM terms WHERE id IS NOT NULL AND NOT coalesce(value IS NOT NULL AND type IN (2, 16, 17, 22), false)""",
        "p1_found": _FREQUENCIES + """SELECT field, term_id, 'rare' AS mark FROM f WHERE records <= 2
            UNION ALL SELECT field, term_id, 'common' FROM f WHERE records > 0.10 * (SELECT count(DISTINCT subject) FROM quads)""",
        "p1_frequencies": _FREQUENCIES + "SELECT field, term_id, occurrences, records FROM f",
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p8_found": _WINDOWS + "SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)",
    }
