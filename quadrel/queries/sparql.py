"""Query-engine operators over the mapped tables and the quad store, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.plans.algebra import Var, iri
from quadrel.plans.compiler import Engine
from quadrel.runtime import table
from quadrel.sources.mapping import MappedStore
from quadrel.sources.store import DictionaryStore

PREFIX = "PREFIX t: <http://tables.example/> PREFIX g: <http://tables.example/graph/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"
CUST = "'http://tables.example/customer/' || c_custkey"

#: name -> (SPARQL over the mapped tables, SQL)
MAPPED: dict[str, tuple[str, str]] = {
    "segment_revenue": (
        "SELECT ?seg (ROUND(SUM(?price) * 100) / 100 AS ?rev) (COUNT(*) AS ?n) { ?o t:o_custkey ?c ; t:o_totalprice ?price . ?c t:c_mktsegment ?seg } GROUP BY ?seg",
        "SELECT c_mktsegment AS seg, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS rev, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    ),
    "bgp_scan": ("SELECT ?c ?name { ?c t:c_name ?name }", f"SELECT {CUST} AS c, c_name AS name FROM customer"),
    "bgp_star": (
        "SELECT ?o ?st ?price ?pri { ?o t:o_orderstatus ?st ; t:o_totalprice ?price ; t:o_orderpriority ?pri ; a t:orders }",
        "SELECT 'http://tables.example/orders/' || o_orderkey AS o, o_orderstatus AS st, o_totalprice AS price, o_orderpriority AS pri FROM orders",
    ),
    "bgp_chain": (
        "SELECT ?region (SUM(?q) AS ?qty) (COUNT(*) AS ?n) { ?l t:l_orderkey ?o ; t:l_quantity ?q . ?o t:o_custkey ?c . ?c t:c_nationkey ?n0 . ?n0 t:n_regionkey ?r . ?r t:r_name ?region } GROUP BY ?region",
        "SELECT r_name AS region, sum(l_quantity) AS qty, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "repeated_var": (
        "SELECT ?n (COUNT(*) AS ?k) { ?c t:c_nationkey ?n . ?s t:s_nationkey ?n } GROUP BY ?n",
        "SELECT 'http://tables.example/nation/' || c_nationkey AS n, count(*) AS k FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1",
    ),
    "bound_subject": ("SELECT ?p ?v { <http://tables.example/nation/3> ?p ?v FILTER(isLiteral(?v)) }", "SELECT 'http://tables.example/' || p AS p, v FROM (SELECT 'n_nationkey' AS p, CAST(n_nationkey AS VARCHAR) AS v FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'n_name', n_name FROM nation WHERE n_nationkey = 3) x"),
    "var_predicate": (
        "SELECT ?p (COUNT(*) AS ?n) { GRAPH g:customer { ?s ?p ?o } } GROUP BY ?p",
        "SELECT p, n FROM (SELECT count(*) AS n FROM customer) x, (VALUES ('http://www.w3.org/1999/02/22-rdf-syntax-ns#type'), ('http://tables.example/c_custkey'), ('http://tables.example/c_name'), ('http://tables.example/c_nationkey'), ('http://tables.example/c_acctbal'), ('http://tables.example/c_mktsegment')) v(p)",
    ),
    "filter_num": ("SELECT ?o ?p { ?o t:o_totalprice ?p FILTER(?p > 400000 && ?p <= 450000.5) }", "SELECT 'http://tables.example/orders/' || o_orderkey AS o, o_totalprice AS p FROM orders WHERE o_totalprice > 400000 AND o_totalprice <= 450000.5"),
    "filter_str": ("SELECT ?c ?s { ?c t:c_mktsegment ?s FILTER(?s < 'F' || ?s = 'MACHINERY') }", f"SELECT {CUST} AS c, c_mktsegment AS s FROM customer WHERE c_mktsegment < 'F' OR c_mktsegment = 'MACHINERY'"),
    "filter_date": ("SELECT ?o { ?o t:o_orderdate ?d FILTER(?d >= '1998-03-01T00:00:00'^^xsd:dateTime && ?d < '1998-04-01T00:00:00Z'^^xsd:dateTime) }", "SELECT 'http://tables.example/orders/' || o_orderkey AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01' AND o_orderdate < TIMESTAMP '1998-04-01'"),
    "filter_in": ("SELECT ?c { ?c t:c_mktsegment ?s FILTER(?s IN ('BUILDING', 'HOUSEHOLD')) FILTER(?s NOT IN ('HOUSEHOLD', 'X')) }", f"SELECT {CUST} AS c FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_bool3vl": (
        "SELECT ?c { ?c t:c_acctbal ?b ; t:c_name ?n FILTER((?b / 0 > 1 || ?b > 9000) && !(?n + 1 = 2 && ?b < 0)) }",
        f"SELECT {CUST} AS c FROM customer WHERE c_acctbal > 9000",
    ),
    "filter_regex": ("SELECT ?p ?n { ?p t:p_name ?n FILTER(REGEX(?n, '^LARGE .*(ring|bolt)$', 'i')) }", "SELECT 'http://tables.example/part/' || p_partkey AS p, p_name AS n FROM part WHERE regexp_matches(p_name, '(?i)^LARGE .*(ring|bolt)$')"),
    "str_fns": (
        "SELECT ?n (STRLEN(?n) AS ?len) (UCASE(?n) AS ?up) (LCASE(?b) AS ?low) (CONCAT(?n, '-', ?b) AS ?both) (CONTAINS(?n, 'ring') AS ?has) (STRSTARTS(?n, 'red') AS ?st) (STRENDS(?n, 'bolt') AS ?en) { ?p t:p_name ?n ; t:p_brand ?b }",
        "SELECT p_name AS n, length(p_name) AS len, upper(p_name) AS up, lower(p_brand) AS low, p_name || '-' || p_brand AS \"both\", contains(p_name, 'ring') AS has, starts_with(p_name, 'red') AS st, ends_with(p_name, 'bolt') AS en FROM part",
    ),
    "str_before_after": (
        "SELECT ?n (STRBEFORE(?n, ' ') AS ?a) (STRAFTER(?n, ' ') AS ?b) (STRAFTER(?n, 'zzz') AS ?c) { ?p t:p_name ?n }",
        "SELECT p_name AS n, split_part(p_name, ' ', 1) AS a, substr(p_name, strpos(p_name, ' ') + 1) AS b, '' AS c FROM part",
    ),
    "substr_replace": (
        "SELECT ?n (SUBSTR(?n, 3) AS ?a) (SUBSTR(?n, 2, 3) AS ?b) (SUBSTR(?n, 0, 3) AS ?c) (REPLACE(?n, '([aeiou])', '<$1>') AS ?d) { ?p t:p_name ?n }",
        "SELECT p_name AS n, substr(p_name, 3) AS a, substr(p_name, 2, 3) AS b, substr(p_name, 1, 2) AS c, regexp_replace(p_name, '([aeiou])', '<\\1>', 'g') AS d FROM part",
    ),
    "encode_uri": ("SELECT ?n (ENCODE_FOR_URI(CONCAT(?n, '/é&~?')) AS ?e) { ?p t:p_name ?n }", "SELECT p_name AS n, replace(p_name, ' ', '%20') || '%2F%C3%A9%26~%3F' AS e FROM part"),
    "str_of_iri": ("SELECT (STR(?c) AS ?s) (IRI(CONCAT(STR(?c), '#x')) AS ?i) { ?c t:c_name ?n }", f"SELECT {CUST} AS s, {CUST} || '#x' AS i FROM customer"),
    "lang_datatype": (
        "SELECT ?n (LANG(?n) AS ?l) (DATATYPE(?b) AS ?d) (STRLANG(?n, 'EN') AS ?t) (LANG(STRLANG(?n, 'EN-us')) AS ?tl) (LANGMATCHES('en-us', 'EN') AS ?m) (STRDT(?n, xsd:token) AS ?x) { ?c t:c_name ?n ; t:c_acctbal ?b }",
        "SELECT c_name AS n, '' AS l, 'http://www.w3.org/2001/XMLSchema#double' AS d, c_name AS t, 'en-us' AS tl, true AS m, c_name AS x FROM customer",
    ),
    "term_tests": (
        "SELECT ?c (isIRI(?c) AS ?a) (isLiteral(?n) AS ?b) (isBlank(?n) AS ?d) (isNumeric(?b0) AS ?e) (sameTerm(?n, ?n) AS ?f) (BOUND(?zz) AS ?g) { ?c t:c_name ?n ; t:c_acctbal ?b0 }",
        f"SELECT {CUST} AS c, true AS a, true AS b, false AS d, true AS e, true AS f, false AS g FROM customer",
    ),
    "math_fns": (
        "SELECT ?c (ABS(?b) AS ?a) (CEIL(?b) AS ?u) (FLOOR(?b) AS ?d) (ROUND(?b) AS ?r) (-?b AS ?m) { ?c t:c_acctbal ?b }",
        f"SELECT {CUST} AS c, abs(c_acctbal) AS a, ceil(c_acctbal) AS u, floor(c_acctbal) AS d, floor(c_acctbal + 0.5) AS r, -c_acctbal AS m FROM customer",
    ),
    "arith_promote": (
        "SELECT ?p (?k + 1 AS ?a) (?k * ?s AS ?b) (xsd:double(?k / 4) AS ?c) (?r * 2 - ?k AS ?d) (xsd:double(?k / 0) AS ?e) { ?p t:p_partkey ?k ; t:p_size ?s ; t:p_retailprice ?r }",
        "SELECT 'http://tables.example/part/' || p_partkey AS p, p_partkey + 1 AS a, p_partkey * p_size AS b, p_partkey / 4.0::DOUBLE AS c, p_retailprice * 2 - p_partkey AS d, CAST(NULL AS DOUBLE) AS e FROM part",
    ),
    "casts": (
        "SELECT ?p (xsd:integer(?r) AS ?a) (xsd:string(?k) AS ?b) (xsd:double(?k) AS ?c) (xsd:boolean(?s) AS ?d) (xsd:integer('x') AS ?e) (xsd:integer('12') AS ?f) (STR(xsd:date(?t)) AS ?g) { ?p t:p_retailprice ?r ; t:p_partkey ?k ; t:p_size ?s BIND('2020-02-03T04:05:06Z'^^xsd:dateTime AS ?t) }",
        "SELECT 'http://tables.example/part/' || p_partkey AS p, CAST(trunc(p_retailprice) AS BIGINT) AS a, CAST(p_partkey AS VARCHAR) AS b, CAST(p_partkey AS DOUBLE) AS c, p_size <> 0 AS d, CAST(NULL AS BIGINT) AS e, CAST(12 AS BIGINT) AS f, '2020-02-03' AS g FROM part",
    ),
    "date_fns": (
        "SELECT ?e (YEAR(?t) AS ?y) (MONTH(?t) AS ?m) (DAY(?t) AS ?d) (HOURS(?t) AS ?h) (MINUTES(?t) AS ?mi) (xsd:double(SECONDS(?t)) AS ?s) (TZ(?t) AS ?z) (HOURS('2011-01-10T14:45:13.8-05:00'^^xsd:dateTime) AS ?lh) (TZ('2011-01-10T14:45:13.8-05:00'^^xsd:dateTime) AS ?lz) { ?e t:ts ?t }",
        "SELECT 'http://tables.example/events/' || event_id AS e, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, (epoch_us(ts) % 60000000) / 1000000.0::DOUBLE AS s, '' AS z, CAST(14 AS BIGINT) AS lh, '-05:00' AS lz FROM events",
    ),
    "hashes": ("SELECT ?n (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) { ?x t:c_name ?n }", "SELECT c_name AS n, md5(c_name) AS a, sha1(c_name) AS b, sha256(c_name) AS c FROM customer"),
    "hashes_long": ("SELECT ?n (SHA384(?n) AS ?a) (SHA512(?n) AS ?b) { ?x t:c_name ?n }", ""),
    "if_coalesce_bound": (
        "SELECT ?c (IF(BOUND(?p), 'big', 'small') AS ?k) (COALESCE(?p, -1.0e0) AS ?v) (IF(1/0, 1, 2) AS ?e) { ?c t:c_name ?n OPTIONAL { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > 490000) } }",
        f"SELECT {CUST} AS c, CASE WHEN o_orderkey IS NULL THEN 'small' ELSE 'big' END AS k, coalesce(o_totalprice, -1.0) AS v, CAST(NULL AS BIGINT) AS e FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 490000",
    ),
    "optional": ("SELECT ?n ?s { ?n t:n_name ?x OPTIONAL { ?s t:s_nationkey ?n ; t:s_acctbal ?b FILTER(?b > 9000) } }", "SELECT 'http://tables.example/nation/' || n_nationkey AS n, 'http://tables.example/supplier/' || s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000"),
    "optional_filter": (
        "SELECT ?c ?o { ?c t:c_acctbal ?b OPTIONAL { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > ?b * 60) } }",
        f"SELECT {CUST} AS c, 'http://tables.example/orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 60",
    ),
    "optional_nested": (
        "SELECT ?r ?n ?s { ?r t:r_name ?x OPTIONAL { ?n t:n_regionkey ?r OPTIONAL { ?s t:s_nationkey ?n ; t:s_acctbal ?b FILTER(?b > 9500) } } }",
        "SELECT 'http://tables.example/region/' || r_regionkey AS r, 'http://tables.example/nation/' || n_nationkey AS n, 'http://tables.example/supplier/' || s_suppkey AS s FROM region LEFT JOIN (nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9500) ON n_regionkey = r_regionkey",
    ),
    "compat_join_unbound": (
        "SELECT ?n (COUNT(*) AS ?k) { { SELECT ?n ?s { ?n t:n_name ?x OPTIONAL { ?s t:s_nationkey ?n ; t:s_acctbal ?b FILTER(?b > 9000) } } } { SELECT ?s ?bal { ?s t:s_acctbal ?bal FILTER(?bal > 8500) } } } GROUP BY ?n",
        "SELECT 'http://tables.example/nation/' || n_nationkey AS n, count(*) AS k FROM (nation LEFT JOIN supplier x ON s_nationkey = n_nationkey AND s_acctbal > 9000) l JOIN supplier r ON (l.s_suppkey = r.s_suppkey OR l.s_suppkey IS NULL) AND r.s_acctbal > 8500 GROUP BY n_nationkey",
    ),
    "union": ("SELECT ?x ?n { { ?x t:p_name ?n } UNION { ?x t:s_name ?n } }", "SELECT 'http://tables.example/part/' || p_partkey AS x, p_name AS n FROM part UNION ALL SELECT 'http://tables.example/supplier/' || s_suppkey, s_name FROM supplier"),
    "union_distinct": ("SELECT DISTINCT ?n { { ?c t:c_nationkey ?n } UNION { ?s t:s_nationkey ?n } }", "SELECT 'http://tables.example/nation/' || c_nationkey AS n FROM customer UNION SELECT 'http://tables.example/nation/' || s_nationkey FROM supplier"),
    "minus": ("SELECT ?c { ?c t:c_name ?n MINUS { ?o t:o_custkey ?c ; t:o_orderstatus 'P' } }", f"SELECT {CUST} AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "minus_disjoint": ("SELECT ?r { ?r t:r_name ?n MINUS { ?x t:n_name ?y } }", "SELECT 'http://tables.example/region/' || r_regionkey AS r FROM region"),
    "exists": ("SELECT ?c { ?c t:c_name ?n FILTER EXISTS { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > 450000) } }", f"SELECT {CUST} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)"),
    "not_exists": ("SELECT ?c { ?c t:c_acctbal ?b FILTER NOT EXISTS { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > ?b * 50) } }", f"SELECT {CUST} AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50)"),
    "exists_in_or": (
        "SELECT ?c { ?c t:c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > 480000) }) }",
        f"SELECT {CUST} AS c FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)",
    ),
    "values_join": ("SELECT ?c ?k { ?c t:c_mktsegment ?s VALUES (?s ?k) { ('BUILDING' 1) ('MACHINERY' 2) } }", f"SELECT {CUST} AS c, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 2 END AS BIGINT) AS k FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "values_undef": (
        "SELECT ?c ?k { ?c t:c_mktsegment ?s ; t:c_nationkey ?n VALUES (?s ?n ?k) { ('BUILDING' UNDEF 1) (UNDEF <http://tables.example/nation/3> 2) } }",
        f"SELECT {CUST} AS c, CAST(k AS BIGINT) AS k FROM customer JOIN (VALUES ('BUILDING', NULL, 1), (NULL, 3, 2)) v(s, n, k) ON (s IS NULL OR s = c_mktsegment) AND (n IS NULL OR n = c_nationkey)",
    ),
    "graph_named": ("SELECT ?n { GRAPH g:nation { ?x t:n_name ?n } }", "SELECT n_name AS n FROM nation"),
    "graph_var": ("SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?x a ?t } } GROUP BY ?g", "SELECT 'http://tables.example/graph/' || t AS g, n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "eval_items", "embeddings")) + ") x"),
    "agg_count": ("SELECT (COUNT(*) AS ?n) (COUNT(?p) AS ?k) { ?c t:c_name ?x OPTIONAL { ?o t:o_custkey ?c ; t:o_totalprice ?p FILTER(?p > 400000) } }", "SELECT count(*) AS n, count(o_totalprice) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000"),
    "agg_count_distinct": ("SELECT (COUNT(DISTINCT ?c) AS ?n) (COUNT(DISTINCT ?s) AS ?k) (COUNT(DISTINCT *) AS ?a) { ?o t:o_custkey ?c ; t:o_orderstatus ?s }", "SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT o_orderstatus) AS k, count(*) AS a FROM orders"),
    "agg_sum": ("SELECT ?s (SUM(?k) AS ?a) (ROUND(SUM(?z) * 100) / 100 AS ?b) { ?p t:p_brand ?s ; t:p_size ?k ; t:p_retailprice ?z } GROUP BY ?s", "SELECT p_brand AS s, CAST(sum(p_size) AS BIGINT) AS a, floor(sum(p_retailprice) * 100 + 0.5) / 100 AS b FROM part GROUP BY 1"),
    "agg_avg": ("SELECT ?s (ROUND(AVG(?z) * 1000000) / 1000000 AS ?b) { ?p t:p_brand ?s ; t:p_retailprice ?z } GROUP BY ?s", "SELECT p_brand AS s, floor(avg(p_retailprice) * 1000000 + 0.5) / 1000000 AS b FROM part GROUP BY 1"),
    "agg_minmax": ("SELECT ?s (MIN(?z) AS ?a) (MAX(?z) AS ?b) (MIN(?n) AS ?c) (MAX(?n) AS ?d) { ?p t:p_brand ?s ; t:p_retailprice ?z ; t:p_name ?n } GROUP BY ?s", "SELECT p_brand AS s, min(p_retailprice) AS a, max(p_retailprice) AS b, min(p_name) AS c, max(p_name) AS d FROM part GROUP BY 1"),
    "agg_distinct_num": ("SELECT (SUM(DISTINCT ?k) AS ?a) (xsd:double(AVG(DISTINCT ?k)) AS ?b) { ?p t:p_size ?k }", "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS a, avg(DISTINCT p_size) AS b FROM part"),
    "agg_empty": ("SELECT (SUM(?k) AS ?a) (COUNT(*) AS ?b) (MIN(?k) AS ?c) { ?p t:p_size ?k FILTER(?k > 1000000) }", "SELECT CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c"),
    "agg_expr_group": ("SELECT ?y (COUNT(*) AS ?n) { ?o t:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "having": ("SELECT ?c (COUNT(*) AS ?n) { ?o t:o_custkey ?c } GROUP BY ?c HAVING (COUNT(*) > 15 && SUM(1) < 25)", "SELECT 'http://tables.example/customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND count(*) < 25"),
    "sample": ("SELECT ?s (SAMPLE(?s) AS ?x) { ?p t:p_brand ?s } GROUP BY ?s", "SELECT p_brand AS s, p_brand AS x FROM part GROUP BY 1"),
    "group_concat_distinct": ("SELECT ?s (GROUP_CONCAT(DISTINCT ?p; SEPARATOR='|') AS ?all) { ?o t:o_orderstatus ?s ; t:o_orderpriority ?p } GROUP BY ?s", "SELECT o_orderstatus AS s, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS \"all\" FROM orders GROUP BY 1"),
    "order_limit_offset": ("SELECT ?k ?p { ?o t:o_orderkey ?k ; t:o_totalprice ?p } ORDER BY DESC(?p) ?k LIMIT 20 OFFSET 7", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 7"),
    "topk": ("SELECT ?k ?p { ?o t:o_orderkey ?k ; t:o_totalprice ?p } ORDER BY ?p ?k LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10"),
    "distinct": ("SELECT DISTINCT ?s ?p { ?o t:o_orderstatus ?s ; t:o_orderpriority ?p }", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "reduced": ("SELECT REDUCED ?s { ?o t:o_orderstatus ?s }", "SELECT DISTINCT o_orderstatus AS s FROM orders"),
    "subquery": (
        "SELECT ?name ?n { { SELECT ?c (COUNT(*) AS ?n) { ?o t:o_custkey ?c } GROUP BY ?c ORDER BY DESC(?n) ?c LIMIT 10 } ?c t:c_name ?name }",
        "SELECT c_name AS name, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 'http://tables.example/customer/' || o_custkey LIMIT 10) x JOIN customer ON c_custkey = o_custkey",
    ),
    "ask": ("ASK { ?o t:o_totalprice ?p FILTER(?p > 1000) }", "SELECT count(*) > 0 AS result FROM orders WHERE o_totalprice > 1000"),
    "path_seq": ("SELECT ?r (COUNT(*) AS ?n) { ?c t:c_nationkey/t:n_regionkey/t:r_name ?r } GROUP BY ?r", "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "path_inverse": ("SELECT ?n (COUNT(?c) AS ?k) { ?n ^t:c_nationkey ?c } GROUP BY ?n", "SELECT 'http://tables.example/nation/' || c_nationkey AS n, count(*) AS k FROM customer GROUP BY c_nationkey"),
    "path_alt": ("SELECT ?x ?n { ?x t:c_nationkey|t:s_nationkey ?n }", f"SELECT {CUST} AS x, 'http://tables.example/nation/' || c_nationkey AS n FROM customer UNION ALL SELECT 'http://tables.example/supplier/' || s_suppkey, 'http://tables.example/nation/' || s_nationkey FROM supplier"),
    "path_neg": (
        "SELECT ?s ?o { GRAPH g:region { ?s !(t:r_regionkey|a) ?o } }",
        "SELECT 'http://tables.example/region/' || r_regionkey AS s, r_name AS o FROM region",
    ),
    "path_neg_customer": ("SELECT ?s (COUNT(?o) AS ?n) { GRAPH g:customer { ?s !(t:c_custkey|a|t:c_name) ?o } } GROUP BY ?s", f"SELECT {CUST} AS s, CAST(3 AS BIGINT) AS n FROM customer"),
    "path_opt": ("SELECT ?x { <http://tables.example/nation/3> t:n_regionkey? ?x }", "SELECT 'http://tables.example/nation/3' AS x UNION SELECT 'http://tables.example/region/' || n_regionkey FROM nation WHERE n_nationkey = 3"),
    "path_plus_fk": ("SELECT ?x { <http://tables.example/customer/7> (t:c_nationkey|t:n_regionkey)+ ?x }", "SELECT 'http://tables.example/nation/' || c_nationkey AS x FROM customer WHERE c_custkey = 7 UNION SELECT 'http://tables.example/region/' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7"),
    "path_bound_both": ("ASK { <http://tables.example/customer/7> (t:c_nationkey|t:n_regionkey)+ <http://tables.example/region/2> }", "SELECT count(*) > 0 AS result FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7 AND n_regionkey = 2"),
    "path_star_graph": ("SELECT (COUNT(*) AS ?n) { GRAPH g:nation { ?x t:n_regionkey* ?y } }", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM (SELECT 's' || n_nationkey FROM nation UNION SELECT 'r' || n_regionkey FROM nation UNION SELECT 'n' || n_name FROM nation UNION SELECT 'i' || n_nationkey FROM nation UNION SELECT 'type') x) AS n"),
    "union_identity": ("SELECT ?n { { ?r t:r_name ?n } UNION { ?x t:n_name ?n FILTER(false) } }", "SELECT r_name AS n FROM region"),
    "join_identity": ("SELECT ?n { {} { ?r t:r_name ?n } {} }", "SELECT r_name AS n FROM region"),
    "group_concat": (
        "SELECT ?c (GROUP_CONCAT(?k; SEPARATOR=',') AS ?all) { SELECT ?c ?k { ?o t:o_custkey ?c ; t:o_orderkey ?k ; t:o_totalprice ?p } ORDER BY DESC(?p) ?k } GROUP BY ?c",
        "SELECT 'http://tables.example/customer/' || o_custkey AS c, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_totalprice DESC, o_orderkey) AS \"all\" FROM orders GROUP BY 1",
    ),
    "sample_in_range": ("SELECT ?b (SAMPLE(?k) >= MIN(?k) && SAMPLE(?k) <= MAX(?k) AS ?ok) { ?p t:p_brand ?b ; t:p_partkey ?k } GROUP BY ?b", "SELECT DISTINCT p_brand AS b, true AS ok FROM part"),
    "iri_relative": (
        "BASE <http://a/b/c?d> SELECT ?n (IRI(CONCAT('../', ?n)) AS ?up) (IRI(CONCAT('#', ?n)) AS ?part) (IRI(CONCAT('/', ?n)) AS ?root) (IRI(?n) AS ?here) (IRI(CONCAT('http://z/', ?n)) AS ?abs) { ?p t:p_name ?n }",
        "SELECT p_name AS n, 'http://a/' || p_name AS up, 'http://a/b/c?d#' || p_name AS part, 'http://a/' || p_name AS root, 'http://a/b/' || p_name AS here, 'http://z/' || p_name AS abs FROM part",
    ),
    "decimal_exact": (
        "SELECT ?k (STR(0.1 * ?k) AS ?a) (STR(?k / 8) AS ?b) (STR(1.25 * 0.3 + ?k) AS ?c) (STR(1.0 / 3 - 0.000000000000000001) AS ?d) { ?p t:p_partkey ?k }",
        "SELECT p_partkey AS k, p_partkey // 10 || '.' || p_partkey % 10 AS a, p_partkey // 8 || CASE p_partkey % 8 WHEN 0 THEN '.0' WHEN 1 THEN '.125' WHEN 2 THEN '.25' WHEN 3 THEN '.375' WHEN 4 THEN '.5' WHEN 5 THEN '.625' WHEN 6 THEN '.75' ELSE '.875' END AS b, p_partkey || '.375' AS c, '0.333333333333333332' AS d FROM part",
    ),
    "sum_beyond_long": ("SELECT (STR(SUM(?k * 0 + 9223372036854775807)) AS ?s) { ?p t:p_partkey ?k }", "SELECT CAST(CAST(count(*) AS HUGEINT) * 9223372036854775807 AS VARCHAR) AS s FROM part"),
    "regex_q": (
        "SELECT ?n (REGEX(?n, '#0.', 'q') AS ?a) (REGEX(?n, '#0.') AS ?b) (REGEX(?n, 'CUSTOMER#', 'iq') AS ?c) (REPLACE(?n, '#', '$1.', 'q') AS ?d) { ?x t:c_name ?n }",
        "SELECT c_name AS n, contains(c_name, '#0.') AS a, regexp_matches(c_name, '#0.') AS b, contains(lower(c_name), 'customer#') AS c, replace(c_name, '#', '$1.') AS d FROM customer",
    ),
    "timezones": (
        "SELECT ?k (STR(TIMEZONE(STRDT(CONCAT('2020-05-06T07:08:09-0', STR(?k), ':30'), xsd:dateTime))) AS ?z) (TZ(STRDT(CONCAT('2020-05-06T07:08:09+0', STR(?k), ':00'), xsd:dateTime)) AS ?t) { ?r t:r_regionkey ?k }",
        "SELECT CAST(r_regionkey AS BIGINT) AS k, CASE r_regionkey WHEN 0 THEN '-PT30M' ELSE '-PT' || r_regionkey || 'H30M' END AS z, '+0' || r_regionkey || ':00' AS t FROM region",
    ),
    "generated": (
        "SELECT ?c (STRLEN(STRUUID()) AS ?a) (STRSTARTS(STR(UUID()), 'urn:uuid:') AS ?b) (RAND() >= 0 && RAND() < 1 AS ?d) (isLiteral(NOW()) AS ?e) (isBlank(BNODE()) AS ?f) { ?c t:c_name ?n }",
        f"SELECT {CUST} AS c, CAST(36 AS BIGINT) AS a, true AS b, true AS d, true AS e, true AS f FROM customer",
    ),
    "bnode_labels": (
        "SELECT (COUNT(*) AS ?n) (COUNT(DISTINCT ?x) AS ?k) (COUNT(DISTINCT ?z) AS ?j) { ?c t:c_mktsegment ?s BIND(BNODE(?s) AS ?x) BIND(BNODE(?s) AS ?y) BIND(BNODE('other') AS ?z) FILTER(?x = ?y && ?x != ?z) }",
        "SELECT count(*) AS n, count(*) AS k, count(*) AS j FROM customer",
    ),
    "exists_uncorrelated": ("SELECT ?n { ?r t:r_name ?n FILTER EXISTS { ?o t:o_totalprice ?p } }", "SELECT r_name AS n FROM region"),
    "optional_three": (
        "SELECT ?n ?s ?c ?r (COUNT(*) AS ?k) { { SELECT ?n ?s ?c ?r { ?n t:n_name ?x OPTIONAL { ?s t:s_nationkey ?n ; t:s_acctbal ?b FILTER(?b > 9500) } OPTIONAL { ?c t:c_nationkey ?n ; t:c_acctbal ?d FILTER(?d > 9900) } OPTIONAL { ?n t:n_regionkey ?r . ?r t:r_name 'ASIA' } } } OPTIONAL { ?r t:r_regionkey ?rk } } GROUP BY ?n ?s ?c ?r",
        """WITH b AS (SELECT n_nationkey, s_suppkey, c_custkey, CASE WHEN r_name = 'ASIA' THEN r_regionkey END AS r FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9500 LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900 LEFT JOIN region ON r_regionkey = n_regionkey)
        SELECT 'http://tables.example/nation/' || n_nationkey AS n, 'http://tables.example/supplier/' || s_suppkey AS s, 'http://tables.example/customer/' || c_custkey AS c, 'http://tables.example/region/' || r2.r_regionkey AS r, count(*) AS k FROM b LEFT JOIN region r2 ON b.r = r2.r_regionkey OR b.r IS NULL GROUP BY ALL""",
    ),
}

_WINDOW = {
    "win_rank": ("RANK()", "ORDER BY ?et", "rank()", "ORDER BY event_type"),
    "win_dense": ("DENSE_RANK()", "ORDER BY ?et", "dense_rank()", "ORDER BY event_type"),
    "win_rownum": ("ROW_NUMBER()", "ORDER BY ?k", "row_number()", "ORDER BY event_id"),
    "win_prec_cur": ("AVG(?v)", "ORDER BY ?k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW", "avg(value)", "ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"),
    "win_cur_foll": ("SUM(?v)", "ORDER BY ?k ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING", "sum(value)", "ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING"),
    "win_prec_prec": ("AVG(?v)", "ORDER BY ?k ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING", "coalesce(avg(value)", "ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING"),
    "win_foll_foll": ("COUNT(?v)", "ORDER BY ?k ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING", "count(value)", "ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING"),
    "win_prec_foll": ("MAX(?v)", "ORDER BY ?k ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING", "max(value)", "ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING"),
    "win_unb_unb": ("MIN(?v)", "ORDER BY ?k ROWS BETWEEN UNBOUNDED AND UNBOUNDED", "min(value)", "ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"),
    "win_unb_cur": ("SUM(?v)", "ORDER BY ?k ROWS BETWEEN UNBOUNDED AND CURRENT ROW", "sum(value)", "ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"),
    "win_cur_unb": ("COUNT(*)", "ORDER BY ?k ROWS BETWEEN CURRENT ROW AND UNBOUNDED", "count(*)", "ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"),
    "win_prec_unb": ("MIN(?v)", "ORDER BY ?k ROWS BETWEEN 2 PRECEDING AND UNBOUNDED", "min(value)", "ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND UNBOUNDED FOLLOWING"),
    "win_sample": ("SAMPLE(?u)", "ORDER BY ?k", "min(user_id)", "ORDER BY event_id"),
    "win_count_distinct": ("COUNT(DISTINCT ?et)", "ORDER BY ?k ROWS BETWEEN 3 PRECEDING AND CURRENT ROW", "count(DISTINCT event_type)", "ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW"),
    "win_groupconcat": ("GROUP_CONCAT(?et)", "ORDER BY ?k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW", "string_agg(event_type, ' ')", "ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW"),
}
for _name, (_f, _over, _sql, _sql_over) in _WINDOW.items():
    _end = ", 0)" if _sql.startswith("coalesce") else ""
    _x, _y = f"{_f} OVER (PARTITION BY ?u {_over})", f"{_sql} OVER (PARTITION BY user_id {_sql_over}){_end}"
    if _f.startswith(("SUM", "AVG")):  # sums of doubles differ in their last bits with the order of adding
        _x, _y = f"ROUND({_x} * 1000000) / 1000000", f"floor({_y} * 1000000 + 0.5) / 1000000"
    MAPPED[_name] = (
        f"SELECT ?k ({_x} AS ?x) {{ ?e t:event_id ?k ; t:user_id ?u ; t:event_type ?et ; t:value ?v }}",
        f"SELECT event_id AS k, {_y} AS x FROM events",
    )
MAPPED["win_ntile_peer"] = (
    "SELECT ?k (NTILE(3) OVER (PARTITION BY ?u ORDER BY ?et) AS ?x) { ?e t:event_id ?k ; t:user_id ?u ; t:event_type ?et }",
    """SELECT event_id AS k, CASE WHEN d <= (g % 3) * (g // 3 + 1) THEN (d - 1) // (g // 3 + 1) + 1 ELSE (d - 1 - (g % 3) * (g // 3 + 1)) // greatest(g // 3, 1) + 1 + g % 3 END AS x
    FROM (SELECT *, max(d) OVER (PARTITION BY user_id) AS g FROM (SELECT event_id, user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS d FROM events) a) b""",
)
MAPPED["win_having"] = (
    "SELECT ?c (COUNT(*) AS ?n) (RANK() OVER (ORDER BY DESC(COUNT(*))) AS ?r) { ?o t:o_custkey ?c } GROUP BY ?c HAVING (RANK() OVER (ORDER BY DESC(COUNT(*))) <= 5)",
    "SELECT 'http://tables.example/customer/' || o_custkey AS c, n, r FROM (SELECT o_custkey, n, rank() OVER (ORDER BY n DESC) AS r FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a) b WHERE r <= 5",
)
MAPPED["win_two"] = (
    "SELECT ?k (ROW_NUMBER() OVER (PARTITION BY ?et ORDER BY ?k) AS ?a) (ROUND(SUM(?v) OVER (PARTITION BY ?u) * 100) / 100 AS ?b) { ?e t:event_id ?k ; t:user_id ?u ; t:event_type ?et ; t:value ?v }",
    "SELECT event_id AS k, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS a, floor(sum(value) OVER (PARTITION BY user_id) * 100 + 0.5) / 100 AS b FROM events",
)

TYPED = "PREFIX ex: <ex:> PREFIX foaf: <foaf:> PREFIX skos: <skos:> PREFIX rdf: <rdf:> PREFIX rdfs: <rdfs:>\n"
_NODUP = "(SELECT DISTINCT subject, predicate, object FROM quads WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL)"
_P = "(SELECT id FROM terms WHERE value = '{}' AND type = 2)"
_LINKS = "WITH RECURSIVE l AS (SELECT DISTINCT subject AS a, object AS b FROM quads WHERE object IS NOT NULL AND predicate IN " + _P.format("skos:broader") + " UNION SELECT object, subject FROM quads WHERE object IS NOT NULL AND predicate IN " + _P.format("skos:narrower") + ")"
#: name -> (SPARQL over the quad store, SQL)
STORED: dict[str, tuple[str, str]] = {
    "store_count": ("SELECT (COUNT(*) AS ?n) { ?s <foaf:knows> ?o }", f"SELECT count(*) AS n FROM {_NODUP} x WHERE predicate IN {_P.format('foaf:knows')}"),
    "store_distinct": ("SELECT (COUNT(DISTINCT ?s) AS ?n) { ?s <rdf:type> <ex:Item> ; <foaf:name> ?x }", f"SELECT count(DISTINCT a.subject) AS n FROM {_NODUP} a JOIN {_NODUP} b ON a.subject = b.subject WHERE a.predicate IN {_P.format('rdf:type')} AND a.object IN {_P.format('ex:Item')} AND b.predicate IN {_P.format('foaf:name')}"),
    "store_join": ("SELECT ?n (COUNT(*) AS ?k) { ?a <foaf:knows> ?b . ?b <foaf:name> ?n } GROUP BY ?n", f"SELECT coalesce(t.value, 'id' || b.object) AS n, count(*) AS k FROM {_NODUP} a JOIN {_NODUP} b ON b.subject = a.object LEFT JOIN terms t ON t.id = b.object WHERE a.predicate IN {_P.format('foaf:knows')} AND b.predicate IN {_P.format('foaf:name')} GROUP BY b.object, 1"),
    "store_sum": ("SELECT ?g (COUNT(?v) AS ?n) { GRAPH ?g { ?s <ex:reading> ?v } } GROUP BY ?g", "SELECT t.value AS g, count(*) AS n FROM (SELECT DISTINCT subject, predicate, object, graph FROM quads WHERE subject IS NOT NULL AND object IS NOT NULL AND graph IS NOT NULL) q JOIN terms t ON t.id = graph WHERE predicate IN " + _P.format("ex:reading") + " GROUP BY graph, t.value"),
    "store_filter": ("SELECT ?s ?v { ?s <ex:reading> ?v FILTER(isNumeric(?v) && ?v > 900) }", f"SELECT coalesce(t.value, 'id' || subject) AS s, CAST(object - 1729382256910270464 AS VARCHAR) AS v FROM {_NODUP} q LEFT JOIN terms t ON t.id = subject WHERE predicate IN {_P.format('ex:reading')} AND object > 1729382256910271364"),
    "store_path_plus": ("SELECT (COUNT(*) AS ?n) { ?a (<skos:broader>|^<skos:narrower>)+ ?b }", "WITH RECURSIVE l AS (SELECT DISTINCT subject AS a, object AS b FROM quads WHERE object IS NOT NULL AND predicate IN " + _P.format("skos:broader") + " UNION SELECT object, subject FROM quads WHERE object IS NOT NULL AND predicate IN " + _P.format("skos:narrower") + "), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b) SELECT count(*) AS n FROM r"),
    "store_total": ("SELECT ?g (SUM(?v) AS ?n) { GRAPH ?g { ?s <ex:reading> ?v } } GROUP BY ?g", "SELECT t.value AS g, CASE WHEN bool_and(object >= 1729382256910270464) THEN CAST(sum(object - 1729382256910270464) AS VARCHAR) END AS n FROM (SELECT DISTINCT subject, predicate, object, graph FROM quads WHERE subject IS NOT NULL AND object IS NOT NULL AND graph IS NOT NULL) q JOIN terms t ON t.id = graph WHERE predicate IN " + _P.format("ex:reading") + " GROUP BY graph, t.value"),
    "store_literal": ("SELECT ?s ?p { ?s ?p 'bridge bave' }", f"SELECT coalesce(a.value, 'id' || subject) AS s, b.value AS p FROM (SELECT DISTINCT subject, predicate FROM {_NODUP} x WHERE object IN (SELECT t.id FROM terms t LEFT JOIN terms d ON d.id = t.datatype WHERE t.value = 'bridge bave' AND t.type IN (17, 22) AND (d.value IS NULL OR lower(replace(replace(trim(d.value), '<', ''), '>', '')) = 'xsd:string'))) q LEFT JOIN terms a ON a.id = subject LEFT JOIN terms b ON b.id = predicate"),
    "store_lang_literal": ("SELECT ?p (COUNT(*) AS ?n) { ?s ?p 'Rosemamati lamp'@en-gb } GROUP BY ?p", f"SELECT b.value AS p, count(*) AS n FROM (SELECT DISTINCT subject, predicate FROM {_NODUP} x WHERE object IN (SELECT id FROM terms WHERE value = 'Rosemamati lamp' AND type = 16 AND replace(lower(trim(language)), '_', '-') = 'en-gb')) q JOIN terms b ON b.id = predicate GROUP BY b.id, 1"),
    "store_path_star": ("SELECT (COUNT(*) AS ?n) { ?a (<skos:broader>|^<skos:narrower>)* ?b }", _LINKS + f", r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b) SELECT count(*) AS n FROM (SELECT a, b FROM r UNION SELECT subject, subject FROM {_NODUP} x UNION SELECT object, object FROM {_NODUP} y) z"),
    "store_path_opt": ("SELECT (COUNT(*) AS ?n) { ?a (<skos:broader>|^<skos:narrower>)? ?b }", _LINKS + f" SELECT count(*) AS n FROM (SELECT a, b FROM l UNION SELECT subject, subject FROM {_NODUP} x UNION SELECT object, object FROM {_NODUP} y) z"),
}


_STORES: dict[tuple[str, str], MappedStore] = {}


def _mapped_store(spark: SparkSession, d: str) -> MappedStore:
    """One store per session and folder, so that schemas are read once."""
    key = spark.sparkContext.applicationId, d
    if key not in _STORES:
        _STORES.clear()
        _STORES[key] = MappedStore(spark, d)
    return _STORES[key]


def _mapped(text: str):
    return lambda spark, d: Engine(_mapped_store(spark, d)).query(PREFIX + text)


def _stored(text: str):
    return lambda spark, d: Engine(DictionaryStore(table(spark, d, "quads"), table(spark, d, "terms"))).query(text)


def construct(spark: SparkSession, d: str) -> DataFrame:
    out = Engine(_mapped_store(spark, d)).query(PREFIX + "CONSTRUCT { ?r t:has ?n . ?n t:in ?r } WHERE { ?n t:n_regionkey ?r }")
    return out.select(F.col("s.lex").alias("s"), F.col("p.lex").alias("p"), F.col("o.lex").alias("o"))


def describe(spark: SparkSession, d: str) -> DataFrame:
    out = Engine(_mapped_store(spark, d)).query(PREFIX + "DESCRIBE ?r { ?r t:r_name 'ASIA' }")
    return out.select(F.col("s.lex").alias("s"), F.col("p.lex").alias("p"), F.col("o.lex").alias("o"))


def graph_description(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quads")
    return q.groupBy("graph", "predicate").agg(F.count(F.lit(1)).alias("n"))


def _store(spark: SparkSession, d: str) -> DictionaryStore:
    return DictionaryStore(table(spark, d, "quads"), table(spark, d, "terms"))


def effective_version(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).effective_version([(Var("s"), iri("foaf:knows"), Var("o")), (Var("s"), iri("skos:broader"), Var("o"))])


def characteristic_sets(spark: SparkSession, d: str) -> DataFrame:
    sets = _store(spark, d).characteristic_sets()
    return sets.select(F.array_join(F.transform("predicates", lambda p: p.cast("string")), " ").alias("predicates"), "subjects")


def star_count(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).star_count([iri("rdf:type"), iri("foaf:name")])


def language_best(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).best_language({"en": 1.0, "de": 0.9, "fr": 0.8, "*": 0.5}, {"fr": 0.5})


def queries() -> dict:
    out = {n: _mapped(q) for n, (q, _) in MAPPED.items()} | {n: _stored(q) for n, (q, _) in STORED.items()}
    return out | {f.__name__: f for f in (construct, describe, graph_description, effective_version, characteristic_sets, star_count, language_best)}


def oracle_sql() -> dict[str, str]:
    out = {n: sql for n, (_, sql) in (MAPPED | STORED).items() if sql}
    out["construct"] = "SELECT 'http://tables.example/region/' || n_regionkey AS s, 'http://tables.example/has' AS p, 'http://tables.example/nation/' || n_nationkey AS o FROM nation UNION SELECT 'http://tables.example/nation/' || n_nationkey, 'http://tables.example/in', 'http://tables.example/region/' || n_regionkey FROM nation"
    out["describe"] = "SELECT 'http://tables.example/region/' || r_regionkey AS s, p, o FROM (SELECT r_regionkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'http://tables.example/region' AS o FROM region WHERE r_name = 'ASIA' UNION ALL SELECT r_regionkey, 'http://tables.example/r_regionkey', CAST(r_regionkey AS VARCHAR) FROM region WHERE r_name = 'ASIA' UNION ALL SELECT r_regionkey, 'http://tables.example/r_name', r_name FROM region WHERE r_name = 'ASIA') x"
    out["effective_version"] = "SELECT max(dataset_version) AS version FROM quads WHERE predicate IN (SELECT id FROM terms WHERE value IN ('foaf:knows', 'skos:broader') AND type = 2)"
    out["characteristic_sets"] = f"SELECT predicates, count(*) AS subjects FROM (SELECT subject, string_agg(CAST(predicate AS VARCHAR), ' ' ORDER BY predicate) AS predicates FROM (SELECT DISTINCT subject, predicate FROM {_NODUP} x) y GROUP BY subject) z GROUP BY predicates"
    out["star_count"] = f"SELECT count(*) AS n FROM (SELECT DISTINCT subject FROM {_NODUP} x WHERE predicate IN {_P.format('rdf:type')}) a JOIN (SELECT DISTINCT subject FROM {_NODUP} x WHERE predicate IN {_P.format('foaf:name')}) b USING (subject)"
    out["language_best"] = """WITH q AS (SELECT DISTINCT subject, predicate, object, graph FROM quads WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL),
      l AS (SELECT q.*, lower(replace(trim(language), '_', '-')) AS lang FROM q LEFT JOIN terms t ON t.id = q.object AND t.type = 16),
      w AS (SELECT *, CASE WHEN lang IS NULL THEN 1.0 WHEN lang = 'en' OR lang LIKE 'en-%' THEN 1.0 WHEN lang = 'de' OR lang LIKE 'de-%' THEN 0.9 WHEN lang = 'fr' OR lang LIKE 'fr-%' THEN 0.8 * 0.5 ELSE 0.5 END AS v FROM l),
      r AS (SELECT *, rank() OVER (PARTITION BY subject, predicate, graph, lang IS NULL ORDER BY v DESC, lang) AS k FROM w)
      SELECT subject, predicate, object, graph FROM r WHERE lang IS NULL OR k = 1"""
    out["graph_description"] = "SELECT graph, predicate, count(*) AS n FROM quads GROUP BY graph, predicate"
    return out
