"""Duplicates hidden by formatting differences.

1. byte-identical raw rows collapse first, with counts (map-side combining: a hot copy costs one row per task);
2. only the distinct survivors are canonicalised, with JVM expressions;
3. the survivors, canonicalised once and written, group again on the full canonical text, and the counts add up.

Only spellings of repeated terms are joined with their groups again: by a hash, with the full text compared beside it.
A term with very many spellings is one hot key of that join, whose other side has one row; AQE splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.runtime import Scratch, small

IRI, LITERALS = 2, (16, 17, 22)
#: One character that separates words: no letter or digit, no single non-space character between two digits, no sign
#: before a digit and not after a word. It matches single characters, so texts of any length need no stack.
SEPARATOR = r"(?U)(?!(?<=\p{N})\S(?=\p{N}))(?!(?<![\p{L}\p{N}])[+-](?=\p{N}))[^\p{L}\p{N}]"


def canonical_iri(value):
    """Lower case, no white space, one pair of angle brackets taken off."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"(?U)\s+", ""), "^<(.*)>$", "$1")


def canonical_literal(value):
    """The words of each field between `;` and `|`, fields sorted; a value without letter or digit stays, trimmed."""
    fields = F.split(F.lower(value), "[;|]", -1)
    words = F.transform(fields, lambda f: F.trim(F.regexp_replace(F.regexp_replace(f, SEPARATOR, " "), " +", " ")))
    text = F.array_join(F.sort_array(F.filter(words, lambda w: w != "")), "|")
    bare = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return F.when(value.rlike(r"[\p{L}\p{N}]"), text).otherwise(F.concat(F.lit("\u0001"), bare))


def _survivors(terms: DataFrame) -> DataFrame:
    literal = F.col("type").isin(*LITERALS)
    usable = terms.where(F.col("id").isNotNull() & F.col("value").isNotNull() & ((F.col("type") == IRI) | literal))
    return usable.select(F.col("id").cast("long").alias("id"), literal.alias("literal"), "value", F.when(literal, F.col("datatype")).alias("datatype"), F.when(literal, F.col("language")).alias("language"))


_RAW = ["literal", "value", "datatype", "language"]
_KEY = ["literal", "dt", "lang", "key"]


def _keyed(raw: DataFrame, terms: DataFrame) -> DataFrame:
    used = raw.where("datatype is not null").select(F.col("datatype").alias("used")).distinct()
    named = terms.where("value is not null").join(small(used), F.col("id") == F.col("used")).groupBy("used").agg(F.min(canonical_iri(F.col("value"))).alias("iri"))
    out = raw.join(small(named), raw["datatype"] == named["used"], "left")
    dt = F.when(F.col("literal"), F.when(F.col("datatype").isNull(), F.lit("xsd:string")).otherwise(F.coalesce("iri", F.concat(F.lit("#"), F.col("datatype").cast("string"))))).otherwise("")
    tag = F.translate(F.lower(F.regexp_replace("language", r"(?U)^\s+|\s+$", "")), "_", "-")
    return out.select(*_RAW, "first", "n", dt.alias("dt"), F.coalesce(F.concat(F.lit("="), tag), F.lit("")).alias("lang"), F.when(F.col("literal"), canonical_literal(F.col("value"))).otherwise(canonical_iri(F.col("value"))).alias("key"))


def _staged(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(terms.sparkSession)
    raw = scratch.stage(_survivors(terms).groupBy(*_RAW).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    keyed = scratch.stage(_keyed(raw, terms))
    return keyed, keyed.groupBy(*_KEY).agg(F.min("first").alias("kept_id"), F.sum("n").alias("copies"), F.count(F.lit(1)).alias("spellings"))


def collapsed(terms: DataFrame) -> DataFrame:
    """(kept_id, copies, spellings): one row per different term, with its number of rows and of byte-different spellings.

    kept_id is the smallest id. Two terms are equal if kind, datatype, language and value agree in the sense of
    TESTDATA problem 4. Blank nodes, unknown types and null values equal nothing: each is a term of its own. Rows
    without an id can't be kept or named and are left out. A datatype id without a row equals only itself. An empty
    table gives no rows.
    """
    _, groups = _staged(terms)
    alone = terms.where(F.col("id").isNotNull() & ~F.coalesce(F.col("value").isNotNull() & F.col("type").isin(IRI, *LITERALS), F.lit(False)))
    return groups.select("kept_id", "copies", "spellings").unionByName(alone.select(F.col("id").cast("long").alias("kept_id"), F.lit(1).cast("long").alias("copies"), F.lit(1).cast("long").alias("spellings")))


def duplicate_ids(terms: DataFrame) -> DataFrame:
    """(kept_id, dup_id): one row for each row of an equal set but the one with the smallest id; see collapsed()."""
    keyed, groups = _staged(terms)
    scratch = Scratch(terms.sparkSession)
    more = groups.where("copies > 1").select(F.xxhash64(*_KEY).alias("_h"), *[F.col(c).alias(f"_{c}") for c in _KEY], "kept_id")
    more = small(scratch.stage(more))  # few groups: the spellings stay where they are
    repeated = F.col("n") > 1  # only these spellings have rows other than `first`
    same_term = F.xxhash64(*_KEY) == F.col("_h")
    for c in _KEY:
        same_term = same_term & (F.concat(F.col(c).cast("string"), F.lit("")) == F.concat(F.col(f"_{c}").cast("string"), F.lit("")))
    members = scratch.stage(keyed.join(more, same_term).select("kept_id", "first", "n", *[F.when(repeated, F.col(c)).alias(c) for c in _RAW]))
    spelled = members.where("first <> kept_id").select("kept_id", F.col("first").alias("dup_id"))
    hot = members.where(repeated).select("kept_id", "first", *[F.col(c).alias(f"m_{c}") for c in _RAW])
    same = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in _RAW]
    on = same[0] & same[1] & same[2] & same[3]
    copies = _survivors(terms).join(hot, on).where("id <> first").select("kept_id", F.col("id").alias("dup_id"))
    return spelled.unionByName(copies)
