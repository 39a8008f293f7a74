"""Attribute-value rows into wide tables.

An entity is a register with one slot per column. RDD.combineByKey merges cells into registers with associative,
commutative mergers, so duplicates and conflicts resolve on the map side (spilling when a worker's memory is used up)
and only registers shuffle, never the rows of a hot entity. Typed encoders then emit one full row per entity.

A slot of a single-valued column is bounded: the smallest value and two flags. A slot of a multi-valued column holds
its distinct values, which is the size of the cell that is asked for.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from decimal import MAX_EMAX, MIN_EMIN, Context, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrel.operators.orphans import INLINE_BASE
from quadrel.runtime import Scratch, small

_TRIM = " \t\r\n"
#: Written cells (compressed) for one partition of registers.
REGISTER_BYTES = 16 << 20
#: Digits of an integer that int() reads at most, whatever the interpreter's settings (its lowest limit).
INT_DIGITS = 640
_INT = re.compile(r"[+-]?[0-9]+\Z")
_DECIMAL = re.compile(r"[+-]?[0-9]+(\.[0-9]+)?\Z")
_DOUBLE = re.compile(r"[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\Z")
_DATE = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})\Z")
_STAMP = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,6}))?(Z|[+-][0-9]{2}:[0-9]{2})?\Z")
_BOOL = {"true": True, "1": True, "false": False, "0": False}


def _date(text: str):
    m = _DATE.match(text)
    try:
        return date(*map(int, m.groups())) if m else None
    except ValueError:
        return None


def _stamp(text: str):
    """The instant as (whole seconds since 1970, microseconds), or None."""
    m = _STAMP.match(text)
    if not m or (day := _date(m[1])) is None:
        return None
    h, mi, s = int(m[2]), int(m[3]), int(m[4])
    if h > 23 or mi > 59 or s > 59:
        return None
    away = 0
    if m[6] and m[6] != "Z":
        oh, om = int(m[6][1:3]), int(m[6][4:])
        if oh > 23 or om > 59:
            return None
        away = (oh * 60 + om) * (-60 if m[6][0] == "-" else 60)
    return ((day - date(1970, 1, 1)).days * 86400 + h * 3600 + mi * 60 + s - away, int((m[5] or "0").ljust(6, "0")))


def _whole(text: str) -> int | Decimal:
    """The exact number; a Decimal, which compares and hashes like an int, beyond the digits that int() reads."""
    digits = text.lstrip("+-").lstrip("0")
    return int(text[: text[0] == "-"] + (digits or "0")) if len(digits) <= INT_DIGITS else Decimal(text)


def _exact(text: str) -> Context:
    """A context in which no digit of a text is rounded."""
    return Context(prec=len(text), Emax=MAX_EMAX, Emin=MIN_EMIN)


def read_value(kind: str, text: str, is_iri: bool):
    """The typed, comparable value of a text, or None if it can't be read as `kind`."""
    if kind == "string":
        return text
    if kind == "iri":
        return text if is_iri else None
    text = text.strip(_TRIM)
    if kind == "boolean":
        return _BOOL.get(text.lower()) if text.isascii() else None
    if kind == "int":
        return _whole(text) if _INT.match(text) else None
    if kind == "decimal":
        return Decimal(text).normalize(_exact(text)) if _DECIMAL.match(text) else None
    if kind == "double":
        return float(text) + 0.0 if _DOUBLE.match(text) else None
    if kind == "date":
        return _date(text)
    if kind == "timestamp":
        return _stamp(text)
    raise ValueError(f"unknown value type {kind}")


_SPARK = {"string": T.StringType(), "iri": T.StringType(), "boolean": T.BooleanType(), "int": T.LongType(), "decimal": T.DecimalType(38, 18), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _encode(kind: str, value):
    """The value as the column's Spark type holds it; null if it is readable but out of that type's range."""
    if kind == "int":
        return value if -(2**63) <= value < 2**63 else None
    if kind == "decimal":
        return value if value.copy_abs() < Decimal(10) ** 20 and value.as_tuple().exponent >= -18 else None
    if kind == "timestamp":
        try:
            return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=value[0], microseconds=value[1])
        except OverflowError:
            return None
    return value


def cells_of(quads: DataFrame, attributes: DataFrame, terms: DataFrame, inline_base: int = INLINE_BASE) -> DataFrame:
    """(subject, predicate, text, kind): the cells of quads whose predicate is an attribute; text null where there is no value."""
    wanted = small(attributes.select(F.col("predicate").alias("_p")).distinct())
    eav = quads.where(F.col("subject").isNotNull()).join(wanted, F.col("predicate") == F.col("_p"), "left_semi").select("subject", "predicate", "object")
    inlined = F.col("object") >= inline_base
    direct = eav.where(F.col("object").isNull() | inlined).select("subject", "predicate", F.when(inlined, (F.col("object") - inline_base).cast("string")).alias("text"), F.lit(17).alias("kind"))
    words = terms.select(F.col("id").alias("object"), F.col("value").alias("text"), F.col("type").cast("int").alias("kind"))
    looked_up = eav.where(~inlined).join(words, "object", "left").select("subject", "predicate", "text", "kind")
    return direct.unionByName(looked_up)


class Registers:
    """The mergers of combineByKey. A register maps slot -> [untyped, conflict, value or set]."""

    def __init__(self, columns: list[tuple[str, str, bool]]):
        self.columns = columns

    def create(self, cell):
        return self.add({}, cell)

    def add(self, register, cell):
        slot, text, is_iri = cell
        if text is None:
            return register
        kind, many = self.columns[slot][1:]
        value = read_value(kind, text, is_iri)
        have = register.get(slot)
        if have is None:
            have = register[slot] = [False, False, set() if many else None]
        if value is None:
            have[0] = True
        elif many:
            have[2].add(value)
        elif have[2] is None:
            have[2] = value
        elif have[2] != value:
            have[1] = True
            have[2] = min(have[2], value)
        return register

    def merge(self, one, other):
        for slot, (untyped, conflict, value) in other.items():
            have = one.get(slot)
            if have is None:
                one[slot] = [untyped, conflict, value]
                continue
            have[0] |= untyped
            have[1] |= conflict
            if self.columns[slot][2]:
                have[2] |= value
            elif value is not None:
                if have[2] is None:
                    have[2] = value
                elif have[2] != value:
                    have[1] = True
                    have[2] = min(have[2], value)
        return one

    def row(self, subject, register):
        out = [subject]
        for slot, (_, kind, many) in enumerate(self.columns):
            untyped, conflict, value = register.get(slot, (False, False, None))
            if many:
                typed = [_encode(kind, v) for v in sorted(value)] if value else None
            else:
                typed = None if conflict or value is None else _encode(kind, value)
            out.append(typed)
        return tuple(out)

    def faults(self, subject, register):
        for slot, (name, _, _) in enumerate(self.columns):
            if slot in register:
                untyped, conflict, _ = register[slot]
                if untyped:
                    yield subject, name, "untyped"
                if conflict:
                    yield subject, name, "conflict"


def _columns(attributes: DataFrame) -> tuple[list[tuple[str, str, bool]], dict[int, list[int]]]:
    """The wide table's columns in order of predicate, and the slots of each predicate. attributes is the schema of the result."""
    rows = attributes.where("predicate is not null and column_name is not null").select("predicate", "column_name", "value_type", F.coalesce("multi_valued", F.lit(False)).alias("m")).distinct().orderBy("predicate", "column_name").collect()
    columns: list[tuple[str, str, bool]] = []
    slots: dict[int, list[int]] = {}
    for r in rows:
        names = [c[0] for c in columns]
        if r["column_name"] not in names:
            columns.append((r["column_name"], r["value_type"], bool(r["m"])))
            names.append(r["column_name"])
        slots.setdefault(r["predicate"], []).append(names.index(r["column_name"]))
    return columns, slots


def registers(quads: DataFrame, attributes: DataFrame, terms: DataFrame):
    """(columns, RDD of (subject, register))."""
    columns, slots = _columns(attributes)
    # the looked-up cells are written once, so that a lost executor repeats neither the scans nor the join. They
    # are dealt out evenly by entity, an entity too large for a partition over several, as what follows is Python's work
    spark, scratch = quads.sparkSession, Scratch(quads.sparkSession)
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    path = scratch.write(cells_of(quads, attributes, terms).hint("rebalance", least, F.col("subject")))
    cells, ops = scratch.read(path), Registers(columns)

    def keyed(rows):
        for subject, predicate, text, kind in rows:
            for slot in slots[predicate]:
                yield subject, (slot, text, kind in (1, 2))

    parts = max(least, scratch.size(path) // REGISTER_BYTES)
    return columns, ops, cells.rdd.mapPartitions(keyed).combineByKey(ops.create, ops.add, ops.merge, numPartitions=parts)


def wide_table(quads: DataFrame, attributes: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per subject with at least one attribute row: subject and one typed column per column_name.

    Multi-valued columns are sorted arrays of the distinct readable values. Cells without a readable value, with two
    or more different values in a single-valued column (see cell_faults), or outside the column type's range
    (int: 64 bits, decimal: 38 digits with 18 after the point) are null. Rows with a null subject describe no entity.
    A column_name that clashes with `subject` gets the prefix `attr_`. Empty tables give no rows.
    """
    columns, ops, rdd = registers(quads, attributes, terms)
    fields = [T.StructField("subject", T.LongType())]
    for name, kind, many in columns:
        kind_type = _SPARK[kind]
        fields.append(T.StructField(f"attr_{name}" if name == "subject" else name, T.ArrayType(kind_type) if many else kind_type))
    return quads.sparkSession.createDataFrame(rdd.map(lambda kv: ops.row(*kv)), T.StructType(fields), verifySchema=False)


def cell_faults(quads: DataFrame, attributes: DataFrame, terms: DataFrame) -> DataFrame:
    """(subject, column_name, fault): `untyped` if a value can't be read, `conflict` if a single-valued cell has different values."""
    _, ops, rdd = registers(quads, attributes, terms)
    schema = T.StructType([T.StructField("subject", T.LongType()), T.StructField("column_name", T.StringType()), T.StructField("fault", T.StringType())])
    return quads.sparkSession.createDataFrame(rdd.flatMap(lambda kv: ops.faults(*kv)), schema, verifySchema=False)
