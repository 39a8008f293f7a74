"""References to records that do not exist (missing, deleted before, or added after the reference).

Keys are integers. They are cut into ranges of 32,768; for each range and month there are bitmaps (built with Spark's
native bitmap aggregates, combined on the map side and compressed in the shuffle):

- refs: keys referred to in that month, per position
- full: keys whose record lived through the whole month
- part: keys whose record lived through part of the month

refs AND NOT full are the suspects. Outside `part` a suspect is an orphan; inside, the exact times decide. Bits that
nobody doubts never become rows again: a filter of fixed size, broadcast, lets only rows that may be suspects leave
their scan, so references that the bitmaps decided are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.runtime import Scratch

#: An object of this value or more is an inlined integer, not a reference (fixed value).
INLINE_BASE = 24 * 2**56
RANGE_BITS = 15
BYTES = (1 << RANGE_BITS) // 8
#: 64-bit words of the filter of suspects: always so many, 8 MB of bits, whatever the data. It lets some others pass
#: too, more of them when there are many suspects; the join after it is exact.
FILTER_WORDS = 1 << 19


def _month(column: str):
    """Months since year 0; null for a null time."""
    return F.year(column) * 12 + F.month(column) - 1


def references(quads: DataFrame, positions: tuple[str, ...] = ("subject", "object"), inline_base: int | None = INLINE_BASE) -> DataFrame:
    """(quad_id, pos, key, at, month): one row per reference; nulls and inlined integers refer to nothing."""
    cells = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("pos"), F.col(p).cast("long").alias("key")) for i, p in enumerate(positions)])
    rows = quads.select(F.col("id").alias("quad_id"), F.col("loaded_at").alias("at"), F.inline(cells)).where(F.col("key").isNotNull())
    if inline_base is not None:
        rows = rows.where(F.col("key") < inline_base)
    return rows.withColumn("month", F.coalesce(_month("at"), F.lit(-1)))


def _bitmaps(rows: DataFrame, role) -> DataFrame:
    """(bucket, role, month, bits) of rows (key, month); one shuffle of combined bitmaps."""
    return rows.groupBy(F.shiftright("key", RANGE_BITS).alias("bucket"), role.cast("int").alias("role"), "month").agg(
        F.expr(f"bitmap_construct_agg(key & {(1 << RANGE_BITS) - 1})").alias("bits")
    )


OPEN, CLOSED, PART, REFS = 0, 1, 2, 3


def _suspects(part: pd.DataFrame) -> pd.DataFrame:
    """The bitmaps of one key range: refs AND NOT full, decoded. At most (periods x roles) bitmaps of 4 KB each."""
    base = int(part["bucket"].iloc[0]) << RANGE_BITS
    maps: dict[int, dict[int, np.ndarray]] = {}
    for role, month, bits in zip(part["role"], part["month"], part["bits"]):
        have = maps.setdefault(int(role), {})
        bits = np.frombuffer(bits, dtype=np.uint8)
        have[int(month)] = have[int(month)] | bits if int(month) in have else bits
    opened = sorted(maps.get(OPEN, {}).items())
    nothing = np.zeros(BYTES, dtype=np.uint8)
    out = []
    wanted = sorted({m for role in maps if role >= REFS for m in maps[role]})
    living, k = nothing, 0
    for month in wanted:  # an open record added in an earlier month lives from then on
        while k < len(opened) and opened[k][0] < month:
            living = living | opened[k][1]
            k += 1
        full = living | maps.get(CLOSED, {}).get(month, nothing)
        partly = maps.get(PART, {}).get(month, nothing)
        for role in maps:
            if role >= REFS and month in maps[role]:
                left = maps[role][month] & ~full
                if left.any():
                    at = np.flatnonzero(np.unpackbits(left, bitorder="little"))
                    doubt = np.unpackbits(partly, bitorder="little")[at].astype(bool)
                    out.append(pd.DataFrame({"pos": np.int8(role - REFS), "month": np.int32(month), "key": base + at.astype(np.int64), "doubt": doubt}))
    return pd.concat(out) if out else pd.DataFrame({"pos": pd.Series(dtype="int8"), "month": pd.Series(dtype="int32"), "key": pd.Series(dtype="int64"), "doubt": pd.Series(dtype="bool")})


def suspects(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(pos, month, key, doubt): references not covered by a record that lived through the whole month."""
    life = parents.select(F.col("id").cast("long").alias("key"), _month("added_at").alias("a"), _month("deleted_at").alias("d")).where("key is not null and a is not null")
    opened = life.where("d is null").select("key", F.lit(OPEN).alias("role"), F.col("a").alias("month"))
    inside = F.when(F.col("d") - F.col("a") > 1, F.sequence(F.col("a") + 1, F.col("d") - 1))
    closed = life.where("d is not null").select("key", F.lit(CLOSED).alias("role"), F.explode(inside).alias("month"))
    ends = F.array_distinct(F.array_compact(F.array("a", "d")))
    partly = life.select("key", F.lit(PART).alias("role"), F.explode(ends).alias("month"))
    both = _bitmaps(opened.unionByName(closed).unionByName(partly), F.col("role")).unionByName(_bitmaps(refs, F.col("pos") + REFS))
    return both.groupBy("bucket").applyInPandas(_suspects, "pos tinyint, month int, key long, doubt boolean")


def _hash():
    return F.pmod(F.xxhash64("pos", "month", "key"), F.lit(FILTER_WORDS * 64))


def _may_be(refs: DataFrame, found: DataFrame) -> DataFrame:
    """References whose (pos, month, key) may be among the suspects; decided in the scan, by a filter of fixed size."""
    h = _hash()
    bits = found.select(F.shiftrightunsigned(h, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int")).alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = refs.sparkSession.range(FILTER_WORDS).withColumnRenamed("id", "_word").join(words.hint("shuffle_hash"), F.col("_word") == F.col("word"), "left")
    table = F.broadcast(every.select("_word", F.coalesce("bits", F.lit(0)).alias("_bits")))
    hit = (F.call_function("shiftrightunsigned", F.col("_bits"), (F.col("_h") % 64).cast("int")) % 2) != 0
    return refs.withColumn("_h", h).join(table, F.shiftrightunsigned("_h", 6) == F.col("_word")).where(hit).select(*refs.columns)


def doubtful_share(quads: DataFrame, parents: DataFrame, positions: tuple[str, ...] = ("subject", "object"), inline_base: int | None = INLINE_BASE) -> DataFrame:
    """One row: keys (different position, month and key), suspects among them, and doubtful ones that exact times decide."""
    refs = references(quads, positions, inline_base)
    found = suspects(refs, parents).agg(F.count(F.lit(1)).alias("suspects"), F.count_if("doubt").alias("doubtful"))
    keys = refs.select("pos", "month", "key").distinct().agg(F.count(F.lit(1)).alias("keys"))
    return keys.select("keys", found.select("suspects").scalar().alias("suspects"), found.select("doubtful").scalar().alias("doubtful"))


def orphan_references(quads: DataFrame, parents: DataFrame, positions: tuple[str, ...] = ("subject", "object"), inline_base: int | None = INLINE_BASE) -> DataFrame:
    """(quad_id, position, key, month): references whose key had no live record at the row's loaded_at.

    parents (id, added_at, deleted_at) is live from added_at up to, not including, deleted_at, or on if that is null;
    a record without added_at is never live; several records of one id count together. A row without loaded_at has
    no time at which a record could be live, so its references are orphans (month null). Null and inlined keys refer
    to nothing. Empty parents make every reference an orphan.
    """
    refs = references(quads, positions, inline_base)
    found = Scratch(quads.sparkSession).stage(suspects(refs, parents))
    refs = _may_be(refs, found)
    # the lives of doubtful keys: id is the key of parents, so an array holds one interval (a few, if ids repeat)
    lives = parents.where(F.col("added_at").isNotNull()).select(F.col("id").cast("long").alias("key"), F.col("added_at").alias("a"), F.col("deleted_at").alias("d"))
    sure = found.where(~F.col("doubt")).select("pos", "month", "key", F.lit(None).cast("array<struct<a:timestamp,d:timestamp>>").alias("lives"))
    times = dict(parents.dtypes)["added_at"]
    sure = sure.withColumn("lives", F.col("lives").cast(f"array<struct<a:{times},d:{times}>>"))
    unsure = found.where("doubt").join(lives, "key").groupBy("pos", "month", "key").agg(F.collect_list(F.struct("a", "d")).alias("lives"))
    held = refs.join(sure.unionByName(unsure), ["pos", "month", "key"])
    live = F.exists("lives", lambda x: (x["a"] <= F.col("at")) & (x["d"].isNull() | (x["d"] > F.col("at"))))
    name = F.element_at(F.array(*[F.lit(p) for p in positions]), F.col("pos") + 1)
    return held.where(~F.coalesce(live, F.lit(False))).select("quad_id", name.alias("position"), "key", F.when(F.col("month") >= 0, F.trunc("at", "month")).alias("month"))


def orphan_report(orphans: DataFrame, table: str) -> DataFrame:
    """(table_name, position, month, orphans, keys): references and distinct missing keys per table, position and month."""
    per = orphans.groupBy("position", "month", "key").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("position", "month").agg(F.sum("n").alias("orphans"), F.count(F.lit(1)).alias("keys")).select(F.lit(table).alias("table_name"), "position", "month", "orphans", "keys")
