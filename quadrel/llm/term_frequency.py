"""Frequency of every distinct value: occurrences and distinct records per term.

Range-partitioned external sort of (field, term, record) pairs, then one run-length scan per sorted range. A hot term,
and even a hot (term, record) pair, is cut over several ranges: the number of the input split takes part in the range
key, so no range has to hold more of a pair than one input split does. Each range yields one compact partial per term
with the records at both of its ends; a record counted on both sides of a cut is taken off when partials merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PARTIAL = "field int, term long, part int, n long, d long, first long, last long"
_SCHEMA = pa.schema([("field", pa.int32()), ("term", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("d", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for null) and a mask of those that are not null."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False), there


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths of sorted (field, term, record) rows: the state between batches is one open run."""
    part = TaskContext.get().partitionId()
    open_run = None  # [field, term, n, d, first, first is there, last, last is there]
    for batch in batches:
        if not batch.num_rows:
            continue
        field, _ = _ints(batch.column(0))
        term, _ = _ints(batch.column(1))
        record, there = _ints(batch.column(2))
        new_term = np.ones(len(term), dtype=bool)
        new_term[1:] = (field[1:] != field[:-1]) | (term[1:] != term[:-1])
        if open_run is not None and (field[0], term[0]) == (open_run[0], open_run[1]):
            new_term[0] = False
        new_record = new_term.copy()
        new_record[1:] |= (record[1:] != record[:-1]) | (there[1:] != there[:-1])
        if not new_term[0]:
            new_record[0] = (record[0], there[0]) != (open_run[6], open_run[7])
        fresh = (new_record & there).astype(np.int64)
        at = np.flatnonzero(new_term)
        if open_run is not None:  # rows before the first new term carry on the open run
            end = int(at[0]) if len(at) else len(term)
            if end:
                open_run[2] += end
                open_run[3] += int(fresh[:end].sum())
                open_run[6:] = [record[end - 1], there[end - 1]]
        if not len(at):
            continue
        ends = np.append(at[1:], len(term))
        n = ends - at
        d = np.add.reduceat(fresh, at)
        runs = [field[at], term[at], n, d, record[at], there[at], record[ends - 1], there[ends - 1]]
        done = [x[:-1] for x in runs]
        if open_run is not None:
            done = [np.concatenate([[o], x]) for o, x in zip(open_run, done)]
        open_run = [x[-1] for x in runs]
        if len(done[0]):
            yield _partials(done, part)
    if open_run is not None:
        yield _partials([np.array([o]) for o in open_run], part)


def _partials(runs: list[np.ndarray], part: int) -> pa.RecordBatch:
    field, term, n, d, first, first_there, last, last_there = runs
    ints = lambda x, there: pa.array(x.astype(np.int64), mask=~there.astype(bool))
    return pa.RecordBatch.from_arrays(
        [pa.array(field.astype(np.int32)), pa.array(term.astype(np.int64)), pa.array(np.full(len(term), part, np.int32)), pa.array(n.astype(np.int64)), pa.array(d.astype(np.int64)), ints(first, first_there), ints(last, last_there)],
        schema=_SCHEMA,
    )


def term_frequencies(rows: DataFrame, fields: list[str], record: str) -> DataFrame:
    """(field, term, occurrences, records) for every distinct non-null value of each integer column in `fields`.

    occurrences counts rows, records the distinct non-null values of the column `record` among them (0 if all are
    null). Nulls are no terms; repeated rows count as occurrences; an empty table gives no rows; other columns of
    `rows`, whatever they are called, are not read.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("field"), F.col(f).cast("long").alias("term")) for i, f in enumerate(fields)])
    pairs = rows.select(F.inline(cells), F.col(record).cast("long").alias("record"), F.spark_partition_id().alias("split")).where(F.col("term").isNotNull())
    ordered = pairs.repartitionByRange("field", "term", "record", "split").sortWithinPartitions("field", "term", "record").select("field", "term", "record")
    partial = ordered.mapInArrow(_scan, _PARTIAL)
    before = F.lag("last").over(Window.partitionBy("field", "term").orderBy("part"))
    merged = partial.withColumn("cut", F.coalesce((before == F.col("first")).cast("long"), F.lit(0))).groupBy("field", "term").agg(F.sum("n").alias("occurrences"), F.sum(F.col("d") - F.col("cut")).alias("records"))
    names = F.array(*[F.lit(f) for f in fields])
    return merged.select(F.element_at(names, F.col("field") + 1).alias("field"), "term", "occurrences", "records")


def marked_terms(rows: DataFrame, fields: list[str], record: str, rare: int = 2, common: float = 0.10) -> DataFrame:
    """(field, term, mark): `rare` if at most `rare` records hold the term, `common` if more than the share `common` of all records does.

    All records means the distinct non-null values of `record`. In a tiny table a term may be both and gets two rows.
    """
    every = rows.select(record).distinct().agg(F.count(record).alias("n"))
    marks = F.array_compact(F.array(F.when(F.col("records") <= rare, F.lit("rare")), F.when(F.col("records") > F.lit(common) * every.scalar(), F.lit("common"))))
    return term_frequencies(rows, fields, record).select("field", "term", F.explode(marks).alias("mark"))
