"""Evaluation texts inside the corpus.

Template canonicalisation: numbers, units and names become typed placeholders, everything else stays. Types come from
counts over the whole corpus, so they depend neither on letter case nor on which items are asked about:

- NUMBER: a word of digits; the digits inside another word are a slot of it;
- NAME: a word that makes up less than the share COMMON of all words (or occurs less than LEAST times);
- UNIT: another word that follows a number in at least half of its occurrences.

Windows of ten template words of corpus and items are hash-joined; where templates meet, the slots decide:

- `exact`: the slots are equal too, so ten consecutive words are shared;
- `reworded`: a run of windows whose templates agree has its slots replaced one to one and consistently, not all equal.
  Numerals with points or commas are one number here. A window takes part if FIXED of its words are no slots (rows of
  numbers or names alone prove nothing); an item without such a window counts if it is there as a whole.

A filter of fixed size, made from the items' windows and broadcast, keeps windows that meet no item in their scan; the
others join the items' windows by hash, one pass over the corpus for any number of items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrel.runtime import Scratch, small

WORDS = 10
#: Words other than slots that a window of a reworded passage has at least (fixed value).
FIXED = 5
#: Share of all words from which on a word is no name: at most 1 / COMMON words are kept, as hashes of 8 bytes.
COMMON = 1e-5
LEAST = 5
#: Bits of the filter over the items' windows: 8 MB, whatever the number of items; the join after it is exact.
FILTER_BITS = 1 << 26
#: Words that a worker remembers before it starts afresh; a matter of speed only.
REMEMBERED = 300_000
WORD = r"[\p{L}\p{N}]+"
#: A numeral's point or comma, between two digits.
_INNER = regex.compile(r"(\p{N})[.,](\p{N})")
_WORD = regex.compile(WORD)
_DIGITS = regex.compile(r"\p{N}+")
NUMBER, NAME, UNIT = 1, 2, 3
SEED = 42
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, as written."""
    return _WORD.findall(text)


def folded(text: str) -> str:
    """The text with each numeral as one word."""
    return _INNER.sub(r"\1\2", text)


def window_hashes(tokens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every window of WORDS tokens."""
    n = len(tokens) - WORDS + 1
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = (tokens + np.uint64(7)) * _BASE
        mixed ^= mixed >> np.uint64(29)
        for k in range(WORDS):
            out = out * np.uint64(0x100000001B3) + mixed[k : k + n]
            out ^= out >> np.uint64(31)
    return out


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


@dataclass
class Types:
    """The words that are no names, as sorted hashes, and those of them that are units."""

    common: np.ndarray
    units: np.ndarray


def learn_types(texts: DataFrame, text: str, common: float = COMMON, least: int = LEAST) -> Types:
    """Counts over all texts: occurrences of each word, and those right after a number. Combined on the map side."""
    low = F.lower(F.col(text).cast("string"))
    every = texts.select(F.explode(F.regexp_extract_all(low, F.lit(WORD), F.lit(0))).alias("w")).select(F.xxhash64("w").alias("h"), F.lit(0).alias("unit"))
    after = texts.select(F.explode(F.regexp_extract_all(low, F.lit(r"\p{N}\s?(\p{L}+)"), F.lit(1))).alias("w")).select(F.xxhash64("w").alias("h"), F.lit(1).alias("unit"))
    counts = Scratch(texts.sparkSession).stage(every.unionByName(after).groupBy("h").agg(F.count_if(F.col("unit") == 0).alias("n"), F.count_if(F.col("unit") == 1).alias("u")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    kept = counts.where((F.col("n") >= least) & (F.col("n") >= common * total)).select("h", (F.col("u") >= F.col("n") * 0.5).alias("unit"))
    rows = [(r["h"], r["unit"]) for r in kept.toLocalIterator()]  # at most 1 / common words
    as_hashes = lambda xs: np.sort(np.array(xs, dtype=np.int64).view(np.uint64))
    return Types(as_hashes([h for h, _ in rows]), as_hashes([h for h, unit in rows if unit]))


class Coder:
    """Words to hashes and placeholders; one for each task."""

    def __init__(self, types: Types):
        self.types = types
        self.known: dict[str, tuple[str, int, int, int]] = {}

    def word(self, w: str) -> tuple[str, int, int, int]:
        """(lower case, hash, hash of the template or NUMBER, whether digits are part of it)."""
        got = self.known.get(w)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            low = w.lower()
            h = t = xxhash.xxh64_intdigest(low, SEED)
            digits = 0
            if _DIGITS.search(low):
                digits, bare = 1, _DIGITS.sub("0", low)
                t = NUMBER if bare == "0" else xxhash.xxh64_intdigest(bare, SEED)
            got = self.known[w] = (low, h, t, digits)
        return got

    def coded(self, texts: list[str | None], fold: bool) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lower-case words, hashes, templates, slots, first word of each text), the texts WORDS apart."""
        words, starts = [], []
        gap = [("", 0, 0, 0)] * WORDS  # no window reaches into the next text
        for text in texts:
            starts.append(len(words))
            if not text:
                continue
            found = words_of(folded(text) if fold else text)
            if len(found) >= WORDS:
                words += map(self.word, found)
                words += gap
        ids = np.array([w[1] for w in words], dtype=np.uint64)
        templates = np.array([w[2] for w in words], dtype=np.uint64)
        digits = np.array([w[3] for w in words], dtype=bool)
        plain = ~digits & (ids != 0)
        templates[plain & ~_member(ids, self.types.common)] = NAME
        templates[plain & _member(ids, self.types.units)] = UNIT
        slots = (templates <= UNIT) | digits
        return [w[0] for w in words], ids, templates, slots, np.array(starts)


_WINDOW = "row long, id {}, stream int, at int, t long, s long, fixed int, words string, slots string"


def _windows(batches: Iterator[pa.RecordBatch], types: Types, streams: tuple[bool, ...], keep: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Windows of (row, id, text) rows; of those that pass the filter `keep`, if there is one.

    A window has its place, the hashes of its template and of its words, the number of words that are no slots, the
    words, and for reworded passages a mark for each word: 1 where it is a slot.
    """
    coder = Coder(types)
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            texts = part.column(2).to_pylist()
            for stream, fold in enumerate(streams):
                words, ids, templates, slots, starts = coder.coded(texts, fold)
                if len(words) < WORDS:
                    continue
                t = window_hashes(templates)
                ok = np.convolve(ids != 0, np.ones(WORDS, dtype=np.int64), "valid") == WORDS
                fixed = np.convolve(~slots, np.ones(WORDS, dtype=np.int64), "valid")
                if keep is not None:
                    low = (t % np.uint64(FILTER_BITS)).astype(np.int64)
                    ok &= (keep[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                row = np.searchsorted(starts, at, side="right") - 1
                s = window_hashes(ids)[at]
                marks = ["".join("1" if x else "0" for x in slots[i : i + WORDS].tolist()) if stream else None for i in at.tolist()]
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(taken), part.column(1).take(taken), pa.array(np.full(len(at), stream, np.int32)), pa.array((at - starts[row]).astype(np.int32)), pa.array(t[at].view(np.int64)), pa.array(s.view(np.int64)),
                     pa.array(fixed[at].astype(np.int32)), pa.array([" ".join(words[i : i + WORDS]) for i in at.tolist()]), pa.array(marks, pa.string())],
                    names=["row", "id", "stream", "at", "t", "s", "fixed", "words", "slots"],
                )


def _filter(windows: DataFrame) -> np.ndarray:
    """The fixed-size filter: one bit for each template hash. At most FILTER_BITS / 64 rows reach the driver."""
    low = F.pmod(F.col("t"), F.lit(FILTER_BITS))  # FILTER_BITS divides 2^64, so signed and unsigned agree
    bits = windows.select(F.shiftright(low, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (low % 64).cast("int")).alias("bit"))
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.view(np.uint8)


def leaks(docs: DataFrame, items: DataFrame, reworded: bool = False, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", common: float = COMMON, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, kind[, words]): documents that hold ten consecutive words of an item (`exact`) or, if asked for,
    an item or a part of it with its numbers, names and units replaced consistently (`reworded`); words, given with
    these, is the number of words in the longest such run, and 10, the least, for exact ones.

    Words are lower-cased runs of letters and digits. Null, empty and short texts leak nothing; repeated documents
    count one by one; an item with several rows under one id counts once per document. Items under ten words can't
    share ten. Null keys of items are no items. Empty tables give no rows. Other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    doc_type, item_type = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    both = docs.select(F.col(text).cast("string").alias("t")).unionByName(items.select(F.col(text).cast("string").alias("t")))
    types = spark.sparkContext.broadcast(learn_types(both, "t", common, least))
    streams = (False, True) if reworded else (False,)
    asked = items.where(F.col(item_key).isNotNull() & F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(item_key).alias("id"), F.col(text).cast("string").alias("t"))
    theirs = scratch.stage(asked.mapInArrow(lambda b: _windows(b, types.value, streams, None), _WINDOW.format(item_type)))
    if reworded:  # an item without any strong window takes part with all of them, and needs them all
        item = Window.partitionBy("id", "row", "stream")
        weak = F.max("fixed").over(item) < FIXED
        needs = theirs.withColumn("weak", weak).withColumn("least", F.when(weak, F.count(F.lit(1)).over(item)).otherwise(1))
        theirs = scratch.stage(needs.where((F.col("stream") == 0) | (F.col("fixed") >= FIXED) | F.col("weak")))
    keep = spark.sparkContext.broadcast(_filter(theirs))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_key).alias("id"), F.col(text).cast("string").alias("t"))
    mine = rows.mapInArrow(lambda b: _windows(b, types.value, streams, keep.value), _WINDOW.format(doc_type))
    if reworded:
        mine = scratch.stage(mine)
    # equal templates and equal slots: the same ten words
    exact_items = theirs.where("stream = 0").select(F.col("id").alias("item_id"), "t", "s", F.col("words").alias("w")).distinct()
    exact = mine.where("stream = 0").select("row", F.col("id").alias("doc_id"), "t", "s", "words").join(small(exact_items), ["t", "s"]).where("words = w")
    exact = exact.select("row", "doc_id", "item_id").distinct().select("doc_id", "item_id", F.lit("exact").alias("kind"))
    if not reworded:
        return exact
    return exact.withColumn("words", F.lit(WORDS)).unionByName(_reworded(mine, theirs))


def _reworded(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Runs of windows with equal templates along one diagonal; slots are judged over the whole run."""
    x = mine.where("stream = 1").select("row", F.col("id").alias("doc_id"), "at", "t", F.split("words", " ").alias("mine"))
    y = theirs.where("stream = 1").select(F.col("id").alias("item_id"), F.col("row").alias("item_row"), F.col("at").alias("where"), "t", F.split("words", " ").alias("theirs"), "slots", "least")
    met = x.join(small(y), "t")
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.lit(WORDS)), lambda k: F.when(F.substring("slots", k, 1) == "1", F.struct(F.element_at("theirs", k).alias("a"), F.element_at("mine", k).alias("b")))), lambda p: p.isNotNull())
    line = Window.partitionBy("row", "item_id", "item_row", "shift").orderBy("at")
    on_line = met.select("row", "doc_id", "item_id", "item_row", "at", "least", (F.col("at") - F.col("where")).alias("shift"), pairs.alias("pairs"))
    runs = on_line.withColumn("run", F.col("at") - F.row_number().over(line))
    whole = runs.groupBy("row", "doc_id", "item_id", "item_row", "shift", "run").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    a, b = F.array_distinct(F.transform("pairs", lambda p: p["a"])), F.array_distinct(F.transform("pairs", lambda p: p["b"]))
    one_to_one = (F.size(a) == F.size("pairs")) & (F.size(b) == F.size("pairs")) & F.exists("pairs", lambda p: p["a"] != p["b"])
    best = whole.where(one_to_one & (F.col("n") >= F.col("least"))).groupBy("row", "doc_id", "item_id").agg((F.max("n") + WORDS - 1).cast("int").alias("words"))
    return best.select("doc_id", "item_id", F.lit("reworded").alias("kind"), "words")
