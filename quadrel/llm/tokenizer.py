"""Encoding with a public byte-level BPE vocabulary.

Per pre-token, an Aho-Corasick pass finds the longest token from every position. The encoder takes the longest one,
keeps it if it may stand next to the token before (a pair may stand together if merging would never have crossed the
cut between them), else tries the token's next shorter prefix, else steps back. Every position fails at most once, so
time is linear, and the result equals that of running the merges. Decoding cuts token bytes out of one blob by an
offset table.

The vocabulary file (50k tokens, 1.6 MB, a fixed size) is read once on the driver and broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of the vocabulary (fixed value).
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Pre-tokens, and pairs of tokens, that a worker remembers before it starts afresh; a matter of speed only.
REMEMBERED = 300_000


def _alphabet() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class BytePairEncoder:
    def __init__(self, raw: str):
        """raw: the JSON text of the vocabulary file. Its special tokens take no part in encoding."""
        model = json.loads(raw)["model"]
        byte_of = _alphabet()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocabulary = model["vocab"]
        self.tokens: dict[int, bytes] = {}
        for text, number in vocabulary.items():
            if all(c in byte_of for c in text):
                self.tokens[number] = bytes(byte_of[c] for c in text)
        # a token's age is the turn of its merge; single bytes are older than all merges
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.age: dict[int, int] = {}
        for turn, (left, right) in enumerate(merges):
            whole = vocabulary[left + right]
            pair = vocabulary[left], vocabulary[right]
            self.joined[pair] = whole
            if whole not in self.age:
                self.age[whole], self.halves[whole] = turn, pair
        reachable = {i: t for i, t in self.tokens.items() if len(t) == 1 or i in self.age}
        ids = {t: i for i, t in reachable.items()}
        self.size = {i: len(t) for i, t in reachable.items()}
        self.shorter: dict[int, int | None] = {}
        self.trie = ahocorasick.Automaton()
        for i, t in reachable.items():
            self.shorter[i] = next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), None)
            self.trie.add_word(t.decode("latin-1"), (len(t), i))
        self.trie.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.cut = regex.compile(PRETOKEN).findall
        self.known: dict[str, tuple[int, ...]] = {}
        top = max(self.tokens) + 1
        lengths = np.array([len(self.tokens.get(i, b"")) for i in range(top)])
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = b"".join(self.tokens.get(i, b"") for i in range(top))

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both would have left a cut between them.

        The cut is crossed by the first merge, in order of age, of a suffix part of `left` and a prefix part of
        `right` that exist at that time. So walk down both along the cut, the younger part first: a part is there
        until the merge that consumed it into its parent.
        """
        pair = left, right
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) >= REMEMBERED:
                self.compatible.clear()
            known = self.compatible[pair] = self._cut_survives(left, right)
        return known

    def _cut_survives(self, left: int, right: int) -> bool:
        age = self.age
        gone_left = gone_right = len(age) + 1  # the turn at which the part was consumed by its parent
        while True:
            whole = self.joined.get((left, right))
            if whole is not None:
                turn = age[whole]
                # the left parent's merge of the same turn comes first (merges run from left to right), the right one's after
                if turn < gone_left and turn <= gone_right:
                    return False
            born_left, born_right = age.get(left, -1), age.get(right, -1)
            if born_left < 0 and born_right < 0:
                return True
            if born_left > born_right:
                gone_left, left = born_left, self.halves[left][1]
            else:
                gone_right, right = born_right, self.halves[right][0]

    def piece(self, text: str) -> tuple[int, ...]:
        """The tokens of one pre-token."""
        data = text.encode("utf-8").decode("latin-1")
        end = len(data)
        longest: list[int] = [-1] * end
        length = [0] * end
        for last, (size, token) in self.trie.iter(data):
            start = last - size + 1
            if size > length[start]:
                length[start], longest[start] = size, token
        size, shorter, may_follow = self.size, self.shorter, self.may_follow
        open_at = bytearray(b"\x01") * (end + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            stop = at + size[token]
            if open_at[stop] and (not out or may_follow(out[-1], token)):
                out.append(token)
                if stop == end:
                    return tuple(out)
                at, token = stop, longest[stop]
                continue
            less = shorter[token]
            while less is None:  # nothing fits here: close the position and shorten the token before
                open_at[at] = 0
                token = out.pop()
                at -= size[token]
                less = shorter[token]
            token = less

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for part in self.cut(text):
            ids = known.get(part)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = self.piece(part)
                if len(part) <= 64:
                    known[part] = ids
            out.extend(ids)
        return out

    def decode(self, ids) -> str:
        blob, offsets = self.blob, self.offsets
        return b"".join(blob[offsets[i] : offsets[i + 1]] for i in ids).decode("utf-8", errors="replace")


_BUILT: dict[int, BytePairEncoder] = {}


def _encoder(raw: str) -> BytePairEncoder:
    """One encoder per worker process."""
    key = hash(raw)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = BytePairEncoder(raw)
    return _BUILT[key]


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each row's text, without special tokens; empty and null texts give an empty list.

    Text that looks like a special token is ordinary text. Every row gives one row, repeated ones and null keys too.
    No shuffle: rows are encoded where they are read.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                lists = [encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<bigint>")


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, text): the text of each row's ids; a null list gives null, an empty one the empty text."""
    with open(vocabulary, encoding="utf-8") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoder(shared.value).decode
        for batch in batches:
            texts = [None if x is None else decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(F.col(key), F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")
