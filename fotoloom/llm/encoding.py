"""Token ids of whole texts under a public byte-level BPE vocabulary.

A text is cut at line breaks before a visible character, where the vocabulary's own pattern always cuts too, so a line's
ids do not depend on its neighbours and lines met before in the same worker (revisions repeat most of theirs) are looked
up. New lines are split by the pattern, and each new word is merged over a segment tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters of lines and of words that a worker remembers at most; beyond, it starts afresh. Results do not depend on it.
REMEMBERED = 12_000_000
LONG_LINE = 2_000

#: White space as the vocabulary's pattern means it (the Unicode property, without the separators U+001C to U+001F).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LINES = re.compile(rf"\n(?=[^{_SPACE}])")
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def default_vocabulary() -> str:
    """byte_bpe_50k of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The word's ids: again and again the leftmost pair of least rank is joined.

    A segment tree over the byte positions holds in each node the least (rank, position) below it. Joining a pair changes
    three leaves (the pair at its place, the pair before, the place that vanishes); each change climbs to the root.
    """
    n = len(word)
    if n == 1:
        return [ranks[word]]
    width = 1 << (n - 1).bit_length()
    never = 1 << 62
    tree = [never] * (2 * width)
    start_of_next = list(range(1, n + 1))  # of the live token at a position: where the next begins
    before = list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        rank = get(word[i : i + 2])
        if rank is not None:
            tree[width + i] = rank * n + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    def pair(i: int) -> int:
        j = start_of_next[i]
        rank = get(word[i : start_of_next[j]]) if j < n else None
        return never if rank is None else rank * n + i

    while tree[1] < never:
        i = tree[1] % n
        gone = start_of_next[i]
        after = start_of_next[gone]
        start_of_next[i] = after
        if after < n:
            before[after] = i
        put(gone, never)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : start_of_next[i]]])
        i = start_of_next[i]
    return ids


class _Words(dict):
    """Words to the bytes of their ids (int32), filled on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.size = ranks, 0

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        rank = self.ranks.get(raw)  # a vocabulary entry is what its own bytes merge to
        ids = np.array([rank] if rank is not None else merge_word(raw, self.ranks), np.int32).tobytes()
        if self.size > REMEMBERED:
            self.clear()
            self.size = 0
        if len(word) <= LONG_LINE:
            self.size += len(word) + 16
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex

        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        pattern = public_tokenizers.PATTERN.replace(r"(?!\S)", rf"(?![^{_SPACE}])").replace(r"[^\s", rf"[^{_SPACE}").replace(r"\s+", rf"[{_SPACE}]+")
        self._split = regex.compile(pattern).findall
        self._split_ascii = _ASCII_WORDS.findall
        self._words = _Words(self.ranks)
        self._lines: dict[str, bytes] = {}
        self._size = 0

    def _line(self, line: str) -> bytes:
        words = (self._split_ascii if line.isascii() else self._split)(line)
        ids = b"".join(map(self._words.__getitem__, words))
        if len(line) <= LONG_LINE:
            if self._size > REMEMBERED:
                self._lines.clear()
                self._size = 0
            self._lines[line] = ids
            self._size += len(line)
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a whole text as little-endian int32."""
        if not text:
            return b""
        lines = _LINES.split(text)
        known, new = self._lines.get, self._line
        out = [known(lines[0]) or new(lines[0])] if lines[0] else []
        for line in lines[1:]:
            line = "\n" + line
            out.append(known(line) or new(line))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), np.int32).tolist()


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One to a worker process."""
    return Encoder(vocabulary)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode_corpus(documents: DataFrame, doc_id: str, text: str, vocabulary: str | None = None, out: str = "ids") -> DataFrame:
    """`doc_id` and the ids of each whole text, without special tokens; their strings in a text are ordinary text.

    Defined results: null and empty texts give an empty list; white space is encoded as it stands; repeated rows are each
    encoded; rows with a null id are kept; an empty table stays empty; other columns are ignored. Nothing is shuffled.
    """
    vocabulary = vocabulary or default_vocabulary()
    slim = documents.select(documents[doc_id].alias("_id"), documents[text].alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                each = [enc.encode_bytes(t) for t in _texts(part.column(1))]
                offsets = np.zeros(len(each) + 1, np.int64)
                np.cumsum([len(x) // 4 for x in each], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(each), np.int32))
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[doc_id, out])

    schema = T.StructType([T.StructField(doc_id, slim.schema["_id"].dataType), T.StructField(out, T.ArrayType(T.IntegerType()))])
    return slim.mapInArrow(encode, schema)


def token_counts(documents: DataFrame, doc_id: str, text: str, *keep: str, vocabulary: str | None = None, out: str = "tokens") -> DataFrame:
    """`doc_id`, the columns to keep and the number of ids of each whole text; 0 for null and empty ones."""
    vocabulary = vocabulary or default_vocabulary()
    names = [doc_id, *keep]
    slim = documents.select(*(documents[c] for c in names), documents[text].alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            sizes = np.array([len(enc.encode_bytes(t)) // 4 for t in _texts(batch.column(len(names)))], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes)], names=[*names, out])

    schema = T.StructType([*(slim.schema[c] for c in names), T.StructField(out, T.LongType())])
    return slim.mapInArrow(count, schema)
