"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

Each pre-token starts as its bytes, held in a doubly linked list. A heap of adjacent pairs gives the
pair of lowest rank (leftmost among equals); popping it joins two symbols. The count is the bytes
minus the merges. Counts of pre-tokens are remembered in a cache of bounded size on each worker, so
a frequent word is merged once.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings inside a text count
as one token each; repeated rows each get their own row; extra columns are not read; a null doc_id stays.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm import bpe
from linkforge.llm.common import pieces, text_or_empty

CACHE_ENTRIES = 300_000
_caches: dict[str, dict[str, int]] = {}


def merged_count(word: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Symbols left of ``word`` when no adjacent pair has a rank."""
    n = len(word)
    if n < 2:
        return n
    after = list(range(1, n + 1))  # start of the next symbol; n: none
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get((word[i : i + 1], word[i + 1 : i + 2]))) is not None]
    heapq.heapify(heap)
    alive, left = bytearray(b"\1") * n, n
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if not alive[i] or j >= n or not alive[j] or after[i] != j or after[j] != end:
            continue  # one of the two was merged since
        alive[j], after[i] = 0, end
        left -= 1
        if end < n:
            before[end] = i
            if (r := ranks.get((word[i:end], word[end : after[end]]))) is not None:
                heapq.heappush(heap, (r, i, end, after[end]))
        if (p := before[i]) >= 0 and (r := ranks.get((word[p:i], word[i:end]))) is not None:
            heapq.heappush(heap, (r, p, i, end))
    return left


class Counts(dict):
    """Pre-token -> count, computed on the first look and forgotten when full."""

    def __init__(self, ranks: dict, entries: int = CACHE_ENTRIES):
        self.ranks, self.entries = ranks, entries

    def __missing__(self, token: str) -> int:
        n = merged_count(token.encode(), self.ranks)
        if len(token) <= 64:
            if len(self) >= self.entries:
                self.clear()
            self[token] = n
        return n


def count_text(text: str, path: str) -> int:
    """Tokens of one text."""
    counts = _caches.get(path) or _caches.setdefault(path, Counts(bpe.merges(path)[0]))
    words, special = bpe.splitter(path)
    total, parts = 0, [text]
    if special and special.search(text):
        parts = special.split(text)
        total = len(parts) - 1
    for part in parts:
        total += sum(map(counts.__getitem__, words.findall(part)))
    return total


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text. One pass, no shuffle."""
    path = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.compute.binary_length(texts).cast("int64"), pa.array((count_text(t.as_py(), path) for t in texts), pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
