"""Best-fit packing of tokenised documents by bin completion with branch and bound.

A document is its token ids and a final separator. Only one longer than a sequence is cut: its last
pieces are whole sequences, its first piece the rest. What is packed is then described fully by how
many pieces there are of each length, a histogram of at most ``capacity`` rows whatever the input.

The search runs on this histogram. Around the largest length left it enumerates the fillings of a bin,
drops the dominated ones, and branches over the rest: each filling for as many bins as the counts
allow, and for one bin only, so that all mixes are reached. A partial plan is dropped when its bins and
a bound on the rest, by the waste that the larger pieces force, reach the incumbent. Incumbents are
best-fit solutions: of the whole, and of what each partial plan leaves.

Limits, as parameters: ``nodes`` partial plans, ``each`` steps in the search for the fillings of one of
them, and ``work`` steps in all. With None for all three the search is exact, and its time has no bound
but the number of plans. Where a limit cuts the search short the least incumbent stands, never worse
than best fit; ``plan_bins`` says whether it is known to be least.

Pieces get their place by their rank within their length, which is counted by salts, whose number
follows the count of a length: a length that a third of all documents share is dealt over many tasks.

Defined results: a null or empty text is the separator alone; a very long text is cut as above; a null
doc_id is packed and stays null; pieces of one length are taken by doc_id, then piece, then checksum, and
rows that tie in all three are alike; repeated rows are packed each; an empty table gives no rows; extra
columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkforge.llm import bpe
from linkforge.llm.common import cut, join_small, pieces, text_or_empty

Plan = list[tuple[tuple[tuple[int, int], ...], int]]  # (((length, times), ...), bins)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Partial plans, steps for one and in all, pieces of a length in one salt, rows that may be broadcast.
NODES, EACH, WORK, SALT, SMALL = 20_000, 2_000, 200_000, 2_000, 300_000


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised(docs: DataFrame, id_col: str, text_col: str, capacity: int, separator: int, vocabulary: str) -> DataFrame:
    """A row for each piece: its place in the document, its length and the checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(vocabulary).encode_to_numpy
        for batch in pieces(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py(), allowed_special="all"), separator).astype("<u4")
                out += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(pieces_of(len(ids), capacity))]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, PIECES)


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram; bins that look alike are handled together."""
    open_bins: dict[int, dict[tuple, int]] = {}  # room -> filling -> bins
    closed: dict[tuple, int] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = min((r for r in open_bins if r >= length), default=None)
            if room is None:
                filling, bins = (), max(1, left // max(1, capacity // length))
                room = capacity
            else:
                filling, bins = open_bins[room].popitem()
                if not open_bins[room]:
                    del open_bins[room]
            each = min(room // length, left)
            used = max(1, min(bins, left // each))
            if bins > used and (filling or room < capacity):
                open_bins.setdefault(room, {})[filling] = bins - used
            left -= used * each
            new, rest = (*filling, (length, each)), room - each * length
            into = open_bins.setdefault(rest, {}) if rest else closed
            into[new] = into.get(new, 0) + used
    for fillings in open_bins.values():
        for filling, bins in fillings.items():
            closed[filling] = closed.get(filling, 0) + bins
    return list(closed.items())


def dominated(filling: dict[int, int], first: int, counts: dict[int, int], waste: int) -> bool:
    """Whether a longer piece that is left over could stand in for some pieces beside the first, or fill the waste.

    Such a swap leaves pieces that are smaller and fit wherever the longer one did. Larger swaps are
    made of these.
    """
    one, more = 0, 0  # sums of one piece beside the first, of two or more, as bits
    for n, times in filling.items():
        for _ in range(times - (n == first)):
            more |= (more | one) << n
            one |= 1 << n
    for x, held in counts.items():
        if held > filling.get(x, 0):
            low = max(0, x - waste)
            shorter = ((one | more | 1) >> low) & ((1 << (x - low)) - 1)  # sums from low to x - 1
            if shorter or more >> x & 1:
                return True
    return False


def completions(first: int, lengths: list[int], counts: dict[int, int], capacity: int, steps: int | None) -> tuple[list[dict[int, int]], int]:
    """Undominated fillings of a bin around one piece of length ``first``, least waste first, and the steps taken.

    After ``steps`` only the fillings found so far come, and one at least.
    """
    taken = 0
    found: list[tuple[int, dict[int, int]]] = []
    stack: list[tuple[int, int, tuple]] = [(0, capacity - first, ())]
    while stack:
        k, room, chosen = stack.pop()
        while k < len(lengths) and lengths[k] > room:
            k += 1
        taken += 1
        if k == len(lengths) or not room:
            filling = {first: 1}
            for n, times in chosen:
                filling[n] = filling.get(n, 0) + times
            if not dominated(filling, first, counts, room):
                found.append((room, filling))
            if steps is not None and taken >= steps and found:
                break
            continue
        n = lengths[k]
        most = min(counts[n] - (n == first), room // n)
        stack += [(k + 1, room - times * n, (*chosen, (n, times)) if times else chosen) for times in range(most + 1)]  # the most first
    return [f for _, f in sorted(found, key=lambda x: x[0])], taken


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: pieces over half a bin are alone; the larger ones leave room that pieces of at least some length cannot use."""
    n = np.array(sorted(counts), np.int64)
    c = np.array([counts[k] for k in n.tolist()], np.int64)
    if not len(n):
        return 0
    number, tokens = np.r_[0, np.cumsum(c)], np.r_[0, np.cumsum(n * c)]
    half = int(np.searchsorted(n, capacity // 2, "right"))  # the first length over half a bin
    alpha = np.r_[0, n[:half]]
    low, high = np.searchsorted(n, alpha, "left"), np.searchsorted(n, capacity - alpha, "right")
    alone = number[-1] - number[high]
    middle, in_middle = number[high] - number[half], tokens[high] - tokens[half]
    small = tokens[half] - tokens[low]
    return int((alone + middle + np.maximum(0, -(-(small - (middle * capacity - in_middle)) // capacity))).max())


def plan_bins(histogram: dict[int, int], capacity: int, nodes: int | None = NODES, each: int | None = EACH, work: int | None = WORK) -> tuple[Plan, bool]:
    """Fillings and how many bins take each, for all pieces of the histogram; and whether no plan has fewer bins for sure."""
    histogram = {n: c for n, c in histogram.items() if c > 0}
    size = lambda plan: sum(bins for _, bins in plan)
    incumbent, least = best_fit(histogram, capacity), least_bins(histogram, capacity)
    most = size(incumbent)
    stack: list[tuple[dict[int, int], Plan, int]] = [(histogram, [], 0)]
    visited = steps = 0
    whole = True
    while stack and most > least:
        if (nodes is not None and visited >= nodes) or (work is not None and steps >= work):
            return incumbent, False
        counts, plan, bins = stack.pop()
        if bins + least_bins(counts, capacity) >= most:
            continue
        visited += 1
        if plan:
            rest = best_fit(counts, capacity)
            if bins + size(rest) < most:
                incumbent, most = [*plan, *rest], bins + size(rest)
        if not counts:
            continue
        lengths = sorted(counts, reverse=True)
        fillings, taken = completions(lengths[0], lengths, counts, capacity, each)
        steps += len(lengths) + taken
        whole = whole and (each is None or taken < each)
        children = []
        for filling in fillings:
            most_often = min(counts[n] // k for n, k in filling.items())
            for times in dict.fromkeys((most_often, 1)):
                left = {n: c - filling.get(n, 0) * times for n, c in counts.items() if c > filling.get(n, 0) * times}
                children.append((left, [*plan, (tuple(sorted(filling.items(), reverse=True)), times)], bins + times))
        stack += children[::-1]
    return incumbent, whole or most <= least


def pack(docs: DataFrame, capacity: int = 2048, separator: int = 0, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", nodes: int | None = NODES, each: int | None = EACH, work: int | None = WORK) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    found = cut(tokenised(docs, id_col, text_col, capacity, separator, vocabulary or bpe.default_vocabulary()))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    salts = spark.createDataFrame([(n, -(-c // SALT)) for n, c in counts.items()], "length long, salts long")
    salted = found.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts")
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    whole = counts.pop(capacity, 0)
    slots, sequence, seen = [], whole, {}
    if whole:
        slots.append((capacity, 0, whole, 1, 0, 0))
    for filling, bins in plan_bins(counts, capacity, nodes, each, work)[0]:
        offset = 0
        for length, times in filling:
            first = seen.get(length, 0)
            slots.append((length, first, first + bins * times, times, sequence, offset))
            seen[length] = first + bins * times
            offset += times * length
        sequence += bins
    # Slots are bounded by the plan, not by the input: best fit and the search use up a length with each filling, or branch.
    slot = spark.createDataFrame(slots, "length long, first long, until long, times long, sequence long, base long")
    before = cut(by_salt.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = join_small(salted.withColumn("own", rank), before, ["length", "salt"], "inner", before.count(), SMALL)
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own") - 1)
    # The slots of a length are sorted and disjoint: the one that holds a rank is found by position.
    lists = slot.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "until", "times", "sequence", "base"))).alias("slots"))
    placed = ranked.join(F.broadcast(lists), "length").withColumn("slot", F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["until"]))[0])
    nth = F.col("rank") - F.col("slot.first")
    return placed.select(
        F.col("doc_id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("slot.sequence") + F.floor(nth / F.col("slot.times"))).cast("long").alias("sequence_id"),
        (F.col("slot.base") + (nth % F.col("slot.times")) * F.col("length")).cast("long").alias("offset"),
    )
