"""Line dedup by overlapping three-line windows, then by overlapping windows of 51 words.

Every run of three consecutive lines that are not blank is hashed (128 bits). A window that occurs
again, in any document, is kept where it occurs first (least doc_id, then place) and covered
elsewhere; covered windows are merged, blank lines inside them too, and the lines that they cover go.

What the lines leave is searched for passages that lie in one or two lines, or that start or end inside
a line: a window of 51 words that an earlier document holds as well (least doc_id; white space is not
compared) is covered, covered windows are merged, and their words go, each with the white space before
it. The document that holds a passage first keeps all of it; repeats within a document are no passages.
Windows are not hashed for all texts: each stands for the least hash of its 8-word shingles, a function
of the window, so only windows whose least hash another document has too can repeat; few texts are
read again for them, and nothing is missed.

Counts are combined before they are shuffled, and the joins back to the windows and texts may be split
by the optimiser, so a window that a third of all documents hold does not meet in one task.

Defined results: a null text stays null; an empty text and one of fewer than three lines that are
not blank, or 51 words, stay as they are; rows that repeat a doc_id and its text are one occurrence; rows
of a null doc_id come first in order; ties of place cannot be, for equal rows are one; a very long text
makes one row for each window; an empty table gives no rows; other columns are handed through, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from linkforge.llm.common import cut, join_small, pieces, scratch, stored, text_or_empty
from linkforge.llm.shingles import runs, word_hashes

WINDOW = 3
#: Words of the shortest passage.
PASSAGE = 51
#: Bytes of short texts that are hashed together.
BLOCK = 500_000
#: Lists are broadcast up to this many rows, ids of documents alone up to so many.
SMALL, IDS = 300_000, 2_000_000
WORD = re.compile(r"[^ \t-\r]+")
#: A line of these alone is blank.
BLANK = " \t\r\v\f"


def windows(text: str, width: int = WINDOW) -> list[tuple[int, int, bytes]]:
    """(first line, last line, hash) of each window; lines from 0."""
    lines = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip(BLANK)]
    out = []
    for k in range(len(lines) - width + 1):
        run = lines[k : k + width]
        out.append((run[0][0], run[-1][0], xxhash.xxh3_128_digest("\n".join(x for _, x in run).encode())))
    return out


def _windows(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[tuple] = []
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                out += [(doc, mark, a, b, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)) for a, b, h in windows(text.as_py(), width)]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "mark", "first", "last", "h1", "h2"])

    return docs.mapInArrow(run, "id long, mark long, first int, last int, h1 long, h2 long")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(id, mark, covered): the lines, from 0, that later occurrences of windows cover; ``mark`` is xxhash64 of the text."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    place = F.struct("id", "mark", "first")
    with scratch(docs.sparkSession) as within:
        found = stored(_windows(rows.where("instr(text, '\n') > 0"), width), within)
        often = cut(found.groupBy("h1", "h2").agg(F.count("*").alias("times")).where("times > 1").select("h1", "h2"))
        many = often.count()
        met = stored(join_small(found, often, ["h1", "h2"], "inner", many, SMALL), within)
        least = met.groupBy("h1", "h2").agg(F.min(place).alias("least"))
        later = join_small(met, least, ["h1", "h2"], "inner", many, SMALL).where(F.col("least") != place)
        return cut(
            later.select("id", "mark", F.explode(F.sequence("first", "last")).alias("line"))
            .groupBy("id", "mark")
            .agg(F.sort_array(F.collect_set("line")).alias("covered"))
        )


def least_hashes(hashes: np.ndarray, words: int = PASSAGE) -> np.ndarray:
    """For each window of ``words`` the least hash of its shingles of a sixth of them."""
    if len(hashes) < words:
        return np.empty(0, np.uint64)
    shingle = max(1, words // 6)
    least, have, want = runs(hashes, shingle), 1, words - shingle + 1
    while have < want:
        step = min(have, want - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    return least


def _runs_of(texts: pa.Array, words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each run of a text's windows that share a sign: number of the text, place, windows, sign and its first word among ``hashes``, which come last; for many short texts or a long one at a time."""
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, BLOCK + (ends[at - 1] if at else 0), "right")))
        hashes, begin = word_hashes(texts.slice(at, upto - at))
        if len(hashes) >= words:
            sign = least_hashes(hashes, words)
            owner = np.repeat(np.arange(upto - at), np.diff(begin))
            whole = owner[: len(sign)] == owner[words - 1 :]
            owner = owner[: len(sign)]
            change = np.flatnonzero((sign[1:] != sign[:-1]) | (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1])) + 1
            first = np.append(0, change)
            many, first = (x[whole[first]] for x in (np.diff(np.append(first, len(sign))), first))
            yield owner[first] + at, first - begin[owner[first]], many, sign[first].view(np.int64), first, hashes
        at = upto


def _signs(texts: DataFrame, words: int) -> DataFrame:
    """(doc, sign): the least hashes of each text's windows, one for each run of windows that share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for owner, _, _, sign, _, _ in _runs_of(batch.column(1), words):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(sign)], ["doc", "sign"])

    return texts.mapInArrow(run, "doc long, sign long")


def _passages(texts: DataFrame, words: int) -> DataFrame:
    """(id, mark, sign, at, hashes): runs of windows of one sign that is among the text's ``signs``; places in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            known = np.unique(batch.column(3).flatten().to_numpy())  # all held by two texts at least, so any text's will do
            for owner, place, many, sign, first, hashes in _runs_of(batch.column(2), words):
                kept = np.flatnonzero(np.isin(sign, known))
                owner, place, many, sign, first = owner[kept], place[kept], many[kept], sign[kept], first[kept]
                ends = np.cumsum(many)
                own = runs(hashes, words)[np.arange(many.sum()) + np.repeat(first - ends + many, many)].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(own))
                whose = pa.array(owner)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(whose), batch.column(1).take(whose), pa.array(sign), pa.array(place, pa.int32()), lists], ["id", "mark", "sign", "at", "hashes"])

    return texts.mapInArrow(run, "id long, mark long, sign long, at int, hashes array<long>")


def repeated_passages(texts: DataFrame, words: int = PASSAGE) -> DataFrame:
    """(id, mark, starts) from (id, mark, text): places, in words, of windows that an earlier document holds too. Reads ``texts`` twice.

    Equal runs of windows are one class before their windows are told apart. Lists are gathered from plain
    rows, for a list of one is larger than its row; each is bounded by its text or run.
    """
    doc = F.xxhash64("id", "mark").alias("doc")
    with scratch(texts.sparkSession) as within:
        signs = stored(_signs(texts.select(doc, "text"), words), within)
        met = cut(signs.groupBy("sign").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("sign"))
        own = join_small(signs, met, ["sign"], "inner", met.count(), SMALL)
        lists = cut(own.repartition("doc").groupBy("doc").agg(F.collect_set("sign").alias("signs")))
        few = join_small(texts.select("id", "mark", "text", doc), lists.select("doc"), ["doc"], "left_semi", lists.count(), IDS)
        found = stored(_passages(few.join(lists, "doc").select("id", "mark", "text", "signs"), words), within).withColumn("class", F.xxhash64("hashes"))
        holder = F.struct("id", "mark")
        classes = cut(found.groupBy("sign", "class").agg(F.min(holder).alias("least"), F.count("*").alias("times"), F.max("hashes").alias("hashes")))
        windows = classes.select("sign", "class", "least", "times", F.posexplode("hashes").alias("k", "hash"))
        first = windows.groupBy("sign", "hash").agg(F.min("least").alias("first"), F.sum("times").alias("times")).where("times > 1").select("sign", "hash", "first")
        owned = windows.select("sign", "class", "k", "hash").join(first, ["sign", "hash"]).select("sign", "class", "k", "first").repartition("sign", "class").groupBy("sign", "class").agg(F.collect_list(F.struct("k", "first")).alias("owned"))
        later = F.filter("owned", lambda x: x["first"] != F.struct("id", "mark"))
        starts = found.drop("hashes").join(owned, ["sign", "class"]).select("id", "mark", F.transform(later, lambda x: x["k"] + F.col("at")).alias("starts"))
        return cut(starts.where(F.size("starts") > 0).groupBy("id", "mark").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")))


def without(text: str, starts: list[int], words: int = PASSAGE) -> tuple[str, int]:
    """``text`` without the windows of words that begin at ``starts``, and how many words went."""
    gone = {k for i in starts for k in range(i, i + words)}
    out, end = [], 0
    for k, m in enumerate(WORD.finditer(text)):
        if k not in gone:
            out.append(text[end : m.end()])
        end = m.end()
    return "".join(out) + text[end:], len(gone)


def _without(text: Column, starts: Column, words: int) -> Column:
    @pandas_udf("text string, words long")
    def run(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([without(t, list(x), words) for t, x in zip(texts, lists, strict=True)], columns=["text", "words"])

    return run.asNondeterministic()(text, starts)  # else a filter on what it returns runs it again, by further workers


def _parted(rows: DataFrame, lists: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The rows (id, mark, ...) that have no list, and those that have one with its ``column``.

    Rows are told apart by broadcast ids first, so that only rows with a list are shuffled, if any. Of
    more ids than may be broadcast all rows are shuffled, once, and kept with their lists.
    """
    n, doc = lists.count(), F.xxhash64("id", "mark").alias("doc")
    own = lists.select(F.col("id").alias("of"), F.col("mark").alias("as"), column)
    own = F.broadcast(own) if n <= SMALL else own
    beside = lambda df: df.join(own, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("as")), "left").drop("doc", "of", "as")
    if n > IDS:
        both = stored(beside(rows.select("*", doc)))
        return both.where(F.col(column).isNull()).drop(column), both.where(F.col(column).isNotNull())
    keyed, of = rows.select("*", doc), F.broadcast(lists.select(doc))
    return keyed.join(of, "doc", "left_anti").drop("doc"), beside(keyed.join(of, "doc", "left_semi"))


def _line_cut(rows: DataFrame, covered: DataFrame) -> DataFrame:
    """``rows`` (id, mark, text, ...) with their covered lines (empty: none) and what is left of their texts."""
    same, hit = _parted(rows, covered, "covered")
    none = F.array().cast("array<int>")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    text = F.when(F.col("covered").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
    hit = stored(hit.withColumn("lines", lines).withColumn("text", text).withColumn("covered", F.coalesce("covered", none)).drop("lines"))
    return same.withColumn("covered", none).unionByName(hit)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, removed_col: str | None = None, words: int | None = PASSAGE, words_col: str | None = None) -> DataFrame:
    """``docs`` with the text cut; ``words`` None: by lines alone.

    With ``removed_col`` also the covered lines (empty: none), with ``words_col`` the number of words that
    went as passages, each replacing a column of that name.
    """
    columns = docs.columns
    fields = [docs[c].alias(f"c{i}") for i, c in enumerate(columns) if c != text_col]
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("mark"), docs[text_col].cast("string").alias("text"), *fields)
    rest = _line_cut(rows, repeated_lines(docs, id_col, text_col, width))
    none = F.lit(0).cast("long")
    if words is None:
        rest = rest.withColumn("went", none)
    else:
        passages = repeated_passages(rest.where(F.length("text") >= 2 * words - 1).select("id", "mark", "text"), words)
        same, hit = _parted(rest, passages, "starts")
        after = hit.withColumn("after", _without(F.col("text"), F.coalesce("starts", F.array().cast("array<int>")), words))
        rest = same.withColumn("went", none).unionByName(after.withColumn("text", F.col("after.text")).withColumn("went", F.col("after.words")).drop("starts", "after"))
    out = []
    for i, c in enumerate(columns):
        if c not in (removed_col, words_col):
            out.append((F.col("text") if c == text_col else F.col(f"c{i}")).alias(c))
    if removed_col:
        out.append(F.col("covered").alias(removed_col))
    if words_col:
        out.append(F.col("went").alias(words_col))
    return rest.select(*out)
