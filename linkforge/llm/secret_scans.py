"""Secret scans: credentials found by pattern, and weak candidates linked to their counterparts.

Only DataFrame functions. Patterns find three strong kinds (an assigned secret, an access
identifier, a long hex run) and three weak ones (a user or client identifier, a bare 40-character
secret, an endpoint). Positions come from the pieces between matches. A weak candidate alone is
noise; it is reported when a complementary part lies in its scope: an identifier near a secret, a
secret near an identifier or endpoint. The interval join of parts and scopes is a sort of the parts
of each document: the nearest complementary part before and after decides, so a document with many
parts makes no pairs. Both sides are running extremes, one in either order, and folds over the
matches of a text go block by block: a very long text with many parts costs little more than in
proportion to them.

Defined results: a null or empty text has no spans; repeated rows (same doc_id and text) get the same
result each; a null doc_id stays; an empty table gives no rows; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkforge.llm.common import cut, text_or_empty

#: The strong kinds, in the order that breaks ties; pattern, group and least length of what must be long enough.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak kinds. An identifier: a name given to a user or client; a secret: a run of just 40 characters of base64; an endpoint: a URL's scheme and host.
WEAK_ID = r"""(?:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
WEAK_SECRET = r"[A-Za-z0-9+/=]{40,}"
ENDPOINT = r"""[a-z][a-z0-9+.-]*://[^\x00-\x20"'<>/?#]+"""
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: Code points around a weak candidate in which a complementary part must start.
SCOPE = 256
MARK = "[SECRET]"
#: Items that a fold takes at once, and spans up to which redaction sends them to the texts rather than the texts to them.
BLOCK, SMALL = 128, 300_000


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _fold(items: Column, state: Column, kind: str, block) -> Column:
    """array<kind>: what ``block(state, items)`` -> struct(state, found) finds in one block of the items after the other.

    An array that grows by each item is copied each time; so it only grows within a block.
    """
    seed = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("found"))

    def step(acc: Column, own: Column) -> Column:
        return _bound(block(acc["state"], own), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["found"], F.array(r["found"])).alias("found")))

    def fold(all_: Column) -> Column:
        last = F.greatest(F.ceil(F.size(all_) / BLOCK) - 1, F.lit(0)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)))
        return F.flatten(F.aggregate(blocks, seed, step, lambda acc: acc["found"]))

    return _bound(items, fold)


SPAN = "struct<start:int,kind:int,until:int>"


def _spans(kind: int, text: Column, pattern: str, group: int = 0, least: int = 0, most: int = 2**31 - 1) -> Column:
    """array<struct<start, kind, until>> of the matches: lengths of the pieces between them, summed."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    lengths = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda p: F.length(p)).alias("gap"),
        F.transform(matches, lambda m: F.length(m)).alias("own"),
        F.transform(value, lambda v: F.length(v)).alias("value"),
    )
    empty = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["state"] + x["gap"]
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["own"]).alias("until")))
        keep = x["own"].isNotNull() & x["value"].between(least, most)
        return F.struct((start + F.coalesce(x["own"], F.lit(0))).alias("state"), F.concat(acc["found"], F.when(keep, span).otherwise(empty)).alias("found"))

    def block(at: Column, own: Column) -> Column:
        return F.aggregate(own, F.struct(at.alias("state"), empty.alias("found")), step)

    return F.when(F.regexp_like(text, F.lit(pattern)), _fold(lengths, F.lit(0), SPAN, block)).otherwise(empty)


def _joined(spans: Column) -> Column:
    """kind:start:end, comma-joined; spans are sorted by start, then kind."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["until"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, mark, base, linked): spans of strong kinds, and of weak candidates in whose scope a counterpart lies.

    One row for each row of ``docs``; ``mark`` is xxhash64 of the text. Spans are structs (start, kind, until).
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    t = F.col("text")
    parts = rows.select(
        "id",
        F.xxhash64(t).alias("mark"),
        F.array_sort(F.concat(_spans(0, t, ASSIGN, 2, 8), _spans(1, t, ACCESS), _spans(2, t, HEX))).alias("base"),
        F.concat(_spans(3, t, WEAK_ID), _spans(4, t, WEAK_SECRET, most=40), _spans(5, t, ENDPOINT)).alias("weak"),
    )
    parts = cut(parts)
    flat = parts.where("size(weak) > 0 and size(weak) + size(base) > 1").select("id", "mark", F.explode(F.concat("base", "weak")).alias("p")).select("id", "mark", "p.*").distinct()
    own, place = Window.partitionBy("id", "mark"), ("start", "kind", "until")
    up = own.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    down = own.orderBy(*map(F.desc, place)).rowsBetween(Window.unboundedPreceding, -1)  # what follows, as a running extreme too
    is_id, is_secret, is_end = F.col("kind").isin(1, 3), F.col("kind").isin(0, 2, 4), F.col("kind") == 5

    def near(which: Column) -> Column:
        before = F.max(F.when(which, F.col("until"))).over(up)
        after = F.min(F.when(which, F.col("start"))).over(down)
        return F.coalesce(F.col("start") - before <= scope, F.lit(False)) | F.coalesce(after - F.col("until") <= scope, F.lit(False))

    linked = flat.select("id", "mark", "start", "kind", "until", near(is_id).alias("with_id"), near(is_secret).alias("with_secret"), near(is_end).alias("with_end")).where(
        "kind > 2 and case when kind = 4 then with_id or with_end else with_secret end"
    )
    linked = linked.groupBy("id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "until"))).alias("linked"))
    linked = linked.select(F.col("id").alias("of"), F.col("mark").alias("as"), "linked")
    both = parts.join(linked, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("as")), "left")
    return both.select(F.col("id").alias(id_col), "mark", "base", F.coalesce("linked", F.array().cast("array<struct<start:int,kind:int,until:int>>")).alias("linked"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each document: counts of strong kinds, digest of their spans, all spans."""
    found = find_secrets(docs, id_col, text_col, scope)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    every = F.array_sort(F.concat("base", "linked"))
    return found.select(
        id_col,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
    )


def _without(text: Column, spans: Column) -> Column:
    """``text`` with a mark for each run of overlapping spans, which are sorted by start."""
    nothing = F.array().cast("array<string>")

    def block(at: Column, own: Column) -> Column:
        # The block's own stretch of the text is cut out first, so that a place is looked up in it alone.
        end = F.greatest(at, F.coalesce(F.array_max(F.transform(own, lambda s: s["until"])), F.lit(0)))

        def step(acc: Column, s: Column, stretch: Column) -> Column:
            piece = F.array(F.concat(stretch.substr(acc["state"] - at + 1, s["start"] - acc["state"]), F.lit(MARK)))
            found = F.concat(acc["found"], F.when(s["start"] >= acc["state"], piece).otherwise(nothing))
            return F.struct(F.greatest(acc["state"], s["until"]).alias("state"), found.alias("found"))

        seed = F.struct(at.alias("state"), nothing.alias("found"))
        return _bound(text.substr(at + 1, end - at), lambda stretch: F.aggregate(own, seed, lambda acc, s: step(acc, s, stretch)))

    end = F.coalesce(F.array_max(F.transform(spans, lambda s: s["until"])), F.lit(0))
    return F.concat(F.array_join(_fold(spans, F.lit(0), "string", block), ""), text.substr(end + 1, F.length(text)))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span replaced by a mark; endpoints stay, they are no secret. Rows and columns stay.

    Up to ``SMALL`` spans, by count, go to the texts; beyond that texts and spans are shuffled.
    """
    columns = docs.columns
    found = find_secrets(docs, id_col, text_col, scope).select(
        F.col(id_col).alias("of"), F.col("mark").alias("as"), F.array_sort(F.filter(F.concat("base", "linked"), lambda s: s["kind"] != 5)).alias("spans")
    )
    found = cut(found.where("size(spans) > 0").dropDuplicates(["of", "as"]))
    whole = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), docs[id_col].cast("long").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("mark"))
    right = F.broadcast(found) if (found.agg(F.sum(F.size("spans"))).first()[0] or 0) <= SMALL else found
    both = whole.join(right, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("as")), "left").withColumn("text", F.col("row")[text_col].cast("string"))
    text = F.when(F.col("spans").isNull(), F.col("row")[text_col]).otherwise(_without(F.col("text"), F.col("spans")))
    return both.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns])
