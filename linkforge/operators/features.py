"""Features of candidate pairs: token sets as array expressions, strings by one Arrow UDF, counts and context by joins and windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.functions.keys import addr_tokens
from linkforge.functions.similarity import NAMES, similarity
from linkforge.functions.text import flat_addr, phonetic, strip_phone, words
from linkforge.operators import blocking

# Legal forms that count as one.
LEGAL_GROUPS = {
    "pvt": "pvt", "ltd": "ltd", "llc": "llc", "inc": "inc", "corp": "inc", "co": "co", "llp": "llp", "pllc": "llc", "pc": "pc", "plc": "ltd",
    "sarl": "sarl", "sas": "sas", "sa": "sa", "eurl": "eurl", "lp": "lp",
}


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def _flag(known: Column, value: Column) -> Column:
    return F.when(known, value.cast("double")).otherwise(-1.0)


def number_features(a: Column, b: Column) -> dict[str, Column]:
    """Of two arrays of numbers; -1 where either has none."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    long = lambda s: F.filter(s, lambda t: F.length(t) >= 5)
    house = F.array_contains(y, F.get(a, F.lit(0))) | F.array_contains(x, F.get(b, F.lit(0)))
    return {
        "num_jacc": _flag(both, F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))),
        "num_unseen_b": _flag(both, F.size(F.array_except(y, x)) / F.greatest(F.size(y), F.lit(1))),
        "num_house_eq": _flag(both, house),
        "zip_agree": _flag(both & (F.size(long(x)) > 0) & (F.size(long(y)) > 0), F.arrays_overlap(long(x), long(y))),
    }


def token_features(a: Column, b: Column) -> dict[str, Column]:
    """Of two core token arrays."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    skeleton = lambda s: F.array_distinct(F.transform(s, phonetic))
    initials = lambda s: F.array_join(F.transform(s, lambda t: F.substring(t, 1, 1)), "")
    return {
        "n_jacc": jaccard(x, y),
        "n_phon_jacc": jaccard(skeleton(x), skeleton(y)),
        "n_first_eq": F.coalesce(F.get(a, F.lit(0)) == F.get(b, F.lit(0)), F.lit(False)).cast("double"),
        "n_bag_eq": (F.array_sort(a) == F.array_sort(b)).cast("double"),
        "n_ntok_a": F.size(a),
        "n_ntok_b": F.size(b),
        "acr_a_in_b": _flag(F.size(a) > 1, F.array_join(b, "").startswith(initials(a))),
        "acr_b_in_a": _flag(F.size(b) > 1, F.array_join(a, "").startswith(initials(b))),
    }


def legal_forms(name: Column) -> Column:
    groups = F.create_map(*[F.lit(x) for p in LEGAL_GROUPS.items() for x in p])
    return F.array_distinct(F.filter(F.transform(words(name), lambda t: F.try_element_at(groups, t)), lambda g: g.isNotNull()))


def legal_flags(a: Column, b: Column) -> dict[str, Column]:
    """Of two arrays of legal forms."""
    both, share = (F.size(a) > 0) & (F.size(b) > 0), F.arrays_overlap(a, b)
    return {"legal_agree": _flag(both, share), "legal_conflict": (both & ~share).cast("double")}


def legal_features(name_a: Column, name_b: Column) -> dict[str, Column]:
    return legal_flags(legal_forms(name_a), legal_forms(name_b))


def agree(a: Column, b: Column) -> Column:
    return _flag((a != "") & (b != ""), a == b)


def phone_token(name: Column) -> Column:
    return F.exists(words(name), lambda t: t.rlike("^[0-9]{7,}$")).cast("double")


def core_frequency(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Adds how many targets of the source, and how many queries, have the target's or the query's core."""
    of_targets = records.where("src <> 1").groupBy("src", "core").agg(F.count("*").alias("n"))
    of_queries = records.where("src = 1").groupBy("core").agg(F.count("*").alias("n"))
    out = candidates
    for column, counts, on in (("t_core_freq", of_targets, ["src", "core_b"]), ("s1core_t_freq", of_targets, ["src", "core_a"]), ("s1_core_freq", of_queries, ["core_a"])):
        out = out.join(counts.withColumnRenamed("core", on[-1]).withColumnRenamed("n", column), on, "left").fillna(0, [column])
    return out


def core_counts(records: DataFrame) -> DataFrame:
    """(id, counts): by source, how many records have the record's core; cores are compared by their SHA-256."""
    own = records.select("id", "src", F.unhex(F.sha2(F.col("core").cast("binary"), 256)).alias("core"))
    counts = own.groupBy("core", "src").agg(F.count("*").alias("n")).groupBy("core").agg(F.map_from_entries(F.collect_list(F.struct("src", "n"))).alias("counts"))
    return own.select("id", "core").join(counts, "core").select("id", "counts")


def pair_core_frequency(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(s1, src, t) with what ``core_frequency`` adds, by counts of each record: no pair carries a core."""
    counts, of = core_counts(records), lambda src: F.coalesce(F.try_element_at("counts", src), F.lit(0))
    out = pairs.select("s1", "src", "t").join(counts.withColumnRenamed("id", "s1"), "s1")
    out = out.select("s1", "src", "t", of(F.col("src")).alias("s1core_t_freq"), of(F.lit(1)).alias("s1_core_freq"))
    return out.join(counts.withColumnRenamed("id", "t"), "t").withColumn("t_core_freq", of(F.col("src"))).drop("counts")


#: Pairs of a batch with their strings.
PAIRS = 1000


def beside(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``pairs`` (country, src, s1, t) as (src, s1, t) with the strings of ``records`` (id, country, src, and strings) of both sides, as name_a and name_b for name.

    Pairs are dealt by the blocks of both records, and a record goes once to each block that it may
    meet: what moves are strings by blocks, and not by pairs.
    """
    names = [c for c in records.columns if c not in ("id", "country", "src")]
    sizes = records.groupBy("country", "src").agg(F.count("*").alias("n"))
    blocks = F.broadcast(sizes.groupBy("country").agg(F.ceil(F.max("n") / blocking.HOT).cast("int").alias("blocks")))
    of = lambda c: F.pmod(F.xxhash64(c), F.col("blocks").cast("long")).cast("int")
    each, cell = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), ["country", "src", "block", "other"]
    sides, blank = records.join(blocks, "country"), [F.lit(None).cast("string").alias(c) for c in ("s1", "t")]
    a = sides.where("src = 1").drop("src").join(F.broadcast(sizes.where("src <> 1").select("country", "src")), "country").select("country", "src", of("id").alias("block"), each.alias("other"), F.lit(1).alias("side"), *blank, "id", *names)
    b = sides.where("src <> 1").select("country", "src", each.alias("block"), of("id").alias("other"), F.lit(2).alias("side"), *blank, "id", *names)
    own = pairs.join(blocks, "country").select("country", "src", of("s1").alias("block"), of("t").alias("other"), F.lit(0).alias("side"), "s1", "t", *[F.lit(None).cast("string").alias(c) for c in ("id", *names)])
    schema = pa.schema([("src", pa.int32()), *((c, pa.string()) for c in ("s1", "t", *(f"{n}_{k}" for k in "ab" for n in names)))])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        met, *held = (whole.filter(pc.equal(whole.column("side"), k)) for k in range(3))
        found = []  # for each side: records in order of their ids' numbers, where a number begins, the number of each pair's id
        for name, side in zip(("s1", "t"), held, strict=True):
            ids = pa.concat_arrays([c.cast(pa.string()) for col in (side.column("id"), met.column(name)) for c in col.chunks] or [pa.array([], pa.string())])
            codes = ids.dictionary_encode().indices.to_numpy()
            order = np.argsort(codes[: len(side)], kind="stable")
            begins = np.searchsorted(codes[: len(side)][order], np.arange(codes.max(initial=-1) + 2))
            found.append((side.select(names).combine_chunks(), order, begins, codes[len(side) :]))
        for at in range(0, len(met), PAIRS):
            rows, taken = np.arange(at, min(at + PAIRS, len(met))), []
            for _, order, begins, codes in found:  # a repeated id repeats the pair
                many = begins[codes[rows] + 1] - begins[codes[rows]]
                place = np.repeat(begins[codes[rows]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                taken = [np.repeat(x, many) for x in taken] + [order[place]]
                rows = np.repeat(rows, many)
            part, sides = met.take(pa.array(rows)), [f[0].take(pa.array(x)) for f, x in zip(found, taken, strict=True)]
            columns = [part.column("src"), part.column("s1"), part.column("t"), *(c for side in sides for c in side.columns)]
            yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema).combine_chunks().to_batches()

    strings = ", ".join(f"{f.name} string" for f in list(schema)[1:])
    return own.unionByName(a).unionByName(b).groupBy(*cell).applyInArrow(run, f"src int, {strings}")


#: Columns of a record that a pair needs, and codes of scripts.
RECORD = ("name", "core", "alt", "is_dom", "script", "addr", "nums", "state")
SCRIPTS = {"L": 0.0, "I": 1.0, "M": 2.0}
#: What is no feature: identities, labels and what a stage adds.
NO_FEATURES = {"s1", "src", "t", "tgt", "country", "label", "fold", "p"}


def with_records(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """``candidates`` (s1, src, t, ...) with the columns of both records, as name_a, name_b and so on; two joins on the id."""
    side = lambda k: records.select(F.col("id").alias(f"id_{k}"), *[F.col(c).alias(f"{c}_{k}") for c in RECORD])
    return candidates.join(side("a"), F.col("s1") == F.col("id_a")).join(side("b"), F.col("t") == F.col("id_b")).drop("id_a", "id_b")


def pair_features(pairs: DataFrame) -> DataFrame:
    """Adds 18 measures and flags and 26 token features; ``pairs`` as ``with_records`` has them. The records' columns go.

    Pairs are dealt by query to as many tasks as the session shuffles to: their bytes are few, so Spark
    would run the measures in a task or two.
    """
    pairs = pairs.repartition(max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.sparkSession.sparkContext.defaultParallelism), "s1")
    core = {k: strip_phone(F.col(f"core_{k}")) for k in "ab"}
    out = pairs.withColumns({f"x_{k}": core[k] for k in "ab"} | {f"at_{k}": addr_tokens(F.col(f"addr_{k}"), F.col(f"state_{k}")) for k in "ab"})
    col, flat = F.col, {k: flat_addr(F.col(f"addr_{k}")) for k in "ab"}
    strings = similarity(col("x_a"), col("x_b"), col("name_a"), col("name_b"), col("alt_b"), flat["a"], flat["b"], col("at_a"), col("at_b"), col("nums_a"), col("nums_b"))
    out = out.withColumn("m", strings)
    tokens = token_features(words(col("x_a")), words(col("x_b"))) | legal_features(col("name_a"), col("name_b")) | number_features(words(col("nums_a")), words(col("nums_b")))
    script = F.coalesce(F.create_map(*[F.lit(x) for p in SCRIPTS.items() for x in p])[col("script_b")], F.lit(0.0))
    flags = {
        "b_script": script, "b_is_dom": col("is_dom_b").cast("double"), "b_has_alt": (col("alt_b") != "").cast("double"), "a_ntok_a": F.size("at_a"), "a_ntok_b": F.size("at_b"),
        "state_agree": agree(col("state_a"), col("state_b")), "a_empty_b": (col("addr_b") == "").cast("double"), "b_phone_tok": phone_token(col("name_b")),
    }
    named = {n: F.col(f"m.{n}") for n in NAMES} | tokens | flags
    kept = [c for c in pairs.columns if c not in {f"{c}_{k}" for c in RECORD for k in "ab"}]
    return out.select(*kept, *[c.cast("double").alias(n) for n, c in named.items()])


def featurize(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """All features of the candidates (s1, src, t, s_name, s_addr, s_cross, ...): pairs, rarity and the competition of a query's candidates.

    ``candidates`` holds all candidates of the queries in it. The strings of a pair go to Python once.
    """
    from linkforge.operators.windows import query_context

    pairs = core_frequency(with_records(candidates, records), records)
    out = pair_features(pairs)
    out = out.withColumns({c: F.col(c).cast("double") for c in ("t_core_freq", "s1core_t_freq", "s1_core_freq")})
    return query_context(out)


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NO_FEATURES]


def label_pairs(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """``candidates`` (s1, t, ...) with label: 1.0 where (s1, tgt) is in ``truth``."""
    known = truth.select("s1", F.col("tgt").alias("t"), F.lit(1.0).alias("label")).distinct()
    return candidates.join(known, ["s1", "t"], "left").fillna(0.0, ["label"])
