"""Records in other scripts: a learned dictionary of tokens, learned native names of states, rules for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.functions.text import core_of, has_indic, rule_translit, words
from linkforge.operators.learn import aligned_tokens, vote


def learn_tokens(truth: DataFrame, records: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """(token, latin, n): native tokens of matched targets against the tokens at their place in the query's Latin name.

    Only queries whose name is all Latin (script L) and targets whose name is not; names of one length.
    """
    latin = records.where("src = 1 and script = 'L'").select(F.col("id").alias("s1"), words(F.col("name")).alias("a"))
    native = records.where("src <> 1 and script <> 'L'").select(F.col("id").alias("tgt"), words(F.col("name")).alias("b"))
    pairs = aligned_tokens(truth.join(latin, "s1").join(native, "tgt"), "a", "b")
    pairs = pairs.where(has_indic(F.col("b")) & ~has_indic(F.col("a")))
    return vote(pairs, "b", "a", least, share).select(F.col("b").alias("token"), F.col("a").alias("latin"), "n")


def components(addr: Column) -> Column:
    return F.split(addr, " , ", -1)


def learn_states(truth: DataFrame, records: DataFrame, least: int = 5, share: float = 0.6) -> DataFrame:
    """(component, state, n): native address components of matched targets against the query's state."""
    known = records.where("src = 1 and state <> ''").select(F.col("id").alias("s1"), "state")
    native = records.where((F.col("src") != 1) & has_indic(F.col("addr"))).select(F.col("id").alias("tgt"), F.explode(components(F.col("addr"))).alias("component"))
    votes = truth.join(known, "s1").join(native, "tgt").where(has_indic(F.col("component")))
    return vote(votes, "component", "state", least, share).select("component", "state", "n")


def _looked_up(rows: DataFrame, parts: Column, dictionary: DataFrame, key: str, value: str) -> DataFrame:
    """(id, place, part, found): the parts of rows with what the dictionary has for them. Dictionaries may be of any size."""
    each = rows.select("id", F.posexplode(parts).alias("place", "part"))
    return each.join(dictionary.select(F.col(key).alias("part"), F.col(value).alias("found")), "part", "left")


def _joined(parts: DataFrame, sep: str, name: str) -> DataFrame:
    in_order = F.array_sort(F.collect_list(F.struct("place", "text")))
    return parts.groupBy("id").agg(F.array_join(F.transform(in_order, lambda p: p["text"]), sep).alias(name))


def enrich(records: DataFrame, tokens: DataFrame, states: DataFrame) -> DataFrame:
    """``records`` with names and addresses in Latin letters, and the state filled from a native component; ``id`` is unique.

    Names that are not all Latin: token by token from the dictionary, else by rule. Native address
    components: the code of a learned state, else by rule. Numbers and aliases stay as they are, and
    rows without native letters pass without a shuffle.
    """
    own_name, own_addr = (F.col("script") != "L") & (F.col("name") != ""), has_indic(F.col("addr"))
    by_rule = lambda c: F.when(has_indic(c), rule_translit(c)).otherwise(c)
    other = records.where(own_name | own_addr)
    named = _looked_up(other.where(own_name), words(F.col("name")), tokens, "token", "latin").select("id", "place", F.coalesce("found", by_rule(F.col("part"))).alias("text"))
    placed = _looked_up(other.where(own_addr), components(F.col("addr")), states, "component", "state")
    native = has_indic(F.col("part"))
    code = placed.where(native & F.col("found").isNotNull()).groupBy("id").agg(F.min_by("found", "place").alias("own_state"))
    placed = placed.select("id", "place", F.when(native, F.coalesce("found", by_rule(F.col("part")))).otherwise(F.col("part")).alias("text"))
    out = other.join(_joined(named, " ", "own_name"), "id", "left").join(_joined(placed, " , ", "own_addr"), "id", "left").join(code, "id", "left")
    new = {"name": F.coalesce("own_name", "name"), "addr": F.coalesce("own_addr", "addr"), "state": F.when(F.col("state") == "", F.coalesce("own_state", "state")).otherwise(F.col("state"))}
    out = out.withColumns(new).select(*records.columns)
    if "core" in records.columns:
        out = out.withColumn("core", core_of(F.col("name")))
    return records.where(~(own_name | own_addr)).unionByName(out)
