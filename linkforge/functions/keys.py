"""Tokens and blocking keys as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkforge.functions.text import words

# Address words that tell nothing, ordinals, and the most tokens taken by default.
STOP = (
    "street road avenue drive lane court place boulevard circle way trail parkway highway terrace square unit floor building near opposite north south east "
    "west northeast northwest southeast southwest and of the plot flat door house block sector nagar city county district post box pmb cdp township main cross "
    "ground first second office shop village taluka colony complex area phase stage layout extension india usa us france po bldg apartment apartments tower "
    "wing gali marg chowk rue de du des la le les chemin allee bis"
).split()
ORDINALS = {"first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10"}
NAME_TOKENS, ADDR_TOKENS = 6, 10


def _first(tokens: Column, most: int | None) -> Column:
    return tokens if most is None else F.slice(tokens, 1, most)


def name_tokens(core: Column, most: int | None = NAME_TOKENS) -> Column:
    """The first ``most`` different tokens, or all."""
    kept = F.filter(words(core), lambda t: (F.length(t) > 1) | t.rlike("^[0-9]+$"))
    return _first(F.array_distinct(kept), most)


def addr_tokens(addr: Column, state: Column, most: int | None = ADDR_TOKENS) -> Column:
    """The first ``most`` telling tokens, or all; ordinals become digits, and a house number with letters also gives its digits."""
    ordinals = F.create_map(*[F.lit(x) for p in ORDINALS.items() for x in p])
    tokens = F.filter(words(addr), lambda t: (t != ",") & (t != state))
    tokens = F.transform(tokens, lambda t: F.regexp_replace(F.coalesce(F.try_element_at(ordinals, t), t), "^([0-9]+)(?:st|nd|rd|th)$", "$1"))
    stop = F.array(*map(F.lit, STOP))
    tokens = F.filter(tokens, lambda t: ~F.array_contains(stop, t) & ((F.length(t) > 1) | t.rlike("^[0-9]+$")))
    both = F.transform(tokens, lambda t: F.when(t.rlike("^[a-z]*[0-9]+[a-z]*$") & ~t.rlike("^[0-9]+$"), F.array(t, F.regexp_extract(t, "([0-9]+)", 1))).otherwise(F.array(t)))
    return _first(F.array_distinct(F.flatten(both)), most)


def pairs(tokens: Column, prefix: str) -> Column:
    """prefix + two different tokens, sorted, joined by a bar."""
    indexed = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    return F.flatten(
        F.transform(indexed, lambda a: F.transform(F.filter(indexed, lambda b: b["i"] > a["i"]), lambda b: F.concat(F.lit(prefix), F.least(a["t"], b["t"]), F.lit("|"), F.greatest(a["t"], b["t"]))))
    )


def record_keys(nt: Column, at: Column) -> dict[str, Column]:
    """Keys of the families name, addr and cross."""
    say = lambda tokens, prefix: F.transform(tokens, lambda t: F.concat(F.lit(prefix), t))
    whole = F.when(F.size(nt) > 0, F.array(F.concat(F.lit("c:"), F.array_join(nt, "")))).otherwise(F.array().cast("array<string>"))
    cross = F.flatten(F.transform(nt, lambda n: F.transform(at, lambda a: F.concat(F.lit("na:"), n, F.lit("|"), a))))
    return {"name": F.concat(say(nt, "n:"), whole, pairs(nt, "nn:")), "addr": F.concat(say(at, "a:"), pairs(at, "aa:")), "cross": cross}
