"""Byte-level BPE vocabulary files, read on each worker once."""

from __future__ import annotations

import functools
import json

import regex

#: Fixed value: the pre-tokenisation pattern of the byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    table = {chr(b): b for b in plain}
    table |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return table


@functools.lru_cache(maxsize=2)
def merges(path: str) -> tuple[dict[tuple[bytes, bytes], int], list[str]]:
    """(rank of each pair, special strings) of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    raw = lambda s: bytes(alphabet[c] for c in s)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    return {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}, [t["content"] for t in spec["added_tokens"]]


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A fast encoder with the ids of the byte-level BPE file; special strings in a text get their ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocabulary = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens=special)


@functools.lru_cache(maxsize=2)
def splitter(path: str):
    """(pattern of pre-tokens, pattern that cuts out special strings or None)."""
    special = merges(path)[1]
    cut = regex.compile("|".join(map(regex.escape, special))) if special else None
    return regex.compile(PATTERN), cut
