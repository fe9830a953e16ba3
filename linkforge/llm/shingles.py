"""Hashed word shingles of a text, and the block signatures that near sets must share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
_ODD = tuple(U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD_ENTRIES = 150_000
#: Bytes of a word beyond which it is hashed by itself.
LONG = 64
#: The lowest bytes of a number, by how many.
_LOW = np.array([2 ** (8 * k) - 1 for k in range(9)], U)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = WordHashes()


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x + U((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * _MIX[0]
        x = (x ^ (x >> U(27))) * _MIX[1]
        return x ^ (x >> U(31))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a shorter text is one shingle, a text without words none.

    A-Z is lower-cased; words are what ASCII white space separates.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(_words.__getitem__, words), U, len(words))
    with np.errstate(over="ignore"):
        if len(h) < width:
            value = U(len(h)) * _ODD[4]
            for i, x in enumerate(h):
                value = value + x * _ODD[i % 4] * U(2 * (i // 4) + 1)
            return mix(np.array([value], U))
        n = len(h) - width + 1
        value = np.zeros(n, U)
        for i in range(width):
            value += h[i : i + n] * _ODD[i % 4] * U(2 * (i // 4) + 1)
        return np.unique(mix(value))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts, as it is written, and where each text's words begin among them, with their number.

    Words are cut and hashed by eight bytes at once from the texts' own buffer; a word of up to eight
    bytes goes in whole, a long one by its xxhash64.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    n, at = int(at[-1] - at[0]), at - at[0]
    if not n:
        return np.empty(0, U), np.zeros(len(texts) + 1, np.int64)
    padded = np.zeros((n // 8 + 3) * 8, np.uint8)
    padded[:n] = np.frombuffer(texts.buffers()[2], np.uint8)[int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset]) :][:n]
    data = padded[:n]
    full = (data != 32) & (data - np.uint8(9) > 4)  # else white space: 9 to 13 and 32
    edge = np.ones(n + 1, bool)  # whether a word would begin or end before this byte
    np.logical_not(full[:-1] & full[1:], out=edge[1:-1])
    edge[at] = True
    start, end = np.flatnonzero(full & edge[:-1]), np.flatnonzero(full & edge[1:]) + 1
    size, eights = end - start, padded.view("<u8")
    out, part, begin, left = (size.astype(U) + U(1)) * _ODD[4], slice(None), start, size
    long = np.flatnonzero(size > LONG)
    with np.errstate(over="ignore"):
        while len(begin):
            word, shift = begin >> 3, (begin.astype(U) & U(7)) << U(3)
            value = (eights[word] >> shift) | ((eights[word + 1] << (U(56) - shift)) << U(8))
            out[part] = mix(out[part] + (value & _LOW[np.minimum(left, 8)]))
            more = np.flatnonzero((left > 8) & (left <= LONG))
            part = more if isinstance(part, slice) else part[more]
            begin, left = begin[more] + 8, left[more] - 8
    for i in long:
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return out, np.searchsorted(start, at)


_powers = [np.ones(1, U), np.ones(1, U)]


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, from sums over powers of an odd number."""
    n = max(0, len(hashes) - width + 1)
    if not n:
        return np.empty(0, U)
    with np.errstate(over="ignore"):
        if len(_powers[0]) < len(hashes):
            for k, x in enumerate((_ODD[3], U(pow(int(_ODD[3]), -1, 2**64)))):
                own = np.full(len(hashes), x, U)
                own[0] = 1
                _powers[k] = np.cumprod(own)
        sums = np.cumsum(hashes * _powers[0][: len(hashes)], dtype=U)
        value = sums[width - 1 :].copy()
        value[1:] -= sums[: n - 1]
        return mix(value * _powers[1][:n])


def parities(columns: np.ndarray) -> bytes:
    """A bit for each of 2^k >= len places: whether an odd number of columns fall there."""
    n = len(columns)
    bits = 1 << max(6, (n - 1).bit_length())
    place = (mix(columns, 9) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the columns in which two sets differ, from their parities."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(_ONES[x ^ y].sum())


class Blocks:
    """Signatures of the blocks of n-gram columns of a set, so that near sets share one.

    Sets of sizes a <= b link when ``den * intersection >= num * union``. Then they differ in at most
    d = floor((a + b) * (den - num) / (den + num)) columns. Columns are dealt into d + 1 + s blocks,
    so two linked sets agree in 1 + s blocks at least. The number of blocks goes by classes of the
    smaller size (tags); a set near a class's lower end signs for the class below too.

    So each set may leave out any s blocks that come last in an order of blocks by content: of the
    blocks in which two linked sets agree, the first in that order is left out by neither. Empty
    blocks, which agree by chance, come last and sign nothing; what is left of s, the budget, goes to
    the blocks that most sets hold. A set with m > s empty blocks also signs, in its first 2 * m
    blocks, each set of columns less one: if linked sets agree in u blocks, all of them empty, at most
    u - s - 1 of the others differ by more than one column.
    """

    #: Low bits of a signature: its tag.
    TAG = 63

    def __init__(self, num: int, den: int):
        self.num, self.den, self.starts = num, den, [1]

    def largest(self, size: int) -> int:
        """The largest set that can link with one of this size."""
        return size * self.den // self.num

    def differ(self, a: int, b: int) -> int:
        """The most columns in which linked sets of these sizes differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def sizes_fit(self, a: int, b: np.ndarray) -> np.ndarray:
        """Whether sets of these sizes can link."""
        return np.minimum(a, b) * self.den >= np.maximum(a, b) * self.num

    def tags(self, size: int) -> list[tuple[int, int, int]]:
        """(tag, number of blocks, spare blocks) for which a set of this size signs."""
        while self.starts[-1] <= size:
            s = self.starts[-1]
            self.starts.append(max(s + 1, s * 3 // 2))
        own = int(np.searchsorted(self.starts, size, "right")) - 1
        out = []
        for tag in range(own, -1, -1):
            last = self.starts[tag + 1] - 1
            if tag < own and self.largest(last) < size:
                break
            need = self.differ(last, self.largest(last)) + 1
            empty = need * np.exp(-self.starts[tag] / need)
            spare = int(np.ceil(empty + 2 * np.sqrt(empty) + 0.12 * need)) if need > 1 else 0
            out.append((tag, need + spare, spare))
        return out

    def signatures(self, columns: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(signatures, budgets): as many blocks with the tag budget % 64 as budget // 64 may be left out."""
        n = len(columns)
        if not n:
            return np.empty(0, U), []
        out, budgets, value = [], [], mix(columns, 1)

        def tagged(sums: np.ndarray, block: np.ndarray, tag: int, salt: int) -> np.ndarray:
            return mix(sums + U(tag + 1) * _ODD[1] + block * _ODD[0], salt) & ~U(self.TAG) | U(tag & self.TAG)

        with np.errstate(over="ignore"):
            for tag, blocks, spare in self.tags(n):
                block = (columns % U(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                block = block[order]
                first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                sums, held = np.add.reduceat(value[order], first), block[first]
                out.append(tagged(sums, held.astype(U), tag, 2))
                empty = blocks - len(held)
                if empty < spare:
                    budgets.append((spare - empty) * 64 + (tag & self.TAG))
                if empty > spare:
                    for j in np.flatnonzero(held < 2 * empty):
                        own = value[order][block == held[j]]
                        less = np.r_[sums[j : j + 1], (sums[j] - own) if len(own) > 1 else own[:0]]
                        out.append(tagged(less, U(held[j]), tag, 3))
        return np.concatenate(out), budgets
