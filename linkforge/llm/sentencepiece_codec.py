"""SentencePiece encoding and decoding.

A single-pass Viterbi driven by an Aho-Corasick automaton over the pieces: the automaton reads a
chunk once; at each position its output links give all pieces that end there, and each relaxes the
best score of that position from the best score at its start. A character that no piece covers goes
to its byte pieces (byte fallback) or to the unknown piece. The text is cut before each run of
spaces first where no piece crosses, which leaves the best path as it is; chunks are remembered in a
cache of bounded size.

The segmentation is the one of greatest summed score (the unigram model), for any vocabulary file;
a file trained by merging has other segmentations under its own library.

Defined results: a null or empty text has no pieces; repeated rows get a row each; a null doc_id
stays; other columns are not read. Decoding joins pieces, bytes of byte pieces, and spaces.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import pieces, text_or_empty

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_ENTRIES = 300_000
#: What the unknown piece scores below the least piece, as the public library has it.
UNKNOWN_PENALTY = 10.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    def __init__(self, pieces: list[tuple[str, float, int]], dummy_prefix: bool = True):
        """``pieces``: (piece, score, kind) by id."""
        self.pieces, self.dummy_prefix = pieces, dummy_prefix
        self.automaton = ahocorasick.Automaton()
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        usual = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER)]
        self.floor = min((s for _, _, s in usual), default=0.0) - UNKNOWN_PENALTY
        for i, p, s in usual:
            self.automaton.add_word(p, (len(p), s, i))
        self.automaton.make_automaton()
        #: Whether a chunk may be cut before a space: no piece holds a space after another character.
        self.cuttable = not any(SPACE in p.lstrip(SPACE) for _, p, _ in usual)
        self.cache: dict[str, bytes] = {}
        surface = [(p.encode().replace(SPACE.encode(), b" ") if kind in (NORMAL, USER) else bytes([int(p[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN else b"") for p, _, kind in pieces]
        self.surface = np.array(surface, dtype=object)

    @classmethod
    def load(cls, path: str) -> Codec:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only files with the identity normaliser are read")
        return cls([(p.piece, p.score, p.type) for p in model.pieces], spec.add_dummy_prefix)

    def viterbi(self, chunk: str) -> list[int]:
        """Ids of the best segmentation of one chunk."""
        n = len(chunk)
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        matches, e = iter(self.automaton.iter(chunk)), 0
        held = next(matches, None)
        for e in range(n):
            single = False
            while held is not None and held[0] == e:
                length, score, i = held[1]
                start = e + 1 - length
                if (s := best[start] + score) > best[e + 1]:
                    best[e + 1], back[e + 1] = s, (start, i)
                single |= length == 1
                held = next(matches, None)
            if not single and (s := best[e] + self.floor) > best[e + 1]:
                best[e + 1], back[e + 1] = s, (e, -1)
        out, end = [], n
        while end:
            start, i = back[end]
            if i >= 0:
                out.append(i)
            else:  # neighbouring unknown characters are one unknown piece
                raw = chunk[start:end].encode()
                if all(b in self.bytes for b in raw):
                    out += [self.bytes[b] for b in reversed(raw)]
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
            end = start
        return out[::-1]

    def _chunk(self, chunk: str) -> bytes:
        if (ids := self.cache.get(chunk)) is None:
            ids = np.array(self.viterbi(chunk), "<i4").tobytes()
            if len(chunk) <= 64:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<i4")
        text = ((" " if self.dummy_prefix else "") + text).replace(" ", SPACE)
        if not self.cuttable:
            return np.array(self.viterbi(text), "<i4")
        words = text.split(SPACE)
        # Spaces before a word: one belongs to the word's chunk; a run of more is kept whole with it.
        chunks, run = [words[0]] if words[0] else [], 0
        for w in words[1:]:
            run += 1
            if w:
                chunks.append(SPACE * run + w)
                run = 0
        if run:
            chunks.append(SPACE * run)
        return np.frombuffer(b"".join(map(self._chunk, chunks)), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(self.surface[np.asarray(ids, np.int64)].tolist()).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec.load(path)


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the piece ids of every whole text. One pass, no shuffle."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.encode(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))], ["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of piece ids; null ids give an empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in pieces(batches):
            lists = batch.column(1)
            texts = [own.decode(lists[i].values.to_numpy(zero_copy_only=False)) if lists[i].is_valid else "" for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, ids_crc32, decoded_crc32, round_trip) of every whole text, without the ids themselves."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in pieces(batches):
            out = []
            for t in batch.column(1):
                text = t.as_py()
                ids = own.encode(text)
                again = own.decode(ids)
                out.append((len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(again.encode()), again == text))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean").withColumnRenamed("id", id_col)
