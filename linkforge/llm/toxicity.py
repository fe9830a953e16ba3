"""Toxicity by a counterfactual-regularised classifier.

Fitting: a bounded sample of labelled rows (``sample`` of the rows that may be learned from, those
with the least hash of their id, one text for each id; documented bound, the fit does not grow with the
input). On the workers their texts become words, and sentences that name an identity group are kept
apart (at most ``SENTENCES`` for a text, those of least hash). Grouped counts choose the words that tell
the classes apart. A logistic model of these words is then fitted with a penalty: in each kept sentence
the identity term is swapped for each other term of its set, and the squared change of the score is
added to the loss. Terms of one set so get like weights, and a neutral mention of a group does not
raise a score. The terms of four languages are a parameter.

Settings are compared by ``fold_losses``, by folds within the rows that may be learned from.

Scoring: one pass over all whole texts with the weights, no shuffle. The score rises with the distinct
telling words of a text, so its length alone does not move it.

Defined results: a null or empty text is scored by the bias alone; a very long text by its distinct
words; a label that is null is not learned from, and of several labels of an id the greatest counts;
without labelled rows of both classes every score is the share of toxic ones (0 without any); repeated
rows are scored each; a null doc_id is scored and is not held out; telling words that tie are taken in
their own order; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.common import cut, pieces, text_or_empty

#: Sets of identity terms that may stand for each other, in English, German, French and Spanish.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("she", "he"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("sie", "er"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("elle", "il"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("ella", "él"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
)
WORD = regex.compile(r"\p{L}[\p{L}\p{M}']*")
END = regex.compile(r"[.!?\n]+")
#: Rows and features of the fit, sentences of a row, least distance in standard errors that makes a feature telling, letters of stems.
SAMPLE, FEATURES, SENTENCES, TELLING, STEMS = 16_384, 2_048, 8, 4.0, (4,)
#: Weights of the counterfactual penalty and of the ridge, by folds: see the README.
PENALTY, RIDGE = 5.0, 1e-5


def with_stems(words: set[str]) -> set[str]:
    """Words, and the stems (first letters, marked) of longer ones."""
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


def words_of(text: str) -> set[str]:
    """The distinct words of a text, and their stems."""
    return with_stems(set(WORD.findall(text.lower())))


def identity_sentences(text: str, terms: set[str], most: int = SENTENCES) -> list[set[str]]:
    """The words of the sentences that name an identity term; of more than ``most`` those of least hash."""
    own = [w for w in map(words_of, END.split(text)) if not terms.isdisjoint(w)]
    return sorted(own, key=lambda w: zlib.crc32(" ".join(sorted(w)).encode()))[:most]


def counterfactuals(sentences: list[set[str]], identity=IDENTITY) -> list[tuple[set[str], set[str]]]:
    """(sentence, the same with one identity term swapped) for each term and each other of its set."""
    return [(s, (s - with_stems({a})) | with_stems({b})) for s in sentences for group in identity for a in group if a in s for b in group if b not in s]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0

    def of(self, words: set[str]) -> float:
        z = self.bias + math.fsum(self.weights[w] for w in words & self.weights.keys())
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

    def score(self, text: str) -> float:
        return self.of(words_of(text))


class Matrix:
    """Rows of words as column numbers."""

    def __init__(self, rows: list[set[str]], index: dict[str, int]):
        columns = [np.fromiter((index[w] for w in sorted(r & index.keys())), np.int64) for r in rows]
        self.n, self.width = len(rows), len(index)
        self.flat = np.concatenate([*columns, np.empty(0, np.int64)])
        self.row = np.repeat(np.arange(len(rows)), [len(c) for c in columns])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.flat], self.n)

    def summed(self, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, by_row[self.row], self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def loss(w: np.ndarray, bias: float, x: Matrix, y: np.ndarray, weight: np.ndarray, before: Matrix, after: Matrix, penalty: float, ridge: float) -> tuple[float, np.ndarray, float]:
    """The weighted log loss with ridge and the mean squared change between a sentence and its counterfactual; its gradient by w and bias."""
    z = bias + x.times(w)
    p = sigmoid(z)
    value = float((weight * (np.logaddexp(0, z) - y * z)).mean() + ridge / 2 * w @ w)
    dz = weight * (p - y) / x.n
    dw, db = x.summed(dz) + ridge * w, dz.sum()
    if before.n:
        a, b = sigmoid(bias + before.times(w)), sigmoid(bias + after.times(w))
        value += float(penalty * ((a - b) ** 2).mean())
        change = 2 * penalty * (a - b) / before.n
        da, d_after = change * a * (1 - a), -change * b * (1 - b)
        dw = dw + before.summed(da) + after.summed(d_after)
        db = db + da.sum() + d_after.sum()
    return value, dw, float(db)


def fit_rows(rows: list[set[str]], labels: np.ndarray, vocabulary: list[str], penalty: float = PENALTY, ridge: float = RIDGE, sentences: list[set[str]] = (), steps: int = 600, identity=IDENTITY) -> Model:
    """Logistic regression with the counterfactual penalty over ``sentences``, by gradient descent with momentum.

    Each row is the words of one text.
    """
    pairs = counterfactuals(list(sentences), identity)
    vocabulary = sorted({*vocabulary, *with_stems({t for s in identity for t in s})}) if pairs else sorted(vocabulary)
    index = {w: i for i, w in enumerate(vocabulary)}
    x, before, after = (Matrix(r, index) for r in (rows, [a for a, _ in pairs], [b for _, b in pairs]))
    y = labels.astype(float)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))  # either class counts half
    w, bias, vw, vb = np.zeros(len(vocabulary)), 0.0, np.zeros(len(vocabulary)), 0.0
    rate = 2.0 / (1 + penalty / PENALTY)  # a steep penalty needs shorter steps
    steps = round(steps * (1 + penalty / PENALTY) / 2)
    for _ in range(steps):
        _, dw, db = loss(w, bias, x, y, weight, before, after, penalty, ridge)
        vw, vb = 0.9 * vw - rate * dw, 0.9 * vb - rate * db
        w, bias = w + vw, bias + vb
    return Model({v: float(k) for v, k in zip(vocabulary, w, strict=True) if k}, float(bias))


def telling_words(rows: list[set[str]], labels: np.ndarray, features: int = FEATURES, telling: float = TELLING) -> list[str]:
    """The words that tell the classes of a bounded sample apart, as ``fit`` finds them."""
    held, pos = Counter(w for r in rows for w in r), Counter(w for r, y in zip(rows, labels, strict=True) if y for w in r)
    share = float(np.mean(labels))
    gain = {w: (pos[w] - n * share) / math.sqrt(n * share + 1) for w, n in held.items() if n >= 3}
    return sorted((w for w in gain if abs(gain[w]) >= telling), key=lambda w: (-abs(gain[w]), w))[:features]


def fold_losses(rows: list[set[str]], labels: np.ndarray, sentences: list[list[set[str]]], settings: list[tuple[float, float]], folds: int = 3) -> list[tuple[float, float, float, float]]:
    """For each (penalty, ridge): those, the mean log loss of the rows left out, and the mean change of their counterfactuals."""
    out, fold = [], np.arange(len(rows)) % folds
    for penalty, ridge in settings:
        losses, changes = [], []
        for k in range(folds):
            learn = np.flatnonzero(fold != k).tolist()
            own = [rows[i] for i in learn]
            model = fit_rows(own, labels[learn], telling_words(own, labels[learn]), penalty, ridge, [s for i in learn for s in sentences[i]])
            for i in np.flatnonzero(fold == k).tolist():
                p = min(max(model.of(rows[i]), 1e-9), 1 - 1e-9)
                losses.append(-math.log(p if labels[i] else 1 - p))
                changes += [abs(model.of(a) - model.of(b)) for a, b in counterfactuals(sentences[i])]
        out.append((penalty, ridge, float(np.mean(losses)), float(np.mean(changes)) if changes else 0.0))
    return out


def worded(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, identity=IDENTITY) -> DataFrame:
    """(id, label, words, sentences) of at most ``sample`` labelled ids, one text for each (the least, if there are several)."""
    terms = {t for s in identity for t in s}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(2).to_pylist()
            words = pa.array([sorted(words_of(t)) for t in texts], pa.list_(pa.string()))
            named = pa.array([[sorted(w) for w in identity_sentences(t, terms)] for t in texts], pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words, named], ["id", "label", "words", "sentences"])

    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    taken = cut(known.orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    texts = rows.join(F.broadcast(taken), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # at most ``sample`` rows are broadcast
    return texts.select("id", "label", "text").mapInArrow(run, "id long, label int, words array<string>, sentences array<array<string>>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, features: int = FEATURES, penalty: float = PENALTY, ridge: float = RIDGE, identity=IDENTITY) -> Model:
    """Model from ``labels`` (id, label), which hold only rows that may be learned from.

    At most ``sample`` labelled ids are taken and ``features`` words; both bound what reaches the driver.
    """
    rows = cut(worded(docs, labels, id_col, text_col, label_col, sample, identity))
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        return Model({}, math.log(max(share, 1e-12) / max(1 - share, 1e-12)))
    counts = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("pos"), F.count("*").alias("all"))
    expected = F.col("all") * F.lit(totals[1] / (totals[0] + totals[1]))
    telling = counts.where("all >= 3").withColumn("gain", (F.col("pos") - expected) / F.sqrt(expected + 1))
    telling = telling.where(F.abs("gain") >= TELLING)
    vocabulary = sorted(r["word"] for r in telling.orderBy(F.abs("gain").desc(), "word").limit(features).select("word").collect())
    wanted = F.array(*map(F.lit, sorted({*vocabulary, *with_stems({t for s in identity for t in s})})))
    kept = F.transform("sentences", lambda s: F.array_intersect(s, wanted))
    held = rows.select("id", "label", F.array_intersect("words", wanted).alias("words"), kept.alias("sentences")).orderBy("id").collect()
    return fit_rows([set(r["words"]) for r in held], np.array([r["label"] for r in held]), vocabulary, penalty, ridge, [set(s) for r in held for s in r["sentences"]], identity=identity)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t.as_py()) for t in batch.column(1)], pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """The rows that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; the columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([model.score(t.as_py() or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
