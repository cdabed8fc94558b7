"""Toxicity of whole texts, read through their disguises.

A character model (trigrams of letters, counted over the words of all
documents) decodes disguised words by Viterbi: each character of a word is a
lattice column of what may have been meant (itself, the letter a digit or sign
stands for, nothing for a separator or one more repeat), and runs of single
characters that hold a letter are one word or several.  The restored words and their beginnings are
the features of a logistic regression, fitted on a bounded sample of labelled
rows (``SAMPLE``); nothing but the text enters a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from clickloom.llm.common import freed, materialize, pieces, prepared, table
from clickloom.plans.registry import Query

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 20_000
THRESHOLD = 0.3
#: Hashed features, and how unlikely by chance a feature's share of toxic rows must be (in standard deviations).
FEATURES, LEAST_Z = 1 << 18, 5.0
BEGINNINGS = (4, 5, 6, 7)

# The letters of the model and what digits and signs stand for
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
MEANT = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Costs of the channel, in nats: a letter written as a sign, a separator or repeat put in, a space put in.
SIGN, EXTRA, SPACE = 1.0, 0.7, 0.3

_code = {c: i + 1 for i, c in enumerate(LETTERS)}
_size = len(LETTERS) + 1  # 0 is the edge of a word, and any other letter
_words = re.compile(r"[^\W\d_]+")
_inner = re.compile(r"[\w@$!|+(€£]")
_letter = re.compile(r"[^\W\d_]")
_no_letter = re.compile(r"[\W\d_]")
_sign = re.compile(r"[@$!|+(€£\d]")
_thrice = re.compile(r"(.)\1\1")
_single = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")  # letters, what is meant as one, and separators


def core(token: str) -> str:
    """A token without signs that stand twice or more at an edge and without edges that mean no letter, in one pass."""
    for strip, at in ((str.lstrip, 0), (str.rstrip, -1)):
        if token and not (token[at].isalnum() or token[at] == "_"):
            left = strip(token, token[at])
            token = left if len(token) - len(left) > 1 else token
    return trimmed(token)


def trimmed(token: str) -> str:
    """A token without the characters at its edges that mean no letter."""
    first = _inner.search(token)
    return token[first.start() : len(token) - _inner.search(token[::-1]).start()] if first else ""


def odd(word: str) -> bool:
    """Whether letters stand together with signs, digits or gaps, or one letter thrice, in one pass."""
    first = _letter.search(word)
    if first is None:
        return False
    end = len(word) - _letter.search(word[::-1]).start()
    return _sign.search(word) is not None or _no_letter.search(word, first.start(), end) is not None or any(_letter.match(m[1]) for m in _thrice.finditer(word))


def _gram(a, b, c):
    return (a * _size + b) * _size + c


#: Characters of texts that are counted together, at least.
PART = 500_000


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is in a word, and its number in the model."""
    inside, number = np.zeros(0x110000, bool), np.zeros(0x110000, np.int32)
    for m in _words.finditer("".join(map(chr, range(0x110000)))):
        inside[m.start() : m.end()] = True
    number[list(map(ord, _code))] = list(_code.values())
    return inside, number


def text_grams(texts: list[str]) -> np.ndarray:
    """How often each trigram stands in the words of some texts, with two edges before a word and one behind it."""
    inside, number = _letters()
    points = np.frombuffer(f"  {' '.join(texts)} ".lower().encode("utf-32-le", "surrogatepass"), "<u4")
    word = inside[points]
    code = np.where(word, number[points], 0)  # nothing but edges between words
    # the letter two places before counts where the one in between is of the word
    first = np.where(word[1:-1], code[:-2], 0)
    of_word = word[2:] | word[1:-1]  # a letter, or the edge behind one
    return np.bincount(_gram(first, code[1:-1], code[2:])[of_word], minlength=_size**3)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, held, size = np.zeros(_size**3, np.int64), [], 0
    for batch in pieces(batches):
        for text in batch["text"].to_pylist():
            held.append(text)
            size += len(text)
            if size >= PART:
                grams += text_grams(held)
                held, size = [], 0
    grams += text_grams(held)
    seen = np.flatnonzero(grams)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(grams[seen])], ["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log-probability of a letter after two others, over the words of all documents.

    The table has as many rows as there are triples of the fixed letters, whatever the documents hold.
    """
    counted = docs.select("text").mapInArrow(freed(_count), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n = np.full(_size**3, 0.05)
    for row in counted.collect():  # at most (letters + 1)^3
        n[row.gram] += row.n
    n = n.reshape(_size, _size, _size)
    return np.log(n / n.sum(axis=2, keepdims=True)).astype(np.float32)


class Decoder:
    """Viterbi decoding of disguised words under the character model."""

    def __init__(self, model: np.ndarray):
        self.model, self.cache = model, {}

    def best(self, chars: str, spaced: bool = False) -> str:
        """The likeliest text behind some characters; ``spaced``: they stood alone, a space may have been meant."""
        model, states = self.model, {(0, 0): (0.0, "")}
        for i, c in enumerate(chars):
            repeat = i > 0 and c == chars[i - 1]
            options = [(c, 0.0)] if c in _code or c.isalpha() else [(m, SIGN) for m in MEANT.get(c, "")]
            skip = EXTRA if repeat or not c.isalpha() else None
            after: dict[tuple[int, int], tuple[float, str]] = {}

            def put(state, cost, text):
                if state not in after or cost < after[state][0]:
                    after[state] = (cost, text)

            for (a, b), (cost, text) in states.items():
                if skip is not None:
                    put((a, b), cost + skip, text)
                for letter, price in options:
                    k = _code.get(letter, 0)
                    put((b, k), cost + price - float(model[a, b, k]), text + letter)
                    if spaced and text:
                        put((0, k), cost + price + SPACE - float(model[a, b, 0]) - float(model[0, 0, k]), text + " " + letter)
            states = after or states
        return min((cost - float(model[a, b, 0]), text) for (a, b), (cost, text) in states.items())[1]

    def word(self, token: str) -> str:
        found = self.cache.get(token)
        if found is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            word = core(token)
            found = self.cache[token] = self.best(word) if odd(word) else word
        return found

    def restore(self, text: str) -> set[str]:
        """Distinct words of a text, disguised ones as decoded."""
        text, words = text.lower(), set()
        for run in _single.findall(text):
            chars = trimmed("".join(run.split()))
            if sum(c in MEANT or c.isalnum() for c in chars) > 2 and any(map(str.isalpha, chars)):
                words.update(self.best(chars, spaced=True).split())
        for token in set(text.split()):
            if token.isalpha() and not _thrice.search(token):
                words.add(token)
            else:
                words.update(_words.findall(token))
                words.update(_words.findall(self.word(token)))
        return words


def features(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    keys = ["w" + word, *("b" + word[:k] for k in BEGINNINGS if len(word) > k)]
    return [xxhash.xxh32_intdigest(k) % FEATURES for k in keys]


def _sample_counts(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, n = Decoder(model), np.zeros((2, FEATURES), np.int64)
        for batch in pieces(batches):
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                found = {f for word in decoder.restore(text) for f in features(word)}
                n[toxic, list(found)] += 1
        seen = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, n[1, seen], n[0, seen])], ["feature", "toxic", "clean"])

    return run


def _sample_rows(model: np.ndarray, chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, number = Decoder(model), {f: i for i, f in enumerate(chosen.tolist())}
        for batch in pieces(batches):
            rows = [sorted({number[f] for w in decoder.restore(t) for f in features(w) if f in number}) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(rows, pa.list_(pa.int32()))], ["toxic", "found"])

    return run


def logistic(rows: list[list[int]], labels: np.ndarray, n: int, l2: float = 1.0, steps: int = 400) -> np.ndarray:
    """Weights and, last, the intercept; full-batch gradient steps with momentum, scaled by how often a feature occurs."""
    feature = np.array([f for r in rows for f in r], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, v = np.zeros(n + 1), np.zeros(n + 1)
    w[-1] = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    scale = np.append(np.bincount(feature, minlength=n), len(rows)) / 4 + l2
    crowd = max(1.0, len(feature) / max(1, len(rows)))  # features of a row move together
    for _ in range(steps):
        z = np.bincount(row, weights=w[feature], minlength=len(rows)) + w[-1]
        wrong = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.append(np.bincount(feature, weights=wrong[row], minlength=n) + l2 * w[:-1], wrong.sum())
        v = 0.9 * v - g / scale / crowd
        w += v
    return w


def _scores(model: np.ndarray, weights: np.ndarray, intercept: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, known = Decoder(model), {}
        weight = dict(zip(np.flatnonzero(weights).tolist(), weights[np.flatnonzero(weights)].tolist()))
        for batch in pieces(batches):
            out = []
            for text in batch["text"].to_pylist():
                found: set[int] = set()
                for word in decoder.restore(text):
                    own = known.get(word)
                    if own is None:
                        if len(known) > 300_000:
                            known.clear()
                        own = known[word] = tuple(f for f in features(word) if f in weight)
                    found.update(own)
                out.append(1 / (1 + np.exp(-np.clip(intercept + sum(weight[f] for f in sorted(found)), -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])

    return run


def is_held_out(doc_id: str = "doc_id"):
    """crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns ``keep``, held_out, score (0 to 1) and predicted of every row.

    The classifier sees at most ``sample`` labelled rows outside the held-out
    fold, those first by a hash of their doc_id.  Labels without a doc_id or
    value are ignored, several of one doc_id count as their greatest; of
    several rows of one doc_id the least text is seen.  Without
    any label every score is 0.5.  Null texts are scored as empty; repeated
    rows get equal scores.
    """
    docs = prepared(docs, *keep)
    model = character_model(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~is_held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    one = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = materialize(one.select("text", "toxic"), "labelled")  # at most ``sample``
    counts = rows.mapInArrow(freed(_sample_counts(model)), "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = counts.toPandas().sort_values("feature")  # at most FEATURES rows
    picked, w = np.zeros(0, np.int64), np.zeros(1)
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if sizes:
        share = sizes.get(1, 0) / sum(sizes.values())
        n = counted["toxic"] + counted["clean"]
        z = (counted["toxic"] - n * share) / np.sqrt(n * share * (1 - share) + 1e-9)
        picked = counted["feature"][(n >= 4) & (abs(z) >= LEAST_Z)].to_numpy()
        found = sorted((r.toxic, list(r.found)) for r in rows.mapInArrow(freed(_sample_rows(model, picked)), "toxic int, found array<int>").collect())  # at most ``sample``
        w = logistic([f for _, f in found], np.array([t for t, _ in found], float), len(picked))
    weights = np.zeros(FEATURES, np.float64)
    weights[picked] = w[:-1]
    scored = docs.mapInArrow(freed(_scores(model, weights, float(w[-1]))), StructType([*docs.schema, StructField("score", DoubleType())]))
    return scored.select("doc_id", "text", *keep, is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text")


QUERIES: dict[str, tuple[Query, str | None]] = {"op5_toxicity": (op5_toxicity, None)}
