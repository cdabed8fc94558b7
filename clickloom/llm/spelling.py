"""Groups of spelling variants: words one edit apart, found by pivotal grams.

A word's prefix are its three rarest bigrams (and what ties with them), its
pivots two disjoint bigrams of the prefix with the least frequency together.
One edit cannot touch both pivots, so of two near words the one whose prefix
ends earlier in the order by rarity has an untouched pivot in the prefix of
the other.  The position limits are used to the full: the edit lies on one side
of that pivot, so up to it (or from it on) the words are alike letter by
letter, and that whole part is the key of the join.  Keys of many words, short
ones mostly, are cut further: of what remains of two words with one edit
between them, either the first or the last half is alike too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import checked_broadcast, materialize, prepared, table
from clickloom.plans.registry import Query

#: Letters of a word, as a pattern class.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points and occurrences of a word, at least.
LENGTH, OCCURRENCES = 7, 2
#: One run in so many loses a letter.
DAMAGE = 31
#: A form has at least so many times the occurrences of its variant.
RATIO = 10
#: Edits between near words and letters of a gram.
EDITS, GRAM = 1, 2
#: A key is cut further if it would bring more pairs than this to verify.
HOT_PAIRS = 10_000

_SIDES = "key string, word string, n long, last int, pivot boolean"
_SIDES_ARROW = pa.schema([("key", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("last", pa.int32()), ("pivot", pa.bool_())])


def _lowered(run: Column) -> Column:
    ascii_only = F.octet_length(run) == F.length(run)
    return F.when(ascii_only, F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def occurrences(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``word`` for every maximal run of at least ``length`` letters, A-Z lower-cased and damaged by rule.

    Shorter runs cannot become long enough words and are not read.  A null
    doc_id counts as the empty text in the rule.
    """
    pattern = F.lit(f"({LETTERS}{{{length},}})")
    runs = prepared(docs).select("doc_id", F.explode(F.regexp_extract_all("text", pattern, F.lit(1))).alias("run"))
    runs = runs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), _lowered(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % DAMAGE == 0, damaged).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, length: int = LENGTH, least: int = OCCURRENCES) -> DataFrame:
    """(word, n): the distinct words long and frequent enough, written once."""
    words = occurrences(docs, length).groupBy("word").agg(F.count("*").alias("n"))
    return materialize(words.where((F.col("n") >= least) & (F.length("word") >= length)), "words")


def gram_counts(words: DataFrame) -> dict[str, int]:
    """Words by bigram; at most as many as pairs of the 90 lower-cased letters."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda i: F.substring("word", i, F.lit(GRAM)))
    each = words.select(F.explode(F.array_distinct(grams)).alias("gram"))
    return {r.gram: r.n for r in each.groupBy("gram").agg(F.count("*").alias("n")).collect()}


def choose(places: list[int], cost: dict[int, int], k: int, width: int) -> list[int]:
    """``k`` of the ascending places, at least ``width`` apart, of least total cost (None if there are not as many).

    Dynamic programming: best[j] is the cheapest choice of j of the places seen
    so far, ``open_[j]`` that among places far enough left of the present one.
    """
    best: list[tuple[int, list[int]] | None] = [(0, [])] + [None] * k
    history, far = [], 0
    open_ = list(best)
    for i, at in enumerate(places):
        while far < i and places[far] <= at - width:
            open_ = history[far]
            far += 1
        for j in range(k, 0, -1):
            if open_[j - 1] is not None:
                total = open_[j - 1][0] + cost[at]
                if best[j] is None or total < best[j][0]:
                    best[j] = (total, [*open_[j - 1][1], at])
        history.append(list(best))
    return best[k][1] if best[k] else None


def keys(word: str, counts: dict[str, int], rank: dict[str, int]) -> tuple[int, list[str], list[str]]:
    """(rank that ends the prefix, keys of the pivots, keys of the prefix) of a word."""
    ranks = [rank[word[i : i + GRAM]] for i in range(len(word) - GRAM + 1)]
    last = sorted(ranks)[GRAM * EDITS]
    prefix = [i for i, r in enumerate(ranks) if r <= last]
    first, second = choose(prefix, {i: counts[word[i : i + GRAM]] for i in prefix}, EDITS + 1, GRAM)
    # an edit right of the first pivot leaves the left part as it is, any other one all from the second pivot on
    pivots = ["<" + word[: first + GRAM], ">" + word[second:]]
    return last, pivots, ["<" + word[: i + GRAM] for i in prefix] + [">" + word[i:] for i in prefix]


def _keyed(counts: dict[str, int]):
    rank = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist()):
                last, pivots, prefix = keys(word, counts, rank)
                out += [(k, word, n, last, True) for k in pivots]
                out += [(k, word, n, last, False) for k in prefix]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SIDES_ARROW.types)], schema=_SIDES_ARROW)

    return run


def halves(rest: str, pivot: bool) -> list[str]:
    """Keys of what a join key leaves of a word, alike in one place at least for rests one edit apart.

    The length m of the prefix word's rest sets where its halves meet; the pivot
    word does not know it and takes all three lengths that one edit allows.
    """
    n, out = len(rest), []
    for m in range(max(n - 1, 0), n + 2) if pivot else (n,):
        if m // 2 <= n:
            out.append(f"{m}<{rest[: m // 2]}")
        if m - m // 2 <= n:
            out.append(f"{m}>{rest[n - (m - m // 2) :]}")
    return out


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, word, n, last, pivot in zip(*(batch[c].to_pylist() for c in _SIDES_ARROW.names)):
            known = len(key) - 1
            rest = word[known:] if key[0] == "<" else word[: len(word) - known]
            out += [(key + half, word, n, last, pivot) for half in halves(rest, pivot)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SIDES_ARROW.types)], schema=_SIDES_ARROW)


def _spread(sides: DataFrame, most: int) -> DataFrame:
    """The sides, those of keys with more than ``most`` pairs under longer keys."""
    pairs = F.count_if("pivot") * F.count_if(~F.col("pivot"))
    hot = materialize(sides.groupBy("key").agg(pairs.alias("pairs")).where(F.col("pairs") > most).select("key"), "hot-keys")
    hot = checked_broadcast(hot)
    return sides.join(hot, "key", "left_anti").union(sides.join(hot, "key", "left_semi").select(*sides.columns).mapInArrow(_halved, _SIDES))


def near_words(words: DataFrame, most: int = HOT_PAIRS) -> DataFrame:
    """(word, n, other, other_n), both ways, of all words of (word, n) that one edit turns into another.

    The words are distinct and have at least four letters, so that the prefix
    holds two disjoint bigrams.
    """
    sides = _spread(materialize(words.mapInArrow(_keyed(gram_counts(words)), _SIDES), "gram-keys"), most)
    left = sides.where("pivot").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("last").alias("a_last"))
    right = sides.where("NOT pivot").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("last").alias("b_last"))
    alike = left.join(right, "key").where("a_last <= b_last AND a <> b AND abs(length(a) - length(b)) <= 1")
    alike = alike.where(F.levenshtein("a", "b", EDITS) == EDITS)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
                   F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    return alike.select(F.inline(both)).distinct()


def last_forms(links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form) lead to in the end; every round doubles the steps taken."""
    ends = materialize(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = ends.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = materialize(step, "forms")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        ends = step.select("word", "root")


def spelling_groups(docs: DataFrame, length: int = LENGTH, least: int = OCCURRENCES, ratio: int = RATIO, most: int = HOT_PAIRS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the documents.

    ``form`` is the near word with the most occurrences, of equals the smallest
    in code-point order, if it has ``ratio`` times those of the word; ``root``
    is the end of the chain of forms, which rises in occurrences and so has no
    circle.  Null and empty texts have no words; repeated rows count again; an
    empty table gives no rows.
    """
    words = vocabulary(docs, length, least)
    found = near_words(words, most).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    found = found.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    found = materialize(found, "near-words")
    roots = last_forms(found.where("form IS NOT NULL"))
    return words.join(found, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, tuple[Query, str | None]] = {"op13_spelling_variants": (op13_spelling_variants, None)}
