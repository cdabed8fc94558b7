"""Category and token transforms as Columns.

Index 0 always means "missing or not in the vocabulary"; known values are 1..n
in vocabulary order.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark scans a map literal entry by entry, so ``apply_spec`` looks longer vocabularies up in another way.
MAP_LITERAL_LIMIT = 64


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vocab_map(vocab: Sequence) -> Column:
    """Map literal value -> index for a short vocabulary."""
    if len(vocab) > MAP_LITERAL_LIMIT:
        raise ValueError(f"{len(vocab)} values: use a vocabulary table and a join")
    pairs: list[Column] = []
    for i, value in enumerate(vocab, 1):
        pairs += [F.lit(str(value)), F.lit(i)]
    return F.create_map(*pairs)


def place(c: Column, vocab: Sequence) -> Column:
    """Index of a text in a given vocabulary of any length, 0 if it is null or unknown."""
    if 0 < len(vocab) <= MAP_LITERAL_LIMIT:
        return F.coalesce(F.element_at(vocab_map(vocab), c), F.lit(0))
    words = F.array(*[F.lit(str(v)) for v in vocab]).cast("array<string>")
    return F.coalesce(F.array_position(words, c).cast("int"), F.lit(0))


def index_literal(c, vocab: Sequence) -> Column:
    return place(_col(c).cast("string"), vocab)


def tokens(c, sep: str = ",", max_len: int | None = None) -> Column:
    """Split on a literal separator, keep the first ``max_len`` parts."""
    parts = F.split(_col(c), re.escape(sep))
    return parts if max_len is None else F.slice(parts, 1, max_len)


def pad(arr: Column, max_len: int, value: Column) -> Column:
    return F.slice(F.concat(arr, F.array_repeat(value, max_len)), 1, max_len)


def split_pad_index(c, vocab: Sequence, max_len: int = 10, sep: str = ",") -> Column:
    """Tokens -> indices, then padded with 0 or cut to ``max_len``; a null text counts as the empty one."""
    idx = F.transform(tokens(F.coalesce(_col(c), F.lit("")), sep, max_len), lambda t: place(t, vocab))
    return pad(idx, max_len, F.lit(0))


def split_index_v2(c, vocab: Sequence, max_len: int, sep: str = " ") -> Column:
    """Tokens cut and padded with '' first, then looked up; a null text counts as the empty one."""
    return F.transform(
        pad(tokens(F.coalesce(_col(c), F.lit("")), sep, max_len), max_len, F.lit("")), lambda t: place(t, vocab)
    )


def split_pad_number(c, max_len: int = 30, sep: str = ",") -> Column:
    """Numeric tokens padded with 0; an empty or null text counts as '0'."""
    text = F.when(F.coalesce(_col(c), F.lit("")) == "", F.lit("0")).otherwise(_col(c))
    nums = F.transform(tokens(text, sep, max_len), lambda t: t.try_cast("float"))
    return pad(nums, max_len, F.lit(0).cast("float"))


def hash_bucket(c, n: int, mask_zero: bool = False) -> Column:
    """Hash of the text form into ``[0, n)``; with ``mask_zero`` '0' -> 0 and the rest ``1..n-1``.

    Same range, determinism and mask as the definition; the hash itself is the
    head of the text's md5, so the numbers are not those of another framework,
    but any engine can work them out.
    """
    if n < (2 if mask_zero else 1):
        raise ValueError("too few buckets")
    text = _col(c).cast("string")
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    if not mask_zero:
        return F.pmod(number, F.lit(n)).cast("int")
    return F.when(text.isin("0", "0.0"), F.lit(0)).otherwise((F.pmod(number, F.lit(n - 1)) + 1).cast("int"))


def seq_mask(idx) -> Column:
    return F.transform(_col(idx), lambda i: (i != 0).cast("int"))


def seq_length(idx) -> Column:
    return F.size(F.filter(_col(idx), lambda i: i != 0))


def length_mask(length, max_len: int) -> Column:
    """Mask from a given length: 1 for the first ``length`` of ``max_len`` steps."""
    return F.transform(F.sequence(F.lit(1), F.lit(max_len)), lambda i: (i <= _col(length)).cast("int"))


def one_hot(idx, n: int) -> Column:
    """0/1 array of length ``n + 1`` (slot 0 is the unknown value)."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: (i == _col(idx)).cast("int"))


def multi_hot(idx, n: int) -> Column:
    """Occurrences of every index 1..n (padding is not counted)."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(n)), lambda i: F.size(F.filter(_col(idx), lambda e: e == i))
    )


def k_max(arr, k: int) -> Column:
    if k < 1:
        raise ValueError("k must be at least 1")
    return F.slice(F.sort_array(_col(arr), asc=False), 1, k)


# Named text clean-ups that run before a vocabulary is fitted or looked up.
CLEANUPS = {
    "split_dot_get_last": lambda c: F.substring_index(_col(c), ".", -1),
}


def cleanup(name: str | None, c) -> Column:
    if name is None:
        return _col(c)
    if name not in CLEANUPS:
        raise ValueError(f"unknown clean-up {name!r}; known: {sorted(CLEANUPS)}")
    return CLEANUPS[name](c)
