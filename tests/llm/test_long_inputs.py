"""Very long tokens, deep pages and broken markup: whole results in time that grows with the length."""

import random
import re
import time

import numpy as np
import pytest

from clickloom.llm import html, ngram_join, toxicity
from clickloom.llm.shingles import shingle_set

# what `core` and `odd` say, as patterns (quadratic on long tokens)
EDGES = re.compile(r"^[^\w@$!|+(€£]+|[^\w@$!|+(€£]+$")
SIGNS = re.compile(r"^([^\w])\1+|([^\w])\2+$")
ODD = re.compile(r"[^\W\d_].*(?:[\W\d_].*[^\W\d_]|[@$!|+(€£\d])|[@$!|+(€£\d].*[^\W\d_]|([^\W\d_])\1\1", re.S)


def test_tokens_are_read_as_the_patterns_say():
    rng = random.Random(1)
    for _ in range(20_000):
        token = "".join(rng.choice("ab1_-.$!(é²€") for _ in range(rng.randint(1, 9)))
        word = EDGES.sub("", SIGNS.sub("", token))
        assert toxicity.core(token) == word and toxicity.odd(word) == bool(ODD.search(word)), token


@pytest.mark.parametrize("token", ["ab" * 250_000 + "!", "a" + "-" * 500_000 + "b", "-=" * 250_000 + "a", "-" * 500_000])
def test_a_very_long_token_takes_one_pass(token):
    start = time.process_time()
    toxicity.odd(toxicity.core(token))
    assert time.process_time() - start < 2


def test_a_deep_page_is_read_in_linear_time():
    start = time.process_time()
    text, path = html.extract("<div>x" * 20_000, ["div>div"])
    assert time.process_time() - start < 10
    assert text.count("x") == 20_000 and path.startswith("div")


def test_a_quote_never_closed_ends_with_its_tag():
    text, _ = html.extract("<article><p>First words.</p><p><a href='foo>bar</a> rest</p></article>", [])
    assert text == "First words.\nbar rest"


@pytest.mark.parametrize("rule", ["Short rule.", "A rule of more than a hundred characters, which stays as well, for no length decides on text. " * 2])
def test_paragraphs_of_an_article_stay_whatever_their_length(rule):
    text, _ = html.extract(f"<article><p>First words.</p><p class='legal-basis'>{rule}</p></article>", [])
    assert text == "First words.\n" + rule.strip()
    short = "<article><p>First words.</p><div class='share-box'>Share this</div><p class='share'>Now</p></article>"
    assert html.extract(short, [])[0] == "First words."


def test_signatures_without_a_sort_are_those_of_the_cut():
    rng = np.random.default_rng(2)
    for n in (1, 7, 40, 900, 20_000):
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        ks = ngram_join.spaces(len(s))
        for k, got in zip(ks, ngram_join.signatures(s, ks)):
            assert np.array_equal(got, ngram_join.cut(s, k)[1])


def test_shingles_keep_words_and_order():
    words = [f"w{i}".encode() for i in range(12)]
    assert len(shingle_set(b" ".join(words))) == 8
    one = shingle_set(b" ".join(words[:5]))
    for other in ([*words[:3], words[4], words[3]], words[1:6], words[:4]):
        assert not np.intersect1d(one, shingle_set(b" ".join(other))).size
    assert np.array_equal(shingle_set(b"A b\tC"), shingle_set(b"a  B\nc")) and not shingle_set(b" \t").size
    assert len(shingle_set(b"a " * 50)) == 1
