import collections
import random
import re
import zlib

import pytest

from clickloom.llm import spelling
from clickloom.llm.common import table
from tests.llm import brute
from tests.llm.conftest import pairs


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def expected(docs, length=7, least=2, ratio=10):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= length and c >= least}
    around = collections.defaultdict(set)
    by_gap = collections.defaultdict(set)
    for w in words:  # near words share a variant with one letter left out
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            for x in by_gap[v]:
                if near(w, x):
                    around[w].add(x)
                    around[x].add(w)
            by_gap[v].add(w)
    form = {}
    for w in words:
        best = min(around[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), c, len(around[w]), words.get(form[w])) for w, c in words.items()}


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    want = expected(pairs(table(spark, sf, "documents")))
    assert found(spelling.op13_spelling_variants(spark, sf)) == want
    assert any(w[0] for w in want.values())


@pytest.mark.parametrize("most", [0, 20, 10_000])  # 0: every key is cut further
@pytest.mark.parametrize("alphabet,length,least", [("ab", 5, 1), ("abcdefgh", 4, 1), ("aeä×Éé", 7, 1), ("rstl", 7, 2)])
def test_dense_words(spark, alphabet, length, least, most):
    rng = random.Random(len(alphabet))
    words = ["".join(rng.choices(alphabet, k=rng.randint(length, length + 3))) for _ in range(250)]
    for w in list(words):
        i = rng.randrange(len(w))
        words += [w[:i] + rng.choice(alphabet) + w[i + rng.randint(0, 1) :]] * rng.randint(0, 2) + [w] * rng.choice([0, 0, 1, 30])
    docs = [(i % 40, " ".join(rng.choices(words, k=60))) for i in range(80)]
    got = found(spelling.spelling_groups(spark.createDataFrame(docs, "doc_id long, text string"), length, least, 3, most))
    assert got == expected(docs, length, least, 3)


def test_chains_and_odd_rows(spark, odd_docs):
    chain = ["wanderweg", "wanderwegs", "wanderwege", "wanderwegee"]  # each ten times rarer
    docs = [(1000 + k, f"{w}. ") for w, c in zip(chain, (2000, 200, 20, 2)) for k in range(c)]
    docs += [(None, "GRÖSSEN grössen Größenwahn"), (None, "GRÖSSEN grössen Größenwahn"), (7, None), (8, ""), (9, "naïve-été×ÀÉÎÕÜ÷ 12 größenwahn größenwahn")]
    docs += [(r[0], r[1]) for r in pairs(odd_docs)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, word string, n int")
    want = expected(docs)
    assert found(spelling.spelling_groups(df)) == want
    assert want["wanderwege"][1] == "wanderweg" or want["wanderwege"][0] == "wanderweg"
    assert spelling.spelling_groups(df.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3])
def test_choice_of_pivots(k):
    import itertools

    rng = random.Random(k)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(1, 8)))
        cost = {p: rng.randint(1, 9) for p in places}
        all_ = [c for c in itertools.combinations(places, k) if all(b - a >= 2 for a, b in itertools.pairwise(c))]
        got = spelling.choose(places, cost, k, 2)
        assert (got is None) == (not all_)
        if all_:
            assert tuple(got) in all_ and sum(cost[p] for p in got) == min(sum(cost[p] for p in c) for c in all_)
