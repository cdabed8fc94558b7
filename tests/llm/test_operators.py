import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clickloom.llm import common, decontaminate, exact_dedup, html, ngram_join, ngram_lm, packing, secrets, substrings, tokens, toxicity, wavelet
from clickloom.llm.catalog import ORACLES, QUERIES
from clickloom.llm.common import components, table
from tests.compare import check, duck
from tests.llm import brute
from tests.llm.conftest import pairs

SF = "/root/testdata/sf0.001"
EMPTY = "doc_id long, text string"


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    assert check(spark, duck(SF), SF, name, QUERIES, ORACLES) is None


# exact duplicates

@pytest.mark.parametrize("bits", [64, 3])  # 3: nearly all chunk hashes collide
def test_exact_duplicates(spark, odd_docs, bits):
    got = by_id(exact_dedup.exact_duplicates(odd_docs, bits), "keep_id", "group_size", "kept")
    groups = {}
    for i, t in pairs(odd_docs):
        groups.setdefault((t or "").translate(brute.LOWER), []).append(i)
    assert got == {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}


def test_exact_duplicates_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "A"), (None, "a"), (None, "b")], EMPTY)
    rows = exact_dedup.exact_duplicates(docs).collect()
    found = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in rows)
    assert found == [("1", "1", 3, False), ("1", "1", 3, True), ("None", "1", 3, False), ("None", "None", 1, True)]
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


# near duplicates

def test_near_duplicates(spark, odd_docs):
    got = by_id(ngram_join.similarity_classes(odd_docs), "n_shingles", "component_id")
    assert got == brute.near_classes(pairs(odd_docs))


def test_near_duplicates_of_random_edits(spark):
    rng = np.random.default_rng(7)
    docs = []
    for size in (3, 4, 6, 7, 9, 14, 15, 16, 26, 27, 28, 40, 47, 48, 62, 63, 86, 150):
        base = [f"b{size}x{i}" for i in range(size + 4)]
        for edits in range(5):
            w = list(base)
            for at in rng.integers(0, len(w), edits // 2):
                w[at] = f"e{len(docs)}"
            w = w[: len(w) - int(rng.integers(0, 1 + size // 6))] + [f"t{len(docs)}"] * (edits % 2)
            docs.append((len(docs), " ".join(w)))
    df = spark.createDataFrame(docs, EMPTY)
    assert by_id(ngram_join.similarity_classes(df), "n_shingles", "component_id") == brute.near_classes(docs)


def test_near_duplicates_of_repeated_rows(spark):
    t = "a b c d e f g"
    df = spark.createDataFrame([(5, t), (5, t), (None, t), (9, "z")], EMPTY)
    assert sorted((str(r.doc_id), r.component_id) for r in ngram_join.similarity_classes(df).collect()) == [("5", 5), ("5", 5), ("9", 9), ("None", 5)]


def test_segments_reach_the_bound():
    # a set within the bound of another has an equal segment, or one that differs in one shingle, among those it relies on
    rng = np.random.default_rng(1)
    for n in (5, 12, 30, 60, 200, 900):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for k in ngram_join.spaces(len(a)):
            at, sig, size, _ = ngram_join.cut(a, k)
            assert len(np.unique(at)) == len(at) and size.sum() == len(a)
            assert len(at) + (size > 1).sum() * (ngram_join.BANDS[k] < ngram_join.SMALL) >= ngram_join.need(len(a)) or n < 20


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (3, 7), (20, 21)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {**dict.fromkeys([1, 2, 3, 7, 8, 9], 1), 20: 20, 21: 20}


# repeated strings

def test_repeated_strings(spark, odd_docs):
    docs = odd_docs.where("doc_id < 16")
    got = by_id(substrings.repeated_strings(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(pairs(docs))


def test_repeated_strings_of_split_hashes(spark, monkeypatch):
    # one passage in many contexts; in a local session the tasks fork from this process
    monkeypatch.setattr(substrings, "SPLIT", 4)
    shared = "the same passage of text stands here, long enough to repeat itself in whole and in part " * 2
    docs = [(i, f"context {i * 7919} before " * 3 + shared[i % 3 :] + f" and {i * 104729} after" * 4) for i in range(30)]
    got = by_id(substrings.repeated_strings(spark.createDataFrame(docs, EMPTY)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeats(docs)
    direct = [((7, 2, False, i, i, 10, (shared[:60] + f"{i:04d}" + shared).encode()),) for i in range(2)]
    removed, split = substrings.sort_shard([x for (x,) in direct])
    assert removed and split and all(len(s) == 100 for s in split[0][1]) and split[0][1] == sorted(split[0][1])


def test_suffix_array_and_common_prefixes():
    for text in (b"", b"a", b"banana", b"aaaaaaaaaaaaaaaaaaaa", bytes(np.random.default_rng(3).integers(0, 3, 400).astype(np.uint8)), b"abc" * 70):
        data = np.frombuffer(text, np.uint8)
        order, rank = substrings.suffix_array(data)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        if len(text) < 2:
            continue
        lcp = substrings.common_prefixes(data, order, rank, np.array([0, len(text) // 2]), 50)
        for r in range(1, len(text)):
            a, b = text[order[r - 1] :], text[order[r] :]
            assert lcp[r] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y or i == 50), min(len(a), len(b), 50))


# token files and packing

@pytest.mark.parametrize("file", [packing.VOCABULARY, wavelet.VOCABULARY])
def test_chunked_encoding_equals_the_tokenizer(spark, odd_docs, file):
    e = tokens.Encoder(file)
    for text in [t or "" for _, t in pairs(odd_docs)] + ["a\t  b", "\n\n a  b \n", "don't  'll x's", "a\x1c!\x1c b", "<|endoftext|>", "日本 語\n\n", "é é"]:
        assert np.frombuffer(e(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("file, ids", [(packing.VOCABULARY, None), (wavelet.VOCABULARY, None), ("byte_bpe_50k.json", [64, 50256, 65]), ("word_bpe_49k.json", [320, 49407, 321])])
def test_added_tokens_in_a_text_are_encoded_as_by_the_file(file, ids):
    import public_tokenizers
    from tokenizers import Tokenizer

    e, fresh = tokens.Encoder(file), Tokenizer.from_file(public_tokenizers.path(file))
    for text in ("a<|endoftext|>b", "<|startoftext|> a b <|endoftext|>", "one<|ENDOFTEXT|> two", "<|endoftext|><|endoftext|>", "a <|endoftext|>\n\n b's", "日本<|endoftext|>語 é", "<|endof text|> x"):
        assert np.frombuffer(e(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids
    assert ids is None or np.frombuffer(e("a<|endoftext|>b"), "<u4").tolist() == ids


def test_token_files(spark, odd_docs, tmp_path):
    path = str(tmp_path / "shards")
    wavelet.write_shards(odd_docs, path, size=500)
    got = by_id(wavelet.read_documents(spark, path), "start", "n_tokens", "ids_crc32")
    e, start = tokens.Encoder(wavelet.VOCABULARY), 0
    for i, t in sorted(pairs(odd_docs)):
        raw = e(t or "") + b"\0\0\0\0"
        assert got[i] == (start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    wavelet.write_shards(spark.createDataFrame([], EMPTY), str(tmp_path / "none"))
    assert wavelet.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_wavelet_lookup():
    ids = np.random.default_rng(0).integers(0, 37, 3000).astype(np.uint32)
    m = wavelet.WaveletMatrix.build(ids)
    assert m.ids().tolist() == ids.tolist()
    for i in (0, 511, 512, 2999):
        assert m.access(i) == ids[i]
    for token in (0, 5, 36, 99):
        at = np.flatnonzero(ids == token)
        assert m.count(token, 100, 2000) == ((at >= 100) & (at < 2000)).sum()
        assert [m.find(token, k) for k in (0, len(at) - 1, len(at))] == ([at[0], at[-1], None] if len(at) else [None] * 3)


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(5)
    for capacity in (7, 16, 100):
        counts = {int(x): int(n) for x, n in zip(rng.permutation(np.arange(1, capacity + 1))[:9], rng.integers(1, 40, 9))}
        free, windows = [], {}
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [r for r in free if r >= length]
                if fits:
                    free.remove(min(fits))
                free.append((min(fits) if fits else capacity) - length)
        for length, first, last, sequence, each, offset in packing.plan(counts, capacity):
            for i in range(last - first):
                windows.setdefault(sequence + i // each, []).append((offset + i % each * length, length))
        for w in windows.values():  # gapless, within the capacity
            assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(w), sorted(w)[1:])) and sorted(w)[0][0] == 0 and sum(x for _, x in w) <= capacity
        assert sorted(capacity - sum(x for _, x in w) for w in windows.values()) == sorted(free)


def test_packing(spark, odd_docs):
    pieces = packing.best_fit(packing.cut_documents(odd_docs, capacity=64), 64).collect()
    e, docs = tokens.Encoder(packing.VOCABULARY), {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == len(docs.setdefault(p.doc_id, b"")) // 4 and len(p.ids) == 4 * p.length
        docs[p.doc_id] += p.ids
    assert docs == {i: e(t or "") + (2).to_bytes(4, "little") for i, t in pairs(odd_docs)}
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    assert all(a + n == b for s in sequences.values() for (a, n), (b, _) in zip(sorted(s), sorted(s)[1:]))
    assert packing.best_fit(packing.cut_documents(spark.createDataFrame([], EMPTY))).count() == 0


# secrets

def test_secrets(spark, odd_docs):
    more = spark.createDataFrame([(100, "Token: abcdefg API_KEY='x1x1x1x1' secret=short PASSWORD = hunter2hunter2"), (101, "user = alice, host: db.example.com password: s3cr3t-s3cr3t")], EMPTY)
    docs = odd_docs.select("doc_id", "text").union(more)
    got = by_id(secrets.find_secrets(docs).withColumn("l", secrets.listing("base")).withColumn("all", secrets.listing("spans")), "n_assign", "n_access", "n_hex", "l", "all")
    for i, t in pairs(docs):
        counts, listing = brute.secrets(t or "")
        assert got[i][:4] == (*counts, listing)
    assert got[101][4] == "identifier:0:12,endpoint:14:34,assign:35:58"  # weak parts beside their complement
    assert secrets.find_secrets(spark.createDataFrame([], EMPTY)).count() == 0


def test_weak_parts_alone_are_not_reported(spark):
    far = "user = alice " + "x " * 400 + "password: s3cr3t-s3cr3t"
    df = spark.createDataFrame([(1, "user = alice, host: db.example.com"), (2, far)], EMPTY)
    got = by_id(secrets.find_secrets(df).withColumn("all", secrets.listing("spans")), "all")
    assert got[1] == ("",) and got[2][0].startswith("assign:") and "," not in got[2][0]


def test_links_of_long_parts_equal_a_brute_force_join(spark):
    rng = np.random.default_rng(11)
    parts = [(-1, 199, 3, 349), (-1, 0, 0, 99), (-1, 449, 2, 500), (-2, 0, 0, 150), (-2, 350, 3, 360), (-3, 0, 0, 150), (-3, 351, 3, 361), (-4, 0, 5, 900), (-4, 400, 3, 410), (-4, 420, 0, 440)]
    for row in range(400):
        at = 0
        for _ in range(int(rng.integers(2, 6))):
            start = max(0, at + int(rng.integers(-150, 450)))  # overlaps too
            at = start + int(rng.integers(150, 1001) if rng.random() < 0.6 else rng.integers(5, 60))
            parts.append((row, start, int(rng.integers(0, 6)), at))
    parts = sorted(set(parts))
    expected = set()
    for row, start, kind, end in parts:
        near = {secrets.KINDS[k] for r, a, k, b in parts if r == row and max(start - b, a - end) <= secrets.SCOPE}
        if kind >= 3 and all(near & set(group) for group in secrets.NEEDS[secrets.KINDS[kind]]):
            expected.add((row, start, kind, end))
    got = [tuple(r) for r in secrets.link_parts(spark.createDataFrame(parts, "row long, start int, kind int, end int")).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert {(-1, 199, 3, 349), (-2, 350, 3, 360), (-4, 0, 5, 900)} <= expected and (-3, 351, 3, 361) not in expected


def test_weak_parts_beside_long_or_overlapping_parts(spark):
    run = "0af9" * 100
    texts = [run + " " * 150 + "user = alice", "https://h.example.com/?user=alice&password=s3cr3ts3cr3t", run + " " * 201 + "user = alice"]
    got = by_id(secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), EMPTY)).withColumn("all", secrets.listing("spans")), "all")
    assert got[0] == ("hex:0:400,identifier:550:562",) and got[2] == ("hex:0:400",)
    assert "endpoint:0:55" in got[1][0] and "identifier:23:" in got[1][0]


# scores

def test_backoff_scores(spark, odd_docs):
    got = by_id(ngram_lm.backoff_scores(odd_docs), "n_words", "n_backed_off", "log_score")
    for i, (n, back, score) in brute.backoff(pairs(odd_docs)).items():
        assert got[i][:2] == (n, back) and got[i][2] == pytest.approx(score)
    assert ngram_lm.backoff_scores(spark.createDataFrame([], EMPTY)).count() == 0


def test_backoff_scores_of_repeated_rows(spark, odd_docs, monkeypatch):
    """Rows that share or lack a doc_id are documents of their own; small hand-overs and slices change nothing."""
    rows = [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (1, "a dog"), (None, "the dog sat"), (None, "the dog sat"), (None, None)]
    want = sorted(brute.backoff(list(enumerate(t for _, t in rows))).values(), key=str)
    for held, slices in ((500_000, 8), (2, 1), (3, 64)):
        monkeypatch.setattr(ngram_lm, "HELD", held)
        monkeypatch.setattr(ngram_lm, "SLICES", slices)
        got = ngram_lm.backoff_scores(spark.createDataFrame(rows, EMPTY)).collect()
        mine = sorted(((r.n_words, r.n_backed_off, round(r.log_score, 9)) for r in got), key=str)
        assert mine == sorted(((a, b, round(c, 9)) for a, b, c in want), key=str)


# decontamination

def test_closest_is_the_edit_distance():
    def plain(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    rng = np.random.default_rng(2)
    for _ in range(60):
        item, text = ("".join(rng.choice(list("abc"), n)) for n in rng.integers(1, 40, 2))
        assert decontaminate.closest(item, text)[0] == plain(item, text)


def test_contamination(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards boil a pot of very strong tea"
    edited = item.replace("jumps", "jumpt").replace("tea", "te")  # two edits of four allowed
    docs = [(0, f"before {item.upper()} after"), (1, f"x {edited}\n y"), (2, item[:60]), (3, None), (4, ""), (5, "clean " * 100), (6, item.replace(" ", "\n\t "))]
    df = spark.createDataFrame([(*d, "clash") for d in docs + [(6, docs[6][1])]], EMPTY + ", item_id string")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (10, "zzzz not there zzzz")], "item_id long, text string")
    rows = decontaminate.contamination(df, bench).collect()
    assert sorted(r.doc_id for r in rows if r.contaminated) == [0, 1, 6, 6] and len(rows) == 8
    assert {r.doc_id: r.least_distance for r in rows if r.contaminated} == {0: 0, 1: 2, 6: 0}
    blocks = decontaminate.find_passages(df.withColumn("row", F.col("doc_id")).where("text IS NOT NULL"), bench, chars=10)
    assert {r.item_id for r in blocks.collect()} == {7}
    assert not any(r.contaminated for r in decontaminate.contamination(df, bench.limit(0)).collect())


def test_items_without_an_id_are_searched(spark):
    one, two = "the quick brown fox jumps over the lazy dog", "seven wizards boil a pot of very strong tea"
    docs = spark.createDataFrame([(0, f"x {one} y"), (1, f"{two} and {one}"), (2, "clean " * 20), (3, two)], EMPTY)
    bench = spark.createDataFrame([(None, one), (None, one), (7, two), (None, None), (None, " ")], "item_id long, text string")
    got = by_id(decontaminate.contamination(docs, bench), "n_hits", "item_ids", "least_distance", "contaminated")
    assert got == {0: (1, [], 0, True), 1: (2, [7], 0, True), 2: (0, [], None, False), 3: (1, [7], 0, True)}


# toxicity

def test_decoder_restores_disguised_words():
    text = ["the idiot is a stupid clown and this person is here with that other thing"] * 50
    n = np.full(toxicity._size**3, 0.05)
    for word in " ".join(text).split():
        codes = [0, 0, *(toxicity._code[c] for c in word), 0]
        for x in zip(codes, codes[1:], codes[2:]):
            n[toxicity._gram(*x)] += 1
    n = n.reshape((toxicity._size,) * 3)
    d = toxicity.Decoder(np.log(n / n.sum(axis=2, keepdims=True)).astype(np.float32))
    assert {"idiot", "stupid", "clown"} <= d.restore("1d10t $tup1d!!! c-l-o-w-n")
    assert "stupid" in d.restore("stuuuupid") and "clown" in d.restore("c l o w n") and "clown" in d.restore("clown###")
    assert d.restore("") == set()


def test_decoder_reads_spaced_words_with_signs():
    n = np.full(toxicity._size**3, 0.05)
    for word in "the idiot is a stupid clown and this person is here with that other thing".split() * 50:
        codes = [0, 0, *(toxicity._code[c] for c in word), 0]
        for x in zip(codes, codes[1:], codes[2:]):
            n[toxicity._gram(*x)] += 1
    n = n.reshape((toxicity._size,) * 3)
    d = toxicity.Decoder(np.log(n / n.sum(axis=2, keepdims=True)).astype(np.float32))
    for text, word in [("s t u p ! d", "stupid"), ("$ t u p 1 d", "stupid"), ("i d ! o t", "idiot"), ("i - d - i - o - t", "idiot"), ("he is - c . l . 0 . w . n !", "clown"), ("i _ d _ i _ o _ t", "idiot")]:
        assert word in d.restore(text), text
    assert d.restore("1 2 3 4 - -") <= {"1", "2", "3", "4"} and d.restore("- - | - -") == set()


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = toxicity.score_toxicity(docs.withColumn("toxic", F.lit(9)), labels)
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0 and scored.count() == docs.count()
    held = scored.where("held_out").join(labels, "doc_id").select("score", "toxic").toPandas()
    assert scored.where("held_out").where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").count() == 0
    pos, neg = held.score[held.toxic == 1].to_numpy(), held.score[held.toxic == 0].to_numpy()
    assert ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2) > 0.8
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "x" * 100_000)], EMPTY)
    assert toxicity.score_toxicity(odd, labels.limit(0)).select("score").distinct().count() == 1


def test_repeated_rows_of_a_label_are_fitted_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(toxicity, "materialize", lambda df, name: kept.append(df) or df)
    docs = spark.createDataFrame([(1, "b b"), (1, "a a")] * 40 + [(i, f"text {i}") for i in range(2, 20)], EMPTY)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 20)], "doc_id long, toxic int")
    toxicity.score_toxicity(docs, labels, sample=10)
    toxicity.score_toxicity(docs, labels)
    assert kept[0].count() <= 10
    texts = [r.text for r in kept[1].collect()]
    assert texts.count("a a") == 1 and "b b" not in texts


# pages

def test_main_text(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>"
        "<div class='content'><h1>Title &amp; more</h1><p>First  <b>bold</b>\n text with enough words to count.<p>Second one.<br>"
        "<div class='ad-slot'>Buy</div><ul><li>item 1<li>item 2</ul><form>Name <input></form></div>"
        "<aside>Side</aside><section id='comments'><p>Nice post, I have a very long comment about all of this.</p></section><script>var x='<p>no</p>'</script>"
        "<footer>&copy; end</footer></body></html>"
    )
    rows = [(i, "http://h.example.com/a", page, "clash") for i in range(3)] + [(3, None, None, "c"), (4, "odd", "", "c"), (5, "http://h.example.com/b", "just <i>text</i>", "c"), (5, "http://h.example.com/b", "<div><p>cut off <b>here &lt", "c")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    texts = {}
    for r in got:
        texts.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert texts[0] == ["Title & more\nFirst bold text with enough words to count.\nSecond one.\nitem 1\nitem 2"]
    assert texts[3] == [""] and texts[4] == [""] and sorted(texts[5]) == ["cut off here <", "just text"]
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_sections_with_ids_made_from_headings_are_kept(spark):
    ids = ["side-effects", "recommendations", "related-work", "legal-basis", "search-methods", "comments", "social-policy", "promotion"]
    sections = "".join(f"<section id='{x}'><h2 id='{x}-1'>{x.replace('-', ' ').title()}</h2><p>What is said in {x}.</p></section>" for x in ids)
    links = "<a href=x>Other story of the day</a> <a href=y>One more story</a>"
    noise = f"<div class='related'>All of this is related to it, as one can see. {'More of it. ' * 20}</div><div id='share-box'>{links}</div><div class='ad-slot'>Buy</div><p>Read <span class='social-links'>{links}</span>on.</p>"
    page = f"<body><article><h1>T</h1><p>One <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> two.</p>{sections}{noise}</article></body>"
    wanted = ["T", "One x=2 two.", *(y for x in ids for y in (x.replace("-", " ").title(), f"What is said in {x}.")), "Read on."]
    rest = f"<div class='post'><p>{'The text itself. ' * 20}</p><div id='side-effects'><h2>Side effects</h2><p>None.</p></div><h2 id='legal-basis'>Legal basis</h2><p>Some.</p><div id='site-search'>Go</div></div>"
    pages = [(1, "http://a.example.com/", page), (2, "http://b.example.com/", rest)]
    got = {r.page_id: r.text.split("\n") for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == wanted
    assert got[2][1:] == ["Side effects", "None.", "Legal basis", "Some."]


def test_titles_and_leads_outside_the_inner_container_are_kept(spark):
    body, links = "<p>" + "The long text of the body itself. " * 20 + "</p>", "<a href=x>Other story</a>"
    long = ("The long text of the body itself. " * 20).strip()
    layouts = [
        (f"<div class=post><h1>Title</h1><div class=lead>A lead.</div><div class=body>{body}</div></div>", ["Title", "A lead.", long]),
        (f"<h1>Title</h1><div class=lead>A lead.</div><div class=body>{body}</div>", ["Title", "A lead.", long]),
        (f"<div class=page><div class=post><h1>Title</h1><section id=a><h2>One</h2>{body}</section><section id=b><h2>Two</h2><p>Short.</p></section></div><div class=more>{links}</div></div>", ["Title", "One", long, "Two", "Short."]),
        (f"<div class=top>The site</div><div class=body>{body}</div><div class=more>{'Another story. ' * 5}</div>", [long]),
        (f"<div class=wrap><div class=list>{links}</div><div class=body>{body}</div></div>", [long]),
    ]
    pages = [(10 * k + i, f"http://h{k}.example.com/{i}", f"<body>{layout}</body>") for k, (layout, _) in enumerate(layouts) for i in range(2)]
    got = {r.page_id: r.text.split("\n") for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {10 * k + i: wanted for k, (_, wanted) in enumerate(layouts) for i in range(2)}


def test_hosts_agree_on_a_path(spark):
    usual = [(i, "http://a.example.com/", f"<body><div class='post p{i}'><p>{'long text of the article itself ' * 20}</p></div><div class='teasers'><p>{'other story ' * 5}</p></div>") for i in range(9)]
    odd = [(9, "http://a.example.com/", f"<body><div class='post p9'><p>short text.</p></div><div class='teasers'><p>{'other story ' * 90}</p></div>")]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(usual + odd, "page_id long, url string, html string")).collect()}
    assert got[9] == "short text."


def test_catalog_lists_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_tried_pairs_are_looked_up_once_a_pair(spark, monkeypatch):
    """Two sets that share many segments are one row of the anti join."""
    asked, plain = [], ngram_join.materialize

    def written(df, label):
        asked.append((label, plain(df, label)))
        return asked[-1][1]

    monkeypatch.setattr(ngram_join, "materialize", written)
    rows = [(0, s, node, 300, True, 9 - node, node) for s in range(100) for node in (1, 2, 3)]
    equal = spark.createDataFrame(rows, "space int, sig long, node long, n long, probe boolean, weight long, component long")
    tried = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [tuple(r) for r in ngram_join._partners(equal, tried).collect()] == [(1, 3)]
    assert {label: df.count() for label, df in asked}["shared"] == 2


def test_texts_travel_in_small_batches(spark, odd_docs):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)

    @common.small_batches
    def plan(docs, fail=False):
        seen.append(int(spark.conf.get(key)))
        return 1 / 0 if fail else docs

    assert plan(odd_docs) is odd_docs
    with pytest.raises(ZeroDivisionError):
        plan(odd_docs, fail=True)
    assert seen == [common.TEXT_ROWS] * 2 and spark.conf.get(key) == before
    assert all(hasattr(f, "__wrapped__") for f in (ngram_join.similarity_classes, ngram_lm.backoff_scores))


def test_trigrams_of_texts_are_those_of_their_words():
    texts = ["", "I", "ab  c_d e9f \u00b2x \u00bd", "ÄÖ\u0130Σ ß日本 don't\n\ttwo", "\ud800 a\x00b", "x" * 9]
    n = np.zeros(toxicity._size**3, int)
    for text in texts:
        for word in toxicity._words.findall(text.lower()):
            codes = [0, 0, *(toxicity._code.get(c, 0) for c in word), 0]
            for x in zip(codes, codes[1:], codes[2:]):
                n[toxicity._gram(*x)] += 1
    assert (toxicity.text_grams(texts) == n).all() and not toxicity.text_grams([]).any()


def test_ascii_letters_need_no_bytes():
    for file in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokens.Encoder(file)
        e.bytes = None
        for chunk in ("Word", " word") if e.byte_level else ("word",):
            assert e._piece(chunk) == e._whole(chunk)


def test_pairs_meet_a_few_times_however_much_they_share(spark):
    """Sets of different components that share many segments are a few rows of the join, and no pair is lost."""
    sketches = spark.range(1, 13).selectExpr("id node", *(f"0L {c}" for c in ngram_join.SKETCH))
    kinds = "space int, sig long, kind int, node long, n long, form int, probe boolean, component long"
    same = [(7, s, 0, node, 900, 0, node == 1 or s % 3 == 0, node) for s in range(300) for node in (1, 2, 3)]
    met = ngram_join._meetings(spark.createDataFrame(same, kinds), sketches)
    assert {tuple(r) for r in met.collect()} == {(1, 2), (1, 3), (2, 3)} and met.count() <= 12
    rng = np.random.default_rng(3)
    for share in (0.02, 0.3, 0.8):
        rows = [(7 + s % 2, s, 0, node, 900, 0, bool(rng.random() < 0.2), node // 2) for s in range(200) for node in range(1, 13) if rng.random() < share]
        want = {(x[3], y[3]) for x in rows for y in rows if x[1] == y[1] and x[3] < y[3] and x[7] != y[7] and (x[6] or y[6])}
        assert {tuple(r) for r in ngram_join._meetings(spark.createDataFrame(rows, kinds), sketches).collect()} == want


def test_batches_are_limited_in_bytes(spark, odd_docs):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, sizes = spark.conf.get(key), common.small_batches(lambda docs: spark.conf.get(key))
    assert int(sizes(odd_docs)) == common.BATCH_BYTES and spark.conf.get(key) == before
    try:
        spark.conf.set(key, "64k")  # a smaller limit stays
        assert sizes(odd_docs) == spark.conf.get(key) != str(common.BATCH_BYTES)
    finally:
        spark.conf.set(key, before)


def test_counts_are_packed_over_small_batches():
    words = np.arange(5000, dtype=np.int64)
    batches = (pa.RecordBatch.from_arrays([pa.array(words[i : i + 500]), pa.array(words[i : i + 500])], ["word", "n"]) for i in range(0, 5000, 500))
    blocks = list(common.freed(ngram_lm._pack_counts(4))(batches))
    assert len(blocks) == 4
    word, row, n = (np.concatenate(x) for x in zip(*ngram_lm._slices(iter(blocks), 2, False)))
    assert sorted(zip(word.tolist(), n.tolist())) == [(i, i) for i in range(5000)] and set(row) == {ngram_lm.COUNT_ROW}
