import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows, a long text, shared passages, clashing extra columns."""
    passage = " ".join(f"word{i} passes" for i in range(40))
    base = " ".join(f"term{i}" for i in range(120))
    texts = [None, "", " \n\t ", "One two", "one TWO", base, base.upper(), base + " and more", "x" * 150, "ab " * 90,
             passage + " first " + base, "second " + passage, passage, "token = 'abcdefgh1' AKIA" + "Z" * 14 + " " + "0af9" * 10,
             "lön | naïve   text " * 30, base.replace("term7 ", "other ")]
    rows = [(i, t, "en", "s", len(t or ""), 0, "clash", 1.0) for i, t in enumerate(texts)]
    rows.append((len(texts), " ".join(f"w{i % 997}" for i in range(30_000)), "en", "s", 0, 0, "clash", 1.0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, bucket string, score double")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
