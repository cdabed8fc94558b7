import corpus_pipeline
from clickloom.llm.common import materialize, table
from tests.llm import brute
from tests.llm.conftest import pairs

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, seen = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
    for name in [n for n, _ in corpus_pipeline.STAGES][:-1]:
        assert seen[name][1].columns == corpus_pipeline.COLUMNS and seen[name][1].count() <= seen[name][0].count()
    before, after = (dict(pairs(d)) for d in seen["exact_dedup"])
    last = {t.translate(brute.LOWER): i for i, t in sorted(before.items())}
    assert set(after) == set(last.values())
    before, after = (dict(pairs(d)) for d in seen["ngram_join"])
    classes = brute.near_classes(list(before.items()))
    assert set(after) == {i for i, (_, c) in classes.items() if i == c}
    before, after = (dict(pairs(d)) for d in seen["decontamination"])
    items = [" ".join(r.text.lower().split()) for r in table(spark, SF, "benchmark").collect()]
    leaked = {i for i, t in before.items() if any(x in " ".join(t.lower().split()) for x in items)}
    assert leaked <= set(before) - set(after) and len(set(before) - set(after)) <= len(leaked) + 1
    before, after = seen["packing"]
    assert {r.doc_id for r in after.select("doc_id").collect()} == set(dict(pairs(before)))


def test_odd_documents(spark, odd_docs):
    docs = odd_docs.union(odd_docs.where("doc_id = 5")).union(odd_docs.where("doc_id = 3").selectExpr("cast(null as bigint) doc_id", *odd_docs.columns[1:]))
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = materialize(stage(spark, docs, SF), name)
    assert docs.where("doc_id = 6").count() == 1 and docs.where("doc_id = 5").count() == 0
    empty = odd_docs.where("false")
    for _, stage in corpus_pipeline.STAGES[1:]:
        empty = materialize(stage(spark, empty, SF), "none")
    assert empty.count() == 0
