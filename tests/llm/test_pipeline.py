import corpus_pipeline
from logweft.llm import common

from test_dedup import jaccard_model
from test_rows import WORD, check_packing, quality_model


def test_stages(spark, docs, rows):
    text = dict(rows)
    current, left = docs, dict(rows)
    for name, stage in corpus_pipeline.STAGES:
        current = common.written(stage(spark, current, "unused"), name)
        if name == "quality_rules":
            left = {i: t for i, t in left.items() if quality_model(t)[-1]}
        elif name == "exact_dedup":
            last = {t: i for i, t in sorted(left.items())}
            left = {i: t for i, t in left.items() if last[t] == i}
        elif name == "jaccard_join":
            left = {i: left[i] for i, (_, c) in jaccard_model(list(left.items())).items() if c == i}
        if name == "best_fit_packing":
            got = [r.asDict() for r in current.collect()]
            check_packing(got, {i: len(WORD.findall(t)) for i, t in left.items()}, (512, 1024, 2048, 4096))
            assert {p["doc_id"] for p in got} == set(left)
        else:
            assert current.columns == docs.columns
            assert {r.doc_id: r.text for r in current.collect()} == {i: text[i] for i in left}


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        current = docs
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, "unused").count() >= 0
            current = common.written(stage(spark, current, "unused"), name)
        assert current.columns == ["doc_id", "piece", "start", "n_words", "bin_id", "bin_offset", "capacity"]
        if docs is no_docs:
            assert current.count() == 0


def test_secrets_are_masked(spark):
    docs = spark.createDataFrame([(1, "my password = hunter2hunter2 ok", "en", "s", 31), (2, None, None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.secrets(spark, docs, "unused").collect()}
    assert got == {1: ("my [SECRET] ok", 14), 2: (None, None)}
