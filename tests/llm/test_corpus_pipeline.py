"""The corpus pipeline against a brute-force version of its stages."""



import corpus_pipeline
from meterload.llm import langid, mixing
from meterload.llm.common import table
from tests.llm.test_decontaminate import shingles
from tests.llm.test_simhash import slow_one_of_each

FOLDER = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [r.text for r in table(spark, FOLDER, "benchmark").collect()]

    model = langid.learn(docs)
    kept = [r for r in rows if langid.judge(r[1], model)[1] >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    got = corpus_pipeline.language(spark, docs, FOLDER)
    assert got.schema == docs.schema and sorted(r.doc_id for r in got.collect()) == [i for i, _ in kept]

    stay = set(slow_one_of_each(kept))
    kept = [r for r in kept if r[0] in stay]
    got = corpus_pipeline.near_duplicates(spark, got, FOLDER)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [i for i, _ in kept]

    asked = [s for s in map(shingles, items) if s]
    kept = [(i, t) for i, t in kept if not any(len(s & shingles(t)) / len(s) >= 0.8 for s in asked)]
    got = corpus_pipeline.decontaminated(spark, got, FOLDER)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [i for i, _ in kept]

    got = corpus_pipeline.pseudonymised(spark, got, FOLDER)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [i for i, _ in kept]
    copies = {r.doc_id: r.copies for r in mixing.mix(got).collect()}
    out = {r.doc_id: r["count"] for r in corpus_pipeline.mixed(spark, got, FOLDER).groupBy("doc_id").count().collect()}
    assert out == {i: c for i, c in copies.items() if c}
    run = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id: r["count"] for r in run.groupBy("doc_id").count().collect()} == out


def test_stages_on_a_very_long_text(spark):
    words = " ".join(f"the word{i} of a very long text" for i in range(40_000))
    rows = [(1, words, "en", "s", len(words)), (2, words, "en", "s", len(words)), (3, "a short text of few words", "en", "s", 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        left = step(spark, left, FOLDER)
    kept = {r.doc_id: r.text for r in left.collect()}
    assert kept[1] == words and 2 not in kept
    assert corpus_pipeline.mixed(spark, docs, FOLDER).where("doc_id = 1").count() > 0


def test_stages_on_edge_rows(spark):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", None, 0, "x"), (2, "one two", "en", "s", 7, "x"),
            (2, "one two", "en", "s", 7, "x"), (3, "One Two", "en", "t", 7, "x"), (None, "three", None, None, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy_no string")
    for step in (corpus_pipeline.near_duplicates, corpus_pipeline.decontaminated, corpus_pipeline.pseudonymised):
        assert step(spark, docs, FOLDER).columns == docs.columns
    left = corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == [("1", ""), ("2", "one two"), ("None", "three")]
    assert corpus_pipeline.mixed(spark, docs, FOLDER).count() > 0
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), FOLDER).count() == 0, name
