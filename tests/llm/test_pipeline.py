import glob

import pytest

import corpus_pipeline as pipeline
from slotcast.llm import langid, packing, quality, suffix
from slotcast.session import materialise
from tests.llm.test_packing import unpacked
from tests.llm.test_simhash import near_sets, plain_components, shingle_set
from tests.llm.test_suffix import plain

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not glob.glob(f"{FOLDER}/*.parquet"), reason="driver tables are not here")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@needs_data
def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(pipeline.STAGES)

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit(quality.training_rows(quality.measured(docs, carry=["doc_id"]), labels, left_out=None))
    scores = {i: model.scores(quality.statistics((t or "").encode()).astype("float32").astype(float)[None])[0] for i, t in kept.items()}
    docs = materialise(stages["quality"](spark, docs, FOLDER))
    assert docs.columns == COLUMNS
    kept = {i: t for i, t in kept.items() if scores[i] >= quality.ACCEPT}
    assert {r.doc_id: r.text for r in docs.collect()} == kept

    judged = {r.doc_id: r["_rejected"] for r in langid.predict(docs, langid.fit(docs)).collect()}
    docs = materialise(stages["language"](spark, docs, FOLDER))
    kept = {i: t for i, t in kept.items() if not judged[i]}
    assert {r.doc_id: r.text for r in docs.collect()} == kept

    ids = sorted(kept)
    roots = plain_components([shingle_set(kept[i]) for i in ids], 0, near_sets)
    first = {}
    for i, r in zip(ids, roots):
        first.setdefault(r, i)
    docs = materialise(stages["near_copies"](spark, docs, FOLDER))
    kept = {i: kept[i] for i in first.values()}
    assert {r.doc_id: r.text for r in docs.collect()} == kept

    cuts = {}
    for (i, start), source in plain(list(kept.items()), suffix.MIN_WORDS).items():
        cuts.setdefault(i, []).append({"start": start, "n_words": suffix.MIN_WORDS, "kept": source == (i, start)})
    docs = materialise(stages["repeated_passages"](spark, docs, FOLDER))
    kept = {i: suffix.cut(t, cuts.get(i)) for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if i not in cuts or t.strip()}
    rows = docs.collect()
    assert {r.doc_id: r.text for r in rows} == kept and all(r.n_chars == len(r.text) for r in rows)

    out = stages["packing"](spark, docs, FOLDER).collect()
    assert unpacked(out) == {i: [*t.encode(), packing.END] for i, t in kept.items()}
    assert all(r.capacity == min(x for x in packing.CAPACITIES if x >= r.n_tokens) for r in out)


@needs_data
def test_near_copies_stage_is_the_similarity_of_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    first = {}
    for i, r in zip(ids, plain_components([shingle_set(texts[i]) for i in ids], 0, near_sets)):
        first.setdefault(r, i)
    kept = dict(pipeline.STAGES)["near_copies"](spark, docs, FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


@needs_data
def test_run_gives_the_last_stage(spark):
    assert pipeline.run(spark, FOLDER).columns == ["bin", "capacity", "n_tokens", "ids", "sources"]


@needs_data
@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_odd_rows_and_empty_tables(spark, name):
    stage = dict(pipeline.STAGES)[name]
    text = "Some plain words, and some more of them to make a text. " * 8
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, text, "en", None, 400), (3, text, None, "s", 400), (3, text, None, "s", 400), (4, "é " * 30_000, "fr", "s", 1)]
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    out = stage(spark, docs, FOLDER)
    assert out.collect() is not None
    assert stage(spark, docs.limit(0), FOLDER).count() == 0
    if name != "packing":
        assert out.columns == COLUMNS


def test_sql_and_stages():
    assert pipeline.ORACLE_SQL is None and 4 <= len(pipeline.STAGES) <= 5
