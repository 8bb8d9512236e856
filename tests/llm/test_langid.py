import numpy as np
from pyspark.sql import functions as F

from slotcast.llm.langid import BUCKETS, MOST_LANGUAGES, accepted, fit, predict, sampled_out, softmax, subwords, train

WORDS = {"en": ["the", "house", "with", "and", "thing", "other"], "de": ["der", "und", "über", "nicht", "straße", "ein"], "el": ["και", "το", "είναι", "για", "δεν"]}


def corpus(n):
    random = np.random.default_rng(1)
    return [(i, " ".join(random.choice(WORDS[lang], random.integers(2, 40))), lang) for i in range(n) for lang in [list(WORDS)[i % 3]]]


def plain_subwords(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return sum(len(w) + (len(w) + 1) + len(w) for w in letters)


def test_number_of_subwords():
    for text in ["Ab c", "  Über-all 12x ", "e", "é.à"]:
        assert len(subwords(text)) == plain_subwords(text)
    assert len(subwords("12 !?")) == 0 and len(subwords("")) == 0
    assert (subwords("Haus") == subwords("haus!")).all() and subwords("a" * 100_000).max() < BUCKETS


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(600), "doc_id long, text string, lang string").withColumn("held", sampled_out("doc_id"))
    model = fit(docs.where("not held"), rows=120)
    assert model.languages == ("de", "el", "en") and 0 <= model.threshold <= 0.5
    out = predict(docs.where("held"), model, carry=["lang"]).collect()
    assert len(out) > 100 and np.mean([r["lang"] == r["_lang"] for r in out]) > 0.98
    assert all(0 <= r["_score"] <= 1 for r in out)


def test_edge_rows(spark):
    model = fit(spark.createDataFrame(corpus(300) + [(1, "und", None), (None, None, "xx"), (2, "123", "yy")], "doc_id long, text string, lang string"))
    assert set(model.languages) == set(WORDS)
    rows = [(1, None, "q"), (2, "", None), (3, "12 +", "q"), (3, "12 +", "q"), (None, "the house and the other thing", "q"), (5, "και το " * 20_000, "q"), (6, "x", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = sorted(predict(docs, model).collect(), key=repr)
    assert sorted(((r.doc_id, r.text, r.lang) for r in out), key=repr) == sorted(rows, key=repr)
    by = {r.doc_id: r for r in out}
    assert all(by[k]["_lang"] == "und" and by[k]["_score"] == 0 and by[k]["_rejected"] for k in (1, 2, 3))
    assert by[None]["_lang"] == "en" and by[5]["_lang"] == "el" and not by[5]["_rejected"] and by[6]["_lang"] in WORDS
    assert by[5].text == rows[5][1]
    assert predict(docs.limit(0), model).count() == 0


def test_no_rows_no_model(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, "7", None)], "doc_id long, text string, lang string")
    assert fit(docs) is None and fit(docs.limit(0)) is None
    assert sorted((r["_lang"], r["_score"], r["_rejected"]) for r in predict(docs, None).collect()) == [("und", 0.0, False), ("und", 0.0, True)]


def test_temperature_lowers_the_loss():
    random = np.random.default_rng(2)
    x = [(random.integers(0, 50, 6) + 50 * (i % 2), np.full(6, 1 / 6, np.float32)) for i in range(200)]
    model = train(x, np.arange(200) % 2, ("a", "b"), 1, 0.99)
    means = np.zeros((1, BUCKETS), np.float32)
    means[0, 55] = 1
    assert model.probabilities(means).shape == (1, 2) and abs(model.probabilities(means).sum() - 1) < 1e-6
    assert np.allclose(softmax(np.array([[0.0, 0.0]])), 0.5)


def test_a_quarter_is_held_out(spark):
    held = spark.range(4000).select(sampled_out("id").alias("h")).agg(F.sum(F.col("h").cast("int"))).first()[0]
    assert 900 < held < 1100


def test_any_column_names(spark):
    model = fit(spark.createDataFrame(corpus(300), "doc_id long, text string, lang string"))
    names = ["_text", "_score", "_lang", "_Rejected", "a.b", "c0"]
    docs = spark.createDataFrame([(1, "the house and the other thing", *[777] * 6), (2, None, *[777] * 6)], ["doc_id", "text", *names])
    out = predict(docs, model)
    assert out.columns == ["doc_id", "text", *names, "__lang", "__score", "__rejected"]
    assert sorted(tuple(r)[:9] for r in out.collect()) == [(1, "the house and the other thing", *[777] * 6, "en"), (2, None, *[777] * 6, "und")]
    kept = accepted(docs, model)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "the house and the other thing", *[777] * 6)]


def test_a_hot_text_does_not_push_its_language_out(spark):
    """Copies count once in the share, so a rare language with a hot text is learned from as many different rows as any."""
    rows = corpus(600)
    hot = [(10_000 + i, "και το είναι για δεν", "el") for i in range(20_000)]
    a = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=100)
    b = fit(spark.createDataFrame(rows + hot, "doc_id long, text string, lang string").repartition(8), rows=100)
    assert a.languages == b.languages == ("de", "el", "en")
    texts = spark.createDataFrame([(i, t, k) for i, t, k in corpus(900)[600:]], "doc_id long, text string, lang string")
    assert np.mean([r["lang"] == r["_lang"] for r in predict(texts, b).collect()]) > 0.98


def test_very_many_language_values_are_bounded(spark):
    many = [(i, f"word{i} and more", f"x{i}") for i in range(3000)]
    model = fit(spark.createDataFrame(many + [(9000 + i, t, k) for i, t, k in corpus(300)], "doc_id long, text string, lang string"))
    assert set(WORDS) <= set(model.languages) and len(model.languages) <= MOST_LANGUAGES


def test_scores_equal_a_plain_softmax(spark):
    """Prediction against the model's definition, text by text: mean of subword rows, softmax at the temperature, the threshold."""
    docs = corpus(200) + [(900, "μια άλλη", "q"), (901, "x", "q"), (902, None, "q")]
    model = fit(spark.createDataFrame(corpus(300), "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in predict(spark.createDataFrame(docs, "doc_id long, text string, lang string"), model).collect()}
    for i, text, _ in docs:
        found = subwords(text) if text else []
        if not len(found):
            assert (got[i]["_lang"], got[i]["_score"], got[i]["_rejected"]) == ("und", 0.0, True)
            continue
        z = (sum(model.table[b].astype(float) for b in found) / len(found) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i]["_lang"] == model.languages[int(p.argmax())] and abs(got[i]["_score"] - p.max()) < 1e-4
        usual = sum(model.usual[b, int(p.argmax())] for b in found) / len(found)
        far = (model.centre[int(p.argmax())] - usual) * np.sqrt(len(found)) / model.spread[int(p.argmax())]
        assert got[i]["_rejected"] == (got[i]["_score"] < model.threshold or far > model.farthest)


def syllables(parts, n, seed):
    """Texts of words made of a language's syllables, so that few words repeat."""
    random = np.random.default_rng(seed)
    return [" ".join("".join(random.choice(parts, random.integers(1, 4))) for _ in range(random.integers(30, 90))) for _ in range(n)]


SYLLABLES = {
    "en": ["the", "ing", "and", "tion", "er", "ou", "th", "ly", "wh", "ed"], "de": ["sch", "ung", "keit", "ein", "der", "ä", "ß", "ver", "zu", "ich"],
    "fr": ["eau", "ment", "que", "é", "ou", "ai", "tre", "la", "ç", "oi"],
}
OTHERS = {
    "cyrillic": ["при", "ст", "ова", "ние", "ко", "раз", "ый", "ла"], "greek": ["και", "ος", "ει", "του", "μα", "λό", "γη"], "finnish": ["kää", "ylly", "nen", "uus", "oja", "vii", "kko"],
    "junk": list("qxzjkwvpfgbdhy"), "japanese": ["の", "を", "日", "本", "語", "です"],
}


def test_unlearned_languages_and_junk_are_rejected(spark):
    """Both shares: known texts that stay, others that go."""
    known = [(t, k) for n, (k, parts) in enumerate(SYLLABLES.items()) for t in syllables(parts, 300, n)]
    model = fit(spark.createDataFrame(known, "text string, lang string"))
    fresh = [(t, k) for n, (k, parts) in enumerate(SYLLABLES.items()) for t in syllables(parts, 200, 50 + n)]
    strange = [(t, k) for n, (k, parts) in enumerate(OTHERS.items()) for t in syllables(parts, 60, 90 + n)]
    out = predict(spark.createDataFrame(fresh + strange, "text string, lang string"), model).collect()
    gone = {k: np.mean([r["_rejected"] for r in out if r["lang"] == k]) for k in [*SYLLABLES, *OTHERS]}
    assert all(gone[k] <= 0.01 for k in SYLLABLES) and all(gone[k] >= 0.95 for k in OTHERS), gone
    assert all(r["_lang"] == r["lang"] for r in out if r["lang"] in SYLLABLES)
