import numpy as np

from slotcast.llm.quality import STATISTICS, accepted, fit, judged, measured, pool, scored, statistics, training_rows


def corpus(n):
    random = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(random.choice(list("abcdeinorst"), random.integers(2, 8))) for _ in range(random.integers(20, 80))]
        good = i % 3 != 0
        text = " ".join(words) if good else [" ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * 40), " ".join(w + "***" for w in words)][i % 9 // 3]
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def test_statistics():
    for raw in [b"", b"  \n", b"One two two.\nOne two two.\n", b"\xc3\xa9" * 50_000, b"!" * 10]:
        s = statistics(raw)
        assert s.shape == (STATISTICS,) and np.isfinite(s).all()
    s = statistics(b"A a a\nA a a")
    assert np.allclose(s[[16, 14, 19]], [1 / 2, 2 / 6, 2 / 6])


def test_pool_equals_brute_force():
    random = np.random.default_rng(4)
    for _ in range(50):
        n = random.integers(1, 12)
        mean, weight = random.random(n).round(1), random.integers(1, 5, n).astype(float)
        at, level = pool(np.arange(n, dtype=float), mean, weight)
        # the largest of the smallest averages, for each place
        want = [max(min(np.average(mean[a : b + 1], weights=weight[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(sorted(set(np.round(want, 9))), np.unique(np.round(level, 9)))
        assert (np.diff(level) > 0).all()


def test_held_out_documents(spark):
    rows, labels = corpus(900)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5, None), (None, 1), (7, labels[7][1])], "doc_id long, quality int")
    stats = measured(docs, carry=["doc_id"])
    model = fit(training_rows(stats, known))
    truth = dict(labels)
    import zlib

    out = [(r["_score"], truth[r.doc_id]) for r in scored(stats, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(out) > 120 and np.mean([(s >= 0.3) == (t == 1) for s, t in out]) > 0.98 and all(0 <= s <= 1 for s, _ in out)


def test_sums_do_not_depend_on_partitions(spark):
    rows, labels = corpus(300)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (fit(training_rows(measured(d, carry=["doc_id"]), known)) for d in (docs.repartition(1), docs.repartition(7)))
    assert np.allclose(a.weights, b.weights, atol=1e-6)


def test_edge_rows(spark):
    rows, labels = corpus(200)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    model = fit(training_rows(measured(spark.createDataFrame(rows, "doc_id long, text string"), carry=["doc_id"]), known, left_out=None))
    odd = [(1, None, "a"), (2, "", None), (None, "x " * 50_000, "c"), (2, "same", "d"), (2, "same", "d")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, label string")
    out = judged(docs, model).collect()
    assert sorted(((r.doc_id, r.text, r.label) for r in out), key=repr) == sorted(odd, key=repr)
    assert all(0 <= r["_score"] <= 1 for r in out)
    assert judged(docs.limit(0), model).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert fit(training_rows(measured(docs, carry=["doc_id"]), none)) is None
    assert {r["_score"] for r in judged(docs, None).collect()} == {0.5}
    only = fit(training_rows(measured(docs, carry=["doc_id"]), spark.createDataFrame([(1, 1)], "doc_id long, quality int"), left_out=None))
    assert all(r["_score"] > 0.9 for r in judged(docs, only).collect())


def test_any_column_names(spark):
    rows, labels = corpus(200)
    model = fit(training_rows(measured(spark.createDataFrame(rows, "doc_id long, text string"), carry=["doc_id"]), spark.createDataFrame(labels, "doc_id long, quality int"), left_out=None))
    names = ["_text", "_score", "_stats", "a.b", "c1"]
    docs = spark.createDataFrame([(i, t, *[777] * 5) for i, t in rows[:40]], ["doc_id", "text", *names])
    out = judged(docs, model)
    assert out.columns == ["doc_id", "text", *names, "__score"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].text == t and tuple(got[i])[2:7] == (777,) * 5 for i, t in rows[:40])
    kept = accepted(docs, model, 0.5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i]["__score"] >= 0.5}


def test_fit_equals_a_plain_ridge(spark):
    """Weights against one dense least-squares solution on the same features."""
    rows, labels = corpus(300)
    train = training_rows(measured(spark.createDataFrame(rows, "doc_id long, text string"), carry=["doc_id"]), spark.createDataFrame(labels, "doc_id long, quality int"), left_out=None)
    model = fit(train, ridge=1e-4)
    got = [(np.array(r["_stats"], dtype=float), r["label"]) for r in train.collect()]
    z, y = model.features(np.stack([s for s, _ in got])), np.array([k for _, k in got], dtype=float)
    d = z.shape[1]
    rows_ = np.vstack([z, np.sqrt(1e-4 * len(y) / (d - 1)) * np.eye(d)])
    weights = np.linalg.lstsq(rows_, np.append(y, np.zeros(d)), rcond=None)[0]
    assert np.allclose(z @ weights, z @ model.weights, atol=1e-5)
