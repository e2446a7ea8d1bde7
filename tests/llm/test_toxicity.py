"""The chain on labelled documents held out from training."""

import random

import numpy as np

from lodestone.llm import toxicity as tx


def labelled(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").orderBy("doc_id").collect()
    random.Random(0).shuffle(rows)
    return [r.text for r in rows], np.array([[1 - r.quality, r.toxic] for r in rows])


def test_held_out(spark):
    texts, y = labelled(spark, "/root/testdata/sf0.1")
    n = len(texts) // 2
    chain = tx.fit_chain(texts[:n], y[:n])
    p = chain.probabilities(texts[n:])
    toxic, verdict = y[n:, 1] == 1, p[:, 1] > chain.threshold
    assert (verdict & toxic).sum() >= 0.85 * toxic.sum()  # some labels of these tables have no visible cause
    assert (verdict & ~toxic).sum() <= 0.01 * (~toxic).sum()
    assert ((p[:, 0] > 0.5) == (y[n:, 0] == 1)).mean() > 0.85


def test_chain_feeds_later_models():
    """A category that equals an earlier one is learnt from that one's log-odds."""
    texts = [f"{'bad' if i % 3 == 0 else 'good'} w{i}" for i in range(120)]
    y = np.array([[i % 3 == 0, i % 3 == 0] for i in range(120)])
    chain = tx.fit_chain(texts, y)
    assert chain.models[1].weights[-1] > 0 and len(chain.models[1].weights) == len(chain.index) + 1
    assert ((chain.probabilities(texts)[:, 1] > chain.threshold) == y[:, 1]).all()


def test_odd_inputs(spark):
    one_sided = tx.fit_chain(["a", "b"], np.array([[0, 0], [0, 0]]))
    assert one_sided.probabilities(["a", "", None, "x " * 20000])[:, 1].max() < 0.05
    assert tx.fit_chain([], np.zeros((0, 2))).probabilities(["a"]).shape == (1, 2)
    chain = tx.fit_chain(["bad word"] * 20 + ["fine word"] * 20, np.array([[0, 1]] * 20 + [[0, 0]] * 20))
    df = spark.createDataFrame([(1, "bad", "t"), (1, "bad", "t"), (None, None, "t"), (2, "", "t"), (3, "fine", "t")], "doc_id long, text string, toxic string")
    got = tx.score(df, chain)
    assert got.columns == ["doc_id", "p_low_quality", "p_toxic", "toxic"]
    assert sorted((str(r.doc_id), r.toxic) for r in got.collect()) == [("1", True), ("1", True), ("2", False), ("3", False), ("None", False)]
    left = tx.drop_toxic(df, chain)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "None"]
    assert tx.score(df.limit(0), chain).count() == 0


def test_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t{i % 30}") for i in range(40)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 4 == 0) for i in range(40)] + [(1, None, True), (None, 1, True), (2, 1, False), (99, 1, False)], "doc_id long, a int, b boolean")
    texts, y = tx.labelled_sample(docs, labels, ("a", "b"), most=1000)
    assert len(texts) == len(set(texts)) == 30 and y.shape == (30, 2)
    texts, _ = tx.labelled_sample(docs, labels, ("a", "b"), most=2)
    assert 2 <= len(texts) <= 8
    texts, y = tx.labelled_sample(docs.limit(0), labels, ("a", "b"))
    assert texts == [] and y.shape == (0, 2)


def test_blank_texts_pass_on_any_chain(spark):
    blank = ["", None, " \n\t", "0", "_"]
    mostly_bad = tx.fit_chain(["bad word"] * 30 + [""] * 30 + ["fine word"] * 5, np.array([[1, 1]] * 60 + [[0, 0]] * 5))
    all_bad = tx.fit_chain(["bad"] * 9, np.ones((9, 2)))
    for chain in (mostly_bad, all_bad, tx.fit_chain([], np.zeros((0, 2)))):
        assert not chain.probabilities(blank).any() and 0 < chain.threshold < 1
    df = spark.createDataFrame([(i, t) for i, t in enumerate(blank)], "doc_id long, text string")
    assert not any(r.toxic for r in tx.score(df, mostly_bad).collect())
    assert tx.drop_toxic(df, mostly_bad).count() == len(blank)


def test_folds_choose_features_without_the_rows_they_hold_out():
    """A word for each row says nothing of other rows: with labels by chance, out-of-fold predictions are no better than chance."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(3000)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(60)) for _ in range(400)]
    y = np.array([[0, r.random() < 0.5] for _ in texts])
    names, rows = tx.encoded(texts)
    seen = np.arange(400) % 5 != 0
    some = tx.select_features(names, [rows[i] for i in np.flatnonzero(seen)], y[seen].astype(float))
    x = tx.occurrence(rows, some, len(names))
    assert some and x.shape == (400, len(some)) and x.sum() == sum(len(set(some) & set(row.tolist())) for row in rows)
    model = tx.fit_linear(x[seen], y[seen, 1])
    assert ((model(x[seen]) > 0) == y[seen, 1]).mean() > 0.9
    assert 0.3 < ((model(x[~seen]) > 0) == y[~seen, 1]).mean() < 0.7


def test_query_and_stage(spark, sf_dir, tmp_path):
    """The registered query's rows from the sample and the chain, over a table with blank and repeated rows as well."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6 + i, t, "en", "s", 0) for i, t in enumerate([None, "", " ", "fine", "fine"])] + [(None, None, None, None, None)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    chain = tx.labelled_chain(spark, docs, str(tmp_path))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    p = chain.probabilities([t for _, t in rows])
    key = lambda x: (x[0] is None, x)
    want = sorted(((i, *(round(float(v), 9) for v in q), bool(q[-1] > chain.threshold)) for (i, _), q in zip(rows, p)), key=key)
    got = sorted(((r.doc_id, round(r.p_low_quality, 9), round(r.p_toxic, 9), r.toxic) for r in tx.op7_toxicity(spark, str(tmp_path)).collect()), key=key)
    assert got == want and 0 < sum(r[-1] for r in got) < len(got) / 2
    left = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, str(tmp_path)).collect()
    gone = {r[0] for r in want if r[-1]}
    assert sorted(str(r.doc_id) for r in left) == sorted(str(i) for i, _ in rows if i not in gone)


def test_ids_that_repeat(spark):
    """Of texts under one id the smallest trains, whatever the order of rows."""
    rows = [(1, "b"), (1, "a"), (1, None), (2, "c"), (2, "d")]
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1)], "doc_id long, low_quality int, toxic int")
    for own in (rows, rows[::-1]):
        texts, y = tx.labelled_sample(spark.createDataFrame(own, "doc_id long, text string"), labels)
        assert sorted(zip(texts, y.tolist())) == [("a", [0, 0]), ("c", [1, 1])]
