"""Language mixtures, quality and toxicity: accuracy on held-out rows and odd inputs."""

import numpy as np
from pyspark.sql import functions as F
from small import docs_table, prose

from evalgrid.llm import language_mix, quality_model, toxicity
from evalgrid.llm import queries as registered

ODD = [(None, None), (1, ""), (2, " \n"), (3, "123 456 !!!"), (4, "word " * 30_000), (5, "x" * 100_000), (6, prose(1)), (6, prose(1))]
SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    out = registered.op6_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right, n = out.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.98


def _texts(rng, words, n):
    return " ".join(rng.choice(words, n))


def test_mixture_of_two_languages():
    rng = np.random.default_rng(1)
    tongues = {"a": ["baba", "bodo", "dudaba", "bubob"], "b": ["kiki", "tekit", "piteke", "kipe"], "c": ["zuxo", "voxu", "xuzov", "vuzo"]}
    counts = np.full((language_mix.BUCKETS, 3), language_mix.SMOOTHING)
    for k, words in enumerate(tongues.values()):
        np.add.at(counts[:, k], language_mix.grams(_texts(rng, words, 3000)), 1)
    model = language_mix.Model(list(tongues), counts / counts.sum(axis=0))
    one = language_mix.infer(model, _texts(rng, tongues["a"], 80))
    two = language_mix.infer(model, _texts(rng, tongues["a"], 60) + " " + _texts(rng, tongues["c"], 140))
    assert [lang for lang, _ in one] == ["a"]
    assert [lang for lang, _ in two] == ["c", "a"] and abs(two[0][1] - 0.7) < 0.08
    share, likelihood = language_mix.mixture(model.chances[:50, :2], np.ones(50))
    grid = [np.ones(50) @ np.log(model.chances[:50, :2] @ np.array([s, 1 - s])) for s in np.linspace(0.001, 0.999, 999)]
    assert likelihood >= max(grid) - 0.1 and abs(share.sum() - 1) < 1e-9


def test_language_odd_inputs(spark):
    rows = [(i, t, "en" if i != 6 else None) for i, t in ODD] + [(9, "été là", "fr")]
    docs = docs_table(spark, rows, extra=True)
    out = language_mix.predict(docs, language_mix.fit(docs)).collect()
    assert len(out) == len(rows)
    for r in out:
        blank = r["doc_id"] in (None, 1, 2, 3)
        assert (r["lang_pred"] == "und" and r["score"] == 0) if blank else r["lang_pred"] in ("en", "fr")
    empty = docs.where("false")
    assert language_mix.predict(empty, language_mix.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in language_mix.predict(docs, language_mix.fit(empty)).collect()} == {"und"}


def test_quality_held_out(spark):
    out = registered.op7_quality_classifier(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = out.where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_quality_density_by_hand():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 3))
    covs = [np.cov(rng.normal(size=(3, 50))) for _ in (0, 1)]
    factors = [np.linalg.cholesky(c) for c in covs]
    means = rng.normal(size=(2, 3))
    model = quality_model.Model(means, np.array([np.linalg.inv(f) for f in factors]), np.array([np.log(np.diag(f)).sum() for f in factors]))

    def log_density(v, k):
        d = v - means[k]
        return -0.5 * d @ np.linalg.inv(covs[k]) @ d - 0.5 * np.log(np.linalg.det(covs[k]))

    assert np.allclose(model.difference(x), [log_density(v, 1) - log_density(v, 0) for v in x])


def test_quality_odd_inputs(spark):
    docs = docs_table(spark, ODD, extra=True)
    described = quality_model.describe(docs)
    labels = spark.createDataFrame([(1, 0), (6, 1), (6, 1), (None, 1), (4, None), (5, 0)], "doc_id bigint, quality int")
    scores = [r["score"] for r in quality_model.score(described, quality_model.fit(described, labels)).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert quality_model.fit(described, labels.where("quality = 1")) is None
    assert quality_model.score(quality_model.describe(docs.where("false")), None).count() == 0


def test_toxicity_on_unseen_rows(spark):
    folder = SF.replace("0.01", "0.1")  # the small table has a few dozen toxic rows
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    seen = language_mix.fold(F.col("doc_id"), 3) != 0
    model = toxicity.fit(docs, labels.where(seen))
    rows = toxicity.score(docs, model).join(labels.where(~seen), "doc_id").collect()
    assert len(rows) > 800
    marked = toxicity.score(docs, model).withColumnRenamed("toxic", "found").join(labels.where(~seen), "doc_id")
    wrong = marked.where(F.col("found") != (F.col("toxic") == 1)).count()
    assert wrong <= 0.015 * len(rows)  # about one label in a hundred has no word to show for it
    assert toxicity.reject(docs, model).columns == docs.columns


def test_ordinal_recovers_grades():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 2))
    latent = x @ np.array([2.0, -1.0]) + rng.logistic(size=4000)
    grades = (latent[:, None] > np.array([0.5, 2.0])).sum(axis=1)
    rows, columns = np.repeat(np.arange(4000), 2), np.tile([0, 1], 4000)
    w, t = toxicity.fit_ordinal(rows, columns, x.ravel(), grades, 2, ridge=0, steps=1500)
    assert np.allclose(w, [2, -1], atol=0.2) and np.allclose(t, [0.5, 2.0], atol=0.2)


def test_cut_has_the_fewest_errors():
    rng = np.random.default_rng(5)
    values = np.round(np.concatenate([rng.normal(0, 1, 60), rng.normal(2, 1, 40)]), 6)
    positive = np.arange(100) >= 60
    wrong = lambda cut: ((values >= cut) != positive).sum()
    cut = toxicity.best_cut(values, positive)
    assert wrong(cut) == min(wrong(v) for v in np.linspace(-4, 6, 5001))
    assert toxicity.best_cut(np.array([-3.0, 1.0, -2.0, 3.0]), np.array([False, True, False, True])) == -0.5


def test_cut_never_divides_equal_scores():
    values = np.concatenate([np.zeros(6001), np.full(200, 3.0)])
    positive = np.arange(6201) >= 6000  # the last of the tied rows is a positive one
    assert toxicity.best_cut(values, positive) == 1.5
    assert toxicity.best_cut(np.zeros(5), np.arange(5) >= 4) == np.inf


def test_toxic_rows_without_a_known_word_flag_no_clean_one(spark):
    rows = [(i, prose(i, 20)) for i in range(60)] + [(100 + i, f"{prose(100 + i, 20)} vile") for i in range(20)] + [(200 + i, prose(200 + i, 20)) for i in range(4)]
    docs = docs_table(spark, rows)
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id bigint, toxic int")
    found = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r["toxic"]}
    assert found >= set(range(100, 120)) and not [i for i in found if i < 100]
    few = labels.where("toxic = 0 or doc_id in (200, 201)")
    assert toxicity.reject(docs, toxicity.fit(docs, few)).count() == len(rows)


def test_toxicity_odd_inputs(spark):
    rows = ODD + [(10 + i, f"{prose(i, 20)} vile", "en") for i in range(12)] + [(30 + i, prose(40 + i, 20), "en") for i in range(12)]
    docs = docs_table(spark, rows, extra=True)
    labels = spark.createDataFrame([(10 + i, 1) for i in range(12)] + [(30 + i, 0) for i in range(12)] + [(None, 1), (3, None), (6, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows) and {r["doc_id"] for r in out if r["toxic"]} == set(range(10, 22))
    assert all(0 <= r["severity"] <= 3 for r in out)
    nothing = toxicity.fit(docs, labels.where("false"))
    assert not any(r["toxic"] for r in toxicity.score(docs, nothing).collect())
    assert toxicity.score(docs.where("false"), toxicity.fit(docs.where("false"), labels)).count() == 0
