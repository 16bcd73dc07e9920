import inspect
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import dtm, etl, lda, linear, medlda, metrics, rtm
from skein.plans import model_queries
from skein.sources import files


@pytest.fixture(scope="module")
def topical(spark):
    """Documents that each use one of two halves of a small vocabulary."""
    rng = np.random.default_rng(2)
    rows = [(d, int(v), 1 + int(rng.integers(3))) for d in range(24) for v in rng.choice(np.arange(10) + 10 * (d % 2), 6, replace=False)]
    return spark.createDataFrame(rows, "d bigint, v bigint, f bigint")


def test_lda_keeps_tokens_and_improves(spark, topical):
    model = lda.fit(topical, 2, 0.5, 0.01, iterations=6)
    n = topical.agg(F.sum("f")).first()[0]
    assert model.ck.sum() == n
    for side, col in ((model.cdk, "cd"), (model.cwk, "cv")):
        assert side.select(F.explode(col).alias("c")).agg(F.sum("c")).first()[0] == n
    assert model.perplexity[-1] < model.perplexity[0]
    assert lda.fit(topical, 2, 0.5, 0.01, iterations=2).perplexity == model.perplexity[:2]


def test_medlda_two_labels(spark, topical):
    y = topical.select("d").distinct().select("d", (F.col("d") % 2).cast("int").alias("y"))
    model = medlda.fit(topical, y, 2, alpha=0.5, iterations=1, sweeps=4)
    assert model.labels == [0, 1] and model.weights.shape == (2, 2)
    pred = medlda.predict(model, topical.filter("d < 6").unionByName(spark.createDataFrame([(0, 99, 1)], topical.schema)), 5, 5)
    assert {r["d"] for r in pred.collect()} == set(range(6)) and {r["pred"] for r in pred.collect()} <= {0, 1}


def test_rtm_forms_follow_the_definition(spark):
    k, u = 2, np.array([[0.5, -0.2], [0.1, 0.3]])
    ends = spark.createDataFrame([(1, 2, 1, 0.5, 1.5, [0.2, 0.8], [0.6, 0.4]), (3, 1, 0, -0.5, 0.5, [1.0, 0.0], [0.2, 0.8])], "src bigint, dst bigint, y int, kappa double, lam double, zs array<double>, zd array<double>")
    got = {r["d"]: r for r in rtm.document_forms(ends, u).collect()}
    g1, g2 = u @ [0.6, 0.4], u.T @ [1.0, 0.0]
    assert np.allclose(got[1]["a"], 0.5 * g1 - 0.5 * g2)
    assert np.allclose(np.reshape(got[1]["b"], (k, k)), 1.5 * np.outer(g1, g1) + 0.5 * np.outer(g2, g2))
    precision, b = rtm.gram(ends, k, 0.5)
    z = [np.outer([0.2, 0.8], [0.6, 0.4]).ravel(), np.outer([1.0, 0.0], [0.2, 0.8]).ravel()]
    assert np.allclose(precision, np.eye(4) / 0.25 + 1.5 * np.outer(z[0], z[0]) + 0.5 * np.outer(z[1], z[1]))
    assert np.allclose(b, 0.5 * z[0] - 0.5 * z[1])


def test_rtm_draws_whole_documents_in_bulk(spark):
    """Per-document forms, kept tokens, and draws that do not depend on how rows are dealt or batched."""
    k, rng = 2, np.random.default_rng(5)
    cells = [(d, int(v), int(rng.integers(1, 6))) for d in range(40) for v in rng.choice(30, 1 + 25 * (d == 7) + d % 3, replace=False)]
    n = rtm.init_topics(spark.createDataFrame(cells, "d bigint, v bigint, f bigint"), k, 3)
    cwk = lda._sum_arrays(n, "v", k, "cv")
    forms = spark.createDataFrame([(d, [0.3 * d, -4.0], [1.0, 0.2, 0.2, 0.5]) for d in range(0, 40, 2)], "d bigint, a array<double>, b array<double>")
    ck, size = "spark.sql.execution.arrow.maxRecordsPerBatch", {d: sum(f for e, _, f in cells if e == d) for d in range(40)}
    for given in (None, forms):
        found = []
        for most, parts in (("10000", 1), ("3", 5)):
            spark.conf.set(ck, most)
            docs = rtm.draw_topics(n.repartition(parts, "v"), cwk, lda.totals(cwk, k), given, 30, 1.0, 0.1, 3, 0).collect()
            spark.conf.unset(ck)
            found.append({r["d"]: (r["z"], sorted(zip(r["v"], np.reshape(r["n"], (-1, k)).tolist()))) for r in docs})
        assert found[0] == found[1] and len(docs) == 40
        for d, (z, words) in found[0].items():
            assert {v: sum(c) for v, c in words} == {v: f for e, v, f in cells if e == d}
            assert np.allclose(np.sum([c for _, c in words], axis=0) / size[d], z)
    flat = rtm.word_rows(spark.createDataFrame([(1, [0.5, 0.5], [4, 6], [1, 2, 3, 4])], "d bigint, z array<double>, v array<bigint>, n array<bigint>"), k)
    assert sorted(tuple(r) for r in flat.collect()) == [(1, 4, [1, 2]), (1, 6, [3, 4])]


def test_rtm_link_weights_follow_the_definition():
    rng, k = np.random.default_rng(6), 3
    z, a, g = rng.dirichlet(np.ones(k), 2), rng.normal(size=(2, k)), rng.normal(size=(2, k, k))
    b, size = g @ g.transpose(0, 2, 1), np.array([4.0, 9.0])
    got = rtm._link_weights(z, size, a, b)
    for d in range(2):
        for old in range(k):
            moved = z[d] + (np.eye(k) - np.eye(k)[old]) / size[d]
            want = moved @ a[d] - np.einsum("ki,ij,kj->k", moved, b[d], moved) / 2
            assert np.allclose(got[d, old] - got[d, old, 0], want - want[0])


def test_rtm_aucs_count_ties_and_splits(spark):
    rng = np.random.default_rng(7)
    rows = [(float(rng.integers(0, 40)) / 8, int(rng.integers(0, 2)), "test" if i % 4 == 0 else "train") for i in range(600)]
    scored = spark.createDataFrame(rows, "score double, y int, split string").repartition(5)
    got = rtm.link_aucs(scored)
    for split in ("train", "test"):
        assert got[split] == pytest.approx(metrics.auc(scored.filter(F.col("split") == split)).first()["auc"], abs=2e-9)
    assert rtm.link_aucs(scored.filter("split = 'train' and y = 1")) == {"train": None, "test": None}


def test_rtm_fit_takes_many_orders(spark, tmp_path):
    """Six thousand orders of 30,000 lines took minutes when each order and link was drawn alone."""
    rng, m = np.random.default_rng(8), 6000
    orders = [(i, i % 600) for i in range(m)]
    lines = [(i % m, int(v), float(q)) for i, (v, q) in enumerate(zip(rng.integers(0, 900, 5 * m), rng.integers(1, 51, 5 * m)))]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    began = time.time()
    first = model_queries.rtm_fit(spark, str(tmp_path)).collect()
    assert time.time() - began < 60
    assert first == model_queries.rtm_fit(spark, str(tmp_path)).collect()
    assert len(first) == 1 and all(0.4 < a < 0.6 for a in (first[0]["train_auc"], first[0]["test_auc"]))


def test_rtm_sweeps_are_weighed_by_links(spark, topical, monkeypatch):
    """With U zero in the first sweep and one iteration in the query, no word was ever weighed by a link."""
    links = [(i, j, int(i % 2 == j % 2), "test" if i % 5 == 0 else "train") for i in range(24) for j in (3 * i % 24, (i + 1) % 24) if i != j]
    met, real, forms = [], inspect.signature(rtm.fit), rtm.document_forms
    monkeypatch.setattr(rtm, "document_forms", lambda ends, u: met.append((ends.count(), u.any())) or forms(ends, u))
    model = rtm.fit(topical, spark.createDataFrame(links, "src bigint, dst bigint, y int, split string"), 2, iterations=1)
    assert met == [(sum(x[3] == "train" for x in links), True)] and len(model.history) == 1
    asked = {}

    def fake(*args, **given):
        asked.update((b := real.bind(*args, **given)).apply_defaults() or b.arguments)
        return rtm.RtmModel(None, None, [(0.5, 0.25), (0.75, 0.5)])

    monkeypatch.setattr(rtm, "fit", fake)
    assert [tuple(r) for r in model_queries.rtm_fit(spark, "/root/testdata/sf0.001").collect()] == [(1, 0.75, 0.5)]
    assert asked["iterations"] >= 2


def test_alpha_moments():
    s = dtm.Settings(topics=2)
    mean, var = dtm.alpha_moments(None, None, np.array([3.0, 0.0]), 4, s)
    assert var == pytest.approx(1 / (1 / s.sigma_alpha0**2 + 4 / s.sigma_eta**2))
    assert mean[0] == pytest.approx(3 / s.sigma_eta**2 * var)


def test_dtm_runs_and_pins(spark, topical):
    toks = topical.withColumn("ep", F.col("d") % 3)
    model = dtm.fit(toks, 2, dtm.Settings(topics=2, phi_rate=(0.01, 100, 0.51), burn_in=2, samples=2, batch=4), (toks.filter("v % 2 = 0"), toks.filter("v % 2 = 1")), report_every=1)
    assert len(model.history) == 3 and all(math.isfinite(h) for h in model.history)
    assert model.alpha[:, -1].tolist() == [0, 0, 0]
    last = toks.agg(F.max("v")).first()[0]
    start = [((last * 7919 + t * 104729) % 1000 / 1000.0 - 0.5) * 0.1 for t in range(2)]
    assert all(np.allclose(r["phi"], start) for r in model.phi.filter(F.col("v") == last).collect())


def test_auc_fixtures(spark):
    auc = lambda rows: metrics.auc(spark.createDataFrame(rows, "score double, y int")).first()["auc"]
    assert auc([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)]) == 0.875
    assert auc([(0.5, 1), (0.5, 0), (0.5, 0)]) == 0.5


def test_splits(spark):
    docs = spark.range(9).select(F.lit(0).alias("ep"), F.col("id").alias("d"))
    assert etl.train_test(docs).filter("split = 'tr'").count() == 7
    seen = etl.held_out(spark.range(5).select(F.lit(1).alias("d"), F.col("id").alias("pos")))
    assert seen.filter("seen").count() == 2
    assert etl.epoch_cap(docs, 4).count() == 4
    assert etl.k_folds(docs, "d", 4).groupBy("fold").count().count() == 4


def test_linear_models(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 90) * 2
    x = np.eye(5)[y][:, ::2] * 2 + rng.standard_normal((90, 3)) * 0.3
    rows = spark.createDataFrame([(i, list(map(float, a)), int(b)) for i, (a, b) in enumerate(zip(x, y))], "d bigint, x array<double>, y int")
    labels, w, duals = linear.fit_hinge(rows, 1.0, rounds=6, blocks=3)
    assert labels == [0, 2, 4]
    pred = linear.predict(rows, labels, w)
    assert metrics.accuracy(pred, "y", "pred").first()["accuracy"] > 0.9
    assert all(0 <= a <= 1 for r in duals.collect() for a in r["a"])
    assert all(abs(sum(r["prob"]) - 1) < 1e-9 for r in linear.probabilities(pred).collect())
    back, weights = linear.model_of(linear.model_table(spark, labels, w))
    assert back == labels and np.allclose(weights, w)
    assert linear.best_c(spark, x, y, np.arange(90) % 3, "mcsvm", [0.1, 1.0])[1] > 0.9


@pytest.fixture(scope="module")
def far_vectors(spark, tmp_path_factory):
    """(folder, x, y): an embeddings table whose ids all lie beyond 200, every component of use."""
    rng, path = np.random.default_rng(4), tmp_path_factory.mktemp("far")
    y = rng.integers(0, 3, 240)
    x = (rng.standard_normal((240, 12)) + 3 * np.eye(12)[y + 9]).astype(np.float32)
    rows = [(200 + i, list(map(float, a)), int(b)) for i, (a, b) in enumerate(zip(x, y))]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3).write.parquet(str(path / "embeddings.parquet"))
    return str(path), x.astype(float), y


def test_solvers_train_on_all_rows_and_components(spark, far_vectors):
    path, x, y = far_vectors
    got = {(r["solver"], r["label"], r["k"]): r["weight"] for r in model_queries.solvers(spark, path).collect()}
    want = {}
    for name in [*linear.SOLVERS, "mcsvm"]:
        labels, w = linear.train_one_task(x, y.astype(float) if "svr" in name else y, name, 0.5)
        want |= {(name, l, k): v for l, row in zip(labels or [-1], w) for k, v in enumerate(row)}
    assert got.keys() == want.keys() and all(got[key] == pytest.approx(want[key], abs=1e-9) for key in want)


def test_parameter_search_validates_on_all_rows(spark, far_vectors):
    path, x, y = far_vectors
    d = np.arange(200, 440)
    fold = np.empty(240, int)
    fold[np.lexsort((d, d * 7919 % 1_000_003))] = np.arange(240) * 4 // 240
    want = max(((linear.cross_validate(x, y, fold, "l2_lr", c), -c) for c in (0.01, 0.1, 1.0)))
    assert [tuple(r) for r in model_queries.parameter_search(spark, path).collect()] == [(-want[1], pytest.approx(want[0]))]


def test_svm_fit_sees_all_components(spark, far_vectors):
    assert model_queries.svm_fit(spark, far_vectors[0]).first()["accuracy"] > 0.9


def test_negative_links_reach_all_orders(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    far = model_queries.whole_links(spark, sf_dir).filter("y = 0").select("dst")
    assert far.filter("dst >= 1000").count() > 0.2 * far.count()
    assert far.join(keys, far["dst"] == keys["o_orderkey"], "left_anti").count() == 0


def test_dtm_scores_words_that_training_has_not_met(spark):
    schema = "ep bigint, d bigint, v bigint, f bigint"
    train = spark.createDataFrame([(d % 2, d, v, 1) for d in range(8) for v in range(4)], schema)
    test = spark.createDataFrame([(0, 50, 1, 2)], schema), spark.createDataFrame([(0, 50, 90, 3)], schema)
    model = dtm.fit(train, 1, dtm.Settings(topics=2, phi_rate=(0.01, 100, 0.51), burn_in=1, samples=1), test)
    assert all(math.isfinite(h) for h in model.history)
    assert {r["v"] for r in model.phi.select("v").distinct().collect()} == {0, 1, 2, 3, 90}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("7 0:2 3:1\n\n9 1:4")
    got = {tuple(r) for r in files.read_corpus(spark, [str(tmp_path / "a.txt")]).collect()}
    assert got == {(7, 0, 2), (7, 3, 1), (9, 1, 4)}
    files.write_corpus(spark.createDataFrame(list(got), "d bigint, v bigint, f bigint"), str(tmp_path / "out"))
    assert {tuple(r) for r in files.read_corpus(spark, str(tmp_path / "out"), 2).collect()} == got
    (tmp_path / "l.txt").write_text("1 2 5 6\n2 0\n")
    assert {tuple(r) for r in files.read_links(spark, str(tmp_path / "l.txt"), 1, "train").collect()} == {(1, 5, 1, "train"), (1, 6, 1, "train")}
    (tmp_path / "t.gml").write_text("1\n3 7 4 5 4\n")
    assert [(r["y"], r["words"]) for r in files.read_labelled(spark, str(tmp_path / "t.gml")).collect()] == [(7, [4, 5, 4])]
    (tmp_path / "b.bin").write_bytes(files.block_bytes(3, [[0, 0, 2], [], [1]]))
    assert [(r["w"], r["docs"]) for r in files.read_blocks(spark, str(tmp_path / "b.bin")).orderBy("w").collect()] == [(0, [0, 0, 2]), (1, []), (2, [1])]
    for m, body in (("2012-12", "1 2 3 4 5\n1 2\n"), ("2013-01", "9 9 9 9 9 9\n")):
        (tmp_path / f"{m}.txt").write_text(body)
    assert [(r["ep"], r["words"]) for r in files.read_months(spark, str(tmp_path), "2012-12", "2013-02").orderBy("ep").collect()] == [(0, [1, 2, 3, 4, 5]), (1, [9] * 6)]
    (tmp_path / "m.txt").write_text("1.0 2.0\n0.5 1.0\n")
    assert sorted((r["k"], r["x"]) for r in files.read_matrix(spark, str(tmp_path / "m.txt")).collect()) == [(0, 0.0), (0, 0.5), (1, 0.0), (1, 1.0)]
    (tmp_path / "v.txt").write_text("0 alpha 3\n1 beta 2\n")
    assert files.read_vocabulary(spark, str(tmp_path / "v.txt")).count() == 2
    (tmp_path / "p.txt").write_text("0 1\n1 0\n")
    assert files.read_pairs(spark, str(tmp_path / "p.txt"), "d", "y").filter("d = 0").first()["y"] == 1
    (tmp_path / "f.list").write_text("x.gz\ny.gz\n")
    assert files.read_file_list(spark, str(tmp_path / "f.list")) == ["x.gz", "y.gz"]
    files.write_topics(spark.createDataFrame([(0, 2, "b"), (0, 1, "a"), (1, 1, "c")], "k int, rank int, w string"), str(tmp_path / "topics"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "topics")).collect()) == ["a b", "c"]


def test_time_sliced_files(spark, tmp_path):
    rows = spark.createDataFrame([("tr", e, d, 1, 2) for e in range(3) for d in range(4)] + [("te", 0, 9, 1, 1)], "split string, ep bigint, d bigint, v bigint, f bigint")
    files.write_time_sliced(rows, str(tmp_path / "t"))
    assert files.read_time_sliced(spark, str(tmp_path / "t"), "tr", 2, 3).count() == 6
    assert files.read_time_sliced(spark, str(tmp_path / "t"), "te").first()["d"] == 9
    files.show_topics(spark.createDataFrame([(0, 1, 1, "a", 0.5), (0, 1, 2, "b", 0.25)], "ep string, k int, rank int, w string, p double"), str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first()["value"] == "Topic 1: (a: 0.500000) (b: 0.250000)"
    files.split_input(spark, str(tmp_path / "s"), str(tmp_path / "x"), 1)
    assert spark.read.text(str(tmp_path / "x")).count() == 1
    files.write_parameters(spark.createDataFrame([(0, 1, [0.5])], "ep int, v int, phi array<double>"), spark.createDataFrame([(0, [0.0])], "ep int, alpha array<double>"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p" / "phi")).count() == 1


def test_running_sum(spark):
    from skein.operators import ranks

    df = spark.range(100).select((F.col("id") * 37 % 101).alias("k"), F.col("id").alias("x"))
    got = ranks.running_sum(df, ["k"], F.col("x"), "s").orderBy("k").collect()
    total = 0
    for r in got:
        total += r["x"]
        assert r["s"] == total
