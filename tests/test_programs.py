import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import programs
from skein.functions import kernels
from skein.operators import etl, linear, rtm
from skein.sources import files


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """(prefix, cells): text files of 24 documents of two kinds, with a vocabulary, labels, links and test documents."""
    rng, base = np.random.default_rng(6), tmp_path_factory.mktemp("corpus")
    prefix, cells = str(base / "c"), {}
    for part in range(2):
        with open(base / f"part{part}.txt", "w") as out:
            for d in range(part * 12, part * 12 + 12):
                words = rng.integers(0, 5, 40) + 5 * (d % 2)
                ids, counts = np.unique(words, return_counts=True)
                cells |= {(d, int(v)): int(f) for v, f in zip(ids, counts)}
                out.write(f"{d} " + " ".join(f"{v}:{f}" for v, f in zip(ids, counts)) + "\n")
    write = lambda name, lines: open(prefix + name, "w").write("\n".join(lines) + "\n")
    write(".filelist", [str(base / f"part{p}.txt") for p in range(2)])
    write(".vocab", [f"{v} word{v} 9" for v in range(10)])
    write(".labelmap", [f"{d} {d % 2}" for d in range(20)])
    write("_test.gml", ["4", *[f"30 {k % 2} " + " ".join(str(v) for v in rng.integers(0, 5, 30) + 5 * (k % 2)) for k in range(4)]])
    for name, shift in ((".trainposlink", 2), (".trainneglink.0.01", 1), (".testposlink", 4), (".testneglink", 3)):
        write(name, [f"{d} 1 {(d + shift) % 24}" for d in range(0 if shift < 3 else 1, 24, 2)])
    return prefix, cells


def test_programs_on_a_corpus(spark, corpus):
    prefix, cells = corpus
    stat = programs.run_format(spark, prefix, 3, 2).first()
    assert (stat["documents"], stat["words"], stat["tokens"]) == (24, 10, 24 * 40)
    assert {(r["d"], r["v"]): r["f"] for r in programs._corpus(spark, prefix).collect()} == cells
    lines = []
    sweeps = programs.run_lda(spark, prefix, K=2, iter=3, report=lines.append).collect()
    assert len(sweeps) == len(lines) == 3 and sweeps[-1]["perplexity"] < 12 and all(r["mtokens_per_s"] > 0 for r in sweeps)
    topics = [r["value"].split() for r in spark.read.text(prefix + ".topic").collect()]
    assert len(topics) == 2 and all(w.startswith("word") for t in topics for w in t)


def test_supervised_program(spark, corpus):
    shutil.rmtree(corpus[0] + ".topic", ignore_errors=True)
    got = programs.run_med_lda(spark, corpus[0], K=3, iter=1, gibbsiter=4).first()
    assert got["n"] == 4 and got["accuracy"] >= 0.5


def test_link_program(spark, corpus):
    got = programs.run_rtm(spark, corpus[0], K=2, iter=2).collect()
    assert len(got) == 2 and all(0 <= r["train_auc"] <= 1 for r in got)
    with pytest.raises(ValueError):
        rtm.fit(None, None, rtm.MAX_TOPICS + 1)


def test_time_programs(spark, tmp_path):
    rng, folder = np.random.default_rng(2), tmp_path / "months"
    folder.mkdir()
    for month in ("2001-01", "2001-02"):
        lines = [" ".join(str(v) for v in rng.integers(0, 12, 12)) for _ in range(10)]
        (folder / f"{month}.txt").write_text("\n".join(lines) + "\n")
    prefix = str(tmp_path / "t")
    docs = {(r["ep"], r["split"]): r["documents"] for r in programs.run_dtm_format(spark, str(folder), "2001-01", "2001-03", prefix).collect()}
    assert docs == {(e, s): n for e in (0, 1) for s, n in (("tr", 8), ("te", 2))}
    (tmp_path / "t.dict").write_text("".join(f"w{v} {v}\n" for v in range(12)))
    got = programs.run_dtm(spark, prefix, str(tmp_path / "dump"), n_iters=2, n_topics=2, n_infer_burn_in=1, n_infer_samples=1, show_topics_K=3).collect()
    assert len(got) == 3 and all(r["perplexity"] > 0 for r in got)
    shown = spark.read.text(str(tmp_path / "dump.topics")).collect()
    assert len(shown) == 4 and all(r["value"].startswith("Topic") and "(w" in r["value"] for r in shown)
    cells = files.read_time_sliced(spark, f"{prefix}.corpus", "tr")
    assert sum(etl.column_words(cells, 3, c).count() for c in range(3)) == cells.count()


def test_flags():
    flags = vars(programs.parser().parse_args(["lda", "--prefix", "p", "--K", "7", "--alpha", "0.5"]))
    assert flags == {"program": "lda", "prefix": "p", "K": 7, "alpha": 0.5, "beta": 0.01, "iter": 100}
    assert programs.parser().parse_args(["rtm", "--prefix", "p"]).cpos == 10


def test_dictionary_and_maps(spark, tmp_path):
    (tmp_path / "d").write_text("stone 3\nriver 1\n")
    assert {(r["w"], r["v"]) for r in files.read_dictionary(spark, str(tmp_path / "d")).collect()} == {("stone", 3), ("river", 1)}
    rows = [(0, 5, 0), (1, 6, 0), (1, 7, 1)]
    files.write_maps(spark.createDataFrame(rows, "p bigint, d bigint, local bigint"), str(tmp_path / "m"))
    assert {(r["p"], r["d"], r["local"]) for r in files.read_maps(spark, str(tmp_path / "m"), "d").collect()} == set(rows)
    docs = spark.createDataFrame([(1,), (2,)], "d bigint")
    labels = spark.createDataFrame([(2, 4)], "d bigint, y bigint")
    assert {(r["d"], r["y"]) for r in etl.with_labels(docs, labels).collect()} == {(1, -1), (2, 4)}


def test_dual_logistic_equals_primal():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4))
    y = np.where(x @ [1, -2, 0.5, 0] + rng.normal(size=120) > 0, 1.0, -1.0)
    for c in (0.1, 2.0, np.where(y > 0, 3.0, 0.5)):
        assert np.allclose(kernels.dual_logistic(x, y, c, eps=1e-8), kernels.logistic(x, y, c), atol=2e-2)
    for a, b in ((0.0, 0.0), (3.0, 10.0), (-50.0, 4.0), (900.0, 1.0)):
        t = kernels.logit_root(a, b)
        assert abs(t + a + b / (1 + np.exp(-min(max(t, -700), 700)))) < 1e-8


def test_label_weights_bias_and_checks():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(200, 2)), rng.integers(0, 2, 200)
    heavy = lambda w: (x @ linear.train_one_task(x, y, "l2_lr", 1.0, {1: w}, None)[1][1] > 0).mean()
    with_bias = [linear.train_one_task(x, y, s, 1.0, {1: 20.0}, 1.0)[1] for s in ("l2_lr", "l2_lr_dual", "l2_svc")]
    assert all(w.shape == (2, 3) and w[1, 2] > 0.5 for w in with_bias) and 0 <= heavy(1.0) <= 1
    for bad in (("none", 1.0, {}), ("l2_lr", 0.0, {}), ("mcsvm", 1.0, {1: 2.0}), ("l2_svr", 1.0, {1: 2.0}), ("l2_lr", 1.0, {1: -1.0})):
        with pytest.raises(ValueError):
            linear.check_parameters(bad[0], bad[1], label_weights=bad[2])
    assert linear.has_probabilities("l2_lr") and not linear.has_probabilities("l2_svc") and linear.is_regression("l1_svr_dual")
