"""Supervised, relational and time-sliced model queries, with their oracle SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import arrays
from skein.operators import dtm, etl, lda, linear, medlda, metrics, rtm
from skein.plans.lda_queries import ALPHA, K, orders_corpus
from skein.sources import tables
from skein.sources.state import written

#: A fixed K x K matrix for the bilinear form: 0.1 i - 0.07 j.
U = [[round(0.1 * i - 0.07 * j, 6) for j in range(K)] for i in range(K)]
C_POS, C_NEG, MU = 10.0, 1.0, 0.1
SIGMA, SIGMA0 = 0.2, 8.0


def doubles(e):
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def embeddings(spark, sf_dir):
    """(d, y, x): the whole embeddings as features."""
    return doubles(tables.table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("d"), F.col("label").alias("y"), "x")


def vectors(spark, sf_dir):
    """(d, y, x): the first eight components of the embeddings as features."""
    return embeddings(spark, sf_dir).withColumn("x", F.slice("x", 1, K))


# -- linear models and supervised topics


def ovr_labels(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    labels = F.broadcast(rows.select(F.col("y").alias("label")).distinct())
    return rows.select("d", "y").crossJoin(labels).select("d", "label", F.when(F.col("y") == F.col("label"), 1).otherwise(-1).alias("sign"))


def class_groups(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first")).withColumn("place", F.row_number().over(Window.orderBy("first")).cast("bigint"))


def svm_features(spark, sf_dir):
    from skein.operators import counts

    z = counts.assign(orders_corpus(spark, sf_dir), K)
    c = counts.dense_counts(z, "d", K).select("d", F.transform("c", lambda x: x.cast("double")).alias("c"))
    return c.select("d", F.posexplode(medlda.theta(F.col("c"), ALPHA, K)).alias("k", "x")).withColumn("x", F.round("x", 9))


def _margins(spark, sf_dir):
    """(s, v, g): sign, squared norm and decision value of fixed weights 0.1 (i + 1)."""
    rows = vectors(spark, sf_dir)
    w = F.array(*[F.lit(round(0.1 * (i + 1), 1)) for i in range(K)])
    return rows.select(F.when(F.col("y") >= 5, 1.0).otherwise(-1.0).alias("s"), F.col("y").cast("double").alias("y"), arrays.dot(F.col("x"), w).alias("g"))


def _objective(rows, loss):
    half = sum(round(0.1 * (i + 1), 1) ** 2 for i in range(K)) / 2
    return rows.agg(F.round(F.lit(half) + F.sum(loss), 6).alias("objective"))


def hinge_objective(spark, sf_dir):
    return _objective(_margins(spark, sf_dir), F.greatest(F.lit(0.0), 1 - F.col("s") * F.col("g")))


def sq_hinge_objective(spark, sf_dir):
    return _objective(_margins(spark, sf_dir), F.pow(F.greatest(F.lit(0.0), 1 - F.col("s") * F.col("g")), 2))


def logistic_objective(spark, sf_dir):
    return _objective(_margins(spark, sf_dir), F.log1p(F.exp(-F.col("s") * F.col("g"))))


def svr_objective(spark, sf_dir):
    return _objective(_margins(spark, sf_dir), F.pow(F.greatest(F.lit(0.0), F.abs(F.col("g") - F.col("y")) - 0.1), 2))


def svm_argmax(spark, sf_dir):
    weights = np.array([[((l * 7 + i * 3) % 11) / 10 - 0.5 for i in range(K)] for l in range(10)])
    return linear.predict(vectors(spark, sf_dir), list(range(10)), weights).select("d", "y", "pred")


def svm_accuracy(spark, sf_dir):
    return metrics.accuracy(svm_argmax(spark, sf_dir), "y", "pred")


def kfold(spark, sf_dir):
    return etl.k_folds(vectors(spark, sf_dir).select("d"), "d", 5)


def margin_term(spark, sf_dir):
    """F11 with fixed duals ((d + j) mod 5) / 4 and weights ((3 j + k) mod 7) / 6 for labels 0 to 2."""
    from skein.operators import counts

    z = counts.assign(orders_corpus(spark, sf_dir), K)
    cd = counts.dense_counts(z, "d", K).select("d", F.transform("c", lambda x: x.cast("double")).alias("cd"))
    duals = cd.select("d", (F.col("d") % 3).cast("int").alias("y"), F.array(*[((F.col("d") + j) % 5) / F.lit(4.0) for j in range(3)]).alias("a"))
    weights = np.array([[((3 * j + k) % 7) / 6 for k in range(K)] for j in range(3)])
    return medlda.margin_terms(duals, cd, [0, 1, 2], weights).select("d", F.posexplode("m").alias("k", "m")).withColumn("m", F.round("m", 9))


def svm_fit(spark, sf_dir):
    """Training accuracy of the distributed hinge solver on the whole embeddings."""
    rows = embeddings(spark, sf_dir)
    labels, w, _ = linear.fit_hinge(rows, 1.0, rounds=4)
    return metrics.accuracy(linear.predict(rows, labels, w), "y", "pred")


def solvers(spark, sf_dir):
    """Weights of every exact solver over the whole table; a task for each solver and label."""
    x, y, _ = linear.gathered(embeddings(spark, sf_dir))
    return linear.train_tasks(spark, x, y, [*linear.SOLVERS, "mcsvm"], 0.5)


def parameter_search(spark, sf_dir):
    """The best C of a grid by cross-validation over the whole table; a task for each value and fold."""
    x, y, rest = linear.gathered(etl.k_folds(embeddings(spark, sf_dir), "d", 4))
    c, acc = linear.best_c(spark, x, y, rest["fold"], "l2_lr", [0.01, 0.1, 1.0])
    return spark.createDataFrame([(c, acc)], "c double, accuracy double")


def medlda_fit(spark, sf_dir):
    """Perplexities of a supervised model of the order corpus, labels by order number."""
    dw = orders_corpus(spark, sf_dir)
    y = dw.select("d").distinct().select("d", (F.col("d") % 3).cast("int").alias("y"))
    model = medlda.fit(dw, y, 4, iterations=1, sweeps=2)
    return spark.createDataFrame(list(enumerate(model.topics.perplexity)), "iteration int, perplexity double")


# -- relational topics


def order_links(spark, sf_dir, span=1000):
    """(src, dst, y): consecutive orders of one customer, and as many pairs by a shift of the first, modulo span."""
    o = tables.table(spark, sf_dir, "orders")
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pos = o.select(F.col("o_orderkey").alias("src"), nxt.alias("dst")).filter("dst is not null")
    neg = pos.select("src", ((F.col("src") * 31 + 7) % F.lit(span)).alias("dst"))
    return pos.withColumn("y", F.lit(1)).unionByName(neg.withColumn("y", F.lit(0)))


def link_union(spark, sf_dir):
    return order_links(spark, sf_dir).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("src").alias("src_sum"), F.sum("dst").alias("dst_sum"))


def link_remap(spark, sf_dir):
    docs = etl.document_map(tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d")), 1)
    links = order_links(spark, sf_dir)
    ends = links.join(docs.select(F.col("d").alias("src"), F.col("local").alias("s")), "src").join(docs.select(F.col("d").alias("dst"), F.col("local").alias("t")), "dst")
    return ends.select("s", "t", "y")


def reverse_adjacency(spark, sf_dir):
    links = order_links(spark, sf_dir)
    both = links.select(F.col("src").alias("d"), F.col("dst").alias("other"), F.lit(0).alias("reached")).union(links.select("dst", "src", F.lit(1)))
    return both.groupBy("d", "reached").agg(F.count(F.lit(1)).alias("n"), F.sum("other").alias("other_sum"))


def edge_kappa(spark, sf_dir):
    return rtm.edge_constants(order_links(spark, sf_dir), C_POS, C_NEG).groupBy("y", "kappa").agg(F.count(F.lit(1)).alias("n"))


def _zbar(spark, sf_dir):
    from skein.operators import counts

    c = counts.dense_counts(counts.assign(orders_corpus(spark, sf_dir), K), "d", K)
    n = F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return c.select("d", F.transform("c", lambda x: x / n).alias("z"))


def zbar(spark, sf_dir):
    return _zbar(spark, sf_dir).select("d", F.posexplode("z").alias("k", "z")).withColumn("z", F.round("z", 9))


def bilinear_score(spark, sf_dir):
    ends = rtm.with_ends(order_links(spark, sf_dir), _zbar(spark, sf_dir))
    return ends.select("src", "dst", "y", F.round(arrays.bilinear(F.col("zs"), U, F.col("zd")), 9).alias("score"))


def gram_matrix(spark, sf_dir):
    ends = rtm.with_ends(rtm.edge_constants(order_links(spark, sf_dir), C_POS, C_NEG), _zbar(spark, sf_dir)).withColumn("lam", F.lit(1.0) + F.col("y"))
    precision, b = rtm.gram(ends, K, MU)
    rows = [(i, j, round(float(precision[i, j]), 6), round(float(b[i]), 6)) for i in range(K * K) for j in range(K * K)]
    return spark.createDataFrame(rows, "i int, j int, precision double, b double")


def auc_ties(spark, sf_dir):
    d, l = tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels")
    return metrics.auc(d.join(l, "doc_id").select((F.floor(F.col("n_chars") / 100)).alias("score"), F.col("quality").alias("y")))


def link_accuracy(spark, sf_dir):
    return metrics.accuracy(bilinear_score(spark, sf_dir).withColumn("pred", (F.col("score") >= 0).cast("int")), "y", "pred")


def pg_mean(spark, sf_dir):
    s = bilinear_score(spark, sf_dir)
    c = F.when(F.col("y") == 1, F.lit(C_POS)).otherwise(F.lit(C_NEG))
    return s.select("src", "dst", "y", F.round(arrays.pg_mean(c, F.col("score")), 9).alias("m"))


def normal_cdf(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(arrays.normal_cdf((F.col("l_quantity") - 25) / 10), 9).alias("p"))


def whole_links(spark, sf_dir):
    """order_links() whose negative pairs reach every order."""
    last = tables.table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return order_links(spark, sf_dir, (last or 0) + 1)


def rtm_fit(spark, sf_dir):
    """Train and test AUC after the last of two iterations of a small relational model over all orders."""
    # Links to orders without lines meet no topic shares in fit(); a pair of both signs is a positive link.
    links = whole_links(spark, sf_dir).repartition("src").groupBy("src", "dst").agg(F.max("y").alias("y")).withColumn("split", F.when(F.col("src") % 5 == 0, "test").otherwise("train"))
    # The second sweep is the first whose words are weighed by links with drawn lam.
    model = rtm.fit(orders_corpus(spark, sf_dir), links.select("src", "dst", "y", "split"), 3, c_pos=2, c_neg=1, iterations=2)
    return spark.createDataFrame([(len(model.history) - 1, *model.history[-1])], "iteration int, train_auc double, test_auc double")


# -- topics over time


def time_corpus(spark, sf_dir):
    """(ep, d, v, f): order lines by ship year from the first."""
    li = tables.table(spark, sf_dir, "lineitem")
    return li.groupBy((F.year("l_shipdate") - 1995).cast("bigint").alias("ep"), F.col("l_orderkey").alias("d"), F.col("l_partkey").alias("v")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("f"))


def epoch_assign(spark, sf_dir):
    return time_corpus(spark, sf_dir).groupBy("ep").agg(F.count_distinct("d").alias("docs"), F.sum("f").alias("tokens"))


def epoch_range_partition(spark, sf_dir):
    return etl.epoch_ranges(spark, epoch_assign(spark, sf_dir).select("ep", F.col("tokens").alias("load")), 3)


def train_test_split(spark, sf_dir):
    return etl.train_test(time_corpus(spark, sf_dir).select("ep", "d").distinct())


def observed_heldout(spark, sf_dir):
    from skein.plans.lda_queries import tokens

    return etl.held_out(tokens(spark, sf_dir)).groupBy("d", "seen").agg(F.count(F.lit(1)).alias("n"))


def minibatch(spark, sf_dir):
    return dtm.minibatch(time_corpus(spark, sf_dir).select("ep", "d").distinct(), 60, 1, 3)


def month_names(spark, sf_dir):
    return spark.range(1).select(F.explode(etl.months("2012-10", "2015-03")).alias("month"))


def phi_cells(spark, sf_dir):
    """(ep, k, v, phi, c): log(1 + f) / (k + 1) over 2 topics of the order lines by year."""
    return cells_of(time_corpus(spark, sf_dir))


def cells_of(toks):
    """phi_cells() of tokens (ep, d, v, f)."""
    f = toks.groupBy("ep", "v").agg(F.sum("f").alias("c"))
    return f.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select("ep", "k", "v", (F.log1p(F.col("c").cast("double")) / (F.col("k") + 1)).alias("phi"), F.col("c").alias("c"))


def phi_log_normalizer(spark, sf_dir):
    return dtm.log_normalisers(phi_cells(spark, sf_dir)).select("ep", "k", F.round("logz", 9).alias("logz"))


def phi_chain_prior(spark, sf_dir):
    order = Window.partitionBy("k", "v").orderBy("ep")
    return phi_cells(spark, sf_dir).select("ep", "k", "v", F.round(dtm.chain_prior(F.col("phi"), order, SIGMA, SIGMA0), 6).alias("g"))


def _drift(spark, sf_dir):
    cells = written(phi_cells(spark, sf_dir), "cells")
    ck = cells.groupBy("ep", "k").agg(F.sum("c").alias("ck"))
    rows = cells.join(dtm.log_normalisers(cells), ["ep", "k"]).join(ck, ["ep", "k"])
    order = Window.partitionBy("k", "v").orderBy("ep")
    g = 2 * (F.col("c") - F.col("ck") * F.exp(F.col("phi") - F.col("logz"))) + dtm.chain_prior(F.col("phi"), order, SIGMA, SIGMA0)
    return rows.select("ep", "k", "v", "phi", g.alias("g"))


def phi_sgld_drift(spark, sf_dir):
    e = dtm.rate(3, (20.0, 100.0, 0.51))
    return _drift(spark, sf_dir).select("ep", "k", "v", F.round(F.col("phi") + F.lit(e / 2) * F.col("g"), 5).alias("phi"))


def psgld_step(spark, sf_dir):
    e = dtm.rate(3, (20.0, 100.0, 0.51))
    pre = F.lit(0.95) * 0.5 + F.lit(0.05) * F.col("g") * F.col("g")
    return _drift(spark, sf_dir).select("ep", "k", "v", F.round(F.col("phi") + F.lit(e / 2) * F.col("g") / (F.lit(1e-4) + F.sqrt(pre)), 6).alias("phi"))


def eta_sgld_drift(spark, sf_dir):
    """Gradient of the document logits at eta = x (embeddings), counts = vec_id + i, alpha = 0.1 i."""
    rows = vectors(spark, sf_dir).select("d", "x", F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda i: ((F.col("d") + i) % 7).cast("double")).alias("c"))
    rows = rows.withColumn("s", arrays.softmax(F.col("x"))).withColumn("n", arrays.total(F.col("c")))
    g = F.transform("x", lambda x, i: F.when(i == K - 1, 0.0).otherwise((i * F.lit(0.1) - x) / 36 + F.get("c", i) - F.col("n") * F.get("s", i)))
    return rows.select("d", F.posexplode(g).alias("k", "g")).withColumn("g", F.round("g", 8))


def alpha_posterior_mean_var(spark, sf_dir):
    """Conditional mean and variance of each year's alpha with its neighbours fixed at 0.1 (ep + 1)."""
    rows = time_corpus(spark, sf_dir).groupBy("ep").agg(F.count_distinct("d").alias("n"), F.sum("f").alias("s"))
    order = Window.orderBy("ep")
    near = F.lag("ep").over(order), F.lead("ep").over(order)
    pa, p0, pe = 1 / 0.36, 1 / 0.01, 1 / 36.0
    precision = F.col("n") * pe + F.when(near[0].isNull(), p0).otherwise(pa) + F.when(near[1].isNull(), 0.0).otherwise(pa)
    b = F.col("s") * pe / 1000 + F.coalesce((near[0] + 1) * 0.1 * pa, F.lit(0.0)) + F.coalesce((near[1] + 1) * 0.1 * pa, F.lit(0.0))
    return rows.select("ep", F.round(b / precision, 9).alias("mean"), F.round(1 / precision, 12).alias("var"))


def heldout_perplexity(spark, sf_dir):
    toks = written(time_corpus(spark, sf_dir), "tokens")
    cells = written(cells_of(toks), "cells")
    cells = cells.join(dtm.log_normalisers(cells), ["ep", "k"])
    phi = cells.groupBy("ep", "v").agg(F.array(*[F.sum(F.when(F.col("k") == k, F.exp(F.col("phi") - F.col("logz")))) for k in (0, 1)]).alias("phi"))
    share = (F.col("d") % 9 + 1) / F.lit(10.0)
    theta = toks.select("d").distinct().select("d", F.array(share, 1 - share).alias("theta"))
    return metrics.heldout_perplexity(toks, phi, theta)


def dtm_topk(spark, sf_dir):
    return metrics.top_words(phi_cells(spark, sf_dir).select("ep", "k", "v", F.round("phi", 9).alias("phi")), ["ep", "k"], "phi", 10)


def dtm_fit(spark, sf_dir):
    """Held-out perplexity of a short run over yearly order lines."""
    toks = time_corpus(spark, sf_dir)
    test = toks.filter("d % 10 = 0")
    model = dtm.fit(toks.filter("d % 10 <> 0"), 1, dtm.Settings(topics=3, phi_rate=(0.01, 100.0, 0.51), burn_in=2, samples=3), (test.filter("v % 2 = 0"), test.filter("v % 2 = 1")))
    return spark.createDataFrame(list(enumerate(model.history)), "report int, perplexity double")


def sorted_merge(spark, sf_dir):
    """Two sorted runs of (key, value) merged by key."""
    o = tables.table(spark, sf_dir, "orders")
    runs = o.filter("o_custkey % 2 = 0").select("o_custkey", "o_orderkey").unionByName(o.filter("o_custkey % 2 = 1").select("o_custkey", "o_orderkey"))
    return runs.orderBy("o_custkey", "o_orderkey")


def order_by_packed_key(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    return li.select(F.shiftleft(F.col("l_partkey"), 32).bitwiseOR(F.col("l_orderkey")).alias("key"), "l_linenumber").orderBy("key", "l_linenumber")


def outer_product(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("d", F.slice("x", 1, 3).alias("a"), F.slice("x", 4, 3).alias("b"))
    return rows.select("d", F.posexplode(arrays.outer(F.col("a"), F.col("b"))).alias("i", "p")).withColumn("p", F.round("p", 9))


QUERIES = {f.__name__: f for f in (
    ovr_labels, class_groups, svm_features, hinge_objective, sq_hinge_objective, logistic_objective, svr_objective, svm_argmax, svm_accuracy, kfold, margin_term,
    svm_fit, solvers, parameter_search, medlda_fit, link_union, link_remap, reverse_adjacency, edge_kappa, zbar, bilinear_score, gram_matrix, auc_ties, link_accuracy,
    pg_mean, normal_cdf, rtm_fit, epoch_assign, epoch_range_partition, train_test_split, observed_heldout, minibatch, month_names, phi_log_normalizer,
    phi_chain_prior, phi_sgld_drift, psgld_step, eta_sgld_drift, alpha_posterior_mean_var, heldout_perplexity, dtm_topk, dtm_fit, sorted_merge,
    order_by_packed_key, outer_product,
)}

from skein.plans.model_oracle import ORACLE  # noqa: E402, F401
