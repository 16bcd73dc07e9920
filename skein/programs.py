"""The programs as functions and a command line: python -m skein.programs NAME --flag value ...

format     text corpus -> maps and blocks        lda        topics of blocks
med_lda    supervised topics and test accuracy    rtm        topics of linked documents
dtm_format monthly files -> time-sliced corpus   dtm        topics that change over time

Files of a corpus share a prefix: .filelist (paths of text files), .vocab ('idx word count'),
.docmap, .wordmap and .bin (folders that format writes), .labelmap ('document label'),
_test.gml (labelled test documents), .trainposlink, .trainneglink.RATIO, .testposlink and
.testneglink (link lists). What a program writes are folders of part files, so no step
passes a corpus through the driver. Each function returns its metrics as a DataFrame.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import dtm, etl, lda, medlda, metrics, ranks, rtm
from skein.sources import files

TOP_WORDS = 20


def run_format(spark: SparkSession, prefix: str, doc_part: int = 2, word_part: int = 2) -> DataFrame:
    """Write .docmap, .wordmap and .bin of the text files that .filelist names; (documents, words, tokens)."""
    dw = files.read_corpus(spark, files.read_file_list(spark, f"{prefix}.filelist"))
    docmap = etl.document_map(dw.select("d").distinct(), doc_part)
    wordmap = etl.word_map(etl.term_frequency(dw), word_part)
    files.write_maps(docmap.select("p", "d", "local"), f"{prefix}.docmap")
    files.write_maps(wordmap.select("p", "v", "local"), f"{prefix}.wordmap")
    docmap, wordmap = _maps(spark, prefix)
    files.write_blocks(etl.index_blocks(etl.blocks(dw, docmap, wordmap)), f"{prefix}.bin")
    cells = _corpus(spark, prefix)
    return cells.agg(F.countDistinct("d").alias("documents"), F.countDistinct("v").alias("words"), F.sum("f").alias("tokens"))


def _maps(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame]:
    return files.read_maps(spark, f"{prefix}.docmap", "d"), files.read_maps(spark, f"{prefix}.wordmap", "v")


def _corpus(spark: SparkSession, prefix: str) -> DataFrame:
    """(d, v, f) of the blocks that run_format() has written."""
    return etl.from_blocks(files.read_block_table(spark, f"{prefix}.bin"), *_maps(spark, prefix))


def _write_top(spark: SparkSession, model: lda.LdaModel, prefix: str) -> None:
    top = metrics.top_words(model.topics(), ["k"], "c", TOP_WORDS)
    named = metrics.topic_words(top, files.read_vocabulary(spark, f"{prefix}.vocab"))
    files.write_topics(named.select("k", "rank", "w"), f"{prefix}.topic")


def _sweeps(spark: SparkSession, model: lda.LdaModel) -> DataFrame:
    speed = model.mtokens or [None] * len(model.perplexity)
    rows = [(i, p, s) for i, (p, s) in enumerate(zip(model.perplexity, speed))]
    return spark.createDataFrame(rows, "iteration int, perplexity double, mtokens_per_s double")


def run_lda(spark: SparkSession, prefix: str, K: int = 100, alpha: float | None = None, beta: float = 0.01, iter: int = 100, report: Callable[[str], None] | None = print) -> DataFrame:
    """Train on the blocks, write the top words of each topic to .topic; a row for each sweep."""
    model = lda.fit(_corpus(spark, prefix), K, alpha, beta, iter, report=report)
    _write_top(spark, model, prefix)
    return _sweeps(spark, model)


def run_med_lda(spark: SparkSession, prefix: str, K: int = 100, alpha: float | None = None, beta: float = 0.01, c: float = 16.0, iter: int = 10, gibbsiter: int = 100) -> DataFrame:
    """Train on the labelled documents of the blocks, write .topic and the test documents' labels to .pred; (n, accuracy)."""
    dw = _corpus(spark, prefix)
    labels = etl.with_labels(dw.select("d").distinct(), files.read_pairs(spark, f"{prefix}.labelmap", "d", "y")).filter("y >= 0")
    model = medlda.fit(dw, labels, K, alpha, beta, c, iter, gibbsiter)
    _write_top(spark, model.topics, prefix)
    test = files.read_labelled(spark, f"{prefix}_test.gml").withColumn("d", F.monotonically_increasing_id())
    words = test.select("d", "y", F.explode("words").alias("v")).groupBy("d", "y", "v").agg(F.count(F.lit(1)).alias("f"))
    guess = medlda.predict(model, words.select("d", "v", "f"))
    guess.join(words.select("d", "y").distinct(), "d").write.parquet(f"{prefix}.pred")
    return metrics.accuracy(spark.read.parquet(f"{prefix}.pred"), "y", "pred")


def run_rtm(spark: SparkSession, prefix: str, K: int = 20, alpha: float | None = None, beta: float = 0.01, iter: int = 100, mu: float = 0.1, cpos: int = 10, cneg: int = 1, negratio: str = "0.01") -> DataFrame:
    """Train on the blocks and the train links; AUC of train and test links by iteration."""
    sources = (("trainposlink", 1, "train"), (f"trainneglink.{negratio}", 0, "train"), ("testposlink", 1, "test"), ("testneglink", 0, "test"))
    links = None
    for name, y, split in sources:
        rows = files.read_links(spark, f"{prefix}.{name}", y, split)
        links = rows if links is None else links.union(rows)
    model = rtm.fit(_corpus(spark, prefix), links, K, alpha, beta, mu, cpos, cneg, iter)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(model.history)], "iteration int, train_auc double, test_auc double")


def run_dtm_format(spark: SparkSession, folder: str, start: str, end: str, out_prefix: str, cols: int = 1, col: int = 0, most: int | None = None) -> DataFrame:
    """Split the documents of monthly files into train ('tr') and test, test tokens into observed ('to') and held out ('th'), and write OUT.corpus; documents by epoch and split."""
    docs = ranks.row_numbers(files.read_months(spark, folder, start, end), ["ep", "line"], "d")
    docs = docs if most is None else etl.epoch_cap(docs, most)
    docs = etl.train_test(docs)
    places = docs.select("split", "ep", "d", F.posexplode("words").alias("pos", "v"))
    test = etl.held_out(places.filter("split = 'te'")).withColumn("split", F.when(F.col("seen"), "to").otherwise("th")).drop("seen")
    cells = places.filter("split = 'tr'").unionByName(test).groupBy("split", "ep", "d", "v").agg(F.count(F.lit(1)).alias("f"))
    files.write_time_sliced(etl.column_words(cells, cols, col), f"{out_prefix}.corpus")
    return docs.groupBy("ep", "split").agg(F.count(F.lit(1)).alias("documents"))


def run_dtm(spark: SparkSession, corpus_prefix: str, dump_prefix: str = "last", n_iters: int = 10000, n_topics: int = 50, n_doc_batch: int = 60, n_sgld_phi: int = 2, n_sgld_eta: int = 4, n_infer_burn_in: int = 16, n_infer_samples: int = 24, sig_al: float = 0.6, sig_al0: float = 0.1, sig_phi: float = 0.2, sig_phi0: float = 8.0, sig_eta: float = 6.0, report_every: int = 1, show_topics_K: int = 0) -> DataFrame:
    """Train on CORPUS.corpus, write the parameters to DUMP and, if asked for, top words by CORPUS.dict to DUMP.topics; held-out perplexity by report."""
    split = lambda name: files.read_time_sliced(spark, f"{corpus_prefix}.corpus", name)
    s = dtm.Settings(topics=n_topics, sigma_phi=sig_phi, sigma_phi0=sig_phi0, sigma_alpha=sig_al, sigma_alpha0=sig_al0, sigma_eta=sig_eta, phi_steps=n_sgld_phi, eta_steps=n_sgld_eta, batch=n_doc_batch, burn_in=n_infer_burn_in, samples=n_infer_samples)
    model = dtm.fit(split("tr"), n_iters, s, (split("to"), split("th")), report_every)
    alpha = spark.createDataFrame([(e, list(map(float, row))) for e, row in enumerate(model.alpha)], "ep bigint, alpha array<double>")
    files.write_parameters(model.phi, alpha, dump_prefix)
    if show_topics_K:
        cells = model.phi.select("ep", "v", F.posexplode("phi").alias("k", "x"))
        norm = cells.groupBy("ep", "k").agg(F.sum(F.exp("x")).alias("z"))
        top = metrics.top_words(cells, ["ep", "k"], "x", show_topics_K).join(F.broadcast(norm), ["ep", "k"])
        named = metrics.topic_words(top, files.read_dictionary(spark, f"{corpus_prefix}.dict"))
        files.show_topics(named.select("ep", "k", "rank", "w", (F.exp("x") / F.col("z")).alias("p")), f"{dump_prefix}.topics")
    return spark.createDataFrame(list(enumerate(model.history)), "report int, perplexity double")


PROGRAMS: dict[str, Callable] = {"format": run_format, "lda": run_lda, "med_lda": run_med_lda, "rtm": run_rtm, "dtm_format": run_dtm_format, "dtm": run_dtm}


def parser() -> argparse.ArgumentParser:
    """Flags of each program: its function's parameters, with their defaults."""
    import inspect

    kinds = {"int": int, "float": float, "str": str, "float | None": float, "int | None": int}
    out = argparse.ArgumentParser(prog="skein.programs", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    each = out.add_subparsers(dest="program", required=True)
    for name, run in PROGRAMS.items():
        sub = each.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for p in list(inspect.signature(run).parameters.values())[1:]:
            if p.annotation in kinds:
                needed = p.default is inspect.Parameter.empty
                sub.add_argument(f"--{p.name}", type=kinds[p.annotation], required=needed, default=None if needed else p.default)
    return out


def main(args: list[str] | None = None) -> None:
    """Run one program in the session that spark-submit or the environment configures."""
    flags = vars(parser().parse_args(args))
    PROGRAMS[flags.pop("program")](SparkSession.builder.getOrCreate(), **flags).show(1000, truncate=False)


if __name__ == "__main__":
    main()
