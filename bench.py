"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ("lda_perplexity_init", "lda_perplexity_orders", "vocab_tf", "inverted_index", "block_sizes", "topic_topk", "sampler_probs", "bilinear_score", "auc_ties", "phi_sgld_drift", "heldout_perplexity")
SWEEPS, TOPICS = 3, 20


def main() -> None:
    from pyspark.sql import functions as F

    from skein.operators import lda
    from skein.plans import catalog, lda_queries
    from skein.plans.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", memory=os.environ.get("BENCH_MEMORY", "12g"))
    found, queries = {}, catalog.queries()
    spark.range(1_000_000).agg(F.sum("id")).collect()
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        found[name] = round(time.time() - began, 3)
    dw = lda_queries.orders_corpus(spark, sf_dir)
    tokens = dw.agg(F.sum("f")).first()[0]
    began = time.time()
    model = lda.fit(dw, TOPICS, 50.0 / TOPICS, 0.01, iterations=SWEEPS)
    found[f"lda_sweep_k{TOPICS}"] = round((time.time() - began) / SWEEPS, 3)
    print(json.dumps({
        "metric": "headline_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": Path(sf_dir).name.removeprefix("sf"),
        "cores": spark.sparkContext.defaultParallelism, "tokens": tokens, "token_updates_per_s": round(tokens / found[f"lda_sweep_k{TOPICS}"]), "perplexity": [round(p, 3) for p in model.perplexity],
    }))


if __name__ == "__main__":
    main()
