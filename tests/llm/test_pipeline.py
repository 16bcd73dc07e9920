import struct

import corpus_pipeline
from skein.llm import exact_dedup, near_dup, quality_rules


def test_stages_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = corpus_pipeline.keep_good(spark, docs, sf_dir)
    keep = {r["doc_id"] for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == keep and good.columns == docs.columns
    once = corpus_pipeline.drop_copies(spark, good, sf_dir)
    assert {r["doc_id"] for r in once.collect()} == {r["doc_id"] for r in exact_dedup.exact_dedup(good).filter("kept").collect()}
    apart = corpus_pipeline.drop_near_copies(spark, once, sf_dir)
    assert {r["doc_id"] for r in apart.collect()} == {r["component_id"] for r in near_dup.near_duplicates(once).collect()}
    mixed = corpus_pipeline.mix_sources(spark, apart, sf_dir)
    assert mixed.columns == docs.columns
    out = corpus_pipeline.tokenise(spark, mixed, sf_dir).collect()
    assert len(out) == mixed.count()

    import public_tokenizers
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out[:50]:
        ids = ref.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r["n_tokens"] == len(ids)


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dup", "mixing", "bpe"]
