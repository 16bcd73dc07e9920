"""Corpus and LDA queries: counts, preparation, numerics, one deterministic sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import arrays
from skein.operators import counts, etl, lda, metrics, ranks
from skein.sources import tables
from skein.sources.state import written

K, ALPHA, BETA = 8, 0.5, 0.01
PARTS = 4


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dw of the documents table."""
    return tables.corpus(spark, sf_dir)[0]


def orders_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dw of the order lines: order, part, quantity."""
    li = tables.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("d"), F.col("l_partkey").alias("v")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("f"))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z of the order corpus."""
    return counts.assign(orders_corpus(spark, sf_dir), K)


def lda_perplexity_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of the corpus under a fixed pseudo-random topic assignment."""
    return counts.perplexity(counts.assign(written(text_corpus(spark, sf_dir), "dw"), K), K, ALPHA, BETA)


def lda_perplexity_orders(spark, sf_dir):
    """The same over the order corpus."""
    return counts.perplexity(counts.assign(written(orders_corpus(spark, sf_dir), "dw"), K), K, ALPHA, BETA)


def tokens(spark, sf_dir):
    return tables.tokens(tables.table(spark, sf_dir, "documents"))


def vocab_tf(spark, sf_dir):
    toks = tokens(spark, sf_dir)
    return tables.vocab(toks).join(toks.groupBy("w").agg(F.count(F.lit(1)).alias("tf")), "w").select("v", "w", "tf")


def doc_length(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("d").agg(F.count(F.lit(1)).alias("l"))


def doc_word_counts(spark, sf_dir):
    return tables.doc_words(tokens(spark, sf_dir))


def corpus_totals(spark, sf_dir):
    dw = orders_corpus(spark, sf_dir)
    return dw.agg(F.count_distinct("d").alias("n_docs"), F.max("d").alias("max_doc"), F.count_distinct("v").alias("n_words"), F.sum("f").alias("n_tokens"), F.round(F.sum("f") / F.count(F.lit(1)), 9).alias("average_count"))


def cdk(spark, sf_dir):
    return counts.long_counts(assigned(spark, sf_dir), "d")


def cwk(spark, sf_dir):
    return counts.long_counts(assigned(spark, sf_dir), "v")


def ck_marginal(spark, sf_dir):
    return assigned(spark, sf_dir).select(F.explode("z").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c"))


def avg_kd(spark, sf_dir):
    cells = cdk(spark, sf_dir)
    return cells.agg(F.round(F.count(F.lit(1)) / F.count_distinct("d"), 9).alias("kd"))


def occurrences(spark, sf_dir):
    return etl.expand_occurrences(orders_corpus(spark, sf_dir))


def libsvm_lines(spark, sf_dir):
    return etl.render_lines(orders_corpus(spark, sf_dir))


def libsvm_parse(spark, sf_dir):
    return etl.parse_lines(libsvm_lines(spark, sf_dir))


def docmap(spark, sf_dir):
    return etl.document_map(orders_corpus(spark, sf_dir).select("d").distinct(), PARTS)


def docs_per_part(spark, sf_dir):
    return docmap(spark, sf_dir).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def wordmap_lpt(spark, sf_dir):
    return etl.word_map(etl.term_frequency(orders_corpus(spark, sf_dir)), PARTS)


def inverted_index(spark, sf_dir):
    return etl.inverted_index(orders_corpus(spark, sf_dir)).select("v", F.concat_ws(",", F.transform("docs", lambda x: x.cast("string"))).alias("docs"))


def block_sizes(spark, sf_dir):
    dw = written(orders_corpus(spark, sf_dir), "dw")
    grid = etl.blocks(dw, etl.document_map(dw.select("d").distinct(), PARTS), etl.word_map(etl.term_frequency(dw), PARTS))
    return grid.groupBy("d_part", "w_part").agg(F.count(F.lit(1)).alias("pairs"), F.sum("f").alias("tokens"))


def corpus_stat(spark, sf_dir):
    return etl.term_frequency(orders_corpus(spark, sf_dir)).filter("tf > 0").orderBy(F.desc("tf"), F.desc("v"))


def renumber_word(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"))
    n = part.count()
    return part.select("v", arrays.renumber(F.col("v"), n, 3).alias("w"), arrays.interval_of(F.col("v"), n, 3).alias("part"))


def csr_offsets(spark, sf_dir):
    sizes = orders_corpus(spark, sf_dir).groupBy("v").agg(F.sum("f").alias("n"))
    return ranks.running_sum(sizes, ["v"], F.col("n"), "upto").select("v", "n", (F.col("upto") - F.col("n")).alias("start"))


def theta(spark, sf_dir):
    c = counts.dense_counts(assigned(spark, sf_dir), "d", K)
    n = F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return c.select("d", F.posexplode(F.transform("c", lambda x: F.round((x + F.lit(ALPHA)) / (n + F.lit(ALPHA * K)), 9))).alias("k", "theta"))


def phi(spark, sf_dir):
    z = assigned(spark, sf_dir)
    ck = counts.topic_totals(z, K).select(F.col("c").alias("t")).crossJoin(F.broadcast(z.agg(F.count_distinct("v").alias("nv"))))
    c = counts.dense_counts(z, "v", K).crossJoin(F.broadcast(ck))
    return c.select("v", F.posexplode(F.transform("c", lambda x, i: F.round((x + F.lit(BETA)) / (F.get("t", i) + F.lit(BETA) * F.col("nv")), 12))).alias("k", "phi"))


def topic_topk(spark, sf_dir):
    return metrics.top_words(cwk(spark, sf_dir), ["k"], "c", 20)


def sampler_rows(spark, sf_dir):
    """(d, v, f, p array of K): unnormalised topic weights under the frozen counts."""
    z = assigned(spark, sf_dir)
    ck = counts.topic_totals(z, K).select(F.col("c").alias("t")).crossJoin(F.broadcast(z.agg(F.count_distinct("v").alias("nv"))))
    rows = z.select("d", "v", "f").join(counts.dense_counts(z, "d", K).withColumnRenamed("c", "cd"), "d").join(counts.dense_counts(z, "v", K).withColumnRenamed("c", "cv"), "v").crossJoin(F.broadcast(ck))
    cells = [(F.get("cd", F.lit(t)) + F.lit(ALPHA)) * (F.get("cv", F.lit(t)) + F.lit(BETA)) / (F.get("t", F.lit(t)) + F.lit(BETA) * F.col("nv")) for t in range(K)]
    return rows.select("d", "v", "f", F.array(*cells).alias("p"))


def sampler_probs(spark, sf_dir):
    rows = sampler_rows(spark, sf_dir)
    return rows.select("d", "v", F.posexplode(arrays.let(arrays.total(F.col("p")), lambda s: F.transform("p", lambda x: F.round(x / s, 9)))).alias("k", "p"))


def topic_cdf(spark, sf_dir):
    rows = sampler_rows(spark, sf_dir).withColumn("s", arrays.total(F.col("p")))
    return rows.select("d", "v", F.posexplode(F.transform(arrays.running_sum(F.col("p")), lambda x: F.round(x / F.col("s"), 9))).alias("k", "cdf"))


def gibbs_sweep_fixed_u(spark, sf_dir):
    """Tokens and a checksum by topic of a sweep whose uniform numbers are a fixed function of (d, v, n)."""
    rows = sampler_rows(spark, sf_dir).select("d", "v", "f", arrays.running_sum(F.col("p")).alias("cdf"))
    one = rows.select("d", "v", "cdf", F.explode(F.sequence(F.lit(1).cast("bigint"), "f")).alias("n"))
    u = ((F.col("d") * 7919 + F.col("v") * 104729 + F.col("n") * 1299709 + 17) % 1_000_003) / F.lit(1_000_003.0)
    goal = F.get("cdf", F.lit(K - 1)) * u
    below = sum((F.when(F.get("cdf", F.lit(t)) < goal, 1).otherwise(0) for t in range(K)), F.lit(0))
    return one.select("d", "v", "n", below.cast("bigint").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.sum((F.col("d") * 31 + F.col("v") * 17 + F.col("n")) % 1009).alias("checksum"))


def logsumexp(spark, sf_dir):
    e = tables.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(arrays.logsumexp(F.transform("embedding", lambda x: x.cast("double"))), 9).alias("lse"))


def log_likelihood(spark, sf_dir):
    """Sum over tokens of log sum_k theta phi under the fixed assignment."""
    rows = sampler_rows(spark, sf_dir)
    size = rows.groupBy("d").agg(F.sum("f").alias("l"))
    p = arrays.total(F.col("p")) / (F.col("l") + F.lit(ALPHA * K))
    return rows.join(size, "d").agg(F.round(F.sum(F.col("f") * F.log(p)), 4).alias("ll"), F.sum("f").alias("n"))


def softmax(spark, sf_dir):
    e = tables.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(arrays.softmax(F.transform("embedding", lambda x: x.cast("double")))).alias("i", "p")).withColumn("p", F.round("p", 9))


def lda_fit(spark, sf_dir):
    """Perplexity by iteration of a trained model (random draws: checked by invariants)."""
    model = lda.fit(orders_corpus(spark, sf_dir), K, ALPHA, BETA, iterations=3)
    return spark.createDataFrame(list(enumerate(model.perplexity)), "iteration int, perplexity double")


QUERIES = {f.__name__: f for f in (
    lda_perplexity_init, lda_perplexity_orders, tokens, vocab_tf, doc_length, doc_word_counts, corpus_totals, cdk, cwk, ck_marginal, avg_kd,
    occurrences, libsvm_lines, libsvm_parse, docmap, docs_per_part, wordmap_lpt, inverted_index, block_sizes, corpus_stat, renumber_word,
    csr_offsets, theta, phi, topic_topk, sampler_probs, topic_cdf, gibbs_sweep_fixed_u, log_likelihood, logsumexp, softmax, lda_fit,
)}

TOKENS = r"""tokens as (
  select d, row_number() over (partition by d order by i) - 1 as pos, w from (
    select doc_id as d, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) as w, generate_subscripts(regexp_split_to_array(lower(text), '[^a-z0-9]+'), 1) as i from documents) where w <> ''),
vocab as (select row_number() over (order by w) - 1 as v, w from (select distinct w from tokens))"""
TEXT_DW = TOKENS + ", dw as (select d, v, count(*) as f from tokens join vocab using (w) group by d, v)"
DW = "dw as (select l_orderkey as d, l_partkey as v, sum(l_quantity::bigint)::bigint as f from lineitem group by 1, 2)"
Z = f"""z as (
  select d, v, n, (d*7919 + v*104729 + n*1299709) % {K} as k
  from (select d, v, unnest(range(1, f + 1)) as n from dw)),
cdk as (select d, k, count(*) as c from z group by d, k),
cwk as (select v, k, count(*) as c from z group by v, k),
ck as (select k, count(*) as c from z group by k),
ld as (select d, sum(f)::bigint as l from dw group by d),
s as (select count(distinct v) as nv from dw)"""
PROBS = f"""p as (select g.d, g.v, g.f, g.k, (coalesce(a.c,0)+{ALPHA}::double)*(coalesce(b.c,0)+{BETA}::double)/(g.c+{BETA}::double*s.nv) as p
  from (select dw.*, ck.k, ck.c from dw cross join ck) g left join cdk a on a.d=g.d and a.k=g.k left join cwk b on b.v=g.v and b.k=g.k cross join s)"""
PERPLEXITY = f"""w as (select d, v, any_value(f) as f, sum(p) as p from p group by d, v)
select count(*)::bigint as pairs, sum(f)::bigint as ntok, max(s.nv)::bigint as nv, round(exp(-sum(f*ln(p/(l+{ALPHA}::double*{K})))/sum(f)), 6) as perplexity from w join ld using (d) cross join s"""
DOCMAP = f"docmap as (select d, (d * 2654435761) % {PARTS} as p, row_number() over (partition by (d * 2654435761) % {PARTS} order by d) - 1 as local from (select distinct d from dw))"
LPT = f"""tf as (select v, tf, row_number() over (order by tf desc, v desc) as i from (select v, sum(f)::bigint as tf from dw group by v)),
lpt as (
  with recursive r(i, v, p, loads) as (
    select 0::bigint, null::bigint, null::bigint, [{', '.join(['0'] * PARTS)}]::bigint[]
    union all
    select t.i, t.v, list_position(r.loads, list_min(r.loads)) - 1,
      [{', '.join(f'r.loads[{b + 1}] + case when list_position(r.loads, list_min(r.loads)) = {b + 1} then t.tf else 0 end' for b in range(PARTS))}]
    from r join tf t on t.i = r.i + 1)
  select v, p::bigint as p from r where v is not null),
wordmap as (select v, p, row_number() over (partition by p order by (v * 7919) % 1000003, v) - 1 as local from lpt)"""

ORACLE = {
    "lda_perplexity_init": f"with {TEXT_DW}, {Z}, {PROBS}, {PERPLEXITY}",
    "lda_perplexity_orders": f"with {DW}, {Z}, {PROBS}, {PERPLEXITY}",
    "tokens": f"with {TOKENS} select d, pos::int as pos, w from tokens",
    "vocab_tf": f"with {TOKENS} select v, w, count(*) as tf from tokens join vocab using (w) group by v, w",
    "doc_length": f"with {TOKENS} select d, count(*) as l from tokens group by d",
    "doc_word_counts": f"with {TOKENS} select d, w, count(*) as f from tokens group by d, w",
    "corpus_totals": f"with {DW} select count(distinct d) as n_docs, max(d) as max_doc, count(distinct v) as n_words, sum(f)::bigint as n_tokens, round(sum(f)::double / count(*), 9) as average_count from dw",
    "cdk": f"with {DW}, {Z} select * from cdk",
    "cwk": f"with {DW}, {Z} select * from cwk",
    "ck_marginal": f"with {DW}, {Z} select * from ck",
    "avg_kd": f"with {DW}, {Z} select round(count(*)::double / count(distinct d), 9) as kd from cdk",
    "occurrences": f"with {DW} select d, v, unnest(range(1, f + 1)) as n from dw",
    "libsvm_lines": f"with {DW} select d::varchar || ' ' || string_agg(v::varchar || ':' || f::varchar, ' ' order by v) as line from dw group by d",
    "libsvm_parse": f"with {DW} select * from dw",
    "docmap": f"with {DW}, {DOCMAP} select * from docmap",
    "docs_per_part": f"with {DW}, {DOCMAP} select p, count(*) as n from docmap group by p",
    "wordmap_lpt": f"with {DW}, {LPT} select * from wordmap",
    "inverted_index": f"with {DW} select v, string_agg(d::varchar, ',' order by d) as docs from (select d, v, unnest(range(f)) from dw) group by v",
    "block_sizes": f"with {DW}, {DOCMAP}, {LPT} select a.p as d_part, b.p as w_part, count(*) as pairs, sum(f)::bigint as tokens from dw join docmap a using (d) join wordmap b using (v) group by 1, 2",
    "corpus_stat": f"with {DW} select v, sum(f)::bigint as tf from dw group by v",
    "renumber_word": "with n as (select count(*) as n from part) select p_partkey as v, case when p_partkey < 3 * (n // 3) then ((p_partkey) % 3) * (n // 3) + (p_partkey) // 3 else p_partkey end as w, (p_partkey) // ((n + 2) // 3) as part from part, n",
    "csr_offsets": f"with {DW}, s as (select v, sum(f)::bigint as n from dw group by v) select v, n, (sum(n) over (order by v) - n)::bigint as start from s",
    "theta": f"with {DW}, {Z} select ld.d, ck.k::int as k, round((coalesce(a.c,0)+{ALPHA}::double)/(ld.l+{ALPHA}::double*{K}), 9) as theta from ld cross join ck left join cdk a on a.d=ld.d and a.k=ck.k",
    "phi": f"with {DW}, {Z} select w.v, ck.k::int as k, round((coalesce(b.c,0)+{BETA}::double)/(ck.c+{BETA}::double*s.nv), 12) as phi from (select distinct v from dw) w cross join ck left join cwk b on b.v=w.v and b.k=ck.k cross join s",
    "topic_topk": f"with {DW}, {Z} select v, k, c, row_number() over (partition by k order by c desc, v)::int as rank from cwk qualify rank <= 20",
    "sampler_probs": f"with {DW}, {Z}, {PROBS} select d, v, k::int as k, round(p / sum(p) over (partition by d, v), 9) as p from p",
    "topic_cdf": f"with {DW}, {Z}, {PROBS} select d, v, k::int as k, round(sum(p) over (partition by d, v order by k) / sum(p) over (partition by d, v), 9) as cdf from p",
    "gibbs_sweep_fixed_u": f"""with {DW}, {Z}, {PROBS}, c as (select d, v, k, f, sum(p) over (partition by d, v order by k) as cdf, sum(p) over (partition by d, v order by k rows between unbounded preceding and unbounded following) as tot from p),
a as (select d, v, any_value(f) as f, list(cdf order by k) as cdf, max(cdf) as tot from c group by d, v),
o as (select d, v, cdf, tot, unnest(range(1, f + 1)) as n from a),
t as (select d, v, n, len(list_filter(cdf, lambda x: x < tot * (((d*7919 + v*104729 + n*1299709 + 17) % 1000003)/1000003.0::double))) as k from o)
select k, count(*) as c, sum((d*31 + v*17 + n) % 1009)::bigint as checksum from t group by k""",
    "log_likelihood": f"with {DW}, {Z}, {PROBS}, w as (select d, v, any_value(f) as f, sum(p) as p from p group by d, v) select round(sum(f * ln(p / (l + {ALPHA}::double * {K}))), 4) as ll, sum(f)::bigint as n from w join ld using (d)",
    "logsumexp": "with e as (select vec_id, unnest(embedding)::double as x from embeddings), m as (select vec_id, max(x) as m from e group by vec_id) select vec_id, round(any_value(m) + ln(sum(exp(x - m))), 9) as lse from e join m using (vec_id) group by vec_id",
    "softmax": "with e as (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as x from embeddings), m as (select vec_id, max(x) as m from e group by vec_id) select vec_id, i::int as i, round(exp(x - m) / sum(exp(x - m)) over (partition by vec_id), 9) as p from e join m using (vec_id)",
}
