"""Oracle SQL of the model queries."""

from __future__ import annotations

from skein.plans.lda_queries import ALPHA, DW, K, TOKENS, Z

VEC = f"v as (select vec_id as d, label as y, [x::double for x in embedding][1:{K}] as x from embeddings)"
DOT = " + ".join(f"x[{i + 1}] * {round(0.1 * (i + 1), 1)}::double" for i in range(K))
G = f"g as (select case when y >= 5 then 1.0::double else -1.0::double end as s, y::double as y, {DOT} as g from v)"
HALF = sum(round(0.1 * (i + 1), 1) ** 2 for i in range(K)) / 2
W = [[((l * 7 + i * 3) % 11) / 10 - 0.5 for i in range(K)] for l in range(10)]
SCORES = "[" + ", ".join(" + ".join(f"x[{i + 1}] * ({w}::double)" for i, w in enumerate(row)) for row in W) + "]"
PRED = f"pred as (select d, y, list_position(s, list_max(s)) - 1 as pred from (select d, y, {SCORES} as s from v))"

M = [[((3 * j + k) % 7) / 6 for k in range(K)] for j in range(3)]
MARGIN = ", ".join(
    "(" + " + ".join(f"(((d + {j}) % 5) / 4.0::double) * (case y when 0 then {M[0][k]}::double when 1 then {M[1][k]}::double else {M[2][k]}::double end - {M[j][k]}::double)" for j in range(3)) + ") / l" for k in range(K)
)

LINKS = """pos as (select * from (select o_orderkey as src, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as dst from orders) where dst is not null),
links as (select src, dst, 1 as y from pos union all select src, (src * 31 + 7) % 1000 as dst, 0 as y from pos)"""
ZBAR = f"""cells as (select ld.d, ck.k, coalesce(a.c, 0)::double / ld.l as z from ld cross join ck left join cdk a on a.d=ld.d and a.k=ck.k),
zbar as (select d, list(z order by k) as z from cells group by d)"""
ENDS = "ends as (select l.src, l.dst, l.y, a.z as zs, b.z as zd from links l join zbar a on a.d=l.src join zbar b on b.d=l.dst)"
U = [[round(0.1 * i - 0.07 * j, 6) for j in range(K)] for i in range(K)]
BILINEAR = " + ".join(f"zs[{i + 1}] * (" + " + ".join(f"({U[i][j]}::double) * zd[{j + 1}]" for j in range(K)) + ")" for i in range(K))
SCORED = f"scored as (select src, dst, y, round({BILINEAR}, 9) as score from ends)"

TIME = "t as (select (year(l_shipdate) - 1995)::bigint as ep, l_orderkey as d, l_partkey as v, sum(l_quantity::bigint)::bigint as f from lineitem group by 1, 2, 3)"
CELLS = "cells as (select ep, k, v, ln(1 + c::double) / (k + 1) as phi, c from (select ep, v, sum(f)::bigint as c from t group by ep, v), (select unnest([0, 1]) as k))"
LOGZ = "mx as (select ep, k, max(phi) as m from cells group by ep, k), lz as (select ep, k, any_value(m) + ln(sum(exp(phi - m))) as logz from cells join mx using (ep, k) group by ep, k)"
CHAIN = """ch as (select ep, k, v, phi, c, case when b is null then -phi / 64.0::double else (b - phi) / (0.2::double * 0.2::double) end + coalesce((a - phi) / (0.2::double * 0.2::double), 0) as g
  from (select *, lag(phi) over w as b, lead(phi) over w as a from cells window w as (partition by k, v order by ep)))"""
DRIFT = "ckk as (select ep, k, sum(c)::bigint as ck from cells group by ep, k), dr as (select ep, k, v, phi, 2 * (c - ck * exp(phi - logz)) + g as g from ch join lz using (ep, k) join ckk using (ep, k))"
RATE = 20.0 * 103.0**-0.51
PG = "case when score = 0 then c / 4 else c / (score * 2) * ((exp(score / 2) - exp(-score / 2)) / (exp(score / 2) + exp(-score / 2))) end"
X = "((l_quantity - 25) / 10)"
T = f"(1.0::double / (1.0::double + 0.2316419::double * abs({X})))"
POLY = f"{T} * (0.319381530::double + {T} * (-0.356563782::double + {T} * (1.781477937::double + {T} * (-1.821255978::double + {T} * 1.330274429::double))))"
TAIL = f"exp(-{X} * {X} / 2) / sqrt(2.0::double * pi()) * {POLY}"

ORACLE = {
    "ovr_labels": f"with {VEC} select d, label, case when y = label then 1 else -1 end as sign from v cross join (select distinct y as label from v)",
    "class_groups": f"with {VEC} select y, count(*) as n, min(d) as first, row_number() over (order by min(d)) as place from v group by y",
    "svm_features": f"with {DW}, {Z} select ld.d, ck.k::int as k, round((coalesce(a.c,0)+{ALPHA}::double)/(ld.l+{ALPHA}::double*{K}), 9) as x from ld cross join ck left join cdk a on a.d=ld.d and a.k=ck.k",
    "hinge_objective": f"with {VEC}, {G} select round({HALF}::double + sum(greatest(0.0, 1 - s * g)), 6) as objective from g",
    "sq_hinge_objective": f"with {VEC}, {G} select round({HALF}::double + sum(pow(greatest(0.0, 1 - s * g), 2)), 6) as objective from g",
    "logistic_objective": f"with {VEC}, {G} select round({HALF}::double + sum(ln(1 + exp(-s * g))), 6) as objective from g",
    "svr_objective": f"with {VEC}, {G} select round({HALF}::double + sum(pow(greatest(0.0, abs(g - y) - 0.1::double), 2)), 6) as objective from g",
    "svm_argmax": f"with {VEC}, {PRED} select d, y, pred::int as pred from pred",
    "svm_accuracy": f"with {VEC}, {PRED} select count(*) as n, round(avg((y = pred)::int::double), 9) as accuracy from pred",
    "kfold": "select d, (rn - 1) * 5 // n as fold from (select vec_id as d, row_number() over (order by (vec_id * 7919) % 1000003, vec_id) as rn, count(*) over () as n from embeddings)",
    "margin_term": f"with {DW}, {Z}, m as (select d, [{MARGIN}] as m from (select d, d % 3 as y, l::double as l from ld)) select d, i::int - 1 as k, round(m[i], 9) as m from m, (select unnest(range(1, {K + 1})) as i)",
    "link_union": f"with {LINKS} select y, count(*) as n, sum(src)::bigint as src_sum, sum(dst)::bigint as dst_sum from links group by y",
    "link_remap": f"with {LINKS}, m as (select o_orderkey as d, row_number() over (order by o_orderkey) - 1 as local from orders) select a.local as s, b.local as t, y from links join m a on a.d = src join m b on b.d = dst",
    "reverse_adjacency": f"with {LINKS} select d, reached, count(*) as n, sum(other)::bigint as other_sum from (select src as d, dst as other, 0 as reached from links union all select dst, src, 1 from links) group by d, reached",
    "edge_kappa": f"with {LINKS} select y, case when y = 1 then 5.0::double else -0.5::double end as kappa, count(*) as n from links group by y",
    "zbar": f"with {DW}, {Z}, {ZBAR} select d, k::int as k, round(z, 9) as z from cells",
    "bilinear_score": f"with {DW}, {Z}, {ZBAR}, {LINKS}, {ENDS}, {SCORED} select * from scored",
    "gram_matrix": f"""with {DW}, {Z}, {ZBAR}, {LINKS}, {ENDS},
e as (select row_number() over () as id, (1.0::double + y) as lam, case when y = 1 then 5.0::double else -0.5::double end as kappa, zs, zd from ends),
x as (select id, lam, kappa, a.i * {K} + b.j as u, zs[a.i + 1] * zd[b.j + 1] as z from e, (select unnest(range({K})) as i) a, (select unnest(range({K})) as j) b),
bb as (select u, sum(kappa * z) as b from x group by u)
select p.u::int as i, p.w::int as j, round(p.s + case when p.u = p.w then 100.0::double else 0 end, 6) as precision, round(bb.b, 6) as b
from (select x.u, y.u as w, sum(x.lam * x.z * y.z) as s from x join x y using (id) group by 1, 2) p join bb on bb.u = p.u""",
    "auc_ties": """with r as (select floor(n_chars / 100) as s, quality as y from documents join labels using (doc_id)),
k as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as r from r),
c as (select sum(r) filter (where y = 1) as s, count(*) filter (where y = 1) as p, count(*) filter (where y = 0) as q from k)
select round((s - p::double * (p::double + 1) / 2) / (p::double * q), 9) as auc, p as positives, q as negatives from c""",
    "link_accuracy": f"with {DW}, {Z}, {ZBAR}, {LINKS}, {ENDS}, {SCORED} select count(*) as n, round(avg(((score >= 0)::int = y)::int::double), 9) as accuracy from scored",
    "pg_mean": f"with {DW}, {Z}, {ZBAR}, {LINKS}, {ENDS}, {SCORED} select src, dst, y, round({PG}, 9) as m from (select *, case when y = 1 then 10.0::double else 1.0::double end as c from scored)",
    "normal_cdf": f"select l_orderkey, l_linenumber, round(case when {X} >= 0 then 1.0::double - {TAIL} else {TAIL} end, 9) as p from lineitem",
    "epoch_assign": f"with {TIME} select ep, count(distinct d) as docs, sum(f)::bigint as tokens from t group by ep",
    "epoch_range_partition": f"""with recursive {TIME},
l as (select ep, sum(f)::bigint as load, row_number() over (order by ep) as i from t group by ep),
n as (select max(i) as n from l),
cuts as (select a.i as a, b.i as b from l a, l b, n where a.i <= b.i and b.i <= n.n),
best as (select min(m) as m from (select greatest(
   (select sum(load) from l where i <= a), (select coalesce(sum(load), 0) from l where i > a and i <= b), (select coalesce(sum(load), 0) from l where i > b)) as m from cuts)),
r(i, part, held) as (
  select 1::bigint, 0::bigint, (select load from l where i = 1)::hugeint
  union all
  select r.i + 1, case when r.held + l.load > (select m from best) then r.part + 1 else r.part end, case when r.held + l.load > (select m from best) then l.load else r.held + l.load end
  from r join l on l.i = r.i + 1)
select ep, load, part from l join r using (i)""",
    "train_test_split": f"with {TIME} select ep, d, case when row_number() over (partition by ep order by d) <= floor(count(*) over (partition by ep) * 0.8::double) then 'tr' else 'te' end as split from (select distinct ep, d from t)",
    "observed_heldout": f"with {TOKENS} select d, pos < n // 2 as seen, count(*) as n from (select d, pos, count(*) over (partition by d) as n from tokens) group by 1, 2",
    "minibatch": f"with {TIME} select ep, d from (select distinct ep, d from t) qualify row_number() over (partition by ep order by (d * 104729 + (1 * 7919 + 3 * 1299709)) % 1000003, d) <= 60",
    "month_names": "select strftime(unnest(generate_series(date '2012-10-01', date '2015-02-01', interval 1 month)), '%Y-%m') as month",
    "phi_log_normalizer": f"with {TIME}, {CELLS}, {LOGZ} select ep, k, round(logz, 9) as logz from lz",
    "phi_chain_prior": f"with {TIME}, {CELLS}, {CHAIN} select ep, k, v, round(g, 6) as g from ch",
    "phi_sgld_drift": f"with {TIME}, {CELLS}, {LOGZ}, {CHAIN}, {DRIFT} select ep, k, v, round(phi + {RATE / 2}::double * g, 5) as phi from dr",
    "psgld_step": f"with {TIME}, {CELLS}, {LOGZ}, {CHAIN}, {DRIFT} select ep, k, v, round(phi + {RATE / 2}::double * g / (0.0001::double + sqrt(0.95::double * 0.5 + 0.05::double * g * g)), 6) as phi from dr",
    "eta_sgld_drift": f"""with {VEC}, r as (select d, i - 1 as i, x[i] as x, list_max(x) as m, ((d + i - 1) % 7)::double as c from v, (select unnest(range(1, {K + 1})) as i)),
s as (select *, exp(x - m) / sum(exp(x - m)) over (partition by d) as p, sum(c) over (partition by d) as n from r)
select d, i::int as k, round(case when i = {K - 1} then 0 else (i * 0.1::double - x) / 36 + c - n * p end, 8) as g from s""",
    "alpha_posterior_mean_var": f"""with {TIME}, r as (select ep, count(distinct d) as n, sum(f)::bigint as s from t group by ep),
w as (select *, lag(ep) over (order by ep) as b, lead(ep) over (order by ep) as a from r),
p as (select ep, n * {1 / 36.0}::double + case when b is null then {1 / 0.01}::double else {1 / 0.36}::double end + case when a is null then 0 else {1 / 0.36}::double end as precision,
  s * {1 / 36.0}::double / 1000 + coalesce((b + 1) * 0.1::double * {1 / 0.36}::double, 0) + coalesce((a + 1) * 0.1::double * {1 / 0.36}::double, 0) as q from w)
select ep, round(q / precision, 9) as mean, round(1 / precision, 12) as var from p""",
    "heldout_perplexity": f"""with {TIME}, {CELLS}, {LOGZ}, ph as (select ep, v, k, exp(phi - logz) as p from cells join lz using (ep, k)),
q as (select t.ep, t.d, t.v, any_value(f) as f, sum(p * case when k = 0 then (t.d % 9 + 1) / 10.0::double else 1 - (t.d % 9 + 1) / 10.0::double end) as p from t join ph using (ep, v) group by t.ep, t.d, t.v)
select sum(f)::bigint as tokens, round(exp(-sum(f * ln(p)) / sum(f)), 6) as perplexity from q""",
    "dtm_topk": f"with {TIME}, {CELLS} select ep, k, v, phi, rank from (select ep, k, v, round(phi, 9) as phi, row_number() over (partition by ep, k order by round(phi, 9) desc, v)::int as rank from cells) where rank <= 10",
    "sorted_merge": "select o_custkey, o_orderkey from orders",
    "order_by_packed_key": "select (l_partkey << 32) | l_orderkey as key, l_linenumber from lineitem",
    "outer_product": f"with {VEC} select d, (i * 3 + j)::int as i, round(x[i + 1] * x[j + 4], 9) as p from v, (select unnest(range(3)) as i) a, (select unnest(range(3)) as j) b",
}
