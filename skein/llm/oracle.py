"""Oracle SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

from skein.llm import quality_rules as rules
from skein.llm.ngram_lm import BACKOFF, MIN_COUNT

WORDS = r"'[^\x20\x09-\x0D]+'"
SPACE = r"'[\x20\x09-\x0D]'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT_DEDUP = rf"""with n as (
  select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), {SPACE}, '', 'g') as norm from documents),
k as (select doc_id, norm, sha256(norm) as text_sha256, length(t) as len from n),
r as (select doc_id, text_sha256, norm,
  row_number() over (partition by norm order by len desc, doc_id nulls last) as rn,
  first_value(doc_id) over (partition by norm order by len desc, doc_id nulls last) as keep_id,
  count(*) over (partition by norm) as group_size from k)
select doc_id, keep_id, group_size, rn = 1 as kept, text_sha256 from r"""

MIXING = rf"""with d as (
  select doc_id, source, md5(coalesce(doc_id::varchar, '')) as key,
    length(regexp_replace(regexp_replace(coalesce(text, ''), {WORDS}, 'w', 'g'), {SPACE}, '', 'g'))::bigint as size from documents),
s0 as (select coalesce('0' || source, '1') as skey, sum(size)::bigint as source_size from d group by 1),
s1 as (select *, (row_number() over (order by skey) - 1) % 3 + 1 as w from s0),
s2 as (select *, source_size * 3 as cap, row_number() over (order by source_size * 3 * (6 // w), skey) as place,
  sum(source_size) over () - coalesce(sum(source_size * 3) over (order by source_size * 3 * (6 // w), skey rows between unbounded preceding and 1 preceding), 0) as lft,
  sum(w) over () - coalesce(sum(w) over (order by source_size * 3 * (6 // w), skey rows between unbounded preceding and 1 preceding), 0) as lw from s1),
cut as (select place as cp, lft as cl, lw as cw from s2 where cap * lw >= lft * w order by place limit 1),
s3 as (select skey, source_size, case when place < cp then cap::double else (cl * w)::double / cw::double end as target from s2, cut),
p as (select d.*, s3.source_size, s3.target, sum(size) over (partition by d.skey order by key, doc_id nulls last, size rows unbounded preceding) - size as start
  from (select *, coalesce('0' || source, '1') as skey from d) d join s3 using (skey))
select doc_id, size, source_size, target,
  (least(greatest(floor(target)::bigint - start, 0), size) + least(greatest(floor(target)::bigint - source_size - start, 0), size)
   + least(greatest(floor(target)::bigint - 2 * source_size - start, 0), size))::bigint as taken from p"""

NGRAM_LM = rf"""with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORDS}) as l from documents),
w as (select rid, unnest(l) as w, generate_subscripts(l, 1) as i from d),
g as (select rid, i, w, lag(w, 1) over p as b, lag(w, 2) over p as a from w window p as (partition by rid order by i)),
n as (select count(*) as n from w),
c1 as (select w, count(*) as c from w group by w),
c2 as (select b, w, count(*) as c from g where b is not null group by b, w),
c3 as (select a, b, w, count(*) as c from g where a is not null group by a, b, w),
s as (select g.rid, case
    when c3.c >= {MIN_COUNT} then log10(c3.c::double / x2.c)
    when c2.c >= {MIN_COUNT} then log10(c2.c::double / x1.c) + case when g.a is null then 0 else log10({BACKOFF}::double) end
    else log10(c1.c::double / n.n) + (least(g.i, 3) - 1) * log10({BACKOFF}::double) end as s
  from g join n on true join c1 on c1.w = g.w left join c1 x1 on x1.w = g.b left join c2 on c2.b = g.b and c2.w = g.w
  left join c2 x2 on x2.b = g.a and x2.w = g.b left join c3 on c3.a = g.a and c3.b = g.b and c3.w = g.w),
t as (select rid, sum(s) as s from s group by rid)
select doc_id, len(l)::bigint as n_words, round(coalesce(s, 0), 6) as log10_score, case when len(l) > 0 then round(s / len(l), 8) end as log10_per_word from d left join t using (rid)"""


def _quoted(chars: str) -> str:
    return "'" + chars.replace("'", "''") + "'"


def _count(chars: str) -> str:
    return f"(length(t) - length(translate(t, {_quoted(chars)}, '')))"


def _divergence(cells: list[tuple[str, float]]) -> str:
    terms = []
    for x, y in cells:
        m = f"(({x} + {y}::double) / 2)"
        terms.append(f"case when {x} > 0 then {x} * log2({x} / {m}) else 0 end" + (f" + {y}::double * log2({y}::double / {m})" if y > 0 else ""))
    return "((" + " + ".join(terms) + ") / 2)"


def quality_rules_sql() -> str:
    """Base counts and verdict of the quality rules."""
    classes = {
        "lower": r"(length(t) - length(regexp_replace(t, '\p{Ll}+', '', 'g')))",
        "upper": r"(length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')))",
        "digit": _count(rules.DIGITS),
        "space": f"(length(t) - length(regexp_replace(t, {SPACE}, '', 'g')))",
        "mark": _count(rules.MARKS),
        "symbol": f"({_count(rules.SYMBOLS)} + {_count(rules.MORE_SYMBOLS)})",
    }
    vocab = sorted({w for ref in rules.WORD_REFERENCES.values() for w in ref})
    name = {w: f"w{i}" for i, w in enumerate(vocab)}
    shares = ", ".join(f"{c} / greatest(length(t)::double, 1) as s_{k}" for k, c in classes.items())
    counts = ", ".join(f"len(list_filter(q, lambda x: x = '{w}')) / greatest(len(l)::double, 1) as {name[w]}" for w in vocab)
    rest = "greatest(1.0::double - (" + " + ".join(f"s_{k}" for k in classes) + "), 0.0::double)"
    class_div = ", ".join(_divergence([*((f"s_{k}", y) for k, y in zip(classes, ref)), ("s_rest", ref[-1])]) for ref in rules.CLASS_REFERENCES.values())

    def word_div(ref: dict[str, float]) -> str:
        other = "greatest(1.0::double - (" + " + ".join(name[w] for w in ref) + "), 0.0::double)"
        return _divergence([*((name[w], y) for w, y in ref.items()), (other, 1 - sum(ref.values()))])

    word = ", ".join(word_div(r) for r in rules.WORD_REFERENCES.values())
    return rf"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {WORDS}) as l from documents),
win as (select rid, i, array_to_string(l[i:i + {rules.WINDOW - 1}], ' ') as key from (select rid, l, unnest(range(1, greatest(len(l) - {rules.WINDOW - 2}, 1))) as i from d)),
rep as (select rid, i from win qualify count(*) over (partition by rid, key) >= 2),
cov as (select rid, count(distinct i + k) as n from rep, (select unnest(range({rules.WINDOW})) as k) group by rid),
b as (select rid, doc_id, t, l, len(l)::bigint as n_words, length(regexp_replace(t, {SPACE}, '', 'g'))::bigint as word_chars, {_count(rules.SYMBOLS)}::bigint as n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORDS})) as lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
  list_transform(l, lambda x: lower(trim(x, {_quoted(rules.MARKS)}))) as q, {shares} from d left join cov using (rid)),
c as (select *, {rest} as s_rest, {counts} from b),
v as (select *, n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words as base_failed,
  case when length(t) >= {rules.MIN_CLASS_CHARS} then least({class_div}) else 0 end as class_div,
  case when n_words >= {rules.MIN_HISTOGRAM_WORDS} then least({word}) else 0 end as word_div from c)
select doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words, base_failed,
  not base_failed and class_div <= {rules.MAX_CLASS_DIVERGENCE}::double and word_div <= {rules.MAX_WORD_DIVERGENCE}::double as kept from v"""
