import hashlib
import random
import re
import time
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import bpe, components, exact_dedup, html_text, language_id, mixing, near_dup, ngram_lm, pii, quality_model, quality_rules
from skein.llm import queries
from skein.llm.queries import fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


# -- exact dedup


def brute_exact(docs):
    groups = defaultdict(list)
    for i, r in enumerate(docs):
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            out.append((docs[m[3]]["doc_id"], docs[best[3]]["doc_id"], len(members), m is best or m == best, hashlib.sha256(norm.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_dedup(messy, parts):
    got = exact_dedup.exact_dedup(messy.repartition(parts), fan_in=2)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(got)) == brute_exact(rows(messy))


def test_exact_dedup_keeps_columns_and_empty(messy, empty):
    kept = exact_dedup.kept_documents(messy)
    assert kept.columns == messy.columns
    assert kept.count() == sum(n for r, n in brute_exact(rows(messy)).items() if r[3])
    assert exact_dedup.exact_dedup(empty).count() == 0


# -- mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing(messy, empty):
    got = rows(mixing.mix(messy))
    sizes = Counter()
    for r in rows(messy):
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    target = brute_targets(sizes)
    assert len(got) == messy.count()
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1
    assert got == rows(mixing.mix(messy))
    places = [r["position"] for r in got if r["position"] is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)
    assert rows(mixing.mix(empty)) == []
    mixed = mixing.mixed_documents(messy)
    assert mixed.columns == messy.columns and mixed.count() == sum(r["passes"] for r in got)


def test_capped_targets(spark):
    docs = spark.createDataFrame([(1, "a " * 1000, "a"), (2, "b", "b"), (3, "c c", "c")], "doc_id bigint, text string, source string")
    by = {r["source"]: r["target"] for r in rows(mixing.mix(docs))}
    assert by == {"a": 994.0, "b": 3.0, "c": 6.0}


def test_inverse_schedule(spark):
    for knots in mixing.SCHEDULES:
        got = [r[0] for r in spark.range(0, 11).select(mixing.inverse(F.col("id") / 10.0, knots)).collect()]
        area = lambda t: sum((min(t, b[0]) - a[0]) * (a[1] + a[1] + (b[1] - a[1]) * (min(t, b[0]) - a[0]) / (b[0] - a[0])) / 2 for a, b in zip(knots, knots[1:]) if t > a[0])  # noqa: B023, E731
        assert [area(t) for t in got] == pytest.approx([k / 10 for k in range(11)], abs=1e-9)


# -- quality rules


def brute_rules(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(wins).items() if n > 1}
    hit = {j for i, w in enumerate(wins) if w in twice for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_quality_rules(messy, empty, spark, sf_dir):
    for docs in (messy, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want = Counter((r["doc_id"], *brute_rules(r["text"] or "")) for r in rows(docs))
        got = rows(quality_rules.quality_rules(docs))
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.quality_rules(empty).count() == 0
    kept = quality_rules.kept_documents(messy)
    assert kept.columns == messy.columns


def test_rules_keep_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.quality_rules(docs).join(labels, "doc_id")
    clean = got.filter("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = got.filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert clean > 0.99 and bad < 0.1


# -- near duplicates


def brute_near(docs):
    def shingles(text):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))

    sets = [shingles(r["text"]) for r in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(docs):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return Counter((r["doc_id"], len(sets[i]), least.get(find(i)) if sets[i] else r["doc_id"]) for i, r in enumerate(docs))


def result(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(df))


def test_near_duplicates(messy, empty):
    assert result(near_dup.near_duplicates(messy)) == brute_near(rows(messy))
    assert near_dup.near_duplicates(empty).count() == 0
    assert near_dup.kept_documents(messy).columns == messy.columns


def test_near_duplicates_keep_one_row_of_each_class(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    docs = [(1, text(1)), (1, text(2)), (2, text(1) + " more"), (3, text(3)), (3, text(3)), (3, text(1) + " less"), (3, "")]
    docs += [(None, text(4)), (None, text(4) + " more"), (None, text(3) + " more"), (None, text(5)), (None, None), (4, text(6))]
    kept = near_dup.kept_documents(spark.createDataFrame(docs, "doc_id bigint, text string"))
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    fourth = [t for d, t in got if t and t.startswith("t4")]
    assert len(fourth) == 1
    want = [(1, text(1)), (1, text(2)), (3, text(3)), (3, ""), (None, fourth[0]), (None, text(5)), (None, None), (4, text(6))]
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("hot", [50, 2])
def test_near_duplicates_with_frequent_shingles(spark, monkeypatch, hot):
    import random

    rng = random.Random(hot)
    words = [f"v{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    docs = []
    for k in range(160):
        body = list(passage)
        for _ in range(k % 9):
            body[rng.randrange(len(body))] = rng.choice(words)
        docs.append((k, " ".join(body + [rng.choice(words) for _ in range((k * 7) % 30)])))
    monkeypatch.setattr(near_dup, "HOT", hot)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert result(near_dup.near_duplicates(df)) == brute_near([{"doc_id": d, "text": t} for d, t in docs])


def test_near_duplicates_of_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert result(near_dup.near_duplicates(docs)) == brute_near(rows(docs))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (5, 5)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}


# -- BPE


def test_bpe_equals_library(messy, empty, spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (messy, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want = Counter()
        for r in rows(docs):
            ids = ref.encode(r["text"] or "", add_special_tokens=False).ids
            want[r["doc_id"], struct.pack(f"<{len(ids)}I", *ids), ref.decode(ids, skip_special_tokens=False)] += 1
        assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in rows(bpe.encode_and_decode(docs))) == want
    assert bpe.encode_and_decode(empty).count() == 0


def test_bpe_query_derives_its_digests(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r["text"] or "" for r in rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
    for r in rows(queries.op2_bpe(spark, sf_dir)):
        ids = ref.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_random_texts_and_forgetting(monkeypatch):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ref, own = Tokenizer.from_file(path), bpe.Bpe(path)
    monkeypatch.setattr(bpe, "MAX_WORDS", 40)
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    rng = random.Random(2)
    parts = list("ab <>|'sS\n\t\r\x0b\x1c\x85\xa0é漢🎉129.,!​﻿") + ["<|endoftext|>", "'ll", " the", "aaaa", " inter"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    for lo in range(0, 400, 50):
        for text, packed in zip(texts[lo : lo + 50], own.encode_all(texts[lo : lo + 50])):
            ids = ref.encode(text, add_special_tokens=False).ids
            assert list(memoryview(packed).cast("I")) == ids
            assert own.decode(packed) == ref.decode(ids, skip_special_tokens=False)


# -- HTML


def test_html_blocks():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><p>Site of the name</p></header>
    <nav><ul><li><a href="/">Home</a></ul></nav><div id="cookie-notice"><p>We use cookies and the like for you and all of us.</div>
    <main><article><h1>Head &amp; line</h1><p>The  first&nbsp;paragraph of the text is here and it is long enough to be read.
    <p>Short.<aside>Also of interest: the other page</aside><p>The second <b>bold</b> one with the usual words of a text and so on.
    <script>var a = "<p>no</p>";</script></article><section class="comments"><p>I like the text and the way it is told to us all.</p></section></main>
    <form><p>Sign up for the letter</p><input></form><footer>&copy; all of it</footer></body></html>"""
    assert html_text.main_text(page).split("\n") == [
        "Head & line",
        "The first paragraph of the text is here and it is long enough to be read.",
        "Short.",
        "The second bold one with the usual words of a text and so on.",
    ]
    plain = "<div>menu</div><p>" + "The text of the page is here and it is told to all of us in the words of it. " * 4 + "</p><p>Ok.</p><p>" + "And that is the end of it for all of us who read to the end of the page. " * 4
    assert html_text.main_text(plain).count("\n") == 2
    for broken in ("", "<", "<p", "<!-- x", "a <b>", "</p></p>", "<p>" * 1000, "&am"):
        assert isinstance(html_text.main_text(broken), str)


def test_html_of_table(spark, sf_dir):
    pages, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "documents"))
    texts = {r["doc_id"]: r["text"] for r in rows(docs)}
    for r in rows(html_text.extract(pages).filter("page_id < 60")):
        doc = texts.get(int(re.search(r"/(\d+)", r["url"].split("//")[1])[1]))
        if doc is not None:
            lines = [" ".join(x.split()) for x in doc.split("\n")]
            assert r["text"].split("\n")[1:] == [x for x in lines if x]
    null = spark.createDataFrame([(1, None, None, "z")], "page_id bigint, url string, html string, text string")
    assert html_text.extract(null.limit(0)).count() == 0
    assert rows(html_text.extract(null)) == [{"page_id": 1, "url": None, "text": ""}]


def brute_labels(blocks):
    """The two passes in a plain form: features of a block alone, then the nearest decided block of each side."""
    first = []
    for b in blocks:
        words = re.findall(r"[^\W\d_]+", b.text.lower())
        density, size = sum(w in html_text.STOP_WORDS for w in words) / max(1, len(words)), len(b.text)
        if b.boiler or b.linked > 0.4 * size:
            first.append("bad")
        elif size < 70:
            first.append("short")
        elif density >= 0.25 and size >= 200 or density >= 0.10 and (b.main or size >= 200):
            first.append("good")
        else:
            first.append("near" if density >= 0.10 or b.main else "bad")
    out = []
    for i, b in enumerate(blocks):
        if first[i] in ("good", "bad"):
            out.append(first[i])
            continue
        sides = [next((k for k in span if first[k] in ("good", "bad")), None) for span in (range(i - 1, -1, -1), range(i + 1, len(blocks)))]
        seen = [("bad", -1) if k is None else (first[k], blocks[k].section) for k in sides if not b.main or k is not None and blocks[k].main and not blocks[k].boiler]
        labels = {label for label, _ in seen}
        same = {label for label, section in seen if section == b.section}
        if not seen:
            out.append("good")
        elif len(labels) == 1:
            out.append(labels.pop())
        elif b.heading and sides[1] is not None:
            out.append(first[sides[1]])
        elif len(same) == 1:
            out.append(same.pop())
        else:
            out.append("good" if first[i] == "near" or b.main else "bad")
    return out


def test_html_passes_equal_plain_ones():
    rng = random.Random(9)
    for _ in range(400):
        blocks = []
        for _ in range(rng.randint(0, 12)):
            text = " ".join(rng.choice(["the", "of", "and", "stone", "river", "walks"]) if rng.random() < 0.7 else "zyx" for _ in range(rng.choice([2, 8, 20, 60])))
            blocks.append(html_text.Block(text, rng.choice([0, 0, len(text)]), rng.random() < 0.2, rng.random() < 0.1, rng.randint(0, 2), rng.random() < 0.3))
        want = brute_labels(blocks)
        for b in blocks:
            b.label = html_text.first_pass(b)
        html_text.second_pass(blocks)
        assert [b.label for b in blocks] == want


def test_html_without_declared_main_part():
    prose = "It was on the day that she came to the house and all of them were there with the others. " * 3
    links = "".join(f'<a href="/{k}">Topic number {k}</a> ' for k in range(20))
    page = f"<body><div>{links}</div><div><h2>A line</h2><p>{prose}</p><p>Short one.</p><p>{prose}</p></div><div>{links}</div><div>Zyx qwv trk plm vbn krt wsx edc rfv tgb yhn ujm ikl opq wert zuio asdf</div></body>"
    assert html_text.main_text(page).split("\n") == ["A line", prose.strip(), "Short one.", prose.strip()]
    # Links inside a declared main part are boilerplate there too.
    assert html_text.main_text(f"<article><p>{prose}</p><p>{links}</p></article>") == prose.strip()


def test_html_broken_markup_is_read_in_linear_time():
    prose = "The text of the page is here and it is told to all of us who read it."
    for tag in ("<svg/>", "<math />", "<svg><path d='M0'/></svg>", "<p title='x>"):
        assert prose in html_text.main_text(f"<article>{tag}<p>{prose}</p></article>"), tag
    for hostile in ('<a "' * 200_000 + '"', "<div>" * 80_000 + "</p></b>" * 80_000, "<svg>" * 200_000, "<div><h1>" * 50_000 + "x</h1></div>" * 50_000, "<!--" * 200_000):
        began = time.time()
        html_text.main_text(hostile)
        assert time.time() - began < 10


# -- language model


def brute_lm(texts):
    counts, docs = Counter(), []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        docs.append(w)
        for n in (1, 2, 3):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(map(len, docs))
    from math import log10

    out = []
    for w in docs:
        s = 0.0
        for i in range(len(w)):
            for n in range(min(3, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1 or counts[g] >= 2:
                    s += log10(counts[g] / (counts[g[:-1]] if n > 1 else total)) + (min(3, i + 1) - n) * log10(0.4)
                    break
        out.append(s)
    return out


def test_ngram_lm(messy, empty):
    docs = rows(messy)
    want = brute_lm([r["text"] for r in docs])
    got = rows(ngram_lm.score_documents(messy))
    key = lambda d, n, s: (d is None, d or 0, n, round(s, 6))
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted(key(r["doc_id"], r["n_words"], r["log10_score"]) for r in got) == sorted(key(r["doc_id"], size(r["text"]), s) for r, s in zip(docs, want))
    assert ngram_lm.score_documents(empty).count() == 0


# -- classifiers


def test_quality_model(spark, messy, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.score_quality(docs, labels, fold(5, 0)).join(labels, "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
    odd = rows(quality_model.score_quality(messy, labels, fold(5, 0)))
    assert len(odd) == messy.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_model.score_quality(empty, labels, fold(5, 0)).count() == 0
    assert {r["score"] for r in rows(quality_model.score_quality(messy, labels.limit(0), fold(5, 0)))} == {0.5}


def test_quality_scores_equal_a_plain_forward_pass(spark):
    import math

    import numpy as np
    import pyarrow as pa

    texts = ["", "one", "The cat and the dog. " * 40, "buy now!!! " * 90, "é漢 #1 * x\ny " * 30]
    rng = np.random.default_rng(2)
    f, h, g = quality_model.N_FEATURES, 3, 2
    p = {"W": rng.normal(size=(f, h)), "b": rng.normal(size=h), "V": rng.normal(size=(h, g)), "U": rng.normal(size=(h, g)), "w": rng.normal(size=g), "c": rng.normal(size=h), "d": rng.normal()}
    model = quality_model.Model(np.zeros(f), np.ones(f), p)
    x, first = quality_model.encode(pa.array(texts))
    got = model.forward(x, first)
    for i in range(len(texts)):
        # Passages of one text are those of the text alone.
        alone, _ = quality_model.encode(pa.array([texts[i]]))
        assert np.allclose(alone[:, : quality_model.N_CLASSES], x[first[i] : first[i + 1], : quality_model.N_CLASSES])
        codes = [[math.tanh(sum(v * p["W"][k, j] for k, v in enumerate(row)) + p["b"][j]) for j in range(h)] for row in x[first[i] : first[i + 1]]]
        gate = lambda c, j: math.tanh(sum(c[k] * p["V"][k, j] for k in range(h))) / (1 + math.exp(-sum(c[k] * p["U"][k, j] for k in range(h))))
        raw = [math.exp(sum(gate(c, j) * p["w"][j] for j in range(g))) for c in codes]
        z = [sum(a * c[j] for a, c in zip(raw, codes)) / sum(raw) for j in range(h)]
        assert model.score(x, first)[i] == pytest.approx(1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"])) + p["d"]))))
    assert got


def test_attention_sums_to_one_and_learns():
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 9, 300)
    first = np.concatenate([[0], np.cumsum(sizes)])
    x = rng.standard_normal((first[-1], quality_model.N_FEATURES))
    y = rng.integers(0, 2, 300).astype(float)
    for i in np.flatnonzero(y == 0):
        x[first[i] + rng.integers(sizes[i]), 0] += 6
    model = quality_model.fit(x, first, y)
    out = model.forward((x - model.mean) / model.scale, first)
    assert np.allclose(np.add.reduceat(out["a"], first[:-1]), 1)
    assert ((out["y"] > 0.5) == y).mean() > 0.9


def test_language_id(spark, messy, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs, fold(4, 2)).join(docs, "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95
    odd = {r["doc_id"]: r for r in rows(language_id.identify(messy, fold(4, 2)))}
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[2]["lang_pred"] == "und" and odd[0]["score"] == 0
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "fr", "und") for r in odd.values())
    assert language_id.identify(empty, fold(4, 2)).count() == 0


def test_language_scores_equal_per_text(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    logs = rng.standard_normal((language_id.BUCKETS + 1, 3)).astype(np.float32)
    logs[-1] = 0
    texts = ["", "a", "ab", "abc", "Der Hund läuft", "x" * 100, "the cat"]
    whole = np.array([sum((logs[language_id.buckets_of(np.frombuffer(t.lower().encode("utf-32-le"), np.uint32), o)].sum(axis=0) for o in language_id.ORDERS), np.zeros(3)) for t in texts])
    assert np.allclose(language_id.score_texts(texts, logs), whole, atol=1e-3)


def test_language_of_texts_longer_than_a_block(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(8)
    logs = rng.standard_normal((language_id.BUCKETS + 1, 2)).astype(np.float32)
    logs[-1] = 0
    texts = ["", "ab", *("".join(rng.choice(list("abcdeé ")) for _ in range(n)) for n in (9, 10, 11, 12, 13, 25, 50, 99))]
    plain = lambda t, o: logs[language_id.buckets_of(np.frombuffer(t.lower().encode("utf-32-le"), np.uint32), o)].sum(axis=0)
    want = np.array([sum((plain(t, o) for o in language_id.ORDERS), np.zeros(2)) for t in texts])
    monkeypatch.setattr(language_id, "BLOCK_CHARS", 10)
    assert np.allclose(language_id.score_texts(texts, logs), want, atol=1e-3)


def test_language_of_a_small_table_equals_plain_bayes(spark):
    import math

    docs = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("the end", "en"), ("und das ende", "de"), ("the dog", "en")] * 3)]
    got = {r["doc_id"]: r for r in rows(language_id.identify(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), fold(4, 2)))}
    grams = lambda t: [(o, t[i : i + o]) for o in language_id.ORDERS for i in range(len(t) - o + 1)]
    counts = {lang: Counter(g for k, t, x in docs if x == lang and not got[k]["held_out"] for g in grams(t)) for lang in ("de", "en")}
    mass = {lang: language_id.SMOOTHING * language_id.BUCKETS + sum(c.values()) for lang, c in counts.items()}
    for k, t, _ in docs:
        logs = {lang: sum(math.log((counts[lang][g] + language_id.SMOOTHING) / mass[lang]) for g in grams(t)) for lang in counts}
        best = max(sorted(logs), key=logs.get)
        assert got[k]["lang_pred"] == best and got[k]["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-4)


# -- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda m: (m[1], pii.KINDS.index(m[0])))


def test_pii_random_texts():
    import random

    rng, anchors = random.Random(4), pii.automaton()
    for _ in range(5000):
        text = "".join(rng.choice("0123456789.+- ()@ab_%42....@@é🎉") for _ in range(rng.randint(0, 80)))
        assert [m for m in pii.find(text, anchors) if m[0] in pii.BASE] == brute_pii(text)


def test_pii_added_spans():
    find = lambda t: [(k, t[a:b]) for k, a, b in pii.find(t, pii.automaton())]
    assert ("ssn", "123-45-6789") in find("SSN: 123-45-6789.")
    assert ("account", "DE89 3704 0044 0532 0130 00") in find("IBAN DE89 3704 0044 0532 0130 00")
    assert ("url_user", "bob:pw@host.org") in find("see ftp://bob:pw@host.org/x")
    assert find("the account of the matter in 2001") == []


def test_pii_added_spans_of_any_form():
    find = lambda t: [(k, t[a:b]) for k, a, b in pii.find(t, pii.automaton()) if k not in pii.BASE]
    iban = "GB29 NWBK 6016 1331 9268 19"
    assert find(f"IBAN {iban}") == find(f"IBAN Code: {iban} BIC NWBKGB2L") == [("account", iban)]
    assert find("IBAN NO93 8601 1117 947.") == [("account", "NO93 8601 1117 947")]
    for label in ("Account Number: ", "Account ID: ", "account no. ", "accounts ", "Account Number " + "." * 40 + " "):
        assert find(label + "12345678 Bank") == [("account", "12345678")]
    assert find("Social Security Number: 123-45-6789") == [("ssn", "123-45-6789")]
    assert find("Account Manager 12345678") == find("account 12345678X") == []
    user = "u" * 400 + "@host.org"
    assert find(f"https://{user}/") == [("url_user", user)]


def test_pii_table(spark, messy, empty, sf_dir):
    for docs in (messy, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want = Counter((r["doc_id"], tuple(brute_pii(r["text"] or ""))) for r in rows(docs))
        got = Counter((r["doc_id"], tuple((m["kind"], m["start"], m["end"]) for m in r["found"] if m["kind"] in pii.BASE)) for r in pii.find_pii(docs).collect())
        assert got == want
    assert pii.find_pii(empty).count() == 0


def test_pii_query_derives_its_columns(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
    for r in rows(queries.op10_pii(spark, sf_dir)):
        want = brute_pii(docs[r["doc_id"]])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(m[0] == k for m in want) for k in pii.BASE]
        assert set(line.split(",")) <= set(r["spans"].split(","))


def test_pii_hostile_texts_take_linear_time():
    anchors = pii.automaton()
    for text in ("IBAN" * 50_000, "account " * 20_000, "IBAN" * 20_000 + " " * 200_000 + "12345678", "+1" * 100_000, "x@" * 100_000, "http://a" * 50_000, "1 " * 100_000, "account " + "no " * 100_000):
        began = time.time()
        pii.find(text, anchors)
        assert time.time() - began < 10
    long_user = "a" * 300
    assert ("url_user", 7, 7 + 300 + 5) in pii.find(f"http://{long_user}@b.cd", anchors)


# -- input columns named like those of the operators


def test_kept_rows_may_have_any_columns(spark):
    names = ["_id", "_sha", "_at", "_sig", "_row", "row", "id", "n", "at", "sig", "size", "met_id", "digest", "_source", "_size", "_nth", "words", "kinds"]
    text = lambda k: " ".join(f"the{k} of{i} and" for i in range(30))
    rows_in = [(k, text(k % 4), ["a", None][k % 2], *[f"{c}{k}" for c in names]) for k in (0, 1, 2, 3, 3, 4)]
    docs = spark.createDataFrame(rows_in, "doc_id bigint, text string, source string, " + ", ".join(f"{c} string" for c in names))
    for stage in (exact_dedup.kept_documents, near_dup.kept_documents, mixing.mixed_documents, quality_rules.kept_documents):
        out = stage(docs)
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.collect()} <= set(rows_in)
    assert len({r["text"] for r in exact_dedup.kept_documents(docs).collect()}) == 4
