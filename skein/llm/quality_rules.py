"""Quality rules by distribution divergence, in DataFrame functions only.

A text's histogram over character classes and its histogram over common words are compared
with references of several languages by the Jensen-Shannon divergence (base 2, 0 to 1). A
text is rejected where even the nearest reference is far, but only when it is long enough
for its histograms to mean something. The base counts and the base rule are the contract's.

All work is inside a row: there is no exchange, so no key can be hot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import SPACE_CHARS, let, text_or_empty, word_array

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Fixed reference values: share of characters by class (lower-case letters, capitals,
#: digits, white space, sentence marks, symbols, the rest) in running prose.
CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other")
CLASS_REFERENCES = {
    "en": (0.790, 0.022, 0.004, 0.160, 0.022, 0.001, 0.001),
    "de": (0.800, 0.040, 0.004, 0.130, 0.024, 0.001, 0.001),
    "fr": (0.785, 0.022, 0.004, 0.160, 0.027, 0.001, 0.001),
    "es": (0.790, 0.020, 0.004, 0.160, 0.024, 0.001, 0.001),
}
#: Fixed reference values: the share of a language's commonest words among all words of a text.
WORD_REFERENCES = {
    "en": {"the": 0.06, "of": 0.035, "and": 0.028, "to": 0.025, "in": 0.02, "a": 0.02, "is": 0.011, "that": 0.011, "for": 0.009, "it": 0.009},
    "de": {"der": 0.035, "die": 0.035, "und": 0.028, "in": 0.018, "den": 0.012, "von": 0.011, "zu": 0.011, "das": 0.010, "mit": 0.010, "sich": 0.009},
    "fr": {"de": 0.045, "la": 0.028, "le": 0.022, "et": 0.020, "les": 0.018, "des": 0.016, "en": 0.013, "un": 0.011, "du": 0.011, "une": 0.010},
    "es": {"de": 0.055, "la": 0.038, "que": 0.028, "el": 0.027, "en": 0.025, "y": 0.024, "los": 0.016, "se": 0.012, "del": 0.011, "las": 0.011},
}
VOCABULARY = sorted({w for ref in WORD_REFERENCES.values() for w in ref})
MAX_CLASS_DIVERGENCE = 0.045
MIN_CLASS_CHARS = 200
MAX_WORD_DIVERGENCE = 0.08
MIN_HISTOGRAM_WORDS = 50

DIGITS = "0123456789"
MARKS = ".,;:!?'\"()-"
SYMBOLS = "#*$%&|<>"
MORE_SYMBOLS = "@^_~=+/\\[]{}`"


def kinds_of(text: Column) -> Column:
    """The text with each digit, mark, symbol and white space replaced by the first of its class."""
    groups = (DIGITS, MARKS, SYMBOLS, MORE_SYMBOLS, SPACE_CHARS)
    return F.translate(text, "".join(groups), "".join(g[0] * len(g) for g in groups))


def count_kind(group: str) -> Column:
    """Characters of a class, counted in the column kinds."""
    return F.length("kinds") - F.length(F.replace(F.col("kinds"), F.lit(group[0]), F.lit("")))


def common_words(words: Column) -> Column:
    """The words that, in lower case and without marks around them, the references hold, in order."""
    return F.filter(F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(MARKS)))), lambda w: w.isin(*VOCABULARY))


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    """64-bit hashes of the windows of 8 words, in order; empty for shorter texts."""
    each = lambda h: F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (window - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, window)))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window, F.array().cast("array<bigint>")).otherwise(let(hashes, each))


def repeated_starts(win: Column) -> Column:
    """Places, ascending, of the values that the array holds twice or more.

    A sort brings equal values together; n log n in the windows of one text.
    """

    def marked(t: Column) -> Column:
        twin = lambda k, x: F.coalesce(F.get(t, k)["h"] == x["h"], F.lit(False))
        hits = F.filter(t, lambda x, k: twin(k - 1, x) | twin(k + 1, x))
        return F.sort_array(F.transform(hits, lambda x: x["i"]))

    return let(F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), marked)


def union_length(at: Column, window: int = WINDOW) -> Column:
    """Length of the union of [a, a + window) over the ascending array at."""
    return F.aggregate(
        at,
        F.struct(F.lit(-window).alias("last"), F.lit(0).cast("bigint").alias("sum")),
        lambda s, a: F.struct(a.alias("last"), (s["sum"] + F.least(F.lit(window), a - s["last"])).alias("sum")),
        lambda s: s["sum"],
    )


def divergence(p: list[Column], q: list[float]) -> Column:
    """Jensen-Shannon divergence in bits of two distributions over the same cells."""
    total = F.lit(0.0)
    for x, y in zip(p, q):
        m = (x + F.lit(y)) / 2
        total = total + F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        total = total + (y * F.log2(F.lit(y) / m) if y > 0 else F.lit(0.0))
    return total / 2


def class_shares(text: Column) -> dict[str, Column]:
    """Counts by character class."""
    n = F.length(text)
    return {
        "lower": n - F.length(F.regexp_replace(text, r"\p{Ll}+", "")),
        "upper": n - F.length(F.regexp_replace(text, r"\p{Lu}+", "")),
        "digit": count_kind(DIGITS),
        "space": count_kind(SPACE_CHARS),
        "mark": count_kind(MARKS),
        "symbol": count_kind(SYMBOLS) + count_kind(MORE_SYMBOLS),
    }


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs (columns doc_id, text; null text is empty).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, and class_divergence and word_divergence (of the nearest reference; null where the
    text is below the minimum length). Texts without words fail the base rule.
    """
    return scored(docs).drop("_row")


def scored(docs: DataFrame) -> DataFrame:
    """quality_rules() with the row of docs itself in a struct column _row."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), "doc_id", text_or_empty().alias("text"))
    rows = rows.withColumn("words", word_array(F.col("text"))).withColumn("kinds", kinds_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    rows = rows.withColumn("win", window_hashes(F.col("words"))).withColumn("lines", lines)
    n_words = F.size("words").cast("bigint")
    rows = rows.select(
        "_row",
        "doc_id",
        "text",
        n_words.alias("n_words"),
        (F.length("text") - count_kind(SPACE_CHARS)).cast("bigint").alias("word_chars"),
        count_kind(SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("win")) < F.size("win"), repeated_starts(F.col("win"))).otherwise(F.array().cast("array<int>")).alias("at"),
        *[c.cast("bigint").alias(f"c_{k}") for k, c in class_shares(F.col("text")).items()],
        F.concat(F.lit(" "), F.concat_ws("  ", common_words(F.col("words"))), F.lit(" ")).alias("spaced"),
    )
    rows = rows.withColumn("n_repeat_words", union_length(F.col("at")))
    chars = F.greatest(F.length("text").cast("double"), F.lit(1.0))
    shares = [F.col(f"c_{k}") / chars for k in CLASSES[:-1]]
    shares.append(F.greatest(F.lit(1.0) - sum(shares[1:], shares[0]), F.lit(0.0)))
    n = F.greatest(F.col("n_words").cast("double"), F.lit(1.0))
    rows = rows.withColumns({f"s_{i}": s for i, s in enumerate(shares)} | {f"w_{w}": (F.length("spaced") - F.length(F.replace("spaced", F.lit(f" {w} "), F.lit("")))) / F.lit(float(len(w) + 2)) / n for w in VOCABULARY})
    class_div = F.least(*[divergence([F.col(f"s_{i}") for i in range(len(CLASSES))], list(ref)) for ref in CLASS_REFERENCES.values()])

    def word_div(ref: dict[str, float]) -> Column:
        rest = F.greatest(F.lit(1.0) - sum((F.col(f"w_{w}") for w in ref), F.lit(0.0)), F.lit(0.0))
        return divergence([*[F.col(f"w_{w}") for w in ref], rest], [*ref.values(), 1 - math.fsum(ref.values())])

    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.select(
        "_row",
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        F.when(F.length("text") >= MIN_CLASS_CHARS, class_div).alias("class_divergence"),
        F.when(F.col("n_words") >= MIN_HISTOGRAM_WORDS, F.least(*[word_div(r) for r in WORD_REFERENCES.values()])).alias("word_divergence"),
    )
    odd = (F.coalesce("class_divergence", F.lit(0.0)) > MAX_CLASS_DIVERGENCE) | (F.coalesce("word_divergence", F.lit(0.0)) > MAX_WORD_DIVERGENCE)
    # The row number holds the optimiser from moving a filter on these columns below the projections,
    # where it would evaluate the whole chain again for every use.
    verdict = ~F.col("base_failed") & ~odd & (F.monotonically_increasing_id() >= 0)
    return rows.select(*rows.columns[:8], verdict.alias("kept"), *rows.columns[8:])


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    return scored(docs).filter("kept").select("_row.*")
