"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are gathered per language and n-gram bucket by a distributed aggregation over a
bounded sample of labelled rows; the log-probability matrix (BUCKETS x languages) is
broadcast and texts are scored in numpy, batch by batch. A batch is a sparse matrix in row
form: the n-gram buckets of its texts one after the other and where each text begins; a
score is the sum of the matrix rows between two such places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bound_batches

ORDERS = (2, 3)
BITS = 16
BUCKETS = 1 << BITS
SMOOTHING = 0.5
#: Bound on the labelled rows that are learned from: about this many, chosen by a hash of the id.
MAX_TRAINING_ROWS = 20_000
#: Characters that are scored at a time.
BLOCK_CHARS = 1 << 18
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def buckets_of(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each place but the last order - 1."""
    n = len(points) - order + 1
    h = np.full(max(n, 0), order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    if n > 0:
        for k in range(order):
            h = (h ^ points[k : k + n]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - BITS)


def blocks(texts: list[str]):
    """(points, starts, rows, tails): texts joined up to BLOCK_CHARS, longer ones cut with an overlap.

    tails: how many places at the end of each piece are the next piece's first ones.
    """
    parts, starts, rows, tails, size = [], [], [], [], 0
    for i, text in enumerate(texts):
        text = text.lower()
        for lo in range(0, len(text), BLOCK_CHARS):
            points = np.frombuffer(text[lo : lo + BLOCK_CHARS + max(ORDERS) - 1].encode("utf-32-le"), np.uint32)
            if size and size + len(points) > BLOCK_CHARS:
                yield np.concatenate(parts), np.array(starts), np.array(rows), np.array(tails)
                parts, starts, rows, tails, size = [], [], [], [], 0
            starts.append(size)
            rows.append(i)
            parts.append(points)
            tails.append(max(0, len(points) - BLOCK_CHARS))
            size += len(points)
    if parts:
        yield np.concatenate(parts), np.array(starts), np.array(rows), np.array(tails)


def spans(points: np.ndarray, starts: np.ndarray, tails: np.ndarray, order: int):
    """Buckets of a block; n-grams that cross a border, or are the next piece's, go to a bucket of their own."""
    h = buckets_of(points, order).astype(np.int64)
    ends = np.append(starts[1:], len(points))
    for k in range(1, max(ORDERS)):
        at = ends[k <= np.maximum(tails, order - 1)] - k
        h[at[(at >= 0) & (at < len(h))]] = BUCKETS
    return h


def learnable(docs: DataFrame, holds_out) -> DataFrame:
    """Labelled rows to learn from: lang known and not held out, at most about MAX_TRAINING_ROWS."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~holds_out)
    n = rows.count()
    if n > MAX_TRAINING_ROWS:
        limit = int((1 << 30) * MAX_TRAINING_ROWS / n)
        rows = rows.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30)) < limit)
    return rows


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities as float32 (BUCKETS + 1) x languages); the last row is 0.

    Only languages x BUCKETS sums reach the driver.
    """

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0), batch.column(1)):
                by.setdefault(lang.as_py(), []).append(text.as_py())
            for lang, texts in by.items():
                counts = found.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for points, starts, _, tails in blocks(texts):
                    for order in ORDERS:
                        counts += np.bincount(spans(points, starts, tails, order), minlength=BUCKETS + 1)
        for lang, counts in found.items():
            at = np.flatnonzero(counts[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])

    sums = rows.select("text", "lang").mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(sums.column("lang").to_pylist()))
    counts = np.full((BUCKETS + 1, len(names)), SMOOTHING)
    if names:
        place = {x: k for k, x in enumerate(names)}
        counts[sums.column("bucket").to_numpy(), [place[x] for x in sums.column("lang").to_pylist()]] += sums.column("n").to_numpy()
    logs = np.log(counts / counts[:-1].sum(axis=0)).astype(np.float32)
    logs[-1] = 0
    return names, logs


def score_texts(texts: list[str], logs: np.ndarray) -> np.ndarray:
    """Log-likelihood of each text under each language."""
    out = np.zeros((len(texts), logs.shape[1]))
    for points, starts, rows, tails in blocks(texts):
        for order in ORDERS:
            h = spans(points, starts, tails, order)
            if len(h):
                inside = starts < len(h)
                sums = np.add.reduceat(logs[h], starts[inside], axis=0, dtype=np.float64)
                np.add.at(out, rows[inside], sums)
    return out


def identify(docs: DataFrame, holds_out) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of docs (columns doc_id, text, lang).

    holds_out is a boolean column: such rows, and rows without a language or a text, are not
    learned from. score is the posterior of the language under equal priors. A null text and
    one without a letter give und and 0, as does everything when there is nothing to learn
    from. Texts are scored whole, however long; rows are independent, so there is no exchange.
    Ties go to the language whose code comes first; equal rows give equal results, an empty
    table an empty one; columns besides these three are ignored.
    """
    bound_batches(docs.sparkSession)
    names, logs = train(learnable(docs, holds_out))
    shared = docs.sparkSession.sparkContext.broadcast((names, logs))

    def run(batches):
        names, logs = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = [t.as_py() or "" for t in part.column(2)]
                real = np.array([bool(_LETTER.search(t)) for t in texts], bool) & bool(names)
                pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                at = np.flatnonzero(real)
                if len(at):
                    s = score_texts([texts[i] for i in at], logs)
                    best = s.argmax(axis=1)
                    score[at] = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
                    for i, k in zip(at, best):
                        pred[i] = names[k]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", holds_out.alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
