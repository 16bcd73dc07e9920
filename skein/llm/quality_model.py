"""Quality classifier: attention-based multiple-instance learning over passages.

A text is a bag of passages of PASSAGE_WORDS words. Each passage is encoded: measured
features (characters by class, word lengths, repetition, common words, hashed byte pairs)
go through a learned layer. Learned gated attention weighs the passages,
a_k ~ exp(w . (tanh(V h_k) * sigmoid(U h_k))), and a logistic unit scores the weighted sum
of their codes. Only document labels are used; which passages matter is learned.

Learning takes a bounded sample of labelled rows; the model is a few thousand numbers, so
the driver fits it and every executor gets it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import textblock
from skein.llm.common import bound_batches

PASSAGE_WORDS = 64
PAIR_BUCKETS = 24
HIDDEN, GATE = 16, 8
#: Bounds on what is learned from: about so many labelled rows, chosen by a hash of the id,
#: and of these the texts with at most so many passages.
MAX_TRAINING_ROWS = 3000
MAX_TRAINING_PASSAGES = 400
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 1e-4
THRESHOLD = 0.3

#: Character classes by byte; bytes from 0x80 on are a class of their own.
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", "\n", ".,;:", "!?", "'\"()-", "#*$%&|<>", "@/\\[]{}^_`~=+")
_CLASS = np.full(256, len(_CLASSES) + 1, np.int64)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
_CLASS[128:] = len(_CLASSES)
N_CLASSES = len(_CLASSES) + 2
N_FEATURES = N_CLASSES + PAIR_BUCKETS + 9
#: Fixed: frequent function words.
_COMMON = "the of and to in a is that for it der die und den von zu das mit de la le et les des en un du une que el y los se del las".split()


def _hash_words(items: list[str]) -> np.ndarray:
    data, offsets = textblock.flat(pa.array(items))
    return np.sort(textblock.words(data, offsets, fold=True)[2])


_COMMON_HASHES = _hash_words(_COMMON)


def byte_counts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, owner: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages x classes, passages x pair buckets): bytes by class and hashed byte pairs.

    A byte belongs to the passage of the last word that has begun, or of its text's first.
    Bytes are worked on in runs, so a very long text needs no array over all of them.
    """
    kinds, pairs = np.zeros((int(first[-1]), N_CLASSES)), np.zeros((int(first[-1]), PAIR_BUCKETS))
    for lo in range(0, len(data), textblock.BLOCK_BYTES):
        place = np.arange(lo, min(lo + textblock.BLOCK_BYTES, len(data)))
        text = np.searchsorted(offsets, place, "right") - 1
        word = owner[np.maximum(np.searchsorted(starts, place, "right") - 1, 0)]
        at = np.minimum(np.maximum(first[text], word), first[text + 1] - 1)
        low, many = int(at.min()), int(at.max() - at.min()) + 1
        kinds[low : low + many] += np.bincount((at - low) * N_CLASSES + _CLASS[data[place]], minlength=many * N_CLASSES).reshape(many, N_CLASSES)
        place, at = place[place + 1 < len(data)], at[place + 1 < len(data)]
        pair = ((data[place].astype(np.int64) * 31 + data[place + 1]) * 0x9E3779B1 >> 12) % PAIR_BUCKETS
        pairs[low : low + many] += np.bincount((at - low) * PAIR_BUCKETS + pair, minlength=many * PAIR_BUCKETS).reshape(many, PAIR_BUCKETS)
    return kinds, pairs


def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, first): measured features of all passages, and each text's first passage.

    A text without words has one passage of zeros.
    """
    data, offsets = textblock.flat(column)
    starts, ends, hashes = textblock.words(data, offsets, fold=True)
    first_word = np.searchsorted(starts, offsets)
    n_words = np.diff(first_word)
    n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(n_pass)])
    total = int(first[-1])
    out = np.zeros((total, N_FEATURES))
    if len(starts):
        text = np.repeat(np.arange(len(n_words)), n_words)
        rank = np.arange(len(starts)) - first_word[text]
        owner = first[text] + rank // PASSAGE_WORDS
        kinds, pairs = byte_counts(data, offsets, starts, owner, first)
        size = np.maximum(kinds.sum(axis=1), 1)[:, None]
        out[:, :N_CLASSES] = kinds / size
        out[:, N_CLASSES : N_CLASSES + PAIR_BUCKETS] = np.sqrt(pairs / size)
        at = N_CLASSES + PAIR_BUCKETS
        count = np.bincount(owner, minlength=total)
        some = np.maximum(count, 1)
        per = lambda v: np.bincount(owner, weights=v, minlength=total) / some
        length = (ends - starts).astype(np.float64)
        same = np.zeros(len(hashes))
        same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
        known = _COMMON_HASHES[np.minimum(np.searchsorted(_COMMON_HASHES, hashes), len(_COMMON_HASHES) - 1)] == hashes
        # First meetings of a word in its passage and in its text: equal ones are side by side, in order, after a stable sort.
        order = np.argsort(hashes, kind="stable")
        order = order[np.argsort(text[order], kind="stable")]
        again = np.zeros(len(order), bool)
        again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
        near = again.copy()
        near[1:] &= owner[order][1:] == owner[order][:-1]
        in_text, in_passage = np.ones(len(order)), np.ones(len(order))
        in_text[order], in_passage[order] = ~again, ~near
        out[:, at] = np.log1p(count)
        out[:, at + 1] = per(length)
        out[:, at + 2] = np.sqrt(np.maximum(per(length * length) - out[:, at + 1] ** 2, 0))
        out[:, at + 3] = per(same)
        out[:, at + 4] = per(in_passage)
        out[:, at + 5] = per(known.astype(np.float64))
        out[:, at + 6] = per(in_text)
        out[:, at + 7] = np.log1p(np.repeat(n_words, n_pass))
        out[:, at + 8] = per(length > 12)
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Parameters: scaling (mean, scale), encoder (W, b), gates (V, U, w), score (c, d)."""

    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """Codes, attention and scores of bags of passages."""
        p = self.params
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        a = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        a /= np.add.reduceat(a, first[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "y": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each bag."""
        return self.forward((features - self.mean) / self.scale, first)["y"]


def fit(features: np.ndarray, first: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Learn a model from bags of passages by Adam on the log loss."""
    rng = np.random.Generator(np.random.Philox(seed))
    n, d = len(labels), features.shape[1]
    model = Model(features.mean(axis=0), features.std(axis=0) + 1e-3, {
        "W": rng.standard_normal((d, HIDDEN)) / np.sqrt(d), "b": np.zeros(HIDDEN),
        "V": rng.standard_normal((HIDDEN, GATE)) / 4, "U": rng.standard_normal((HIDDEN, GATE)) / 4, "w": rng.standard_normal(GATE) / 4,
        "c": rng.standard_normal(HIDDEN) / 4, "d": np.zeros(()),
    })
    x_all = (features - model.mean) / model.scale
    p = model.params
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            take = order[lo : lo + BATCH]
            sizes = first[take + 1] - first[take]
            f = np.concatenate([[0], np.cumsum(sizes)])
            x = x_all[np.repeat(first[take] - f[:-1], sizes) + np.arange(f[-1])]
            s = model.forward(x, f)
            dy = (s["y"] - labels[take]) / len(take)
            dz = dy[:, None] * p["c"]
            da = (dz[s["bag"]] * s["h"]).sum(axis=1)
            de = s["a"] * (da - np.add.reduceat(s["a"] * da, f[:-1])[s["bag"]])
            dt, dg = de[:, None] * p["w"] * s["g"] * (1 - s["t"] ** 2), de[:, None] * p["w"] * s["t"] * s["g"] * (1 - s["g"])
            dh = s["a"][:, None] * dz[s["bag"]] + dt @ p["V"].T + dg @ p["U"].T
            dx = dh * (1 - s["h"] ** 2)
            grads = {"W": x.T @ dx, "b": dx.sum(axis=0), "V": s["h"].T @ dt, "U": s["h"].T @ dg, "w": (s["t"] * s["g"]).T @ de, "c": s["z"].T @ dy, "d": dy.sum()}
            step += 1
            for k, grad in grads.items():
                grad = grad + DECAY * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
                p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def training_bags(docs: DataFrame, labels: DataFrame, holds_out: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, first, labels) of the bounded sample of rows to learn from.

    The sampled labels are about MAX_TRAINING_ROWS rows, which bounds the broadcast.
    """
    rows = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~holds_out).groupBy("doc_id").agg(F.max("quality").alias("label"))
    n = rows.count()
    if n > MAX_TRAINING_ROWS:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) < int((1 << 30) * MAX_TRAINING_ROWS / n))

    def run(batches):
        for batch in batches:
            for part in textblock.row_blocks(batch, 0):
                x, first = encode(part.column(0))
                keep = np.flatnonzero(np.diff(first) <= MAX_TRAINING_PASSAGES)
                yield pa.RecordBatch.from_arrays([pa.array([x[first[i] : first[i + 1]].astype(np.float32).tobytes() for i in keep], pa.binary()), part.column(1).take(pa.array(keep))], ["x", "label"])

    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", F.col("label").cast("int").alias("label")).mapInArrow(run, "x binary, label int").toArrow()
    bags = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in found.column("x").to_pylist()]
    order = sorted(range(len(bags)), key=lambda i: (len(bags[i]), bags[i].tobytes()))
    sizes = [len(bags[i]) for i in order]
    x = np.concatenate([bags[i] for i in order]).astype(np.float64) if bags else np.zeros((0, N_FEATURES))
    y = np.array([found.column("label")[i].as_py() for i in order], np.float64)
    return x, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), y


def score_quality(docs: DataFrame, labels: DataFrame, holds_out: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (columns doc_id, text).

    holds_out is a boolean column over doc_id: such rows are not learned from. score is the
    probability of label 1, predicted is 1 from THRESHOLD on. Null and empty texts are bags
    of one passage of zeros. Without labelled rows every score is 0.5. Whole texts are read
    and rows are independent: there is no exchange of documents. Equal texts have equal scores,
    whatever their ids; an empty table gives an empty one; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    x, first, y = training_bags(docs, labels, holds_out)
    model = fit(x, first, y) if len(y) else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in textblock.row_blocks(batch, 2):
                score = model.score(*encode(part.column(2))) if model else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", holds_out.alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
