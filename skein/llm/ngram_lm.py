"""Language-model scores by stupid backoff, computed relationally.

Every text's n-grams (orders 1 to ORDER) are exploded and dealt by hash over partitions of a
count table that is gathered from the same corpus. Rows of the exchange are blocks: the
distinct n-grams of a few thousand texts in one hash range, sorted, with their counts. In its
range an n-gram's counts over all blocks are summed (that is the count table's partition) and
joined to the blocks that asked, which get the sums back in their own order. Each block then
has the corpus counts of all its n-grams, and the scores are summed per document.

Counting blocks and not occurrences bounds what a frequent n-gram sends: one row part from
each block, however often it occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import textblock
from skein.llm.common import bound_batches, release, written

ORDER = 3
BACKOFF = 0.4
#: N-grams of two words and more that the corpus has less often are taken as unseen.
MIN_COUNT = 2
#: Rows of a block; a text of more than LONG_TEXT bytes is a block of its own, so a block has at most 256 MB.
ROWS_PER_BLOCK, LONG_TEXT = 4000, 1 << 16
NGRAMS_PER_RANGE = 6_000_000
MIN_RANGE_BITS = 6
#: Bits of the hash, beyond those that name the range, by which n-grams are told apart. As the
#: ranges grow in number with the corpus, an n-gram shares its count with an unlike one with odds
#: of at most NGRAMS_PER_RANGE / 2^40, about 6 in a million, whatever the corpus.
BITS_IN_RANGE = 40


def _counts_of(column: pa.Array, order: int):
    """First word of each text and, by order from 1, (n-gram of each place, texts)."""
    data, offsets = textblock.flat(column)
    starts, _, hashes = textblock.words(data, offsets, fold=True)
    first = np.searchsorted(starts, offsets)
    return first, [textblock.ngrams(hashes, first, k)[0] for k in range(1, order + 1)]


def _block_column() -> Column:
    at = F.monotonically_increasing_id()
    inside = at.bitwiseAND(F.lit((1 << 33) - 1))
    several = F.shiftright(at, 33) * F.lit(1 << 24) + F.floor(inside / ROWS_PER_BLOCK)
    return F.when(F.octet_length("text") > LONG_TEXT, F.lit(-2) - at).otherwise(several)


def _rows(parts):
    cols = list(zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], ["r", "block", "o", "g", "c"])


def requests(blocked: DataFrame, order: int, bits: int) -> DataFrame:
    """(r, block, o, g, c): a block's distinct n-grams of order o in hash range r, and their counts."""

    def flush(block, held):
        _, grams = _counts_of(pa.concat_arrays(held), order)
        each = [np.unique(g, return_counts=True) for g in grams]
        # The sums of the distinct n-grams tell whether the second reading has the same blocks.
        yield block % (1 << bits), block, 0, np.array([v.sum(dtype=np.uint64) for v, _ in each], "<u8").tobytes(), b""
        for o, (values, counts) in enumerate(each, 1):
            edges = np.searchsorted(values >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            inside = (values << np.uint64(bits)) >> np.uint64(64 - BITS_IN_RANGE)
            for r in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                lo, hi = int(edges[r]), int(edges[r + 1])
                yield r, block, o, textblock.pack_ascending(inside[lo:hi]), textblock.pack_counts(counts[lo:hi])

    def run(batches):
        block, held = None, []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]]) if len(ids) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if ids[lo] < -1:
                    yield _rows(list(flush(int(ids[lo]), [batch.column(1).slice(lo, hi - lo)])))
                    continue
                if block is not None and ids[lo] != block:
                    yield _rows(list(flush(block, held)))
                    held = []
                block = int(ids[lo])
                held.append(batch.column(1).slice(lo, hi - lo))
        if held:
            yield _rows(list(flush(block, held)))

    return blocked.select("block", "text").mapInArrow(run, "r int, block bigint, o int, g binary, c binary")


def answers(asked: DataFrame) -> DataFrame:
    """(block, r, o, c, n): the corpus counts of each request's n-grams, in its order.

    A row of block -1 and order 1 has in n the words that the corpus has in a range; one of
    order 0 has in c the sums of the block's distinct n-grams, as they were sent.
    """

    def run(batches):
        by: dict[tuple[int, int], list] = {}
        for batch in batches:
            for row in zip(*batch.columns):
                r, block, o, g, c = (x.as_py() for x in row)
                by.setdefault((r, o), []).append((block, g, c))
        for r, o in sorted(by):
            parts = by.pop((r, o))
            if o == 0:
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in parts], pa.int64()), pa.array([r] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([g for _, g, _ in parts], pa.binary()), pa.array([0] * n, pa.int64())], ["block", "r", "o", "c", "n"])
                continue
            each = [textblock.unpack_ascending(g) for _, g, _ in parts]
            grams = np.concatenate(each)
            counts = np.concatenate([textblock.unpack_counts(c) for _, _, c in parts])
            order = np.argsort(grams)
            at = np.flatnonzero(np.concatenate([[True], grams[order][1:] != grams[order][:-1]]))
            sums = np.add.reduceat(counts[order], at)
            back = np.empty(len(grams), np.int64)
            back[order] = np.repeat(sums, np.diff(np.concatenate([at, [len(grams)]])))
            edge = np.cumsum([0] + [len(g) for g in each])
            blocks = [b for b, _, _ in parts]
            bodies = [textblock.pack_counts(back[lo:hi]) for lo, hi in zip(edge, edge[1:])]
            words = [0] * len(parts)
            if o == 1:
                blocks, bodies, words = [*blocks, -1], [*bodies, b""], [*words, int(counts.sum())]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([r] * n, pa.int32()), pa.array([o] * n, pa.int32()), pa.array(bodies, pa.binary()), pa.array(words, pa.int64())], ["block", "r", "o", "c", "n"])

    return asked.repartition("r").mapInArrow(run, "block bigint, r int, o int, c binary, n bigint")


def score_block(column: pa.Array, sums: list[np.ndarray], total: int, order: int, check: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(words, sum of log10 scores) of each text of a block.

    sums: by order from 1, the corpus counts of the block's distinct n-grams, ascending by hash.
    check: the sums of those n-grams when they were sent; others are an error, never a wrong score.
    """
    first, grams = _counts_of(column, order)
    sent = np.frombuffer(check, "<u8") if check else None
    n_words = np.diff(first)
    text = np.repeat(np.arange(len(n_words)), n_words)
    rank = np.arange(len(text)) - first[text]
    by_place = []
    for k, g in enumerate(grams, 1):
        # One sort names each place's n-gram among the distinct ones; no place is searched for.
        order_of = np.argsort(g)
        ascending = g[order_of]
        fresh = np.ones(len(g), bool)
        fresh[1:] = ascending[1:] != ascending[:-1]
        nth = np.cumsum(fresh) - 1
        if int(fresh.sum()) != len(sums[k - 1]) or sent is not None and ascending[fresh].sum(dtype=np.uint64) != sent[k - 1]:
            raise RuntimeError("the blocks of the second reading are not those of the first; write the input as a table first")
        # Count of the n-gram that ends at each place; 0 where the text has not had so many words.
        out = np.zeros(len(text), np.int64)
        out[np.flatnonzero(rank >= k - 1)[order_of]] = sums[k - 1][nth]
        by_place.append(out)
    score = np.log10(np.maximum(by_place[0], 1) / max(total, 1)) + (order - 1) * np.log10(BACKOFF)
    for k in range(2, order + 1):
        seen = by_place[k - 1] >= MIN_COUNT
        context = np.zeros(len(text), np.int64)
        context[1:] = by_place[k - 2][:-1]
        level = np.log10(np.maximum(by_place[k - 1], 1) / np.maximum(context, 1)) + (order - k) * np.log10(BACKOFF)
        score = np.where(seen & (rank >= k - 1), level, score)
    # A text's first words have no longer n-grams: they owe no backoff for those.
    short = np.maximum(order - 1 - rank, 0)
    score -= short * np.log10(BACKOFF) * (short > 0)
    sums_of = np.bincount(text, weights=score, minlength=len(n_words)) if len(text) else np.zeros(len(n_words))
    return n_words, sums_of


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, log10_score, log10_per_word) of each row of docs (columns doc_id, text).

    Words are runs of characters outside ASCII white space, A to Z lower-cased. The score of a
    word is count(n-gram) / count(its context) for the longest n-gram that ends with it and
    that the corpus has MIN_COUNT times, with BACKOFF for each shorter order; a word alone is
    count / all words. Counts are over all rows. Null texts and texts without words have 0
    words and score 0; log10_per_word is null there. An empty table gives an empty table.
    """
    bound_batches(docs.sparkSession)
    blocked = docs.select(_block_column().alias("block"), "doc_id", "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    bits = max(MIN_RANGE_BITS, int(size * order // 8 // NGRAMS_PER_RANGE).bit_length())
    found = written(answers(requests(blocked, order, bits)), "counts")
    release(docs.sparkSession)
    total = found.filter("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def join(texts: pa.Table, counts: pa.Table) -> pa.Table:
        parts: dict[int, dict[int, bytes]] = {}
        for r, o, c in zip(counts.column("r").to_pylist(), counts.column("o").to_pylist(), counts.column("c").to_pylist()):
            parts.setdefault(o, {})[r] = c
        sums = [np.concatenate([np.zeros(0, np.int64), *(textblock.unpack_counts(parts[o][r]) for r in sorted(parts.get(o, {})))]) for o in range(1, order + 1)]
        column = texts.column("text").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        words, score = score_block(column, sums, total, order, parts.get(0, {None: None}).popitem()[1])
        per = [s / w if w else None for s, w in zip(score, words)]
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(words, pa.int64()), "log10_score": pa.array(score, pa.float64()), "log10_per_word": pa.array(per, pa.float64())})

    counts = found.filter("block <> -1").select("block", "r", "o", "c")
    return blocked.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(join, f"doc_id {kind}, n_words bigint, log10_score double, log10_per_word double")
