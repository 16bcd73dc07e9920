"""Near duplicates: an n-gram Jaccard join by grouped prefixes, and its connected classes.

A text is the set of its distinct 5-word shingles. Two sets whose similarity is at least
3/4 share a shingle among the first n/4 + 1 of each (n: the set's size), under any one order
of all shingles. The order here has rare shingles first, by hash, and behind them frequent
ones, by count. Frequent are those in more than HOT sets: a constant, whatever the corpus.

1. Equal sets are collapsed (they are linked by definition).
2. Blocks of sets ask the ranges of the hash for their frequent shingles; the answers follow
   each set by its number, so nothing that grows with the corpus is broadcast.
3. Sets with the same prefix and size form a group. Groups that share a rare prefix shingle,
   and whose sizes allow the similarity, are candidate pairs: at most HOT groups a shingle.
4. Two sets that share no rare shingle have at most their frequent ones in common. Only sets
   with a frequent shingle in their prefix can link that way, and only where the smaller
   number of frequent ones is enough for the similarity. These are a few sets of the
   largest families of copies; they are compared with one central set of the shingle.
5. What links is a class already; pairs inside it need no look. Candidates of different
   classes that are left are expanded to members and compared.

A comparison first bounds the difference of two sets by their parity bitmaps, a few dozen
bytes each; pairs that this cannot rule out are decided over whole sets of 48-bit hashes: two
unlike shingles of a pair of sets of n and m agree by chance with odds of n m / 2^48.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import textblock
from skein.llm.common import bound_batches, drop, release, written
from skein.llm.components import components

SHINGLE = 5
#: Links hold where PERCENT * union <= 100 * intersection.
PERCENT = 75
#: A shingle in more sets than this is frequent.
HOT = 50
#: Half of the hash range, whose tokens are kept apart: prefixes take a quarter of a set.
_LOW = np.uint64(1 << 47)
TOKENS_PER_RANGE = 1_000_000
MIN_RANGE_BITS = 10
#: Ranges that a task works on, one after the other.
RANGES_PER_TASK = 8
#: Tokens, and row numbers, that a block of sets spans at most (one set at least).
BLOCK_TOKENS, BLOCK_SPAN = 1_000_000, 1 << 16


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Shingles of a set of n of which similar sets share one."""
    return n - -(-PERCENT * n // 100) + 1


def pack(tokens: np.ndarray) -> bytes:
    """48-bit tokens in six bytes each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(body: bytes) -> np.ndarray:
    """The tokens of pack()."""
    raw = np.frombuffer(body, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.reshape(-1).view("<u8")


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each text's distinct shingles, ascending; a shorter text is one shingle."""
    data, offsets = textblock.flat(column)
    starts, _, hashes = textblock.words(data, offsets, fold=True)
    first_word = np.searchsorted(starts, offsets)
    count = np.diff(first_word)
    grams, text = textblock.ngrams(hashes, first_word, SHINGLE)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        whole = []
        for i in short:
            h = np.uint64(1000 + count[i])
            for w in hashes[first_word[i] : first_word[i + 1]]:
                h = np.uint64(int(h) * 0xD6E8FEB86659FD93 + int(w) & 0xFFFFFFFFFFFFFFFF)
            whole.append(h)
        grams, text = np.concatenate([grams, textblock.mix(np.array(whole, np.uint64))]), np.concatenate([text, short])
    order = np.argsort(grams)
    order = order[np.argsort(text[order], kind="stable")]
    grams, text = grams[order], text[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[fresh], text[fresh]
    return grams, np.searchsorted(text, np.arange(len(count) + 1))


def bitmap(own: np.ndarray) -> bytes:
    """Parity of the set's hashes by their lowest bits, over at least two bits for each of them."""
    size = max(64, 1 << int(2 * len(own) - 1).bit_length()) if len(own) else 64
    return np.packbits((np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(a: bytes, b: bytes, n: int) -> bool:
    """False only where two sets of n shingles together cannot be similar enough.

    Bits in which parities differ are at most the shingles in which the sets differ, and those
    are at most (100 - PERCENT) / (100 + PERCENT) of n. The larger bitmap is folded.
    """
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (100 + PERCENT) * int(np.bitwise_count(x ^ y).sum()) <= (100 - PERCENT) * n


def set_rows(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, n, n_low, sig, low, high, bits): size, digest, tokens and bitmap of each row's set.

    low holds the n_low lowest tokens, those of the lower half of the hash range or some more
    than a prefix has if these are more; high holds the others. uid is a number that no other
    row has.
    """

    def run(batches):
        for batch in batches:
            for part in textblock.row_blocks(batch, 2):
                grams, first = shingle_sets(part.column(2))
                n = np.diff(first)
                need = np.minimum(n, prefix_size(n) + n // 8 + 4)
                n_low, sig, low, high, maps = [], [], [], [], []
                for i in range(len(n)):
                    own = grams[first[i] : first[i + 1]]
                    sig.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    maps.append(bitmap(own))
                    tokens = own >> np.uint64(16)
                    n_low.append(max(int(np.searchsorted(tokens, _LOW)), int(need[i])))
                    low.append(pack(tokens[: n_low[i]]))
                    high.append(pack(tokens[n_low[i] :]))
                binary = [pa.array(x, pa.binary()) for x in (sig, low, high, maps)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(n_low, pa.int64()), *binary], ["uid", "doc_id", "n", "n_low", "sig", "low", "high", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(run, f"uid bigint, doc_id {kind}, n bigint, n_low bigint, sig binary, low binary, high binary, bits binary")


def range_bits(total: int) -> int:
    """Bits of the hash that name a range, so that a range has about TOKENS_PER_RANGE of the tokens."""
    return max(MIN_RANGE_BITS, (-(-total // TOKENS_PER_RANGE) - 1).bit_length())


def coarse(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits + 32 bits of tokens: a range and 32 bits within it.

    Candidates are found by these; two tokens that agree in them count as one, which adds
    candidates and loses none.
    """
    return tokens >> np.uint64(max(0, 16 - bits))


def _split(values: np.ndarray, bits: int):
    """(range, slice) of ascending coarse tokens."""
    edges = np.searchsorted(values, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(min(32, 48 - bits)))
    for r in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield r, slice(int(edges[r]), int(edges[r + 1]))


def _within(values: np.ndarray) -> bytes:
    return values.astype("<u4").tobytes()


def hot_tokens(rows: DataFrame, bits: int) -> DataFrame:
    """(uid, tok, df): each set's coarse tokens that more than HOT sets have, and in how many.

    A block of rows, the sets of one digest once, sends its tokens by range, with the place of
    their set; in its range a token's sets are counted and those of frequent ones answered.
    A group of equal sets is counted once a block, so a token may count as frequent for its
    copies alone; that changes the order of shingles, never a result.
    """

    def flush(base, held):
        tokens = coarse(np.concatenate([t for _, t in held]), bits)
        owner = np.repeat(np.array([u - base for u, _ in held], np.uint16), [len(t) for _, t in held])
        order = np.argsort(tokens)
        tokens, owner = tokens[order], owner[order]
        cols = list(zip(*[(r, _within(tokens[s]), owner[s].tobytes()) for r, s in _split(tokens, bits)]))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([base] * len(cols[0]), pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["r", "base", "t", "o"])

    def deal(batches):
        base, held, size, met = 0, [], 0, set()
        for batch in batches:
            for uid, sig, low, high in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                if held and (size > BLOCK_TOKENS or not 0 <= uid - base < BLOCK_SPAN):
                    yield flush(base, held)
                    held, size, met = [], 0, set()
                if sig.as_py() in met:
                    continue
                base = base if held else uid
                met.add(sig.as_py())
                held.append((uid, np.concatenate([unpack(low.as_py()), unpack(high.as_py())])))
                size += len(held[-1][1])
        if held:
            yield flush(base, held)

    def count(batches):
        by: dict[int, list] = {}
        for batch in batches:
            for r, base, t, o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                by.setdefault(r, []).append((base, t.as_py(), o.as_py()))
        for r in list(by):
            parts = by.pop(r)
            tokens = np.concatenate([np.frombuffer(t, "<u4") for _, t, _ in parts])
            order = np.argsort(tokens)
            at = np.flatnonzero(np.concatenate([[True], tokens[order][1:] != tokens[order][:-1]]))
            df = np.diff(np.concatenate([at, [len(tokens)]]))
            each = np.repeat(df, df)
            chosen, df = order[each > HOT], each[each > HOT]
            if len(chosen):
                uid = np.concatenate([base + np.frombuffer(o, np.uint16).astype(np.int64) for base, _, o in parts])
                yield pa.RecordBatch.from_arrays([pa.array(uid[chosen]), pa.array(tokens[chosen].astype(np.int64) + (r << min(32, 48 - bits))), pa.array(df.astype(np.int64))], ["uid", "tok", "df"])

    dealt = rows.filter("n > 0").select("uid", "sig", "low", "high").mapInArrow(deal, "r int, base bigint, t binary, o binary")
    return dealt.repartition((1 << bits) // RANGES_PER_TASK, "r").mapInArrow(count, "uid bigint, tok bigint, df bigint")


def prefix_of(tokens: np.ndarray, n: int, hot: np.ndarray, df: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, is hot) of a set: rare tokens by hash, then frequent ones by count.

    tokens: the set's, or its lowest ones where those have rare ones enough for a prefix.
    """
    p = int(prefix_size(np.int64(n)))
    if not len(hot):
        return tokens[:p], np.zeros(min(p, len(tokens)), bool)
    hot, at = np.unique(hot, return_index=True)
    part = coarse(tokens, bits).astype(np.int64)
    where = np.minimum(np.searchsorted(hot, part), len(hot) - 1)
    known = hot[where] == part
    rare = tokens[~known][:p]
    often = np.flatnonzero(known)
    often = often[np.lexsort((tokens[often], df[at[where[often]]]))][: p - len(rare)]
    return np.concatenate([rare, tokens[often]]), np.concatenate([np.zeros(len(rare), bool), np.ones(len(often), bool)])


def with_prefixes(sets: DataFrame, bits: int) -> DataFrame:
    """(rep, n, r, psig, rare, often) of sets (rep, n, tokens, hot); r: rare tokens of the whole set."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            edges, values = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            tok, df = values.field("tok").to_numpy(), values.field("df").to_numpy()
            size, psig, rare, often = [], [], [], []
            for i, (n, body) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                lo, hi = int(edges[i]), int(edges[i + 1])
                tokens, flag = prefix_of(unpack(body.as_py()), n, tok[lo:hi], df[lo:hi], bits)
                size.append(n - (hi - lo))
                psig.append(hashlib.blake2b(pack(tokens), digest_size=16).digest())
                rare.append(pack(np.sort(tokens[~flag])))
                often.append(np.unique(coarse(tokens[flag], bits)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(psig, pa.binary()), pa.array(rare, pa.binary()), pa.array(often, pa.list_(pa.int64()))], ["rep", "n", "r", "psig", "rare", "often"])

    return sets.select("rep", "n", "tokens", "hot").mapInArrow(run, "rep bigint, n bigint, r bigint, psig binary, rare binary, often array<bigint>")


def rare_pairs(groups: DataFrame, bits: int) -> DataFrame:
    """Distinct (ga, gb), ga < gb: groups that share a rare prefix token and may be similar by size.

    Tokens of a block of groups are sent by hash range, sorted, with the block's groups once.
    A rare token is in at most HOT groups, so its pairs are few.
    """

    def deal(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                tokens = [unpack(b.as_py()) for b in part.column(2)]
                owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]).astype(np.uint16)
                tokens = coarse(np.concatenate(tokens) if tokens else np.zeros(0, np.uint64), bits)
                order = np.argsort(tokens)
                tokens, owner = tokens[order], owner[order]
                gid, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                rows = []
                for r, s in _split(tokens, bits):
                    used, local = np.unique(owner[s], return_inverse=True)
                    rows.append((r, _within(tokens[s]), local.astype(np.uint16).tobytes(), gid[used].astype(np.int64).tobytes(), n[used].astype(np.int32).tobytes()))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["r", "t", "o", "g", "n"])

    def meet(batches):
        by: dict[int, list] = {}
        for batch in batches:
            for row in zip(*batch.columns):
                r, t, o, g, n = (x.as_py() for x in row)
                own = np.frombuffer(o, np.uint16)
                by.setdefault(r, []).append((np.frombuffer(t, "<u4"), np.frombuffer(g, np.int64)[own], np.frombuffer(n, np.int32)[own]))
        for r in list(by):
            tokens, gid, n = (np.concatenate(x) for x in zip(*by.pop(r)))
            order = np.lexsort((gid, tokens))
            tokens, gid, n = tokens[order], gid[order], n[order].astype(np.int64)
            last, step = len(tokens), 1
            out = []
            while step < last:
                same = np.flatnonzero(tokens[step:] == tokens[:-step])
                if not len(same):
                    break
                a, b = same, same + step
                ok = (100 * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b])) & (gid[a] != gid[b])
                out.append(np.stack([gid[a][ok], gid[b][ok]], axis=1))
                step += 1
            pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["ga", "gb"])

    dealt = groups.filter(F.octet_length("rare") > 0).select("gid", "n", "rare").mapInArrow(deal, "r int, t binary, o binary, g binary, n binary")
    return dealt.repartition((1 << bits) // RANGES_PER_TASK, "r").mapInArrow(meet, "ga bigint, gb bigint").distinct()


def plausible(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The distinct pairs (u, v) whose bitmaps and sizes allow a link, by rows (uid, n, bits)."""

    def run(batches):
        for batch in batches:
            ok = [may_link(a.as_py(), b.as_py(), n.as_py()) for a, b, n in zip(batch.column(2), batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    left = rows.select(F.col("uid").alias("u"), F.col("n").alias("nu"), F.col("bits").alias("a"))
    right = rows.select(F.col("uid").alias("v"), F.col("n").alias("nv"), F.col("bits").alias("b"))
    both = pairs.join(left, "u").join(right, "v").filter(sizes_allow("nu", "nv"))
    return both.select("u", "v", "a", "b", (F.col("nu") + F.col("nv")).alias("n")).mapInArrow(run, "u bigint, v bigint")


def bodies_of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(rep, body): whole sets of the rows at either end of pairs (u, v), written."""
    ends = written(pairs.select(F.explode(F.array("u", "v")).alias("uid")).distinct(), "ends")
    found = written(rows.select("uid", F.concat("low", "high").alias("body")).join(ends, "uid").select(F.col("uid").alias("rep"), "body"), "bodies")
    drop(ends)
    return found


def linked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough, written."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = unpack(x.as_py()), unpack(y.as_py())
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                ok.append(100 * both >= PERCENT * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    sets = bodies_of(pairs, rows)
    left = sets.select(F.col("rep").alias("u"), F.col("body").alias("a"))
    right = sets.select(F.col("rep").alias("v"), F.col("body").alias("b"))
    out = written(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint"), "links")
    drop(sets)
    return out


def sizes_allow(a: str, b: str) -> Column:
    """Whether sets of these sizes (columns) can be similar enough."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def frequent_allow(n: str, r: str, m: str, q: str) -> Column:
    """Whether sets of n and m shingles, r and q of them rare, can link by frequent ones alone.

    They have at most the smaller number of frequent ones in common.
    """
    most = F.least(F.col(n) - F.col(r), F.col(m) - F.col(q))
    return sizes_allow(n, m) & ((100 + PERCENT) * most >= PERCENT * (F.col(n) + F.col(m)))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, named): (uid, doc_id, n, sig) of each row; (sig, comp, least_id) of each set.

    comp is null for a set that has no link; least_id is the smallest doc_id of the set's rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = written(set_rows(docs), "sets")
    members = written(rows.select("uid", "doc_id", "n", "sig"), "members")
    sets = rows.filter("n > 0").groupBy("sig").agg(F.min(F.struct("uid", "n", "n_low")).alias("x"), F.min("doc_id").alias("least_id"))
    sets = written(sets.select(F.col("x.uid").alias("rep"), F.col("x.n").alias("n"), F.col("x.n_low").alias("n_low"), "sig", "least_id"), "distinct")
    bits = range_bits(sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    # Prefixes: from the lower half of the hash range where that has rare shingles enough, else from all.
    hot = hot_tokens(rows, bits).groupBy("uid").agg(F.collect_list(F.struct("tok", "df")).alias("hot")).withColumnRenamed("uid", "rep")
    none = F.array().cast("array<struct<tok:bigint,df:bigint>>")
    known = sets.select("rep", "n", "n_low").join(hot, "rep", "left").withColumn("hot", F.coalesce("hot", none))
    short = F.col("n_low") - F.size("hot") < F.expr(f"n - (({PERCENT} * n + 99) div 100) + 1")
    known = written(known.withColumn("short", short).drop("n_low"), "known")
    release(spark)
    # Their numbers alone are a small table, so that not all whole sets need be dealt out for them.
    few = written(known.filter("short").select("rep"), "short")
    body = lambda column: rows.select(F.col("uid").alias("rep"), column.alias("tokens"))
    tokens = lambda those, keep: those.join(known.filter(keep), "rep").select("rep", "n", "tokens", "hot")
    whole = written(body(F.concat("low", "high")).join(few, "rep"), "whole")
    release(spark)
    found = written(with_prefixes(tokens(body(F.col("low")), "not short").union(tokens(whole, "short")), bits), "prefixes")
    for old in (known, few, whole):
        drop(old)
    release(spark)
    held = F.struct("rep", "r", "rare", "often")
    groups = found.groupBy("psig", "n").agg(F.min_by(held, "rep").alias("x"), F.count(F.lit(1)).alias("size"))
    groups = written(groups.select(F.col("x.rep").alias("gid"), "psig", "n", F.col("x.r").alias("r"), F.col("x.rare").alias("rare"), F.col("x.often").alias("often"), "size"), "groups")
    several = groups.filter("size > 1").select("psig", "n", "gid")
    grouped = written(found.select("rep", "n", "psig").join(several, ["psig", "n"]).select("rep", "gid", "n"), "grouped")
    drop(found)
    release(spark)

    # The candidates: pairs of groups, rows of frequent tokens, members of groups.
    pairs = written(rare_pairs(groups, bits), "pairs")
    often = written(groups.filter(F.size("often") > 0).select("gid", "n", "r", F.explode("often").alias("tok")), "often")
    drop(groups)
    release(spark)
    # Aggregates are written before they are joined back, so that adaptive execution can split a hot key.
    # The set with the largest share of frequent shingles is nearest to what the others are copies of.
    centre = F.max(F.struct(((F.col("n") - F.col("r")) / F.col("n")).alias("share"), (-F.col("gid")).alias("neg"), "n", "r", "gid"))
    pivots = written(often.groupBy("tok").agg(centre.alias("x")), "pivots")
    spokes = often.join(pivots, "tok").select("gid", "n", "r", F.col("x.gid").alias("pid"), F.col("x.n").alias("pn"), F.col("x.r").alias("pr"))
    spokes = spokes.filter((F.col("gid") != F.col("pid")) & frequent_allow("n", "r", "pn", "pr"))
    nearest = pairs.groupBy("gb").agg(F.min("ga").alias("ga")).select(F.col("ga").alias("u"), F.col("gb").alias("v"))
    first = nearest.union(spokes.select(F.least("gid", "pid").alias("u"), F.greatest("gid", "pid").alias("v")))
    first = first.union(grouped.filter("rep <> gid").select(F.col("gid").alias("u"), F.col("rep").alias("v"))).distinct()
    first = written(plausible(first, rows), "first")
    links = linked(first, rows)
    comps = written(components(links), "comps")
    release(spark)

    # What is left: candidates of different classes, group members in place of their leader.
    comp_of = lambda df, node, out: df.join(comps.select(F.col("node").alias(node), F.col("comp").alias(out)), node, "left").withColumn(out, F.coalesce(out, node))
    crowd = comp_of(grouped.select("rep", "gid", "n"), "rep", "c")
    spread = written(crowd.groupBy("gid").agg(F.min("c").alias("lo"), F.max("c").alias("hi")), "spread")
    side = lambda df, g, lo, hi: comp_of(df, g, "_c").join(spread.select(F.col("gid").alias(g), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), g, "left").withColumn(lo, F.coalesce("_lo", "_c")).withColumn(hi, F.coalesce("_hi", "_c")).drop("_c", "_lo", "_hi")
    open_pairs = side(side(pairs, "ga", "la", "ha"), "gb", "lb", "hb").filter(~((F.col("la") == F.col("ha")) & (F.col("lb") == F.col("hb")) & (F.col("la") == F.col("lb"))))
    member = lambda g, out, c: crowd.select(F.col("gid").alias(g), F.col("rep").alias(out), F.col("c").alias(c))

    def expanded(df: DataFrame) -> DataFrame:
        for g, out, c in (("ga", "u", "cu"), ("gb", "v", "cv")):
            df = comp_of(df, g, "_c").join(member(g, out, c), g, "left").withColumn(out, F.coalesce(out, g)).withColumn(c, F.coalesce(c, "_c")).drop("_c")
        return df.filter("cu <> cv").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))

    stray = written(side(often, "gid", "lo", "hi"), "stray")
    mixed = written(stray.groupBy("tok").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).filter("a <> b").select("tok"), "mixed")
    stray = stray.join(mixed, "tok").select("tok", "gid", "n", "r", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("c"))
    stray = written(stray, "open")
    other = stray.select("tok", F.col("gid").alias("gb"), F.col("n").alias("nb"), F.col("r").alias("rb"), F.col("c").alias("cb"))
    meets = (F.col("ga") < F.col("gb")) & F.coalesce(F.col("c") != F.col("cb"), F.lit(True)) & frequent_allow("n", "r", "nb", "rb")
    crossing = stray.withColumnRenamed("gid", "ga").join(other, "tok").filter(meets).select("ga", "gb").distinct()
    split = crowd.join(spread.filter("lo <> hi").select("gid"), "gid")
    within = split.alias("a").join(split.alias("b"), "gid").filter("a.rep < b.rep and a.c <> b.c").select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))
    rest = expanded(open_pairs.select("ga", "gb").union(crossing).distinct()).union(within).distinct()
    rest = written(plausible(rest, rows), "rest")
    more = linked(rest, rows)
    final = components(comps.filter("node <> comp").select(F.col("node").alias("u"), F.col("comp").alias("v")).union(more))
    named = written(sets.join(final, sets["rep"] == final["node"], "left").select("sig", "comp", "least_id"), "named")
    for old in (rows, sets, grouped, pairs, often, pivots, first, links, comps, spread, mixed, stray, rest, more):
        drop(old)
    release(spark)
    return members, named


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (columns doc_id, text).

    component_id is the smallest doc_id among the rows that links reach, the row itself
    included. Null and empty texts, and texts without words, have no shingles, link with
    nothing and are their own class; a text of fewer than five words has one shingle. Equal
    rows and rows of one id are linked like any others. An empty table gives an empty table.
    """
    members, named = classes(docs)
    best = written(named.filter("comp is not null").groupBy("comp").agg(F.min("least_id").alias("component_id")), "best")
    of_sig = named.join(best, "comp", "left").select("sig", F.coalesce("component_id", "least_id").alias("component_id"))
    out = members.filter("n > 0").join(of_sig, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(members.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def with_sets(rows: DataFrame) -> DataFrame:
    """(row, doc_id, sig) of rows (row, doc_id, text): the digest of each row's set, null without shingles."""

    def run(batches):
        for batch in batches:
            for part in textblock.row_blocks(batch, 2):
                grams, first = shingle_sets(part.column(2))
                sig = [hashlib.blake2b(grams[lo:hi].tobytes(), digest_size=16).digest() if hi > lo else None for lo, hi in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sig, pa.binary())], ["row", "doc_id", "sig"])

    return rows.mapInArrow(run, rows.drop("text").withColumn("sig", F.lit(None).cast("binary")).schema)


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: one with the smallest id, its columns unchanged.

    The row that stays is named by its id and its set, since ids may repeat or be null; of rows
    that agree in both, one stays. Rows without shingles are their own class and all stay. Rows
    travel in a struct, so their columns may have any names. An empty table gives an empty one.
    """
    members, named = classes(docs)
    first = F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "sig")).alias("x")
    chosen = named.filter("comp is not null").groupBy("comp").agg(first).select("x.sig", "x.least_id")
    chosen = written(chosen.union(named.filter("comp is null").select("sig", "least_id")), "chosen")
    # An id of one row names that row; only rows of other ids are told apart by their sets again.
    often = members.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"))
    often = written(often.filter("n_rows > 1").select("doc_id"), "repeated")
    stay = members.filter("n > 0").join(chosen.withColumnRenamed("least_id", "doc_id"), ["sig", "doc_id"], "left_semi").select("doc_id")
    stay = stay.union(members.filter("n = 0").select("doc_id")).filter("doc_id is not null")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "doc_id", "text")
    single = rows.join(stay.join(often, "doc_id", "left_anti"), "doc_id", "left_semi")
    unclear = with_sets(rows.join(often, "doc_id", "left_semi").select("row", "doc_id", "text").union(rows.filter("doc_id is null")))
    named_so = F.col("sig").eqNullSafe(F.col("keep")) & F.col("doc_id").eqNullSafe(F.col("least"))
    keep = chosen.select(F.col("sig").alias("keep"), F.col("least_id").alias("least"))
    once = unclear.filter("sig is not null").join(keep, named_so, "left_semi").dropDuplicates(["doc_id", "sig"])
    return single.select("row.*").union(once.select("row.*")).union(unclear.filter("sig is null").select("row.*"))
