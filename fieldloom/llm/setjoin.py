"""N-gram Jaccard join by chosen paths.

Texts become sets of hashed word shingles; equal sets are one class with a representative. Each representative is
embedded by MinHash into a fixed number of tokens, two sets sharing a token with probability equal to their Jaccard
similarity. Sets with equal tokens go the same way everywhere, so one of them goes for all, and the others are connected
to it. A run splits the sets recursively: every node samples one or two of the token positions (1 / threshold on
average) and a set goes to the child of each token it has there, so a pair at the threshold is expected to stay together
once a level. Nodes with few sets are compared by brute force. In a larger one each set is compared with two of them: those
like the first, or the second, or either if the two are like each other, are connected, as in a family of near copies. If at
most ``REST`` sets remain, each of them is compared with every set of the node, which settles it. Nodes with more are split
further, down to ``DEEPEST``. What is still large there is compared block by block.

Independent runs are repeated until the target recall holds. A pair survives fewer levels the deeper its nodes are split,
so the number of runs follows from the depth (``runs_for``): sets that were in a large node of some run, and no others,
get the further runs that the next level asks for. A pair that isn't in large nodes of a level together is settled at
that level or above in each of the runs that level asks for, so its chance to be missed is that level's at most.

Runs need only find one path of links between the members of a connected group: each group is then compared exactly,
on whole shingle sets, in pairs of blocks, where links are counted without being written out. Sets whose sizes differ too
much for a link are in different blocks and these aren't paired. Groups are connected by spanning edges, the blocks'
results are summed, and groups that exact similarity doesn't hold together fall apart.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldloom.llm.shared import discard, staged

WORDS, SIMILAR = 5, 0.8
TOKENS, RUNS, FIRST, DEEPEST, SMALL, BLOCK, REST = 64, 8, 3, 9, 64, 512, 512
#: Words whose hashes a worker remembers, and edges that a task reduces to a forest.
MEMO, EDGES = 100_000, 1_000_000
#: Shingles that a block of sets holds at most or so.
SHINGLES = 500_000
#: Recall of a pair at the threshold, at any depth. No depth has fewer than RUNS runs.
TARGET = 0.995
_SPLIT = re.compile(r"\w+").findall
_A = np.frombuffer(b"".join(xxhash.xxh3_64_digest(f"multiplier {i}") for i in range(TOKENS)), "<u8") | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Tokens that must agree: four deviations below the threshold.
_LEAST = TOKENS * SIMILAR - 4 * (TOKENS * SIMILAR * (1 - SIMILAR)) ** 0.5


def word_hashes(text: str, memo: dict[str, int]) -> np.ndarray:
    words = _SPLIT(text.lower())
    for w in set(words).difference(memo):
        memo[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, memo: dict[str, int]) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the five-word shingles; a shorter text is one shingle, one without words none."""
    h = word_hashes(text or "", memo)
    if len(memo) > MEMO:
        memo.clear()
    if not len(h):
        return np.zeros(0, np.uint32)
    n = max(1, len(h) - WORDS + 1)
    acc = np.full(n, len(h) if len(h) < WORDS else 0, np.uint64)
    for k in range(min(WORDS, len(h))):
        acc = (acc ^ h[k : k + n]) * _MIX
        acc ^= acc >> np.uint64(29)
    return np.unique((acc >> np.uint64(16)).astype(np.uint32))


def tokens(items: np.ndarray) -> np.ndarray:
    """MinHash tokens, one for each position."""
    x = items.astype(np.uint64) * _MIX
    x ^= x >> np.uint64(31)
    out = np.empty(TOKENS, np.uint32)
    for i in range(TOKENS):
        out[i] = ((x * _A[i]) >> np.uint64(32)).min()
    return out


def children(node: int, sig: np.ndarray) -> list[int]:
    """The child nodes a set goes to: positions depend on the node alone, children on the set's tokens there."""
    h = xxhash.xxh3_64_intdigest(node.to_bytes(8, "little"))
    spots = [h % TOKENS]
    if (h >> 16) % 10_000 < (1 / SIMILAR - 1) * 10_000:
        spots.append((spots[0] + 1 + (h >> 40) % (TOKENS - 1)) % TOKENS)
    return [xxhash.xxh3_64_intdigest(node.to_bytes(8, "little") + bytes([i]) + sig[i].tobytes()) for i in spots]


def missed(depth: int, runs: int) -> float:
    """Probability that ``runs`` runs of ``depth`` levels all miss a pair at the threshold, over the spread of its tokens."""
    total, two = 0.0, 1 / SIMILAR - 1
    for k in range(TOKENS + 1):
        both = k * (k - 1) / (TOKENS * (TOKENS - 1))
        one = 2 * (k / TOKENS - both)
        lost = 0.0  # that no node below holds both
        for _ in range(depth):
            lost = (1 - two) * (1 - k / TOKENS + k / TOKENS * lost) + two * (1 - one - both + one * lost + both * lost**2)
        total += math.comb(TOKENS, k) * SIMILAR**k * (1 - SIMILAR) ** (TOKENS - k) * (lost**runs if k >= _LEAST else 1)
    return total


@functools.cache
def runs_for(depth: int, target: float) -> int:
    for runs in range(RUNS, 400):
        if missed(depth, runs) <= 1 - target:
            return runs
    raise ValueError(f"no recall of {target} with {TOKENS} tokens")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sets(df: DataFrame, key: str, text: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            a, b, n, sig = [], [], [], []
            for t in batch.column(1):
                s = shingles(t.as_py(), memo)
                raw = s.tobytes()
                h = xxhash.xxh3_128_intdigest(raw)
                a.append(_signed(h >> 64))
                b.append(_signed(h & (1 << 64) - 1))
                n.append(len(s))
                sig.append(tokens(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary())], ["id", "a", "b", "n", "sig"])

    return df.select(F.col(key).cast("long").alias("id"), text).mapInArrow(work, "id long, a long, b long, n int, sig binary")


def _with_shingles(df: DataFrame) -> DataFrame:
    """From (id, text) to (id, a, b, raw): the digest of the shingle set and its sorted hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            raw = [shingles(t.as_py(), memo).tobytes() for t in batch.column(1)]
            h = [xxhash.xxh3_128_intdigest(x) for x in raw]
            a, b = [_signed(x >> 64) for x in h], [_signed(x & (1 << 64) - 1) for x in h]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(raw, pa.binary())], ["id", "a", "b", "raw"])

    return df.select("id", "text").mapInArrow(work, "id long, a long, b long, raw binary")


def _like_pivots(df: DataFrame) -> DataFrame:
    """From (node, id, sig, lo, hi, lo_sig, hi_sig) to (node, id, lo, hi, near): bit 1 if the set is like lo, bit 2 if
    it is like hi, by as many equal tokens as a pair needs that may be a link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, lo, hi = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, TOKENS) for c in ("sig", "lo_sig", "hi_sig"))
            near = ((own == lo).sum(1) >= _LEAST) + 2 * ((own == hi).sum(1) >= _LEAST)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "id", "lo", "hi")), pa.array(near.astype(np.int32))], ["node", "id", "lo", "hi", "near"])

    return df.mapInArrow(work, "node long, id long, lo long, hi long, near int")


def _descend(df: DataFrame, levels: int = 1, runs: range | None = None) -> DataFrame:
    """From (id, sig) to the nodes ``levels`` below the roots of ``runs``, or from (node, id, sig) that far down."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, ids = batch.column("sig").to_pylist(), batch.column("id").to_pylist()
            above = [[xxhash.xxh3_64_intdigest(f"run {r}") for r in runs]] * len(ids) if runs is not None else [[x & (1 << 64) - 1] for x in batch.column("node").to_pylist()]
            nodes, owner = [], []
            for i, s, at in zip(ids, sigs, above, strict=True):
                sig = np.frombuffer(s, "<u4")
                for _ in range(levels):
                    at = [c for x in at for c in children(x, sig)]
                nodes += map(_signed, at)
                owner += [i] * len(at)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(owner, pa.int64())], ["node", "id"])

    return df.mapInArrow(work, "node long, id long")


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A star for each component of the graph: (least vertex, vertex). Stars of the same members agree whichever pairs
    they come from, so that repeated runs over a large group yield few different edges."""
    top = list(range(n))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = root(i), root(j)
        if a != b:
            top[max(a, b)] = min(a, b)
    return [(root(x), x) for x in range(n) if root(x) != x]


def _likely(pdf: pd.DataFrame) -> pd.DataFrame:
    """Connecting edges of the pairs whose tokens agree often enough (four deviations below the threshold)."""
    pdf = pdf.sort_values("id")
    ids, sig = pdf["id"].to_numpy(), np.stack([np.frombuffer(s, "<u4") for s in pdf["sig"]])
    agree = np.zeros((len(ids), len(ids)), np.int16)
    for i in range(TOKENS):
        agree += sig[:, i, None] == sig[None, :, i]
    edges = _forest(len(ids), *np.nonzero(np.triu(agree >= _LEAST, 1)))
    return pd.DataFrame([(ids[i], ids[j]) for i, j in edges], columns=["u", "v"]).astype("int64")


def _likely_small(df: DataFrame) -> DataFrame:
    """The same edges for (node, id, sig) of nodes with at most SMALL members: a node is one row with the list of its
    members, and an Arrow batch of nodes is worked off without a data frame for each."""
    lists = df.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("id", "sig"))).alias("m")).select("m.id", "m.sig")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, u, v = np.cumsum([0, *(len(x) for x in batch.column("id"))]), [], []
            ids = batch.column("id").flatten().to_numpy()
            sig = np.frombuffer(b"".join(batch.column("sig").flatten().to_pylist()), "<u4").reshape(-1, TOKENS)
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                part = sig[lo:hi]
                agree = (part[:, None, :] == part[None, :, :]).sum(2)
                left, right = np.nonzero(np.triu(agree >= _LEAST, 1))
                for i, j in _forest(hi - lo, left, right) if len(left) else ():
                    u.append(ids[lo + i])
                    v.append(ids[lo + j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return lists.mapInArrow(work, "u long, v long")


def _likely_rest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Connecting edges of the likely pairs between the remaining sets of a node (``left``) and all sets of a block of it."""
    pdf = pdf.sort_values("id")
    ids, sig, left = pdf["id"].to_numpy(), np.stack([np.frombuffer(s, "<u4") for s in pdf["sig"]]), np.flatnonzero(pdf["left"])
    agree = np.zeros((len(left), len(ids)), np.int16)
    for i in range(TOKENS):
        agree += sig[left, i, None] == sig[None, :, i]
    agree[np.arange(len(left)), left] = 0
    u, v = np.nonzero(agree >= _LEAST)
    edges = _forest(len(ids), left[u], v)
    return pd.DataFrame([(ids[i], ids[j]) for i, j in edges], columns=["u", "v"]).astype("int64")


def _rest_pairs(df: DataFrame) -> DataFrame:
    """Edges of nodes (node, id, sig, left, n_group) with few sets marked ``left``, which go to each block of their node."""
    blocks = F.ceil(F.col("n_group") / (8.0 * BLOCK)).cast("long")
    own = F.array(F.pmod(F.xxhash64("id"), blocks))
    dealt = df.withColumn("block", F.explode(F.when(F.col("left"), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(own)))
    return dealt.select("node", "block", "id", "sig", "left").groupBy("node", "block").applyInPandas(_likely_rest, "u long, v long")


def _exact(pdf: pd.DataFrame) -> pd.DataFrame:
    """For a pair of blocks of a group: links of each member across the pair, and spanning edges (rows with a null)."""
    pdf = pdf.sort_values("id")
    lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
    ids, block = pdf["id"].to_numpy(), pdf["block"].to_numpy()
    sets = [np.frombuffer(x, "<u4") for x in pdf["raw"]]
    size = np.array([len(s) for s in sets], float)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable").astype(np.int32)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), size.astype(int))[order]
    flat = flat[order]
    fresh = np.append(True, flat[1:] != flat[:-1])
    words, col = flat[fresh], np.cumsum(fresh, dtype=np.int32) - 1
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(words), 4096):
        a, b = np.searchsorted(col, [at, at + 4096])
        held = np.zeros((len(sets), min(4096, len(words) - at)), np.float32)
        held[row[a:b], col[a:b] - at] = 1
        common += held @ held.T
    linked = common >= SIMILAR * (size[:, None] + size[None, :] - common) - 1e-6
    np.fill_diagonal(linked, False)
    forest = _forest(len(ids), *np.nonzero(np.triu(linked, 1)))
    if lo != hi:
        linked &= block[:, None] != block[None, :]
    count = linked.sum(1)
    some, u, v = np.flatnonzero(count), [i for i, _ in forest], [j for _, j in forest]
    ends = pd.array([*ids[v]], "Int64") if v else pd.array([], "Int64")
    return pd.DataFrame({"u": np.concatenate([ids[some], ids[u] if u else ids[:0]]), "v": pd.array([pd.NA] * len(some) + [*ends], "Int64"), "links": np.concatenate([count[some], np.zeros(len(u), np.int64)]).astype("int64")})


def _block_pairs(df: DataFrame, group: str, size: int) -> DataFrame:
    """Rows (with ``n_group`` members in their group) dealt into blocks of about ``size`` and sent to each pair of blocks."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_group") / size).cast("int"))
    df = df.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("long")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
    return df.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other")


#: Blocks of one range of sizes are numbered in a span of so many.
_SPAN = 1 << 32


def _sized_pairs(df: DataFrame, size: int) -> DataFrame:
    """Rows (root, id, n) sent to the pairs of blocks whose sizes allow a link. A range of sizes reaches to 1 / SIMILAR
    times its least size, so linked sets are in one range or in neighbouring ones. Some pairs of ranges hold no two rows."""
    df = df.withColumn("range", F.floor(F.log(F.col("n").cast("double")) / math.log(1 / SIMILAR) + 1e-9))
    held = df.groupBy("root", "range").agg(F.greatest(F.ceil(F.count("*") / F.lit(float(size))), F.ceil(F.sum("n") / F.lit(float(SHINGLES)))).alias("blocks"))
    beside = [held.select("root", (F.col("range") - d).alias("range"), F.lit(d).alias("d"), "blocks") for d in (-1, 0, 1)]
    beside = beside[0].union(beside[1]).union(beside[2]).groupBy("root", "range").agg(*(F.coalesce(F.max(F.when(F.col("d") == d, F.col("blocks"))), F.lit(0)).alias(f"b{d + 1}") for d in (-1, 0, 1)))
    df = df.join(beside.filter("b1 > 0"), ["root", "range"])
    own = F.col("range") * _SPAN + F.pmod(F.xxhash64("id"), F.col("b1"))

    def beside_of(d: int) -> Column:
        first = (F.col("range") + d) * _SPAN
        return F.when(F.col(f"b{d + 1}") > 0, F.sequence(first, first + F.greatest(F.col(f"b{d + 1}") - 1, F.lit(0)))).otherwise(F.array().cast("array<long>"))

    spots = [beside_of(d) for d in (-1, 0, 1)]
    df = df.withColumn("block", own).withColumn("other", F.explode(F.concat(*spots)))
    return df.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "range", "b0", "b1", "b2")


def _local_forest(edges: DataFrame) -> DataFrame:
    """Edges that connect the same vertices, fewer: each task keeps a forest of its EDGES edges or so."""
    tasks = max(1, -(-edges.count() // EDGES))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        ends = np.concatenate([np.concatenate(x) for x in held]) if held else np.zeros(0, np.int64)
        ids, at = np.unique(ends, return_inverse=True)
        starts = np.cumsum([0, *(2 * len(u) for u, _ in held)])
        left = np.concatenate([at[i : i + len(u)] for i, (u, _) in zip(starts, held, strict=False)]) if held else at
        right = np.concatenate([at[i + len(u) : i + 2 * len(u)] for i, (u, _) in zip(starts, held, strict=False)]) if held else at
        kept = np.array(_forest(len(ids), left, right), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids[kept[:, 0]]), pa.array(ids[kept[:, 1]])], ["u", "v"])

    return edges.select("u", "v").coalesce(tasks).mapInArrow(work, "u long, v long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, root): the least id of each vertex's connected component; every round is written, so lineage stays short.
    Labels only fall, so the rounds end; as labels jump to the labels of labels, they are few."""
    both = staged(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    old = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).select(F.col("u").alias("id"), "root"), f"{name}-0")
    moved, i = True, 0
    while moved:
        i += 1
        label = old.select("id", "root")
        seen = both.join(label.select(F.col("id").alias("v"), "root"), "v").groupBy(F.col("u").alias("id")).agg(F.min("root").alias("r"))
        least = label.join(seen, "id").select("id", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        jump = least.select(F.col("id").alias("root"), F.col("root").alias("up"))
        new = staged(least.join(jump, "root", "left").select("id", F.least("root", F.coalesce("up", "root")).alias("root"), "was"), f"{name}-{i}")
        moved = not new.filter("root <> was").isEmpty()
        discard(old)
        old = new
    discard(both)
    return old.select("id", "root")


def _candidates(reps: DataFrame, same: DataFrame, target: float) -> DataFrame:
    """Edges (u, v) that connect the sets (id, sig) which may be linked, beside those known before (``same``): the runs, level
    by level."""
    runs = runs_for(FIRST, target)

    def compared(nodes: DataFrame, large: DataFrame, name: str) -> DataFrame:
        """The sets of ``large`` nodes (node, lo, hi), each against both."""
        pivots = large.select("node", "lo", "hi").join(reps.select(F.col("id").alias("lo"), F.col("sig").alias("lo_sig")), "lo").join(reps.select(F.col("id").alias("hi"), F.col("sig").alias("hi_sig")), "hi")
        return staged(_like_pivots(nodes.join(pivots, "node").join(reps, "id").select("node", "id", "sig", "lo", "hi", "lo_sig", "hi_sig")), name)

    def stars(judged: DataFrame) -> DataFrame:
        sides = [judged.filter((F.col("near").bitwiseAND(bit) > 0) & (F.col("id") != F.col(side))).select(F.least(F.col(side), F.col("id")).alias("u"), F.greatest(F.col(side), F.col("id")).alias("v")) for side, bit in (("lo", 1), ("hi", 2))]
        return sides[0].union(sides[1])

    nodes = staged(_descend(reps, FIRST, range(runs)), "nodes")
    found: list[DataFrame] = [staged(same, "same")]
    for depth in range(FIRST, DEEPEST + 1):
        sizes = nodes.groupBy("node").agg(F.count("*").alias("n_group"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("n_group > 1")
        few = nodes.join(sizes.filter(f"n_group <= {SMALL}"), "node").join(reps, "id").select("node", "id", "sig")
        judged = compared(nodes, sizes.filter(f"n_group > {SMALL}"), f"pivots-{depth}")
        # The sets like a pivot are connected to it, and all are if the pivots are alike (so each has both bits).
        apart = [F.sum((F.col("near").bitwiseAND(bit) == 0).cast("long")) for bit in (1, 2, 3)]
        one = F.max(F.when(F.col("id") == F.col("lo"), F.col("near"))) == 3
        state = judged.groupBy("node").agg(F.count("*").alias("n_group"), one.alias("one"), *(x.alias(f"apart_{bit}") for bit, x in zip((1, 2, 3), apart, strict=True)))
        state = state.withColumn("side", F.when(F.col("one"), 3).when(F.col("apart_1") <= F.col("apart_2"), 1).otherwise(2))
        state = staged(state.withColumn("rest", F.when(F.col("one"), F.col("apart_3")).otherwise(F.least("apart_1", "apart_2"))).select("node", "n_group", "side", "rest"), f"states-{depth}")
        nearly = judged.select("node", "id", "near").join(state.filter(f"rest BETWEEN 1 AND {REST}"), "node")
        nearly = nearly.withColumn("left", F.col("near").bitwiseAND(F.col("side")) == 0).join(reps, "id")
        got = _likely_small(few).union(stars(judged)).union(_rest_pairs(nearly.select("node", "id", "sig", "left", "n_group")))
        large = judged.select("node", "id").join(state.filter(f"rest > {REST}").select("node", "n_group"), "node")
        if depth == DEEPEST:
            blocks = _block_pairs(large.join(reps, "id"), "node", BLOCK)
            found.append(staged(got.union(blocks.groupBy("node", "lo", "hi").applyInPandas(_likely, "u long, v long")).distinct(), f"edges-{depth}"))
            discard(nodes, judged, state)
            break
        found.append(staged(got.distinct(), f"edges-{depth}"))
        below = _descend(large.join(reps, "id").select("node", "id", "sig"))
        if (more := runs_for(depth + 1, target)) > runs:
            below = below.union(_descend(large.select("id").distinct().join(reps, "id").select("id", "sig"), depth + 1, range(runs, more)))
            runs = more
        deeper = staged(below.distinct(), f"nodes-{depth}")
        discard(nodes, judged, state)
        nodes = deeper
        if nodes.isEmpty():
            discard(nodes)
            break
    out = staged(_local_forest(functools.reduce(DataFrame.union, found)), "edges")
    discard(*found)
    return out


def jaccard_join(df: DataFrame, key: str = "doc_id", text: str = "text", target: float = TARGET) -> DataFrame:
    """One row per input row: ``key``, class_id, links, group_id, n_shingles.

    ``target`` is the least probability to find a pair at the threshold that no other pairs connect.

    class_id is the least key among documents of equal shingle sets (copies, up to case and punctuation), links the
    number of *other classes* with a Jaccard similarity of at least 0.8, and group_id the least key of the connected
    group. Documents without a word (null, empty, punctuation) have no shingle, are a class of their own by key and have
    no links. A null key stays null and is the least of none; where all keys of a class or group are null, so is its id.
    Repeated rows are members of their class each; classes of different texts under one key keep apart but share its
    class_id. Empty tables give no rows; other columns play no part. Jobs are run while the plan is built.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sets = staged(_sets(rows, "id", "text"), "sets")
    full = sets.filter("n > 0")
    # Inside, a class has a number of its own; it is written, so it stays.
    classes = staged(full.groupBy("a", "b", "n").agg(F.min("id").alias("class_id"), F.first("sig").alias("sig")).withColumn("no", F.monotonically_increasing_id()), "classes")
    alike = staged(classes.groupBy("sig").agg(F.min("no").alias("id"), F.count("*").alias("c")), "alike")
    same = classes.join(alike.filter("c > 1").select("sig", F.col("id").alias("u")), "sig").filter("no > u").select("u", F.col("no").alias("v"))
    edges = _candidates(alike.select("id", "sig"), same, target)
    near = components(edges, "near")
    discard(edges, alike)
    marked = near.join(classes.select(F.col("no").alias("id"), "a", "b", "n", "class_id"), "id").withColumnRenamed("id", "no")
    # Of several rows with the representative's key, any whose set is the class's will do.
    wanted = marked.select(F.col("class_id").alias("want")).distinct()
    body = _with_shingles(rows.join(wanted, F.col("id").eqNullSafe(F.col("want")), "left_semi"))
    body = staged(body.select("a", "b", "raw").join(marked.select("no", "a", "b", "n", "root"), ["a", "b"]).select(F.col("no").alias("id"), "root", "n", "raw").dropDuplicates(["id"]), "bodies")
    exact = staged(_sized_pairs(body, BLOCK).groupBy("root", "lo", "hi").applyInPandas(_exact, "u long, v long, links long"), "links")
    links = exact.filter("v IS NULL").groupBy(F.col("u").alias("no")).agg(F.sum("links").alias("links"))
    named = components(_local_forest(exact.filter("v IS NOT NULL")), "group").select(F.col("id").alias("no"), "root").join(classes.select("no", "class_id"), "no")
    least = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
    groups = named.select("no", "root").join(least, "root").select("no", "group_id", F.lit(True).alias("grouped"))
    of = staged(classes.select("no", "a", "b", "n", "class_id").join(links, "no", "left").join(groups, "no", "left"), "known")
    discard(body, exact)
    # A class may hold a third of all rows: the many rows are dealt by id first, the class side goes to each of 16 salts.
    salted = full.select("id", "a", "b", "n").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)))
    wide = of.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    out = salted.join(wide, ["a", "b", "n", "salt"]).select("id", "class_id", "links", F.when(F.col("grouped"), F.col("group_id")).otherwise(F.col("class_id")).alias("group_id"), "n")
    out = out.unionByName(sets.filter("n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links"), F.col("id").alias("group_id"), "n"))
    return out.select(F.col("id").alias(key), "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"), "group_id", F.col("n").alias("n_shingles"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, links, group_id, n_shingles of every document; see ``jaccard_join`` for odd rows."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
