"""Problem 6: the k most similar vectors of every vector, by a hash-prefix forest.

Every tree gives each vector a string of 63 random-hyperplane signs; the sorted strings are the tree. A query descends to
the strings with which it shares the longest prefix and then ascends all trees together, one sign at a time, until they hold
``BUDGET * sqrt(n)`` candidates between them; the depth at which that is so differs from vector to vector. Down to depth
``TOP`` the number of strings under every prefix is counted over all vectors in one pass (a table of fixed size, broadcast),
so a vector knows its depth before anything is shuffled. Where all vectors are not asked for, ``probes`` further strings of a query with
its least certain signs turned are looked up as well.

A tree is cut into slices at prefixes: a slice is the largest subtree of at most ``SLICE_ROWS`` strings, so the strings that share
a prefix with a query lie in its slice; the ascent ends at a slice's root. Only (slice, string, id, sketch) is shuffled, the sketch
being 192 or 256 further signs. Within a slice a query finds its prefix by binary search, looks at least at its even share of the budget (``WINDOW``
strings at most), and passes on those whose sketch is near enough to its own: for a threshold on the cosine, ``DEVIATIONS`` standard deviations
beyond the distance expected at it; without one, the nearest ``PASS`` of random pairs (30 k / n in a small table) as measured on a bounded sample (``SAMPLE``
vectors). Vectors are fetched for these pairs only, and cosines computed in double precision.

A vector that meets more than half such a share of strings as near as that (as a cosine of ``DENSE``, without a threshold)
stands in a dense group, most of which would lie outside every window; it is compared with all vectors, by block products.

Vectors equal component by component are searched once: only the k + 1 smallest ids of each such group can be
neighbours of anything, and its other members take their neighbours from it.

Accuracy against brute force is measured in the README and the tests (0.9 is the floor; cosines and ties are exact).

Defined results for awkward input: null, all-zero, NaN, infinite and wrongly sized vectors take no part; repeated rows count
once (one id with two vectors: the one with the smaller hash stays); an empty table gives an empty result; extra columns are ignored. Ids
are below 2^55 in size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselle.llm.bounds import broadcast_if_small
from tesselle.session import cut

DIM = 64
TREES = 12  # enough for neighbours of a cosine of 0.9 and more
WIDE_TREES = 32  # for neighbours however far
PROBES = 8
BITS = 63
TOP = 16
WORDS = 3  # of 64 signs, in a sketch where a threshold on the cosine is given
WIDE_WORDS = 4
DEVIATIONS = 3.0
BUDGET = 26.0
WINDOW = 512
LEAST_WINDOW = 32
SLICE_ROWS = 32_768
DENSE = 0.6
PASS = 0.008
SAMPLE = 4096
BLOCK_ROWS = 32_768
BROADCAST_ROWS = 1_000_000
# Which of the least certain signs a further string turns.
TURNS = [(0,), (1,), (2,), (0, 1), (0, 2), (3,), (1, 2)]
TURN_AMONG = 10


def _row(words: int) -> str:
    return "slice bigint, key bigint, meta bigint" + "".join(f", s{i} bigint" for i in range(words))



class Forest:
    """The hash functions: strings of every tree and the sketch of a batch of vectors."""

    def __init__(self, dim: int, trees: int, words: int = 0):
        self.dim, self.trees = dim, trees
        rng = np.random.default_rng(20_251)
        self.planes = rng.standard_normal((dim, trees * BITS)).astype(np.float32)
        self.further = rng.standard_normal((dim, 64 * words)).astype(np.float32)
        self.weight = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)

    def unit(self, column) -> np.ndarray:
        x = np.asarray(column.flatten()).reshape(-1, self.dim).astype(np.float32)
        return x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x

    def signs(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.planes).reshape(len(x), self.trees, BITS)

    def strings(self, signs: np.ndarray) -> np.ndarray:
        return (signs > 0) @ self.weight

    def sketches(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.further > 0, axis=1).view(np.int64)

    def turned(self, signs: np.ndarray, keys: np.ndarray, probes: int) -> np.ndarray:
        """(vector, tree, probe): the further strings, the least certain of the first signs turned."""
        order = np.argsort(np.abs(signs[:, :, :TURN_AMONG]), axis=2)
        out = [np.bitwise_xor.reduce(self.weight[order[:, :, list(t)]], axis=2) ^ keys for t in TURNS[:probes]]
        return np.stack(out, axis=2) if out else np.zeros((*keys.shape, 0), np.int64)


def _count(dim: int, trees: int):
    """How many strings of each tree lie under each prefix of TOP signs, one compressed row a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, total = Forest(dim, trees), np.zeros((trees, 1 << TOP), np.uint32)
        for b in batches:
            x = forest.unit(b.column(1))
            if len(x):
                cell = forest.strings(forest.signs(x)) >> (BITS - TOP)
                total += np.bincount((cell + (np.arange(trees) << TOP)).reshape(-1), minlength=trees << TOP).reshape(trees, -1).astype(np.uint32)
        if total.any():
            yield _packed(total)

    return run


def _packed(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([zlib.compress(t.tobytes(), 1) for t in total], pa.binary())], names=["tree", "counts"])


def _add(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, 1 << TOP), np.uint32)
        for b in batches:
            for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[t] += np.frombuffer(zlib.decompress(c), np.uint32)
        if total.any():
            yield _packed(total)

    return run


def prefix_counts(reps: DataFrame, dim: int, trees: int) -> np.ndarray:
    """(trees, 2^TOP) counts over all vectors; tasks' tables are added up in tasks before the last few reach the driver."""
    counts = reps.select("id", "embedding").mapInArrow(_count(dim, trees), "tree int, counts binary")
    rows = counts.repartition(4).mapInArrow(_add(trees), "tree int, counts binary").collect()
    total = np.zeros((trees, 1 << TOP), np.uint32)
    for r in rows:
        total[r["tree"]] += np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint32)
    return total


class Top:
    """The counted top of every tree: the depth of a query, and the slices."""

    def __init__(self, counts: np.ndarray, budget: int):
        self.budget, self.levels = budget, [counts.astype(np.int64)]
        for _ in range(TOP):
            self.levels.append(self.levels[-1].reshape(len(counts), -1, 2).sum(axis=2))
        self.levels.reverse()  # levels[d]: (trees, 2^d)
        cells = np.arange(1 << TOP)
        self.root = np.full(counts.shape, TOP, np.int64)
        for d in range(TOP - 1, -1, -1):
            self.root = np.where(self.levels[d][:, cells >> (TOP - d)] <= SLICE_ROWS, d, self.root)
        self.salts = -(-self.levels[TOP] // SLICE_ROWS)  # above 1 only where the whole prefix is too many

    def depths(self, cells: np.ndarray) -> np.ndarray:
        """The deepest level at which all trees together hold the budget, from cells (vector, tree, string)."""
        trees = np.arange(cells.shape[1])[None, :, None]
        depth = np.zeros(len(cells), np.int64)
        for d in range(1, TOP + 1):
            depth[self.levels[d][trees, cells >> (TOP - d)].sum(axis=(1, 2)) >= self.budget] = d
        return depth

    def slices(self, tree: np.ndarray, cell: np.ndarray, salt: np.ndarray) -> np.ndarray:
        d = self.root[tree, cell]
        return (((tree << 22) | (d << 17) | (cell >> (TOP - d))) << 20) | (salt % np.maximum(1, self.salts[tree, cell]))


def _rows(dim: int, trees: int, probes: int, words: int, budget: int, shared):
    """id, vector, asked -> one row a tree, and one a further string of an asked vector; meta packs id, depth, asked and indexed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, top = Forest(dim, trees, words), Top(shared.value, budget)
        for b in batches:
            x = forest.unit(b.column(1))
            if not len(x):
                continue
            ids, asked = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            signs = forest.signs(x)
            keys, sketch = forest.strings(signs), forest.sketches(x)
            every = np.concatenate([keys[:, :, None], forest.turned(signs, keys, probes - 1)], axis=2) if probes > 1 else keys[:, :, None]
            depth = top.depths(every >> (BITS - TOP))
            n, t, p = every.shape
            use = np.ones((n, t, p), bool)
            use[:, :, 1:] = asked.astype(bool)[:, None, None]
            i, j, s = np.nonzero(use)
            key = every[i, j, s]
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
            at = top.slices(j, key >> (BITS - TOP), salt[i])
            meta = (ids[i] << 7) | (depth[i] << 2) | (asked[i] << 1) | (s == 0)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (at, key, meta, *sketch[i].T)], names=["slice", "key", "meta", *(f"s{c}" for c in range(words))])

    return run


def _search(limit: int, dense_at: int, budget: int, window: int):
    """Rows sorted by (slice, key): the pairs (a asked, b) whose sketches are at most ``limit`` apart among those with a's prefix, and
    (a, null) for a vector in a dense group."""

    def flush(key, meta, *sketch):
        index = np.flatnonzero(meta & 1)
        same = np.zeros(len(index), bool)  # a repeated row
        same[1:] = (key[index[1:]] == key[index[:-1]]) & (meta[index[1:]] == meta[index[:-1]])
        index = index[~same]
        sketch = [x.view(np.uint64) for x in sketch]
        ikey, iid, held_asked, held_by = key[index], meta[index] >> 7, meta[index] & 2, [x[index] for x in sketch]
        asked = np.flatnonzero(meta & 2)
        if not len(asked) or not len(index):
            return None
        k, q, depth = key[asked], meta[asked] >> 7, (meta[asked] >> 2) & 31
        shift = BITS - depth
        low = (k >> shift) << shift
        pos = np.searchsorted(ikey, k)
        lo = np.searchsorted(ikey, low)
        hi = np.searchsorted(ikey, low | ((np.int64(1) << shift) - 1), side="right")
        half = max(window, budget) // 2
        lo = np.maximum(0, np.clip(lo, pos - half, pos - window // 2))
        hi = np.minimum(len(ikey), np.clip(hi, pos + window // 2, pos + half))
        out, dense = [], []
        for a in range(0, len(asked), 64):
            z = slice(a, a + 64)
            x, y = lo[z].min(), hi[z].max()
            rows = asked[z]
            first = np.zeros((len(rows), y - x), np.uint8)  # two words first: what is too far apart in them is so in all
            for mine, theirs in zip(sketch[:2], held_by[:2]):
                first += np.bitwise_count(mine[rows, None] ^ theirs[None, x:y])
            first[iid[None, x:y] == q[z, None]] = 255
            first = first.reshape(-1)
            at = np.flatnonzero(first <= min(limit, 254))
            i, j = np.divmod(at, y - x)
            apart = first[at].astype(np.int64)
            for mine, theirs in zip(sketch[2:], held_by[2:]):
                apart += np.bitwise_count(mine[rows[i]] ^ theirs[x + j])
            close = apart <= limit
            many = np.bincount(i[close & (apart <= dense_at)], minlength=len(rows)) > window // 2
            if many.any():
                dense.append(q[z][many])
                close &= ~many[i]
            i, j = i[close], j[close]
            one, other = q[z][i], iid[x + j]
            turn = (held_asked[x + j] > 0) & (other < one)  # a pair that is met from both sides is one
            out.append(np.stack([np.where(turn, other, one), np.where(turn, one, other)]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1)
        dense = np.unique(np.concatenate(dense)) if dense else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[0], dense])), pa.concat_arrays([pa.array(pairs[1]), pa.nulls(len(dense), pa.int64())])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            s = columns[0]
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1), len(s)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if held and s[lo] != last:
                    got = flush(*(np.concatenate(c) for c in zip(*held)))
                    held = []
                    if got is not None:
                        yield got
                last = s[lo]
                held.append([c[lo:hi] for c in columns[1:]])
        if held:
            got = flush(*(np.concatenate(c) for c in zip(*held)))
            if got is not None:
                yield got

    return run


def _cosines(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.asarray(b.column(c).flatten()).reshape(-1, dim).astype(np.float64) for c in (2, 3))
            if len(x):
                x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(np.einsum("ij,ij->i", x, y), 9))], names=["a", "b", "cosine"])

    return run


def _sketch_limit(reps: DataFrame, n: int, k: int, dim: int, words: int, least: float) -> tuple[int, int]:
    """How far apart the sketches of a candidate may be, and of a member of a dense group."""

    def beyond(cosine: float, deviations: float) -> int:
        p = math.acos(cosine) / math.pi
        return math.floor(64 * words * p + deviations * math.sqrt(64 * words * p * (1 - p)))

    if least > 0:
        limit = beyond(min(least, 1.0), DEVIATIONS)
        return limit, limit
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    rows = reps.select("embedding").where(h <= int((1 << 30) * min(1.0, 2 * SAMPLE / max(1, n)))).limit(SAMPLE).collect()
    if len(rows) < 2:
        return 64 * words, beyond(DENSE, 0)
    forest = Forest(dim, 0, words)
    x = np.array([r["embedding"] for r in rows], np.float32)
    s = forest.sketches(x / np.abs(x).max(axis=1, keepdims=True)).view(np.uint64)
    a, b = s[: len(s) // 2], s[len(s) // 2 :]
    apart = sum(np.bitwise_count(a[:512, None, c] ^ b[None, :, c]).astype(int) for c in range(words))
    return max(int(np.quantile(apart, min(1.0, max(PASS, 30 * k / n)))), beyond(DENSE, 1.5)), beyond(DENSE, 0)


def _compare(dim: int, k: int, least: float):
    """Rows sorted by (cell, role): the best k of each vector of role 0 among all those of role 1 in its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, x, best = -1, np.zeros(0, np.int64), np.zeros((0, dim)), None

        def emit():
            a, b, s = best
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(b), pa.array(s)], names=["a", "b", "cosine"])

        for batch in batches:
            c, role, i = (batch.column(n).to_numpy() for n in range(3))
            e = np.asarray(batch.column(3).flatten()).reshape(-1, dim).astype(np.float64)
            e /= np.linalg.norm(e, axis=1, keepdims=True)
            mark = c.astype(np.int64) * 2 + role
            cuts = [0, *(np.flatnonzero(mark[1:] != mark[:-1]) + 1), len(mark)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if c[lo] != cell:
                    if best is not None and len(best[0]):
                        yield emit()
                    cell, ids, x = c[lo], np.zeros(0, np.int64), np.zeros((0, dim))
                    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                if role[lo] == 0:
                    ids, x = np.concatenate([ids, i[lo:hi]]), np.concatenate([x, e[lo:hi]])
                elif len(ids):
                    best = better(ids, x, i[lo:hi], e[lo:hi], best)
        if best is not None and len(best[0]):
            yield emit()

    def better(ids, x, others, e, best):
        """The lists (row, other, cosine), sorted by row, with the others brought in."""
        floor = np.full(len(ids), max(least, -1.0))
        full = np.bincount(best[0], minlength=len(ids)) >= k
        floor[full] = np.maximum(floor[full], best[2][np.cumsum(np.bincount(best[0], minlength=len(ids)))[full] - 1])
        parts = [best]
        for a in range(0, len(ids), 512):
            z = min(a + 512, len(ids))
            c = x[a:z] @ e.T
            bar = floor[a:z]
            if k + 1 < len(others) and not full[a:z].all():  # one more: a vector may meet itself
                bar = np.maximum(bar, np.partition(c, -k - 1, axis=1)[:, -k - 1])
            r, j = np.nonzero(c >= bar[:, None] - 2e-9)
            s = np.round(c[r, j], 9)
            good = (s >= max(least, -1.0)) & (ids[a + r] != others[j])
            parts.append((a + r[good], others[j[good]], s[good]))
        r, b, s = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((b, -s, r))
        r, b, s = r[order], b[order], s[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[keep], b[keep], s[keep]

    return run


def _exact(dense: DataFrame, reps: DataFrame, dim: int, k: int, least: float) -> DataFrame:
    """(a, b, cosine): the k best of every vector of ``dense`` (a) among all of ``reps``, a grid of blocks of bounded size."""
    hot = reps.join(dense.withColumnRenamed("a", "id"), "id", "left_semi").select("id", "embedding")
    high, wide = -(-dense.count() // BLOCK_ROWS), max(8, -(-reps.count() // BLOCK_ROWS))
    block, part = F.pmod(F.xxhash64("id"), F.lit(high)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(wide))
    one = hot.select(F.explode(F.sequence(block * wide, block * wide + wide - 1)).alias("cell"), F.lit(0).alias("role"), "id", "embedding")
    two = reps.select(F.explode(F.sequence(part, part + (high - 1) * wide, F.lit(wide).cast("bigint"))).alias("cell"), F.lit(1).alias("role"), "id", "embedding")
    return one.union(two).repartition(high * wide, "cell").sortWithinPartitions("cell", "role").mapInArrow(_compare(dim, k, least), "a bigint, b bigint, cosine double")


def usable(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, embedding) of the vectors that can take part; ids may repeat."""
    ok = f"id is not null and size(embedding) = {dim} and not exists(embedding, v -> v is null or isnan(v) or abs(v) = float('inf')) and exists(embedding, v -> v <> 0)"
    return vectors.select(F.col("article_id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).where(ok)


def candidates(reps: DataFrame, k: int, dim: int, trees: int, probes: int, least: float) -> DataFrame:
    """(a, b): the pairs to verify of every asked vector of (id, embedding, asked), and (a, null) for one in a dense group."""
    spark = reps.sparkSession
    counts = prefix_counts(reps, dim, trees)
    n = int(counts[0].sum())
    words = WORDS if least > 0 else WIDE_WORDS
    limit, dense_at = _sketch_limit(reps, n, k, dim, words, least)
    budget = math.ceil(BUDGET * math.sqrt(n))
    window = max(LEAST_WINDOW, min(WINDOW, budget // (trees * probes)))
    rows = reps.select("id", "embedding", "asked").mapInArrow(_rows(dim, trees, probes, words, budget, spark.sparkContext.broadcast(counts)), _row(words))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * trees // (4 * SLICE_ROWS)))
    return rows.repartition(parts, "slice").sortWithinPartitions("slice", "key", "meta").mapInArrow(_search(limit, dense_at, budget, window), "a bigint, b bigint")


def neighbours(vectors: DataFrame, k: int = 5, dim: int = DIM, trees: int = TREES, least: float = -1.0, every: int = 1, probes: int = 1) -> DataFrame:
    """(id, neighbour, cosine, rank): the k nearest others of every vector whose id is divisible by ``every``.

    ``least`` leaves out neighbours below that cosine. Cosines are rounded to 9 decimals, ties go to the smaller id.
    """
    raw = usable(vectors, dim).withColumn("g", F.xxhash64("embedding"))
    v = cut(raw.groupBy("id").agg(F.min("g").alias("g")))
    head = cut(v.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("id"))).where(F.col("r") <= k + 1))
    twins = head.where("r = 2").select("g")
    lead = head.where("r = 1").select("id", "g")
    rest = broadcast_if_small(cut(raw.select("id", "g").join(lead, ["id", "g"], "left_anti").distinct()), BROADCAST_ROWS)
    reps = raw.join(rest, ["id", "g"], "left_anti")
    if every > 1:  # a group is asked for if any member is
        asked = lead.join(v.where(F.col("id") % every == 0).select("g").distinct(), "g", "left_semi").select("id", F.lit(True).alias("asked"))
        reps = reps.join(broadcast_if_small(cut(asked), BROADCAST_ROWS), "id", "left").select("id", "embedding", F.coalesce("asked", F.lit(False)).alias("asked"))
    else:
        reps = reps.select("id", "embedding", F.lit(True).alias("asked"))
    found_in = cut(candidates(reps, k, dim, trees, probes, least).distinct())
    dense = found_in.where("b is null").select("a")
    pairs = found_in.where("b is not null")
    hot = not dense.isEmpty()
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    needed = broadcast_if_small(cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), BROADCAST_ROWS)
    held = reps.join(needed, "id", "left_semi").select("id", "embedding").dropDuplicates(["id"])
    both = pairs.join(held.withColumnsRenamed({"id": "a", "embedding": "x"}), "a").join(held.withColumnsRenamed({"id": "b", "embedding": "y"}), "b")
    near = both.select("a", "b", "x", "y").mapInArrow(_cosines(dim), "a bigint, b bigint, cosine double").where(F.col("cosine") >= least)
    near = cut(near)
    near = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    if hot:
        unique = reps.select("id", "embedding").dropDuplicates(["id"])
        near = cut(near.join(dense, "a", "left_anti").union(_exact(dense, unique, dim, k, least)))
    # A representative stands for its whole group: bring in the group's other small ids on either side.
    twin = head.join(twins, "g", "left_semi")
    lead = twin.where("r = 1").select(F.col("id").alias("lead"), "g")
    others = lead.join(twin.where("r > 1").select("g", F.col("id").alias("other")), "g").select("lead", "other")
    near = cut(near.union(near.join(others, near["b"] == others["lead"]).select("a", F.col("other").alias("b"), "cosine")))
    members = v.join(twins, "g", "left_semi").select("g", "id").join(lead, "g")
    copies = members.where("id <> lead").join(near, F.col("lead") == F.col("a")).select(F.col("id").alias("a"), "b", "cosine")
    inside = members.join(twin.select("g", F.col("id").alias("b")), "g").where("id <> b").select(F.col("id").alias("a"), "b", F.lit(1.0).alias("cosine"))
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    out = near.union(copies).union(inside).where((F.col("a") % every == 0) & (F.col("cosine") >= least))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "cosine", "rank")


def found(vectors: DataFrame) -> DataFrame:
    near = neighbours(vectors, k=5, least=0.90)
    return near.select(F.least("id", "neighbour").cast("int").alias("article_id_a"), F.greatest("id", "neighbour").cast("int").alias("article_id_b")).distinct()
