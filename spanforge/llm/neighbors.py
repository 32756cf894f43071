"""The k most similar vectors of every vector.

Method: a hierarchical k-means tree, searched best bin first. The top of the tree is fitted on a
bounded sample; leaves that hold too many of all vectors are split again on samples of their own,
in parallel, so leaves stay small whatever the number of vectors. A query descends through a
priority queue keyed by a bin's bound: the largest distance, over the levels of its path, of the
query to the plane between the path's centre and the best sibling's, which no vector of the bin
can undercut. It first searches its home leaf; then it pops further bins until the best bound
left exceeds ``width`` times the distance of its k-th neighbour so far. The width is calibrated:
sampled queries are compared with all vectors, half of them give the least width that reaches
the wanted recall, and it is widened until the other half reaches it too.

Both steps are one shuffle each by leaf. A task streams through its leaves: it holds the vectors
at home in one block of a leaf and one batch of visitors. Leaves above ``leaf_rows`` are cut
into blocks on both sides, and every pair of blocks meets, so nothing is dropped. Exact copies of
a vector travel at most k + 2 at a time; when it has more, their neighbours are its first copies,
given by a join.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.llm._common import materialise

SAMPLE = (16_384, 131_072)  # vectors the top of the tree is fitted on: an eighth of all within these bounds
LEAF_SAMPLE = 32_768  # vectors of one leaf that its subtree is fitted on
CALIBRATION = 2_048  # queries compared with all vectors to calibrate the width
BRANCHING = 8
LEAF_TARGET = 1_024
PER_LEAF = 16  # sample vectors a leaf needs
MAX_LEAVES = 262_144  # 64 MB of centres at 64 dimensions, sent to every task
LEVELS = 4  # rounds of splitting
LEAF_ROWS = 4_096
MARGIN = 1.25  # the calibrated width is widened by this factor


def _distance(sim):
    """Between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * np.asarray(sim, float), 0))


@dataclass
class Tree:
    """Nodes in an array; children of node i are first[i] .. first[i] + count[i] - 1; leaves have count 0."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def __post_init__(self) -> None:
        self.size = (self.centres * self.centres).sum(axis=1)
        self.width = max(int(self.count.max()), 1)
        kids = np.minimum(self.first[:, None] + np.arange(self.width), len(self.first) - 1)
        inner = np.flatnonzero(self.count)
        self.row = np.zeros(len(self.first), np.int64)
        self.row[inner] = np.arange(len(inner))
        c = self.centres[kids[inner]].astype(np.float32)
        cross = np.einsum("nid,njd->nij", c, c)
        square = np.einsum("nii->ni", cross)
        self.apart = np.sqrt(np.maximum(square[:, :, None] + square[:, None, :] - 2 * cross, 1e-12)) if len(inner) else np.ones((1, 1, 1))
        self.kids, self.valid = kids, np.arange(self.width) < self.count[:, None]
        self.parent = np.full(len(self.first), -1, np.int64)
        self.parent[kids[inner][self.valid[inner]]] = np.repeat(inner, self.count[inner])

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.centres, self.first, self.count

    def bounds(self, x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Distance of row i of x to the plane between each child's centre and the best child's of nodes[i]; 0 for the best."""
        kids = self.kids[nodes]
        d = self.size[kids] - 2 * np.einsum("rd,rkd->rk", x, self.centres[kids])  # squared distance less |x|^2
        d[~self.valid[nodes]] = np.inf
        best = d.argmin(axis=1)
        gap = d - d[np.arange(len(x)), best][:, None]
        return np.maximum(gap, 0) / (2 * self.apart[self.row[nodes], best])

    def home(self, x: np.ndarray) -> np.ndarray:
        """The home leaf of each row: the best child at every level."""
        x = x.astype(np.float32)
        at = np.zeros(len(x), np.int64)
        todo = np.flatnonzero(self.count[at] > 0)
        while len(todo):
            for lo in range(0, len(todo), 4096):
                rows = todo[lo : lo + 4096]
                at[rows] = self.first[at[rows]] + self.bounds(x[rows], at[rows]).argmin(axis=1)
            todo = todo[self.count[at[todo]] > 0]
        return at

    def visits(self, x: np.ndarray, stop: np.ndarray):
        """(rows, leaves, bounds): for each row the leaves it visits, best bin first, until the best bound left exceeds its stop.

        Every row has its own priority queue; the queues are popped in step, so that the bounds of
        all popped nodes' children are computed at once.
        """
        x, stop = x.astype(np.float32), np.broadcast_to(np.asarray(stop, float), (len(x),))
        out: list[tuple] = []
        for lo in range(0, len(x), 2048):
            rows = np.arange(lo, min(lo + 2048, len(x)))
            queue = np.full((len(rows), 8 * self.width), np.inf)
            nodes = np.zeros(queue.shape, np.int64)
            queue[:, 0], used = 0.0, 1
            live = np.arange(len(rows))
            while len(live):
                j = queue[live].argmin(axis=1)
                bound = queue[live, j]
                near = bound <= stop[rows[live]]
                live, j, bound = live[near], j[near], bound[near]
                if not len(live):
                    break
                queue[live, j] = np.inf
                node = nodes[live, j]
                leaf = self.count[node] == 0
                if leaf.any():
                    out.append((rows[live[leaf]], node[leaf], bound[leaf]))
                inner = live[~leaf]
                if len(inner):
                    if used + self.width > queue.shape[1]:  # the queues are sorted and cut to what is left in them
                        order = queue.argsort(axis=1)
                        queue, nodes = np.take_along_axis(queue, order, 1), np.take_along_axis(nodes, order, 1)
                        used = int(np.isfinite(queue).sum(axis=1).max())
                        if used + self.width > queue.shape[1]:
                            queue = np.concatenate([queue, np.full(queue.shape, np.inf)], axis=1)
                            nodes = np.concatenate([nodes, np.zeros(nodes.shape, np.int64)], axis=1)
                    b = np.maximum(self.bounds(x[rows[inner]], node[~leaf]), bound[~leaf][:, None])
                    b[b > stop[rows[inner]][:, None]] = np.inf
                    queue[inner, used : used + self.width] = b
                    nodes[inner, used : used + self.width] = self.kids[node[~leaf]]
                    used += self.width
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        found = [np.concatenate(z) for z in zip(*out)]
        order = np.argsort(found[0], kind="stable")
        return tuple(z[order] for z in found)

    def leaf_bound(self, x: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Row i's bound of leaf leaves[i]."""
        x, bound, at = x.astype(np.float32), np.zeros(len(x)), np.asarray(leaves).copy()
        rows = np.flatnonzero(at > 0)
        while len(rows):
            up = self.parent[at[rows]]
            b = self.bounds(x[rows], up)[np.arange(len(rows)), at[rows] - self.first[up]]
            bound[rows] = np.maximum(bound[rows], b)
            at[rows] = up
            rows = rows[up > 0]
        return bound

    def grown(self, subtrees: dict[int, Tree]) -> Tree:
        """The tree with leaves replaced by subtrees; other nodes keep their numbers."""
        centres, first, count, base = [self.centres], self.first.copy(), self.count.copy(), len(self.first)
        more_first, more_count = [], []
        for leaf, sub in subtrees.items():
            first[leaf], count[leaf] = base + sub.first[0] - 1, sub.count[0]
            centres.append(sub.centres[1:])
            more_first.append(np.where(sub.count[1:] > 0, base + sub.first[1:] - 1, 0))
            more_count.append(sub.count[1:])
            base += len(sub.first) - 1
        return Tree(np.concatenate(centres), np.concatenate([first, *more_first]), np.concatenate([count, *more_count]))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=k)
        full = sizes > 0
        c[full] = sums[full] / sizes[full, None]
    return np.unique(c, axis=0)


def fit_tree(x: np.ndarray, leaves: int, branching: int = BRANCHING, seed: int = 0) -> Tree:
    """Splits the node with most sample rows until there are ``leaves`` leaves; identical rows are never split."""
    rng = np.random.default_rng(seed)
    x = np.ascontiguousarray(x, np.float32)
    centres, first, count = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1], np.float32)], [0], [0]
    queue, n_leaves = [(-len(x), 0, np.arange(len(x)))], 1
    while queue and n_leaves < leaves:
        size, node, rows = heapq.heappop(queue)
        if -size < 2 * branching:
            continue
        c = kmeans(x[rows], branching, rng)
        if len(c) < 2:
            continue
        near = ((c * c).sum(axis=1)[None, :] - 2 * x[rows] @ c.T).argmin(axis=1)
        first[node], count[node] = len(centres), len(c)
        n_leaves += len(c) - 1
        for j in range(len(c)):
            centres.append(c[j])
            first.append(0)
            count.append(0)
            own = rows[near == j]
            heapq.heappush(queue, (-len(own), len(centres) - 1, own))
    return Tree(np.array(centres, np.float32), np.array(first, np.int64), np.array(count, np.int64))


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, group_col: str, dim: int) -> DataFrame:
    """(id, grp, vec array<float>, same bigint): non-null, dim long, finite, not all zero."""
    v = F.col("vec")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(group_col).cast("string"), F.lit("")).alias("grp"), F.col(vector_col).cast("array<float>").alias("vec"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & (F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0))
    return rows.withColumn("same", F.xxhash64("grp", "vec"))


def _matrix(column, dim: int) -> np.ndarray:
    """Unit rows, float64, of an Arrow list column."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _share(salt: int):
    return F.shiftrightunsigned(F.xxhash64("id", F.lit(salt)), 11) / float(1 << 53)


def _sample(vectors: DataFrame, size: int, total: int, dim: int, salt: int) -> tuple[list, list, np.ndarray]:
    """About ``size`` of ``total`` vectors, those with the least hashes of their ids: the same whatever the partitions.

    The share is taken where the rows are, so only the sample travels; repeated rows count once
    and a tenth more than the size is never exceeded.
    """
    rows = vectors.where(_share(salt) < min(1.0, size / max(total, 1))).select("id", "grp", "vec", "same").dropDuplicates(["id", "same"])
    rows = rows.select("id", "grp", "vec").limit(size + size // 10 + 100).toArrow()
    if not rows.num_rows:
        return [], [], np.zeros((0, dim))
    order = np.lexsort((np.array(rows.column("grp").to_pylist()), np.array(rows.column("id").to_pylist())))
    rows = rows.take(pa.array(order))
    return rows.column("id").to_pylist(), rows.column("grp").to_pylist(), _matrix(rows.column("vec").combine_chunks(), dim)


def compare_with_all(vectors: DataFrame, ids: list, groups: list, x: np.ndarray, k: int, least: float, dim: int, tree: Tree | None = None) -> DataFrame:
    """(q, id, sim, near, far): for each query row its exact k best other vectors of its group with sim >= least.

    Brute force in blocks; the queries are few and go to every task. near is the bound at which
    the query's search reaches the other's leaf, far the reverse (0 without a tree).
    """
    kind = vectors.schema["id"].dataType.simpleString()
    sc = vectors.sparkSession.sparkContext
    given = sc.broadcast((np.array(ids), np.array(groups, dtype=object), x.astype(np.float32), tree.home(x) if tree else None, tree.arrays() if tree else None))

    def run(batches):
        q_ids, q_groups, q, q_home, arrays = given.value
        tree = Tree(*arrays) if arrays else None
        kept, size, id_type = [], 0, None
        codes = {g: n for n, g in enumerate(dict.fromkeys(q_groups.tolist()))}
        q_codes = np.array([codes[g] for g in q_groups.tolist()], np.int8 if len(codes) < 120 else np.int32)

        def best():
            a, i, s, near, far = (np.concatenate(x) for x in zip(*kept))
            order = np.lexsort((i, -s, a))
            a, i, s, near, far = a[order], i[order], s[order], near[order], far[order]
            once = np.ones(len(a), bool)
            once[1:] = (a[1:] != a[:-1]) | (i[1:] != i[:-1])
            a, i, s, near, far = a[once], i[once], s[once], near[once], far[once]
            top = np.arange(len(a)) - np.searchsorted(a, a) < 2 * k
            return a[top], i[top], s[top], near[top], far[top]

        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            id_type = batch.column(0).type
            own, grp = np.array(batch.column(0).to_pylist()), np.array(batch.column(1).to_pylist(), dtype=object)
            own_codes = np.array([codes.get(g, -1) for g in grp.tolist()], q_codes.dtype)
            v = _matrix(batch.column(2), dim)
            for lo in range(0, len(v), 4096):
                part = v[lo : lo + 4096].astype(np.float32)
                sim = q @ part.T
                if len(codes) > 1 or (own_codes < 0).any():
                    sim[q_codes[:, None] != own_codes[None, lo : lo + 4096]] = -2.0
                a, b = best_cells(sim, 2 * k + 1, least - 1e-4, columns=False)
                b += lo
                good = (q_groups[a] == grp[b]) & (q_ids[a] != own[b])
                a, b = a[good], b[good]
                s = (q[a].astype(np.float64) * v[b]).sum(axis=1)
                good = s >= least - 1e-7
                a, b, s = a[good], b[good], s[good]
                if not len(a):
                    continue
                near = far = np.zeros(len(a))
                if tree is not None:
                    near, far = tree.leaf_bound(q[a], tree.home(v[b])), tree.leaf_bound(v[b], q_home[a])
                kept.append((a, own[b], s, near, far))
                size += len(a)
                if size > 200_000:  # a task keeps no more than its best
                    kept = [best()]
                    size = len(kept[0][0])
        if kept:
            a, i, s, near, far = best()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(i.tolist(), id_type), *(pa.array(z, pa.float64()) for z in (s, near, far))], names=["q", "id", "sim", "near", "far"])

    found = vectors.select("id", "grp", "vec").mapInArrow(run, f"q int, id {kind}, sim double, near double, far double").dropDuplicates(["q", "id"])
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def best_cells(sim: np.ndarray, k: int, least: float, columns: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Cells of at least ``least`` that are among the k best of their row or, with ``columns``, of their column.

    All such cells are returned where they are few; where whole groups of near copies meet, only
    those within rounding of a row's or column's k-th best.
    """
    good = sim >= least
    if np.count_nonzero(good) > 4 * k * (len(sim) + sim.shape[1]):
        near = np.zeros(sim.shape, bool)
        for axis in (1, 0) if columns else (1,):
            n = sim.shape[axis]
            if n <= k:
                near[:] = True
            else:
                near |= sim >= np.take(np.partition(sim, n - k, axis=axis), [n - k], axis=axis) - 1e-5
        good &= near
    return np.nonzero(good)


def width_for(q: np.ndarray, sim: np.ndarray, near: np.ndarray, far: np.ndarray, k: int, least: float, target: float) -> float:
    """The least width at which both halves of the queries reach the mean recall ``target``.

    A pair is found if its bound from the query's side is within width times the distance of the
    query's k-th neighbour, or from the other side within width times their own distance.
    """
    if not len(q):
        return MARGIN
    values, place, counts = np.unique(q, return_inverse=True, return_counts=True)
    last = np.full(len(values), 2.0)
    np.minimum.at(last, place, sim)
    stop = np.where(counts < k, _distance(least), _distance(last))
    need = np.minimum(near / np.maximum(stop[place], 1e-6), far / np.maximum(_distance(sim), 1e-6))
    weight = 1.0 / counts[place]
    width = 0.0
    for half in (values[place] % 2 == 0, values[place] % 2 == 1):  # fitted on the first half, checked and widened on the second
        if half.any():
            order = np.argsort(need[half])
            recall = np.cumsum(weight[half][order]) / weight[half].sum()
            width = max(width, float(need[half][order][min(np.searchsorted(recall, target - 1e-12), len(order) - 1)]))
    return width * MARGIN + 1e-3


def calibrate(vectors: DataFrame, total: int, tree: Tree, k: int, least: float, dim: int, queries: int, target: float) -> float:
    ids, groups, x = _sample(vectors, queries, total, dim, salt=2)
    found = compare_with_all(vectors, ids, groups, x, k, least, dim, tree).select("q", "sim", "near", "far").toPandas()
    return width_for(*(found[c].to_numpy() for c in ("q", "sim", "near", "far")), k, least, target)


def grow_tree(vectors: DataFrame, total: int, dim: int, most: int, sample: tuple[int, int], leaf_target: int) -> tuple[Tree, dict[int, int]]:
    """(tree, sizes of its leaves above leaf_target): the top from a sample of all, then, level by level, subtrees of
    large leaves from samples of their own, each fitted where its sample is.

    Sizes count what travels: at most ``most`` copies of a vector a batch.
    """
    spark = vectors.sparkSession
    _, _, x = _sample(vectors, min(max(total // 8, sample[0]), sample[1]), total, dim, salt=1)
    tree = fit_tree(x, max(1, min(total // leaf_target, len(x) // PER_LEAF)))
    sizes: dict[int, int] = {}
    for level in range(LEVELS + 1):
        if total <= leaf_target:
            break
        shared = spark.sparkContext.broadcast(tree.arrays())  # arrays only: workers may lack this package
        counts = vectors.select("vec", "same").mapInArrow(_leaf_counts(shared, dim, most), "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n"))
        before, sizes = sizes, {r["leaf"]: r["n"] for r in counts.where(F.col("n") > leaf_target).collect()}
        room = MAX_LEAVES - int((tree.count == 0).sum())
        large = {leaf: n for leaf, n in sizes.items() if n > 4 * leaf_target and before.get(leaf) != n}  # a leaf that did not split stays
        if not large or room <= 0 or level == LEVELS:
            break
        wanted = {leaf: min(-(-n // leaf_target), LEAF_SAMPLE // PER_LEAF) for leaf, n in large.items()}
        scale = min(1.0, room / sum(wanted.values()))
        plan = {leaf: (min(1.0, LEAF_SAMPLE / large[leaf]), max(2, int(w * scale))) for leaf, w in wanted.items()}
        given = spark.sparkContext.broadcast(plan)
        near = vectors.select(_share(4).alias("share"), "vec", "same").mapInArrow(_leaf_sample(shared, given, dim, most), "leaf int, vec binary")
        fitted = near.groupBy("leaf").applyInArrow(_fit_leaf(given, dim), "leaf int, centres binary, first binary, count binary")
        subtrees = {
            r["leaf"]: Tree(np.frombuffer(r["centres"], np.float32).reshape(-1, dim), np.frombuffer(r["first"], np.int64), np.frombuffer(r["count"], np.int64)) for r in fitted.collect()
        }
        subtrees = {leaf: t for leaf, t in subtrees.items() if t.count[0]}
        if not subtrees:
            break
        tree = tree.grown(subtrees)
    return tree, sizes


def _first_copies(same: np.ndarray, most: int) -> np.ndarray:
    """Indices of at most ``most`` rows of each value, in order."""
    order = np.argsort(same, kind="stable")
    return np.sort(order[np.arange(len(same)) - np.searchsorted(same[order], same[order]) < most])


def _leaf_counts(shared, dim: int, most: int):
    def run(batches):
        tree = Tree(*shared.value)
        total = np.zeros(len(tree.first), np.int64)
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(_first_copies(batch.column(1).to_numpy(), most))
                total += np.bincount(tree.home(_matrix(batch.column(0).take(keep), dim)), minlength=len(total))
        leaves = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), pa.array(total[leaves], pa.int64())], names=["leaf", "n"])

    return run


def _leaf_sample(shared, given, dim: int, most: int):
    def run(batches):
        tree, plan = Tree(*shared.value), given.value
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pa.array(_first_copies(batch.column(2).to_numpy(), most)))
            share, v = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            home = tree.home(v)
            rows = [i for i, leaf in enumerate(home.tolist()) if leaf in plan and share[i] < plan[leaf][0]]
            yield pa.RecordBatch.from_arrays([pa.array(home[rows], pa.int32()), pa.array([r.tobytes() for r in v[rows].astype(np.float32)], pa.binary())], names=["leaf", "vec"])

    return run


def _fit_leaf(given, dim: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        leaf = key[0].as_py()
        x = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float32).reshape(-1, dim)
        tree = fit_tree(x, min(given.value[leaf][1], max(1, len(x) // PER_LEAF)), seed=leaf)
        return pa.table({"leaf": pa.array([leaf], pa.int32()), "centres": pa.array([tree.centres.tobytes()], pa.binary()), "first": pa.array([tree.first.tobytes()], pa.binary()), "count": pa.array([tree.count.tobytes()], pa.binary())})

    return run


def similar_pairs(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    group_col: str = "model",
    dim: int = 64,
    k: int = 5,
    least: float = 0.92,
    target_recall: float = 0.999,
    sample: tuple[int, int] = SAMPLE,
    calibration: int = CALIBRATION,
    leaf_target: int = LEAF_TARGET,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """(vec, other, sim, rank): of every usable vector the k most similar others of its group with cosine >= least.

    Ties rank by id. Vectors that are null, of another length, not finite or all zero are no
    vectors; a null group is a group of its own; null ids are dropped; repeated rows of an id
    count once. The top of the tree is fitted on an eighth of the vectors, at least ``sample[0]``
    and at most ``sample[1]``, and the width on ``calibration`` queries, both halves of which
    reach ``target_recall`` before it is widened by MARGIN; every vector is indexed and searched.
    """
    vectors = usable_vectors(df, id_col, vector_col, group_col, dim)
    kind = vectors.schema["id"].dataType.simpleString()
    sc, total, most = df.sparkSession.sparkContext, vectors.count(), k + 2
    tree, sizes = grow_tree(vectors, total, dim, most, sample, leaf_target)
    width = calibrate(vectors, total, tree, k, least, dim, calibration, target_recall)
    shared = sc.broadcast((tree.arrays(), {leaf: -(-n // leaf_rows) for leaf, n in sizes.items() if n > leaf_rows}))  # as large as the tree at most
    schema = f"grp string, leaf int, home_block int, visit_block int, role int, same bigint, id {kind}, vec binary, other {kind}, sim double"
    keys = ["grp", "leaf", "home_block", "visit_block"]
    placed = vectors.mapInArrow(_place(shared, dim, most), schema)
    searched = placed.repartition(*keys).sortWithinPartitions(*keys, "role", "same", "id").mapInArrow(_search(shared, k, least, most, dim, width), schema)
    visited = searched.repartition(*keys).sortWithinPartitions(*keys, "role", "same", "id").mapInArrow(_search(shared, k, least, most, dim, None), schema)
    found = materialise(visited.select("id", "other", "sim", "grp", "same", "role"))

    many = found.where(F.col("role") == CROWDED).select("grp", "same").distinct()
    pairs = found.where(F.col("role") == PAIR).select("id", "other", "sim")
    if many.limit(1).count():
        pairs = pairs.unionByName(_copies_of_many(vectors, many, k))
    pairs = pairs.groupBy("id", "other").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("sim"), "other"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias("vec"), "other", "sim", "rank")


HOME, VISITOR, PAIR, CROWDED = 0, 1, 2, 3  # roles of rows; pairs and crowded vectors only pass through the second search


def _rows(n: int, grp, leaf, home_block, visit_block, role: int, same, ids, vec, other, sim, id_type) -> pa.RecordBatch:
    column = lambda x, kind: pa.nulls(n, kind) if x is None else pa.array([x] * n, kind) if np.isscalar(x) else pa.array(x, kind)
    of_ids = lambda x: pa.nulls(n, id_type) if x is None else pa.array(x.tolist(), id_type)
    return pa.RecordBatch.from_arrays(
        [
            column(grp, pa.string()), column(leaf, pa.int32()), column(home_block, pa.int32()), column(visit_block, pa.int32()), column(role, pa.int32()),
            column(same, pa.int64()), of_ids(ids), column(vec, pa.binary()), of_ids(other), column(sim, pa.float64()),
        ],
        names=["grp", "leaf", "home_block", "visit_block", "role", "same", "id", "vec", "other", "sim"],
    )


def _in_blocks(blocks: dict, leaf: np.ndarray, same: np.ndarray, home: bool):
    """(row, home_block, visit_block) of every pair of blocks a row belongs to; copies of a vector share a block."""
    parts = np.array([blocks.get(x, 1) for x in leaf.tolist()], np.int64)
    own = (same.view(np.uint64) % parts.astype(np.uint64)).astype(np.int64)
    rows = np.repeat(np.arange(len(leaf)), parts)
    other = np.arange(len(rows)) - np.repeat(np.cumsum(parts) - parts, parts)
    return (rows, own[rows], other) if home else (rows, other, own[rows])


def _place(shared, dim: int, most: int):
    """Every vector at home in its leaf; in a leaf of several blocks it also visits the other blocks."""

    def run(batches):
        arrays, blocks = shared.value
        tree = Tree(*arrays)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, same = np.array(batch.column(0).to_pylist()), batch.column(3).to_numpy()
            order = np.lexsort((ids, same))
            ids, same = ids[order], same[order]
            new = np.ones(len(ids), bool)  # a repeated id takes one place of the quota
            new[1:] = (ids[1:] != ids[:-1]) | (same[1:] != same[:-1])
            order, ids, same = order[new], ids[new], same[new]
            first = np.arange(len(same)) - np.searchsorted(same, same) < most
            ids, same, batch = ids[first], same[first], batch.take(pa.array(order[first]))
            v = _matrix(batch.column(2), dim)
            leaf, grp, vec = tree.home(v), batch.column(1), pa.array([r.tobytes() for r in v.astype(np.float32)], pa.binary())
            for role in (HOME, VISITOR):
                rows, own, other = _in_blocks(blocks, leaf, same, role == HOME)
                if role == VISITOR:  # the block at home is searched with itself
                    rows, own, other = (z[own != other] for z in (rows, own, other))
                if len(rows):
                    take = pa.array(rows)
                    yield _rows(len(rows), grp.take(take), leaf[rows], own, other, role, same[rows], ids[rows], vec.take(take), None, None, batch.column(0).type)

    return run


class _Thin:
    """Drops repeated ids and copies beyond the first ``most`` from rows sorted by (same, id), batch after batch."""

    def __init__(self, most: int):
        self.most, self.last, self.crowded = most, None, []

    def keep(self, same: np.ndarray, ids: np.ndarray) -> np.ndarray:
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (same[1:] != same[:-1])
        begun = 0
        if self.last and same[0] == self.last[0]:
            new[0], begun = ids[0] != self.last[1], self.last[2]
        seen = np.cumsum(new)
        start = np.searchsorted(same, same)
        place = seen - np.where(start > 0, seen[start - 1], 0) + np.where(start == 0, begun, 0)  # the row's number among its vector's ids
        self.crowded.extend(np.unique(same[new & (place == self.most)]).tolist())
        self.last = (same[-1], ids[-1], int(place[-1]))
        return np.flatnonzero(new & (place <= self.most))


def _search(shared, k: int, least: float, most: int, dim: int, width: float | None):
    """Meets the visitors of a block with the vectors at home, and those at home with each other.

    With a width it is the first search: the vectors at home also set out to further leaves, as
    far as width times the distance of their k-th neighbour so far. Without one it is the second:
    all at home have met each other before.
    """

    def best(q, h, rows, cols, sim):
        order = np.lexsort((h[cols], -sim, rows))
        rows, cols, sim = rows[order], cols[order], sim[order]
        top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return q[rows[top]], h[cols[top]], sim[top], rows[top]

    def meet(ids, v, h_ids, h):
        """Pairs both ways, and each row's k-th best similarity (least where it has fewer)."""
        out, kth = [], np.full(len(ids), least)
        for lo in range(0, len(ids), 2048):
            sim = v[lo : lo + 2048] @ h.T
            a, b = best_cells(sim, k + 1, least - 1e-4)  # a vector may meet itself
            other = ids[lo + a] != h_ids[b]
            a, b = a[other], b[other]
            exact = (v[lo + a].astype(np.float64) * h[b]).sum(axis=1)
            good = exact >= least - 1e-7
            a, b, exact = a[good], b[good], exact[good]
            if len(a):
                one = best(ids[lo : lo + 2048], h_ids, a, b, exact)
                out += [one[:3], best(h_ids, ids[lo : lo + 2048], b, a, exact)[:3]]
                rows, n = np.unique(one[3], return_counts=True)
                ends = np.cumsum(n) - 1
                kth[lo + rows[n == k]] = np.maximum(one[2][ends[n == k]], least)
        return out, kth

    def run(batches):
        arrays, blocks = shared.value
        tree = Tree(*arrays) if width is not None else None
        key, state, id_type = None, None, None

        def settle():
            """The vectors at home are complete: one matrix, met with itself in the first search."""
            ids, same, v = (np.concatenate(z) if z else np.zeros(0) for z in (state["ids"], state["same"], state["vec"]))
            state["home"] = (ids, v)
            grp, leaf, home_block, visit_block = key
            if width is None or not len(ids):
                return
            if home_block == visit_block:
                found, kth = meet(ids, v, ids, v)
                yield from pairs(found)
                rows, leaves, _ = tree.visits(v, width * _distance(kth))
                away = leaves != leaf
                rows, leaves = rows[away], leaves[away].astype(np.int64)
                raw = [r.tobytes() for r in v]
                for role, at, to in ((HOME, np.arange(len(ids)), np.full(len(ids), leaf, np.int64)), (VISITOR, rows, leaves)):
                    for lo in range(0, len(at), 8192):
                        part, dest = at[lo : lo + 8192], to[lo : lo + 8192]
                        pick, own, other = _in_blocks(blocks, dest, same[part], role == HOME)
                        yield _rows(len(pick), grp, dest[pick], own, other, role, same[part][pick], ids[part][pick], pa.array([raw[i] for i in part[pick]], pa.binary()), None, None, id_type)

        def pairs(found):
            for x, y, s in found:
                yield _rows(len(x), None, 0, 0, 0, PAIR, None, x, None, y, s, id_type)

        def leave():
            if state is not None:
                if state["home"] is None:
                    yield from settle()
                crowded = sorted(set(state["thin"].crowded)) if width is not None and key[2] == key[3] else []
                if crowded:
                    yield _rows(len(crowded), key[0], 0, 0, 0, CROWDED, crowded, None, None, None, None, id_type)

        for batch in batches:
            if not batch.num_rows:
                continue
            id_type = batch.column(6).type
            role = batch.column(4).to_numpy()
            passing = role >= PAIR
            if passing.any():
                yield batch.filter(pa.array(passing))
                batch = batch.filter(pa.array(~passing))
                role = role[~passing]
                if not batch.num_rows:
                    continue
            grp = batch.column(0).to_pylist()
            leaf, home_block, visit_block = (batch.column(i).to_numpy() for i in (1, 2, 3))
            same, ids, raw = batch.column(5).to_numpy(), np.array(batch.column(6).to_pylist()), batch.column(7)
            change = np.ones(len(role), bool)
            change[1:] = (leaf[1:] != leaf[:-1]) | (home_block[1:] != home_block[:-1]) | (visit_block[1:] != visit_block[:-1]) | (role[1:] != role[:-1]) | np.array([a != b for a, b in zip(grp[1:], grp[:-1])], bool)
            starts = [*np.flatnonzero(change).tolist(), len(role)]
            for lo, hi in zip(starts, starts[1:]):
                now = (grp[lo], int(leaf[lo]), int(home_block[lo]), int(visit_block[lo]))
                if now != key:
                    yield from leave()
                    key, state = now, {"ids": [], "same": [], "vec": [], "home": None, "thin": _Thin(most), "visitors": _Thin(most)}
                at_home = role[lo] == HOME
                pick = lo + state["thin" if at_home else "visitors"].keep(same[lo:hi], ids[lo:hi])
                if not len(pick):
                    continue
                v = np.frombuffer(b"".join(raw.take(pa.array(pick)).to_pylist()), np.float32).reshape(-1, dim)
                if at_home:
                    state["ids"].append(ids[pick])
                    state["same"].append(same[pick])
                    state["vec"].append(v)
                    continue
                if state["home"] is None:
                    yield from settle()
                h_ids, h = state["home"]
                if len(h_ids):
                    yield from pairs(meet(ids[pick], v, h_ids, h)[0])
        yield from leave()

    return run


def _copies_of_many(vectors: DataFrame, many: DataFrame, k: int) -> DataFrame:
    """(id, other, 1.0) for vectors with more copies than travel: the first k other copies of each.

    The first k + 1 ids of each vector come from a window whose row limit is applied before the
    shuffle; the rest is a join on the vector's hash and value, split by AQE where one key is hot.
    """
    copies = vectors.join(many, ["grp", "same"], "left_semi").select("grp", "same", "vec", "id")
    rank = F.dense_rank().over(W.partitionBy("grp", "same").orderBy("id"))
    firsts = copies.withColumn("rank", rank).where(F.col("rank") <= k + 1).select("grp", "same", "vec", F.col("id").alias("other")).distinct()
    joined = copies.join(firsts.groupBy("grp", "same", "vec").agg(F.collect_list("other").alias("others")), ["grp", "same", "vec"])
    mine = F.slice(F.array_sort(F.filter("others", lambda o: o != F.col("id"))), 1, k)
    return joined.select("id", F.explode(mine).alias("other"), F.lit(1.0).alias("sim"))


def recall_report(df: DataFrame, pairs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "model", dim: int = 64, k: int = 5, least: float = 0.92, every: int = 20, block: int = 16_384) -> DataFrame:
    """(model, k, n, mean_recall, min_recall, queries_below_full_recall) of found pairs(vec, other) against brute force.

    Queries are all usable rows whose id is divisible by ``every``, compared with all rows in
    blocks of at most ``block`` queries; n counts those that have a neighbour. A query's recall is
    the share of its exact neighbours found; copies that tie with one of them count as it.
    """
    vectors = usable_vectors(df, id_col, vector_col, group_col, dim)
    queries = vectors.where(F.col("id") % every == 0).dropDuplicates(["id", "same"])
    n = queries.count()
    parts = max(1, -(-n // block))
    truth = None
    for i in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts)) == i).select("id", "grp", "vec").toArrow()
        if not rows.num_rows:
            continue
        ids, groups = rows.column("id").to_pylist(), rows.column("grp").to_pylist()
        x = _matrix(rows.column("vec").combine_chunks(), dim)
        names = df.sparkSession.createDataFrame(list(zip(range(len(ids)), ids, groups)), f"q int, vec {vectors.schema['id'].dataType.simpleString()}, grp string")
        part = compare_with_all(vectors, ids, groups, x, k, least, dim).join(names, "q").select("vec", "grp", F.col("id").alias("other"), "sim")
        truth = part if truth is None else truth.unionByName(part)
    if truth is None:
        truth = pairs.select("vec", F.lit("").alias("grp"), "other", "sim").where("false")
    found = pairs.select("vec", "other", F.lit(1).alias("hit"))
    per = truth.join(found, ["vec", "other"], "left").groupBy("grp", "vec").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
    return per.groupBy(F.col("grp").alias("model")).agg(
        F.lit(k).alias("k"), F.count(F.lit(1)).cast("int").alias("n"), F.avg("recall").alias("mean_recall"), F.min("recall").alias("min_recall"),
        F.count_if(F.col("recall") < 1).cast("int").alias("queries_below_full_recall"),
    )
