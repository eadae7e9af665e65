"""Hard negatives by a cover tree over norm-augmented candidates.

A candidate gets one more component, so that all have the norm M of the longest: they lie on a sphere, and
the largest inner product with an anchor is the smallest angle to it. A cover tree holds them: a node's
points are covered by centres found farthest first, which are nested (its own centre is the first) and lie
further apart than the covering radius they leave; every node keeps the exact radius of its points. With an
anchor at an angle a to a node's centre and r the angle of its radius, all products lie between
|anchor| M cos(a + r) and |anchor| M cos(a - r).

Descent is level by level for many anchors at once, an anchor visiting only nodes whose bounds meet its
window and beat what it has found; leaves, best bound first, are verified with exact integer products.

Candidates are dealt by hash into blocks of some ``BLOCK_ROWS``, each a tree of its own that is written
once; copies of a vector share a leaf of radius zero. Anchors come in groups of at most ``ANCHOR_BYTES``,
which are broadcast; a task carries what each anchor has found from tree to tree and gives k rows a window
at most, so trees stay where they are.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm._common import Written, named, written

BLOCK_ROWS = 4096
LEAF = 512
FANOUT = 16
ANCHOR_BYTES = 16 << 20
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
EXACT = 2.0**53  # integers that doubles and their sums hold exactly
LONG = 2**63 - 1
NONE = -LONG - 1


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def is_valid(vector: Column) -> Column:
    """Neither null nor with null or non-finite components, nor such as overflow when scaled."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(2.0**54))), F.lit(False))


@dataclass
class Tree:
    """A level's nodes are runs of the points: level by level their starts, ends, centres, radii and first children."""

    points: np.ndarray  # whole numbers
    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    norm: float  # M
    starts: list[np.ndarray] = field(default_factory=list)
    ends: list[np.ndarray] = field(default_factory=list)
    centres: list[np.ndarray] = field(default_factory=list)  # on the sphere, norm M
    radii: list[np.ndarray] = field(default_factory=list)  # angles
    parents: list[np.ndarray] = field(default_factory=list)


def augmented(points: np.ndarray, norm: float) -> np.ndarray:
    """The points with the component that brings each to the norm."""
    x = points.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))])


def _spread(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own centre of each point, indices of the centres): farthest first, until the radius has halved or FANOUT stand."""
    picked, own = [0], np.zeros(len(x), np.int64)
    near = ((x - x[0]) ** 2).sum(1)
    goal = near.max() / 4
    while len(picked) < FANOUT and near.max() > goal:
        far = int(near.argmax())
        d = ((x - x[far]) ** 2).sum(1)
        own[d < near] = len(picked)
        near = np.minimum(near, d)
        picked.append(far)
    return own, np.array(picked)


def build(points: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> Tree:
    """The cover tree of a block; nodes of LEAF points, or whose points are all alike, are leaves."""
    order = np.lexsort((rows, ids))
    points, ids, rows, labels = points[order], ids[order], rows[order], labels[order]
    norm = float(np.sqrt((points.astype(float) ** 2).sum(1).max())) if len(points) else 0.0
    x, at = augmented(points, norm), np.arange(len(points))
    levels = []
    open_ = [(0, len(points), 0, -1)]  # start, end, centre (a place in ``at``), parent
    while open_:
        level, below = [], []
        for start, end, centre, parent in open_:
            own = x[at[start:end]]
            c = x[centre]
            radius = np.sqrt(((own - c) ** 2).sum(1).max())
            level.append((start, end, c, radius, parent))
            if end - start <= LEAF or radius == 0 or norm == 0:
                at[start:end].sort()  # by id: of a leaf's equal scores the first stay
                continue
            # The node's centre comes first: nested.
            first = int(np.flatnonzero(at[start:end] == centre)[0])
            swap = np.r_[first, np.delete(np.arange(end - start), first)]
            at[start:end] = at[start:end][swap]
            group, picked = _spread(x[at[start:end]])
            sort = np.argsort(group, kind="stable")
            centres = at[start:end][picked]
            at[start:end] = at[start:end][sort]
            sizes = np.bincount(group, minlength=len(picked))
            for k, n in enumerate(sizes):
                if n:
                    below.append((start, start + n, centres[k], len(level) - 1))
                    start += n
        levels.append(level)
        open_ = below
    small = np.int32 if np.abs(points).max(initial=0) < 2**31 else np.int64
    tree = Tree(points[at].astype(small), ids[at], rows[at], labels[at], norm)
    for level in levels:
        tree.starts.append(np.array([r[0] for r in level]))
        tree.ends.append(np.array([r[1] for r in level]))
        tree.centres.append(np.array([r[2] for r in level]))
        tree.radii.append(2 * np.arcsin(np.clip(np.array([r[3] for r in level]) / (2 * norm or 1), 0, 1)))
        tree.parents.append(np.array([r[4] for r in level]))
    return tree


class Best:
    """For each anchor the k best hits found: score (largest first), then smaller id, then row."""

    def __init__(self, anchors: int, k: int):
        self.k, self.floor = k, np.full(anchors, NONE)
        self.held = [np.zeros(0, np.int64)] + [np.zeros(0, np.int64) for _ in range(3)]  # anchor, score, id, row

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(anchor):
            return
        own = np.isin(self.held[0], anchor)
        a, s, i, r = (np.concatenate([h[own], n]) for h, n in zip(self.held, (anchor, score, ids, rows)))
        order = np.lexsort((r, i, -s, a))
        a, s, i, r = a[order], s[order], i[order], r[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        nth = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
        keep = nth < self.k
        full = nth == self.k - 1
        self.floor[a[full]] = s[full]
        self.held = [np.concatenate([h[~own], n[keep]]) for h, n in zip(self.held, (a, s, i, r))]


@dataclass
class Anchors:
    """A group of anchors: whole vectors, labels, and each one's windows (lowest and highest score taken)."""

    rows: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    low: np.ndarray  # (anchors, windows)
    high: np.ndarray
    same_label: bool


def _products(points: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact integer products, as int64; those beyond a long are its limit."""
    largest = [float(max(x.max(initial=0), -float(x.min(initial=0)))) for x in (points, anchors)]
    if largest[0] * largest[1] * points.shape[1] < EXACT:
        return (points.astype(float) @ anchors.astype(float).T).astype(np.int64)
    exact = points.astype(object) @ anchors.astype(object).T
    return np.clip(exact, NONE, LONG).astype(np.int64)


def search(tree: Tree, anchors: Anchors, best: list[Best]) -> tuple[int, int]:
    """Adds a tree's hits to each window's best; returns (verified, all) pairs of anchors and points."""
    n, q = len(anchors.rows), anchors.vectors.astype(float)
    if not n or not len(tree.ids):
        return 0, 0
    length = np.sqrt((q * q).sum(1))
    q = np.column_stack([q, np.zeros(n)])
    reach = length * tree.norm
    slack = 1e-9 * reach + 1e-6

    def bounds(centres: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        angle = np.arccos(np.clip(centres @ q.T / np.maximum(tree.norm * length, 1e-300), -1, 1))
        wide = radii[:, None] + 1e-7  # arccos near 0 and pi is good to some 1e-8
        return reach * np.cos(np.maximum(angle - wide, 0)) + slack, reach * np.cos(np.minimum(angle + wide, np.pi)) - slack

    def floors() -> np.ndarray:
        """The score a hit must reach to be of use to any window of its anchor."""
        return np.min([np.maximum(anchors.low[:, w], b.floor) for w, b in enumerate(best)], axis=0)

    top = anchors.high.max(axis=1)
    alive, leaves = np.ones((1, n), bool), []
    for level, parents in enumerate(tree.parents):
        if level:
            alive = alive[parents]
        upper, lower = bounds(tree.centres[level], tree.radii[level])
        alive &= (upper >= floors()) & (lower <= top)
        inner = np.zeros(len(parents), bool)
        if level + 1 < len(tree.parents):
            inner[tree.parents[level + 1]] = True
        for k in np.flatnonzero(~inner & alive.any(axis=1)):
            leaves.append((np.where(alive[k], upper[k], -np.inf).max(), tree.starts[level][k], tree.ends[level][k], upper[k], alive[k]))
    verified = 0
    for _, start, end, upper, open_ in sorted(leaves, key=lambda x: (-x[0], x[1])):
        for a in range(start, end, LEAF):  # leaves of equal points may be long
            b = min(a + LEAF, end)
            at = np.flatnonzero(open_ & (upper >= floors()))
            if not len(at):
                continue
            verified += len(at) * (b - a)
            scores = _products(tree.points[a:b], anchors.vectors[at])
            same = tree.labels[a:b, None] == anchors.labels[at]
            use = (same if anchors.same_label else ~same) & (tree.rows[a:b, None] != anchors.rows[at])
            for w, found in enumerate(best):
                hit = use & (scores >= np.maximum(anchors.low[at, w], found.floor[at])) & (scores <= anchors.high[at, w])
                if hit.sum() > found.k * len(at):
                    # No more than the leaf's own k best can stay; its points are in the order of ties.
                    order = np.argsort(np.where(hit, -np.maximum(scores, NONE + 1), LONG), axis=0, kind="stable")[: found.k]
                    few = np.zeros_like(hit)
                    np.put_along_axis(few, order, True, axis=0)
                    hit &= few
                point, anchor = np.nonzero(hit)
                found.add(at[anchor], scores[point, anchor], tree.ids[a:b][point], tree.rows[a:b][point])
    return verified, n * len(tree.ids)


def _plant(table: pa.Table) -> pa.Table:
    """A block's tree, as a pickled dictionary of arrays."""
    dim = len(table.column("whole")[0])
    points = table.column("whole").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    tree = build(points, *(table.column(c).to_numpy() for c in ("id", "row", "label")))
    return pa.table({"block": table.column("block")[:1], "tree": pa.array([pickle.dumps(vars(tree))], pa.binary())})


def plant(rows: DataFrame, count: int) -> DataFrame:
    """(block, tree) of rows (id, row, label, whole): each block is a task's work, and so a few MB."""
    blocks = max(1, -(-count // BLOCK_ROWS))
    tasks = blocks if blocks < 1000 else blocks // 8
    cut = rows.select("id", "row", "label", "whole", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(blocks)).cast("int").alias("block"))
    return written(cut.repartition(tasks, "block").groupBy("block").applyInArrow(_plant, "block int, tree binary"), "trees")


def _search_all(held, k: int):
    def run(batches):
        anchors = Anchors(**held.value)
        best = [Best(len(anchors.rows), k) for _ in range(anchors.low.shape[1])]
        for batch in batches:
            for tree in batch.column("tree"):
                search(Tree(**pickle.loads(tree.as_py())), anchors, best)
        for w, b in enumerate(best):
            at, score, ids, rows = b.held
            yield pa.RecordBatch.from_arrays([pa.array(anchors.rows[at]), pa.array(np.full(len(at), w, np.int32)), pa.array(score), pa.array(ids), pa.array(rows)], names=["anchor", "window", "score", "id", "row"])

    return run


def _found(trees: DataFrame, asked: DataFrame, count: int, dim: int, k: int, same_label: bool) -> DataFrame:
    """(anchor, window, rank, score, id, row) for anchors (row, whole, label, low, high: a window each)."""
    spark = trees.sparkSession
    groups = max(1, -(-count * dim * 16 // ANCHOR_BYTES))  # 8 bytes a component, doubled for what a hash deals unevenly
    cut = written(asked.withColumn("group", F.pmod(F.xxhash64("row", F.lit(4)), F.lit(groups))), "asked")
    out: Written | None = None
    for g in range(groups):
        own = cut.where(F.col("group") == g).drop("group").orderBy("row").toArrow()
        if not own.num_rows:
            continue
        matrix = lambda c, width: own.column(c).combine_chunks().flatten().to_numpy().reshape(-1, width)
        windows = len(own.column("low")[0])
        anchors = Anchors(own.column("row").to_numpy(), matrix("whole", dim), own.column("label").to_numpy(), matrix("low", windows), matrix("high", windows), same_label)
        hits = trees.mapInArrow(_search_all(spark.sparkContext.broadcast(vars(anchors)), k), "anchor long, window int, score long, id long, row long")
        nth = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row"))
        best = hits.withColumn("rank", nth).where(F.col("rank") <= k)
        if out is None:
            out = Written(best, "found")
        else:
            best.write.mode("append").parquet(out.path)
    return spark.createDataFrame([], "anchor long, window int, score long, id long, row long, rank int") if out is None else spark.read.schema(out.df.schema).parquet(out.path)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = 256,
) -> DataFrame:
    """For each anchor and each of its positives the hardest negatives in the positive's window.

    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Scores are inner
    products of the vectors' components times ``scale``, rounded down. Positives are an anchor's best
    other rows of its label; negatives are rows of another label that score ``low`` to ``high`` percent of the
    positive. Higher scores come first, ties by smaller id. Rows with a null id, label or vector, with an
    empty vector, with null or non-finite components (or of 2^54 and more), and with another than the most
    frequent dimension take no part. Rows that repeat an id are rows of their own; so an anchor may be
    listed twice. Products beyond a long are its limit. No anchor, or none with a positive: no rows.
    """
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    picked = vectors.select(
        named(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), named(vector).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & is_valid(F.col("v")) & (F.size("v") > 0))
    common = picked.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], shape)
    same = picked.where(F.size("v") == common["d"])
    held = written(same.select("id", "label", whole(F.col("v"), scale).alias("whole"), "is_anchor", F.monotonically_increasing_id().alias("row")), "candidates")
    trees = plant(held, held.count())
    anchors = held.where("is_anchor").select("row", "id", "label", "whole")
    count = anchors.count()
    any_score = anchors.select("row", "label", "whole", F.array(F.lit(NONE)).alias("low"), F.array(F.lit(LONG)).alias("high"))
    pos = _found(trees, any_score, count, common["d"], positives, True)
    share = lambda percent, round_: round_(F.col("score").cast("decimal(25,0)") * percent / 100).cast("long")
    edges = pos.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", share(low, F.ceil).alias("low"), share(high, F.floor).alias("high")))).alias("e"))  # ``positives`` at most
    edge = lambda side, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("e", i)[side], F.lit(none).cast("long")))
    windows = anchors.join(edges, F.col("row") == F.col("anchor")).select("row", "label", "whole", edge("low", 1).alias("low"), edge("high", 0).alias("high"))
    neg = _found(trees, windows, count, common["d"], negatives, False)
    given = pos.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    told = neg.select("anchor", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(given, ["anchor", "window"])
    return told.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
