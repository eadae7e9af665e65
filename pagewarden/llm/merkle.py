"""A Merkle manifest of a dataset by time-forward processing.

Leaves are digests of rows. Within a tree (a language) they ascend by id, and every ``FAN`` consecutive
nodes become one; the trees' roots are the leaves of one more tree. Nodes are labelled in post-order (the
last leaf below a node, then its level), so that a child's label is always smaller than its parent's. An
upward sweep visits labels in order: a node takes its children's digests from a priority queue, where they
wait under its label, and sends its own to its parent's label. The reversed sweep visits labels from the
root down: a node takes what lies beside and above it from a queue and sends each child that, and the
child's siblings.

The queue is external: leaves are numbered and cut into blocks of ``FAN ** LEVELS``, each a whole subtree,
that Spark's shuffle sorts and delivers; a block's own queue holds at most FAN - 1 messages a level. Blocks'
roots are the leaves of the next tier, and a written table hands tier to tier, so that even 10^12 leaves
take four tiers. No tree is ever in one task, and a tier is recomputed from the table before it.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from heapq import heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm._common import lower_ascii, named, written

FAN = 8
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(fields: list[Column]) -> Column:
    """SHA-256, as 32 bytes, of the fields: - for null, else UTF-8 byte count, a colon, the value."""
    parts = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def joined(digests: list[bytes]) -> bytes:
    """The digest of digests, taken as hex text one after another."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


class Run(NamedTuple):
    """A node of a sweep: its level within the block (1 above leaves), its place there, its children's digests."""

    level: int
    place: int
    children: list[bytes]


def sweep_up(leaves, levels: int) -> tuple[bytes, list[Run]]:
    """The root of one block's leaves after ``levels`` levels, and all its runs by label.

    ``leaves`` come in order. The queue's entries are (last leaf below the parent, level of the parent, child, digest).
    """
    leaves = list(leaves)
    last, queue, runs = len(leaves) - 1, [], []
    root = leaves[0] if not levels else b""

    def send(level: int, place: int, digest: bytes) -> None:
        end = min((place // FAN + 1) * FAN ** (level + 1) - 1, last)
        heappush(queue, (end, level + 1, place, digest))

    for i, leaf in enumerate(leaves):
        if levels:
            send(0, i, leaf)
        while queue and queue[0][0] <= i:
            end, level, child, digest = heappop(queue)
            run = Run(level, child // FAN, [digest])
            while queue and queue[0][:2] == (end, level):
                run.children.append(heappop(queue)[3])
            runs.append(run)
            own = joined(run.children)
            if level < levels:
                send(level, run.place, own)
            else:
                root = own
    return root, runs


Path = tuple[tuple[bytes, bytes], ...]  # level by level, what stands left and right of a node, as hex text


def sweep_down(runs: list[Run], levels: int, above: Path) -> dict[int, Path]:
    """Each leaf's path to the root: its siblings, its parent's, and so on, then ``above`` of the block."""
    if not levels:
        return {0: above}
    queue, paths = [], {}
    order = {(r.level, r.place): -k for k, r in enumerate(runs)}  # labels reversed
    heappush(queue, (order[levels, 0], above))
    for run in reversed(runs):
        _, path = heappop(queue)
        text = [d.hex().encode() for d in run.children]
        for k in range(len(text)):
            own = ((b"".join(text[:k]), b"".join(text[k + 1 :])), *path)
            place = run.place * FAN + k
            if run.level == 1:
                paths[place] = own
            else:
                heappush(queue, (order[run.level - 1, place], own))
    return paths


def fold(leaf: bytes, path: Path) -> bytes:
    """The root that a leaf and its path give."""
    for left, right in path:
        leaf = hashlib.sha256(left + leaf.hex().encode() + right).digest()
    return leaf


def proof(path: Path) -> str:
    """SHA-256 of all siblings, level by level, left to right."""
    return hashlib.sha256(b"".join(left + right for left, right in path)).hexdigest()


def _height(n: int) -> int:
    """Levels between ``n`` leaves and their root."""
    h = 0
    while FAN**h < n:
        h += 1
    return h


_PATH = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
_PATHS = "tree long, block long, path array<struct<left: binary, right: binary>>, subroot binary"


def _levels(nodes: pa.Table, levels: int) -> int:
    """How many of a tier's levels a block has: all its nodes have the size of their tree."""
    return min(levels, _height(nodes.column("n")[0].as_py()))


def _rise(levels: int):
    def root_of(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("place")
        root, _ = sweep_up(nodes.column("digest").to_pylist(), _levels(nodes, levels))
        n = -(-nodes.column("n")[0].as_py() // FAN**levels)
        return pa.table({"tree": nodes.column("tree")[:1], "place": nodes.column("block")[:1], "n": pa.array([n], pa.int64()), "digest": pa.array([root], pa.binary())})

    return root_of


def _paths_within(nodes: pa.Table, above: pa.Table, levels: int) -> dict[int, Path]:
    levels = _levels(nodes, levels)
    path = tuple((x["left"], x["right"]) for x in above.column("path")[0].as_py())
    return sweep_down(sweep_up(nodes.column("digest").to_pylist(), levels)[1], levels, path)


def _descend(levels: int):
    """What lies above each node of a block: a block of the tier below."""

    def paths_of(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("place")
        paths = _paths_within(nodes, above, levels)
        packed = pa.array([[{"left": a, "right": b} for a, b in paths[i]] for i in range(nodes.num_rows)], _PATH)
        return pa.table({"tree": nodes.column("tree"), "block": nodes.column("place"), "path": packed, "subroot": pa.array(above.column("subroot").to_pylist() * nodes.num_rows, pa.binary())})

    return paths_of


def _conclude(levels: int):
    """The lowest tier's reversed sweep: a leaf's path is used at once and not kept."""

    def proofs_of(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("place")
        paths = _paths_within(nodes, above, levels)
        leaves, tampered = nodes.column("digest").to_pylist(), nodes.column("tampered").to_pylist()
        return pa.table(
            {
                "doc_id": nodes.column("doc_id"),
                "leaf": pa.array([d.hex() for d in leaves], pa.string()),
                "subroot": pa.array([above.column("subroot")[0].as_py().hex()] * len(leaves), pa.string()),
                "proof_sha256": pa.array([proof(paths[i]) for i in range(len(leaves))], pa.string()),
                "folded_root": pa.array([fold(d if t is None else t, paths[i]).hex() for i, (d, t) in enumerate(zip(leaves, tampered))], pa.string()),
            }
        )

    return proofs_of


class Forest:
    """Trees in tiers: ``nodes`` has tree, place (from 0 within the tree), n (leaves of the tree) and digest."""

    def __init__(self, nodes: DataFrame, levels: int = LEVELS):
        self.levels = levels
        self.tiers = [self._in_blocks(nodes)]
        size = nodes.agg(F.max("n")).first()[0] or 0
        while size > 1:
            up = self.tiers[-1].where("n > 1").groupBy("tree", "block").applyInArrow(_rise(levels), "tree long, place long, n long, digest binary")
            self.tiers.append(self._in_blocks(written(up, "tier")))
            size = -(-size // FAN**levels)

    def _in_blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.expr(f"place div {FAN**self.levels}"))

    def roots(self) -> DataFrame:
        """(tree, digest): in the tier where a tree has one node left, that is its root."""
        return reduce(DataFrame.unionByName, (t.where("n = 1").select("tree", "digest") for t in self.tiers))

    def down(self, k: int, blocks: DataFrame, step, shape: str) -> DataFrame:
        """The reversed sweep of tier ``k``, from what lies above each of its blocks."""
        blocks = blocks.toDF("of_tree", "of_block", "path", "subroot")  # names that the tier does not have
        return self.tiers[k].groupBy("tree", "block").cogroup(blocks.groupBy("of_tree", "of_block")).applyInArrow(step(self.levels), shape)

    def above_blocks(self, above: DataFrame) -> DataFrame:
        """What lies above each block of the lowest tier; ``above`` has tree, path and subroot of every root."""
        blocks = None
        for k in reversed(range(len(self.tiers))):
            lone = self.tiers[k].where("n = 1").select("tree").join(above, "tree").select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot")
            blocks = lone if blocks is None else blocks.unionByName(lone)
            if k:
                blocks = written(self.down(k, blocks, _descend, _PATHS), "paths")
        return blocks


def _number_runs(by: int):
    """Adds to sorted rows their task's number and their place in the run of equal first ``by`` columns."""

    def run(batches):
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            own = []
            for key in zip(*(batch.column(i).to_pylist() for i in range(by))):
                at = at + 1 if key == last else 0
                last = key
                own.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(own), pa.int32()), pa.array(own, pa.int64())], names=[*batch.schema.names, "_part", "_own"])

    return run


def ranked(rows: DataFrame, by: list[str], within: list[str], place: str, total: str, parts: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their place (from 0) in the order of ``within`` in their group and the group's size; and (by..., total).

    Rows are dealt out by ranges of all these columns, which must tell any two rows apart, so that no
    group is one task's; a range's start is the count of its group's rows in the ranges before it.
    """
    first = [*by, *(c for c in rows.columns if c not in by)]
    order = [named(c) for c in (*by, *within)]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*map(named, first)).schema)
    dealt = rows.select(*map(named, first)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranges = written(dealt.mapInArrow(_number_runs(len(by)), f"{shape}, _part int, _own long"), "ranges")
    counts = ranges.groupBy(*map(named, by), "_part").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*map(named, by))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = [f"_g{i}" for i in range(len(by))]
    starts = written(counts.select(*(named(b).alias(k) for b, k in zip(by, keys)), F.col("_part").alias("_p"), before.alias("_start"), F.sum("_n").over(whole).alias(total)), "starts")
    same = reduce(lambda a, b: a & b, (named(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)), F.col("_part") == F.col("_p"))
    numbered = ranges.join(starts, same).select(*map(named, rows.columns), (F.col("_own") + F.col("_start")).cast("long").alias(place), total)
    return numbered, starts.groupBy(*(F.col(k).alias(b) for b, k in zip(by, keys))).agg(F.max(total).alias(total))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", doc_id: str = "doc_id", text: str = "text", tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a tree ascend by doc_id (nulls first; of one doc_id by their digests), trees by name (null
    first). ``tampered`` marks the rows whose text is checked with A-Z lower-cased against the manifest;
    by default those where 3 divides the crc32 of the doc_id. Repeated rows are leaves like any other. A
    lone leaf is its tree's root, a lone tree's root is the root; an empty table gives no rows. Columns
    that are not among ``fields`` are not read.
    """
    if tampered is None:
        tampered = F.crc32(named(doc_id).cast("string").cast("binary")) % 3 == 0
    changed = F.coalesce(tampered & (lower_ascii(named(text)) != named(text)), F.lit(False))
    other = [lower_ascii(named(f)) if f == text else named(f) for f in fields]
    leaves = written(
        docs.select(
            named(tree).alias("name"), named(doc_id).alias("doc_id"), digest_of([named(f) for f in fields]).alias("digest"), F.monotonically_increasing_id().alias("row"),
            F.when(changed, digest_of(other)).alias("tampered"),
        ),
        "leaves",
    )
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // 250_000))
    placed, names = ranked(leaves, ["name"], ["doc_id", "digest", "row"], "place", "n", parts)
    trees, _ = ranked(written(names.select("name", F.lit(0).alias("all")), "names"), ["all"], ["name"], "tree", "trees", 1 + names.count() // 250_000)
    # Written: its size is known, so Spark broadcasts few trees and shuffles many, which are no hot ones then.
    trees = written(trees.select(F.col("name").alias("_name"), "tree", "trees"), "trees")
    nodes = written(placed.join(trees, F.col("name").eqNullSafe(F.col("_name"))).select("doc_id", "tree", "place", "n", "digest", "tampered"), "nodes")
    forest = Forest(nodes, levels)
    subroots = written(forest.roots(), "subroots")
    top = Forest(written(subroots.join(trees, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("trees").alias("n"), "digest"), "top"), levels)
    root = (top.roots().select(F.lower(F.hex("digest"))).first() or [None])[0]
    start = docs.sparkSession.createDataFrame([(0, [], b"")], "tree long, path array<struct<left: binary, right: binary>>, subroot binary")
    to_trees = top.down(0, top.above_blocks(start), _descend, _PATHS).select(F.col("block").alias("tree"), "path")
    above = written(to_trees.join(subroots, "tree").select("tree", "path", F.col("digest").alias("subroot")), "above")
    kind = docs.select(named(doc_id)).schema[0].dataType.simpleString()
    told = forest.down(0, forest.above_blocks(above), _conclude, f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    checked = told.withColumn("root", F.lit(root).cast("string"))
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
