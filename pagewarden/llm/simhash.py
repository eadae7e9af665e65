"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that correlate over the corpus are grouped into partitions; a dynamic programme over estimated
candidate counts then gives every partition its own threshold t_i >= -1 with sum t_i = d - m + 1, so that
two fingerprints within d bits agree up to t_i bits in at least one partition (-1: never probed). Keys
are probed, candidates verified on the whole fingerprint, and links joined into components.

Equal fingerprints are one node from the start. A bucket of more than ``PAIR_CAP`` fingerprints is not
paired: two fingerprints are within two bits exactly if their one-bit neighbourhoods meet, so its members
meet on their 65 neighbours instead, in groups of 65 at most. Both ways are exact; the second is linear.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewarden.llm._common import all_of, connected_components, fresh, named, written

MAX_BITS = 2
SHINGLE_WORDS = 3
PAIR_CAP = 64
KEY_COST = 8.0  # a shuffled key against a verified pair
PARTITION_COUNTS = (2, 3, 4)
_LANES = np.uint64(0x0101010101010101)


def _shingle_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < SHINGLE_WORDS:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS))))
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)


def fingerprints_of(texts) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is set in over half of the text's shingle hashes."""
    hashes = [_shingle_hashes(t) for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    h, n = np.concatenate([hashes[i] for i in full]), sizes[full]
    begins = np.concatenate([[0], np.cumsum(n)[:-1]])
    # Bytes count up to 255 without a carry: sum runs of 255 hashes, then the runs of each text.
    runs = -(-n // 255)
    first_run = np.concatenate([[0], np.cumsum(runs)[:-1]])
    at = np.repeat(begins, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        for byte in range(8):
            out[full] |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


@F.pandas_udf(T.LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    """The fingerprint's 64 bits as a signed long; null texts count as empty (fingerprint zero)."""
    parts = [fingerprints_of(text.iloc[i : i + 256]) for i in range(0, len(text), 256)]
    return pd.Series(np.concatenate(parts).view(np.int64) if parts else [], dtype="int64")


def _bit_sums(batches):
    both, n = np.zeros((64, 64)), 0
    for batch in batches:
        v = batch["fp"].to_numpy().view(np.uint64)
        bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        both += bits.T @ bits
        n += len(v)
    yield pd.DataFrame({"part": [TaskContext.get().partitionId() % 16], "n": [n], "both": [both.ravel()]})


def _add_sums(part: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"n": [part["n"].sum()], "both": [np.sum(np.stack(part["both"]), axis=0)]})


def _bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each two bits are set together, over all of them."""
    rows = fps.mapInPandas(_bit_sums, "part int, n long, both array<double>").groupBy("part").applyInPandas(_add_sums, "n long, both array<double>").collect()
    both = np.zeros((64, 64))
    for r in rows:
        both += np.array(r["both"]).reshape(64, 64)
    return sum(r["n"] for r in rows), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near equal width, correlated ones together."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(phi, 0)
    left, groups = list(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        group = [max(left, key=lambda b: (phi[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: (phi[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def allocate_thresholds(costs: list[dict[int, float]], budget: int) -> tuple[float, list[int]]:
    """Least total cost of thresholds that sum to ``budget``, one for each partition."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t, c in own.items():
                if s + t not in new or cost + c < new[s + t][0]:
                    new[s + t] = (cost + c, [*chosen, t])
        best = new
    return best[budget]


def plan_probes(fps: DataFrame) -> list[tuple[list[int], int]]:
    """The partitions to probe, as (bits, threshold), of the cheapest number of partitions."""
    n, both = _bit_statistics(fps)
    grouped = {m: group_bits(n, both, m) for m in PARTITION_COUNTS}
    keys = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("key")) for m, gs in grouped.items() for i, g in enumerate(gs)]
    pairs = (
        fps.select(F.explode(F.array(*keys)).alias("k"))
        .groupBy("k.m", "k.i", "k.key")
        .agg(F.count("*").alias("c"))
        .groupBy("m", "i")
        .agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs"))
    )
    equal = {(r["m"], r["i"]): r["pairs"] for r in pairs.collect()}
    p = np.diag(both) / max(n, 1)
    agree = np.clip(p**2 + (1 - p) ** 2, 0.5, 1 - 1e-9)
    choices = []
    for m, groups in grouped.items():
        costs = []
        for i, bits in enumerate(groups):
            poly = np.array([1.0, 0, 0])  # symmetric sums of the bits' odds to differ: pairs with 0, 1, 2 differing bits
            for odds in (1 - agree[bits]) / agree[bits]:
                poly[1:] += odds * poly[:-1]
            probes = np.cumsum([1, len(bits), len(bits) * (len(bits) - 1) / 2])
            costs.append({-1: 0.0} | {t: equal.get((m, i), 0.0) * poly[: t + 1].sum() + KEY_COST * n * probes[t] for t in range(MAX_BITS + 1)})
        cost, thresholds = allocate_thresholds(costs, MAX_BITS - m + 1)
        choices.append((cost, [(b, t) for b, t in zip(groups, thresholds) if t >= 0]))
    return min(choices, key=lambda x: x[0])[1]


def _flips(bits, t: int) -> list[int]:
    return [_mask(c) for k in range(1, t + 1) for c in combinations(bits, k)]


def near_links(nodes: DataFrame) -> DataFrame:
    """(a, b) links that join all of ``nodes`` (fp, rep; fp unique) within two bits into components."""
    keys = []
    for i, (bits, t) in enumerate(plan_probes(nodes)):
        own = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        keys += [F.struct(F.lit(i).alias("part"), own.alias("key"), F.lit(True).alias("own"))]
        keys += [F.struct(F.lit(i).alias("part"), own.bitwiseXOR(F.lit(x)).alias("key"), F.lit(False).alias("own")) for x in _flips(bits, t)]
    keyed = nodes.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select("fp", "rep", "k.part", "k.key", "k.own")
    # Written, so that both sides of the join are plain exchanges and AQE may split a hot key.
    sizes = written(keyed.groupBy("part", "key").agg(F.count("*").alias("n"), F.count_if("own").alias("owned")).where("n > 1 AND owned > 0").drop("owned"), "sizes")
    met = written(keyed.join(sizes, ["part", "key"]), "buckets")

    cold = met.where(F.col("n") <= PAIR_CAP)
    a = cold.where("own").select("part", "key", F.col("fp").alias("fp_a"), F.col("rep").alias("a"))
    b = cold.select("part", "key", F.col("fp").alias("fp_b"), F.col("rep").alias("b"), F.col("own").alias("own_b"))
    close = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= MAX_BITS
    once = (F.col("fp_a") != F.col("fp_b")) & (~F.col("own_b") | (F.col("fp_a") < F.col("fp_b")))
    paired = a.join(b, ["part", "key"]).where(once & close).select("a", "b")

    hot = met.where(F.col("n") > PAIR_CAP).select("fp", "rep").distinct()
    ball = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_mask([x]))) for x in range(64)))
    met_on = hot.select("rep", F.explode(ball).alias("z")).groupBy("z").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    starred = met_on.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a <> b")
    return paired.unionByName(starred)


def find_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents are linked if their fingerprints differ in at most two bits; component_id is the smallest
    doc_id reachable. Null and wordless texts have fingerprint zero and are linked like any other. Rows
    without a doc_id get a component but neither name nor bridge one; an empty table gives no rows.
    """
    fps = written(docs.select(named(doc_id).alias("doc_id"), fingerprint(named(text)).alias("fp")), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = connected_components(near_links(nodes.where("rep IS NOT NULL")))
    by_fp = nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(by_fp, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents whose doc_id names their component, with all their columns, whatever their names.

    The ids to drop are a written table: Spark broadcasts it if its size is under the session's
    threshold and shuffles otherwise. Rows without a doc_id stay.
    """
    (gone,) = fresh(docs, "gone")
    dropped = written(find_components(docs, text, doc_id).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)), "dropped")
    return docs.join(dropped, named(doc_id) == F.col(gone), "left_anti").select(*all_of(docs))
