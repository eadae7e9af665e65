"""Nearest neighbours by additive quantisation.

A vector is its norm times a unit vector, which is approximated by a sum of one codeword from each of
``BOOKS`` full-dimensional codebooks. The books come in ``GROUPS``: each is fitted, on a bounded sample
(``SAMPLE_ROWS`` vectors of the smallest hashes), to what the groups before leave over, brought to unit
length, and encodes it by beam search over its books jointly. Vectors of tight clusters leave over little,
others much; at unit length the same books serve both. Each group's sum has a gain a vector, all of them by
least squares, so the error is orthogonal to every group's sum: a cluster's queries, which point along its
first codeword, don't see it. Gains and the norm are stored with the codes. A query is scored against codes by
adding one entry of its lookup table a book, times the group's gain and the norm; a query's ``RERANK`` best by
that score are reranked on the original vectors in double precision.

The index is packed into blocks of some ``BLOCK_ROWS`` vectors, which are scanned where they are written:
queries come to them, in groups of ``QUERY_BYTES`` at most that are broadcast one after another, and a task
carries each query's best from block to block. Only codes, gains and norms (48 bytes a vector) are read for it;
original vectors stay where they are until the few that are reranked are joined by their place in the
index. Equal vectors of a block are one entry with its k + 1 smallest ids: no more of them can be among a
query's k nearest, ties going to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewarden.llm._common import Written, named, written

GROUPS = (1, 7, 8, 8)  # books of each group; the first is a coarse one
BOOKS = sum(GROUPS)
WORDS = 256
BEAM = 4
SAMPLE_ROWS = 8192
BLOCK_ROWS = 8192
QUERY_ROWS = 512  # whose lookup tables are held at a time
QUERY_BYTES = 8 << 20
RERANK = 160


def is_valid(vector: Column) -> Column:
    """Not null nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _k_means(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (lost := np.flatnonzero(n == 0)).size:
            centres[lost] = x[rng.choice(len(x), lost.size)]
    return centres


def fit_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 7) -> np.ndarray:
    """(books, words, dimension): each book is fitted to what the books before leave over."""
    rng, rest, out = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(books):
        c = _k_means(rest, words, rng).astype(np.float32)
        rest = rest - c[np.argmin((c**2).sum(1) - 2 * rest @ c.T, axis=1)]
        out.append(c)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes, reconstructions' squared norms) by beam search; ties go to the smaller codeword."""
    m, k, d = books.shape
    gram = np.einsum("mkd,nld->mnkl", books, books).astype(np.float32)
    all_codes, all_norms = [], []
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024].astype(np.float32)
        n = len(part)
        dots = (part @ books.reshape(m * k, d).T).reshape(n, m, k)
        codes, loss, norms = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32), np.zeros((n, 1), np.float32)
        for b in range(m):
            own = np.diag(gram[b, b])
            cross = np.zeros((n, codes.shape[1], k), np.float32)
            for a in range(b):
                cross += gram[a, b][codes[:, :, a]]
            added = own + 2 * cross
            total = loss[:, :, None] + added - 2 * dots[:, None, b]
            flat = total.reshape(n, -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            rows = np.arange(n)[:, None]
            best = best[rows, np.argsort(flat[rows, best], axis=1, kind="stable")]
            came, word = best // k, best % k
            codes = np.concatenate([codes[rows, came], word[:, :, None]], axis=2)
            norms = norms[rows, came] + added[rows, came, word]
            loss = flat[rows, best]
        all_codes.append(codes[:, 0].astype(np.uint8))
        all_norms.append(norms[:, 0])
    return np.concatenate(all_codes), np.concatenate(all_norms)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(axis=1, keepdims=True))


def _encode_group(rest: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, sums of their codewords, what their best multiple leaves over) of vectors of any length, zero included."""
    codes = encode(rest / np.maximum(_lengths(rest), 1e-300), books)[0]
    sums = np.zeros_like(rest)
    for m, words in enumerate(books):
        sums += words[codes[:, m]]
    gain = (rest * sums).sum(1) / np.maximum((sums**2).sum(1), 1e-300)
    return codes, sums, rest - gain[:, None] * sums


def _in_groups(books: np.ndarray) -> list[np.ndarray]:
    return np.split(books, np.cumsum(GROUPS)[:-1])


def fit_groups(units: np.ndarray) -> np.ndarray:
    """The books of all groups, (BOOKS, WORDS, dimension)."""
    rest, out = units.astype(np.float64), []
    for g, n in enumerate(GROUPS):
        length = _lengths(rest)
        some = length[:, 0] > 1e-12  # where rounding is all that is left, nothing is learnt
        out.append(fit_codebooks((rest[some] / length[some]) if some.any() else units, n, seed=7 + g))
        rest = _encode_group(rest, out[-1])[2]
    return np.concatenate(out)


def encode_groups(units: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, gains of the groups) of unit vectors."""
    all_codes, all_gains = [], []
    for at in range(0, len(units), 1024):
        part = rest = units[at : at + 1024]
        codes, sums = [], []
        for own in _in_groups(books):
            c, s, rest = _encode_group(rest, own)
            codes.append(c)
            sums.append(s)
        s = np.stack(sums, axis=1)
        gram = np.einsum("ngd,nhd->ngh", s, s)
        gram += (1e-10 * np.trace(gram, axis1=1, axis2=2)[:, None, None] + 1e-300) * np.eye(len(GROUPS))
        all_codes.append(np.concatenate(codes, axis=1))
        all_gains.append(np.linalg.solve(gram, np.einsum("ngd,nd->ng", s, part)[..., None])[..., 0].astype(np.float32))
    return np.concatenate(all_codes), np.concatenate(all_gains)


def _matrix(values) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in values])


def unit_vectors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, norms) in double precision, for components of any finite size; no row is zero."""
    top = np.abs(x).max(axis=1, keepdims=True)
    scaled = x / top
    length = np.sqrt((scaled**2).sum(axis=1, keepdims=True))
    return scaled / length, np.minimum(top * length, np.finfo(float).max)[:, 0]


def _learn(part: pd.DataFrame) -> pd.DataFrame:
    books = fit_groups(unit_vectors(_matrix(part.sort_values("vec_id")["vector"]))[0])
    return pd.DataFrame({"books": [books.tobytes()]})


def _pack_index(books: np.ndarray, keep: int):
    """A row a block: for each distinct vector its codes, gains and norm, and for the rerank the vector and its ``keep`` smallest ids."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        x = _matrix(part["vector"]) + 0.0
        _, first, same = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_index=True, return_inverse=True)
        order = np.argsort(same, kind="stable")
        nth = np.arange(len(order)) - np.concatenate([[0], np.cumsum(np.bincount(same))[:-1]])[same[order]]
        order = order[nth < keep]
        units, norms = unit_vectors(x[first])
        codes, gains = encode_groups(units, books)
        return pd.DataFrame({
            "block": part["block"].iloc[:1].to_numpy(), "codes": [codes.tobytes()], "gains": [gains.astype("<f4").tobytes()], "norms": [norms.astype("<f8").tobytes()],
            "vectors": [x[first].astype("<f8").tobytes()], "ids": [part["vec_id"].to_numpy()[order].astype("<i8").tobytes()], "sizes": [np.bincount(same[order]).astype("<i4").tobytes()],
        })

    return run


def _entries(batches):
    """(block, at, original, ids) of the packed index: its entries as rows."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            sizes = np.frombuffer(r.sizes, "<i4")
            vectors = np.frombuffer(r.vectors).reshape(len(sizes), -1)
            ids = np.split(np.frombuffer(r.ids, "<i8"), np.cumsum(sizes)[:-1])
            for at in range(0, len(sizes), 1024):
                own = slice(at, at + 1024)
                yield pd.DataFrame({"block": np.full(len(sizes[own]), r.block, np.int32), "at": np.arange(at, at + len(sizes[own]), dtype=np.int32), "original": list(vectors[own]), "ids": ids[own]})


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products over the last axis, one dimension after another: equal vectors score equally."""
    out = np.zeros(np.broadcast_shapes(q.shape[:-1], x.shape[:-1]))
    for d in range(x.shape[-1]):
        out += q[..., d] * x[..., d]
    return out


def look_up(queries: np.ndarray, codes: np.ndarray, gains: np.ndarray, norms: np.ndarray, books: np.ndarray, keep: int):
    """For each query (entries, approximate scores) of the ``keep`` best of a block by lookup tables, stored gains and norms."""
    tables = np.einsum("qd,mkd->qmk", queries, books)
    codes, gains = np.ascontiguousarray(codes.T), np.ascontiguousarray(gains.T)
    ends = np.cumsum(GROUPS)
    for t in tables:
        approx = np.zeros(len(norms), np.float32)
        for gain, begin, end in zip(gains, ends - GROUPS, ends):
            part = t[begin][codes[begin]]
            for m in range(begin + 1, end):
                part += t[m][codes[m]]
            approx += gain * part
        score = approx * norms
        best = np.argpartition(-score, keep - 1)[:keep] if keep < len(score) else np.arange(len(score))
        yield best, score[best]


def _scan(held, books: np.ndarray, keep: int, most: int):
    """For each query the ``most`` best of a task's blocks, ``keep`` of a block at most."""

    def run(batches):
        ids, q = held.value
        best = [(np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, np.int32))] * len(ids)
        for batch in batches:
            for r in batch.itertuples(index=False):
                norms = np.frombuffer(r.norms)
                codes = np.frombuffer(r.codes, np.uint8).reshape(len(norms), -1)
                gains = np.frombuffer(r.gains, np.float32).reshape(len(norms), -1)
                for a in range(0, len(ids), QUERY_ROWS):
                    for i, (top, score) in enumerate(look_up(q[a : a + QUERY_ROWS], codes, gains, norms, books, keep), a):
                        s, at, block = (np.concatenate(x) for x in zip(best[i], (score, top.astype(np.int32), np.full(len(top), r.block, np.int32))))
                        if len(s) > most:
                            stay = np.argpartition(-s, most - 1)[:most]
                            s, at, block = s[stay], at[stay], block[stay]
                        best[i] = s, at, block
        for a in range(0, len(ids), QUERY_ROWS):
            part = best[a : a + QUERY_ROWS]
            s, at, block = (np.concatenate(x) for x in zip(*part))
            yield pd.DataFrame({"query_id": np.repeat(ids[a : a + QUERY_ROWS], [len(x[0]) for x in part]), "block": block, "at": at, "approx": s.astype(float)})

    return run


def _full_blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def _share(rerank: int, blocks: int) -> int:
    """How many of a query's ``rerank`` best may lie in one of ``blocks`` random blocks: four deviations and some over the mean."""
    mean = rerank / blocks
    return min(rerank, int(np.ceil(mean + 4 * np.sqrt(mean))) + 8)


def build_index(vectors: DataFrame, k: int) -> tuple[DataFrame, int, np.ndarray]:
    """(packed index, number of its blocks, codebooks) of valid vectors (vec_id, vector)."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS)
    row = sample.groupBy().applyInPandas(_learn, "books binary").first()
    books = np.frombuffer(bytes(row["books"]), np.float32).reshape(BOOKS, WORDS, -1)
    blocks = _full_blocks(vectors.count(), BLOCK_ROWS)
    cut = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    tasks = blocks if blocks < 1000 else blocks // 8
    packed = cut.repartition(tasks, "block").groupBy("block").applyInPandas(_pack_index(books, k + 1), "block int, codes binary, gains binary, norms binary, vectors binary, ids binary, sizes binary")
    return written(packed, "index"), blocks, books


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """For each query id its k nearest other rows by inner product: query_id, rank (from 1), vec_id, score.

    Nearest first, ties to the smaller vec_id; all candidates if fewer than k. Vectors that is_valid
    rejects, null ids, and vectors of another than the most frequent dimension take no part. Rows that
    repeat a vec_id are candidates once each; of queries with one id the smallest vector asks. No valid
    vector, or no query: no rows. Components may have any finite size; products beyond double's range are infinite.
    """
    picked = vectors.select(named(vec_id).cast("long").alias("vec_id"), named(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(is_valid(F.col("vector")) & F.col("vec_id").isNotNull())
    common = picked.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    valid = picked.where(F.size("vector") == common["d"])
    index, blocks, books = build_index(valid.select("vec_id", "vector"), k)
    asked = valid.where("is_query").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("query"))
    # 4 bytes a component, doubled for what a hash deals unevenly.
    groups = _full_blocks(asked.count() * common["d"] * 8, QUERY_BYTES)
    cut = written(asked.withColumn("group", F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(groups))), "asked")
    rerank, near = max(rerank, 2 * k + 1), None
    by_approx = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("approx"), "block", "at"))
    for g in range(groups):
        own = cut.where(F.col("group") == g).select("query_id", "query").orderBy("query_id").toPandas()
        if not len(own):
            continue
        held = vectors.sparkSession.sparkContext.broadcast((own["query_id"].to_numpy(np.int64), unit_vectors(_matrix(own["query"]))[0].astype(np.float32)))
        scored = index.select("block", "codes", "gains", "norms").mapInPandas(_scan(held, books, _share(rerank, blocks), rerank), "query_id long, block int, at int, approx double")
        best = scored.withColumn("nth", by_approx).where(F.col("nth") <= rerank).select("query_id", "block", "at")
        if near is None:
            near = Written(best, "near")
        else:
            best.write.mode("append").parquet(near.path)
    if near is None:
        return vectors.sparkSession.createDataFrame([], schema)
    near = vectors.sparkSession.read.schema(near.df.schema).parquet(near.path)

    entries = index.select("block", "vectors", "ids", "sizes").mapInPandas(_entries, "block int, at int, original array<double>, ids array<long>")
    product = F.aggregate(F.zip_with("query", "original", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    found = near.join(entries, ["block", "at"]).join(asked, "query_id").select("query_id", product.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
