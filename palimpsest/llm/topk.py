"""Exact top-k inner products over a pivot-distance index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint

#: Bytes of query vectors sent to all tasks at once, pivots, sample rows that pivots and first bounds come from, rows in
#: an annulus, queries that a task handles together.
QUERY_BYTES, PIVOTS, SAMPLE, ANNULUS, TOGETHER = 32 << 20, 64, 4096, 64, 2048
RESULT = "query_id long, rank int, vec_id long, score long"


def integer_vectors(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as double; drops vectors that are null or hold null or non-finite components."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    rows = rows.where(x.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.col("vec_id").isNotNull())
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double")).alias("v"))


def matrix(column, width: int) -> np.ndarray:
    """An Arrow column of lists of that length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def pick_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first from the sample, which must not be empty."""
    picked = [0]
    d = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(most, len(sample)) and d.max() > 0:
        picked.append(int(d.argmax()))
        d = np.minimum(d, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)))


def search(index_rows: DataFrame, is_query, k: int = 5, scanned: bool = False) -> DataFrame:
    """The ``k`` greatest integer inner products of each query with the rows of other ids: query_id, rank, vec_id, score.

    ``index_rows``: (vec_id, v) with whole-number components, as from :func:`integer_vectors`; ``is_query`` is a Column
    over vec_id. Ties go to the smaller vec_id. An inner product needs vectors of one length: each length (they are few)
    is searched by itself. Repeated ids: each row is a candidate of other ids; one query per id and length, its least
    vector. Fewer candidates give fewer rows, an empty table none. ``scanned`` adds the number of rows that the query
    was compared with.
    """
    schema = RESULT + ", scanned long" * scanned
    found = None
    for width, n in sorted(tuple(r) for r in index_rows.groupBy(F.size("v")).count().collect()):
        part = _search(index_rows.where(F.size("v") == width), n, width, is_query, k, scanned)
        found = part if found is None else found.unionAll(part)
    return index_rows.sparkSession.createDataFrame([], schema) if found is None else found


def _search(rows: DataFrame, n: int, width: int, is_query, k: int, scanned: bool) -> DataFrame:
    """:func:`search` among vectors of one length.

    Every row is keyed by its nearest pivot and its distance and sorted by both, so stretches of rows are annuli. For an
    annulus of inner radius r, outer R and greatest norm m, a query at distance d from the pivot has
    q.x <= (|q|^2 + m^2 - g^2) / 2 with g = max(d - R, r - d, 0), by the triangle inequality, and q.x <= q.p + |q| R.
    The bound falls with the distance from d to the annulus, so a query starts at its own distance in each pivot's list,
    goes outward on both sides, always at the list whose next annulus has the best bound, and stops when that bound is
    below its k-th best score so far. Queries go out in blocks of at most QUERY_BYTES, one after the other: a block's
    answers are checkpointed and its broadcast is dropped before the next. The pivots and first k-th scores come from
    SAMPLE rows, but all rows are indexed and the result is exact.
    """
    import pyarrow as pa

    spark = rows.sparkSession
    some = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(min(1.0, 2 * SAMPLE / n) * (1 << 30))).limit(SAMPLE).toArrow()
    sample = (some if some.num_rows else rows.limit(SAMPLE).toArrow()).combine_chunks()  # all of them copies of a row
    sample_ids, sample_v = sample.column("vec_id").to_numpy(), matrix(sample.column("v").combine_chunks(), width)
    pivots = pick_pivots(sample_v, PIVOTS)

    def key(batches):
        for b in batches:
            v = matrix(b.column("v"), width)
            if len(v):
                d = distances(v, pivots)
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(v)), at])], ["vec_id", "v", "pivot", "distance"])

    keyed = rows.mapInArrow(key, "vec_id long, v array<double>, pivot int, distance double")
    index = checkpoint(keyed.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id"))
    queries = checkpoint(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks = max(1, -(-queries.count() * 8 * max(1, width) // QUERY_BYTES))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    total = Window.partitionBy("query_id")
    found = None
    for block in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        got = some.select("vec_id", "v").toArrow().combine_chunks()
        ids, q = got.column("vec_id").to_numpy(), matrix(got.column("v").combine_chunks(), width)
        first = np.full(len(q), -np.inf)  # the k-th best score among sample rows
        if len(sample_v) > k:
            for i in range(0, len(q), 512):
                s = q[i : i + 512] @ sample_v.T
                s[ids[i : i + 512, None] == sample_ids] = -np.inf
                first[i : i + 512] = np.partition(s, -k, axis=1)[:, -k]
        sent = spark.sparkContext.broadcast((ids, q, first, pivots))
        part = index.mapInArrow(_probe(sent, k, width), "query_id long, vec_id long, score long, scanned long")
        part = part.withColumn("scanned", F.sum("scanned").over(total)).where("vec_id is not null") if scanned else part.where("vec_id is not null")
        part = part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *["scanned"] * scanned)
        if blocks > 1:
            part = checkpoint(part)
            sent.destroy()
        found = part if found is None else found.unionAll(part)
    return found


class Nearest:
    """The k best (score, id) of each query so far: best first, ties to the smaller id."""

    def __init__(self, first: np.ndarray, k: int):
        self.k, self.bound = k, first.copy()
        self.score, self.id = np.full((len(first), k), -np.inf), np.full((len(first), k), np.iinfo(np.int64).max)
        self.scanned = np.zeros(len(first), dtype=np.int64)

    def add(self, queries: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Rows ``ids`` with their scores (a row per query) come into the table."""
        self.scanned[queries] += (score > -np.inf).sum(1)
        for at in np.flatnonzero((score >= self.bound[queries, None]).any(1)):
            i = queries[at]
            c = np.flatnonzero(score[at] >= self.bound[i])
            sc, ci = np.r_[self.score[i], score[at][c]], np.r_[self.id[i], ids[c]]
            o = np.lexsort((ci, -sc))[: self.k]
            self.score[i], self.id[i] = sc[o], ci[o]
            self.bound[i] = max(self.bound[i], self.score[i, -1])


def annuli_of(pivot: np.ndarray, far: np.ndarray, square: np.ndarray):
    """Stretches of rows sorted by (pivot, distance): start, end, pivot, inner and outer radius, greatest squared norm."""
    firsts = np.r_[0, np.flatnonzero(np.diff(pivot)) + 1]
    edges = np.concatenate([np.arange(a, b, ANNULUS) for a, b in zip(firsts, np.r_[firsts[1:], len(pivot)], strict=True)])
    ends = np.r_[edges[1:], len(pivot)]
    return edges, ends, pivot[edges], far[edges], far[ends - 1], np.maximum.reduceat(square, edges)


def expand(q, ids, norm, to_pivot, with_pivot, v, own, pivot, far, best: Nearest, base: int) -> None:
    """Queries base, base + 1, .. against sorted rows: best bound first, in strides that double, until no bound reaches the k-th score."""
    start, end, p, inner, outer, most = annuli_of(pivot, far, (v * v).sum(1))
    gap = np.maximum(0, np.maximum(to_pivot[:, p] - outer, inner - to_pivot[:, p]))
    top = np.minimum((norm[:, None] + most - gap * gap) / 2, with_pivot[:, p] + np.sqrt(norm)[:, None] * outer)
    top += 1e-6 * (1 + np.abs(top)) + 1  # scores are whole: a margin of 1 covers rounding
    order = np.argsort(-top, axis=1, kind="stable")
    live, at, stride = np.arange(len(q)), 0, 1
    while at < len(start):
        turn = order[live, at : at + stride]
        go = np.take_along_axis(top[live], turn, 1) >= best.bound[base + live, None]
        live, turn, go = (x[go.any(1)] for x in (live, turn, go))  # bounds fall: the others stop for good
        if not len(live):
            return
        who, col = np.nonzero(go)
        what = turn[who, col]
        by = np.argsort(what, kind="stable")
        what, who = what[by], who[by]
        cuts = np.r_[0, np.flatnonzero(np.diff(what)) + 1, len(what)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            a, some = what[s], live[who[s:e]]
            rows = slice(start[a], end[a])
            score = q[some] @ v[rows].T
            score[ids[some, None] == own[rows]] = -np.inf
            best.add(base + some, score, own[rows])
        at, stride = at + stride, 2 * stride


def _probe(sent, k: int, width: int):
    import pyarrow as pa

    def probe(batches):
        ids, q, first, pivots = sent.value
        best = Nearest(first, k)
        norm = (q * q).sum(1)
        to_pivot, with_pivot = distances(q, pivots), q @ pivots.T
        for b in batches:
            if not b.num_rows:
                continue
            v, own, pivot, far = matrix(b.column("v"), width), b.column("vec_id").to_numpy(), b.column("pivot").to_numpy(), b.column("distance").to_numpy()
            for i in range(0, len(q), TOGETHER):
                s = slice(i, i + TOGETHER)
                expand(q[s], ids[s], norm[s], to_pivot[s], with_pivot[s], v, own, pivot, far, best, i)
        at, col = np.nonzero(best.score > -np.inf)
        seen = np.flatnonzero(best.scanned)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[ids[at], ids[seen]]), pa.array([*best.id[at, col].tolist(), *[None] * len(seen)], pa.int64()), pa.array([*best.score[at, col].astype(np.int64).tolist(), *[None] * len(seen)], pa.int64()), pa.array(np.r_[np.zeros(len(at), np.int64), best.scanned[seen]])],
            ["query_id", "vec_id", "score", "scanned"],
        )

    return probe
