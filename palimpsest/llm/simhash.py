"""SimHash near-duplicates by a segment-popcount embedding."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint, fresh, slices, text_bytes
from palimpsest.llm.components import LocalUnion, connected_components

_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_PAIRS = np.uint64(0x5555555555555555)
#: 32 segments of two bits in six groups; bits of a group.
_GROUPS = [(0, 12), (12, 12), (24, 10), (34, 10), (44, 10), (54, 10)]
_CHOICES = list(combinations(range(6), 3))


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text: a bit is set if it is in over half of the shingles' XXH64 (seed 42)."""
    from xxhash import xxh64_intdigest

    words = text.translate(_UPPER).split()  # bytes.split: exactly the six ASCII spaces
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    ones, n = np.zeros(64, dtype=np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 16):
        stop = min(n, at + (1 << 16))
        pairs = zip(starts[at:stop].tolist(), ends[at + shingle - 1 : stop + shingle - 1].tolist(), strict=True)
        h = np.array([xxh64_intdigest(line[a:b], 42) for a, b in pairs], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` and ``_fp``, the fingerprint of text as a signed long. Null text is empty."""
    import pyarrow as pa

    def add(batches):
        for b in (part for whole in batches for part in slices(whole)):
            fp = np.array([fingerprint_of(t) for t in text_bytes(b.column("text"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fp)], [*keep, "_fp"])

    names = list(dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes)
    return docs.select(*names).mapInArrow(add, schema + ", _fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each as 00, 01 or 11: xor and count bits to get Manhattan distances."""
    low, high = fp & _PAIRS, (fp >> np.uint64(1)) & _PAIRS
    return (low | high) | ((low & high) << np.uint64(1))


def cells(counts: np.ndarray) -> np.ndarray:
    """The 20 grid cells of each embedded point.

    If two points are within Manhattan distance 3, then at most three of the six groups of segments differ, so both lie
    in one cell of at least one choice of three groups, in which these groups' counts are the cell's coordinates.
    """
    parts = [(counts >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in _GROUPS]
    out = [(parts[a] | parts[b] << np.uint64(12) | parts[c] << np.uint64(24)) | np.uint64(i << 40) for i, (a, b, c) in enumerate(_CHOICES)]
    return np.stack(out, axis=1)


def finer(fp: np.ndarray) -> np.ndarray:
    """Four keys of each point, one a 16-bit quarter of its bits: points within three bits have one in common."""
    return np.stack([(fp >> np.uint64(16 * i)) & np.uint64(0xFFFF) | np.uint64(i << 16) for i in range(4)], axis=1)


def links_of(fp: np.ndarray, limit: int):
    """Linked positions of distinct points in a cell, enough to connect what is linked: a range join on the sum of the counts.

    Points are sorted by that sum; two within the limit differ by at most the limit in it, so each front of a
    breadth-first search looks only at the unvisited points in that range, first by Manhattan distance, then exactly.
    """
    counts = embed(fp)
    total = np.bitwise_count(counts).astype(np.int64)
    left = np.argsort(total, kind="stable")
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            p = front.pop()
            lo, hi = np.searchsorted(total[left], (total[p] - limit, total[p] + limit + 1))
            some = left[lo:hi]
            near = np.bitwise_count(counts[some] ^ counts[p]) <= limit
            near[near] = np.bitwise_count(fp[some[near]] ^ fp[p]) <= limit
            if near.any():
                got = some[near]
                yield np.full(len(got), p), got
                front.extend(got)
                left = np.r_[left[:lo], some[~near], left[hi:]]


def _links(keys: np.ndarray, fps: np.ndarray, limit: int):
    """Linked positions of points by their cells; sorted keys. Cells of up to 32: all pairs at offset 1, 2, ..; larger ones one by one, over 2048 points by their finer keys."""
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[new, len(keys)])
    of = np.repeat(size, size)
    small = np.flatnonzero((of > 1) & (of <= 32))
    k, x = keys[small], fps[small]
    c = embed(x)
    for d in range(1, int(min(32, size.max(initial=0)))):
        if d >= len(k):
            break
        near = np.flatnonzero((k[d:] == k[:-d]) & (np.bitwise_count(c[d:] ^ c[:-d]) <= limit))
        near = near[np.bitwise_count(x[near + d] ^ x[near]) <= limit]
        yield small[near], small[near + d]
    for at in np.flatnonzero(size > 32):
        first, n = new[at], size[at]
        x = fps[first : first + n]
        if n <= 2048:
            groups = [np.arange(n)]
        else:
            key = finer(x).ravel()
            order = np.argsort(key, kind="stable")
            groups = [g // 4 for g in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(g) > 1]
        for g in groups:
            for a, b in links_of(x[g], limit):
                yield first + g[a], first + g[b]


def link_fingerprints(classes: DataFrame, limit: int = 3) -> DataFrame:
    """(_fp) of distinct fingerprints -> edges (a, b) between them that connect the same sets as all pairs within ``limit`` (at most 3) bits.

    Each point is sent to its 20 cells. A cell never holds copies, only distinct fingerprints that agree in half of the
    segments; within it no pair is emitted but the edges of a forest. Manhattan distance filters, the exact distance
    decides. A task emits edges run by run and remembers nothing between them.
    """
    import pyarrow as pa

    def spread(batches):
        for b in batches:
            fp = b.column("_fp").to_numpy()
            key = cells(embed(fp.view(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(fp, key.shape[1]))], ["cell", "_fp"])

    def forest(keys: np.ndarray, fps: np.ndarray):
        union = LocalUnion()
        for a, b in _links(keys, fps.view(np.uint64), limit):
            union.add(fps[a], fps[b])
        for a, b in union.edges():
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def join(batches):
        keys, fps = [], []  # of whole cells and of one that may go on
        for b in batches:
            if not b.num_rows:
                continue
            keys.append(b.column("cell").to_numpy())
            fps.append(b.column("_fp").to_numpy())
            if keys[0][0] != keys[-1][-1]:
                k, x = np.concatenate(keys), np.concatenate(fps)
                last = int(np.searchsorted(k, k[-1]))
                yield from forest(k[:last], x[:last])
                keys, fps = [k[last:]], [x[last:]]
        if keys:
            yield from forest(np.concatenate(keys), np.concatenate(fps))

    spread_out = classes.select("_fp").mapInArrow(spread, "cell long, _fp long")
    return spread_out.repartition("cell").sortWithinPartitions("cell").mapInArrow(join, "a long, b long")


def lookup(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table``, which has each ``key`` once and in ``n`` how many rows have it.

    Keys of over a thousandth of the ``total`` rows (so at most a thousand) are looked up by broadcast and only the
    others by a join, which no hot key can then tilt. Rows whose key is not in ``table`` are dropped.
    """
    hot = F.broadcast(table.where(F.col(n) * 1000 > total).drop(n))
    cold = table.where(F.col(n) * 1000 <= total).drop(n)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def near_duplicates(fingerprints: DataFrame, limit: int = 3) -> DataFrame:
    """(doc_id, _fp) -> (doc_id, _fp, component_id): the least doc_id reachable by links of at most ``limit`` bits.

    ``fingerprints`` is read several times: checkpoint it first. Copies become one class by a pre-aggregated minimum, and
    only classes are linked. Rows of one doc_id (any 64-bit number) are one document, so an id with several fingerprints
    links them. A component without any id has a null component_id.
    """
    total = fingerprints.count()
    classes = checkpoint(fingerprints.groupBy("_fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    one = fingerprints.where("doc_id is not null").groupBy("doc_id").agg(F.min("_fp").alias("_low"), F.max("_fp").alias("_high")).where("_low <> _high")
    shared = fingerprints.join(one, "doc_id").select(F.col("_fp").alias("a"), F.col("_low").alias("b")).where("a <> b").distinct()
    roots = connected_components(link_fingerprints(classes, limit).unionAll(shared))
    classes = checkpoint(classes.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left"))
    linked = classes.where("root is not null")
    groups = checkpoint(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_members")))
    linked = lookup(linked.select("_fp", "n", "root"), groups, "root", "_members", classes.count())
    of = checkpoint(linked.select("_fp", "n", "component_id").unionAll(classes.where("root is null").select("_fp", "n", "least")))
    return lookup(fingerprints, of, "_fp", "n", total).select("doc_id", "_fp", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): fingerprint (16 hex digits) and component_id.

    Texts without words (null too) have fingerprint zero and link like any other. Repeated rows stay; other columns are
    ignored; an empty table gives no rows; null ids as in :func:`near_duplicates`.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = near_duplicates(checkpoint(with_fingerprint(docs, ["doc_id"])))
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of texts that are linked by their fingerprints: the one of least doc_id (null last), then of least hash.

    Only texts link rows here: rows without an id, or of one id but with texts that are not near, each keep their own
    text. The survivor is found among classes of equal fingerprints by pre-aggregated minima.
    """
    columns = docs.columns
    key, row, nth = fresh("_id", columns), fresh("_hash", columns), fresh("_nth", columns)
    cols = [F.col(f"`{c}`") for c in columns]
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))  # one key for the join and the window: one shuffle of the texts
    named = docs.withColumns({key: known, row: F.xxhash64(*cols, *(c.isNull() for c in cols))})
    found = named.select(F.col(key).alias("id"), F.col("doc_id").isNull().alias("nameless"), F.col(row).alias("hash"), "text")
    found = checkpoint(with_fingerprint(found, ["nameless", "id", "hash"]))
    classes = checkpoint(found.groupBy("_fp").agg(F.min(F.struct("nameless", "id", "hash")).alias("best")))
    roots = connected_components(link_fingerprints(classes))
    best = classes.join(roots, classes["_fp"] == roots["node"], "left").groupBy(F.coalesce("root", "_fp").alias("root")).agg(F.min("best").alias("best"))
    kept = named.join(best.select(F.col("best.id").alias(key), F.col("best.hash").alias(row)), [key, row], "left_semi")
    one = Window.partitionBy(key, row).orderBy(row)
    return kept.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).select(*cols)
