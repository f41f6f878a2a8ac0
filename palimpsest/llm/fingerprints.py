"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import partitions_of, slices

#: Two 31-bit primes and bases: products fit in 64 bits, and both together make a 62-bit hash.
MODULI = (2147483647, 2147483629)
BASES = (911382323, 972663749)
SKETCH = 64
#: Span widths, each for texts of fewer code points than stated; the first for all.
WIDTHS = ((16, None), (4, 64), (2, 16))


class _Powers:
    """Powers of the bases and of their inverses, extended on demand."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int):
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 15)
            self.powers = [self._table(b, m, self.n) for b, m in zip(BASES, MODULI, strict=True)]
            self.inverse = [self._table(pow(b, -1, m), m, self.n) for b, m in zip(BASES, MODULI, strict=True)]
        return self

    @staticmethod
    def _table(base: int, mod: int, n: int) -> np.ndarray:
        out = np.ones(1, dtype=np.uint64)
        while len(out) < n:  # doubling: the next half is this one times base**len
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), mod)) % np.uint64(mod)])
        return out[:n]


POWERS = _Powers()


class PrefixHash:
    """Modular prefix arrays of a text: H[i] = sum of c[j] * base**j over j < i.

    Any two spans compare in constant time, longest common extensions by binary search; equal hashes stand for equal
    spans (two moduli, an error chance near 2**-62 for each comparison).
    """

    def __init__(self, text: str):
        self.text = text
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.n = n = len(self.codes)
        p = POWERS.upto(n + 1)
        self.prefix = []
        for table, mod in zip(p.powers, MODULI, strict=True):
            h = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.codes * table[:n] % np.uint64(mod), out=h[1:])  # 2**31 * n stays under 2**64
            self.prefix.append(h % np.uint64(mod))

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The hash of text[start:end], wherever it stands."""
        p = POWERS.upto(self.n + 1)
        return tuple((int(h[end]) - int(h[start])) % m * int(inv[start]) % m for h, inv, m in zip(self.prefix, p.inverse, MODULI, strict=True))

    def spans_of(self, width: int) -> np.ndarray:
        """62-bit hashes of all spans of ``width``, of the whole text if it is shorter."""
        width = min(width, self.n)
        count = self.n - width + 1 if self.n else 0
        p = POWERS.upto(self.n + 1)
        both = []
        for h, inv, m in zip(self.prefix, p.inverse, MODULI, strict=True):
            mod = np.uint64(m)
            both.append((h[width : width + count] + mod - h[:count]) % mod * inv[:count] % mod)
        return both[0] << np.uint64(31) | both[1]

    def equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(other_start, other_start + length)

    def extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """Length of the longest common extension from both places, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(start, other, other_start, mid):
                low = mid
            else:
                high = mid - 1
        return low


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread hashes evenly (the finaliser of splitmix64), so that the least ones are a fair sample of spans."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(ph: PrefixHash, width: int) -> np.ndarray:
    """The SKETCH least distinct hashes of spans of that width, as 32-bit numbers in order."""
    h = (mixed(ph.spans_of(width)) >> np.uint64(32)).astype("<u4")
    if len(h) > 4 * SKETCH:
        least = np.unique(np.partition(h, 4 * SKETCH)[: 4 * SKETCH])
        if len(least) >= SKETCH:
            return least[:SKETCH]
    return np.unique(h)[:SKETCH]


def fingerprint(ph: PrefixHash) -> str:
    """Length, whole-text hash and sketches of each width that the text has: equal for equal texts, and enough to judge likeness."""
    a, b = ph.span(0, ph.n)
    sketches = [sketch(ph, w) for w, below in WIDTHS if below is None or ph.n < below]
    return ".".join([f"{ph.n:x}", f"{a:08x}{b:08x}", *(base64.b64encode(x.tobytes()).decode() for x in sketches)])


def likeness_of(a: str, b: str) -> float:
    """Likeness of two fingerprints: the shared part of the spans of both texts (Dice), estimated from the least of their union.

    Spans of the least width that both have; 1 for equal texts, 0 for an empty one and another.
    """
    a, b = a.split("."), b.split(".")
    if a[:2] == b[:2]:
        return 1.0
    x, y = (np.frombuffer(base64.b64decode(f[min(len(a), len(b)) - 1]), dtype="<u4") for f in (a, b))
    if not len(x) or not len(y):
        return 0.0
    union = np.union1d(x, y)
    if max(len(x), len(y)) == SKETCH:  # else both sketches are whole
        union = union[:SKETCH]
    j = np.count_nonzero(np.isin(union, x, assume_unique=True) & np.isin(union, y, assume_unique=True)) / len(union)
    return 2 * j / (1 + j)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; with the next document by doc_id (null first, then ties by text).

    The edited text has the last floor(n/2) code points replaced by as many (or all) of the next document's first; the
    last document is followed by the first, a single one by itself. Null text is empty. Repeated rows each count; other
    columns are ignored; an empty table gives no rows. ``common_edited`` and ``common_next`` are the longest common prefixes.

    Texts cross the network once, dealt into ranges of doc_id. The first document of each range is sent along to the
    range before, so every row meets its successor, and a task holds two texts at a time.
    """
    import pyarrow as pa

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    ranges = 4 * min(1 << 14, max(4, partitions_of(docs)))
    cuts = docs.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (8 * ranges)) or []
    cuts = np.array(sorted({int(x) for x in cuts}), dtype=np.int64)
    lowest = np.iinfo(np.int64).min

    def numbers(column) -> np.ndarray:
        return column.fill_null(lowest).to_numpy(zero_copy_only=False)

    def firsts(batches):
        for b in batches:
            ids = numbers(b.column("doc_id"))
            at = np.searchsorted(cuts, ids, side="right")
            order = np.lexsort((ids, at))
            at, ids = at[order], ids[order]
            new = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(at[new]), pa.array(ids[new])], ["range", "id"])

    found = docs.select("doc_id").mapInArrow(firsts, "range long, id long").groupBy("range").agg(F.min("id").alias("id"))
    first = sorted(tuple(r) for r in found.collect())  # one row a range
    goes_to = {start: first[i - 1][0] for i, (_, start) in enumerate(first)}
    starts = np.array(sorted(goes_to), dtype=np.int64)
    before = np.array([goes_to[x] for x in starts.tolist()], dtype=np.int64)

    def deal(batches):
        for b in batches:
            ids = numbers(b.column("doc_id"))
            at = np.searchsorted(cuts, ids, side="right").astype(np.int64)
            cols = [b.column("doc_id"), b.column("text")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at), pa.array(np.zeros(len(ids), np.int32))], ["doc_id", "text", "range", "extra"])
            if len(starts) and len(ids):
                k = np.minimum(np.searchsorted(starts, ids), len(starts) - 1)
                again = np.flatnonzero(starts[k] == ids)
                if len(again):
                    pick = pa.array(again)
                    yield pa.RecordBatch.from_arrays([*(c.take(pick) for c in cols), pa.array(before[k[again]]), pa.array(np.ones(len(again), np.int32))], ["doc_id", "text", "range", "extra"])

    dealt = docs.mapInArrow(deal, "doc_id long, text string, range long, extra int").repartition("range")
    dealt = dealt.sortWithinPartitions("range", "extra", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def compare(batches):
        held = None  # the row that waits for its successor
        for b in (part for whole in batches for part in slices(whole)):
            rows = []
            for doc_id, text, extra in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("extra").to_pylist(), strict=True):
                if extra and held is None:
                    continue  # a further row of the same first id
                ph = PrefixHash(text or "")
                mark = fingerprint(ph)
                if held:
                    rows.append(row(*held, ph, mark))
                held = None if extra else (doc_id, ph, mark)
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_edited", "common_next"]
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def row(doc_id, ph, mark, next_ph, next_mark):
        half = ph.n // 2
        text = ph.text[: ph.n - half] + next_ph.text[:half]
        edited = PrefixHash(text)
        edited_mark = fingerprint(edited)
        digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, ph.n, digest, mark, edited_mark, likeness_of(mark, edited_mark), likeness_of(mark, next_mark), ph.extension(0, edited, 0), ph.extension(0, next_ph, 0)

    return dealt.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long")
