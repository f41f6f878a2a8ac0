"""Quality by Bradley-Terry pairwise ranking and a score quantile."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACE, checkpoint, crc_fold

FOLDS, HELD = 3, 1
ROUNDS = 60
#: Units of a score; the bits that the bins of the quantile leave off; the step of the grid of scores, and the coarser one's in such steps; most places of either.
UNITS, SHIFTS = 1 << 30, (24, 12, 0)
STEP, COARSE_STEP, FINE, COARSE = 1 / 64, 32, 4096, 128

#: Classes of UTF-8 bytes: newline, space, lower, upper, digit, full stop or comma, ! ?, quotes and hyphen, brackets, other marks, letters beyond ASCII.
_CLASS = np.full(256, 9, dtype=np.uint8)
_CLASS[SPACE] = 1
_CLASS[10] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 2, 3, 4
for _chars, _k in ((".,", 5), ("!?", 6), ("'\"-", 7), ("()[]{}", 8)):
    _CLASS[np.frombuffer(_chars.encode(), dtype=np.uint8)] = _k
_CLASS[128:] = 10
KINDS = 11


def features_of(text: bytes) -> np.ndarray:
    """Shape of a text: logs of class-pair shares, repetition of words and lines, lengths. Zeros for an empty text."""
    out = np.zeros(KINDS * KINDS + 9)
    if not text:
        return out
    c = _CLASS[np.frombuffer(text, dtype=np.uint8)]
    pairs = np.bincount(c[:-1].astype(np.int64) * KINDS + c[1:], minlength=KINDS * KINDS) if len(c) > 1 else np.zeros(KINDS * KINDS)
    out[: KINDS * KINDS] = np.log1p(1000 * pairs / len(c))
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    same = sum(map(bytes.__eq__, words[1:], words))
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    out[KINDS * KINDS :] = (len(set(words)) / n, same / n, len(set(lines)) / len(lines), size.mean(), size.std(), np.log1p(n), n / len(lines) / 100, np.log1p(len(lines)), (len(set(words)) + 20) / (n + 20) ** 0.8)
    return out


def sums_by_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of each one's rows of ``values``."""
    known, back = np.unique(keys, return_inverse=True)
    out = np.zeros((len(known), values.shape[1]))
    np.add.at(out, back, values)
    return known, out


def on_grid(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` at real places, parted linearly between the whole numbers around them; both of them stay, even with nothing."""
    low = np.floor(at).astype(np.int64)
    part = (at - low)[:, None]
    return sums_by_key(np.concatenate([low, low + 1]), np.concatenate([values * (1 - part), values * part]))


class BradleyTerry:
    """score = w.x, learnt by the logistic loss of w.(x_better - x_worse), averaged over all pairs of a good and a poor row.

    Newton's method; each round passes over all rows twice. The first pass counts the scores on a grid, parted linearly
    between its points, which gives the sums over the other class at every point; by them the second weighs each row in
    the gradient (grid of 1/64, so a weight is off by some 3e-6) and in the Hessian (a coarser grid, which only affects
    how fast the rounds converge). The cut is an exact quantile of the scores of all rows: the one that puts as large a
    share of rows under it as ``poor_share`` (default: the rows' own), both classes weighted so. ``probability`` is 1/2 there.
    """

    def __init__(self, decay: float = 1e-3):
        self.decay = decay
        self.mean, self.scale, self.w, self.cut, self.spread = np.zeros(1), np.ones(1), np.zeros(1), 0.0, 1.0

    def fit(self, x: np.ndarray, y: np.ndarray, poor_share: float | None = None) -> BradleyTerry:
        """From rows in memory."""
        return self.learn(lambda f: f(np.asarray(x, dtype=np.float64), y), poor_share)

    def learn(self, total: Callable, poor_share: float | None = None) -> BradleyTerry:
        """``total(f)`` adds up f(x, y), which is (keys, a row of sums for each), over all blocks of rows. Without both classes every score is the cut, or on the side of the only class."""
        sizes, (poor, good) = self._moments(total)
        if not poor or not good:
            self.cut = 1.0 if poor else -1.0
            return self
        before, least = np.zeros_like(self.w), np.inf
        for _ in range(ROUNDS):
            keys, counts = total(_histogram(self))
            fine, coarse = _grid(keys, counts, 1, FINE), _grid(keys, counts, COARSE_STEP, COARSE)
            loss = _pair_loss(*fine) / sizes + self.decay / 2 * self.w @ self.w
            if loss > least + 1e-5:
                step = self.w - before
                self.w = before + step / 2
            else:
                before, least = self.w, loss
                g, h = _slopes(total(_sums(self, fine, coarse)), len(self.w), coarse)
                step = np.linalg.solve(h / sizes + self.decay * np.eye(len(self.w)), g / sizes + self.decay * self.w)
                self.w = self.w - step
            if np.abs(step).max() < 1e-6:
                break
        self.w = _rounded(self.w)
        self.spread = max(1e-6, self._deviation(total, poor + good) / 4)
        self.cut = self._quantile(total, poor, good, poor / (poor + good) if poor_share is None else poor_share)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        """In whole units, so that equal rows score alike wherever they stand."""
        return np.rint((x - self.mean) / self.scale @ self.w * UNITS) / UNITS if self.w.any() else np.zeros(len(x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.scores(x) - self.cut) / self.spread, -30, 30)))

    def _moments(self, total: Callable) -> tuple[float, tuple[int, int]]:
        """Sets mean and scale by all rows; the numbers of pairs, and of poor and good rows."""
        keys, sums = total(lambda x, y: sums_by_key(y, np.column_stack([np.ones(len(y)), x, x * x])))
        n = {int(k): round(s[0]) for k, s in zip(keys, sums, strict=True)}
        poor, good = n.get(0, 0), n.get(1, 0)
        if rows := poor + good:
            d = sums.shape[1] // 2
            mean, square = sums.sum(0)[1 : d + 1] / rows, sums.sum(0)[d + 1 :] / rows
            self.mean, self.scale = _rounded(mean), _rounded(np.maximum(np.sqrt(np.maximum(0, square - mean * mean)), 1e-3))
            self.w = np.zeros(d)
        return float(poor) * good, (poor, good)

    def _deviation(self, total: Callable, rows: int) -> float:
        def squares(x, y):
            s = self.scores(x)
            return np.zeros(1, dtype=np.int64), np.array([[s.sum(), (s * s).sum()]])

        mean, square = total(squares)[1][0] / rows
        return float(np.sqrt(max(0.0, square - mean * mean)))

    def _quantile(self, total: Callable, poor: int, good: int, poor_share: float) -> float:
        """Midway between the least score with more than ``poor_share`` up to it and the next lesser score, found by ever finer bins: of them the one that holds the former, and the one before it."""
        weight = np.array([poor_share / poor, (1 - poor_share) / good])
        parents, below = None, 0.0
        for shift in SHIFTS:
            keys, counts = total(_bins(self, shift, parents))
            share = below + np.cumsum(counts @ weight)
            at = min(int(np.searchsorted(share, poor_share + 1e-9, side="right")), len(keys) - 1)
            first = max(0, at - 1)
            parents, below = (shift, keys[first : at + 1]), float(share[first - 1]) if first else below
        return float(parents[1].mean()) / UNITS


def _rounded(x: np.ndarray) -> np.ndarray:
    """To 24 bits: what the order of sums changes, does not show."""
    return x.astype(np.float32).astype(np.float64)


def _classes(y: np.ndarray) -> np.ndarray:
    return np.column_stack([y == 0, y == 1]).astype(np.float64)


def _histogram(model: BradleyTerry) -> Callable:
    return lambda x, y: on_grid(model.scores(x) / STEP, _classes(y))


def _grid(keys: np.ndarray, counts: np.ndarray, times: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of a grid ``times`` as coarse, and twice as coarse until it has at most ``most`` places. Rows keep both places around them."""
    found, sums = on_grid(keys / times, counts) if times > 1 else (keys, counts)
    while len(found) > most:
        times *= 2
        found, sums = on_grid(keys / times, counts)
    return found * (times * STEP), sums


def _pair_loss(at: np.ndarray, counts: np.ndarray) -> float:
    """The sum of log(1 + exp(poor - good)) over all pairs."""
    return sum(float(counts[i : i + 256, 1] @ np.logaddexp(0, at - at[i : i + 256, None]) @ counts[:, 0]) for i in range(0, len(at), 256))


def _against(at: np.ndarray, counts: np.ndarray, slope: bool) -> np.ndarray:
    """At each place, the sums of the losses' first (or second) derivatives over the other class: for poor rows, for good rows."""
    out = np.zeros((len(at), 2))
    for i in range(0, len(at), 256):
        p = 1 / (1 + np.exp(np.clip(at[i : i + 256, None] - at, -60, 60)))  # of a good row here and a poor row there
        p = p * (1 - p) if slope else p
        out[i : i + 256, 1] = p @ counts[:, 0]
        out[:, 0] += counts[i : i + 256, 1] @ p
    return out


def _sums(model: BradleyTerry, fine: tuple, coarse: tuple) -> Callable:
    """Rows weighed by the other class: their sum, their squares' sum, and their sums by class and place of the coarse grid."""
    pull, (places, _) = _against(*fine, False), coarse
    bend = _against(*coarse, True)

    def f(x, y):
        z, s = (x - model.mean) / model.scale, model.scores(x)
        good = y == 1
        g = np.where(good, -np.interp(s, fine[0], pull[:, 1]), np.interp(s, fine[0], pull[:, 0]))
        k = np.where(good, np.interp(s, places, bend[:, 1]), np.interp(s, places, bend[:, 0]))
        low = np.clip(np.searchsorted(places, s, side="right") - 1, 0, len(places) - 2)
        part = (s - places[low]) / (places[low + 1] - places[low])
        share = np.zeros((len(s), len(places)))
        share[np.arange(len(s)), low], share[np.arange(len(s)), low + 1] = 1 - part, part
        out = np.vstack([g @ z, (z * k[:, None]).T @ z, share[~good].T @ z[~good], share[good].T @ z[good]])
        return np.arange(len(out)), out

    return f


def _slopes(found: tuple, d: int, coarse: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the summed loss over all pairs."""
    (_, sums), (at, _) = found, coarse
    poor, good = sums[d + 1 :].reshape(2, len(at), d)
    p = 1 / (1 + np.exp(np.clip(at[:, None] - at, -60, 60)))
    cross = good.T @ (p * (1 - p)) @ poor
    return sums[0], sums[1 : d + 1] - cross - cross.T


def _bins(model: BradleyTerry, shift: int, parents: tuple | None) -> Callable:
    """Counts by class of the scores, in units without the last ``shift`` bits; of the scores inside the parent bins only."""

    def f(x, y):
        units = np.rint(model.scores(x) * UNITS).astype(np.int64)
        inside = np.isin(units >> parents[0], parents[1]) if parents else np.ones(len(units), dtype=bool)
        return sums_by_key(units[inside] >> shift, _classes(y[inside]))

    return f


def labelled_shapes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(_label, _x): label and features (single precision) of every row of ``docs`` that has a label and is outside the held-out fold.

    Null text counts as empty, each row of a repeated id by itself; null ids and ids with both labels teach nothing. Only
    features move, never texts.
    """
    import pyarrow as pa

    from palimpsest.llm.common import slices, text_bytes

    def shape(batches):
        for whole in batches:
            for b in slices(whole):
                x = [features_of(t).astype(np.float32).tobytes() for t in text_bytes(b.column("text"))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.binary())], ["doc_id", "_x"])

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_label")).where("_label in (0, 1) and doc_id is not null")
    known = known.where(crc_fold("doc_id", FOLDS) != HELD).groupBy("doc_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).where("_label = _most")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(crc_fold("doc_id", FOLDS) != HELD)
    return checkpoint(rows.mapInArrow(shape, "doc_id long, _x binary").join(known, "doc_id").select("_label", "_x"))


def total_over(shapes: DataFrame) -> Callable:
    """``total`` of BradleyTerry.learn over a table of ``labelled_shapes``. At most 64 partitions return their sums, whatever the input: up to 400 kB
    each, and counts only for the steps of the grid that hold scores (few, as at most a share of 1/k^2 is over k deviations off)."""
    import pyarrow as pa

    rows = shapes.coalesce(64)

    def total(f):
        def run(batches):
            keys, sums = None, None
            for b in batches:
                y, x = b.column("_label").to_numpy(), b.column("_x").cast(pa.large_binary())
                ends = np.frombuffer(x.buffers()[1], dtype=np.int64)[x.offset : x.offset + len(x) + 1]
                x = np.frombuffer(x.buffers()[2], dtype=np.float32, count=(ends[-1] - ends[0]) // 4, offset=ends[0]).reshape(len(x), -1) if len(x) else None
                for i in range(0, len(y), 2048):
                    k, s = f(x[i : i + 2048].astype(np.float64), y[i : i + 2048])
                    keys, sums = (k, s) if keys is None else (keys, sums + s) if np.array_equal(keys, k) else sums_by_key(np.concatenate([keys, k]), np.concatenate([sums, s]))
            if keys is not None:
                yield pa.RecordBatch.from_pydict({"keys": [keys.astype(np.int64).tobytes()], "sums": [sums.tobytes()]})

        parts = [(np.frombuffer(r.keys, dtype=np.int64), np.frombuffer(r.sums)) for r in rows.mapInArrow(run, "keys binary, sums binary").collect()]
        parts = [(k, s.reshape(len(k), -1)) for k, s in parts if len(k)]
        return sums_by_key(np.concatenate([k for k, _ in parts]), np.concatenate([s for _, s in parts])) if parts else (np.zeros(0, dtype=np.int64), np.zeros((0, 1)))

    return total


def fit_quality(docs: DataFrame, labels: DataFrame) -> BradleyTerry:
    """A model from every labelled row outside the held-out fold."""
    return BradleyTerry().learn(total_over(labelled_shapes(docs, labels)))


def score_quality(docs: DataFrame, model: BradleyTerry, threshold: float = 0.5) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1), predicted.

    held_out is crc32(doc_id as text) mod 3 = 1, false for null ids. Null or empty text is scored like any other (all
    features zero). Repeated rows stay; other columns are ignored; row by row, without shuffle.
    """
    import pyarrow as pa

    from palimpsest.llm.common import slices, text_bytes

    def score(batches):
        for whole in batches:
            for b in slices(whole):
                x = np.array([features_of(t).astype(np.float32) for t in text_bytes(b.column("text"))], dtype=np.float64).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.probability(x))], ["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
    held = F.coalesce(crc_fold("doc_id", FOLDS) == HELD, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
