"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels."""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import crc_fold, slices, texts
from palimpsest.llm.training import labelled_sample

FOLDS, HELD = 5, 0
BITS = 18
#: Words kept per Python worker, of at most so many characters; then the store starts anew.
KEPT_WORDS, KEPT_CHARS = 150_000, 40
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_EDGE = ".,;:!?\"'()[]{}*#%&$-_ "


def names_of(word: str) -> list[str]:
    """Features of a word: itself and its first 3, 4 and 5 letters, marked by their number."""
    w = word.strip(_EDGE).lower()
    return [w, *(f"{w[:n]} {n}" for n in (3, 4, 5) if len(w) > n)] if w else []


def features_of(word: str) -> list[int]:
    """Hashed features of a word."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in names_of(word)]


def sentences_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences, in code points."""
    return [m.span() for m in SENTENCE.finditer(text)]


def words_of(text: str) -> set[str]:
    """The words of a sentence, or of all sentences of a text: what white space and sentence ends part."""
    return set(text.replace(".", " ").replace("!", " ").replace("?", " ").split())


def log_clean(z: np.ndarray, bias: float) -> np.ndarray:
    """log(1 - P) of sentences by their scores z = bias + word weights, beyond the base rate sigmoid(bias): 0 for a sentence without weights."""
    return np.minimum(0.0, np.logaddexp(0, bias) - np.logaddexp(0, np.clip(z, -30, 30)))


class NoisyOr:
    """P(document) = 1 - product over sentences of (1 - P), where 1 - P = (1 - sigmoid(bias + sum of word weights)) / (1 - sigmoid(bias)).

    A sentence without any weighted word has P = 0, so a document's score does not grow with its neutral sentences.
    The document's label is the only supervision: the gradient reaches each sentence by its share in the noisy-or. Only
    features that at least ``support`` toxic documents hold, and that are surely commoner there (log-odds less two
    standard errors above ``margin``), get a weight; so a few wrong labels teach nothing about rare words.
    """

    def __init__(self, seed: int = 3, epochs: int = 10, rate: float = 0.3, decay: float = 1e-4, support: int = 3, margin: float = 1.0):
        self.weights, self.bias = np.zeros(1 << BITS), -6.0
        self.table: dict[str, float] = {}  # the weights by name, of the features that training met
        self.seed, self.epochs, self.rate, self.decay, self.support, self.margin = seed, epochs, rate, decay, support, margin

    def fit(self, rows: list[tuple[str, int]]) -> NoisyOr:
        """Adagrad over documents in a seeded order; classes weigh alike. Without both classes the weights stay zero."""
        positives = sum(y for _, y in rows)
        if not 0 < positives < len(rows):
            return self
        known: dict[str, int] = {}
        features: list[list[int]] = []
        split = []  # of each document, its sentences' distinct words and where they stand
        seen_in = np.zeros((2, 1 << BITS))
        for text, y in rows:
            ids, at = array("i"), array("i")
            for k, (s, e) in enumerate(sentences_of(text)):
                for w in sorted(words_of(text[s:e])):
                    if (i := known.get(w)) is None:
                        i = known[w] = len(features)
                        features.append(features_of(w))
                    ids.append(i)
                    at.append(k)
            split.append((ids, at, y))
            held = set().union(*(features[i] for i in set(ids)))
            seen_in[y, list(held)] += 1
        pos, neg = seen_in[1], seen_in[0]
        odds = np.log((pos + 0.5) / (positives - pos + 0.5)) - np.log((neg + 0.5) / (len(rows) - positives - neg + 0.5))
        sure = odds - 2 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
        used = (pos >= self.support) & (sure > self.margin)
        self.weights = np.where(used, odds, 0.0)
        keep = [[f for f in fs if used[f]] for fs in features]
        share = {1: len(rows) / (2 * positives), 0: len(rows) / (2 * (len(rows) - positives))}
        bags = []
        for words, places, y in split:
            pairs = [(f, k) for w, k in zip(words, places, strict=True) for f in keep[w]]
            if pairs:  # neutral sentences say nothing
                ids, at = np.array(pairs, dtype=np.int64).T
                n, at = len(k := np.unique(at)), np.searchsorted(k, at)
                bags.append((ids, at, n, y))
        if not bags:
            return self
        squares, square = np.full(1 << BITS, 1e-1), 1e-1
        order = np.random.default_rng(self.seed)
        for _ in range(self.epochs):
            for i in order.permutation(len(bags)):
                ids, at, n, y = bags[i]
                z = self.bias + np.bincount(at, self.weights[ids], n)
                p, base = (1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (z, self.bias))
                clean = np.exp(log_clean(z, self.bias).sum())
                pull = share[0] if y == 0 else -share[1] * clean / max(1 - clean, 0.05)
                u, back = np.unique(ids, return_inverse=True)
                g = np.bincount(back, (pull * p)[at]) + self.decay * self.weights[u]
                squares[u] += g * g
                self.weights[u] = np.maximum(0, self.weights[u] - self.rate * g / np.sqrt(squares[u]))
                b = float((pull * (p - base)).sum())
                square += b * b
                self.bias = min(-3.0, self.bias - self.rate * b / np.sqrt(square))
        for w, i in known.items():
            if keep[i]:
                self.table.update((x, float(self.weights[f])) for x, f in zip(names_of(w), features[i], strict=True) if self.weights[f] > 0)
        return self


class Scorer:
    """A fitted model over whole texts. Each new word is weighed once; as nearly all weigh nothing, a text's words are parted from
    those by one set difference, and only sentences with weighted words are looked into."""

    def __init__(self, table: dict[str, float], bias: float):
        self.table, self.bias = table, bias
        self.heads = {x[:3] for x in table}
        self.neutral: set[str] = set()
        self.heavy: dict[str, float] = {}

    def weighted(self, text: str) -> dict[str, float]:
        """The words of the text that have a weight."""
        found = {}
        if len(self.neutral) + len(self.heavy) > KEPT_WORDS:
            self.neutral.clear()
            self.heavy.clear()
        for w in words_of(text) - self.neutral:
            if (x := self.heavy.get(w)) is None:
                x = sum(self.table.get(f, 0.0) for f in names_of(w)) if w.strip(_EDGE).lower()[:3] in self.heads else 0.0
                if len(w) <= KEPT_CHARS:
                    self.heavy.update({w: x}) if x else self.neutral.add(w)
            if x:
                found[w] = x
        return found

    def judge(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of the text, and (start, end, score) of its sentences with weighted words."""
        if not (found := self.weighted(text)):
            return 0.0, []
        spans, z = [], []
        for s, e in sentences_of(text):
            sentence = text[s:e]
            if any(w in sentence for w in found) and (here := sorted(found.keys() & words_of(sentence))):
                spans.append((s, e))
                z.append(self.bias + sum(found[w] for w in here))
        clean = log_clean(np.array(z), self.bias)
        return min(1.0, max(0.0, float(-np.expm1(clean.sum())))), [(*span, p) for span, p in zip(spans, (-np.expm1(clean)).tolist(), strict=True)]


def score_toxicity(docs: DataFrame, model: NoisyOr, threshold: float = 0.5) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1), predicted, n_sentences, offending.

    ``offending`` lists (start, end, score) of the sentences that alone reach the threshold, or the strongest one of a
    rejected document. Null or empty text has no sentence and scores 0. held_out is crc32(doc_id as text) mod 5 = 0,
    false for null ids. Repeated rows stay; other columns are ignored; row by row, without shuffle.
    """
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def score(batches):
        scorer = Scorer(*sent.value)
        for b in (part for whole in batches for part in slices(whole)):
            rows = []
            for t in texts(b.column("text")):
                whole, found = scorer.judge(t)
                bad = [x for x in found if x[2] >= threshold]
                if not bad and whole >= threshold:
                    bad = [max(found, key=lambda x: x[2])]
                rows.append((whole, len(SENTENCE.findall(t)), [{"start": s, "end": e, "score": p} for s, e, p in bad]))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind)], ["doc_id", "score", "n_sentences", "offending"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = found.mapInArrow(score, "doc_id long, score double, n_sentences long, offending array<struct<start:bigint,end:bigint,score:double>>")
    held = F.coalesce(crc_fold("doc_id", FOLDS) == HELD, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "offending")


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> NoisyOr:
    """A model from a bounded sample of labelled rows outside the held-out fold."""
    return NoisyOr().fit(labelled_sample(docs, labels, "toxic", FOLDS, HELD))


def drop_toxic(docs: DataFrame, model: NoisyOr, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))
    columns = docs.columns

    def keep(batches):
        scorer = Scorer(*sent.value)
        for b in (part for whole in batches for part in slices(whole)):
            yield b.filter(pa.array([scorer.judge(t)[0] < threshold for t in texts(b.column("text"))], pa.bool_())).select(columns)

    return docs.mapInArrow(keep, docs.schema)
