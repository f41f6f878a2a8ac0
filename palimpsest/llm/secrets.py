"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import DataFrame

from palimpsest.llm.common import slices, texts

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, so the same as [0-9a-f]+ of which shorter matches are dropped
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Shortest span that the models find, and its least log-likelihood ratio in all and for each character.
SHORTEST, LEAST, EACH = 16, 14.0, 0.6
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CODE = {c: i for i, c in enumerate(ALPHABET)}
EDGE = len(ALPHABET)

#: Ordinary words: of general English, German, French and Spanish, and of identifiers.
_PLAIN = """the and that with from this have which their other about would there people could between after before where while
account address array balance batch binary block buffer build cache channel client cluster column command commit compare config connect
content context control counter create current customer data database decode default delete detail device directory document domain
download element email engine entity error event example execute export factory feature field file filter folder format function
gateway graph group handler header height helper history image index initial input instance interface item kernel label language
length library license limit line list location logger manager matrix memory message method module network number object offset
option order output package parameter parser partition path pattern payment platform policy position price private process product
project protocol provider query queue random range reader record request response result schedule schema search section server
der die und nicht haben werden arbeit freiheit sprache les des avec pour dans elle monde una los para como ciudad mundo palabra""".split()


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """The default training rows: (text, 1) random strings, (text, 0) identifiers, paths and words joined as people join them."""
    r = random.Random(seed)
    alphabets = ["".join(ALPHABET[:62]), "0123456789abcdef", "0123456789ABCDEF", "".join(ALPHABET[26:62]), ALPHABET[:64], "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    rows = []
    for _ in range(n):
        a = r.choice(alphabets)
        rows.append(("".join(r.choice(a) for _ in range(r.randint(16, 48))), 1))
        words = [r.choice(_PLAIN) for _ in range(r.randint(2, 6))]
        kind = r.randrange(9)
        s = {0: "_".join(words), 1: words[0] + "".join(w.title() for w in words[1:]), 2: "".join(w.title() for w in words), 3: "-".join(words), 4: "_".join(words).upper(), 5: "/".join(words), 6: "".join(words), 7: "".join(words).upper(), 8: "-" * r.randint(8, 30) + r.choice(["", "=" * 12, "_" * 12])}[kind]
        if r.random() < 0.25:
            s += r.choice(["", "_", "-"]) + str(r.choice([r.randint(0, 99), r.randint(1990, 2030), "2024-01-0" + str(r.randint(1, 9))]))
        rows.append((s, 0))
    return rows


class MarkovPair:
    """First-order character models of both kinds; ``ratios`` are the log-likelihood ratios of the characters, random over ordinary."""

    def __init__(self, samples: Iterable[tuple[str, int]], smoothing: float = 0.5):
        size = len(ALPHABET) + 1
        counts = [[[smoothing] * size for _ in range(size)] for _ in range(2)]
        for text, label in samples:
            last = EDGE
            for c in text:
                if (k := CODE.get(c)) is None:
                    last = EDGE
                    continue
                counts[int(label)][last][k] += 1
                last = k
        logs = [[[math.log(x / sum(row)) for x in row] for row in table] for table in counts]
        self.ratio = [[p - o for p, o in zip(a, b, strict=True)] for a, b in zip(logs[1], logs[0], strict=True)]

    def ratios(self, text: str) -> list[float]:
        last, out, ratio = EDGE, [], self.ratio
        for c in text:
            k = CODE[c]
            out.append(ratio[last][k])
            last = k
        return out

    def score(self, text: str) -> float:
        return sum(self.ratios(text))


def best_segment(ratios: list[float], shortest: int) -> tuple[float, int, int]:
    """(sum, start, end) of the segment of at least ``shortest`` ratios whose sum is greatest; the first and then longest of equals."""
    sums = [0.0, *accumulate(ratios)]
    best, low = (-math.inf, 0, 0), 0
    for end in range(shortest, len(sums)):
        if sums[end - shortest] < sums[low]:
            low = end - shortest
        if sums[end] - sums[low] >= best[0] and (sums[end] - sums[low] > best[0] or low == best[1]):
            best = (sums[end] - sums[low], low, end)
    return best


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within each kind."""
    found = []
    low = text.lower()  # never hides an ASCII keyword, whatever it does to other letters
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def markov_spans(text: str, base: list[tuple[int, int, int]], model: MarkovPair, least: float, each: float) -> list[tuple[int, int, int]]:
    """Stretches of SHORTEST and more key characters outside all base spans that look random: ``least`` in all and ``each`` per character.

    Of each run of key characters between base spans, and then of what is left of it on both sides, the stretch of the
    greatest log-likelihood ratio is taken, so that ordinary text in the same run hides nothing.
    """
    found = []
    for m in CANDIDATE.finditer(text):
        rest, at = [], m.start()
        for a, _, b in sorted(x for x in base if x[0] < m.end() and m.start() < x[2]):
            rest.append((at, a))
            at = max(at, b)
        rest.append((at, m.end()))
        while rest:
            s, e = rest.pop()
            if e - s < SHORTEST:
                continue
            score, a, b = best_segment(model.ratios(text[s:e]), SHORTEST)
            if score >= least and score >= each * (b - a):
                found.append((s + a, 3, s + b))
                rest += [(s, s + a), (s + b, e)]
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """Replace every span, overlapping ones together, by ``mark``."""
    out, at = [], 0
    for s, _, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, samples: Iterable[tuple[str, int]] | None = None, max_samples: int = 20_000, least: float = LEAST, each: float = EACH, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts per kind, spans (array of kind, start, end), and the redacted text if ``keep_text``.

    Base spans come from the fixed patterns; spans of kind ``markov`` from two character models trained on at most
    ``max_samples`` labelled ``samples`` (default: ``labelled_samples()``). Null or empty text has no span; null ids and
    repeated rows stay as they are; other columns are ignored. Rows are handled one by one, so the plan has no shuffle.
    """
    import pyarrow as pa

    model = MarkovPair(list(samples if samples is not None else labelled_samples())[:max_samples])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        for b in (part for whole in batches for part in slices(whole)):
            spans, clean = [], []
            for t in texts(b.column("text")):
                base = base_spans(t)
                spans.append(sorted([*base, *markov_spans(t, base, model, least, each)]))
                if keep_text:
                    clean.append(redact(t, spans[-1]) if spans[-1] else t)
            out = [b.column("doc_id").cast(pa.int64()), *(pa.array([sum(k == x for _, x, _ in s) for s in spans], pa.int64()) for k in range(4))]
            out.append(pa.array([[{"kind": KINDS[k], "start": a, "end": e} for a, k, e in s] for s in spans], kind))
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "spans"]
            if keep_text:
                out.append(pa.array(clean, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(scan, schema + ", redacted string" * keep_text)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def redact_documents(docs: DataFrame, samples: Iterable[tuple[str, int]] | None = None) -> DataFrame:
    """``docs`` with every secret in text replaced by a mark; n_chars follows the new text, other columns stay. Null text stays null."""
    import pyarrow as pa

    columns, model = docs.columns, MarkovPair(samples if samples is not None else labelled_samples())

    def clean(batches):
        for b in (part for whole in batches for part in slices(whole)):
            out = []
            for t in b.column("text").to_pylist():
                if t:
                    base = base_spans(t)
                    if spans := [*base, *markov_spans(t, base, model, LEAST, EACH)]:
                        t = redact(t, spans)
                out.append(t)
            cols = {c: b.column(c) for c in columns}
            cols["text"] = pa.array(out, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if x is None else len(x) for x in out], pa.int64()).cast(cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(clean, docs.schema)
