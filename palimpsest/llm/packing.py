"""Best-fit packing of token sequences by large-item matching over the histogram of lengths."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint, running_sum, slices, spread, texts

#: Words kept per Python worker, with their ids of at most that number: the new ones, and as many that were in use before.
KEPT_WORDS, KEPT_IDS = 150_000, 32
_WHITE = re.compile("[\t\n\x0b\x0c\r \x85\xa0  -     　]+")
_CONTROL = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the tokenizer


#: What the tokenizer does to texts of these characters alone: lower case, then runs of letters, single digits, and runs of the rest.
_OTHER = re.compile("[^\x00-\xff\u2010-\u2027\u2030-\u203e\u20ac]")
_SPACES, _LETTERS, _DIGITS = "\t\n\x0b\x0c\r \x85\xa0", "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")
_MARKS = ".,;:!?#$%&*-)\"'"
_PROBES = ("Don't STOP, it's 3.14!  a_b\t\xc9t\xe9 \xbd\xb2 \u2014x\u20ac", "we'll 'Re \xd7\xf7 A1b2  \n\n--==")


class Words(dict):
    """Ids of lower-case words, found by the tokenizer's merges when first asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.letters, self.older = tokenizer.model, byte_letters(), {}

    def age(self) -> None:
        """Begin a new generation when this one is full; a word of the last one comes over when it is met."""
        if len(self) > KEPT_WORDS:
            self.older = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes:
        if (out := self.older.get(word)) is not None:
            self[word] = out
            return out
        head = word.rstrip(_MARKS)
        if head != word and head.isalpha():  # words with marks are many, their parts few
            out = self[head] + self[word[len(head) :]]
        elif word.isalpha() or len(parts := _SPLIT.findall(word)) == 1:
            ids = [t.id for t in self.model.tokenize(word if word.isascii() and word.isprintable() else word.translate(self.letters))]
            out = struct.pack(f"<{len(ids)}I", *ids)
        else:
            out = b"".join(map(self.__getitem__, parts))
        if len(out) <= 4 * KEPT_IDS:  # long strings are rare, and would fill the store
            self[word] = out
        return out


def byte_letters() -> dict[int, str]:
    """The usual characters as a byte-level alphabet writes their UTF-8: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    names = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    usual = [*range(256), *range(0x2010, 0x2028), *range(0x2030, 0x203F), 0x20AC]
    return {c: "".join(names.get(b, chr(b)) for b in chr(c).encode()) for c in usual}


class WordTokens:
    """Ids of a text from a tokenizer that drops white space and never looks across it: word by word, each new word once.

    Words of usual characters go straight to the merges, if the tokenizer splits the probes as expected; others, and
    texts that hold an added token, through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.words = Words(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        whole = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self.direct = all(b"".join(map(self.words.__getitem__, t.lower().split())) == whole(t) for t in _PROBES)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        self.words.age()
        get, out, rest = self.words.__getitem__, [], []
        for i, t in enumerate(texts):
            if self.direct and not _OTHER.search(t) and not _CONTROL.search(t) and not any(x in t for x in self.added):
                out.append(b"".join(map(get, t.lower().split())))
            else:
                out.append(b"")
                rest.append(i)
        for i, ids in zip(rest, self.through([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def through(self, texts: list[str]) -> list[bytes]:
        split = [t.split() if not _CONTROL.search(t) else [w for w in _WHITE.split(t) if w] for t in texts]
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        new = list({w for words in split for w in words if w not in known})
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, dtype="<u4").tobytes()
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]


_LOADED: dict[str, WordTokens] = {}


def tokens_of(path: str) -> WordTokens:
    """One per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Token pieces of every text: its ids and then ``end_id``, cut every ``capacity`` ids."""
    import pyarrow as pa

    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        encoder = tokens_of(tokenizer)
        for whole in batches:
            for b in slices(whole, most=1 << 20):
                rows = []
                for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(texts(b.column("text"))), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        rows.append((doc_id, k, start, len(part) // 4, zlib.crc32(part)))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Bins for items of which only the number per length is known.

    Items over a third of the capacity go first, at most two to a bin: the longest left with the longest that still
    fits. Then the shorter ones, longest first, each into the bin with the least gap that holds it. Items of a length
    are alike, so runs of bins with the same gap are handled at once, and the plan's size depends on the capacity only.

    ``placed``: (length, first rank, items, first bin, items per bin, offset of the first).
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.bins, self.placed = capacity, 0, []
        self.gaps: dict[int, list[list[int]]] = {}  # gap -> runs of bins [first, number]
        self.mask = 0
        self.rank = dict.fromkeys(counts, 0)
        left = dict(counts)
        self._match({n: c for n, c in left.items() if 3 * n > capacity})
        for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
            self._fill(n, left[n])

    def _put(self, n: int, items: int, first: int, each: int, offset: int) -> None:
        self.placed.append((n, self.rank[n], items, first, each, offset))
        self.rank[n] += items

    def _open(self, gap: int, first: int, number: int) -> None:
        if number and gap:
            self.gaps.setdefault(gap, []).append([first, number])
            self.mask |= 1 << gap

    def _match(self, left: dict[int, int]) -> None:
        for a in sorted(left, reverse=True):
            b = min(a, self.capacity - a)
            while left[a]:
                while 3 * b > self.capacity and not left.get(b, 0) - (a == b) > 0:
                    b -= 1
                if 3 * b <= self.capacity:
                    number = left[a]
                    self._put(a, number, self.bins, 1, 0)
                    gap = self.capacity - a
                elif a == b:
                    number = left[a] // 2
                    self._put(a, 2 * number, self.bins, 2, 0)
                    left[a] -= number
                    gap = self.capacity - 2 * a
                else:
                    number = min(left[a], left[b])
                    self._put(a, number, self.bins, 1, 0)
                    self._put(b, number, self.bins, 1, a)
                    left[b] -= number
                    gap = self.capacity - a - b
                left[a] -= number
                self._open(gap, self.bins, number)
                self.bins += number

    def _fill(self, n: int, items: int) -> None:
        while items:
            fit = self.mask >> n
            if not fit:
                number = -(-items // (self.capacity // n))
                self._open(self.capacity, self.bins, number)
                self.bins += number
                continue
            gap = n + (fit & -fit).bit_length() - 1
            run = self.gaps[gap].pop()
            if not self.gaps[gap]:
                del self.gaps[gap]
                self.mask ^= 1 << gap
            first, number = run
            each, offset = gap // n, self.capacity - gap
            full = min(number, items // each)
            if full:
                self._put(n, full * each, first, each, offset)
                self._open(gap - full_width(each, n), first, full)
                items -= full * each
            if full < number and items and items < each:
                self._put(n, items, first + full, items, offset)
                self._open(gap - n * items, first + full, 1)
                full, items = full + 1, 0
            self._open(gap, first + full, number - full)


def full_width(each: int, n: int) -> int:
    return each * n


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (length from 1 to ``capacity``); ties between equal rows are immaterial.

    Only the number of pieces per length reaches the driver (at most ``capacity`` rows). Each piece is then numbered
    within its length, by salted buckets so that a hot length is spread, and finds its place by binary search in the
    plan, whose size is bounded by the capacity. ``pieces`` is read three times: checkpoint it first.
    """
    import pyarrow as pa

    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    plan = Plan(counts, capacity)
    placed = np.array(sorted(plan.placed), dtype=np.int64).reshape(-1, 6)
    total = sum(counts.values())
    rows = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread(total))))
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "piece", "start", "ids_crc32")]
    rows = running_sum(rows, ["length"], "_salt", order, F.lit(1), "_rank").drop("_salt")
    step, names = np.int64(total + 1), pieces.columns
    sent = pieces.sparkSession.sparkContext.broadcast((placed, placed[:, 0] * step + placed[:, 1]))

    def place(batches):
        placed, keys = sent.value
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            p = placed[np.searchsorted(keys, length * step + rank, side="right") - 1]
            k = rank - p[:, 1]
            extra = [pa.array(p[:, 3] + k // p[:, 4]), pa.array(p[:, 5] + k % p[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *extra], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)
    return rows.select(*names, "_rank").mapInArrow(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) with their sequence and place.

    Null or empty text is the single end id. Null ids, repeated rows and equal texts are packed like any other; other
    columns are ignored; an empty table gives no rows. Only documents longer than ``capacity`` are cut. Bin numbers have
    no meaning beyond equality.
    """
    return pack(checkpoint(pieces_of(docs, tokenizer, capacity)), capacity)
