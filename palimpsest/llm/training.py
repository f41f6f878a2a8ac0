"""Bounded labelled samples for classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint, crc_fold

#: Most rows of a class, and code points for each of them on average, that a model learns from.
PER_CLASS, MEAN_CHARS = 2500, 8000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int = PER_CLASS, mean_chars: int = MEAN_CHARS) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` rows a class, chosen by a hash of doc_id among the rows learnt from.

    Rows whose crc32(doc_id as text) modulo ``folds`` is ``held`` never take part, nor do null texts, labels other than
    0 and 1, or ids with both labels. Of a repeated id the shortest text counts. Texts of any length are taken, in the
    order of the hash, until the next one would bring the class over per_class * mean_chars code points; only a text
    that is longer than that by itself is passed over. So at most twice as many code points reach the driver, whatever
    the input. Twice as many ids are drawn as needed, to make up for labels without a document.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label")).where("_label in (0, 1) and doc_id is not null")
    rows = rows.where(crc_fold("doc_id", folds) != held).groupBy("doc_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).where("_label = _most")
    order = F.xxhash64("doc_id", F.lit(17))
    ids = None
    for x in (0, 1):
        part = rows.where(F.col("_label") == x).orderBy(order, "doc_id").limit(2 * per_class).select("doc_id", "_label")
        ids = part if ids is None else ids.unionAll(part)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    found = checkpoint(found.withColumns({"_size": F.length("text"), "_hash": F.xxhash64("text")}))  # the only pass over docs
    sizes = found.groupBy("doc_id", "_label").agg(F.min(F.struct("_size", "_hash")).alias("_least"))
    sizes = sizes.select("_label", order.alias("_order"), "doc_id", "_least._size", "_least._hash").collect()
    most, picked = per_class * mean_chars, []
    for x in (0, 1):
        n = total = 0
        for r in sorted(r for r in sizes if r[0] == x and r[3] <= most):
            if n == per_class or total + r[3] > most:
                break
            n, total = n + 1, total + r[3]
            picked.append(r)
    if not picked:
        return []
    chosen = docs.sparkSession.createDataFrame([tuple(r[2:]) for r in picked], "doc_id long, _size int, _hash long")
    text = {r.doc_id: r.text for r in found.join(F.broadcast(chosen), ["doc_id", "_size", "_hash"]).dropDuplicates(["doc_id"]).select("doc_id", "text").collect()}
    return [(text[r[2]], r[0]) for r in picked]
