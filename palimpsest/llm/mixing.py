"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACE, checkpoint, fresh, global_index, partitions_of, running_sum, slices, spread

WEIGHTS, EPOCHS, BUDGET, BLOCK = (5, 2, 1), 2, 1.5, 4096
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_counts(column) -> np.ndarray:
    """Number of words of each text of an Arrow string column: places where a word begins, over all bytes at once."""
    import pyarrow as pa

    col = column.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(col) or offsets[-1] == offsets[0]:
        return np.zeros(len(col), dtype=np.int64)
    space = SPACE[np.frombuffer(col.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    begins = ~space
    begins[1:] &= space[:-1]
    firsts = (offsets[:-1] - offsets[0])[np.diff(offsets) > 0]
    begins[firsts] = ~space[firsts]
    n = np.searchsorted(np.flatnonzero(begins), offsets - offsets[0])
    return np.diff(n)


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, hash of text and source, size in words) of every row; null text is 0."""
    import pyarrow as pa

    def count(batches):
        for b in (part for whole in batches for part in slices(whole)):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "hash")), pa.array(word_counts(b.column("text")))], ["doc_id", "source", "hash", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text", "source").alias("hash"), "text")
    return rows.mapInArrow(count, "doc_id long, source string, hash long, size long")


def targets_of(sources: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, budget: float = BUDGET) -> DataFrame:
    """(source, source_size) -> also ``at`` (order by code point, null last) and ``target``.

    Weights repeat in that order and share ``budget`` times all words; what a source's target has over ``epochs`` times
    its size is shared again by weight until none is above. Only three sums a round reach the driver.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("long")
    s = global_index(sources, [F.col("source").asc_nulls_last()], "at")
    s = checkpoint(s.withColumn("_w", w).withColumn("_cap", epochs * F.col("source_size")))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, last = 0.0, None
    while True:
        full = F.col("_cap") <= F.col("_w") * F.lit(level)
        capped, open_w = s.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w")))).first()
        if not open_w or (capped or 0, open_w) == last:
            break
        last = (capped or 0, open_w)
        level = (budget * total - last[0]) / last[1]
    return s.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_w") * F.lit(level))).drop("_w", "_cap")


def earlier(n: np.ndarray, x: np.ndarray, bits: int) -> np.ndarray:
    """How many of the first ``n`` van der Corput points lie below ``x``; points are whole numbers under 2**bits.

    The numbers below n fall into one run for each bit set in n, and the points of a run are evenly spaced.
    """
    out, high = np.zeros_like(n), np.zeros_like(n)
    for j in range(bits, -1, -1):
        on, step = (n >> j) & 1, bits - j
        out += on * np.clip((x - high + (1 << step) - 1) >> step, 0, 1 << j)
        high += on << max(0, bits - 1 - j)
    return out


def schedule(sources: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """(at, source_size, target) -> slots (slot, at, rank, block, pass, until), and the number of slots that the targets need.

    A source needs as many slots as blocks up to its target, in passes over its blocks. Slot i has the i-th base-2 van
    der Corput point, which maps through the cumulative needs to a source; as the r-th slot of its source it takes block
    r modulo the number of blocks, in pass r div that number, up to stream position ``until``. Slots are drawn until
    every source has what it needs, and a source that has it passes: among the first 2**k >= n points are all multiples
    of 2**-k, so each source is met at least as often as it needs, and up to each slot its share deviates by O(log n) slots.

    The rank is counted, not sorted: so many points before the slot's lie between the source's bounds. Cells cut the
    axis, so that slots meet any number of sources in an equality join; up to 10,000 sources are broadcast.
    """
    import pyarrow as pa

    spark = sources.sparkSession
    size, words = F.col("source_size"), F.floor("target").cast("long")
    s = sources.where((size > 0) & (F.col("target") >= 1)).select("at", size.alias("size"), words.alias("words"))
    s = s.withColumn("blocks", F.expr(f"(size + {block - 1}) div {block}")).withColumn("passes", F.expr("words div size"))
    s = s.withColumn("rest", F.expr("words - passes * size")).withColumn("need", F.expr(f"passes * blocks + (rest + {block - 1}) div {block}"))
    s = checkpoint(s)
    n, kinds = s.agg(F.sum("need"), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], "slot long, at long, rank long, block long, pass long, until long"), 0
    bits = max(1, (n - 1).bit_length())
    step = spread(kinds)
    axis = running_sum(s.withColumn("_all", F.lit(0)).withColumn("_step", F.expr(f"at div {step}")), ["_all"], "_step", [F.col("at")], F.col("need"), "low")
    edge = lambda x: F.expr(f"cast((cast({x} as decimal(38, 0)) * {1 << bits} + {n - 1}) div {n} as long)")
    axis = axis.select("at", "need", "blocks", "rest", "size", edge("low").alias("low"), edge("low + need").alias("high"))
    width = -(-(1 << bits) // max(16, min(1 << bits, kinds)))
    axis = axis.withColumn("cell", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")))
    point = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long")
    points = spark.range(1 << bits).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.expr(f"point div {width}"))
    hit = points.join(F.broadcast(axis) if kinds <= 10_000 else axis, "cell").where("point >= low and point < high")

    def rank(batches):
        for b in batches:
            slot, low, high = (b.column(c).to_numpy() for c in ("slot", "low", "high"))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(earlier(slot, high, bits) - earlier(slot, low, bits))], [*b.schema.names[:-2], "rank"])

    ranked = hit.select("slot", "at", "need", "blocks", "rest", "size", "low", "high").mapInArrow(rank, "slot long, at long, need long, blocks long, rest long, size long, rank long")
    until = F.expr("case when rank = need - 1 and rest > 0 then rest else size end")
    return ranked.where("rank < need").select("slot", "at", "rank", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks").alias("pass"), until.alias("until")), n


def shuffle_key(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def plan_of(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, int]:
    """Documents dealt to slots, the sources, and the number of slots needed.

    The first has a row per row of ``docs``: doc_id, hash, at, size, begin (position in the source's stream), taken,
    first_slot, n_slots, and drawn: slot and words of each pass that takes words of it.
    """
    rows = checkpoint(sizes_of(docs))
    buckets = spread(rows.count())
    sources = checkpoint(targets_of(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    slots, n = schedule(sources, block)
    # a source's stream: buckets of the shuffled order, so that a hot source is spread
    key, order = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), shuffle_key(F.col("doc_id"))
    rows = rows.withColumn("_key", key).withColumn("_order", order)
    rows = rows.withColumn("_bucket", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(float(1 << 32))))
    rows = running_sum(rows, ["_key"], "_bucket", [F.col("_order"), F.col("doc_id"), F.col("size"), F.col("hash")], F.col("size"), "begin")
    named = sources.select(key.alias("_key"), "at")
    rows = rows.join(F.broadcast(named) if sources.count() <= 10_000 else named, "_key")
    rows = checkpoint(rows.select("doc_id", "hash", "at", "size", "begin"))
    parts = rows.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")))
    parts = parts.join(slots, ["at", "block"], "left")
    low = F.greatest(F.col("begin"), F.col("block") * block)
    high = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block, F.coalesce("until", F.lit(0)))
    parts = parts.withColumn("words", F.greatest(F.lit(0), high - low))
    some, each = F.col("words") > 0, []
    for p in range(EPOCHS):
        of = some & (F.col("pass") == p)
        each += [F.min(F.when(of, F.col("slot"))).alias(f"_slot{p}"), F.sum(F.when(of, F.col("words"))).alias(f"_words{p}")]
    sums = [F.sum("words").alias("taken"), F.min(F.when(some, F.col("slot"))).alias("first_slot"), F.count(F.when(some, 1)).alias("n_slots")]
    found = parts.groupBy("doc_id", "hash", "at", "size", "begin").agg(*sums, *each)
    drawn = F.filter(F.array(*(F.struct(F.col(f"_slot{p}").alias("slot"), F.col(f"_words{p}").alias("words"), (F.col(f"_words{p}") == F.col("size")).alias("whole")) for p in range(EPOCHS))), lambda d: d["words"].isNotNull())
    none = {"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long"), "n_slots": F.lit(0).cast("long"), "drawn": F.array().cast("array<struct<slot:bigint,words:bigint,whole:boolean>>")}
    names = ["doc_id", "hash", "at", "size", "begin", *none]
    return found.withColumn("drawn", drawn).select(*names).unionAll(rows.where("size = 0").withColumns(none).select(*names)), sources, n


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): size, source_size, target (of its source), taken (words, repeats counted), first_slot, n_slots.

    Each source's documents stand in the order of md5("mix:" and doc_id), then doc_id, size and a hash of the text, as one
    stream cut into blocks of ``block`` words; the schedule says which slot takes which block. So a source gives
    floor(target) words, whole streams first, and no document more than twice its words. ``first_slot`` is the place of
    the document in the mix and ``n_slots`` how many slots take words of it. Null source: a source of its own, last. Null
    text: size 0, nothing taken, no first slot. Null ids and repeated rows take part like others; an empty table gives no
    rows; other columns are ignored. Texts are counted where they are read; only numbers are shuffled.
    """
    found, sources, _ = plan_of(docs, block)
    named = sources.select("at", "source_size", "target")
    found = found.join(F.broadcast(named) if sources.count() <= 10_000 else named, "at")
    return found.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def first_words(text: str, words: int) -> str:
    """The text up to the end of so many words, which it must have."""
    return text[: next(islice(WORD.finditer(text), words - 1, None)).end()]


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a row for each pass that takes words of a document, cut where a source's target is reached.

    Rows stand in the order of the slots: partition after partition, and in each by slot and place in the stream. All
    columns stay, n_chars follows the text. Documents meet their part of the plan by doc_id and a hash of the text. Rows
    that are alike in both (copies with one id or none) are numbered on both sides, so that each copy gets its own part.
    """
    import pyarrow as pa

    columns = docs.columns
    key, mark, nth, drawn_of, slot_of, at_of = (fresh(n, columns) for n in ("_id", "_hash", "_nth", "_drawn", "_slot", "_begin"))
    plan, _, slots = plan_of(docs)
    plan = plan.where("size > 0").select(F.col("doc_id").alias(key), F.col("hash").alias(mark), F.col("begin").alias(at_of), F.col("drawn").alias(drawn_of))
    plan = checkpoint(plan)
    named = docs.withColumn(mark, F.xxhash64("text", "source"))
    cols = [F.col(f"`{c}`") for c in columns]
    groups = plan.groupBy(key, mark).agg(F.count(F.lit(1)).alias(nth), F.min(at_of).alias(at_of), F.min(drawn_of).alias(drawn_of), F.max(F.size(drawn_of)).alias("_most"))
    groups = groups.where("_most > 0").drop("_most")
    same = lambda rows, side: rows["doc_id"].eqNullSafe(side[key]) & (rows[mark] == side[mark])
    single = groups.where(F.col(nth) == 1)
    kept = named.join(single, same(named, single)).select(*cols, at_of, drawn_of)
    several = checkpoint(groups.where(F.col(nth) > 1).select(key, mark))
    if not several.isEmpty():  # such rows have no identity but the one that a checkpoint gives them
        again = named.join(several, same(named, several)).select(*cols, several[key], several[mark])
        again = checkpoint(again.withColumn(nth, F.monotonically_increasing_id()))
        buckets = spread(again.count())

        def numbered(rows: DataFrame, order: str) -> DataFrame:
            rows = rows.withColumn("_group", F.xxhash64(key, F.col(key).isNull(), mark)).withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(buckets)))
            return running_sum(rows, ["_group"], "_salt", [F.col(order)], F.lit(1), "_number").drop("_salt", key, mark)

        parts = plan.join(several, plan[key].eqNullSafe(several[key]) & (plan[mark] == several[mark]), "left_semi")
        parts = numbered(again.select(key, mark, nth), nth).join(numbered(parts, at_of), ["_group", "_number"]).drop("_group", "_number")
        kept = kept.unionAll(again.join(parts, nth).select(*cols, at_of, drawn_of))

    def cut(batches):
        for b in (part for whole in batches for part in slices(whole)):
            rows, out, slot = [], [], []
            for i, (t, drawn) in enumerate(zip(b.column("text").to_pylist(), b.column(drawn_of).to_pylist(), strict=True)):
                for d in drawn:
                    rows.append(i)
                    out.append(t if d["whole"] else first_words(t, d["words"]))
                    slot.append(d["slot"])
            pick = pa.array(rows, pa.int64())
            cols = {c: b.column(c).take(pick) for c in columns}
            cols["text"] = pa.array(out, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(x) for x in out], pa.int64()).cast(cols["n_chars"].type)
            cols |= {slot_of: pa.array(slot, pa.int64()), at_of: b.column(at_of).take(pick)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    rows = kept.mapInArrow(cut, f"{schema}, `{slot_of}` long, `{at_of}` long")
    parts = partitions_of(docs)
    place = F.least(F.lit(parts - 1), F.floor(F.col(slot_of) / F.lit(float(max(1, slots))) * parts)).cast("int")
    return rows.repartitionById(parts, place).sortWithinPartitions(slot_of, at_of).select(*cols)
