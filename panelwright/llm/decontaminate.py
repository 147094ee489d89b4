"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

A document is cut into windows as long as each benchmark item; windows and
items get a 64-bit SimHash over five-word shingles. Fingerprints are cut into
radius + 1 blocks: two within the radius agree in one block at least, so a join
on blocks finds them all. What lies within the radius is verified by the exact
weighted similarity of its shingles (each weighs as often as it occurs).

Only windows that can pass are made. A window at or above the threshold shares
shingles with its item, and sliding it until it begins or ends with a shared
one does not lower the overlap: so the windows of an item begin, or end, where
a document has one of its shingles. Nothing that passes is lost by this.

No window is written out. Fingerprints come from running bit counts along a
document, taken at the begin and the end of each window; overlaps from running
sums of what each shingle adds to the windows that hold it. Both grow with the
length of a document, not with windows times length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .joining import small

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: At similarity 0.8 two fingerprints differ in 10 of 64 bits on average, standard deviation 3.
RADIUS = 20


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Hashes of the word shingles of a lower-cased text, in order, repeats included.

    Fewer words are one shingle; a null text or one without words has none.
    """
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        size = F.size(w)
        many = F.transform(F.sequence(F.lit(0), size - words), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]))
        return F.when(size >= words, many).when(size > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    # The one-element transform names the words once, so that they are not split again at every use.
    return F.get(F.transform(F.array(tokens), of), 0)


LANES = (1 << 32) + 1


def _bit_counts(h: Column) -> list[Column]:
    """Two counters to a long, 32 longs for the 64 bits of a hash: ``s0`` .. ``s31``, for sums of fewer than 2^31 hashes."""
    return [F.shiftrightunsigned(h, b).bitwiseAND(F.lit(LANES)).alias(f"s{b}") for b in range(32)]


SUMS = [f"s{b}" for b in range(32)]


def _simhash(counts: list[Column], n: Column) -> Column:
    """A bit is one if set in over half of n hashes."""
    fp = F.lit(0).cast("long")
    for b in range(32):
        for lane in (0, 1):
            count = F.shiftrightunsigned(counts[b], 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
            at = 32 * lane + b
            bit = F.lit((1 << at) - (1 << 64) if at == 63 else 1 << at).cast("long")
            fp = fp.bitwiseOR(F.when(2 * count > n, bit).otherwise(F.lit(0).cast("long")))
    return fp


def _window_prints(bodies: DataFrame, windows: DataFrame) -> DataFrame:
    """``windows`` (key, start, stop, ..) with ``fp``, the SimHash of the shingles from start to before stop."""
    ends = windows.select("key", F.explode(F.array("start", "stop")).alias("at")).distinct()
    marks = ends.select("key", "at", F.lit(None).cast("long").alias("h"))
    needed = bodies.join(ends.select("key").distinct(), "key", "left_semi").select("key", F.posexplode("g").alias("pos", "h"))
    steps = needed.select("key", (F.col("pos") + 1).alias("at"), "h").unionByName(marks)
    # One hash a row is moved and sorted, not its 32 counters: they are made behind both.
    steps = steps.repartition("key").sortWithinPartitions("key", "at").select("key", "at", F.col("h").isNull().alias("mark"), *_bit_counts(F.coalesce("h", F.lit(0).cast("long"))))
    before = Window.partitionBy("key").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = steps.select("key", "at", "mark", *[F.sum(s).over(before).alias(s) for s in SUMS])
    sums = sums.where("mark").select("key", "at", F.array(*SUMS).alias("sums"))
    low = sums.select("key", F.col("at").alias("start"), F.col("sums").alias("low"))
    high = sums.select("key", F.col("at").alias("stop"), F.col("sums").alias("high"))
    met = windows.join(low, ["key", "start"]).join(high, ["key", "stop"])
    counts = [F.get("high", F.lit(b)) - F.get("low", F.lit(b)) for b in range(32)]
    return met.select(*windows.columns, _simhash(counts, F.col("stop") - F.col("start")).alias("fp"))


def _overlaps(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """``windows`` (key, item_id, start) with ``common``, the size of the multiset intersection of window and item.

    hits: (key, item_id, len, h, times, pos), the places where a document has a
    shingle that its item holds ``times`` times. A place counts in the windows
    that hold it unless they hold ``times`` earlier ones: these are the windows
    from behind that earlier place, or a window's length before it, up to it.
    """
    places = hits.groupBy("key", "item_id", "len", "h", "times").agg(F.sort_array(F.collect_list("pos")).alias("ps"))
    spans = F.transform("ps", lambda p, i: F.struct(
        F.greatest(F.lit(0), p - F.col("len") + 1, F.when(i >= F.col("times"), F.get("ps", (i - F.col("times")).cast("int")) + 1).otherwise(0)).alias("first"), p.alias("last")
    ))
    each = places.select("key", "item_id", F.inline(spans)).where("first <= last")
    changes = each.select("key", "item_id", F.inline(F.array(
        F.struct(F.col("first").alias("start"), F.lit(1).alias("change")), F.struct((F.col("last") + 1).alias("start"), F.lit(-1).alias("change"))
    )))
    asked = windows.select("key", "item_id", "start", F.lit(0).alias("change")).distinct()
    steps = changes.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True)))
    steps = steps.groupBy("key", "item_id", "start").agg(F.sum("change").alias("change"), F.max("asked").alias("asked"))
    upto = Window.partitionBy("key", "item_id").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("common", F.sum("change").over(upto)).where("asked").select("key", "item_id", "start", "common")


def _blocks(fp: Column, radius: int) -> Column:
    """(block number, its bits) of a fingerprint cut into radius + 1 blocks."""
    count = radius + 1
    cuts = [64 * k // count for k in range(count + 1)]
    return F.array(*[
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
    ])


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """(id, item_id, similarity, first_shingle): each document's best window of each item it contains.

    Similarity is the weighted Jaccard of window and item shingles. Ties take
    the earliest window. A window at the end of a document is as long as the
    document allows. Null and empty texts contain nothing; items without words
    are ignored; documents with a null id are reported under null. Items and
    documents may have any length. Repeated documents are compared once, by 128
    bits of hash of their text.
    """
    wanted = items.select(F.col(item_id).alias("item_id"), shingle_hashes(F.col(item_text)).alias("g"))
    # A repeated id with another text is an item of its own until the end.
    wanted = wanted.where(F.size("g") > 0).dropDuplicates().withColumn("item", F.struct("item_id", F.xxhash64("g").alias("a"), F.xxhash64(F.lit(7), "g").alias("b")))
    wanted = checkpointed(wanted.withColumn("len", F.size("g")))
    known = checkpointed(wanted.select(F.col("item").alias("item_id"), "len", F.explode("g").alias("h")).groupBy("item_id", "len", "h").agg(F.count("*").alias("times")))
    single = small(checkpointed(known.select("h").distinct()))

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    texts = texts.withColumn("key", F.struct(F.xxhash64("t").alias("a"), F.xxhash64(F.lit(7), "t").alias("b")))
    shingled = texts.select("id", "key", F.explode(shingle_hashes(F.col("t"))).alias("h"))
    touched = checkpointed(shingled.join(single, "h", "left_semi").select("id", "key").distinct())

    # Whole texts of the touched documents, one of each.
    keys = small(checkpointed(touched.select("key").distinct()))
    bodies = texts.join(keys, "key", "left_semi").select("key", "t").dropDuplicates(["key"])
    bodies = checkpointed(bodies.select("key", shingle_hashes(F.col("t")).alias("g")))
    placed = bodies.select("key", F.size("g").alias("size"), F.posexplode("g").alias("pos", "h"))
    hits = checkpointed(placed.join(small(known), "h"))
    starts = hits.select("key", "item_id", "len", "size", F.explode(F.array("pos", F.greatest(F.lit(0), F.col("pos") - F.col("len") + 1))).alias("start")).distinct()
    windows = starts.withColumn("stop", F.least(F.col("start") + F.col("len"), F.col("size"))).drop("size")
    prints = _window_prints(bodies, windows)

    item_sums = wanted.select(F.col("item").alias("item_id"), "len", F.explode("g").alias("h")).select("item_id", "len", *_bit_counts(F.col("h")))
    item_sums = item_sums.groupBy("item_id", "len").agg(*[F.sum(s).alias(s) for s in SUMS])
    item_prints = item_sums.select("item_id", _simhash([F.col(s) for s in SUMS], F.col("len")).alias("ifp"))
    item_blocks = checkpointed(item_prints.select("item_id", "ifp", F.inline(_blocks(F.col("ifp"), radius))))
    near = (
        prints.select("key", "item_id", "len", "start", "stop", "fp", F.inline(_blocks(F.col("fp"), radius)))
        .join(small(item_blocks), ["item_id", "block", "bits"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius)
        .select("key", "item_id", "len", "start", "stop")
        .distinct()
    )
    near = checkpointed(near)
    met = hits.join(near.select("key", "item_id").distinct(), ["key", "item_id"], "left_semi")
    verified = near.join(_overlaps(met.select("key", "item_id", "len", "h", "times", "pos"), near), ["key", "item_id", "start"])
    alike = F.col("common") / (F.col("stop") - F.col("start") + F.col("len") - F.col("common"))
    found = verified.select("key", F.col("item_id.item_id").alias("item_id"), "start", alike.alias("similarity")).where(F.col("similarity") >= similarity)
    best = found.groupBy("key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("b"))
    return touched.join(best, "key").groupBy(F.col("id").alias(id_col), "item_id").agg(F.max("b").alias("b")).select(
        id_col, "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.back")).alias("first_shingle")
    )
