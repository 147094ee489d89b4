"""Quality selection by importance resampling.

Two generative models of hashed word n-grams, one of the target texts and one
of all texts, give each document the log-ratio of its probabilities. Adding
Gumbel noise and taking the k largest draws k documents without replacement in
proportion to that ratio.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .blocks import mix, text_blocks, word_hashes, word_spans

BUCKETS = 10_000
ORDERS = (1, 2)
#: Documents that fit the target model at most.
MAX_TARGETS = 20_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _buckets(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a block and the text of each."""
    low = _LOWER[raw]
    starts, ends, first = word_spans(low, offsets)
    words = word_hashes(low, starts, ends)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    found, owners = [], []
    for n in ORDERS:
        if len(words) < n:
            continue
        code = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            code = mix(code + words[k : len(words) - n + 1 + k])
        inside = owner[: len(code)] == owner[n - 1 :]
        found.append((code[inside] % np.uint64(buckets)).astype(np.int64))
        owners.append(owner[: len(code)][inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def weights(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS,
            max_targets: int = MAX_TARGETS) -> np.ndarray:
    """Log-ratio of target to raw probability of each bucket, add-one smoothed.

    The raw model counts all texts. The target model counts the texts whose id
    is in ``targets`` (its first column), of ``max_targets`` ids at most, those
    with the lowest hashes; so many ids fit a broadcast. Each task sums its own
    buckets; ``buckets`` rows come back to the driver.
    """
    ids = targets.select(F.col(targets.columns[0]).alias("_target")).where("_target is not null").distinct()
    ids = ids.orderBy(F.xxhash64("_target"), "_target").limit(max_targets)
    marked = docs.join(F.broadcast(ids), F.col(id_col) == F.col("_target"), "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), dtype=np.int64)
        for part, raw, offsets in text_blocks(batches, "t"):
            found, owner = _buckets(raw, offsets, buckets)
            target = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            sums[0] += np.bincount(found, minlength=buckets)
            sums[1] += np.bincount(found[target[owner]], minlength=buckets)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["b", "n", "t"])

    rows = marked.select(F.col(text_col).alias("t"), F.col("_target").isNotNull().alias("y"))
    sums = rows.mapInArrow(count, "b int, n long, t long").groupBy("b").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toPandas()
    raw, target = np.ones(buckets), np.ones(buckets)
    raw[sums["b"]] += sums["n"]
    target[sums["b"]] += sums["t"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_ratios(docs: DataFrame, ratio: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, log_weight, n_grams): summed log-ratio of each whole text; 0 for a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in text_blocks(batches, "t"):
            found, owner = _buckets(raw, offsets, len(shared.value))
            n = len(offsets) - 1
            total = np.bincount(owner, shared.value[found], n).astype(np.float64)  # whole numbers where no text has a word
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total), pa.array(np.bincount(owner, minlength=n))], names=["id", "log_weight", "n_grams"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(task, f"id {kind}, log_weight double, n_grams long")


def gumbel(seed: int, *cols: str) -> Column:
    """A standard Gumbel number that depends on the seed and the columns alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12).cast("double") + 0.5) * 2.0**-52
    return -F.log(-F.log(u))


def _kth(scored: DataFrame, k: int) -> tuple[float, int] | None:
    """The k-th largest ``perturbed`` and how many of its equals are among the k.

    Each pass is a histogram of the range that holds it, 65,536 rows at most
    whatever k and the table are, and narrows the range to one of its cells.
    """
    low, high = scored.agg(F.min("perturbed"), F.max("perturbed")).first()
    left = k
    while low < high:
        cells = 65_536
        step = (high - low) / cells
        if step == 0 or low + step == low:
            break
        cell = F.least(F.lit(cells - 1), F.floor((F.col("perturbed") - low) / step).cast("int"))
        inside = scored.where(F.col("perturbed").between(low, high)).groupBy(cell.alias("cell"))
        counts = inside.agg(F.count("*").alias("n"), F.min("perturbed").alias("low"), F.max("perturbed").alias("high"))
        above = F.sum("n").over(Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1))
        row = counts.withColumn("above", F.coalesce(above, F.lit(0))).where((F.col("above") < left) & (F.col("above") + F.col("n") >= left)).first()
        left -= row.above
        if (row.low, row.high) == (low, high):
            break
        low, high = row.low, row.high
    return low, left


def resample(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.8,
             seed: int = 3, buckets: int = BUCKETS, max_targets: int = MAX_TARGETS) -> DataFrame:
    """(id, log_weight, n_grams, perturbed, selected): ``share`` of the rows drawn by importance.

    targets: ids of texts of the target. k is ``share`` of all rows, rounded.
    Null and empty texts have weight 0 and take part. The noise depends on seed,
    id and weight, so repeated rows have equal scores; of rows equal in score
    as many as still fit are taken, smaller ids first (nulls before all).
    """
    ratio = weights(docs, targets, id_col, text_col, buckets, max_targets)
    scored = log_ratios(docs, ratio, id_col, text_col)
    scored = checkpointed(scored.withColumn("perturbed", F.col("log_weight") + gumbel(seed, "id", "log_weight")))
    k = round(share * scored.count())
    if k <= 0:
        return scored.withColumn("selected", F.lit(False)).withColumnRenamed("id", id_col)
    bound, equals = _kth(scored, k)
    # Equal scores at the bound are copies of a row (same id and text): the first ones are taken.
    tied = scored.where(F.col("perturbed") == bound)
    order = Window.orderBy("id", "log_weight")
    tied = tied.withColumn("selected", F.row_number().over(order) <= equals)
    clear = scored.where(F.col("perturbed") != bound).withColumn("selected", F.col("perturbed") > bound)
    return clear.unionByName(tied).withColumnRenamed("id", id_col)
