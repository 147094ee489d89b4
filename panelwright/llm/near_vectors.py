"""Near-duplicate vectors by collision counting on one-dimensional projections.

All vectors are projected on many random directions. Two vectors collide on a
direction if the second lies in the window centred on the first; vectors at the
wanted cosine collide on most directions, others on few. Pairs with enough
collisions are verified by their cosine in double precision. Number, window and
count are calibrated: a pair exactly at the threshold is lost with a chance
below ``1 - recall``, closer ones far less often.

Work is dealt in blocks: the first projection cuts a label into cells one
window wide, large cells into blocks of a bounded number of rows. Only blocks
of one cell or of two neighbouring ones can hold a pair inside the first window
and meet in a task, where each direction is sorted once and counted. A task
returns rows per vector, not per pair, so dense groups stay small.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .components import components

COSINE = 0.93
DIRECTIONS = 40
RECALL = 0.999
BLOCK_ROWS = 1024
SEED = 11


@dataclass(frozen=True)
class Plan:
    """Window half-widths (first direction, others) and the collisions that a pair needs."""

    first: float
    other: float
    needed: int
    recall: float


def calibrate(cosine: float, directions: int = DIRECTIONS, recall: float = RECALL) -> Plan:
    """For unit vectors at distance s the projections differ by a normal variable of deviation s.

    The first window is 4 s wide to either side, the others s; the count is the
    highest that still finds a pair at the threshold with the wanted recall.
    """
    s = sqrt(max(2 - 2 * cosine, 1e-12))
    hit = erf(1 / sqrt(2))
    first = erf(4 / sqrt(2))
    tail, needed = 1.0, 0
    for k in range(directions):
        below = tail - comb(directions, k) * hit**k * (1 - hit) ** (directions - k)
        if below * first < recall:
            break
        tail, needed = below, k + 1
    return Plan(4 * s, s, needed, tail * first)


def directions(dims: int, count: int, seed: int = SEED) -> np.ndarray:
    """Random normal directions, dims x count."""
    return np.random.default_rng([seed, dims]).standard_normal((dims, count))


def _first_projection(v: Column, seed: int = SEED) -> Column:
    """Projection of the unit vector on a normal direction whose components are hashed from their positions."""
    part = lambda i, k: (F.shiftrightunsigned(F.xxhash64(i, F.lit(seed + k)), 12).cast("double") + 0.5) * 2.0**-52
    normal = lambda i: F.sqrt(-2 * F.log(part(i, 0))) * F.cos(2 * math.pi * part(i, 1))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def of(size: Column) -> Column:
        dot = total(F.transform(v, lambda x, i: x / size * normal(i)))
        return dot / F.sqrt(total(F.transform(v, lambda x: (x / size) * (x / size))))

    # Through an array of one, so that the largest component is looked for once a vector, not once a component.
    return F.get(F.transform(F.array(F.array_max(F.transform(v, F.abs))), of), 0)


def collisions(a: np.ndarray, b: np.ndarray, half: float) -> np.ndarray:
    """How often each row of ``b`` lies in the window around each row of ``a``, over all directions (columns)."""
    n, m = len(a), len(b)
    counts = np.zeros(n * m, dtype=np.int16)
    for k in range(a.shape[1]):
        order = np.argsort(b[:, k], kind="stable")
        line = b[order, k]
        low = np.searchsorted(line, a[:, k] - half, side="left")
        size = np.searchsorted(line, a[:, k] + half, side="right") - low
        begin = np.cumsum(size) - size
        inside = order[np.arange(int(size.sum())) + np.repeat(low - begin, size)]
        counts[np.repeat(np.arange(n) * m, size) + inside] += 1  # each cell once per direction
    return counts.reshape(n, m)


def _roots(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """Smallest position that each of ``count`` positions reaches through the links a-b."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _checked(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, v, label, fine); fine: labelled, with an id, and a vector of finite, non-null components that are not all zero."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.withColumn("fine", F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole, F.lit(False)))


def _met(rows: DataFrame, plan: Plan, cosine: float, count: int) -> DataFrame:
    """(id, root, links): for each vector and task its links to others and a vector it is connected with."""
    schema = "id long, root long, links long"

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        side = group["side"].to_numpy()
        order = np.lexsort((group["id"].to_numpy(), side))
        group, side = group.iloc[order], side[order]
        ids, copies = group["id"].to_numpy(), group["copies"].to_numpy()
        x = np.stack(group["v"].to_numpy()).astype(np.float64)
        x /= np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) * np.abs(x).max(axis=1, keepdims=True)
        cut = int((side == 0).sum())
        p, first = x @ directions(x.shape[1], count), group["first"].to_numpy()
        same = cut == len(x)
        b0 = 0 if same else cut
        a, b = np.nonzero(collisions(p[:cut], p[b0:], plan.other) >= plan.needed)
        b = b + b0
        ok = (np.abs(first[a] - first[b]) <= plan.first) & ((a < b) if same else True)
        a, b = a[ok], b[ok]
        close = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) >= cosine for i in range(0, len(a), 65536)] or [np.zeros(0, bool)])
        a, b = a[close], b[close]
        links = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
        root = _roots(a, b, len(x))
        some = links > 0
        return pd.DataFrame({"id": ids[some], "root": ids[root[some]], "links": links[some].astype(np.int64)})

    return rows.groupBy("dims", "label", "one", "two").applyInPandas(meet, schema)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 cosine: float = COSINE, count: int = DIRECTIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector.

    Vectors link when their labels are equal and their cosine is at least
    ``cosine``. Rows with null id or label, and vectors that are null, empty,
    zero or hold null or non-finite components, link with nothing: no links,
    their own component. Equal vectors of a label are one class until the end;
    classes, not ids, are linked, so rows that share an id stand each for their
    own label and vector. Vectors of different lengths link with nothing.
    component_id is the smallest id of the component; equal ids in it are all
    kept or none. An empty table gives no rows, other columns are ignored.

    The work of a label grows with the pairs whose first projections are close:
    collision counting prunes verification, not the count itself.
    """
    plan = calibrate(cosine, count)
    rows = _checked(vectors, id_col, vector_col, label_col)
    valid = rows.where("fine").drop("fine")
    # Equal vectors: 128 bits of hash stand for the vector.
    keyed = valid.withColumn("key", F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(7), "v").alias("b"), F.size("v").alias("dims")))
    classes = keyed.groupBy("label", "key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # The checkpoint fixes the number that each class gets.
    reps = checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))

    placed = reps.select(F.col("key.dims").alias("dims"), "label", F.col("node").alias("id"), "copies", "v", _first_projection(F.col("v")).alias("first"))
    placed = placed.withColumn("cell", F.floor(F.col("first") / plan.first))
    sizes = checkpointed(placed.groupBy("dims", "label", "cell").agg(F.ceil(F.count("*") / block_rows).alias("blocks")))
    after = sizes.select("dims", "label", (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("next_blocks"))
    before = sizes.select("dims", "label", (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("prev_blocks"))
    around = sizes.join(after, ["dims", "label", "cell"], "left").join(before, ["dims", "label", "cell"], "left")
    spread = placed.join(around, ["dims", "label", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    name = lambda cell, block: F.struct(cell.alias("cell"), block.alias("block"))
    me, cell = F.col("block"), F.col("cell")
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    meets = F.concat(
        F.transform(up_to(me + 1), lambda o: F.struct(name(cell, o).alias("one"), name(cell, me).alias("two"), F.when(o == me, 0).otherwise(1).alias("side"))),
        F.transform(F.filter(up_to(F.col("blocks")), lambda o: o > me), lambda o: F.struct(name(cell, me).alias("one"), name(cell, o).alias("two"), F.lit(0).alias("side"))),
        F.transform(up_to(F.coalesce("next_blocks", F.lit(0))), lambda o: F.struct(name(cell, me).alias("one"), name(cell + 1, o).alias("two"), F.lit(0).alias("side"))),
        F.transform(up_to(F.coalesce("prev_blocks", F.lit(0))), lambda o: F.struct(name(cell - 1, o).alias("one"), name(cell, me).alias("two"), F.lit(1).alias("side"))),
    )
    dealt = spread.select("dims", "label", "id", "copies", "v", "first", F.inline(meets))
    met = checkpointed(_met(dealt, plan, cosine, count))

    parts = components(met.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = met.groupBy("id").agg(F.sum("links").alias("others"))
    linked = reps.select("label", "key", "rep", "copies", F.col("node").alias("me")).join(links, F.col("me") == F.col("id"), "left").drop("id")
    linked = linked.join(parts, F.col("me") == F.col("node"), "left").select(
        "label", "key", "rep", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "me").alias("root")
    )
    linked = checkpointed(linked)
    lowest = linked.groupBy("root").agg(F.min("rep").alias("component"))
    found = keyed.select("id", "label", "key").join(linked.join(lowest, "root").drop("root", "rep"), ["label", "key"]).select("id", "n_links", "component")
    lone = rows.where("NOT fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return found.union(lone).select(
        F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )
