"""Toxicity by a support vector machine on a gapped subsequence kernel.

The kernel counts common subsequences of three symbols inside windows of a
text, each gap symbol costing a factor, up to four of them in each of the two
gaps: insertions as in "ixxdxxixxoxxt" keep a word's subsequences, at less
weight. Landmark windows give the
Nyström features in which a linear machine is trained. As the kernel is an inner
product over triples, the trained machine folds into one weight per triple, and
a whole text is scored by sums over its windows.

Labels belong to documents. A toxic document says that one of its sentences is
toxic: training takes the strongest windows of its sentences for positive and
learns again, as in multiple-instance learning; windows of clean documents are
all negative. A logistic function of a document's strongest sentences gives the
score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .blocks import SPACE, text_blocks

#: Labelled documents of each class that train at most (toxic, clean), by the hash of their ids.
MAX_DOCS = (2500, 5000)
WINDOW = 20
GAP = 0.5
LANDMARKS = 400
ROUNDS = 4
#: Symbols that a gap holds at most.
GAP_SYMBOLS = 4
SPAN = 2 * (GAP_SYMBOLS + 1)
#: Offsets of the second and third symbol, and the weight of the gaps between.
PAIRS = [(j, k, GAP ** (k - 2)) for k in range(2, SPAN + 1) for j in range(1, k) if max(j, k - j) <= GAP_SYMBOLS + 1]
#: Blanks after a text: none of its windows reaches a triple of the next text.
PAD = WINDOW + SPAN
TRIPLES = 1 << 18

_SYMBOL = np.zeros(256, dtype=np.uint32)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27 + (np.arange(128, 256) & 31)
for _sign, _letter in zip(b"013457@$", b"oieastas"):  # digits and signs that stand for letters
    _SYMBOL[_sign] = _letter - 96
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?\n")] = True


def squeeze(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts without what is inserted into words: signs between two letters (i.d-i**o.t), however many, and whatever
    signs and blanks stand between the letters of a word spelled out (i d i o t, i - d - i - o - t). Letters that are
    inserted stay; the kernel's gaps bear them."""
    n = len(raw)
    if n < 3:
        return raw, offsets
    letter = _SYMBOL[raw] > 0
    blank = SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    # Runs of signs and blanks, cut at the ends of texts.
    begins = ~letter
    begins[1:] &= letter[:-1] | edge[1:-1]
    first = np.flatnonzero(begins)
    if not len(first):
        return raw, offsets
    ends = ~letter
    ends[:-1] &= letter[1:] | edge[1:-1]
    last = np.flatnonzero(ends)
    inside = ~edge[first] & ~edge[last + 1]  # a letter of the same text on either side
    blanks = np.concatenate(([0], np.cumsum(blank)))
    signs = blanks[last + 1] == blanks[first]
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    # Letters on their own: nothing of their text or no letter on their other side.
    alone = (edge[before] | ~letter[before - 1]) & (edge[after + 1] | ~letter[np.minimum(after + 1, n - 1)])
    drop = np.repeat(inside & (signs | alone), last + 1 - first)
    keep = np.ones(n, dtype=bool)
    keep[~letter] = ~drop
    kept = np.concatenate(([0], np.cumsum(keep)))
    return raw[keep], kept[offsets]


def _symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each followed by PAD blanks, and the begin of each text (one more entry at the end)."""
    sizes = np.diff(offsets)
    begin = np.concatenate(([0], np.cumsum(sizes + PAD)))
    out = np.zeros(int(begin[-1]), dtype=np.uint32)
    out[np.arange(len(raw)) + np.repeat(begin[:-1] - offsets[:-1], sizes)] = _SYMBOL[raw]
    return out, begin


def _triples(symbols: np.ndarray, j: int, k: int) -> np.ndarray:
    """The triple that begins at each symbol but the last SPAN."""
    n = len(symbols) - SPAN
    return (symbols[:n] << np.uint32(12)) | (symbols[j : n + j] << np.uint32(6)) | symbols[k : n + k]


@dataclass
class Machine:
    """Weight of each triple, the bias of a window, and the logistic weights of a document."""

    weights: np.ndarray
    bias: float
    logistic: np.ndarray

    def windows(self, symbols: np.ndarray) -> np.ndarray:
        """Score of the window that begins at each symbol."""
        sums = np.zeros(len(symbols), dtype=np.float64)
        if len(symbols) > SPAN:
            for j, k, weight in PAIRS:
                sums[: len(symbols) - SPAN] += np.float32(weight) * self.weights[_triples(symbols, j, k)]
        total = np.concatenate(([0.0], np.cumsum(sums)))
        end = np.minimum(np.arange(len(symbols)) + WINDOW, len(symbols))
        return total[end] - total[:-1] + self.bias

    def sentences(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best window score of each sentence of non-empty texts, its place, its text, and the symbols of the block."""
        raw, offsets = squeeze(raw, offsets)
        symbols, begin = _symbols(raw, offsets)
        score = self.windows(symbols)
        own = np.zeros(len(symbols), dtype=bool)
        own[np.arange(len(raw)) + np.repeat(begin[:-1] - offsets[:-1], np.diff(offsets))] = True
        score[~own] = -np.inf  # a window that begins after a text may reach the next one
        starts = np.zeros(len(symbols), dtype=bool)
        starts[begin[:-1]] = np.diff(offsets) > 0
        after = np.flatnonzero(_STOP[raw]) + 1
        owner = np.searchsorted(offsets, after - 1, side="right") - 1
        inner = after < offsets[owner + 1]
        starts[after[inner] + (begin[:-1] - offsets[:-1])[owner[inner]]] = True
        cut = np.flatnonzero(starts)
        if not len(cut):
            return np.zeros(0), cut, cut, symbols
        # A text's last windows reach into the blanks after it; windows of the next text never come in.
        text = np.searchsorted(begin, cut, side="right") - 1
        best = np.maximum.reduceat(score, cut)
        end = np.append(cut[1:], len(symbols))
        hit = np.flatnonzero(score == np.repeat(best, end - cut)) if cut[0] == 0 else cut[0] + np.flatnonzero(score[cut[0] :] == np.repeat(best, end - cut))
        place = np.empty(len(cut), dtype=np.int64)
        which = np.searchsorted(cut, hit, side="right") - 1
        place[which[::-1]] = hit[::-1]
        return best, place, text, symbols

    def features(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text: the scores of its two strongest sentences, what the strongest has above zero, and one."""
        out = np.full((len(offsets) - 1, 4), self.bias)
        best, _, text, _ = self.sentences(raw, offsets)
        if len(best):
            order = np.lexsort((-best, text))
            best, text = best[order], text[order]
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            out[text[first], 0] = best[first]
            second = first + 1
            second = second[second < len(text)]
            second = second[text[second] == text[second - 1]]
            out[text[second], 1] = best[second]
        out[:, 2] = np.maximum(out[:, 0], 0)
        out[:, 3] = 1.0
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.logistic, -500, 500)))


def _vectors(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triples of each window (rows of WINDOW + SPAN symbols) and their weights."""
    rows = windows.astype(np.uint32)
    triples = [(rows[:, :WINDOW] << 12) | (rows[:, j : WINDOW + j] << 6) | rows[:, k : WINDOW + k] for j, k, _ in PAIRS]
    weights = np.repeat([w for _, _, w in PAIRS], WINDOW)
    out = np.concatenate(triples, axis=1)
    return out, np.where(out > 0, weights, 0.0)


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Squared-hinge support vector machine by Newton steps; the last column of z is the bias."""
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        left, right = penalty.copy(), np.zeros(z.shape[1])
        for low in range(0, len(z), 2000):  # blocks of rows: the driver holds one copy of the features
            block = z[low : low + 2000].astype(np.float64)
            part, sign = weight[low : low + 2000], y[low : low + 2000]
            part = np.where(sign * (block @ w) < 1, part, 0.0)
            left += (block * part[:, None]).T @ block
            right += block.T @ (part * sign)
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def fit_windows(windows: np.ndarray, y: np.ndarray, landmarks: int = LANDMARKS, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights of all triples and bias, from labelled windows (y: +1, -1), by Nyström features of landmark windows."""
    draw = np.random.default_rng(seed)
    chosen = []
    for side in (1, -1):
        own = np.flatnonzero(y == side)
        chosen += list(draw.permutation(own)[: landmarks // 2])
    marks = np.unique(windows[chosen], axis=0)
    triples, weights = _vectors(marks)
    used = np.unique(triples)
    basis = np.zeros((len(marks), len(used)), dtype=np.float32)
    np.add.at(basis, (np.arange(len(marks))[:, None], np.searchsorted(used, triples)), weights)
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    keep = values > values.max() * 1e-6
    root = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)  # landmarks x features
    z = np.empty((len(windows), root.shape[1] + 1), dtype=np.float32)
    step = 250
    for low in range(0, len(windows), step):
        triples, weights = _vectors(windows[low : low + step])
        at = np.minimum(np.searchsorted(used, triples), len(used) - 1)
        known = np.where(used[at] == triples, weights, 0.0)
        dense = np.zeros((len(triples), len(used)), dtype=np.float32)
        np.add.at(dense, (np.arange(len(triples))[:, None], at), known)
        z[low : low + step, :-1] = dense @ basis.T @ root
    z[:, -1] = 1.0
    scale = float(np.sqrt(np.einsum("ij,ij->i", z[:, :-1], z[:, :-1]).mean()))
    z[:, :-1] /= scale
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * 100
    w = _machine(z, y.astype(float), share)
    table = np.zeros(TRIPLES, dtype=np.float32)
    table[used] = basis.T @ (root @ (w[:-1] / scale))
    table[0] = 0
    return table, float(w[-1])


def inserted(windows: np.ndarray, seed: int) -> np.ndarray:
    """The windows with one to GAP_SYMBOLS letters put in somewhere: what the machine has to bear."""
    draw = np.random.default_rng(seed)
    at = draw.integers(2, WINDOW - 2, len(windows))[:, None]
    many = draw.integers(1, GAP_SYMBOLS + 1, len(windows))[:, None]
    place = np.arange(windows.shape[1])[None, :]
    shifted = np.take_along_axis(windows, np.where(place < at, place, np.maximum(place - many, 0)), axis=1)
    letters = draw.integers(1, 27, windows.shape)
    return np.where((place >= at) & (place < at + many), letters, shifted).astype(np.uint8)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = (weight * (y - p)) @ x - 1e-3 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, bound: tuple[int, int]) -> tuple[DataFrame, np.ndarray]:
    """(t, y) of a bounded number of labelled documents, and how many labels stand for one of each class."""
    marks = labels.select(F.col(labels.columns[0]).alias("_id"), F.col(labels.columns[1]).cast("int").alias("y")).where("_id is not null and y in (0, 1)")
    marks = marks.groupBy("_id").agg(F.max("y").alias("y"))
    sizes = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [marks.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(bound[1 - y]) for y in (1, 0)]
    ids = checkpointed(picked[0].union(picked[1]))
    rows = docs.join(F.broadcast(ids), F.col(id_col) == F.col("_id")).select(F.coalesce(text_col, F.lit("")).alias("t"), "y")
    stands = np.array([max(1.0, sizes.get(y, 0) / bound[1 - y]) for y in (0, 1)])
    return checkpointed(rows), stands


def _odds(rows: DataFrame) -> np.ndarray:
    """Log-odds of each triple between texts of the two classes, by how many hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, TRIPLES), dtype=np.int64)
        for part, raw, offsets in text_blocks(batches, "t"):
            symbols, begin = _symbols(*squeeze(raw, offsets))
            for d, y in enumerate(part.column(1).to_pylist()):
                own = symbols[begin[d] : begin[d + 1]]
                held = np.zeros(TRIPLES, dtype=bool)
                for j, k, _ in PAIRS:
                    held[_triples(own, j, k)] = True
                sums[y] += held
        at = np.flatnonzero(sums.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["f", "a", "b"])

    found = rows.mapInArrow(count, "f int, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    table = np.zeros(TRIPLES, dtype=np.float32)
    some = found[found["a"] + found["b"] >= 3]
    share = [(some[c] + 1) / (sizes.get(y, 0) + 2) for y, c in ((0, "a"), (1, "b"))]
    table[some["f"]] = np.log(share[1]) - np.log(share[0])
    table[0] = 0
    return table


def _strongest(rows: DataFrame, machine: Machine, each: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strongest windows of the ``each`` strongest sentences of every text and one window anywhere:
    (windows, class, score, rank: 0 for the strongest, -1 for the one anywhere)."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(machine))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(**shared.value)
        for part, raw, offsets in text_blocks(batches, "t"):
            best, place, text, symbols = own.sentences(raw, offsets)
            symbols = np.concatenate((symbols, np.zeros(WINDOW + SPAN, np.uint32))).astype(np.uint8)
            y = part.column(1).to_numpy(zero_copy_only=False)
            order = np.lexsort((-best, text))
            first = np.flatnonzero(np.append(True, text[order][1:] != text[order][:-1])) if len(order) else order
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            top = order[rank < each]
            # Somewhere in the text itself, told by its own bytes.
            tight, cut = squeeze(raw, offsets)
            begin = np.concatenate(([0], np.cumsum(np.diff(cut) + PAD)))
            drawn = [begin[k] + crc32(tight[cut[k] : cut[k + 1]].tobytes()) % (cut[k + 1] - cut[k]) for k in text[order[first]]]
            at = np.concatenate((place[top], np.array(drawn, dtype=np.int64)))
            ranks = np.concatenate((rank[rank < each], np.full(len(first), -1)))
            labels = np.concatenate((y[text[top]], y[text[order[first]]]))
            scores = np.concatenate((best[top], np.full(len(first), -1.0)))
            taken = [symbols[a : a + WINDOW + SPAN].tobytes() for a in at]
            yield pa.RecordBatch.from_arrays([pa.array(taken, pa.binary()), pa.array(labels.astype(np.int32)), pa.array(scores), pa.array(ranks.astype(np.int32))], names=["w", "y", "s", "r"])

    found = rows.mapInArrow(task, "w binary, y int, s double, r int").toPandas()
    windows = np.frombuffer(b"".join(found["w"]), np.uint8).reshape(-1, WINDOW + SPAN)
    return windows, found["y"].to_numpy(), found["s"].to_numpy(), found["r"].to_numpy()


def _features(rows: DataFrame, machine: Machine) -> tuple[np.ndarray, np.ndarray]:
    shared = rows.sparkSession.sparkContext.broadcast(vars(machine))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in text_blocks(batches, "t"):
            x = Machine(**shared.value).features(raw, offsets)
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), part.column(1)], names=[*"abcd", "y"])

    found = rows.mapInArrow(task, "a double, b double, c double, d double, y int").toPandas()
    return found[list("abcd")].to_numpy(), found["y"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: tuple[int, int] = MAX_DOCS) -> Machine:
    """Fit on at most ``bound`` (toxic, clean) labelled documents, whole texts; labels: id, 0 or 1.

    Only windows of WINDOW + SPAN symbols come to the driver, four of a document. Labels of
    unknown ids, null labels and other values are ignored; an id labelled both
    ways is toxic. Without documents of both classes every score is 0.
    """
    rows, stands = _sample(docs, labels, id_col, text_col, bound)
    machine = Machine(_odds(rows), 0.0, np.array([0.0, 0.0, 0.0, -50.0]))
    if {r.y for r in rows.select("y").distinct().collect()} != {0, 1}:
        return machine
    for turn in range(ROUNDS):
        windows, y, score, rank = _strongest(rows, machine)
        # Of a toxic document its strongest window is positive, the next ones if they are beyond the bound of the machine.
        positive = (y == 1) & (rank >= 0) & ((rank == 0) | ((score > 0) & (turn > 0)))
        if turn > 0:
            positive &= (score > -1) | (rank < 0)
        negative = y == 0
        if not positive.any() or not negative.any():
            break
        taken = np.concatenate((windows[positive], inserted(windows[positive], turn), windows[negative]))
        sign = np.repeat([1, 1, -1], [positive.sum(), positive.sum(), negative.sum()])
        machine.weights, machine.bias = fit_windows(taken, sign)
    x, y = _features(rows, machine)
    machine.logistic = _logistic(x, y, stands[y])
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row, from its whole text; a null text is scored as an empty one.

    Repeated rows get equal scores; a score of exactly one half predicts toxic.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(machine))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(**shared.value)
        for part, raw, offsets in text_blocks(batches, "t"):
            p = own.score(own.features(raw, offsets))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(task, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
