"""Spelling variants of a vocabulary by search schemes on a bidirectional FM-index.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. One error leaves one half of a word untouched, so two searches
find everything: the left half with its delimiter exactly, then to the right
with one error up to the next delimiter; or the right half exactly, then to the
left. Suffix-rank intervals of the delimited vocabulary and of its reverse are
kept in step, so a search goes on in either direction from where it stands.

Near words share their first or their last ``min_chars // 2`` code points.
Every word is dealt to the unit of its beginning and to that of its end; a unit
is one task's index and queries. A beginning or an end that very many words
share is cut into blocks of bounded size, every block of queries meeting every
block of the index, so no task grows with the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .blocks import text_blocks
from .joining import small

MIN_CHARS = 6
MIN_COUNT = 5
#: A form occurs at least this many times as often as its variant.
TIMES = 5
#: Words of an index, about; queries searched at a time; counted words that a task holds.
UNIT_WORDS = 16_384
SLICE = 8_192
HELD_WORDS = 300_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
               damage: int | None = None) -> DataFrame:
    """(word, n): letter runs of all whole texts, A-Z lower-cased, of ``min_chars`` code points and ``min_count`` occurrences at least.

    damage: where this divides h, the crc32 of ``id:run``, code point
    h % length is deleted first (a null id is empty text). A null text has no
    words. Repeated rows count each; extra columns are ignored.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_chars},}}")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        held: Counter[str] = Counter()
        for part, raw, offsets in text_blocks(batches, "t"):
            whole, ends = _LOWER[raw].tobytes(), offsets.tolist()
            for name, a, b in zip(part.column(0).to_pylist(), ends, ends[1:]):
                found = runs.findall(whole[a:b].decode())
                if damage is None:
                    held.update(found)
                    continue
                start = zlib.crc32(f"{name}:".encode())
                for run, k in Counter(found).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % damage == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < min_chars:
                            continue
                    held[run] += k
            if len(held) > HELD_WORDS:
                yield batch()
                held.clear()
        yield batch()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("t"))
    counted = rows.mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


class Wavelet:
    """Wavelet matrix of a sequence of small numbers: ranks, counts of smaller symbols and the symbols of intervals, for many intervals at once."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.zeros, self.split = bits, [], []
        for b in range(bits - 1, -1, -1):
            low = symbols >> b & 1 == 0
            self.zeros.append(np.concatenate(([0], np.cumsum(low))).astype(np.int32))
            self.split.append(int(low.sum()))
            symbols = np.concatenate((symbols[low], symbols[~low]))
        # Where each symbol's run begins on the last level.
        every = np.arange(1 << bits)
        self.first = np.zeros(1 << bits, dtype=np.int64)
        self.first = self._walk(np.zeros(len(every), np.int64), np.zeros(len(every), np.int64), every)[0]

    def _walk(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        smaller = np.zeros(len(lo), dtype=np.int64)
        for k, (zeros, split) in enumerate(zip(self.zeros, self.split)):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            lo0, hi0 = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            smaller += np.where(one, hi0 - lo0, 0)
            lo, hi = np.where(one, split + lo - lo0, lo0), np.where(one, split + hi - hi0, hi0)
        return lo, hi - lo, smaller

    def step(self, lo: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ``symbol`` before each interval: its rank; inside it: its count and that of smaller symbols."""
        at, count, smaller = self._walk(lo, lo + size, symbol)
        return at - self.first[symbol], count, smaller

    def symbols(self, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All distinct symbols of the intervals: (interval, symbol, rank, count, smaller)."""
        owner, symbol, smaller, hi = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64), lo + size
        for zeros, split in zip(self.zeros, self.split):
            lo0, hi0 = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            lo1, hi1, left = split + lo - lo0, split + hi - hi0, hi0 - lo0
            zero, one = left > 0, hi1 > lo1
            owner = np.concatenate((owner[zero], owner[one]))
            symbol = np.concatenate((symbol[zero] * 2, symbol[one] * 2 + 1))
            smaller = np.concatenate((smaller[zero], smaller[one] + left[one]))
            lo, hi = np.concatenate((lo0[zero], lo1[one])), np.concatenate((hi0[zero], hi1[one]))
        return owner, symbol, lo - self.first[symbol], hi - lo, smaller


def rotation_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Starts of the sorted rotations of a sequence that is no repetition, by doubling their compared length."""
    n, width = len(symbols), max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    for k in range(width):
        key = key << bits | np.roll(symbols, -k)
    while True:
        _, rank = np.unique(key, return_inverse=True)
        if width >= n or rank.max() == n - 1:
            return np.argsort(rank, kind="stable")
        key = rank.astype(np.int64) * n + np.roll(rank, -width)
        width *= 2


class Index:
    """Bidirectional FM-index of sorted distinct words, each behind a delimiter (symbol 0), read as a ring."""

    def __init__(self, words: list[str], letters: np.ndarray) -> None:
        text = np.frombuffer(("\0" + "\0".join(words)).encode("utf-32-le"), dtype=np.uint32)
        symbols = np.searchsorted(letters, text).astype(np.int64)
        bits = max(1, int(len(letters) - 1).bit_length())
        order = rotation_order(symbols, bits)
        self.n, self.order = len(symbols), order
        self.word_at = np.cumsum(symbols == 0) - 1
        self.below = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=1 << bits))))
        self.left = Wavelet(symbols[order - 1], bits)
        back = symbols[::-1]
        self.right = Wavelet(back[rotation_order(back, bits) - 1], bits)

    def extend(self, lo: np.ndarray, lo_back: np.ndarray, size: np.ndarray, symbol: np.ndarray, to_right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both intervals of the patterns made longer by a symbol at one end."""
        if to_right:
            rank, count, smaller = self.right.step(lo_back, size, symbol)
            return lo + smaller, self.below[symbol] + rank, count
        rank, count, smaller = self.left.step(lo, size, symbol)
        return self.below[symbol] + rank, lo_back + smaller, count

    def branches(self, lo: np.ndarray, lo_back: np.ndarray, size: np.ndarray, to_right: bool) -> tuple[np.ndarray, ...]:
        """All extensions by one symbol: (pattern, symbol, its two intervals, size)."""
        if to_right:
            owner, symbol, rank, count, smaller = self.right.symbols(lo_back, size)
            return owner, symbol, lo[owner] + smaller, self.below[symbol] + rank, count
        owner, symbol, rank, count, smaller = self.left.symbols(lo, size)
        return owner, symbol, self.below[symbol] + rank, lo_back[owner] + smaller, count

    def search(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, to_right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of all words that differ by one error in the second half of the search, each once.

        flat, starts, lengths: the queries' symbols. To the right: their left
        half exactly, then the rest with one error; else mirrored.
        """
        half = lengths // 2
        exact = half if to_right else lengths - half

        def at(q: np.ndarray, i: np.ndarray) -> np.ndarray:
            """Symbol i of the query as the search meets it: the exact part from its middle out, then the other half; 0 beyond."""
            inside, over = i < exact[q], i == exact[q]
            # Order of the search: exact part outwards, its delimiter, then the other half away from the middle.
            if to_right:
                place = np.where(inside, half[q] - 1 - i, i - 1)
            else:
                place = np.where(inside, half[q] + i, lengths[q] - i)
            last = i > lengths[q]
            return np.where(over | last, 0, flat[starts[q] + np.where(over | last, 0, place)])

        q = np.arange(len(lengths))
        lo, lo_back, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), self.n, np.int64)
        i = np.zeros(len(q), np.int64)
        while True:  # the exact half and its delimiter
            go = i <= exact[q]
            if not go.any():
                break
            lo[go], lo_back[go], size[go] = self.extend(lo[go], lo_back[go], size[go], at(q[go], i[go]), not to_right)
            i[go] += 1
            kept = size > 0
            q, i, lo, lo_back, size = q[kept], i[kept], lo[kept], lo_back[kept], size[kept]

        found_q, found_w = [], []
        clean = q, i, lo, lo_back, size
        wrong = tuple(np.zeros(0, np.int64) for _ in range(5))
        while len(clean[0]) or len(wrong[0]):
            made = []
            if len(wrong[0]):  # with their error behind them: exactly on, to the delimiter
                q, i, lo, lo_back, size = wrong
                lo, lo_back, size = self.extend(lo, lo_back, size, at(q, i), to_right)
                hit, over = size > 0, i > lengths[q]
                found_q.append(q[hit & over])
                found_w.append(self.word_at[self.order[lo[hit & over]]])
                go = hit & ~over
                made.append((q[go], i[go] + 1, lo[go], lo_back[go], size[go]))
            if len(clean[0]):
                q, i, lo, lo_back, size = clean
                here, more = at(q, i), i <= lengths[q]
                # Left out: a symbol of the query. Of a run of equal ones only the last.
                gone = more & (here != at(q, i + 1))
                made.append((q[gone], i[gone] + 1, lo[gone], lo_back[gone], size[gone]))
                owner, symbol, lo, lo_back, size = self.branches(lo, lo_back, size, to_right)
                other = (symbol != here[owner]) & (symbol != 0)
                # Put in: any symbol but the one that follows; replaced: likewise.
                made.append((q[owner[other]], i[owner[other]], lo[other], lo_back[other], size[other]))
                swap = other & more[owner]
                made.append((q[owner[swap]], i[owner[swap]] + 1, lo[swap], lo_back[swap], size[swap]))
                same = (symbol == here[owner]) & more[owner]
                clean = q[owner[same]], i[owner[same]] + 1, lo[same], lo_back[same], size[same]
            wrong = tuple(np.concatenate(x) for x in zip(*made))
        return np.concatenate([np.zeros(0, np.int64), *found_q]), np.concatenate([np.zeros(0, np.int64), *found_w])


def _frame(rows: list[tuple[str, int, int, str]]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=t) for k, (c, t) in enumerate((("word", object), ("n_near", "int64"), ("best_n", "int64"), ("best", object)))})


def near_in_unit(words: list[str], counts: np.ndarray, queries: list[str], to_right: bool) -> pd.DataFrame:
    """word, n_near, best_n, best of each query that has a near word in the index ``words`` (sorted, with ``counts``).

    A word that both searches find is left to the search to the right.
    """
    both = np.frombuffer(("\0" + "".join(words) + "".join(queries)).encode("utf-32-le"), dtype=np.uint32)
    letters = np.unique(both)
    index = Index(words, letters)
    found: list[tuple[str, int, int, str]] = []
    for first in range(0, len(queries), SLICE):
        part = queries[first : first + SLICE]
        flat = np.searchsorted(letters, np.frombuffer("".join(part).encode("utf-32-le"), dtype=np.uint32)).astype(np.int64)
        lengths = np.array([len(w) for w in part], dtype=np.int64)
        q, w = index.search(flat, np.cumsum(lengths) - lengths, lengths, to_right)
        if not to_right:
            once = np.fromiter((not words[b].startswith(part[a][: len(part[a]) // 2]) for a, b in zip(q.tolist(), w.tolist())), bool, len(q))
            q, w = q[once], w[once]
        order = np.lexsort((w, -counts[w], q))  # the index is sorted, so places are in code-point order
        q, w = q[order], w[order]
        own, lead, n = np.unique(q, return_index=True, return_counts=True)
        found += zip([part[k] for k in own], n.tolist(), counts[w[lead]].tolist(), [words[k] for k in w[lead]])
    return _frame(found)


def _units(words: DataFrame, min_chars: int, unit_words: int) -> DataFrame:
    """(side, unit, word, n, role): each word at its units; role 1 index, 2 query, 3 both."""
    width = min_chars // 2
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.left("word", F.lit(width)).alias("key")), F.struct(F.lit(1).alias("side"), F.right("word", F.lit(width)).alias("key"))))
    dealt = words.select("word", "n", sides.alias("s")).select("word", "n", "s.*")
    sizes = dealt.groupBy("side", "key").agg(F.ceil(F.count("*") / unit_words).cast("int").alias("blocks"))
    heavy = small(checkpointed(sizes.where("blocks > 1")))
    total = words.count()
    buckets = max(1, ceil(2 * total / unit_words))
    rows = dealt.join(heavy, ["side", "key"], "left")
    mine = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    light = F.array(F.struct(F.concat(F.lit("b"), F.pmod(F.xxhash64("key"), F.lit(buckets))).alias("unit"), F.lit(3).alias("role")))
    name = lambda i, j: F.concat_ws(" ", "key", i.cast("string"), j.cast("string"))
    others = lambda me: F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != me)
    crossed = F.concat(
        F.array(F.struct(name(F.col("mine"), F.col("mine")).alias("unit"), F.lit(3).alias("role"))),
        F.transform(others(F.col("mine")), lambda o: F.struct(name(F.col("mine"), o).alias("unit"), F.lit(1).alias("role"))),
        F.transform(others(F.col("mine")), lambda o: F.struct(name(o, F.col("mine")).alias("unit"), F.lit(2).alias("role"))),
    )
    placed = rows.withColumn("mine", mine).withColumn("at", F.when(F.col("blocks").isNull(), light).otherwise(crossed))
    return placed.select("side", "word", "n", F.inline("at"))


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, unit_words: int = UNIT_WORDS) -> DataFrame:
    """(word, n_near, best_n, best): for each word with near words their number and the most frequent one.

    words: distinct (word, n), each of ``min_chars`` (2 or more) code points at
    least. Ties go to the word first in code-point order.
    """

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("word", key=lambda c: c.map(lambda w: w.encode("utf-32-be")))
        own, asked = group[group["role"] != 2], group["word"][group["role"] != 1].tolist()
        if not len(own) or not asked:
            return _frame([])
        return near_in_unit(own["word"].tolist(), own["n"].to_numpy(), asked, bool(group["side"].iloc[0] == 0))

    units = _units(words, min_chars, unit_words)
    found = units.groupBy("side", "unit").applyInPandas(search, "word string, n_near long, best_n long, best string")
    # Units of a word are disjoint, so their numbers add.
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def variants(words: DataFrame, min_chars: int = MIN_CHARS, times: int = TIMES, unit_words: int = UNIT_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a vocabulary (distinct word, n).

    form: the near word of largest n, if that is ``times`` (2 or more) the
    word's own; root: the last of the chain of forms. An empty vocabulary gives
    no rows.
    """
    words = checkpointed(words.select("word", "n"))
    near = near_words(words, min_chars, unit_words)
    is_form = F.col("best_n") >= times * F.col("n")
    named = checkpointed(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    ))
    # Along a chain n grows ``times`` fold each time, so it is short; each round doubles the way gone.
    least, most = words.agg(F.min("n"), F.max("n")).first()
    links = max(1, int(log(most / least) / log(times)) + 1) if most else 1
    ways = named.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(links)) + 1 if links > 1 else 0):
        onward = ways.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        ways = checkpointed(ways.join(onward, F.col("root") == F.col("_from"), "left").select("word", F.coalesce("_to", "root").alias("root")))
    roots = ways.withColumnRenamed("word", "_word")
    return named.join(roots, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
