"""Language identification with error-correcting output codes.

Every language has a codeword; for each bit of it a binary classifier over
hashed letter n-grams tells the languages with a one from those with a zero. A
text's bits are decoded to the language whose codeword loses least, each bit
weighing as much as its classifier proved right on the training rows. A text
whose best two languages lie too close is marked ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .blocks import text_blocks
from .joining import small

BUCKETS = 1 << 16
ORDERS = (2, 3)
#: Training rows of each language, about: a hash of the id picks them.
ROWS_PER_LANGUAGE = 4000
#: A text is ambiguous below this difference of its two best scores.
AMBIGUOUS = 0.05
#: Bytes of text worked on at once. A byte takes some 150 bytes for a while: its n-grams and their weights for every bit.
BLOCK_BYTES = 1 << 18
#: From this many n-grams on, more text makes a score no surer.
SURE_AT = 100

_LETTERS = np.zeros(256, dtype=np.uint32)
_LETTERS[97:123] = np.arange(1, 27)
_LETTERS[65:91] = np.arange(1, 27)
_LETTERS[128:] = np.arange(27, 155)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """One row of +1/-1 for each language. Up to 7 languages: all splits; beyond: far-apart random columns."""
    if languages < 2:
        return np.ones((languages, 1), dtype=np.int8)
    if languages <= 7:
        splits = np.arange(1, 1 << (languages - 1))
        return np.array([[1 if k == 0 or not s >> (k - 1) & 1 else -1 for s in splits] for k in range(languages)], np.int8)
    width = max(15, int(np.ceil(10 * np.log2(languages))))
    draw = np.random.default_rng(seed)
    tries = (draw.choice(np.array([-1, 1], np.int8), (languages, width)) for _ in range(200))
    return max(tries, key=lambda c: np.min((width - c.astype(int) @ c.T.astype(int)) / 2 + width * np.eye(languages)))


def _grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that begin at each byte, one row per order, and which of them count.

    ASCII letters lose their case, other ASCII is one separator; an n-gram of
    separators alone and one that leaves its text do not count.
    """
    symbol = _LETTERS[raw]
    buckets, counted = [], []
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(raw))
    for n in ORDERS:
        code = np.full(len(raw), n, dtype=np.uint32)
        any_letter = np.zeros(len(raw), dtype=bool)
        for k in range(n):
            next_symbol = symbol[k:] if not k else np.concatenate((symbol[k:], np.zeros(min(k, len(raw)), np.uint32)))[: len(raw)]
            code = code * np.uint32(155) + next_symbol
            any_letter |= next_symbol > 0
        buckets.append((code * np.uint32(0x9E3779B1)) >> np.uint32(16))
        counted.append(any_letter & (left >= n))
    return np.array(buckets), np.array(counted)


@dataclass
class Coder:
    """weights: bucket x bit; the last bucket is empty. trust: of each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean weight of each text's n-grams for each bit, and how many n-grams it has."""
        sums = np.zeros((len(offsets) - 1, self.code.shape[1]))
        counts = np.zeros(len(offsets) - 1)
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            for buckets, counted in zip(*_grams(raw, offsets)):
                found = self.weights[np.where(counted, buckets, BUCKETS)]
                sums[full] += np.add.reduceat(found, offsets[full], axis=0, dtype=np.float64)
                counts[full] += np.add.reduceat(counted, offsets[full], dtype=np.int64)
        return sums / np.maximum(counts, 1)[:, None], counts

    def decode(self, margins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Scores of all languages, adding to one: softmax of minus the weighted loss of their codewords."""
        gain = np.sqrt(np.clip(counts, 1, SURE_AT))[:, None]
        loss = np.zeros((len(margins), len(self.languages)))
        for k, word in enumerate(self.code):
            loss[:, k] = np.logaddexp(0, -margins * gain * word) @ self.trust
        shifted = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return shifted / shifted.sum(axis=1, keepdims=True)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _sampled(rows: DataFrame, per_language: int) -> DataFrame:
    """Rows of a bounded number of each language, picked by a hash of id and text: the same rows on every run.

    The row of the lowest hash is always in, so no language is lost; of rows
    equal in id and text one is.
    """
    hashed = rows.withColumn("_pick", F.pmod(F.xxhash64("id", "t", F.lit("train")), F.lit(1 << 40)))
    sizes = hashed.groupBy("lang").agg(F.count("*").alias("n"), F.min("_pick").alias("_least"))
    share = F.least(F.lit(1.0), per_language / F.col("n"))
    picked = (F.col("_pick") < share * (1 << 40)) | (F.col("_pick") == F.col("_least"))
    return hashed.join(small(checkpointed(sizes)), "lang").where(picked).dropDuplicates(["lang", "id", "t"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = ROWS_PER_LANGUAGE) -> Coder:
    """Fit all bit classifiers on about ``per_language`` rows of each language, whole texts.

    Rows without language or without letter teach nothing. n-gram counts are
    summed in Spark; languages x buckets numbers come back, not texts. No usable
    row gives a coder without languages, which answers ``und`` to everything.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang"))
    rows = _sampled(rows.where(F.col("lang").isNotNull() & has_letter(F.col("t"))), per_language).select("lang", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for part, raw, offsets in text_blocks(batches, "t", BLOCK_BYTES):
            names = np.array(part.column(0).to_pylist(), dtype=object)
            owner = np.repeat(np.arange(len(names)), np.diff(offsets))
            for buckets, counted in zip(*_grams(raw, offsets)):
                for name in set(names):
                    here = counted & (names == name)[owner]
                    seen.setdefault(name, np.zeros(BUCKETS, np.int64))
                    seen[name] += np.bincount(buckets[here], minlength=BUCKETS)
        for name, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"]
            )

    counts = (
        rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = sorted(counts["lang"].unique())
    code = codewords(len(languages))
    shares = np.zeros((len(languages), BUCKETS))
    for k, name in enumerate(languages):
        own = counts[counts["lang"] == name]
        shares[k, own["bucket"].to_numpy()] = own["n"].to_numpy()
        shares[k] = (shares[k] + 0.5) / (shares[k].sum() + 0.5 * BUCKETS)
    weights = np.zeros((BUCKETS + 1, code.shape[1]), dtype=np.float32)
    if len(languages) > 1:
        for bit in range(code.shape[1]):
            one, zero = code[:, bit] > 0, code[:, bit] < 0
            weights[:BUCKETS, bit] = np.log(shares[one].mean(axis=0)) - np.log(shares[zero].mean(axis=0))
    coder = Coder(languages, code, weights, np.full(code.shape[1], 1.0 / max(1, code.shape[1])))
    if len(languages) > 1:
        coder.trust = _trust(rows, coder)
    return coder


def _trust(rows: DataFrame, coder: Coder) -> np.ndarray:
    """How often each bit is right on the training rows, mean over languages, above chance, adding to one."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(coder))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in text_blocks(batches, "t", BLOCK_BYTES):
            own = Coder(**shared.value)
            langs = part.column(0).to_pylist()
            truth = own.code[[own.languages.index(x) for x in langs]]
            right = (own.margins(raw, offsets)[0] * truth > 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), pa.array(list(right))], names=["lang", "right"])

    bits = coder.code.shape[1]
    hits = rows.mapInArrow(score, "lang string, right array<double>").groupBy("lang").agg(
        F.array(*[F.avg(F.col("right")[b]) for b in range(bits)]).alias("right")
    )
    right = np.array([r.right for r in hits.collect()]).mean(axis=0)
    trust = np.maximum(right - 0.5, 0.01)
    return trust / trust.sum()


def with_language(docs: DataFrame, coder: Coder, text_col: str = "text", ambiguous: float = AMBIGUOUS,
                  keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (default: all) with lang_pred, score and ambiguous, from the whole text.

    A null text, an empty one and one without letter are ``und`` with score 0,
    not ambiguous. Repeated rows are answered once each; ties go to the language
    that sorts first. Columns of the three names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(coder))
    plain = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score", "ambiguous")]
    sent = plain if text_col in plain else [*plain, text_col]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in text_blocks(batches, text_col, BLOCK_BYTES):
            own = Coder(**shared.value)
            lettered = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            if not own.languages:
                lettered = np.zeros_like(lettered)
            n = len(lettered)
            names = np.full(n, "und", dtype=object)
            best, close = np.zeros(n), np.zeros(n, dtype=bool)
            if lettered.any():
                scores = own.decode(*own.margins(raw, offsets))
                top = scores.argmax(axis=1)
                best = np.where(lettered, scores.max(axis=1), 0.0)
                names[lettered] = np.array(own.languages, dtype=object)[top[lettered]]
                if scores.shape[1] > 1:
                    second = np.sort(scores, axis=1)[:, -2]
                    close = lettered & (best - second < ambiguous)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[: len(plain)], pa.array(names, pa.string()), pa.array(best), pa.array(close)], names=[*plain, "lang_pred", "score", "ambiguous"]
            )

    schema = docs.select(*plain).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return docs.select(*sent, has_letter(F.col(text_col)).alias("_lettered")).mapInArrow(task, schema)


def predict(docs: DataFrame, coder: Coder, id_col: str = "doc_id", text_col: str = "text", ambiguous: float = AMBIGUOUS) -> DataFrame:
    """(id, lang_pred, score, ambiguous) of every row; see ``with_language``."""
    return with_language(docs, coder, text_col, ambiguous, keep=[id_col])


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo: the fold of a row; a null id has the fold of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(modulus))
