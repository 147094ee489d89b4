"""Byte-level helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space: blank and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_blocks(
    batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1_000_000
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into row blocks of about ``max_bytes`` of text.

    Yields (rows, bytes of all texts, offsets of each text). A null is an empty
    text. A text longer than ``max_bytes`` is a block of its own, never cut.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            part = pc.fill_null(texts.slice(first, last - first), "")
            if isinstance(part, pa.ChunkedArray):
                part = part.combine_chunks()
            offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + len(part) + 1]
            data = part.buffers()[2]
            raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
            yield batch.slice(first, last - first), raw[offsets[0] : offsets[-1]], offsets - offsets[0]
            first = last


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the first word of each text (one more entry at the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[raw]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    opens[edge] = solid[edge]
    closes[edge - 1] = solid[edge - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Uniform doubles inside (0, 1) from hashed uint64."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    longest = int((ends - starts).max())
    powers = np.ones(longest, dtype=np.uint64)
    np.multiply.accumulate(np.full(longest - 1, 0x9E3779B97F4A7C15, np.uint64), out=powers[1:]) if longest > 1 else None
    lengths = ends - starts
    where = np.repeat(starts, lengths) + (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    place = where - np.repeat(starts, lengths)
    terms = (raw[where].astype(np.uint64) + np.uint64(1)) * powers[place]
    return mix(np.add.reduceat(terms, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
