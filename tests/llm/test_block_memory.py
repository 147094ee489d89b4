"""What a task's block of text takes while it is worked on."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from panelwright.llm import ball_simhash, langid
from panelwright.llm.blocks import text_blocks

TEXTS = [" ".join(f"word{(k * 7 + i) % 997}" for i in range(300)) for k in range(500)]


def _peak_mb(work, module) -> float:
    batch = pa.RecordBatch.from_pydict({"t": TEXTS})
    tracemalloc.start()
    try:
        for _, raw, offsets in text_blocks(iter([batch]), "t", getattr(module, "BLOCK_BYTES", 1_000_000)):
            work(raw, offsets)
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_fingerprints_of_a_megabyte_take_few_megabytes():
    assert _peak_mb(ball_simhash.block_fingerprints, ball_simhash) < 40


def test_language_of_a_megabyte_takes_few_megabytes():
    code = langid.codewords(4)
    weights = np.zeros((langid.BUCKETS + 1, code.shape[1]), np.float32)
    coder = langid.Coder(list("abcd"), code, weights, np.full(code.shape[1], 1 / code.shape[1]))
    assert _peak_mb(coder.margins, langid) < 60


def test_small_steps_count_the_same_bits():
    hashes = np.random.default_rng(5).integers(0, 1 << 63, 40_000).astype(np.uint64) * np.uint64(2)
    firsts = np.array([0, 0, 3, 9_000, 9_000, 25_000, 40_000, 40_000])
    assert np.array_equal(ball_simhash._bit_counts(hashes, firsts), ball_simhash._bit_counts(hashes, firsts, 1 << 17))


@pytest.mark.parametrize("size", [1 << 10, 1 << 18, 1_000_000])
def test_block_size_changes_no_fingerprint(size):
    batch = pa.RecordBatch.from_pydict({"t": [*TEXTS[:50], None, "", "one"]})
    found = np.concatenate([ball_simhash.block_fingerprints(raw, offsets) for _, raw, offsets in text_blocks(iter([batch]), "t", size)])
    whole = np.concatenate([ball_simhash.block_fingerprints(raw, offsets) for _, raw, offsets in text_blocks(iter([batch]), "t", 1 << 30)])
    assert np.array_equal(found, whole)
