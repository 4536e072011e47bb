"""What a Python process keeps between tasks."""

import re
from pathlib import Path

import numpy as np
import pytest

from pagequarry.llm import words
from pagequarry.llm.common import forget_caches


def _mb() -> float:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_freed_memory_goes_back():
    """Arrays that are let go between others that stay leave the process, and so do the powers of a long text."""
    blocks = [np.ones(12_000) for _ in range(2_000)]  # 96 KB each: of the heap, not mapped one by one
    stay = blocks[::10]
    full = _mb()
    del blocks
    text = np.full(1 << 21, 97, np.uint8)
    words.word_hashes(text, np.array([0]), np.array([len(text)]))
    forget_caches()
    assert len(stay) == 200 and not words._POWERS
    assert _mb() < full - 100


def test_powers_come_again():
    """Hashes are the same after caches are forgotten."""
    text = np.frombuffer(b"one two three", np.uint8)
    at = np.array([0, 4, 8]), np.array([3, 7, 13])
    before = words.word_hashes(text, *at)
    forget_caches()
    assert (words.word_hashes(text, *at) == before).all()
