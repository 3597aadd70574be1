import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from tarnfield.llm import pii
from tarnfield.llm.common import slices


def held():
    """MB that this process holds."""
    return int(re.search(r"\nRssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_what_a_part_took_is_given_back():
    parts = slices(pa.RecordBatch.from_arrays([pa.array(["ab", "cd"])], ["text"]), 0, 1)
    next(parts)
    blocks = [np.ones(8000) for _ in range(3000)]
    pins = blocks[::50]  # what stays keeps the C library from returning what lies between
    del blocks
    before = held()
    next(parts)
    assert len(pins) == 60 and held() < before - 100


def test_word_counts_do_not_depend_on_the_parts(monkeypatch):
    texts = ["one two two", "two three", None, "", "one"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([1, 1, 1, 1, 2], pa.int64())], ["text", "times"])
    every = np.full(pii.FILTER // 8, 255, np.uint8)
    for most in (pii.COUNTED_BYTES, 1):
        monkeypatch.setattr(pii, "COUNTED_BYTES", most)
        (counts,) = pii._document_counts(every)(iter([batch]))
        assert dict(zip(*(c.to_pylist() for c in counts.columns))) == {"one": 3, "two": 2, "three": 1}
