"""Recoding of tab-separated files."""

import tracemalloc

import pyarrow as pa
import pytest

from textbayes.sources import tables


def test_gb18030_holds_a_block_only():
    column = pa.array(["数字，" * 50_000, None] * 100)
    tracemalloc.start()
    try:
        coded = tables._encoded.func(column)
        back = tables._decoded.func(coded)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert back == column and peak < column.nbytes / 4
    with pytest.raises(UnicodeDecodeError):
        tables._decoded.func(pa.array(["ok", "\xff"]))
