"""Variable-length integers: inverse of each other, and a plain loop's bytes."""

import numpy as np
import pytest
from hypothesis import given, strategies as st

from prismlake.functions import varints


def plain(v: int) -> bytes:
    out = bytearray()
    while True:
        v, low = v >> 7, v & 127
        out.append(low | (128 if v else 0))
        if not v:
            return bytes(out)


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**63 - 1))))
def test_bytes_equal_a_loop_and_come_back(values):
    data, n = varints.encode(np.array(values, np.int64))
    assert data.tobytes() == b"".join(map(plain, values))
    assert n.tolist() == [len(plain(v)) for v in values]
    assert varints.decode(data).tolist() == values
    assert varints.decode(data[:-1]).tolist() == values[: max(len(values) - 1, 0)]


@given(st.lists(st.integers(-(2**61), 2**61)))
def test_signs_come_back(values):
    z = varints.zigzag(np.array(values, np.int64))
    assert (z >= 0).all()
    assert varints.unzigzag(z).tolist() == values


def test_overlong_values_are_refused():
    with pytest.raises(ValueError):
        varints.decode(np.array([255] * 10 + [1], np.uint8))
