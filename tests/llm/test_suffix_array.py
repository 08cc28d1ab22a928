import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skerry.llm.suffix_array import big_words, common_prefixes, two_stage


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab\x01", max_size=30), min_size=1, max_size=6))
def test_order_and_common_prefixes(strings):
    text = np.frombuffer(b"\0".join([*(s.encode() for s in strings), b""]), np.uint8)
    depth = 12
    words = big_words(text, depth)
    order = two_stage(text, depth, words)
    assert sorted(order.tolist()) == list(range(len(text)))
    raw = text.tobytes()
    upto = [raw[i : raw.index(0, i)][:depth] for i in order]
    assert upto == sorted(upto)
    shared = common_prefixes(order, words, depth)
    for k in range(1, len(order)):
        a, b = (raw[i : i + depth] + bytes(depth) for i in (order[k - 1], order[k]))
        same = next((j for j in range(depth) if a[j] != b[j]), depth)
        assert shared[k] == same


@pytest.mark.parametrize("text", [b"", b"\0", b"\0\0\0", b"a" * 500 + b"\0"])
def test_small_and_plain(text):
    order = two_stage(np.frombuffer(text, np.uint8), 50)
    assert sorted(order.tolist()) == list(range(len(text)))
