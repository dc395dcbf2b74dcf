from hypothesis import given, settings
from hypothesis import strategies as st

from privlake.llm.suffix_array import suffix_array
from privlake.llm.suffix_dedup import CELL, repeated_starts


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_order(symbols):
    s = [*symbols, 0]
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=12, max_size=40), st.integers(0, 12), st.integers(1, 2)), min_size=1, max_size=6))
def test_repeated_starts(contexts):
    """Windows count as equal if their bytes and their distances to the anchor's cell agree, as equal windows of one anchor do."""
    size, rows = 12, [(t.encode(), left, n) for t, left, n in contexts]
    got = repeated_starts(rows, size)
    seen = {}
    for raw, left, n in rows:
        for p in range(len(raw) - size + 1):
            key = ((p - left) % CELL, raw[p : p + size])
            seen[key] = seen.get(key, 0) + n
    for (raw, left, _), mask in zip(rows, got, strict=True):
        assert [bool(m) for m in mask] == [seen[(p - left) % CELL, raw[p : p + size]] > 1 for p in range(len(raw) - size + 1)]
