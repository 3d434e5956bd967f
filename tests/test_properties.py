"""Property tests of the per-pair helpers (hypothesis)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from textdrift.functions.alignment import lcs_length, meteor_pair, prf
from textdrift.functions.porter import stem

words = st.lists(st.sampled_from(["a", "b", "cat", "cats", "run", "running", "the"]), max_size=25)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_lcs_symmetric_and_bounded(a, b):
    n = lcs_length(a, b)
    assert n == lcs_length(b, a)
    assert 0 <= n <= min(len(a), len(b))
    assert lcs_length(a, a) == len(a)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_meteor_in_unit_interval(a, b):
    s = meteor_pair(a, b)
    assert 0.0 <= s <= 1.0
    if a:
        # identical texts: all words match in one chunk
        assert abs(meteor_pair(a, a) - (1 - 0.5 * (1 / len(a)) ** 3)) < 1e-12


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 30), st.integers(0, 30), st.integers(0, 30))
def test_prf_bounds(o, n1, n2):
    o = min(o, n1, n2)
    p, r, f = prf(o, n1, n2)
    assert 0 <= p <= 1 and 0 <= r <= 1 and min(p, r) - 1e-12 <= f <= max(p, r) + 1e-12


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz", min_size=1, max_size=15))
def test_stem_never_longer(w):
    s = stem(w)
    assert len(s) <= len(w) + 1 and s  # step 1b may add an 'e'; never empty
