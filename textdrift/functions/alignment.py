"""Per-pair sequence helpers: LCS length (ROUGE-L) and METEOR.

Small pure-Python helpers, called from Arrow-batched pandas UDFs on one
(generated, reference) token pair at a time.  Both work on whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from textdrift.functions.porter import stem as porter_stem


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, bit-parallel.

    Each token of ``a`` updates a bit vector over the positions of ``b``
    (Hyyro's formulation of the Allison-Dix algorithm); Python integers act
    as arbitrary-width machine words, so the cost is O(|a| * |b| / 64).
    """
    if not len(a) or not len(b):
        return 0
    masks: dict = {}
    for j, t in enumerate(b):
        masks[t] = masks.get(t, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for t in a:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


def prf(overlap: float, n_pred: int, n_ref: int) -> tuple[float, float, float]:
    """Precision, recall and F1 (zero when either side is empty)."""
    if n_pred <= 0 or n_ref <= 0:
        return 0.0, 0.0, 0.0
    p, r = overlap / n_pred, overlap / n_ref
    f = 0.0 if p + r == 0 else 2 * p * r / (p + r)
    return p, r, f


def _match_stage(hyp: list, ref: list, key: Callable[[str], str]):
    """Match remaining (index, word) items: from the last hypothesis word
    backwards, each takes the last unmatched reference word with the same
    key.  Returns (matches, hyp_left, ref_left)."""
    stacks: dict = {}
    for pos, (j, w) in enumerate(ref):
        stacks.setdefault(key(w), []).append(pos)
    used_ref = set()
    matches, hyp_left = [], []
    for i, w in reversed(hyp):
        st = stacks.get(key(w))
        if st:
            pos = st.pop()
            used_ref.add(pos)
            matches.append((i, ref[pos][0]))
        else:
            hyp_left.append((i, w))
    hyp_left.reverse()
    ref_left = [item for pos, item in enumerate(ref) if pos not in used_ref]
    return matches, hyp_left, ref_left


def count_chunks(matches: list) -> int:
    """Chunks of matches adjacent in both sequences (matches sorted by
    hypothesis position)."""
    if not matches:
        return 0
    chunks = 1
    for (h0, r0), (h1, r1) in zip(matches, matches[1:]):
        if not (h1 == h0 + 1 and r1 == r0 + 1):
            chunks += 1
    return chunks


def meteor_pair(hyp: Sequence[str], ref: Sequence[str], alpha: float = 0.9, beta: float = 3.0,
                gamma: float = 0.5, stemmer: Callable[[str], str] | None = porter_stem,
                synonyms: dict | None = None) -> float:
    """METEOR of one hypothesis against one reference (Banerjee & Lavie,
    2005): exact matches, then stem matches, then optional synonym classes
    (``synonyms`` maps a word to a class id); harmonic mean weighted by
    ``alpha`` and a fragmentation penalty ``gamma * (chunks/m) ** beta``."""
    h = list(enumerate(hyp))
    r = list(enumerate(ref))
    if not h or not r:
        return 0.0
    matches, h, r = _match_stage(h, r, lambda w: w)
    if stemmer is not None and h and r:
        more, h, r = _match_stage(h, r, stemmer)
        matches += more
    if synonyms and h and r:
        more, h, r = _match_stage(h, r, lambda w: synonyms.get(w, w))
        matches += more
    m = len(matches)
    if m == 0:
        return 0.0
    matches.sort()
    p, rc = m / len(hyp), m / len(ref)
    fmean = p * rc / (alpha * p + (1 - alpha) * rc)
    penalty = gamma * (count_chunks(matches) / m) ** beta
    return (1 - penalty) * fmean
