"""Myers' bit-parallel edit distance over any sequences; Python integers serve as bit vectors of any width."""

from __future__ import annotations


def masks(pattern) -> dict:
    """For each symbol the bits of its positions in ``pattern``."""
    out: dict = {}
    for i, symbol in enumerate(pattern):
        out[symbol] = out.get(symbol, 0) | 1 << i
    return out


def search(peq: dict, m: int, text) -> tuple[int, int]:
    """The least edit distance of the pattern to a substring of ``text``, and where the first such substring ends (exclusive)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    get = peq.get
    for at, symbol in enumerate(text, 1):
        eq = get(symbol, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, at
    return best, end


def distance(a, b) -> int:
    """The edit distance of two whole sequences."""
    m = len(a)
    if not m or not len(b):
        return max(m, len(b))
    full, top = (1 << m) - 1, 1 << (m - 1)
    get = masks(a).get
    pv, mv, score = full, 0, m
    for symbol in b:
        eq = get(symbol, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return score
