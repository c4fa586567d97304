"""Indel similarity of strings, 0 to 100: twice the longest common subsequence
over the summed lengths, and its token forms."""

from __future__ import annotations


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of: what both share against each whole, and whole against whole."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    wholes = [" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x)]
    scores = [ratio(*wholes)]
    if both:
        scores += [ratio(both, whole) for whole in wholes]
    return max(scores)
