"""Plain restatements that tests hold native operators against."""

from veristrand.constants import CHAR_CAP, FRAGMENT_CHARS_EXTRA, OVERLAP, WINDOW


def windows(sizes, window=WINDOW, overlap=OVERLAP, char_cap=CHAR_CAP):
    """Ranges of fragments of these lengths. A window takes its first fragment whatever its length."""
    first, total = 0, len(sizes)
    while first < total:
        room, last = char_cap - sizes[first] - FRAGMENT_CHARS_EXTRA, first
        while last + 1 < total and last + 1 - first < window and sizes[last + 1] + FRAGMENT_CHARS_EXTRA <= room:
            last += 1
            room -= sizes[last] + FRAGMENT_CHARS_EXTRA
        yield first, last
        if last + 1 == total:
            return
        first = max(first + 1, last + 1 - min(overlap, last - first))


def coverage(n):
    """Positions of n items in coverage order: ends of the range, its middle, then both inner ranges, level by level."""
    if n < 3:
        return tuple(range(n))
    out = {}
    level = [(0, n - 1)]
    while level:
        inner = []
        for low, high in level:
            mid = (low + high) // 2
            out.update(dict.fromkeys((low, high, mid)))
            inner += [(a, b) for a, b in ((low + 1, mid - 1), (mid + 1, high - 1)) if a <= b]
        level = inner
    return tuple(out)
