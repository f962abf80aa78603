"""Plain versions of edit similarity over all pairs of lines."""

import re

import numpy as np

from .test_near_copies import groups_of


def distance_within(x: str, y: str, most: int) -> bool:
    """Whether the edit distance is `most` or less, by bit vectors over one text."""
    if not x or not y:
        return max(len(x), len(y)) <= most
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    mask, top = (1 << len(x)) - 1, 1 << len(x) - 1
    up, down, score = mask, 0, len(x)
    for c in y:
        eq = places.get(c, 0)
        xv = eq | down
        xh = ((eq & up) + up ^ up) | eq
        ph, mh = (down | ~(xh | up)) & mask, up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & mask, mh << 1 & mask
        up, down = (mh | ~(xv | ph)) & mask, ph & xv
    return score <= most


def line_groups(rows, min_words=5, min_chars=20):
    """{(doc, line): stays} over rows (doc, text), by edit similarity of 0.8 of all pairs of distinct lines, and the links."""
    seen: dict[str, set] = {}
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            words = [w for w in re.split("[\\x20\\x09-\\x0D]+", line.lower()) if w]
            if words:
                seen.setdefault(" ".join(words), set()).add((doc, n))
    wide = sorted((t for t in seen if len(t.split(" ")) >= min_words or len(t) >= min_chars), key=len)
    # One edit changes three trigrams at most, so near copies share 0.4 of them; buckets can only add to what is shared.
    counts = np.zeros((len(wide), 2048), np.uint8)
    for i, t in enumerate(wide):
        np.add.at(counts[i], [hash(t[k : k + 3]) % 2048 for k in range(len(t) - 2)], 1)
    size = np.array([len(t) for t in wide])
    links = []
    for i, t in enumerate(wide):
        other = np.arange(i + 1, int(np.searchsorted(size, int(len(t) / 0.8 + 1e-9), "right")))
        if len(t) < 200 * 255:
            shared = np.minimum(counts[other], counts[i]).sum(1, dtype=np.int64)
            other = other[shared >= 0.4 * size[other] - 3]
        links += [(t, wide[j]) for j in other.tolist() if distance_within(t, wide[j], int(0.2 * len(wide[j]) + 1e-9))]
    group = groups_of(links, seen)
    first: dict = {}
    for t, places in seen.items():
        first[group[t]] = min(first.get(group[t], min(places)), min(places))
    return {place: first[group[t]] == place for t, places in seen.items() for place in places}, links
