"""Merge-dropout is drawn for every occurrence."""

import numpy as np

from scriptorium.llm import piece_codec


def test_every_occurrence_draws():
    c = piece_codec.codec(piece_codec.default_model())
    words = ["information ", "there ", "something "]
    for word in words:
        text = (word * 3000).encode()
        ids, offset = c.encode([text], np.array([3]), 0.1, 7)
        assert c.decode(ids, offset) == [text]
        plain, _ = c.encode([text], np.array([3]))
        assert len(ids) > len(plain)
    found = set()
    for n in range(400):
        ids, _ = c.encode([b"information"], np.array([n]), 0.1, 7)
        found.add(ids.tobytes())
    assert len(found) > 8


def test_shared_plain_segmentations_change_nothing():
    """Sharing the plain segmentation gives what merging every occurrence by itself gives."""
    c = piece_codec.codec(piece_codec.default_model())
    texts = [b"the information of something there and the information", "\u00fcber die  Stra\u00dfe \u4e2d\u6587 the the".encode(), b""] * 40
    seen = []
    own = c.segment

    def spy(data, offset, salt, dropout, *rest):
        if dropout:
            seen.append(len(offset) - 1)
        return own(data, offset, salt, dropout, *rest)

    keys = np.arange(len(texts))
    c.segment = spy
    try:
        ids, offset = c.encode(texts, keys, 0.1, 5)
        chunks = sum(seen)
        alone = [c.encode([t], keys[k : k + 1], 0.1, 5)[0] for k, t in enumerate(texts)]
    finally:
        del c.segment
    assert np.array_equal(ids, np.concatenate(alone)) and chunks > 0
    assert [x for x in c.decode(ids, offset)] == texts
