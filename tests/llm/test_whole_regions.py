"""Regions of the personal data model against the recursion over the whole text."""

import random

from scriptorium.llm import personal_data
from scriptorium.llm.personal_data import Region


def test_regions_lose_no_candidate():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    model = personal_data.default_model()
    for n in range(60):
        far = " ".join(word() for _ in range(rng.randint(40, 90)))
        text = f"{far} {word()}.{word()} @ {word()}.{word()}.com {far}, mail {word()}.{n} @ {word()}.org\n{far}"
        whole = Region(text, 0, len(text))
        spans = lambda r: {(r.spots[i][0], r.spots[j][1]) for j, row in enumerate(r.candidates) for i, _ in row}
        chosen = lambda r: {(r.spots[i][0], r.spots[j][1], t) for i, j, t in model.best(r)}
        parts = [Region(text, a, b) for a, b in personal_data.regions(text)]
        assert set().union(*map(spans, parts)) == spans(whole)
        assert set().union(*map(chosen, parts)) == chosen(whole)
