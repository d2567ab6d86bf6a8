"""What leads the matcher from a piece to its item."""

import random

import pytest

from lexquarry.llm import decontaminate
from tests.llm.test_operators import semi_global

ITEM = "it was a bright cold day in april and the clocks were striking thirteen while winston smith slipped quickly through the glass doors of victory mansions"


def test_a_piece_alone_does_not_lead_to_its_item(monkeypatch):
    matcher = decontaminate.Matcher([(1, ITEM)])
    whole, distances = [], matcher.distances
    monkeypatch.setattr(matcher, "distances", lambda words, part, *rest: whole.extend(part if words > 1 else []) or distances(words, part, *rest))  # a run has one word
    cuts = [len(ITEM) * j // 16 for j in range(17)]
    alone = [f"qqqqqqqqqqqqqqqqqqqqqqqqqqqq{ITEM[a:b]}zzzzzzzzzzzzzzzzzzzzzzzzzzzzzz" for a, b in zip(cuts, cuts[1:])]
    assert matcher.find(alone) == [] and not whole
    assert [x[:3] for x in matcher.find([*alone, ITEM.replace("bright", "brigth")])] == [(16, 0, 2)] and whole


@pytest.mark.parametrize("rate", [0.02, 0.1, 0.2])
def test_as_many_edits_as_the_budget(rate):
    """Edits in every run, up to and past the budget, at the beginning and the end of a text too."""
    rng, matcher = random.Random(3), decontaminate.Matcher([(1, ITEM), (2, ITEM[:23]), (3, ITEM[40:110])], rate)
    texts = []
    for _ in range(60):
        _, text = rng.choice(matcher.items)
        s, edits = list(text), rng.randint(0, int(len(text) * rate) + 1)
        for j in range(edits):  # spread evenly, so that no run is without
            at, kind = min(len(s) - 1, (2 * j + 1) * len(s) // (2 * edits)), rng.random()
            s[at : at + (kind < 0.6)] = [] if 0.3 < kind < 0.6 else ["x"]
        texts.append(rng.choice(["", "ab "]) + "".join(s) + rng.choice(["", " ba"]))
    want = {(k, a): d for k, t in enumerate(texts) for a, (_, y) in enumerate(matcher.items) if (d := semi_global(y, t)) <= matcher.budget[a]}
    assert {(k, a): d for k, a, d, _ in matcher.find(texts)} == want and want
