"""License templates across line ends, and longer than a default block."""

from __future__ import annotations

import math
import random
import textwrap

import pytest

from heliograde.llm import licenses


def plain_labels(text, templates, span):
    """Labels by a count in every stretch of ``span`` words."""
    words = text.split()
    out = set()
    for at in range(max(1, len(words) - span + 1)):
        held = set(words[at : at + span])
        out |= {lab for lab, t in templates if len(held & set(t.split())) >= math.ceil(0.9 * len(set(t.split())) - 1e-9)}
    return out


def labels(text, templates=licenses.TEMPLATES):
    return set(licenses.scan(text, licenses.Index(templates, {}), {})[5].split(",")) - {""}


@pytest.mark.parametrize("width", [20, 40, 76])
def test_wrapped_notices(width):
    for label, t in licenses.TEMPLATES:
        assert label in labels("\n".join(textwrap.wrap("some words before " + t + " and after", width)))


def test_long_templates_against_a_sliding_count():
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(400)]
    templates = [(f"t{n}", " ".join(rng.sample(vocab, n))) for n in (5, 34, 50, 64, 65, 90, 150)]
    for _ in range(60):
        words = [f"x{rng.randrange(50)}" for _ in range(rng.randrange(300))]
        for _, t in rng.sample(templates, 2):
            own = t.split()
            for _ in range(rng.randrange(len(own) // 8 + 1)):
                own[rng.randrange(len(own))] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        text = "".join(w + rng.choice([" ", "\n"]) for w in words)
        assert plain_labels(text, templates, 150) <= labels(text, templates) <= plain_labels(text, templates, 300)
