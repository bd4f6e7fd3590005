"""Overlaps by bisection, and very long texts of findings in op5 and op9."""

import random
import time

from claimloom.llm import privacy, secrets
from claimloom.llm.text import Taken


def test_overlaps_are_those_of_the_plain_test():
    rng = random.Random(1)
    for _ in range(200):
        spans = [("x", a, a + rng.randrange(1, 12)) for a in (rng.randrange(60) for _ in range(rng.randrange(8)))]
        taken = Taken(spans)
        for a in range(65):
            for b in range(a + 1, a + 9):
                assert taken(a, b) == any(a < e and s < b for _, s, e in spans)


def test_a_million_characters_of_findings_take_seconds():
    net, tagger = secrets.trained(), privacy.trained()
    text = " ".join(f"token=abcd{k:06d}xyz" for k in range(45_000))
    begin = time.process_time()
    base, every = secrets.found_spans([text], net)[0]
    assert len(base) == 45_000 and len(every) >= 45_000
    mails = " ".join(f"write to name{k}@host.org or" for k in range(20_000))
    base, every = privacy.found_spans([mails], tagger)[0]
    assert len(base) == 20_000 and len(every) >= 20_000
    assert time.process_time() - begin < 240
