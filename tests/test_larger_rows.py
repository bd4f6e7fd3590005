"""Steps whose work grew faster than their rows: results against plain versions, and the shape that keeps them small."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from claimloom import registry
from claimloom.operators import components, search
from claimloom.sources import files

FLAT = "page int, block int, paragraph int, word int, position int, text string, brk string, x0 int, y0 int, x1 int, y1 int"


def plain_lines(symbols):
    out, line = {}, {}
    for page, block, paragraph, word, position, text, brk, x0, y0, x1, y1 in sorted(symbols, key=lambda s: s[:5]):
        at = line.setdefault(page, 0)
        shown = text + (" " if brk in ("SPACE", "SURE_SPACE") else "")
        t, a, b, c, e = out.get((page, at), ("", x0, y0, x1, y1))
        out[page, at] = (t + shown, min(a, x0), min(b, y0), max(c, x1), max(e, y1))
        line[page] += brk in ("LINE_BREAK", "EOL_SURE_SPACE")
    return out


def test_lines_of_words_with_breaks_inside(spark):
    draw = random.Random(3)
    symbols = [
        (page, block, paragraph, word, k, draw.choice("abcé日"), draw.choice([None, None, "SPACE", "SURE_SPACE", "LINE_BREAK", "EOL_SURE_SPACE", "HYPHEN"]), *(draw.randrange(99) for _ in range(4)))
        for page in range(3) for block in range(2) for paragraph in range(2) for word in range(4) for k in range(draw.randrange(6))
    ]
    got = files.visual_lines(spark.createDataFrame(symbols, FLAT).orderBy(F.rand(1))).collect()
    assert {(r.page, r.line): (r.text, r.x0, r.y0, r.x1, r.y1) for r in got} == plain_lines(symbols)


def test_symbols_of_a_text_are_no_rows(spark):
    plan = registry.QUERIES["s12_visual_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 2 and "explode(split(value" not in plan


def test_kinds_of_forms_are_scored_once(monkeypatch):
    """Many items with few names and equal vectors: ties go to the smaller ids, a lexical score is taken once for two names."""
    calls = []
    plain = search.lexical
    monkeypatch.setattr(search, "lexical", lambda one, i, two, j, least=-1.0: calls.append((i, j)) or plain(one, i, two, j, least))
    monkeypatch.setattr(search, "TILE", 64)
    monkeypatch.setattr(search, "TURN", 1000)
    vectors = [np.eye(4)[k % 4] for k in range(300)]
    rows = search.Forms(pd.DataFrame({"i": range(300), "form": [("red bolt", "blue bolt", "ring")[k % 3] for k in range(300)], "v": vectors, "denied": [None] * 300}))
    found, _ = search.best_pairs_of(rows, rows, 40, -2.0, True)
    want = sorted((a, b) for a in range(300) for b in range(a + 1, 300) if a % 12 == b % 12)[:40]
    assert found == [(1.0, a, b) for a, b in want] and len(calls) == len(set(calls)) <= 9


def test_tasks_join_up_edges_and_components_take_few_rounds(spark, monkeypatch):
    """A path of 400 nodes, cycles and a hub, in small pieces: the same components, and a whole path in one task is a star at once."""
    rows = [(f"p{k:03}", f"p{k + 1:03}") for k in range(400)] + [(f"c{k}", f"c{k // 8 * 8 + (k + 1) % 8}") for k in range(64)] + [("hub", f"h{k}") for k in range(90)] + [("one", "one"), (None, "two")]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "src string, dst string")
    want = {n: "p000" for r in rows for n in r if n and n[0] == "p"} | {f"c{k}": min(f"c{x}" for x in range(k // 8 * 8, k // 8 * 8 + 8)) for k in range(64)}
    want |= {f"h{k}": "h0" for k in range(90)} | {"hub": "h0", "one": "one", "two": "two"}
    for most in (7, 1 << 19):
        monkeypatch.setattr(components, "AT_ONCE", most)
        assert {r.node: r.component for r in components.connected_components(frame).collect()} == want
    written = []
    plain = components.settled
    monkeypatch.setattr(components, "settled", lambda *a: written.append(1) or plain(*a))
    components.connected_components(frame.where("src like 'p%'").repartition(1)).count()
    assert len(written) <= 4


def test_whole_texts_reach_python_in_short_runs(spark):
    for name in ("x13_located", "x14_best_span"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
