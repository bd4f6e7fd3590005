"""Pages, cursors and requests as tables against the request's own checks."""

import pytest

from claimloom.model import view
from claimloom.operators import facets, roundtrips

TABLES = "/root/testdata/sf0.001"


def test_every_page_has_the_cursor_that_leads_to_it(spark):
    claims, spec = view(spark, TABLES, "claims"), facets.FilterSpec(relation=("1-URGENT",))
    pages = {}
    for r in roundtrips.request_pages(claims, spec, 40).collect():
        pages.setdefault((r.fetch, r.cursor), set()).add(r.claim_id)
    cursor, seen = None, 0
    for fetch, told in sorted(pages, key=lambda p: p[0]):
        assert told == cursor and (told is None or facets.decode_cursor(spec, told) == 40 * fetch)
        rows, cursor = facets.triples_page(claims, spec, 40, told)
        assert {r.claim_id for r in rows} == pages[fetch, told]
        seen += len(rows)
    assert cursor is None and len(pages) > 3 and seen == claims.where(spec.columns()).count()


@pytest.mark.parametrize("request_", [{}, {"volume": ["vol9"]}, {"volume": ["vol1", "vol2"], "page_start": 3}, {"volume": ["vol1"], "page_start": 5, "page_end": 4}, {"volume": ["vol2"], "page_start": 4, "page_end": 4}, {"subject": [f"n{k}" for k in range(101)]}, {"subject": ["x" * 301], "volume": ["vol9"]}, {"page_end": 2}])
def test_a_row_is_refused_as_the_request_is(spark, request_):
    row = (request_.get("volume", []), request_.get("page_start"), request_.get("page_end"), request_.get("subject", []))
    frame = spark.createDataFrame([row], "v array<string>, a int, b int, s array<string>")
    problem = frame.select(roundtrips.request_problem(frame.v, frame.a, frame.b, frame.s)).first()[0]
    try:
        facets.FilterSpec.parse(request_)
        assert problem is None
    except ValueError as refused:
        assert problem is not None and problem in str(refused)
