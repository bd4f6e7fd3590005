"""Request checks and cursors, file scans and sinks, and the streaming twins."""

import gzip
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.model import view
from claimloom.operators import facets, pages
from claimloom.sources import files
from claimloom.streaming import windows

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bad", [{"x": "1"}, {"volume": "vol9"}, {"page_start": 3}, {"volume": "vol1", "page_start": 9, "page_end": 2}, {"subject": [f"n{k}" for k in range(101)]}, {"subject": "n" * 301}])
def test_requests_are_checked_first(bad):
    with pytest.raises(ValueError):
        facets.FilterSpec.parse(bad)


def test_values_merge_in_order():
    assert facets.FilterSpec.parse({"subject": ["b,a", "a", "c"]}).subject == ("b", "a", "c")
    assert facets.check_id("e_" + "0" * 32, "entity") and facets.check_id("vol1_s000001", "sentence")
    with pytest.raises(ValueError):
        facets.check_id("e_x'; DROP", "entity")


def test_pages_join_up_without_repeats(spark):
    claims, spec, seen, cursor = view(spark, TABLES, "claims"), facets.FilterSpec(volume=("vol1",), relation=("1-URGENT",)), [], None
    while True:
        rows, cursor = facets.triples_page(claims, spec, 40, cursor)
        seen += [r.claim_id for r in rows]
        if cursor is None:
            break
    assert len(seen) == len(set(seen)) == claims.where(spec.columns()).count()
    with pytest.raises(ValueError, match="invalid_cursor"):
        facets.triples_page(claims, facets.FilterSpec(), 40, facets.encode_cursor(spec, 40))


def test_own_role_is_never_narrowed(spark):
    claims = view(spark, TABLES, "claims")
    narrow, wide = facets.FilterSpec(s_cat=("E1",), relation=("5-LOW",)), facets.FilterSpec(s_cat=("E1",))
    assert facets.filtered_tags(claims, narrow, "relation").collect() == facets.filtered_tags(claims, wide, "relation").collect()


def test_scans(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, f"{p}/a.jsonl", "a int").collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a"\n')
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, f"{p}/bad.jsonl", "a int").collect()
    (tmp_path / "vol1").mkdir()
    (tmp_path / "vol1" / "0047.json").write_text('{\n "m": {"s1": {"t": "x"}, "s2": {"t": "y"}}\n}')
    got = files.map_rows(files.with_page(files.read_json_documents(spark, f"{p}/vol1", "m map<string, struct<t string>>")), "m")
    assert sorted((r.volume_id, r.page, r.sid, r.t) for r in got.collect()) == [("vol1", 47, "s1", "x"), ("vol1", 47, "s2", "y")]
    (tmp_path / "t.csv").write_text("id,n\n1,5\n2,6\n")
    assert files.read_csv_strict(spark, f"{p}/t.csv", "id int, n int", ["id"]).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        files.read_csv_strict(spark, f"{p}/t.csv", "id int, other int").collect()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/x.jsonl", "one\n\ntwo\n")
        z.writestr("d/y.txt", "no\n")
    assert [(r.member, r.line) for r in files.read_zip_members(spark, f"{p}/z.zip").collect()] == [("d/x.jsonl", "one"), ("d/x.jsonl", "two")]
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert {r["index"]: r.embedding for r in files.read_matrix(spark, f"{p}/m.npy").collect()}[2] == [4.0, 5.0]
    with gzip.open(tmp_path / "v.vec.gz", "wt") as f:
        f.write("2 3\nking 1 2 3\ncity 4 5 6\n")
    got = files.read_word_vectors(spark, f"{p}/v.vec.gz", spark.createDataFrame([("city",)], "token string")).collect()
    assert [(r.token, r.embedding) for r in got] == [("city", [4.0, 5.0, 6.0])]
    (tmp_path / "n.md").write_text("# x\n- **91.5%** — a b ↔ c\n- **E01 Label**: some text\n| h | k |\n|---|---|\n| 1 | 2 |\n")
    got = files.scan_markdown(spark.read.text(f"{p}/n.md")).collect()
    assert [(r.kind, r.fields) for r in got] == [("pair", ["91.5", "a b", "c"]), ("term", ["E01", "Label", "some text"]), ("cells", ["h", "k"]), ("cells", ["1", "2"])]


def test_sheet_source(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>flag</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="B2" t="b"><v>1</v></c></row><row><c r="B3"><v>2.5</v></c></row></sheetData></worksheet>')
    spark.dataSource.register(files.SheetSource)
    got = spark.read.format("sheet").option("path", str(tmp_path / "b.xlsx")).load().collect()
    assert sorted(map(tuple, got), key=str) == sorted([("x", "true"), (None, "2.5")], key=str)


def test_marked_volume_and_lines(spark):
    text = "[[BOOK=v PAGE=0001]]one[[BOOK=v PAGE=0002]]Index of names[[BOOK=v PAGE=0003]]after"
    got = files.split_marked_volume(spark.createDataFrame([(text,)], "value string")).orderBy("page").collect()
    assert [(r.page, r.body, r.back_matter) for r in got] == [(1, "one", False), (2, "Index of names", True), (3, "after", True)]
    symbols = [(1, 0, 0, 0, 0, "a", None, 0, 0, 1, 1), (1, 0, 0, 0, 1, "b", "SPACE", 1, 0, 2, 1), (1, 0, 0, 1, 0, "c", "LINE_BREAK", 2, 0, 3, 2), (1, 0, 0, 2, 0, "d", None, 0, 3, 1, 4)]
    frame = spark.createDataFrame(symbols, "page int, block int, paragraph int, word int, position int, text string, brk string, x0 int, y0 int, x1 int, y1 int")
    assert [(r.text, r.x0, r.y1) for r in files.visual_lines(frame).orderBy("line").collect()] == [("ab c", 0, 2), ("d", 0, 4)]


def test_sinks(spark, tmp_path):
    p, frame = str(tmp_path), spark.createDataFrame([(1, 'a"b'), (2, None)], "id int, t string")
    files.write_staged(frame, f"{p}/out", lambda x: None)
    assert spark.read.parquet(f"{p}/out").count() == 2
    with pytest.raises(FileExistsError):
        files.write_staged(frame, f"{p}/out")

    def refuse(_):
        raise ValueError("no")

    with pytest.raises(ValueError):
        files.write_staged(frame, f"{p}/other", refuse)
    assert not [x for x in tmp_path.iterdir() if "other" in x.name]
    assert [r.value for r in files.quads(frame, "g", "id", {"t": "label"}).collect()] == ['<urn:claim:1> <urn:claim:label> "a\\"b" <urn:claim:g> .']
    one = files.artifact(frame.orderBy("id"))
    assert one == files.artifact(frame.orderBy("id")) and gzip.decompress(one["gzip"]) == one["plain"]
    files.write_csv(frame, f"{p}/c", ["t", "id"], gzipped=True)
    assert spark.read.option("header", True).csv(f"{p}/c").columns == ["t", "id"]
    (tmp_path / "x.bin").write_bytes(b"1")
    before = spark.createDataFrame(files.manifest(spark, [f"{p}/x.bin"]).collect())
    files.check_manifest(before, files.manifest(spark, [f"{p}/x.bin"]))
    (tmp_path / "x.bin").write_bytes(b"2")
    with pytest.raises(ValueError):
        files.check_manifest(before, files.manifest(spark, [f"{p}/x.bin"]))


def test_patches_report_failed_expectations(spark):
    lines = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "doc int, line int, value string")
    patches = spark.createDataFrame([(1, 0, "a", "A"), (1, 1, "b", None), (1, 2, "x", "y")], "doc int, line int, expected string, replacement string")
    done, bad = pages.applied_patches(lines, patches, "doc")
    assert [r.value for r in done.orderBy("line").collect()] == ["A", "c"] and [r.line for r in bad.collect()] == [2]


def stream_of(spark, tmp_path):
    rows = spark.read.parquet(f"{TABLES}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    return rows, windows.read_events(spark, str(tmp_path / "in"))


def test_streamed_windows_equal_batch(spark, tmp_path):
    rows, stream = stream_of(spark, tmp_path)
    windows.run_to_table(windows.windowed_counts(stream, "1 hour", "30 minutes", "10 minutes"), "slid", str(tmp_path / "ck"), "complete").awaitTermination(60)
    want = windows.windowed_counts(rows, "1 hour", "30 minutes").select("start", "event_type", "n")
    got = spark.table("slid").select("start", "event_type", "n")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_streamed_sessions_are_among_batch(spark, tmp_path):
    rows, stream = stream_of(spark, tmp_path)
    windows.run_to_table(windows.sessions(stream, "2 hours", "1 hour"), "sess", str(tmp_path / "ck")).awaitTermination(60)
    got = spark.table("sess")
    assert got.count() > 0 and got.exceptAll(windows.sessions(rows, "2 hours")).count() == 0


def test_limiter_rejects_and_recovers(spark, tmp_path):
    times = ["00:00:00", "00:00:10", "00:00:20", "00:00:59", "00:01:01", "00:01:05"]
    rows = spark.createDataFrame([(7, k, f"2024-01-01 {t}") for k, t in enumerate(times)], "user_id long, event_id long, t string").select("user_id", "event_id", F.to_timestamp("t").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    limited = windows.limit_requests(windows.read_events(spark, str(tmp_path / "in")), 3, 60)
    windows.run_to_table(limited, "lim", str(tmp_path / "ck")).awaitTermination(60)
    got = {r.event_id: (r.allowed, r.remaining) for r in spark.table("lim").collect()}
    assert got == {0: (True, 2), 1: (True, 1), 2: (True, 0), 3: (False, 0), 4: (True, 0), 5: (False, 0)}


def test_replayed_batch_replaces_itself(spark, tmp_path):
    write = windows.idempotent_sink(str(tmp_path / "out"))
    for _ in range(2):
        write(spark.range(5), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_terminal_state_is_never_left(spark):
    rows = [(1, "RUNNING", 1), (1, "SUCCEEDED", 2), (1, "RUNNING", 3), (2, "RUNNING", 1)]
    frame = spark.createDataFrame(rows, "job int, state string, s int").withColumn("at", F.timestamp_seconds("s"))
    assert {r.job: r.state for r in windows.job_states(frame, "job", "state", "at").collect()} == {1: "SUCCEEDED", 2: "RUNNING"}
