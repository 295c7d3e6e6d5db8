"""The extractor hook and its scores, captures of HTML, and record files."""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from casework.operators import captures, extractors
from casework.sources import files


# The hook --------------------------------------------------------------------------------------------
def test_extractor_contract():
    labels = frozenset({"a"})
    good = {"label": "a", "spans": [{"start": 0, "end": 1}, {"start": 1, "end": 3}], "provenance": {}}
    assert extractors.contract_problem(good, "abc", labels) is None
    for change, problem in (
        ({"extra": 1}, "fields"), ({"label": "b"}, "label_not_registered"), ({"spans": None}, "span_fields"), ({"spans": [{"start": 0}]}, "span_fields"), ({"spans": [{"start": False, "end": 1}]}, "span_fields"), ({"spans": [{"start": 1, "end": 1}]}, "span_outside_text"),
        ({"spans": [{"start": 0, "end": 4}]}, "span_outside_text"), ({"spans": [{"start": 1, "end": 3}, {"start": 0, "end": 1}]}, "spans_not_in_order"), ({"label": None}, "spans_without_label"), ({"provenance": []}, "provenance"),
    ):
        assert extractors.contract_problem(good | change, "abc", labels) == problem
    assert extractors.contract_problem(["a"], "abc", labels) == "fields"


def test_extractor_in_sql(spark):
    def find(unit):
        if unit["text"] == "boom":
            raise RuntimeError("no")
        at = unit["text"].find(unit["needle"])
        return {"label": "hit" if at >= 0 else None, "spans": [{"start": at, "end": at + len(unit["needle"])}] if at >= 0 else [], "provenance": {"n": 3, "none": None}}

    extractors.register_extractor(spark, "find_needle", find, ["hit"])
    spark.createDataFrame([("1", "a needle", "needle"), ("2", None, "x"), ("3", "boom", "x"), (None, "xx", "x")], "unit_id string, text string, needle string").createOrReplaceTempView("units_to_search")
    got = {r.unit_id: r for r in spark.sql("SELECT * FROM find_needle(TABLE(units_to_search))").collect()}
    assert [tuple(s) for s in got["1"].spans] == [(2, 8)] and got["1"].provenance == {"n": "3", "none": None} and got["1"].problem is None
    assert got["2"].label is None and got["3"].problem == "raised: RuntimeError" and got[None].label == "hit"
    with pytest.raises(Exception, match="unit_id and text"):
        spark.sql("SELECT * FROM find_needle(TABLE(SELECT 1 AS a))").collect()


def test_overlap_by_ends_equals_characters(spark):
    rnd = random.Random(2)

    def spans():
        cuts = sorted(rnd.sample(range(40), 2 * rnd.randint(0, 4)))
        return [{"start": a, "end": b} for a, b in zip(cuts[::2], cuts[1::2])]

    rows = [(i, spans(), spans()) for i in range(60)]
    table = spark.createDataFrame(rows, "i int, a array<struct<start int, end int>>, b array<struct<start int, end int>>")
    chars = lambda x: {c for s in x for c in range(s["start"], s["end"])}
    got = {r.i: r.share for r in table.select("i", extractors.overlap_share(F.col("a"), F.col("b")).alias("share")).collect()}
    for i, a, b in rows:
        either = chars(a) | chars(b)
        assert got[i] == (len(chars(a) & chars(b)) / len(either) if either else 1.0)
    flat = lambda c: table.select(F.col("i").alias("unit_id"), F.explode(c).alias("s")).select("unit_id", "s.start", "s.end")
    found = extractors.span_matches(flat("a"), flat("b")).collect()
    assert len({(r.unit_id, r.start) for r in found}) == len({(r.unit_id, r.p_start) for r in found}) == len(found)
    for i, a, b in rows:  # nothing that overlaps is left over on both sides
        mine = [r for r in found if r.unit_id == i]
        for x, y in itertools.product(a, b):
            if max(x["start"], y["start"]) < min(x["end"], y["end"]):
                assert any(r.start == x["start"] or r.p_start == y["start"] for r in mine)
        assert all(r.overlap == min(r.end, r.p_end) - max(r.start, r.p_start) > 0 for r in mine)


def test_report_counts(spark):
    spans = "array<struct<start int, end int>>"
    gold = spark.createDataFrame([("1", "a", [(0, 4)]), ("2", "b", [(0, 2)]), ("3", None, None), ("4", "a", [(1, 3)]), ("5", "a", [])], f"unit_id string, label string, spans {spans}")
    said = spark.createDataFrame([("1", "a", [(0, 3)], {"x": "1"}, None), ("2", "a", [(0, 2)], {"x": ""}, None), ("3", None, [], {}, None), ("4", None, None, None, "fields")], f"unit_id string, label string, spans {spans}, provenance map<string,string>, problem string")
    r = extractors.extractor_report(gold, said, ["x"], 0.75).first()
    assert (r.units, r.broken, r.tp, r.fp, r.fn, r.covered, r.all_exact_spans, r.exact_spans, r.overlapping, r.complete) == (5, 2, 1, 1, 3, 2, 3, 0, 1, 1)
    empty = extractors.extractor_report(gold.limit(0), said, [], None).first()
    assert empty.units == 0 and empty.coverage is None and empty.overlap_rate is None and empty.f1 == 0


# Captures --------------------------------------------------------------------------------------------
PAGE = """<html><div>out</div><div class="x correspondence_text">One &amp; two<br> three
  <div class="inner">foür</div> <!-- not <b>this</b> --> five</div></div><p>out</p><DIV CLASS='correspondence_text'>é six"""


def test_class_text_and_the_way_back():
    text, spans = captures.class_text(PAGE, "div", "correspondence_text")
    assert text == unicodedata.normalize("NFC", "One & two three foür five é six")
    assert [text[a:b] for a, b, _, _ in spans] == ["One & two", "three", "foür", "five", "é six"]
    assert [PAGE[c:d].strip() for _, _, c, d in spans] == ["One &amp; two", "three", "foür", "five", "é six"]
    assert captures.part_at(spans, 12) == spans[1][2:] and captures.part_at(spans, 9) is None
    assert captures.class_text("", "div", "a") == ("", []) and captures.class_text("</div></div><div class=a>x</div>y", "div", "a")[0] == "x"
    assert captures.class_text("<div class=ab>x</div><div class>y</div><div class='b a'>z<div>w</div>v</div>u", "div", "a")[0] == "z w v"


def test_captures_and_broken_spans(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, '<div class="correspondence_text">é&#233; x</div>' * 3), (5, '<div class="correspondence_text">' + "word " * 50_000)], "page_id long, html string").withColumn("text", F.lit("x"))
    found = captures.capture_text(pages, "page_id", "html")
    got = {r.page_id: r for r in found.collect()}
    assert [len(got[i].spans) for i in range(1, 6)] == [5, 0, 0, 3, 1] and got[4].text == "éé x éé x éé x" and got[2].text == "" and len(got[5].text) == 249_999
    assert got[4].text_sha256 == hashlib.sha256(got[4].text.encode()).hexdigest()
    sealed = captures.seal_spans(found, pages.select("page_id", "html"), "page_id", "html")
    assert sealed.count() == 9 and captures.span_problems(sealed, found, pages, "page_id", "html").count() == 0
    changed = found.withColumn("text", F.when(F.col("page_id") == 4, F.replace("text", F.lit("x"), F.lit("y"))).otherwise(F.col("text")))
    less = pages.filter("page_id <> 5").withColumn("html", F.when(F.col("page_id") == 1, F.substring("html", 1, 60)).otherwise(F.col("html")))
    issues = sorted((r.page_id, r.issue) for r in captures.span_problems(sealed, changed, less, "page_id", "html").collect())
    assert issues == [(1, "out_of_bounds")] * 5 + [(4, "text_differs")] * 3 + [(5, "capture_missing")]


# Record files ----------------------------------------------------------------------------------------
def test_record_files(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"request_id":"r1","title":"One"}\n\n{"request_id":"r2","é":"ß"}\n', encoding="utf-8")
    (tmp_path / "a.json").write_text('[{"request_id":"r3"}, 4, {"request_id":"r4"}]')
    (tmp_path / "c.json").write_text('{"records":[{"request_id":"r5"}]}')
    (tmp_path / "d.json").write_text('{"request_id":"r6"}')
    (tmp_path / "empty.jsonl").write_text("\n")
    (tmp_path / "note.txt").write_text("no record")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.jsonl").write_text('{"request_id":"r7"}')
    at = str(tmp_path)
    assert [p.removeprefix(at + "/") for p in files.discover([f"{at}/d.json", at, f"{at}/*.json"])] == ["a.json", "b.jsonl", "c.json", "d.json", "empty.jsonl"]
    assert files.discover([f"{at}/*/e.jsonl", f"{at}/none*"]) == [f"{at}/sub/e.jsonl"] and files.discover([f"file://{at}/a.json"]) == [f"file://{at}/a.json"]
    rows = files.read_record_files(spark, [at, f"{at}/sub"])
    got = {(r.input_file.removeprefix(at + "/"), r.number, json.loads(r.record)["request_id"]) for r in rows.collect()}
    assert got == {("b.jsonl", 1, "r1"), ("b.jsonl", 3, "r2"), ("a.json", 1, "r3"), ("a.json", 3, "r4"), ("c.json", 1, "r5"), ("d.json", 1, "r6"), ("sub/e.jsonl", 1, "r7")}
    assert rows.rdd.getNumPartitions() == 6
    counts = {r.input_file.removeprefix(at + "/"): r.records for r in files.batch_report(rows, [at, f"{at}/sub"]).collect()}
    assert counts == {"a.json": 2, "b.jsonl": 2, "c.json": 1, "d.json": 1, "empty.jsonl": 0, "sub/e.jsonl": 1}
    assert spark.read.format("casework_records").load(f"{at}/d.json").count() == 1
    with pytest.raises(FileNotFoundError):
        files.discover([f"{at}/missing.json"])
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n[2]\n')
    with pytest.raises(Exception, match="line 2 is no JSON object"):
        files.read_record_files(spark, [f"{at}/bad.jsonl"]).collect()
