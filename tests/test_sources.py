from __future__ import annotations

import json

from pyspark.sql import functions as F

from threshmill.sources import io, providers


def test_jsonl_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"evidence_id":"x","v":1}\n\nnot json\n{"evidence_id":"x","v":2}\n{"v":3}\n{"v":4}\n')
    got = io.read_jsonl_tolerant(spark, str(tmp_path / "a.jsonl"), "evidence_id string, v int").collect()
    assert sorted((r.evidence_id or "", r.v) for r in got) == [("", 3), ("", 4), ("x", 1)]
    for w in ("worker_1", "worker_0"):
        (tmp_path / w).mkdir()
        (tmp_path / w / "items.jsonl").write_text(json.dumps({"v": 1}) + "\n")
    assert io.read_shards(spark, str(tmp_path / "worker_*" / "items.jsonl"), "v int").select("source_file").distinct().count() == 2


def test_keyed_arrays_and_array(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"nurse": [{"q": "a"}, {"q": "b"}], "cook": []}))
    assert [(r.occupation, r.seq, r.q) for r in io.read_keyed_arrays(spark, str(tmp_path / "c.json"), "q:string").orderBy("seq").collect()] == [("nurse", 0, "a"), ("nurse", 1, "b")]
    (tmp_path / "d.json").write_text(json.dumps([{"q": "a"}, {"q": "b"}], indent=1))
    assert io.read_json_array(spark, str(tmp_path / "d.json"), "q string").count() == 2


def test_csv_round_trip_and_split(spark, tmp_path):
    df = spark.createDataFrame([("u", ' says "x", and\nmore', True), ("v", "w", False)], "a string, b string, ok boolean")
    io.write_csv(df.select("a", "b"), str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in io.read_csv(spark, str(tmp_path / "csv"), ["a", "b"]).collect())[0][0] == "u"
    io.split_write(df, F.col("ok"), str(tmp_path / "kept"), str(tmp_path / "gone"))
    assert spark.read.json(str(tmp_path / "kept")).count() == spark.read.json(str(tmp_path / "gone")).count() == 1
    io.append_jsonl(df, str(tmp_path / "log"), "a")
    io.append_jsonl(df, str(tmp_path / "log"), "a")
    assert io.read_jsonl(spark, str(tmp_path / "log"), "a string, b string").count() == 4


def test_providers(spark):
    requests = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k1", "a")], "key string, text string")
    called = providers.Called((lambda xs: [x.upper() for x in xs],)).ask(requests)
    assert sorted((r.key, r.answer) for r in called.collect()) == [("k1", "A"), ("k1", "A"), ("k2", "B")]

    def broken(xs):
        raise TimeoutError

    assert {r.answer for r in providers.Called((broken, lambda xs: ["z"] * len(xs))).ask(requests).collect()} == {"z"}
    assert {r.answer for r in providers.Called((broken,)).ask(requests).collect()} == {None}
    works = spark.createDataFrame([("d1", 1), ("d2", 2), ("d3", 3)], "doi string, rank int")
    places = spark.createDataFrame([("d1", "", None), ("d2", None, "u2"), ("d3", "p3", "u3")], "doi string, url_for_pdf string, url string")
    assert [r.url for r in providers.open_access(works, places, 5).collect()] == ["u2", "p3"]
    js = spark.createDataFrame([('{"title":"t","articleids":[{"idtype":"pmc","value":"1"},{"idtype":"doi","value":"10.1/x"}]}',)], "json string")
    assert tuple(providers.summary_doi(js).first()) == ("t", "10.1/x")
    assert spark.range(1).select(providers.xml_text(F.lit("<?xml version='1.0'?><!DOCTYPE a><a> b <c>d</c></a>"))).first()[0] == "b d"


def test_sheets(spark, tmp_path):
    from threshmill.sources import sheets

    data = sheets.workbook([["title", None, "n"], ["a <b> & c", "x", "1"], [None, "y"], ["\u00e9\x01 ", "z", "2"]])
    assert sheets.cells(data) == [["title", None, "n"], ["a <b> & c", "x", "1"], [None, "y"], ["\u00e9 ", "z", "2"]]
    (tmp_path / "one.xlsx").write_bytes(data)
    rows = sheets.read_xlsx(spark, f"{tmp_path}/*.xlsx", ["n", "title", "gone"]).orderBy("row_number").collect()
    assert [(r.row_number, r.n, r.title, r.gone) for r in rows] == [(1, "1", "a <b> & c", None), (2, None, None, None), (3, "2", "\u00e9 ", None)]
    assert sheets.read_xlsx(spark, f"{tmp_path}/*.xlsx", ["n"], 9).count() == 0
    assert [sheets.column_number(sheets.column_name(i) + "7") for i in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]


def test_shared_strings():
    import io as files
    import zipfile

    from threshmill.sources import sheets

    out = files.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{sheets.SHEET_NS}"><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{sheets.SHEET_NS}"><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="C2"><v>3.5</v></c><c r="D2" t="s"><v>0</v></c></row></sheetData></worksheet>')
    assert sheets.cells(out.getvalue()) == [[], [None, "two", "3.5", "one"]]


def test_pdf(spark):
    from threshmill.sources import pdf

    body = b"%PDF-1.4\n1 0 obj << /Title <FEFF00C9> /ModDate (D:20200229) /Keywords (rev. B-2) >> endobj\n2 0 obj << /Length 9 >> stream\nBT [(Hel) -20 (lo)] TJ T* (a\\)b\\101) Tj ET\nendstream"
    files = [(1, body), (2, None), (3, b"junk"), (4, b"<< /Filter /FlateDecode >> stream\nbroken\nendstream")]
    got = {r.k: (r.text, r.title, r.publication_date, r.version) for r in pdf.read_pdf(spark.createDataFrame(files, "k int, f binary"), "k", "f").collect()}
    assert got == {1: ("Hello a)bA", "\u00c9", "2020-02-29", "B-2"), 2: ("", "", "", ""), 3: ("", "", "", ""), 4: ("", "", "", "")}


def test_checkpoints_are_whole(spark, tmp_path):
    at = str(tmp_path / "c")
    assert io.read_checkpoint(spark, at, ["k"]) is None
    io.write_checkpoint(spark.createDataFrame([("1",)], "k string"), at, 1)
    io.write_checkpoint(spark.createDataFrame([("2",), ("3",)], "k string"), at, 2)
    assert io.read_checkpoint(spark, at, ["k"]).count() == 2
    (tmp_path / "c" / "checkpoint=00000002" / "_SUCCESS").unlink()
    assert [r.k for r in io.read_checkpoint(spark, at, ["k"]).collect()] == ["1"]


def test_keys_are_used_up_in_their_process(spark):
    def refuses(texts):
        raise providers.Refused(402)

    def busy(texts):
        raise providers.Refused(503)

    requests = spark.createDataFrame([("k1", "a")], "key string, text string")
    asked = providers.Called((refuses, busy, lambda xs: ["z"] * len(xs)), name="test")
    assert asked.ask(requests).first().answer == "z" and asked.ask(requests).first().answer == "z"
    assert providers.exhausted("elsewhere") == set()
