import io
import json
import zipfile

import pytest

from maskwright.sources import documents as D
from maskwright.sources import readers as R
from maskwright.sources.store import RunStore, cache_key, content_hash, with_cached
from maskwright.streaming.detect import latency_windows, rewrite_stream


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl_with_other_key_names(spark, tmp_path):
    rows = [
        {"uid": "a", "body": "Ann lives in Ely", "pii": [{"begin": 0, "stop": 3, "kind": "NAME"}, {"begin": 13, "stop": 16, "kind": "town"}, {"begin": 0, "stop": 99, "kind": "NAME"}, {"begin": 0, "stop": 2, "kind": "WHAT"}], "lang": "English"},
        {"uid": None, "body": "no spans", "pii": None, "lang": "DE"}]
    path = write(tmp_path / "x.jsonl", "\n".join(map(json.dumps, rows)))
    got = R.spans_dataset(R.read_raw(spark, path)).orderBy("text").collect()
    assert [(s["label"], s["fine_label"], s["text"]) for s in got[0]["gold_spans"]] == [("PERSON", "PERSON", "Ann"), ("ADDRESS", "CITY", "Ely")]
    assert (got[0]["id"], got[0]["language"], got[1]["language"]) == ("a", "en", "de") and got[1]["gold_spans"] == []


def test_json_object_that_holds_a_list(spark, tmp_path):
    path = write(tmp_path / "x.json", json.dumps({"records": [{"id": 1, "text": "a"}, {"id": 2, "text": "b"}]}))
    assert sorted(r["id"] for r in R.spans_dataset(R.read_raw(spark, path)).collect()) == ["1", "2"]


def test_csv_in_both_forms(spark, tmp_path):
    a = write(tmp_path / "a.csv", "id,text,label,start,end\n1,Ann met Bo,NAME,0,3\n1,Ann met Bo,NAME,8,10\n2,plain,,,\n")
    got = {r["id"]: r for r in R.csv_dataset(spark, a).collect()}
    assert [s["text"] for s in got["1"]["gold_spans"]] == ["Ann", "Bo"] and got["2"]["gold_spans"] == []
    b = write(tmp_path / "b.csv", 'id,text,spans\n1,"Ann, here","[{""label"": ""NAME"", ""start"": 0, ""end"": 3}]"\n')
    assert R.csv_dataset(spark, b).first()["gold_spans"][0]["text"] == "Ann"
    with pytest.raises(ValueError):
        R.csv_dataset(spark, write(tmp_path / "c.csv", "a,b\n1,2\n"))
    with pytest.raises(ValueError):
        R.infer_format("x.doc")


def test_bio(spark):
    df = spark.createDataFrame([(["Ann", "Lee", "in", "Ely", "now"], ["B-NAME", "I-NAME", "O", "I-town", "O"])], "tokens array<string>, tags array<string>")
    row = R.bio_dataset(df).first()
    assert row["text"] == "Ann Lee in Ely now" and [(s["label"], s["text"]) for s in row["gold_spans"]] == [("PERSON", "Ann Lee"), ("ADDRESS", "Ely")]
    ints = spark.createDataFrame([(["Ann", "Bo"], [1, 1])], "tokens array<string>, tags array<int>")
    assert [s["text"] for s in R.bio_dataset(ints, tag_names=["O", "B-NAME"]).first()["gold_spans"]] == ["Ann", "Bo"]


def test_from_texts_numbers_blanks(spark):
    df = spark.createDataFrame([(0, "a"), (1, " "), (2, "b")], "k int, text string")
    assert sorted((r["id"], r["text"]) for r in R.from_texts(df, order_col="k").collect()) == [("text-0001", "a"), ("text-0003", "b")]


def test_text_and_bytes():
    text, segments, warnings = D.parse_text("one\r\n\r\n  two".encode())
    assert text == "one\n\n  two" and [(text[a:b], w["line"]) for a, b, w in segments] == [("one", "1"), ("  two", "3")]
    assert D.decode_bytes("é".encode("cp1252"))[0] == "é" and D.decode_bytes("﻿x".encode("utf-16-le"))[0] == "x"
    assert D.decode_bytes("abcdef".encode("utf-16-be"))[0] == "abcdef"
    for name in ("utf-32", "utf-16", "utf-8-sig"):
        assert D.decode_bytes("Zoë\U0001f600".encode(name)) == ("Zoë\U0001f600", [])
    text, warnings = D.decode_bytes(b"a\x81b")
    assert text == "a\ufffdb" and "1 undecodable" in warnings[0]
    assert D.decode_bytes(b"")[0] == "" and D.parse_text(b"\n\n a").segments == [(2, 4, {"line": "3"})]


def test_html():
    page = "<html><head><title>t</title></head><body><p>One &amp; two</p><script>x()</script><table><tr><td>a</td><td>b</td></tr></table><pre>x\n  y</pre></body></html>"
    assert D.html_lines(page) == ["One & two", "a\tb", "x", "y"]
    # an open head or noscript does not swallow the page
    assert D.html_lines("<head><title>t</title><meta x><p>one<p>two") == ["one", "two"]
    assert D.html_lines("<html><head><style>a{}<script>b</script></style></head><body><noscript>no</noscript>seen</body>") == ["seen"]
    assert D.html_lines("<head><script>x()</script><body>a<noscript><p>b</noscript>c") == ["ac"]
    assert D.html_lines("") == [] and D.html_lines("<pre>a\tb\r\nc</pre>") == ["a b", "c"]


def test_csv_document():
    text, segments, _ = D.parse("csv", b"name;;mail\nAnn;7;a@b.io\n;;\n")
    assert text == "name\tmail\nAnn\t7\ta@b.io" and [w["column"] for *_, w in segments][-3:] == ["name", "B", "mail"]
    assert D.column_letters(0) == "A" and D.column_letters(27) == "AB"


def test_email_with_nested_attachment():
    inner = "From: x@y.z\nSubject: in\n\ninner text\n"
    raw = (
        "From: a@b.io\nTo: c@d.io\nSubject: hi\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain; charset=utf-8\n\nbody line\n"
        f"--B\nContent-Type: text/csv\nContent-Disposition: attachment; filename=t.csv\n\na,b\n1,2\n--B\nContent-Type: message/rfc822\nContent-Disposition: attachment\n\n{inner}\n--B--\n")
    text, segments, _ = D.parse("eml", raw.encode())
    assert "Subject: hi" in text and "body line" in text and "inner text" in text
    assert any(w.get("attachment") == "t.csv" for *_, w in segments)
    assert all(text[a:b].strip() for a, b, _ in segments) and all(x[1] <= y[0] for x, y in zip(segments, segments[1:]))


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def test_docx_and_xlsx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r><w:ins><w:r><w:t> there</w:t></w:r></w:ins><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p></w:body></w:document>"
    assert D.parse("docx", _zip({"word/document.xml": doc})).text == "Hello there"
    x = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = _zip({
        "xl/workbook.xml": f'<workbook {x} {r}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {x}><si><t>name</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {x}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>3.0</v></c></row></sheetData></worksheet>'})
    text, segments, _ = D.parse("xlsx", book)
    assert text == "name\t3" and segments[1][2] == {"sheet": "S", "cell": "B1"}


def test_docx_tables_controls_and_headers():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(t)}</w:tc>"
    rows = f"<w:tr>{cell('wide', '<w:gridSpan w:val=\"2\"/>')}{cell('c')}</w:tr><w:tr>{cell('top', '<w:vMerge w:val=\"restart\"/>')}{cell('x')}{cell('y')}</w:tr><w:tr>{cell('hid', '<w:vMerge/>')}{cell('z')}</w:tr>"
    lost = f"<w:customXml>{p('lost')}</w:customXml>"
    doc = f"<w:document {w}><w:body>{p('one')}<w:p/><w:tbl>{rows}</w:tbl><w:sdt><w:sdtContent>{p('in')}</w:sdtContent></w:sdt>{p('two')}{lost}<w:sectPr><w:headerReference w:type=\"first\" r:id=\"rId1\"/></w:sectPr></w:body></w:document>"
    files = {
        "word/document.xml": doc, "word/header1.xml": f"<w:hdr {w}>{p('head')}{p('head')}</w:hdr>",
        "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="header1.xml"/></Relationships>'}
    text, segments, warnings = D.parse("docx", _zip(files))
    places = {text[a:b]: where for a, b, where in segments}
    assert text == "one\nwide\tc\ntop\tx\ty\nz\nin\ntwo\n\nhead"
    assert places["c"] == {"table": "0", "row": "0", "col": "2"} and places["two"] == {"paragraph": "2"} and places["in"] == {"content_control": "0", "paragraph": "0"}
    assert places["head"] == {"part": "header", "section": "0", "variant": "first"} and warnings[0].startswith("7 characters")


def test_xlsx_dates():
    assert D.render_date(32874) == "1990-01-01" and D.render_date(32874.5) == "1990-01-01T12:00:00" and D.render_date(0.25) == "06:00:00" and D.render_date(0, True) == "00:00:00"
    assert D.render_number("5551234567.0") == "5551234567" and D.render_number("1.5") == "1.5"


def test_laid_out_pieces():
    text, segments = D.lay_out([D.Piece("\n", " ", {}), D.Piece("\n", "a\r\nb", {"k": "1"}), D.Piece("\t", "", {}), D.Piece("\t", "c", {"k": "2"})])
    assert text == "a\nb\tc" and [text[a:b] for a, b, _ in segments] == ["a\nb", "c"] and D.broken_segments(text, segments) == []
    assert D.broken_segments("abc", [(0, 2, {}), (1, 3, {})]) == ["segment 1"]


def test_parse_many(spark, tmp_path):
    write(tmp_path / "a.txt", "hello")
    write(tmp_path / "b.bin", "zzz")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "~$a.docx", "x")
    docs, skipped = D.parse_many(spark, [str(tmp_path), str(tmp_path / "none"), str(tmp_path / "a.txt")])
    assert {r["source"] for r in docs.collect()} == {"a.txt"}
    got = [(r["source"], r["reason"].split(":")[0]) for r in skipped.collect()]
    assert (str(tmp_path / "none"), "not found") in got and ("b.bin", "unsupported type 'bin'") in got and ("c.docx", "BadZipFile") in got and ("sub/~$a.docx", "lock file") in got
    assert ("a.txt", "duplicate of a.txt") in got


def test_run_store(spark, tmp_path):
    rec = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, text string")
    res = spark.createDataFrame([("1", "d1", 1.0), ("2", "d1", 2.0)], "id string, detector string, latency_ms double")
    run = RunStore(spark, str(tmp_path / "r1"))
    run.write(res, rec, "toy", ["PERSON"])
    run.write(res.replace("d1", "d2", "detector"), rec, "toy", ["PERSON"])
    assert run.manifest()["detectors"] == ["d1", "d2"] and run.results(["d1"]).count() == 2
    with pytest.raises(ValueError):
        run.write(res, rec.limit(1), "toy", [])
    other = RunStore(spark, str(tmp_path / "r2"))
    other.write(res, rec, "toy", ["PERSON"])
    assert other.reuse_from(run) == ["d2"] and other.results().count() == 4
    assert content_hash(rec) == content_hash(rec.orderBy("text"))


def test_cache(spark):
    calls = spark.createDataFrame([("a",), ("b",)], "prompt string").withColumn("key", cache_key(__import__("pyspark.sql.functions", fromlist=["col"]).col("prompt")))
    cache = calls.where("prompt = 'a'").selectExpr("key", "'x' as response")
    hit, miss = with_cached(calls, cache)
    assert [r["prompt"] for r in hit.collect()] == ["a"] and [r["prompt"] for r in miss.collect()] == ["b"]


def test_streams(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/requests.parquet").select("request_id", "text")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = rewrite_stream(stream, rules=["email"]).select("request_id", "replaced_text").writeStream.format("memory").queryName("rw").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rw").count() == rows.count()
    assert latency_windows(spark.read.parquet(f"{data}/predictions.parquet"), "1 day").count() > 0


def test_latency_windows_on_a_stream(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/predictions.parquet").select("id", "detector", "run_id", "started_at", "error", "latency_ms")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = latency_windows(stream, "1 day").writeStream.format("memory").queryName("lat").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = latency_windows(rows, "1 day")
    assert spark.table("lat").selectExpr("sum(calls)").first()[0] == batch.selectExpr("sum(calls)").first()[0]
