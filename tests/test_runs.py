"""Reports, run folders, baselines and reviews of a small run."""

import pytest
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions import taxonomy as X
from maskwright.operators import detect, records, report, silver
from maskwright.operators.models import stub_client
from maskwright.plans.queries import QUERIES
from maskwright.sources import documents as D
from maskwright.sources import readers as R
from maskwright.sources.store import RunStore, export_baseline, find_baseline, seed_run

SPAN = S.SPANS.simpleString()


def span(a, b, label):
    return (label, label, label, a, b, None)


@pytest.fixture
def tables(spark):
    fixtures = spark.createDataFrame(
        [("1", "Ann a@b.c", "en", [span(0, 3, "PERSON"), span(4, 9, "EMAIL")]), ("2", "Bo", "German", [span(0, 2, "PERSON")]), ("3", None, None, None)],
        f"id string, text string, language string, gold_spans {SPAN}")
    calls = [("1", "x", [span(0, 3, "PERSON")], None), ("2", "x", [], None), ("1", "y", [span(4, 9, "EMAIL")], None), ("2", "y", [], "timeout")]
    predictions = spark.createDataFrame([(*c, 1.0, None, None, None) for c in calls], f"id string, detector string, spans {SPAN}, error string, latency_ms double, started_at timestamp, run_id string, ingested_at timestamp")
    return fixtures, predictions


def test_report_sections(spark, tables):
    text = report.run_report(*tables, {"dataset": "toy", "started_at": "2026"})
    for heading in ("# Detector report 2026", "## Fair view", "## Raw view", "### Strict outcomes", "## By label", "## By language", "## Detected spans", "## Coverage"):
        assert heading in text
    assert "| x | 2 | 0.500 |" in text  # one of three found, none wrong
    assert "| de | 1 | 0.000 |" in text and "| y | 3 | 1 | 1 | 1 |" in text
    only = report.run_report(*tables, {}, detectors=["y"])
    assert "- detectors: y" in only and "| x |" not in only and "not registered" in only
    with pytest.raises(ValueError):
        report.run_report(*tables, {}, detectors=["nobody"])
    with pytest.raises(ValueError):
        report.run_report(*tables, {}, detectors=[])
    assert "precision or recall" in report.run_report(*tables, {}, gold="none") and "## Fair" not in report.run_report(*tables, {}, gold="none")
    failed = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    lost = report.run_report(*tables, {}, gold="silver", silver={"labelers": ["a", "b"], "merge": "majority", "n_errors": {"a": 3}}, failed=failed)
    assert "labels by a, b, merged by majority" in lost and "nothing to score" in lost and "| a | 3 |" in lost
    assert "left out: 1 record" in report.run_report(*tables, {}, gold="silver", failed=failed.limit(1))


def test_report_helpers(spark):
    assert report.safe_name("a/b c:1") == "a_b_c_1" and report.safe_name("//") == "unnamed"
    assert report.span_in_context("one | two three", 6, 9, 4) == "…e \\| **two** thr…"
    assert report.run_labels(None, None, ["EMAIL", "PERSON"]) == ["PERSON", "EMAIL"] and report.run_labels(["EMAIL"], ["PERSON"], []) == ["EMAIL"]
    issues = spark.createDataFrame([(f"r{i:03d}", "error" if i % 2 else "warning", "x", 2) for i in range(30)], "id string, severity string, issue string, n int")
    got = report.issues_summary(issues, shown=5, most=20)
    assert not got["ok"] and got["counts"] == {"error": 30, "warning": 30} and len(got["shown"]) == 5 and got["hidden"] == 15
    with pytest.raises(ValueError):
        report.md_table(spark.range(report.MAX_ROWS + 1))


def test_run_folder_and_baseline(spark, tables, tmp_path):
    fixtures, predictions = tables
    records = fixtures.select("id", "text")
    results = predictions.select("id", "detector", "spans", "error", "latency_ms")
    run = RunStore(spark, str(tmp_path / "a"))
    run.write(results, records, "toy", ["PERSON"], {"x": {"t": 1}})
    (tmp_path / "a" / "notes.txt").write_text("mine")
    export_baseline(run, records, str(tmp_path / "base" / "toy"))
    assert find_baseline(str(tmp_path / "base"), "toy", {"x": {"t": 1}}) == str(tmp_path / "base" / "toy") and find_baseline(str(tmp_path / "base"), "toy", {}) is None
    other = RunStore(spark, str(tmp_path / "b"))
    assert not seed_run(other, str(tmp_path / "base" / "toy"), records, "toy", ["PERSON"], {})
    changed = records.withColumn("text", F.when(F.col("id") == "1", "other").otherwise(F.col("text")))
    assert not seed_run(other, str(tmp_path / "base" / "toy"), changed, "toy", ["PERSON"], {"x": {"t": 1}})
    assert seed_run(other, str(tmp_path / "base" / "toy"), records.where("id = '1'"), "toy", ["PERSON"], {"x": {"t": 1}}) and other.results().count() == 2
    spark.range(3).write.parquet(run.review_path("judge one"))
    assert run.reviews().count() == 3 and run.reviews("judge one").count() == 3
    with pytest.raises(FileNotFoundError):
        run.reviews("nobody")
    assert run.clear() == ["manifest.json", "raw", "review_judge_one"] and (tmp_path / "a" / "notes.txt").exists()
    assert run.clear() == [] and RunStore(spark, str(tmp_path / "none")).clear() == []


def test_bio_schemes(spark):
    def spans(tokens, tags, ws=None):
        df = spark.createDataFrame([(tokens, tags, ws)], "t array<string>, g array<string>, w array<boolean>")
        r = df.select(R.bio_spans(F.col("t"), F.col("g"), F.col("w") if ws else None).alias("b")).first()["b"]
        return r["text"], [(s["label"], r["text"][s["start"] : s["end"]]) for s in r["spans"]]

    assert spans(["Ann", "Lee", "Bo"], ["B-P", "I-P", "B-P"]) == ("Ann Lee Bo", [("P", "Ann Lee"), ("P", "Bo")])
    assert spans(["a", "b", "c", "d"], ["B-P", "L-P", "U-P", "S-Q"]) == ("a b c d", [("P", "a b"), ("P", "c"), ("Q", "d")])
    assert spans(["a", "b", "c"], ["I-P", "I-Q", "Q"]) == ("a b c", [("P", "a"), ("Q", "b c")])
    assert spans(["a", "b"], ["P", "O"], [False, True]) == ("ab", [("P", "a")])
    assert spans([], []) == ("", []) and spans(["x"] * 600, ["O"] * 599 + ["B-P"])[1] == [("P", "x")]
    text = spark.createDataFrame([("1", "Ann", '[{"entity_type": "PERSON", "begin": 0, "stop": 3}]')], "id string, text string, spans string")
    assert [s["text"] for s in R.spans_dataset(text, "canonical").first()["gold_spans"]] == ["Ann"]


def test_lines_that_are_no_records(spark):
    lines = ['{"id": "a", "text": "x"}', "{bad", '{"id": "b", "text": 5}', '{"id": 7, "text": "x"}', "[1]", " ", '{"text": "x"}', '{"id": "c", "text": null}']
    df = spark.createDataFrame(list(enumerate(lines)), "line int, value string")
    got = {r["line"]: r["issue"] for r in records.validate_jsonl(df).collect()}
    assert got == {1: "bad JSON", 2: "text is no string", 3: "id is no string", 4: "no object", 6: "id is no string", 7: "text is no string"}
    made = spark.createDataFrame([("a", "xy", [span(0, 1, "PERSON"), span(0, 1, "PERSON")], 1, None)], f"id string, text string, gold_spans {SPAN}, doc_id bigint, offset int")
    assert {r["issue"] for r in records.validate(made, unlabeled=True).collect()} == {"repeated span", "overlapping gold", "chunk without an offset", "gold in unlabeled records"}
    kept = R.spans_dataset(spark.createDataFrame([("1", "Ann", [("weird", 0, 3)])], "id string, text string, spans array<struct<label:string,start:int,end:int>>"), "canonical", keep_unmapped=True).first()
    assert [s["label"] for s in kept["gold_spans"]] == ["WEIRD"]


def test_demonstration_search(spark):
    rows = {r["mode"]: r for r in QUERIES["demo_search"](spark, "").collect()}
    assert rows["plain"]["recall"] == 1.0 and rows["label_token"]["recall"] == 1.0 and rows["label"]["recall"] < 0.5 and rows["redact"]["recall"] < 0.5
    table = report.side_by_side([{"plain": "x" * 80, "label": "[A]"}], ["label"], 10)
    assert table.splitlines()[2] == "| " + "x" * 9 + "… | [A] |"


def test_command_line(spark, tables, tmp_path, data, capsys):
    from maskwright.__main__ import main

    fixtures, predictions = tables
    fixtures.write.parquet(str(tmp_path / "f"))
    predictions.write.parquet(str(tmp_path / "r"))
    assert main(["report", str(tmp_path / "f"), str(tmp_path / "r"), str(tmp_path / "report.md")]) == 0 and "## Coverage" in (tmp_path / "report.md").read_text()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    assert main(["parse", str(tmp_path / "in"), str(tmp_path / "docs")]) == 0 and spark.read.parquet(str(tmp_path / "docs")).count() == 1
    (tmp_path / "x.jsonl").write_text('{"id": "a", "text": "x"}\n{bad\n')
    assert main(["validate", str(tmp_path / "x.jsonl")]) == 1 and main(["language_counts", data, str(tmp_path / "q")]) == 0
    assert main(["detectors"]) == 0 and "regex_strict" in capsys.readouterr().out and main([]) == 2 and main(["nothing", "x"]) == 2


def test_registries(spark, tmp_path):
    rows = spark.createDataFrame([("toy", "Who", "PERSON", 1), ("toy", "where", "CITY", 2), ("other", "x", "EMAIL", 1)], "vocab_key string, raw string, canonical string, ord int")
    v = X.vocab_from_rows(rows, "toy")
    X.bind_detector("toy_net", "toy")
    try:
        assert v.lookup("B-who") == "PERSON" and X.supported_labels("toy_net") == ["PERSON", "CITY"] and X.children("SECRET") == ["PASSWORD", "API_KEY"]
        with pytest.raises(KeyError):
            X.bind_detector("y", "none")
        with pytest.raises(ValueError):
            X.register_vocab("toy", {})
    finally:
        del X.VOCABS["toy"], X.DETECTOR_VOCAB["toy_net"]
    spark.createDataFrame([("1", "Ann")], "id string, text string").write.parquet(str(tmp_path / "d.parquet"))
    R.register_dataset(R.Dataset("toy", str(tmp_path / "d.parquet")), replace=True)
    assert R.load_dataset(spark, "toy").count() == 1
    with pytest.raises(ValueError):
        R.register_dataset(R.Dataset("toy", "x"))
    doc = D.from_text("one\r\n\n two")
    assert doc["text"] == "one\n\n two" and [(s["start"], s["end"]) for s in doc["segments"]] == [(0, 3), (5, 9)] and doc["id"].endswith(":pasted")


def test_model_families(spark):
    a = detect.register_token_classifier("toy_tagger", "some/model", replace=True)
    b = detect.register_prompted_model("toy_prompted", "some/other", "rules", ["EMAIL"], replace=True)
    try:
        assert not a.available and set(a.missing()) <= {"transformers", "torch"} and b.missing() == ["gliner"]
        with pytest.raises(RuntimeError):
            detect.detect(spark.createDataFrame([("1", "x")], "id string, text string"), "toy_tagger")
        v = X.VOCABS["canonical"]
        assert detect.model_span(v, "B-city", 0, 3, "Ely now", 0.9) == {"label": "ADDRESS", "fine_label": "CITY", "raw_label": "B-city", "start": 0, "end": 3, "text": "Ely", "score": 0.9}
        assert detect.model_span(v, "odd", 0, 1, "x") is None and detect.model_span(v, "odd", 0, 1, "x", keep_unmapped=True)["label"] == "ODD"
    finally:
        del detect.REGISTRY["toy_tagger"], detect.REGISTRY["toy_prompted"]
    bars = report.text_bars([{"d": "a", "f": 0.5}, {"d": "bb", "f": 1.0}, {"d": "c", "f": None}], "d", "f", 4)
    assert bars.splitlines() == ["a  ██ 0.500", "bb ████ 1.000", "c   –"] and report.text_bars([], "d", "f") == ""


def test_silver_report(spark, tables):
    fixtures, predictions = tables
    labelers = {"a": stub_client(lambda p: [{"value": "Ann", "label": "PERSON"}] if "Ann" in p else [])}
    made, rows = silver.generate(fixtures.select("id", "text", "language"), labelers)
    text = report.run_report(made, predictions, {}, gold="silver", silver={"labelers": ["a"]}, failed=silver.failed(rows))
    assert "Report on silver labels" in text and "| PERSON |" in text
