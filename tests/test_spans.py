import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions import taxonomy as X
from maskwright.operators import detect, documents, judge, models, records, review, scoring, segments, silver, transforms, voting
from maskwright.operators.locate import Found, Located, assign, without_overlaps
from maskwright.sources import fixtures

SP = "id string, text string, spans array<struct<start:int,end:int,label:string>>"


def one(spark, text, spans, mode="label"):
    df = spark.createDataFrame([("r", text, spans)], SP)
    return transforms.rewrite(df, "spans", mode=mode).first()


def test_overlap_earlier_start_wins(spark):
    row = one(spark, "alice and bob", [(0, 9, "PERSON"), (3, 9, "ORGANIZATION")])
    assert row["replaced_text"] == "[PERSON] bob"
    assert [s["replaced"] for s in row["detected_spans"]] == [True, False]


def test_modes(spark):
    text, spans = "Kim met Kim and Lee", [(0, 3, "PERSON"), (8, 11, "PERSON"), (16, 19, "PERSON")]
    assert one(spark, text, spans, "redact")["replaced_text"] == "******** met ******** and ********"
    assert one(spark, text, spans, "label_number")["replaced_text"] == "[PERSON_1] met [PERSON_1] and [PERSON_2]"
    token = one(spark, text, spans, "label_token")["replaced_text"]
    a, b, c = (token.split("[PERSON_")[k].split("]")[0] for k in (1, 2, 3))
    assert a == b != c and len(a) == 7 and a.isalnum()
    with pytest.raises(ValueError):
        one(spark, text, spans, "other")


def test_numbers_are_independent_per_label_and_dropped_spans_take_one(spark):
    row = one(spark, "ab cd ab", [(0, 2, "PERSON"), (0, 2, "EMAIL"), (3, 5, "EMAIL"), (6, 8, "PERSON")], "label_number")
    assert row["replaced_text"] == "[EMAIL_1] [EMAIL_2] [PERSON_1]"


def test_rewrite_nulls_and_bad_spans(spark):
    df = spark.createDataFrame([("a", None, [(0, 1, "X")]), ("b", "text", None), ("c", "", []), ("d", "abc", [(2, 9, "X"), (1, 1, "X"), (-1, 2, "X")])], SP)
    rows = {r["id"]: r["replaced_text"] for r in transforms.rewrite(df, "spans").collect()}
    assert rows == {"a": None, "b": "text", "c": "", "d": "abc"}


def test_category_filter(spark):
    q = spark.createDataFrame([(1, "ab cd", None, None), (2, "ab cd", [], None), (3, "ab cd", ["EMAIL"], "redact")], "request_id bigint, text string, categories array<string>, mode string")
    s = spark.createDataFrame([(k, "PERSON", 0, 2) for k in (1, 2, 3)] + [(k, "EMAIL", 3, 5) for k in (1, 2, 3)], "request_id bigint, label string, start int, end int")
    rows = {r["request_id"]: r for r in transforms.replace(q, transforms.spans_by_request(s)).collect()}
    assert rows[1]["replaced_text"] == "[PERSON] [EMAIL]" and rows[1]["by_label"] == {"PERSON": 1, "EMAIL": 1}
    assert rows[2]["replaced_text"] == "ab cd" and rows[2]["span_count"] == 0
    assert rows[3]["replaced_text"] == "ab ********"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8)), max_size=8))
def test_splice_matches_a_plain_loop(spark, pairs):
    text = "".join(chr(97 + i % 26) for i in range(40)) + "😀é"
    spans = sorted({(a, min(a + n, len(text)), "X") for a, n in pairs})
    out, at = "", 0
    for a, b, label in spans:
        if a >= at:
            out, at = out + text[at:a] + f"[{label}]", b
    assert one(spark, text, spans)["replaced_text"] == out + text[at:]


def test_regex_offsets_with_wide_characters(spark):
    df = spark.createDataFrame([("😀 mail a@b.io and c.d@e.org",)], "text string")
    row = detect.detect_rules(df, ["email"]).first()
    assert [(s["start"], s["end"], s["text"]) for s in row["spans"]] == [(7, 13, "a@b.io"), (18, 27, "c.d@e.org")]


def test_luhn_separates_strict_from_loose(spark):
    df = spark.createDataFrame([("1", "4111111111111111 and 4111111111111112")], "id string, text string")
    n = {r["detector"]: len(r["spans"]) for r in detect.detect_all(df, ["regex_strict", "regex_loose"]).collect()}
    assert n == {"regex_strict": 1, "regex_loose": 2}


def test_plugin_detector_returns_errors(spark):
    def load():
        def model(text):
            if "boom" in text:
                raise RuntimeError("no")
            return [{"label": "PERSON", "fine_label": None, "raw_label": "p", "start": 0, "end": 1, "text": text[:1], "score": s} for s in (0.9, 0.1)]
        return model

    detect.register(detect.DetectorSpec("toy", load=load), replace=True)
    df = spark.createDataFrame([("1", "ab"), ("2", "boom"), ("3", None)], "id string, text string")
    rows = {r["id"]: r for r in detect.detect(df, "toy").collect()}
    assert len(rows["1"]["spans"]) == 1 and rows["1"]["error"] is None
    assert rows["2"]["error"].startswith("RuntimeError") and rows["3"]["spans"] == []
    with pytest.raises(ValueError):
        detect.select_detectors(["nobody"])


def test_trim_boundaries(spark):
    row = spark.range(1).select(detect.trim_boundaries(F.lit("x, Ann. y"), F.lit(1), F.lit(7)).alias("t")).first()
    assert (row["t"]["start"], row["t"]["end"]) == (3, 6)


def test_taxonomy():
    assert len(X.COARSE) == 15 and len(X.PARENT) == 24
    assert X.parent("CITY") == "ADDRESS" and X.parent("NEW") == "NEW"
    assert X.to_canonical("records", "B-town") == "CITY" and X.to_canonical("records", "TOWN", "coarse") == "ADDRESS"
    assert X.to_canonical("records", "nothing") is None
    with pytest.raises(ValueError):
        X.check_level("middle")
    assert X.scope_for(["PERSON", "CITY"], ["PERSON", "CITY", "EMAIL"], "fine", "fair").keys() >= {"PERSON", "CITY", "ADDRESS"}
    assert set(X.scope_for(["PERSON"], ["PERSON", "EMAIL"], "coarse", "raw").values()) == {"PERSON", "EMAIL"}
    assert X.prompts_for("records", ["EMAIL"]) == ["EMAIL", "MAIL_ADDR"]


def _tables(spark, text, gold, pred):
    span = lambda x: (x[2], None, None, x[0], x[1], None)
    rec = spark.createDataFrame([("r", text, "en", [span(x) for x in gold])], f"id string, text string, language string, gold_spans {S.SPANS.simpleString()}")
    return rec, spark.createDataFrame([("r", "d", [span(x) for x in pred], None)], f"id string, detector string, spans {S.SPANS.simpleString()}, error string")


def _score(spark, gold, pred):
    rec, latest = _tables(spark, "x" * 60, gold, pred)
    out = scoring.outcomes(scoring.answered(rec, latest), scoring.scopes(rec, latest))
    return {r["schema"]: r for r in scoring.score(out, ["view", "detector"]).where("view = 'raw'").collect()}


def test_semeval_table(spark):
    gold = [(0, 5, "PERSON"), (10, 15, "EMAIL"), (20, 25, "PHONE"), (30, 35, "PERSON"), (40, 45, "EMAIL")]
    pred = [(0, 5, "PERSON"), (10, 15, "PERSON"), (20, 23, "PHONE"), (31, 35, "EMAIL"), (50, 55, "PERSON")]
    s = _score(spark, gold, pred)
    pick = lambda x: tuple(s[x][c] for c in ("cor", "inc", "par", "mis", "spu"))
    assert pick("strict") == (1, 3, 0, 1, 1)
    assert pick("exact") == (2, 2, 0, 1, 1)
    assert pick("partial") == (2, 0, 2, 1, 1)
    assert pick("ent_type") == (2, 2, 0, 1, 1)
    assert s["partial"]["precision"] == pytest.approx(3 / 5)


def test_touching_spans_do_not_overlap(spark):
    s = _score(spark, [(0, 5, "PERSON")], [(5, 9, "PERSON")])
    assert (s["strict"]["mis"], s["strict"]["spu"]) == (1, 1)


def test_fair_scope_counts_supported_labels_that_are_never_found(spark):
    rec, latest = _tables(spark, "x" * 60, [(0, 5, "PERSON"), (10, 15, "PHONE"), (20, 25, "MONEY")], [(0, 5, "PERSON")])
    X.DETECTOR_VOCAB["d"] = "plain8"  # supports PHONE and never finds one; knows no MONEY
    try:
        out = scoring.outcomes(scoring.answered(rec, latest), scoring.scopes(rec, latest))
        missed = {r["view"]: r["mis"] for r in scoring.score(out, ["view", "detector"]).where("schema = 'strict'").collect()}
        assert missed == {"fair": 1, "raw": 2}
        given = scoring.score(scoring.outcomes(scoring.answered(rec, latest), scoring.scopes(rec, latest, labels=["MONEY"])), ["view"]).where("schema = 'strict'").collect()
        assert {r["mis"] for r in given} == {1}
    finally:
        del X.DETECTOR_VOCAB["d"]


def test_fine_level_collapses_what_a_detector_cannot_split(spark):
    span = lambda a, b, label, fine: (label, fine, None, a, b, None)
    kind = S.SPANS.simpleString()
    rec = spark.createDataFrame([("r", "x" * 60, "en", [span(0, 5, "ADDRESS", "CITY"), span(10, 15, "ADDRESS", "CITY")])], f"id string, text string, language string, gold_spans {kind}")
    calls = spark.createDataFrame(
        [("r", "whole", [span(0, 5, "ADDRESS", None)], None), ("r", "split", [span(0, 5, "ADDRESS", None), span(10, 15, "ADDRESS", "CITY")], None)], f"id string, detector string, spans {kind}, error string")
    X.DETECTOR_VOCAB["whole"] = "coarse15"
    try:
        out = scoring.outcomes(scoring.answered(rec, calls, "fine"), scoring.scopes(rec, calls, "fine"))
        rows = {r["detector"]: r for r in scoring.score(out, ["view", "detector"]).where("schema = 'strict' and view = 'fair'").collect()}
        assert (rows["whole"]["cor"], rows["whole"]["inc"], rows["whole"]["mis"]) == (1, 0, 1)
        # the coarse parent of a fine gold label is one incorrect span, not a miss
        assert (rows["split"]["cor"], rows["split"]["inc"], rows["split"]["mis"]) == (1, 1, 0)
    finally:
        del X.DETECTOR_VOCAB["whole"]


def test_agreement_of_two_empty_detectors_is_one(spark):
    kind = S.SPANS.simpleString()
    calls = spark.createDataFrame([("r", "a"), ("r", "b")], "id string, detector string")
    none = spark.createDataFrame([], f"id string, detector string, spans {kind}, error string")
    row = voting.agreement(none, calls).first()
    assert (row["a"], row["b"], row["f1"]) == ("a", "b", 1.0)
    span = ("PERSON", None, None, 0, 4, None)
    twice = spark.createDataFrame([("r", "a", [span, span], None), ("r", "b", [span], None)], none.schema)
    row = voting.agreement(twice, calls).first()
    assert (row["same"], row["n_a"], row["n_b"], row["precision"], row["recall"]) == (1, 2, 1, 1.0, 0.5)


def test_majority_of_two_needs_both(spark):
    p = spark.createDataFrame([("r", "a", 0, 4, "PERSON"), ("r", "b", 0, 5, "PERSON"), ("r", "a", 9, 12, "EMAIL")], "id string, detector string, start int, end int, label string")
    calls = spark.createDataFrame([("r", "a"), ("r", "b")], "id string, detector string")
    assert {(r["start"], r["label"]) for r in voting.merge_votes(p, calls, "majority").collect()} == {(0, "PERSON")}
    assert voting.merge_votes(p, calls, "union").count() == 3
    kept = voting.resolve_overlaps(voting.merge_votes(p, calls, "union")).collect()
    assert sorted((r["start"], r["end"]) for r in kept) == [(0, 5), (9, 12)]


def test_greedy_matching_uses_each_gold_once(spark):
    rec, latest = _tables(spark, "x" * 30, [(0, 10, "PERSON")], [(0, 9, "PERSON"), (0, 10, "PERSON")])
    row = scoring.greedy_matches(scoring.answered(rec, latest)).first()
    assert (row["tp"], row["n_pred"], row["n_gold"]) == (1, 2, 1)


def test_exact_quantiles_match_sorting(spark):
    rng = random.Random(3)
    values = [("g", rng.choice([0.0, 1.5, rng.random() * 1e6, rng.random()])) for _ in range(997)] + [("h", 2.0)]
    df = spark.createDataFrame(values + [("g", None), ("g", float("nan"))], "g string, v double")
    rows = {r["g"]: r for r in records.exact_quantiles(df, "g", "v", {"p0": F.lit(0), "p50": F.floor((F.col("n") - 1) / 2), "p1": F.col("n") - 1}).collect()}
    want = sorted(v for g, v in values if g == "g")
    assert (rows["g"]["n"], rows["g"]["p0"], rows["g"]["p50"], rows["g"]["p1"]) == (997, want[0], want[498], want[-1])
    assert rows["h"]["p50"] == 2.0


def test_chunks_cover_and_rebuild(spark):
    rng = random.Random(1)
    for _ in range(40):
        text = "".join(rng.choice("ab \n.") for _ in range(rng.randint(1, 300)))
        segs = sorted({(0, rng.randint(1, len(text))) for _ in range(5)})
        got = documents.chunk_ranges(text, segs, 37)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
        assert all(0 < b - a <= 37 for a, b in got)
    df = spark.createDataFrame([(1, "one two three " * 20, None), (2, None, None), (3, "", None)], "doc_id bigint, text string, segments array<struct<start:int,end:int>>")
    back = {r["doc_id"]: r for r in documents.rebuild(documents.chunks(df, 50)).collect()}
    assert back[1]["text"] == "one two three " * 20 and back[1]["complete"] and set(back) == {1}


def test_interval_union_keeps_touching_apart(spark):
    df = spark.createDataFrame([("a", 0, 4), ("a", 2, 6), ("a", 6, 8), ("b", 1, 2)], "id string, start int, end int")
    assert sorted(tuple(r) for r in documents.interval_union(df, ["id"]).collect()) == [("a", 0, 6), ("a", 6, 8), ("b", 1, 2)]


def test_review_summary_nulls(spark):
    pooled = spark.createDataFrame([("r", 0, 3, "PERSON", ["a"])], "id string, start int, end int, label string, detectors array<string>")
    gold = spark.createDataFrame([("r", 0, 3, "PERSON"), ("r", 5, 9, "EMAIL")], "id string, start int, end int, label string")
    calls = spark.createDataFrame([("r", "a"), ("r", "b")], "id string, detector string")
    rows = {r["detector"]: r for r in review.summarize(review.judge_from_gold(pooled, gold), review.missed_from_gold(pooled, gold), calls).collect()}
    assert (rows["a"]["precision"], rows["a"]["recall"], rows["a"]["missed_by_all"]) == (1.0, 0.5, 1)
    assert (rows["b"]["precision"], rows["b"]["recall"], rows["b"]["n_spans"]) == (None, 0.0, 0)


def test_entities_are_never_merged_by_a_long_span():
    spans = [(0, 5, "correct"), (3, 7, "correct"), (10, 15, "correct"), (4, 14, "boundary"), (20, 25, "wrong_label"), (22, 30, "boundary"), (14, 16, "wrong_label")]
    assert review.group_entities(spans) == [0, 0, 1, 1, 2, 2, 1]


def test_entities_match_a_plain_search():
    rng = random.Random(3)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 9), rng.choice(["correct", "boundary", "wrong_label"])) for a in (rng.randrange(30) for _ in range(rng.randint(1, 9)))]
        got = review.group_entities(spans)
        sure = [i for i, s in enumerate(spans) if s[2] == "correct"]
        near = lambda i, j: spans[i][0] < spans[j][1] and spans[j][0] < spans[i][1]
        reach = {i: {i} for i in sure}
        for _ in sure:
            reach = {i: {j for k in r for j in sure if near(k, j)} | r for i, r in reach.items()}
        assert all((got[i] == got[j]) == (j in reach[i]) for i in sure for j in sure)
        for i, s in enumerate(spans):
            if s[2] != "correct":
                mates = [j for j in sure if got[j] == got[i]]
                assert bool(mates) <= any(near(i, j) for j in sure)
                mine = [j for j in range(len(spans)) if got[j] == got[i]]
                assert any(near(i, j) for j in mine if j != i) or len(mine) == 1


def test_judge_splits_and_answers(spark):
    pooled = [(0, 3, "PERSON", ["a"]), (4, 9, "EMAIL", ["a", "b"]), (10, 12, "PHONE", ["b"])]
    kind = "array<struct<start:int,end:int,label:string,detectors:array<string>>>"
    df = spark.createDataFrame([("r", "Ann a@b.c 12 and Bo Lee", pooled), ("e", "x y", []), ("n", None, []), ("b", "  ", [])], f"id string, text string, spans {kind}")
    rule = judge.rule_judge(lambda c: "boundary" if c["label"] == "PERSON" else "correct", lambda asked: [{"value": "Bo Lee", "label": "PERSON"}, {"value": "Zed", "label": "PERSON"}], limit=1)
    rows = judge.judge(df, rule).collect()
    spans = {r["label"]: r for r in rows if r["kind"] == "span"}
    assert {k: r["verdict"] for k, r in spans.items()} == {"PERSON": "boundary", "EMAIL": "correct", "PHONE": "correct"} and spans["PERSON"]["calls"] == 5
    assert [(r["id"], r["start"], r["text"]) for r in rows if r["kind"] == "found"] == [("r", 17, "Bo Lee")]
    assert {(r["id"], r["value"], r["reason"]) for r in rows if r["kind"] == "dropped"} == {("r", "Zed", "not_found"), ("e", "Bo Lee", "not_found"), ("e", "Zed", "not_found")}
    assert not [r for r in rows if r["id"] in ("n", "b")]
    bad = judge.judge(df, judge.rule_judge(lambda c: "perhaps")).collect()
    assert [(r["id"], r["kind"]) for r in bad if r["id"] == "r"] == [("r", "error")]
    none = judge.judge(df, lambda: lambda prompt: models.Answer('{"verdicts": []}')).where("kind = 'span'").collect()
    assert {r["verdict"] for r in none} == {"unjudged"}


def test_classifier_runs(spark):
    kind = "array<struct<start:int,end:int,label:string,detectors:array<string>>>"
    df = spark.createDataFrame([("r", "Ann a@b.c", [(0, 3, "PERSON", ["a"]), (4, 9, "EMAIL", ["b"]), (4, 99, "EMAIL", ["b"])]), ("n", None, [])], f"id string, text string, spans {kind}")

    def respond(request):
        if "[[Ann]]" in request["state"]["text"]:
            raise ValueError("no")
        return {"is_pii": 0.7, "label_ok": judge.noul(0.6), "label": judge.choice({"EMAIL": 0.9, "NOT_PII": 0.1})}

    rows = {r["label"]: r for r in judge.classify_spans(df, lambda: judge.RuleBackend(respond)).collect()}
    assert rows["PERSON"]["error"] == "ValueError: no" and (rows["EMAIL"]["p_pii"], rows["EMAIL"]["best_label"], rows["EMAIL"]["error"]) == (0.7, "EMAIL", None)
    even = judge.classify_spans(df, judge.RuleBackend).collect()
    assert len(even) == 2 and all(r["p_pii"] == 0.5 and r["error"] is None for r in even)
    calls = spark.createDataFrame([("r", "Ann left. a@b.c 12", [("d", [(0, 3, "PERSON"), (10, 15, "EMAIL")]), ("e", [(0, 99, "PERSON")])])], "id string, text string, calls array<struct<detector:string,spans:array<struct<start:int,end:int,label:string>>>>")
    segs = segments.segments(calls)
    asked = judge.classify_segments(segs, lambda: judge.RuleBackend(lambda q: {"residual": 0.9, "residual_type": judge.choice({"NONE": 1.0})}))
    got = {(r["detector"], r["masked"]): (r["p_residual"], r["trivial"]) for r in asked.collect()}
    assert got == {("d", "[PERSON] left."): (0.9, False), ("d", "[EMAIL] 12"): (0.9, False), ("e", "Ann left."): (0.9, False), ("e", "a@b.c 12"): (0.9, False)}
    broken = judge.classify_segments(segs, lambda: judge.RuleBackend(lambda q: {}))
    assert broken.where("error like 'KeyError%'").count() == 4
    assert {r["residual_rate"] for r in judge.residual_summary(asked).collect()} == {1.0}


def test_segments_never_cut_spans():
    text = "Dr. Ann Lee came. She left at 5 p.m. today! Id\n12 34 is hers. " + "x" * 30 + " tail"
    got = [text[a:b] for a, b in segments.split(text, 25, [(44, 52)])]
    assert got[:2] == ["Dr. Ann Lee came.", "She left at 5 p.m. today!"] and "Id\n12 34 is hers." in got
    assert all(len(x) <= 30 for x in got)
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice("ab .!\n") for _ in range(rng.randint(1, 80)))
        spans = [(a, min(len(t), a + rng.randint(1, 12))) for a in (rng.randrange(len(t)) for _ in range(3))]
        out = segments.split(t, 10, spans)
        assert all(x[1] <= y[0] for x, y in zip(out, out[1:])) and sum(c.isalnum() for c in t) == sum(sum(c.isalnum() for c in t[a:b]) for a, b in out)


def test_models(spark):
    assert models.parse_json("Sure: ```json\n[1]\n``` done") == [1] and models.parse_json("x {\"a\": 1} y") == {"a": 1}
    schema = {"type": "array", "items": {"type": "object", "required": ["value"], "properties": {"value": {"type": "string"}}, "additionalProperties": False}}
    assert models.problems([{"value": "x"}], schema) == [] and len(models.problems([{"v": 1}, 3], schema)) == 3
    df = spark.createDataFrame([("1", "abc"), ("2", None), ("3", "y" * 500), ("4", "abc")], "id string, text string")
    client = models.stub_client(lambda p: [{"value": "abc"}] if "abc" in p else 7, limit=300)
    prompt = models.labels_prompt(F.col("text"), ["PERSON"])
    rows = {r["id"]: r for r in models.ask(df, prompt, client, schema).collect()}
    assert rows["1"]["error"] is None and rows["2"]["error"] == "no prompt" and rows["3"]["truncated"]
    cache = spark.createDataFrame([], "key string, response string")
    answers, new = models.ask_cached(df.where("id in ('1', '4')"), prompt, "m", client, cache, schema)
    assert answers.count() == 2 and new.count() == 1
    assert models.halve("aaa bbb") == 4 and models.halve("aa bb\ncc dd") == 6 and models.halve("x" * 10) == 5
    assert models.parse_json('see [1] or {"a": 1}', {"type": "object"}) == {"a": 1}
    rules = {"type": "object", "required": ["n", "s"], "properties": {"n": {"type": "integer", "minimum": 1, "maximum": 3}, "s": {"type": "string", "minLength": 2, "pattern": "^a"}, "c": {"const": 7}}}
    assert models.problems({"n": 2, "s": "ab", "c": 7}, rules) == [] and len(models.problems({"n": 9, "s": "b", "c": 8}, rules)) == 4
    assert models.minimal(rules) == {"n": 1, "s": "xx"} and models.problems(models.minimal({"type": "array", "minItems": 2, "items": {"enum": ["q"]}}), {"type": "array"}) == []
    failing = models.stub_client(lambda p: 1 / 0)
    assert models.ask(df.where("id = '1'"), prompt, failing).first()["error"].startswith("ZeroDivisionError")


def test_fixtures(spark, tmp_path):
    rec, _ = _tables(spark, "Ann here", [(0, 3, "PERSON"), (5, 99, "EMAIL")], [])
    rows, meta = fixtures.ensure(rec, str(tmp_path / "f"), 5, dataset="toy")
    assert meta["dropped_spans"] == 1 and rows.first()["gold_spans"][0]["label"] == "PERSON" and fixtures.ensure(rec, str(tmp_path / "f"), 5, dataset="toy")[1] == meta
    docs = spark.createDataFrame([(1, "one. " * 9 + " " * 30 + "two", None)], "doc_id bigint, text string, segments array<struct<start:int,end:int>>")
    recs, blank = fixtures.from_documents(docs, 20)
    back = documents.rebuild(recs.select("doc_id", "offset", "text").unionByName(blank.select("doc_id", "offset", "text"))).first()
    assert back["complete"] and back["text"] == docs.first()["text"]


def test_validation_issues(spark):
    schema = f"id string, text string, language string, gold_spans {S.SPANS.simpleString()}"
    sp = lambda label, a, b: (label, None, None, a, b, None)
    df = spark.createDataFrame([
        ("a", "hello", "en", [sp("PERSON", 0, 3), sp("PERSON", 2, 9)]), ("a", "hello", "en", []), (None, "x", "en", []), ("c", None, "en", None), ("d", "text", "en", [sp("THING", 0, 2)])], schema)
    got = {(r["id"], r["issue"]) for r in records.validate(df).collect()}
    assert got == {("a", "repeated id"), ("a", "offsets out of the text"), ("a", "overlapping gold"), (None, "missing id"), ("c", "missing text"), ("d", "label outside the taxonomy")}


def test_empty_tables(spark):
    rec = spark.createDataFrame([], f"id string, text string, language string, gold_spans {S.SPANS.simpleString()}")
    pred = spark.createDataFrame([], "id string, detector string, start int, end int, label string")
    assert records.gold_long(rec).count() == 0 and voting.pool(pred).count() == 0 and records.validate(rec).count() == 0


def test_silver(spark):
    rec = spark.createDataFrame([("1", "Ann met Bo Lee", "en"), ("2", "nobody", "en"), ("3", None, "en")], "id string, text string, language string")
    say = lambda *pairs: models.stub_client(lambda p: [{"value": v, "label": x} for v, x in pairs if v in p or v == "ghost"])
    labelers = {"a": say(("Ann", "PERSON"), ("Bo Lee", "PERSON"), ("ghost", "PERSON")), "b": say(("Ann", "PERSON"), ("Lee", "PERSON")), "c": say(("Ann", "PERSON"))}
    got, rows = silver.generate(rec, labelers)
    spans = {r["id"]: [(s["start"], s["end"], s["label"]) for s in r["gold_spans"]] for r in got.collect()}
    # "Bo Lee" and "Lee" agree (IoU 0.5); of the two the longer one is kept
    assert spans == {"1": [(0, 3, "PERSON"), (8, 14, "PERSON")], "2": [], "3": []}
    n = {r["detector"]: r for r in silver.counters(rows).collect()}
    assert n["a"]["n_dropped"] == 2 and n["a"]["n_errors"] == 0 and silver.failed(rows).count() == 0
    broken = silver.generate(rec, {"x": models.stub_client(lambda p: 1 / 0)})[1]
    assert [r["id"] for r in silver.failed(broken).orderBy("id").collect()] == ["1", "2"]
    with pytest.raises(ValueError):
        silver.check_labels(["NOPE"])
    gold = rec.withColumn("gold_spans", F.expr(f"cast(array(named_struct('label','PERSON','fine_label','PERSON','raw_label','p','start',0,'end',3,'text','Ann')) as {S.SPANS.simpleString()})")).where("id = '1'")
    best = silver.calibrate(gold, rows).where("schema = 'strict' and view = 'raw' and detector = 'c'").first()
    assert best["f1"] == 1.0


def test_long_texts_are_labelled_in_pieces(spark):
    names = [f"Name{i:03d}" for i in range(60)]
    text = "\n".join(f"{n} wrote a line of some length about it" for n in names)
    shown = []

    def rule(prompt):
        body = prompt.split("Text:\n", 1)[1]
        shown.append(len(body))
        return [{"value": n, "label": "PERSON"} for n in names if n[:5] in body]

    client = models.stub_client(rule, limit=700)()
    kept, dropped = silver.label_text(client, text, ["PERSON"], max_chars=900, min_split=50)
    assert [text[f.start : f.end] for f in kept] == names and max(shown) <= 700
    assert not [d for d in dropped if d["reason"] != "not_found"]
    with pytest.raises(models.CallFailed):
        silver.label_text(models.stub_client(rule, limit=80)(), text, ["PERSON"], max_chars=900, min_split=200)
    assert silver.label_text(client, " \n", ["PERSON"]) == ([], []) and silver.pieces("abc", 10) == [(0, 3)]
    assert silver.cut_at_edge("see Ann Lee now", (0, 7), "Ann Lee") and not silver.cut_at_edge("see Ann Lee now", (0, 11), "Ann Lee")
    other = lambda: lambda p: models.Answer("[]", fallback="small")
    row = silver.counters(silver.label_records(spark.createDataFrame([("1", "x")], "id string, text string"), "a", other)).first()
    assert (row["n_fallback"], row["n_errors"]) == (1, 0)
    assert models.remote_allowed(None) and not models.remote_allowed("perhaps")
    with pytest.raises(PermissionError):
        models.guarded(other, True, "off")


def test_contexts_pin_places():
    doc = Located("Ann met Bo. Then Ann left, said Annabel; ANN too")
    cut = lambda items, mode: [(f.start, f.label) for f in sorted(assign(doc, items, None, mode)[0])]
    ann = {"value": "Ann", "label": "PERSON"}
    assert cut([ann | {"context": "Then Ann left"}], "all") == [(17, "PERSON")]
    assert cut([ann], "all") == [(0, "PERSON"), (17, "PERSON")]
    assert cut([ann, ann | {"context": "Ann met"}], "listed") == [(0, "PERSON"), (17, "PERSON")]
    assert assign(doc, [ann, ann, ann], None, "listed")[1] == [(2, "over_listed")]
    assert assign(doc, [{"value": " ", "label": "PERSON"}, {"value": "Ann", "label": "NOPE"}, {"value": "Zed", "label": "PERSON"}])[1] == [(0, "empty"), (1, "label"), (2, "not_found")]
    assert [p[:2] for p in doc.find("annabel")] == [(32, 39)] and doc.find("ANN")[0].start == 41
    nfd = Located("Zoe\u0308 und Rene\u0301e")
    assert [p[:2] for p in nfd.find("Zo\u00eb")] == [(0, 4)] and [p[:2] for p in nfd.find("Ren\u00e9e")] == [(9, 15)]
    assert [p[:2] for p in Located("x a  b").find("a b")] == [(2, 6)] and Located("王小明在").find("小明")[0].start == 1
    kept, lost = without_overlaps([Found(0, 5, "A", 0, 0, False), Found(0, 5, "B", 1, 0, True), Found(3, 4, "A", 2, 0, True), Found(0, 5, "B", 3, 0, True)], 9)
    assert [f.label for f in kept] == ["B"] and len(lost) == 2


def test_answer_misses(spark):
    located = spark.createDataFrame([("r", 0, 3, "PERSON", None), ("r", 0, 3, "PERSON", None), ("r", 5, 7, "EMAIL", None), ("r", 9, 12, "PHONE", None), ("r", None, None, "DATE", "not_found")], "id string, start int, end int, label string, reason string")
    seen = spark.createDataFrame([("r", 0, 4, "correct"), ("r", 5, 7, "not_pii"), ("s", 0, 5, "correct"), ("s", 3, 12, "boundary"), ("u", 0, 9, "unjudged"), ("v", 0, 9, "boundary")], "id string, start int, end int, verdict string")
    more = spark.createDataFrame([("s", 10, 14, "EMAIL", None), ("u", 0, 9, "EMAIL", None), ("v", 8, 12, "EMAIL", None)], located.schema)
    kinds = {r["id"]: r["kind"] for r in review.answer_misses(more, seen).collect()}
    assert kinds == {"s": "missed", "u": "missed", "v": "dropped"}  # an over-long span of another entity covers nothing
    got = {(r["label"], r["kind"], r["reason"]) for r in review.answer_misses(located, seen).collect()}
    assert got == {("PERSON", "dropped", "covered_by_candidate"), ("EMAIL", "dropped", "judged_not_pii"), ("PHONE", "missed", None), ("DATE", "dropped", "not_found")}
