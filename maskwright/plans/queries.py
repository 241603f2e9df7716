"""Named queries over the test tables: one or more per operator of the inventory. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import spans as S
from maskwright.functions import taxonomy as X
from maskwright.operators import detect, documents, judge, locate, records, report, review, scoring, search, segments, transforms, voting
from maskwright.session import cut_lineage, shared_folder
from maskwright.sources import readers, store
from maskwright.streaming.detect import latency_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


class Run:
    """The tables most queries start from."""

    def __init__(self, spark: SparkSession, d: str, level: str = "coarse") -> None:
        self.level = level
        self.fixtures = t(spark, d, "fixtures")
        self.predictions = t(spark, d, "predictions")
        self.texts = self.fixtures.select("id", "text").distinct()
        self.records = records.distinct_records(self.fixtures)
        self.latest = records.latest_predictions(self.predictions)
        self.answered = scoring.answered(self.records, self.latest, level)
        self.gold = records.gold_long(self.records, level)
        known = self.records.select("id").distinct()
        self.calls = self.latest.where("error is null").select("id", "detector").join(known, "id", "left_semi")
        self.pred = records.predicted_long(self.latest, level).join(known, "id", "left_semi")
        self.inside = records.inside_text(records.predicted_long(self.latest, level), self.records)

    def outcomes(self, labels: list[str] | None = None) -> DataFrame:
        return scoring.outcomes(self.answered, scoring.scopes(self.records, self.predictions, self.level, labels))


# scans, counts, coverage, latency ------------------------------------------------------------------------------------


@query
def coverage(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    return records.coverage(run.records, run.latest)


@query
def span_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.span_counts(Run(spark, d).latest)


@query
def gold_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.label_counts(Run(spark, d).records)


@query
def language_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.language_counts(Run(spark, d).records)


@query
def raw_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.raw_label_counts(Run(spark, d).latest)


@query
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return records.latency_summary(records.without_repeats(t(spark, d, "predictions"), "detector", "latency_ms", "error"))


@query
def latency_by_window(spark: SparkSession, d: str) -> DataFrame:
    return latency_windows(t(spark, d, "predictions"), "1 day")


@query
def run_rows(spark: SparkSession, d: str) -> DataFrame:
    """Manifests joined to their result rows: what each run really holds."""
    calls = records.without_repeats(t(spark, d, "predictions"), "run_id", "detector").groupBy("run_id", "detector").agg(F.count(F.lit(1)).alias("n_rows"))
    listed = t(spark, d, "runs").select("run_id", "dataset", "n_examples", F.explode("detectors").alias("detector"))
    return listed.join(calls, ["run_id", "detector"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


@query
def unlisted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Result rows of detectors that their run's manifest does not list."""
    listed = t(spark, d, "runs").select("run_id", F.explode("detectors").alias("detector"))
    return t(spark, d, "predictions").select("id", "run_id", "detector").distinct().join(listed, ["run_id", "detector"], "left_anti").groupBy("run_id", "detector").agg(F.count(F.lit(1)).alias("n"))


@query
def reuse_missing(spark: SparkSession, d: str) -> DataFrame:
    """How many known records each detector has no row for; detectors that lack none are left out."""
    run = Run(spark, d)
    ids = run.records.select("id").distinct()
    have = run.latest.join(ids, "id", "left_semi").groupBy("detector").agg(F.count(F.lit(1)).alias("have"))
    return have.withColumn("n", ids.agg(F.count(F.lit(1))).scalar()).select("detector", (F.col("n") - F.col("have")).alias("missing")).where("missing > 0")


@query
def gold_dropped(spark: SparkSession, d: str) -> DataFrame:
    return records.gold_dropped(Run(spark, d).records)


@query
def validate_fixtures(spark: SparkSession, d: str) -> DataFrame:
    return records.validate(t(spark, d, "fixtures"))


@query
def sample_records(spark: SparkSession, d: str) -> DataFrame:
    return records.sample(Run(spark, d).records.select("id").distinct(), 100)


@query
def holdout(spark: SparkSession, d: str) -> DataFrame:
    return records.holdout_split(Run(spark, d).records.select("id").distinct(), 0.3)


@query
def baseline_hashes(spark: SparkSession, d: str) -> DataFrame:
    return records.baseline(t(spark, d, "fixtures"))


@query
def baseline_guard(spark: SparkSession, d: str) -> DataFrame:
    """The records against a baseline of their documents' own first chunks."""
    whole = t(spark, d, "documents").select(F.concat("file_id", F.lit("#0")).alias("id"), F.sha1("text").alias("text_sha1"))
    return records.baseline_covers(whole, t(spark, d, "fixtures"))


@query
def annotated_labels(spark: SparkSession, d: str) -> DataFrame:
    """Observed labels of both sides with their place in the taxonomy."""
    run = Run(spark, d, "fine")
    both = run.gold.select("label", F.lit("gold").alias("side")).distinct().unionByName(run.pred.select("label", F.lit("pred").alias("side")).distinct())
    return both.withColumn("parent", X.parent_col(F.col("label")))


# reading and writing: each table goes out in a format and comes back through its reader ------------------------------


def _seen(rows: DataFrame) -> DataFrame:
    """What came back of labelled records."""
    return rows.select("id", F.sha1("text").alias("text_sha1"), F.size("gold_spans").alias("n_spans"), F.aggregate("gold_spans", F.lit(0), lambda n, s: n + s["start"] + s["end"]).alias("places"))


@query
def io_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Fixtures as JSON lines under other key names, read by the span loader: unknown labels and spans out of the text are dropped."""
    span = lambda s: F.struct(s["label"].alias("kind"), s["start"].alias("begin"), s["end"].alias("stop"))
    rows = t(spark, d, "fixtures").select(F.col("id").alias("uid"), F.col("text").alias("body"), F.col("language").alias("lang"), F.transform("gold_spans", span).alias("pii"))
    path = shared_folder(spark, "fixtures.jsonl")
    store.write_jsonl(rows, path)
    back = readers.spans_dataset(readers.read_raw(spark, path, "jsonl", "uid string, body string, lang string, pii array<struct<kind:string,begin:int,stop:int>>"), "canonical")
    return _seen(back).join(back.select("id", "language").distinct(), "id").distinct()


@query
def io_parquet(spark: SparkSession, d: str) -> DataFrame:
    """Fixtures as a privacy mask in Parquet."""
    span = lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("value"))
    rows = t(spark, d, "fixtures").select("id", F.col("text").alias("source_text"), "language", F.transform("gold_spans", span).alias("privacy_mask"))
    path = shared_folder(spark, "masks.parquet")
    rows.write.mode("overwrite").parquet(path)
    return _seen(readers.privacy_mask_dataset(readers.read_raw(spark, path), "canonical")).distinct()


@query
def io_csv_spans(spark: SparkSession, d: str) -> DataFrame:
    """Fixtures as CSV with a JSON column of spans."""
    span = lambda s: F.struct(s["label"].alias("type"), s["start"].alias("start_char"), s["end"].alias("end_char"))
    rows = t(spark, d, "fixtures").where("text <> ''").select("id", "text", F.to_json(F.transform("gold_spans", span)).alias("spans"))
    path = shared_folder(spark, "records.csv")
    rows.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n")
    return _seen(readers.csv_dataset(spark, path, "canonical")).distinct()


@query
def io_bio(spark: SparkSession, d: str) -> DataFrame:
    """Requests as token and tag lists: words with an at-sign are tagged, neighbouring ones are one span."""
    words = F.regexp_extract_all("text", F.lit("[^ \\t\\n\\r]+"), F.lit(0))
    rows = t(spark, d, "requests").where("text is not null").select(F.col("request_id").cast("string").alias("id"), words.alias("tokens"))
    tags = F.transform("tokens", lambda w: F.when(F.contains(w, F.lit("@")), "I-EMAIL").otherwise("O"))
    return _seen(readers.bio_dataset(rows.withColumn("tags", tags), "canonical"))


@query
def io_texts(spark: SparkSession, d: str) -> DataFrame:
    """Request texts in order as numbered records; blank ones are left out but keep their number."""
    rows = readers.from_texts(t(spark, d, "requests").select("request_id", "text"), order_col="request_id", language="en")
    return rows.select("id", F.sha1("text").alias("text_sha1"), "language")


@query
def io_run(spark: SparkSession, d: str) -> DataFrame:
    """Predictions as a run folder, one part per detector: rows and spans that come back of two of them."""
    path = shared_folder(spark, "run")
    latest = Run(spark, d).latest
    latest.write.mode("overwrite").partitionBy("detector").parquet(path)
    back = spark.read.parquet(path).where(F.col("detector").isin("ner_small", "lex_scan"))
    return back.groupBy("detector").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size("spans"), F.lit(0)).cast("bigint")).alias("n_spans"))


@query
def taxonomy_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every label with its parent."""
    return X.labels_table(spark)


@query
def supported_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels each detector's vocabulary supports, as coarse ones and as they are."""
    names = scoring.names_of(t(spark, d, "predictions"), "detector")
    rows = [(n, x, X.parent(x)) for n in [*names, "ensemble_all"] for x in X.supported_labels(n)]
    return spark.createDataFrame(rows, "detector string, label string, parent string")


@query
def request_types(spark: SparkSession, d: str) -> DataFrame:
    """Raw labels to ask a vocabulary for, restricted to three target labels, in the vocabulary's order; and their coarse view."""
    view = X.coarse_view("rules")
    rows = [(i, raw, view[raw]) for i, raw in enumerate(X.prompts_for("rules", ["EMAIL", "PHONE", "URL"]), 1)]
    return spark.createDataFrame(rows, "place bigint, raw_label string, label string")


# scoring ------------------------------------------------------------------------------------------------------------


@query
def semeval_overall(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.score(Run(spark, d).outcomes(), ["view", "detector"]))


@query
def semeval_by_label(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.score(Run(spark, d).outcomes(), ["view", "detector", "tag"]))


@query
def semeval_by_language(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    lang = run.records.groupBy("id").agg(F.min(X.normalize_language(F.col("language"))).alias("language"))
    return _rounded(scoring.score(run.outcomes().join(lang, "id"), ["view", "detector", "language"]))


@query
def semeval_fine(spark: SparkSession, d: str) -> DataFrame:
    """Fine level: fine labels survive under parents where the gold side and the detector's vocabulary both have them, else the parent counts."""
    return _rounded(scoring.score(Run(spark, d, "fine").outcomes(), ["view", "detector"]))


@query
def semeval_fine_by_label(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.score(Run(spark, d, "fine").outcomes(), ["view", "detector", "tag"]))


@query
def semeval_of_labels(spark: SparkSession, d: str) -> DataFrame:
    """Scores on a given label set, which overrides both views; records of one language."""
    run = Run(spark, d)
    german = run.records.where(X.normalize_language(F.col("language")) == "de").select("id").distinct()
    return _rounded(scoring.score(run.outcomes(["PERSON", "EMAIL"]).join(german, "id", "left_semi"), ["view", "detector"]))


@query
def scope_labels(spark: SparkSession, d: str) -> DataFrame:
    """What each detector is scored on at the fine level, in either view."""
    run = Run(spark, d, "fine")
    rows = scoring.scopes(run.records, run.predictions, "fine")
    return rows.select("view", "detector", F.explode("project").alias("src_label", "label"))


@query
def headline(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.headline(scoring.score(Run(spark, d).outcomes(), ["view", "detector"]))
    return rows.select("view", "detector", *[F.round(c, 6).alias(c) for c in rows.columns[2:]])


@query
def per_label_f1(spark: SparkSession, d: str) -> DataFrame:
    """Type F1 of every coarse label per detector, 0.0 where a label has none."""
    rows = scoring.score(Run(spark, d).outcomes(), ["view", "detector", "tag"]).where("view = 'raw' and schema = 'ent_type'")
    return rows.groupBy("detector").pivot("tag", list(X.COARSE)).agg(F.round(F.max("f1"), 6)).fillna(0.0)


@query
def headline_order(spark: SparkSession, d: str) -> DataFrame:
    """Detectors of the fair view from the best to the worst type F1."""
    rows = scoring.headline(scoring.score(Run(spark, d).outcomes(), ["view", "detector"])).where("view = 'fair'")
    return report.ranked(rows.select("detector", F.round("f1_ent_type", 6).alias("f1")), "f1", "detector")


def _rounded(scores: DataFrame) -> DataFrame:
    keep = [c for c in scores.columns if c not in ("precision", "recall", "f1")]
    return scores.select(*keep, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def _errors(spark: SparkSession, d: str, kind: str) -> DataFrame:
    run = Run(spark, d)
    return scoring.errors(run.answered, run.texts, kind)


@query
def errors_missed(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d, "missed")


@query
def errors_spurious(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d, "spurious")


@query
def errors_mislabeled(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d, "mislabeled")


@query
def errors_boundary(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d, "boundary")


@query
def errors_missed_of_label(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    return scoring.errors(run.answered, run.texts, "missed", labels=["PHONE"])


@query
def greedy_prf(spark: SparkSession, d: str) -> DataFrame:
    return _few(scoring.greedy_matches(Run(spark, d).answered))


@query
def greedy_exact(spark: SparkSession, d: str) -> DataFrame:
    return _few(scoring.greedy_matches(Run(spark, d).answered, 1.0))


# pooling, voting, ensembles -----------------------------------------------------------------------------------------


@query
def pooled_spans(spark: SparkSession, d: str) -> DataFrame:
    p = voting.pool(Run(spark, d).inside)
    return p.select("id", "start", "end", "label", F.array_join("detectors", ",").alias("detectors"), "n")


@query
def pooled_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record with the size of its pool."""
    run = Run(spark, d)
    return voting.pool_records(run.inside, run.records).select("id", F.size("spans").alias("n_spans"))


@query
def pooled_fine(spark: SparkSession, d: str) -> DataFrame:
    return voting.pool_fine(Run(spark, d).latest).select("id", "start", "end", "label", "fine_label", "n")


@query
def detector_agreement(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    rows = voting.agreement(run.latest, run.calls)
    return rows.select("a", "b", "records", "n_a", "n_b", "same", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def merge_union(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    return voting.merge_votes(run.pred, run.calls, "union")


@query
def merge_majority(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    return voting.merge_votes(run.pred, run.calls, "majority")


@query
def merge_intersection(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    return voting.merge_votes(run.pred, run.calls, "intersection")


@query
def silver_spans(spark: SparkSession, d: str) -> DataFrame:
    """Majority merge with overlaps resolved greedily."""
    run = Run(spark, d)
    return voting.resolve_overlaps(voting.merge_votes(run.pred, run.calls, "majority"))


@query
def silver_fine(spark: SparkSession, d: str) -> DataFrame:
    """Majority merge with the fine label most of the agreeing detectors give."""
    run = Run(spark, d)
    return voting.merge_fine(run.latest, voting.merge_votes(run.pred, run.calls, "majority")).select("id", "start", "end", "label", "fine_label", "votes")


def _label_scores(run: Run) -> DataFrame:
    return scoring.score(run.outcomes(), ["view", "detector", "tag"]).where("view = 'fair'")


@query
def recipe(spark: SparkSession, d: str) -> DataFrame:
    return voting.recipe(_label_scores(Run(spark, d))).select("label", "detector", F.round("f1", 6).alias("f1"))


@query
def recipe_candidates(spark: SparkSession, d: str) -> DataFrame:
    return voting.top_candidates(_label_scores(Run(spark, d))).select("label", "place", "detector", F.round("f1", 6).alias("f1"))


@query
def ensemble_spans(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    return voting.apply_recipe(run.pred, voting.recipe(_label_scores(run)))


@query
def ensemble_calls(spark: SparkSession, d: str) -> DataFrame:
    """One row per record of the composite detector."""
    run = Run(spark, d)
    chosen = cut_lineage(voting.recipe(_label_scores(run)))
    rows = voting.ensemble_calls(run.latest, voting.apply_recipe(run.pred, chosen), chosen, run.records)
    return rows.select("id", "detector", F.size("spans").alias("n_spans"), F.round("latency_ms", 3).alias("latency_ms"), "error")


@query
def skipped_labels(spark: SparkSession, d: str) -> DataFrame:
    """Annotated labels that no detector of the recipe finds."""
    run = Run(spark, d)
    gold = run.gold.select("label").distinct()
    return gold.join(voting.recipe(_label_scores(run)).select("label"), "label", "left_anti")


@query
def raw_label_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    raw = run.latest.where("error is null").select("id", "detector", F.explode("spans").alias("p")).select("id", "detector", "p.raw_label", "p.label", "p.start", "p.end")
    return voting.hit_rate(raw, run.gold)


@query
def label_redundancy(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d, "fine")
    return voting.redundancy(run.pred, run.gold)


# rewriting ----------------------------------------------------------------------------------------------------------


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return t(spark, d, "requests"), transforms.spans_by_request(t(spark, d, "detected_spans"))


def _rewritten(spark: SparkSession, d: str, mode: str) -> DataFrame:
    requests, spans = _requests(spark, d)
    return transforms.rewrite(requests.join(spans, "request_id", "left"), "spans", mode=mode).select("request_id", "replaced_text")


@query
def replace_redact(spark: SparkSession, d: str) -> DataFrame:
    return _rewritten(spark, d, "redact")


@query
def replace_label(spark: SparkSession, d: str) -> DataFrame:
    return _rewritten(spark, d, "label")


@query
def replace_label_number(spark: SparkSession, d: str) -> DataFrame:
    return _rewritten(spark, d, "label_number")


@query
def replace_label_token(spark: SparkSession, d: str) -> DataFrame:
    return _rewritten(spark, d, "label_token")


@query
def render_modes(spark: SparkSession, d: str) -> DataFrame:
    requests, spans = _requests(spark, d)
    return transforms.render_modes(requests.join(spans, "request_id", "left"), "spans").select("request_id", "plain", *transforms.MODES)


@query
def service_find(spark: SparkSession, d: str) -> DataFrame:
    found = transforms.find(*_requests(spark, d))
    return found.select("request_id", F.explode_outer("by_label").alias("label", "n"), "span_count").withColumn("n", F.coalesce("n", F.lit(0)))


@query
def service_replace(spark: SparkSession, d: str) -> DataFrame:
    return transforms.replace(*_requests(spark, d)).select("request_id", "replaced_text")


@query
def service_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans of the requests of every mode; an unknown mode counts as label."""
    rows = transforms.replace(*_requests(spark, d))
    return rows.select("request_id", F.explode("detected_spans").alias("s")).select("request_id", "s.label", "s.start", "s.end", "s.text", "s.replacement", "s.replaced")


@query
def service_problems(spark: SparkSession, d: str) -> DataFrame:
    """Requests that ask for a mode or a category the service does not know."""
    return transforms.problems(t(spark, d, "requests"))


@query
def replace_with_vault(spark: SparkSession, d: str) -> DataFrame:
    """Tokens from a table of the distinct values, in place of the digest on the spot; addresses have no column in the vault."""
    requests, spans = _requests(spark, d)
    j = requests.join(spans, "request_id", "left").select("request_id", "text", "spans")
    values = j.select("text", F.explode(transforms.clean_spans(F.col("spans"), F.col("text"))).alias("s")).select("s.label", S.slice_text(F.col("text"), F.col("s.start"), F.col("s.end")).alias("text"))
    return transforms.rewrite_with_vault(j, "spans", transforms.vault_tokens(values, [x for x in X.ALL_LABELS if x != "ADDRESS"]))


@query
def token_collisions(spark: SparkSession, d: str) -> DataFrame:
    return transforms.token_collisions(t(spark, d, "detected_spans").select("label", "text"))


@query
def detect_rules(spark: SparkSession, d: str) -> DataFrame:
    """Spans of all rules with offsets, long form."""
    found = detect.detect_rules(t(spark, d, "requests").where("text is not null"))
    return found.select("request_id", F.explode("spans").alias("s")).select("request_id", "s.label", "s.start", "s.end", "s.text")


@query
def trimmed_spans(spark: SparkSession, d: str) -> DataFrame:
    """The service's spans without white space and punctuation at their ends."""
    rows = t(spark, d, "detected_spans").select("request_id", "start", "end").distinct().join(t(spark, d, "requests").select("request_id", "text"), "request_id")
    inside = rows.where(S.in_bounds(F.col("start"), F.col("end"), F.col("text")))
    cut = detect.trim_boundaries(F.col("text"), F.col("start"), F.col("end"))
    return inside.withColumn("t", cut).select("request_id", "start", "end", F.col("t.start").alias("trimmed_start"), F.col("t.end").alias("trimmed_end"))


@query
def routed_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language each record's model is asked in, of five supported ones."""
    lang = detect.route_by_language(F.col("language"), ["en", "de", "fr", "es", "it"])
    return t(spark, d, "fixtures").groupBy(lang.alias("asked_in")).agg(F.count(F.lit(1)).alias("n"))


@query
def detect_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two registered rule detectors over the requests: spans per detector and label."""
    rows = detect.detect_all(t(spark, d, "requests"), ["regex_strict", "regex_loose"], key_col="request_id")
    return rows.select("detector", F.explode("spans").alias("s")).groupBy("detector", F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query
def masked_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Thirty code points around every span within the bounds of its request, with spans masked: one row per request, start, end and label."""
    requests, spans = _requests(spark, d)
    j = requests.select("request_id", "text").join(spans, "request_id").withColumn("spans", transforms.clean_spans(F.col("spans"), F.col("text")))
    j = j.withColumn("f", F.explode("spans"))
    lo, hi = F.greatest(F.col("f.start") - 30, F.lit(0)), F.least(F.col("f.end") + 30, F.length("text"))
    out = transforms.mask(j, "spans", lo, hi)
    return out.select("request_id", "f.start", "f.end", "f.label", "masked", S.nothing_left(F.col("masked")).alias("nothing_left"))


# documents ----------------------------------------------------------------------------------------------------------


@query
def line_segments(spark: SparkSession, d: str) -> DataFrame:
    return documents.line_segments(t(spark, d, "documents"))


@query
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = documents.chunks(t(spark, d, "documents"))
    return rows.select("doc_id", "k", "offset", F.length("text").alias("n_chars"))


@query
def chunk_properties(spark: SparkSession, d: str) -> DataFrame:
    """Per document with a text: no chunk is longer than allowed, and no segment that fits is cut."""
    docs = t(spark, d, "documents")
    cut = documents.chunks(docs).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("offset").alias("start"), (F.col("offset") + F.length("text")).alias("end"))).alias("c"))
    j = cut.join(docs.select("doc_id", "segments"), "doc_id")
    fits = F.filter(F.coalesce("segments", F.array()), lambda s: (s["end"] - s["start"] <= 4000) & (s["start"] < s["end"]))
    return j.select(
        "doc_id", F.forall("c", lambda c: c["end"] - c["start"] <= 4000).alias("within_limit"),
        F.forall(fits, lambda s: F.exists("c", lambda c: (c["start"] <= s["start"]) & (s["end"] <= c["end"]))).alias("uncut"))


@query
def documents_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    back = documents.rebuild(documents.chunks(t(spark, d, "documents")))
    return back.select("doc_id", F.sha1("text").alias("text_sha1"), "complete")


@query
def document_map(spark: SparkSession, d: str) -> DataFrame:
    return documents.document_map(t(spark, d, "fixtures"))


@query
def spans_in_documents(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    return documents.chunk_spans_to_documents(t(spark, d, "fixtures"), run.gold, t(spark, d, "documents").where("text is not null"))


@query
def span_places(spark: SparkSession, d: str) -> DataFrame:
    """Every segment a gold span touches, with its place written out, in document order."""
    run = Run(spark, d)
    return documents.span_places(t(spark, d, "fixtures"), run.gold, t(spark, d, "documents").where("text is not null"))


@query
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return documents.interval_union(Run(spark, d).pred, ["id"])


@query
def segment_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Segments per kind of document and key of their location."""
    rows = t(spark, d, "documents").select("kind", F.explode("segments").alias("s"))
    return rows.select("kind", F.explode(F.map_keys("s.where")).alias("place")).groupBy("kind", "place").agg(F.count(F.lit(1)).alias("n"))


@query
def located_items(spark: SparkSession, d: str) -> DataFrame:
    """The service's values looked up again in their texts by the tiers of the labeler."""
    items = t(spark, d, "detected_spans").distinct().groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("span_id", F.col("text").alias("value"), "label"))).alias("items"))
    items = items.withColumn("items", F.transform("items", lambda i: F.struct(i["value"].alias("value"), i["label"].alias("label"))))
    return locate.locate(t(spark, d, "requests").join(items, "request_id"), "request_id")


# reviews ------------------------------------------------------------------------------------------------------------


def _reviewed(run: Run) -> tuple[DataFrame, DataFrame]:
    pooled = cut_lineage(voting.pool(run.inside))  # identical spans once; both sides of a review read it
    return review.judge_from_gold(pooled, run.gold), review.missed_from_gold(pooled, run.gold)


@query
def review_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return review.verdict_counts(_reviewed(Run(spark, d))[0])


@query
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    reviewed, missed = _reviewed(run)
    return _few(review.summarize(cut_lineage(reviewed), missed, run.calls))  # the summary reads the verdicts twice


@query
def review_entities(spark: SparkSession, d: str) -> DataFrame:
    """How many entities the reviewed spans form, by the number of spans in them."""
    rows = review.entities(_reviewed(Run(spark, d))[0])
    return rows.groupBy("id", "entity").agg(F.count(F.lit(1)).alias("spans")).groupBy("spans").agg(F.count(F.lit(1)).alias("n"))


@query
def review_disagreements(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    return review.disagreements(*_reviewed(run), run.texts)


@query
def review_missed(spark: SparkSession, d: str) -> DataFrame:
    return _reviewed(Run(spark, d))[1].select("id", "start", "end", "label")


@query
def classifier_summary(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    return _few(review.classifier_summary(review.classifier_rows(voting.pool(run.inside), run.gold)))


@query
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    return _few(review.threshold_sweep(review.classifier_rows(voting.pool(run.inside), run.gold), run.gold, [0.1, 0.3, 0.5, 0.7, 0.9]))


def _few(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in rows.schema.fields])


@query
def residual_rate(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d)
    return _few(review.residual_rate(run.records, run.pred, run.gold, run.calls))


def _segments(run: Run) -> DataFrame:
    return segments.segments(segments.calls_by_record(run.answered, run.texts))


@query
def residual_segments(spark: SparkSession, d: str) -> DataFrame:
    """Per detector: segments left after masking, trivial ones and those that still hold a gold span."""
    run = Run(spark, d)
    marked = segments.residual_segments(_segments(run), run.gold, run.pred)
    return marked.groupBy("detector").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("trivial").alias("trivial"), F.count_if("residual").alias("residual"))


@query
def segment_properties(spark: SparkSession, d: str) -> DataFrame:
    """Per record: no segment is longer than allowed unless a span is, none overlaps another, none cuts a detector's span, and all letters and digits lie in one."""
    run = Run(spark, d)
    own = segments.calls_by_record(run.answered, run.texts)
    first = segments.segments(own).groupBy("id", "detector").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s")).groupBy("id").agg(F.min("s").alias("s"))
    j = first.join(own, "id").withColumn("spans", F.flatten(F.transform("calls", lambda c: c["spans"])))
    s = F.col("s")
    inside = F.aggregate(F.transform(s, lambda x: S.slice_text(F.col("text"), x["start"], x["end"])), F.lit(0), lambda n, x: n + F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")))
    seen = lambda a, b: S.slice_text(F.col("text"), a, b).rlike(r"\S")  # noqa: E731 - white space at the ends is trimmed, not cut
    cuts = lambda p: F.exists(s, lambda x: ((p["start"] < x["start"]) & (x["start"] < p["end"]) & seen(p["start"], x["start"]))
                              | ((p["start"] < x["end"]) & (x["end"] < p["end"]) & seen(x["end"], p["end"])))
    return j.select(
        "id", F.forall(F.transform(s, lambda x, i: (i == 0) | (x["start"] >= F.get(s, i - 1)["end"])), lambda ok: ok).alias("in_order"),
        (~F.exists("spans", cuts)).alias("uncut"), (inside == F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))).alias("covered"))


def _pooled_texts(run: Run) -> DataFrame:
    return voting.pool_records(run.inside, run.records).join(run.texts, "id")


def _at_sign(candidate: dict) -> str:
    """A judge by rule for the test tables: e-mail addresses have an at-sign, phone numbers and accounts a digit."""
    need = {"EMAIL": "@", "PHONE": "0123456789", "ACCOUNT": "0123456789"}.get(candidate["label"])
    return "correct" if need is None or any(c in candidate["value"] for c in need) else "not_pii"


def _likely(request: dict) -> dict:
    """A classifier by rule for the test tables."""
    text = request["state"]["text"]
    if "residual" in request["questions"]:
        left = any(c.isdigit() for c in text)
        return {"residual": judge.noul(0.8 if left else 0.1), "residual_type": judge.choice({"ACCOUNT": 0.8 if left else 0.1, judge.NONE: 0.2 if left else 0.9})}
    value, label = text.split("[[", 1)[1].split("]]", 1)[0], request["state"]["label"]
    return {
        "is_pii": judge.noul(0.9 if len(value) > 3 else 0.3), "label_ok": judge.noul(0.8 if ("@" in value) == (label == "EMAIL") else 0.2),
        "label": judge.choice({label: 0.9, judge.NOT_PII: 0.1})}


@query
def judge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A judge by rule over the pooled spans of every record: verdicts per label."""
    rows = judge.judge(_pooled_texts(Run(spark, d)), judge.rule_judge(_at_sign, limit=3))
    return rows.where("kind = 'span'").groupBy("label", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query
def judge_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """The reviewer that finds everything correct: what a review would judge."""
    rows = judge.judge(_pooled_texts(Run(spark, d)), judge.dry_run())
    return rows.groupBy("kind", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query
def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall per detector as the judge by rule sees them; it reports every at-sign word that no candidate covers."""
    run = Run(spark, d)
    words = lambda asked: [{"value": w, "label": "EMAIL", "context": None} for w in asked["text"].split() if "@" in w]
    rows = cut_lineage(judge.judge(_pooled_texts(run), judge.rule_judge(_at_sign, words)))
    spans = rows.where("kind = 'span'")
    missed = review.answer_misses(rows.where("kind = 'found'"), spans).where("kind = 'missed'")
    calls = review.without_failed(run.calls, rows.where("kind = 'error'"))
    return _few(review.summarize(spans, missed, calls))


@query
def classifier_spans(spark: SparkSession, d: str) -> DataFrame:
    """A classifier by rule asked about every pooled span: per detector."""
    rows = judge.classify_spans(_pooled_texts(Run(spark, d)), lambda: judge.RuleBackend(_likely))
    return _few(review.classifier_summary(rows.where("error is null")))


@query
def classifier_segments(spark: SparkSession, d: str) -> DataFrame:
    """The same asked about what masking leaves: estimated against true residual rate per detector and threshold."""
    run = Run(spark, d)
    marked = segments.residual_segments(_segments(run), run.gold, run.pred)
    return _few(judge.residual_sweep(judge.classify_segments(marked, lambda: judge.RuleBackend(_likely)), [0.1, 0.5, 0.9]))


@query
def plan_calls(spark: SparkSession, d: str) -> DataFrame:
    return review.plan_calls(Run(spark, d).records)


# search -------------------------------------------------------------------------------------------------------------


@query
def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The texts of all documents whose id is divisible by 20 as queries over all documents."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    q = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.bm25_many(docs, q, 10).select("query_id", "doc_id", F.round("score", 4).alias("score"), "place")


@query
def search_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Held-out prompts as queries over all documents, through the inverted index."""
    q = t(spark, d, "eval_items").select(F.col("prompt").alias("text")).distinct().withColumn("query_id", F.md5("text"))
    return search.bm25(t(spark, d, "documents").select("doc_id", "text"), q, 10).select("query_id", "doc_id", F.round("score", 4).alias("score"), "place")


@query
def search_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Frequency of search words in the rewritten requests."""
    rows = _rewritten(spark, d, "label_number")
    return rows.select(F.explode(search.tokens(F.col("replaced_text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query
def demo_search(spark: SparkSession, d: str) -> DataFrame:
    """The made-up corpus and its two address queries, searched in every rewriting mode: averages of precision and recall."""
    docs, queries = search.demo_corpus(spark)
    both = docs.select("doc_id", "text").unionByName(queries.select((-1 - F.col("query_id")).alias("doc_id"), "text"))
    rows = transforms.render_modes(detect.detect_rules(both, ["email"]), "spans")
    parts = []
    for m in ("plain", *transforms.MODES):
        texts = rows.select("doc_id", F.col(m).alias("text"))
        asked = texts.where("doc_id < 0").select((-1 - F.col("doc_id")).alias("query_id"), "text")
        found = search.bm25(texts.where("doc_id >= 0"), asked, 5)
        parts.append(search.retrieval_quality(found, queries).withColumn("mode", F.lit(m)))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return _few(every.groupBy("mode").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall")))


@query
def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    """Average precision and recall per rewriting mode: the requests whose id is divisible by 20 as queries over all requests,
    both rewritten in that mode. The tables judge no relevance, so relevant are the ten hits of the plain texts."""
    quality, _ = _retrieval(spark, d)
    return _few(quality.groupBy("mode").agg(F.count(F.lit(1)).alias("queries"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall")))


@query
def retrieval_by_query(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of every query in every mode."""
    return _few(_retrieval(spark, d)[0])


def _retrieval(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    requests, spans = _requests(spark, d)
    rows = transforms.render_modes(requests.join(spans, "request_id", "left"), "spans")

    def hits(mode: str) -> DataFrame:
        docs = rows.select(F.col("request_id").alias("doc_id"), F.col(mode).alias("text"))
        return search.bm25_many(docs, docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), 10)

    plain = cut_lineage(hits("plain").select("query_id", "doc_id"))
    relevant = plain.groupBy("query_id").agg(F.collect_set("doc_id").alias("relevant"))
    per = [search.retrieval_quality(plain if m == "plain" else hits(m), relevant).withColumn("mode", F.lit(m)) for m in ("plain", *transforms.MODES)]
    quality = per[0]
    for more in per[1:]:
        quality = quality.unionByName(more)
    return quality, relevant
