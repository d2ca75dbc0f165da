"""Exact values of single operators, on small texts with the features that matter."""

import json
import sys
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provena.functions import spans as S
from provena.operators import audit, baseline, compare, detect, experiment, inspect, normalize, spans, stats, unicode
from provena.plans.catalog import png
from provena.sources import readers, sinks
from provena.streaming import documents

KEY = b"a test key"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(df):
    return df.collect()[0].asDict()


def test_counts_of_null_and_empty(spark):
    got = stats.counts(docs(spark, None, "", "It's 2 o'clock.\n\n \nNext_one")).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 0), (0, 0, 0, 0), (27, 5, 7, 2)]


def test_diversity(spark):
    got = one(stats.lexical_diversity(docs(spark, "a b a c")))
    assert (got["types"], got["type_token_ratio"], got["root_ttr"], got["hapax_legomena"]) == (3, 0.75, 1.5, 2)
    assert one(stats.lexical_diversity(docs(spark, "")))["type_token_ratio"] == 0
    assert one(stats.moving_average_ttr(docs(spark, "x " * 49)))["moving_average_ttr"] is None
    assert one(stats.moving_average_ttr(docs(spark, "x " * 60)))["moving_average_ttr"] == 0.02


def test_ties_go_to_the_first_occurrence(spark):
    got = stats.frequent_words(docs(spark, "d c b a b")).orderBy("rank").collect()
    assert [r.word for r in got] == ["b", "d", "c", "a"]
    assert [(r.size, r.ngram, r.n) for r in stats.repeated_ngrams(docs(spark, "p q p q")).collect()] == [(2, "p q", 2)]


def test_findings(spark):
    text = "ok\nz​x‮y\U000e0041️а "
    got = unicode.findings(docs(spark, text)).orderBy("position").collect()
    assert [r.kind for r in got] == ["zero_width", "bidi_control", "tag_character", "variation_selector", "homoglyph", "unusual_whitespace"]
    assert (got[0].line, got[0].column, got[0].codepoint) == (2, 2, "U+200B")
    assert got[2].codepoint == "U+E0041" and got[4].looks_like == "a" and got[0].looks_like is None
    assert unicode.findings(docs(spark, "​" * 700)).count() == 500


def test_rows_that_repeat_an_id_are_looked_at_one_by_one(spark):
    df = spark.createDataFrame([(1, "a b. c"), (1, "a b. c"), (1, "x\u200by\u200b"), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.word_count, r.sentence_count, r.total_suspicious) for r in baseline.records(df).collect())
    assert got == [(1, 2, 1, 2), (1, 3, 2, 0), (1, 3, 2, 0), (2, 0, 0, 0)]
    assert [(r.doc_id, r.kind, r.n) for r in unicode.kind_counts(df).collect()] == [(1, "zero_width", 2)]
    rows = experiment.controls(df, lambda d: detect.keyed(d, KEY)).collect()
    assert len(rows) == 16 and sorted(r.experiment_id for r in rows) == sorted("ABCD" * 4)
    assert sum(r.chars_changed for r in rows) == 2
    plan = baseline.records(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_findings_say_what_is_left_out(spark):
    got = unicode.findings(docs(spark, "\u200b" * 3 + "\n\u00a0"), most=2).orderBy("position").collect()
    assert [(r.name, r.total_suspicious, r.findings_truncated) for r in got] == [("ZERO WIDTH SPACE", 4, True)] * 2
    assert [(r.line, r.column, r.findings_truncated) for r in unicode.findings(docs(spark, "a\nb\u00a0")).collect()] == [(2, 2, False)]


@pytest.mark.parametrize(
    "mode, before, after",
    [
        ("typographic", "\"Hi,\" she said -- it's 'so' -- no!!", "“Hi,” she said—it’s ‘so’ -- no!"),
        ("keep", "“Hi” – well… no!!! ok .", "“Hi” – well… no! ok ."),
        ("normalized", "it’s “so”", "it's \"so\""),
    ],
)
def test_punctuation_modes(spark, mode, before, after):
    got = one(normalize.transform(docs(spark, before), "punctuation", punctuation=mode, protect=S.protection(quotes=False)))
    assert got["text"] == after and all(e.metadata == {"mode": mode} for e in got["edits"])
    with pytest.raises(ValueError):
        normalize.transform(docs(spark, ""), "punctuation", punctuation="none")


def test_protection(spark):
    text = "see `a!!` and \"b!!\" at https://x.example/c!!"
    of = lambda **k: one(normalize.transform(docs(spark, text), "punctuation", protect=S.protection(**k)))["text"]
    assert of() == "see `a!!` and \"b!!\" at https://x.example/c!"
    assert of(edit_code=True) == "see `a!` and \"b!!\" at https://x.example/c!"
    assert of(quotes=False) == "see `a!!` and \"b!\" at https://x.example/c!"
    with pytest.raises(ValueError):
        S.protection(disabled=["nothing"])


def test_totals(spark):
    got = one(normalize.totals(docs(spark, "One  two!! Three."), "whitespace,punctuation"))
    assert (got["edit_count"], got["changed_characters"], got["edit_distance"], got["changed_words"], got["changed_sentences"]) == (2, 4, 2, 0, 1)
    assert [(s.stage, s.edit_count) for s in got["per_stage"]] == [("whitespace", 1), ("punctuation", 1)]
    log = normalize.edit_log(normalize.transform(docs(spark, "a!!"), "punctuation")).collect()
    assert log[0].deterministic and log[0].metadata == {"mode": "normalized"}


def test_named_corpus_and_blank_queries(spark):
    got = {r.name: r.text for r in readers.named_corpus(spark).collect()}
    assert len(got) == 10 and all(got.values()) and got["long_prose"].count("\n\n") == 4
    assert {k for *_, k in S.protected_spans(got["technical_markdown"])} >= {"url", "email", "inline_code"}
    blank = spark.createDataFrame([(" ", "{}")], "query string, body string")
    assert readers.search_results(blank).count() == 0
    with pytest.raises(Exception, match="must not be blank"):
        readers.search_results(blank, blank_fails=True).collect()


def test_manifest_readers(spark):
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b""))], "path string, content binary")
    assert {r.error for r in inspect.verify(files).collect()} == {"no reader of manifests is installed"}

    def reader():
        return lambda data: {"sdk": "own", "validation_state": "valid", "body": f"{1 / len(data)}"}

    got = {r.path: r for r in inspect.verify(files, reader).collect()}
    assert got["a"].validation_state == "valid" and got["b"].error_type == "ZeroDivisionError"
    with pytest.raises(ValueError):
        detect.make("other")
    with pytest.raises(ValueError):
        detect.make("keyed")


def test_stable_hash(spark):
    x = spark.createDataFrame([("a", 1)], "s string, n int").select(normalize.stable_hash_column("s", "n").alias("h")).first().h
    assert int(x) == normalize.stable_hash("a", 1) == int.from_bytes(__import__("hashlib").sha256(b"a\x1f1").digest()[:8], "big")


@settings(max_examples=200, deadline=None)
@given(st.text("abc é", max_size=40), st.text("abc é", max_size=40))
def test_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    assert compare.levenshtein(a, b) == row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_sentences(spark):
    text = "Dr. Brown paid 3.5 euros. Why? He left! J. Doe stayed\n\nA new start"
    assert [text[a:b] for a, b in S.sentence_spans(text)] == ["Dr. Brown paid 3.5 euros.", "Why?", "He left!", "J. Doe stayed", "A new start"]
    assert one(spans.sentence_lengths(docs(spark, "One two. Three.")))["mean"] == 1.5
    assert one(spans.sentence_lengths(docs(spark, "")))["mean"] is None


def test_protected_items_and_code():
    text = 'See https://a.example/x, mail me@b.org on 2024-05-06: "half of 12%" and `code 7`.'
    got = {(k, text[a:b]) for a, b, k in S.protected_spans(text)}
    assert {("url", "https://a.example/x"), ("email", "me@b.org"), ("date", "2024-05-06"), ("number", "12%"), ("quote", "half of "), ("inline_code", "`code 7`")} <= got
    covered = sorted((a, b) for a, b, _ in S.protected_spans(text))
    assert all(b <= c for (_, b), (c, _) in zip(covered, covered[1:], strict=False))
    assert "".join(text[a:b] for a, b in S.free_ranges(text, S.protected_spans(text))) != text
    fence = "Before\n```python\nx = 1  # note\n```\nafter"
    prose, code, comments = S.code_split(fence)
    assert S.code_blocks(fence)[0][2] == "python" and comments == "# note" and "x = 1" in code and "after" in prose
    assert any(k == "number" for *_, k in S.protected_spans("`7` 8", S.KINDS - S.CODE)) and len(S.protected_spans("`7`", S.KINDS - S.CODE)) == 0


@pytest.mark.parametrize(
    "stages, before, after",
    [
        ("whitespace", "a  b\tc \n  keep\n\n\n\n\nend  ", "a b c\n  keep\n\nend"),
        ("unicode-nfc,strip-invisible", "éa​b", "éab"),
        ("unicode-nfkc", "ﬁn", "fin"),
        ("punctuation", "“Hi” – well… no!!! ok .", "\"Hi\" - well... no! ok ."),
        ("punctuation", "see `a!!` now!!", "see `a!!` now!"),
    ],
)
def test_transform(spark, stages, before, after):
    assert one(normalize.transform(docs(spark, before), stages))["text"] == after


def test_transform_log_and_approval(spark):
    d = docs(spark, "no!! yes!!")
    got = normalize.transform(d, "punctuation")
    log = normalize.edit_log(got).orderBy("start").collect()
    assert [(r.start, r.original, r.replacement, r.edit_distance) for r in log] == [(2, "!!", "!", 1), (8, "!!", "!", 1)]
    some = spark.createDataFrame([(0, 0, 8)], "doc_id long, stage int, start int")
    assert one(normalize.transform(d, "punctuation", some))["text"] == "no!! yes!"
    with pytest.raises(ValueError):
        normalize.transform(d, "lexical")


def test_compare(spark):
    assert compare.levenshtein("kitten", "sitting") == 3 and compare.levenshtein("", "abc") == 3
    long = "\n\n".join(["the same words in each paragraph here"] * 200)
    other = long.replace("words", "terms", 3)
    assert compare.edit_distance(long, other) == 3 * compare.levenshtein("words", "terms")
    assert compare.changed(long, other, S.WORD.findall) == 3
    pairs = spark.createDataFrame([(1, "Same text here.", "Same text here."), (2, "one two three", "four"), (3, "", None)], "pair_id long, before string, after string")
    got = {r.pair_id: r for r in compare.compare(pairs).collect()}
    assert got[1].preservation_score == 1.0 and got[1].strength == "NONE" and got[1].numbers.ratio is None and got[1].numbers["count"] == 0
    assert got[2].strength == "STRONG" and got[3].tfidf_cosine == 1.0
    over = {r.pair_id: r for r in compare.word_overlap(pairs).collect()}
    assert over[1].jaccard == 1 and over[2].cosine == 0 and over[3].jaccard == 1
    assert {r.pair_id: r.char_ngram_cosine for r in compare.char_ngram_cosine(pairs).collect()} == {1: 1.0, 2: 0.0, 3: 1.0}
    with pytest.raises(ValueError):
        compare.Thresholds.parse("nothing=1")
    assert compare.Thresholds.parse("word_light=0.5").word_light == 0.5


def test_keyed_detection(spark):
    d = docs(spark, detect.marked_text(KEY, 1, 400), "too short")
    got = detect.keyed(d, KEY).orderBy("doc_id").collect()
    assert got[0].status == "DETECTED" and got[0].score > 4 and got[0].p_value < 1e-4
    assert got[1].score is None and got[1].status == "UNKNOWN"
    assert detect.keyed(d, b"another").orderBy("doc_id").first().status == "NOT_DETECTED"
    native, python = ({r.doc_id: (r.green, r.scored) for r in f(d, KEY).collect()} for f in (detect.green_counts, detect.keyed_python))
    assert native == python
    few = detect.green_counts(d, KEY, vocabulary=["baran"]).orderBy("doc_id").first()
    assert few.scored < got[0].scored
    with pytest.raises(ValueError):
        detect.green_counts(d, KEY, gamma=1)


def test_other_detectors(spark):
    d = docs(spark, "text")
    assert one(detect.no_detector(d))["status"] == "UNKNOWN" and one(detect.mock(d))["status"] == "UNKNOWN"

    class Plugin:
        def detect(self, text):
            return {"detected": True, "score": 2}

    assert one(detect.external(d, plugin=Plugin))["status"] == "DETECTED"
    code = "import sys,json; sys.stdin.read(); print(json.dumps({'detected': None}))"
    assert one(detect.external(d, command=f'{sys.executable} -c "{code}"'))["status"] == "UNKNOWN"
    with pytest.raises(ValueError):
        detect.external(d)


def test_controls_do_not_move_the_score(spark):
    d = docs(spark, detect.marked_text(KEY, 3, 300) + "  And!!  so​ on…")
    got = experiment.controls(d, lambda x: detect.keyed(x, KEY)).orderBy("experiment_id").collect()
    assert [r.experiment_id for r in got] == list("ABCD") and {r.signal_change for r in got} == {0.0}
    assert got[0].strength == "NONE" and {r.interpretation for r in got} == {"still detected"}
    quiet = experiment.controls(d, detect.mock, is_mock=True).collect()
    assert all(r.watermark_score_before is None and r.detector_is_mock for r in quiet)


def test_inspection(spark):
    files = {"a.png": png(), "b.png": png((b"caBX", b"jumb c2pa")), "c.png": png((b"caBX", b"broken")), "d.jpg": b"\xff\xd8\xff\xe1\x00\x08Exif..\xff\xeb\x00\x0aJPc2pa..\xff\xda", "e": b"", "f.gif": b"GIF89a jumb"}
    got = inspect.classify(inspect.scan(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary"))).collect()
    by = {r.path: r for r in got}
    assert [by[k].format for k in files] == ["png", "png", "png", "jpeg", "unknown", "gif"]
    assert [by[k].status for k in files] == ["ABSENT", "UNVERIFIABLE", "UNVERIFIABLE", "UNVERIFIABLE", "ABSENT", "UNVERIFIABLE"]
    assert by["d.jpg"].exif and by["b.png"].jumbf_boxes[0].has_c2pa_label and not by["c.png"].jumbf_boxes[0].has_c2pa_label
    scanned = inspect.scan(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary"))
    told = spark.createDataFrame([("b.png", "Valid", None), ("c.png", None, "ManifestNotFound")], "path string, validation_state string, error_type string")
    by = {r.path: r.status for r in inspect.classify(scanned, told).collect()}
    assert by["b.png"] == "PRESENT" and by["c.png"] == "INVALID"
    pairs = spark.createDataFrame([("b.png", "a.png")], "before string, after string")
    assert one(inspect.persistence(pairs, scanned))["persists"] is False
    store = {"active_manifest": "m", "manifests": {"m": {"title": "t", "signature_info": {"issuer": "i"}, "assertions": [{"label": "x"}]}}}
    got = one(inspect.manifest_summary(spark.createDataFrame([("p", json.dumps(store))], "path string, body string")))
    assert (got["title"], got["issuer"], got["assertions"], got["manifest_count"]) == ("t", "i", ["x"], 1)


def test_audit(spark, tmp_path):
    (tmp_path / "venv").mkdir()
    (tmp_path / "venv" / "x.py").write_text("import torch\n")
    (tmp_path / "a.py").write_text("import os\nimport torch.nn, json\nfrom jax.numpy import x\nimport torchless\n")
    (tmp_path / "requirements.txt").write_text("numpy\nspacy>=3\n")
    got = audit.audit(audit.read_tree(spark, str(tmp_path)))
    bad = {(r.path, r.line, r.item) for r in got.filter("kind <> 'reference'").collect()}
    assert bad == {("a.py", 2, "torch.nn"), ("a.py", 3, "jax.numpy"), ("requirements.txt", 2, "spacy")}
    assert {r.item: r.n for r in audit.term_counts(got).collect()}["torch"] == 2


def test_search_and_clock(spark):
    body = json.dumps({"answerBox": {"a": 1}, "organic": [{"title": "t", "link": "u", "snippet": "s"}, {"title": "v"}]})
    got = readers.search_results(spark.createDataFrame([(" q ", body), (" ", body), ("r", "{}"), ("x", "no json")], "query string, body string")).orderBy("query", "rank").collect()
    assert [(r.query, r.rank, r.url) for r in got] == [("q", 1, "u"), ("q", 2, None), ("r", None, None), ("x", None, None)]
    assert json.loads(got[0].answer_box) == {"a": 1}
    got = one(readers.clock(spark, F.lit(datetime(2024, 2, 29, 10, 0))))
    assert (got["date"], got["weekday"], got["month"], got["year"]) == ("2024-02-29", "Thursday", "February", 2024)


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("line\nline")
    (tmp_path / "in" / "b.bin").write_bytes(b"\0\1")
    assert one(readers.text_files(spark, str(tmp_path / "in" / "*.txt")))["text"] == "line\nline"
    assert one(readers.binary_files(spark, str(tmp_path / "in"), "*.bin"))["length"] == 2
    df = spark.createDataFrame([("A", None, "x")], "experiment_id string, n int, text string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert "null" in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    sinks.write_json(df, str(tmp_path / "json"))
    sinks.write_texts(df, str(tmp_path / "texts"))
    sinks.write_edit_log(df, str(tmp_path / "log"))
    assert list((tmp_path / "texts").glob("experiment_id=A/*.txt")) and list((tmp_path / "log").glob("experiment_id=A/*.json"))
    page = sinks.report("T <1>", [("S", [("FACT", "a & b")], df)])
    assert "T &lt;1&gt;" in page and "a &amp; b" in page
    with pytest.raises(ValueError):
        sinks.report("t", [("S", [("GUESS", "")], None)])


def test_template_prose_repeats_late(spark):
    texts = [r.text for r in readers.template_prose(spark, 100).collect()]
    lines = [s for t in texts for s in t.split(". ")]
    assert len(texts) == 100 and len({s.rstrip(".") for s in lines}) == 600


def test_stream_equals_batch(spark, tmp_path):
    d = docs(spark, "a b a", "c", None).selectExpr("doc_id", "text", "'en' lang", "'s' source", "0L n_chars")
    d.repartition(2).write.parquet(str(tmp_path / "in"))
    query = documents.run(documents.read_documents(spark, str(tmp_path / "in"), 1), stats.counts, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stats.counts(d).collect()))


def test_windowed_counts(spark):
    e = spark.createDataFrame([(datetime(2024, 1, 1, 1, 5), "a"), (datetime(2024, 1, 1, 1, 50), "a"), (datetime(2024, 1, 1, 2, 0), "a")], "ts timestamp, event_type string")
    assert sorted(r.n for r in documents.windowed_counts(e).collect()) == [1, 2]
