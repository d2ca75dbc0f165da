import json

import pytest

from provena import cli
from provena.operators import baseline, unicode
from provena.sources import readers


def call(spark, capsys, *args):
    code = cli.main(list(map(str, args)))
    return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_commands(spark, capsys, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("One text here. It has 2 sentences!!")
    b.write_text("One text here. It has 3 sentences!!")
    code, got = call(spark, capsys, "analyze", a)
    assert code == 0 and got[0]["word_count"] == 7 and got[0]["lexical_diversity"]["types"] == 7
    assert call(spark, capsys, "unicode", a) == (0, [])
    assert call(spark, capsys, "transform", a, "--stages", "punctuation")[1][0]["text"].endswith("sentences!")
    assert call(spark, capsys, "compare", a, b)[1][0]["edit_distance"] == 1
    assert call(spark, capsys, "detect", a)[1][0]["status"] == "UNKNOWN"
    assert len(call(spark, capsys, "experiment", a, "--detector", "mock", "--csv", tmp_path / "csv")[1]) == 4
    assert call(spark, capsys, "corpus", "--paragraphs", "3")[1][2]["doc_id"] == 2
    assert "weekday" in call(spark, capsys, "current-date")[1][0]
    assert call(spark, capsys, "inspect-file", a)[1][0]["status"] == "ABSENT"
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "x.py").write_text("import torch\n")
    assert call(spark, capsys, "audit-static", tmp_path / "src")[0] == 1
    assert cli.main(["detect", str(a), "--detector", "keyed"]) == 2
    assert cli.main(["transform", str(a), "--stages", "lexical"]) == 2
    with pytest.raises(SystemExit) as e:
        cli.main(["nothing"])
    assert e.value.code == 2


def test_records_of_blank_texts(spark):
    got = baseline.records(spark.createDataFrame([(1, ""), (2, None), (3, "a b a b")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.word_count for r in got] == [0, 0, 4] and got[0].unicode_categories == {} and got[0].word_frequency_top == []
    assert got[2].repeated_ngrams["2-grams"][0].ngram == "a b" and got[2].whitespace_distribution == {"space": 3}


def test_scripts_and_forms(spark):
    df = spark.createDataFrame([(1, "aбé1"), (2, None), (3, "é")], "doc_id long, text string")
    assert {(r.doc_id, r.script): r.n for r in unicode.letter_scripts(df).collect()} == {(1, "LATIN"): 2, (1, "CYRILLIC"): 1, (3, "LATIN"): 1}
    assert {r.doc_id: r.nfc for r in unicode.stable_forms(df).collect()} == {1: True, 2: True, 3: False}


def test_vocabulary(spark, tmp_path):
    (tmp_path / "flat.json").write_text(json.dumps({"Big": ["large"], "big ": [], "odd": ["x"]}))
    (tmp_path / "tiers.json").write_text(json.dumps({"one": {"a": []}, "two": {"b": []}, "three": {"c": []}}))
    words = lambda *a: {r.word for r in readers.vocabulary(spark, *a).collect()}
    assert words(str(tmp_path / "flat.json")) == {"big", "odd"}
    assert words(str(tmp_path / "tiers.json"), ("one", "two", "none")) == {"a", "b"}
