"""Command line: ``python -m provena.cli <command> ...``.

Exit codes: 0 done, 1 an audit found something, 2 wrong use or a failure.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import spans
from provena.operators import audit, baseline, compare, detect, experiment, inspect, normalize, unicode
from provena.sources import readers, sinks


def _session() -> SparkSession:
    s = SparkSession.builder.appName("provena").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    if paths == ["-"]:
        return spark.createDataFrame([(0, "-", sys.stdin.read())], "doc_id long, name string, text string")
    if len(paths) == 1 and paths[0].endswith(".parquet"):
        return spark.read.parquet(paths[0])
    return readers.text_files(spark, paths)


def _show(df: DataFrame, out: str | None) -> None:
    """To a folder of JSON, or the first rows to the terminal."""
    if out:
        sinks.write_json(df, out)
        return
    for r in df.limit(1000).toJSON().toLocalIterator():
        print(r)


def _detector(a: argparse.Namespace, spark: SparkSession):
    words = None
    if getattr(a, "vocabulary", None):
        tiers = tuple(t for t in (a.tiers or "").split(",") if t)
        words = [r.word for r in readers.vocabulary(spark, a.vocabulary, tiers).collect()]
    return detect.make(a.detector, (a.key or "").encode(), a.gamma, words, command=getattr(a, "external_command", None))


def _pairs(spark: SparkSession, before: str, after: str) -> DataFrame:
    one = lambda p, n: readers.text_files(spark, p).select(F.col("text").alias(n), F.lit(0).cast("long").alias("pair_id"))
    return one(before, "before").join(one(after, "after"), "pair_id")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="provena")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, inputs: str | None = None) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        if inputs:
            c.add_argument("inputs", nargs=inputs)
        for a in args:
            c.add_argument(a)
        c.add_argument("--out")
        return c

    add("analyze", inputs="+")
    add("unicode", inputs="+")
    c = add("transform", "--unprotect", inputs="+")
    c.add_argument("--stages", required=True)
    c.add_argument("--punctuation", choices=normalize.PUNCTUATION_MODES, default="normalized")
    c.add_argument("--edit-code", action="store_true")
    c.add_argument("--edit-quotes", action="store_true")
    c.add_argument("--totals", action="store_true")
    for name in ("detect", "experiment"):
        c = add(name, "--key", inputs="+")
        c.add_argument("--detector", choices=("none", "mock", "keyed") + (("external",) if name == "detect" else ()), default="none")
        c.add_argument("--gamma", type=float, default=0.5)
        if name == "detect":
            c.add_argument("--external-command")
            c.add_argument("--vocabulary")
            c.add_argument("--tiers")
        else:
            c.add_argument("--csv")
    add("compare", "before", "after", "--thresholds")
    add("inspect-file", inputs="+")
    add("compare-files", "before", "after")
    c = add("corpus")
    c.add_argument("--paragraphs", type=int, default=100)
    c.add_argument("--named", action="store_true")
    add("audit-static", "root")
    add("search-results", "responses")
    add("current-date")
    return p


def run(a: argparse.Namespace, spark: SparkSession) -> int:
    c = a.command
    if c == "analyze":
        _show(baseline.records(_texts(spark, a.inputs)), a.out)
    elif c == "unicode":
        _show(unicode.findings(_texts(spark, a.inputs)), a.out)
    elif c == "transform":
        protect = spans.protection(a.edit_code, not a.edit_quotes, [k for k in (a.unprotect or "").split(",") if k])
        make = normalize.totals if a.totals else normalize.transform
        _show(make(_texts(spark, a.inputs), a.stages, punctuation=a.punctuation, protect=protect), a.out)
    elif c == "detect":
        _show(_detector(a, spark)(_texts(spark, a.inputs)), a.out)
    elif c == "experiment":
        got = experiment.controls(_texts(spark, a.inputs), _detector(a, spark), a.detector == "mock")
        if a.csv:
            sinks.write_csv(got.select(*experiment.COLUMNS), a.csv)
        _show(got, a.out)
    elif c == "compare":
        _show(compare.compare(_pairs(spark, a.before, a.after), compare.Thresholds.parse(a.thresholds)), a.out)
    elif c == "inspect-file":
        files = spark.read.format("binaryFile").load(a.inputs).select("path", "content")
        _show(inspect.classify(inspect.scan(files)), a.out)
    elif c == "compare-files":
        files = spark.read.format("binaryFile").load([a.before, a.after]).select("path", "content")
        paths = [spark.read.format("binaryFile").load(p).select("path").first().path for p in (a.before, a.after)]
        _show(inspect.persistence(spark.createDataFrame([tuple(paths)], "before string, after string"), inspect.scan(files)), a.out)
    elif c == "corpus":
        _show(readers.named_corpus(spark) if a.named else readers.template_prose(spark, a.paragraphs), a.out)
    elif c == "audit-static":
        got = audit.audit(audit.read_tree(spark, a.root)).cache()
        _show(got, a.out)
        bad = got.filter("kind <> 'reference'").count()
        print(json.dumps({"passed": not bad, "violations": bad}))
        return int(bad > 0)
    elif c == "search-results":
        _show(readers.search_results(spark.read.json(a.responses, schema="query string, body string")), a.out)
    elif c == "current-date":
        _show(readers.clock(spark), a.out)
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv), _session())
    except Exception as e:  # one line instead of a trace
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
