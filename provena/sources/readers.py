"""Sources: text files, binary files, saved search responses, a clock, and a synthetic corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """name and text of whole UTF-8 files, with a doc_id by name."""
    t = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("text"))
    return t.select(F.xxhash64("name").alias("doc_id"), "name", "text")


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def search_results(responses: DataFrame, blank_fails: bool = False) -> DataFrame:
    """responses (query, body as JSON) -> query, rank, title, url, snippet, answer_box, knowledge_graph.

    Missing keys give nulls; a response without results gives one row without a rank; blank queries go, or
    are an error."""
    query = F.trim("query")
    if blank_fails:
        query = F.when(F.coalesce(query, F.lit("")) == "", F.raise_error(F.lit("a query must not be blank")).cast("string")).otherwise(query)
    r = responses.withColumn("query", query).filter(F.col("query") != "").withColumn("v", F.try_parse_json("body"))
    items = F.variant_get("v", "$.organic", "array<struct<title:string,link:string,snippet:string>>")
    part = lambda p: F.to_json(F.variant_get("v", p, "variant"))
    x = r.select("query", part("$.answerBox").alias("answer_box"), part("$.knowledgeGraph").alias("knowledge_graph"), F.posexplode_outer(items).alias("pos", "r"))
    return x.select("query", (F.col("pos") + 1).alias("rank"), "r.title", F.col("r.link").alias("url"), "r.snippet", "answer_box", "knowledge_graph")


def clock(spark: SparkSession, now: Column | None = None) -> DataFrame:
    """One row that describes the moment of the query."""
    t = F.current_timestamp() if now is None else now
    date = lambda f: F.date_format(t, f)
    return spark.range(1).select(date("yyyy-MM-dd").alias("date"), date("HH:mm:ss").alias("time"), date("yyyy-MM-dd'T'HH:mm:ssXXX").alias("iso"), date("EEEE").alias("weekday"), date("MMMM").alias("month"), F.year(t).alias("year"), F.unix_timestamp(t).alias("unix"), F.current_timezone().alias("timezone"))


_SUBJECTS = ("The survey team", "A small archive", "The harbour office", "Each regional desk", "The night shift")
_VERBS = ("records", "compares", "summarises", "checks", "files", "reviews", "copies")
_OBJECTS = ("the tide tables", "old letters", "weekly counts", "every invoice", "the ledgers", "new maps", "field notes", "all permits")
_TAILS = ("before noon", "in plain language", "without delay", "for the public", "by hand", "twice a year", "near the river", "as agreed", "on request", "with care", "since spring")


def template_prose(spark: SparkSession, paragraphs: int, sentences: int = 6, partitions: int = 8) -> DataFrame:
    """doc_id, text: paragraphs of template sentences, each part chosen by modular arithmetic.

    The sizes of the lists are coprime, so a sentence comes again only after 3080 others."""
    one = lambda k: F.concat_ws(" ", *[F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int")) for v in (_SUBJECTS, _VERBS, _OBJECTS, _TAILS)])
    k = F.sequence(F.col("id") * sentences, F.col("id") * sentences + (sentences - 1))
    return spark.range(0, paragraphs, 1, partitions).select(F.col("id").alias("doc_id"), F.array_join(F.transform(k, lambda i: F.concat(one(i), F.lit("."))), " ").alias("text"))


#: Ten short documents, one for each kind of text that the operators treat in a way of its own.
_NAMED = (
    ("short_prose", "The ferry leaves at dawn. Nobody on the pier looks up; the gulls do."),
    ("long_prose", None),
    ("factual", "The bridge opened on 12 March 1968. It is 1,245 m long, carries 38,000 cars a day and cost 4.7 million pounds."),
    ("technical_markdown", "# Setup\n\nCopy `settings.toml` to /etc/demo/settings.toml, run `demo --check`, then see https://docs.example.org/setup or write to help@example.org.\n"),
    ("academic", "Sediment cores show two phases (Moreno, 2011). Growth follows $g = k t$ [3, 5]. As one report puts it, \"the record is patchy before 1850\"."),
    ("bullets", "To pack:\n\n- rope, 20 m\n- two lamps\n- a dry map\n"),
    ("markdown_table", "| port | ships |\n| --- | --- |\n| north | 14 |\n| south | 9 |\n"),
    ("code", "```python\ndef area(w, h):\n    # plain rectangle\n    return w * h\n```\n"),
    ("mixed", "The function below adds a list.\n\n```js\nconst sum = xs => xs.reduce((a, b) => a + b, 0) // zero if empty\n```\n\nIt returns 0 for an empty one."),
    ("invisible_characters", "A zero\u200bwidth space, a non\u00a0breaking one, a soft\u00adhyphen and a Cyrillic \u0430."),
)


def named_corpus(spark: SparkSession, paragraphs: int = 5) -> DataFrame:
    """doc_id, name, text of ten documents; the long one is template prose."""
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(_NAMED) if t is not None], "doc_id long, name string, text string")
    prose = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda r: r["text"]), "\n\n")
    made = [(i, n) for i, (n, t) in enumerate(_NAMED) if t is None]
    for i, n in made:
        rows = rows.unionByName(template_prose(spark, paragraphs).agg(prose.alias("text")).select(F.lit(i).cast("long").alias("doc_id"), F.lit(n).alias("name"), "text"))
    return rows


def vocabulary(spark: SparkSession, path: str, tiers: tuple[str, ...] = ()) -> DataFrame:
    """word: the heads of a JSON word table, lower-cased; flat (head: list) or by tiers of such tables.

    Only the heads are read: they say which words a detector scores."""
    v = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    flat = F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))
    if not tiers:
        heads = v.select(F.explode(flat).alias("word"))
    else:
        heads = v.select(F.explode(F.flatten(F.array(*[F.coalesce(F.map_keys(F.try_variant_get("v", f"$.{t}", "map<string,variant>")), F.array().cast("array<string>")) for t in tiers]))).alias("word"))
    return heads.select(F.lower(F.trim("word")).alias("word")).filter("word <> ''").distinct()
