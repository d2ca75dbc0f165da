"""Audit of a source tree: forbidden imports and dependencies, and mentions of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of files that count, folders that do not, and files that name dependencies.
SUFFIXES = ("py", "md", "txt", "toml", "cfg", "ini", "json", "yaml", "yml", "html", "sh")
SKIPPED = (".git", "__pycache__", ".venv", "venv", "node_modules", ".pytest_cache", "build", "dist")
DEPENDENCY_FILES = ("requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile")
#: Inference libraries that a text-statistics code base should not need; a parameter.
FORBIDDEN = ("transformers", "torch", "tensorflow", "keras", "jax", "flax", "spacy", "sklearn", "gensim", "vllm")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) and content of the files that count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    below = F.ltrim(F.regexp_replace(path, "^.*?" + root.strip("/").replace(".", r"\.") + "/", ""))
    x = files.select(below.alias("path"), F.decode("content", "UTF-8").alias("text"))
    part = F.split("path", "/")
    name = F.element_at(part, -1)
    return x.filter(~F.arrays_overlap(part, F.array(*map(F.lit, SKIPPED))) & (F.regexp_extract("path", r"\.(\w+)$", 1).isin(*SUFFIXES) | name.isin(*DEPENDENCY_FILES)))


def audit(files: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN, terms: tuple[str, ...] = FORBIDDEN) -> DataFrame:
    """path, line, kind (forbidden_import, forbidden_dependency, reference), item."""
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    lines = lines.repartition("path", "line")
    bad = F.array(*map(F.lit, forbidden))
    hit = lambda m: F.exists(bad, lambda b: (m == b) | m.startswith(F.concat(b, F.lit("."))))
    one, many = F.regexp_extract("text", r"^[ \t]*from[ \t]+([\w.]+)[ \t]+import", 1), F.regexp_extract("text", r"^[ \t]*import[ \t]+([\w., \t]+)", 1)
    modules = F.filter(F.concat(F.array(one), F.transform(F.split(many, ","), lambda m: F.split(F.trim(m), " ")[0])), lambda m: m != "")
    imports = lines.filter(F.col("path").endswith(".py")).select("path", "line", F.lit("forbidden_import").alias("kind"), F.explode(F.filter(modules, hit)).alias("item"))
    name = F.translate(F.lower(F.regexp_extract(F.regexp_replace(F.trim("text"), "^[\"',]+", ""), r"^[^<>=!~\[;\s\"']*", 0)), "-", "_")
    deps = lines.filter(F.element_at(F.split("path", "/"), -1).isin(*DEPENDENCY_FILES) & F.array_contains(F.transform(bad, lambda b: F.translate(b, ".", "_")), name)).select("path", "line", F.lit("forbidden_dependency").alias("kind"), name.alias("item"))
    found = lines.select("path", "line", F.lit("reference").alias("kind"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("|".join(terms)), F.lit(0))).alias("item"))
    return imports.unionByName(deps).unionByName(found)


def term_counts(audited: DataFrame) -> DataFrame:
    return audited.filter("kind = 'reference'").groupBy("item").agg(F.count("*").alias("n"))
