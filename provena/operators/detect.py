"""Watermark detection: scoring only, with null results where nothing can be said.

The keyed test counts, over distinct pairs of neighbouring words, those whose HMAC under the key falls
below gamma.  Pairs, digests and counts are array expressions of one row, so a document is scored
without a shuffle; only NFKC and the p-value need Python, on Arrow batches.
The key's pads are literals of the plan: use test keys, or ``keyed_python`` for a key that must not
appear in plans.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import shlex
import subprocess
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from provena.functions import text as T

RESULT = "doc_id long, detected boolean, score double, p_value double, confidence double, detector_name string, status string"


def status(detected: Column, mock: bool = False) -> Column:
    if mock:
        return F.lit("UNKNOWN")
    return F.when(detected.isNull(), "UNKNOWN").when(detected, "DETECTED").otherwise("NOT_DETECTED")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex digest, composed of the built-in sha2."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key.ljust(64, b"\0")).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


#: Characters that NFKC may change: all beyond Latin-1, and a few of its signs.
_MAY_CHANGE = r"[^\x00-\xFF]|[\xA0\xA8\xAA\xAF\xB2-\xB5\xB8-\xBA\xBC-\xBE]"


def scored_words(text: Column, compose: bool = True) -> Column:
    """Lower-cased words without code blocks and format characters.  Only texts that NFKC may change go to Python."""
    t = F.regexp_replace(text, T.CODE_BLOCK, "")
    t = F.coalesce(nfkc(F.when(t.rlike(_MAY_CHANGE), t)), t) if compose else t
    return T.words(F.lower(F.translate(F.regexp_replace(t, r"\p{Cf}", ""), "’", "'")))


def green_counts(df: DataFrame, key: bytes, gamma: float = 0.5, vocabulary: list[str] | None = None, compose: bool = True) -> DataFrame:
    """doc_id, green, scored.  With a vocabulary only its words are scored; their context is any word."""
    if not 0 < gamma < 1:
        raise ValueError("gamma must lie between 0 and 1")
    w = df.select(F.col("doc_id").cast("long").alias("doc_id"), scored_words(T.whole("text"), compose).alias("w"))
    n = F.size("w")
    pairs = F.zip_with(F.slice("w", 1, F.greatest(n - 1, F.lit(0))), F.slice("w", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws("\x1f", a, b))
    pairs = F.array_distinct(pairs)  # of strings, by hash; of structs Spark compares each with each
    if vocabulary is not None:
        known = F.array(*map(F.lit, sorted(set(vocabulary)))) if vocabulary else F.array().cast("array<string>")
        pairs = F.filter(pairs, lambda p: F.array_contains(known, F.substring_index(p, "\x1f", -1)))
    digest = lambda p: F.substring(hmac_sha256(key, p), 1, 16)
    # value < gamma, both as hex of 64 bits: the order of hex digits is that of numbers
    bound = math.ceil(gamma * 2**64)
    x = w.select("doc_id", F.when(n > 1, pairs).otherwise(F.array().cast("array<string>")).alias("p"))
    green = F.size(F.filter("p", lambda p: digest(p) < f"{bound:016x}"))
    return x.select("doc_id", green.cast("long").alias("green"), F.size("p").cast("long").alias("scored"))


def z_scores(counts: DataFrame, gamma: float = 0.5, threshold: float = 4.0, least: int = 16) -> DataFrame:
    z = (F.col("green") - gamma * F.col("scored")) / F.sqrt(F.col("scored") * gamma * (1 - gamma))
    z = F.when(F.col("scored") >= least, z)
    return counts.withColumn("z", z).withColumn("detected", F.col("z") >= threshold).withColumn("score", F.bround("z", 4))


def keyed(df: DataFrame, key: bytes, gamma: float = 0.5, threshold: float = 4.0, least: int = 16, vocabulary: list[str] | None = None) -> DataFrame:
    """The z-test of each document; Spark has no erfc, so the few numbers of a row pass through Arrow."""

    def run(it):
        for pdf in it:
            rows = []
            for d, green, n in zip(pdf["doc_id"], pdf["green"], pdf["scored"], strict=True):
                if n < least:
                    rows.append((d, None, None, None, None, "local-keyed", "UNKNOWN", green, n))
                    continue
                z = (green - gamma * n) / math.sqrt(n * gamma * (1 - gamma))
                p = 0.5 * math.erfc(z / math.sqrt(2))
                rows.append((d, z >= threshold, round(z, 4), p, round(1 - p, 6), "local-keyed", "DETECTED" if z >= threshold else "NOT_DETECTED", green, n))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    schema = RESULT + ", green long, scored long"
    return green_counts(df, key, gamma, vocabulary).mapInPandas(run, schema)


def no_detector(df: DataFrame) -> DataFrame:
    none = F.lit(None)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), none.cast("boolean").alias("detected"), *[none.cast("double").alias(c) for c in ("score", "p_value", "confidence")], F.lit("none").alias("detector_name"), F.lit("UNKNOWN").alias("status"))


def mock(df: DataFrame) -> DataFrame:
    """A number made of the text's digest: for trying out what follows; its status is always unknown."""
    high = F.conv(F.substring(F.sha2(T.whole("text"), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    x = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.round(high / 2.0**64, 6).alias("score"))
    return x.select("doc_id", (F.col("score") >= 0.5).alias("detected"), "score", F.round(1 - F.col("score"), 6).alias("p_value"), F.lit(None).cast("double").alias("confidence"), F.lit("mock").alias("detector_name"), F.lit("UNKNOWN").alias("status"))


def _from_mapping(doc_id: int, m: dict, name: str) -> tuple:
    number = lambda k: None if m.get(k) is None else float(m[k])
    found = None if m.get("detected") is None else bool(m["detected"])
    state = "UNKNOWN" if found is None or (m.get("metadata") or {}).get("mock") else "DETECTED" if found else "NOT_DETECTED"
    return doc_id, found, number("score"), number("p_value"), number("confidence"), str(m.get("detector_name") or name), state


def external(df: DataFrame, plugin=None, command: str | None = None, timeout: float = 120) -> DataFrame:
    """A detector of the user: ``plugin()`` gives an object with detect(text) -> mapping, one for each
    partition; or a command that reads the text and prints a JSON object."""
    if (plugin is None) == (command is None):
        raise ValueError("give either a plugin or a command")

    def run(it):
        made = plugin() if plugin is not None else None
        for pdf in it:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                if made is not None:
                    got = made.detect(t)
                else:
                    done = subprocess.run(shlex.split(command), input=t, capture_output=True, text=True, timeout=timeout, check=False)
                    if done.returncode:
                        raise RuntimeError(f"the detector command failed: {done.stderr[-500:]}")
                    got = json.loads(done.stdout)
                rows.append(_from_mapping(d, got, "external"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), T.whole("text").alias("text")).mapInPandas(run, RESULT)


def make(name: str, key: bytes | None = None, gamma: float = 0.5, vocabulary: list[str] | None = None, plugin=None, command: str | None = None):
    """A detector by name (none, mock, keyed, external) as a function of documents; wrong use is an error."""
    if name == "keyed":
        if not key:
            raise ValueError("the keyed detector needs a key")
        return lambda d: keyed(d, key, gamma, vocabulary=vocabulary)
    if name == "external":
        return lambda d: external(d, plugin, command)
    if name not in ("none", "mock"):
        raise ValueError(f"unknown detector {name!r}; detectors: none, mock, keyed, external")
    return no_detector if name == "none" else mock


def keyed_python(df: DataFrame, key: bytes, gamma: float = 0.5) -> DataFrame:
    """green_counts with the key only in the closure of the workers."""
    from provena.functions.spans import PATTERNS, WORD

    def run(it):
        for pdf in it:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                t = unicodedata.normalize("NFKC", PATTERNS[0][1].sub("", t))
                w = [x.lower().replace("’", "'") for x in WORD.findall("".join(c for c in t if unicodedata.category(c) != "Cf"))]
                pairs = set(zip(w, w[1:], strict=False))
                green = sum(int.from_bytes(hmac.digest(key, f"{a}\x1f{b}".encode(), "sha256")[:8], "big") < gamma * 2**64 for a, b in pairs)
                rows.append((d, green, len(pairs)))
            yield pd.DataFrame(rows, columns=["doc_id", "green", "scored"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), T.whole("text").alias("text")).mapInPandas(run, "doc_id long, green long, scored long")


def marked_text(key: bytes, seed: int, n: int, gamma: float = 0.5) -> str:
    """A fixture of n words that carries the mark from the start: each word is the first of a fixed
    list, from a place that depends on seed, that is green after the word before.  Takes no input text."""
    bank = [a + b for a in ("ba", "do", "fi", "gu", "ka", "le", "mo", "ni") for b in ("ran", "sel", "tin", "vor", "lum", "pek")]
    out = ["the"]
    for i in range(n - 1):
        order = [bank[(seed * 7 + i * 5 + k) % len(bank)] for k in range(len(bank))]
        out.append(next((w for w in order if int.from_bytes(hmac.digest(key, f"{out[-1]}\x1f{w}".encode(), "sha256")[:8], "big") < gamma * 2**64), order[0]))
    return " ".join(out) + "."
