"""Control experiment: score documents before and after character-level cleaning.

Rows: A the text itself, B Unicode form and invisible characters, C white space, D punctuation.
A detector that works on words must not move by these; the experiment shows whether it does.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import text as T
from provena.operators import compare, detect, normalize

#: Identifier, name and stages of the rows.
CONTROLS = (("A", "original", ""), ("B", "unicode_normalization", "strip-invisible,unicode-nfkc"), ("C", "whitespace_normalization", "whitespace"), ("D", "punctuation_normalization", "punctuation"))
COLUMNS = ("experiment_id", "transformation", "strength", "words_changed", "chars_changed", "edit_distance", "tfidf_similarity", "char_ngram_similarity", "preservation_score", "watermark_score_before", "watermark_score_after", "p_value_before", "p_value_after", "detected_before", "detected_after", "detection_status_before", "detection_status_after", "detector", "detector_is_mock")


def interpretation(none, mock, before, after):
    return (
        F.when(none, "unknown: no detector")
        .when(mock, "unknown: the detector is a mock")
        .when((before == "UNKNOWN") | (after == "UNKNOWN"), "unknown: the detector gave no decision")
        .when((before == "DETECTED") & (after == "NOT_DETECTED"), "no longer flagged; one measurement, no proof")
        .when((before == "DETECTED") & (after == "DETECTED"), "still detected")
        .when(before == "NOT_DETECTED", "not detected before, so no effect can be seen")
        .otherwise(F.concat(before, F.lit(" to "), after))
    )


def controls(df: DataFrame, detector: Callable[[DataFrame], DataFrame] = detect.no_detector, is_mock: bool = False) -> DataFrame:
    """doc_id and the columns above, four rows for each row of df, also where ids repeat.

    Each version of a text is scored once: row A's score is the one before.  Rows are known by id and by
    the order of their texts; the detector sees a hash of that as doc_id."""
    order = Window.partitionBy("doc_id").orderBy("text")
    base = df.select(F.col("doc_id").cast("long").alias("doc_id"), T.whole("text").alias("text")).withColumn("place", F.row_number().over(order))
    cleaners = [normalize.cleaner(stages) for *_, stages in CONTROLS]

    def run(it):
        for pdf in it:
            rows = []
            for d, place, before in zip(pdf["doc_id"], pdf["place"], pdf["text"], strict=True):
                for k, clean in enumerate(cleaners):
                    after, log = clean(before)
                    rows.append((d, place, k, before, after, sum(max(len(e["original"]), len(e["replacement"])) for e in log)))
            yield pd.DataFrame(rows, columns=["doc_id", "place", "k", "before", "after", "chars_changed"])

    made = base.mapInPandas(run, "doc_id long, place int, k int, before string, after string, chars_changed long")
    key = lambda k: F.xxhash64("doc_id", "place", k)
    scored = detector(made.select(key(F.col("k")).alias("doc_id"), F.col("after").alias("text")))
    of = lambda suffix: scored.select(F.col("doc_id").alias(f"key_{suffix}"), *[F.col(c).alias(f"{c}_{suffix}") for c in ("detected", "score", "p_value", "status")], F.col("detector_name").alias(f"name_{suffix}"))
    rows = made.withColumn("key_after", key(F.col("k"))).withColumn("key_before", key(F.lit(0))).join(of("after"), "key_after").join(of("before"), "key_before")
    rows = compare.compare_columns(rows)
    number = (lambda c: F.lit(None).cast("double")) if is_mock else F.col
    truth = (lambda c: F.lit(None).cast("boolean")) if is_mock else F.col
    named = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in CONTROLS]), F.col("k") + 1)
    out = rows.select(
        "doc_id", named(0).alias("experiment_id"), named(1).alias("transformation"), "strength", F.col("changed_words").alias("words_changed"), "chars_changed", "edit_distance", F.col("tfidf_cosine").alias("tfidf_similarity"), F.col("char_3gram_cosine").alias("char_ngram_similarity"), "preservation_score",
        *[number(f"{a}_{s}").alias(f"{b}_{s}") for a, b in (("score", "watermark_score"), ("p_value", "p_value")) for s in ("before", "after")], *[truth(f"detected_{s}").alias(f"detected_{s}") for s in ("before", "after")],
        F.col("status_before").alias("detection_status_before"), F.col("status_after").alias("detection_status_after"), F.col("name_before").alias("detector"), F.lit(is_mock).alias("detector_is_mock"),
    )
    change = F.round(F.col("watermark_score_after") - F.col("watermark_score_before"), 6)
    return out.withColumn("signal_change", change).withColumn("interpretation", interpretation(F.col("detector") == "none", F.col("detector_is_mock"), F.col("detection_status_before"), F.col("detection_status_after")))
