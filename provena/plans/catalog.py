"""The queries over the reference's own operators, and the DuckDB SQL that they are held against."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import spans as S
from provena.functions import text as T
from provena.operators import audit, baseline, compare, detect, experiment, inspect, normalize, spans, stats, unicode
from provena.sources import readers

KEY = b"test key for queries"
VOCABULARY = ("the", "and", "of", "der", "die", "und", "le", "la", "que", "de")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_documents(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(_t(spark, sf_dir, "documents"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one of the next id."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("after"))
    return d.join(nxt, "doc_id").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("before"), "after")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation with the next one, for word-level measures of short texts."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return c.join(nxt, ["conv_id", "turn"]).select((F.col("conv_id") * 2**20 + F.col("turn")).alias("pair_id"), F.col("text").alias("before"), "after")


#: Marks that the tables lack, and what they are put in for, the same way in Spark and in SQL.
PLANTED = (("ou", "o\u200bu"), ("an ", "an\u00a0 "), ("ti", "t\u0456"), ("en.", "en\u2026"), ("er,", "er!!,,"), ("th", "t\ufb01h"), ("de", "d\u202ee"), ("re ", "re\u2014"), ("st\n", "st  \n\n \n\n"), ("is", "\u201cis\u201d"), ("ei", "e\u0301i"))
_BLOCK = "\n```\nsome code here\n```\n"


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with marks put in: invisible, look-alike and typographic ones, blanks, a code block at the end."""
    text = T.whole("text")
    for old, new in PLANTED:
        text = F.replace(text, F.lit(old), F.lit(new))
    return _t(spark, sf_dir, "documents").select("doc_id", F.concat(text, F.lit(_BLOCK)).alias("text"))


def _findings(df: DataFrame) -> DataFrame:
    """All but the names of characters, which SQL lacks."""
    return unicode.findings(df).drop("name")


def _clean(spark: SparkSession, sf_dir: str, of: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    c = normalize.clean(of(spark, sf_dir) if of else _t(spark, sf_dir, "documents"))
    return c.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def _exact_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = normalize.transform(_t(spark, sf_dir, "documents"), "strip-invisible,unicode-nfkc,whitespace,punctuation")
    return done.select("doc_id", F.size("edits").alias("n_edits"), F.sha2("text", 256).alias("sha256"))


def _z(spark: SparkSession, sf_dir: str, of: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    x = detect.z_scores(detect.green_counts(of(spark, sf_dir) if of else _t(spark, sf_dir, "documents"), KEY))
    return x.select("doc_id", "green", "scored", F.round("z", 6).alias("z"), "detected", detect.status(F.col("detected")).alias("status"))


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.keyed(_t(spark, sf_dir, "documents"), KEY, vocabulary=list(VOCABULARY))


def _vocabulary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir).select("doc_id", "green", "scored", "detected", F.round("score", 4).alias("score"), "status")


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unicode.letter_scripts(_planted(spark, sf_dir))


def _nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unicode.stable_forms(_planted(spark, sf_dir)).select("doc_id", "nfc")


def _record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record's parts that SQL has, flat."""
    r = baseline.records(_planted(spark, sf_dir))
    bag = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    named = lambda c, k: F.array_join(F.transform(c, lambda e: F.concat_ws("=", e[k], e["count"])), ";")
    d, s = F.col("lexical_diversity"), F.col("sentence_length_words")
    return r.select("doc_id", "character_count", "word_count", "token_count", "paragraph_count", bag("unicode_categories").alias("categories"), bag("whitespace_distribution").alias("whitespace"), bag("suspicious_characters").alias("suspicious"), "total_suspicious", d["types"].alias("types"), d["hapax_legomena"].alias("hapax_legomena"), named("word_frequency_top", "word").alias("words"), (s["count"] == F.col("sentence_count")).alias("sentences_agree"), F.col("code.code_blocks").cast("long").alias("code_blocks"))


def _sentence_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.sentence_lengths(_t(spark, sf_dir, "documents")).select("doc_id", "count", F.col("min").cast("long").alias("min"), F.col("max").cast("long").alias("max"), "median")


def _sentence_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.sentence_histogram(_t(spark, sf_dir, "documents"))


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved responses, made of pages: each has one result, some lack keys."""
    p = _t(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    body = F.when(F.col("page_id") % 5 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(F.array(F.struct("title", F.col("url").alias("link"))).alias("organic"))))
    return readers.search_results(p.select(F.concat(F.lit(" q"), F.col("page_id")).alias("query"), body.alias("body"))).select("query", "rank", "title", "url", "snippet")


def png(*chunks: tuple[bytes, bytes]) -> bytes:
    """A PNG of one pixel with more chunks, for inspection."""
    one = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + one(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + b"".join(one(*c) for c in chunks) + one(b"IDAT", zlib.compress(b"\0\0")) + one(b"IEND", b"")


def _inspect(spark: SparkSession, _: str) -> DataFrame:
    rows = [("plain.png", png()), ("marked.png", png((b"caBX", b"....jumb....c2pa"))), ("text.png", png((b"tEXt", b"XML:com.adobe.xmp\0dcterms:provenance"))), ("x.pdf", b"%PDF-1.7 ....jumb..c2pa")]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    return inspect.classify(inspect.scan(files)).select("path", "format", "size_bytes", "status", "reason")


def _audit(spark: SparkSession, _: str) -> DataFrame:
    files = spark.createDataFrame([("a.py", "import os\nimport torch, json\nfrom jax.numpy import x\n# torch\n"), ("requirements.txt", "numpy==1\nspacy>=3\n")], "path string, text string")
    return audit.audit(files)


def _experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows A to D of the benchmark's texts, scored by the keyed test."""
    d = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return experiment.controls(d, lambda x: detect.keyed(x, KEY))


def _profile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "text").join(_t(spark, sf_dir, "labels"), "doc_id")
    return stats.profile(d, "quality")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "lang_profile": lambda spark, d: stats.profile(_t(spark, d, "documents"), "lang"),
    "label_profile": _profile_labels,
    "role_profile": lambda spark, d: stats.profile(_t(spark, d, "conversations"), "role"),
    "text_counts": _on_documents(stats.counts),
    "unicode_categories": _on_documents(stats.categories),
    "punctuation_distribution": _on_documents(stats.punctuation),
    "whitespace_distribution": _on_documents(stats.whitespace),
    "lexical_diversity": _on_documents(stats.lexical_diversity),
    "moving_average_ttr": _on_documents(stats.moving_average_ttr),
    "frequent_words": _on_documents(stats.frequent_words),
    "repeated_ngrams": _on_documents(stats.repeated_ngrams),
    "unicode_findings": lambda spark, d: _findings(_planted(spark, d)),
    "unicode_kinds": lambda spark, d: unicode.kind_counts(_planted(spark, d)),
    "page_unicode_findings": lambda spark, d: _findings(_t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))),
    "letter_scripts": _scripts,
    "stable_forms": _on_documents(unicode.stable_forms),
    "stable_nfc": _nfc,
    "baseline_record": _on_documents(baseline.records),
    "baseline_counts": _record_counts,
    "clean_text": _clean,
    "clean_planted": lambda spark, d: _clean(spark, d, _planted),
    "transform_totals": lambda spark, d: normalize.totals(_t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "strip-invisible,unicode-nfkc,whitespace,punctuation"),
    "exact_transform": _exact_edits,
    "sentences": _on_documents(spans.sentences),
    "sentence_lengths": _sentence_ends,
    "sentence_histogram": _sentence_bins,
    "protected_spans": _on_documents(spans.protected),
    "free_segments": _on_documents(spans.free_segments),
    "code_statistics": _on_documents(spans.code_statistics),
    "pair_word_overlap": lambda spark, d: compare.word_overlap(_pairs(spark, d)),
    "pair_char_cosine": lambda spark, d: compare.char_ngram_cosine(_turns(spark, d)),
    "pair_compare": lambda spark, d: compare.compare(_turns(spark, d)),
    "detect_keyed": _z,
    "detect_planted": lambda spark, d: _z(spark, d, _planted),
    "detect_vocabulary": _vocabulary_counts,
    "detect_mock": _on_documents(detect.mock),
    "detect_none": _on_documents(detect.no_detector),
    "control_experiment": _experiment,
    "search_results": _search,
    "template_prose": lambda spark, _: readers.template_prose(spark, 500),
    "clock": lambda spark, _: readers.clock(spark),
    "inspect_files": _inspect,
    "static_audit": _audit,
    "audit_terms": lambda spark, d: audit.term_counts(_audit(spark, d)),
    "named_corpus": lambda spark, _: stats.counts(readers.named_corpus(spark)),
}

_WS = T.WS
_LW = f"regexp_extract_all(lower(coalesce(text, '')), '{T.WORD.replace(chr(39), chr(39) * 2)}')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _profile_sql(by: str, table: str) -> str:
    return f"""WITH w AS (SELECT {by}, {_LW} AS w FROM {table})
SELECT {by}, count(*) AS documents, sum(len(w))::BIGINT AS words,
  round(avg(CASE WHEN len(w) > 0 THEN len(list_distinct(w))::DOUBLE / len(w) ELSE 0 END), 6) AS mean_ttr FROM w GROUP BY {by}"""


def _chars_sql(pattern: str) -> str:
    return f"SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), {_q(pattern)})) AS ch FROM documents) GROUP BY doc_id, ch"


def _ranked_sql(source: str, keys: str, out: str, least: int = 1) -> str:
    return f"""WITH t AS ({source}),
c AS (SELECT {keys}, term, count(*) AS n, min(pos) AS first FROM t GROUP BY {keys}, term),
r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, first) AS rank FROM c)
SELECT {keys}, rank::INT AS rank, term AS {out}, n FROM r WHERE rank <= 25 AND n >= {least}"""


def _bag_sql(source: str, pairs: str, columns: str) -> str:
    return f"""WITH pairs AS ({pairs}), t AS ({source}),
b AS (SELECT pair_id, term, sum(1 - side) AS a, sum(side) AS b FROM t GROUP BY pair_id, term),
x AS (SELECT pair_id, count(*) FILTER (WHERE a > 0 AND b > 0) AS common, count(*) AS total, sum(least(a, b)) AS lo, sum(a) AS na, sum(b) AS nb, sum(a * b) AS dot, sum(a * a) AS aa, sum(b * b) AS bb FROM b GROUP BY pair_id),
m AS (SELECT pair_id, round(common::DOUBLE / total, 4) AS jaccard, round(lo::DOUBLE / greatest(na, nb), 4) AS multiset_overlap,
  round(CASE WHEN na = 0 AND nb = 0 THEN 1 WHEN na = 0 OR nb = 0 THEN 0 ELSE dot::DOUBLE / sqrt(aa::DOUBLE * bb) END, 4) AS cosine FROM x)
SELECT pairs.pair_id, {columns} FROM pairs LEFT JOIN m USING (pair_id)"""


_DOC_PAIRS = "SELECT d.doc_id AS pair_id, d.text AS before, e.text AS after FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1"
_TURN_PAIRS = "SELECT d.conv_id * 1048576 + d.turn AS pair_id, d.text AS before, e.text AS after FROM conversations d JOIN conversations e ON e.conv_id = d.conv_id AND e.turn = d.turn + 1"
_PAIR_WORDS = " UNION ALL ".join(f"SELECT pair_id, unnest(regexp_extract_all(lower(coalesce({c}, '')), {_q(T.WORD)})) AS term, {s} AS side FROM pairs" for c, s in (("before", 0), ("after", 1)))
_PAIR_GRAMS = " UNION ALL ".join(f"SELECT pair_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS term, {s} AS side FROM (SELECT pair_id, regexp_replace(lower(coalesce({c}, '')), {_q(f'[{_WS}]+')}, ' ', 'g') AS t FROM pairs)" for c, s in (("before", 0), ("after", 1)))


def _planted_sql() -> str:
    t = "coalesce(text, '')"
    for old, new in PLANTED:
        t = f"replace({t}, {_q(old)}, {_q(new)})"
    return f"SELECT doc_id, {t} || {_q(_BLOCK)} AS text FROM documents"


def _findings_sql(table: str, key: str, text: str) -> str:
    kinds = " ".join(f"WHEN regexp_matches(ch, {_q('[' + unicode.CLASSES[k] + ']')}) THEN '{k}'" for k in unicode.CLASSES)
    return f"""WITH l AS (SELECT {key} AS doc_id, regexp_extract_all({text}, '(?s).') AS l FROM {table} WHERE regexp_matches({text}, {_q(unicode.SUSPICIOUS)})),
c AS (SELECT doc_id, unnest(l) AS ch, unnest(range(1, len(l) + 1)) AS p FROM l),
d AS (SELECT *, count(*) FILTER (WHERE ch = chr(10)) OVER w AS breaks, max(CASE WHEN ch = chr(10) THEN p END) OVER w AS last FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS rank, count(*) OVER (PARTITION BY doc_id) AS total FROM d WHERE regexp_matches(ch, {_q(unicode.SUSPICIOUS)}))
SELECT doc_id, (p - 1)::INT AS position, (breaks + 1)::INT AS line, (p - coalesce(last, 0))::INT AS "column", CASE {kinds} END AS kind,
  'U+' || lpad(upper(to_base(unicode(ch), 16)), greatest(4, length(to_base(unicode(ch), 16)))::INT, '0') AS codepoint,
  CASE WHEN kind = 'homoglyph' THEN translate(ch, {_q(''.join(unicode.HOMOGLYPHS))}, {_q(''.join(unicode.HOMOGLYPHS.values()))}) END AS looks_like,
  total AS total_suspicious, total > 500 AS findings_truncated
FROM m WHERE rank <= 500"""


def _clean_sql(table: str) -> str:
    sp = "[ \\t" + normalize.UNUSUAL_SPACES + "]"
    steps = [(unicode.INVISIBLE_CLASS, ""), (r"(?:[ \t]*\r?\n){3,}", "\n\n"), (sp + r"+(\r?\n)", r"\1"), (sp + r"+\z", ""), (r"([^\t\n\x0B\f\r ])" + sp + "{2,}", r"\1 "), (r"([^\t\n\x0B\f\r ])[\t" + normalize.UNUSUAL_SPACES + "]", r"\1 "), (r"!!+", "!"), *((f"[{m}]{{2,}}", m) for m in "?,;:"), (r"\.{4,}", "...")]
    t = "coalesce(text, '')"
    for pattern, new in steps:
        t = f"regexp_replace({t}, {_q(pattern)}, {_q(new)}, 'g')"
    one = {a: b for a, b in (normalize.QUOTES | normalize.DASHES).items() if len(b) == 1}
    t = f"translate({t}, {_q(''.join(one))}, {_q(''.join(one.values()))})"
    return f"SELECT doc_id, length(t) AS n_chars, sha256(t) AS sha256 FROM (SELECT doc_id, replace(replace(replace({t}, '—', '--'), '―', '--'), '…', '...') AS t FROM {table})"


def _keyed_sql(key: bytes, gamma: float = 0.5, text: str = "coalesce(text, '')", table: str = "documents", vocabulary: tuple[str, ...] | None = None) -> str:
    pad = lambda x: "unhex('" + bytes(b ^ x for b in key.ljust(64, b"\0")).hex() + "')"
    among = f" WHERE b IN ({', '.join(map(_q, vocabulary))})" if vocabulary else ""
    last = "detected, round(z, 4) AS score" if vocabulary else "round(z, 6) AS z, detected"
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(replace(regexp_replace({text}, '\\p{{Cf}}', '', 'g'), '’', '\'\'')), {_q(T.WORD)}) AS w FROM {table}),
p AS (SELECT DISTINCT doc_id, a, b FROM (SELECT doc_id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:len(w)]) AS b FROM w WHERE len(w) > 1){among}),
h AS (SELECT doc_id, substr(sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode(a || chr(31) || b)))), 1, 16) AS d FROM p),
g AS (SELECT doc_id, count(*) FILTER (WHERE d < '{int(gamma * 2**64):016x}') AS green, count(*) AS scored FROM h GROUP BY doc_id),
z AS (SELECT doc_id, coalesce(green, 0) AS green, coalesce(scored, 0) AS scored, CASE WHEN scored >= 16 THEN (green - {gamma} * scored) / sqrt(scored * {gamma} * {1 - gamma}) END AS z FROM documents LEFT JOIN g USING (doc_id))
SELECT doc_id, green, scored, {last}, CASE WHEN z IS NULL THEN 'UNKNOWN' WHEN z >= 4 THEN 'DETECTED' ELSE 'NOT_DETECTED' END AS status FROM (SELECT *, z >= 4 AS detected FROM z)"""


def _composed_sql() -> str:
    """The planted text without its block, as NFKC makes it: written out for the marks that are put in."""
    t = "text"
    for old, new in (("\ufb01", "fi"), ("\u00a0", " "), ("\u2026", "...")):
        t = f"replace({t}, {_q(old)}, {_q(new)})"
    return f"nfc_normalize(replace({t}, {_q(_BLOCK)}, ''))"


def _sentences_sql() -> str:
    """Words of each sentence.  Periods of abbreviations are hidden first, twice as matches share blanks."""
    close = "[\"\\x27”’)\\]]*"
    short = "|".join(a.replace(".", r"\.") for a in sorted(S.ABBREVIATIONS))
    hide = _q(rf"(^|[^\p{{L}}\p{{N}}_.])((?i:{short})|\p{{Lu}})\.({close})(\s|$)")
    p = "p"
    for _ in range(2):
        p = f"regexp_replace({p}, {hide}, '\\1\\2' || chr(1) || '\\3\\4', 'g')"
    p = f"regexp_replace({p}, {_q(rf'([.!?]+{close})(\s|$)')}, '\\1' || chr(2) || '\\2', 'g')"
    return f"""SELECT doc_id, len(regexp_extract_all(s, {_q(T.WORD)})) AS words FROM (
  SELECT doc_id, unnest(string_split({p}, chr(2))) AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), {_q(T.PARAGRAPH_BREAK)})) AS p FROM documents)) WHERE regexp_matches(s, {_q(f'[^{_WS}]')})"""


def _categories_sql(table: str = "documents") -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, len(regexp_extract_all(coalesce(text, ''), '\\p{{{c}}}')) AS n FROM {table} WHERE regexp_matches(coalesce(text, ''), '\\p{{{c}}}')" for c in T.CATEGORIES if c != "Cs")


def _whitespace_sql() -> str:
    return f"SELECT doc_id, CASE ch WHEN ' ' THEN 'space' WHEN chr(9) THEN 'tab' WHEN chr(10) THEN 'newline' WHEN chr(13) THEN 'carriage_return' WHEN chr(160) THEN 'nbsp' ELSE 'other U+' || lpad(upper(to_base(unicode(ch), 16)), 4, '0') END AS kind, n FROM ({_chars_sql(f'[{_WS}]')})"


def _words_sql() -> str:
    return _ranked_sql(f"SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {_LW} AS w FROM documents)", "doc_id", "word")


def _counts_sql() -> str:
    return f"""SELECT doc_id, length(coalesce(text, '')) AS character_count, len(regexp_extract_all(coalesce(text, ''), {_q(T.WORD)})) AS word_count,
  len(regexp_extract_all(coalesce(text, ''), {_q(T.TOKEN)})) AS token_count,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), {_q(T.PARAGRAPH_BREAK)}), lambda p: regexp_matches(p, {_q(f'[^{_WS}]')}))) AS paragraph_count FROM documents"""


def _diversity_sql() -> str:
    return f"""WITH w AS (SELECT doc_id, {_LW} AS w FROM documents),
h AS (SELECT doc_id, count(*) AS hapax FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY ALL HAVING n = 1) GROUP BY doc_id),
x AS (SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS types, coalesce(hapax, 0) AS hapax_legomena FROM w LEFT JOIN h USING (doc_id))
SELECT doc_id, words, types, CASE WHEN words > 0 THEN round(types::DOUBLE / words, 4) ELSE 0 END AS type_token_ratio, CASE WHEN words > 0 THEN round(types / sqrt(words), 4) ELSE 0 END AS root_ttr,
  hapax_legomena, CASE WHEN words > 0 THEN round(hapax_legomena::DOUBLE / types, 4) ELSE 0 END AS hapax_ratio FROM x"""


def _record_sql() -> str:
    """The flat record of planted texts, from the queries of its parts."""
    on = lambda sql: sql.replace("FROM documents", "FROM planted")
    bag = lambda sql, key, order: f"(SELECT doc_id, string_agg({key} || '=' || n, ';' ORDER BY {order}) AS s FROM ({on(sql)}) GROUP BY doc_id)"
    kinds = f"SELECT doc_id, kind, count(*) AS n FROM ({_findings_sql('planted', 'doc_id', 'text').replace(' WHERE rank <= 500', '')}) GROUP BY doc_id, kind"
    return f"""WITH planted AS ({_planted_sql()})
SELECT c.*, g.s AS categories, w.s AS whitespace, coalesce(k.s, '') AS suspicious, coalesce(k.total, 0)::BIGINT AS total_suspicious, d.types, d.hapax_legomena, coalesce(f.s, '') AS words, true AS sentences_agree, 1::BIGINT AS code_blocks
FROM ({on(_counts_sql())}) c JOIN {bag(_categories_sql(), 'category', 'category')} g USING (doc_id) JOIN {bag(_whitespace_sql(), 'kind', 'kind')} w USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(kind || '=' || n, ';' ORDER BY kind) AS s, sum(n) AS total FROM ({kinds}) GROUP BY doc_id) k USING (doc_id)
JOIN ({on(_diversity_sql())}) d USING (doc_id) LEFT JOIN {bag(_words_sql(), 'word', 'rank')} f USING (doc_id)"""


def _scripts_sql() -> str:
    return f"""SELECT doc_id, CASE WHEN ch = 'ª' THEN 'FEMININE' WHEN ch = 'º' THEN 'MASCULINE' WHEN ch = 'µ' THEN 'MICRO' WHEN regexp_matches(ch, '\\p{{Latin}}') THEN 'LATIN' WHEN regexp_matches(ch, '\\p{{Cyrillic}}') THEN 'CYRILLIC' END AS script, count(*) AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{{L}}')) AS ch FROM ({_planted_sql()})) GROUP BY ALL"""


def _template_sql() -> str:
    lists = (readers._SUBJECTS, readers._VERBS, readers._OBJECTS, readers._TAILS)
    one = " || ' ' || ".join("[" + ", ".join(map(_q, v)) + f"][(k % {len(v)} + 1)::INT]" for v in lists)
    return f"SELECT id AS doc_id, string_agg({one} || '.', ' ' ORDER BY k) AS text FROM (SELECT k // 6 AS id, k FROM range(3000) t(k)) GROUP BY id"


ORACLE_SQL: dict[str, str] = {
    "lang_profile": _profile_sql("lang", "documents"),
    "label_profile": _profile_sql("quality", "(SELECT quality, text FROM documents JOIN labels USING (doc_id))"),
    "role_profile": _profile_sql("role", "conversations"),
    "text_counts": _counts_sql(),
    "unicode_categories": _categories_sql(),
    "punctuation_distribution": _chars_sql(T.PUNCTUATION),
    "whitespace_distribution": _whitespace_sql(),
    "lexical_diversity": _diversity_sql(),
    "baseline_counts": _record_sql(),
    "letter_scripts": _scripts_sql(),
    "stable_nfc": f"SELECT doc_id, nfc_normalize(text) = text AS nfc FROM ({_planted_sql()})",
    "sentence_lengths": f"SELECT doc_id, coalesce(count, 0) AS count, min, max, median FROM documents LEFT JOIN (SELECT doc_id, count(*) AS count, min(words) AS min, max(words) AS max, median(words) AS median FROM ({_sentences_sql()}) GROUP BY doc_id) USING (doc_id)",
    "sentence_histogram": f"SELECT doc_id, (words // 5 * 5) || '-' || (words // 5 * 5 + 4) AS bin, count(*) AS n FROM ({_sentences_sql()}) GROUP BY ALL",
    "moving_average_ttr": f"""WITH w AS (SELECT doc_id, {_LW} AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) >= 50 THEN round(list_sum(list_transform(range(1, len(w) - 48), lambda i: len(list_distinct(w[i:i + 49]))))::DOUBLE / (50.0 * (len(w) - 49)), 4) END AS moving_average_ttr FROM w""",
    "frequent_words": _words_sql(),
    "repeated_ngrams": _ranked_sql(" UNION ALL ".join(f"SELECT doc_id, {n} AS size, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS term, unnest(range(greatest(0, len(w) - {n} + 1))) AS pos FROM (SELECT doc_id, {_LW} AS w FROM documents)" for n in (2, 3, 4)), "doc_id, size", "ngram", 2),
    "unicode_findings": _findings_sql(f"({_planted_sql()})", "doc_id", "text"),
    "page_unicode_findings": _findings_sql("pages", "page_id", "html"),
    "unicode_kinds": f"SELECT doc_id, kind, count(*) AS n FROM ({_findings_sql(f'({_planted_sql()})', 'doc_id', 'text').replace(' WHERE rank <= 500', '')}) GROUP BY doc_id, kind",
    "clean_text": _clean_sql("documents"),
    "clean_planted": _clean_sql(f"({_planted_sql()})"),
    "pair_word_overlap": _bag_sql(_PAIR_WORDS, _DOC_PAIRS, "coalesce(jaccard, 1) AS jaccard, coalesce(multiset_overlap, 1) AS multiset_overlap, coalesce(cosine, 1) AS cosine"),
    "pair_char_cosine": _bag_sql(_PAIR_GRAMS, _TURN_PAIRS, "coalesce(cosine, 1) AS char_ngram_cosine"),
    "detect_keyed": _keyed_sql(KEY),
    "detect_planted": _keyed_sql(KEY, text=_composed_sql(), table=f"({_planted_sql()})"),
    "detect_vocabulary": _keyed_sql(KEY, vocabulary=VOCABULARY),
    "inspect_files": "SELECT * FROM (VALUES ('plain.png', 'png', 67, 'ABSENT', 'no credential bytes'), ('marked.png', 'png', 95, 'UNVERIFIABLE', 'credential bytes, but no reader of manifests'), ('text.png', 'png', 115, 'UNVERIFIABLE', 'a remote manifest is named; not fetched'), ('x.pdf', 'pdf', 23, 'UNVERIFIABLE', 'credential bytes, but no reader of manifests')) t(path, format, size_bytes, status, reason)",
    "audit_terms": "SELECT * FROM (VALUES ('torch', 2), ('jax', 1), ('spacy', 1)) t(item, n)",
    "static_audit": "SELECT * FROM (VALUES ('a.py', 2, 'forbidden_import', 'torch'), ('a.py', 3, 'forbidden_import', 'jax.numpy'), ('requirements.txt', 2, 'forbidden_dependency', 'spacy'), ('a.py', 2, 'reference', 'torch'), ('a.py', 3, 'reference', 'jax'), ('a.py', 4, 'reference', 'torch'), ('requirements.txt', 2, 'reference', 'spacy')) t(path, line, kind, item)",
    "detect_mock": "SELECT doc_id, score >= 0.5 AS detected, score, round(1 - score, 6) AS p_value, NULL::DOUBLE AS confidence, 'mock' AS detector_name, 'UNKNOWN' AS status FROM (SELECT doc_id, round(('0x' || substr(sha256(coalesce(text, '')), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0, 6) AS score FROM documents)",
    "detect_none": "SELECT doc_id, NULL::BOOLEAN AS detected, NULL::DOUBLE AS score, NULL::DOUBLE AS p_value, NULL::DOUBLE AS confidence, 'none' AS detector_name, 'UNKNOWN' AS status FROM documents",
    "search_results": "SELECT 'q' || page_id AS query, CASE WHEN page_id % 5 <> 0 THEN 1 END AS rank, CASE WHEN page_id % 5 <> 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title, CASE WHEN page_id % 5 <> 0 THEN url END AS url, NULL::VARCHAR AS snippet FROM pages",
    "template_prose": _template_sql(),
}
