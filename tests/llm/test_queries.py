"""The registered queries themselves, on whole small tables, against brute force or DuckDB."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest

from provena.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return {i: t or "" for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}


def rows(frame):
    return sorted(repr(tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_equal_to_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got, want = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns), duck.sql(queries.ORACLE_SQL[name])
    assert rows(got) == rows(pd.DataFrame(want.fetchall(), columns=want.columns)) and len(got)


def lower(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_op1(spark, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op1_lm"](spark, SF).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    toks = {i: [*WORD.findall(lower(t)), None] for i, t in texts.items()}
    c = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    assert len(got) == len(texts) and sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_op3(spark, texts):
    import tiktoken

    from provena.llm.bpe import read_ranks

    lib = tiktoken.Encoding("lib", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in queries.QUERIES["op3_bpe"](spark, SF).collect()}
    for i, t in texts.items():
        ids = lib.encode_ordinary(t)
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op4(spark, duck):
    import html

    got = {r.page_id: r for r in queries.QUERIES["op4_html"](spark, SF).collect()}
    pages = duck.sql("SELECT page_id, url, html FROM pages").fetchall()
    for i, url, page in pages:
        inner = re.sub(r"</?(b|i|a)\b[^>]*>", "", re.search("<article>(.*?)</article>", page, re.DOTALL)[1])
        text = " ".join(html.unescape(re.sub("<[^>]*>", "\n", inner)).split())
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, text, len(text))
    assert len(got) == len(pages)


def test_op6(spark, texts):
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))
    got = {r.doc_id: r for r in queries.QUERIES["op6_secrets"](spark, SF).collect()}
    for i, t in texts.items():
        spans = sorted((m.start(), k, m.end(), name) for k, (name, p, group, least) in enumerate(kinds) for m in p.finditer(t) if len(m[group]) >= least)
        told = ",".join(f"{name}:{a}:{b}" for a, _, b, name in spans)
        r, n = got[i], Counter(s[3] for s in spans)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (n["assign"], n["access"], n["hex"], hashlib.sha256(told.encode()).hexdigest())
        assert set(told.split(",")) - {""} <= set(r.spans.split(","))


def test_op7(spark, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op7_quality"](spark, SF).collect()}
    for i, t in texts.items():
        ws, r = WORD.findall(t), got[i]
        lines = [x for x in t.split("\n") if WORD.search(x)]
        places = defaultdict(list)
        for k in range(len(ws) - 7):
            places[tuple(ws[k : k + 8])].append(k)
        repeat = {k + j for at in places.values() if len(at) > 1 for k in at for j in range(8)}
        failed = len(ws) < 20 or 100 * len(repeat) > 30 * len(ws)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(ws), sum(map(len, ws)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(repeat), failed)
        assert not (failed and r.kept)


def test_op8(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.QUERIES["op8_packing"](spark, SF).collect():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert len(part) == 4 * r.length and r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        assert [a for a, _ in sorted(pieces[i])] + [len(x)] == [0, *np.cumsum([n for _, n in sorted(pieces[i])]).tolist()]
    for s in sequences.values():
        assert [a for a, _ in sorted(s)] == [0, *np.cumsum([n for _, n in sorted(s)])[:-1].tolist()] and sum(n for _, n in s) <= 2048
    total = sum(map(len, ids.values()))
    assert len(sequences) <= 1.01 * total / 2048 + 1
