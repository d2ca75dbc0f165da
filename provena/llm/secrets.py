"""Secret scans: patterns for the plain kinds, then structure for the rest.

The base kinds (assign, access, hex) are pattern matches.  Further kinds are only reported if the text
decodes to what it claims to be:

* ``jwt``: three base64url parts; header and claims are JSON objects and the header names an algorithm
* ``pem``: an armoured key whose body is base64 of nested DER lengths that fit exactly, an OpenSSH
  container with its length-prefixed fields, or cipher blocks under headers that name cipher and IV
* ``der``: base64 or hex, in either case, that decodes to such a key encoding (PKCS#1, PKCS#8, SEC1).
  Base64 may be url-safe, wrapped over lines, and begin anywhere in a run: the encoding says how long it is
* ``basic``: ``Basic`` with base64 of ``user:password`` in printable ASCII
* ``ssh``: a base64 run that begins an OpenSSH private container

Nulls count as empty texts: no span.  Rows are independent: one output row for each input row, also where
ids repeat.  Spans of one start go by kind as listed, then by end.  Long texts are scanned whole; a
candidate is decoded only as far as its own length says.  Other columns are not looked at.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from provena.llm.common import id_text, map_arrow, table, text_buffer

#: The base kinds, in the order in which they are listed when they start at one place.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "pem", "der", "ssh", "basic")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
#: Header lines of an encrypted key, with backslash-n for line ends where a key stands in a string.
_HEADERS = re.compile(r"(?:\s|\\[nr])*((?:[A-Za-z][A-Za-z-]*: [^\n\\]*(?:\n|\\n))+)")
_CIPHER = re.compile(r"DEK-Info: [A-Z0-9-]+,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\b")
#: Where base64 of a DER sequence of 40 to 65535 bytes can begin.
_SEQUENCE = re.compile(r"M[C-I](?=[A-Za-z0-9+/_-]{38}|[A-Za-z0-9+/_\\\s-]{60})")
_LONG = re.compile(r"[A-Za-z0-9+/_-]+")
#: Hex runs in capitals, or in both cases, that may hold a key; those in small letters are known already.
_CAPITALS = re.compile(r"30(?<![0-9A-F]30)[0-9A-F]{78,}")
_MIXED = re.compile(r"30(?<![0-9A-Fa-f]30)[0-9A-Fa-f]{78,}")
_SSH = re.compile(r"b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/]+={0,2}")
_BASIC = re.compile(r"\bBasic ([A-Za-z0-9+/]{8,}={0,2})")

_HEX = np.zeros(256, bool)
_HEX[48:58] = True
_HEX[97:103] = True


def unbase64(s: str, url: bool = False) -> bytes | None:
    s = re.sub(r"[\s\\]", "", s).rstrip("=")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of DER items that fill data exactly, or None."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, n, i = data[i], data[i + 1], i + 2
        if n >= 128:
            k = n & 127
            if not 1 <= k <= 4 or i + k > len(data):
                return None
            n, i = int.from_bytes(data[i : i + k], "big"), i + k
            if n < 128:
                return None
        if i + n > len(data):
            return None
        out.append((tag, data[i : i + n]))
        i += n
    return out


def key_kind(data: bytes) -> str | None:
    """What private key encoding data is: nested lengths must fit to the last byte."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return None
    items = der_items(top[0][1])
    if not items or items[0][0] != 0x02 or items[0][1] not in (b"\0", b"\1"):
        if items and len(items) == 2 and items[0][0] == 0x30 and items[1][0] == 0x04 and (a := der_items(items[0][1])) and a[0][0] == 0x06:
            return "pkcs8-encrypted"
        return None
    tags = [t for t, _ in items]
    if len(items) >= 9 and tags[:9] == [2] * 9:
        return "pkcs1"
    if tags[:3] == [0x02, 0x30, 0x04] and (a := der_items(items[1][1])) and a[0][0] == 0x06:
        return "pkcs8"
    if tags[:2] == [0x02, 0x04] and items[0][1] == b"\1" and 16 <= len(items[1][1]) <= 66:
        return "sec1"
    if len(items) == 6 and tags == [2] * 6:
        return "dsa"
    return None


def openssh_key(data: bytes) -> bool:
    """The container's magic and its first three length-prefixed strings."""
    if not data.startswith(b"openssh-key-v1\0"):
        return False
    i = 15
    for _ in range(3):
        if i + 4 > len(data):
            return False
        i += 4 + int.from_bytes(data[i : i + 4], "big")
    return i + 4 <= len(data)


def signed_token(s: str) -> bool:
    parts = s.split(".")
    try:
        head, claims = (json.loads(unbase64(p, url=True) or b"") for p in parts[:2])
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(claims, dict) and isinstance(head.get("alg"), str) and (head["alg"].lower() == "none" or unbase64(parts[2], url=True) is not None and len(parts[2]) >= 16)


def armoured(text: str) -> list[tuple[int, int]]:
    """Armoured private keys whose body is what it claims to be."""
    out, missing, at = [], set(), 0
    while m := _BEGIN.search(text, at):
        at = m.end()
        last = f"-----END {m[1]}-----"
        end = -1 if last in missing else text.find(last, at)
        if end < 0:
            missing.add(last)  # nor is it further on
            continue
        head = _HEADERS.match(text, at, end)
        data = unbase64(text[head.end() if head else at : end].replace("\\n", "").replace("\\r", ""))
        cipher = _CIPHER.search(head[1]) if head else None
        if data and (key_kind(data) or openssh_key(data) or cipher and len(data) >= 64 and len(data) % (len(cipher[1]) // 2) == 0):
            out.append((m.start(), end + len(last)))
    return out


def bare_keys(text: str) -> list[tuple[int, int]]:
    """Base64 of a key encoding without armour, from wherever a sequence may begin, over line ends if need be."""
    out, done = [], 0
    for m in _SEQUENCE.finditer(text):
        if m.start() < done:
            continue
        first = unbase64(re.sub(r"[\s\\].*", "", text[m.start() : m.start() + 8], flags=re.DOTALL).translate(_PLAIN_64))
        if not first or len(first) < 5:
            continue
        size = {0x81: 3 + first[2], 0x82: 4 + int.from_bytes(first[2:4], "big")}.get(first[1], 2 + first[1] if first[1] < 128 else 0)
        inner = first[{0x81: 3, 0x82: 4}.get(first[1], 2)]
        if size < 40 or inner not in (0x02, 0x30):
            continue
        # so many characters hold the encoding; line ends between them do not count
        need, have, at = -(-4 * size // 3), [], m.start()
        while need > 0 and (run := _LONG.match(text, at, at + need)):
            have.append(run[0])
            need -= len(run[0])
            at = run.end()
            if need > 0:
                gap = _GAP.match(text, at)
                at = gap.end() if gap else at
                if not gap:
                    break
        if need > 0:
            continue
        data = unbase64("".join(have).translate(_PLAIN_64))
        if data and key_kind(data[:size]):
            at += len(_PADDING.match(text, at)[0])
            out.append((m.start(), at))
            done = at
    return out


_GAP, _PADDING = re.compile(r"(?:\r?\n|\\r|\\n)[ \t]*"), re.compile("={0,2}")
_PLAIN_64 = str.maketrans("-_", "+/")


def structural_spans(text: str, hex_runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Spans that decode to key encodings or signed tokens."""
    out: list[tuple[str, int, int]] = []
    if "eyJ" in text:
        out += [("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if signed_token(m[0])]
    if "-----BEGIN " in text:
        out += [("pem", a, b) for a, b in armoured(text)]
    inside = lambda at: any(k == "pem" and a <= at < b for k, a, b in out)
    out += [("der", a, b) for a, b in bare_keys(text) if not inside(a)]
    more = {m.span() for x in (_CAPITALS, _MIXED) for m in x.finditer(text)}
    for a, b in [*hex_runs, *sorted(more.difference(hex_runs))]:
        if b - a >= 80 and text.startswith("30", a) and (b - a) % 2 == 0 and key_kind(bytes.fromhex(text[a:b])):
            out.append(("der", a, b))
    if "b3BlbnNzaC1rZXktdjEA" in text:
        out += [("ssh", m.start(), m.end()) for m in _SSH.finditer(text) if not inside(m.start()) and (d := unbase64(m[0])) and openssh_key(d)]
    if "Basic " in text:
        for m in _BASIC.finditer(text):
            data = unbase64(m[1])
            if data and b":" in data[1:] and all(32 <= c < 127 for c in data):
                out.append(("basic", m.start(1), m.end(1)))
    return out


def _hex_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and end of each maximal run of [0-9a-f] that is long enough; runs end with their text."""
    is_hex = np.zeros(len(buf) + 2, bool)
    is_hex[1:-1] = _HEX[buf]
    change = np.flatnonzero(is_hex[1:] != is_hex[:-1])
    lo, hi = change[::2], change[1::2]
    long = hi - lo >= LEAST_HEX
    lo, hi = lo[long], hi[long]
    starts, ends = [], []
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        cuts = offsets[(offsets > a) & (offsets < b)].tolist()
        for x, y in zip([a, *cuts], [*cuts, b], strict=True):
            if y - x >= LEAST_HEX:
                starts.append(x)
                ends.append(y)
    return np.array(starts, np.int64), np.array(ends, np.int64)


def scan(texts: pa.Array) -> list[list[tuple[str, int, int]]]:
    """All spans of each text, by start, then kind as listed, in code points."""
    buf, offsets = text_buffer(texts)
    lo, hi = _hex_runs(buf, offsets)
    owner = np.searchsorted(offsets, lo, side="right") - 1
    hexes: dict[int, list[tuple[int, int]]] = {}
    for k, a, b in zip(owner.tolist(), lo.tolist(), hi.tolist(), strict=True):
        hexes.setdefault(k, []).append((a - int(offsets[k]), b - int(offsets[k])))
    out = []
    for k, text in enumerate(texts.to_pylist()):
        text = text or ""
        spans = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
        if "AKIA" in text:
            spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        runs = hexes.get(k, [])
        if runs and not text.isascii():
            raw = text.encode()
            runs = [(a := len(raw[:x].decode()), a + y - x) for x, y in runs]
        spans += [("hex", a, b) for a, b in runs]
        spans += structural_spans(text, runs)
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
        out.append(spans)
    return out


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row."""
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [[{"kind": k, "start": a, "end": e} for k, a, e in s] for s in scan(b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(rows, struct)], ["doc_id", "spans"])

    return map_arrow(id_text(df, id_col, text_col), run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[{}]") -> str:
    """text with each span, or union of overlapping spans, replaced by the kind that starts it.

    Of an assignment only the value goes: the name before it stays."""
    cut: list[list] = []
    for kind, a, b in spans:
        if kind == "assign" and (m := _ASSIGN.match(text, a)):
            a = m.start(2)
        if cut and a < cut[-1][2]:
            cut[-1][2] = max(b, cut[-1][2])
        else:
            cut.append([kind, a, b])
    for kind, a, b in reversed(cut):
        text = text[:a] + mark.format(kind) + text[b:]
    return text


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with secrets in ``text`` replaced and ``n_chars``, if there, set anew; other columns unchanged."""
    schema = docs.schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            old, at = b["text"].to_pylist(), b.schema.get_field_index("text")
            new = [redacted(t, s) if s else t for t, s in zip(old, scan(b["text"]), strict=True)]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if (k := b.schema.get_field_index("n_chars")) >= 0:
                was = b["n_chars"].to_pylist()
                cols[k] = pa.array([len(x) if x != y else n for x, y, n in zip(new, old, was, strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return map_arrow(docs, run, schema)


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            doc, spans = b["doc_id"], [[(s["kind"], s["start"], s["end"]) for s in row] for row in b["spans"].to_pylist()]
            told = lambda row: ",".join(f"{k}:{a}:{e}" for k, a, e in row)
            base = [[s for s in row if s[0] in BASE] for row in spans]
            counts = [pa.array([sum(s[0] == k for s in row) for row in base], pa.int64()) for k in BASE]
            yield pa.RecordBatch.from_arrays([doc, *counts, pa.array([hashlib.sha256(told(r).encode()).hexdigest() for r in base]), pa.array([told(r) for r in spans])], [c.split()[0] for c in _OUT.split(", ")])

    return map_arrow(find_secrets(table(spark, sf_dir, "documents")), run, _OUT)
