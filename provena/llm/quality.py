"""Quality rules: fixed counts, then a linear-chain CRF over the lines of a document.

Each line with a word is marked content or boilerplate by Viterbi decoding; the share of words in
content lines decides.  The CRF is fitted here, from zero weights, on a bounded sample of labelled
documents: ``SAMPLE`` of each class, the smallest ids, and ``SAMPLE_LINES`` lines of each, the first.
Labels are of documents, marks are of lines.  A line of the sample scores by how much more often lines
with the same features are in good documents than in bad ones; each document takes its best marks under
these scores and a fixed cost of a change of marks.  Where a content share contradicts the label, one
mark gets a bonus, no larger than needed.  Then the weights are fitted to the marks by ascent on the
conditional likelihood.  Everything else runs over all rows, one pass, no shuffle.

Nulls and empty texts have no words and fail the base rules.  Without labels of both classes nothing is
fitted and the base rules alone decide.  Documents with both labels are left out of the sample, and so are
all rows but one of an id.  Rows that repeat an id are judged one by one.  Ties between marks go to
content.  Long texts are described whole, some forty bytes a byte of text at a time.  Other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import batches, doc_of, id_text, map_arrow, mix, span_hashes, table, text_buffer, window_hashes, window_mask, word_hashes

SAMPLE, SAMPLE_LINES = 400, 64
#: What a change of marks costs before anything is fitted: lines that tell nothing go with their neighbours.
FIRST_SWITCH = np.array([[0.0, -1.0], [-1.0, 0.0]])
#: Bytes of text whose lines are described at once.
PART = 1 << 20
MIN_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: Below this share of words in content lines a document goes.
LEAST_CONTENT = 0.5
SYMBOLS = b"#*$%&|<>"
FEATURES = ("bias", "short", "very_short", "symbols", "many_symbols", "upper", "bang", "digits", "bars", "repeated", "long_words", "no_stop", "no_common", "stutter")

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_LOWER = np.zeros(256, bool)
_IS_LOWER[97:123] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
_IS_START = np.ones(256, bool)  # not a UTF-8 continuation byte
_IS_START[128:192] = False


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def repeated_words(h: np.ndarray, woff: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """For each text, how many words lie in an n-word window that the text has at least twice."""
    w = window_hashes(h, n)
    inside = np.flatnonzero(window_mask(woff, n, len(w)))
    if not len(inside):
        return np.zeros(len(woff) - 1, np.int64)
    doc = doc_of(woff)
    key = mix(w[inside] + doc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    cover = np.zeros(len(h) + 1, np.int32)
    if len(twice):
        at = np.searchsorted(twice, key)
        hit = inside[twice[np.minimum(at, len(twice) - 1)] == key]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + n, -1)
    total = _sums(np.cumsum(cover[:-1]) > 0)
    return total[woff[1:]] - total[woff[:-1]]


def line_table(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text and features of each of its lines that has a word."""
    h, woff, starts, ends, buf = word_hashes(texts)
    _, off = text_buffer(texts)
    chars = _sums(_IS_START[buf])
    symbols = _sums(_IS_SYMBOL[buf])
    out = {"n_words": np.diff(woff), "n_symbols": symbols[off[1:]] - symbols[off[:-1]], "n_repeat_words": repeated_words(h, woff)}
    c = _sums(chars[ends] - chars[starts])
    out["word_chars"] = c[woff[1:]] - c[woff[:-1]]
    # lines: of words that start after the same newline of the same text
    newline = np.zeros(len(buf) + 1, np.int64)
    newline[1:] = buf == 10
    newline[off[1:-1][off[1:-1] < len(buf)]] += 1  # texts begin new lines
    number = np.cumsum(newline)
    line_of_word = number[starts]
    first = np.flatnonzero(np.r_[True, line_of_word[1:] != line_of_word[:-1]]) if len(starts) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(starts)] - 1 if len(first) else first
    doc = np.searchsorted(woff, first, side="right") - 1
    # the line's bytes, white space at its ends included: two lines are equal if these are
    breaks = np.flatnonzero(buf == 10)
    k = np.searchsorted(breaks, starts[first])
    lo = np.maximum(np.r_[-1, breaks][k] + 1, off[doc])
    hi = np.minimum(np.r_[breaks, len(buf)][k], off[doc + 1])
    key = mix(span_hashes(buf, lo, hi) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[at] = False
    out["n_dup_lines"] = np.bincount(doc[again], minlength=len(woff) - 1)
    seen = lambda mask: (s := _sums(mask[buf]))[hi] - s[lo]
    words = last - first + 1
    size = np.maximum(1, seen(_IS_START))
    up, low, dig = seen(_IS_UPPER), seen(_IS_LOWER), seen(_IS_DIGIT)
    bars = _sums(buf == 124)
    bang = _sums((buf == 33) | (buf == 63))
    stop = np.isin(buf[np.maximum(ends[last] - 1, 0)], np.frombuffer(b".!?:;\"')", np.uint8)) if len(first) else np.zeros(0, bool)
    short_words = _sums((ends - starts) <= 3)
    twin = _sums(np.r_[h[1:] == h[:-1], np.zeros(min(1, len(h)), bool)])
    sym = (symbols[hi] - symbols[lo]) / size
    f = np.zeros((len(first), len(FEATURES)), np.float64)
    f[:, 0] = 1
    f[:, 1] = words < 8
    f[:, 2] = words < 3
    f[:, 3] = sym > 0.02
    f[:, 4] = sym > 0.08
    f[:, 5] = (up > 0.6 * np.maximum(1, up + low)) & (words >= 3)
    f[:, 6] = (bang[hi] - bang[lo]) > 0.5 * words
    f[:, 7] = dig > 0.25 * size
    f[:, 8] = (bars[hi] - bars[lo]) > 0.2 * words
    f[:, 9] = again
    f[:, 10] = (size - words + 1) > 12 * words
    f[:, 11] = ~stop
    f[:, 12] = (short_words[last + 1] - short_words[first]) < 0.1 * words if len(first) else 0
    f[:, 13] = (twin[last] - twin[first] > 0.25 * words) if len(first) else 0
    return out | {"doc": doc, "words": words, "features": f}


class Chains:
    """Runs of lines of one document each; all advance together, a line a step, the longest first."""

    def __init__(self, doc: np.ndarray):
        self.n = len(doc)
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if self.n else np.zeros(0, np.int64)
        length = np.diff(np.r_[first, self.n])
        order = np.argsort(-length, kind="stable")
        self.first, self.length = first[order], length[order]
        self.steps = int(self.length[0]) if self.n else 0

    def at(self, step: int) -> np.ndarray:
        """The lines at this step of the chains that are so long."""
        return self.first[: int(np.searchsorted(-self.length, -step, side="left"))] + step


def viterbi(score: np.ndarray, doc: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best marks (1: content) of each chain; score: of content minus boilerplate; trans: of each pair of marks."""
    chains = Chains(doc)
    mark, back = np.zeros(chains.n, np.int8), np.zeros((chains.n, 2), np.int8)
    best = np.zeros((chains.n, 2))
    best[chains.first, 1] = score[chains.first]
    for step in range(1, chains.steps):
        at = chains.at(step)
        way = best[at - 1][:, :, None] + trans[None]
        back[at] = way[:, 1] >= way[:, 0]
        best[at] = way.max(1)
        best[at, 1] += score[at]
    for step in range(chains.steps - 1, -1, -1):
        at = chains.at(step)
        on = len(chains.at(step + 1))  # chains that go on: their next mark says which this one is
        mark[at[on:]] = best[at[on:], 1] >= best[at[on:], 0]
        mark[at[:on]] = back[at[:on] + 1, mark[at[:on] + 1]]
    return mark


def likelihood(score: np.ndarray, chains: Chains, marks: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the marks, and its slope by each line's score and by each transition."""
    n = chains.n
    node = np.stack([np.zeros(n), score], 1)
    fwd, bwd, total = node.copy(), np.zeros((n, 2)), np.zeros(n)
    for step in range(1, chains.steps):
        at = chains.at(step)
        p = fwd[at - 1][:, :, None] + trans[None]
        fwd[at] += np.logaddexp(p[:, 0], p[:, 1])
    for step in range(chains.steps - 1, -1, -1):
        at = chains.at(step)
        on = len(chains.at(step + 1))
        total[at[on:]] = np.logaddexp(fwd[at[on:], 0], fwd[at[on:], 1])
        total[at[:on]] = total[at[:on] + 1]
        q = trans[None] + (node[at[:on] + 1] + bwd[at[:on] + 1])[:, None, :]
        bwd[at[:on]] = np.logaddexp(q[:, :, 0], q[:, :, 1])
    post = np.exp(fwd + bwd - total[:, None])
    later = np.ones(n, bool)
    later[chains.first] = False
    i = np.flatnonzero(later)
    pair = np.exp(fwd[i - 1][:, :, None] + trans[None] + (node[i] + bwd[i])[:, None, :] - total[i][:, None, None]).sum(0)
    seen = np.bincount(2 * marks[i - 1] + marks[i], minlength=4).reshape(2, 2)
    value = float((marks * score).sum() + (seen * trans).sum() - total[chains.first].sum())
    return value, marks - post[:, 1], seen - pair


def fit(features: np.ndarray, doc: np.ndarray, marks: np.ndarray, rounds: int = 150, rate: float = 0.2, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and transition weights, from zero, by ascent with moments (Adam).

    Each switch has a weight of its own.  Staying has none, so that what speaks for a mark at every line is
    in the features and holds for documents of one line too."""
    chains, marks = Chains(doc), np.asarray(marks, np.int64)
    x = np.zeros(features.shape[1] + 2)
    switches = lambda x: np.array([[0.0, x[-2]], [x[-1], 0.0]])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        _, by_line, by_pair = likelihood(features @ x[:-2], chains, marks, switches(x))
        slope = np.r_[features.T @ by_line, by_pair[0, 1], by_pair[1, 0]] / max(1, chains.n) - ridge * x
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        x = x + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return x[:-2], switches(x)


def marks_by_label(score: np.ndarray, doc: np.ndarray, words: np.ndarray, good: np.ndarray, trans: np.ndarray, least: float) -> np.ndarray:
    """Best marks of each document such that its content share agrees with its label."""
    size = np.maximum(1, np.bincount(doc, words))
    bonus = np.zeros(len(size))
    for step in (0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
        marks = viterbi(score + bonus[doc], doc, trans)
        wrong = (np.bincount(doc, words * marks) / size >= least) != good
        if not wrong.any() or step == 32.0:
            break
        bonus[wrong] = np.where(good, 1, -1)[wrong] * max(0.5, 2 * step)
    return marks


def first_scores(features: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Before anything is fitted: how much more often lines with just these features are in good documents."""
    _, which = np.unique(features, axis=0, return_inverse=True)
    rate = lambda m: (np.bincount(which, m) + 0.5) / (m.sum() + 1)
    return np.log(rate(good) / rate(~good))[which]


def fit_from_labels(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, lines: int = SAMPLE_LINES) -> tuple[np.ndarray, np.ndarray] | None:
    """Fits on at most ``most`` documents of each quality label, the smallest doc_ids, and the first ``lines``
    lines of each; of their texts only line features come to the driver."""
    told = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"), F.max("quality").alias("z")).filter("y = z")
    wanted = {r.doc_id: int(r.y) for y in (0, 1) for r in told.filter(F.col("y") == y).orderBy("doc_id").limit(most).collect()}
    if len(set(wanted.values())) < 2:
        return None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, PART):
            t = line_table(b["text"])
            cuts = np.r_[0, np.flatnonzero(np.diff(t["doc"])) + 1, len(t["doc"])].tolist() if len(t["doc"]) else [0]
            for i, j in zip(cuts, cuts[1:], strict=False):
                j = min(j, i + lines)
                parts = [pa.array([x], pa.list_(k)) for x, k in ((t["features"][i:j].ravel(), pa.float64()), (t["words"][i:j], pa.int64()))]
                yield pa.RecordBatch.from_arrays([b["doc_id"][int(t["doc"][i]) : int(t["doc"][i]) + 1], *parts], ["doc_id", "f", "words"])

    rows = map_arrow(id_text(docs).filter(F.col("doc_id").isin(sorted(wanted))), run, "doc_id long, f array<double>, words array<long>").collect()
    rows = sorted({r.doc_id: r for r in sorted(rows, key=lambda r: (r.words, r.f))}.values(), key=lambda r: r.doc_id)
    if len({wanted[r.doc_id] for r in rows}) < 2:
        return None
    doc = np.repeat(np.arange(len(rows)), [len(r.words) for r in rows])
    f, words = np.array([x for r in rows for x in r.f]).reshape(-1, len(FEATURES)), np.array([x for r in rows for x in r.words])
    return fit_from_documents(f, doc, words, np.array([wanted[r.doc_id] == 1 for r in rows]))


def fit_from_documents(features: np.ndarray, doc: np.ndarray, words: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights from lines whose documents alone have labels."""
    return fit(features, doc, marks_by_label(first_scores(features, good[doc]), doc, words, good, FIRST_SWITCH, LEAST_CONTENT))


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def verdicts(t: dict[str, np.ndarray], n: int, weights: tuple[np.ndarray, np.ndarray] | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of n texts fail the base rules, which are kept, and the share of each one's words in content lines."""
    failed = (t["n_words"] < MIN_WORDS) | (100 * t["n_repeat_words"] > MOST_REPEATED * t["n_words"])
    if weights is None:
        return failed, ~failed, np.ones(n)
    content = viterbi(t["features"] @ weights[0], t["doc"], weights[1]) * t["words"]
    share = np.bincount(t["doc"], content, minlength=n) / np.maximum(1, t["n_words"])
    return failed, ~failed & (share >= least), share


def judge(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray] | None, least: float = LEAST_CONTENT) -> DataFrame:
    """One row for each row of docs: its counts, whether the base rules fail it, whether it is kept."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, PART):
            t = line_table(b["text"])
            failed, kept, share = verdicts(t, b.num_rows, weights, least)
            ints = [pa.array(t[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *ints, pa.array(failed), pa.array(kept), pa.array(share)], [x.split()[0] for x in OUT.split(", ")])

    return map_arrow(id_text(docs), run, OUT)


def kept_documents(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray] | None, least: float = LEAST_CONTENT) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, PART):
            yield b.filter(pa.array(verdicts(line_table(b["text"]), b.num_rows, weights, least)[1]))

    return map_arrow(docs, run, docs.schema)


def weights_for(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[np.ndarray, np.ndarray] | None:
    return fit_from_labels(docs, table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, weights_for(spark, docs, sf_dir))
