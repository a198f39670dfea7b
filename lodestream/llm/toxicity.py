"""Toxic spans by a linear-chain conditional random field.

Tokens (runs of ASCII letters and digits and of all other characters that are
not ASCII, lower-cased A-Z) are tagged toxic or not. The field has hashed features of each
token (the word, its first and last letters, how strongly the word goes with the
toxic label) and weights for each pair of neighbouring tags. It is fitted to
tokens labelled from document labels: in a toxic document those words are toxic
that go with the label, all others aren't. Forward-backward gives each token's
marginal; a document's score is a logistic function, fitted to the document
labels, of its highest marginal, the sum of its marginals and their share.

Fitting uses a bounded sample, which the driver holds: of either label the
documents of least hash, SAMPLE_ROWS at most, until they have SAMPLE_CHARS
characters together, and of each no more than SAMPLE_TEXT, so that a very long text
can't crowd out its label. Near copies of a sampled text count once, as
chance words of a much copied text would pass for signs of its label. Tokens are
fitted in pieces of _SEGMENT, each begun like a text; scoring doesn't cut. Rows
of a class count as many as they stand for. Everything else covers all data:
each whole text is scored.

Defined cases: null and empty texts have no tokens and get the score that an
empty document gets; labels that are null or neither 0 nor 1 aren't learnt from;
an id with both labels counts as toxic; without any usable label every score is
0, with one class alone it is that class; repeated rows get equal scores; an
empty table gives no rows; other columns are kept by `with_toxicity`, but that
one called out_col is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.common import crc_mod, small_batches, table

#: Most documents of a label to learn from, and most characters of all of these.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 12_000_000
#: Characters of one text that the fit sees; scores are of whole texts.
SAMPLE_TEXT = 240_000
FEATURES = 1 << 18
#: A word goes with the label from this many toxic documents, this log ratio and this log-likelihood statistic on.
LEAST_DOCS, LEAST_RATIO, LEAST_G = 3, 1.5, 24.0
_SEGMENT = 128
#: Tokens whose marginals are computed at once while fitting, so that the driver holds no long arrays of floats.
_AT_ONCE = 1 << 18
_CACHE = 300_000
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Model:
    weights: np.ndarray  # of the hashed features
    ratios: dict[bytes, float]  # of words that go with a label, bounded by the sample
    pairs: np.ndarray  # [tag, next tag]
    start: float
    logistic: np.ndarray  # of (1, highest, log sum, share)


def _features(word: bytes, ratios: dict[bytes, float]) -> list[int]:
    r = ratios.get(word)
    step = 0 if r is None else int(np.clip(np.round(r), -3, 6)) + 4
    return [zlib.crc32(x) % FEATURES for x in (b"w" + word, b"p" + word[:3], b"q" + word[:6], b"s" + word[-3:], b"r%d" % step)]


def marginals(e: np.ndarray, lengths: np.ndarray, pairs: np.ndarray, start: float) -> np.ndarray:
    """P(toxic) of every token; e: emissions of all texts' tokens in a row, lengths: tokens of each text.

    All texts step at once: at step t those with over t tokens, the longest first.
    Messages are odds of the two tags.
    """
    if not len(e):
        return np.empty(0)
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # texts with over t tokens
    offset = np.concatenate([[0], np.cumsum(active)])
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    time = np.arange(len(e)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = offset[time] + np.repeat(rank, lengths)
    odds = np.empty(len(e))
    odds[place] = np.exp(np.clip(e, -30, 30))
    a = np.exp(pairs)
    low, high = 1e-30, 1e30
    forward = np.empty(len(e))
    now = np.clip(odds[:active[0]] * np.exp(start), low, high)
    forward[:active[0]] = now
    for t in range(1, steps):
        i, k = offset[t], active[t]
        now = now[:k]
        now = np.clip(odds[i:i + k] * ((a[0, 1] + now * a[1, 1]) / (a[0, 0] + now * a[1, 0])), low, high)
        forward[i:i + k] = now
    back = np.ones(len(e))
    for t in range(steps - 2, -1, -1):
        i, j, k = offset[t], offset[t + 1], active[t + 1]
        message = odds[j:j + k] * back[j:j + k]
        back[i:i + k] = np.clip((a[1, 0] + a[1, 1] * message) / (a[0, 0] + a[0, 1] * message), low, high)
    both = forward * back
    return (both / (1 + both))[place]


def _pair_marginals(e, lengths, pairs, start):
    """Expected counts of tag pairs and of a toxic start, and the token marginals."""
    p = marginals(e, lengths, pairs, start)
    first = np.zeros(len(e), bool)
    ends = np.cumsum(lengths)
    first[(ends - lengths)[lengths > 0]] = True
    at = np.flatnonzero(~first)
    # P(y[t-1], y[t]) from the two marginals and the local odds ratio of the pair
    theta = np.exp(pairs[0, 0] + pairs[1, 1] - pairs[0, 1] - pairs[1, 0])
    u, v = p[at - 1], p[at]
    if abs(theta - 1) < 1e-9:
        both = u * v
    else:
        s = 1 + (theta - 1) * (u + v)
        both = (s - np.sqrt(np.maximum(s * s - 4 * theta * (theta - 1) * u * v, 0))) / (2 * (theta - 1))
    both = np.clip(both, np.maximum(0, u + v - 1), np.minimum(u, v))
    n11, n01, n10 = both.sum(), (v - both).sum(), (u - both).sum()
    return p, np.array([[len(at) - n11 - n01 - n10, n01], [n10, n11]]), p[first].sum()


def _summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(1, highest, log sum, share) of each text."""
    n = len(lengths)
    out = np.zeros((n, 4))
    out[:, 0] = 1
    some = np.flatnonzero(lengths)
    if len(some):
        begin = (np.cumsum(lengths) - lengths)[some]
        total = np.add.reduceat(p, begin)
        out[some, 1], out[some, 2], out[some, 3] = np.maximum.reduceat(p, begin), np.log1p(total), total / lengths[some]
    return out


def _fit_logistic(x, y, w, ridge=1.0, rounds=50):
    b = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (y - p)) - penalty @ b
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, g)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _likelihood_ratio(a: int, n: int, b: int, m: int) -> float:
    """G statistic of a of n against b of m."""
    share = (a + b) / (n + m)
    cells = ((a, n * share), (n - a, n * (1 - share)), (b, m * share), (m - b, m * (1 - share)))
    return 2 * sum(o * np.log(o / e) for o, e in cells if o)


def _blocks(lengths: np.ndarray, most: int):
    """(texts, tokens) as ranges of neighbouring texts with about `most` tokens each."""
    ends = np.append(0, np.cumsum(lengths))
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        yield slice(a, b), slice(int(ends[a]), int(ends[b]))
        a = b


def distinct(split: Iterable[list[bytes]]) -> list[int]:
    """Numbers of the texts that are no near copy of an earlier one: of 16 minima of their words' hashes, no band of four agrees."""
    keys = np.random.default_rng(1).integers(1, 1 << 31, (16, 1), dtype=np.int64) | 1
    seen, stay = set(), []
    for i, ws in enumerate(split):
        h = np.fromiter((zlib.crc32(w) for w in {*ws}), np.int64, len({*ws}))
        least = (h * keys & 0xFFFFFFFF).min(axis=1, initial=1 << 40).tolist()
        bands = {(b, *least[b:b + 4]) for b in range(0, 16, 4)}
        if not bands & seen:
            stay.append(i)
        seen |= bands
    return stay


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, rounds: int = 80, rate: float = 0.3, ridge: float = 1e-4) -> Model:
    """The model of labelled texts."""
    constant = lambda b: Model(np.zeros(FEATURES), {}, np.zeros((2, 2)), 0.0, np.array([b, 0.0, 0.0, 0.0]))
    if len(set(labels.tolist())) < 2:
        return constant(0.0 if not len(labels) else 30.0 if labels[0] else -30.0) if len(labels) else constant(-40.0)
    stay = distinct(map(tokens, texts))  # copies would pass chance words off as signs of their label
    if len(set(labels[stay].tolist())) == 2:
        texts, labels, weights = [texts[i] for i in stay], labels[stay], weights[stay]
    # words by number from here on: a list of them takes ten times the memory
    ids: dict[bytes, int] = {}
    parts = []
    for text in texts:
        ws = tokens(text)
        parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int32, len(ws)))
    docs = np.zeros((2, len(ids)), np.int64)
    for part, y in zip(parts, labels.tolist()):
        docs[y, np.unique(part)] += 1
    n = [int((labels == y).sum()) for y in (0, 1)]
    ratios = {}
    for w, b, c in zip(ids, *docs.tolist()):
        if c < LEAST_DOCS:
            continue
        r = np.log((c + 0.5) / (n[1] + 1)) - np.log((b + 0.5) / (n[0] + 1))
        if r >= LEAST_RATIO and _likelihood_ratio(c, n[1], b, n[0]) >= LEAST_G:
            ratios[w] = float(r)
    lengths = np.array([len(x) for x in parts], np.int64)
    flat = np.concatenate(parts)
    del parts, docs
    feats = np.fromiter((x for w in ids for x in _features(w, ratios)), np.int32).reshape(len(ids), -1)
    marked = np.array([w in ratios for w in ids], bool)
    y = marked[flat] & np.repeat(labels == 1, lengths)
    pieces = [min(_SEGMENT, k - a) for k in lengths.tolist() for a in range(0, k, _SEGMENT)]
    pieces = np.array(pieces, np.int64)
    inner = np.ones(len(flat), bool)
    inner[np.cumsum(pieces) - pieces] = False
    pair = (2 * y[:-1].view(np.int8) + y[1:].view(np.int8))[inner[1:]]
    seen = np.bincount(pair, minlength=4).reshape(2, 2).astype(float)
    del pair
    started = y[~inner].sum()
    w, pairs, start = np.zeros(FEATURES), np.zeros((2, 2)), 0.0
    gw, gp, gs = np.full(FEATURES, 1e-8), np.full((2, 2), 1e-8), 1e-8
    share = 1.0 / max(1, y.sum())
    for _ in range(rounds):  # AdaGrad on the whole sample
        of_word, d, expected, began = w[feats].sum(axis=1), np.zeros(len(ids)), np.zeros((2, 2)), 0.0
        for some, mine in _blocks(pieces, _AT_ONCE):
            p, expected_here, began_here = _pair_marginals(of_word[flat[mine]], pieces[some], pairs, start)
            d += np.bincount(flat[mine], weights=y[mine] - p, minlength=len(ids))
            expected, began = expected + expected_here, began + began_here
        d *= share
        g = np.zeros(FEATURES)
        for j in range(feats.shape[1]):
            g += np.bincount(feats[:, j], weights=d, minlength=FEATURES)
        g -= ridge * w
        gw += g * g
        w = w + rate * g / np.sqrt(gw)
        g = (seen - expected) * share - ridge * pairs
        gp += g * g
        pairs = pairs + rate * g / np.sqrt(gp)
        g = (started - began) * share - ridge * start
        gs += g * g
        start = start + rate * g / np.sqrt(gs)
    summary, of_word, begin = np.zeros((len(lengths), 4)), w[feats].sum(axis=1), np.cumsum(lengths) - lengths
    by_size = np.argsort(lengths, kind="stable")  # long texts, of which each step has few tokens, together
    for some, _ in _blocks(lengths[by_size], 4 * _AT_ONCE):
        which = by_size[some]
        mine = np.concatenate([flat[begin[i]:begin[i] + lengths[i]] for i in which.tolist()])
        summary[which] = _summary(marginals(of_word[mine], lengths[which], pairs, start), lengths[which])
    logistic = _fit_logistic(summary, labels.astype(float), weights)
    return Model(w.astype(np.float32), ratios, pairs, float(start), logistic)


class _Emissions(dict):
    """Word to emission; afresh from _CACHE words on."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word):
        v = self[word] = float(self.model.weights[_features(word, self.model.ratios)].sum())
        return v


def _spans(text: str, p: np.ndarray, least: float = 0.5) -> list[dict]:
    """Code-point spans of the tokens whose marginal is at least `least`."""
    data = text.encode("utf-8", "surrogatepass")
    plain, low = text.isascii(), data.translate(_TABLE)
    at = lambda i: i if plain else len(data[:i].decode("utf-8", "surrogatepass"))
    return [{"start": at(m.start()), "end": at(m.end()), "marginal": float(x)} for m, x in zip(_TOKEN.finditer(low), p) if x >= least]


def _score_texts(texts, model: Model, emissions: _Emissions, spans: bool):
    if len(emissions) > _CACHE:
        emissions.clear()
    split = [tokens(t) for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    e = np.fromiter((emissions[w] for ws in split for w in ws), np.float64, int(lengths.sum()))
    p = marginals(e, lengths, model.pairs, model.start)
    scores = 1 / (1 + np.exp(-np.clip(_summary(p, lengths) @ model.logistic, -35, 35)))
    found = [[]] * len(split)
    if spans:
        ends = np.cumsum(lengths)
        for i in np.flatnonzero(_summary(p, lengths)[:, 1] >= 0.5):
            found[i] = _spans(texts[i], p[ends[i] - lengths[i]:ends[i]])
    return scores, found


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity", spans: bool = True) -> DataFrame:
    """docs with out_col: (score, spans), spans the (start, end, marginal) of toxic tokens in code points."""
    small_batches(docs.sparkSession)

    def score(batches):
        emissions = _Emissions(model)
        for texts in batches:
            scores, found = _score_texts(texts.fillna("").tolist(), model, emissions, spans)
            yield pd.DataFrame({"score": scores, "spans": found})

    from collections.abc import Iterator
    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(score, "score double, spans array<struct<start:long,end:long,marginal:double>>")
    return docs.withColumn(out_col, udf(F.coalesce(F.col(text_col), F.lit(""))))


def fit_on(docs: DataFrame, labels: DataFrame, keep=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """The model of a bounded sample of labelled rows. keep: condition on the label table's rows."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if keep is not None:
        known = known.where(keep)
    known = known.groupBy(F.col(id_col).alias("tox_id")).agg(F.max(label_col).cast("int").alias("tox_label"))
    totals = dict(known.groupBy("tox_label").count().collect())
    picked = None
    for y in (0, 1):
        some = known.where(F.col("tox_label") == y).orderBy(F.xxhash64("tox_id"), "tox_id").limit(rows)
        picked = some if picked is None else picked.union(some)
    # 2 * rows pairs of numbers at most
    sample = docs.select(F.col(id_col).alias("tox_of"), F.coalesce(F.col(text_col), F.lit("")).alias("tox_text")).join(
        F.broadcast(picked), F.col("tox_of") == F.col("tox_id"))
    # one text of each id, so that the window has as many rows as were picked at most
    sample = sample.groupBy("tox_id").agg(F.first("tox_label").alias("tox_label"), F.min(F.struct(F.xxhash64("tox_text"), F.substring("tox_text", 1, SAMPLE_TEXT).alias("text"))).alias("tox_least"))
    sample = sample.select("tox_id", "tox_label", F.col("tox_least.text").alias("tox_text"), F.length("tox_least.text").cast("long").alias("tox_length"))
    upto = Window.partitionBy("tox_label").orderBy(F.xxhash64("tox_id"), "tox_id").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("tox_length").over(upto) - F.col("tox_length")
    sample = sample.withColumn("tox_before", before).where(F.col("tox_before") < SAMPLE_CHARS).select("tox_id", "tox_text", "tox_label").collect()
    sample.sort()
    y = np.array([r.tox_label for r in sample], np.int64)
    share = {k: totals[k] / max(1, int((y == k).sum())) for k in totals}
    w = np.array([share[k] for k in y.tolist()], float)
    return fit([r.tox_text for r in sample], y, w / w.mean() if len(w) else w)


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on(docs, table(spark, sf_dir, "labels"), keep=crc_mod("doc_id", 5) != 0)
    scored = with_toxicity(docs, model, spans=True)
    return scored.select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.transform("toxicity.spans", lambda s: F.struct(s["start"], s["end"])).alias("spans"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
