"""Line deduplication by winnowing: equal runs of lines, and equal runs of words inside lines.

A word is deleted if it lies in
- a run of whole lines with at least MIN_WORDS words, or
- a run of RUN_WORDS words, wherever it begins and whatever white space it has,
that stands at an earlier place too: in order of document id, then position. A
run of words and its earlier place don't overlap.

Winnowing over line hashes selects from each window (a shortest run of lines
with MIN_WORDS words, from each line on and up to each line) the line of least
hash, the last of equals. Lines can be of any length, so the same is done on
words: their hashed runs of GRAM words are the units, a window has RUN_WORDS
words, and the least hash in it is its fingerprint. Equal windows select the
same fingerprint, so every repeated run shares one with its earlier place.
Fingerprints found at one place only go first. Then positions are joined: a
fingerprint's places carry the stretch of text over which it is the least, and
its hash. Places of equal stretches repeat the first of them as a whole. Where
a fingerprint has several stretches, one place of each is extended both ways:
every window that the fingerprint was selected from is looked up among the same
fingerprint's others, so a match ends at the very word where the texts part.
Texts are equal here if two 64-bit hashes are, the fingerprint's and the run's.

Nothing is paired: a fingerprint that a third of all documents share gives one
first place for each stretch by a min aggregation.

Defined cases: a null or empty text has no words and stays as it is; a null id
sorts first; rows with equal id and text are one document and all are treated
as it is; texts with equal ids are ordered by their hash; an empty table gives
no rows; other columns are kept by `dedup_lines` whatever their names, but that one called
removed_col is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import small_batches, stored, table

#: Least words of a repeated run of lines, and of a repeated run of words.
MIN_WORDS, RUN_WORDS = 12, 50
#: Words whose hash is a unit of winnowing.
GRAM = 8
#: Slots of the table that tells which documents have no place worth a look; its size is fixed.
SLOTS = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ld_span: first word of a stretch, the word after it, and whether it is of lines, in 32, 31 and 1 bits.
_MARKS = "ld_id long, ld_hash long, ld_fp long, ld_run long, ld_span long"
_CALL_BYTES = 1 << 20
_BASE, _OTHER, _BYTES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, n of them or more."""
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = np.cumprod(np.append(np.uint64(1), np.full(n + n // 4, base, np.uint64)))
    return _POWERS[base]


class _Runs:
    """Hashes of runs of a sequence of hashes."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes)
        self.back = _powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _powers(base, n)[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


@dataclass
class Words:
    """All words of several texts, one after the other."""
    doc: np.ndarray  # number of each word's text
    begin: np.ndarray  # first byte of each word, of all bytes
    end: np.ndarray
    hashes: np.ndarray
    lines: np.ndarray  # first word of each line that holds some, and the number of words at last
    line_hashes: np.ndarray
    first: np.ndarray  # first word of each text


def words_of(texts: list[bytes]) -> Words:
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_at = np.cumsum(sizes) - sizes + 1
    blank = _SPACE[data]
    begin, end = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    runs = _Runs(data.astype(np.uint64) + np.uint64(1), _BYTES)
    first = np.searchsorted(begin, text_at)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(begin))))
    line = np.cumsum(data == 10, dtype=np.int32)[begin]
    lines = np.flatnonzero(np.append(True, line[1:] != line[:-1])[:len(line)])
    last = np.append(lines[1:], len(begin))[:len(lines)] - 1
    return Words(doc, begin, end, runs.of(begin, end), np.append(lines, len(begin)), runs.of(begin[lines], end[last]),
                 first)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Of each window of so many values the place of the least, the last of equals."""
    at, best, have = np.arange(len(values)), values, 1
    while have < width:
        step = min(have, width - have)
        left, right = slice(0, max(0, len(best) - step)), slice(step, None)
        take = best[right] <= best[left]
        at, best = np.where(take, at[right], at[left]), np.where(take, best[right], best[left])
        have += step
    return at


def word_marks(hashes: np.ndarray, doc: np.ndarray, run: int = RUN_WORDS, gram: int = GRAM):
    """(fingerprint, hash of the stretch, its first and end) of the words of several texts; doc: number of each word's text."""
    gram = min(gram, run)
    n = len(hashes) - run + 1
    if n < 1:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    grams = _Runs(hashes, _BASE)
    start = np.arange(len(hashes) - gram + 1)
    fp = grams.of(start, start + gram)
    at = least_of(fp, run - gram + 1)
    whole = np.flatnonzero(doc[:n] == doc[run - 1:])  # windows within one text
    chosen = at[whole]
    new = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (whole[1:] != whole[:-1] + 1))[:len(chosen)])
    place, first = chosen[new], whole[new]
    end = whole[np.append(new[1:], len(whole))[:len(new)] - 1] + run
    stretch = _Runs(hashes, _OTHER).of(first, end)
    return fp[place], _mixed(stretch + (place - first).astype(np.uint64)), first, end


def line_marks(hashes: np.ndarray, begin: np.ndarray, doc: np.ndarray, min_words: int):
    """(fingerprint, hash of the window, first and last line) of each window of lines.

    begin: first word of each line, and the end; doc: number of each line's text.
    Windows are the shortest runs of min_words words from each line on and up to each line.
    """
    n = len(hashes)
    i = np.arange(n)
    last = np.searchsorted(begin, begin[:-1] + min_words, side="left") - 1
    first = np.searchsorted(begin, begin[1:] - min_words, side="right") - 1
    a, b = np.concatenate([i, first]), np.concatenate([last, i])
    whole = (a >= 0) & (b < n)
    a, b = a[whole], b[whole]
    a, b = np.divmod(np.unique(a[doc[a] == doc[b]] * (n + 1) + b[doc[a] == doc[b]]), n + 1)
    at = a.copy()
    for k in range(1, int((b - a).max(initial=0)) + 1):  # under min_words, as a line has a word
        inside = np.flatnonzero(a + k <= b)
        less = hashes[a[inside] + k] <= hashes[at[inside]]
        at[inside[less]] = a[inside[less]] + k
    run = _Runs(hashes, _OTHER).of(a, b + 1)
    return hashes[at], _mixed(run + (at - a).astype(np.uint64) + np.uint64(1)), a, b


def marks_of(texts: list[bytes], min_words: int, run_words: int):
    """(text's number, fingerprint, run hash, first, end, of lines), as arrays."""
    w = words_of(texts)
    fp, run, first, end = word_marks(w.hashes, w.doc, run_words)
    of_line = w.doc[w.lines[:-1]]
    line_fp, line_run, a, b = line_marks(w.line_hashes, w.lines, of_line, min_words)
    of = np.concatenate([of_line[a], w.doc[first]])
    back = w.first[of]
    both = lambda x, y: np.concatenate([x, y])
    return of, both(line_fp, fp), both(line_run, run), both(w.lines[a], first) - back, both(w.lines[b + 1], end) - back, np.arange(len(of)) < len(a)


def _pieces(batches):
    """Batches of a bounded number of bytes, but for single long texts, and their texts."""
    for batch in batches:
        texts = batch.column("ld_text").cast(pa.binary()).to_pylist()
        texts = [t or b"" for t in texts]
        sizes = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // _CALL_BYTES
        cuts = np.flatnonzero(np.diff(sizes, prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(texts)]):
            yield batch.slice(a, b - a), texts[a:b]


def _emit(batches, min_words, run_words):
    for batch, texts in _pieces(batches):
        of, fp, run, first, end, lines = marks_of(texts, min_words, run_words)
        take = pa.array(of)
        yield pa.RecordBatch.from_arrays(
            [batch.column("ld_id").take(take), batch.column("ld_hash").take(take), pa.array(fp.view(np.int64)), pa.array(run.view(np.int64)), pa.array(first << 32 | end << 1 | lines)],
            names=["ld_id", "ld_hash", "ld_fp", "ld_run", "ld_span"])


def _emit_windows(batches, run_words):
    """Every window that a wanted fingerprint was selected from: (id, hash, fingerprint, window hash, first word)."""
    for batch, texts in _pieces(batches):
        w = words_of(texts)
        lists = batch.column("ld_wanted")
        of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        wanted = pc.list_flatten(lists)
        fp, first, end = (pc.struct_field(wanted, k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("fp", "first", "last"))
        n = end - first - run_words + 1
        start = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        of, fp = np.repeat(of, n), np.repeat(fp, n)
        at = start + w.first[of]
        run = _Runs(w.hashes, _OTHER).of(at, at + run_words)
        take = pa.array(of)
        yield pa.RecordBatch.from_arrays(
            [batch.column("ld_id").take(take), batch.column("ld_hash").take(take), pa.array(fp), pa.array(run.view(np.int64)), pa.array(start.astype(np.int32))],
            names=["ld_id", "ld_hash", "ld_fp", "ld_run", "ld_first"])


def _slot():
    return F.pmod(F.xxhash64("ld_id", "ld_hash"), F.lit(SLOTS))


def _split(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs that may have one of the keys (ld_id, ld_hash), and docs that have none; SLOTS numbers are broadcast at most."""
    slots = F.broadcast(stored(keys.select(_slot().alias("ld_slot")).distinct(), "line-slots"))
    marked = docs.withColumn("ld_slot", _slot())
    return marked.join(slots, "ld_slot", "left_semi").drop("ld_slot"), marked.join(slots, "ld_slot", "left_anti").drop("ld_slot")


def _of_document(keys: DataFrame):
    """Condition that a document's ld_id, ld_hash are those of keys, there named ld_of_id, ld_of_hash."""
    return F.col("ld_id").eqNullSafe(F.col("ld_of_id")) & (F.col("ld_hash") == F.col("ld_of_hash"))


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("ld_id", "ld_of_id").withColumnRenamed("ld_hash", "ld_of_hash")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """(ld_id, ld_hash, ld_first, ld_last): runs of words that stand at an earlier place, end exclusive. docs: ld_id, ld_hash, ld_text."""
    marks = stored(docs.mapInArrow(lambda b: _emit(b, min_words, run_words), _MARKS), "line-marks")
    # all sides grow with the corpus: always merged, never broadcast
    often = marks.groupBy("ld_fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ld_fp")
    shared = stored(marks.join(often.hint("merge"), "ld_fp"), "line-shared")
    place = F.struct("ld_id", "ld_hash", "ld_span")
    runs = stored(shared.groupBy("ld_fp", "ld_run").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("n")), "line-runs")
    first = lambda span: F.shiftright(span, 32).cast("int")
    last = lambda span: F.shiftright(F.col(span).bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int")
    of_lines = lambda span: F.col(span).bitwiseAND(F.lit(1).cast("long")) == 1

    here = (F.col("ld_id").eqNullSafe(F.col("p.ld_id")) & (F.col("ld_hash") == F.col("p.ld_hash")))
    step = first("ld_span") - first("p.ld_span")
    again = ~here | F.when(of_lines("ld_span"), step > 0).otherwise(step >= run_words)
    seen = shared.join(runs.where("n > 1").select("ld_fp", "ld_run", "p").hint("merge"), ["ld_fp", "ld_run"]).withColumn("ld_again", again)
    whole = seen.where("ld_again").select("ld_id", "ld_hash", first("ld_span").alias("ld_first"), last("ld_span").alias("ld_last"))

    # of fingerprints with several stretches of words, the first place of each stretch and those that overlap it
    several = runs.where(~of_lines("p.ld_span")).groupBy("ld_fp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("ld_fp")
    firsts = runs.where("n = 1").select("ld_fp", "p.*").unionByName(seen.where("not ld_again").select("ld_fp", "ld_id", "ld_hash", "ld_span")).where(~of_lines("ld_span")).distinct()
    one = F.struct(F.col("ld_fp").alias("fp"), first("ld_span").alias("first"), last("ld_span").alias("last"))
    wanted = stored(firsts.join(several.hint("merge"), "ld_fp").groupBy("ld_id", "ld_hash").agg(F.collect_list(one).alias("ld_wanted")), "line-wanted")
    some, _ = _split(docs, wanted)
    held = some.join(_renamed(wanted).hint("merge"), _of_document(wanted)).dropDuplicates(["ld_id", "ld_hash"]).select("ld_id", "ld_hash", "ld_text", "ld_wanted")
    found = stored(held.mapInArrow(lambda b: _emit_windows(b, run_words), "ld_id long, ld_hash long, ld_fp long, ld_run long, ld_first int"), "line-windows")
    first = found.groupBy("ld_fp", "ld_run").agg(F.min(F.struct("ld_id", "ld_hash", "ld_first")).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = found.join(first.hint("merge"), ["ld_fp", "ld_run"]).where(~here | (F.col("ld_first") - F.col("p.ld_first") >= run_words))
    return whole.unionByName(later.select("ld_id", "ld_hash", "ld_first", (F.col("ld_first") + run_words).alias("ld_last")))


def keep_words(text: str, first, last) -> tuple[str, int]:
    """The text without the words of the runs and the white space after them (a line break stays), and how many words those are."""
    data = text.encode("utf-8", "surrogatepass")
    w = words_of([data])
    n = len(w.begin)
    gone = np.cumsum(np.bincount(first, minlength=n + 1)[:n + 1] - np.bincount(last, minlength=n + 1)[:n + 1])[:n] > 0
    if not gone.any():
        return text, 0
    begin, end = np.append(w.begin, len(data) + 1) - 1, w.end - 1
    turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
    out, done = [], 0
    for a, b in zip(turns[::2], turns[1::2]):
        out.append(data[done:begin[a]])
        done = begin[b]
        if b"\n" in data[end[b - 1]:done] and out[-1] and not out[-1].endswith(b"\n"):
            out.append(b"\n")
    return (b"".join(out) + data[done:]).decode("utf-8", "surrogatepass"), int(gone.sum())


def _cleaned(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
    kept = [(t, 0) if t is None or a is None or not len(a) else keep_words(t, a, b) for t, a, b in zip(texts, firsts, lasts)]
    return pd.DataFrame(kept, columns=["text", "removed"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, run_words: int = RUN_WORDS, removed_col: str = "n_removed") -> DataFrame:
    """docs with later repeated runs deleted from text_col, and removed_col, how many words went (in place of a column of that name)."""
    small_batches(docs.sparkSession)
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("ld_row")  # the caller's names stay out of the way
    keyed = docs.select(docs[f"`{id_col}`"].cast("long").alias("ld_id"), F.xxhash64(docs[f"`{text_col}`"]).alias("ld_hash"), docs[f"`{text_col}`"].alias("ld_text"), whole)
    runs = repeated_runs(keyed.drop("ld_row"), min_words, run_words)
    runs = stored(runs.groupBy("ld_id", "ld_hash").agg(F.collect_set(F.struct(F.col("ld_first").alias("first"), F.col("ld_last").alias("last"))).alias("ld_gone")), "line-gone")
    some, clean = _split(keyed.drop("ld_text"), runs)
    joined = some.join(_renamed(runs).hint("merge"), _of_document(runs), "left")
    joined = joined.withColumn("ld_out", F.pandas_udf(_cleaned, "text string, removed long")(F.col("ld_row")[text_col], F.col("ld_gone.first"), F.col("ld_gone.last")))
    kept = [c for c in docs.columns if c != removed_col]
    cleaned = joined.select(*(F.col("ld_out.text").alias(c) if c == text_col else F.col("ld_row")[c].alias(c) for c in kept), F.col("ld_out.removed").alias(removed_col))
    return cleaned.unionByName(clean.select(*(F.col("ld_row")[c].alias(c) for c in kept), F.lit(0).cast("long").alias(removed_col)))


def _words_in(text: str):
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t-\r]+"), lambda w: w != "")


def op4_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = dedup_lines(docs)
    kept = _words_in("text")
    return found.select("doc_id", (F.size(kept) + F.col("n_removed")).cast("long").alias("n_words"), "n_removed", F.md5(F.array_join(kept, " ")).alias("kept_md5"))


#: The same rule without winnowing: every window of lines, by its lines, and every window of words, by its words.
_OP4_SQL = rf"""
WITH raw AS (
  SELECT doc_id, i AS line_no, list_extract(string_split(text, chr(10)), i::BIGINT) AS line
  FROM documents, generate_series(1, len(string_split(text, chr(10)))) AS g(i)),
l AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k,
    sum(w) OVER (PARTITION BY doc_id ORDER BY line_no) AS upto
  FROM (SELECT doc_id, line_no, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line,
          len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM raw)
  WHERE w > 0),
ends AS (
  SELECT a.doc_id, a.k AS f, min(b.k) AS t FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.w >= {MIN_WORDS} GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.k) AS f, b.k AS t FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.w >= {MIN_WORDS} GROUP BY ALL),
win AS (
  SELECT e.doc_id, f, t, string_agg(line, chr(10) ORDER BY k) AS content, min(upto - w) AS a, max(upto) AS b
  FROM ends e JOIN l ON l.doc_id = e.doc_id AND l.k BETWEEN f AND t GROUP BY ALL),
later AS (
  SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, f, t) AS n FROM win) WHERE n > 1),
ws AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {RUN_WORDS - 1}], ' ')) AS content
  FROM ws, generate_series(1, len(w) - {RUN_WORDS - 1}) AS g(i)),
placed AS (SELECT doc_id, i, first_value(doc_id) OVER x AS d, first_value(i) OVER x AS s FROM runs WINDOW x AS (PARTITION BY content ORDER BY doc_id, i)),
spans AS (
  SELECT doc_id, a AS f, b AS t FROM later
  UNION ALL SELECT doc_id, i - 1, i + {RUN_WORDS - 1} FROM placed WHERE d <> doc_id OR i - s >= {RUN_WORDS}),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(f::BIGINT, t::BIGINT - 1)) AS k FROM spans),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS k FROM ws),
kept AS (
  SELECT x.doc_id, count(*) AS n_words, count(g.k) AS n_removed, coalesce(string_agg(CASE WHEN g.k IS NULL THEN word END, ' ' ORDER BY x.k), '') AS kept
  FROM words x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.k = g.k GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, md5(coalesce(kept, '')) AS kept_md5
FROM documents d LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE_SQL = {"op4_line_dedup": _OP4_SQL}
