"""Alignment of two tokenizers' tokens over a corpus, with counts of the id pairs that overlap.

Both tokenizers' tokens are spans of the same bytes: a space, then the text. Two
tokens are linked where their spans overlap; the offsets where tokens of both end
cut a text into groups. A pair of ids is packed into one long, the first
tokenizer's id above the second's, and counted by the documents that hold it
linked.

Blocks of documents are aligned and stored: for each document its distinct pairs
and how often it has them, as places in the block's sorted pairs. The blocks'
np.unique counts are merged within each partition, dealt out by ranges of the
packed key, sorted, and summed run by run into shards: sorted keys and counts, as
two byte strings of at most SHARD_KEYS values. A block asks each shard for the
keys in its range, once; a task has one shard at a time, memory-mapped (in a file
without a folder, so nothing is left on a machine), and answers by searchsorted.
Each shard meets at most one request of a block, however frequent a pair is.

The first tokenizer splits texts before a single space between two other
characters, and no entry of the second has a space after another character, so
texts are cut there and each worker aligns a distinct piece once. The constructor
checks both; `tests/llm/test_token_alignment.py` holds results against the
libraries' ids of whole texts.

Defined cases: a text that is null, empty, or not given back by the bytes of both
tokenizers' tokens has no tokens (zeros and an empty digest); repeated rows count
as documents each; a null id stays null; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import small_batches, stored, table
from lodestream.llm.token_files import CALL_BYTES, _byte_chars, vocabulary

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Distinct pairs of documents in a block, beyond which it is closed after the texts at hand.
BLOCK_PAIRS = 1 << 18
#: Keys in a shard.
SHARD_KEYS = 1 << 16
#: Keys that a partition merges before it hands them on.
_MERGED = 1 << 20
#: What a worker keeps of pieces, in characters and links, before it starts anew.
CACHE_WEIGHT = 24_000_000
#: Blocks and shards in an Arrow batch: they take up to a few MB each.
_FEW = 8
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Aligner:
    """Pieces of texts with their tokens in both vocabularies; each distinct piece is aligned once."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
        self.a.encode_special_tokens = True
        of_char = {chr(c): b for b, c in _byte_chars().items()} | {chr(b): b for b in range(256) if b not in _byte_chars()}
        special = self.a.get_added_tokens_decoder()
        self.a_bytes = [(t or "").encode() if i in special else bytes(of_char[c] for c in t or "") for i, t in
                        ((i, self.a.id_to_token(i)) for i in range(self.a.get_vocab_size()))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        split = json.loads(self.a.to_str())
        if split["normalizer"] or (split["pre_tokenizer"] or {}).get("use_regex") is not True or any(b" " in t.lstrip(b" ") for t in self.b_bytes):
            raise ValueError("texts can't be cut at spaces for these vocabularies")
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.number: dict[int, int] = {}  # of a packed pair
        self.groups: list[bytes] = []  # of a piece: its groups as text
        self.weight, self.pieces, self.used, self.pairs = 0, 0, 0, 0
        self.facts = np.zeros((1 << 12, 4), np.int32)  # tokens of either, groups, whether the bytes are the piece's
        self.begin, self.size, self.flat, self.keys = (np.zeros(1 << 12, t) for t in (np.int64, np.int64, np.int32, np.int64))

    def _room(self, name: str, needed: int) -> np.ndarray:
        have = getattr(self, name)
        if needed > len(have):
            have = np.concatenate([have, np.zeros((needed + len(have) // 2, *have.shape[1:]), have.dtype)])
            setattr(self, name, have)
        return have

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[str]]:
        """Linked pairs of ids, one for each overlap, and the groups as text."""
        links, groups, left, right = [], [], [], []
        i = j = 0
        if a:
            a_end, b_end = len(self.a_bytes[a[0]]), len(self.b_bytes[b[0]])
            left, right = [str(a[0])], [str(b[0])]
        while i < len(a):
            links.append((a[i], b[j]))
            a_done, b_done = a_end <= b_end, b_end <= a_end
            if a_done and b_done:
                groups.append(f"{','.join(left)}|{','.join(right)}")
                left, right = [], []
            if a_done:
                i += 1
                if i < len(a):
                    a_end += len(self.a_bytes[a[i]])
                    left.append(str(a[i]))
            if b_done:
                j += 1
                if j < len(b):
                    b_end += len(self.b_bytes[b[j]])
                    right.append(str(b[j]))
        return links, groups

    def _learn(self, pieces: list[str]) -> None:
        first = self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)
        second = self.b.encode(pieces, num_threads=1)
        facts, flat, sizes = [], [], []
        for p, e, b in zip(pieces, first, second):
            a, whole = e.ids, (" " + p).encode()
            fits = b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
            links, groups = self.align(a, b) if fits else ([], [])
            facts.append((len(a), len(b), len(groups), fits))
            self.groups.append(";".join(groups).encode())
            sizes.append(len(links))
            for x, y in links:
                key = x << 32 | y
                n = self.number.setdefault(key, self.pairs)
                if n == self.pairs:
                    self._room("keys", n + 1)[n] = key
                    self.pairs += 1
                flat.append(n)
            self.weight += len(p) + 4 * len(links) + 40
        n, ends = self.pieces, self.used + np.cumsum(sizes)
        self._room("facts", n + len(pieces))[n:n + len(pieces)] = facts
        self._room("size", n + len(pieces))[n:n + len(pieces)] = sizes
        self._room("begin", n + len(pieces))[n:n + len(pieces)] = ends - sizes
        self._room("flat", self.used + len(flat))[self.used:self.used + len(flat)] = flat
        self.place.update(zip(pieces, range(n, n + len(pieces))))
        self.pieces, self.used = n + len(pieces), self.used + len(flat)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens of either, groups, links; digest. Of all: text number, pair number and times of each text's distinct pairs."""
        cut = [_CUT.split(t) if t else [] for t in texts]
        every = [p for ps in cut for p in ps]
        at = np.fromiter(map(self.place.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys(every[i] for i in missing)))
            at[missing] = [self.place[every[i]] for i in missing]
        owner = np.repeat(np.arange(len(texts)), list(map(len, cut)))
        facts, size = self.facts[at], self.size[at]
        bad = np.bincount(owner[facts[:, 3] == 0], minlength=len(texts)) > 0
        of_text = [np.where(bad, 0, np.bincount(owner, x, len(texts)).astype(np.int64)) for x in (*facts[:, :3].T, size)]
        digests, ends = [], np.cumsum(list(map(len, cut)))
        places, of = at.tolist(), self.groups.__getitem__
        for wrong, ps, end in zip(bad.tolist(), cut, ends.tolist()):
            digests.append("" if wrong or not ps else hashlib.sha256(b";".join(map(of, places[end - len(ps):end]))).hexdigest())
        good = ~bad[owner]
        size, begin, owner = size[good], self.begin[at[good]], owner[good]
        stops = np.cumsum(size)
        pairs = self.flat[np.repeat(begin - stops + size, size) + np.arange(stops[-1] if len(stops) else 0)]
        both, times = np.unique(np.repeat(owner, size) << 32 | pairs, return_counts=True)
        return np.array(of_text).reshape(4, -1), digests, both >> 32, both & 0xFFFFFFFF, times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
_BLOCK = ("block long, doc_id array<bigint>, facts binary, digests array<string>, keys binary, partial binary, "
          "sizes binary, places binary, times binary")
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _text(value: bytes | None) -> str:
    try:
        return (value or b"").decode()
    except UnicodeDecodeError:  # no tokenizer gives such bytes back
        return ""


def _align_blocks(batches, first: str, second: str, block_pairs: int, cache_weight: int):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    if (first, second) not in _ALIGNERS:
        _ALIGNERS[first, second] = Aligner(first, second)
    aligner = _ALIGNERS[first, second]
    number, ids, parts = TaskContext.get().partitionId() << 32, [], []

    def block():
        facts, digests, owners, pairs, times = zip(*parts)
        before = np.cumsum([0, *(f.shape[1] for f in facts)])
        owner, pair = np.concatenate([o + b for o, b in zip(owners, before)]), np.concatenate(pairs)
        used, at = np.unique(pair, return_inverse=True)
        keys = aligner.keys[used]
        order = np.argsort(keys)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        places = rank[at]
        data = [np.concatenate(facts, axis=1), keys[order], np.bincount(places, minlength=len(keys)), np.bincount(owner, minlength=len(ids)).astype(np.int32),
                places.astype(np.int32), np.concatenate(times).astype(np.int32)]
        held = [pa.array([x.tobytes()], pa.binary()) for x in data]
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), held[0], pa.array([sum(digests, [])], pa.list_(pa.string())), *held[1:]],
            names=["block", "doc_id", "facts", "digests", "keys", "partial", "sizes", "places", "times"])

    for batch in batches:
        texts, names = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
        ends = np.cumsum([len(t or b"") for t in texts]) // CALL_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)] if texts else []
        for at, to in zip(cuts, cuts[1:]):
            parts.append(aligner.texts([_text(t) for t in texts[at:to]]))
            ids += names[at:to]
            full = aligner.weight > cache_weight
            if full or sum(len(p[2]) for p in parts) >= block_pairs:
                yield block()
                number, ids, parts = number + 1, [], []
            if full:
                aligner.forget()
    if parts:
        yield block()


def _array(column, i: int, kind="<i8") -> np.ndarray:
    value = column[i]
    return np.frombuffer(value.as_buffer(), kind) if value.is_valid else np.empty(0, kind)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts' sums."""
    found, at = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, at, counts)
    return found, sums


def _partial_counts(batches):
    waiting, n = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            waiting.append((_array(batch.column("keys"), i).copy(), _array(batch.column("partial"), i).copy()))
            n += len(waiting[-1][0])
            if n > 2 * _MERGED:
                keys, counts = _summed(*map(np.concatenate, zip(*waiting)))
                waiting, n = [(keys, counts)], len(keys)
                if n > _MERGED:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])
                    waiting, n = [], 0
    if waiting:
        keys, counts = _summed(*map(np.concatenate, zip(*waiting)))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])


def _runs(batches, shard_keys: int):
    """Shards of a partition's sorted (key, n) rows: the counts of equal keys, which follow each other, summed."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def shard(k, c):
        return pa.RecordBatch.from_arrays([pa.array(k[:1]), pa.array([k.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], names=["low", "keys", "counts"])

    for batch in batches:
        keys, counts = np.concatenate([keys, batch.column("key").to_numpy()]), np.concatenate([counts, batch.column("n").to_numpy()])
        starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
        keys, counts = keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts
        while len(keys) > shard_keys:  # the last key may go on
            yield shard(keys[:shard_keys], counts[:shard_keys])
            keys, counts = keys[shard_keys:], counts[shard_keys:]
    if len(keys):
        yield shard(keys, counts)


def _best_of_shards(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            ids, at = np.unique(_array(batch.column("keys"), i) >> 32, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.maximum.reduceat(_array(batch.column("counts"), i), at))], names=["a_id", "n"])


def _pairs_of_shards(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            keys = _array(batch.column("keys"), i)
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(_array(batch.column("counts"), i))], names=["a_id", "b_id", "n_docs"])


_ASKED = "shard int, block long, keys binary, counts binary"


def _requests(batches, lows: np.ndarray):
    """A block's keys, for each shard that has some of them."""
    for batch in batches:
        for block, i in zip(batch.column("block").to_pylist(), range(batch.num_rows)):
            keys = _array(batch.column("keys"), i)
            shard = np.searchsorted(lows, keys, side="right") - 1
            starts = np.flatnonzero(np.diff(shard, prepend=-1))
            cut = [keys[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(keys)])]
            yield pa.RecordBatch.from_arrays([pa.array(shard[starts].astype(np.int32)), pa.array([block] * len(cut), pa.int64()), pa.array(cut, pa.binary()),
                                              pa.array([None] * len(cut), pa.binary())], names=["shard", "block", "keys", "counts"])


def _own_requests(batches, lows: np.ndarray):
    for batch in batches:
        shard = np.searchsorted(lows, batch.column("low").to_numpy(), side="right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array([None] * batch.num_rows, pa.int64()), batch.column("keys"), batch.column("counts")],
                                         names=["shard", "block", "keys", "counts"])


def _mapped(data) -> mmap.mmap:
    """A memory map of the bytes, in a file that has no folder and goes with the map."""
    handle = os.memfd_create("shard")
    with os.fdopen(handle, "wb", closefd=False) as f:
        f.write(data)
    held = mmap.mmap(handle, 0, prot=mmap.PROT_READ)
    os.close(handle)
    return held


def _answers(batches):
    """Sorted by shard, the shard itself first: (block, shard, counts of the keys that the block asked for)."""
    keys = counts = None
    for batch in batches:
        for i in range(batch.num_rows):
            block, shard = batch.column("block")[i].as_py(), batch.column("shard")[i].as_py()
            if block is None:
                keys, counts = (np.frombuffer(_mapped(batch.column(c)[i].as_buffer()), "<i8") for c in ("keys", "counts"))
                continue
            found = counts[np.searchsorted(keys, _array(batch.column("keys"), i))]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([shard], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=["block", "shard", "counts"])


def _finish(batches, best: np.ndarray):
    for batch in batches:
        for i in range(batch.num_rows):
            column = lambda name, kind="<i8", i=i: _array(batch.column(name), i, kind)
            ids, keys, sizes, places, times = batch.column("doc_id")[i].as_py(), column("keys"), column("sizes", "<i4"), column("places", "<i4"), column("times", "<i4").astype(np.int64)
            found = batch.column("answers")[i].as_py() or []
            totals = np.frombuffer(b"".join(x["counts"] for x in found), "<i8")  # shards and keys are in one order
            facts = column("facts").reshape(4, len(ids))
            owner, count = np.repeat(np.arange(len(ids)), sizes), totals[places] if len(places) else np.empty(0, np.int64)
            top = (totals == best[keys >> 32])[places] if len(places) else np.empty(0, bool)
            n_best, sums = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            np.add.at(n_best, owner[top], times[top])
            np.add.at(sums, owner, times * count)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, facts), pa.array(n_best), pa.array(sums), batch.column("digests")[i].values],
                                             names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


@contextmanager
def _few_rows(spark):
    """What runs inside reads blocks and shards, of up to a few MB each, a few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_FEW))
    try:
        yield
    finally:
        small_batches(spark)


def aligned_blocks(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text",
                   block_pairs: int = BLOCK_PAIRS, cache_weight: int = CACHE_WEIGHT) -> DataFrame:
    """The documents' alignments, in blocks, stored."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return stored(rows.mapInArrow(lambda b: _align_blocks(b, first, second, block_pairs, cache_weight), _BLOCK), "align-blocks")


def count_shards(blocks: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(low, keys, counts): packed pairs in ascending order with the number of documents that hold them linked, stored."""
    spark = blocks.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _few_rows(spark):
        partial = stored(blocks.select("keys", "partial").mapInArrow(_partial_counts, "key long, n long"), "align-partial")
    return stored(partial.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(lambda b: _runs(b, shard_keys), "low long, keys binary, counts binary"), "align-shards")


def pair_counts(shards: DataFrame) -> DataFrame:
    """(a_id, b_id, n_docs) of each linked pair of ids."""
    return shards.mapInArrow(_pairs_of_shards, "a_id long, b_id long, n_docs long")


def align(docs: DataFrame, first: str | None = None, second: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          block_pairs: int = BLOCK_PAIRS, shard_keys: int = SHARD_KEYS, cache_weight: int = CACHE_WEIGHT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row, and the shards of counts."""
    spark = docs.sparkSession
    blocks = aligned_blocks(docs, first or vocabulary(FIRST), second or vocabulary(SECOND), id_col, text_col, block_pairs, cache_weight)
    shards = count_shards(blocks, shard_keys)
    lows = np.array(sorted(r.low for r in shards.select("low").collect()), np.int64)  # one number for each SHARD_KEYS pairs
    with _few_rows(spark):
        most = shards.mapInArrow(_best_of_shards, "a_id long, n long").groupBy("a_id").agg(F.max("n").alias("n")).collect()  # a vocabulary's size at most
        best = np.zeros(1 + max((r.a_id for r in most), default=0), np.int64)
        for r in most:
            best[r.a_id] = r.n
        asked = blocks.select("block", "keys").mapInArrow(lambda b: _requests(b, lows), _ASKED).union(shards.mapInArrow(lambda b: _own_requests(b, lows), _ASKED))
        asked = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", F.asc_nulls_first("block"))
        answers = asked.mapInArrow(_answers, "block long, shard int, counts binary")
        by_block = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("shard", "counts"))).alias("answers"))
        met = blocks.drop("partial").join(by_block.hint("merge"), "block", "left")  # both grow with the corpus
        found = stored(met.mapInArrow(lambda b: _finish(b, best), _RESULT), "align-result")
    return found, shards


def op12_token_alignment(spark, sf_dir):
    return align(table(spark, sf_dir, "documents"))[0]


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLE_SQL: dict[str, str] = {}
