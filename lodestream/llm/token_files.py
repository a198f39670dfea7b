"""Token-id files in a Simple-8b word-aligned code.

A 64-bit word holds a 4-bit selector and 60 bits of payload: as many ids, of as
many bits each, as the selector says. Ids of over 60 bits are escapes: such a
word's payload is the id's place in the block's list of raw ids, so that every
word of a block can be decoded at the same time. A block holds whole documents,
the offset of each one's first id and that of every GROUP ids' first word.

A file is a Parquet table of blocks, in ascending id order: part and block
number, ids before the block in its part, then the block itself. `write_tokens`
makes it and `read_tokens` decodes it; both go through Spark's readers and
writers, so any shared store does.

Defined cases: a null text is encoded as an empty one; a null id sorts first;
rows of one id are ordered by their text; repeated rows are each written; an
empty table gives a file without blocks; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from itertools import chain, repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import own_path, small_batches, table

#: (ids in a word, bits of each) by selector; selector 0 is the escape.
SELECTORS = ((1, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
             (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
END_ID = 2
#: Bytes of text that are encoded at a time, beyond which a call has the text at hand and no more.
CALL_BYTES = 2 << 20
_STOP = re.compile(rb"(?<=[0-9a-z])[.,](?=[\t-\r ])")
#: Kinds of bytes: a of letters and digits (those of U+00C0 to U+027F, but for two signs, are all letters), ? of others that may not be.
#: One of these letters, U+0130, has no letter alone for its lower case, so a stop after it isn't a word: _words looks for it.
_KINDS = bytes(ord("a") if chr(b).isalnum() and b < 128 or 0x80 <= b < 0xC0 or 0xC3 <= b <= 0xC9 else ord("?") if b >= 0xC0
               else ord(" ") if b in b" \t\n\x0b\x0c\r" else ord(".") if b in b".," else ord("x") for b in range(256))
#: Ids in a block, beyond which it is closed after the document at hand.
BLOCK_IDS = 1 << 18
#: Distinct words whose ids a worker keeps, about 170 bytes each.
CACHE_WORDS = 800_000
#: Ids in a group; a block has the offset of each group's first word.
GROUP = 240
_LIMITS = np.array([1 << b for b in range(61)], np.uint64)
_FEW_BITS = np.searchsorted(_LIMITS, np.arange(1 << 20, dtype=np.uint64), side="right").astype(np.uint8)
_COUNTS = np.array([c for c, _ in SELECTORS], np.int64)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the offset of each group's first word, and raw (escaped) ids of a sequence of unsigned 64-bit ids.

    A group is GROUP ids; its last word may have room to spare. Within a group
    each word takes as many ids as fit; all groups are packed in step.
    """
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    bits = np.searchsorted(_LIMITS, ids, side="right") if int(ids.max()) >> 20 else _FEW_BITS[ids.astype(np.intp)]
    most = int(bits.max())
    # all ids fit the widest that is needed; the escape, if there is none
    widest = max((s for s in range(1, len(SELECTORS)) if SELECTORS[s][1] >= most), default=0, key=lambda s: SELECTORS[s][0])
    choice = np.full(n, widest, np.uint8)
    at = np.arange(n)
    limit = np.minimum((at // GROUP + 1) * GROUP, n)
    for s in range((widest or len(SELECTORS)) - 1, 0, -1):  # what fits a selector fits those before it here
        count, width = SELECTORS[s]
        if most > width:
            if len(at) * count < n:  # few places are left: look at their ids
                inside = np.minimum(at[:, None] + np.arange(count), limit[at, None] - 1)
                at = at[bits[inside].max(axis=1) <= width]
            else:
                wide = np.zeros(n + 1, np.int32)
                np.cumsum(bits > width, out=wide[1:])
                at = at[wide[np.minimum(at + count, limit[at])] == wide[at]]
            if not len(at):
                break
        choice[at] = s
    now = np.arange(0, n, GROUP)
    n_groups, ends, first = len(now), np.minimum(now + GROUP, n), np.zeros(n, bool)
    step = _COUNTS[choice]
    while len(now):
        first[now] = True
        now = now + step[now]
        more = now < ends
        now, ends = now[more], ends[more]
    starts = np.flatnonzero(first)
    sizes = np.bincount(starts // GROUP, minlength=n_groups)
    chosen, last = choice[starts], np.minimum((starts // GROUP + 1) * GROUP, n)
    out = chosen.astype(np.uint64) << np.uint64(60)
    for s, (count, width) in enumerate(SELECTORS):
        at = np.flatnonzero(chosen == s) if s and width else []
        if len(at):
            begin, room = starts[at], last[at] - starts[at]
            packed = out[at]
            for i in range(count):
                if i < room.min():
                    packed |= ids[begin + i] << np.uint64(i * width)
                else:  # the last words of groups have room to spare
                    some = np.flatnonzero(room > i)
                    packed[some] |= ids[begin[some] + i] << np.uint64(i * width)
            out[at] = packed
    escaped = np.flatnonzero(chosen == 0)
    out[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return out, np.cumsum(sizes) - sizes, ids[starts[escaped]]


def decode(words: np.ndarray, groups: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block, all words at a time."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.intp)
    counts = _COUNTS[selector]
    before = np.cumsum(counts) - counts
    sizes = np.diff(np.append(groups, len(words)))
    starts = before - np.repeat(before[groups] - np.arange(len(groups)) * GROUP, sizes)
    last = np.repeat(np.minimum(np.arange(1, len(groups) + 1) * GROUP, n), sizes)
    for s, (count, width) in enumerate(SELECTORS):
        at = np.flatnonzero(selector == s)
        if not len(at) or (width == 0 and s):
            continue
        if s == 0:
            out[starts[at]] = raw[(words[at] & np.uint64((1 << 60) - 1)).astype(np.intp)]
            continue
        mask = np.uint64((1 << width) - 1)
        for i in range(count):
            inside = starts[at] + i < last[at]
            if not inside.all():
                at = at[inside]
            out[starts[at] + i] = (words[at] >> np.uint64(i * width)) & mask
    return out


def _byte_chars() -> dict[int, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


#: Normaliser, split and what follows of a tokenizer whose texts can be cut at white space.
_BY_WORDS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    None]


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space and letter case and never merges across white space.

    Each distinct word goes to the tokenizers library once. Cutting at ASCII white
    space changes no id: composition, lower case (one character at a time) and the
    vocabulary's own split don't reach across it. A full stop or comma between a
    letter or digit and white space is a word, as that split has it, if the
    letter's lower case is letters alone. Of over cache_words words, those used
    least are forgotten. A tokenizer whose normaliser and split aren't those that
    this holds for (_BY_WORDS) gets whole texts instead.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        self.tokenizer, self.limit = Tokenizer.from_file(path), cache_words
        parts = json.loads(self.tokenizer.to_str())
        self.by_words = [parts["normalizer"], parts["pre_tokenizer"], parts["post_processor"]] == _BY_WORDS
        self.place: dict[bytes, int] = {}
        self.calls = 0
        self.used = 0  # of flat; begin, size and uses go by place
        self.flat, self.begin, self.size, self.uses = (np.zeros(1 << 16, t) for t in (np.uint32, np.int32, np.int32, np.int32))

    def _put(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        for name, more in (("flat", ids), ("begin", self.used + np.cumsum(sizes) - sizes), ("size", sizes), ("uses", np.zeros(len(words), np.int64))):
            used, have = self.used if name == "flat" else len(self.place), getattr(self, name)
            if used + len(more) > len(have):
                have = np.concatenate([have, np.zeros(len(have) + len(more), have.dtype)])
                setattr(self, name, have)
            have[used:used + len(more)] = more
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.used += len(ids)

    def _forget(self, room: int) -> None:
        stay = np.sort(np.argsort(-self.uses[:len(self.place)], kind="stable")[:max(0, min(self.limit // 2, self.limit - room))])
        words, size, uses = list(self.place), self.size[stay], self.uses[stay] // 2
        flat = self.flat[np.repeat(self.begin[stay] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        self.place, self.used = {}, 0
        self._put([words[i] for i in stay.tolist()], flat, size)
        self.uses[:len(stay)] = uses

    def _places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))

    def _learn(self, words: list[bytes]) -> None:
        """Words of lower-case Latin letters go to the library's model as they are, others through its whole way."""
        tokenize, lists, ordered, others = self.tokenizer.model.tokenize, [], [], []
        for w in words:
            if w.isalpha() and w.islower():  # of bytes: ASCII
                lists.append([x.id for x in tokenize(w.decode())])
                ordered.append(w)
                continue
            t = w.decode()
            if t.isalpha() and max(t) < "\u0250" and t == t.lower() and is_normalized("NFC", t):
                lists.append([x.id for x in tokenize(w.decode("latin-1").translate(_BYTE_CHARS))])
                ordered.append(w)
            else:
                others.append(w)
        for i in range(0, len(others), 4096):
            lists += [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in others[i:i + 4096]], add_special_tokens=False)]
        ordered += others
        if b"\n" in words:
            lists[ordered.index(b"\n")] = [self.end_id]
        self._put(ordered, np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists)))

    def _words(self, data: bytes) -> list[bytes]:
        if b"<|" in data:  # special tokens keep their case
            return data.split()
        kinds = data.translate(_KINDS)
        if b"?" in kinds or b"x. " in kinds or b".. " in kinds or b"\xc3\x97" in data or b"\xc3\xb7" in data or b"\xc4\xb0" in data:
            return _STOP.sub(rb" \g<0>", data.lower()).split()
        return data.lower().replace(b". ", b" . ").replace(b", ", b" , ").split()

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8), and how many each has, end_id counted."""
        if not self.by_words:
            lists = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(lists), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists))
        split = [self._words(t) for t in texts]
        for ws in split:
            ws.append(b"\n")  # no text has such a word: the end id
        self.end_id = end_id
        every = list(chain.from_iterable(split))
        at = self._places(every)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = {every[i] for i in missing.tolist()}
            if len(self.place) + len(new) > self.limit:
                self._forget(len(new))
                at = self._places(every)
                missing = np.flatnonzero(at < 0)
                new = {every[i] for i in missing.tolist()}
            self._learn(list(new))
            at[missing] = self._places([every[i] for i in missing.tolist()])
        self.calls += 1
        if self.calls % 8 == 1:  # a sample of the uses tells what to forget
            self.uses += np.bincount(at, minlength=len(self.uses)).astype(np.int32)
        sizes = self.size[at]
        per_text = np.fromiter(map(len, split), np.int64, len(split))
        ends = np.zeros(len(at) + 1, np.int32)
        np.cumsum(sizes, out=ends[1:])
        source = np.repeat(self.begin[at] - ends[:-1], sizes)
        source += np.arange(ends[-1], dtype=np.int32)
        return self.flat[source], np.diff(ends[np.cumsum(per_text)], prepend=0).astype(np.int64)


_TOKENIZERS: dict[str, WordTokenizer] = {}
_BLOCKS = ("part int, block int, ids_before long, n_ids long, doc_ids array<bigint>, offsets array<bigint>, "
           "words binary, groups array<bigint>, escapes binary")


def _write_blocks(batches, path: str, end_id: int):
    gc.disable()  # millions of lists without a cycle would be walked again and again
    try:
        yield from _blocks_of(batches, path, end_id)
    finally:
        gc.enable()


def _blocks_of(batches, path: str, end_id: int):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    tokenizer = _TOKENIZERS[path]
    part, block, before = TaskContext.get().partitionId(), 0, 0
    doc_ids: list = []
    parts: list[np.ndarray] = []
    lengths: list[np.ndarray] = []

    def flush():
        ids, sizes = np.concatenate(parts), np.concatenate(lengths)
        packed, groups, raw = encode(ids)
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()),
            pa.array([doc_ids], pa.list_(pa.int64())), pa.array([np.cumsum(sizes) - sizes], pa.list_(pa.int64())),
            pa.array([packed.astype("<u8").tobytes()], pa.binary()), pa.array([groups], pa.list_(pa.int64())), pa.array([raw.astype("<u8").tobytes()], pa.binary()),
        ], names=["part", "block", "ids_before", "n_ids", "doc_ids", "offsets", "words", "groups", "escapes"])

    for batch in batches:
        texts, names = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
        ends = np.cumsum([len(t or b"") for t in texts]) // CALL_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)] if texts else []
        for at, to in zip(cuts, cuts[1:]):
            ids, sizes = tokenizer.encode([t or b"" for t in texts[at:to]], end_id)
            doc_ids += names[at:to]
            parts.append(ids)
            lengths.append(sizes)
            n = sum(map(len, parts))
            if n >= BLOCK_IDS:
                yield flush()
                before, block, doc_ids, parts, lengths = before + n, block + 1, [], [], []
    if parts:
        yield flush()


def _in_order(rows: DataFrame) -> DataFrame:
    """rows in ascending doc_id order over partitions: ranges from approximate quantiles, which read the ids alone."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / n for k in range(1, n)] or [0.5]
    marks = rows.select(F.percentile_approx("doc_id", shares, 10 * n)).first()[0] or []
    bounds = F.from_json(F.lit(str(sorted(set(marks)))), "array<bigint>")
    part = F.size(F.filter(bounds, lambda b: b < F.col("doc_id")))
    return rows.repartitionById(n, part).sortWithinPartitions("doc_id", "text")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode docs in ascending id order and write the file at path."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    _in_order(rows).withColumn("text", F.col("text").cast("binary")).mapInArrow(lambda b: _write_blocks(b, tokenizer, end_id), _BLOCKS).write.option("compression", "zstd").parquet(path)


def _read_blocks(batches, first: dict[int, int], digests: bool):
    for batch in batches:
        for r in batch.to_pylist():
            ids = decode(np.frombuffer(r["words"], "<u8"), np.array(r["groups"], np.int64), np.frombuffer(r["escapes"], "<u8"), r["n_ids"])
            offsets = np.array([*r["offsets"], r["n_ids"]], np.int64)
            data = ids.astype("<u4")
            columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(offsets[:-1] + r["ids_before"] + first[r["part"]], pa.int64()), pa.array(np.diff(offsets), pa.int64())]
            if digests:
                columns.append(pa.array([zlib.crc32(data[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])], pa.int64()))
            else:
                columns.append(pa.array([data[a:b].astype(np.int64) for a, b in zip(offsets, offsets[1:])], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])


def read_tokens(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the file; digests: ids_crc32 in place of ids.

    The sizes of the file's parts come to the driver, one number for each.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    first, total = {}, 0
    for part, n in sorted(blocks.groupBy("part").agg(F.sum("n_ids")).collect()):
        first[part], total = total, total + n
    last = "ids_crc32 long" if digests else "ids array<bigint>"
    return blocks.mapInArrow(lambda b: _read_blocks(b, first, digests), f"doc_id long, start long, n_tokens long, {last}")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def digests_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs written as a token file in the shared folder, and what the file then holds."""
    path = own_path(spark, "tokens")
    write_tokens(docs, path, vocabulary())
    return read_tokens(spark, path, digests=True)


def op9_token_files(spark, sf_dir):
    return digests_of(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_files": op9_token_files}
ORACLE_SQL: dict[str, str] = {}
