import hashlib
from collections import Counter

import pytest

from lodestream.llm import token_alignment
from lodestream.llm.token_files import vocabulary

A_FILE, B_FILE = vocabulary(token_alignment.FIRST), vocabulary(token_alignment.SECOND)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer, decoders
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of_char = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}

    def b_bytes(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def spans(text):
        """Whole texts by the libraries: (id, first byte, end) of each token; None if bytes don't join to the text."""
        if not text:
            return None
        out = []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        for ids, data in ((ids_a, [bytes(of_char[c] for c in a.id_to_token(i)) for i in ids_a]), ((ids_b := b.encode(text)), [b_bytes(i) for i in ids_b])):
            if b"".join(data) != (" " + text).encode():
                return None
            at, found = 0, []
            for i, d in zip(ids, data):
                found.append((i, at, at + len(d)))
                at += len(d)
            out.append(found)
        return out
    return spans


def brute(rows, spans):
    """By comparing all tokens of the one with all of the other."""
    found = [(i, spans(t)) for i, t in rows]
    linked = [[(x, y) for x, s, e in f[0] for y, b, z in f[1] if s < z and b < e] if f else [] for _, f in found]
    docs = Counter(p for ls in linked for p in set(ls))
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (i, f), ls in zip(found, linked):
        if not f:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for _, _, e in f[0]} & {e for _, _, e in f[1]})
        groups = ["|".join(",".join(str(x) for x, s, e in side if lo <= s and e <= hi) for side in f) for lo, hi in zip([0, *cuts], cuts)]
        out.append((i, len(f[0]), len(f[1]), len(groups), len(ls), sum(docs[p] == best[p[0]] for p in ls), sum(docs[p] for p in ls),
                    hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def run(docs):
    return sorted((tuple(r) for r in token_alignment.align(docs)[0].collect()), key=str)


TEXTS = [None, "", "a", " a", "a  b", "  two  spaces  ", "line\nbreak \n next", "tab\tand  odd white　space x", "don't  we'll 'tis", "éè naïve 你好 世界",
         "emoji \U0001f600\U0001f468‍\U0001f469 here", "<|endoftext|> <s> </s> <0x0A> <unk>", "a▁b is not given back", "▁", "x" * 3000 + " y", "1234 56,789.00 $5 ##", "é ﬁ NFC", "\x1c a \x1f b \x85 c",
         "the same text", "the same text", "THE Same TEXT", "a b " * 200, "﻿bom", "\x00 nul \x7f", "trailing "]


def test_against_whole_texts(spark, libraries):
    rows = list(enumerate(TEXTS)) + [(None, "the same text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, libraries)
    assert run(docs) == want and sum(r[1] > 0 for r in want) == len(rows) - 4


def test_pieces_give_the_libraries_ids(libraries):
    """Random texts of letters, signs and white space of many kinds."""
    import random
    rng, aligner = random.Random(0), token_alignment.Aligner(A_FILE, B_FILE)
    marks = [*"abcdeEST0123'.,-<>|\"", " ", " ", " ", " ", "  ", "\n", "\t", " ", " ", "　", "​", "\x1c", "\x85", "é", "中", "İ", "ing", "the", "'s", "́", "\U0001f600"]
    for _ in range(3000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(1, 30)))
        facts, digests, *_ = aligner.texts([text])
        f = libraries(text)
        cuts = sorted({e for _, _, e in f[0]} & {e for _, _, e in f[1]})
        groups = ["|".join(",".join(str(x) for x, s, e in side if lo <= s and e <= hi) for side in f) for lo, hi in zip([0, *cuts], cuts)]
        assert (facts[:3, 0].tolist(), digests[0]) == ([len(f[0]), len(f[1]), len(cuts)], hashlib.sha256(";".join(groups).encode()).hexdigest()), repr(text)


def test_small_shards_blocks_and_cache(spark, sf_dir, libraries):
    rows = [(r.doc_id, (r.text or "")[:1500]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found, shards = token_alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_pairs=300, shard_keys=100, cache_weight=20_000)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, libraries)
    pairs = token_alignment.pair_counts(shards)
    assert shards.count() > 20 and pairs.count() == pairs.select("a_id", "b_id").distinct().count()


def test_odd_rows(odd, empty, clashing, libraries):
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 5]  # comparing all tokens takes too long there
    assert [r for r in run(odd.where("doc_id is null or doc_id <> 5")) ] == brute(rows, libraries)
    assert run(empty) == [] and run(clashing) == run(odd)
