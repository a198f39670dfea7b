import random
import zlib

import hypothesis.strategies as st
import numpy as np
from hypothesis import given, settings
from tokenizers import Tokenizer

from lodestream.llm import token_files as tf


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1), st.just(0)), max_size=700))
def test_round_trip(ids):
    x = np.array(ids, np.uint64)
    packed, groups, raw = tf.encode(x)
    assert (tf.decode(packed, groups, raw, len(x)) == x).all()
    assert all(w >> 60 for w in packed.tolist() if not len(raw))


def test_dense():
    assert len(tf.encode(np.full(240, 5, np.uint64))[0]) == 12  # 20 of three bits in a word
    assert len(tf.encode(np.zeros(240, np.uint64))[0]) == 2


ODD = ["", "  a", "x). y", "a.b. C, <|endoftext|> <|ENDOFTEXT|> é. İ. ﬁ… …. ).,  1. 2, ", "don't. it's, \x1c \xa0 a\x85b.  c", "Σας. ΣΑΣ, ﬀ. ½. x²,",
       "ét́. ́x", "日本語。 テスト, 안녕.", "«mot». – dash, ×. ÷, ñ.\nÑ,\n", "the, the. the.\tthe,\r\n" * 50, "a" * 5000]


def plain(texts):
    t = Tokenizer.from_file(tf.vocabulary())
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def test_words_encode_as_texts():
    t = tf.WordTokenizer(tf.vocabulary(), 40)
    for _ in range(2):
        ids, sizes = t.encode([x.encode() for x in ODD], 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == plain(ODD)


PIECES = ["a", "word", "Straße", "İ", "ALİ", "i̇", "é", "é", "́", "Σ", "ΑΣ", "ß", "ŉ", "ǰ", "ª", "²", "½", "ﬁ", "K", "×", "÷", "…", ".", ",", "'s", "'re", "’",
          "5", "12", "٣", "日本", "한", "-", "_", "<|", "<|endoftext|>", "|>", "x.", ".,", "\u00a0", "\u0085", "\u2003", "\u3000", "\u200b", "\x1c", "\x00", "😀", "👩‍👩", "נּ", "ा", "ก็"]
SPACES = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "", "", ". ", ", ", ".\n", ",\t"]


def mismatches(texts):
    """Texts whose ids differ from those of the library, which encodes each text whole and by itself."""
    whole, words = Tokenizer.from_file(tf.vocabulary()), tf.WordTokenizer(tf.vocabulary(), 3000)
    ids, sizes = words.encode([t.encode() for t in texts], 2)
    found = np.split(ids, np.cumsum(sizes)[:-1])
    return [t for t, x in zip(texts, found) if x.tolist() != [*whole.encode(t, add_special_tokens=False).ids, 2]]


def test_every_letter_before_a_stop():
    texts = [f"{a}{chr(c)}{b}" for c in [*range(32, 0x600), *range(0x1E00, 0x2200)] for a, b in (("", ". x"), ("a", ", "), ("", "\t"), (".", "a. "), ("", "́. "))]
    assert mismatches(texts) == []


def test_fuzz():
    rng = random.Random(5)
    make = lambda: "".join(rng.choice(PIECES) + rng.choice(SPACES) for _ in range(rng.randrange(1, 9)))
    texts = [make() for _ in range(100_000)]
    bad = [t for at in range(0, len(texts), 20_000) for t in mismatches(texts[at:at + 20_000])]
    assert bad == []


def check(docs, got):
    rows = sorted(((r.doc_id is not None, r.doc_id, r.text is not None, r.text) for r in docs), key=lambda r: (r[0], r[1] or 0, r[2], (r[3] or "").encode()))
    start, want = 0, []
    for r, ids in zip(rows, plain([r[3] for r in rows])):
        want.append((r[1], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_tables(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), tf.op9_token_files(spark, sf_dir).collect())


def test_odd_rows(spark, odd, empty, clashing, tmp_path):
    check(odd.collect(), tf.digests_of(spark, odd).collect())
    assert tf.digests_of(spark, empty).collect() == []
    assert tf.digests_of(spark, clashing).count() == clashing.count()
    tf.write_tokens(odd, f"file://{tmp_path}/t", tf.vocabulary())
    got = {r.start: r["ids"] for r in tf.read_tokens(spark, f"file://{tmp_path}/t").collect()}
    assert sorted(got.values()) == sorted(plain([r.text for r in odd.collect()]))


def test_other_tokenizers_get_whole_texts():
    path = tf.vocabulary("byte_bpe_50k.json")
    t, library = tf.WordTokenizer(path), Tokenizer.from_file(path)
    texts = [x for x in ODD if "<|" not in x]
    ids, sizes = t.encode([x.encode() for x in texts], 7)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode(x, add_special_tokens=False).ids + [7] for x in texts]
