import random
from collections import Counter

import numpy as np

from lodestream.llm import decontaminate as dc
from lodestream.llm.common import words


def shingles(ws):
    return [tuple(ws[i:i + dc.SHINGLE]) for i in range(max(1, len(ws) - dc.SHINGLE + 1))] if ws else []


def brute(docs, items, similarity=dc.SIMILARITY):
    """The best similarity of each (document, item) over all item-sized windows."""
    out = {}
    for i, t in docs:
        ws = words(t or "")
        for k, x in items:
            xs = words(x or "")
            if not ws or not xs:
                continue
            b, n = Counter(shingles(xs)), min(len(xs), len(ws))
            for a in range(len(ws) - n + 1):
                c = Counter(shingles(ws[a:a + n]))
                s = sum((b & c).values()) / sum((b | c).values())
                if s >= similarity - 1e-9:
                    out[(i, k)] = max(out.get((i, k), 0), round(s, 9))
    return out


def found(spark, docs, items):
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got.collect()}


def test_planted(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(prose(n))) for k, n in enumerate([3, 5, 12, 30, 64, 65, 150, 300])] + [(8, "a a a a a a a a b"), (9, None), (10, "")]
    docs = []
    for i in range(60):
        body = prose(120)
        item = items[i % 9][1].split()
        if i % 3 == 0:
            item = item[2:] if len(item) > 20 else item
        if i % 4 == 1 and len(item) > 20:
            item = item[:len(item) // 2] + ["x", "y"] + item[len(item) // 2:]
        at = rng.randrange(100)
        docs.append((i, " ".join(body[:at] + item + body[at:]).title() if i % 5 else " ".join(body)))
    docs += [(100, items[3][1]), (101, items[0][1]), (102, None), (103, ""), (103, items[3][1]), (103, items[3][1])]
    assert found(spark, docs, items) == brute(docs, items)


def test_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert want and found(spark, docs, items) == want


def test_odd_rows(spark, odd, empty, clashing):
    items = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(odd, items).collect()} == {(4, 1)}
    assert dc.contaminated(empty, items).collect() == [] and dc.contaminated(odd, items.limit(0)).collect() == []
    assert dc.clean(clashing, items).count() == clashing.count() - 2
    taken = odd.withColumnsRenamed({"lang": "dc_id", "source": "dc_of", "n_chars": "dc_row"})
    assert dc.clean(taken, items).columns == taken.columns and dc.clean(taken, items).count() == odd.count() - 2


def test_recall_of_the_radius(capsys):
    """Windows of items of 6 to 400 words with edits, similar by 0.8 to 0.85: how many are within the radius."""
    rng, found = random.Random(1), Counter()
    while found["all"] < 4000:
        n = rng.choice([6, 8, 10, 15, 20, 30, 45, 60, 100, 200, 400])
        item = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        text = [f"x{rng.randrange(10**6)}" if rng.random() < rng.choice([0.01, 0.02, 0.03]) else w for w in item]
        cut = rng.randrange(0, 1 + n // 8)
        text = text[cut:] + [f"y{rng.randrange(10**6)}" for _ in range(cut)]
        b, c = Counter(shingles(item)), Counter(shingles(text))
        if 0.8 <= sum((b & c).values()) / sum((b | c).values()) <= 0.85:
            hashes = [dc.shingle_hashes(dc._hashed(" ".join(x), dc._Hashes())) for x in (item, text)]
            found["all"] += 1
            found["near"] += bin((dc.majority(hashes[0]) ^ dc.majority(hashes[1])) & (1 << 64) - 1).count("1") <= dc.RADIUS
    print("recall of the radius", found["near"] / found["all"])
    assert found["near"] >= 0.998 * found["all"]


def test_blocks_guarantee_the_radius(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    flips = [rng.choice(64, dc.RADIUS, replace=False) for _ in a]
    b = np.array([x ^ np.bitwise_xor.reduce(np.uint64(1) << f.astype(np.uint64)).view(np.int64) for x, f in zip(a, flips)])
    frame = lambda v: dc._blocks(spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "i long, fp long"), dc.RADIUS)
    assert frame(a).join(frame(b), ["i", "block", "bits"]).select("i").distinct().count() == len(a)


def test_windows_have_the_size_of_a_long_item(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (81, 300, 1010)]
    # every fifth shingle and more is lost at the edits, but not at the item's ends
    spoilt = lambda n: [f"x{k}" if n // 5 < k < 4 * n // 5 and k % (n // max(1, (n - 4) // 45)) == 0 else f"i{n}w{k}" for k in range(n)]
    docs = [(n, " ".join(["before"] * 9 + spoilt(n) + ["after"] * 9)) for n, _ in items]
    want = {}
    for (n, text), (_, item) in zip(docs, items):
        b, ws = Counter(shingles(words(item))), words(text)
        windows = [Counter(shingles(ws[a:a + n])) for a in range(len(ws) - n + 1)]
        want[(n, n)] = round(max(sum((b & c).values()) / sum((b | c).values()) for c in windows), 9)
    assert min(want.values()) >= 0.8
    assert found(spark, docs, items) == want
