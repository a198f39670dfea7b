import random
import re

from lodestream.llm import licences


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    ws, places, base = plain(text), [], set()
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(ws) - len(p) + 1) if ws[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, best = set(base), 0.0
    for templates, threshold, block, stride in ((licences.TEMPLATES, licences.THRESHOLD, licences.BLOCK, licences.STRIDE),
                                                (licences.LONG_TEMPLATES, licences.LONG_THRESHOLD, licences.LONG_BLOCK, licences.LONG_STRIDE)):
        for at in range(0, max(1, len(ws) - block + stride), stride):
            have = set(ws[at:at + block])
            for label, t in templates:
                share = len(have & set(t.split())) / len(set(t.split()))
                if share >= threshold - 1e-9:
                    labels.add(label)
                    best = max(best, share)
    return len(ws), sorted(places), sorted(base), sorted(labels), 1.0 if places else best


def result(r):
    return r.n_words, sorted(r.places), r.base_labels, r.labels, r.score


TEXTS = [
    "The MIT License", "cc-by cc by CC.BY", "Apache\nLicense", "xmit license", "mit licenses", "GNU  General--Public (License)",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files.",
    "Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution 4.0 International License!", "CC BY", "İcc bY K K MIT LICENSE\x00mit license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", None, "",
    "x " * 61 + "Permission is hereby granted, free of charge,\nto any person obtaining a copy\nof this software and associated\ndocumentation files" + " y" * 40,
    "Permission to use, modify, and or distribute this software for any\npurpose with or without fee is hereby granted",
    "Redistribution and use in source and binary forms, with or without\nmodification are permitted if the following conditions are met",
]


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: result(r) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_wrapped_and_changed_statements(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS[-3:])]
    got = {r.doc_id: (r.labels, r.score) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (["mit"], 1.0) and got[1][0] == ["isc"] and 0.9 < got[1][1] < 1 and got[2][0] == []


def changed(text, share, seed):
    """The text with words left out, changed and added, so that this share of its distinct words is gone."""
    rng = random.Random(seed)
    words = sorted(set(text.split()))
    gone = set(rng.sample(words, int(share * len(words))))
    out = []
    for w in text.split():
        out += [rng.choice(["", "otherwords"])] if w in gone else [w]
        if rng.random() < 0.03:
            out.append("inserted")
    return " ".join(x for x in out if x)


def test_whole_texts_with_many_words_missing(spark):
    """All templates, at any place of long texts, with about a sixth of their words gone; with a third gone they are no match."""
    prose = " ".join(f"prose{i % 97}" for i in range(900)).split()
    rows, want = [], {}
    for n, (label, t) in enumerate(licences.LONG_TEMPLATES):
        for k, share in enumerate((0.0, 0.1, 0.17, 0.34)):
            at = (n * 211 + k * 137) % 700
            rows.append((len(rows), " ".join(prose[:at]) + "\n" + changed(t, share, n * 9 + k).replace("and", "AND,") + "\n" + " ".join(prose[at:])))
            want[rows[-1][0]] = label if share < 0.2 else None
    got = {r.doc_id: result(r) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert all((label in got[i][3]) if label else not set(got[i][3]) & {"isc", "bsd"} for i, label in want.items())


def test_whole_texts_are_told_apart():
    for label, t in licences.LONG_TEMPLATES:
        have = set(t.split())
        assert [k for k, u in licences.LONG_TEMPLATES if len(have & set(u.split())) >= licences.LONG_THRESHOLD * len(set(u.split()))] == [label]


def test_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: result(r) for r in licences.scan(docs).collect()} == {i: brute(t) for i, t in texts.items()}


def test_plan_is_native(spark, sf_dir):
    plan = licences.op6_licence_scan(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(odd, empty, clashing):
    got = licences.scan(odd)
    assert sorted(r.n_words for r in got.collect()) == sorted(len(plain(r.text)) for r in odd.collect())
    assert licences.scan(empty).collect() == [] and licences.scan(clashing).count() == clashing.count()
