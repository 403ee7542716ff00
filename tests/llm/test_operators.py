"""Each operator against its plain version: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import os
import random
import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import components, embed_dedup, licenses, minhash, mixing, pii, quality, sentencepieces, suffix_dedup, token_store, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
#: Names that operators use inside.
CLASHES = ("key", "mark", "value", "row", "own", "size", "id", "doc", "context", "place", "label", "part", "start", "a.dotted `name`")


def docs(spark, texts, ids=None, sources=None, clash=True):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[n], None if t is None else len(t)) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASHES if clash else ():
        df = df.withColumn(c, F.lit("x"))  # names of the operators' own columns, and one that has to be quoted
    return df


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def rows_of(df):
    return {r.doc_id for r in df.collect()}


def noise(rng, n, letters="abc de\nfé"):
    return "".join(rng.choice(letters) for _ in range(n))


ODD = [None, "", " ", "\n\n", "a", "été 中文 😀 \x1c\x85", "<s></s><|endoftext|>", "▁ ▁▁", "x" * 3000, "  two  spaces\t\ttabs \r\n", "a b c d e f g " * 400]


# ---- 1 ----


def test_base_spans(spark):
    rng = random.Random(2)
    bits = ["a", "b.", "@", "1", "23", ".", "192.168.1.1", "+1 (202) 555-0011", "-", " ", "4000038985693383", "é", "😀", "x@y.com", "%", "+", "(", ")", "\n", "256", "4111 1111 1111 1111"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(300)] + ODD + ["1" * 20000, "a@" * 5000, "1.1.1.1 " * 3000, "+1 " * 3000]
    got = pii.digest(pii.find_pii(docs(spark, texts))).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        want = brute.spans(t)
        assert [r[f"n_{k}"] for k, _ in brute.KINDS] == [sum(x[0] == k for x in want) for k, _ in brute.KINDS]
        assert r.base_sha256 == hashlib.sha256(brute.span_text(want).encode()).hexdigest()


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"we met; please contact badge u{i}@mail.example.com now" if i % 3 else f"hello there; please contact badge 5550{i:05d}x now" for i in range(60)]
    texts += ["version 12345678 of something", "no digits at all"]
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(docs(spark, texts))).collect()}
    assert all(got[i].n_found == (i % 3 == 0) for i in range(60)) and got[60].n_found == got[61].n_found == 0
    assert got[0].spans.startswith("email:")
    masked = {r.doc_id: r.text for r in pii.mask_documents(docs(spark, texts, clash=False)).collect()}
    assert masked[0] == "hello there; please contact badge [EMAIL] now" and masked[60] == texts[60]


def test_every_base_span_is_a_seed(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4000 0389 8569 3383", "6011 0000 0000 0004", "3530 1113 3330 0000", "4012 8888 8888 1881"]
    texts = [f"we met; please write mailbox {letters[i]}ane.doe@example.com now" for i in range(20)] + ["we met; please write mailbox jane.doe-at-example now", "we met; please write mailbox x" + "y" * 80 + ", now"]
    texts += [f"hello there charged card {c} today" for c in cards] + ["hello there charged card 4111 1111 1111 1112 today"]
    texts += [f"go see the {letters[i]}o@example.com house" for i in range(8)] + [f"go see the {x} house" for x in ("old", "red", "big", "dull")]
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(docs(spark, texts))).collect()}
    assert [got[i].n_found for i in range(len(texts))] == [0] * 20 + [1, 1] + [0] * 6 + [1] + [0] * 12
    masked = {r.doc_id: r.text for r in pii.mask_documents(docs(spark, texts, clash=False)).collect()}
    assert masked[20] == "we met; please write mailbox [EMAIL] now" and masked[21] == "we met; please write mailbox [EMAIL], now"
    assert masked[28] == "hello there charged card [CARD] today" and masked[37] == texts[37]


def test_keys_are_found_by_where_they_stand(spark):
    """Weak seeds alone: keys after a name, keys with a common head; none of it by shape alone."""
    rng = random.Random(4)
    key = lambda n, letters="0123456789abcdef": "".join(rng.choice(letters) for _ in range(n))
    texts = [f"{noise(rng, 20, 'abcd ')} token = \"{key(40)}\" {noise(rng, 20, 'abcd ')}" for _ in range(12)]
    texts += [f"{noise(rng, 20, 'abcd ')} password={key(18)}, {noise(rng, 20, 'abcd ')}" for _ in range(12)] + ["then password=tiger9, that"]
    texts += [f"{noise(rng, 9, 'abcd')} {noise(rng, 9, 'abcd')} QRST{key(16, 'ABCD0123456789')} {noise(rng, 9, 'abcd')}" for _ in range(12)]
    texts += [f"{noise(rng, 9, 'efgh')} {noise(rng, 9, 'efgh')} {key(30)} {noise(rng, 9, 'efgh')}" for _ in range(3)]
    texts += [f"see the {x} here" for x in (key(20), key(20), key(20), key(20), key(20), "old", "red", "big", "dull", "new")]
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(docs(spark, texts))).collect()}
    found = [got[i].n_found for i in range(len(texts))]
    assert found == [1] * 37 + [0] * 13
    assert all(got[i].n_spans == got[i].n_found + sum(got[i][f"n_{k}"] for k in pii.KINDS) for i in range(len(texts)))
    masked = {r.doc_id: r.text for r in pii.mask_documents(docs(spark, texts)).collect()}
    assert masked[0].split("token")[1].startswith(" = \"[SECRET]\"") and "password=[SECRET], " in masked[12] and masked[24] == "then password=[SECRET], that"
    assert masked[37] == texts[37]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bootstrap_step_by_step(spark, seed):
    rng = random.Random(seed)
    names = ["mail", "call", "from", "the", "key", "id", "to", "é", "|", "-"]
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    made = [
        lambda: f"{noise(rng, 4, 'abc')}{rng.randrange(99)}@x{rng.randrange(50)}.org", lambda: f"10.0.{rng.randrange(300)}.{rng.randrange(256)}", lambda: f"+1 (202) 555-{rng.randrange(10**4):04d}",
        lambda: f"+1 (202) {rng.randrange(99)}", lambda: key(20), lambda: f"pin={key(17)}", lambda: f'pin="{key(18)}"', lambda: f"pin={noise(rng, 3, 'abc')}", lambda: f"WXYZ{key(18)}", lambda: noise(rng, 5, "abc"), lambda: f"u{rng.randrange(10**6)}x",
    ]
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 9)):
            k = rng.randrange(8)
            words += [rng.choice(names), rng.choice(names[: 1 + k])]
            # Some names mostly hold one sort of thing.
            words.append(made[k % len(made)]() if rng.random() < 0.8 else rng.choice(made)())
            if rng.random() < 0.2:
                words[-1] = rng.choice(['"', "(", "*"]) + words[-1] + rng.choice([",", ")", ""])
        texts.append(" ".join(words))
    texts += [*ODD, texts[0]]
    got = {r.doc_id: [tuple(x) for x in r.found] for r in pii.find_pii(docs(spark, texts)).collect()}
    want = brute.bootstrap(texts, pii)
    assert [got[i] for i in range(len(texts))] == want and sum(map(len, want)) > 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_planted_keys_are_found(spark):
    """Precision and recall on the test tables, whose keys follow a name or share a head."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    planted = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer(r"(?:token = \"|password=)(\w+)", t or "")}
    got = set()
    for r in pii.find_pii(df).collect():
        got |= {(r.doc_id, x.start, x.stop) for x in r.found}
        assert not r.base or brute.span_text(brute.spans(texts[r.doc_id])) == ",".join(f"{pii.KINDS[x.kind]}:{x.start}:{x.stop}" for x in r.base)
    assert len(planted) >= 5 and planted <= got and all(re.match(r"AKIA", texts[i][a:b]) for i, a, b in got - planted)


def test_masking(spark):
    texts = ["mail a.b@c.example.com or +1 (202) 555-0011, 10.0.0.1 and 4000038985693383; not 300.1.1.1 or 4000038985693384", None, ""]
    out = pii.mask_documents(docs(spark, texts))
    assert out.columns == [*[c.split()[0] for c in DOCS.split(", ")], *CLASHES] and {r.mark for r in out.collect()} == {"x"}
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == "mail [EMAIL] or [PHONE], [IP] and [CARD]; not 300.1.1.1 or 4000038985693384"
    assert got[0].n_chars == len(got[0].text) and got[1].text is None and got[2].text == ""


# ---- 2 ----


def test_licences(spark):
    rng = random.Random(1)
    plain = [noise(rng, 300, "abcdefgh    ") for _ in range(40)]
    notes = {"apache": "Licensed under the Apache License, Version 2.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "mit": "Released under the MIT License.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    texts = plain + [f"{p}\n{t}" for p, t in zip(plain, notes.values(), strict=False)] + [None, "", "the licence of poets", *[notes["mit"]] * 2]
    df = docs(spark, texts)
    got = [r for r in licenses.scan(df, licenses.fit()).orderBy("doc_id").collect()]
    assert [r.families for r in got] == [""] * 40 + list(notes) + ["", "", "", "mit", "mit"]
    assert all(r.n_confirmed == (r.families != "") for r in got)
    empty = docs(spark, ["a"]).limit(0)
    assert licenses.scan(empty, licenses.fit()).count() == 0


def test_other_wordings_and_other_licences(spark):
    """Held-out wordings have their family or none, licences without a family are unknown, ordinary text is nothing."""
    scanner = licenses.fit()
    assert 0.5 <= scanner.threshold < 1 and scanner.vocabulary == licenses.fit().vocabulary
    held = [(t, f) for f, own in licenses.HELD_OUT.items() for t in own]
    other = [(t, "unknown") for t in (*licenses.UNKNOWN_NOTICES[1::2], *licenses.UNSEEN_NOTICES)]
    plain = [(t, "") for t in licenses.ORDINARY] + [("the licence of poets", ""), ("the plate of the car says AB 12", "")]
    texts = [f"Words before it.\n\n{t}\n\nWords after it." for t, _ in held + other + plain]
    found = licenses.paragraphs(docs(spark, texts), scanner).collect()
    by = {r.doc_id: r.family for r in found}
    got = [by.get(i, "") for i in range(len(texts))]
    named = [(g, f) for g, (_, f) in zip(got, held + other + plain, strict=True) if g not in ("", "unknown")]
    assert all(g == f for g, f in named) and len(named) >= 0.8 * len(held)
    assert sum(g == "unknown" for g in got[len(held) : -len(plain)]) >= 0.7 * len(other)
    assert not any(got[-len(plain) :])


NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}


@pytest.mark.parametrize("width", [16, 30, 60, 75])
def test_wrapped_licences(spark, width):
    import textwrap

    rng = random.Random(3)
    plain = [noise(rng, 300, "abcdefgh    ") for _ in range(40)]
    wrapped = {f: textwrap.fill(t, width, break_on_hyphens=False, break_long_words=False) for f, t in NOTICES.items()}
    texts, want = list(plain), [""] * 40
    for f, t in wrapped.items():
        texts += [t, f"{plain[0]}\n{t}\n{plain[1]}", f"{plain[0]}\n\n{t}\n\n{plain[1]}", "\n".join(f" * {x}" for x in t.split("\n")), f"{plain[2]} {t}"]
        want += [f] * 5
    texts += [wrapped["mit"] + "\n" + wrapped["gpl"], wrapped["bsd"] + "\n \n" + wrapped["bsd"], "Released under the MIT License.\nReleased under the MIT License.\n" + wrapped["gpl"], wrapped["mit"].replace("\n", "\n\n").partition(" any")[0]]
    df = docs(spark, texts)
    got = [(r.families, r.n_licences, r.n_confirmed) for r in licenses.scan(df, licenses.fit()).orderBy("doc_id").collect()]
    assert got[:60] == [(w, *[int(w != "")] * 2) for w in want]
    assert got[60:63] == [("gpl,mit", 2, 2), ("bsd", 2, 2), ("gpl,mit", 3, 3)]
    assert got[63][2] == 0


def test_notices_window_by_window(spark):
    import textwrap

    rng = random.Random(12)
    scanner = licenses.fit()
    pool = [*[t for own in (licenses.TEMPLATES, licenses.HELD_OUT) for x in own.values() for t in x], *licenses.UNKNOWN_NOTICES, *licenses.UNSEEN_NOTICES, *licenses.ORDINARY]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            t = " ".join(w for w in rng.choice(pool).split() if rng.random() > 0.1)
            parts.append(textwrap.fill(t, rng.choice([20, 40, 200])) if t else "")
            parts.append(rng.choice(["\n", "\n\n", " ", "\n \n", "\n// "]))
        texts.append("".join(parts))
    texts += [*ODD, texts[0]]
    got = {}
    for r in licenses.paragraphs(docs(spark, texts), scanner).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r["first"], r["last"], r.family, r.confirmed))
    want = [brute.notices(t, scanner, licenses) for t in texts]
    assert [sorted(got.get(i, [])) for i in range(len(texts))] == want and sum(map(len, want)) > 100


# ---- 3 ----


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 2, 0])
def test_repeated_bytes(spark, group):
    """Entries of an anchor are sorted together, or, past the size of a group, ranked by digests."""
    rng = random.Random(5)
    parts = [noise(rng, n) for n in (390, 399, 400, 401, 700, 1500) for _ in range(3)]
    texts = []
    for _ in range(80):
        x = ""
        for _ in range(rng.randrange(5)):
            p, k = rng.choice(parts), rng.randrange(6)
            x += [p, p[rng.randrange(len(p)) :], "a" * rng.choice([399, 400, 450]), "ab" * 250, p[:350] + "Z" + p[351:], noise(rng, 900, "xyz é")][k]
        texts.append(x)
    texts += [*ODD, texts[3], texts[3]]
    ids = [*range(len(texts) - 1), None]
    got = suffix_dedup.remove_repeats(docs(spark, texts, ids), group).collect()
    by = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}
    want = brute.repeats(texts)
    assert [by[i] for i in ids] == want and sum(w[1] for w in want) > 10000
    assert suffix_dedup.remove_repeats(docs(spark, ["a"]).limit(0)).count() == 0


def test_arrays_combine_as_pairs_do(monkeypatch):
    rng = random.Random(6)
    for _ in range(20):
        n, length = rng.randrange(2, 30), 12
        far = np.array([rng.randrange(1, 9) for _ in range(n)])
        near = np.array([rng.randrange(0, f + 1) for f in far])
        phrases = [bytes(rng.choice(b"ab") for _ in range(f)) for f in far]
        suffixes = [(b"abab" + bytes(rng.choice(b"ab") for _ in range(length)))[: length - k] for k in near]
        spread = lambda found: [{d for lo, hi in own for d in range(lo, hi + 1)} for own in found]
        monkeypatch.setattr(suffix_dedup, "PAIRS", 100)
        pairs = spread(suffix_dedup.repeated_starts(phrases, suffixes, near, far, length))
        monkeypatch.setattr(suffix_dedup, "PAIRS", 1)
        assert spread(suffix_dedup.repeated_starts(phrases, suffixes, near, far, length)) == pairs
        string = lambda i, d: phrases[i][:d][::-1] + suffixes[i][: length - d]
        want = [{d for d in range(near[i], far[i] + 1) if any(j != i and near[j] <= d <= far[j] and string(i, d) == string(j, d) for j in range(n))} for i in range(n)]
        assert pairs == want


@pytest.mark.parametrize(("length", "group"), [(64, suffix_dedup.GROUP), (64, 2), (250, suffix_dedup.GROUP), (250, 0), (1000, suffix_dedup.GROUP)])
def test_other_lengths(spark, length, group):
    rng = random.Random(length)
    parts = [noise(rng, length + n) for n in (-1, 0, 1, 30, length) for _ in range(3)]
    texts = []
    for _ in range(60):
        x = ""
        for _ in range(rng.randrange(5)):
            p, k = rng.choice(parts), rng.randrange(4)
            x += [p, p[rng.randrange(len(p)) :], "a" * (length + rng.choice([-1, 0, 20])), noise(rng, length, "xyz é")][k]
        texts.append(x)
    texts += [*ODD, texts[3]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs(spark, texts), group, length).collect()}
    want = brute.repeats(texts, length)
    assert [got[i] for i in range(len(texts))] == want and sum(w[1] for w in want) > 2000


def test_short_lengths_are_refused(spark):
    with pytest.raises(ValueError, match="too short"):
        suffix_dedup.remove_repeats(docs(spark, ["a"]), length=63)


def test_passages_shorter_than_the_contract_are_found_at_their_length(spark):
    """Passages of over 50 words of `benchmark`, of 271 to 394 bytes, stand in several documents: 400 bytes cannot see them, 250 do."""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    passages = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text and len(r.text.split()) > 50]
    holders = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").select("text").collect() if any(p in r.text for p in passages)]
    texts = passages + holders
    whole = [(i, p) for i, t in enumerate(texts) for p in passages if p in t and len(p.encode()) >= 250]
    assert len(holders) > 20
    spans = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in suffix_dedup.remove_repeats(docs(spark, texts), length=250).collect()}
    caught = [any(a <= (at := len(texts[i][: texts[i].index(p)].encode())) and at + len(p.encode()) <= b for a, b in spans[i]) for i, p in whole]
    repeated = [sum(p in t for t in texts) > 1 for _, p in whole]
    assert all(c for c, r in zip(caught, repeated, strict=True) if r) and sum(repeated) > 40


def test_structured_texts_are_told_apart(spark):
    """Words over two letters, on which rolling hashes modulo a power of two collide whatever their base."""
    texts = []
    for a, b in ("ab", "01", "AQ", "!1", "@P"):
        thue = "".join(a if i.bit_count() % 2 else b for i in range(2048))
        turned = thue.translate(str.maketrans(a + b, b + a))
        texts += [f"{x[:n]}{a * (400 - n) if n < 400 else ''}" for n in (256, 2048) for x in (thue, turned)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs(spark, texts)).collect()}
    want = brute.repeats(texts)
    assert [got[i] for i in range(len(texts))] == want and any(w[1] == 0 for w in want)


# ---- 4 ----


def test_pieces_match_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abz.,!  \n\t▁é中😀01<'\x00") for _ in range(rng.randrange(40))) for _ in range(400)] + ODD
    got = {r.doc_id: r for r in sentencepieces.digest_documents(docs(spark, texts), PIECES).collect()}
    full = {r.doc_id: r for r in sentencepieces.encode_documents(docs(spark, texts), PIECES).collect()}
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or ""), lib.eos_id()]
        assert full[i].ids == ids and full[i].decoded == lib.decode(ids)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    with open(PIECES, "rb") as f:
        vocab = sentencepieces.MergeVocabulary(f.read())
    assert vocab.decode(vocab.encode("a new word")) == "a new word"
    vocab.fresh.append(("▁word", "1 2"))
    with pytest.raises(RuntimeError, match="otherwise"):
        vocab.check()


# ---- 5 ----


def test_targets(spark):
    def targets(sizes, weights):
        rows = [(f"s{i:03d}", n) for i, n in enumerate(sizes)]
        found = mixing.source_targets(spark.createDataFrame(rows, "source string, size long"), weights=tuple(weights)).table
        return [r.target for r in found.orderBy("source_no").collect()]

    assert targets([10, 10, 10], [1, 1, 1]) == [15.0, 15.0, 15.0]
    assert targets([10, 100, 100], [5, 2, 1]) == pytest.approx([20, 295 * 2 / 3, 295 / 3])
    assert targets([10, 60, 1000], [5, 2, 1]) == pytest.approx([20, 120, 1465])
    assert targets([], [1]) == [] and targets([0, 0], [1, 1]) == [0, 0] and targets([10, 0], [1, 5]) == [15.0, 0.0]
    rng = random.Random(2)
    sizes = [rng.randrange(3) * rng.randrange(10 ** rng.randrange(1, 6)) for _ in range(200)]
    assert targets(sizes, mixing.WEIGHTS) == brute.allot(sizes, [mixing.WEIGHTS[i % 3] for i in range(200)])


def test_mix(spark):
    rng = random.Random(3)
    texts = [" ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(400))) for _ in range(300)] + [None, "", " \n ", *["one two  three\n"] * 40, "x " * 9000, "y z"]
    sources = [rng.choice(["a", "a", "a", "a", "b", "c", "é", None]) for _ in range(303)] + ["b"] * 40 + ["a", "tiny"]
    ids = [*range(303), *[5] * 20, *[None] * 20, 7, 7]
    df = docs(spark, texts, ids, sources)
    want, parts = brute.mixed(list(zip(ids, sources, texts, strict=True)), mixing.GOLDEN)
    per, pieces = mixing.mix(df)
    columns = ["doc_id", "source", "size", "source_size", "target", "taken", "first_slot"]
    assert rows(per, *columns) == sorted(((i, s, *w) for i, s, w in zip(ids, sources, want, strict=True)), key=str)
    assert rows(per, *columns) == rows(mixing.mix(df.repartition(7))[0], *columns)  # reruns agree
    slots = pieces.groupBy("slot").agg(F.sum("taken").alias("n")).collect()
    assert max(r.n for r in slots) <= mixing.BLOCK_WORDS
    # The documents of the mix: the words taken, repeated rows on their own, in the order of the schedule.
    out = mixing.mixed_documents(df)
    assert out.columns == [*[c.split()[0] for c in DOCS.split(", ")], *CLASHES]
    got = out.collect()
    cut = lambda t, n: t if n == len(t.split()) else re.match(rf"(\s*\S+){{{n}}}", t)[0]
    made = [(i, cut(t, n)) for i, t, p in zip(ids, texts, parts, strict=True) for n in p]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(made, key=str)
    assert all(r.n_chars == len(r.text) and r.key == "x" for r in got)
    first = {(i, s): w[4] for i, s, w in zip(ids, sources, want, strict=True)}
    lead = [first[r.doc_id, r.source] for r in got if ids.count(r.doc_id) == 1 and len(parts[ids.index(r.doc_id)]) == 1]
    assert lead == sorted(lead) and len(lead) > 30
    assert mixing.mix(df.limit(0))[0].count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_schedule_spreads_sources(spark):
    sized = spark.createDataFrame([("a", 256 * 300), ("b", 256 * 100), ("c", 1)], "source string, size long")
    sources = mixing.source_targets(sized, weights=(3, 1, 1), share=1)
    slots = mixing.schedule(sized, sources).orderBy("slot").collect()
    assert sources.blocks == len(slots) and sorted(r.source_no for r in slots)[-1] == 2
    for k in range(0, 400, 40):
        assert 28 <= sum(r.source_no == 0 for r in slots[k : k + 40]) <= 32


def test_points_are_exact(spark):
    ks = [0, 1, 2, 12345, 2**31 - 2, 2**31, 2**40 + 7, 10**15, 2**61 - 5]
    got = spark.createDataFrame([(k,) for k in ks], "k long").select("k", *[mixing.place_of(F.col("k"), n).alias(f"n{n}") for n in (1, 7, 10**17)]).collect()
    for r in got:
        for n in (1, 7, 10**17):
            assert r[f"n{n}"] == ((r.k + 1) * mixing.GOLDEN % (1 << 62)) * n >> 62


# ---- 6 ----


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1", "http://example.com/en/1?q", "http://a.b.net/fr/x#y", "http://a.b.net/en/x", "http://x.com", "http://spam.org/a", "http://a.spam-x.org/", "x", None, "", "a://b://c.net/es/", "http://net/es/", "http://example.com/en", "http://example.com/en/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, key string")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    listed = lambda: spark.createDataFrame([("spam.org/",), ("spam-x.org/",), ("spam.org/",), ("not.asked.for/deep/path/",)], "key string")
    got = urlfilter.judge_urls(df, rules, listed())
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert by[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert by[1][2:] == ("example.com/en/", "block") and by[2] == ("a.b.net", "/fr/x", "net/fr/", "block") and by[3][2:] == (None, "allow")
    assert by[4] == ("x.com", "", None, "allow") and by[5][2:] == (None, "block") and by[6][2:] == (None, "block")
    assert by[7] == by[8] == by[9] == ("", "", None, "allow") and by[10][:2] == ("b:", "//c.net/es/")
    assert by[11][2:] == ("net/es/", "block") and by[12][2:] == ("com/", "allow") and by[13][2:] == ("example.com/en/", "block")
    assert rows(urlfilter.judge_urls(df, rules, listed(), most_bytes=0), *got.columns) == rows(got, *got.columns)  # the join beyond the size bound
    assert urlfilter.judge_urls(df.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        urlfilter.judge_urls(df, [("block", "a", "/x")])
    with pytest.raises(ValueError, match="different verdicts"):
        urlfilter.judge_urls(df, [("block", "A.com", "/"), ("allow", "a.com", "/")])


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = urlfilter.build_cascade(universe, universe.where("hash(key) % 10 = 0"))
    listed = {r.key for r in universe.where("hash(key) % 10 = 0").collect()}
    assert len(cascade.levels) > 1 and all((f"k{i}" in cascade) == (f"k{i}" in listed) for i in range(20000))


# ---- 7 ----


@pytest.mark.parametrize("block", [4096, 20])
def test_embeddings(spark, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.12, base[:10] * 3, np.zeros((1, 16))])
    vectors = [list(map(float, v)) for v in x.astype(np.float32)] + [None, [], [float("nan")] * 16, [float("inf")] * 16, [1.0, None], vec := [1.0] * 16, vec, [1.0] * 8]
    labels = [n % 3 for n in range(30)] * 2 + [None] * 5
    labels = (labels + [0] * 20)[: len(vectors)]
    df = spark.createDataFrame([(i, v, l, "x") for i, (v, l) in enumerate(zip(vectors, labels, strict=True))], "vec_id long, embedding array<float>, label int, n string")

    def linked(i, j):
        a, b = vectors[i], vectors[j]
        if labels[i] is None or labels[i] != labels[j] or not a or not b or len(a) != len(b):
            return False
        a, b = np.array(a, float), np.array(b, float)
        if not (np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()):
            return False
        return a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98

    ids = list(range(len(vectors)))
    want = brute.joined(ids, linked)
    got = embed_dedup.near_duplicates(df, block_rows=block).orderBy("vec_id").collect()
    assert [r.component_id for r in got] == want and [r.kept for r in got] == [w == i for i, w in enumerate(want)]
    assert [r.n_links for r in got] == [sum(linked(i, j) for j in ids if j != i) for i in ids] and any(r.n_links for r in got)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_forest():
    rng = np.random.default_rng(3)
    for n in (1, 2, 30, 200):
        pairs = [(x, y) for x in range(n) for y in range(x) if rng.random() < 1.5 / n]
        some = [pairs[k::3] for k in range(3)]
        arrays = ((np.array([p[0] for p in own], int), np.array([p[1] for p in own], int)) for own in some)
        counts, kept = embed_dedup._forest(n, arrays, np.ones(n, int))
        assert counts.tolist() == [sum(v in p for p in pairs) for v in range(n)] and set(kept) <= set(pairs)
        whole, tree = ({frozenset(p) for p in own} for own in (pairs, kept))
        parts = lambda links: brute.joined(list(range(n)), lambda i, j: frozenset((i, j)) in links)
        assert parts(whole) == parts(tree) and len(kept) == n - len(set(parts(whole)))


def test_error_bound_holds():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(200, 64)), rng.normal(size=(200, 64))
    u, q, s, e = embed_dedup.quantise(a)
    v, q2, s2, e2 = embed_dedup.quantise(b)
    gap = np.abs(u @ v.T - (q @ q2.T) * s[:, None] * s2[None, :])
    assert (gap <= e[:, None] * (1 + e2[None, :]) + e2[None, :] + embed_dedup.SLACK).all() and np.abs(q).max() <= 127


# ---- 8 ----


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    rng = random.Random(7)
    texts = []
    for _ in range(25):
        base = [noise(rng, rng.randrange(2, 8), "abcdef") for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 15)):
                copy[rng.randrange(len(copy))] = "edit" + noise(rng, 3, "xyz")
            texts.append(" ".join(copy))
    texts += [*ODD, "One Word", "one word", "oneword", texts[0].upper()]
    ids = rng.sample(range(1000), len(texts))
    sizes, parts = brute.near(texts, ids, words)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.link_components(docs(spark, texts, ids), words).collect()}
    assert got == {i: (n, c, c == i) for i, n, c in zip(ids, sizes, parts, strict=True)}
    kept = minhash.one_of_each(docs(spark, texts, ids), words)
    assert kept.columns == [*[c.split()[0] for c in DOCS.split(", ")], *CLASHES] and {r.mark for r in kept.collect()} == {"x"}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(parts))
    assert minhash.link_components(docs(spark, ["a"]).limit(0), words).count() == 0


def test_long_lists_take_the_exact_path(spark, monkeypatch):
    """One passage in many documents that are otherwise their own, next to a large group of near copies."""
    monkeypatch.setattr(minhash, "SHORT_LIST", 3)
    rng = random.Random(9)
    word = lambda: noise(rng, 6, "abcdefgh")
    passage = [word() for _ in range(60)]
    texts = [" ".join(passage + [word() for _ in range(rng.randrange(5, 40))]) for _ in range(60)]
    for _ in range(60):
        copy = list(passage)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(60)] = word()
        texts.append(" ".join(copy))
    ids = list(range(len(texts)))
    got = {r.doc_id: r.component_id for r in minhash.link_components(docs(spark, texts), 2).collect()}
    assert [got[i] for i in ids] == brute.near(texts, ids, 2)[1]


def test_repeated_ids(spark):
    df = docs(spark, ["a b c d", "a b c d", "a b c d", "x y z w"], [4, 4, None, 9])
    got = minhash.link_components(df, 2)
    assert rows(got, "doc_id", "component_id") == sorted([(4, 4), (4, 4), (None, 4), (9, 9)], key=str)
    assert sorted(str(r.doc_id) for r in minhash.one_of_each(df, 2).collect()) == ["4", "9", "None"]


def test_texts_of_one_id_are_judged_apart(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f", "x y z w v u", "x y z w v u", "", ""], [3, 5, 5, 5, 5, 5])
    assert rows(minhash.link_components(df, 2), "doc_id", "n_shingles", "component_id") == sorted([(3, 5, 3), (5, 5, 3), (5, 5, 5), (5, 5, 5), (5, 0, 5), (5, 0, 5)], key=str)
    assert rows(minhash.one_of_each(df, 2), "doc_id", "text") == sorted([(3, "a b c d e f"), (5, "x y z w v u"), (5, "")], key=str)


def test_signature_tests_miss_hardly_any():
    assert minhash.missed() < 1e-6 and minhash.missed(0.9) < 1e-12


def test_components(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (3, 2), (7, 7), (None, 5), (10, 11)], "a long, b long")
    assert rows(components.components(links), "id", "component") == sorted([(1, 1), (2, 1), (3, 1), (7, 7), (10, 10), (11, 10)], key=str)
    assert components.components(links.limit(0)).count() == 0


# ---- 9 ----


def test_token_store(spark, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    lib.encode_special_tokens = True
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "B", "1", " the", " foo", ".", ",", "'s", " ", "\n", "é", "中", "\xa0"]) for _ in range(rng.randrange(60))) for _ in range(300)] + ODD
    ids = rng.sample(range(10000), len(texts))
    df = docs(spark, texts, ids)
    token_store.write_tokens(df, str(tmp_path / "s"), BYTES, 2, partitions=5)
    stored = token_store.read_tokens(spark, str(tmp_path / "s"))
    got = {r.doc_id: r for r in token_store.with_crc32(stored).collect()}
    full = {r.doc_id: r.tokens for r in stored.collect()}
    start = 0
    for i, t in sorted(zip(ids, texts, strict=True)):
        want = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert full[i] == want
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    one = token_store.read_tokens(spark, str(tmp_path / "s"), ids=[ids[5]])
    assert [(r.doc_id, r.tokens, r.start) for r in one.collect()] == [(ids[5], full[ids[5]], got[ids[5]].start)]
    assert "PushedFilters: [IsNotNull" in one._jdf.queryExecution().toString()
    assert "tokens:array" not in token_store.read_tokens(spark, str(tmp_path / "s"), with_tokens=False)._jdf.queryExecution().executedPlan().toString()
    assert token_store.store_and_read(df.limit(0), BYTES, 2).count() == 0
    again = token_store.store_and_read(docs(spark, ["b", "a", "a"], [1, 1, None]), BYTES, 2)
    assert sorted(r.start for r in again.collect()) == [0, 2, 4]


def test_token_store_files(spark, tmp_path):
    """Packed ids and counts, sorted row groups, pages that an index finds."""
    import pyarrow.parquet as pq

    rng = random.Random(8)
    texts = [" ".join(noise(rng, rng.randrange(2, 9), "abcdefghij") for _ in range(rng.randrange(80))) for _ in range(6000)]
    token_store.write_tokens(docs(spark, texts, clash=False), str(tmp_path / "s"), BYTES, 2, partitions=2)
    files = sorted((tmp_path / "s").glob("part-*.parquet"))
    assert len(files) == 2
    last = -1
    for f in files:
        meta = pq.ParquetFile(f).metadata
        columns = {meta.row_group(0).column(i).path_in_schema: i for i in range(meta.num_columns)}
        tokens = next(i for c, i in columns.items() if c.startswith("tokens"))
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            ids = group.column(columns["doc_id"])
            assert ids.statistics.min > last
            last = ids.statistics.max
            assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(group.column(tokens).encodings) and {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(ids.encodings)
            assert all(group.column(i).has_offset_index and group.column(i).has_column_index for i in (columns["doc_id"], tokens))
    assert last == 5999


def test_token_store_splits_an_id_of_many_rows(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "SAME_ID_ROWS", 100)
    lib = Tokenizer.from_file(BYTES)
    rng = random.Random(9)
    texts = [noise(rng, rng.randrange(30)) for _ in range(900)]
    ids = [None if n % 3 else n for n in range(900)]
    token_store.write_tokens(docs(spark, texts, ids), str(tmp_path / "s"), BYTES, 2, partitions=6, literal=False)
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.where("doc_id IS NULL").select("part").distinct().count() > 2
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.tokens) for r in token_store.read_tokens(spark, str(tmp_path / "s")).collect())
    assert [g[1] for g in got] == sorted(g[1] for g in got)
    assert [g[0] for g in got] == [sum(len(x[2]) for x in got[:n]) for n in range(len(got))]
    want = [(-1 if i is None else i, [*lib.encode(t, add_special_tokens=False).ids, 2]) for i, t in zip(ids, texts, strict=True)]
    assert sorted(g[1:] for g in got) == sorted(want)


def test_token_store_takes_special_tokens_as_the_library_does(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    texts = ["foo <|endoftext|> bar", "plain words", "<|endoftext|>", "a<|endoftext|>b\n<|endof text|> c", *ODD]
    got = {r.doc_id: r for r in token_store.store_and_read(docs(spark, texts), BYTES, 2).collect()}
    start = 0
    for i, t in enumerate(texts):
        want = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert 50256 in lib.encode(texts[0], add_special_tokens=False).ids


# ---- 10 ----


def test_base_counts():
    rng = random.Random(6)
    texts = [noise(rng, rng.randrange(200), "ab \n#|é\x1c\x85\t") for _ in range(400)] + ODD
    for t in texts:
        assert quality.base_counts(t or "") == brute.quality(t)


def best_path(chain, x):
    import itertools

    score = x @ chain.state
    paths = itertools.product((0, 1), repeat=len(x))
    return max(sum(score[t, y] for t, y in enumerate(p)) + sum(chain.step[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(30):
        chain = quality.Chain(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=(2, 2)))
        x = rng.integers(0, 2, (6, len(quality.FEATURES))).astype(float)
        y = chain.decode(x)
        own = sum((x @ chain.state)[t, k] for t, k in enumerate(y)) + sum(chain.step[a, b] for a, b in zip(y, y[1:], strict=False))
        assert own == pytest.approx(best_path(chain, x))


def test_quality_without_labels(spark):
    df = docs(spark, ["word one two three four five " * 3 + " ".join(f"w{i}" for i in range(60)), None, ""])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judge(df, quality.fit_chain(df, labels)).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [True, False, False] and got[1].n_words == 0 and got[1].base_failed
    assert quality.judge(df.limit(0), quality.Chain(np.zeros((len(quality.FEATURES), 2)), np.zeros((2, 2)))).count() == 0


def test_lines_are_labelled_within_documents(spark):
    """Good paragraphs beside navigation bars and shouting: the share follows the lines, and decides."""
    rng = random.Random(8)

    def prose():
        return " ".join(rng.choice(["river", "stone", "morning", "letter", "garden", "window", "slowly", "because", "under", "walked"]) + rng.choice("abcdefgh") for _ in range(14)).capitalize() + "."

    junk = [lambda: " | ".join(rng.choice(["Home", "About", "Help", "Login"]) + str(rng.randrange(99)) for _ in range(8)), lambda: " ".join("BUY" + noise(rng, 4, "ABCD") + "!!" for _ in range(9)), lambda: " ".join(noise(rng, 5, "abc") + "$$$" for _ in range(9))]
    bad = lambda: rng.choice(junk)()
    train = [([prose() for _ in range(9)] + [bad()], 1) for _ in range(40)] + [([prose()] + [bad() for _ in range(9)], 0) for _ in range(40)]
    mixed = [[prose() for _ in range(k)] + [bad() for _ in range(12 - k)] for k in range(13)]
    texts = ["\n".join(rows) for rows, _ in train] + ["\n".join(x) for x in mixed]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, q) for i, (_, q) in enumerate(train)], "doc_id long, quality int")
    chain = quality.fit_chain(df, labels)
    for k, rows in enumerate(mixed):
        size = [len(x.replace(" ", "")) for x in rows]
        assert quality.verdict("\n".join(rows), chain)[2] == pytest.approx(sum(size[:k]) / sum(size))
    got = [r for r in quality.judge(df, chain).orderBy("doc_id").collect()][len(train) :]
    assert [r.kept for r in got] == [not r.base_failed and r.content_share >= 0.5 for r in got] and 4 < sum(r.kept for r in got) < 12
    assert rows_of(quality.keep_good(df, chain)) == {i for i, r in enumerate(quality.judge(df, chain).orderBy("doc_id").collect()) if r.kept}


def test_letters():
    for line in ["", "aB", "éÀ 中a1!", "ß|ǅ", "x" * 100 + "É" * 50]:
        assert quality._letters(line) == (sum(map(str.isalpha, line)), sum(map(str.isupper, line)))


def test_training_takes_one_text_of_an_id(spark):
    df = docs(spark, ["word " * 30, "| a | b", None, "plain words of a line."], [1, 1, 1, 2])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (9, 0), (2, None)], "doc_id long, quality int")
    assert quality.fit_chain(df, labels).state.any()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.judge(df, quality.fit_chain(df, train)).join(held, "doc_id").where("NOT base_failed").collect()
    right = sum(r.kept == (r.quality == 1) for r in got)
    assert right >= 0.97 * len(got) and len(got) > 100
