"""Encoding, packing, decontamination, licenses, fingerprints against plain versions; odd rows; the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest

from bitextile.llm import bpe, decontaminate, fingerprint, licenses, packing

ODD = [(None, "a b", "en"), (1, None, "en"), (2, "", None), (3, "A a\x0bB", "en"), (3, "A a\x0bB", "en"), (5, "é😀 <|endoftext|>  \n x", "x")]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe(spark, tokenizer):
    e, r = bpe.encoder(bpe.vocabulary()), random.Random(1)
    alphabet = " \t\n\r\x0b 　 aAbcdelnstr019'.,!?<|>éüñß中文😀́\x00\x85"
    for k in range(3000):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(30)))
        if k % 7 == 0:
            t = t[:5] + "<|endoftext|>" + t[5:]
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert e.encode(t) == want and e.decode(want) == tokenizer.decode(want, skip_special_tokens=False)
    docs = spark.createDataFrame(ODD, "doc_id long, text string, ids string")
    rows = bpe.digests(docs).collect()
    assert len(rows) == len(ODD)
    for (_, t, _), x in zip(ODD, rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    again = bpe.decode_ids(bpe.encode_documents(docs)).select("text", "decoded").collect()
    assert all((x.text or "") == x.decoded for x in again)


def test_packing(spark, tokenizer, tmp_path):
    r = random.Random(3)
    lengths = [r.randrange(0, 700) for _ in range(400)]
    rows = packing.pack(lengths, 256)
    room = []
    pieces = sorted((n % 256 for n in lengths if n % 256), reverse=True)
    for n in pieces:
        fit = [(x, i) for i, x in enumerate(room) if x >= n]
        if fit:
            room[min(fit)[1]] -= n
        else:
            room.append(256 - n)
    assert len(rows) == len(room) + sum(n // 256 for n in lengths)
    assert all(sum(n for _, _, n in row) <= 256 for row in rows)
    docs = spark.createDataFrame([*ODD, (9, "word " * 5000, "en")], "doc_id long, text string, ids string")
    got: dict = {}
    for x in packing.packed(docs, 128).collect():
        m = np.frombuffer(x.ids, "<u2")
        for k, (d, o) in enumerate(zip(x.doc_ids, x.doc_offsets)):
            got.setdefault(d, []).append((o, m[x.cu_seqlens[k] : x.cu_seqlens[k + 1]].tolist()))
        assert np.frombuffer(x.positions, "<u2").tolist() == [p for a, z in zip(x.cu_seqlens, x.cu_seqlens[1:]) for p in range(z - a)] + [0] * (128 - x.cu_seqlens[-1])
    want = tokenizer.encode("word " * 5000, add_special_tokens=False).ids
    assert sum((p for _, p in sorted(got[9])), []) == want and 1 not in got and 2 not in got
    assert got[5] == [(0, tokenizer.encode(ODD[5][1], add_special_tokens=False).ids)]
    packing.write_packed(docs, str(tmp_path / "packed"), 128)
    again = spark.read.parquet(str(tmp_path / "packed"))
    assert again.count() == packing.packed(docs, 128).count()
    assert sorted((str(x.doc_id), x.n_tokens) for x in packing.unpacked(again).groupBy("doc_id").agg({"n_tokens": "sum"}).toDF("doc_id", "n_tokens").collect()) == sorted((str(d), sum(len(p) for _, p in v)) for d, v in got.items())
    assert packing.packed(docs.limit(0)).count() == 0


def test_decontamination(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: word.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("abcdef") + r.choice("xy") for _ in range(n))
    items = [(k, text(25)) for k in range(6)] + [(7, "Only-three words"), (8, ""), (9, None), (None, text(12)), (7, "Only-three words")]
    docs = [*ODD, *((k, text(r.randrange(60)) + ", " + items[k % 6][1][r.randrange(20) :] + " " + items[k % 6][1].upper() + " only THREE. words " + text(5), "en") for k in range(10, 60))]
    windows: dict = {}
    for i, t in items:
        w = fold(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(i)
    want = []
    for d, t, _ in docs:
        w, hit, found = fold(t), set(), set()
        for g, own in windows.items():
            for a in range(len(w) - len(g) + 1):
                if tuple(w[a : a + len(g)]) == g:
                    hit.update(range(a, a + len(g)))
                    found |= own - {None}
        ids = sorted(map(str, found))
        want.append((str(d), len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    frame = spark.createDataFrame(docs, "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((str(x[0]), *x[1:]) for x in decontaminate.digests(frame, bench).collect()) == sorted(want)
    old, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, 300  # several blocks
    try:
        assert sorted((str(x[0]), *x[1:]) for x in decontaminate.digests(frame, bench).collect()) == sorted(want)
    finally:
        decontaminate.BLOCK_BYTES = old
    assert {x.n_hit for x in decontaminate.digests(frame, bench.limit(0)).collect()} == {0}
    clean = decontaminate.decontaminated(frame, bench)
    assert clean.columns == ["doc_id", "text", "items"]
    assert {x.doc_id: x.text for x in clean.collect()}[5] == ODD[5][1]


def test_licenses(spark):
    rows = [*ODD, (6, "See the MIT License, and mit-license!\nLicensed under CC BY-NC 4.0.", "en"), (7, "mİt license General\nPublic  license K", "en"), (8, "licensed by nc under 4 cc 0 extra", "x")]
    got = {x.doc_id: x for x in licenses.digests(spark.createDataFrame(rows, "doc_id long, text string, score string")).collect()}
    assert (got[6].n_base, got[6].first_word, got[6].last_word, got[6].base_labels, got[6].labels) == (2, 2, 5, "mit", "cc-by-nc,mit")
    assert (got[7].base_labels, got[7].n_base, got[7].first_word) == ("gpl", 1, 2)
    assert (got[8].labels, got[8].score, got[8].base_labels) == ("cc-by-nc", 1.0, "")
    assert (got[1].n_words, got[1].score, got[1].first_word, got[1].labels) == (0, 0.0, None, "")


def test_fingerprints(spark):
    texts = {1: "a b c\nd e f\n\nx", 2: "x\nd e f\na b c", 3: "a b c", 4: "d e f\nx", 5: None, 6: "other words here"}
    rows = {x.doc_id: x.fingerprint for x in fingerprint.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert rows[1] == rows[2] != rows[3]
    assert fingerprint.combine(rows[3], rows[4]) == rows[1] and fingerprint.combine(rows[1], rows[4], -1) == rows[3]
    data = [*ODD, *((k, f"text {k} " * (k % 9)) for k in range(20, 60))]
    data = [x[:2] for x in data]
    pairs = fingerprint.edited_neighbours(spark.createDataFrame(data, "doc_id long, text string"), 200).collect()
    order = sorted(data, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    want = []
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((str(d), len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted((str(x.doc_id), x.n_chars, x.edited_sha256) for x in pairs) == sorted(want)
    assert fingerprint.edited_neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = " ".join(f"w{k}" for k in range(60))
    docs = [(k, f"start{k} " + " ".join(f"t{k}x{j}" for j in range(40)), "en", "s", 0) for k in range(30)]
    head = " ".join(f"h{k}" for k in range(40)) + " "
    docs += [(30, docs[3][1] + " more", "en", "s", 0), (31, base + " tail one", "en", "s", 0), (32, head + base, "en", "s", 0), (33, None, "en", "s", None), (34, "", None, None, 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"t5x{j}" for j in range(10, 25)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = frame
    results = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == frame.columns
        results.append({x.doc_id: x.text for x in kept.collect()})
    assert 30 not in results[1] and len(results[1]) == len(docs) - 1
    assert results[2][31] == docs[31][1] and results[2][32].split() == head.split()
    assert "t5x12" not in results[3][5] and results[3][6] == docs[6][1]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(docs) - 1


def test_licenses_wrapped_over_lines(spark):
    import textwrap

    rows = []
    for k, (label, t) in enumerate(licenses.TEMPLATES):
        rows += [(2 * k, "\n".join(f" * {x}" for x in textwrap.wrap(f"Some words before. {t}", 24)), label), (2 * k + 1, "\n\n".join(f"{w} {'and so on ' * 12}" for w in t.split()), "")]
    got = {x.doc_id: x for x in licenses.digests(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()}
    for d, _, want in rows:
        if want:
            assert want in got[d].labels.split(",") and got[d].score == 1.0
        else:
            assert got[d].labels == "" and got[d].score == 0.0  # its words stand too far apart
