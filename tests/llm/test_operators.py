"""The large-scale operators against brute force, round trips and odd rows."""

from __future__ import annotations

import collections
import fractions
import itertools
import math
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import common, language, license, media, mixing, neardup, packing, quality, queries, topk, warc, wavelet
from sparkloom.llm.tokens import public_path, units

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, rep long, size long, id long"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], DOCS)


ODD = [
    (1, None, None, None), (2, "", "en", "b"), (3, " \n ", "en", "a"), (4, "one", None, "a"), (5, "two words", "en", None),
    (6, "the quick brown fox jumps over the lazy dog " * 3, "en", "a"), (7, "the quick brown fox jumps over the lazy dog " * 3, "en", "a"),
    (7, "the quick brown fox jumps over the lazy dog " * 3, "en", "a"), (8, "Licensed under the Apache License, Version 2.0.", "en", "b"),
    (9, "é ̈ " + "日本 語 " * 40, "fr", "b"), (10, "word " * 30000, "de", "c"), (None, "no id here at all", "en", "c"), (11, "12 34 !!", "en", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- words, tokens ------------------------------------------------------------


def test_span_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"abc xyz abc  abcd", np.uint8)
    start, end, _ = common.runs((~common.IS_SPACE[data]).astype(np.uint8), np.array([0, len(data)]))
    h = common.span_hashes(data, start, end)
    assert h[0] == h[2] and len({*h.tolist()}) == 3


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_library_ids(name, documents):

    encoder, fresh = units(public_path(name)), Tokenizer.from_file(public_path(name))
    texts = [r.text for r in documents.select("text").limit(60).collect()] + [r[1] for r in ODD if r[1] is None or len(r[1]) < 9999]
    texts += ["", " ", "  a", "a  b", "it's 'll\n\n x\t y", "<|endoftext|> x", "e ́ a", "ΑΣ ΟΔΟΣ.\nx", "a b", "o'neil's a,'s ',a '' .\nx", "É é, ×,a ÷.b", "a\x00 b \x7f c", "İstanbul K"]
    for a, b, data, offsets in common.text_chunks(pa.array(texts)):
        ids, at = encoder.encode(data, offsets)
        for r in range(a, b):
            want = fresh.encode(texts[r] or "", add_special_tokens=False).ids + [1]
            assert ids[at[r - a] : at[r - a + 1]].tolist() == want, texts[r]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_ids_of_a_fresh_tokenizer_at_white_space(name):
    fresh, encoder = Tokenizer.from_file(public_path(name)), units(public_path(name))
    texts = ["a\n\nb", "para one.\n\nPara two", "a\n\n\nb", "a\r\nb", "a\r\n\r\nb", "é\n\né", "\n\nb", "a\n\n", "b", "a  ", "b", "a \n", "b", "\n", "\n", "b"]
    rng = np.random.default_rng(3)
    pieces = ["a", "B", "\n", "\n", " ", "\r", "\t", ".", "'s", "é", "\u3000", "\u00a0", "7", "日", "\u0301", "-"]
    texts += ["".join(rng.choice(pieces, rng.integers(0, 12))) for _ in range(5000)]
    for a, b, data, offsets in common.text_chunks(pa.array(texts)):
        ids, at = encoder.encode(data, offsets, None)
        for r in range(a, b):
            assert ids[at[r - a] : at[r - a + 1]].tolist() == fresh.encode(texts[r], add_special_tokens=False).ids, texts[r]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_ids_of_a_fresh_tokenizer_for_added_tokens(name):
    fresh, encoder = Tokenizer.from_file(public_path(name)), units(public_path(name))
    texts = ["see <|endoftext|> here", "<|startoftext|>x", "a\n\n<|endoftext|>\n\nb", "<|endof", "text|>", "a<|endoftext|><|endoftext|>", "<|<|endoftext|>|>", "<|ENDOFTEXT|>"]
    rng = np.random.default_rng(4)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "a", "\n", " ", ".", "é", "<", "|", ">"]
    texts += ["".join(rng.choice(pieces, rng.integers(0, 9))) for _ in range(3000)]
    for a, b, data, offsets in common.text_chunks(pa.array(texts)):
        ids, at = encoder.encode(data, offsets, None)
        for r in range(a, b):
            assert ids[at[r - a] : at[r - a + 1]].tolist() == fresh.encode(texts[r], add_special_tokens=False).ids, texts[r]


def test_units_with_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    from sparkloom.llm import tokens

    monkeypatch.setattr(tokens, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    path = public_path("byte_bpe_50k.json")
    texts = [b"one two six ten", b"abc abd xyz", b""]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ids, at = tokens.Units(path).encode(np.frombuffer(b"".join(texts), np.uint8), offsets, None)
    fresh = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [fresh.encode(t.decode(), add_special_tokens=False).ids for t in texts]


# ---- 1 packing ------------------------------------------------------------------


def _check_pieces(rows, texts):
    tokenizer = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    want = collections.Counter((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in texts)
    by_doc, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    for doc, ids in want:
        own = [r for r in by_doc[doc] if r.doc_tokens == len(ids) and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert sum(r.length for r in own) == len(ids) * want[doc, ids]
    assert sum(r.length for r in rows) == sum(len(i) * n for (_, i), n in want.items())
    padding = 0
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 2048 - at if at & (at - 1) else 0
    assert padding == 0


def test_packing(spark, odd, documents):
    rows = packing.pack(odd, public_path("byte_bpe_50k.json")).collect()
    _check_pieces(rows, [(r[0], r[1]) for r in ODD])
    texts = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    _check_pieces(packing.pack(documents, public_path("byte_bpe_50k.json"), shard_tokens=20000).collect(), texts)
    assert packing.pack(odd.where("false"), public_path("byte_bpe_50k.json")).count() == 0


def test_packing_puts_neighbours_together():
    rng = np.random.default_rng(1)
    topics = [rng.integers(100 * k, 100 * k + 80, (6, 300)) for k in range(10)]
    docs = [d for group in zip(*topics, strict=True) for d in group]  # topics alternate
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    pieces = packing.pack_windows(np.concatenate(docs).astype(np.uint32), at)
    first = [p[0] % 10 for p in pieces if p[3] == 0]
    assert first.count(first[0]) == 6


def test_packing_brings_copies_of_the_whole_table_together(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 60)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string").repartitionByRange(6, "doc_id")
    path = public_path("byte_bpe_50k.json")
    rows = packing.pack(docs, path, shard_tokens=8000).collect()
    _check_pieces(rows, list(enumerate(texts * 2)))
    windows = collections.defaultdict(set)
    for r in rows:
        windows[r.doc_id].add(r.sequence_id)
    together = sum(bool(windows[i] & windows[i + 300]) for i in range(300))
    assert together > 250
    tokenizer = Tokenizer.from_file(path)
    ids = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts * 2]  # end ids are no terms
    stats = packing.statistics(packing.encoded(docs, path, 1))
    want = collections.Counter(i for own in ids for i in set(own))
    assert stats.docs == 600 and np.isclose(stats.mean, np.mean(list(map(len, ids)))) and {int(i): int(stats.df[i]) for i in np.flatnonzero(stats.df)} == want


def test_packing_fills_a_window_with_all_neighbours_of_its_seed():
    rng = np.random.default_rng(5)
    docs = [np.concatenate([[1000 + i % 10], rng.integers(0, 9, 3) + 10 * (i % 10) + 2000]) for i in range(1000)]  # topics alternate, 4 ids each
    at = np.arange(0, 4001, 4)
    pieces = packing.pack_windows(np.concatenate(docs).astype(np.uint32), at, 256)
    assert sorted((d, s) for d, s, *_ in pieces if s == 0) == [(i, 0) for i in range(1000)]
    topics = [{p[0] % 10 for p in pieces if p[3] == w} for w in range(15)]
    assert len(topics[0]) == 1 and sum(map(len, topics)) <= 15 + 10
    lonely = np.concatenate([[7 * i, 7 * i] for i in range(5)] + [[1, 2]] * 3).astype(np.uint32)  # without neighbours, then a topic
    order = [p[0] for p in packing.pack_windows(lonely, np.arange(0, 17, 2), 64)]
    assert sorted(order) == list(range(8))


def test_bm25_against_brute_force():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 40, n) for n in (30, 50, 20, 80)]
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    index, mean = packing.Bm25(np.concatenate(docs), at), np.mean([len(d) for d in docs])

    def impact(t, d):
        df, tf = sum(t in x for x in docs), int((d == t).sum())
        return np.log1p((4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))

    want = [sum(impact(t, d) for t in set(docs[0].tolist())) for d in docs]
    assert np.allclose(index.scores(0), want, rtol=1e-5)
    stats = packing.Stats(4, mean, np.bincount([t for d in docs for t in set(d.tolist())]))
    for least, got in zip((0, 2, 4), packing.topics(np.concatenate(docs), at, stats, (0, 2, 4)), strict=True):
        for d, own in zip(docs, got.tolist(), strict=True):
            telling = [t for t in sorted(set(d.tolist())) if stats.df[t] >= least]
            assert own == max(telling, key=lambda t: impact(t, d), default=-1)


# ---- 2 licences -------------------------------------------------------------------


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def _brute_scan(rows):
    known, n = license.vocabulary(), len(rows)
    all_words = [_words(t) for _, t in rows]
    df = {w: sum(w in ws for ws in map(set, all_words)) for w in known}
    idf = {w: np.log((n + 1) / (df[w] + 0.5)) for w in known}
    out = []
    for (doc, _), ws in zip(rows, all_words, strict=True):
        base, labels, score = [], set(), 0.0
        for label, k, body, at in license.templates():
            for s in range(len(ws) - len(k) + 1):
                if ws[s : s + len(k)] == k:  # each place of a key phrase has the votes of its own rare words
                    labels.add(label)
                    hit = sum(max(idf[w], 1e-6) for i, w in enumerate(body) if 0 <= s - at + i < len(ws) and ws[s - at + i] == w)
                    score = max(score, min(1, hit / sum(max(idf[w], 1e-6) for w in body)))
                    base += [(label, s)] if (label in dict((b, a) for a, b in license.BASE)) else []
        places = [s for _, s in base]
        out.append((doc, len(ws), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({b for b, _ in base})), ",".join(sorted(labels)), round(score, 9)))
    return sorted(out, key=repr)


def test_license_scan(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()] + [(r[0], r[1]) for r in ODD]
    rows += [(100000, "GNU General Public License; gnu-general public\nlicense version 3, MIT License mit license cc by-nc CC BY 4.0 by cc"), (100001, "permission is hereby granted free of charge to any person"), (100002, "the mit" + " license" * 3)]
    rows += [(100003 + i, f"head {i}\n" + t) for i, (_, _, t) in enumerate(license.TEMPLATES)] + [(100100, license.MIT.replace("merge", "MERGED, SO TO SAY")), (100101, "cc by " * 5000)]
    docs = frame(spark, [(d, t, None, None) for d, t in rows])
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in license.label_columns(license.scan(docs)).collect()), key=repr)
    assert got == _brute_scan(rows)
    by_doc = {r[0]: r for r in got}
    for i, (label, _, _) in enumerate(license.TEMPLATES):  # a whole text is found in full
        assert label in by_doc[100003 + i][6].split(",") and by_doc[100003 + i][7] > 0.999
    assert "mit-text" in by_doc[100100][6] and by_doc[100100][7] < 0.9
    assert license.label_columns(license.scan(docs.where("false"))).count() == 0


def test_license_scan_runs_no_python(spark, documents):
    plan = license.label_columns(license.scan(documents))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- 3 quality, 10 language ---------------------------------------------------------


def test_quality(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert right > 0.97 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    some = labels.select("doc_id", "quality", F.lit(None).cast("int").alias("toxic")).unionByName(spark.createDataFrame([(None, 1, 1), (6, None, 1)], "doc_id long, quality int, toxic int"))
    out = quality.classify(odd, some).collect()
    assert len(out) == len(ODD) and len({r.score for r in out if r.doc_id in (6, 7)}) == 1
    none = quality.classify(odd, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(odd.where("false"), labels).count() == 0


def test_quality_score_is_the_sparse_dot_product():
    rng = np.random.default_rng(3)
    w = rng.normal(size=1 << quality.TABLE_BITS)
    texts = [b"A cat sat, a CAT sat sat!!", b"", b"x"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = quality.score_rows(data, offsets, w, 0.25)
    for r, t in enumerate(texts):
        own = quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.isclose(got[r], 0.25 + sum(w[e].mean() if len(e) else 0 for e, _ in own))
    assert got[1] == 0.25


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs, 60).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    trees = language.train(docs, 20)
    out = {r.doc_id: r for r in language.predict(odd, trees, ["doc_id"]).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[11].lang_pred == "und" and out[1].score == 0
    assert out[6].lang_pred == "en" and 0 < out[6].score <= 1
    assert language.train(docs, 20, 1).langs == trees.langs and len(language.train(docs, 20, 1).trees[0].orders[2][2]) < len(trees.trees[0].orders[2][2])
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(odd.where("false")).count() == 0


def test_code_lengths_against_a_plain_model():
    texts = {"a": b"abracadabra abra", "b": b"banana bandana"}
    counts = {}
    for lang, t in texts.items():
        w, c = np.unique(language.windows(np.frombuffer(t, np.uint8), np.array([0, len(t)])), return_counts=True)
        counts[lang] = (w, c)
    trees = language.Trees.build(counts)
    assert sum(len(t.orders[2][2]) for t in trees.trees) == sum(len(w) for w, _ in counts.values())  # every window of the sample, none for other languages

    def plain(train: bytes, text: bytes) -> float:
        tables = collections.defaultdict(collections.Counter)
        pad = b"\0\0\0"
        for i, s in enumerate(train):
            for k in range(4):
                tables[(pad + train)[3 + i - k : 3 + i]][s] += 1
        bits = 0.0
        for i, s in enumerate(text):
            for k in (3, 2, 1, 0, -1):
                if k < 0:
                    bits += 8
                    break
                own = tables.get((pad + text)[3 + i - k : 3 + i])
                if not own:
                    continue
                n, d = sum(own.values()), len(own)
                if own[s]:
                    bits -= np.log2(own[s] / (n + d))
                    break
                bits -= np.log2(d / (n + d))
        return bits

    probe = [b"abra banana", b"zzz", b"b", b""]
    data, offsets = np.frombuffer(b"".join(probe), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in probe])])
    got = trees.code_lengths(data, offsets)
    for r, p in enumerate(probe):
        for j, lang in enumerate(trees.langs):
            assert np.isclose(got[r, j], plain(texts[lang], p)), (p, lang)


# ---- 4 near duplicates --------------------------------------------------------------


def _brute_groups(rows, words, percent):
    sets = []
    for doc, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, (a, _)), (j, (b, _)) in itertools.combinations(enumerate(rows), 2):
        if a is None or b is None or not sets[i] or not sets[j]:
            continue
        k = len(sets[i] & sets[j])
        if a == b or 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), find(d) if d is not None else None) for (d, _), s in zip(rows, sets, strict=True)), key=repr)


def _got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_near_duplicates_odd_rows(spark, odd):
    assert _got(neardup.near_duplicates(odd, 3, 85)) == _brute_groups([(r[0], r[1]) for r in ODD], 3, 85)
    assert neardup.near_duplicates(odd.where("false"), 3, 85).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, number = [], 0
    for base in range(4):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(18):
            own = list(words)
            for k in rng.integers(0, 120, rng.integers(0, 9)):
                own[k] = f"x{rng.integers(0, 9999)}"
            rows.append((number, " ".join(own)))
            number += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words, percent in ((3, 85), (5, 80)):
        assert _got(neardup.near_duplicates(docs, words, percent)) == _brute_groups(rows, words, percent)


def test_bucket_blocks_lose_no_link(spark, monkeypatch):
    """Chains that only the second round joins, in a bucket cut into many blocks."""
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([f"n{j}" for j in range(6 * k)] + words[6 * k :])) for k in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup.in_units, "__defaults__", (3,))
    monkeypatch.setattr(neardup, "PAIRS", 5)
    assert _got(neardup.near_duplicates(docs, 3, 85)) == _brute_groups(rows, 3, 85)


def test_units_let_each_pair_meet_once_and_hold_rows_once_where_a_block_is_enough(spark, monkeypatch):
    """40 rows of the smallest one's component, 9 apart and 4 that are one component."""
    c = {k: 0 if k < 40 else k if k < 49 else 49 for k in range(1, 53)}
    rows = spark.createDataFrame([(5, k, 10, of, 0) for k, of in c.items()], "bucket long, id long, n int, c long, hc long").persist()
    assert neardup.in_units(rows).count() == len(c)
    apart = sorted((a, b) for a, b in itertools.combinations(c, 2) if c[a] != c[b])
    for block, shingles in ((1000, 1 << 20), (3, 1 << 20), (1000, 50)):
        monkeypatch.setattr(neardup.in_units, "__defaults__", (block,))
        monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
        units = {}
        for r in neardup.in_units(rows).collect():
            units.setdefault((r.kind, r.i, r.j), []).append((r.id, r.side))
        met = [tuple(sorted((a, b))) for own in units.values() for (a, x), (b, y) in itertools.combinations(own, 2) if (x != y or x == 2) and c[a] != c[b]]
        assert sorted(met) == apart


def test_versions_of_a_document_join_the_classes_they_are_in(spark):
    a, b, c = ("lorem ipsum dolor sit amet " * 4 + x for x in ("one", "two " * 30, "three " * 30))
    rows = [(9, a), (9, b), (3, a), (5, b), (7, c), (7, c), (8, None), (12, a), (12, c), (20, c)] + [(30 + k, a) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _got(neardup.near_duplicates(docs, 3, 85)) == _brute_groups(rows, 3, 85)
    monkey = neardup.SMALL_IDS
    try:
        neardup.SMALL_IDS = 0  # texts are found by a shuffle
        assert _got(neardup.near_duplicates(docs, 3, 85)) == _brute_groups(rows, 3, 85)
    finally:
        neardup.SMALL_IDS = monkey


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (20, 3), (30, 31), (31, 31)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r.id: r.component for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7, 30: 30, 31: 30} | {100 + i: 100 for i in range(21)}


# ---- 5 mixing -----------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200, 250 / 3, 500 / 3]
    assert mixing.targets([10], [3]) == [15]
    assert np.isclose(sum(mixing.targets([5, 1000, 3, 70], [3, 1, 2, 3])), 1.5 * 1078)


def _brute_tree(quotas, lo, hi, seed):
    """Blocks of every leaf, node by node."""
    if hi - lo == 1:
        return [list(quotas)]
    mid = (lo + hi) // 2
    rng, need, rest, left = np.random.default_rng([seed, lo, hi]), sum(quotas) * (mid - lo) // (hi - lo), sum(quotas), []
    for n in quotas:
        rest -= n
        got = 0 if not (need and n) else int(rng.hypergeometric(n, rest, need)) if rest else need
        left.append(got)
        need -= got
    return _brute_tree(left, lo, mid, seed) + _brute_tree([n - x for n, x in zip(quotas, left, strict=True)], mid, hi, seed)


def test_splitting_tree_is_exact():
    quotas = [1000, 1, 0, 377]
    out = mixing.split_quotas(np.array(quotas), 13, 4)
    assert out.sum(0).tolist() == quotas and set(out.sum(1)) <= {105, 106, 107} and (out >= 0).all()
    assert out.tolist() == _brute_tree(quotas, 0, 13, 4)
    every = [(k, a.tolist(), n.tolist()) for k, a, n in mixing.leaves(np.array(quotas), 13, 4)]
    assert [a for _, a, _ in every] == (np.cumsum(out, 0) - out).tolist()  # no two leaves share a block
    some = [x for lo in range(0, 13, 5) for x in mixing.leaves(np.array(quotas), 13, 4, lo, min(lo + 5, 13))]
    assert [(k, a.tolist(), n.tolist()) for k, a, n in some] == every  # tasks that hold a part of the leaves agree


def test_leaves_draw_what_the_rows_give(spark, documents, monkeypatch):
    """Every draw of every row, recomputed from sizes, hashes and the tree."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 400)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 7)
    monkeypatch.setattr(mixing, "GROUP", 5)
    few = documents.where("doc_id % 3 = 0")
    rows = few.select("doc_id", "source", F.xxhash64(F.lit(0), "doc_id", "source").alias("order"), F.xxhash64("text").alias("tie"), F.size(F.regexp_extract_all("text", F.lit(f"({mixing.WORD})"), F.lit(1))).alias("size")).collect()
    order = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in rows if r.source == s) for s in order]
    goal = [round(t) for t in mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(order))])]
    blocks = [-(-n // 400) for n in sizes]
    own = collections.defaultdict(list)
    for r in rows:
        own[order.index(r.source), r.order % blocks[order.index(r.source)]].append(r)
    want, lists = collections.defaultdict(list), []
    for s in range(len(order)):
        passes, left = divmod(goal[s], sizes[s])
        mine = [(p, b, 1 << 40) for p in range(passes) for b in range(blocks[s])]  # (pass, block, words that may be taken)
        for b in range(blocks[s]):
            if left > 0:
                mine.append((passes, b, left))
            left -= sum(r.size for r in own[s, b])
        lists.append(mine)
    shards = -(-sum(map(len, lists)) // 7)
    for shard, counts in enumerate(_brute_tree(list(map(len, lists)), 0, shards, 0)):
        for s, n in enumerate(counts):
            for p, b, left in lists[s][:n]:
                for r in sorted(own[s, b], key=lambda r: (r.order, r.doc_id, r.tie)):
                    if (take := min(left, r.size)) > 0:
                        want[r.doc_id].append((p, shard, take))
                    left -= take
            lists[s] = lists[s][n:]
    assert shards > 5 and not any(lists)
    for limit in (100_000, 0):  # broadcast, and joined by a shuffle
        monkeypatch.setattr(mixing, "SMALL_DRAWS", limit)
        got = {r.doc_id: sorted((d["pass"], d.shard, d.words) for d in r.draws) for r in mixing.plan(few).collect()}
        assert {d: x for d, x in got.items() if x} == {d: sorted(x) for d, x in want.items()}


def test_mixing(spark, odd, documents):
    for docs in (documents, odd):
        rows = mixing.plan(docs).collect()
        sizes, taken = collections.Counter(), collections.Counter()
        for r in rows:
            assert 0 <= r.taken <= 2 * r.size and r.taken == sum(d.words for d in r.draws)
            sizes[r.source] += r.size
            taken[r.source] += r.taken
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = mixing.targets([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))])
        for s, t in zip(order, want, strict=True):
            assert abs(taken[s] - t) <= 1 and all(r.source_size == sizes[s] and abs(r.target - t) < 1e-6 for r in rows if r.source == s)
        assert sorted(map(repr, mixing.plan(docs.repartition(3)).collect())) == sorted(map(repr, rows))
    words = F.size(F.regexp_extract_all("text", F.lit(f"({mixing.WORD})"), F.lit(1)))
    assert mixing.mixed(documents).agg(F.sum(words)).first()[0] == sum(r.taken for r in mixing.plan(documents).collect())
    assert mixing.plan(odd.where("false")).count() == 0 and mixing.plan(odd.where("doc_id <= 3")).agg(F.sum("taken")).first()[0] == 0


def test_mix_is_written_by_shard_in_its_order(spark, documents, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 40)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 500)
    sorted_in = documents.repartition(2, "source").sortWithinPartitions("source")
    rows = mixing.mixed(sorted_in).select("mix_shard", "mix_order", "doc_id", F.spark_partition_id().alias("at"), F.monotonically_increasing_id().alias("n")).orderBy("n").collect()
    places = collections.defaultdict(set)
    for r in rows:
        places[r.mix_shard].add(r.at)
    assert len(places) > 2 and all(len(p) == 1 for p in places.values())
    keys = [(r["at"], r.mix_shard, r.mix_order) for r in rows]
    assert keys == sorted(keys)
    # The pipeline's stage keeps that order in its files, so neither copies nor sources lie beside each other.
    stage = common.cut(corpus_pipeline.mix_sources(spark, sorted_in, SF), "test-mixed")
    assert stage.columns == documents.columns
    at = stage.select("doc_id", "source").collect()
    beside = list(itertools.pairwise(at))
    assert len(at) == len(rows) and sum(a.doc_id == b.doc_id for a, b in beside) < len(at) / 10
    assert sum(a.source == b.source for a, b in beside) < len(at) / 2
    clash = documents.limit(5).withColumn("mix_shard", F.lit("mine")).withColumn("a.b", F.lit(1)).withColumn("mix_order", F.lit(0))
    assert [r.mix_shard for r in corpus_pipeline.mix_sources(spark, clash, SF).limit(1).collect()] == ["mine"]
    assert mixing.mixed(clash).columns == [*documents.columns, "a.b", "mix_shard", "mix_order"]
    assert corpus_pipeline.drop_near_duplicates(spark, clash, SF).columns == clash.columns


# ---- 6 top-k ------------------------------------------------------------------------


def _floor(x):
    """floor(1024 * x) as a Python integer."""
    return int(fractions.Fraction(x) * 1024 // 1)


def _brute_top(vectors, every=100, k=10):
    fine = [(i, [_floor(x) for x in v]) for i, v in vectors if i is not None and v is not None and None not in v and all(map(math.isfinite, v))]
    out = {}
    for q in sorted({i for i, _ in fine if i % every == 0}):
        own = min((v for i, v in fine if i == q))
        scores = ((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own, v, strict=False)))), i) for i, v in fine if i != q)
        out[q] = [(i, s) for s, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]
    return {q: rows for q, rows in out.items() if rows}


def _got_top(df, **options):
    got = collections.defaultdict(list)
    for r in topk.top_k(df, **options).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def test_top_k(spark):
    rng = np.random.default_rng(7)
    vectors = [(i, rng.normal(size=16).round(1).tolist()) for i in range(0, 900)]
    vectors += [(1000, None), (1100, [float("nan")] * 16), (1200, [None] * 16), (1300, []), (100, vectors[3][1]), (1400, [float("inf")] * 16), (None, [1.0] * 16), (1500, [0.5] * 4), (1600, [0.0] * 16)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, label int")
    as_float = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    assert _got_top(df) == _brute_top(as_float)
    assert topk.top_k(df.where("false")).count() == 0


def test_top_k_takes_vectors_of_any_finite_size(spark):
    small = [(0, [1.0, 1.0]), (100, [70000.0, 0.0]), (1, [70000.0, 1.0]), (2, [2.0, 2.0])]
    rng = np.random.default_rng(11)
    wide = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(-3, 13, 8)).tolist()) for i in range(600)]
    beyond = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 300)).tolist()) for i in range(300)] + [(300, [1.7e308, -1.7e308, 5e-324])]
    for vectors in (small, wide, beyond):
        df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
        assert _got_top(df) == _brute_top(vectors)


def test_top_k_stops_early_and_in_blocks(spark):
    rng = np.random.default_rng(8)
    m = (rng.random((4000, 32)) ** 8 * 900).astype(np.int64)
    index = topk.ImpactIndex.from_bytes(topk.ImpactIndex(np.arange(4000), m / 1024).to_bytes())
    early = 0
    for q in m[:20]:
        ids, scores = index.search(q / 1024, -1)
        best = np.lexsort((np.arange(4000), -(m @ q)))[:10]
        assert ids.tolist() == best.tolist() and scores.tolist() == (m @ q)[best].tolist()
        early += index.processed < len(index.dim) and index.rescored < 2000
    assert early >= 15  # the proof comes before all segments are processed
    tiny = topk.ImpactIndex(np.arange(60), m[:60] / 1024)  # a small shard takes the same path
    tiny.search(m[3] / 1024, -1)
    assert tiny.processed > 0 and tiny.rescored < 60
    df = spark.createDataFrame([(i, (v / 1024).tolist()) for i, v in enumerate(m[:600])], "vec_id long, embedding array<double>")
    path = common.fresh_path(spark, "test-index")
    topk.build_index(df, path, shard_rows=128)
    queries_of = topk.usable(df).where("vec_id % 50 = 0")
    table = spark.read.parquet(path)
    one, many = (sorted(map(tuple, topk.search(table, queries_of, query_bytes=n).collect())) for n in (1 << 20, 600))
    assert one == many and len(one) == 120


# ---- 7 token files ------------------------------------------------------------------


def test_wavelet_matrix():
    rng = np.random.default_rng(9)
    for n, m in ((0, 5), (1, 1), (700, 3), (3000, 49408)):
        v = rng.integers(0, m, n)
        w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(v).to_bytes())
        assert w.decode().tolist() == v.tolist() and w.count(m + 70000) == 0
        for i in rng.integers(0, n, 15).tolist() if n else []:
            k = int((v[:i] == v[i]).sum())
            assert w.access(i) == v[i] and w.rank(int(v[i]), i) == k and w.select(int(v[i]), k) == i
        with pytest.raises(IndexError):
            w.access(n)


def test_token_files(spark, odd):
    tokenizer = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    rows = sorted(((r[0], r[1] or "") for r in ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start, want = 0, []
    for doc, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    path = common.fresh_path(spark, "test-tokens")
    wavelet.write_tokens(odd, path, public_path("word_bpe_49k.json"), shard_tokens=64)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in wavelet.read_tokens(spark, path).orderBy("start").collect()]
    assert got == want
    assert wavelet.tokens_round_trip(odd.where("false"), public_path("word_bpe_49k.json")).count() == 0


# ---- 8 WARC -------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "<p>" + "é日" * 60
    rows = [(3, "u", big), (1, None, big), (2, "http://x/\r\nEvil: y", big), (2, "v", big), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (None, "u", big), (7, "u", "\x1f\x08 gzip magic\r\n\r\nWARC/1.1\r\n" * 9)]
    pages = spark.createDataFrame([(*r, 0, "x") for r in rows], "page_id long, url string, html string, first long, digest string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_round_trip(pages).collect()), key=repr)
    n = len(big.encode())
    want = [(3, n, "revisit", 1), (1, n, "response", None), (2, n, "revisit", 1), (2, n, "revisit", 1), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None), (None, n, "revisit", 1), (7, len(rows[-1][2]), "response", None)]
    assert got == sorted(want, key=repr)
    assert warc.warc_round_trip(pages.where("false")).count() == 0


def test_warc_splits_own_each_record_once(tmp_path):
    rng = np.random.default_rng(10)
    data, places = b"", []
    for k in range(60):
        noise = rng.integers(0, 256, int(rng.integers(0, 3000)), dtype=np.uint8).tobytes() + warc.MAGIC * 3
        places.append(len(data))
        data += warc.member(warc.record(k, "u", noise, "d", "response", None), level=0)  # stored: magic bytes stay in sight
    (tmp_path / "a.warc.gz").write_bytes(data)
    for step in (1 << 20, 4096, 997):
        found = []
        with open(tmp_path / "a.warc.gz", "rb") as f:
            for lo in range(0, len(data), step):
                found += [p for p, _ in warc.records(f, lo, min(lo + step, len(data)), len(data))]
        assert found == places


# ---- 9 media ------------------------------------------------------------------------


def test_telephony_tables():
    assert media.MULAW[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert media.ALAW[[0x00, 0x55, 0x80, 0xD5]].tolist() == [-5504, -8, 5504, 8]
    assert len(set(media.ALAW.tolist())) == 256 and len(set(media.MULAW.tolist())) == 255


def test_adpcm_against_a_plain_decoder():
    t = np.arange(4000)
    pcm = (9000 * np.sin(t / 7) + 3000 * np.sin(t / 31)).astype(np.int16)
    data = media.encode_ima(pcm, 256)
    out = media.decode_ima(data, 256)
    plain = []
    for b in range(0, len(data), 256):
        value, index = int(np.frombuffer(data[b : b + 2].tobytes(), "<i2")[0]), int(data[b + 2])
        plain.append(value)
        for byte in data[b + 4 : b + 256].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(media.IMA_STEPS[index])
                change = (step >> 3) + (step >> 2 if code & 1 else 0) + (step >> 1 if code & 2 else 0) + (step if code & 4 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(media.IMA_MOVES[code & 7])))
                plain.append(value)
    assert out.tolist() == plain and np.abs(out[: len(pcm)].astype(int) - pcm)[40:].max() < 900


def test_resampling_keeps_a_tone():
    t = np.arange(1600)
    tone = (8000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int16)
    up = media.resample(tone, 8000, 16000)
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(3200) / 16000)
    assert len(up) == 3200 and np.abs(up - want)[50:-50].max() < 60
    assert len(media.resample(tone, 8000, 11025)) == -(-1600 * 441 // 320)


def test_media_round_trip(spark, odd):
    import hashlib

    got = media.media_round_trip(odd).collect()
    for r, (_, text) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(((r[0], r[1]) for r in ODD), key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        file = media.coded(payload)
        assert r.media_bytes == len(file) and r.media_sha256 == hashlib.sha256(file).hexdigest() and bytes(media.unwave(file)[3]) == payload
        kind, rate, block, samples = media.unwave(file)
        pcm = media.resample(*media.expand(file), media.TARGET_RATE)
        assert r.feature == f"coding={dict((n, c) for c, n in media.FORMATS.items())[kind]};" + media.features(pcm, media.TARGET_RATE)
    assert len({r.feature for r in got if r.doc_id in (6, 7)}) == 1
    many = frame(spark, [(i, f"{i} " * (i % 700), None, None) for i in range(200)])
    codings = collections.Counter(r.feature.split(";")[0] for r in media.media_round_trip(many).collect())
    assert set(codings) == {"coding=mulaw", "coding=alaw", "coding=ima"}
    long = frame(spark, [(1, "long text " * 1_500_000, None, None)])
    assert media.media_round_trip(long).first().n_bytes == 15_000_000
    files = spark.createDataFrame([(1, bytearray(media.wave(bytes(media.encode_ima(np.zeros(500, np.int16), 64)), "ima", block=64))), (2, bytearray(b"broken")), (3, None), (4, bytearray(media.wave(b"\xd5" * 10, "alaw")))], "k int, media binary")
    for own in (files, files.withColumn("pcm", F.lit("mine"))):
        pcm = {r.k: r.pcm for r in media.decode_media(own, target=16000).collect()}
        assert pcm[2] is None and pcm[3] is None and len(pcm[4]) == 40 and len(pcm[1]) > 2000
    assert media.media_round_trip(odd.where("false")).count() == 0


# ---- queries and pipeline --------------------------------------------------------------


def test_sql_agrees(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SF)
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(repr, (tuple(r) for r in got.select(want.columns).collect()))) == sorted(map(repr, want.fetchall())), name


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars between 300 and 3000 and not text rlike '[*#$%&|!]{2}'").limit(20).collect()]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[4], "en", "s0", 1), (101, texts[5] + " tail", "en", "s1", 1), (102, "12 34 ...", "en", "s1", 1), (103, None, None, None, None)]
    rows += [(200 + i, "Junk%%% and&&& more$$$ " * 40 + str(i), "en", "s2", 1) for i in range(6)]
    clashing = [F.lit(7).alias(c) for c in ("score", "row", "size", "label", "id", "draw")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *clashing)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(200 + i, 0, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at, kept = docs, {}
    for name, stage in p.STAGES[:4]:
        at = common.cut(stage(spark, at, str(tmp_path)), "test-stage")
        assert at.columns == docs.columns
        kept[name] = {r.doc_id for r in at.select("doc_id").collect()}
    assert kept["language"] == {r[0] for r in rows} - {102, 103}
    assert kept["quality"] == kept["language"] - {200 + i for i in range(6)}
    assert kept["near_duplicates"] == kept["quality"] - {100, 101} and kept["mixing"] <= kept["near_duplicates"]
    pieces = p.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    assert sum(r.length for r in pieces) == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in at.collect())


def test_unicode_letters_decide_und(spark):
    trees = language.Trees.build({"en": (np.array([97], np.uint32), np.array([3.0]))})
    probes = ["ª", "1 2", "日", "ʰ", "́", "ⅷ"]
    got = language.predict(spark.createDataFrame([(i, t) for i, t in enumerate(probes)], "doc_id int, text string"), trees, ["doc_id"]).collect()
    assert [r.lang_pred != "und" for r in got] == [any(unicodedata.category(c)[0] == "L" for c in t) for t in probes]
