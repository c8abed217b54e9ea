"""Conversation repair, url filters and source divergence against plain Python and SQL;
windows, samples and training against plain versions."""

from __future__ import annotations

import collections
import hashlib
import heapq
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common, conversations, divergence, language, media, packing, quality, queries, urls, warc

SF = "/root/testdata/sf0.001"


# ---- 1 packing: the choice of windows ---------------------------------------------


def _plain_windows(docs: list[list[int]], window: int) -> list[set[int]]:
    """Documents of each window, by plain BM25 over the documents without their end ids."""
    bodies = [d[:-1] for d in docs]
    df = collections.Counter(t for b in bodies for t in set(b))
    mean = sum(map(len, bodies)) / len(bodies)

    def score(seed: int, other: int) -> float:
        tf = collections.Counter(bodies[other])
        return sum(math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(bodies[other]) / mean)) for t in set(bodies[seed]) if tf[t])

    unused, windows, fill = set(range(len(docs))), [set()], 0
    seed = None
    while unused:
        ranked = sorted((-round(score(seed, d), 9), d) for d in unused if score(seed, d) > 0) if seed is not None else []
        opens = not ranked
        doc = ranked[0][1] if ranked else min(unused)
        unused.discard(doc)
        left = len(docs[doc])
        while left:
            take = min(left, window - fill)
            windows[-1].add(doc)
            left, fill = left - take, fill + take
            if fill == window:
                windows.append(set())
                fill, opens = 0, True
        seed = doc if fill and opens else seed if fill else None
    return [w for w in windows if w]


def _windows_of(docs, window, **more):
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    pieces = packing.pack_windows(np.concatenate([np.array(d, np.int64) for d in docs]), at, window, ended=True, **more)
    out = collections.defaultdict(set)
    for doc, _, _, number, _ in pieces:
        out[number].add(doc)
    return pieces, [out[n] for n in sorted(out)]


@pytest.mark.parametrize("seed", range(6))
def test_windows_are_those_of_plain_bm25_without_end_ids(seed):
    rng = np.random.default_rng(seed)
    docs = [[*(100 * int(rng.integers(4)) + rng.integers(2, 30, int(rng.integers(1, 40)))).tolist(), 1] for _ in range(60)]
    docs += [docs[3], docs[3], docs[7]]
    pieces, got = _windows_of(docs, 256)
    want = _plain_windows(docs, 256)
    assert got[: len(want) - 1] == want[:-1]  # the last window is dealt out to powers of two
    ids = collections.Counter()
    for doc, start, length, _, _ in pieces:
        ids.update((doc, k) for k in range(start, start + length))
    assert set(ids.values()) == {1} and len(ids) == sum(map(len, docs))


def test_a_second_seed_inside_a_window_brings_its_own_neighbours():
    docs = [[1000 * (n % 40) + 2 + k for k in range(16)] + [1] for n in range(120)]  # 40 topics, no common word, three documents each
    _, got = _windows_of([[*d[: 12 + n // 40], 1] for n, d in enumerate(docs)], 128)
    for w in got[:-1]:
        topics = collections.Counter(d % 40 for d in w)
        assert sum(n < 3 for n in topics.values()) <= 2  # only topics that the window's ends cut
    assert len([w for w in got if len({d % 40 for d in w}) >= 3]) > 5


def test_no_window_holds_a_document_twice_without_repeats():
    rng = np.random.default_rng(1)
    docs = [[*rng.integers(2, 50, int(rng.integers(1, 300))).tolist(), 1] for _ in range(50)]
    docs = [*docs, *docs, *docs[:5] * 3]
    pieces, _ = _windows_of(docs, 256, repeats=False)
    inside = collections.Counter((n, tuple(docs[d])) for d, n in {(d, n) for d, _, _, n, _ in pieces})
    assert max(inside.values()) == 1
    fills = collections.Counter()
    for _, _, length, number, _ in pieces:
        fills[number] += length
    assert all(not f & (f - 1) for f in fills.values())
    assert sum(fills.values()) == sum(map(len, docs))


def test_packing_of_repeated_documents_within_partitions(spark):
    rows = [(n, f"word{n % 7} " * (5 + n % 11)) for n in range(80)]
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string").coalesce(1)
    out = packing.pack(docs, queries.public_path("byte_bpe_50k.json"), window=128, gather=False, repeats=False).collect()
    got = collections.Counter((r.sequence_id, r.doc_id) for r in out if r.start == 0)
    assert max(got.values()) == 1 and sum(r.length for r in out) == sum(r.doc_tokens for r in out if r.start == 0)


# ---- 10 language, 3 quality: samples and training ------------------------------------


@pytest.mark.parametrize("doc_id", [3, 4, 8, 11])
def test_a_language_under_one_id_is_learned(spark, doc_id):
    known = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    one = spark.range(5000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.concat(F.lit("xyzzy qux "), F.col("id").cast("string")).alias("text"), F.lit("xx").alias("lang"))
    copies = spark.range(3000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit("plugh plugh").alias("text"), F.lit("yy").alias("lang"))
    trees = language.train(known.unionByName(one).unionByName(copies))
    assert {"xx", "yy", "en", "de", "fr", "es"} == set(trees.langs)


def test_quality_learns_from_one_id_with_many_rows(spark):
    rows = [(5, f"good text number {n}", 1) for n in range(300)] + [(5, f"!!! $$$ {n} !!!", 0) for n in range(300)] + [(6, "good text", 1)] * 500
    weights, bias = quality.train(spark.createDataFrame(rows, "doc_id long, text string, label int"), sample_docs=200)
    assert np.any(weights)
    weights, bias = quality.train(spark.createDataFrame(rows, "doc_id long, text string, label int"), sample_entries=1)
    assert np.any(weights)


def test_ftrl_updates_are_those_of_the_plain_rule():
    rng = np.random.default_rng(2)
    model, z, n = quality.Ftrl(20), [0.0] * 20, [0.0] * 20
    alpha, beta, l1, l2 = quality.ALPHA, quality.BETA, quality.L1, quality.L2
    for _ in range(200):
        at = rng.choice(20, 5, replace=False)
        x, y = rng.random(5), float(rng.integers(2))
        model.update(at, x, y)
        w = {}
        for i in at.tolist():
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at.tolist(), x.tolist(), strict=True))))
        for i, v in zip(at.tolist(), x.tolist(), strict=True):
            g = (p - y) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


# ---- 8 WARC: large records, false members, equal pages ----------------------------------------


def test_a_record_of_64_mb_and_false_members_inside_of_records(tmp_path):
    rng = np.random.default_rng(8)
    false = [warc.member(warc.VERSION + b"no more\r\n\r\n", level=0), warc.member(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: x\r\n\r\n", level=0), warc.member(b"plain"), warc.MAGIC, warc.member(warc.VERSION, level=0)]
    payloads = [rng.integers(0, 256, 64 << 20, dtype=np.uint8).tobytes(), b"".join(false) * 3, b"x" * 5000 + false[0], b""]
    data, starts = b"", []
    for k, payload in enumerate(payloads):
        starts.append(len(data))
        data += warc.member(warc.record(k, "u" * (20_000 if k == 2 else 1), payload, "d", "response", None), level=0)
    (tmp_path / "a.warc.gz").write_bytes(data)
    for step in (len(data), 7 << 20, (64 << 20) + 1000):
        found = []
        with open(tmp_path / "a.warc.gz", "rb") as f:
            for lo in range(0, len(data), step):
                found += [(p, hashlib.sha256(r["block"].partition(b"\r\n\r\n")[2]).hexdigest()) for p, r in warc.records(f, lo, min(lo + step, len(data)), len(data))]
        assert found == list(zip(starts, [hashlib.sha256(p).hexdigest() for p in payloads], strict=True))


def test_equal_pages_are_marked_whatever_their_ids(spark):
    page, other = "p" * 200, "q" * 200
    rows = [(5, page), (3, page), (None, page), (3, page), (9, page), (1, "p" * 99), (2, "p" * 99), (None, other), (None, other), (7, None), (8, None)]
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.marked(spark.createDataFrame([(i, "u", h, "x") for i, h in rows], "page_id long, url string, html string, digest string")).collect()), key=repr)
    want = [(i, "revisit", 3) if h == page and i != 3 else (i, "response", None) for i, h in rows]
    assert got == sorted(want, key=repr)


# ---- 9 media: every payload is resampled, PCM is packed without loss --------------------------


def _plain_resampled(pcm, up, down):
    """Each output as one sum over the inputs in reach, without phases."""
    cutoff = min(1.0, up / down)
    reach = math.ceil(media.REACH / cutoff)
    out = []
    for k in range(-(-len(pcm) * up // down)):
        at = k * down / up
        first = k * down // up
        taps = [n - at for n in range(first - reach, first + reach + 1)]
        kernel = [cutoff * float(np.sinc(cutoff * t)) * math.cos(math.pi * t / (2 * reach + 2)) ** 2 for t in taps]
        total = sum(kernel)
        out.append(sum(w / total * (pcm[n] if 0 <= n < len(pcm) else 0) for w, n in zip(kernel, range(first - reach, first + reach + 1), strict=True)))
    return np.clip(np.rint(out), -32768, 32767)


@pytest.mark.parametrize(("rate", "target"), [(8000, 16000), (8000, 11025), (16000, 8000), (11025, 8000)])
def test_resampling_is_that_of_a_plain_sum(rate, target):
    pcm = np.random.default_rng(3).integers(-20000, 20000, 150).astype(np.int16)
    up, down = target // math.gcd(rate, target), rate // math.gcd(rate, target)
    got, want = media.resample(pcm, rate, target), _plain_resampled(pcm.tolist(), up, down)
    assert len(got) == len(want) and np.abs(got - want).max() <= 1  # sums of 32 bits round apart now and then


def test_pcm_is_packed_without_loss():
    rng = np.random.default_rng(4)
    cases = [np.zeros(0), np.zeros(1), np.array([5, -7]), rng.integers(-32768, 32768, 3001), rng.integers(-3, 4, 999), np.array([-32768, 32767] * 700), np.full(600_001, 12)]
    cases += [media.resample(media.MULAW[rng.integers(0, 256, n)], 8000, 16000) for n in (1, 2, 511, 4000)]
    for pcm in cases:
        packed = media.pack_pcm(pcm.astype(np.int16))
        assert media.unpack_pcm(packed).tolist() == pcm.astype(np.int16).tolist()
    speech = media.resample(media.ALAW[rng.integers(0, 256, 4000)], 8000, 16000)
    assert len(media.pack_pcm(speech)) < 4000 + 600 + 40  # what was interpolated takes no bits
    for n in (0, 1, 255, 256, 257, 70_000):
        values = rng.integers(0, 1 << int(rng.integers(1, 32)), n).astype(np.uint32)
        data = media.pack_numbers(values)
        got, took = media.unpack_numbers(memoryview(data), n)
        assert got.tolist() == values.tolist() and took == len(data)


def test_every_payload_is_resampled():
    assert {rate for _, _, rate, _ in media.CODINGS} == {media.RATE} and media.RATE != media.TARGET_RATE


def test_stored_pcm_holds_every_resampled_sample(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "fresh_path", lambda _, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(media, "fresh_path", common.fresh_path)
    texts = {i: f"{i} sampled words " * (i % 40 * 7) for i in range(400)}
    got = media.media_round_trip(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    stored = {r.doc_id: bytes(r.pcm) for r in spark.read.parquet(f"{tmp_path}/media-pcm").collect()}
    assert max(pq.ParquetFile(f).metadata.row_group(0).num_rows for f in tmp_path.glob("media-pcm/*.parquet")) == media.PCM_ROWS
    assert len(got) == len(stored) == 400 and {r.feature[7:10] for r in got} == {"mul", "ala", "ima"}
    for doc, text in texts.items():
        pcm, rate = media.expand(media.coded(media.payload_of(text.encode())))
        assert stored[doc] == media.resample(pcm, rate, media.TARGET_RATE).astype("<i2").tobytes() and len(stored[doc]) == 4 * len(pcm)


def test_pcm_in_waves_gives_the_same_rows_and_one_wave_is_on_disk_at_a_time(spark, tmp_path, monkeypatch):
    numbers, waves, plain = itertools.count(), [], media.described
    monkeypatch.setattr(media, "fresh_path", lambda _, name: f"{tmp_path}/{name}-{next(numbers)}")

    def seen(speech, *rest):
        assert len(list(tmp_path.glob("media-pcm-*"))) == 1
        waves.append(sorted((r.doc_id or 0, bytes(r.pcm)) for r in speech.collect()))
        return plain(speech, *rest)

    docs = [(None if i % 97 == 0 else i // 2, None if i % 89 == 0 else f"{i // 4} sampled words " * (i % 40 * 7)) for i in range(800)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(media, "described", seen)
    got = queries.op9_media(spark, str(tmp_path)).collect()
    held = [sum(len(pcm) for _, pcm in wave) for wave in waves]
    assert len(waves) == media.WAVES and max(held) < sum(held) / 5 and not list(tmp_path.glob("media-pcm-*"))
    kept = media.media_round_trip(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert sorted(itertools.chain(*waves[:-1])) == waves[-1] and len(got) == len(waves[-1]) == 800  # every sample was stored and read back
    assert sorted(map(str, got)) == sorted(map(str, kept))


# ---- 11 conversations ------------------------------------------------------------------


def _damaged(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        own = out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def _plain_repair(own):
    """Uniform-cost search over (rows read, roles said): no grammar items, only prefixes of the pattern."""
    own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][: conversations.HEAD].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in own:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in own if t is not None]
    initials = [r[:1] for _, r, _ in own]
    agenda, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, said, lines = heapq.heappop(agenda)
        if i == len(own) and re.fullmatch("(s?(ua)+)?", said):
            break
        if (i, said[-1:]) in done:
            continue
        done.add((i, said[-1:]))
        steps = [(3, "I", i, n, (n, "")) for n in ("user", "assistant")]
        if i < len(own):
            _, role, text = own[i]
            steps.append((4, "D", i + 1, None, None))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                steps += [(3 + more, "R", i + 1, n, (n, text)) for n in ("user", "assistant")] + [(more, "K", i + 1, role, (role, text))]
        for more, edit, j, role, line in steps:
            roles = said + (role[:1] or "~") if line else said
            if re.fullmatch("(s?(ua)*u?)?", roles):
                heapq.heappush(agenda, (cost + more, audit + edit, j, roles, lines + (line,) if line else lines))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, digest)


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _repaired(spark, rows, parts=3):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copies int, digest string").repartition(parts)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in conversations.repair(conversations.damage(table)).collect()}


def _odd_conversations():
    rng = np.random.default_rng(5)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "s", "u"], ["Yes.", "No", "", "  ", "Why?\n", None, "Yes.", "a" * 40 + ".", "a" * 40 + "!", "é…", "x\x0b"]
    return [(None if conv == 40 else conv, None if rng.random() < 0.1 else int(rng.integers(0, 9)), roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]) for conv in range(41) for _ in range(rng.integers(1, 9))]


def test_conversations_are_repaired_as_by_plain_search(spark):
    rows = _odd_conversations()
    rows += [(100, t, "user" if t % 2 else "assistant", f"text {t}.") for t in range(12)] + [(101, t, "user", "same.") for t in range(7)]
    assert _repaired(spark, rows) == {conv: _plain_repair(own) for conv, own in _damaged(rows).items()}


def test_conversations_cut_into_pieces_are_repaired_the_same(spark, monkeypatch):
    rows = [(7, t, ("system", "user", "assistant", "tool")[(t * t + t // 3) % 4], f"text {t % 17}" + "." * (t % 3 > 0)) for t in range(60)] + [(8, 1, "user", "again.")] * 9 + _odd_conversations()
    want = _repaired(spark, rows)
    monkeypatch.setattr(conversations, "PIECE", 3)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert _repaired(spark, rows, 5) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert want[7] == _plain_repair(_damaged(rows)[7])


def test_conversations_of_the_supplied_table_and_of_none(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_conversation_repair(spark, SF).collect()}
    assert got == {conv: _plain_repair(own) for conv, own in _damaged(rows).items()}
    assert conversations.repair(conversations.damage(table.limit(0))).count() == 0


def test_a_conversation_that_loses_all_its_rows_stays(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert _repaired(spark, [(conv, 0, "user", "x.")]) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# ---- 12 urls ------------------------------------------------------------------------------


def _plain_rule(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, None
    rest = url[at + 3 :]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = (None, None)
    for verdict, rule in urls.RULES:
        own, below = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + below) and len(rule) > len(best[1] or ""):
            best = (verdict, rule)
    return host, path, best[1], best[0]


ODD_URLS = ["http://A.NET/x", "https://a.net", "https://a.net?q=/", "net/", None, "", "x://", "://net/", "http://Éx.ORG/fr/1", "http://x.example.com/de/1?u=http://y.net/", "http://x.example.com/de", "http://example.net/en/", "http://notexample.net/en/1", "http://planet/", "http://u@h.com:80/a//b/", "http://h/1/2/3/4/5/6/7/8/9/10", "http://h/" + "a" * 5000, "http://net/\n://x"]


def test_urls_are_cut_and_ruled_as_in_plain_python(spark):
    rows = [(n, u, "x", 1) for n, u in enumerate([*ODD_URLS, *ODD_URLS])]
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string, n int")).collect()}
    assert got == {n: _plain_rule(u)[:3] for n, u, _, _ in rows}


def test_rules_of_the_supplied_pages_decide(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = queries.op12_url_filter(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = _plain_rule(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_of_labelled_pages_reject_the_unlabelled(spark):
    rows = [(n, f"http://shop.x/item-{n}/view", True) for n in range(40)] + [(100 + n, f"http://shop.x/offer-{n}/buy", None) for n in range(5)]
    rows += [(200 + n, f"http://shop.x/{w}/post", True if n % 9 else None) for n, w in enumerate("".join(chr(97 + n // 26**k % 26) for k in range(3)) for n in range(200))]
    rows += [(500 + n, f"http://blog.x/{n}/", False if n % 3 else None) for n in range(60)] + [(600 + n, f"http://new.x/{n}", None) for n in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r.page_id: r for r in urls.judge(pages, (), F.col("bad")).collect()}
    assert all(got[n].verdict == "block" for n in range(40)) and all(got[200 + n].verdict == "block" for n in range(200))
    assert {got[200 + n].template for n in range(200)} == {"/*/post"}  # words of one level, each rare: a wildcard
    assert all(got[100 + n].verdict == "allow" for n in range(5)), got[100]  # without labels, so not merged with its neighbour
    assert all(got[n].verdict == "allow" for n in range(500, 560)) and all(got[n].verdict == "allow" for n in range(600, 660))


def test_similar_branches_merge_and_labels_keep_others_apart():
    child = lambda seg, n, kinds, blocked=0, allowed=0: {"seg": seg, "n": n, "kinds": kinds, "blocked": blocked, "allowed": allowed}
    names = dict(urls.merged([child("en", 900, [0, 600, 300, 0, 0]), child("fr", 100, [0, 65, 35, 0, 0]), child("de", 100, [0, 65, 35, 0, 0], 100), child("tag", 500, [500, 0, 0, 0, 0])]))
    assert names == {"en": "{en|fr}", "fr": "{en|fr}", "de": "de", "tag": "tag"}


# ---- 13 divergence --------------------------------------------------------------------------


def _divergence(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, p int")
    return sorted(tuple(r) for r in divergence.audit(docs, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def _plain_divergence(rows, least, top=50):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    df, counts, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        df.update((lang, t) for t in set(terms(text)))
        counts.update((lang, source, t) for t in terms(text))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (own, t), n in df.items() if own == lang and n >= least]
        sources = [s for own, s in groups if own == lang]

        def shares(count):
            total = sum(count(t) for t in kept)
            return {t: 1 + 10**9 * (count(t) + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(lambda t, s=s: counts[lang, s, t]) for s in sources}
        q = shares(lambda t: sum(counts[lang, s, t] for s in sources))
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            more = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s, t] and p[s][t] > q[t])
            out += [(lang, s, "pair", o, -v, n) for n, (v, _, o) in enumerate(pairs, 1)]
            out += [(lang, s, "term", t, -v, n) for n, (v, _, t) in enumerate(more[:top], 1)]
    return sorted(out)


def _odd_sources():
    rng = np.random.default_rng(9)
    words = ["a", "B", "the", "THE", "été", "Été", "x1y", "o'neil", "日本", "　", "\u00a0z", "ab", "abc", "b", "bc"]
    rows = [(n, " ".join(rng.choice(words, rng.integers(0, 20))) + "\n", ["en", "de", None, "qq"][n % 4], [f"s{k}" for k in range(9)][rng.integers(9)] if n % 7 else None) for n in range(400)]
    return [*rows, (None, None, "en", "s0"), (1, "the the", "en", "only"), (2, "", "lone", "one"), (3, "the", "fr", "a"), (3, "the", "fr", "b"), (4, "the " * 200_000, "en", "s1")]


def test_divergence_is_that_of_plain_counts(spark, monkeypatch):
    rows = _odd_sources()
    want = _plain_divergence(rows, 5, 4)
    assert _divergence(spark, rows, least_docs=5, top_terms=4) == want
    monkeypatch.setattr(divergence, "HELD", 3)  # sums leave their tasks at once
    monkeypatch.setattr(divergence, "SEARCHED", 16)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 4)
    assert _divergence(spark, rows, least_docs=5, top_terms=4, book_bytes=40, tile=2) == want


def test_divergence_of_the_supplied_table_is_that_of_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({queries.oracle_sql()['op13_source_divergence']})").fetchall()
    got = queries.op13_source_divergence(spark, sf).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 1000
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


# ---- pipeline ----------------------------------------------------------------------------------


def test_pipeline_windows_hold_no_document_twice(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).select("sequence_id", "doc_id", "start", "length", "doc_tokens").collect()
    begun = collections.Counter((r.sequence_id, r.doc_id) for r in rows if r.start == 0)
    taken = collections.Counter(r.doc_id for r in rows if r.start == 0)
    assert rows and max(begun.values()) == 1 and max(taken.values()) == 2
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_pipeline_of_an_empty_table_gives_no_row(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
