"""Kept postings: search over segments equals a plain search over the texts as they are."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import lexical, postings
from sparkloom.operators.segments import Conflict, Segments
from sparkloom.plans import kept


def plain(texts: dict[int, list[str]], phrases: list[list[str]], k: int, digits: int = 6) -> list[tuple[int, float]]:
    """Texts: for each key its rows' texts."""
    docs = [(key, re.findall(r"\w+", t.lower())) for key, own in texts.items() for t in own]
    mean = sum(len(w) for _, w in docs) / len(docs)
    found = {}
    for phrase in {tuple(p) for p in phrases}:
        tf = [(n, sum(w[i : i + len(phrase)] == list(phrase) for i in range(len(w) - len(phrase) + 1))) for n, (_, w) in enumerate(docs)]
        tf = [(n, c) for n, c in tf if c]
        weight = max(math.log((len(docs) - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6)
        for n, c in tf:
            found[n] = found.get(n, 0.0) + weight * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(docs[n][1]) / mean))
    return sorted(((docs[n][0], round(s, digits)) for n, s in found.items()), key=lambda x: (-x[1], x[0]))[:k]


WORDS = ["of", "the", "thing", "thon", "run", "a", "zeta", "é"]


def _texts(rng, n):
    return [" ".join(rng.choice(WORDS, rng.integers(0, 30), p=[0.2, 0.3, 0.1, 0.05, 0.1, 0.2, 0.01, 0.04])) for _ in range(n)]


def _write(spark, path, name, rows):
    """One file of the table, in place of the one of that name."""
    import os
    import shutil

    aside = f"{path}-aside"
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(aside)
    os.makedirs(path, exist_ok=True)
    made = next(f for f in os.listdir(aside) if f.endswith(".parquet"))
    shutil.move(f"{aside}/{made}", f"{path}/{name}.parquet")


QUERIES = [[["thing"], ["thon"]], [["of", "the"]], [["zeta"]], [["the"], ["of", "the"]], [["the", "the"]], [["nowhere"]], [["thing"], ["nowhere"]], [["of", "the", "thing"]]]


def _same(search, texts, queries=QUERIES):
    for phrases in queries:
        got = [(r.key, r.score) for r in search.top(phrases, 10).collect()]
        want = plain(texts, phrases, 10)
        assert [k for k, _ in got] == [k for k, _ in want], phrases
        assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6), phrases


def test_search_follows_files_that_come_change_and_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SPAN_BITS", 3)
    monkeypatch.setattr(postings, "SPAN", 8)
    rng, path = np.random.default_rng(3), str(tmp_path / "documents")
    files = {f"f{n}": [(100 * n + i, t) for i, t in enumerate(_texts(rng, 40))] for n in range(3)}
    files["f0"] += [(1, None), (1, ""), (5, "of the thing " * 50)]
    for name, rows in files.items():
        _write(spark, path, name, rows)

    def texts():
        out = {}
        for rows in files.values():
            for key, t in rows:
                out.setdefault(key, []).append(t or "")
        return out

    search = kept.text_postings(spark, path)
    _same(search, texts(), QUERIES[:4])
    before = [s["seg"] for s in search.store.manifest["segments"]]
    for step in range(4):
        name = f"f{step % 3}"
        if step == 2:
            (tmp_path / "documents" / f"{name}.parquet").unlink()
            files[name] = []
        else:
            files[name] = [(1000 * (step + 1) + i, t) for i, t in enumerate(_texts(rng, 5 + step))]
            _write(spark, path, name, files[name])
        search = kept.text_postings(spark, path)
        _same(search, texts(), QUERIES[:1] if step < 3 else QUERIES)
        if step == 0:  # one segment more, with the changed file's documents alone
            last = search.store.manifest["segments"][-1]
            assert len(search.store.manifest["segments"]) == len(before) + 1 and last["rows"]["docs"] == 5 and last["rows"]["dead"] == 43
    assert kept.text_postings(spark, path).store.manifest["version"] == search.store.manifest["version"]  # nothing changed


@pytest.mark.parametrize("whole", [False, True])
def test_merged_segments_give_the_same(spark, tmp_path, monkeypatch, whole):
    from sparkloom.operators import segments

    monkeypatch.setattr(segments, "MOST", 2)
    monkeypatch.setattr(segments, "SHARE", -1e9 if whole else 1e9)
    rng, path = np.random.default_rng(4), str(tmp_path / "documents")
    files, counts = {}, []
    for step in range(4):
        name = f"f{step % 2}"
        files[name] = [(100 * step + i, t) for i, t in enumerate(_texts(rng, 20))]
        _write(spark, path, name, files[name])
        search = kept.text_postings(spark, path)
        counts.append(len(search.store.manifest["segments"]))
        if step == 3:
            _same(search, {k: [t] for rows in files.values() for k, t in rows}, QUERIES[:2])
    assert max(counts) <= 2 + (not whole)


def test_blocks_that_cannot_reach_the_kth_score_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SPAN_BITS", 4)
    monkeypatch.setattr(postings, "SPAN", 16)
    path = str(tmp_path / "documents")
    rows = [(n, "rare " * (20 if n // 16 in (5, 40) else 1) + "filler " * (5 if n // 16 in (5, 40) else 300)) for n in range(1600) if n % 3 or n // 16 in (5, 40)]
    spark.createDataFrame([(n, "other words") for n in range(2000, 6000)] + rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    search = kept.text_postings(spark, path)
    _, spans = search.promising(["rare"], 10)
    every = search.bounds(search.weights(["rare"])).count()
    assert every > 60 and spans.count() <= 4
    want = [(r.key, r.score) for r in lexical.top(search.keyed(search.scores([["rare"]])), "key", 10).collect()]
    assert [(r.key, r.score) for r in search.top([["rare"]], 10).collect()] == want


def test_blocks_are_made_of_parts_of_bounded_size(spark):
    """3000 documents of 400 words: a task never makes the blocks of a whole batch of them at once."""
    rows = spark.range(3000).select("id", F.array(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda k: F.when(k % 2 == 0, "a").otherwise(F.concat(F.lit("b"), (F.col("id") % 7).cast("string"))))).alias("fields")).coalesce(1)
    made = postings.blocks(postings.documents(rows, "id", F.lit("f"), F.col("fields"))).where("term = 'a'").collect()
    assert sum(r.n for r in made) == 3000 and all(list(r.tfs) == [200] * r.n and list(r.dls) == [400] * r.n for r in made)
    assert len({(r.span, o) for r in made for o in r.offsets}) == 3000 and all(r.n * 400 <= postings.PART_WORDS for r in made)
    assert list(postings._parts(np.array([0, 5, postings.PART_WORDS + 1, 0, 7]))) == [(0, 2), (2, 3), (3, 5)] and not list(postings._parts(np.zeros(0, int)))


def test_fields_are_not_joined_by_phrases_and_keys_tie(spark, tmp_path):
    store = Segments(spark, f"file://{tmp_path}/s", postings.schemas(), postings.UNITS)
    rows = spark.createDataFrame([("b", "u", [["x", "y"], ["z"]]), ("a", "u", [["x"], ["y", "z"]]), ("c", "u", [[], ["y", "z"], None]), ("d", "v", None)], "k string, u string, f array<array<string>>")
    wrote, facts = postings.add(store, 1, postings.documents(rows, "k", F.col("u"), F.coalesce("f", F.array().cast("array<array<string>>"))))
    store.publish({"seg": 1, "rows": wrote}, facts)
    search = postings.Searcher(store)
    assert facts == {"docs": 4, "length": 8}
    assert [r.key for r in search.top([["x", "y"]], 5).collect()] == ["b"]
    assert [r.key for r in search.top([["y", "z"]], 5).collect()] == ["a", "c"]
    assert [r.key for r in search.top([["x"]], 5).collect()] == ["a", "b"]
    of_kind = spark.createDataFrame([("d",)], "key string")
    assert {r.kind_filter_dropped for r in lexical.search_kind(search, [["x"]], of_kind, 5).collect()} == {True}


def test_two_writers_of_one_version_conflict(spark, tmp_path):
    one, two = (Segments(spark, f"file://{tmp_path}/s", postings.schemas(), postings.UNITS) for _ in range(2))
    one.publish({"seg": 1, "rows": {}}, {})
    with pytest.raises(Conflict):
        two.publish({"seg": 1, "rows": {}}, {})


def test_an_empty_table_finds_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents"))
    search = kept.text_postings(spark, str(tmp_path / "documents"))
    assert search.top([["x"]], 5).count() == 0 and search.top([["x", "y"]], 5).count() == 0 and search.top([], 5).count() == 0
    assert T.words(F.lit("x")) is not None
