"""Packing by lexical retrieval: windows of tokens from related documents.

Texts are encoded once and their ids written to the shared folder. Document
frequencies and the mean length are counted over all of them. A shuffle sorts
the documents by their most telling ids, so related ones and copies of the whole
corpus come together, and this order is cut into shards of bounded size. Each
shard has an inverted index over token ids with BM25 impacts. The window that a
seed document opens is filled with the best unused documents of the shard, by the
score of all the seed's terms, as long as any has a score above 0; then
the next document seeds the rest of the window. End ids are no terms: they are in no
postings, frequencies or lengths. The last document is cut where the
window ends, and its rest seeds the next window. Without ``repeats`` a window takes no
second copy of a document that it holds, and is closed if its shard has nothing else
left. A task holds one shard at a time; documents that are related by other ids than those they are sorted by may
be in different shards. What remains at a shard's end is cut into windows whose
lengths are powers of two, which take no padding. Without ``gather`` the documents stay
in the order of their partitions, so that shards of a mix keep its proportions.

Cases: null text is empty; an empty document is its end id alone; rows that
repeat a doc_id are packed each on its own; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, in_workers, row_chunks, text_buffers
from sparkloom.llm.tokens import ENCODE_BYTES, END_ID, units

WINDOW = 2048
#: A shard is closed at that many tokens.
SHARD_TOKENS = 1 << 20
#: Ids that are counted together.
COUNT_IDS = 1 << 18
K1, B = 1.2, 0.75

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Bm25:
    """Inverted index of a shard: for each term its documents and impacts.

    A term that an eighth of the documents hold has a row with the impact of every
    document, 0 where it is absent; so rows have at most 8 places for each posting.
    """

    def __init__(self, ids: np.ndarray, at: np.ndarray, stats: Stats | None = None):
        n, lengths = len(at) - 1, np.diff(at).astype(np.float64)
        doc, term, tf = _postings(ids, at)
        df = np.bincount(term, minlength=1)
        if stats is None:  # the shard is all there is
            stats = Stats(n, lengths.mean(), df)
        impact = _impacts(stats, stats.df[term], tf, lengths[doc])
        common = 8 * df >= max(n, 1)
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.rows = np.zeros((int(common.sum()), n), np.float32)
        row = self.row[term]
        rare = np.flatnonzero(row < 0)
        self.rows[row[row >= 0], doc[row >= 0]] = impact[row >= 0]
        by_term = rare[np.argsort(term[rare] << 32 | doc[rare])]
        self.n, self.docs, self.impacts = n, doc[by_term], impact[by_term]
        self.term_at = np.concatenate([[0], np.cumsum(np.where(common, 0, df))])
        self.doc_at = np.searchsorted(doc, np.arange(n + 1))
        self.doc_terms = term.astype(np.int32)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the seed's terms."""
        chosen = self.doc_terms[self.doc_at[seed] : self.doc_at[seed + 1]]
        row = self.row[chosen]
        chosen = chosen[row < 0]
        lo, hi = self.term_at[chosen], self.term_at[chosen + 1]
        ends = np.cumsum(hi - lo)
        places = np.repeat(lo - (ends - (hi - lo)), hi - lo)
        places += np.arange(len(places))
        rare = np.bincount(self.docs[places], self.impacts[places], self.n)
        return rare + self.rows.take(row[row >= 0], 0).sum(0)


def bodies(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets of documents without their last, the end ids."""
    stays = np.ones(len(ids), bool)
    stays[at[1:] - 1] = False
    return ids[stays], at - np.arange(len(at))


def _copies(ids: np.ndarray, at: np.ndarray, names: list | None) -> np.ndarray:
    """For each document the number of its group: those with the same ids, or the same name, are one."""
    raw, size = memoryview(np.ascontiguousarray(ids)).cast("B"), ids.itemsize
    head = list(range(len(at) - 1))

    def of(n: int) -> int:
        while head[n] != n:
            head[n] = n = head[head[n]]
        return n

    first: dict = {}
    for n, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        keys = [raw[size * a : size * b].tobytes()] + ([] if names is None or names[n] is None else [names[n]])
        for key in keys:
            one, other = sorted((of(n), of(first.setdefault(key, n))))
            head[other] = one
    return np.array([of(n) for n in head], np.int64)


def pack_windows(ids: np.ndarray, at: np.ndarray, window: int = WINDOW, stats: Stats | None = None, ended: bool = False, repeats: bool = True, names: list | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, window, offset) that hold each id of a shard once.

    ``ended``: every document's last id is an end id, which is no term. ``names``: of
    documents; those of one name count as copies, as one may be a part of the other.
    """
    index, lengths = Bm25(*(bodies(ids, at) if ended else (ids, at)), stats), np.diff(at).tolist()
    n, pieces, number, fill = len(lengths), [], 0, 0
    unused = np.ones(n, bool)
    alike = np.arange(n) if repeats else _copies(ids, at, names)
    barred = np.zeros(n, bool)  # by number of a first copy: one is in the open window
    inside: list[int] = []
    scores = np.zeros(n)  # of the seed of the open window
    waiting: list[int] = []  # its best neighbours, the best last
    batch = 0
    following = 0
    for _ in range(n):
        while waiting and not (unused[waiting[-1]] and not barred[alike[waiting[-1]]]):
            waiting.pop()
        if not waiting and batch:  # the neighbours after those that were taken
            waiting, batch = _best(scores, unused & ~barred[alike], batch), 2 * batch
        seeds = not waiting
        if waiting:
            doc = waiting.pop()
        else:
            while not unused[following]:
                following += 1
            doc = following
            if barred[alike[doc]]:
                free = np.flatnonzero(unused[following:] & ~barred[alike[following:]])
                if len(free):
                    doc = following + int(free[0])
                else:
                    pieces = _ended(pieces, number, fill)
                    number, fill = pieces[-1][3] + 1, 0
                    barred[inside] = False
                    inside = []
        unused[doc] = False
        start, left = 0, lengths[doc]
        while left:
            take = min(left, window - fill)
            pieces.append((doc, start, take, number, fill))
            start, left, fill = start + take, left - take, fill + take
            if fill == window:
                number, fill, seeds = number + 1, 0, True
                barred[inside] = False
                inside = []
        if fill and not repeats:
            barred[alike[doc]] = True
            inside.append(int(alike[doc]))
        if fill and seeds:  # it opened the window, or nothing in it has neighbours left
            scores, waiting, batch = index.scores(doc), [], 32
        elif not fill:
            waiting, batch = [], 0
    return _ended(pieces, number, fill)


def _best(scores: np.ndarray, unused: np.ndarray, most: int) -> list[int]:
    """At least ``most`` unused neighbours, if there are as many, by score, the best last."""
    found = np.flatnonzero(unused & (scores > 0))
    if len(found) > most:
        least = np.partition(scores[found], len(found) - most)[len(found) - most]
        found = found[scores[found] >= least]
    return found[np.lexsort((-found, scores[found]))].tolist()


def _ended(pieces: list, number: int, fill: int) -> list:
    """Deal the open window out to windows whose lengths are powers of two."""
    if not fill or not fill & (fill - 1):
        return pieces
    last = [p for p in pieces if p[3] == number]
    done = pieces[: len(pieces) - len(last)]
    room = 1 << (fill.bit_length() - 1)
    used = 0
    for doc, start, length, _, _ in last:
        while length:
            take = min(length, room - used)
            done.append((doc, start, take, number, used))
            start, length, used, fill = start + take, length - take, used + take, fill - take
            if used == room and fill:
                number, used, room = number + 1, 0, 1 << (fill.bit_length() - 1)
    return done


class Stats(NamedTuple):
    """Documents, their mean length, and for each id the documents that hold it."""

    docs: int
    mean: float
    df: np.ndarray

    def idf(self, df: np.ndarray) -> np.ndarray:
        return np.log1p((self.docs - df + 0.5) / (df + 0.5))


def _postings(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, occurrences) in order of documents, then ids."""
    n = len(at) - 1
    bits = max(1, int(ids.max(initial=0)).bit_length())
    kind = np.uint32 if n << bits <= 1 << 32 else np.uint64  # short keys sort faster
    key = np.sort(np.repeat(np.arange(n, dtype=kind) << kind(bits), np.diff(at)) | ids.astype(kind))
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    tf = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> kind(bits)).astype(np.int64), (key & kind((1 << bits) - 1)).astype(np.int64), tf


def _impacts(stats: Stats, df: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return stats.idf(df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / stats.mean))


def topics(ids: np.ndarray, at: np.ndarray, stats: Stats, least: tuple[float, ...]) -> list[np.ndarray]:
    """For each value of ``least`` every document's most telling id of those that so many documents hold; -1 if there is none."""
    doc, term, tf = _postings(ids, at)
    df = stats.df[term]
    impact = _impacts(stats, df, tf, np.diff(at)[doc])
    held, first, count = np.unique(doc, return_index=True, return_counts=True)
    out = []
    for n in least:
        own = np.where(df >= n, impact, -1.0)
        best = np.full(len(at) - 1, -1, np.int64)
        if len(held):
            most = np.maximum.reduceat(own, first)
            hit = np.flatnonzero((own == np.repeat(most, count)) & (own >= 0))[::-1]
            best[doc[hit]] = term[hit]  # the first of equal ones is written last
        out.append(best)
    return out


def _token_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of ids as bytes, and the n + 1 offsets of rows in them."""
    data, offsets = text_buffers(column)
    return data[offsets[0] : offsets[-1]].view("<u4"), (offsets - offsets[0]) // 4


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, row, ids as bytes): every row of ``docs`` under a number of its own, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = units(tokenizer_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids_of, (data, offsets) = batch.column(0), text_buffers(batch.column(1))
            for a, b in row_chunks(offsets, ENCODE_BYTES):
                own = offsets[a : b + 1]
                ids, at = encoder.encode(data[own[0] : own[-1]], own - own[0], end_id)
                column = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([ids_of.slice(a, b - a).cast(pa.int64()), pa.array(np.arange(row, row + b - a)), column], names=["doc_id", "row", "ids"])
                row += b - a

    return cut(in_workers(docs.select("doc_id", "text"), run, "doc_id long, row long, ids binary", "tokens"), "packing-ids")


def statistics(tokens: DataFrame) -> Stats:
    """Of all documents, without end ids. A row for each id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(1, np.int64), 0, 0
        for batch in batches:
            ids, at = _token_buffers(batch.column(0))
            for a, b in row_chunks(at, COUNT_IDS):
                own = np.bincount(_postings(*bodies(ids[at[a] : at[b]], at[a : b + 1] - at[a]))[1], minlength=1)
                small, df = sorted((df, own), key=len)
                df = df.copy()
                df[: len(small)] += small
            docs, length = docs + len(at) - 1, length + int(at[-1]) - (len(at) - 1)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"id": np.concatenate([[-2, -1], held]), "n": np.concatenate([[docs, length], df[held]])})

    table = in_workers(tokens.select("ids"), run, "id long, n long", "tokens").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    df = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    df[ids[ids >= 0]] = n[ids >= 0]
    docs, length = int(n[ids == -2].sum()), int(n[ids == -1].sum())
    return Stats(docs, length / max(docs, 1), df)


def gathered(tokens: DataFrame, stats: Stats, shard_tokens: int, window: int) -> DataFrame:
    """``tokens`` in an order in which related documents of all the corpus are near each other.

    They are sorted by their most telling ids: of those that fill a shard, then of
    those that fill a window, then of all that two documents hold. Ranges of this order
    are the partitions. The row's number comes last, so a hot group is split as any other.
    """
    schema = "t0 long, t1 long, t2 long, row long, doc_id long, ids binary"
    least = tuple(max(2.0, n / max(stats.mean, 1)) for n in (shard_tokens, window, 0))
    sent = tokens.sparkSession.sparkContext.broadcast(stats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = _token_buffers(batch.column(2))
            for a, b in row_chunks(at, COUNT_IDS):
                keys = topics(*bodies(ids[at[a] : at[b]], at[a : b + 1] - at[a]), sent.value, least)
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), rows.column(1), rows.column(0), rows.column(2)], names=["t0", "t1", "t2", "row", "doc_id", "ids"])

    keys = ["t0", "t1", "t2", "row"]
    return in_workers(tokens, run, schema, "tokens").repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "ids")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID, with_ids: bool = False, gather: bool = True, repeats: bool = True) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text); with ``with_ids`` its ids too."""
    schema = PIECES + (", ids array<long>" if with_ids else "")
    tokens = encoded(docs, tokenizer_path, end_id)
    stats = statistics(tokens)
    sent = docs.sparkSession.sparkContext.broadcast(stats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        names: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        tokens = 0

        def closed(sequence: int) -> tuple[int, pa.RecordBatch]:
            ids, at = np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            rows = np.array(pack_windows(ids, at, window, sent.value, True, repeats, names), np.int64).reshape(-1, 5)
            raw = memoryview(ids.astype("<u4").view(np.uint8))
            lo = at[rows[:, 0]] + rows[:, 1]
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + rows[:, 2]).tolist(), strict=True)]
            columns = {"doc_id": pa.array([names[d] for d in rows[:, 0].tolist()], pa.int64()), "start": rows[:, 1], "length": rows[:, 2], "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": np.diff(at)[rows[:, 0]], "sequence_id": rows[:, 3] + sequence, "offset": rows[:, 4]}
            if with_ids:
                columns["ids"] = pa.array([ids[a : a + n].astype(np.int64) for a, n in zip(lo.tolist(), rows[:, 2].tolist(), strict=True)], pa.list_(pa.int64()))
            return sequence + int(rows[-1, 3]) + 1, pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            ids_of, (ids, at) = batch.column(0).to_pylist(), _token_buffers(batch.column(1))
            r = 0
            while r < len(ids_of):
                s = min(len(ids_of), max(r + 1, int(np.searchsorted(at, at[r] + shard_tokens - tokens, "left"))))
                names += ids_of[r:s]
                held.append(ids[at[r] : at[s]])
                lengths.append(np.diff(at[r : s + 1]))
                tokens += int(at[s] - at[r])
                r = s
                if tokens >= shard_tokens:
                    sequence, made = closed(sequence)
                    yield made
                    tokens, names, held, lengths = 0, [], [], []
        if names:
            yield closed(sequence)[1]

    order = gathered(tokens, stats, shard_tokens, window) if gather else tokens.select("doc_id", "ids")
    return in_workers(order, run, schema, "tokens")
