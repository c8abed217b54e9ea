"""Source divergence audit: how far the words of each source are from the other
sources of its language, and from the language as a whole.

Pass 1 counts, for each language, the documents that hold each term, exactly, and
keeps the terms of at least ``LEAST_DOCS`` documents. Pass 2 reads the texts again:
an Aho-Corasick automaton of each language's kept terms, each padded with a
delimiter on both sides, counts their occurrences for every source. Both passes add
up inside their tasks and send only sums. The kept terms go to the tasks in books
of about ``BOOK_BYTES``, so an automaton's size is bounded; each further book is one
more reading of the texts. Counts above 0 are sparse postings (language, source,
term, count); a count of 0 is never a row.

A term's share in a source is ``1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))``
with N the source's occurrences of kept terms and V their number, in exact integers.
Two sources' distance is the sum over all kept terms of the shares' difference. For
terms that neither source has it is the difference of the two shares of count 0, so
tasks go through postings term by term and add only what differs from that. A
language's terms are dealt to blocks and its sources to tiles of about ``TILE``, so
no task holds a language: it streams the postings of one block and two tiles.

Cases: null text, language and source are empty ones; rows that repeat a doc_id
count each on its own; a group without terms has N = 0; without kept terms all
distances are 0 and no term is listed; a source that is alone in its language has no
pair; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, in_workers, kept_by_workers

LEAST_DOCS, SMOOTH, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Bytes of the kept terms of one book, terms of a block, sources of a tile.
BOOK_BYTES, BLOCK_TERMS, MOST_BLOCKS, TILE = 4 << 20, 256, 256, 256
#: Sums that a task holds before it sends them, and bytes that are searched together.
HELD, SEARCHED = 800_000, 1 << 20

# Bytes of terms are ASCII letters, of which A-Z are lower-cased, and all above 127; others delimit.
DELIMITER = 32
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else DELIMITER for b in range(256))

_automata: dict = {}
kept_by_workers.append(_automata)


def grouped(docs: DataFrame) -> DataFrame:
    """(lang, source, text), empty for null."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _rows(lang: str, source: str | None, terms: list[bytes], n: list[int]) -> pa.RecordBatch:
    named = {"lang": pa.array([lang]).take(pa.array([0] * len(n), pa.int32()))}
    if source is not None:
        named["source"] = pa.array([source]).take(pa.array([0] * len(n), pa.int32()))
    return pa.RecordBatch.from_pydict(named | {"term": pa.array(terms, pa.binary()).cast(pa.string()), "n": pa.array(n, pa.int64())})


def frequencies(rows: DataFrame) -> DataFrame:
    """(lang, term, n): documents of the language with the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                yield _rows(lang, None, list(own), list(own.values()))
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                own = held.setdefault(lang, Counter())
                size -= len(own)
                own.update(set(text.as_py().translate(TERM_BYTES).split()))
                size += len(own)
                if size > HELD:
                    yield from sent()
                    size = 0
        yield from sent()

    parts = in_workers(rows.select("lang", "text"), run, "lang string, term string, n long", "divergence")
    return parts.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def automaton(terms: list[bytes]) -> ahocorasick.Automaton:
    """Of terms between two delimiters; what it finds is a term's number."""
    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for n, term in enumerate(terms):
        made.add_word(f" {term.decode('latin-1')} ", n)
    made.make_automaton()
    return made


def count(counts: Counter, finder: ahocorasick.Automaton, texts: list[bytes]) -> None:
    """Add to ``counts`` the number of each kept term that stands in ``texts``, as often as it does."""
    data = b" ".join([b"", *texts, b""]).translate(TERM_BYTES)
    start, last = 0, len(data) - 1
    while start < last:  # a piece ends with the delimiter that the next one begins with
        end = data.find(b" ", min(start + SEARCHED, last))
        counts.update(map(itemgetter(1), finder.iter(data[start : end + 1].decode("latin-1"))))
        start = end


def occurrences(rows: DataFrame, book: dict[str, list[bytes]]) -> DataFrame:
    """(lang, source, term, n) of the terms of ``book`` (language -> terms), sums of tasks."""
    shared, name = rows.sparkSession.sparkContext.broadcast(book), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], Counter] = {}
        size = 0
        if name not in _automata:
            _automata.clear()
            _automata[name] = {}
        made = _automata[name]

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in held.items():
                terms = shared.value[lang]
                yield _rows(lang, source, [terms[k] for k in own], list(own.values()))
            held.clear()

        for batch in batches:
            texts: dict[tuple[str, str], list[bytes]] = {}
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if lang in shared.value:
                    texts.setdefault((lang, source), []).append(text)
            for (lang, source), own in texts.items():
                if lang not in made:
                    made[lang] = automaton(shared.value[lang])
                counter = held.setdefault((lang, source), Counter())
                size -= len(counter)
                count(counter, made[lang], own)
                size += len(counter)
                if size > HELD:
                    yield from sent()
                    size = 0
        yield from sent()

    return in_workers(rows.select("lang", "source", "text"), run, "lang string, source string, term string, n long", "divergence")


def postings(rows: DataFrame, kept: DataFrame, book_bytes: int = BOOK_BYTES) -> DataFrame:
    """(lang, source, term, n) for n above 0, from one reading of the texts for each book of kept terms."""
    size = kept.agg(F.sum(F.octet_length("term") + 8).alias("n")).first().n or 0
    books = max(1, -(-4 * size // (3 * book_bytes)))
    parts = None
    for b in range(books):
        own = kept.where(F.pmod(F.xxhash64("lang", "term"), F.lit(books)) == b).select("lang", "term").toArrow()
        book: dict[str, list[bytes]] = {}
        for lang, term in zip(own.column(0).to_pylist(), own.column(1).cast(pa.binary()).to_pylist(), strict=True):
            book.setdefault(lang, []).append(term)
        part = cut(occurrences(rows, book).groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "divergence-postings")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def share(count: str, total: str, terms: str) -> Column:
    """The exact share of ``count`` in a group with ``total`` occurrences of ``terms`` kept terms; 0 without terms."""
    whole = "CAST({} AS DECIMAL(19, 0))"
    return F.expr(f"if({terms} = 0, 0L, 1 + (({whole.format(count)} + {SMOOTH}) * CAST({SCALE} AS DECIMAL(10, 0))) div ({whole.format(total)} + {whole.format(terms)} * {SMOOTH}))")


def _pairs(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a tile pair, once, from sorted rows.

    Rows of a (lang, near, far, block): first every source with its share of count 0
    (no term), then the block's postings by term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, term = None, None
        names: list[str] = []
        tiles: list[int] = []
        base: list[int] = []
        place: dict[str, int] = {}
        at: list[int] = []
        values: list[int] = []
        floor = apart = both = one = None

        def settled() -> None:
            """Add the term's postings: (a holder's share to every source's) less what two sources without it have."""
            shares = floor.copy()
            shares[at] = values
            added = np.abs(shares[at][:, None] - shares) - apart[at]
            both[np.ix_(at, at)] += added[:, at]
            added[:, at] = 0
            one[at] += added
            at.clear(), values.clear()

        def ended() -> Iterator[pa.RecordBatch]:
            lang, near, far, block, kept = key
            if at:
                settled()
            plain = np.array(base, np.int64)
            total = (both + one + one.T) if both is not None else np.zeros((len(base), len(base)), np.int64)
            if block == 0:
                total = total + kept * np.abs(plain[:, None] - plain)
            side = np.array(tiles)
            order = np.array(sorted(range(len(names)), key=lambda k: names[k].encode()))
            rank = np.empty(len(names), np.int64)
            rank[order] = np.arange(len(names))
            wanted = (rank[:, None] < rank) & ((side[:, None] != side) | (near == far))
            a, b = np.nonzero(wanted)
            own = pa.array(names, pa.string())
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(a), pa.string()), "source": own.take(pa.array(a)), "item": own.take(pa.array(b)), "value": pa.array(total[a, b])})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "near", "far", "block", "kept", "term", "source", "tile", "p")]
            for lang, near, far, block, kept, word, source, tile, p in zip(*columns, strict=True):
                if key is None or key[:4] != (lang, near, far, block):
                    if key is not None:
                        yield from ended()
                    key, term = (lang, near, far, block, kept), None
                    names, tiles, base, place, at, values = [], [], [], {}, [], []
                    floor = apart = both = one = None
                if word is None:
                    place[source] = len(names)
                    names.append(source), tiles.append(tile), base.append(p)
                    continue
                if floor is None:
                    floor = np.array(base, np.int64)
                    apart = np.abs(floor[:, None] - floor)
                    both, one = np.zeros_like(apart), np.zeros_like(apart)
                if word != term and at:
                    settled()
                term = word
                at.append(place[source]), values.append(p)
        if key is not None:
            yield from ended()

    return in_workers(rows, run, "lang string, source string, item string, value long", "divergence")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, book_bytes: int = BOOK_BYTES, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has the distance to each
    other source of the language, part ``term`` the terms that the source has more of
    than its language, the ``top_terms`` with the largest difference."""
    rows = grouped(docs)
    kept = cut(frequencies(rows).where(F.col("n") >= least_docs), "divergence-terms")
    counts = postings(rows, kept, book_bytes)
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("docs"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept"])
    groups = cut(groups.withColumn("p", share("0", "total", "kept")), "divergence-groups")
    have = counts.join(groups.select("lang", "source", "total", "kept"), ["lang", "source"])
    have = have.select("lang", "source", "term", share("n", "total", "kept").alias("p"))

    sizes = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.max("kept").alias("kept"), F.count("*").alias("sources"))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(sizes, "lang").select("lang", "term", share("n", "all", "kept").alias("q"))
    more = have.join(whole, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    most = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = more.withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= top_terms)

    # Tiles and blocks: a source is in one tile, a term in one block; both ends of a pair of tiles get it.
    shape = sizes.select("lang", F.ceil(F.col("sources") / tile).cast("int").alias("tiles"), F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("kept") / BLOCK_TERMS))).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    pairs_of = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("near"), F.greatest(t, F.col("tile")).alias("far"))))
    plain = groups.join(shape, "lang").withColumn("tile", own).withColumn("t", pairs_of).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    given = have.join(shape.join(langs, "lang"), "lang").withColumn("tile", own).withColumn("t", pairs_of).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    columns = ["lang", "t.near", "t.far", "block", "kept", "source", "tile", "p"]
    sent = plain.select(*columns, F.lit(None).cast("string").alias("term")).unionByName(given.select(*columns, "term"))
    key = ["lang", "near", "far", "block"]
    found_pairs = _pairs(sent.repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("term"), "source"))
    once = found_pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    twice = once.select("lang", F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))), "value")
    nearest = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = twice.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(nearest))
    return pairs.unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))
