"""Conversation structure repair by error-correcting Earley parsing.

A conversation's rows are symbols: the initial of the role, whether the text is cut
short, and whether the row must go (a blank or repeated one). The role grammar is
left-linear, so a chart column holds a bounded number of items and a parse takes
linear time. Its error productions are weighted: a row may be deleted, a user's or an
assistant's turn may be read from a row of another role, or from nothing. Every
chart item keeps its least (cost, audit), the audit being the initials of the edits;
of equal costs the audit that sorts first in ASCII wins. The completed item of an
accepting state at the last column is the repair.

No task needs a whole conversation to parse it. Rows without texts, equal ones
counted together, are dealt to ranges of (conversation, turn); each piece of at most
``PIECE`` rows in a range is parsed from every state of the grammar that it may begin
in, and a conversation's pieces are put together in order. Only then its texts come to
one task, sorted, and pass through the hash of the repaired text one by one: a hash of
one text can't be split, and nothing but the audit is held meanwhile. (An audit has a
letter for each row and is copied once for each piece.)

Cases: a null role or text is one space; null conversations are one conversation;
null turns come first; rows of one turn are ordered by role, the text's first
characters, and its digest, so that equal rows are neighbours; other roles than
those of the grammar are reroled or deleted; a conversation without rows after
damage has zeros and an empty audit; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import in_workers

#: Costs of productions that mend a fault, and of a text that stays cut short.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a piece, characters of a text that order rows before its digest does.
PIECE, HEAD = 2048, 32
# White space, ends of sentences, pairs of role initials that may meet.
SPACE, ENDS, PAIRS = " \t\n\x0b\x0c\r", ".!?", ("su", "ua", "au")
NAMES = {"u": "user", "a": "assistant"}
GOES = "d"

#: Role grammar `(s?(ua)+)?` as left-linear productions (head, what comes before, terminal). Head 0
#: is empty; each of the others ends with the role that names it. ANY is a row that is deleted.
ANY = "x"
STATES, ACCEPTED = "0sua", "0a"
PRODUCTIONS = (("s", "0", "s"), ("u", "0", "u"), ("u", "s", "u"), ("u", "a", "u"), ("a", "u", "a"), *((q, q, ANY) for q in STATES))
#: For the completer: the items that wait for a head, as (head, terminal) with the dot before the terminal.
WAITING = {q: [(head, terminal) for head, before, terminal in PRODUCTIONS if before == q] for q in STATES}

Item = tuple[int, str]  # least (cost, audit)


def _column(scanned: dict[str, Item]) -> dict[str, Item]:
    """A chart column's completed items from those that the scanner completed.

    The completer moves the dot of what waits for a head over it; an insert production
    then moves it over a user's or an assistant's role without a row. Items leave the
    agenda by (cost, audit), so the first of a head is its least. All origins are the
    piece's beginning, as the grammar is left-linear.
    """
    agenda = [(cost, audit, head) for head, (cost, audit) in scanned.items()]
    heapq.heapify(agenda)
    done: dict[str, Item] = {}
    while agenda:
        cost, audit, head = heapq.heappop(agenda)
        if head in done:
            continue
        done[head] = (cost, audit)
        for made, terminal in WAITING[head]:
            if terminal in NAMES and made not in done:
                heapq.heappush(agenda, (cost + INSERT, audit + "I", made))
    return done


def _scan(column: dict[str, Item], symbol: str, times: int) -> dict[str, Item]:
    """Completed items that the waiting ones of ``column`` make of a row."""
    initial, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    out: dict[str, Item] = {}
    for before, (cost, audit) in column.items():
        for head, terminal in WAITING[before]:
            if terminal == ANY:
                item = (cost + DELETE * times, audit + "D" * times)
            elif symbol == GOES:
                continue
            elif terminal == initial:
                item = (cost + more, audit + "K")
            elif terminal in NAMES:
                item = (cost + REROLE + more, audit + "R")
            else:
                continue
            if head not in out or item < out[head]:
                out[head] = item
    return out


def parse(rows: list[tuple[str, int]], start: str = "0") -> dict[str, Item]:
    """For each head that ``rows`` can be read as after ``start``: the least (cost, audit).

    A row is (symbol, times): the initial s, u or a, or o for another role, in upper
    case if its text is cut short; d for so many rows that must go.
    """
    column = _column({start: (0, "")})
    for symbol, times in rows:
        column = _column(_scan(column, symbol, times))
    return column


@lru_cache(1 << 14)
def _parsed(rows: tuple, start: str) -> dict[str, Item]:
    return parse(list(rows), start)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as they are after damage; a dropped row has 0 copies and no more than its conversation."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spoken("conv_id"), spoken("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spoken("role").alias("role"), spoken("text").alias("text"), kind.alias("kind"))
    stays = lambda c: F.when(F.col("kind") != 0, c)
    return given.select(
        "conv_id",
        stays(F.col("turn")).alias("turn"),
        stays(F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).alias("role"),
        stays(text).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def whole(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of rows that are as they should be examined."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spoken("role"), spoken("text"), F.lit(1).alias("copies"))


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"head": F.left("text", F.lit(HEAD)), "digest": F.unhex(F.sha2("text", 256))})


def _symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, head, digest, copies, blank, truncated, earlier): rows without
    texts, equal ones together; ``earlier``: an earlier turn says the same."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    slim = rows.select("conv_id", "turn", "role", "head", "digest", "copies", (last == "").alias("blank"), (~last.isin("", *ENDS)).alias("truncated"))
    slim = slim.groupBy("conv_id", "turn", "role", "head", "digest", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    # The first turn of what several turns say; copies in one turn are one row by now.
    said = slim.where("copies > 0 and not blank").groupBy("conv_id", "role", "digest").agg(F.count("*").alias("turns"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("null_turn"))
    said = said.where("turns > 1").select(*[F.col(c).alias(f"said_{c}") for c in ("conv_id", "role", "digest")], "first", "null_turn")
    # One text may be a large part of a long conversation: its rows are salted, the few first turns sent to every salt.
    salted = said.withColumn("said_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    left = slim.withColumn("salt", F.pmod(F.xxhash64("turn", "conv_id"), F.lit(16)).cast("int"))
    on = F.col("conv_id").eqNullSafe(F.col("said_conv_id")) & (F.col("role") == F.col("said_role")) & (F.col("digest") == F.col("said_digest")) & (F.col("salt") == F.col("said_salt"))
    joined = left.join(salted, on, "left")
    earlier = F.col("turn").isNotNull() & (F.col("null_turn") | (F.col("turn") > F.col("first")))
    return joined.select("conv_id", "turn", "role", "head", "digest", "copies", "blank", "truncated", F.coalesce(earlier, F.lit(False)).alias("earlier"))


FACTS = "conv_id long, part long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, first_turn long, last_turn long, low long, high long, turns long, costs array<long>, audits array<string>"


def _pieces(symbols: DataFrame) -> DataFrame:
    """Pieces of conversations, each with its counts, its ends, and its parses from every state."""
    order = ["conv_id", "turn", "role", "head", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        conv, opened, begun = None, False, 0
        symbols: list[tuple[str, int]] = []
        counts, illegal, roles, turns = [0, 0, 0], 0, [], []

        def ended() -> None:
            nonlocal part, illegal
            key = tuple(symbols)
            table = {q: _parsed(key, q) if len(key) < 40 else parse(symbols, q) for q in (STATES if begun != 1 else "0")}
            flat = [table.get(p, {}).get(q) for p in STATES for q in STATES]
            known = [t for t in turns if t is not None]
            distinct = sum(a != b for a, b in zip([None, *known], known, strict=False))
            out.append((conv, part, *counts, illegal, roles[0] if roles else None, roles[-1] if roles else None, turns[0] if turns else None, turns[-1] if turns else None, known[0] if known else None, known[-1] if known else None, distinct, [-1 if x is None else x[0] for x in flat], ["" if x is None else x[1] for x in flat]))
            part += 1
            symbols.clear(), roles.clear(), turns.clear()
            counts[:], illegal = [0, 0, 0], 0

        def sent() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=FIELDS)
            out.clear()
            return made

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "copies", "blank", "truncated", "earlier")]
            for own, turn, role, copies, blank, truncated, earlier in zip(*columns, strict=True):
                if not opened or own != conv:
                    if opened:
                        ended()
                        begun = 1  # the conversation begins here
                    conv, opened = own, True
                elif len(symbols) >= PIECE:
                    ended()
                    begun = 2
                if not copies:
                    continue
                initial = role[:1]
                if roles and roles[-1] + initial not in PAIRS:
                    illegal += 1
                if copies > 1 and initial + initial not in PAIRS:
                    illegal += copies - 1
                roles[1:] = [initial] if roles else []
                if not roles:
                    roles.append(initial)
                turns.append(turn)
                symbol = initial if initial in ("s", "u", "a") else "o"
                if blank or earlier:
                    symbols.append((GOES, copies))
                    counts[0 if blank else 1] += copies
                else:
                    symbols.append((symbol.upper() if truncated else symbol, 1))
                    counts[2] += truncated
                    if copies > 1:
                        symbols.append((GOES, copies - 1))
                        counts[1] += copies - 1
            if len(out) > 4096:
                yield sent()
        if opened:
            ended()
        if out:
            yield sent()

    dealt = symbols.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "copies", "blank", "truncated", "earlier")
    return in_workers(dealt, run, FACTS, "conversations")


FIELDS = [f.split()[0] for f in FACTS.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}[f.split()[1]] for f in FACTS.split(", ")]

REPAIR = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """Facts of a conversation as its pieces come, then the hash of its repaired text as its rows come."""

    def __init__(self, conv: int | None):
        self.conv, self.counts, self.illegal, self.turns = conv, [0, 0, 0], 0, 0
        self.low = self.high = self.last_role = self.last_turn = None
        self.states: dict[str, Item] = {"0": (0, "")}
        self.cost, self.audit, self.at, self.state = 0, None, 0, "0"
        self.hash, self.empty = hashlib.sha256(), True

    def piece(self, row: dict) -> None:
        self.counts = [a + row[c] for a, c in zip(self.counts, ("blank", "duplicate", "truncated"), strict=True)]
        self.illegal += row["illegal"] + (self.last_role is not None and row["first_role"] is not None and self.last_role + row["first_role"] not in PAIRS)
        self.turns += row["turns"] - (self.last_turn is not None and row["first_turn"] == self.last_turn)
        if row["low"] is not None:
            self.low = row["low"] if self.low is None else self.low
            self.high = row["high"]
        if row["last_role"] is not None:
            self.last_role, self.last_turn = row["last_role"], row["last_turn"]
        after: dict[str, Item] = {}
        for n, (more, edits) in enumerate(zip(row["costs"], row["audits"], strict=True)):
            before, made = STATES[n // 4], STATES[n % 4]
            if more >= 0 and before in self.states:
                item = (self.states[before][0] + more, self.states[before][1] + edits)
                if made not in after or item < after[made]:
                    after[made] = item
        self.states = after

    def settle(self) -> None:
        if self.audit is None:
            self.cost, self.audit = min(item for state, item in self.states.items() if state in ACCEPTED)

    def _say(self, role: str, text: str) -> None:
        if not self.empty:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode())
        self.empty, self.state = False, role[:1]

    def _turn(self) -> str:
        """The role of the turn that an edit makes here."""
        return NAMES["a" if self.state == "u" else "u"]

    def insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._say(self._turn(), "")
            self.at += 1

    def row(self, role: str, text: str, copies: int) -> None:
        self.settle()
        for _ in range(copies):
            self.insert()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                self._say(role if edit == "K" else self._turn(), text)

    def done(self) -> tuple:
        self.settle()
        self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.counts, self.illegal, self.cost, self.audit, self.hash.hexdigest())


def repair(rows: DataFrame) -> DataFrame:
    """The repair of every conversation of ``rows`` (conv_id, turn, role, text, copies)."""
    rows = _ordered(rows)
    pieces = _pieces(_symbols(rows))
    texts = rows.where("copies > 0").select("conv_id", "turn", "role", "head", "digest", "copies", "text")
    both = pieces.withColumn("kind", F.lit(0)).unionByName(texts.withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        out: list[tuple] = []

        def sent() -> pa.RecordBatch:
            names = [f.split()[0] for f in REPAIR.split(", ")]
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names=names)
            out.clear()
            return made

        facts = [f for f in FIELDS if f != "conv_id"]
        for batch in batches:
            kinds, convs = batch.column("kind").to_pylist(), batch.column("conv_id").to_pylist()
            columns = {c: batch.column(c) for c in (*facts, "role", "text", "copies")}
            for n, (kind, conv) in enumerate(zip(kinds, convs, strict=True)):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.done())
                    now = _Conversation(conv)
                if kind == 0:
                    now.piece({c: columns[c][n].as_py() for c in facts})
                else:
                    now.row(columns["role"][n].as_py(), columns["text"][n].as_py(), columns["copies"][n].as_py())
            if len(out) > 4096:
                yield sent()
        if now is not None:
            out.append(now.done())
        if out:
            yield sent()

    order = ["conv_id", "kind", "part", "turn", "role", "head", "digest"]
    return in_workers(both.repartition("conv_id").sortWithinPartitions(*order), run, REPAIR, "conversations")
