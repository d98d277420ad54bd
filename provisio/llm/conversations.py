r"""Conversation structure repair by secondary-sorted streaming.

Rows are dealt by conversation and sorted by turn inside the partitions; ``mapInPandas``
reads them batch by batch and carries a small dynamic program from one batch to the
next, so a conversation may be longer than any batch.  Per row it keeps one byte for each
of four states (the back-pointer) and the row's place in the repaired text; both go to an
unnamed temporary file of the task once a conversation outgrows ``HELD`` bytes.  At the end the
back-pointers are walked from the last row to the first, in pieces, and the repaired
text is hashed in one forward read.

States are the initial of the last element so far: none, s, u, a.  The result must read
``(s?(ua)+)?``.  Edits of a row: Keep 0, Rerole to user or assistant 1, Delete 2 (the only
one for blank and duplicate rows); Insert an empty user or assistant turn 5; a truncated row
that is not deleted adds 5.  Inserts stand before the edit of a row or at the end, so the
edit strings of different states are never prefixes of each other and a rank among
the states orders them: of cheapest strings the ASCII-least wins.

Duplicates need the rows of a conversation that stand anywhere before; they come from a
Spark aggregation over (conversation, digest of role and text), not from a set in the task.

Null turns come first, in one conversation the rows of one turn by role and text.
A null conversation id is a conversation of its own.  Null role or text counts as one
space (so a null text is blank).  Repeated rows are rows; of equal ones all but the
first are duplicates.  Texts may have any length.  Empty table: no rows.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of one conversation's rows and back-pointers that a task holds in memory each.
HELD = 16 << 20
#: Rows of back-pointers read at once on the way back.
PIECE = 1 << 16
NONE, S, U, A = range(4)
INITIAL = {"s": S, "u": U, "a": A}
AFTER = {(NONE, "s"): S, (NONE, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
#: States that inserts lead to, with their number.
INSERTS = {s: [(s, 0)] for s in (NONE, S, U, A)}
INSERTS[NONE] += [(U, 1), (A, 2)]
INSERTS[S] += [(U, 1), (A, 2)]
INSERTS[U] += [(A, 1)]
INSERTS[A] += [(U, 1)]
ROLES = {U: b"user", A: b"assistant"}
LEGAL = {"su", "ua", "au"}
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPORT = f"conv string, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string"
TURNS = "conv string, place bigint, edit string, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def _options(initial: str, kept: bool, late: int) -> list[list[tuple[int, int, str, int]]]:
    """For each state after a row: (cost, state before, edits, byte), over all ways of inserts and one edit."""
    out: list[list[tuple[int, int, str, int]]] = [[], [], [], []]
    for before in range(4):
        for at, inserts in INSERTS[before]:
            edits = [(at, 2, "D")]
            if kept:
                if (at, initial) in AFTER:
                    edits.append((AFTER[at, initial], late, "K"))
                edits += [(AFTER[at, r], 1 + late, "R") for r in "ua" if (at, r) in AFTER]
            for to, cost, edit in edits:
                byte = before | inserts << 2 | "DKR".index(edit) << 4 | kept << 6
                out[to].append((cost + 5 * inserts, before, "I" * inserts + edit, byte))
    return out


class Repair:
    """The program of one conversation; rows come in order."""

    #: Options by what a row allows; there are few kinds of rows.
    kinds: dict[tuple, list] = {}

    def __init__(self, held: int = HELD):
        self.costs: list[int | None] = [0, None, None, None]
        self.ranks = [0, 0, 0, 0]
        self.rows = self.gaps = 0
        self.faults = [0, 0, 0]
        self.illegal, self.last = 0, None
        self.low = self.high = self.turn = None
        self.turns = 0
        self.back = tempfile.SpooledTemporaryFile(max_size=held)
        self.texts = tempfile.SpooledTemporaryFile(max_size=held)

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        """``fault``: 0 none, 1 blank, 2 duplicate, 3 truncated."""
        self.rows += 1
        if turn is not None:
            if self.turns == 0:
                self.low = turn
            if self.turns == 0 or turn != self.high:
                self.turns += 1
            self.high = turn
        if fault:
            self.faults[fault - 1] += 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        kind = (initial if initial in INITIAL else "", fault not in (1, 2), 5 if fault == 3 else 0)
        options = self.kinds.get(kind)
        if options is None:
            options = self.kinds[kind] = _options(*kind)
        costs, found, keys = [], [], []
        for ways in options:
            best = min(((self.costs[b] + c, self.ranks[b], e, byte) for c, b, e, byte in ways if self.costs[b] is not None), default=None)
            costs.append(best and best[0])
            keys.append(best and best[1:3])
            found.append(best[3] if best else 0)
        # Strings of different states differ before either ends, so (rank before, edits) orders them.
        order = sorted({k for k in keys if k})
        self.costs = costs
        self.ranks = [order.index(k) if k else 0 for k in keys]
        self.back.write(bytes(found))
        if fault not in (1, 2):
            own = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
            self.texts.write(struct.pack("<QQ", *map(len, own)) + own[0] + own[1])

    def _edits(self, state: int) -> Iterator[bytes]:
        """(inserts, edit) of every row as a byte, pieces from the last to the first."""
        for start in range(self.rows - 1 - (self.rows - 1) % PIECE, -1, -PIECE):
            self.back.seek(4 * start)
            held = self.back.read(4 * (min(self.rows, start + PIECE) - start))
            out = bytearray(len(held) // 4)
            for i in range(len(out) - 1, -1, -1):
                byte = held[4 * i + state]
                out[i], state = byte >> 2, byte & 3
            yield bytes(out)

    def finish(self) -> tuple[int, Iterator[tuple[str, bytes, bytes]]]:
        """The least cost, and every edit in order: (initial, role, text) of what it leaves, empty for D."""
        ends = [(c + 5 * n, rank, n, s) for s, (c, rank) in enumerate(zip(self.costs, self.ranks)) if c is not None for n in self._to_end(s)]
        cost, _, last, state = min(ends)
        return cost, self._walk(state, last)

    @staticmethod
    def _to_end(state: int) -> list[int]:
        return [n for to, n in INSERTS[state] if to == A or (state == NONE and n == 0)]

    def _walk(self, state: int, last: int) -> Iterator[tuple[str, bytes, bytes]]:
        # The decisions lie in a file from the last row to the first, which is read from its end.
        with tempfile.SpooledTemporaryFile(max_size=HELD) as way:
            for piece in self._edits(state):
                way.write(piece[::-1])
            self.texts.seek(0)
            at = NONE
            for end in range(self.rows, 0, -PIECE):
                start = max(0, end - PIECE)
                way.seek(start)
                for byte in reversed(way.read(end - start)):
                    for _ in range(byte & 3):
                        at = A if at == U else U
                        yield "I", ROLES[at], b""
                    edit, held = "DKR"[byte >> 2 & 3], byte >> 4
                    if held:
                        sizes = struct.unpack("<QQ", self.texts.read(16))
                        role, text = self.texts.read(sizes[0]), self.texts.read(sizes[1])
                    if edit == "D":
                        yield "D", b"", b""
                        continue
                    at = (A if at == U else U) if edit == "R" else INITIAL[role[:1].decode()]
                    yield edit, ROLES[at] if edit == "R" else role, text
        for _ in range(last):
            at = A if at == U else U
            yield "I", ROLES[at], b""

    def report(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        cost, edits = self.finish()
        digest, audit, first = hashlib.sha256(), [], True
        for edit, role, text in edits:
            audit.append(edit)
            if edit != "D":
                digest.update((b"" if first else b"\n") + role + b":" + text)
                first = False
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, *self.faults, self.illegal, cost, "".join(audit), digest.hexdigest()

    def close(self) -> None:
        self.back.close()
        self.texts.close()


def _conversations(frames: Iterator[pd.DataFrame], held: int) -> Iterator[tuple[str | None, Repair]]:
    """Every conversation of a sorted partition with its program; state goes from batch to batch."""
    key, run, before = None, None, None
    for frame in frames:
        for conv, turn, role, text, fault, gone in zip(*(frame[c] for c in ("conv", "turn", "role", "text", "fault", "gone"))):
            if run is None or conv != key:
                if run is not None:
                    yield key, run
                    run.close()
                key, run, before = conv, Repair(held), None
            if gone:
                continue
            own = (turn, role, text)
            # Equal rows of one turn are neighbours.
            run.add(None if turn is None else int(turn), role, text, 2 if fault != 1 and own == before else fault)
            before = own
    if run is not None:
        yield key, run
        run.close()


def _prepared(rows: DataFrame) -> DataFrame:
    """Sorted rows with their faults: 1 blank, 2 equal to a row of an earlier turn, 3 truncated.

    A column ``gone`` marks rows that say no more than that their conversation exists.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    rows = rows.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"),
    )
    bare = F.rtrim("text", F.lit(BLANK))
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in ("conv", "role", "text")]
    rows = rows.withColumn("end", F.substring(bare, -1, 1)).withColumn("own", F.when(~F.col("gone") & (F.col("end") != ""), F.sha2(F.concat(*parts), 256)))
    turn = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    again = rows.filter("own IS NOT NULL").groupBy("own").agg(F.min(turn).alias("first"), F.max(turn).alias("last")).filter("first != last").select("own", "first")
    rows = rows.join(again, "own", "left")
    later = F.coalesce(turn != F.col("first"), F.lit(False))
    fault = F.when(F.col("end") == "", 1).when(later, 2).when(~F.col("end").isin(".", "!", "?"), 3).otherwise(0)
    rows = rows.select("conv", "turn", "role", "text", fault.alias("fault"), "gone")
    rows = rows.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text")
    return rows.withColumn("turn", F.col("turn").cast("string"))


def report(rows: DataFrame, held: int = HELD) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of every conversation of ``rows`` (conv_id, turn, role, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for conv, program in _conversations(frames, held):
            out.append((conv, *program.report()))
            if len(out) == 1024:
                yield pd.DataFrame(out, columns=["conv", *COUNTS, "audit", "repaired_sha256"])
                out = []
        yield pd.DataFrame(out, columns=["conv", *COUNTS, "audit", "repaired_sha256"])

    found = _prepared(rows).mapInPandas(run, REPORT)
    return found.select(F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *COUNTS, "audit", "repaired_sha256")


def repair(rows: DataFrame, held: int = HELD) -> DataFrame:
    """The repaired turns: (conv_id, place from 0, edit K, R or I, role, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv", "place", "edit", "role", "text"]
        for conv, program in _conversations(frames, held):
            out, place, size = [], 0, 0
            for edit, role, text in program.finish()[1]:
                if edit != "D":
                    out.append((conv, place, edit, role.decode(errors="surrogatepass"), text.decode(errors="surrogatepass")))
                    place, size = place + 1, size + len(text)
                if len(out) == 4096 or size > held:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    found = _prepared(rows).mapInPandas(run, TURNS)
    return found.select(F.col("conv").cast(rows.schema["conv_id"].dataType).alias("conv_id"), "place", "edit", "role", "text")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with faults by CRC-32 of ``conv_id:turn`` modulo 20, as the query over clean tables wants.

    0 drops a row (it stays, marked ``gone``, as the trace of its conversation), 1 empties its
    text, 2 takes out its full stops, question and exclamation marks, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(named.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    kept = rows.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind <= 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return kept.drop("copy")
