"""Repair of conversations: the cheapest edits that make the roles alternate.

Rows are dealt out by conversation and sorted by turn (nulls first), then role and text,
so every conversation streams through one task row by row. A dynamic program over the
four places that a conversation can be in (nothing yet, after the system's row, after a
user's, after an assistant's) carries, from row to row and from Arrow batch to Arrow
batch, the cost of the cheapest edits that lead to each place and how their audit strings
compare; two edit strings of equal cost are never prefixes of each other, so the order
once found stays. What the program decides at a row depends only on the row's class and
on those few numbers, so steps are remembered and a row costs one look-up.

Each row leaves a compact backpointer: one number for the four places. A conversation's
backpointers and rows stay in memory up to ``buffer`` bytes; a giant one's go to files in
the cluster's shared folder, segment by segment, are read back from the last segment to
the first to find the edits and once more in order to write the repaired rows, and are
then deleted. Memory holds one segment and the audit string, a byte an edit.

Faults (a row's first counts): blank (no character but ASCII white space), duplicate
(role and text seen earlier in the conversation), truncated (last character that is no
white space is none of ``.!?``). Edits: Keep 0, Rerole to user or assistant 1, Delete 2
(the only one for blank and duplicate rows), Insert an empty user's or assistant's row 5;
truncated rows that stay add 5. The result's role initials read ``(s?(ua)+)?``.

Null roles and texts count as one space; null ids are one conversation; null turns come
first and count for no gap; equal rows are duplicates; other columns are neither read nor
changed; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from helixframe.llm import files
from helixframe.llm.text import SPACES
from helixframe.session import shared_dir

BUFFER = 32 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = SPACES.decode()
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
TURN_OF = {USER: "user", ASSISTANT: "assistant"}
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
OUT_DDL = ", ".join(f"{c} long" for c in REPORT) + ", audit string, repaired_sha256 string, seq long, role string, text string"
State = tuple[tuple[int, int, int], ...]  # (place, cost above the least, rank of its audit), by place
FIRST: State = ((START, 0, 0),)


def insertions(place: int) -> Iterator[tuple[int, int]]:
    """Number of inserted rows and the place they lead to; more than two come back to where they began."""
    for n in range(3):
        yield n, place
        place = AFTER[place]["a" if place == USER else "u"]


def moves(place: int, kind: str) -> Iterator[tuple[str, int, int]]:
    """Edit, cost and next place for a row of this class at a place."""
    yield "D", DELETE, place
    if kind != "-":
        late = TRUNCATED if kind[1] == "!" else 0
        for to, after in AFTER[place].items():
            if to == kind[0]:
                yield "K", KEEP + late, after
            elif after in TURN_OF:
                yield "R", REROLE + late, after


@cache
def step(state: State, kind: str) -> tuple[State, int, int]:
    """Next state, what the least cost grew by, and the number of the backpointer."""
    best: dict[int, tuple] = {}
    for place, cost, rank in state:
        for n, between in insertions(place):
            for edit, price, after in moves(between, kind):
                entry = (cost + n * INSERT + price, rank, "I" * n + edit, place)
                if after not in best or entry < best[after]:
                    best[after] = entry
    least = min(e[0] for e in best.values())
    ranks = {after: i for i, after in enumerate(sorted(best, key=lambda a: best[a][1:3]))}
    pointer = tuple((after, best[after][3], best[after][2]) for after in sorted(best))
    return tuple((after, best[after][0] - least, ranks[after]) for after in sorted(best)), least, pointer_number(pointer)


POINTERS: list[dict[int, tuple[int, str]]] = []
_numbers: dict[tuple, int] = {}


def pointer_number(pointer: tuple) -> int:
    if pointer not in _numbers:
        _numbers[pointer] = len(POINTERS)
        POINTERS.append({after: (before, edits) for after, before, edits in pointer})
    return _numbers[pointer]


def ending(state: State) -> tuple[int, int, str]:
    """Cost above the least, place and last insertions of the cheapest allowed end."""
    best = min((cost + n * INSERT, rank, "I" * n, place) for place, cost, rank in state for n, at in insertions(place) if at in (START, ASSISTANT))
    return best[0], best[3], best[2]


def row_class(role: str, text: str, again: bool) -> tuple[str, str | None]:
    """Class for the dynamic program, and the row's fault."""
    end = text.rstrip(BLANKS)[-1:]
    if not end:
        return "-", "blank"
    if again:
        return "-", "duplicate"
    late = end not in ".!?"
    return (role[:1] if role[:1] in ("s", "u", "a") else "?") + ("!" if late else "."), "truncated" if late else None


class Conversation:
    """Faults, dynamic program and buffered rows of one conversation."""

    def __init__(self, key: str | None, folder: str, buffer: int):
        self.key, self.folder, self.buffer = key, folder, buffer
        self.count = dict.fromkeys(REPORT, 0)
        self.state, self.pointers, self.rows, self.held, self.before = FIRST, array("H"), [], 0, None
        self.turns: list[int] = []  # first, last, number of distinct ones
        self.segments: list[tuple[str, int]] = []

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        kind, fault = row_class(role, text, again)
        if fault:
            self.count[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.count["illegal"] += 1
        self.before = role[:1]
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1:] = [turn, self.turns[2] + 1]
        self.state, grown, pointer = step(self.state, kind)
        self.count["cost"] += grown
        self.pointers.append(pointer)
        self.rows.append((role, text))
        self.held += 2 * len(text) + 100
        if self.held > self.buffer:
            self.spill()

    def spill(self) -> None:
        """Move the buffered rows and their backpointers to a file in the shared folder."""
        uri = f"{self.folder}/{uuid.uuid4().hex}"
        used = sorted(set(self.pointers))
        table = [[(after, *POINTERS[p][after]) for after in POINTERS[p]] for p in used]
        small = {p: i for i, p in enumerate(used)}
        head = zlib.compress(json.dumps([table, [small[p] for p in self.pointers]]).encode(), 1)
        with files.create(uri) as f:
            f.write(head)
            f.write(zlib.compress(json.dumps(self.rows).encode(), 1))
        self.segments.append((uri, len(head)))
        self.rows, self.pointers, self.held = [], array("H"), 0

    def finish(self, messages: bool) -> Iterator[tuple]:
        """Repaired rows where they are asked for, then the conversation's report."""
        above, place, last = ending(self.state)
        self.count["cost"] += above
        edits, place = trace([POINTERS[p] for p in self.pointers], place)
        parts = [edits]
        for uri, head in reversed(self.segments):
            table, pointers = json.loads(zlib.decompress(files.read_range(uri, 0, head)))
            table = [{after: (before, e) for after, before, e in entry} for entry in table]
            edits, place = trace([table[p] for p in pointers], place)
            parts.append(edits)
        parts.reverse()
        digest, place, seq, audit = hashlib.sha256(), START, 0, []
        for i, edits in enumerate(parts):
            rows = self.rows if i == len(parts) - 1 else json.loads(zlib.decompress(files.read_all(self.segments[i][0])[self.segments[i][1]:]))
            for actions, (role, text) in [*zip(edits, rows), *([(last, ("", ""))] if last and i == len(parts) - 1 else [])]:
                for edit in actions:
                    if edit == "D":
                        continue
                    if edit == "K":
                        place = AFTER[place][role[:1]]
                        final = (role, text)
                    else:
                        place = AFTER[place]["a" if place == USER else "u"]
                        final = (TURN_OF[place], text if edit == "R" else "")
                    digest.update((b"\n" if seq else b"") + f"{final[0]}:{final[1]}".encode("utf-8", "surrogatepass"))
                    if messages:
                        yield (self.key, *[None] * (len(REPORT) + 2), seq, *final)
                    seq += 1
            audit.append("".join(edits))
        for uri, _ in self.segments:
            files.delete(uri)
        if self.turns:
            self.count["gaps"] = self.turns[1] - self.turns[0] + 1 - self.turns[2]
        yield (self.key, *[self.count[c] for c in REPORT], "".join(audit) + last, digest.hexdigest(), None, None, None)


def trace(pointers: list[dict[int, tuple[int, str]]], place: int) -> tuple[list[str], int]:
    """Edits of each row of a segment that ends at ``place``, and the place it began at."""
    edits = []
    for pointer in reversed(pointers):
        place, e = pointer[place]
        edits.append(e)
    return edits[::-1], place


def stream(folder: str, buffer: int, messages: bool, columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out = None, []
        for batch in batches:
            for key, absent, bare, turn, role, text, again in zip(*[batch[c] for c in batch.columns]):
                if now is None or key != now.key:
                    if now is not None:
                        for row in now.finish(messages):
                            out.append(row)
                            if len(out) >= 5_000:
                                yield pd.DataFrame(out, columns=columns, dtype=object)
                                out = []
                    now = Conversation(key, folder, buffer)
                if not absent:
                    now.add(None if bare else int(turn), role, text, again)
        if now is not None:
            out += now.finish(messages)
        if out:
            yield pd.DataFrame(out, columns=columns, dtype=object)

    return run


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           absent: Column | None = None, messages: bool = False, buffer: int = BUFFER) -> DataFrame:
    """One report per conversation; with ``messages`` also its repaired rows (seq, role, text; report columns null).

    ``absent``: rows for which it holds only name their conversation.
    """
    spark = rows.sparkSession
    content = rows.select(F.col(id_col).cast("string").alias("key"), F.coalesce(absent if absent is not None else F.lit(False), F.lit(False)).alias("absent"),
                          F.col(turn_col).isNull().alias("bare"), F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"),
                          F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"))
    order = [F.desc("absent"), F.desc("bare"), "turn", "role", "text"]
    same = W.partitionBy("key", "absent", "role", "text").orderBy(F.desc("bare"), "turn")
    sorted_rows = (content.repartition("key").withColumn("again", F.row_number().over(same) > 1)
                   .sortWithinPartitions("key", *order).select("key", "absent", "bare", "turn", "role", "text", "again"))
    id_type = rows.select(id_col).schema[0].dataType
    schema = StructType.fromDDL("key string, " + OUT_DDL)
    out = sorted_rows.mapInPandas(stream(shared_dir(spark, "backpointers"), buffer, messages, schema.names), schema)
    wanted = [F.col("key").cast(id_type).alias(id_col), *REPORT, "audit", "repaired_sha256"]
    return out.select(*wanted, "seq", "role", "text") if messages else out.select(*wanted)


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Faults for trial runs, set by the checksum of ``id:turn``: key, absent, turn, role and text of every row after damage."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    fault = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", blank)
    return rows.select(
        F.col(id_col), F.col(turn_col), (fault == 0).alias("absent"),
        F.when(fault == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")
