"""Three-way merge of branches by a sweep over sorted units.

A document is cut into units: the row itself, each column, each line, the gap behind each line. Every version is tagged: the
base has a row for each unit, a branch one for each unit that it changes. Rows are dealt by document and sorted by unit and
branch; then three cursors move through each task's rows together, one unit at a time, and only a document's counts and merged
lines are held. A unit that one branch changes, or both alike, is a clean change; else it is a conflict and the left state is taken.
A row that a branch drops is one unit as a whole: a conflict if the other one keeps it changed.

Rows of one document go to one task, so what a task holds together is bounded by a text. Rows are known by id, a hash of their
content, and the partition that read them: rows that repeat an id are documents of their own, copies within a partition are
counted and come out as often, and copies in other partitions go to other tasks. Added rows that repeat an id are the least of their
branch, found by an aggregate before the sort. An added row whose id the base has too is a row of its own.

Null text, lang and source count as empty. A null id counts as an empty one in what branches draw from it, and adds no row; nor
does an id whose added one would leave 64 bits. An empty table gives no row. Extra columns take no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import only, rows_of

BASE, LEFT, RIGHT = 0, 1, 2
#: Units before a document's lines; line i is 2 i and the gap behind it 2 i + 1.
ADDED, ROW, LANG, SOURCE = -4, -3, -2, -1
#: What a synthetic branch draws for each unit: the remainder of a checksum.
REMAINDERS = 17
MARKS = {1: "!", 2: "?"}
#: How far a branch's added rows are from the row that they stand behind.
ADDED_AT = {LEFT: 0, RIGHT: 4}

KEY = ["doc_id", "part", "hash"]
UNIT = "struct<unit:bigint,branch:int,value:string>"


def _unit(unit: Column, branch: int, value: Column) -> Column:
    return F.struct(unit.cast("long").alias("unit"), F.lit(branch).alias("branch"), value.cast("string").alias("value"))


def _drawn(branch: int, name: Column) -> Column:
    """What a branch draws for a unit."""
    text = F.concat(F.lit("L:" if branch == LEFT else "R:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), name)
    return F.crc32(text.cast("binary")) % REMAINDERS


def _keyed(docs: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = only(docs, "doc_id", "text", "lang", "source").select(F.col("doc_id").cast("long").alias("doc_id"), blank("text"), blank("lang"), blank("source"))
    return rows.withColumns({"part": F.spark_partition_id(), "hash": F.xxhash64("text", "lang", "source")})


def _row_units() -> Column:
    """Of a document the units before its lines, in all versions."""
    found = [_unit(F.lit(u), BASE, v) for u, v in ((ROW, F.lit("")), (LANG, F.col("lang")), (SOURCE, F.col("source")))]
    for branch in (LEFT, RIGHT):
        found.append(F.when(_drawn(branch, F.lit("row")) == 0, _unit(F.lit(ROW), branch, F.lit(None))))
        for unit, name in ((LANG, "lang"), (SOURCE, "source")):
            code, old = _drawn(branch, F.lit(name)), F.col(name)
            new = F.when(code == 0, "").when(code == 1, F.concat(old, F.lit(MARKS[1]))).when(code == 2, F.concat(old, F.lit(MARKS[2])))
            found.append(F.when(new != old, _unit(F.lit(unit), branch, new)))
    return F.array_compact(F.array(*found))


def _line_units() -> Column:
    """Of a line (i, line) the unit of each version; a branch changes the line or inserts one behind it."""
    found = [_unit(2 * F.col("i"), BASE, F.col("line"))]
    for branch in (LEFT, RIGHT):
        code, at = _drawn(branch, F.col("i").cast("string")), 2 * F.col("i").cast("long")
        change = F.when(code == 0, _unit(at, branch, F.lit(None)))
        for k, mark in MARKS.items():
            change = change.when(code == k, _unit(at, branch, F.concat("line", F.lit(mark)))).when(code == k + 2, _unit(at + 1, branch, F.lit(mark)))
        found.append(change)
    return F.array_compact(F.array(*found))


def _added(rows: DataFrame) -> DataFrame:
    """The units of rows that branches add: an id's least one of each branch."""
    found = []
    for branch, far in ADDED_AT.items():
        code = _drawn(branch, F.lit("row"))
        for k, mark in MARKS.items():
            made = F.struct(F.try_subtract(F.bitwise_not("doc_id"), F.lit(far).cast("long")).alias("id"), F.lit(branch).alias("branch"), F.to_json(F.array("lang", "source", F.lit(mark))).alias("value"))
            found.append(F.when(code == k + 2, made))
    each = rows.select(F.inline(F.array_compact(F.array(*found)))).filter("id IS NOT NULL").groupBy("id", "branch").agg(F.min("value").alias("value"))
    return each.select(F.col("id").alias("doc_id"), F.lit(-1).alias("part"), F.lit(0).cast("long").alias("hash"), F.lit(ADDED).cast("long").alias("unit"), "branch", "value")


def versions(docs: DataFrame) -> DataFrame:
    """The units of the base and of two synthetic branches: doc_id, part, hash, unit, branch, value (null: dropped)."""
    rows = _keyed(docs)
    lines = rows.select(*KEY, F.posexplode(F.split("text", "\n")).alias("i", "line")).select(*KEY, F.inline(_line_units()))
    return rows.select(*KEY, F.inline(_row_units())).unionByName(lines).unionByName(_added(rows))


class _Sweep:
    """The documents of sorted rows, one after another."""

    def __init__(self):
        self.out: list[tuple] = []
        self.size = 0
        self.key = None
        self.unit: int | None = None

    def begin(self, key: tuple) -> None:
        self.close()
        self.key, self.unit = key, None
        self.copies, self.there = 0, False
        self.drops = [False, False, False]
        self.changed = [False, False, False]
        self.clean = self.edit_edit = self.edit_delete = self.insert_insert = 0
        self.columns = {LANG: "", SOURCE: ""}
        self.lines: list[str] = []

    def row(self, unit: int, branch: int, value: str | None) -> None:
        """The cursor of ``branch`` stands at a row of ``unit``."""
        if unit != self.unit:
            self.settle()
            self.unit, self.states = unit, {}
        if unit == ROW and branch == BASE:
            self.copies += 1
        self.states[branch] = value

    def settle(self) -> None:
        """All three cursors have passed a unit: merge its states."""
        unit = self.unit
        if unit is None:
            return
        states = self.states
        if len(states) == 1 and BASE in states:  # as the base has it
            if unit == ROW:
                self.there = True
            elif unit < 0:
                self.columns[unit] = states[BASE]
            else:
                self.lines.append(states[BASE])
            return
        left, right = LEFT in states, RIGHT in states
        if unit == ROW:
            self.drops, self.there = [False, left, right], True
            return
        self.changed[LEFT] |= left
        self.changed[RIGHT] |= right
        if self.drops[RIGHT]:  # then only the left version can remain
            state = states[LEFT] if left else states.get(BASE)
        else:
            state = states[LEFT] if left else states[RIGHT]
            if left and right and states[LEFT] != states[RIGHT]:
                if BASE not in states:
                    self.insert_insert += 1
                elif states[LEFT] is None or states[RIGHT] is None:
                    self.edit_delete += 1
                else:
                    self.edit_edit += 1
            else:
                self.clean += 1
        if unit == ADDED:
            self.copies, self.there = 1, True
            lang, source, text = json.loads(state)
            self.columns = {LANG: lang, SOURCE: source}
            self.lines = [text]
        elif unit < 0:
            self.columns[unit] = state
        elif state is not None:
            self.lines.append(state)

    def close(self) -> None:
        if self.key is None:
            return
        self.settle()
        counts = (self.clean, self.edit_edit, self.edit_delete, self.insert_insert)
        absent = False
        if self.drops[LEFT] or self.drops[RIGHT]:
            kept_changed = (not self.drops[LEFT] and self.changed[LEFT]) or (not self.drops[RIGHT] and self.changed[RIGHT])
            counts = (0, 0, 1, 0) if kept_changed else (1, 0, 0, 0)
            absent = self.drops[LEFT] or not kept_changed
        if self.there:
            text = None if absent else "\n".join(self.lines)
            state = (None, None, None) if absent else (self.columns[LANG], self.columns[SOURCE], text)
            self.out += [(self.key[0], *state, *counts)] * max(1, self.copies)
            self.size += len(text or "") * max(1, self.copies)
        self.key = None


SCHEMA = "doc_id long, lang string, source string, text string, n_clean long, n_edit_edit long, n_edit_delete long, n_insert_insert long"
#: Characters of merged texts that a task holds before it hands them on.
HELD = 1 << 22


def merge(units: DataFrame) -> DataFrame:
    """doc_id, lang, source, text (nulls: the row is gone) and the counts of clean changes and conflicts, from ``versions``' units."""
    kinds = [pa.int64(), *[pa.string()] * 3, *[pa.int64()] * 4]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = _Sweep()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*sweep.out, strict=True), kinds, strict=True)], names)
            sweep.out, sweep.size = [], 0
            return out

        for doc_id, part, hash_, unit, branch, value in rows_of(batches, 1024):
            for key, u, b, v in zip(zip(doc_id, part, hash_, strict=True), unit, branch, value, strict=True):
                if key != sweep.key:
                    sweep.begin(key)
                sweep.row(u, b, v)
            if sweep.size > HELD or len(sweep.out) > 1024:
                yield handed()
        sweep.close()
        if sweep.out:
            yield handed()

    tagged = units.select(*KEY, "unit", "branch", "value")
    return tagged.repartition(*KEY).sortWithinPartitions(*KEY, "unit", "branch").mapInArrow(run, SCHEMA)


def digests(docs: DataFrame) -> DataFrame:
    """The merge of two synthetic branches of the documents, with the text's SHA-256 in its place."""
    text = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    return merge(versions(docs)).select("doc_id", "lang", "source", text, "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")
