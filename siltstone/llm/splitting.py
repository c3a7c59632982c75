"""Pieces of oversized texts, cut at natural boundaries with an overlap (problem 3).

Texts are handled by ranges of bytes: those of a column as slices of its bytes, those of files
as reads at an offset, so that no task holds a whole file. A code point belongs to the range in
which its first byte lies. Workers look for boundaries in one range with a small halo on both
sides; what leaves a range is its number of code points, a thin table of boundary offsets and
the lengths of its boundary-free runs. The tables of a text then pass a planner in order, which
adds up the lengths, stitches runs over borders and keeps only the boundaries of the next two
pieces; a piece is emitted from the one range, with a halo of a piece's length, in which it
starts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.tables import latest, schema_with, table

LIMIT = 4000
OVERLAP = 200
SLACK = 40  # the overlap may be shorter by this much to begin at a word
#: Bytes of a range of a text in a column, and of a file.
RANGE, FILE_RANGE = 65_536, 4 << 20
#: Bytes on both sides of a range in which a boundary may go on; a code point has at most four.
HALO, WIDEST = 16, 4
CELL = 16  # of the boundaries of one cell the strongest, last one is kept

#: The characters that count as natural boundaries besides white space.
MARKS = ".!?;,。！？、"
BREAK = re.compile(rf"[\s{re.escape(MARKS)}]")
#: From strong to weak; a match ends where a piece may end.
KINDS = (
    (4, re.compile(r"\n[ \t\r\f]*\n\s*|\f\s*")),
    (3, re.compile(r"\n\s*")),
    (2, re.compile(r"[.!?][\"')\]]*\s+|[。！？]")),
    (1, re.compile(r"[;,、]\s*")),
    (0, re.compile(rf"\s+|[{re.escape(MARKS)}]")),
)


def boundaries(text: str, lead: int, size: int) -> list[tuple[int, int]]:
    """(offset, strength) of the boundaries of the ``size`` code points that follow ``lead``, thinned per cell.

    Offsets count from the start of the range; a boundary at 0 belongs to the range before.
    """
    best: dict[int, tuple[int, int]] = {}
    for strength, pattern in KINDS:
        for match in pattern.finditer(text):
            at = match.end() - lead
            if 0 < at <= size:
                cell = at // CELL
                if cell not in best or best[cell] < (strength, at):
                    best[cell] = (strength, at)
    return sorted((at, strength) for strength, at in best.values())


def runs(text: str) -> tuple[int, int, int]:
    """Lengths of the boundary-free run at the start, at the end and of the longest between."""
    last, inner, head = -1, 0, None
    for match in BREAK.finditer(text):
        at = match.start()
        if head is None:
            head = at
        else:
            inner = max(inner, at - last - 1)
        last = at
    if head is None:
        return len(text), len(text), len(text)
    return head, len(text) - last - 1, inner


def plan(offsets: np.ndarray, strengths: np.ndarray, length: int, limit: int = LIMIT, overlap: int = OVERLAP, start: int = 0, ahead: int | None = None) -> list[tuple[int, int, bool, int]]:
    """(start, end, forced, start of the next) of each piece: the strongest boundary of the window's latter half, else the last one, else the limit.

    With ``ahead`` the text goes on: only pieces that end so far before ``length`` are given.
    """
    pieces = []
    while length - start > limit + (0 if ahead is None else ahead):
        reach = start + limit
        first = np.searchsorted(offsets, start + overlap, side="right")
        stop = np.searchsorted(offsets, reach, side="right")
        if stop > first:
            half = np.searchsorted(offsets, start + limit // 2, side="right")
            lo = half if stop > half else first
            window = strengths[lo:stop]
            end = int(offsets[lo + np.flatnonzero(window == window.max())[-1]])
            forced = False
        else:
            end, forced = reach, True
        begin = end - overlap
        at = np.searchsorted(offsets, begin)
        if at < len(offsets) and begin <= offsets[at] <= begin + SLACK:
            begin = int(offsets[at])
        after = np.searchsorted(offsets, end, side="right")
        if after < len(offsets) and begin + limit < offsets[after] <= end + limit:
            begin = int(offsets[after]) - limit  # keeps the next natural boundary within reach
        pieces.append((start, end, forced, min(begin, end)))
        start = min(begin, end)
    if ahead is None:
        pieces.append((start, length, False, length))
    return pieces


@dataclass
class Planner:
    """Takes the tables of a text's ranges in order and gives its pieces; holds no more than the boundaries ahead."""

    at: int = 0  # code points seen
    start: int = 0  # of the piece to come
    run: int = 0
    longest: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    strengths: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    ranges: list[tuple[int, int]] = field(default_factory=list)  # (first code point, number) of the ranges from ``start`` on

    def take(self, part: dict) -> list[tuple[int, int, bool, int, int]]:
        """(start, end, forced, range, start within it) of the pieces that this range completes."""
        size = int(part["size"])
        if part["head"] == size:
            self.run += size
        else:
            self.longest = max(self.longest, self.run + int(part["head"]), int(part["inner"]))
            self.run = int(part["tail"])
        self.longest = max(self.longest, self.run)
        self.ranges.append((self.at, int(part["number"])))
        self.offsets = np.concatenate((self.offsets, np.asarray(part["offsets"], dtype=np.int64) + self.at))
        self.strengths = np.concatenate((self.strengths, np.asarray(part["strengths"], dtype=np.int64)))
        self.at += size
        # a piece and the boundary after it are known once two pieces' lengths have been seen
        return self.placed(plan(self.offsets, self.strengths, self.at, start=self.start, ahead=LIMIT))

    def rest(self) -> list[tuple[int, int, bool, int, int]]:
        return self.placed(plan(self.offsets, self.strengths, self.at, start=self.start)) if self.at > LIMIT else []

    def placed(self, pieces: list[tuple[int, int, bool, int]]) -> list[tuple[int, int, bool, int, int]]:
        out = []
        for start, end, forced, following in pieces:
            while len(self.ranges) > 1 and self.ranges[1][0] <= start:
                self.ranges.pop(0)
            out.append((start, end, forced, self.ranges[0][1], start - self.ranges[0][0]))
            self.start = following
        keep = np.searchsorted(self.offsets, self.start)
        self.offsets, self.strengths = self.offsets[keep:], self.strengths[keep:]
        return out


def slices(texts: DataFrame, key: str, text: str, left: int, right: int) -> DataFrame:
    """One row per range of bytes of a text: number, bytes before it, and its bytes with ``left`` and ``right`` around."""
    raw = texts.select(key, F.col(text).cast("binary").alias("_b")).select(key, "_b", F.octet_length("_b").alias("_n"))
    cut = raw.select(key, "_b", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(RANGE))).alias("_from"))
    lead: Column = F.least(F.lit(left), F.col("_from"))
    size = F.least(F.lit(RANGE), F.col("_n") - F.col("_from"))
    return cut.select(key, (F.col("_from") / RANGE).cast("int").alias("number"), lead.alias("lead"), size.alias("core"), F.substring(F.col("_b"), F.col("_from") - lead + 1, lead + size + right).alias("raw"))


def first_byte(raw: bytes, at: int) -> int:
    """The place of the first code point that begins at ``at`` or later."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def ranged(raw: bytes, lead: int, core: int) -> tuple[str, int, int]:
    """The range with its halos as text, the code points before it, and its own."""
    begin, end = first_byte(raw, lead) if lead else 0, first_byte(raw, lead + core)
    before = raw[first_byte(raw, 0) if lead else 0 : begin].decode("utf-8", "replace")
    own = raw[begin:end].decode("utf-8", "replace")
    return before + own + raw[end:].decode("utf-8", "replace"), len(before), len(own)


TABLE = "number int, size int, offsets array<int>, strengths array<int>, head int, tail int, inner int"
PLANNED = "piece_no int, start_at long, end_at long, forced boolean, number int, local int, cut string"


def boundary_table(raw: bytes, lead: int, core: int) -> tuple:
    """What a range gives away: code points, boundaries and run lengths."""
    text, before, size = ranged(raw, lead, core)
    found = boundaries(text, before, size)
    return (size, [at for at, _ in found], [s for _, s in found], *runs(text[before : before + size]))


def planned_from(tables: DataFrame, key: str) -> DataFrame:
    """The pieces of each text, and after them a row without piece number that says how it is cut; no rows for texts within the limit.

    The tables of a text stand in one task in order, but pass it one by one.
    """

    def plan_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, planner, number = None, None, 0

        def rows(pieces: list[tuple[int, int, bool, int, int]]) -> list[tuple]:
            nonlocal number
            out = [(name, number + i, a, b, forced, at, local, None) for i, (a, b, forced, at, local) in enumerate(pieces)]
            number += len(out)
            return out

        def close() -> list[tuple]:
            if planner is None or planner.at <= LIMIT:
                return []
            return [*rows(planner.rest()), (name, None, None, None, None, None, None, "forced" if planner.longest > LIMIT else "natural")]

        def frame(out: list[tuple]) -> pd.DataFrame:
            made = pd.DataFrame(out, columns=[key, "piece_no", "start_at", "end_at", "forced", "number", "local", "cut"])
            return made.astype({c: "Int64" for c in ("piece_no", "start_at", "end_at", "number", "local")} | {"forced": "boolean"})

        for batch in batches:
            out: list[tuple] = []
            for part in batch.to_dict("records"):
                if planner is None or part[key] != name:
                    out += close()
                    name, planner, number = part[key], Planner(), 0
                out += rows(planner.take(part))
            yield frame(out)
        yield frame(close())

    schema = schema_with(tables, key, PLANNED)
    return tables.repartition(key).sortWithinPartitions(key, "number").mapInPandas(plan_all, schema)


def planned_ranges(texts: DataFrame, key: str, text: str) -> DataFrame:
    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(name, number, *boundary_table(raw, lead, core)) for name, number, lead, core, raw in zip(batch[key], batch["number"], batch["lead"], batch["core"], batch["raw"], strict=True)]
            yield pd.DataFrame(found, columns=[key, "number", "size", "offsets", "strengths", "head", "tail", "inner"])

    return planned_from(slices(texts, key, text, HALO, HALO).mapInPandas(detect, schema_with(texts, key, TABLE)), key)


def planned(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key and cut of every text over the limit."""
    return planned_ranges(texts, key, text).where("piece_no IS NULL").select(key, "cut")


PIECES = "piece_no int, start_at long, end_at long, forced boolean, piece string"


def pieces_of(name: object, raw: bytes, lead: int, core: int, pieces: list) -> list[tuple]:
    """The pieces that start in a range."""
    text, before, _ = ranged(raw, lead, core)
    return [(name, p["piece_no"], p["start_at"], p["end_at"], p["forced"], text[before + p["local"] : before + p["local"] + p["end_at"] - p["start_at"]]) for p in pieces]


def by_range(plan_: DataFrame, key: str) -> DataFrame:
    """The pieces that start in each range in one row; there are few, as each but the last moves on by half a limit."""
    wanted = F.struct("piece_no", "start_at", "end_at", "forced", "local")
    return plan_.where("piece_no IS NOT NULL").groupBy(key, "number").agg(F.collect_list(wanted).alias("pieces"))


def split_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, piece_no (from 0), start_at, end_at, forced and piece of every text over the limit.

    Texts of at most ``LIMIT`` code points, nulls included, give no rows: they need no cut. A text
    without any boundary is cut at the limit. Every piece holds at most ``LIMIT`` code points, and
    each after the first begins at most ``OVERLAP`` before the end of the one before; the overlap
    is shortened to begin at a word, or where otherwise the next boundary would be out of reach.
    """
    long = texts.where(F.length(text) > LIMIT)
    bodies = slices(long, key, text, WIDEST, WIDEST * (LIMIT + 1))
    joined = by_range(planned_ranges(long, key, text), key).join(bodies, [key, "number"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [row for name, pieces, lead, core, raw in zip(batch[key], batch["pieces"], batch["lead"], batch["core"], batch["raw"], strict=True) for row in pieces_of(name, raw, lead, core, pieces)]
            yield pd.DataFrame(out, columns=[key, "piece_no", "start_at", "end_at", "forced", "piece"])

    return joined.select(key, "pieces", "lead", "core", "raw").mapInPandas(emit, schema_with(long, key, PIECES))


def split_files(spark: SparkSession, folder: str, step: int = FILE_RANGE) -> DataFrame:
    """path, piece_no, start_at, end_at, forced and piece of every UTF-8 file below a folder that is over the limit.

    Files are listed without their content; each task reads its range of ``step`` bytes at its
    offset, once for the boundaries and once for the pieces, through the file system that the
    path names. Empty files give no rows; bytes that are no UTF-8 count as replacement characters.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes")).where("bytes > 0")
    ranges = listed.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("begin"))
    ranges = ranges.select("path", "bytes", "begin", (F.col("begin") / step).cast("int").alias("number")).repartition("path", "number")

    def read(path: str, size: int, begin: int, left: int, right: int) -> tuple[bytes, int, int]:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
        lead, core = min(left, begin), min(step, size - begin)
        with system.open_input_file(place) as source:
            source.seek(begin - lead)
            return source.read(lead + core + right), lead, core

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, begin, number in zip(batch["path"], batch["bytes"], batch["begin"], batch["number"], strict=True):
                yield pd.DataFrame([(path, number, *boundary_table(*read(path, size, begin, HALO, HALO)))], columns=["path", "number", "size", "offsets", "strengths", "head", "tail", "inner"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, begin, pieces in zip(batch["path"], batch["bytes"], batch["begin"], batch["pieces"], strict=True):
                out = pieces_of(path, *read(path, size, begin, WIDEST, WIDEST * (LIMIT + 1)), pieces)
                yield pd.DataFrame(out, columns=["path", "piece_no", "start_at", "end_at", "forced", "piece"])

    planned_ = planned_from(ranges.mapInPandas(detect, f"path string, {TABLE}"), "path")
    return by_range(planned_, "path").join(ranges, ["path", "number"]).select("path", "bytes", "begin", "pieces").mapInPandas(emit, f"path string, {PIECES}")


def long_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id and body of the oversized chunks, each id as delivered last; only their bodies are shuffled."""
    chunks = table(spark, folder, "asset_chunks").where(F.col("id").isNotNull())
    slim = chunks.select(F.col("id").alias("chunk_id"), "updated_at", F.when(F.length("body") > LIMIT, F.col("body")).alias("body"))
    return latest(slim, "chunk_id", "updated_at").where(F.col("body").isNotNull()).select("chunk_id", "body")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return planned(long_chunks(spark, folder), "chunk_id", "body")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(long_chunks(spark, folder), "chunk_id", "body")


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
SQL = {
    "p3_found": """
WITH last AS (
  SELECT id, arg_max(body, updated_at) AS body FROM asset_chunks WHERE id IS NOT NULL GROUP BY id
), long AS (
  SELECT id, list_max(list_transform(string_split_regex(body, '[\\s\\pZ.!?;,。！？、\\x0b\\x1c-\\x1f\\x85]'), lambda x: length(x))) AS run
  FROM last WHERE length(body) > 4000
)
SELECT id AS chunk_id, CASE WHEN run > 4000 THEN 'forced' ELSE 'natural' END AS cut FROM long
"""
}
