"""CSV rows as lists of text cells, without types or defaults, from many splits of one file.

A line break ends a row only outside of quotes, so what a split holds depends on all before it.
Spark's text source cuts files into splits at line breaks, and behind a line break the parser is in
one of two states: between rows, or inside a quoted cell.  A first pass reads every split under
both and notes how many rows end in it and in which state it leaves the parser.  Folding the notes
along each file (two short rows per split) gives the state and the number of rows before every
split, and a second pass parses all splits side by side.  Rows that reach over the end of a split
are put together from their parts.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_BATCH = 4096
_ROWS = pa.schema([("source_file", pa.string()), ("locator", pa.int64()),
                   ("is_header", pa.bool_()), ("cells", pa.list_(pa.string())),
                   ("fault", pa.string())])
_ROWS_SQL = ("source_file string, locator bigint, is_header boolean, cells array<string>, "
             "fault string")
_NOTES = pa.schema([("source_file", pa.string()), ("start", pa.int64()), ("state", pa.string()),
                    ("rows", pa.int64()), ("end", pa.string()), ("bad", pa.bool_())])
_NOTES_SQL = ("source_file string, start bigint, state string, rows bigint, end string, "
              "bad boolean")
_PLACES = pa.schema([("source_file", pa.string()), ("start", pa.int64()), ("state", pa.string()),
                     ("end", pa.string()), ("before", pa.int64()), ("rows", pa.int64()),
                     ("open", pa.int64()), ("bad", pa.bool_())])
_PLACES_SQL = ("source_file string, start bigint, state string, end string, before bigint, "
               "rows bigint, open bigint, bad boolean")
_PARTS = pa.schema([("source_file", pa.string()), ("locator", pa.int64()), ("start", pa.int64()),
                    ("text", pa.string()), ("bad", pa.bool_())])
_PARTS_SQL = "source_file string, locator bigint, start bigint, text string, bad boolean"
#: States behind a line break: between rows, in a quoted cell, behind quotes that do not fit.
BETWEEN, INSIDE, BROKEN = "between", "inside", "broken"


def pieces(line: str) -> Iterator[str]:
    """A line of the text source, with its break, cut at the other breaks of CSV rows."""
    if "\r" not in line:
        return iter((line + "\n",))
    return iter(io.StringIO(line + "\n", newline=""))


def behind(piece: str, state: str) -> str:
    """The state behind a piece; a row ends with it if that is BETWEEN."""
    if '"' not in piece or state == BROKEN:
        return state
    try:
        # An opening quote brings the parser into the state it has inside a quoted cell.
        next(_reader(['"' + piece if state == INSIDE else piece]))
    except csv.Error as error:
        return INSIDE if "unexpected end" in str(error) else BROKEN
    return BETWEEN


def _reader(text: Iterable[str]) -> Iterator[list[str]]:
    csv.field_size_limit(sys.maxsize)
    return csv.reader(text, strict=True)


def _cells(text: Iterable[str]) -> list[str] | None:
    try:
        return next(_reader(text))
    except csv.Error:
        return None


def _splits(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, bool]]]]:
    """Each split of a task: its columns besides the line, and its lines with whether they are
    UTF-8.  A task reads its splits one after another."""
    def rows() -> Iterator[dict]:
        for part in parts:
            for at in range(0, part.num_rows, _BATCH):
                yield from part.slice(at, _BATCH).to_pylist()

    def lines(group: Iterable[dict]) -> Iterator[tuple[str, bool]]:
        for row in group:
            try:
                yield row["line"].decode(), False
            except UnicodeDecodeError:
                yield row["line"].decode(errors="replace"), True

    for _, group in groupby(rows(), lambda r: (r["source_file"], r["start"])):
        first = next(group)
        yield first, lines(chain([first], group))


def _noted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for split, lines in _splits(parts):
        found = {BETWEEN: [BETWEEN, 0], INSIDE: [INSIDE, 0]}
        broken_utf8 = False
        for line, bad in lines:
            broken_utf8 |= bad
            for piece in pieces(line):
                for note in found.values():
                    note[0] = behind(piece, note[0])
                    note[1] += note[0] == BETWEEN
        yield _batch([(split["source_file"], split["start"], state, rows, end, broken_utf8)
                      for state, (end, rows) in found.items()], _NOTES)


def _folded(notes: pa.Table) -> pa.Table:
    """The true state, and the rows, before each split of one file."""
    by_start: dict[int, dict[str, dict]] = {}
    for note in notes.to_pylist():
        by_start.setdefault(note["start"], {})[note["state"]] = note
    state, before, out, bad = BETWEEN, 0, [], False
    for start in sorted(by_start):
        note = by_start[start].get(state) or {"rows": 0, "end": BROKEN, "bad": False}
        out.append((start, state, note["end"], before, note["rows"]))
        state, before = note["end"], before + note["rows"]
        bad |= next(iter(by_start[start].values()))["bad"]
    left_open = before if state == INSIDE else -1
    name = notes.column("source_file")[0].as_py()
    return pa.Table.from_batches([_batch([(name, *row, left_open, bad) for row in out], _PLACES)])


def _parsed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that begin and end in one split, and those whose quotes do not fit."""
    def rows() -> Iterator[tuple]:
        for split, lines in _splits(parts):
            name, state, number = split["source_file"], _known(split), split["before"]
            last, head, held = number + split["rows"], state == INSIDE, []
            for piece in (p for line, _ in lines for p in pieces(line)):
                if state == BROKEN or number == last and split["end"] != BROKEN:
                    break                   # the rest belongs to a row that ends elsewhere
                state = behind(piece, state)
                held.append(piece)
                if state == INSIDE:
                    continue
                if not head:
                    yield _row(name, number, held if state == BETWEEN else None, split["bad"])
                number, head, held = number + 1, False, []
        # Nothing is held here that is not in `_reaching` or left open.

    return _batches(rows(), _ROWS)


def _row(name: str, number: int, text: Iterable[str] | None, bad: bool) -> tuple:
    cells = None if text is None else _cells(text)
    if cells is None:
        return name, number, False, None, "quotes"
    return name, number, number == 0, cells, "utf8" if bad and number == 0 else None


def _known(split: dict) -> str:
    if split["state"] is None:
        raise ValueError(f"{split['source_file']} was cut differently when it was read again")
    return split["state"]


def _reaching(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of rows that reach over the end of a split, without a cell that is never closed."""
    def found() -> Iterator[tuple]:
        for split, lines in _splits(parts):
            state, number, held, head = _known(split), split["before"], [], True
            if state != INSIDE and split["end"] != INSIDE:
                continue
            head, name, last = state == INSIDE, split["source_file"], number + split["rows"]
            keep = lambda: (name, number, split["start"], "".join(held), split["bad"])
            for piece in (p for line, _ in lines for p in pieces(line)):
                if state == BROKEN or number == split["open"]:
                    held = []
                    break
                state = behind(piece, state)
                if head or number == last:
                    held.append(piece)
                if state != INSIDE:
                    if head:
                        yield keep()
                    number, head, held = number + 1, False, []
            if held:
                yield keep()

    return _batches(found(), _PARTS)


def _joined(parts: pa.Table) -> pa.Table:
    rows = sorted(parts.to_pylist(), key=lambda r: r["start"])
    text = io.StringIO("".join(r["text"] for r in rows), newline="")
    return pa.Table.from_batches([_batch(
        [_row(rows[0]["source_file"], rows[0]["locator"], text, rows[0]["bad"])], _ROWS)])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, locator, is_header, cells, fault), one row per row of the files.

    A row has exactly the cells its text has, empty ones included, and quoted cells may hold line
    breaks; a typed CSV reader would fill up or cut rows to its schema.  The first row of each file
    is its header.  fault names what is wrong with a file as a whole: utf8 (its bytes are no
    UTF-8), quotes (quotes that do not fit or a quoted cell that is not closed: the row has no
    cells and the file no rows behind it).

    A file is read in as many tasks as the text source has splits; no value is larger than a line
    or a cell.  The notes on the splits, of which there is one in about 128 MB, are broadcast.
    """
    lines = (spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line")))
    places = lines.mapInArrow(_noted, _NOTES_SQL).groupBy("source_file").applyInArrow(
        _folded, _PLACES_SQL)
    placed = lines.join(F.broadcast(places), ["source_file", "start"], "left")
    whole = placed.mapInArrow(_parsed, _ROWS_SQL)
    over = placed.mapInArrow(_reaching, _PARTS_SQL).groupBy("source_file", "locator").applyInArrow(
        _joined, _ROWS_SQL)
    unclosed = places.where("open >= 0").select(
        "source_file", F.col("open").alias("locator"), F.lit(False).alias("is_header"),
        F.lit(None).cast("array<string>").alias("cells"), F.lit("quotes").alias("fault")).distinct()
    return whole.unionByName(over).unionByName(unclosed)
