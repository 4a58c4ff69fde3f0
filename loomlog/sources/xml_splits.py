"""Row elements of XML files of any size and shape, whatever the splits.

Files are read as pieces that end at ``>``, so a file without line ends splits
too.  A state machine runs over the pieces: outside of markup, in a comment, CDATA,
processing instruction, declaration, or inside a quoted value of a tag (which may hold ``>``),
of the row's own tag or another, and how many row elements are open.

1. Each split is summed up by what it does to every state it could begin in: the
   state it ends in, how many row elements it closes that it didn't open, and how
   many stay open.  These summaries, a row a split, are composed in order for
   each file, which gives each split the state it really begins in.
2. Each split runs again from there: rows inside it come out whole, the parts of a row that
   crosses splits come out with the split it began in, and are put together.

Only rows that cross splits are shuffled, and the memory of a task is one row, or a
split's part of one.  Nested elements of the row's name belong to the outer row; a
closing tag without an open row is ignored, a row that isn't closed at the
end of its file is left out.  Comments and CDATA inside a row stay in it as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomlog.sources.scans import configure

#: What a split may begin in: nothing, comment, CDATA, instruction, declaration, and a quoted value
#: (double, single) of the row's tag or of another tag.
OUT, COMMENT, CDATA, INSTRUCTION, DECLARATION, ROW2, ROW1, TAG2, TAG1 = range(9)
STATES = range(9)
_ENDS = {COMMENT: "--", CDATA: "]]", INSTRUCTION: "?"}
_OPENS = (("<!--", COMMENT), ("<![CDATA[", CDATA), ("<?", INSTRUCTION))
_QUOTED = re.compile("\"[^\"]*\"|'[^']*'")

_FILE = [T.StructField("file", T.StringType()), T.StructField("part", T.LongType())]
SUMMARY = T.StructType([*_FILE, T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("closed", T.ArrayType(T.LongType())), T.StructField("opened", T.ArrayType(T.LongType()))])
ENTRY = T.StructType([*_FILE, T.StructField("state", T.IntegerType()), T.StructField("depth", T.LongType()), T.StructField("began", T.LongType())])
#: ``began``: where the row begins; ``closed``: whether it ends here.
FOUND = T.StructType([*_FILE, T.StructField("began", T.LongType()), T.StructField("xml", T.StringType()), T.StructField("closed", T.BooleanType())])
#: Rows of a batch that is handed back.
BATCH = 2000


class Machine:
    """Steps over pieces, for one name of row elements."""

    def __init__(self, row: str):
        self.opens = re.compile(f"<{re.escape(row)}(?=[\\s/]|$)").match
        self.closes = re.compile(f"</{re.escape(row)}\\s*$").match

    def step(self, state: int, piece: str) -> tuple[int, int, int]:
        """(state after ``piece`` and its ``>``, event, where in the piece a row begins).

        Events: 1 a row opens, -1 a row closes, 2 a row opens and closes, 0 none.
        """
        if state in _ENDS:
            return (OUT if piece.endswith(_ENDS[state]) else state), 0, 0
        if state == DECLARATION:
            return (OUT if piece.rstrip().endswith("]") else state), 0, 0
        if state == OUT:
            at = piece.find("<")
            if at < 0:
                return OUT, 0, 0
            tag = piece[at:] if at else piece
            if tag[1:2] in ("!", "?"):
                for opening, inside in _OPENS:
                    if tag.startswith(opening):
                        return (OUT if tag.endswith(_ENDS[inside], len(opening)) else inside), 0, 0
                return (DECLARATION if "[" in tag and not tag.rstrip().endswith("]") else OUT), 0, 0
            if self.closes(tag):
                return OUT, -1, 0
            mine = self.opens(tag) is not None
            after = self._tag(tag, mine)
            return after, (2 if after == OUT and tag.endswith("/") else 1) if mine else 0, at
        mine = state in (ROW2, ROW1)
        quote = '"' if state in (ROW2, TAG2) else "'"
        at = piece.find(quote)
        if at < 0:
            return state, 0, 0
        after = self._tag(piece[at + 1 :], mine)
        return after, -1 if mine and after == OUT and piece.endswith("/") else 0, 0

    @staticmethod
    def _tag(text: str, mine: bool) -> int:
        """The state after a tag's text outside of quotes: OUT, or inside the quoted value that isn't closed."""
        if '"' not in text and "'" not in text:
            return OUT
        left = _QUOTED.sub("", text)
        two, one = left.find('"'), left.find("'")
        if two < 0 and one < 0:
            return OUT
        double = two >= 0 and (one < 0 or two < one)
        return (ROW2 if mine else TAG2) if double else (ROW1 if mine else TAG1)


class _Summary:
    """What a split does, from each state; states that have met go on together."""

    def __init__(self, machine: Machine):
        self.step = machine.step
        self.now = {s: [s] for s in STATES}  # state reached: those begun in
        self.closed, self.opened = [0] * len(STATES), [0] * len(STATES)

    def add(self, piece: str) -> None:
        moved = []
        for state, begun in self.now.items():
            if state in _ENDS and not piece.endswith(_ENDS[state]):
                continue
            after, event, _ = self.step(state, piece)
            if event in (1, -1):
                for s in begun:
                    if event == 1:
                        self.opened[s] += 1
                    elif self.opened[s]:
                        self.opened[s] -= 1
                    else:
                        self.closed[s] += 1
            if after != state:
                moved.append((state, after))
        if moved:
            leaving = [(after, self.now.pop(state)) for state, after in moved]
            for after, begun in leaving:
                self.now[after] = self.now.get(after, []) + begun

    def row(self) -> tuple[list[int], list[int], list[int]]:
        ends = [0] * len(STATES)
        for state, begun in self.now.items():
            for s in begun:
                ends[s] = state
        return ends, self.closed, self.opened


def _pieces(spark: SparkSession, paths: Sequence[str], options: dict[str, str]) -> DataFrame:
    raw = spark.read.options(**options).option("lineSep", ">").text(list(paths))
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), "value")


def _by_split(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[str] | None]]:
    """(first ``width`` columns, pieces) of rows of equal (file, part), batch by batch; None for pieces at a split's end."""
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        same = [pa.compute.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
        bounds = [0, *(np.flatnonzero(same[0] | same[1]) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            new = tuple(batch.column(i)[lo].as_py() for i in range(width))
            if new != key:
                if key is not None:
                    yield key, None
                key = new
            yield key, batch.column(width).slice(lo, hi - lo).to_pylist()
    if key is not None:
        yield key, None


def _sums(row: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        machine = Machine(row)
        summary = _Summary(machine)
        for (file, part), pieces in _by_split(batches, 2):
            if pieces is None:
                yield pa.RecordBatch.from_pylist([dict(zip(SUMMARY.names, (file, part, *summary.row()), strict=True))], schema=to_arrow_schema(SUMMARY))
                summary = _Summary(machine)
            else:
                for piece in pieces:
                    summary.add(piece)

    return run


def _rows(row: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Second run, over columns file, part, state, depth, began, value: rows and parts of rows."""
    arrow = to_arrow_schema(FOUND)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches):
        machine, out, text, key = Machine(row), [], [], None
        state = depth = began = 0
        for (file, part, *entry), pieces in _by_split(batches, 5):
            if pieces is None:
                if depth and text:
                    out.append((file, part, began, "".join(text), False))
                key, text = None, []
                continue
            if key is None:
                key, (state, depth, began) = (file, part), entry
            for piece in pieces:
                state, event, at = machine.step(state, piece)
                if depth:
                    text += (piece, ">")
                elif event > 0:
                    began, text = part, [piece[at:], ">"]
                depth += 1 if event == 1 else -1 if event == -1 and depth else 0
                if text and not depth:
                    out.append((file, part, began, "".join(text), True))
                    text = []
            if len(out) >= BATCH:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return run


def entries(sums: DataFrame) -> DataFrame:
    """(file, part, state, depth, began) in which each split begins; ``sums``: a row a split.

    The splits of one file are composed in one task: some 200 bytes for each.
    """

    def compose(splits: pa.Table) -> pa.Table:
        out, state, depth, began = [], OUT, 0, 0
        for s in splits.sort_by("part").to_pylist():
            out.append({"file": s["file"], "part": s["part"], "state": state, "depth": depth, "began": began})
            left = max(depth - s["closed"][state], 0)
            began = began if left else s["part"]
            state, depth = s["ends"][state], left + s["opened"][state]
        return pa.Table.from_pylist(out, to_arrow_schema(ENTRY))

    return sums.groupBy("file").applyInArrow(compose, ENTRY)


def read_xml_rows(spark: SparkSession, paths: str | Sequence[str], row: str, **options: str) -> DataFrame:
    """(file, xml): the text of each row element of documents with or without a single root."""
    wanted = [paths] if isinstance(paths, str) else list(paths)
    pieces = _pieces(configure(spark), wanted, options)
    known = entries(pieces.mapInArrow(_sums(row), SUMMARY))
    # Spark broadcasts the entries if they are small, and else shuffles by split; within a split pieces keep their order
    ordered = pieces.withColumn("seq", F.monotonically_increasing_id()).join(known, ["file", "part"]).sortWithinPartitions("file", "part", "seq")
    found = ordered.select("file", "part", "state", "depth", "began", "value").mapInArrow(_rows(row), FOUND)
    here = F.col("began") == F.col("part")
    inside = found.filter(here & F.col("closed")).select("file", "xml")
    across = found.filter(~(here & F.col("closed"))).groupBy("file", "began").agg(F.array_sort(F.collect_list(F.struct("part", "xml"))).alias("parts"), F.bool_or("closed").alias("closed"))
    put = across.filter("closed").select("file", F.array_join(F.transform("parts", lambda p: p["xml"]), "").alias("xml"))
    return inside.unionByName(put)
