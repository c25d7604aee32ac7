"""Records that reach over line and split boundaries, read by all tasks at once.

A file is read in pieces that end at a separator, which Spark finds in any split: ``}`` for JSON
arrays, a line feed for CSV. Whether a separator ends a record depends on what came before it: an
open string, an open bracket. What a split does to that state is a function of the state at its
start; one pass gives each split's function, and a window over the splits of a file composes them, so
that a second pass can start in the right state everywhere. A record that begins in one split and
ends in a later one is put together from their fragments, a few for each split.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

ESCAPED = re.compile(r"\\.", re.S)
CLOSED = re.compile(r'(?:[^"]|"")*+"')
QUOTED = re.compile(r'(?:(?<![^,])|\A)"(?:[^"]|"")*+"')
OPENED = re.compile(r'(?<![^,])"')

#: Of a piece: the state after it (1: in a string) and the change of depth, from either state before it.
Step = tuple[tuple[int, int], tuple[int, int]]


def json_piece(value: str) -> Step:
    parts = (ESCAPED.sub("", value) if "\\" in value else value).split('"')
    depth = [x.count("{") + x.count("[") - x.count("]") - x.count("}") for x in parts]
    odd = (len(parts) - 1) % 2
    return (odd, sum(depth[::2])), (1 - odd, sum(depth[1::2]))


def csv_piece(value: str) -> Step:
    """A quote opens a value only where the value begins."""
    if '"' not in value:
        return (0, 0), (1, 0)
    outside = int(OPENED.search(QUOTED.sub("", value)) is not None)
    end = CLOSED.match(value)
    inside = int(end is None or OPENED.search(QUOTED.sub("", "." + value[end.end() :])) is not None)
    return (outside, 0), (inside, 0)


def _pieces(spark: SparkSession, files: list[str], separator: str) -> DataFrame:
    lines = spark.read.text(files, lineSep=separator)
    meta = [F.col(f"_metadata.file_{n}").alias(a) for n, a in (("path", "file"), ("block_start", "block"), ("size", "bytes"))]
    return lines.select(*meta, "value", (F.octet_length("value") + 1).cast("long").alias("size"))


SUMMARY = "file string, block long, bytes long, n long, size long, end0 long, depth0 long, end1 long, depth1 long"
START = "file string, block long, state long, depth long, last long"


def _schema(text: str) -> pa.Schema:
    types = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, types[t]) for n, t in (x.split() for x in text.split(", "))])


def _summaries(scan: Callable[[str], Step], closes: int):
    """What each split does to either state; a separator outside a string lowers the depth by ``closes``."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], dict] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key = row["file"], row["block"]
                own = found.setdefault(key, {"file": key[0], "block": key[1], "bytes": row["bytes"], "n": 0, "size": 0, "end0": 0, "depth0": 0, "end1": 1, "depth1": 0})
                step = scan(row["value"] or "")
                for s in "01":
                    end, depth = step[own["end" + s]]
                    own["end" + s] = end
                    own["depth" + s] += depth - (0 if end else closes)
                own["n"] += 1
                own["size"] += row["size"]
        yield pa.RecordBatch.from_pylist(list(found.values()), _schema(SUMMARY))

    return summaries


def _composed(splits: pa.Table) -> pa.Table:
    """The state at the start of each split of one file, and the piece that has no separator (0: all have one)."""
    rows, state, depth = [], 0, 0
    ordered = sorted(splits.to_pylist(), key=lambda x: x["block"])
    # A mark of three bytes at the beginning of a file is not handed on.
    unclosed = sum(x["size"] for x in ordered) - ordered[0]["bytes"] in (1, 1 - 3)
    for x in ordered:
        rows.append({"file": x["file"], "block": x["block"], "state": state, "depth": depth, "last": x["n"] if unclosed and x is ordered[-1] else 0})
        state, depth = x[f"end{state}"], depth + x[f"depth{state}"]
    return pa.Table.from_pylist(rows, _schema(START))


FOUND = "file string, block long, part string, text string"


def _records(scan: Callable[[str], Step], closes: int, separator: str, base: int):
    """Whole records of each split, the fragments before its first and after its last boundary, or all of it where it has none."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, text, state, depth, seen, count = None, [], 0, 0, False, 0

        def entry(part: str) -> dict:
            return {"file": now[0], "block": now[1], "part": part, "text": "".join(text)}

        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if (row["file"], row["block"]) != now:
                    if now:
                        out.append(entry("last" if seen else "whole"))
                    now, text, state, depth, seen, count = (row["file"], row["block"]), [], row["state"], row["depth"], False, 0
                state, change = scan(row["value"] or "")[state]
                depth += change
                count += 1
                text.append(row["value"] or "")
                if count == row["last"]:
                    continue
                text.append(separator)
                if not state:
                    depth -= closes
                    if depth <= base:
                        out.append(entry("record" if seen else "first"))
                        text, seen = [], True
            if out:
                yield pa.RecordBatch.from_pylist(out, _schema(FOUND))
        if now:
            yield pa.RecordBatch.from_pylist([entry("last" if seen else "whole")], _schema(FOUND))

    return records


def records(spark: SparkSession, files: list[str], separator: str, scan: Callable[[str], Step], closes: int = 0, base: int = 0) -> DataFrame:
    """``file``, ``block`` (of the split where it begins), ``text`` of every record with its separators,
    and ``head``, whether it is the file's first one."""
    pieces = _pieces(spark, files, separator)
    summary = pieces.mapInArrow(_summaries(scan, closes), SUMMARY)
    starts = summary.groupBy("file").applyInArrow(_composed, START)  # a row per split
    found = pieces.select("file", "block", "value").join(F.broadcast(starts), ["file", "block"]).mapInArrow(_records(scan, closes, separator, base), FOUND)
    late = F.col("part") == "last"
    order = Window.partitionBy("file").orderBy("block", late).rowsBetween(Window.unboundedPreceding, -1)
    cut = found.filter("part <> 'record'").withColumn("number", F.coalesce(F.count_if(F.col("part") == "first").over(order), F.lit(0)))
    # A record has a fragment in each split that it reaches over.
    whole = cut.groupBy("file", "number").agg(F.min("block").alias("block"), F.array_sort(F.collect_list(F.struct("block", late.alias("late"), "text"))).alias("parts"))
    joined = whole.select("file", "block", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), (F.col("number") == 0).alias("head"))
    return found.filter("part = 'record'").select("file", "block", "text", F.lit(False).alias("head")).unionAll(joined)


def json_lines(spark: SparkSession, files: list[str], base: int) -> DataFrame:
    """One line ``value`` for each element of the files' arrays (``base`` 1) or for their single events (0).

    What stands between the objects of an array is a line of its own, which is no event.
    """
    text = F.regexp_replace(F.translate("text", "\n\r\t\ufeff", "   "), r"^[\s,\[\]]+|\s+$" if base else r"^\s+|\s+$", "")
    rows = records(spark, files, "}", json_piece, 1, base).select(text.alias("text"))
    between = F.regexp_extract("text", r"^[^{]*", 0)
    parts = F.array(between, F.expr("substring(text, length(regexp_extract(text, '^[^{]*', 0)) + 1)"))
    rest = r"^[\s,\[\]]*$"
    return rows.select(F.explode(parts if base else F.array("text")).alias("value")).filter(~F.col("value").rlike(rest))
