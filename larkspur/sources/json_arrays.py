"""JSON array files read by many tasks.

Spark's text reader cuts a file at closing braces, so every byte range of it is read by its own task, from any store. A range cannot know
whether it begins inside a string or how deep; so a first pass works out what each range does to the depth if it begins outside
a string and if it begins inside one. These short summaries, one row per range, are chained per file, and a second pass then cuts
the records of each range exactly. Records that span ranges are put together from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.session import written

#: A string that ends, or one that runs on to the end of the text; or a bracket.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[{}\[\]]', re.DOTALL)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*("?)', re.DOTALL)
_WIDTH = {"{": 1, "[": 1, "}": -1, "]": -1}


def brackets(text: str, inside: bool) -> tuple[list[tuple[int, int]], bool]:
    """``(position, step)`` of the brackets outside strings, and whether the text ends inside a string. ``inside``: it begins in one."""
    found, at = [], 0
    if inside:
        rest = _REST_OF_STRING.match(text)
        if not rest.group(1):
            return found, True
        at = rest.end()
    for token in _TOKEN.finditer(text, at):
        step = _WIDTH.get(token.group())
        if step is not None:
            found.append((token.start(), step))
        elif not token.group(1):
            return found, True
    return found, False


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range and way to begin: the way it ends, the change of depth and the lowest depth on the way."""
    names = ["file", "start", "head", "inside", "ends_inside", "change", "lowest"]
    key, states, head = None, None, ""

    def closed() -> pa.RecordBatch:
        columns = [[key[0]] * 2, [key[1]] * 2, [head] * 2, [False, True], *zip(*states)]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        for own, start, text in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value"))):
            if key != (own, start):
                if key is not None:
                    yield closed()
                key, states, head = (own, start), [(False, 0, 0), (True, 0, 0)], text.lstrip("\ufeff \t\r\n")[:1]
            after = []
            for inside, change, lowest in states:
                steps, inside = brackets(text + "}", inside)
                for _, step in steps:
                    change += step
                    lowest = min(lowest, change)
                after.append((inside, change, lowest))
            states = after
    if key is not None:
        yield closed()


def _chained(ranges: pa.Table) -> pa.Table:
    """For the ranges of one file: how each begins, and the range that began the record it begins in (-1: in none)."""
    rows = sorted(ranges.to_pylist(), key=lambda r: (r["start"], r["inside"]))
    base = 1 if rows and rows[0]["head"] == "[" else 0
    inside, depth, owner, out = False, 0, -1, []
    for outside_row, inside_row in zip(rows[::2], rows[1::2]):
        row = inside_row if inside else outside_row
        out.append((row["file"], row["start"], base, inside, depth, owner if depth > base else -1))
        # Where the depth came down to that of the array, the record that is open at the end was begun in this range.
        owner = row["start"] if depth + row["lowest"] <= base else owner
        inside, depth = row["ends_inside"], depth + row["change"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], ["file", "start", "base", "inside", "depth", "owner"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file, owner, part, text``: the whole records of each range (owner -1), and its parts of records that span ranges."""
    key, here, held, out = None, False, [], []
    inside, depth, base, owner = False, 0, 0, -1

    def flushed() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], ["file", "owner", "part", "text"])

    for batch in batches:
        for own, start, text, *state in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value", "base", "inside", "depth", "owner"))):
            if key != (own, start):
                if held:
                    out.append((key[0], owner, key[1], "".join(held)))
                key, here, held = (own, start), False, []
                base, inside, depth, owner = state
            text, begin = text + "}", 0
            steps, inside = brackets(text, inside)
            for place, step in steps:
                if depth == base and text[place] == "{":
                    here, owner, held, begin = True, start, [], place
                depth += step
                if depth == base and text[place] == "}" and owner >= 0:
                    held.append(text[begin : place + 1])
                    out.append((own, -1 if here else owner, start, "".join(held)))
                    here, owner, held = False, -1, []
            if owner >= 0:
                held.append(text[begin:])
        if out:
            yield flushed()
            out = []
    if held:
        out.append((key[0], owner, key[1], "".join(held)))
        yield flushed()


def array_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``text`` of every object in the array of each file, or on the top level of files without one. Other elements are left out."""
    read = spark.read.option("lineSep", "}").text(path)
    pieces = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").cast("long").alias("start"))
    summed = pieces.mapInArrow(_summed, "file string, start long, head string, inside boolean, ends_inside boolean, change long, lowest long")
    # Two short rows per range of a file; the table of all ranges grows with the bytes divided by the size of a range.
    chained = summed.groupBy("file").applyInArrow(_chained, "file string, start long, base int, inside boolean, depth long, owner long")
    ranges = written(chained, "ranges")
    cut = pieces.join(F.broadcast(ranges), ["file", "start"]).mapInArrow(_cut, "file string, owner long, part long, text string")
    parts = written(cut, "records")
    spanning = parts.filter("owner >= 0").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts"))
    together = spanning.select(F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    return parts.filter("owner < 0").select("text").unionByName(together)


def read_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType, corrupt: str = "_corrupt_record") -> DataFrame:
    """Records of JSON array files by ``schema``, with the text of unreadable ones in ``corrupt``.

    Equals the multi-line JSON reader on well-formed files, but reads one file in as many tasks as it has splits. A record that is no
    valid JSON by itself is kept as unreadable and spoils no other, as long as its quotes and brackets are balanced.
    """
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = F.from_json("text", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    return array_records(spark, path).select(parsed.alias("r")).select("r.*")
