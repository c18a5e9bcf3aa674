"""Trigram bitmaps of a table's files: substring search that skips files.

A column that contains a text contains all of its trigrams.  For every file and
searched field the index keeps one bitmap of 32,768 bits, the hashes of the
trigrams of bytes that occur there (lower case).  The tasks that read the files
mark the bits of whole column batches and send on one bitmap per file and field.
A search reads the bitmaps, drops the files that lack a bit of a text it needs,
and filters what is left as usual, so the index never changes a result: hash collisions only keep a file, and a file
that the index does not know is read.  Texts below three bytes skip nothing.

The bitmaps are read on executors; the names of the files to skip reach the
driver, which lists the table's files anyhow.
"""

from __future__ import annotations

from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 32_768  # of one built-in bitmap


def _positions(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bit of every trigram of bytes in texts that lie one after the other in
    ``data``; ``ends`` are the places behind each text."""
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64)
    d = data.astype(np.uint32)
    inside = np.ones(len(data) - 2, dtype=bool)
    for back in (1, 2):  # a trigram that begins here would reach over the end
        at = ends - back
        inside[at[(at >= 0) & (at < len(inside))]] = False
    gram = (d[:-2] << 16 | d[1:-1] << 8 | d[2:])[inside]
    return (gram * np.uint32(2654435761) >> np.uint32(32 - BITS.bit_length() + 1)).astype(np.int64)


def _text_positions(texts: pa.Array) -> np.ndarray:
    """Bits of the trigrams of a column of lower-case texts (null: none)."""
    texts = pa.concat_arrays([pc.drop_null(texts).cast(pa.large_binary())])  # offsets from the start
    if not len(texts):
        return np.zeros(0, dtype=np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return _positions(data, ends[1:] - ends[0])


def _bitmap(seen: np.ndarray) -> bytes:
    return np.packbits(seen, bitorder="little").tobytes()


def build_index(table: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """``(file, field, bits)`` of a table read from files; a null text has no trigrams."""
    names = list(fields)
    rows = table.select(F.col("_metadata.file_path").alias("file"), *[F.lower(c.cast("string")).alias(f"t{i}") for i, c in enumerate(fields.values())])

    def marked(batches):
        """The bitmaps of one file at a time: a task reads its files one by one."""
        at, seen = None, None
        for b in batches:
            files = b.column(0).dictionary_encode()
            for code, file in enumerate(files.dictionary.to_pylist()):
                part = b if len(files.dictionary) == 1 else b.filter(pc.equal(files.indices, code))
                if file != at:
                    if at is not None:
                        yield done(at, seen)
                    at, seen = file, np.zeros((len(names), BITS), dtype=bool)
                for i in range(len(names)):
                    seen[i, _text_positions(part.column(i + 1))] = True
        if at is not None:
            yield done(at, seen)

    def done(file, seen):
        return pa.RecordBatch.from_arrays([pa.array([file] * len(names)), pa.array(names), pa.array([_bitmap(x) for x in seen], pa.binary())],
                                          names=["file", "field", "bits"])

    bits = rows.mapInArrow(marked, "file string, field string, bits binary")
    return bits.groupBy("file", "field").agg(F.bitmap_or_agg("bits").alias("bits"))


def _has(bits: Column, position: int) -> Column:
    byte = F.conv(F.hex(F.substring(bits, position // 8 + 1, 1)), 16, 10).cast("int")
    return F.getbit(byte, F.lit(position % 8)) == 1


def files_without(index: DataFrame, wanted: dict[str, list[str]]) -> set[str]:
    """The indexed files that cannot hold a row whose fields contain all ``wanted`` texts."""
    asked = [(field, text) for field, texts in wanted.items() for text in texts]
    if not asked:
        return set()
    low = index.sparkSession.range(1).select(*[F.lower(F.lit(t)).alias(f"t{i}") for i, (_, t) in enumerate(asked)]).first()
    lacks = F.lit(False)
    for (field, _), text in zip(asked, low):
        for p in sorted(set(_text_positions(pa.array([text], pa.string())).tolist())):
            lacks = lacks | ((F.col("field") == field) & ~_has(F.col("bits"), p))
    return {_plain(r["file"]) for r in index.where(lacks).select("file").distinct().collect()}


def _plain(uri: str) -> str:
    """A file's name without the spelling differences of its address."""
    return unquote(urlparse(uri).path) if "://" in uri or uri.startswith("file:") else uri


def read_matching(spark: SparkSession, path: str, index: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """The Parquet table at ``path`` without the files that the index rules out."""
    table = spark.read.parquet(path)
    skip = files_without(index, wanted)
    files = table.inputFiles()
    keep = [f for f in files if _plain(f) not in skip]
    if len(keep) == len(files):
        return table
    if not keep:
        return table.where(F.lit(False))
    return spark.read.schema(table.schema).option("basePath", path).parquet(*[unquote(f) for f in keep])
