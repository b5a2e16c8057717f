"""What kind of character every code point is, as the JVM's regular expressions see it.

Steps that cut whole texts outside the JVM take the kinds from here, so they cut where its
patterns would, whatever Unicode version either side has.
"""
from __future__ import annotations

import zlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .text import INDEX_TOKEN, SPACE

LETTER, DIGIT, UPPER, BLANK, GAP, INDEXED = 1, 2, 4, 8, 16, 32  # \p{L}; \p{N} or _; \p{Lu}; SPACE; \s or \p{Z}; of an index token
_KINDS = {LETTER: r"\p{L}", DIGIT: r"\p{N}|_", UPPER: r"\p{Lu}", BLANK: SPACE, GAP: r"[\s\p{Z}]", INDEXED: INDEX_TOKEN}
_LOW, _HIGH = 0x40000, 0xE0000  # no character is assigned between them
_packed: dict[str, bytes] = {}


def packed_kinds(spark: SparkSession) -> bytes:
    """One byte of kinds a code point, compressed; asked of the JVM once."""
    if "kinds" not in _packed:
        code = F.when(F.col("id") < _LOW, F.col("id")).otherwise(F.col("id") + (_HIGH - _LOW))
        c = F.decode(F.unhex(F.lpad(F.hex("code"), 8, "0")), "UTF-32")
        kinds = sum((F.when(c.rlike(f"^(?:{p})"), bit).otherwise(0) for bit, p in _KINDS.items()), F.lit(0))
        kinds = F.when(F.col("code").between(0xD800, 0xDFFF), 0).otherwise(kinds)
        asked = spark.range(0, 0x110000 - (_HIGH - _LOW), 1, spark.sparkContext.defaultParallelism)
        rows = asked.select(code.alias("code")).select("code", kinds.cast("byte").alias("k")).toArrow().sort_by("code")["k"].to_numpy().astype("uint8").tobytes()
        _packed["kinds"] = zlib.compress(rows[:_LOW] + bytes(_HIGH - _LOW) + rows[_LOW:])
    return _packed["kinds"]


def text_tools(spark: SparkSession):
    """Functions over the bytes of many texts: kind_of, runs, coded, pieces. They are nested here, so that a worker
    needs no module of this package."""
    packed, tables = packed_kinds(spark), []

    def kind_of(data):
        """The kinds of the character that every byte of valid UTF-8 belongs to."""
        import zlib

        import numpy as np

        if not tables:
            tables.append(np.frombuffer(zlib.decompress(packed), np.uint8))
            tables.append(np.append(tables[0][:128], np.zeros(128, np.uint8)))
        table, single = tables
        kind = single[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            b = [data[np.minimum(lead + i, len(data) - 1)].astype(np.int32) for i in range(4)]
            size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
            tail = [x & 63 for x in b]
            code = np.where(size == 2, (b[0] & 31) << 6 | tail[1], np.where(
                size == 3, (b[0] & 15) << 12 | tail[1] << 6 | tail[2], (b[0] & 7) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3]))
            k = table[np.minimum(code, len(table) - 1)]
            for i in range(4):
                kind[lead[size > i] + i] = k[size > i]
        return kind

    def runs(inside, offsets):
        """Starts and ends of runs that don't cross a row."""
        import numpy as np

        edges = offsets[:-1][offsets[:-1] < len(inside)]
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[edges] = False
        after[edges[edges > 0] - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def coded(data, inside, first, last):
        """Numbers of words, which are the bytes `inside`, and the distinct words."""
        import numpy as np
        import pyarrow as pa

        ends = np.zeros(len(first) + 1, np.int32)
        np.cumsum(last - first, out=ends[1:])
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(data[inside])).dictionary_encode()
        return words.indices.to_numpy(), words.dictionary

    def pieces(text, size):
        """(first row, end row, bytes, offsets) of consecutive rows of about `size` bytes; a longer text is a piece of its own."""
        import numpy as np
        import pyarrow as pa

        if text.null_count:
            text = text.fill_null("")
        _, at, data = text.buffers()
        kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
        offsets = np.frombuffer(at, kind)[text.offset:text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
        flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
            yield i, j, flat[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            i = j

    return kind_of, runs, coded, pieces
