"""Splitting documents into overlapping chunks along paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphfold.errors import Invalid
from graphfold.plans.ship import ship

GAP = "\n\n"
#: A paragraph begins at a character other than a line end and goes on to a blank line.
_PARAGRAPH = re.compile(r"[^\r\n](?:(?!\n\n|\r\n\r)[\s\S])*")

Span = tuple[int, int, str]


def check_sizes(size: int, overlap: int) -> None:
    if size < 1 or overlap < 0 or overlap >= size:
        raise Invalid(f"chunk size {size} and overlap {overlap}: 0 <= overlap < size is needed")


def paragraphs(text: str) -> Iterator[Span]:
    """(start, end, stripped text) of each paragraph that is not blank."""
    for m in _PARAGRAPH.finditer(text):
        body = m[0].strip()
        if body:
            start = m.start() + m[0].index(body[0])
            yield start, start + len(body), body


def windows(start: int, body: str, size: int, overlap: int) -> Iterator[Span]:
    """Overlapping windows of a text that is too long for one chunk."""
    step = max(1, size - overlap)
    last = max(0, -(-(len(body) - size) // step))
    for i in range(last + 1):
        piece = body[i * step : i * step + size]
        yield start + i * step, start + i * step + len(piece), piece


def split_text(text: str | None, size: int = 1200, overlap: int = 200) -> list[Span]:
    """Chunks of a text: paragraphs packed up to size, longer ones cut into windows, each chunk led in by the last
    `overlap` characters of the finished chunk before it unless it begins with them."""
    check_sizes(size, overlap)
    pieces: list[Span] = []
    open_ = False  # whether the last piece may take another paragraph
    for start, end, body in paragraphs(text or ""):
        if len(body) > size:
            pieces += windows(start, body, size, overlap)
            open_ = False
        elif open_ and len(pieces[-1][2]) + len(GAP) + len(body) <= size:
            pieces[-1] = pieces[-1][0], end, pieces[-1][2] + GAP + body
        else:
            pieces.append((start, end, body))
            open_ = True
    out = pieces[:1]
    for start, end, body in pieces[1:]:
        tail = out[-1][2][-overlap:] if overlap else ""
        led = bool(tail) and not body.startswith(tail)
        out.append((max(0, out[-1][1] - len(tail)), end, tail + GAP + body) if led else (start, end, body))
    return out


def chunk_documents(docs: DataFrame, key: str = "id", text: str = "text", size: int = 1200, overlap: int = 200) -> DataFrame:
    """(key, ord, char_start, char_end, text): a row for each chunk. Arrow batches stream through; nothing is shuffled."""
    check_sizes(size, overlap)
    ship(docs.sparkSession)
    schema = T.StructType([docs.schema[key], T.StructField("ord", T.IntegerType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, (a, b, piece) in enumerate(split_text(t, size, overlap)):
                    ids.append(i)
                    rows.append((n, a, b, piece))
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def hard_split(text: Column, size: int, overlap: int) -> Column:
    """array<struct<ord, char_start, char_end, text>>: the windows of a single paragraph, as an expression."""
    check_sizes(size, overlap)
    step = max(1, size - overlap)
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")

    def window(i: Column) -> Column:
        start = i * step
        return F.struct(i.alias("ord"), start.alias("char_start"), F.least(start + size, n).alias("char_end"), F.substring(text, start + 1, F.lit(size)).alias("text"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), window))
