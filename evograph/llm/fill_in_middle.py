"""Fill-in-middle transformation by in-place block rotation, and its exact inverse.

A text becomes prefix, middle and suffix, cut at code points. The bytes of the text go into one
bytearray; the cuts are found by scanning for bytes that begin a character, the sentinels are
inserted, and the blocks change places inside the array by three reversals (each block, then
both together), a bounded slice at a time. Restoring runs the same rotations backwards and
takes the sentinels out.

Cuts and form depend on ``doc_id`` and the length alone, so a row gives the same result wherever and
whenever it is computed:

- ``plain``: the text itself, where it is empty, already holds a sentinel, or is not chosen;
- ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
- ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

Defined results: a null text is empty; a null doc_id is hashed as no digits; of a negative one the
sign is hashed too; cuts may fall together, also at the ends, which leaves blocks empty; repeated rows
get one row each; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Of 100 texts so many are transformed, and of 100 transformed so many are spm.
FIM_PERCENT, SPM_PERCENT = 90, 20
SEED = "1:"
_SLICE = 1 << 16


def _reverse(a: np.ndarray, lo: int, hi: int) -> None:
    """Reverse a[lo:hi] in place, with a bounded slice beside it."""
    while hi - lo > 1:
        n = min(_SLICE, (hi - lo) // 2)
        left = a[lo:lo + n].copy()
        a[lo:lo + n] = a[hi - n:hi][::-1]
        a[hi - n:hi] = left[::-1]
        lo, hi = lo + n, hi - n


def rotate(buffer: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange the neighbouring blocks buffer[lo:mid] and buffer[mid:hi] in place."""
    a = np.frombuffer(buffer, np.uint8)
    _reverse(a, lo, mid)
    _reverse(a, mid, hi)
    _reverse(a, lo, hi)


def _draws(doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit draws of a document."""
    h = sha256(f"{SEED}{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(h[4 * i:4 * i + 4], "big") for i in range(4)]


def _byte_offsets(text: bytes, at: list[int]) -> tuple[int, list[int]]:
    """Code points of ``text``, and the byte offsets of the code point offsets ``at`` (ascending)."""
    seen, left, out = 0, list(at), []
    for lo in range(0, len(text), _SLICE):
        first = np.flatnonzero(np.frombuffer(text, np.uint8, min(_SLICE, len(text) - lo), lo) & 0xC0 != 0x80)
        while left and left[0] < seen + len(first):
            out.append(lo + int(first[left.pop(0) - seen]))
        seen += len(first)
    return seen, out + [len(text)] * len(left)


def forward(doc_id: int | None, text: bytes) -> tuple[int, str, int | None, int | None, bytearray]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    n = _byte_offsets(text, [])[0]
    h = _draws(doc_id)
    if not text or h[2] % 100 >= FIM_PERCENT or any(s in text for s in SENTINELS):
        return n, "plain", None, None, bytearray(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    i, j = _byte_offsets(text, [a, b])[1]
    buffer = bytearray(text)
    buffer[j:j] = SUFFIX
    buffer[i:i] = MIDDLE
    buffer[0:0] = PREFIX
    i, j = i + len(PREFIX), j + len(PREFIX) + len(MIDDLE)
    rotate(buffer, i, j, len(buffer))  # <M>middle <S>suffix -> <S>suffix <M>middle
    if h[3] % 100 >= SPM_PERCENT:
        return n, "psm", a, b - a, buffer
    rotate(buffer, 0, i, len(buffer) - (j - i))  # <P>prefix <S>suffix -> <S>suffix <P>prefix
    return n, "spm", a, b - a, buffer


def backward(form: str, output: bytes) -> bytearray:
    """The text that ``output`` was made of. A text with a sentinel is plain, so each sentinel occurs once."""
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    if form == "spm":
        rotate(buffer, 0, buffer.index(PREFIX), buffer.index(MIDDLE))
    i, m = buffer.index(SUFFIX), buffer.index(MIDDLE)
    rotate(buffer, i, m, len(buffer))
    j = i + len(buffer) - m
    if not (buffer[:3] == PREFIX and buffer[i:i + 3] == MIDDLE and buffer[j:j + 3] == SUFFIX):
        raise ValueError("sentinels out of place")
    del buffer[j:j + 3], buffer[i:i + 3], buffer[:3]
    return buffer


#: Bytes of texts that are gathered before they leave a task.
BATCH_BYTES = 1 << 20
_FORWARD = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
_TYPES = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
          ("middle_chars", pa.int64()), ("output", pa.binary()), ("restored", pa.binary())]


def _batches(rows: Iterator[tuple], width: int) -> Iterator[pa.RecordBatch]:
    """Rows, the last of whose values are byte buffers, in batches of bounded size (or of one row)."""
    schema = pa.schema(_TYPES[:width])

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row[5:]))
        if size >= BATCH_BYTES:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _made(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[tuple]:
    for b in batches:
        for doc, text in zip(b.column(0), b.column(1)):
            row = (doc.as_py(), *forward(doc.as_py(), text.as_py()))
            yield (*row[:5], bytes(row[5]), *((bytes(backward(row[2], row[5])),) if keep else ()))


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars (null if plain), output (UTF-8) of every whole text."""
    return _texts(docs).mapInArrow(lambda batches: _batches(_made(batches, False), 6), _FORWARD)


def restore(made: DataFrame) -> DataFrame:
    """The columns of :func:`transform` and restored (binary): the text before it, from form and output alone."""
    names = [name for name, _ in _TYPES[:6]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(x.as_py() for x in row) for b in batches for row in zip(*(b.column(c) for c in names)))
        return _batches(((*row, bytes(backward(row[2], row[5]))) for row in rows), 7)
    return made.select(*names).mapInArrow(run, f"{_FORWARD}, restored binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """:func:`transform` and :func:`restore` in one pass over the texts."""
    return _texts(docs).mapInArrow(lambda batches: _batches(_made(batches, True), 7), f"{_FORWARD}, restored binary")
