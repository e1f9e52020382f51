"""Bounded-space online packing of token sequences.

Each partition streams its documents through a fixed number of open windows.
Whole windows of a long document leave at once. The rest is placed best-fit:
into the open window with the least room that still holds it. When none fits
and all windows are open, the fullest is topped up with the start of the piece
and emitted, and a new one is opened. At the end the leftovers are merged into
full windows, and what is left over then is cut at powers of two, which need no
padding. Memory is the open windows and one batch of texts; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import words
from lakeloom.llm.bpe import CACHE, byte_codec

#: (doc, start, ids, doc_tokens); ids are bytes, four for each
Piece = tuple[int | None, int, bytes, int]


class Packer:
    """Packs pieces into windows of ``size`` ids with ``n_open`` open at most."""

    def __init__(self, size: int, n_open: int) -> None:
        self.size, self.n_open = size, n_open
        self.open: list[list] = []  # [room, pieces]

    def add(self, doc: int | None, ids: bytes) -> Iterator[list[Piece]]:
        """Place one document; windows that are full."""
        total, at = len(ids) // 4, 0
        while total - at >= self.size:
            yield [(doc, at, ids[4 * at : 4 * (at + self.size)], total)]
            at += self.size
        n = total - at
        if not n:
            return
        piece = (doc, at, ids[4 * at :], total)
        fits = [w for w in self.open if w[0] >= n]
        if fits:
            best = min(fits, key=lambda w: w[0])
        elif len(self.open) < self.n_open:
            best = [self.size, []]
            self.open.append(best)
        else:
            full = min(self.open, key=lambda w: w[0])
            self.open.remove(full)
            first, piece = cut(piece, full[0])
            yield full[1] + [first]
            n -= full[0]
            best = [self.size, []]
            self.open.append(best)
        best[0] -= n
        best[1].append(piece)
        if not best[0]:
            self.open.remove(best)
            yield best[1]

    def finish(self) -> Iterator[list[Piece]]:
        """Merge the leftovers, the fullest first; the last remainder is cut at powers of two."""
        held: list[Piece] = []
        have = 0
        for room, pieces in sorted(self.open, key=lambda w: w[0]):
            for p in pieces:
                n = len(p[2]) // 4
                while have + n >= self.size:
                    first, p = cut(p, self.size - have)
                    yield held + [first]
                    held, have, n = [], 0, len(p[2]) // 4
                if n:
                    held.append(p)
                    have += n
        self.open = []
        while have:
            want, window, took = 1 << (have.bit_length() - 1), [], 0
            while took < want:
                n = len(held[0][2]) // 4
                if n > want - took:
                    first, held[0] = cut(held[0], want - took)
                else:
                    first = held.pop(0)
                window.append(first)
                took += len(first[2]) // 4
            yield window
            have -= want


def cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    """The first n ids of a piece, and the rest."""
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total)


def _rows(windows: Iterable[list[Piece]], first: int) -> Iterator[list[tuple]]:
    """Windows as rows, in lists of some megabytes."""
    out, size = [], 0
    for number, window in enumerate(windows):
        offset = 0
        for doc, start, ids, total in window:
            n = len(ids) // 4
            out.append((doc, start, n, total, first + number, offset, ids))
            offset += n
            size += len(ids) + 64
        if size > 4 << 20:
            yield out
            out, size = [], 0
    if out:
        yield out


def pack_documents(df: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, n_open: int = 64, cache: int = 2 * CACHE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole texts, each followed by ``end_id``, into sequences of ``size`` ids at most.

    Returns a row per piece: id_col, start (the document's ids before it),
    length, doc_tokens, sequence_id, offset (in its sequence, gapless from 0)
    and ids (binary, little-endian unsigned 32-bit).

    cache: encoded chunks that a Python worker keeps, some 200 bytes each. The
    worker keeps them while it serves other stages too, so a job of several
    stages does well with fewer; the ids are the same.

    Defined cases: a null or empty text is just the end id; null document ids
    stay null; repeated rows are packed each for itself; an empty table gives
    an empty result; other columns are not looked at.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = byte_codec(tokenizer), Packer(size, n_open)

        def windows() -> Iterator[list[Piece]]:
            for b in batches:
                for part in words.slices(b, "body"):
                    bodies = [x or b"" for x in part.column("body").to_pylist()]
                    for doc, ids in zip(part.column("doc").to_pylist(), own.run(bodies, cache)):
                        yield from packer.add(doc, ids + end)
            yield from packer.finish()

        for rows in _rows(windows(), TaskContext.get().partitionId() << 32):
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    out = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("body")).mapInArrow(
        words.tidy(run), "doc long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    return out.withColumnRenamed("doc", id_col)
