"""Hierarchical packing into windows of several context sizes.

A document longer than the longest window gives whole windows; what remains is
routed to the smallest tier (context size) that holds it. Tiers are packed from the long end:
a remainder opens a window of its tier, and the gap is filled from the shorter
tiers, always with the longest piece that still fits; when nothing fits, the next
longer piece is cut to fill the window to the last token and its rest goes back
to its tier. Windows are powers of two and full, so nothing is padded; the
last tokens of a partition go to windows of smaller powers of two. Windows
of one tier form step groups of equal tokens (``STEP_TOKENS``).

Every partition packs its own rows in one pass with a bounded pool, so there is no
shuffle and no step that sees all documents; a lost task repeats alone.

Edge cases. Null and empty texts are the end token alone. Ids may be null or
repeat: pieces carry the row's own count. Very long texts are tokenised whole.
An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

WINDOW, END = 2048, 1
TIERS = (128, 256, 512, 1024, 2048)
STEP_TOKENS = 1 << 14
#: Tokens a partition keeps waiting for a better fit, and texts tokenised at a time, in characters.
POOL_TOKENS, BATCH_CHARS = 256 * WINDOW, 1 << 20

SCHEMA = "id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs documents given one by one; ``rows`` gathers the pieces of finished windows."""

    def __init__(self, base: int = 0, window: int = WINDOW):
        self.window, self.base = window, base
        self.by_length: dict[int, list] = {}
        self.lengths: list[int] = []  # sorted lengths with a waiting piece
        self.waiting = 0
        self.sequences = 0
        self.steps: dict[int, tuple[int, int]] = {}  # tier -> (step group, windows left in it)
        self.groups = 0
        self.rows: list[tuple] = []

    def _put(self, doc: tuple, start: int, length: int) -> None:
        stack = self.by_length.get(length)
        if stack is None:
            stack = self.by_length[length] = []
            insort(self.lengths, length)
        stack.append((doc, start))
        self.waiting += length

    def _take(self, at: int) -> tuple[tuple, int, int]:
        length = self.lengths[at]
        stack = self.by_length[length]
        doc, start = stack.pop()
        if not stack:
            del self.by_length[length], self.lengths[at]
        self.waiting -= length
        return doc, start, length

    def _close(self, size: int, pieces: list[tuple]) -> None:
        group, left = self.steps.get(size, (0, 0))
        if not left:
            group, left = self.base + self.groups, max(1, STEP_TOKENS // size)
            self.groups += 1
        self.steps[size] = group, left - 1
        offset, sequence = 0, self.base + self.sequences
        self.sequences += 1
        for (key, ids, base, total), start, length in pieces:
            self.rows.append((key, start, length, zlib.crc32(ids[start - base : start - base + length].data), total, sequence, offset, size, group))
            offset += length

    def add(self, key, ids: np.ndarray) -> None:
        n = len(ids)
        for start in range(0, n - self.window + 1, self.window):
            self._close(self.window, [((key, ids, 0, n), start, self.window)])
        if rest := n % self.window:  # what waits holds its own ids only, not the document's
            self._put((key, ids[n - rest :].copy(), n - rest, n), n - rest, rest)
        if self.waiting > POOL_TOKENS:
            self.pack(POOL_TOKENS // 2)

    def pack(self, leave: int) -> None:
        """Fill windows until at most ``leave`` tokens wait."""
        while self.waiting > leave:
            longest = self.lengths[-1]
            tier = next(t for t in (*TIERS, self.window) if t >= longest)
            size = min(tier, 1 << (self.waiting.bit_length() - 1))
            pieces, gap = [], size
            while gap:
                fit = bisect_right(self.lengths, gap) - 1
                if fit >= 0:
                    piece = self._take(fit)
                else:  # the next longer piece is cut
                    doc, start, length = self._take(bisect_left(self.lengths, gap))
                    self._put(doc, start + gap, length - gap)
                    piece = (doc, start, gap)
                pieces.append(piece)
                gap -= piece[2]
            self._close(size, pieces)


def slices(batch: pa.RecordBatch, chars: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose second column holds about ``chars`` bytes of text, without copying."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + chars, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = SCHEMA.format(kind=kind)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.coder(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 33, window)
        types: list = [None]

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows))
            packer.rows = []
            return pa.record_batch([pa.array(columns[0], types[0]), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.int32()), pa.array(columns[8], pa.int64())], names=names)

        for b in batches:
            types[0] = b.column(0).type
            for part in slices(b, BATCH_CHARS):
                for key, x in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist())):
                    packer.add(key, np.append(x, np.uint32(END)))
                if len(packer.rows) > 10_000:
                    yield out()
        packer.pack(0)
        if packer.rows:
            yield out()

    return rows.mapInArrow(run, schema)
