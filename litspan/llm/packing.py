"""Cost-balanced packing of token sequences.

Attention within a document costs ``linear * n + quadratic * n * n``. Documents fall into blocks by
a hash, each block is packed on its own: whole multiples of the sequence length stand alone, the
remainders are assigned in descending order, each to the sequence of lowest cost that still has
room for it; where none has, the piece is cut and fills the roomiest. A block opens as many full
sequences as its remainders fill, and sequences of distinct powers of two for what is left, so
nothing is padded.

Blocks are dealt by id, text and a part of the scan, so rows that share an id, or even repeat whole, don't meet in one block; a block is packed in parts of bounded size
as it streams by.

Defined cases: a null or empty text is the closing id alone. Repeated rows, also with the same id,
are packed as separate documents. An empty table gives no pieces. Ids may be of any type, other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspan.llm.bpe import CHUNK, Merged, encode, encoder
from litspan.llm.common import measured, slices, texts

LENGTH = 2048
CLOSING = 1
SPECIAL = "<|endoftext|>"  # fixed value: the vocabulary's one special token, and its id
SPECIAL_ID = 50256
BLOCK_DOCS = 1024  # mean documents of a block
MOST_DOCS = 8192  # a block with more is packed in parts of so many,
PART_BYTES = 64 << 20  # and so many bytes of ids (a document above that is a part of its own)
SCANS = 64  # parts of the scan by which rows are dealt


def encode_with_special(batch: list[str], merged: Merged) -> list[bytes]:
    """Ids as unsigned 16-bit; the special token's text is that token, as the tokenizer file has it."""
    if not any(SPECIAL in t for t in batch):
        return [ids for ids, _ in encode(batch, merged)]
    parts = [t.split(SPECIAL) for t in batch]
    found = iter([ids for ids, _ in encode([p for x in parts for p in x], merged)])
    between = np.array([SPECIAL_ID], "<u2").tobytes()
    return [between.join(next(found) for _ in x) for x in parts]


def token_rows(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id column and ``ids`` binary: unsigned 16-bit ids of the whole text, with the closing id."""
    frame = docs.select(id_column, text_column)
    closing = np.array([CLOSING], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = encoder(vocabulary, "H")
        for batch in batches:
            words = texts(batch.column(1))
            for lo, hi in slices(batch, [len(t) for t in words], CHUNK):
                ids = [x + closing for x in encode_with_special(words[lo:hi], merged)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.binary())], names=[id_column, "ids"])

    return frame.mapInArrow(run, f"`{id_column}` {frame.schema[id_column].dataType.simpleString()}, ids binary")


def pack_lengths(lengths: np.ndarray, length: int = LENGTH, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of the given lengths."""
    pieces = []
    sequence = 0
    for doc in range(len(lengths)):
        for start in range(0, int(lengths[doc]) // length * length, length):
            pieces.append((doc, start, length, sequence, 0))
            sequence += 1
    rest = lengths % length
    full, left = divmod(int(rest.sum()), length)
    room = np.array([length] * full + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1], np.int64)
    used, cost = np.zeros_like(room), np.zeros(len(room))
    waiting = [int(d) for d in np.lexsort((np.arange(len(rest)), -rest)) if rest[d]]
    at = {d: int(lengths[d] - rest[d]) for d in waiting}
    for doc in waiting:
        need = int(rest[doc])
        while need:
            fits = room >= need
            if fits.any():
                s, n = int(np.where(fits, cost, np.inf).argmin()), need
            else:
                s = int(room.argmax())
                n = int(room[s])
            pieces.append((doc, at[doc], n, sequence + s, int(used[s])))
            at[doc] += n
            need -= n
            room[s] -= n
            used[s] += n
            cost[s] += linear * n + quadratic * n * n
    return pieces


def pack_documents(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Pack all documents; one row for each piece.

    Columns: the id, ``start`` (ids of the document before the piece), ``length``, ``ids`` binary
    (the piece's unsigned 16-bit ids), ``doc_tokens``, ``sequence_id``, ``offset``. One shuffle, of the
    two-byte ids; a task holds one part of a block. Sequences are numbered through each block.
    """
    count, width = measured(docs, text_column)
    blocks = max(1, math.ceil(count / block_docs))
    rows = token_rows(docs, vocabulary, id_column, text_column)
    block = F.pmod(F.xxhash64(id_column, "ids", F.pmod(F.spark_partition_id(), F.lit(SCANS))), F.lit(blocks))
    rows = rows.select(block.alias("block"), F.col(id_column).alias("id"), F.length("ids").alias("n"), "ids")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, made = None, 0
        for block, group in parts(batches):
            current, made = block, made if block == current else 0
            pieces, sequences = pack_block(group, (block << 32) + made, length, id_column)
            made += sequences
            yield pieces

    schema = f"`{id_column}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    # The order within a block decides the packing, so it must not hang on how rows arrive.
    dealt = rows.repartition(width, "block").sortWithinPartitions("block", "id", "n", F.crc32("ids"))
    return dealt.mapInArrow(run, schema)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Cut rows (block, id, n, ids) sorted by block into parts of one block and of bounded numbers of rows and bytes."""
    held: list[pa.RecordBatch] = []
    last, rows, size = None, 0, 0
    for batch in batches:
        start = 0
        for i, (block, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            if block != last or rows == MOST_DOCS or size + n > PART_BYTES:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield last, pa.Table.from_batches(held)
                held, last, rows, size, start = [], block, 0, 0, i
            rows += 1
            size += n
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield last, pa.Table.from_batches(held)


def pack_block(group: pa.Table, first: int, length: int, id_column: str) -> tuple[pa.RecordBatch, int]:
    """The pieces of one part of a block, and its number of sequences, numbered from ``first``."""
    ids = [np.frombuffer(x, "<u2") for x in group.column("ids").to_pylist()]
    names = group.column("id").combine_chunks()
    pieces = pack_lengths(np.array([len(x) for x in ids], np.int64), length)
    doc, start, size, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
    columns = [
        names.take(pa.array(doc)),
        pa.array(start),
        pa.array(size),
        pa.array([ids[d][a : a + n].tobytes() for d, a, n in zip(doc, start, size, strict=True)], pa.binary()),
        pa.array([len(ids[d]) for d in doc], pa.int64()),
        pa.array(sequence + first),
        pa.array(offset),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[id_column, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]), int(sequence.max()) + 1


def piece_checksums(pieces: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32`` long: crc32 of the ids as little-endian unsigned 32-bit."""
    schema = pieces.schema
    at = schema.fieldNames().index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in batch.column(at).to_pylist()]
            columns = [pa.array(sums, pa.int64()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=["ids_crc32" if i == at else n for i, n in enumerate(batch.schema.names)])

    fields = ", ".join("ids_crc32 bigint" if f.name == "ids" else f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return pieces.mapInArrow(run, fields)
