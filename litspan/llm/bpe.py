"""Byte-level BPE with vectorised pre-tokenisation.

Piece boundaries are found without a regex engine. Every code point becomes a symbol (its class,
plus what the next code point says about it), every symbol is a function on eight automaton
states, and the composition of such functions is associative. The functions that compositions can
reach are few and numbered once, so composing is one table lookup. The text is cut into columns,
each column's product is built, a prefix scan over the products gives each column's entry state,
and one more sweep reads off the boundaries. Pieces are merged once and kept in a bounded cache.

Null and empty texts have no tokens. A text is never cut: its pieces are merged one at a time, so
memory is bounded by the longest text of a batch. Repeated texts are encoded each on its own. Ids may be of any type.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from litspan.llm.common import slices, texts

#: Symbols of the automaton. A blank that a word follows binds to it (BIND); another white space
#: before a word stands alone (LONE); the rest of a white-space run stays together (RUN).
LETTER, NUMBER, OTHER, RUN, BIND, LONE, SHORT, LONG = range(8)
#: States: outside, in letters, in numbers, in others, in white space, after a binding blank, and
#: with one or two letters of a contraction to come.
OUT, IN_L, IN_N, IN_O, IN_W, BOUND, ONE, TWO = range(8)
STATES, FRESH = 8, 8  # symbol + FRESH: the same symbol as the first of a text
IDENTITY = 16
CHUNK = 1 << 20  # code points handled at once
COLUMN = 64  # code points of a column of the scan


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and boundary flag, by [symbol, state]."""
    step, cut = np.zeros((17, STATES), np.intp), np.ones((17, STATES), bool)
    stays = {LETTER: (IN_L, (IN_L, BOUND)), NUMBER: (IN_N, (IN_N, BOUND)), OTHER: (IN_O, (IN_O, BOUND)), RUN: (IN_W, (IN_W,))}
    for symbol, (to, joined) in stays.items():
        step[symbol] = to
        cut[symbol, list(joined)] = False
    step[LETTER, ONE], step[LETTER, TWO] = OUT, ONE
    cut[LETTER, [ONE, TWO]] = False
    step[BIND], step[LONE] = BOUND, OUT
    for symbol, to in ((SHORT, ONE), (LONG, TWO)):
        step[symbol] = to
        step[symbol, [IN_O, BOUND]] = IN_O
        cut[symbol, [IN_O, BOUND]] = False
    for symbol in range(8):
        step[symbol + FRESH] = step[symbol, OUT]
    step[IDENTITY], cut[IDENTITY] = np.arange(STATES), False
    return step, cut


def _monoid(step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that symbols generate by composition: for each its value at OUT, the product
    with each symbol, and the product with each other function. Function 0 is the identity."""
    found = {tuple(range(STATES)): 0}
    order = [tuple(range(STATES))]
    for f in order:
        for row in step:
            g = tuple(row[list(f)].tolist())
            if g not in found:
                found[g] = len(order)
                order.append(g)
    table = np.array(order)
    by_symbol = np.array([[found[tuple(row[list(f)].tolist())] for row in step] for f in order])
    by_function = np.array([[found[tuple(g[f].tolist())] for g in table] for f in table])
    return table[:, OUT], by_symbol, by_function


def members(pattern: str) -> np.ndarray:
    """The code points of a character class, as the tokenizer libraries know it.

    The class is asked of the library itself, whose Unicode version is not Python's: a tokenizer whose pieces are
    single members of it, with bytes for tokens, keeps the members of a text that holds every code point.
    """
    every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4").tobytes().decode("utf-32-le")
    single = {bytes([b]): b for b in range(256)}
    kept = bytes(tiktoken.Encoding("members", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every))
    return np.frombuffer(kept.decode().encode("utf-32-le"), "<u4")


@cache
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or RUN of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", RUN)):
        kinds[members(pattern)] = kind
    return kinds


_STEP, _CUT = _automaton()
_AT_OUT, _BY_SYMBOL, _BY_FUNCTION = _monoid(_STEP)
_SYMBOLS, _FUNCTIONS = _BY_SYMBOL.shape[1], len(_BY_SYMBOL)
#: For one sweep: next state and boundary in one number, by symbol * STATES + state.
_MOVE = (_STEP * 2 + _CUT).ravel()


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which pieces start in concatenated texts.

    ``points`` are code points, ``first`` the positions of each non-empty text's first one.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.intp)
    symbol = _classes()[points]
    last = np.zeros(n, bool)  # the last code point of a text looks at nothing
    last[first[1:] - 1] = last[n - 1] = True
    white = symbol == RUN
    lone = np.flatnonzero(white[:-1] & ~white[1:] & ~last[:-1])
    symbol[lone] = np.where(points[lone] == 0x20, BIND, LONE)
    quotes = np.flatnonzero((points == 0x27) & ~last)
    if len(quotes):
        a = points[quotes + 1]
        one = np.isin(a, [ord(x) for x in "stmd"])
        far = np.minimum(quotes + 2, n - 1)
        b = np.where(last[quotes + 1], 0, points[far])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        symbol[quotes[one]] = SHORT
        symbol[quotes[two]] = LONG
    symbol[first] += FRESH

    width = -(-n // COLUMN)
    table = np.full(width * COLUMN, IDENTITY, np.uint8)
    table[:n] = symbol
    rows = np.ascontiguousarray(table.reshape(width, COLUMN).T)
    product, by_symbol = np.zeros(width, np.intp), _BY_SYMBOL.ravel()
    for row in rows:
        product *= _SYMBOLS
        product += row
        product = by_symbol.take(product)
    reach, by_function = 1, _BY_FUNCTION.ravel()
    while reach < width:  # prefix scan: product[i] becomes the function of columns 0..i
        product[reach:] = by_function.take(product[:-reach] * _FUNCTIONS + product[reach:])
        reach *= 2
    state = np.concatenate([[OUT], _AT_OUT[product[:-1]]])
    cuts = np.empty((COLUMN, width), bool)
    for j, row in enumerate(rows):
        state += row.astype(np.intp) * STATES
        moved = _MOVE.take(state)
        cuts[j] = moved & 1
        state = moved >> 1
    return np.flatnonzero(cuts.T.ravel()[:n])


def read_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a vocabulary file with lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: join the adjacent pair of lowest rank, leftmost first, until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 96:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        best = min(pairs)
        if best == 1 << 40:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 40)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 40)
    return [ranks[x] for x in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge_piece, with a heap over a linked list: n log n for very long pieces."""
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        middle = end[i]
        alive[middle] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (left := before[i]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Merged(dict):
    """Pieces already merged, as little-endian ids; a piece that is missing is merged and kept.

    The public tokenizer library's merge loop for one piece does the merging where it has one
    (merge_piece gives the same ids, ten times slower)."""

    def __init__(self, ranks: dict[bytes, int], code: str, most: int = 1 << 18):
        super().__init__()
        self.ranks, self.code, self.most = ranks, code, most
        merge = getattr(tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}), "_encode_single_piece", None)
        self.merge = merge or (lambda piece: merge_piece(piece, ranks))

    def __missing__(self, piece: str) -> bytes:
        ids = array(self.code, self.merge(piece.encode())).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def trim(self) -> None:
        """Forget the older half when there are too many: memory stays bounded on any corpus."""
        if len(self) > self.most:
            for piece in list(islice(self, len(self) // 2)):
                del self[piece]


@cache
def encoder(path: str, code: str = "I") -> Merged:
    """The piece cache of this worker for a vocabulary file; ids are unsigned, of 4 ("I") or 2 ("H") bytes."""
    return Merged(read_ranks(path), code)


def encode(batch: list[str], merged: Merged, offsets: bool = False) -> Iterator[tuple[bytes, bytes]]:
    """Ids (and, if asked for, the code point offset of each piece as unsigned 32-bit) of each text."""
    lengths = np.array([len(t) for t in batch], np.intp)
    whole = "".join(batch)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    starts = piece_starts(points, begin[:-1][lengths > 0])
    edges = np.searchsorted(starts, begin)
    places = [*starts.tolist(), len(whole)]
    for i in range(len(batch)):
        lo, hi = edges[i], edges[i + 1]
        merged.trim()
        ids = b"".join(map(merged.__getitem__, map(whole.__getitem__, map(slice, places[lo:hi], places[lo + 1 : hi + 1]))))
        yield ids, ((starts[lo:hi] - begin[i]).astype("<u4").tobytes() if offsets else b"")


class Decoder:
    """Bytes of ids, by the vocabulary's concatenated bytes and the offset of each id in them."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        size = max(ranks.values()) + 1
        pieces = [b""] * size
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.length = np.array([len(p) for p in pieces], np.intp)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        """The decoded bytes; ids are handled in blocks, so a long text needs no long index array."""
        out = []
        for k in range(0, len(ids), CHUNK // 4):
            part = ids[k : k + CHUNK // 4]
            length = self.length[part]
            shift = self.offset[part] - (np.cumsum(length) - length)
            out.append(self.bytes[np.arange(length.sum()) + np.repeat(shift, length)].tobytes())
        return b"".join(out)


@cache
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", offsets: bool = False) -> DataFrame:
    """Encode every whole text: id column, ``n_tokens`` long, ``ids`` binary (little-endian unsigned
    32-bit) and, with ``offsets``, ``offsets`` binary (each piece's first code point).

    No shuffle: one pass over the scan, with only the two columns read. Null text counts as empty.
    """
    ids = docs.select(id_column, text_column)
    kind = ids.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = encoder(vocabulary)
        for batch in batches:
            rows = texts(batch.column(1))
            for lo, hi in slices(batch, [len(t) for t in rows], CHUNK):
                found = list(encode(rows[lo:hi], merged, offsets))
                columns = [batch.column(0).slice(lo, hi - lo), pa.array([len(a) // 4 for a, _ in found], pa.int64()), pa.array([a for a, _ in found], pa.binary())]
                names = [id_column, "n_tokens", "ids"]
                if offsets:
                    columns, names = [*columns, pa.array([b for _, b in found], pa.binary())], [*names, "offsets"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_column}` {kind}, n_tokens bigint, ids binary" + (", offsets binary" if offsets else "")
    return ids.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Add ``decoded`` binary to a frame that has ``ids`` binary. Other columns stay as they are."""
    schema = encoded.schema
    at = schema.fieldNames().index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                bytes_ = [decode(np.frombuffer(x or b"", "<u4")) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bytes_, pa.binary())], names=[*part.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")
