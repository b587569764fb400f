"""BPE with word ends as a streaming transducer of bounded lookahead, and a decoder that is a state machine.

Which token a piece begins with can hang on symbols further right only through a chain of merges, each of
which takes the right end of a token away before a merge of lower priority uses it. Ranks fall along such a chain, so one pass over the merge list
bounds its length for every token (``Merges.look``): a token is stable as soon as that many symbols behind it are known. The transducer holds
a window of symbols, merges it, and emits the tokens that are stable; a piece of any length takes constant memory.

Texts are read in blocks that end where normalisation can't reach across; a piece that a block leaves open is carried on, a long one inside the
transducer. Pieces that are whole and short are kept with their ids in a bounded cache.

Defined cases: null and empty texts have no tokens. Whole texts are read, of any length. Special tokens that a text spells out are those tokens, as in the tokenizer's own library.
Repeated texts and rows are encoded each on its own; ids may be of any type; other columns are not read.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from tokenizers import normalizers, pre_tokenizers

from litspan.llm.common import slices, texts

OTHER, LETTER, NUMBER, WHITE = range(4)
BLOCK = 1 << 16  # code points read at once
HOLD = 1024  # code points of an open piece that are carried as text; beyond it the transducer holds them
CACHED, MOST = 48, 1 << 18  # longest piece in the cache, and the number of them
SLICE = 1 << 20  # code points of texts whose ids are built before they are passed on
QUOTE = "'"


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else one of those from 256 on."""
    printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(printed))}
    return [others.get(b, chr(b)) for b in range(256)]


class Merges:
    """A merge list: the symbols of bytes, pairs by priority, and the sufficient lookahead of each token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        letters = byte_letters()
        self.plain = [self.vocabulary[c] for c in letters]
        self.final = [self.vocabulary[c + self.end] for c in letters]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        size = max(self.vocabulary.values()) + 1
        self.length, self.look = [1] * size, [0] * size
        known = {*self.plain, *self.final}
        for k, (a, b) in enumerate(pairs):
            x, z, t = self.vocabulary[a], self.vocabulary[b], self.vocabulary[a + b]
            if x not in known or z not in known or t in known:
                raise ValueError(f"merge {k} joins tokens that no earlier merge has made, or makes one again")
            known.add(t)
            self.rank[x, z] = k
            self.made.append(t)
            self.length[t] = self.length[x] + self.length[z]
            # t needs what z needs at this rank; from now on x can be taken by z, which needs all that z does
            self.look[t] = self.look[z]
            self.look[x] = max(self.look[x], self.length[z] + self.look[z])
        #: Symbols that decide the first token of any window.
        self.window = max(n + far for n, far in zip(self.length, self.look, strict=True))

    def merge(self, symbols: list[int]) -> list[int]:
        """Join the pair of lowest rank, leftmost first, until no pair is left."""
        return self._by_heap(symbols) if len(symbols) > 24 else self._by_scan(symbols)

    def _by_scan(self, symbols: list[int]) -> list[int]:
        parts, never = list(symbols), len(self.made)
        ranks = [self.rank.get(pair, never) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) < never:
            i = ranks.index(low)
            parts[i : i + 2] = [self.made[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.rank.get((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = self.rank.get((parts[i], parts[i + 1]), never)
        return parts

    def _by_heap(self, symbols: list[int]) -> list[int]:
        parts: list[int | None] = list(symbols)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or self.rank.get((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = self.made[r], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := self.rank.get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (q, i))
            if (h := before[i]) >= 0 and (q := self.rank.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (q, h))
        return [p for p in parts if p is not None]


class Transducer:
    """Symbols of one piece in, stable tokens out; between calls it holds fewer than two windows."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.held: list[int] = []
        self.last = -1  # the newest byte: whether it ends the piece isn't known yet

    def push(self, data: bytes) -> list[int]:
        """Take more bytes of the piece; the tokens that no further byte can change."""
        m, out = self.merges, []
        if not data:
            return out
        known = data[:-1] if self.last < 0 else bytes([self.last]) + data[:-1]
        self.last = data[-1]
        for k in range(0, len(known), m.window):
            self.held += [m.plain[b] for b in known[k : k + m.window]]
            if len(self.held) >= 2 * m.window:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        m, out, at = self.merges, [], 0
        for token in m.merge(self.held):
            stop = at + m.length[token]
            if stop + m.look[token] > len(self.held):
                break
            out.append(token)
            at = stop
        del self.held[:at]
        return out

    def close(self) -> list[int]:
        """The piece ends: the tokens of what is held."""
        if self.last < 0:
            return []
        symbols = [*self.held, self.merges.final[self.last]]
        self.held, self.last = [], -1
        return self.merges.merge(symbols)


def _every() -> str:
    """The code points below 0x40000, beyond which there are no letters, numbers, blanks or compositions."""
    return np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x40000)]).astype("<u4").tobytes().decode("utf-32-le")


@cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER of every code point, as the tokenizer library's patterns know them."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        kept = pre_tokenizers.Split(tokenizers.Regex(pattern), behavior="removed", invert=True).pre_tokenize_str(_every())
        kinds[np.frombuffer("".join(x for x, _ in kept).encode("utf-32-le"), "<u4")] = kind
    return kinds


@cache
def _lower() -> tuple[dict[int, str], re.Pattern]:
    """The library's lower case of every code point that has one, and a pattern of those that Python's ``lower`` makes otherwise (by place in the word, too)."""
    every = [c for c in _every() if c.lower() != c or ord(c) > 0x7F and unicodedata.category(c) in ("Cn", "Lu", "Lt", "So", "Nl")]
    low = normalizers.Lowercase().normalize_str("\n".join(every)).split("\n")
    table = {ord(c): x for c, x in zip(every, low, strict=True) if c != x}
    odd = [c for c, x in zip(every, low, strict=True) if c.lower() != x] + ["Σ"]
    return table, re.compile("[" + "".join(map(re.escape, odd)) + "]")


@cache
def _seconds() -> frozenset[str]:
    """Characters that can join the one before them when text is composed: second halves of decompositions, and vowels and finals of Hangul."""
    pairs = (unicodedata.decomposition(c) for c in _every())
    found = {chr(int(x.split(" ")[1], 16)) for x in pairs if x and x[0] != "<" and " " in x}
    return frozenset(found | set(map(chr, range(0x1160, 0x1200))))


def _apart(c: str) -> bool:
    """Nothing before ``c`` is composed or ordered with it or what follows it."""
    if ord(c) < 0x300:
        return True
    head = unicodedata.normalize("NFD", c)[0]
    return unicodedata.category(c) != "Cn" and not unicodedata.combining(head) and head not in _seconds()


def blocks(text: str, size: int) -> Iterator[str]:
    """Consecutive parts of about ``size`` code points; a run of marks longer than that stays whole."""
    at = 0
    while at < len(text):
        stop = at + size
        while stop > at + size // 2 and stop < len(text) and not _apart(text[stop]):
            stop -= 1
        if stop == at + size // 2:
            stop = at + size
            while stop < len(text) and not _apart(text[stop]):
                stop += 1
        yield text[at:stop]
        at = stop


_NFC = normalizers.NFC()


def normalized(text: str) -> str:
    """Composed and lower-cased as the tokenizer library does it."""
    if text.isascii():
        return text.lower()
    if max(text) >= "̀":
        text = _NFC.normalize_str(text)
    table, odd = _lower()
    return text.translate(table) if odd.search(text) else text.lower()


def cuts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of white space and pieces start, and the class of each code point.

    A piece is a contraction, a run of letters, one number, or a run of other characters; a quote begins a contraction only where it begins a run.
    """
    kind = classes()[points]
    n = len(points)
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    quotes = np.flatnonzero((points == ord(QUOTE)) & start)
    if len(quotes):
        wide = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = wide[quotes + 1], wide[quotes + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for found, far in ((quotes[one], 2), (quotes[two], 3)):
            start[found + 1] = False
            start[(found + far)[found + far < n]] = True
    return np.flatnonzero(start), kind


class Pieces(dict):
    """Ids of short pieces as bytes; a missing one goes through the transducer."""

    def __init__(self, merges: Merges, most: int = MOST):
        super().__init__()
        self.merges, self.most = merges, most

    def __missing__(self, piece: str) -> bytes:
        machine = Transducer(self.merges)
        ids = array("I", machine.push(piece.encode()) + machine.close()).tobytes()
        if len(piece) <= CACHED:
            self[piece] = ids
        return ids

    def trim(self) -> None:
        """Forget the older half when there are too many."""
        if len(self) > self.most:
            for piece in list(islice(self, len(self) // 2)):
                del self[piece]


class Reader:
    """Reads the blocks of one text; between blocks it keeps the last piece, as text or inside a transducer."""

    def __init__(self, pieces: Pieces, hold: int = HOLD):
        self.pieces, self.hold = pieces, hold
        self.carry, self.open, self.kind = "", None, OTHER

    def feed(self, block: str, final: bool) -> Iterator[bytes]:
        s = self.carry + normalized(block)
        self.carry = ""
        points = np.frombuffer(s.encode("utf-32-le"), "<u4")
        if self.open is not None:
            differs = np.flatnonzero(classes()[points] != self.kind)
            run = int(differs[0]) if len(differs) else len(s)
            yield array("I", self.open.push(s[:run].encode())).tobytes()
            if run == len(s) and not final:
                return
            yield array("I", self.open.close()).tobytes()
            self.open, s, points = None, s[run:], points[run:]
        if not s:
            return
        starts, kind = cuts(points)
        places, white = [*starts.tolist(), len(s)], (kind[starts] == WHITE).tolist()
        if not final:
            keep = places[-2]
            if kind[-1] == LETTER and s[-2:-1] == QUOTE and len(s) - 2 in places[-3:-1]:
                keep = len(s) - 2  # may become a contraction of three
            self.carry = s[keep:]
            while places[-1] > keep:
                places.pop()
            white = white[: len(places) - 1]
        self.pieces.trim()
        found = [s[a:b] for a, b, w in zip(places, places[1:], white, strict=False) if not w]
        yield b"".join(map(self.pieces.__getitem__, found))
        if len(self.carry) > max(self.hold, 3) and kind[-1] != WHITE:
            self.open, self.kind = Transducer(self.pieces.merges), kind[-1]
            yield array("I", self.open.push(self.carry.encode())).tobytes()
            self.carry = ""
        elif kind[-1] == WHITE:
            self.carry = self.carry[:1]


def encode(text: str, pieces: Pieces, block: int = BLOCK, hold: int = HOLD) -> Iterator[bytes]:
    """Ids of a text as unsigned 32-bit, in parts, each as soon as it is stable."""
    special = pieces.merges.special
    parts = re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text) if any(x in text for x in special) else [text]
    for k, part in enumerate(parts):
        if k % 2:
            yield array("I", [special[part]]).tobytes()
            continue
        reader, waiting = Reader(pieces, hold), None
        for b in blocks(part, block):
            if waiting is not None:
                yield from reader.feed(waiting, False)
            waiting = b
        if waiting is not None:
            yield from reader.feed(waiting, True)


class Decoder:
    """Ids to text, block by block. The state is whether a token came before, and up to three bytes of an unfinished character.

    ``spaced`` gives the tokens' own spelling with blanks between, as the library does for a vocabulary file without a decoder; otherwise bytes are decoded and word ends become blanks.
    """

    def __init__(self, merges: Merges, spaced: bool = True):
        letters = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        spelled = {i: t for t, i in (merges.vocabulary | merges.special).items()}
        table = [b""] * (max(spelled) + 1)
        for i, t in spelled.items():
            if spaced:
                table[i] = b" " + t.encode()
            elif t in merges.special:
                table[i] = t.encode()
            else:
                word = merges.end and t.endswith(merges.end)
                table[i] = b"".join(map(letters.__getitem__, t.removesuffix(merges.end) if word else t)) + b" " * bool(word)
        self.spaced = spaced
        self.length = np.array([len(x) for x in table], np.intp)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.begin()

    def begin(self) -> None:
        """A new text."""
        self.first, self.state = self.spaced, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray, final: bool) -> str:
        """The characters that are whole after these ids; at the end, unfinished bytes become replacement characters."""
        length = self.length[ids]
        shift = self.offset[ids] - (np.cumsum(length) - length)
        data = self.bytes[np.arange(length.sum()) + np.repeat(shift, length)].tobytes()
        if self.first and len(ids):
            data, self.first = data[1:], False
        return self.state.decode(data, final)

    def decode(self, ids: np.ndarray, block: int = BLOCK) -> Iterator[str]:
        """All of one text's ids, in blocks."""
        self.begin()
        for k in range(0, max(len(ids), 1), block):
            yield self.feed(ids[k : k + block], k + block >= len(ids))


@cache
def merges_of(path: str) -> Merges:
    return Merges(path)


@cache
def pieces_of(path: str) -> Pieces:
    """The cache of this worker for a vocabulary file."""
    return Pieces(merges_of(path))


@cache
def decoder_of(path: str, spaced: bool) -> Decoder:
    return Decoder(merges_of(path), spaced)


def encode_documents(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every whole text: id column, ``n_tokens`` long, ``ids`` binary (little-endian unsigned 32-bit). No shuffle: one pass over the two columns."""
    frame = docs.select(id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary)
        for batch in batches:
            rows = texts(batch.column(1))
            for lo, hi in slices(batch, [len(t) for t in rows], SLICE):
                ids = [b"".join(encode(t, pieces)) for t in rows[lo:hi]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[id_column, "n_tokens", "ids"])

    return frame.mapInArrow(run, f"`{id_column}` {frame.schema[id_column].dataType.simpleString()}, n_tokens bigint, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str, spaced: bool = True) -> DataFrame:
    """Add ``decoded`` string to a frame that has ``ids`` binary (null: no ids). Other columns stay as they are."""
    at = encoded.schema.fieldNames().index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoder_of(vocabulary, spaced)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = ["".join(decoder.decode(np.frombuffer(x or b"", "<u4"))) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*part.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded string")
