"""Encoding of a corpus with a public byte-level BPE tokenizer.

The splitting pattern of byte-level BPE is evaluated without a regular expression engine. Every code
point is mapped to a character class; each class acts on the scanner's state as a function, the closure
of those functions under composition is a small monoid, and because composition is associative the state
before every character comes out of one blocked prefix scan over function numbers. Token starts are then
a vectorised expression of (state before, class, next class). The slices between starts are looked up in
a cache of merged pieces; pieces seen for the first time are merged by rank.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Character classes. A class plus RESET is the same character as the first one of a text.
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE = range(6)
RESET = 8

# Scanner states: what the last character left behind.
S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_SPACE, S_QUOTE = range(6)

#: The Unicode White_Space property.
WHITE_SPACE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

#: Pieces kept in the cache of one worker; beyond it the cache starts afresh. Results don't depend on it.
CACHE_PIECES = 600_000
#: Characters scanned at once, and slices looked up at once.
SCAN_CHARS = 1 << 21
LOOKUP_SLICES = 1 << 19
#: Longer pieces are merged with a heap.
HEAP_FROM = 48


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point."""
    kinds = np.fromiter((ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)), np.uint8, 0x110000)
    table = np.full(0x110000, OTHER, np.uint8)
    table[kinds == ord("L")] = LETTER
    table[kinds == ord("N")] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    table[0x20] = BLANK
    table[0x27] = QUOTE
    return table


@lru_cache(maxsize=1)
def transition_monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each class's function, composition table, functions as rows of resulting states)."""

    def step(cls: int, state: int) -> int:
        if cls == QUOTE:
            return S_OTHER if state in (S_OTHER, S_BLANK, S_QUOTE) else S_QUOTE
        return {LETTER: S_LETTER, NUMBER: S_NUMBER, OTHER: S_OTHER, BLANK: S_BLANK, SPACE: S_SPACE}[cls]

    functions = [tuple(range(6))]
    number = {functions[0]: 0}

    def add(f: tuple[int, ...]) -> int:
        if f not in number:
            number[f] = len(functions)
            functions.append(f)
        return number[f]

    of_class = np.zeros(16, np.uint8)
    for cls in range(6):
        of_class[cls] = add(tuple(step(cls, s) for s in range(6)))
        of_class[cls + RESET] = add((step(cls, S_SPACE),) * 6)
    grown = 0
    while grown < len(functions):
        grown = len(functions)
        for f in list(functions):
            for g in list(functions):
                add(tuple(g[s] for s in f))
    n = len(functions)
    compose = np.zeros((16, 16), np.uint8)
    for i, f in enumerate(functions):
        for j, g in enumerate(functions):
            compose[i, j] = number[tuple(g[s] for s in f)]
    assert n <= 16
    rows = np.zeros((16, 6), np.uint8)
    rows[:n] = functions
    return of_class, compose.ravel(), rows


def scan_states(classes: np.ndarray, block: int = 512) -> np.ndarray:
    """State before each character, by an associative scan over function numbers."""
    of_class, compose, rows = transition_monoid()
    n = len(classes)
    width = -(-n // block)
    f = np.zeros(width * block, np.uint8)
    f[:n] = of_class[classes]
    f = np.ascontiguousarray(f.reshape(width, block).T)
    for j in range(1, block):
        np.take(compose, (f[j - 1] << 4) | f[j], out=f[j])
    total = f[-1].copy()
    shift = 1
    while shift < width:
        total[shift:] = compose[(total[:-shift] << 4) | total[shift:]]
        shift <<= 1
    entry = np.full(width, S_SPACE, np.uint8)
    entry[1:] = rows[total[:-1], S_SPACE]
    states = np.empty((block, width), np.uint8)
    states[0] = entry
    flat = rows.ravel()
    for j in range(1, block):
        np.take(flat, f[j - 1].astype(np.uint16) * 6 + entry, out=states[j])
    return states.T.reshape(-1)[:n]


def token_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a piece begins. first marks the first character of each text."""
    classes = class_table()[codes]
    before = scan_states(np.where(first, classes + RESET, classes).astype(np.uint8))
    spacing = (classes == BLANK) | (classes == SPACE)
    symbol = (classes == OTHER) | (classes == QUOTE)
    goes_on = (
        ((classes == LETTER) & (before == S_LETTER))
        | ((classes == NUMBER) & (before == S_NUMBER))
        | (symbol & ((before == S_OTHER) | (before == S_QUOTE)))
        | (before == S_BLANK)
    )
    starts = ~spacing & ~goes_on
    followed = np.zeros(len(codes), bool)
    followed[:-1] = ~spacing[1:] & ~first[1:]
    starts |= spacing & (((before != S_BLANK) & (before != S_SPACE)) | followed)
    starts |= first

    # A contraction takes one or two letters after an apostrophe that begins a piece.
    at = np.flatnonzero((classes == QUOTE) & ((before == S_LETTER) | (before == S_NUMBER) | (before == S_SPACE) | first))
    if len(at):
        padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
        broken = np.concatenate([first, np.ones(3, bool)])
        a, b = np.where(broken[at + 1], 0, padded[at + 1]), np.where(broken[at + 1] | broken[at + 2], 0, padded[at + 2])
        one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
        two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        starts[at[one | two] + 1] = False
        after = np.concatenate([at[one] + 2, at[two] + 3])
        after = after[after < len(codes)]
        starts[after[classes[after] == LETTER]] = True
    return starts


class Merger:
    """Rank-ordered pair merging with a cache of merged pieces.

    The cache numbers the pieces; their ids lie one after another in one growing array, so that a block of
    slices becomes ids by two array gathers. Unknown pieces of a block are merged together, by length.
    """

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        ranks = self.ranks
        pairs = sorted(((ranks[a] << 17 | ranks[b]), whole) for piece, whole in ranks.items() for cut in range(1, len(piece)) if (a := piece[:cut]) in ranks and (b := piece[cut:]) in ranks)
        self.none = 1 << 17
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes that each id stands for
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        self.pair_keys = np.array([k for k, _ in pairs] + [1 << 40], np.int64)
        self.pair_ids = np.array([v for _, v in pairs] + [self.none], np.int32)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.forget()

    def forget(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.counts = np.zeros(1 << 12, np.int32)
        self.begins = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.int32)
        self.pieces = self.filled = 0

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece of any length, from a heap of (rank, position)."""
        ranks, n = self.ranks, len(piece)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 17 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ids[at], self.none)

    def merge_together(self, pieces: list[bytes], length: int) -> list[np.ndarray]:
        """Merge pieces of one length: in each round every unfinished row joins its leftmost best pair."""
        rows = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)].reshape(-1, length)
        joined = self._pair(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), -1)
        owner, out = np.arange(len(rows)), [None] * len(rows)
        while True:
            j = joined.argmin(1)
            best = joined[np.arange(len(rows)), j]
            done = best == self.none
            if done.any():
                for k, row in zip(owner[done].tolist(), rows[done]):
                    out[k] = row
                keep = ~done
                rows, joined, owner, j, best = rows[keep], joined[keep], owner[keep], j[keep], best[keep]
            n, width = rows.shape
            if not n:
                return out
            each = np.arange(n)
            rows[each, j] = best
            mask = np.ones((n, width), bool)
            mask[each, j + 1] = False
            rows = rows[mask].reshape(n, width - 1)
            mask = np.ones((n, width - 1), bool)
            mask[each, j] = False
            joined = joined[mask].reshape(n, width - 2)
            if width == 2:
                for k, row in zip(owner.tolist(), rows):
                    out[k] = row
                return out
            left = j > 0
            joined[each[left], j[left] - 1] = self._pair(rows[each[left], j[left] - 1], rows[each[left], j[left]])
            right = j < width - 2
            joined[each[right], j[right]] = self._pair(rows[each[right], j[right]], rows[each[right], j[right] + 1])

    def _learn(self, unknown: list[bytes]) -> None:
        by_length: dict[int, list[bytes]] = {}
        for piece in unknown:
            by_length.setdefault(len(piece), []).append(piece)
        pieces, merged = [], []
        for length, group in by_length.items():
            pieces += group
            if length == 1:
                merged += [[self.ranks[p]] for p in group]
            elif length >= HEAP_FROM or len(group) < 12:
                merged += map(self.merge, group)
            else:
                merged += self.merge_together(group, length)
        counts = np.fromiter(map(len, merged), np.int32, len(merged))
        ids = np.concatenate([np.asarray(m, np.int32) for m in merged])
        n, size = self.pieces + len(pieces), self.filled + len(ids)
        if n > len(self.counts):
            self.counts, self.begins = np.resize(self.counts, 2 * n), np.resize(self.begins, 2 * n)
        if size > len(self.ids):
            self.ids = np.resize(self.ids, 2 * size)
        self.counts[self.pieces : n] = counts
        self.begins[self.pieces : n] = self.filled + np.cumsum(counts) - counts
        self.ids[self.filled : size] = ids
        self.cache.update(zip(pieces, range(self.pieces, n)))
        self.pieces, self.filled = n, size

    def lookup(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each)."""
        if len(self.cache) > CACHE_PIECES:
            self.forget()
        found = np.fromiter(map(self.cache.get, pieces, repeat(-1)), np.int64, len(pieces))
        missed = np.flatnonzero(found < 0).tolist()
        if missed:
            self._learn(list(dict.fromkeys([pieces[k] for k in missed])))
            get = self.cache.__getitem__
            found[missed] = [get(pieces[k]) for k in missed]
        counts = self.counts[found].astype(np.int64)
        ends = np.cumsum(counts)
        at = np.repeat(self.begins[found] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[at], counts


@lru_cache(maxsize=4)
def merger(vocabulary: str) -> Merger:
    return Merger(vocabulary)


def encode_pieces(data: np.ndarray, lengths: np.ndarray, vocabulary: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, piece's first byte, ids per piece), block by block, of texts that lie one after another in UTF-8."""
    tool = merger(vocabulary)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(codes) + 1, bool)
    first[np.concatenate([[0], np.cumsum(lengths)])] = True
    first = first[:-1]
    begins = np.empty(len(codes), bool)
    at = 0
    while at < len(codes):  # a scan ends where a text does
        stop = min(len(codes), at + SCAN_CHARS)
        if stop < len(codes):
            cut = np.flatnonzero(first[at + 1 : stop])
            stop = at + 1 + int(cut[-1]) if len(cut) else len(codes)
        mark = first[at:stop]
        begins[at:stop] = token_starts(codes[at:stop], mark)
        at = stop
    starts = lead[begins]
    raw = data.tobytes()
    for k in range(0, len(starts), LOOKUP_SLICES):
        part = starts[k : k + LOOKUP_SLICES]
        edges = [*part.tolist(), int(starts[k + LOOKUP_SLICES]) if k + LOOKUP_SLICES < len(starts) else len(raw)]
        ids, counts = tool.lookup([raw[a:b] for a, b in zip(edges, edges[1:])])
        yield ids, part, counts


def _segments(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """A text's bytes in parts of about limit bytes, cut between a letter and a blank.

    A piece always begins there and what follows doesn't depend on what came before, so the parts can be
    encoded one by one. Where there is no such place the part goes on to the next one.
    """
    at = 0
    while at < len(data):
        stop = at + limit
        while stop < len(data):
            part = data[at:stop]
            blank = np.isin(part[1:], (9, 10, 13, 32))
            folded = part[:-1] | 0x20
            cuts = np.flatnonzero(blank & (folded >= ord("a")) & (folded <= ord("z")))
            if len(cuts):
                stop = at + 1 + int(cuts[-1])
                break
            stop += limit
        yield data[at:stop]
        at = stop


def encode_batch(texts: pa.Array, vocabulary: str, run_bytes: int = 4 << 20) -> tuple[pa.ListArray, pa.ListArray]:
    """(ids, offsets) of each text; empty lists for a null and for an empty text.

    An offset is the place of an id's first byte in the text's UTF-8. Slices lie one after another, so within a
    text the offsets are the running sum of what the ids stand for.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    if not len(data):
        empty = pa.array([[]] * len(texts), pa.list_(pa.int32()))
        return empty, empty
    edges = offsets - offsets[0]
    ids, per_text = [], np.zeros(len(texts), np.int64)
    if len(texts) == 1 and len(data) > run_bytes:
        for part in _segments(data, run_bytes):
            ids += [block for block, _, _ in encode_pieces(part, np.array([int((part & 0xC0 != 0x80).sum())]), vocabulary)]
        per_text[0] = sum(map(len, ids))
    else:
        lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        for block, at, counts in encode_pieces(data, lengths, vocabulary):
            ids.append(block)
            owner = np.searchsorted(edges, at, side="right") - 1
            per_text += np.bincount(owner, counts, len(texts)).astype(np.int64)
    every = np.concatenate(ids)
    sizes = merger(vocabulary).sizes[every]
    begins = np.cumsum(sizes) - sizes - np.repeat(edges[:-1], per_text)
    out = pa.array(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32))
    return tuple(pa.ListArray.from_arrays(out, pa.array(a, pa.int32())) for a in (every, begins))


def _bounded(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about limit bytes; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield at, i
            at, total = i, 0
        total += size
    yield at, len(sizes)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, run_bytes: int = 4 << 20, with_offsets: bool = False) -> DataFrame:
    """(id, ids) for every row of docs, without special tokens; with_offsets adds offsets, each id's first byte.

    Null and empty texts give empty lists. Control tokens written in a text are ordinary text. Repeated
    ids stay repeated rows, other columns are ignored whatever their names, an empty table gives an empty
    table. A map over the scan: no shuffle, so neither skew nor size of the corpus changes the plan.
    """
    names = [id_col, "ids", "offsets"][: 3 if with_offsets else 2]
    # The file goes to the workers with the job; where they have it in its place anyway, that one is read.
    docs.sparkSession.sparkContext.addFile(vocabulary)
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in names[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary))
        for batch in batches:
            for a, b in _bounded(batch.column(1), run_bytes):
                if b > a:
                    part = batch.slice(a, b - a)
                    lists = encode_batch(part.column(1), own, run_bytes)
                    yield pa.RecordBatch.from_arrays([part.column(0), *lists[: len(names) - 1]], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(ids: list[int], vocabulary: str = DEFAULT_VOCABULARY) -> str:
    """The text of a list of ids."""
    return b"".join(map(_pieces(vocabulary).__getitem__, ids)).decode("utf-8", errors="replace")


def decode_part(ids: list[int], offsets: list[int], first: int, last: int, vocabulary: str = DEFAULT_VOCABULARY) -> bytes:
    """The bytes first to last (excluded) of a text from its ids: only those are decoded that the offsets place there."""
    a, b = bisect_right(offsets, first) - 1, bisect_left(offsets, last)
    if first >= last or a < 0:
        return b""
    found = b"".join(map(_pieces(vocabulary).__getitem__, ids[a:b]))
    return found[first - offsets[a] : last - offsets[a]]


@lru_cache(maxsize=4)
def _pieces(vocabulary: str) -> dict[int, bytes]:
    return {rank: piece for piece, rank in merger(vocabulary).ranks.items()}
