"""Finding held-out passages inside a corpus, copied or reworded.

A randomised SVD, fitted by distributed passes over the TF-IDF vectors of the items' word windows, gives
every word a latent vector. Pieces of the corpus are projected with it and searched among the pieces of the items
by cosine, in blocks of one matrix product. Two sizes of pieces are asked: windows of six words, for copies, and
stretches of two dozen, for reworded parts. What comes near is checked word by word: for the longest run it has in
common with the passage, the longest common subsequence, and the share of its telling words (the answers: numbers,
names and other rare words) that the passage holds.

Copies are not lost by the search: a window copied from an item has cosine 1 with it, and their stride is such that
each run of min_run words holds a whole window. A stretch of which fewer words are known to the items than must be
common can't be a hit, so only such stretches are left out before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W_]+")
#: The items travel to the executors, so their text must stay within this; more are searched for in several calls.
MAX_ITEM_BYTES = 64 << 20
#: Cells of one matrix product.
BLOCK = 1 << 22


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and digits in lower case."""
    return WORD.findall(text.lower()) if text else []


@dataclass(frozen=True)
class Search:
    """What counts as a leak, and how it is looked for.

    min_run: words of a copy. span: words of a stretch, a shorter text is one stretch. min_common: share of a stretch
    that must be a common subsequence with the passage. min_answers: share of its telling words that the passage
    must hold. copy_cosine, stretch_cosine: how near a window or a stretch must be to be checked.
    """

    min_run: int = 12
    window: int = 6
    span: int = 24
    min_common: float = 0.5
    min_answers: float = 0.5
    copy_cosine: float = 0.9
    stretch_cosine: float = 0.5
    rank: int = 32

    def __post_init__(self) -> None:
        if self.window > self.min_run:
            raise ValueError("a window must not be longer than a run")


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.square(v).sum(-1, keepdims=True))
    return v / np.where(norm > 1e-12, norm, 1.0)


@dataclass
class LatentModel:
    """What the search needs of the items."""

    search: Search
    vocabulary: dict[str, int]
    words: np.ndarray  # latent vector of each word, weighted by its idf; a last row of zeros for other words
    telling: np.ndarray  # whether a word is rare among the items; a last one for other words
    members: np.ndarray  # items x words, other words last: whether the item holds the word
    items: list[tuple[int, np.ndarray]]  # (item id, word numbers)
    windows: np.ndarray  # word numbers of each item window
    window_at: np.ndarray  # (item's place, first word) of each
    window_vectors: np.ndarray
    stretch_item: np.ndarray  # item's place of each item stretch
    stretch_vectors: np.ndarray

    def project(self, ids: np.ndarray) -> np.ndarray:
        """Unit latent vectors of pieces (rows of word numbers)."""
        return _unit(self.words[ids].sum(1))


def _windows_of(ids: np.ndarray, size: int, stride: int = 1) -> np.ndarray:
    """Pieces of size words; the last one ends with the text, and a shorter text is one piece, filled up with -1."""
    if len(ids) <= size:
        return np.concatenate([ids, np.full(size - len(ids), -1, ids.dtype)])[None]
    starts = np.unique(np.append(np.arange(0, len(ids) - size + 1, stride), len(ids) - size))
    return ids[starts[:, None] + np.arange(size)]


def _partial_products(texts: DataFrame, vocabulary: dict[str, int], window: int, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A basis for the TF-IDF matrix A of the texts' windows, as a sum over partitions of bounded size |V| x columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(basis)
        weighted = basis * weights[:, None]
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = np.array([vocabulary[w] for w in words_of(text)], np.int64)
                if len(ids) < window:
                    continue
                pieces = _windows_of(ids, window)
                y = weighted[pieces].sum(1)
                for j in range(window):
                    np.add.at(total, pieces[:, j], y * weights[pieces[:, j]][:, None])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["part"])

    parts = texts.mapInArrow(run, "part array<double>")
    return sum((np.asarray(r.part) for r in parts.toLocalIterator()), np.zeros(basis.size)).reshape(basis.shape)


def randomised_svd(texts: DataFrame, vocabulary: dict[str, int], window: int, weights: np.ndarray, rank: int, passes: int = 2, extra: int = 8, seed: int = 7) -> np.ndarray:
    """The first right singular vectors (|V| x rank) of the TF-IDF matrix of the texts' windows; a pass reads the table once."""
    size = min(len(weights), rank + extra)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(weights), size)))[0]
    for _ in range(passes):
        q = np.linalg.qr(_partial_products(texts, vocabulary, window, weights, q))[0]
    small = q.T @ _partial_products(texts, vocabulary, window, weights, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, np.argsort(-values)[: min(rank, size)]]


def fit(items: DataFrame, item_col: str = "item_id", text_col: str = "passage", search: Search = Search()) -> LatentModel | None:
    """The latent model of the held-out items; None if no item has a word."""
    texts = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).dropna().distinct()
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"the items hold more than {MAX_ITEM_BYTES} bytes; search for them in several calls")
    split = [(i, w) for i, w in ((i, words_of(text)) for i, text in sorted(map(tuple, texts.collect()))) if w]
    if not split:
        return None
    vocabulary = {w: k for k, w in enumerate(sorted({x for _, w in split for x in w}))}
    coded = [(i, np.array([vocabulary[x] for x in w], np.int64)) for i, w in split]
    members = np.zeros((len(coded), len(vocabulary) + 1), bool)
    for n, (_, w) in enumerate(coded):
        members[n, w] = True
    frequency = members[:, :-1].sum(0)
    weights = np.log((1 + len(coded)) / (1 + frequency)) + 1
    latent = randomised_svd(texts.select("text"), vocabulary, search.window, weights, search.rank) * weights[:, None]
    words = np.vstack([latent, np.zeros(latent.shape[1])]).astype(np.float32)
    whole = [(n, w) for n, (_, w) in enumerate(coded) if len(w) >= search.window]
    windows = np.concatenate([_windows_of(w, search.window) for _, w in whole]) if whole else np.zeros((0, search.window), np.int64)
    at = np.array([(n, p) for n, w in whole for p in range(len(w) - search.window + 1)], np.int64).reshape(-1, 2)
    pieces = [(n, _windows_of(w, search.span, max(1, search.span // 4))) for n, (_, w) in enumerate(coded)]
    model = LatentModel(search, vocabulary, words, np.append(frequency <= max(1, np.median(frequency)), False), members, coded, windows, at, words[:0], np.repeat([n for n, _ in pieces], [len(p) for _, p in pieces]), words[:0])
    model.window_vectors = model.project(windows)
    model.stretch_vectors = model.project(np.concatenate([p for _, p in pieces]))
    return model


def _near(query: np.ndarray, vectors: np.ndarray, min_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query's number, vector's number) of all pairs of at least that cosine, block by block."""
    step = max(1, BLOCK // max(1, len(vectors)))
    for at in range(0, len(query), step):
        q, v = np.nonzero(query[at : at + step] @ vectors.T >= min_cosine)
        yield q + at, v


def _runs(ids: np.ndarray, model: LatentModel) -> dict[int, int]:
    """Item's place -> words of the longest run, at least min_run, that a text shares with the passage."""
    search = model.search
    # A word of no item ends a run.
    inside = ids >= 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    long = stops - starts >= search.min_run
    if not long.any() or not len(model.windows):
        return {}
    stride = search.min_run - search.window + 1
    places = np.concatenate([np.arange(a, b - search.window + 1, stride) for a, b in zip(starts[long].tolist(), stops[long].tolist())])
    query = ids[places[:, None] + np.arange(search.window)]
    found: dict[int, int] = {}
    for q, w in _near(model.project(query), model.window_vectors, search.copy_cosine):
        same = (query[q] == model.windows[w]).all(1)
        for at, (n, p) in zip(places[q[same]].tolist(), model.window_at[w[same]].tolist()):
            passage = model.items[n][1]
            room = min(at, p)
            back = np.flatnonzero(ids[at - room : at][::-1] != passage[p - room : p][::-1])
            left = int(back[0]) if len(back) else room
            room = min(len(ids) - at, len(passage) - p)
            ahead = np.flatnonzero(ids[at : at + room] != passage[p : p + room])
            run = left + (int(ahead[0]) if len(ahead) else room)
            if run >= search.min_run and run > found.get(n, 0):
                found[n] = run
    return found


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, one vectorised row at a time."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return int(row[-1]) if len(b) else 0


def _rewordings(ids: np.ndarray, model: LatentModel) -> dict[int, tuple[float, float]]:
    """Item's place -> (common, answers) of the stretch of a text that tells most of the passage."""
    search = model.search
    pieces = _windows_of(ids, search.span, max(1, search.span // 2))
    wide = min(search.span, len(ids))
    pieces = pieces[(pieces >= 0).sum(1) >= search.min_common * wide]
    best: dict[int, tuple[float, float]] = {}
    if not len(pieces):
        return best
    for q, v in _near(model.project(pieces), model.stretch_vectors, search.stretch_cosine):
        pairs = np.unique(q * len(model.items) + model.stretch_item[v])
        at, n = pairs // len(model.items), pairs % len(model.items)
        part = pieces[at]
        held, telling = model.members[n[:, None], part], model.telling[part]
        told = telling.sum(1)
        answers = (held & telling).sum(1) / np.maximum(told, 1)
        # More words can't be common in order than are common at all.
        for k in np.flatnonzero((answers >= search.min_answers) & (told > 0) & (held.sum(1) >= search.min_common * wide)).tolist():
            common = common_subsequence(model.items[n[k]][1], part[k][part[k] >= 0]) / wide
            if common >= search.min_common and (common, float(answers[k])) > best.get(int(n[k]), (0.0, 0.0)):
                best[int(n[k])] = (common, float(answers[k]))
    return best


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", search: Search = Search()) -> DataFrame:
    """(item_id, doc_id, run, common, answers): documents that hold an item's passage, fully or partly, copied or reworded.

    run is the longest run of consecutive words shared, 0 if shorter than min_run; common and answers (see Search)
    are those of the best stretch, rounded to 4 digits, 0 if none reaches both bounds; a row has one or the other.
    Null and empty texts hold nothing. Repeated documents give repeated rows; extra columns are ignored; without
    items or documents there are no rows. Texts are read whole. Map-only over the corpus: the items, of bounded
    size, are broadcast.
    """
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("run", T.IntegerType()), T.StructField("common", T.DoubleType()), T.StructField("answers", T.DoubleType())])
    model = fit(items, item_col, passage_col, search)
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                get = own.vocabulary.get
                ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                runs, told = _runs(ids, own), _rewordings(ids, own)
                for n in sorted(runs.keys() | told.keys()):
                    rows.append(i)
                    out.append((own.items[n][0], runs.get(n, 0), *(round(x, 4) for x in told.get(n, (0.0, 0.0)))))
            found, lengths, common, answers = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int32()), pa.array(common, pa.float64()), pa.array(answers, pa.float64())], names=schema.names
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)
