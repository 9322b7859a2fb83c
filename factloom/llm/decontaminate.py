"""Benchmark items in documents, paraphrased or not, by latent semantic retrieval.

1. Items are cut into passages of ``PASSAGE`` words.  Documents are read once: the
   places of words that an item has are written to the shared folder, and all that
   follows reads these.
2. The passages of all documents, as TF-IDF rows of these words, go through a randomised
   singular value decomposition: tasks make A'(A G), Spark sums it.  Its right
   vectors are the latent space.
3. Windows of ``PASSAGE`` words of whole documents, ``STEP`` words apart, are compared with
   all passages of items in that space; a cosine of ``MIN_COSINE`` makes a candidate.
4. The longest common subsequence of words between the item and the surroundings
   of a candidate decides: at least ``COVERED`` of the item, or at least
   ``COVERED_WITH_ANSWER`` when the item's last words (its answer) stand there too.
5. What the cosine search may have missed is looked up by the item's rarest words: if
   ``COVERED_WITH_ANSWER`` of an item is there, so is a known number of the positions
   of any of its words but the most common ones.  These candidates are verified alike, and
   ``by_cosine`` tells which matches the search found by itself.

Items are sent to the tasks in chunks of at most ``CHUNK_BYTES`` of text; a larger
benchmark takes one pass over the documents for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import wordhash
from factloom.llm.tables import saved, text_bytes

PASSAGE, STEP = 32, 8
RANK, OVERSAMPLE = 96, 16
# Of the 247 matches in the documents of sf0.1, 245 reach this; step 5 adds the rest.
MIN_COSINE = 0.6
COVERED, COVERED_WITH_ANSWER = 0.75, 0.6
ANSWER_WORDS = 5
# Words in more than this share of the passages have no weight, unless a passage
# of an item has fewer than MIN_RARE others.
COMMON, MIN_RARE = 0.2, 4
SHARED = 0.2  # share of an item's positions that its rarer words must give
CHUNK_BYTES = 1 << 20
PIECE_BYTES = 1 << 20  # text of documents hashed at once
PART_WORDS = 1 << 17  # words of documents searched at once
FITTED_WORDS = 1 << 19  # and of those the latent space is made of
BLOCK_PASSAGES = 2048
PRODUCT_CELLS = 1 << 18  # cosines computed at once, few enough to stay in a cache
CELLS = 1 << 20  # cells of other tables made at once
SCHEMA = "doc_id long, item_id long, coverage double, cosine double, answer boolean, by_cosine boolean"


def _words(text: pa.Array) -> wordhash.Words:
    return wordhash.words(wordhash.texts_of(wordhash.lowered(text)))


@dataclass
class Vocabulary:
    """Sorted hashes of the words of some items."""

    hashes: np.ndarray

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose word is known, and its number."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[number] == hashes[at]
        return at[same], number[same]


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorts ``keys`` in place."""
    keys.sort()
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def _batches(load: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose load adds up to about ``CELLS``."""
    total = np.cumsum(load)
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CELLS, side="right")))
        yield a, b
        a = b


def _ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1 and so on, lengths[i] numbers for every i."""
    return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in wordhash.pieces(batch.column("text"), PIECE_BYTES):
            yield batch.slice(a, b - a)


class Marked(NamedTuple):
    """The words of some documents: text i has number[first[i]:first[i + 1]].

    ``number`` is that of a known word, or the size of the vocabulary; ``at`` are the
    places of known words.
    """

    first: np.ndarray
    number: np.ndarray
    at: np.ndarray

    def passages(self, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """For places the number of their passage of so many words, and the first passage of each text."""
        begin = np.concatenate([[0], np.cumsum(-(-np.diff(self.first) // words))])
        text = np.searchsorted(self.first, at, side="right") - 1
        return begin[text] + (at - self.first[text]) // words, begin


def known_words(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_words, places, numbers): where known words stand in each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            words = _words(part.column("text"))
            at, number = vocabulary.find(words.hashes)
            text = np.searchsorted(words.first, at, side="right") - 1
            offsets = pa.array(np.searchsorted(at, words.first), pa.int32())
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(np.diff(words.first), pa.int32()),
                 pa.ListArray.from_arrays(offsets, pa.array(at - words.first[text], pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(number, pa.int32()))],
                names=["doc_id", "n_words", "places", "numbers"],
            )

    return docs.mapInArrow(run, "doc_id long, n_words int, places array<int>, numbers array<int>")


def _parts(batches: Iterator[pa.RecordBatch], size: int, limit: int) -> Iterator[tuple[pa.RecordBatch, Marked]]:
    """Documents of about so many words at a time; a longer one is a part of its own."""
    for batch in batches:
        total = np.cumsum(batch.column("n_words").to_numpy().astype(np.int64))
        a = 0
        while a < len(total):
            had = total[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(total, had + limit, side="right")))
            part = batch.slice(a, b - a)
            first = np.concatenate([[0], total[a:b] - had])
            own = pc.list_value_length(part.column("places")).to_numpy()
            at = pc.list_flatten(part.column("places")).to_numpy() + np.repeat(first[:-1], own)
            number = np.full(first[-1], size, np.int32)
            number[at] = pc.list_flatten(part.column("numbers")).to_numpy()
            yield part, Marked(first, number, at)
            a = b


def passage_frequencies(marked: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """For each known word the number of document passages that hold it, and of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(size, np.int64), 0
        for _, words in _parts(batches, size, PART_WORDS):
            passage, begin = words.passages(words.at, PASSAGE)
            total += int(begin[-1])
            count += np.bincount(_distinct(passage * size + words.number[words.at]) % size, minlength=size)
        told = np.flatnonzero(count)
        yield pa.record_batch(
            [pa.array(np.r_[told, -1]), pa.array(np.r_[count[told], total])], names=["number", "n"]
        )

    rows = marked.mapInArrow(run, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    out = np.zeros(size + 1, np.int64)
    for number, n in rows.collect():  # at most one row for each word of a chunk of items
        out[number] = n
    return out[:-1], int(out[-1])


def _weighted_passages(size: int, weight: np.ndarray):
    """Sparse TF-IDF rows of unit length: (places, values, first entry of each row)."""

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for _, words in _parts(batches, size, FITTED_WORDS):
            at = words.at[weight[words.number[words.at]] > 0]
            if not len(at):
                continue
            passage, _ = words.passages(at, PASSAGE)
            key, count = np.unique(passage * size + words.number[at], return_counts=True)
            places = key % size
            values = count * weight[places]
            begins = np.flatnonzero(np.diff(key // size, prepend=-1))
            norm = np.sqrt(np.add.reduceat(values**2, begins))
            values /= np.repeat(norm, np.diff(np.append(begins, len(key))))
            yield places, values.astype(np.float32), begins

    return sparse


@dataclass
class Gate:
    """The rarer words of the items of up to ``reach`` words.

    An item of n words of which ``needed`` must be found has ``shared`` of them among
    any n - needed + shared of its positions; ``holders`` index those of the rarest words.
    """

    reach: int
    indptr: np.ndarray  # for each known word the items that hold it,
    holders: np.ndarray
    positions: np.ndarray  # and at how many positions
    shared: np.ndarray  # for each item


def _gates(own: list[np.ndarray], vocabulary: Vocabulary, frequency: np.ndarray) -> list[Gate]:
    size = len(vocabulary.hashes)
    by_reach: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    shared = np.zeros(len(own), np.int64)
    for k, w in enumerate(own):
        n = len(w)
        needed = int(np.ceil(COVERED_WITH_ANSWER * n - 1e-9))
        shared[k] = int(np.ceil(SHARED * n - 1e-9))
        number, positions = np.unique(np.searchsorted(vocabulary.hashes, w), return_counts=True)
        order = np.argsort(frequency[number], kind="stable")
        number, positions = number[order], positions[order]
        enough = np.searchsorted(np.cumsum(positions), n - needed + shared[k]) + 1
        reach = max(PASSAGE, 1 << (n - 1).bit_length())
        by_reach.setdefault(reach, []).append((k, number[:enough], positions[:enough]))
    gates = []
    for reach, rows in sorted(by_reach.items()):
        number = np.concatenate([r[1] for r in rows])
        order = np.argsort(number, kind="stable")
        holders = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])[order]
        indptr = np.searchsorted(number[order], np.arange(size + 1))
        gates.append(Gate(reach, indptr, holders, np.concatenate([r[2] for r in rows])[order], shared))
    return gates


@dataclass
class Items:
    """A chunk of items: words by number, passages in the latent space, and its basis."""

    ids: list[int]
    words: list[np.ndarray]
    size: int  # of the vocabulary
    basis: np.ndarray  # known words x rank, weighted
    passages: np.ndarray  # latent passages of unit length
    owner: np.ndarray  # the item of each passage
    gates: list[Gate]


def _cuts(n: int) -> list[tuple[int, int]]:
    if n <= PASSAGE:
        return [(0, n)]
    return [(min(a, n - PASSAGE), min(a, n - PASSAGE) + PASSAGE) for a in range(0, n - PASSAGE // 2, PASSAGE // 2)]


def latent_basis(table: DataFrame, sparse, width: int, rank: int) -> np.ndarray:
    """Right singular vectors (width x rank) of the sparse rows A that ``sparse`` makes of Arrow batches.

    Randomised: A'(A G) for a random G, made orthonormal, is Q; the eigenvectors of
    (A Q)'(A Q) turn it.  Only sums of rank + oversample columns leave a task; Spark adds
    them up, one row for each column of A.
    """
    kept = min(rank + OVERSAMPLE, width)
    columns = [f"c{k}" for k in range(kept)]
    schema = "place long, " + ", ".join(f"{c} double" for c in columns)

    def blocks(batches: Iterator[pa.RecordBatch], test: np.ndarray):
        for places, values, begins in sparse(batches):
            side = test.astype(values.dtype)
            for i in range(0, len(begins), BLOCK_PASSAGES):
                a, b = begins[i], begins[i + BLOCK_PASSAGES] if i + BLOCK_PASSAGES < len(begins) else len(places)
                p, v, heads = places[a:b], values[a:b, None], begins[i : i + BLOCK_PASSAGES] - a
                yield p, v, heads, np.add.reduceat(v * side[p], heads)

    def summed(run, height: int) -> np.ndarray:
        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = run(batches)
            used = np.flatnonzero(total.any(axis=1))
            yield pa.record_batch([pa.array(used), *(pa.array(total[used, k]) for k in range(kept))], names=["place", *columns])

        partial = table.mapInArrow(told, schema)
        got = partial.groupBy("place").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
        out = np.zeros((height, kept))
        out[got.column("place").to_numpy()] = np.stack([got.column(c).to_numpy() for c in columns], axis=1)
        return out

    def power(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((width, kept))
        for p, v, heads, image in blocks(batches, test):
            order = np.argsort(p, kind="stable")
            row = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(p))))[order]
            first = np.flatnonzero(np.diff(p[order], prepend=-1))
            total[p[order][first]] += np.add.reduceat(v[order] * image[row], first)
        return total

    def core(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((kept, kept))
        for *_, image in blocks(batches, test):
            total += image.T @ image
        return total

    test = np.random.default_rng(3).normal(size=(width, kept))
    test, _ = np.linalg.qr(summed(power, width))
    small = summed(core, kept)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:rank]
    return test @ turn[:, order[values[order] > 1e-9 * max(values.max(), 1e-30)]]


def read_items(docs: DataFrame, items: DataFrame) -> tuple[Items, DataFrame] | None:
    """The latent space of one chunk of items, and where documents have their words; None if no item has a word."""
    got = items.orderBy("item_id").toArrow()
    ids, texts = got.column("item_id").to_pylist(), got.column("text").combine_chunks()
    if not ids:
        return None
    words = _words(texts)
    own = [words.hashes[i:j] for i, j in zip(words.first[:-1], words.first[1:])]
    keep = [k for k, w in enumerate(own) if len(w)]
    ids, own = [ids[k] for k in keep], [own[k] for k in keep]
    if not ids:
        return None
    vocabulary = Vocabulary(np.unique(np.concatenate(own)))
    size = len(vocabulary.hashes)
    numbers = [np.searchsorted(vocabulary.hashes, w) for w in own]
    marked = saved(known_words(docs, vocabulary), "known-words")
    frequency, total = passage_frequencies(marked, size)
    weight = np.maximum(np.log((total + 1) / (frequency + 1)), 1e-3)
    rare = frequency <= COMMON * max(total, 1)
    for number in numbers:
        for a, b in _cuts(len(number)):
            if len(np.unique(number[a:b][rare[number[a:b]]])) < MIN_RARE:
                rare[number[a:b]] = True
    weight[~rare] = 0
    basis = latent_basis(marked, _weighted_passages(size, weight), size, RANK)
    scaled = (basis * weight[:, None]).astype(np.float32)
    cuts = [(k, a, b) for k, number in enumerate(numbers) for a, b in _cuts(len(number))]
    passages = np.stack([scaled[numbers[k][a:b]].sum(axis=0) for k, a, b in cuts])
    passages /= np.maximum(np.linalg.norm(passages, axis=1), 1e-9)[:, None]
    owner = np.array([k for k, _, _ in cuts])
    return Items(ids, numbers, size, scaled, passages, owner, _gates(own, vocabulary, frequency)), marked


def common_subsequence(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, one bit for each word of the item."""
    bits: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        bits[w] = bits.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in region.tolist():
        mask = bits.get(w)
        if mask:
            both = row & mask
            row = (row + both | row - both) & full
    return len(item) - row.bit_count()


def _holds(region: np.ndarray, phrase: np.ndarray) -> bool:
    if len(region) < len(phrase):
        return False
    same = np.ones(len(region) - len(phrase) + 1, bool)
    for k, w in enumerate(phrase):
        same &= region[k : k + len(same)] == w
    return bool(same.any())


def _near_passages(words: Marked, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first of ``PASSAGE`` places, item): where a window is near a passage of the item; by place and item."""
    at = words.at[items.basis.any(axis=1)[words.number[words.at]]]
    if not len(at):
        return at, at, at
    # texts in blocks of STEP words, with empty blocks behind so that no window spans two texts
    span = PASSAGE // STEP
    block, begin = words.passages(at, STEP)
    text = np.searchsorted(words.first, at, side="right") - 1
    block, begin = block + text * (span - 1), begin + np.arange(len(begin)) * (span - 1)
    windows = np.zeros((int(begin[-1]), items.basis.shape[1]), np.float32)
    for slot in range(STEP):  # each block once
        here = (at - words.first[text]) % STEP == slot
        windows[block[here]] += items.basis[words.number[at[here]]]
    reach = 1
    while reach < span:  # sums of 2, then 4 blocks
        windows[:-reach] += windows[reach:].copy()
        reach *= 2
    size = np.linalg.norm(windows, axis=1)
    some, n_items = np.flatnonzero(size > 1e-6), len(items.words)
    step = max(64, PRODUCT_CELLS // len(items.passages))
    whose = np.searchsorted(begin, some, side="right") - 1
    tiles = (begin[whose] + (some - begin[whose]) // span) * n_items
    found, passages = [np.zeros(0, np.int64)], np.ascontiguousarray(items.passages.T)
    for a in range(0, len(some), step):
        own = some[a : a + step]
        near = np.flatnonzero(windows[own] @ passages >= MIN_COSINE * size[own, None])
        found.append(_distinct(tiles[a + near // len(items.owner)] + items.owner[near % len(items.owner)]))
    key = _distinct(np.concatenate(found))
    tile, item = key // n_items, key % n_items
    t = np.searchsorted(begin, tile, side="right") - 1
    return t, words.first[t] + (tile - begin[t]) * PASSAGE, item


def _covered(words: Marked, items: Items, text: np.ndarray, place: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which of the items the surroundings of the passage at a place can cover; all rows of a place stand together."""
    sizes = np.array([len(w) for w in items.words])
    flat, head = np.concatenate(items.words), np.cumsum(sizes) - sizes
    edges = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    if not len(edges):
        return np.zeros(0, bool)
    ends = np.append(edges[1:], len(place))
    n = np.maximum.reduceat(sizes[item], edges)
    low = np.maximum(words.first[text[edges]], place[edges] - n)
    high = np.minimum(words.first[text[edges] + 1], place[edges] + 2 * PASSAGE + n)
    width, kept = items.size + 1, np.zeros(len(item), bool)
    for a, b in _batches(width + np.add.reduceat(sizes[item], edges)):
        held = np.zeros((b - a) * width, bool)
        lengths = np.maximum(high[a:b] - low[a:b], 0)  # a window may begin behind the last word
        held[np.repeat(np.arange(b - a) * width, lengths) + words.number[_ranges(low[a:b], lengths)]] = True
        own = item[edges[a] : ends[b - 1]]
        row = np.repeat(np.repeat(np.arange(b - a) * width, ends[a:b] - edges[a:b]), sizes[own])
        count = np.add.reduceat(held[row + flat[_ranges(head[own], sizes[own])]], np.cumsum(sizes[own]) - sizes[own], dtype=np.int64)
        kept[edges[a] : ends[b - 1]] = count / sizes[own] >= COVERED_WITH_ANSWER
    return kept


def _sharing_rare_words(words: Marked, items: Items) -> Iterator[tuple[int, int, int]]:
    """(text, first word of ``reach`` places, item): where enough of the item's rarer words are near."""
    known, number = words.at, words.number[words.at].astype(np.int64)
    size, n_items = items.size, len(items.words)
    lengths = np.diff(words.first)
    for gate in items.gates:
        counts = np.diff(gate.indptr)
        some = counts[number] > 0
        at, word = known[some], number[some]
        if not len(at):
            continue
        tiles = -(-lengths // gate.reach)
        begin = np.concatenate([[0], np.cumsum(tiles)])
        text = np.searchsorted(words.first, at, side="right") - 1
        tile = begin[text] + (at - words.first[text]) // gate.reach
        # surroundings of places in a tile reach from the tile before to the second one after
        there = _distinct(tile * size + word)
        whose = np.append(np.repeat(np.arange(len(tiles)), tiles), [-1, -2])
        tile = there // size
        near = [there + d * size for d in (-2, -1, 0, 1)]
        pair = _distinct(np.concatenate([x[whose[x // size] == whose[tile]] for x in near]))
        where, own = pair // size, pair % size
        edges = np.flatnonzero(np.diff(where, prepend=-1))
        ends, n = np.append(edges[1:], len(pair)), counts[own]
        for a, b in _batches(n_items + np.add.reduceat(n, edges)):
            i, j = edges[a], ends[b - 1]
            slot = _ranges(gate.indptr[own[i:j]], n[i:j])
            row = np.repeat(np.repeat(np.arange(b - a) * n_items, ends[a:b] - edges[a:b]), n[i:j])
            mass = np.bincount(row + gate.holders[slot], gate.positions[slot], minlength=(b - a) * n_items)
            row, item = np.nonzero(mass.reshape(b - a, n_items) >= gate.shared)
            for place, k in zip(where[edges[a + row]].tolist(), item.tolist()):
                t = int(np.searchsorted(begin, place, side="right")) - 1
                yield t, int(words.first[t]) + (place - int(begin[t])) * gate.reach, k


def _cosine(region: np.ndarray, items: Items, k: int) -> float:
    """Of the region's windows and the item's passages the nearest two."""
    at = np.flatnonzero(region < items.size)
    vectors = np.zeros((len(region) + 1, items.basis.shape[1]), np.float32)
    vectors[at + 1] = items.basis[region[at]]
    run = np.cumsum(vectors, axis=0)
    starts = np.arange(0, max(len(region) - PASSAGE, 0) + 1, STEP)
    windows = run[np.minimum(starts + PASSAGE, len(region))] - run[starts]
    size = np.linalg.norm(windows, axis=1)[:, None]
    return float((windows @ items.passages[items.owner == k].T / np.maximum(size, 1e-9)).max())


def _matches(words: Marked, items: Items) -> dict[tuple[int, int], tuple[float, float, bool, bool]]:
    found: dict[tuple[int, int], tuple[float, float, bool, bool]] = {}
    reach = {k: gate.reach for gate in items.gates for k in np.unique(gate.holders).tolist()}
    marked = np.zeros(items.size + 1, bool)

    def covered(k: int, low: int, high: int) -> float:
        """The share of the item's words that stand in a region; no common subsequence is longer."""
        marked[words.number[low:high]] = True
        share = np.count_nonzero(marked[items.words[k]]) / len(items.words[k])
        marked[words.number[low:high]] = False
        return share

    def verify(text: int, place: int, span: int, k: int, by_cosine: bool) -> None:
        item, n = items.words[k], len(items.words[k])
        head, tail = int(words.first[text]), int(words.first[text + 1])
        best = found.get((text, k))
        if best is not None and best[0] == 1.0:
            return
        if covered(k, max(head, place - n), min(tail, place + span + PASSAGE + n)) < COVERED_WITH_ANSWER:
            return
        for start in range(place, min(place + span, tail), STEP):
            low, high = max(head, start - n), min(tail, start + PASSAGE + n)
            if covered(k, low, high) < COVERED_WITH_ANSWER:
                continue
            region = words.number[low:high]
            coverage = common_subsequence(item, region[region < items.size]) / n
            if coverage < COVERED_WITH_ANSWER:
                continue
            answer = _holds(region, item[-ANSWER_WORDS:])
            if coverage >= COVERED or answer:
                if n <= ANSWER_WORDS and not _holds(region, item):
                    continue  # a few words count only as they stand
                best = found.get((text, k))
                if best is None or coverage > best[0]:
                    found[text, k] = (coverage, _cosine(region, items, k), answer, by_cosine if best is None else best[3])
                if coverage == 1.0:
                    return

    near = _near_passages(words, items)
    kept = _covered(words, items, *near)
    for text, place, k in zip(*(x[kept].tolist() for x in near)):
        verify(text, place, PASSAGE, k, True)
    for text, place, k in _sharing_rare_words(words, items):
        verify(text, place, reach[k], k, False)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, cosine, answer, by_cosine): items found in documents.

    One row for each pair of ids, with the best coverage; ``by_cosine`` if the cosine
    search found it by itself.  NULL and empty texts
    hold no item; items without words are in no document; items of up to
    ``ANSWER_WORDS`` words must stand there as they are.  Rows with a NULL doc_id
    are reported under NULL, items with a NULL id are left out, rows that repeat
    count once.  Empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    given = given.where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    chunks = max(1, -(-text_bytes(given) // CHUNK_BYTES))
    out = None
    for chunk in range(chunks):
        got = read_items(rows, given.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == chunk))
        if got is None:
            continue
        items, marked = got
        found = marked.mapInArrow(_searcher(items), SCHEMA)
        out = found if out is None else out.union(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    best = F.max(F.struct("coverage", "cosine", "answer")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best, F.max("by_cosine").alias("by_cosine")).select(
        "doc_id", "item_id", "best.*", "by_cosine"
    )


def _searcher(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _parts(batches, items.size, PART_WORDS):
            found = _matches(words, items)
            pairs = list(found)
            kinds = (pa.float64(), pa.float64(), pa.bool_(), pa.bool_())
            yield pa.record_batch(
                [part.column("doc_id").take(pa.array([t for t, _ in pairs], pa.int64())),
                 pa.array([items.ids[k] for _, k in pairs], pa.int64()),
                 *(pa.array([found[p][i] for p in pairs], kind) for i, kind in enumerate(kinds))],
                names=["doc_id", "item_id", "coverage", "cosine", "answer", "by_cosine"],
            )

    return run
