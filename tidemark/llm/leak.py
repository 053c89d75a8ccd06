"""Evaluation texts inside training texts: a BM25 inverted index of the test items, walked by block-max WAND.

The terms are runs of three words. A sorted posting list holds, for each term, the items that have it
and its BM25 weight there, with the largest weight of every block of postings and of the whole list.
Every training document is cut into passages that overlap by one word less than the shared run looked
for; each passage is a query. WAND moves the cursors of its terms past every item whose bound stays
under the threshold, first by the maxima of lists, then by those of blocks; only the others are scored.
Weights are scaled item by item so that a passage holding any run of ``run`` words of the item scores
at least 1: retrieval loses nothing, whatever the wording. Retrieved pairs are then verified word by word.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

WORD = re.compile(r"[^\W_]+")
#: Words of the test items in one index: about 100 bytes each, so an index stays under 250 MB.
SHARD_WORDS = 2_000_000
#: Indices that one pass over the documents carries; a larger held-out set takes more passes.
SHARDS_A_PASS = 4
TERM = 3
_ENOUGH = 0.999


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, case folded; none for null."""
    return WORD.findall(text.casefold()) if text else []


class LeakIndex:
    """Sorted postings (item, weight) by term, with block and list maxima, of one shard of test items."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int = 12, block: int = 64, k1: float = 1.2, b: float = 0.75):
        self.run, self.block = run, block
        items = [(key, w) for key, w in items if len(w) >= run]
        self.keys = [key for key, _ in items]
        self.terms: dict[str, int] = {}
        self.words = [np.array([self.terms.setdefault(t, len(self.terms)) for t in w], np.int32) for _, w in items]
        n, mean = len(items), sum(len(w) for w in self.words) / max(len(items), 1)
        mine = [self._keys(w.astype(np.int64))[0] for w in self.words]
        owner = np.repeat(np.arange(n), [len(t) for t in mine]) if n else np.zeros(0, np.int64)
        flat = np.concatenate(mine) if n else np.zeros(0, np.uint64)
        self.vocabulary, term = np.unique(flat, return_inverse=True)
        both, count = np.unique(np.stack([term, owner]), axis=1, return_counts=True) if len(flat) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        self.starts = np.searchsorted(both[0], np.arange(len(self.vocabulary) + 1))
        frequency = np.diff(self.starts)
        length = np.array([len(w) for w in self.words], np.float64)
        idf = np.log(1 + (n - frequency + 0.5) / (frequency + 0.5))
        score = idf[both[0]] * count * (k1 + 1) / (count + k1 * (1 - b + b * length[both[1]] / max(mean, 1)))
        # what the run of an item scores that scores least: every distinct term of a run counts once
        least = np.full(n, np.inf)
        place = {(int(t), int(i)): float(s) for t, i, s in zip(both[0], both[1], score)}
        at = 0
        for j, t in enumerate(mine):
            ids = term[at:at + len(t)]
            at += len(t)
            width = run - TERM + 1
            for i in range(len(ids) - width + 1):
                least[j] = min(least[j], sum(place[int(x), j] for x in set(ids[i:i + width].tolist())))
        self.items = both[1].astype(np.int32)
        self.weights = (score / least[both[1]]).astype(np.float32)
        self.most = np.maximum.reduceat(self.weights, self.starts[:-1]) if len(self.vocabulary) else np.zeros(0, np.float32)
        blocks = -(-frequency // block)
        self.first_block = np.concatenate(([0], np.cumsum(blocks)))
        inside = np.arange(self.first_block[-1]) - np.repeat(self.first_block[:-1], blocks)
        edges = np.repeat(self.starts[:-1], blocks) + inside * block
        self.block_most = np.maximum.reduceat(self.weights, edges) if len(edges) else np.zeros(0, np.float32)
        # plain arrays: a cursor reads one number at a time
        self.posted, self.weighed, self.begins = array("i", self.items.tolist()), array("f", self.weights.tolist()), array("q", self.starts.tolist())
        self.block_most, self.first_block = array("f", self.block_most.tolist()), array("q", self.first_block.tolist())
        self.runs = [np.sort(self.run_hashes(w.astype(np.int64))[0]) for w in self.words]

    def encode(self, words: list[str]) -> np.ndarray:
        """Words as numbers; all words that no item has share the last one."""
        unknown = len(self.terms)
        get = self.terms.get
        return np.array([get(w, unknown) for w in words], np.int64)

    def _keys(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms of a text as numbers, whether all words of each are known)."""
        if len(ids) < TERM:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        base, unknown = np.uint64(len(self.terms) + 1), len(self.terms)
        key, known = np.zeros(len(ids) - TERM + 1, np.uint64), np.ones(len(ids) - TERM + 1, bool)
        for j in range(TERM):
            part = ids[j:len(ids) - TERM + 1 + j]
            key = key * base + part.astype(np.uint64)
            known &= part < unknown
        return key, known

    def run_hashes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, position) of every run of ``run`` known words, in order."""
        n = len(ids) - self.run + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        total = np.zeros(n, np.uint64)
        for j in range(self.run):
            total = total * np.uint64(0xD6E8FEB86659FD93) + mixed[j:j + n]
        bad = np.concatenate(([0], np.cumsum(ids == len(self.terms))))
        good = np.flatnonzero(bad[self.run:self.run + n] == bad[:n])
        return total[good], good

    def retrieve(self, documents: list[np.ndarray], passage: int = 32) -> list[tuple[int, int]]:
        """(document, item) positions whose BM25 score reaches the threshold in some passage."""
        step, width = passage - self.run + 1, passage - TERM + 1
        if not len(self.vocabulary) or not documents:
            return []
        # one row of terms for the whole batch; a gap of unknown words keeps documents apart
        gap = np.full(TERM, len(self.terms), np.int64)
        begin = np.cumsum([0] + [len(d) + TERM for d in documents])
        key, known = self._keys(np.concatenate([x for d in documents for x in (d, gap)]))
        spot = np.minimum(np.searchsorted(self.vocabulary, key), len(self.vocabulary) - 1)
        hit = np.flatnonzero(known & (self.vocabulary[spot] == key))
        if not len(hit):
            return []
        doc = np.searchsorted(begin, hit, side="right") - 1
        at = hit - begin[doc]
        # a term lies in the passages that begin at most its position, and at least that less their width
        last = at // step
        first = np.maximum(-(-(at - width + 1) // step), 0)
        spread = last - first + 1
        number = np.repeat(first, spread) + np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
        rows = np.unique(np.stack([np.repeat(doc, spread), number, np.repeat(spot[hit], spread)]), axis=1)
        edge = np.flatnonzero(np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))))
        bound = np.add.reduceat(self.most[rows[2]].astype(np.float64), edge)
        ends = np.append(edge[1:], rows.shape[1])
        found: set[tuple[int, int]] = set()
        for p in np.flatnonzero(bound >= _ENOUGH):
            d = int(rows[0, edge[p]])
            found.update((d, j) for j in self._wand(rows[2, edge[p]:ends[p]].tolist()))
        return sorted(found)

    def _wand(self, terms: list[int]) -> list[int]:
        """Items whose weights over the terms add up to the threshold."""
        items, weights, begins, block = self.posted, self.weighed, self.begins, self.block
        # a cursor: item, position, end of the list, largest weight, beginning of the list, its first block
        cursors = [[items[begins[t]], begins[t], begins[t + 1], float(self.most[t]), begins[t], self.first_block[t]] for t in terms]
        found = []

        def forward(c: list, item: int) -> bool:
            """Moves to the first posting of ``item`` or later; False at the end."""
            c[1] = bisect_left(items, item, c[1], c[2])
            if c[1] < c[2]:
                c[0] = items[c[1]]
            return c[1] < c[2]

        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += c[3]
                if total >= _ENOUGH:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            total, until = 0.0, math.inf
            for c in cursors[:pivot + 1]:
                at = bisect_left(items, item, c[1], c[2])
                if at >= c[2]:
                    continue
                number = (at - c[4]) // block
                total += self.block_most[c[5] + number]
                until = min(until, items[min(c[4] + (number + 1) * block, c[2]) - 1])
            if total < _ENOUGH:
                # no item up to the end of the nearest block, nor before the next cursor, can reach the threshold
                following = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
                target = int(min(until + 1, following))
                cursors = [c for i, c in enumerate(cursors) if i > pivot or forward(c, max(target, item + 1) if c[0] <= item else target)]
                continue
            cursors = [c for i, c in enumerate(cursors) if i > pivot or c[0] >= item or forward(c, item)]
            here = [c for c in cursors if c[0] == item]
            if sum(weights[c[1]] for c in here) >= _ENOUGH:
                found.append(item)
            cursors = [c for c in cursors if c[0] > item or forward(c, item + 1)]
        return found

    def verify(self, found: list[tuple[int, int]], encoded: list[np.ndarray]) -> list[tuple[int, int]]:
        """Those of the pairs that share a run of words: by the runs' hashes, then word by word."""
        out, runs = [], {}
        for d, j in found:
            if d not in runs:
                runs[d] = self.run_hashes(encoded[d])
            hashes, at = runs[d]
            common = np.isin(hashes, self.runs[j])
            if not common.any():
                continue
            item = self.words[j]
            mine = {item[i:i + self.run].tobytes() for i in range(len(item) - self.run + 1)}
            text = encoded[d].astype(np.int32)
            if any(text[i:i + self.run].tobytes() in mine for i in at[common].tolist()):
                out.append((d, j))
        return out


def find_leaks(
    documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str,
    run: int = 12, passage: int = 32, shard_words: int = SHARD_WORDS, shards_a_pass: int = SHARDS_A_PASS,
) -> DataFrame:
    """(item_id, doc_id) for every document that shares ``run`` consecutive words with a test item.

    The held-out set is streamed to the driver item by item and indexed in shards of at most
    ``shard_words`` words, of which one narrow pass over the documents carries ``shards_a_pass``; a set
    that fits one pass needs no shuffle but for the last distinct, a larger one is written pass by pass,
    and the indices of a pass are destroyed before the next. Items shorter than the run cannot leak.
    Null texts and ids are left out; repeated rows give one result; other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")
    )
    rows = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")
    ).distinct()

    def one_pass(indices: list) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in range(0, batch.num_rows, 500):
                    piece = batch.slice(part, 500)
                    keys, texts = piece.column(0).to_pylist(), [words_of(t) for t in piece.column(1).to_pylist()]
                    pairs = []
                    for index in indices:
                        at = index.value
                        encoded = [at.encode(w) for w in texts]
                        pairs += [(at.keys[j], keys[d]) for d, j in at.verify(at.retrieve(encoded, passage), encoded)]
                    if pairs:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["item_id", "doc_id"]
                        )

        return docs.mapInArrow(search, "item_id long, doc_id long")

    shard: list[tuple[int, list[str]]] = []
    size, open_, done = 0, [], []
    for row in rows.toLocalIterator():
        words = words_of(row["t"])
        if shard and size + len(words) > shard_words:
            open_.append(spark.sparkContext.broadcast(LeakIndex(shard, run)))
            shard, size = [], 0
            if len(open_) == shards_a_pass:
                done.append(cut(one_pass(open_).distinct()))
                for index in open_:
                    index.destroy()
                open_ = []
        shard.append((row["i"], words))
        size += len(words)
    found = one_pass([*open_, spark.sparkContext.broadcast(LeakIndex(shard, run))])
    for part in done:
        found = found.unionByName(part)
    return found.distinct()
