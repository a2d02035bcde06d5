"""Evaluation items inside training texts.

The items (a small fixed table, its size checked) become a BM25 inverted index, held by every worker. Each passage of
each document is a query. Retrieval is block-max WAND with one fixed threshold: the sum of the query terms' list maxima,
then the sum of their maxima in a block of items, must reach the threshold before a single item is scored.
A block's bound is never below the scores in it, so every item at or above the threshold is retrieved: no top-k.
A leak may also lie in pieces far apart, each below the threshold: pairs whose item has that share of its weight in the
document's terms as a whole are retrieved too. Retrieved pairs are verified on the whole document by aligning its words with the item's.

No shuffle: one pass over the documents. Defined cases: null and empty texts and items never match; copies of a document
count each for themselves; an empty item table yields an empty result; items with the same text are reported each; very long texts are passed through in
whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orelode.llm.textforms import words
from orelode.session import spread
from orelode.sources.tables import small_rows

K1, B = 1.2, 0.75
#: A passage is two neighbouring strides of words.
STRIDE = 48
#: Share of an item's whole BM25 weight that a passage must hold to be retrieved.
THRESHOLD = 0.16
#: Share of the item's words that must be found, in order, in passages of at least SPAN words.
COVERED = 0.45
SPAN = 5
BLOCK = 16
#: Strides scored at once, and words gathered before they are.
STRIDES = 2_000
WORDS = 100_000


class Index:
    """BM25 impacts by term and item, as shares of the item's whole weight, with maxima by list and by block."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [words(t or "") for _, t in items]
        n = len(items)
        df = Counter(w for ws in self.words for w in set(ws))
        self.term = {w: k for k, w in enumerate(sorted(df))}
        mean = sum(map(len, self.words)) / max(1, n)
        impact = np.zeros((len(self.term) + 1, -(-max(1, n) // BLOCK) * BLOCK), np.float32)  # the last row is for all other words
        for j, ws in enumerate(self.words):
            for w, f in Counter(ws).items():
                idf = np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                impact[self.term[w], j] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ws) / mean))
        whole = impact.sum(0)
        self.impact = impact / np.where(whole > 0, whole, 1)
        self.block_max = self.impact.reshape(len(impact), -1, BLOCK).max(2)
        self.list_max = self.block_max.max(1)
        self.other = len(self.term)
        grams = Counter(g for ws in self.words for g in {tuple(ws[i : i + 3]) for i in range(len(ws) - 2)})
        common = max(3, n // 50)
        #: trigram -> (item, position, whether few items share it), for the check of retrieved pairs
        self.at: dict[tuple, list] = defaultdict(list)
        for j, ws in enumerate(self.words):
            for i, g in enumerate(zip(ws, ws[1:], ws[2:])):
                self.at[g].append((j, i, grams[g] <= common))

    def retrieve(self, docs: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
        """(document, item), both by position, where some passage of the document's term ids, or the document as a whole, holds ``threshold`` of the item."""
        lengths = np.array([len(d) for d in docs])
        strides = -(-lengths // STRIDE)
        owner = np.repeat(np.arange(len(docs)), strides)
        first = np.concatenate([[0], np.cumsum(strides)[:-1]])
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        starts = np.repeat(begin, strides) + (np.arange(len(owner)) - np.repeat(first, strides)) * STRIDE
        ids, out = np.concatenate(docs), set()
        stride = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
        once = np.zeros(len(ids), bool)  # a term counts once in a stride
        once[np.unique(stride * (self.other + 1) + ids, return_index=True)[1]] = True
        once &= self.list_max[ids] > 0
        once[starts] = True  # no stride becomes empty
        place = np.cumsum(once) - 1
        starts, ids = place[starts], ids[once]
        for s in range(0, len(starts), STRIDES):  # bounded memory for documents of any length
            last = min(s + STRIDES + 1, len(starts))  # the stride after the slice completes its last passage
            base, until = starts[s], starts[last] if last < len(starts) else len(ids)
            out |= self._slice(ids[base:until], starts[s:last] - base, owner[s:last], threshold)
        return sorted(out | self._whole(docs, threshold))

    def _whole(self, docs: list[np.ndarray], threshold: float) -> set[tuple[int, int]]:
        """The same for the terms of a document all together, each counted once."""
        out: set[tuple[int, int]] = set()
        for k, ids in enumerate(docs):
            ids = np.unique(ids)
            if self.list_max[ids].sum() >= threshold:
                out.update((k, j) for j in np.flatnonzero(self.impact[ids].sum(0) >= threshold).tolist())
        return out

    def _slice(self, ids: np.ndarray, starts: np.ndarray, owner: np.ndarray, threshold: float) -> set[tuple[int, int]]:
        def passages(x: np.ndarray) -> np.ndarray:
            """Sums over each stride and the one after it, if that is of the same document."""
            sums = np.add.reduceat(x, starts)
            follows = np.concatenate([owner[1:] == owner[:-1], [False]])
            return sums + np.concatenate([sums[1:], sums[:1]]) * (follows if x.ndim == 1 else follows[:, None])

        out: set[tuple[int, int]] = set()
        if not (passages(self.list_max[ids]) >= threshold).any():  # the pivot test on whole lists
            return out
        alive = passages(self.block_max[ids]) >= threshold  # the same on blocks
        ends = np.concatenate([starts[1:], [len(ids)]])
        follows = np.concatenate([owner[1:] == owner[:-1], [False]])
        for b in np.flatnonzero(alive.any(0)):
            ps = np.flatnonzero(alive[:, b])
            until = np.where(follows[ps], ends[np.minimum(ps + 1, len(ends) - 1)], ends[ps])
            size = until - starts[ps]
            shift = np.concatenate([[0], np.cumsum(size)[:-1]])
            take = np.repeat(starts[ps] - shift, size) + np.arange(size.sum())
            score = np.add.reduceat(self.impact[ids[take], b * BLOCK : (b + 1) * BLOCK], shift, axis=0)
            p, j = np.nonzero(score >= threshold)
            out.update(zip(owner[ps[p]].tolist(), (b * BLOCK + j).tolist()))
        return out

    def hits(self, doc: list[str], items: set[int]) -> dict[int, list]:
        """(place in the document, place in the item, distinctive) of every trigram that the document shares with one of the items."""
        at, out = self.at, defaultdict(list)
        for d, g in enumerate(zip(doc, doc[1:], doc[2:])):
            if g in at:
                for j, i, rare in at[g]:
                    if j in items:
                        out[j].append((d, i, rare))
        return out

    def covered(self, j: int, hits: list) -> float:
        """Share of item j's words in passages of the document that follow the item's order.

        Equal trigrams are joined to passages over an occasional changed, added or missing word. A passage counts from
        SPAN words on and if its wording is not shared by many items. The best chain of passages in both orders counts.
        """
        n = len(self.words[j])
        runs: list[list] = []  # item from, item to, doc from, doc to, distinctive
        live: list[list] = []
        for d, i, rare in hits:
            live = [r for r in live if d - r[3] <= 4]
            r = next((r for r in reversed(live) if r[0] < i and -2 <= i - r[1] <= 4 and d + 3 > r[3]), None)
            if r is None:
                live.append(r := [i, i + 3, d, d + 3, rare])
                runs.append(r)
            else:
                r[1], r[3], r[4] = max(r[1], i + 3), d + 3, r[4] or rare
        best = np.zeros(n + 1, np.int64)  # words covered by the best chain that ends at or before an item position
        ready: list[tuple[int, int, int]] = []
        for i0, i1, d0, d1, rare in sorted(runs, key=lambda r: r[2]):
            if i1 - i0 < SPAN or not rare:
                continue
            while ready and ready[0][0] <= d0 + 2:
                _, e, v = heappop(ready)
                best[e:] = np.maximum(best[e:], v)
            heappush(ready, (d1, i1, int(best[i0]) + i1 - i0))
        for _, e, v in ready:
            best[e:] = np.maximum(best[e:], v)
        return float(best[-1]) / max(1, n)


def _search(items: list[tuple[int, str]], threshold: float, share: float, key: str, item_key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        term, other = index.term, index.other
        def flush(keys: list[int], docs: list[list[str]]) -> pa.RecordBatch:
            terms = [np.fromiter(map(term.get, ws, repeat(other)), np.int32, len(ws)) for ws in docs]
            found = []
            for k, pairs in groupby(index.retrieve(terms, threshold), lambda p: p[0]):
                ws = docs[k]
                hits = index.hits(ws, {j for _, j in pairs})
                for j in sorted(hits):  # a trigram brings at most three words and two between: too few can't do
                    if 5 * len(hits[j]) >= share * len(index.words[j]) and (c := index.covered(j, hits[j])) >= share:
                        found.append((keys[k], index.ids[j], round(c, 4)))
            a, b, c = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], [key, item_key, "covered"])

        keys, docs, n = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if ws := words(text.as_py()):
                    keys.append(doc_id)
                    docs.append(ws)
                    n += len(ws)
                    if n > WORDS:
                        yield flush(keys, docs)
                        keys, docs, n = [], [], 0
        if keys:
            yield flush(keys, docs)

    return run


def find_leaks(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, share: float = COVERED,
) -> DataFrame:
    """(doc_id, item_id, covered) for every document that holds at least ``share`` of an item."""
    rows = sorted((int(r[0]), r[1]) for r in small_rows(items.where(f"trim({item_text}) <> '' and {item_key} is not null").select(item_key, item_text).distinct()))
    need = documents.where(f"{text} is not null and {text} <> '' and {key} is not null").select(documents[key].cast("bigint"), text)
    out = f"{key} bigint, {item_key} bigint, covered double"
    return spread(need).mapInArrow(_search(rows, threshold, share, key, item_key), out) if rows else documents.sparkSession.createDataFrame([], out)
