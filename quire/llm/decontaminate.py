"""Benchmark decontamination by spaced seeds.

Fixed masks pick some of the words of a window and ignore the others, so a window with
substituted words still has a mask that sees none of them. Hashes of masked benchmark
windows are looked up at every word of every document; around a hit the words are aligned
and compared, and an overlap counts if a run of words agrees but for the allowed share.

The benchmark is the query set: it is taken in blocks of bounded size, each of which is
sent to the executors and passed over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.common import table

#: Whatever 20 % of 8 to 13 words are substituted, one of these masks fits among the words
#: without seeing one of them (found by search over all patterns).
MASKS = ["1111011", "110010111", "11011101", "11100111", "111111", "110101011"]
WORDS = re.compile(r"\w+")
#: Runs of scripts written without spaces.
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]+")
#: Characters of such a run by which an item is looked up.
ANCHOR = 8
#: Benchmark text of one block: what is broadcast at once.
BLOCK_BYTES = 16 << 20
#: Words of documents aligned at once.
CHUNK_WORDS = 1 << 19
#: Pairs of a document's and an item's place that are compared at once.
HITS = 1 << 17
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], "u8")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def masked_hashes(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows whose seen words are all known (id >= 0)."""
    seen = [j for j, c in enumerate(mask) if c == "1"]
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    known = np.ones(n, bool)
    for j in seen:
        known &= ids[j : j + n] >= 0
    at = np.flatnonzero(known)
    h = np.zeros(len(at), "u8")
    for k, j in enumerate(seen):
        h = (h ^ (ids[at + j].astype("u8") + np.uint64(1))) * MULTIPLIERS[k % len(MULTIPLIERS)]
        h ^= h >> np.uint64(32)
    return at, h


def surroundings(ids: np.ndarray, at: np.ndarray, reach: int, *more: np.ndarray) -> np.ndarray:
    """(places, words) of all windows of ``reach`` words over seeds at ``at``; -1 beyond the
    ends. ``more`` are further columns."""
    padded = np.concatenate([np.full(reach, -1, "i4"), ids, np.full(2 * reach, -1, "i4")])
    rows = np.lib.stride_tricks.sliding_window_view(padded, 3 * reach)[at]
    return np.concatenate([rows, *(c[:, None].astype("i4") for c in more)], axis=1) if more else rows


def distinct_places(rows: np.ndarray) -> np.ndarray:
    """The first of each set of equal rows, ascending. Compared byte for byte."""
    rows = np.ascontiguousarray(rows)
    return np.sort(np.unique(rows.view(f"V{rows.shape[1] * rows.itemsize}").ravel(), return_index=True)[1])


class Index:
    """Spaced seeds of a block of benchmark items. Items of fewer than ``least`` words are
    looked up whole: by a hash of their words, or by characters in scripts without spaces."""

    def __init__(self, items: list[tuple[int, str]], window: int = 13, similarity: float = 0.8, least: int = 8):
        self.window, self.similarity = window, similarity
        self.vocabulary: dict[str, int] = {}
        self.names, self.starts, self.lengths, parts, at = [], [], [], [], 0
        brief = []
        for name, text in items:
            words = words_of(text)
            if len(words) < least:
                brief += [(name, words)] if words else []
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], "i4")
            self.names.append(name)
            self.starts.append(at)
            self.lengths.append(len(ids))
            parts += [ids, np.full(window, -1, "i4")]
            at += len(ids) + window
        self.ids = np.concatenate(parts) if parts else np.zeros(0, "i4")
        self.item_at = np.repeat(np.arange(len(self.names)), [n + window for n in self.lengths]) if parts else np.zeros(0, "i8")
        self.starts, self.lengths = np.array(self.starts, "i8"), np.array(self.lengths, "i8")
        self.seeds = []
        for mask in MASKS:
            pos, h = masked_hashes(self.ids, mask)
            order = np.argsort(h, kind="stable")
            self.seeds.append(self.without_repeats(h[order], pos[order]))
        self.anchors: dict[int, dict[str, list[tuple[int, str, int]]]] = {}
        by_length: dict[int, list[tuple[int, list[int]]]] = {}
        for item, (name, words) in enumerate(brief, len(self.names)):
            self.names.append(name)
            line = " ".join(words)
            if run := UNSPACED.search(line):
                anchor = run[0][:ANCHOR]
                self.anchors.setdefault(len(anchor), {}).setdefault(anchor, []).append((item, line, run.start()))
            else:
                by_length.setdefault(len(words), []).append((item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        self.brief = []
        for n, own in sorted(by_length.items()):
            h = masked_hashes(np.array([w for _, words in own for w in words], "i4"), "1" * n)[1][::n]
            order = np.argsort(h, kind="stable")
            self.brief.append((n, h[order], np.array([i for i, _ in own])[order], np.array([words for _, words in own], "i4")[order]))
        #: Known words of the least document that can hold an item.
        self.fewest = min([4, *by_length])

    def without_repeats(self, h: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of places of an item that are alike as far as windows over a seed reach, one is kept:
        an item that says the same over and over has few places that differ."""
        keep = np.ones(len(h), bool)
        shared = np.flatnonzero(np.append(False, h[1:] == h[:-1]) | np.append(h[1:] == h[:-1], False)) if len(h) else np.zeros(0, "i8")
        for cut in range(0, len(shared), HITS):
            own = shared[cut : cut + HITS]
            keep[own] = False
            keep[own[distinct_places(surroundings(self.ids, pos[own], self.window, self.item_at[pos[own]]))]] = True
        return h[keep], pos[keep]

    def held(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(item, first word, words) of brief items that the text holds by characters."""
        line, found = " ".join(words), {}
        for run in UNSPACED.finditer(line):
            for size, anchors in self.anchors.items():
                for i in range(run.start(), run.end() - size + 1):
                    for item, text, offset in anchors.get(line[i : i + size], ()):
                        a = i - offset
                        b = a + len(text)
                        # A word of a script with spaces must not go on beyond the item.
                        if item not in found and a >= 0 and line.startswith(text, a) and all(x in (0, len(line)) or " " in line[x - 1 : x + 1] or UNSPACED.search(line[x - 1 : x + 1]) for x in (a, b)):
                            found[item] = (line.count(" ", 0, a), text.count(" ") + 1)
        return [(item, *v) for item, v in found.items()]

    def whole(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """As ``overlaps``, of brief items by their words."""
        for n, h, items, words in self.brief:
            at, own = masked_hashes(ids, "1" * n)
            lo, hi = np.searchsorted(h, own), np.searchsorted(h, own, side="right")
            k = hi - lo
            hits = np.repeat(at, k)
            place = np.repeat(lo, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            same = (ids[hits[:, None] + np.arange(n)] == words[place]).all(1)
            hits, place = hits[same], place[same]
            docs = np.searchsorted(bounds, hits, side="right")
            _, first = np.unique(np.stack([docs, place], 1), axis=0, return_index=True)
            for i in first.tolist():
                yield int(docs[i]), int(items[place[i]]), int(hits[i]), n, n

    def matches(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(documents, items, first words, window lengths, words that agree) of windows around
        seed hits that agree in enough words, ``HITS`` hits at a time."""
        begins = np.concatenate([[0], bounds[:-1]])
        ends = bounds - self.window  # without the gap
        for mask, (h, pos) in zip(MASKS, self.seeds):
            at, own = masked_hashes(ids, mask)
            known = np.searchsorted(h, own) < np.searchsorted(h, own, side="right")
            at, own = at[known], own[known]
            docs = np.searchsorted(bounds, at, side="right")
            if len(at) > 1:
                first = distinct_places(surroundings(ids, at, self.window, docs))
                at, own, docs = at[first], own[first], docs[first]
            lo = np.searchsorted(h, own)
            n = np.searchsorted(h, own, side="right") - lo
            total = np.concatenate([[0], np.cumsum(n)])
            for cut in range(0, int(total[-1]), HITS):
                k = np.arange(cut, min(cut + HITS, int(total[-1])))
                hit = np.searchsorted(total, k, side="right") - 1
                yield self.verified(ids, at[hit], docs[hit], pos[lo[hit] + k - total[hit]], begins, ends)

    def verified(self, ids: np.ndarray, at: np.ndarray, docs: np.ndarray, place: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of document positions ``at`` and item positions ``place`` that a seed aligns: windows
        over the seed that lie within both texts and agree in enough words."""
        item = self.item_at[place]
        width = np.minimum(self.window, self.lengths[item])
        need = np.ceil(self.similarity * width - 1e-9).astype("i8")
        a, b = surroundings(ids, at, self.window), surroundings(self.ids, place, self.window)
        same = (a == b) & (b >= 0)
        total = np.concatenate([np.zeros((len(at), 1), "i2"), np.cumsum(same, axis=1, dtype="i2")], axis=1)
        out = []
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            agree = total[rows, w:] - total[rows, :-w]
            shift = np.arange(agree.shape[1]) - self.window
            starts, in_item = at[rows, None] + shift, place[rows, None] + shift
            inside = (starts >= begins[docs[rows], None]) & (starts + w <= ends[docs[rows], None])
            inside &= (in_item >= self.starts[item[rows], None]) & (in_item + w <= (self.starts + self.lengths)[item[rows], None])
            i, j = np.nonzero(inside & (agree >= need[rows, None]))
            r = rows[i]
            out.append((docs[r], item[r], starts[i, j], np.full(len(r), w), agree[i, j].astype("i8")))
        return tuple(map(np.concatenate, zip(*out)))

    def overlaps(self, ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first word, words, words that agree) of verified overlaps, where
        ``bounds`` holds the documents' ends in ``ids``, a gap included. The best window per
        pair, of equal ones the first."""
        best = [np.zeros(0, "i8")] * 5
        for found in self.matches(ids, bounds):
            docs, items, at, n, agree = map(np.concatenate, zip(best, found))
            order = np.lexsort((at, -agree, items, docs))
            pair = np.stack([docs[order], items[order]])
            first = order[np.concatenate([[True], (pair[:, 1:] != pair[:, :-1]).any(axis=0)])] if len(order) else order
            best = [x[first] for x in (docs, items, at, n, agree)]
        return list(zip(*(x.tolist() for x in best))) + list(self.whole(ids, bounds))


def scan(index: Index, texts: Iterator[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, first word, words, words that agree) over texts, a chunk at a time."""
    get, gap = index.vocabulary.get, np.full(index.window, -1, "i4")
    parts, bounds, starts, rows, size = [], [], [], [], 0

    def flush():
        for doc, item, at, n, agree in index.overlaps(np.concatenate(parts), np.array(bounds)):
            yield rows[doc], item, at - starts[doc], n, agree

    for row, text in enumerate(texts):
        words = words_of(text)
        if index.anchors:
            for item, at, n in index.held(words):
                yield row, item, at, n, n
        ids = [get(w, -1) for w in words]
        if len(ids) - ids.count(-1) < index.fewest:
            continue
        starts.append(size)
        rows.append(row)
        parts += [np.array(ids, "i4"), gap]
        size += len(ids) + len(gap)
        bounds.append(size)
        if size > CHUNK_WORDS:
            yield from flush()
            parts, bounds, starts, rows, size = [], [], [], [], 0
    if parts:
        yield from flush()


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, **options):
    """Indexes of the benchmark's blocks, one after another."""
    items = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield Index(sorted(((r["item_id"], r["text"]) for r in block.collect()), key=lambda x: (x[0] is None, x[0], x[1])), **options)


def overlap_batches(index, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            found = list(scan(own, (t.as_py() for t in batch.column("text"))))
            cols = list(zip(*found)) or [()] * 5
            ids = batch.column("doc_id").take(pa.array(cols[0], pa.int32()))
            items = pa.array([own.names[i] for i in cols[1]], item_type)
            yield pa.RecordBatch.from_arrays([ids, items, *(pa.array(c, pa.int32()) for c in cols[2:])], ["doc_id", "item_id", "first_word", "n_words", "n_agree"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_agree): documents that hold benchmark items.

    A document holds an item if some 13 consecutive words of it (all of a shorter item)
    agree, word for word at the same places, with the item's in at least 80 %. Words are
    runs of letters and digits in lower case. Items of fewer than 8 words are held where all
    their words follow each other; those in a script without spaces, where their characters
    do. One row per row of ``docs`` and item with the best window, of equal ones the first; ids
    may be of any type. Null ids are kept, null and empty texts hold nothing, repeated rows are
    judged alike, repeated items count once. Very long texts are taken whole; places that are
    alike are compared once, so texts that repeat themselves cost little. No documents or no
    items: no rows. Extra columns are left out.
    """
    spark = docs.sparkSession
    found, item = None, benchmark.schema["item_id"].dataType
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {item.simpleString()}, first_word int, n_words int, n_agree int"
    for index in blocks(benchmark, **options):
        sent = spark.sparkContext.broadcast(index)
        part = docs.select("doc_id", "text").mapInArrow(overlap_batches(sent, to_arrow_type(item)), schema)
        found = part if found is None else found.unionByName(part)
    return found


def clean_batches(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = np.ones(batch.num_rows, bool)
            for row, *_ in scan(index.value, (t.as_py() for t in batch.column("text"))):
                stay[row] = False
            yield batch.filter(pa.array(stay))

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    for index in blocks(benchmark, **options):
        docs = docs.mapInArrow(clean_batches(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
