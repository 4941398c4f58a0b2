"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared within candidate buckets. A bucket's fingerprints are stored
as bit planes (one machine word holds one bit of 64 fingerprints), so XOR with a row's bit
and carry-save adders update 64 distances at once; a block is abandoned as soon as every
distance in it is beyond the radius. Links within a bucket are thinned to a spanning forest
before they leave it, and components are found over distinct fingerprints only.

Buckets come from keys that linked fingerprints must share (exact pigeonhole keys). Buckets
of more than ``hot`` rows are dealt again by finer keys, and those that are still larger by
pairs of chunks, not capped. Similarity search over
texts, by the same comparison, is in :mod:`quire.llm.near_text`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import partitions, stored, table
from quire.llm.components import connected_components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Rows of a block of the bit-sliced comparison.
BLOCK = 512
#: Odd constants that make further 64-bit hashes of a hash.
MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, repeats included."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, "u8")
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], "u8")
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], "u8")


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31))) * np.uint64(MIX[k])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def majority(h: np.ndarray, words: int = 1) -> np.ndarray:
    """A fingerprint of 64 * words bits: a bit is 1 if set in over half the hashes."""
    total = np.zeros(64 * words, "i8")
    for a in range(0, len(h), 255 * 64):
        part = h[a : a + 255 * 64]
        wide = np.empty((len(part), words), "<u8")
        for k in range(words):
            wide[:, k] = part if k == 0 else mixed(part, k - 1)
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):
            total += bits[b : b + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(h), bitorder="little").view("<u8")


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """64-bit SimHash; 0 for a text without words."""
    return int(majority(shingle_hashes(text, size))[0])


def fingerprint_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint(t.as_py(), size) for t in batch.column("text").cast(pa.binary())], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "fp"])

    return run


def planes(fps: np.ndarray) -> np.ndarray:
    """(rows, words) fingerprints -> (bits, rows / 64) bit planes; rows is a multiple of 64."""
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def near(rows: np.ndarray, cols: np.ndarray, *radii: int) -> list[np.ndarray] | None:
    """For each radius the bit matrix (rows, columns / 64 words) of pairs at that many or fewer
    differing bits, or None once all pairs are beyond the largest. ``cols`` has a multiple
    of 64 rows."""
    sliced, own = planes(cols), np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")
    own = (np.uint64(0) - own.astype("u8"))  # all ones where the row's bit is set
    largest = max(radii)
    width = max(1, largest.bit_length())
    counters = [np.zeros((len(rows), sliced.shape[1]), "u8") for _ in range(width)]
    over = np.zeros_like(counters[0])
    n_bits = sliced.shape[0]

    def add(carry: np.ndarray, level: int) -> None:
        for i in range(level, width):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        np.bitwise_or(over, carry, out=over)

    def beyond(radius: int) -> np.ndarray:
        more, equal = np.zeros_like(over), ~np.zeros_like(over)
        for i in reversed(range(width)):
            if radius >> i & 1:
                equal &= counters[i]
            else:
                more |= equal & counters[i]
                equal &= ~counters[i]
        return over | more

    step = 4 if width < 3 else 32
    for at in range(0, n_bits, 4):
        a, b, c, d = (sliced[at + j][None, :] ^ own[:, at + j][:, None] for j in range(4))
        # Carry-save: four planes become ones, twos and fours before the counters ripple.
        ab, cd = a ^ b, c ^ d
        ones = ab ^ cd
        twos_a, twos_b, twos_c = a & b, c & d, ab & cd
        x = twos_a ^ twos_b
        twos, fours = x ^ twos_c, (twos_a & twos_b) | (x & twos_c)
        add(ones, 0)
        for level, plane in ((1, twos), (2, fours)):
            if level < width:
                add(plane, level)
            else:
                np.bitwise_or(over, plane, out=over)
        if (at + 4) % step == 0 and at + 4 < n_bits and at + 4 > largest and bool((beyond(largest) == ~np.uint64(0)).all()):
            return None
    return [~beyond(r) for r in radii]


def near_pairs(rows: np.ndarray, cols: np.ndarray, *radii: int) -> list[np.ndarray] | None:
    """:func:`near` as boolean matrices, for any number of columns."""
    pad = -len(cols) % 64
    hits = near(rows, np.vstack([cols, np.zeros((pad, cols.shape[1]), "<u8")]) if pad else cols, *radii)
    return hits and [np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")[:, : len(cols)].astype(bool) for h in hits]


def tile_pairs(keys: np.ndarray) -> Iterator[tuple[slice, slice, slice]]:
    """(rows, columns, stretch) of the comparisons within runs of equal keys.

    Whole small runs share a block; a run larger than a block is compared block by block.
    No row outside the stretch has a key of it."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist() + [len(keys)]
    i = 0
    while i < len(starts) - 1:
        j = i + 1
        while j < len(starts) - 1 and starts[j + 1] - starts[i] <= BLOCK:
            j += 1
        stretch = slice(starts[i], starts[j])
        tiles = [slice(x, min(x + BLOCK, starts[j])) for x in range(starts[i], starts[j], BLOCK)]
        for y, second in enumerate(tiles):
            for first in tiles[: y + 1]:
                yield first, second, stretch
        i = j


class Labels:
    """Components of rows, by label. One link for each union is kept in ``links``."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def unite(self, row: int, others: np.ndarray, stretch: slice) -> None:
        """Links ``row`` to one row of each other component among ``others``."""
        part = self.of[stretch]
        others = others[self.of[others] != self.of[row]]
        while len(others):
            self.links.append((row, int(others[0])))
            part[part == self.of[others[0]]] = self.of[row]
            others = others[self.of[others] != self.of[row]]

    def unite_all(self, found: np.ndarray, a: slice, b: slice, stretch: slice) -> None:
        for i in np.flatnonzero(found.any(axis=1)).tolist():
            self.unite(a.start + i, np.flatnonzero(found[i]) + b.start, stretch)


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links of the rows (sorted by key) that share a key and are near each other."""
    labels = Labels(len(keys))
    for a, b, stretch in tile_pairs(keys):
        found = near_pairs(fps[a], fps[b], radius)
        if found:
            same = found[0] & (keys[a][:, None] == keys[b][None, :])
            labels.unite_all(np.triu(same, 1) if a == b else same, a, b, stretch)
    return labels.links


def compare_batches(words: int, radius: int):
    """Over rows sorted by key; complete buckets only, so memory holds one bucket and a batch."""

    def work(keys: np.ndarray, vids: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        same = keys[1:] == keys[:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(keys) else np.zeros(0, bool)
        keys, vids, fps = keys[twice], vids[twice], np.ascontiguousarray(fps[twice])
        at = np.array(bucket_links(keys, fps, radius) if len(keys) else [], "i8").reshape(-1, 2)
        u, v = vids[at[:, 0]], vids[at[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, vids = batch.column("key").to_numpy(), batch.column("vid").to_numpy()
            fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), "<u8").reshape(-1, words)
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                kept.append((keys[:cut], vids[:cut], fps[:cut]))
                yield work(*map(np.concatenate, zip(*kept)))
                kept = []
            elif kept and kept[-1][0][-1] != keys[0]:
                yield work(*map(np.concatenate, zip(*kept)))
                kept = []
            kept.append((keys[cut:], vids[cut:], fps[cut:]))
        if kept:
            yield work(*map(np.concatenate, zip(*kept)))

    return run


def near_links(rows: DataFrame, words: int, radius: int, hot: int = 8192) -> DataFrame:
    """(u, v) from rows (vid long, fp binary, keys array<long>, subs array<array<long>>), where
    ``subs`` has finer keys for each key, or one list for all.

    Rows that share a key are compared. Of keys with more than ``hot`` rows the rows are
    dealt again by the key and each of its ``subs``. Where that leaves more than ``hot`` too,
    rows are cut into chunks of half as many and every two chunks are a bucket of their own, so
    no task holds more. Those keys are stored tables, which Spark broadcasts only if their
    files are small enough."""
    spark = rows.sparkSession
    flat = rows.select("vid", "fp", F.posexplode("keys").alias("k", "key"), "subs").select("vid", "fp", "key", F.get("subs", F.least(F.col("k"), F.size("subs") - 1)).alias("subs"))
    hot_keys = stored(rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key"), "hotkeys")
    cold = flat.join(hot_keys, "key", "left_anti").select("key", "vid", "fp")
    again = flat.join(hot_keys, "key", "left_semi").select("vid", "fp", "key", F.posexplode("subs").alias("s", "sub")).select(F.xxhash64("key", "s", "sub").alias("key"), "vid", "fp")
    half = F.lit(max(1, hot // 2))
    crowds = stored(again.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key", F.ceil(F.col("n") / half).cast("long").alias("chunks")), "crowds")
    if not crowds.isEmpty():
        chunk, other = F.pmod(F.xxhash64(F.lit(7), "vid"), F.col("chunks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
        crowded = again.join(crowds, "key").select("key", "vid", "fp", chunk.alias("chunk"), other)
        cells = crowded.select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"), "vid", "fp")
        again = again.join(crowds, "key", "left_anti").select("key", "vid", "fp").unionByName(cells)
    dealt = cold.unionByName(again).repartition(partitions(spark), "key").sortWithinPartitions("key", "vid")
    return dealt.mapInArrow(compare_batches(words, radius), "u long, v long")


def pigeonhole_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a radius of 2: of four 16-bit blocks two agree, so six keys (two blocks each)
    lose no link; of the other 32 bits one of three parts agrees, which makes the subs."""
    blocks = fps.view("<u2").reshape(-1, 4).astype("u8")
    keys, subs = [], []
    for t, (i, j) in enumerate(combinations(range(4), 2)):
        p, q = (x for x in range(4) if x not in (i, j))
        rest = blocks[:, p] << np.uint64(16) | blocks[:, q]
        keys.append((np.uint64(t) << np.uint64(32)) | blocks[:, i] << np.uint64(16) | blocks[:, j])
        subs.append(np.stack([rest & np.uint64(0x7FF), rest >> np.uint64(11) & np.uint64(0x7FF), rest >> np.uint64(22)], 1))
    return np.stack(keys, 1).view("i8"), np.stack(subs, 1).view("i8")


def key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy().view("u8")
        n = len(fps)
        keys, subs = pigeonhole_keys(fps)
        key_list = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4") * 6), pa.array(keys.ravel()))
        inner = pa.ListArray.from_arrays(pa.array(np.arange(6 * n + 1, dtype="i4") * 3), pa.array(subs.ravel()))
        sub_list = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4") * 6), inner)
        raw = pa.array([x.tobytes() for x in fps], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("fp"), raw, key_list, sub_list], ["vid", "fp", "keys", "subs"])


ROWS = "vid long, fp binary, keys array<long>, subs array<array<long>>"


def simhash_components(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id): 64-bit SimHash over ``size``-word shingles, linked at
    2 or fewer differing bits.

    component_id is the smallest id reachable, null only if all ids there are null. Texts
    without words (null too) have fingerprint zero and link like others; very long texts are
    taken whole. Repeated rows and ids stay; ties of a bit (set in just half) are 0. No rows:
    no rows. Extra columns are left out.
    """
    prints = stored(docs.select("doc_id", "text").mapInArrow(fingerprint_batches(size), "doc_id long, fp long"), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = near_links(classes.select("fp").mapInArrow(key_batches, ROWS), 1, 2)
    roots = connected_components(links)
    rooted = classes.join(roots, classes["fp"] == roots["vid"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
