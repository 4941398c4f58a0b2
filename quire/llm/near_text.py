"""Near-duplicate texts: bit-sliced SimHash comparison, then exact similarity where in doubt.

Texts are sets of word shingles. Each has a 512-bit SimHash and eight keys made of two minima
of its shingle hashes; texts that share a key are compared bit-sliced. A distance far above
what the wanted similarity gives on average is no link, equal fingerprints are one, and
all between is decided by the shingle sets themselves: only texts with a partner in doubt
have their sets fetched, and once two texts are in one component they are not
compared again. No pair is written for more than one link of a component.

Fingerprints alone can't give the candidates: at a similarity of 0.8 they differ in 15 % of
their bits on average, so a key of 16 bits would be shared by 7 % of such pairs (90 tables for
the 0.999 that eight keys of two minima reach), and exact pigeonhole keys would have 4 bits.

A key of very many texts is dealt to cells: its texts are cut into chunks and each pair of
chunks is compared in a task of its own, so no pair is lost and no task holds the whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_scratch, partitions, stored
from quire.llm.components import connected_components
from quire.llm.simhash import Labels, majority, mixed, near_pairs, shingle_hashes, tile_pairs

WORDS = 8
TABLES = 8
#: With fewer shingles than this many fingerprint bits are ties.
FEW = 16
#: A key's rows or bytes of shingle hashes beyond which it is dealt to cells.
CELL_ROWS = 8192
CELL_BYTES = 64 << 20
SETS = "vid long, shingles binary"
LINKS = "u long, v long, key long"


@dataclass(frozen=True)
class Radii:
    """Differing bits: a link up to ``sure``, none beyond ``doubt`` (``few`` for small sets)."""

    sure: int
    doubt: int
    few: int
    similarity: float


def radii_of(similarity: float, bits: int = 64 * WORDS) -> Radii:
    """Four standard deviations around the mean distance of sets of equal size at this Jaccard
    similarity (others are nearer); ties in small sets add up to a quarter to the mean."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    mean, spread = bits * p, 4 * math.sqrt(bits * p * (1 - p))
    return Radii(0, math.ceil(mean + spread), math.ceil(1.25 * mean + spread), similarity)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketch(text: bytes | None, size: int) -> tuple[bytes, list[int], int]:
    """(fingerprint, keys, number of shingles) of the set of shingles. Minima under seeded
    orders: two texts share one with the probability of their similarity."""
    h = np.unique(shingle_hashes(text, size))
    h = h if len(h) else np.zeros(1, "u8")
    least = [int(mixed(h ^ np.uint64(s * 0x2545F4914F6CDD1D & (1 << 64) - 1), s % 7).min()) for s in range(2 * TABLES)]
    keys = [signed(xxhash.xxh64_intdigest(b"%d %d %d" % (k, least[2 * k], least[2 * k + 1]))) for k in range(TABLES)]
    return majority(h, WORDS).tobytes(), keys, len(h)


def sketch_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys, sizes = zip(*(sketch(t.as_py(), size) for t in batch.column("text").cast(pa.binary()))) if batch.num_rows else ((), (), ())
            new = [pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int32())]
            names = ["doc_id", "t1", "t2"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], [*names, "fp", "keys", "size"])

    return run


def set_batches(size: int):
    """The sorted shingle hashes of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), size)).astype("<u8").tobytes() for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("vid"), pa.array(sets, pa.binary())], ["vid", "shingles"])

    return run


class Rows:
    """Rows of whole cells, sorted by cell. ``side``: rows of one side are not compared with
    each other, but for side -1; ``table``: the place of the key among ``keys``."""

    def __init__(self, batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches)
        cell = t.column("cell").to_numpy()
        same = cell[1:] == cell[:-1]
        t = t.filter(pa.array(np.append(same, False) | np.append(False, same))).combine_chunks()  # rows that are not alone
        self.cell, self.vid, self.key, self.side, self.table, self.size = (t.column(c).to_numpy() for c in ("cell", "vid", "key", "side", "k", "size"))
        n = len(self.cell)
        self.fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), "<u8").reshape(n, WORDS)
        self.keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(n, TABLES)
        self.sets = [np.frombuffer(x, "<u8") for x in t.column("shingles").to_pylist()] if "shingles" in t.schema.names else []

    def compare(self, a: slice, b: slice, radii: Radii) -> tuple[np.ndarray, np.ndarray] | None:
        """Boolean matrices of the pairs that are links for sure, and of those in doubt. A pair
        is in doubt only under the first key that both have."""
        hits = near_pairs(self.fps[a], self.fps[b], radii.sure, radii.doubt, radii.few)
        if not hits:
            return None
        sure, doubt, few = hits
        side, size = self.side, self.size.astype("f8")
        pairs = (self.cell[a][:, None] == self.cell[b][None, :]) & ((side[a] < 0)[:, None] | (side[a][:, None] != side[b][None, :]))
        if a == b:
            pairs = np.triu(pairs, 1)
        small = (size[a] < FEW)[:, None] | (size[b] < FEW)[None, :]
        alike = np.minimum(size[a][:, None], size[b][None, :]) >= radii.similarity * np.maximum(size[a][:, None], size[b][None, :]) - 1e-9
        sure &= pairs
        doubt = (doubt | few & small) & pairs & alike & ~sure
        for t in range(TABLES - 1):
            if not doubt.any():
                break
            doubt &= ~((self.table[a] > t)[:, None] & (self.keys[a][:, t][:, None] == self.keys[b][:, t][None, :]))
        return sure, doubt

    def postings(self, b: slice) -> tuple[np.ndarray, np.ndarray]:
        """(shingle hashes in order, their rows) of a tile."""
        values = np.concatenate(self.sets[b])
        rows = np.repeat(np.arange(b.stop - b.start), [len(s) for s in self.sets[b]])
        order = np.argsort(values, kind="stable")
        return values[order], rows[order]

    def common(self, row: int, b: slice, postings: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """How many shingles each row of the tile has in common with ``row``."""
        values, owners = postings
        lo, hi = np.searchsorted(values, self.sets[row]), np.searchsorted(values, self.sets[row], side="right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(owners[at], minlength=b.stop - b.start)


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """Rows sorted by cell -> rows of complete cells; memory holds a cell and a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column("cell").to_numpy()
        cut = int(np.searchsorted(cells, cells[-1]))
        if cut:
            yield Rows([*held, batch.slice(0, cut)])
            held = []
        elif held and held[-1].column("cell")[-1].as_py() != cells[0]:
            yield Rows(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield Rows(held)


def compare_batches(radii: Radii):
    """Sure links (u, v), and (u, null, key) of rows that have a partner in doubt there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches):
            labels, doubtful = Labels(len(rows.cell)), np.zeros(len(rows.cell), bool)
            for a, b, stretch in tile_pairs(rows.cell):
                if b.stop - a.start < 2 or not (found := rows.compare(a, b, radii)):
                    continue
                sure, doubt = found
                labels.unite_all(sure, a, b, stretch)
                doubt &= labels.of[a][:, None] != labels.of[b][None, :]
                doubtful[a] |= doubt.any(axis=1)
                doubtful[b] |= doubt.any(axis=0)
            links = np.array(labels.links, "i8").reshape(-1, 2)
            n, m = len(links), int(doubtful.sum())
            u = np.concatenate([rows.vid[links[:, 0]], rows.vid[doubtful]])
            v = pa.array(np.concatenate([rows.vid[links[:, 1]], np.zeros(m, "i8")]), mask=np.arange(n + m) >= n)
            key = pa.array(np.concatenate([np.zeros(n, "i8"), rows.key[doubtful]]), mask=np.arange(n + m) < n)
            yield pa.RecordBatch.from_arrays([pa.array(u), v, key], ["u", "v", "key"])

    return run


def verify_batches(radii: Radii):
    """Links (u, v) of pairs in doubt, by their shingle sets."""
    s = radii.similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches):
            labels, index, last = Labels(len(rows.cell)), None, None
            for a, b, stretch in tile_pairs(rows.cell):
                if b.stop - a.start < 2 or not (found := rows.compare(a, b, radii)):
                    continue
                sure, doubt = found
                labels.unite_all(sure, a, b, stretch)
                for i in np.flatnonzero(doubt.any(axis=1)).tolist():
                    row = a.start + i
                    others = np.flatnonzero(doubt[i]) + b.start
                    others = others[labels.of[others] != labels.of[row]]
                    if not len(others):
                        continue
                    if last != b:
                        index, last = rows.postings(b), b
                    common = rows.common(row, b, index)[others - b.start]
                    alike = common * (1 + s) >= s * (rows.size[row] + rows.size[others].astype("i8")) - 1e-9
                    labels.unite(row, others[alike], stretch)
            links = np.array(labels.links, "i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(rows.vid[links[:, 0]]), pa.array(rows.vid[links[:, 1]])], ["u", "v"])

    return run


def dealt_to_cells(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """Rows (vid, key, ...) with cell and side, sorted by cell within partitions. ``crowded``
    (key, chunks) is a stored table, which Spark broadcasts only if it is small."""
    chunk = F.pmod(F.xxhash64(F.lit(5), "vid"), F.col("chunks"))
    marked = rows.join(crowded, "key", "left").withColumn("chunk", chunk)
    other = F.when(F.col("chunks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    spread = marked.withColumn("other", F.explode(other))
    alone = F.col("chunks").isNull()
    cell = F.when(alone, F.col("key")).otherwise(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")))
    side = F.when(alone | (F.col("chunk") == F.col("other")), -1).when(F.col("chunk") < F.col("other"), 0).otherwise(1).cast("int")
    cells = spread.withColumns({"cell": cell, "side": side}).drop("chunks", "chunk", "other")
    return cells.repartition(partitions(rows.sparkSession), "cell").sortWithinPartitions("cell", "vid")


def text_keys() -> list[Column]:
    """A 128-bit key of the text, in two columns."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, cell_rows: int = CELL_ROWS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(t1, t2, least, component_id, stays): texts, by key, and their groups of near copies.

    Equal texts are one class (``least``: its smallest id). Classes are linked where the Jaccard
    similarity of their sets of ``size``-word shingles (lower case A-Z; the whole text if it has
    fewer words) is at least ``similarity``, which the sets themselves decide for all pairs but
    those with equal 512-bit fingerprints. A pair at 0.8 shares one of the eight keys, and
    so is seen, with probability 0.9997; more similar pairs with a higher one. component_id is
    the smallest id of the group, and the class that has it ``stays`` (of several, or where all
    ids are null, the one of the smallest key). Texts without words are not returned; very long
    texts are taken whole; repeated rows are one class. No rows: no rows. Extra columns are left out.
    """
    spark = docs.sparkSession
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(has_words).select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(), "text")
    sketches = keyed.mapInArrow(sketch_batches(size), "doc_id long, t1 long, t2 long, fp binary, keys array<long>, size int")
    classes = stored(sketches.groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("fp", "keys", "size")]), "classes")
    # A class goes by its id; where several texts share one, or have none, by a hash.
    shared = stored(classes.groupBy("least").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND least IS NOT NULL").select("least", F.lit(True).alias("shared")), "shared")
    vid = F.when(F.col("shared").isNull() & F.col("least").isNotNull(), F.col("least")).otherwise(F.xxhash64("t1", "t2"))
    classes = classes.join(shared, "least", "left").withColumn("vid", vid).drop("shared")
    links = similar(classes, keyed, size, radii_of(similarity), cell_rows, cell_bytes)
    roots = connected_components(links)
    rooted = stored(classes.select("t1", "t2", "least", "vid").join(roots, "vid", "left").select("t1", "t2", "least", F.coalesce("root", "vid").alias("root")), "rooted")
    groups = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "t1", "t2")).alias("head"))
    stays = (F.col("t1") == F.col("head.t1")) & (F.col("t2") == F.col("head.t2"))
    return rooted.join(groups, "root").select("t1", "t2", "least", F.col("head.least").alias("component_id"), stays.alias("stays"))


def similar(classes: DataFrame, texts: DataFrame, size: int, radii: Radii, cell_rows: int, cell_bytes: int) -> DataFrame:
    """Links (u, v), spanning each component of similar ``classes`` (vid, least, t1, t2, fp,
    keys, size). ``texts`` (doc_id, t1, t2, text) holds their texts."""
    half = F.lit(max(1, cell_rows // 2))
    flat = classes.select("vid", "fp", "keys", "size", F.posexplode("keys").alias("k", "key"))
    crowded = flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows).select("key", F.ceil(F.col("n") / half).cast("long").alias("chunks"))
    found = stored(dealt_to_cells(flat, stored(crowded, "crowded")).mapInArrow(compare_batches(radii), LINKS), "found")
    doubtful = stored(found.where("v IS NULL").select(F.col("u").alias("vid"), "key").distinct(), "doubtful")
    wanted = stored(classes.join(doubtful.select("vid").distinct(), "vid").select("vid", F.col("least").alias("own"), F.col("t1").alias("w1"), F.col("t2").alias("w2")), "wanted")
    own_text = (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("own"))
    sets = texts.join(wanted, own_text).select("vid", "text").mapInArrow(set_batches(size), SETS)
    sets = stored(sets.groupBy("vid").agg(F.first("shingles").alias("shingles")), "sets")  # a row may be repeated
    known = doubtful.join(classes.select("vid", "fp", "keys", "size"), "vid").withColumn("k", (F.array_position("keys", F.col("key")) - 1).cast("int"))
    room = F.lit(max(1, cell_bytes // 2))
    crowded = known.groupBy("key").agg(F.sum(F.col("size").cast("long") * 8).alias("b")).where(F.col("b") > cell_bytes).select("key", F.ceil(F.col("b") / room).cast("long").alias("chunks"))
    verified = stored(dealt_to_cells(known.join(sets, "vid"), stored(crowded, "crowdedsets")).mapInArrow(verify_batches(radii), "u long, v long"), "verified")
    drop_scratch(sets)
    return found.where("v IS NOT NULL").select("u", "v").unionByName(verified)


def one_of_each_group(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, but near copies: of each group only rows with its
    smallest id stay. Texts without words stay, and so do rows that repeat a kept id and text."""
    groups = near_duplicates(docs, size, similarity).select("t1", "t2", "least", "stays")
    left = docs.select(F.struct(*docs.columns).alias("rec"), *text_keys())
    kept = left.join(groups, ["t1", "t2"], "left").where("stays IS NULL OR stays AND rec.doc_id <=> least")
    return kept.select("rec.*")
