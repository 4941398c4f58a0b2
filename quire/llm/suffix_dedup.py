"""Removal of repeated byte strings by a sparse, range-partitioned suffix array.

A string of ``length`` bytes is a repeat if it also starts anywhere else. Sorting the
suffixes at all positions would take many times the input; two facts make it sparse:

1. Anchors. In every run of ``length`` bytes, the ``GRAM``-byte gram with the least hash is
   at the same place in each copy (minimizers). So both copies of a repeat have an anchor at
   the same offset, and only suffixes at anchors need comparing. Anchors whose gram occurs
   once can't lie in a repeat and go first.
2. Contexts. Around an anchor, the repeats that contain it lie within a fixed stretch. Equal
   stretches are one entry with a count, so copies, however many, are sorted once.

Suffixes at anchors are range-partitioned by their leading bytes through sampled splitters.
Each bucket sorts them by multikey quicksort, and the bytes before the anchors, read
backwards, in the same way. Common prefixes of neighbours in both orders show which strings
around an anchor two contexts have in common, byte for byte. Splitters fall between different
grams, and contexts of different grams have no string around the anchor in common, so
neighbours across such a boundary need no comparison. A gram of more than ``HOT`` contexts
would outgrow a bucket: its contexts are dealt over all tasks and compared across those
boundaries by 128-bit hashes of their strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import drop_scratch, partitions, stored, table

GRAM = 64
#: More than the length of a span around one anchor; a power of two.
SPAN = 1 << 16
#: Contexts of one gram that a bucket takes.
HOT = 20_000
#: Bytes whose anchors are found at once; longer texts are taken in overlapping pieces.
PIECE = 1 << 20
#: Bytes of contexts in a bucket, which one task holds.
BUCKET_BYTES = 64 << 20
#: Contexts compared at once.
CHUNK = 8192
LETTERS = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of the GRAM bytes at every position, by doubling."""
    h, size = LETTERS[data], 1
    while size < GRAM:
        h = h[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + h[size:]
        size *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes): the least gram of every run of ``length`` bytes, with ties."""
    width = length - GRAM + 1
    found, hashes = [], []
    for start in range(0, max(1, len(data) - length + 1), PIECE):
        piece = np.frombuffer(data, np.uint8, min(len(data) - start, PIECE + length - 1), start)
        if len(piece) < length:
            break
        h = gram_hashes(piece)
        least = sliding(h, width, np.minimum)
        fill = np.zeros(width - 1, "u8")
        chosen = sliding(np.concatenate([fill, least, fill]), width, np.maximum) == h
        at = np.flatnonzero(chosen)
        found.append(at + start)
        hashes.append(h[at])
    if not found:
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    at, first = np.unique(np.concatenate(found), return_index=True)
    return at, np.concatenate(hashes)[first]


def context(data: bytes, at: int, length: int) -> tuple[int, bytes]:
    """(bytes before the anchor, all bytes) of the stretch in which repeats with it lie."""
    start = max(0, at - (length - GRAM))
    return at - start, data[start : at + length]


def anchor_batches(length: int):
    """(doc, fp, pos, g, c): places and 64-bit hashes of grams and contexts. Equal contexts have
    equal grams, so (g, c) is their 128-bit key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch, rows, positions, grams, contexts):
            at = pa.array(np.repeat(np.array(rows, "i4"), [len(p) for p in positions]))
            pos = np.concatenate(positions) if positions else np.zeros(0)
            gram = np.concatenate(grams) if grams else np.zeros(0, "u8")
            columns = [pa.array(pos.astype("i4")), pa.array(gram.view("i8")), pa.array(np.array(contexts, "u8").view("i8"))]
            return pa.RecordBatch.from_arrays([batch.column("doc").take(at), batch.column("fp").take(at), *columns], ["doc", "fp", "pos", "g", "c"])

        for batch in batches:
            rows, positions, grams, contexts = [], [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                data = text.as_py() or b""
                if len(data) >= length:
                    p, g = anchors(data, length)
                    rows.append(i)
                    positions.append(p)
                    grams.append(g)
                    for at in p.tolist():
                        left, bytes_ = context(data, at, length)
                        contexts.append(xxhash.xxh3_64_intdigest(bytes_, left))
                    if len(contexts) > 200_000:
                        yield out(batch, rows, positions, grams, contexts)
                        rows, positions, grams, contexts = [], [], [], []
            yield out(batch, rows, positions, grams, contexts)

    return run


def context_batches(length: int):
    """(g, c, n, left, ctx) of documents with ``at``, the contexts that they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["g", "c", "n", "left", "ctx"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

        found = []
        for batch in batches:
            for text, at in zip(batch.column("text").cast(pa.binary()), batch.column("at")):
                data = text.as_py()
                for r in at.as_py():
                    found.append((r["g"], r["c"], r["n"], *context(data, r["pos"], length)))
                if len(found) > 20_000:
                    yield out(found)
                    found = []
        if found:
            yield out(found)

    return run


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of (n, k) big-endian words and group numbers of equal rows.

    A multikey quicksort, one word a level: each level sorts by its word within the groups
    that are still equal, and only those of more than one row go to the next."""
    n, k = words.shape
    order, group = np.arange(n), np.zeros(n, "i8")
    active = np.arange(n)  # places in ``order`` whose group has several rows
    for level in range(k):
        if not len(active):
            break
        rows = order[active]
        by = np.lexsort((words[rows, level], group[active]))
        rows = rows[by]
        order[active] = rows
        word, own = words[rows, level], group[active]
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (own[1:] != own[:-1])])
        starts = np.flatnonzero(new)
        group[active] = active[starts][np.cumsum(new) - 1]  # a group is named by its first place
        sizes = np.diff(np.append(starts, len(active)))
        active = active[np.repeat(sizes > 1, sizes)]
    return order, group


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row, in this order, has in common with the row before it; the first: -1."""
    differ = rows[order[1:]] != rows[order[:-1]]
    found = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.append(-1, found)


def big_words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as words that sort like them."""
    pad = -rows.shape[1] % 8
    return np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8")


def repeats(ctx: list[bytes], left: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest offset ``a`` at which the string of ``length`` bytes from
    ``a`` bytes before the anchor is a repeat (-1: none) of contexts in these.

    Suffixes from the anchors on are sorted, and so are the bytes before them, read
    backwards; common prefixes of neighbours give, for every ``a``, runs of rows that agree in the
    ``length - a`` bytes from the anchor and runs that agree in the ``a`` bytes before it.
    Two rows in the same run of both have the string in common."""
    before, n = length - GRAM, len(ctx)
    right = np.fromiter(map(len, ctx), "i8", n) - left
    after, ahead = np.zeros((n, length), np.uint8), np.zeros((n, before), np.uint8)
    for i, (data, k) in enumerate(zip(ctx, left.tolist())):
        row = np.frombuffer(data, np.uint8)
        after[i, : len(row) - k] = row[k:]
        ahead[i, :k] = row[:k][::-1]
    least, most = np.full(n, 1 << 30), np.full(n, -1)
    many = (count > 1) & (np.maximum(0, length - right) <= left)
    least[many], most[many] = np.maximum(0, length - right)[many], left[many]
    if n < 2:
        return least, most
    sides = []
    for rows, size in ((after, right), (ahead, left)):
        order = multikey_sort(big_words(rows))[0]
        prefix = common_prefixes(rows, order)
        best = np.empty(n, "i8")
        best[order] = np.minimum(np.maximum(prefix, np.append(prefix[1:], -1)), size[order])
        sides.append((order, prefix, best))
    (by_right, lcp, most_right), (by_left, lcs, most_left) = sides
    # No neighbour has more in common with a row than this, on either side.
    hopeful = most_right + most_left >= length
    run_right, run_left = np.empty(n, "i8"), np.empty(n, "i8")
    low, high = np.maximum(length - most_right, 0), most_left
    for a in range(int(low[hopeful].min()), int(high[hopeful].max()) + 1) if hopeful.any() else ():
        rows = np.flatnonzero(hopeful & (low <= a) & (a <= high))
        if len(rows) < 2:
            continue
        run_right[by_right] = np.cumsum(lcp < length - a)
        run_left[by_left] = np.cumsum(lcs < a)
        key = run_right[rows] * (n + 1) + run_left[rows]
        _, inverse, size = np.unique(key, return_inverse=True, return_counts=True)
        both = rows[size[inverse] > 1]
        least[both] = np.minimum(least[both], a)
        most[both] = np.maximum(most[both], a)
    return least, most


def bucket_batches(length: int):
    """(g, c, least, most) of a bucket of contexts (g, c, n, left, ctx) with repeats, sorted here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, c, n, left, ctx = [], [], [], [], []
        for b in batches:
            for own, name in ((g, "g"), (c, "c"), (n, "n"), (left, "left")):
                own.append(b.column(name).to_numpy())
            ctx += b.column("ctx").to_pylist()
        if not ctx:
            return
        g, c, n, left = map(np.concatenate, (g, c, n, left))
        grams = np.frombuffer(b"".join([d[k : k + GRAM] for d, k in zip(ctx, left.tolist())]), ">u8").reshape(-1, GRAM // 8)
        order, group = multikey_sort(grams)
        starts = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(order)).tolist()
        i = 0
        while i < len(starts) - 1:
            j = i + 1
            while j < len(starts) - 1 and starts[j + 1] - starts[i] <= CHUNK:
                j += 1
            rows = order[starts[i] : starts[j]]
            least, most = repeats([ctx[r] for r in rows.tolist()], left[rows].astype("i8"), n[rows], length)
            some = most >= 0
            yield pa.RecordBatch.from_arrays([pa.array(g[rows][some]), pa.array(c[rows][some]), pa.array(least[some].astype("i4")), pa.array(most[some].astype("i4"))], ["g", "c", "least", "most"])
            i = j

    return run


def string_batches(length: int):
    """128-bit hashes of every string of ``length`` bytes around the anchors of contexts."""
    before = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, offsets, hashes = [], [], []
            for i, (left, data) in enumerate(zip(b.column("left").to_pylist(), b.column("ctx").to_pylist())):
                for a in range(max(0, length - (len(data) - left)), min(left, before) + 1):
                    rows.append(i)
                    offsets.append(a)
                    hashes.append(xxhash.xxh3_128_digest(data[left - a : left - a + length]))
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("g").take(at), b.column("c").take(at), b.column("n").take(at), pa.array(offsets, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["g", "c", "n", "a", "s1", "s2"])

    return run


def spelled_out(contexts: DataFrame, length: int) -> DataFrame:
    """(g, c, least, most) of contexts of grams too frequent for a bucket: comparison across
    boundaries. Any number of contexts of one gram, dealt over all tasks by their strings."""
    strings = stored(contexts.mapInArrow(string_batches(length), "g long, c long, n long, a int, s1 long, s2 long"), "strings")
    # A string's place is known by any of its anchors, so only equal offsets are counted together.
    twice = strings.groupBy("s1", "s2", "a").agg(F.sum("n").alias("times")).where("times > 1").select("s1", "s2", "a")
    return strings.join(twice, ["s1", "s2", "a"], "left_semi").groupBy("g", "c").agg(F.min("a").alias("least"), F.max("a").alias("most"))


def keyed(docs: DataFrame) -> DataFrame:
    """Adds doc and fp. Rows with equal keys have equal texts, and so equal results; where ids
    are unique, they are key enough and fp is zero."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    unique = docs.groupBy(doc.alias("doc")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return docs.select("doc_id", doc.alias("doc"), (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("fp"), "text")


def repeated_spans(rows: DataFrame, length: int = 200, n_buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """(doc, fp, spans array<struct<start,end>>) of :func:`keyed` rows with repeats: byte ranges,
    which may overlap, whose union is what repeats cover."""
    spark = rows.sparkSession
    all_anchors = stored(rows.select("doc", "fp", "text").mapInArrow(anchor_batches(length), "doc long, fp long, pos int, g long, c long"), "anchors")
    # Stored, so that the join reads both sides as they are and Spark can split a frequent gram.
    several = stored(all_anchors.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"), "grams")
    members = stored(all_anchors.join(several, "g", "left_semi").select("doc", "fp", "pos", "g", "c"), "members")
    drop_scratch(all_anchors)
    drop_scratch(several)
    # One place stands for all equal contexts: only its bytes are fetched.
    distinct = stored(members.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), *[F.first(x).alias(x) for x in ("doc", "fp", "pos")]), "distinct")
    # At most (distinct contexts / hot) grams; Spark broadcasts them only if their file is small.
    hot_grams = stored(distinct.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot).select("g"), "hotgrams")
    # Dealt as plain rows, which are smaller than the lists of a partial aggregate.
    listed = distinct.repartition(partitions(spark), "doc", "fp").groupBy("doc", "fp").agg(F.collect_list(F.struct("pos", "g", "c", "n")).alias("at"))
    fetched = rows.select("doc", "fp", "text").join(listed, ["doc", "fp"]).select("text", "at").mapInArrow(context_batches(length), "g long, c long, n long, left int, ctx binary")
    # Stored: texts are shuffled once for both ways and for the sampling of splitters.
    contexts = stored(fetched, "contexts")
    n_buckets = n_buckets or max(partitions(spark), distinct.count() * (2 * length - GRAM) // BUCKET_BYTES + 1)
    buckets = contexts.join(hot_grams, "g", "left_anti").repartitionByRange(n_buckets, F.substring("ctx", F.col("left") + 1, F.lit(GRAM)))
    results = buckets.mapInArrow(bucket_batches(length), "g long, c long, least int, most int")
    if not hot_grams.isEmpty():
        results = results.unionByName(spelled_out(contexts.join(hot_grams, "g", "left_semi"), length))
    results = stored(results, "repeats")
    drop_scratch(contexts)
    start, end = F.col("pos").cast("long") - F.col("most"), F.col("pos").cast("long") - F.col("least") + length
    spans = members.join(results, ["g", "c"]).select("doc", "fp", (start * SPAN + end - start).cast("long").alias("packed"))
    packed = spans.repartition(partitions(spark), "doc", "fp").groupBy("doc", "fp").agg(F.sort_array(F.collect_set("packed")).alias("packed"))
    unpacked = F.transform("packed", lambda x: F.struct(F.shiftright(x, SPAN.bit_length() - 1).alias("start"), (F.shiftright(x, SPAN.bit_length() - 1) + x % SPAN).alias("end")))
    out = stored(packed.select("doc", "fp", unpacked.alias("spans")), "spans")
    for table_ in (members, distinct, results):
        drop_scratch(table_)
    return out


def union(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans."""
    out: list[list[int]] = []
    for s in spans or ():
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return [(a, b) for a, b in out]


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, runs = [], [], []
        for text, spans in zip(batch.column("text").cast(pa.binary()), batch.column("spans")):
            data, cuts = text.as_py() or b"", union(spans.as_py())
            at, parts = 0, []
            for a, b in cuts:
                parts.append(data[at:a])
                at = b
            parts.append(data[at:])
            kept.append(b"".join(parts))
            removed.append(sum(b - a for a, b in cuts))
            runs.append(len(cuts))
        size = np.array(list(map(len, kept)), "i8") + np.array(removed, "i8")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 200, n_buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary), one row per row of ``docs``.

    Every byte covered by a string of ``length`` bytes that starts at least at one more place
    goes, all copies of it; n_spans counts the maximal removed runs. Strings do not cross
    documents. Null texts are empty. Equal rows are copies of each other; null ids are
    documents like others; very long texts are taken in overlapping pieces. What is kept may
    cut a character. Extra columns are left out. No rows: no rows.
    """
    rows = keyed(docs)
    spans = repeated_spans(rows, length, n_buckets, hot)
    joined = rows.join(spans, ["doc", "fp"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut_batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
