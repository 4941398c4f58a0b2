"""Line dedup across documents by range-partitioned hashes.

Lines become 128-bit hashes of their keys with document and position. The hashes are
range-partitioned with a secondary sort by document and position, and each partition is
streamed: a run of equal hashes tells how many documents hold the line and which of them
keeps it. What comes back are compressed keep bitmaps per document, not text.

A key of more than ``hot`` lines never enters a run. Such keys are at most (lines / hot),
so their statistics (made with map-side sums) are joined to the lines instead.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import partitions, stored, table, text_fp

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
STRIP = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
#: Lines of a range, which one task streams.
RANGE_LINES = 4_000_000
LINES = "doc_id long, fp long, h1 long, h2 long, pos int"
DROPS = "doc_id long, fp long, pos int"


def line_keys(text: str | None, min_chars: int) -> list[tuple[int, bytes]]:
    """(position, key) of the lines long enough to be compared."""
    out = []
    if text and len(text) >= min_chars:
        for pos, line in enumerate(text.encode("utf-8", "surrogatepass").translate(LOWER).split(b"\n")):
            if len(line) >= min_chars:
                key = line.strip(STRIP)
                if len(key) >= min_chars and (key.isascii() or len(key.translate(None, CONTINUATION)) >= min_chars):
                    out.append((pos, key))
    return out


def hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, pos, keys = [], [], []
            for i, text in enumerate(batch.column("text")):
                found = line_keys(text.as_py(), min_chars)
                docs += [i] * len(found)
                pos += [p for p, _ in found]
                keys += [xxhash.xxh3_128_digest(k) for _, k in found]
                if len(docs) >= 200_000:
                    yield lines_batch(batch, docs, pos, keys)
                    docs, pos, keys = [], [], []
            yield lines_batch(batch, docs, pos, keys)

    return run


def lines_batch(batch: pa.RecordBatch, docs: list, pos: list, keys: list) -> pa.RecordBatch:
    h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    at = pa.array(docs, pa.int32())
    columns = [batch.column("doc_id").take(at), batch.column("fp").take(at), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(pos, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "h1", "h2", "pos"])


def stream_runs(min_docs: int):
    """Over lines sorted by (h1, h2, doc_id, fp, pos): the lines that go. The last run of
    a batch waits for the next batch; a run has at most ``hot`` lines."""

    def decide(a: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(a["h1"])
        new = np.ones(n, bool)
        new[1:] = (a["h1"][1:] != a["h1"][:-1]) | (a["h2"][1:] != a["h2"][:-1])
        doc = new.copy()
        doc[1:] |= a["doc_id"][1:] != a["doc_id"][:-1]
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        n_docs = np.add.reduceat(doc.astype("i8"), starts) if n else np.zeros(0, "i8")
        last = a["doc_id"][np.append(starts[1:], n) - 1] if n else a["doc_id"]
        out = (n_docs[run] >= min_docs) & (a["doc_id"] != last[run]) if n else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(a[c][out]) for c in ("doc_id", "fp", "pos")], ["doc_id", "fp", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[dict[str, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            a = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            same = (a["h1"] == a["h1"][-1]) & (a["h2"] == a["h2"][-1])
            cut = int(np.argmax(same))  # the last run starts here
            if cut == 0 and carry and carry[-1]["h1"][-1] == a["h1"][0] and carry[-1]["h2"][-1] == a["h2"][0]:
                carry.append(a)
                continue
            yield decide({c: np.concatenate([*(x[c] for x in carry), a[c][:cut]]) for c in a})
            carry = [{c: v[cut:] for c, v in a.items()}]
        if carry:
            yield decide({c: np.concatenate([x[c] for x in carry]) for c in carry[0]})

    return run


def pack_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for drops in batch.column("drops"):
            at = np.array(drops.as_py(), "i8")
            bits = np.ones(at.max() + 1, np.uint8)
            bits[at] = 0
            out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes() + len(bits).to_bytes(8, "little"), 6))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fp"), pa.array(out, pa.binary())], ["doc_id", "fp", "keep"])


def unpack_bitmap(keep: bytes) -> np.ndarray:
    """True where a line stays. Lines beyond the bitmap's end stay too."""
    raw = zlib.decompress(keep)
    return np.unpackbits(np.frombuffer(raw[:-8], np.uint8), bitorder="little")[: int.from_bytes(raw[-8:], "little")].astype(bool)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, hot: int | None = None) -> DataFrame:
    """(doc_id, fp, keep): compressed keep bitmaps of the documents that lose lines.

    A key of at least ``min_chars`` code points found under at least ``min_docs`` different
    ids loses its lines but in the largest id. ``fp`` tells rows of one id with different
    texts apart; they count as one document. Rows with a null id lose nothing and are not
    counted. Null, empty and very long texts are texts like others. Extra columns are unread.
    """
    spark = docs.sparkSession
    keyed = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_fp(F.col("text")).alias("fp"), "text")
    lines = stored(keyed.mapInArrow(hash_lines(min_chars), LINES), "lines")
    total = lines.count()
    hot = hot or min(1_000_000, max(1000, total // 1000))
    # Cells of hash prefixes, so many that one holds a sixteenth of ``hot`` lines on average.
    cell = F.shiftrightunsigned("h1", 64 - min(40, max(4, (16 * total // hot).bit_length())))
    # Sums of cells come before those of keys: a key of more than ``hot`` lines makes its cell so.
    cells = stored(lines.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("cell"), "cells")
    cold, parts = lines, []
    if not cells.isEmpty():
        within = lines.join(cells, cell == F.col("cell"), "left_semi")
        # Both are small tables as a rule; Spark broadcasts them only if their files are.
        keys = stored(within.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("h1", "h2"), "hotkeys")
        stats = stored(
            within.join(keys, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last")),
            "hotlines",
        )
        cold = lines.join(stats, ["h1", "h2"], "left_anti")
        parts.append(lines.join(stats, ["h1", "h2"]).where((F.col("n_docs") >= min_docs) & (F.col("doc_id") != F.col("last"))).select("doc_id", "fp", "pos"))
    dealt = cold.repartitionByRange(max(partitions(spark), total // RANGE_LINES), "h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "fp", "pos")
    drops = dealt.mapInArrow(stream_runs(min_docs), DROPS)
    for part in parts:
        drops = drops.unionByName(part)
    return drops.groupBy("doc_id", "fp").agg(F.collect_set("pos").alias("drops")).mapInArrow(pack_bitmaps, "doc_id long, fp long, keep binary")


def apply_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n_lines, n_dropped and kept_text to batches of documents with ``keep``."""
    for batch in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, keep in zip(batch.column("text"), batch.column("keep")):
            lines = (text.as_py() or "").split("\n")
            bits = keep.as_py()
            stay = lines
            if bits is not None:
                flags = unpack_bitmap(bits)
                stay = [x for x, k in zip(lines, flags) if k] + lines[len(flags) :]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            kept.append("\n".join(stay))
        names = [n for n in batch.schema.names if n not in ("text", "keep")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], [*names, "n_lines", "n_dropped", "kept_text"])


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text), one row per row of ``docs``, equal rows alike.

    As in :func:`keep_bitmaps`; a null text has one empty line. No rows: no rows.
    """
    bitmaps = keep_bitmaps(docs, **options)
    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_fp(F.col("text")).alias("fp"), "text")
    joined = left.join(bitmaps, ["doc_id", "fp"], "left").select("doc_id", "text", "keep")
    return joined.mapInArrow(apply_bitmaps, "doc_id long, n_lines long, n_dropped long, kept_text string")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), lines AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split
), stats AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id <> s.last, false) AS gone FROM lines l LEFT JOIN stats s ON l.key = s.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
