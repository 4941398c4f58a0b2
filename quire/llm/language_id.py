"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's vector is the mean of the embeddings of its hashed byte 2-, 3- and 4-grams;
a linear softmax gives the languages. Both are trained together by stochastic gradient
descent in numpy on a bounded sample. Averaging is linear, so scoring needs one table of
class scores per bucket. Scores are calibrated by temperature on held-back rows of the
sample, and texts below the calibrated threshold are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import drop_scratch, stored, table

BUCKETS = 1 << 16
UND = "und"
#: ASCII letters in lower case; other ASCII bytes as blanks; the rest as it is.
FOLD = bytes((b | 0x20 if chr(b).isalpha() else b) if b < 128 and chr(b).isalpha() or b >= 128 else 0x20 for b in range(256))
LETTER = regex.compile(r"\p{L}")


def subwords(text: str) -> np.ndarray:
    """Bucket of every byte 2-, 3- and 4-gram of `` text`` between blanks."""
    b = np.frombuffer(b" " + text.encode("utf-8", "replace").translate(FOLD) + b"   ", np.uint8).astype("u4")
    two = b[:-3] | b[1:-2] << np.uint32(8)
    three = two | b[2:-1] << np.uint32(16)
    four = three | b[3:] << np.uint32(24)
    out = np.concatenate([two * np.uint32(0x9E3779B1), (three + np.uint32(1)) * np.uint32(0x85EBCA77), four * np.uint32(0xC2B2AE3D)])
    return ((out ^ out >> np.uint32(15)) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (buckets, languages): class scores of a bucket's embedding
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, ids = np.zeros(len(self.languages)), subwords(text)
        for a in range(0, len(ids), 1 << 20):
            total += self.table[ids[a : a + (1 << 20)]].sum(axis=0, dtype="f8")
        return total / len(ids) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not LETTER.search(text):
            return UND, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def snippet(text: str, rng: np.random.Generator) -> str:
    words = text.split()
    n = int(rng.integers(2, 30))
    at = int(rng.integers(0, max(1, len(words) - n)))
    return " ".join(words[at : at + n])


def train(rows: list[tuple[str, str]], dim: int = 16, epochs: int = 6, rate: float = 0.5, max_error: float = 0.01, max_rejected: float = 0.002, seed: int = 11) -> Model:
    """From (text, lang) rows. A fifth of them calibrates and is not trained on, drawn by the
    first words of the text, so that copies of a text, near ones too, are on one side."""
    rng = np.random.default_rng(seed)
    rows = [(t, lang) for t, lang in rows if t and lang is not None and LETTER.search(t)]
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), "f4"), np.zeros(0))
    index = {lang: k for k, lang in enumerate(languages)}
    fit, held = [], []
    for text, lang in rows:
        apart = crc32(" ".join(text.split(None, 5)[:5]).lower().encode()) % 5 == 4
        for part in (text, snippet(text, rng)):
            ids, counts = np.unique(subwords(part), return_counts=True)
            (held if apart and len(rows) >= 50 else fit).append((ids.astype("i4"), (counts / counts.sum()).astype("f4"), index[lang], part))
    held = held or fit
    fit = [x[:3] for x in fit]
    embed = rng.normal(0, 1 / dim, (BUCKETS, dim)).astype("f4")
    out, bias = np.zeros((dim, len(languages)), "f4"), np.zeros(len(languages), "f4")
    steps, step = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            ids, weights, y = fit[i]
            lr = np.float32(rate * (1 - step / steps))
            x = weights @ embed[ids]
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            # The mean spreads the gradient thinly over buckets; sums of counts undo that.
            embed[ids] -= (lr * 20) * np.outer(weights, out @ p)
            out -= lr * np.outer(x, p)
            bias -= lr * np.float32(0.1) * p
            step += 1
    model = Model(languages, embed @ out, bias.astype("f8"))
    z = np.stack([model.logits(part) for *_, part in held])
    y = np.array([k for _, _, k, _ in held])
    return calibrate(model, z, y, max_error, max_rejected)


def calibrate(model: Model, z: np.ndarray, y: np.ndarray, max_error: float, max_rejected: float) -> Model:
    """The temperature of least log loss; the lowest threshold above which the share of
    errors is at most ``max_error``, but never one that rejects more than ``max_rejected``
    of the right answers."""

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(probabilities(t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = probabilities(model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score)
    errors = np.cumsum(~right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(errors <= max_error)
    limit = float(np.quantile(score[right], max_rejected)) if right.any() else 1.0
    model.threshold = min(limit, float(score[order][good[-1]]) if len(good) else 1.0)
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def training_rows(docs: DataFrame, per_language: int = 1000, max_bytes: int = 20_000, max_rows: int = 20_000, max_languages: int = 1000) -> list[tuple[str, str]]:
    """About ``per_language`` rows of each language, fewer where there are so many languages
    that this would exceed ``max_rows`` in all, drawn by a hash of the id; of more than
    ``max_languages`` languages, those of most rows. Only rows outside the held-out fold, with
    an id, a language and a text of at most ``max_bytes`` are drawn. So the driver holds
    at most ``max_rows * max_bytes``, whatever the table is like."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 2) & (F.octet_length("text") <= max_bytes)).select("text", "lang", F.xxhash64(F.lit(11), "doc_id").alias("h"))
    counts = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages), "languages")
    n_languages = counts.count()
    if not n_languages:
        return []
    each = max(1, min(per_language, max_rows // n_languages))
    # Shares of the range of h; in doubles, so that no product overflows.
    cut = F.when(F.col("n") <= each, F.lit((1 << 63) - 1)).otherwise((F.lit(2.0**64) * each / F.col("n") - F.lit(2.0**63)).cast("long"))
    drawn = rows.join(counts.select("lang", cut.alias("cut")), "lang").where("h <= cut")
    sample = drawn.orderBy("h", "text").limit(min(max_rows, 2 * each * n_languages)).select("text", "lang").collect()
    drop_scratch(counts)
    return [(r["text"], r["lang"]) for r in sample]


def predict_batches(model, within: bool):
    """Adds the prediction to ``rec``; the text is a field of it (``within``) or a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            rec = batch.column("rec")
            got = [m.predict(t.as_py()) for t in (rec.field("text") if within else batch.column("text"))]
            score = np.array([s for _, s in got], "f8")
            accepted = np.array([lang != UND for lang, _ in got], bool) & (score >= m.threshold)
            yield pa.RecordBatch.from_arrays([rec, pa.array([lang for lang, _ in got], pa.string()), pa.array(score), pa.array(accepted)], ["rec", "lang_pred", "score", "accepted"])

    return run


def identify(docs: DataFrame, **sample) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted), one row per row of ``docs``.

    A null text, or one without letters, is ``und`` with score 0, and never accepted; so is
    every text if no labelled rows exist. Null ids are not held out and never trained on.
    Very long texts are read whole; repeated rows are predicted alike, and each of them may be
    drawn for training. Of equal probabilities the language that sorts first is predicted.
    Extra columns are left out. No rows: no rows.
    """
    held_out = F.coalesce(fold(F.col("rec.doc_id")) == 2, F.lit(False)).alias("held_out")
    return with_language(docs, ["doc_id"], **sample).select("rec.doc_id", held_out, "lang_pred", "score", "accepted")


def with_language(docs: DataFrame, keep: list[str], **sample) -> DataFrame:
    """``rec``, a struct of the columns to keep, with lang_pred, score and accepted."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(training_rows(docs, **sample)))  # BUCKETS x languages
    within = "text" in keep
    read = docs.select(F.struct(*keep).alias("rec"), *([] if within else ["text"]))
    return read.mapInArrow(predict_batches(model, within), f"rec {read.schema['rec'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
