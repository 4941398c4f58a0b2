"""Token ids as Parquet list columns.

Documents are range-partitioned by id, encoded in Arrow batches and written as one
file per range: ``ids`` is an INT32 list in delta encoding (format version 2), next to
``doc_id``, ``n_tokens`` and ``part`` columns, with row groups of a set size and the
page indexes that Parquet's writer adds. A reader of lengths alone touches no id page,
and page indexes on the sorted ``doc_id`` let one document be read without its row group.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter
from struct import Struct
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import scratch_path, table

#: Pieces that one worker remembers, twice over.
CACHE_WORDS = 400_000
#: The letter of a space, and full stops and commas, which take no part in words.
SPACE, STOPS = "\u0120", (",", ".")
#: How this kind of tokenizer cuts a text before its merges.
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The pre-tokenizer whose cuts are known here, as a tokenizer file states it.
KNOWN_CUTS = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Merging options of a model under which a word's ids don't depend on where it stands.
PLAIN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
ID = attrgetter("id")
#: Letters of a plain word, and so its ids, are fewer.
MOST = 24
LINES = re.compile(r"(\n+)").split
#: Characters that are cut or encoded at once, and where a longer text may be cut for that.
STRETCH, SAFE = 1 << 17, re.compile("(?<=[!-~]) (?=[!-~])").search
PLAIN = re.compile("[\n -~\xa1-\xac\xae-\u024f]+").fullmatch
#: Bytes of texts that are encoded together.
SLICE = 8 << 20
#: Kinds of bytes. Letters of two bytes are those whose first byte leads to hardly anything else
#: (Latin, Cyrillic); what is odd, apostrophes too, is left to the library.
NEWLINE, BLANK, LETTER, DIGIT, MARK, ODD = range(6)
KINDS = np.array([NEWLINE if b == 10 else BLANK if b == 32 else LETTER if chr(b).isalpha() and b < 128 or 0xC3 <= b <= 0xC9 or 0xD0 <= b <= 0xD1 else DIGIT if 48 <= b < 58 else MARK if 32 < b < 127 and b != 39 else ODD for b in range(256)], "u1")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def worker_store() -> dict[str, PieceEncoder]:
    """What this Python worker keeps between tasks. This package travels with each task,
    with globals of its own, so the store is a module of the worker."""
    return vars(sys.modules.setdefault("quire_worker_store", ModuleType("quire_worker_store"))).setdefault("encoders", {})


class Whole(Exception):
    """The text at hand must be encoded whole."""


class Pieces(dict):
    """Ids by piece, a word with what stands by it, the space before it left out. Two generations:
    a full one becomes the old one, and pieces that are still met move out of it."""

    def __init__(self, encoder: PieceEncoder, lead: str):
        self.encoder, self.merge, self.lead = encoder, encoder.merge, lead
        self.packs = [Struct(f"<{n}i").pack for n in range(MOST + 1)]
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            # Plain words and words before a stop, by far the most, without a further call.
            if piece.isalpha():
                if piece.isascii() and len(piece) < MOST:
                    found = [t.id for t in self.merge(self.lead + piece)]
                    ids = self.packs[len(found)](*found)
                else:
                    ids = self.encoder.new_piece(piece, self.lead)
            elif (stop := self.encoder.stops.get(piece[-1:])) and (word := piece[:-1]).isalpha():
                if word not in self:
                    return self[word] + stop  # of a word met for the first time, only the word is kept
                ids = self[word] + stop
            else:
                ids = self.encoder.new_piece(piece, self.lead)
        self[piece] = ids
        return ids

    def turn(self, most: int) -> None:
        if len(self) > most:
            self.old = dict(self)
            self.clear()


class Merges:
    """The merges of a byte-level model, for many words at once.

    Each word is a column of tokens, with an edge above and below. In every round each word makes
    its merge of the lowest rank, the leftmost of equals, as the library does word by word; only the
    pairs to the left and right of it change.
    """

    #: Bytes of a word, at most, words of one column table, and a rank beyond all.
    MOST, WIDTH, NONE = 28, 4096, 1 << 24

    def __init__(self, model: dict):
        vocab, edge = model["vocab"], max(model["vocab"].values()) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(merges)}
        self.letters, self.edge, self.size = np.array([vocab[c] for c in byte_letters()], "i4"), edge, edge + 1
        self.into = np.array([vocab[a + b] for a, b in merges], "i4")
        self.bits = max(18, len(ranks).bit_length() + 2)
        self.keys, self.ranks = np.full(1 << self.bits, -1, "i8"), np.full(1 << self.bits, self.NONE, "i4")
        keys, values = np.array([a * self.size + b for a, b in ranks], "i8"), np.array(list(ranks.values()), "i4")
        slots = self.slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            taken, at = np.unique(slots[free], return_index=True)
            self.keys[taken], self.ranks[taken] = keys[free][at], values[free][at]
            left = self.keys[slots] != keys
            keys, values, slots = keys[left], values[left], (slots[left] + 1) % len(self.keys)
        self.of_bytes = self.rank(np.repeat(self.letters, 256), np.tile(self.letters, 256)).reshape(256, 256)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view("i8")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of pairs of tokens."""
        keys = left.astype("i8") * self.size + right
        slots = self.slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.ranks[slots], self.NONE)
        more = np.flatnonzero((there != keys) & (there >= 0))
        while len(more):
            slots[more] = (slots[more] + 1) % len(self.keys)
            there = self.keys[slots[more]]
            hit = there == keys[more]
            out[more[hit]] = self.ranks[slots[more[hit]]]
            more = more[~hit & (there >= 0)]
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of words of ``data`` of at most ``MOST`` bytes: where the ids of each start, how many it has, and all ids."""
        at, many, ids, used = np.zeros(len(starts), "i8"), np.zeros(len(starts), "i8"), [], 0
        order = np.argsort(sizes, kind="stable")
        bounds = np.searchsorted(sizes[order], np.arange(self.MOST + 2))
        for n in range(1, self.MOST + 1):
            for k in range(bounds[n], bounds[n + 1], self.WIDTH):
                own = order[k : min(k + self.WIDTH, bounds[n + 1])]
                tokens = self.columns(data[starts[own] + np.arange(n)[:, None]]).T
                kept = tokens >= 0
                ids.append(tokens[kept])
                many[own] = kept.sum(1)
                at[own] = used + np.cumsum(many[own]) - many[own]
                used += len(ids[-1])
        return at, many, ids

    def columns(self, letters: np.ndarray) -> np.ndarray:
        """Tokens of words, a column each; -1 where a token went into the one before."""
        n, width = letters.shape
        tokens = np.full((n + 2, width), self.edge, "i4")
        tokens[1:-1] = self.letters[letters]
        rows = np.arange(n + 2, dtype="i4")[:, None]
        after, before = np.repeat(rows + 1, width, 1).ravel(), np.repeat(rows - 1, width, 1).ravel()
        ranks = np.full((n + 2, width), self.NONE, "i4")
        ranks[1:-2] = self.of_bytes[letters[:-1], letters[1:]]
        ranks = (ranks << 5) + rows  # the least of a column tells the place as well
        flat, flat_ranks = tokens.ravel(), ranks.ravel()
        while True:
            best = ranks.min(0)
            live = np.flatnonzero(best < self.NONE << 5)
            if not len(live):
                return tokens[1:-1]
            best = best[live]
            row = best & 31
            here = row * width + live
            gone = after[here] * width + live
            next_row, last_row = after[gone], before[here]
            right, left = next_row * width + live, last_row * width + live
            merged = self.into[best >> 5]
            flat[here], flat[gone], flat_ranks[gone] = merged, -1, self.NONE << 5
            after[here], before[right] = next_row, row
            found = self.rank(np.concatenate([flat[left], merged]), np.concatenate([merged, flat[right]]))
            flat_ranks[left] = (found[: len(live)] << 5) + last_row
            flat_ranks[here] = (found[len(live) :] << 5) + row


class PieceEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, word by word.

    The tokenizer cuts before a lone space between two visible characters, so the ids of a
    text are those of its pieces, each with its space, and in the same way around newlines
    between two visible characters. New pieces of Latin letters are cut
    into words here and merged by the tokenizer's model; other new pieces are encoded by
    the tokenizer. Texts with other white space next to a space are encoded whole, and so are
    texts with an added token, such as a special one, which the tokenizer finds before it cuts.

    That holds for files with the byte-level pre-tokenizer, no normalizer, no post-processor
    and plain merges. With any other file every text is encoded whole by the library.
    Many texts at once are cut by their bytes, and their plain words merged together by ``Merges``.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()  # whole texts, whatever the file says
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaceless = not any(" " in content for content in self.added)
        if not self.cuts_known(path):
            self.encode, self.encode_many = self.encode_whole, self.encode_each
            return
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"])
        self.merge = self.tokenizer.model.tokenize
        if resize := getattr(self.tokenizer.model, "_resize_cache", None):
            resize(0)  # words are remembered here
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.cache_words = cache_words
        self.stops = {c: self.merged(c) for c in STOPS}
        #: Pieces after a space and those at the start of a line.
        self.known, self.leading = Pieces(self, SPACE), Pieces(self, "")

    @classmethod
    def of_worker(cls, path: str) -> PieceEncoder:
        """The encoder that this Python worker keeps between tasks."""
        kept = worker_store()
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    @staticmethod
    def cuts_known(path: str) -> bool:
        """Whether the file's tokenizer cuts texts as this class does."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        return file.get("pre_tokenizer") == KNOWN_CUTS and model["vocab"].keys() >= set(byte_letters()) and not file.get("normalizer") and not file.get("post_processor") and all(model.get(k) == v for k, v in PLAIN_MODEL.items())

    def encode_whole(self, text: str) -> bytes:
        return self.whole(text) if text else b""

    def whole(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def in_stretches(self, text: str) -> bytes:
        """As ``whole``; a long text by stretches that the tokenizer cuts apart anyway."""
        out, at = [], 0
        while len(text) - at > STRETCH and self.spaceless and (cut := SAFE(text, at + STRETCH)):
            out.append(self.whole(text[at : cut.start()]))
            at = cut.start()
        return b"".join([*out, self.whole(text[at:])])

    def merged(self, letters: str) -> bytes:
        """Of one word in the vocabulary's letters."""
        return array("i", list(map(ID, self.merge(letters)))).tobytes()

    def spelled(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.letters)

    def new_piece(self, piece: str, lead: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Whole  # its white space could merge with the space before or after it
        if piece.isalpha() and PLAIN(piece):
            return self.merged(lead + self.spelled(piece))
        return self.cut((" " if lead else "") + piece)

    def cut(self, text: str) -> bytes:
        if not PLAIN(text):
            return self.whole(text)
        return b"".join([self.known[w[1:]] if w[0] == " " and w[1:].isalpha() else self.merged(self.spelled(w)) for w in CUT.findall(text)])

    def newlines(self, n: int, at_end: bool) -> bytes:
        """Of newlines between visible characters, where the last is cut off, or at the end."""
        letter = self.spelled("\n")
        return self.merged(letter * n) if at_end or n == 1 else self.merged(letter * (n - 1)) + self.merged(letter)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        for content in self.added:
            if content in text:
                return self.in_stretches(text)
        self.known.turn(self.cache_words)
        self.leading.turn(self.cache_words // 4)
        get, leading, out = self.known.__getitem__, self.leading, []
        lines = LINES(text)
        try:
            for k, line in enumerate(lines):
                if k % 2:
                    out.append(self.newlines(len(line), k == len(lines) - 2 and not lines[-1]))
                elif line or 0 < k < len(lines) - 1:
                    cut = line.find(" ")
                    out.append(leading[line if cut < 0 else line[:cut]])
                    while cut >= 0:  # a stretch of pieces at a time
                        at, cut = cut + 1, line.find(" ", cut + 1 + STRETCH)
                        out.append(b"".join(map(get, (line[at:] if cut < 0 else line[at:cut]).split(" "))))
            return b"".join(out)
        except Whole:
            return self.in_stretches(text)

    def encode_each(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_many``, text by text."""
        data = [self.encode(text or "") + end for text in texts.to_pylist()]
        return np.array([len(x) // 4 for x in data], "i8"), np.frombuffer(b"".join(data), "<i4")

    def word(self, word: str) -> bytes:
        """Of a word with odd bytes; nothing where its text must be encoded alone."""
        try:
            return self.known[word[1:]] if word[0] == " " else self.leading[word]
        except Whole:
            return b""

    def encode_many(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Of many texts, how many ids each has, ``end`` included, and all their ids.

        The bytes of all texts, with a newline before each, are cut into words where the tokenizer
        does. Each different word is encoded once, and the ids are gathered by its number. What
        stands between white space and holds odd bytes counts as one word.
        """
        if len(texts) < 2:
            return self.encode_each(texts, end)
        texts = pc.fill_null(texts, "").cast(pa.string())
        alone = pa.array(np.zeros(len(texts), bool))
        for content in self.added:
            alone = pc.or_(alone, pc.match_substring(texts, content))
        lines = pc.binary_join_element_wise("\n", pc.if_else(alone, "", texts), "")
        alone = alone.to_numpy(zero_copy_only=False).copy()
        bounds = np.frombuffer(lines.buffers()[1], "i4")[lines.offset : lines.offset + len(lines) + 1].astype("i8")
        data = np.frombuffer(lines.buffers()[2], "u1")[bounds[0] : bounds[-1]]
        bounds -= bounds[0]
        starts, odd = self.starts(data, bounds[:-1])
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype("i4")), pa.py_buffer(data)]).dictionary_encode()
        at, different = words.indices.to_numpy(), words.dictionary
        stops = np.frombuffer(different.buffers()[1], "i4")[different.offset : different.offset + len(different) + 1].astype("i8")
        sizes, strange = np.diff(stops), np.unique(at[odd])
        plain = sizes <= Merges.MOST
        plain[strange] = False
        start, many = np.zeros((2, len(different)), "i8")
        start[plain], many[plain], ids = self.merges.encode(np.frombuffer(different.buffers()[2], "u1"), stops[:-1][plain], sizes[plain])
        used = int(many.sum())
        plain[strange] = True
        self.known.turn(self.cache_words)
        self.leading.turn(self.cache_words // 4)
        rest = np.concatenate([strange, np.flatnonzero(~plain)])
        found = list(map(self.word, self.lines(different.take(strange)))) + [self.merged(self.spelled(different[k].as_py().decode())) for k in rest[len(strange) :].tolist()]
        many[rest] = np.fromiter(map(len, found), "i8", len(found)) // 4
        start[rest] = used + np.cumsum(many[rest]) - many[rest]
        ids.append(np.frombuffer(b"".join(found), "i4"))
        used += len(ids[-1])
        first = np.searchsorted(starts, bounds[:-1])
        stop = np.append(first[1:], len(starts))
        start, many, none = start[at], many[at], many == 0
        if none.any():
            alone[np.searchsorted(first, np.flatnonzero(none[at]), "right") - 1] = True
        many[first] = 0  # the newline before the text
        for k in np.flatnonzero(alone).tolist():
            ids.append(np.frombuffer(self.encode(texts[k].as_py()), "i4"))
            many[first[k] : stop[k]] = 0
            start[first[k]], many[first[k]] = used, len(ids[-1])
            used += len(ids[-1])
        if end:
            ids.append(np.frombuffer(end, "i4"))
            start, many = np.insert(start, stop, used), np.insert(many, stop, len(ids[-1]))
            first = first + np.arange(len(first))
        places = np.repeat((start + many - np.cumsum(many)).astype("i4"), many)
        places += np.arange(len(places), dtype="i4")
        return np.add.reduceat(many, first), np.concatenate(ids)[places]

    @staticmethod
    def lines(words: pa.Array) -> list[str]:
        """Words without newlines, far faster than ``to_pylist``."""
        return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), "\n")[0].as_py().split("\n") if len(words) else []

    @staticmethod
    def starts(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of texts, each after a newline, start, and the numbers of those with odd bytes."""
        kinds = KINDS[data]
        wide = np.flatnonzero(data >= 0x80)
        if len(wide):
            before = data[wide - 1]
            kinds[wide[(data[wide] < 0xC0) & (before >= 0xC0) & (KINDS[before] == LETTER)]] = LETTER
            times = wide[(before == 0xC3) & ((data[wide] == 0x97) | (data[wide] == 0xB7))]
            kinds[times], kinds[times - 1] = ODD, ODD
        white = kinds <= BLANK
        begins = kinds != np.roll(kinds, 1)
        begins[1:] &= kinds[:-1] != BLANK  # a space goes with the word after it
        if (double := white[1:] & white[:-1]).any():
            # Of white space in a row, the last before a word stands by itself or goes with it.
            rows = np.flatnonzero(double) + 1
            begins[rows] = ~np.append(white, True)[rows + 1]
        begins[texts] = True
        begins[texts[texts < len(data) - 1] + 1] = True
        odd = kinds == ODD
        if odd.any():
            edges = np.flatnonzero(white)
            number = np.flatnonzero(np.logical_or.reduceat(odd, edges))
            low, high = edges[number] + 2, np.append(edges, len(data))[number + 1]
            sizes = np.maximum(high - low, 0)
            begins[np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = False
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(np.logical_or.reduceat(odd, starts))


def encode_batches(tokenizer_path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = PieceEncoder.of_worker(tokenizer_path)
        end = b"" if end_id is None else np.array([end_id], "<i4").tobytes()
        for batch in batches:
            ids, docs = batch.column("doc_id"), batch.column("text")
            sizes = pc.fill_null(pc.binary_length(docs), 0).to_pylist()
            start = 0
            while start < len(docs):
                stop, used = start + 1, sizes[start]
                while stop < len(docs) and used + sizes[stop] <= SLICE:
                    used += sizes[stop]
                    stop += 1
                n = stop - start
                lengths, values = encoder.encode_many(docs.slice(start, n), end)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("i4")
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([ids.slice(start, n), pa.array(np.full(n, part, "i4")), pa.array(lengths), lists], ["doc_id", "part", "n_tokens", "ids"])
                start = stop

    return run


def write_token_lists(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int | None = 0,
    path: str | None = None,
    files: int | None = None,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    encoding: str = "delta",
    compression: str = "snappy",
) -> str:
    """Writes (doc_id, part, n_tokens, ids) in ascending doc_id order; returns the path.

    ``encoding`` is ``delta`` or ``dictionary``. Files follow each other by ``part``. Null ids
    come first; a null or empty text has the end id alone (or no ids). Rows that share an id
    follow each other in the order of their texts' hashes, so a run of them can span files.
    Very long texts are encoded one at a time. Any file of the tokenizers library will
    do. Extra columns are left out. No rows: an empty table is written.
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"encoding {encoding!r}: delta or dictionary")
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    repeated = not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    order = [F.col("doc_id"), F.xxhash64("text")] if repeated else [F.col("doc_id")]
    dealt = docs.select("doc_id", "text").repartitionByRange(files, *order).sortWithinPartitions(*order)
    out = dealt.mapInArrow(encode_batches(tokenizer_path, end_id), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, n_tokens long, ids array<int>")
    (
        out.write.option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("compression", compression)  # packed deltas hardly shrink further
        .parquet(path)
    )
    return path


def crc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(np.diff(offsets).astype("i8")), pa.array(crc, pa.int64())], ["doc_id", "part", "n_tokens", "ids_crc32"])


def with_starts(rows: DataFrame, lengths: DataFrame, *tie: str | Column) -> DataFrame:
    """Adds ``start``: the ids of all documents before, first by part, then within it.
    ``lengths`` is (part, n_tokens) of the same rows, which a reader of the files gets
    without touching a page of ids."""
    zero = F.lit(0).cast("long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    parts = lengths.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), zero).alias("part_start"))
    own = Window.partitionBy("part").orderBy(F.col("doc_id"), *tie).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), zero)).join(parts, "part").withColumn("start", F.col("part_start") + F.col("own"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = write_token_lists(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    files = spark.read.schema("doc_id long, part int, n_tokens long, ids array<int>").parquet(path)
    rows = files.select("doc_id", "part", "ids").mapInArrow(crc_batches, "doc_id long, part int, n_tokens long, ids_crc32 long")
    return with_starts(rows, files.select("part", "n_tokens"), "n_tokens", "ids_crc32").select("doc_id", "start", "n_tokens", "ids_crc32")
