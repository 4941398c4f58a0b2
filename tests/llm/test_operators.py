"""The training-data operators against brute force, on small awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.oracle import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n, rng):
    return " ".join("".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    base = [words(rng.randint(5, 90), rng) for _ in range(24)]
    shared = words(60, rng)
    line = "Shared LINE that is certainly long enough to be compared here"
    out = []
    for i, t in enumerate(base):
        text = t
        if i % 3 == 0:
            text += "\n  " + line + "\t\n" + words(4, rng)
        if i % 4 == 1:
            text += " " + shared + " " + words(3, rng)
        out.append((i * 7, text, ["en", "de", None][i % 3], ["s1", None, "s2"][i % 3], len(text)))
    long_ = words(6000, rng)
    out += [
        (1000, None, None, None, None), (1001, "", "en", "s1", 0), (1002, " \n\t\n", "en", "s1", 4),
        (1003, long_, "de", "s2", len(long_)), (1004, long_[:20000] + "x" + long_[20000:], "de", "s2", 1),
        (1005, base[2], "en", "s1", 1), (1006, base[2], "en", "s1", 1), (1005, base[2], "en", "s1", 1), (1005, base[3], "en", "s1", 1),
        (None, base[4], "en", "s1", 1), (None, base[4], None, None, 1), (None, None, None, None, None),
        (1010, "ab" * 4000, "en", "s1", 8000), (1011, "#*$% " * 60, "en", "s2", 300), (1012, "one two", "fr", "s2", 7), (1013, "日本語 " * 30, "ja", "s1", 120),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    extras = "fp doc key keys h1 h2 pos at g c1 c2 bucket rec recs first shard slot part ids n n_tokens stratum kept w cell place leaf t1 t2 _t1 _least _stays _key lang_pred score accepted drops keep spans".split()
    return df.withColumns({x: F.lit(f"clash {x}") for x in extras})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(got, want):
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))


# 1


def brute_lines(rows, min_docs=5):
    keys = {}
    for i, (d, t, *_) in enumerate(rows):
        if d is not None:
            for line in (t or "").split("\n"):
                k = line.strip(" \t\n\x0b\x0c\r").translate(AZ)
                if len(k) >= 40:
                    keys.setdefault(k, set()).add(d)
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            k = line.strip(" \t\n\x0b\x0c\r").translate(AZ)
            if d is None or len(k) < 40 or len(keys[k]) < min_docs or max(keys[k]) == d:
                kept.append(line)
        yield d, len(lines), len(lines) - len(kept), "\n".join(kept)


@pytest.mark.parametrize("hot", [None, 3])
def test_line_dedup(docs, rows, hot):
    from quire.llm.line_dedup import dedup_lines

    multiset(dedup_lines(docs, hot=hot).collect(), brute_lines(rows))


def test_keep_bitmap_round_trip():
    from quire.llm.line_dedup import pack_bitmaps, unpack_bitmap
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([[0, 9, 3]])], ["doc_id", "fp", "drops"])
    keep = next(pack_bitmaps(iter([batch]))).column("keep")[0].as_py()
    assert np.flatnonzero(~unpack_bitmap(keep)).tolist() == [0, 3, 9]


def test_line_runs_over_batches():
    from quire.llm.line_dedup import stream_runs
    import pyarrow as pa

    def batch(h, d):
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array([0] * len(d)), pa.array(h), pa.array([0] * len(d)), pa.array([0] * len(d), pa.int32())], ["doc_id", "fp", "h1", "h2", "pos"])

    out = [x for b in stream_runs(3)(iter([batch([1, 2], [5, 1]), batch([2, 2], [2, 3]), batch([2, 3], [4, 1])])) for x in b.column("doc_id").to_pylist()]
    assert out == [1, 2, 3]


# 2


def test_language_id_learns_and_rejects(spark, docs, rows):
    from quire.llm.language_id import identify

    out = identify(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert all(r["lang_pred"] == "und" and not r["accepted"] for r in out if r["doc_id"] in (1000, 1001, 1002, 1011))


def test_language_id_held_out_accuracy(spark):
    from quire.llm.language_id import op2_language_id

    rows = op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert rows.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_id_without_labels(spark, empty):
    from quire.llm.language_id import identify

    assert identify(empty).count() == 0
    one = identify(spark.createDataFrame([(1, "text", None, None, 4)], SCHEMA)).first()
    assert (one["lang_pred"], one["accepted"]) == ("und", False)


# 3


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for (d, *_), t in zip(rows, texts):
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = True
        runs = int(np.sum(covered & ~np.concatenate([[False], covered[:-1]]))) if len(t) else 0
        yield d, len(t), int(covered.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~covered])).hexdigest()


@pytest.mark.parametrize("hot, n_buckets", [(20_000, None), (20_000, 1), (0, 60)])
def test_suffix_dedup(docs, rows, empty, hot, n_buckets):
    from quire.llm.suffix_dedup import remove_repeats

    out = remove_repeats(docs, n_buckets=n_buckets, hot=hot).withColumn("kept", F.sha2("kept", 256))
    multiset(out.collect(), brute_repeats(rows, 200))
    assert remove_repeats(empty, n_buckets=n_buckets, hot=hot).count() == 0


@pytest.mark.parametrize("hot, n_buckets", [(20_000, 1), (20_000, 400), (20, 3)])
def test_suffix_dedup_of_a_frequent_passage(spark, hot, n_buckets):
    """One passage, or the start or the end of it, between other bytes: buckets are
    small, and frequent grams are compared across them."""
    from quire.llm.suffix_dedup import remove_repeats

    rng = random.Random(14)
    passage = words(60, rng)
    rows = []
    for i in range(120):
        a, b = rng.choice([(0, len(passage)), (0, 230), (len(passage) - 215, len(passage)), (40, 200), (40, 245)])
        rows.append((i, words(rng.randint(0, 30), rng)[: rng.randint(0, 150)] + passage[a:b] + words(rng.randint(1, 9), rng), None, None, 0))
    out = remove_repeats(spark.createDataFrame(rows, SCHEMA), n_buckets=n_buckets, hot=hot).withColumn("kept", F.sha2("kept", 256))
    multiset(out.collect(), brute_repeats(rows, 200))


def test_suffix_query_by_brute_force(spark):
    from quire.llm.registry import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    multiset(queries()["op3_suffix_dedup"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), brute_repeats(rows, 200))


def test_multikey_sort_groups_equal_rows():
    from quire.llm.suffix_dedup import multikey_sort

    w = np.random.default_rng(1).integers(0, 3, (500, 4)).astype(">u8")
    order, group = multikey_sort(w)
    listed = [tuple(x) for x in w[order].tolist()]
    assert listed == sorted(listed)
    assert all((a == b) == (g == h) for a, b, g, h in zip(listed, listed[1:], group, group[1:]))


# 4


@pytest.fixture(scope="module")
def benchmark(spark):
    rng = random.Random(2)
    items = [(i, words(rng.randint(8, 40), rng)) for i in range(30)]
    return items, spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short"), (0, items[0][1])], "item_id long, text string")


def brute_leaks(docs, items, window=13):
    for row, (d, text) in enumerate(docs):
        w = re.findall(r"\w+", (text or "").lower())
        for item, t in items:
            b = re.findall(r"\w+", t.lower())
            n = min(window, len(b))
            need = -(-n * 4 // 5)
            if any(sum(x == y for x, y in zip(w[i : i + n], b[j : j + n])) >= need for i in range(len(w) - n + 1) for j in range(len(b) - n + 1)):
                yield row, d, item


@pytest.mark.parametrize("block_bytes", [1 << 24, 500])
def test_decontamination(spark, benchmark, block_bytes):
    from quire.llm.decontaminate import contaminated, without_contaminated

    items, table = benchmark
    rng = random.Random(3)
    rows = [(i, words(rng.randint(1, 60), rng)) for i in range(20)]
    for i, (_, t) in enumerate(items):
        b = t.split()
        for k in range(4):  # up to two substituted words in every 13
            changed = list(b)
            for j in range(k % 3):
                changed[(i + 6 * j + j) % len(b)] = "other"
            rows.append((100 + 10 * i + k, words(5, rng) + " " + " ".join(changed).replace("a", "A") + ". " + words(5, rng)))
    rows += [(None, items[3][1]), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    want = list(brute_leaks(rows, items))
    assert len(want) > 80
    multiset([(r["doc_id"], r["item_id"]) for r in contaminated(docs, table, block_bytes=block_bytes).collect()], [(d, i) for _, d, i in want])
    bad = {row for row, *_ in want}
    multiset([(r["doc_id"],) for r in without_contaminated(docs, table, block_bytes=block_bytes).collect()], [(d,) for k, (d, _) in enumerate(rows) if k not in bad])


def test_decontamination_by_items_of_few_words(spark):
    from quire.llm.decontaminate import contaminated, without_contaminated

    items = [(0, "Alpha beta gamma"), (1, "beta"), (2, "one two three four five six seven"), (3, "東京は日本の首都です"), (4, "5月の花"), (5, "..."), (6, "beta"), (7, "one two three four five six seven eight nine")]
    rows = [
        (0, "say alpha, BETA gamma!"), (1, "alpha beta delta gamma"), (2, "alphabeta gammas"), (3, "x one two three four five six seven y"), (4, "one two three four five other seven"),
        (5, "昔から東京は日本の首都です。はい"), (6, "東京は日本"), (7, "15月の花"), (8, "この5月の花が"), (9, None), (10, "..."), (11, "one two three four five six seven eight nine"),
    ]
    want = [(0, 0), (0, 1), (0, 6), (1, 1), (1, 6), (3, 2), (5, 3), (8, 4), (11, 2), (11, 7)]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (1 << 24, 30):
        found = contaminated(docs, table, block_bytes=block_bytes).collect()
        multiset([(r["doc_id"], r["item_id"]) for r in found], want)
        kept = without_contaminated(docs, table, block_bytes=block_bytes).collect()
        assert {r["doc_id"] for r in kept} == {d for d, _ in rows} - {d for d, _ in want}
    assert [tuple(r)[2:] for r in found if r["item_id"] == 0] == [(1, 3, 3)]


def test_decontamination_of_texts_that_repeat_themselves(spark):
    import time

    from quire.llm.decontaminate import Index, contaminated, scan

    began = time.process_time()
    item, doc = "spam " * 100_000, "other words first " + "spam " * 100_000
    assert [x[:3] for x in scan(Index([(1, item)]), [doc, "spam " * 12, "spam ham " * 500])] == [(0, 0, 3)]
    rng = random.Random(1)
    two = [" ".join(rng.choice("ab") for _ in range(n)) for n in (3000, 20_000, 30, 12)]
    items = [(0, two[0]), (1, " ".join("abc"[i % 3] for i in range(2000)))]
    texts = [two[1], two[2], two[3], "a b c " * 3000, "b a " * 3000, None, ""]
    rows = list(enumerate(texts))
    assert time.process_time() - began < 60
    small = [(d, t and " ".join(t.split()[:200])) for d, t in rows]
    few = [(i, " ".join(t.split()[:150])) for i, t in items]
    docs = spark.createDataFrame([(f"d{d}", t) for d, t in small], "doc_id string, text string")
    found = contaminated(docs, spark.createDataFrame([(f"i{i}", t) for i, t in few], "item_id string, text string"))
    multiset([(r["doc_id"], r["item_id"]) for r in found.collect()], [(f"d{d}", f"i{i}") for _, d, i in brute_leaks(small, few)])
    found = {(d, i): (at, agree) for d, i, at, n, agree in scan(Index(items), texts)}
    assert found[0, 0][1] == 13 and found[3, 1] == (0, 13)
    assert time.process_time() - began < 120


def test_decontamination_reports_the_first_best_window():
    from quire.llm.decontaminate import Index, scan

    rng = random.Random(21)
    item = words(15, rng).split()
    part = list(item[:13])
    part[6] = "changed"
    text = [*words(3, rng).split(), *part, *words(4, rng).split(), *item, *words(2, rng).split(), *item]
    assert list(scan(Index([("x", " ".join(item))]), [" ".join(text)])) == [(0, 0, 20, 13, 13)]


def test_masks_fit_beside_any_substitutions():
    from itertools import combinations

    from quire.llm.decontaminate import MASKS

    for w in range(8, 14):
        for out in combinations(range(w), w - -(-w * 4 // 5)):
            assert any(all(i + j not in out for j, c in enumerate(m) if c == "1") for m in MASKS for i in range(w - len(m) + 1)), (w, out)


# 5


def test_chat_format_of_typed_parts(spark):
    from quire.llm.chat import format_conversations, loss_text, parse_turns

    rows = [
        (1, 0, "user", [("text", "see <image 0> & </turn>", None, None), ("image", None, "a.png", 3), ("audio", None, "b.wav", 2)]),
        (1, 1, "assistant", [("text", "fine", None, None), ("document", None, "c.pdf", None), ("odd", None, None, 5)]),
        (2, None, None, None),
        (2, None, "x>y", [("text", None, None, None)]),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, content array<struct<type:string,text:string,ref:string,units:long>>").withColumns({"formatted": F.lit(1), "turns": F.lit(2), "t": F.lit(3)})
    out = {r["conv_id"]: r for r in format_conversations(df).withColumn("turns", parse_turns(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert out[1]["formatted"] == "<turn user>\nsee &lt;image 0> &amp; &lt;/turn><image 0><audio 1></turn>\n<turn assistant>\nfine<document 2><odd 3></turn>\n"
    assert [(a["number"], a["type"], a["ref"], a["tokens"], a["turn"]) for a in out[1]["attachments"]] == [(0, "image", "a.png", 770, 0), (1, "audio", "b.wav", 52, 0), (2, "document", "c.pdf", 602, 1), (3, "odd", None, 0, 1)]
    assert out[1]["media_tokens"] == 770 + 52 + 602 and out[1]["loss"] == "fine<document 2><odd 3>"
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("", ""), ("x>y", "")]


def test_chat_query(spark, duck):
    from quire.llm.chat import OP5_SQL, op5_chat_format

    same(op5_chat_format(spark, SF), duck, OP5_SQL)


def test_chat_of_nothing(spark):
    from quire.llm.chat import format_conversations

    assert format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 6


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_lists(spark, docs, rows, tmp_path, encoding):
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    from quire.llm.token_output import write_token_lists

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    out = write_token_lists(docs, path, path=str(tmp_path / "t"), files=3, encoding=encoding)
    back = spark.read.parquet(out).collect()
    multiset([(r["doc_id"], tuple(r["ids"])) for r in back], [(d, (*t.encode(x or "", add_special_tokens=False).ids, 0)) for d, x, *_ in rows])
    assert all(r["n_tokens"] == len(r["ids"]) for r in back)
    ordered = [r["doc_id"] for r in sorted(back, key=lambda r: (r["part"], -1 if r["doc_id"] is None else r["doc_id"]))]
    assert ordered == sorted(ordered, key=lambda d: -1 if d is None else d)
    column = pq.ParquetFile(next((tmp_path / "t").glob("*.parquet"))).metadata.row_group(0).column(3)
    assert any(("DELTA" if encoding == "delta" else "DICTIONARY") in e for e in column.encodings) and column.has_offset_index


@pytest.mark.parametrize("text", ["", "  a", "a  b", "it's \n x", "\t tab", "日本 語", "l'été 12 34a", "<|endoftext|> a", "a\xa0b", "x\x1cy", "²³ ½x", "end ", "a\n b\n\nc d\r\ne", "a, b. c.. d", ", . a"])
def test_piece_encoder(text):
    import public_tokenizers

    from quire.llm.token_output import PieceEncoder

    e = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), cache_words=2)
    for x in (text, text + " " + text, text):
        assert e.encode(x) == e.whole(x)


@pytest.mark.parametrize("text", ["<|endoftext|> a", "a<|endoftext|>b", "a <|endoftext|>", "<|endoftext|>", "<|endoftext|><|endoftext|>\n c", "a <|endoftext| > b", "plain words"])
def test_piece_encoder_finds_added_tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quire.llm.token_output import PieceEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert list(memoryview(PieceEncoder(path).encode(text)).cast("i")) == ids
    assert (50256 in ids) == ("<|endoftext|>" in text)


def test_long_texts_by_stretches(monkeypatch):
    import public_tokenizers

    import quire.llm.token_output as m

    monkeypatch.setattr(m, "STRETCH", 7)
    e = m.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), cache_words=30)
    rng = random.Random(17)
    bits = ["a", "word", "The", ".", ",", " ", " ", "  ", "\n", "\n\n", "\t", "é", "日本", "12", "'s", "(", "\r\n", "\xa0", "<|endoftext|>", "..."]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))
        assert e.encode(text) == e.whole(text), text


def test_texts_encoded_together():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    import quire.llm.token_output as m

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, e, end = Tokenizer.from_file(path), m.PieceEncoder(path, cache_words=30), np.array([0], "<i4").tobytes()
    rng = random.Random(18)
    bits = ["a", "word", "The", ".", ",", " ", " ", " ", " ", "  ", "\n", "\n\n", "\n", "\t", "é", "É", "×", "÷", "ɐ", "ʰ", "¿", "日本", "ªº", "12", "½", "'s", "'", "’", "(", "\r\n", "\xa0", "\x85", "\x1c", "\x7f", "\u3000", "😀", "<|endoftext|>", "...", " " * 40, "x" * 30, "é" * 20, "7" * 33, "-" * 29]
    for k in range(800):
        some = bits if k % 2 else rng.sample(bits, 6)
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(some) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(3, 40))]
        want = [[*plain.encode(x or "", add_special_tokens=False).ids, 0] for x in texts[2:]]
        lengths, ids = e.encode_many(pa.array(texts, pa.string()).slice(2), end)
        assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x], texts


def test_letters_of_two_bytes():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    import quire.llm.token_output as m

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, e = Tokenizer.from_file(path), m.PieceEncoder(path)
    texts = [f"a{c}b 1{c}2 .{c}. {c}\n{c}" for c in map(chr, range(0x80, 0x800))]
    lengths, ids = e.encode_many(pa.array(texts))
    at = 0
    for text, n in zip(texts, lengths):
        assert ids[at : at + n].tolist() == plain.encode(text, add_special_tokens=False).ids, text
        at += n


def test_words_merged_together(monkeypatch):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    import quire.llm.token_output as m

    monkeypatch.setattr(m.Merges, "WIDTH", 7)
    path = public_tokenizers.path("byte_bpe_50k.json")
    merges, model, letters = m.Merges(json.load(open(path))["model"]), Tokenizer.from_file(path).model, m.byte_letters()
    rng = random.Random(19)
    words = [bytes(rng.choice(b" aeionrstth\n\xc3\xa9") if rng.random() < 0.95 else rng.randrange(256) for _ in range(rng.randint(1, 28))) for _ in range(3000)]
    sizes = np.array([len(w) for w in words])
    at, many, ids = merges.encode(np.frombuffer(b"".join(words), "u1"), np.cumsum(sizes) - sizes, sizes)
    ids = np.concatenate(ids)
    for w, a, n in zip(words, at, many):
        assert ids[a : a + n].tolist() == [t.id for t in model.tokenize("".join(letters[b] for b in w))], w


def test_different_words_are_encoded_once():
    import public_tokenizers
    import pyarrow as pa

    import quire.llm.token_output as m

    e, asked = m.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json")), []
    encode = e.merges.encode
    e.merges.encode = lambda data, starts, sizes: asked.extend(data[a : a + n].tobytes() for a, n in zip(starts, sizes)) or encode(data, starts, sizes)
    texts = ["a word and, a word", "word and word\nword and"]
    lengths, ids = e.encode_many(pa.array(texts * 50))
    assert ids.tobytes() == b"".join(map(e.whole, texts)) * 50 and lengths.tolist() == [6, 6] * 50
    assert sorted(asked) == [b"\n", b" a", b" and", b" word", b",", b"a", b"word"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "truncated"])
def test_other_tokenizers_encode_whole(name, tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    from quire.llm.token_output import PieceEncoder

    path = public_tokenizers.path("byte_bpe_50k.json" if name == "truncated" else name)
    plain = Tokenizer.from_file(path)
    if name == "truncated":  # and with a space before each text
        file = json.load(open(path))
        file["pre_tokenizer"]["add_prefix_space"] = True
        file["truncation"] = {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}
        path = str(tmp_path / "t.json")
        json.dump(file, open(path, "w"))
        plain = Tokenizer.from_file(path)
        plain.no_truncation()
    for text in ("", "It's  a Test", "x <|endoftext|> y", "naïve CAFÉ 12 345", " a\n b"):
        assert list(memoryview(PieceEncoder(path).encode(text)).cast("i")) == plain.encode(text, add_special_tokens=False).ids


def test_token_query_against_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quire.llm.registry import queries

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()):
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    multiset(queries()["op6_token_ids"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect(), want)


def test_token_starts_span_parts(spark, docs, rows, tmp_path):
    import public_tokenizers

    from quire.llm.token_output import crc_batches, with_starts, write_token_lists

    schema = "doc_id long, part int, n_tokens long, ids array<int>"
    files = spark.read.schema(schema).parquet(write_token_lists(docs, public_tokenizers.path("byte_bpe_50k.json"), path=str(tmp_path / "t"), files=4))
    read = files.select("doc_id", "part", "ids").mapInArrow(crc_batches, "doc_id long, part int, n_tokens long, ids_crc32 long")
    out = sorted(with_starts(read, files.select("part", "n_tokens"), "n_tokens", "ids_crc32").collect(), key=lambda r: r["start"])
    assert len({r["part"] for r in out}) > 1 and len(out) == len(rows) and out[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:]))


# 7


def test_shards(spark, docs, rows, empty):
    from quire.llm.sharding import shuffle_into_shards

    out = shuffle_into_shards(docs, 7, bucket_bytes=20_000)
    got = out.collect()
    multiset([(r["doc_id"], r["text"], r["source"]) for r in got], [(d, t, s) for d, t, _, s, _ in rows])
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = shuffle_into_shards(docs, 7, bucket_bytes=20_000).collect()
    multiset([(r["doc_id"], r["shard"]) for r in got if r["doc_id"] not in (None, 1005)], [(r["doc_id"], r["shard"]) for r in again if r["doc_id"] not in (None, 1005)])
    assert shuffle_into_shards(empty, 7).count() == 0
    assert shuffle_into_shards(docs.limit(3), 7).count() == 3


def test_shards_of_one_row_repeated(spark):
    from quire.llm.sharding import shuffle_into_shards

    same_row = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.col("id").alias("other"))
    docs = same_row.unionByName(spark.range(100).select("id", F.col("id").cast("string").alias("text"), "id").toDF("doc_id", "text", "other"))
    got = shuffle_into_shards(docs, 4, bucket_bytes=10_000, alike=50).collect()
    assert sorted((r["doc_id"], r["other"]) for r in got) == sorted([(5, i) for i in range(3000)] + [(i, i) for i in range(100)])
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(775)) for s in slots.values()) and len(slots) == 4
    # Not in the order they came in, and not together.
    assert len({r["shard"] for r in got if r["other"] < 100 and r["doc_id"] == 5}) == 4


def test_sharding_query(spark):
    from quire.llm.registry import queries

    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries()["op7_sharding"](spark, SF).collect()
    multiset([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], [(d, len(t) + 16, zlib.crc32(t)) for d, t in docs.items()])
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    slots = collections.Counter(r["shard"] for r in got)
    assert set(slots) == set(range(40)) and max(slots.values()) - min(slots.values()) <= 1
    assert {(r["shard"], r["slot"]) for r in got} == {(s, k) for s, n in slots.items() for k in range(n)}


# 8


def brute_stats(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics(spark, docs, rows):
    from quire.llm.quality import text_stats

    out = text_stats(docs, "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    multiset(out, [(d, *brute_stats(t)) for d, t, *_ in rows])


def test_exact_binomial_tail(spark):
    import math

    from quire.llm.quality import log_binomial_tail

    cases = [(k, n) for n in (1, 7, 300, 5000) for k in (0, 1, 2, 5, 20) if k <= n]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", log_binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    for r in got:
        k, n = r["k"], r["n"]
        want = math.log(sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)))
        assert r["p"] == 0 if k >= n * 0.01 else abs(r["p"] - want) < 1e-8


def test_quality_cutoffs_hold_their_promise(spark):
    from quire.llm.quality import judge

    rng = random.Random(5)
    good = [(i, words(40, rng), "en", None, 0) for i in range(1500)]
    bad = [(9000 + i, " ".join(w + "###" for w in words(40, rng).split()), "en", None, 0) for i in range(200)]
    few = [(20000 + i, words(40, rng) + " ###", "de", None, 0) for i in range(20)]
    labels = spark.createDataFrame([(d, int(d < 9000 or d >= 20000)) for d, *_ in [*good, *bad, *few] if d % 2 == 0 or d >= 20000] + [(None, 1), (2, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in judge(spark.createDataFrame([*good, *bad, *few], SCHEMA), labels).collect()}
    assert sum(not out[d]["kept"] for d, *_ in good) <= 0.05 * len(good)
    assert not any(out[d]["kept"] for d, *_ in bad)
    assert all(out[d]["kept"] for d, *_ in few)


def test_quality_without_labels_or_rows(spark, docs, rows, empty):
    from quire.llm.quality import judge

    none = spark.createDataFrame([], "doc_id long, quality int")
    out = judge(docs, none).collect()
    assert len(out) == len(rows) and all(r["kept"] == (not r["base_failed"]) for r in out)
    assert judge(empty, none).count() == 0


# 9


def test_budgets_go_to_siblings_first():
    from quire.llm.mixing import allocate

    leaves = {("a", "en", "x"): 10, ("a", "en", "y"): 500, ("a", "de", "z"): 500, ("b", "en", "x"): 1000}
    out = allocate(leaves, 400, {("a",): 1, ("b",): 1, ("a", "en"): 3, ("a", "de"): 1}, 1)
    assert out == {("a", "en", "x"): 10, ("a", "en", "y"): 140, ("a", "de", "z"): 50, ("b", "en", "x"): 200}
    out = allocate(leaves, 1800, {("a",): 1, ("b",): 1}, 1)
    assert out == {("a", "en", "x"): 10, ("a", "en", "y"): 440, ("a", "de", "z"): 450, ("b", "en", "x"): 900}
    assert sum(allocate(leaves, 10**9, {}, 2).values()) == 2 * 2010
    assert allocate({}, 10, {}, 1) == {}


@pytest.mark.parametrize("share", [0.3, 1.5])
def test_mixture_meets_targets(spark, docs, rows, empty, share):
    from quire.llm.mixing import allocate, document_path, mix

    out = mix(docs, document_path(), {("a",): 2.0}, share=share).collect()
    tokens, leaves = collections.Counter(), collections.Counter()
    for r in out:
        assert r["used_tokens"] == r["full_epochs"] * r["n_tokens"] + r["prefix_tokens"] > 0 and r["prefix_tokens"] <= r["n_tokens"]
        tokens[r["domain"], r["language"], r["leaf"]] += r["used_tokens"]
    for d, t, lang, s, _ in rows:
        digit = re.search(r"(\d)$", s or "")
        n = len(WORD.findall(t or ""))
        if n:
            leaves["a" if digit and int(digit[1]) <= 3 else "other", lang or "", s or ""] += n
    want = allocate(dict(leaves), round(sum(leaves.values()) * share), {("a",): 2.0}, 2)
    assert dict(tokens) == {k: v for k, v in want.items() if v}
    assert mix(empty, document_path(), {}).count() == 0


def spark_hash(*values, seed=42):
    """xxhash64 as Spark's, of longs and strings: one hash is the seed of the next."""
    import xxhash

    h = seed
    for v in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode(), h)
    return h


def brute_mix(rows, share, max_epochs, seed=3):
    """(doc_id, domain, language, leaf, n_tokens, target_tokens, full_epochs, prefix_tokens, used_tokens) of documents in use."""
    from quire.llm.mixing import WEIGHTS, allocate

    leaves = collections.defaultdict(list)
    for d, text, lang, source in rows:
        n = len(WORD.findall(text or ""))
        digit = int(source[-1]) if re.search(r"\d$", source or "") else None
        domain = "other" if digit is None or digit > 8 else "a" if digit <= 3 else "b" if digit <= 6 else "c"
        if n:
            key = spark_hash(text)
            leaves[domain, lang or "", source or ""].append((d, key - (1 << 64) if key >> 63 else key, n))
    sizes = {k: sum(n for *_, n in own) for k, own in leaves.items()}
    targets = allocate(sizes, round(sum(sizes.values()) * share), WEIGHTS, max_epochs)
    first = spark_hash(seed.to_bytes(4, "little").decode())  # an int literal is hashed as four bytes
    for leaf, own in leaves.items():
        full, rest = divmod(targets[leaf], sizes[leaf])
        for d, _, n in sorted(own, key=lambda x: spark_hash(full, *leaf, x[0], x[1], seed=first)):
            taken = min(n, rest)
            rest -= taken
            if full or taken:
                yield d, *leaf, n, targets[leaf], full, taken, full * n + taken


@pytest.mark.parametrize("driver_leaves", [100, 0])
def test_mixing_takes_the_seeded_prefix(spark, driver_leaves):
    """Which documents, by an order worked out apart from the operator."""
    from quire.llm.mixing import WEIGHTS, document_path, mix

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mix(docs, document_path(), WEIGHTS, driver_leaves=driver_leaves).drop("text_key").collect()
    multiset(got, brute_mix(docs.select("doc_id", "text", "lang", "source").collect(), 0.5, 2))


def test_mixing_query_by_brute_force(spark):
    from quire.llm.registry import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = "doc_id domain language source n_tokens target_tokens full_epochs prefix_tokens used_tokens".split()
    multiset(queries()["op9_mixing"](spark, SF).select(*names).collect(), brute_mix(docs.select("doc_id", "text", "lang", "source").collect(), 0.5, 2))


def test_budgets_in_tasks_equal_those_of_the_driver(spark):
    from quire.llm.mixing import allocate, allocated

    rng = random.Random(31)
    leaves = {(rng.choice("ab"), rng.choice(["en", "de", ""]), f"s{i}"): rng.randint(0, 900) for i in range(40)}
    weights = {("a",): 3.0, ("a", "en"): 0.0, ("b", "de"): 2.5}
    df = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "domain string, language string, leaf string, n long")
    for budget in (0, 500, 6000, 10**9):
        out = {(r[0], r[1], r[2]): r["target_tokens"] for r in allocated(df, ["domain", "language", "leaf"], budget, weights, 2).collect()}
        assert out == allocate(leaves, budget, weights, 2)


# 10


def brute_print(text, size=3):
    import xxhash

    w = WORD.findall((text or "").translate(AZ))
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """(id, print) -> smallest id reachable over two or fewer differing bits."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, p, least.get(find(i))) for i, (d, p) in enumerate(prints)]


def test_simhash_components(docs, rows, empty):
    from quire.llm.simhash import simhash_components

    got = [(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash_components(docs).collect()]
    multiset(got, brute_components([(d, brute_print(t)) for d, t, *_ in rows]))
    assert simhash_components(empty).count() == 0


@pytest.mark.parametrize("hot", [8192, 5])
def test_near_links_lose_nothing(spark, hot):
    from quire.llm.components import connected_components
    from quire.llm.simhash import ROWS, key_batches, near_links

    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for p in list(prints)[:60]:
        for _ in range(12):
            q = p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
            prints.add(q)
            p = q if rng.random() < 0.3 else p
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r["vid"]: r["root"] for r in connected_components(near_links(df.mapInArrow(key_batches, ROWS), 1, 2, hot=hot)).collect()}
    want = brute_components([(p, p & (1 << 64) - 1) for p in signed])
    assert {p: roots.get(p, p) for p in signed} == {d: c for d, _, c in want}


def test_near_links_of_one_crowd(spark):
    """Fingerprints that agree in all but a few bits share every key and every finer key."""
    from quire.llm.components import connected_components
    from quire.llm.simhash import ROWS, key_batches, near_links

    rng = random.Random(16)
    prints = sorted({0x1234567800000000 | sum(1 << b for b in rng.sample(range(0, 32, 3), rng.randint(0, 5))) for _ in range(150)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r["vid"]: r["root"] for r in connected_components(near_links(df.mapInArrow(key_batches, ROWS), 1, 2, hot=4)).collect()}
    assert {p: roots.get(p, p) for p in prints} == {d: c for d, _, c in brute_components([(p, p) for p in prints])}


def test_simhash_query_by_brute_force(spark):
    from quire.llm.registry import queries

    prints = [(r["doc_id"], brute_print(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(d, f"{p:016x}", c) for d, p, c in brute_components(prints)]
    multiset(queries()["op10_simhash"](spark, SF).select("doc_id", "fingerprint", "component_id").collect(), want)


def leaks_by_words(docs, items):
    """(doc_id, item_id) where 13 words in a row agree in 11 with those of an item of 13 or more."""
    grams, found = {}, set()
    for item, t in items:
        w = re.findall(r"\w+", t.lower())
        for j in range(len(w) - 12):
            for k, x in enumerate(w[j : j + 13]):
                grams.setdefault((k, x), set()).add((item, j))
    for d, text in docs:
        w = re.findall(r"\w+", (text or "").lower())
        for i in range(len(w)):
            agree = collections.Counter(place for k, x in enumerate(w[i : i + 13]) for place in grams.get((k, x), ()))
            found |= {(d, item) for (item, _), n in agree.items() if n >= 11}
    return found


def test_decontamination_query_by_brute_force(spark):
    from quire.llm.registry import queries

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = leaks_by_words(docs, items)
    assert all(len(re.findall(r"\w+", t)) >= 13 for _, t in items) and want
    multiset([(r["doc_id"], r["item_id"]) for r in queries()["op4_decontaminate"](spark, SF).collect()], want)


def test_bit_sliced_distances():
    from quire.llm.simhash import near

    rng = np.random.default_rng(3)
    for words_, radius in ((1, 2), (1, 5), (8, 78)):
        a = rng.integers(0, 1 << 63, (70, words_), dtype="u8")
        b = np.vstack([a[:64] ^ (rng.random((64, words_)) < 0.6).astype("u8"), rng.integers(0, 1 << 63, (64, words_), dtype="u8")])
        bits = lambda x: np.unpackbits(x.view(np.uint8), axis=1)
        want = (bits(a)[:, None, :] != bits(b)[None, :, :]).sum(axis=2) <= radius
        hits = near(a, b, radius)
        got = np.unpackbits(hits[0].view(np.uint8), axis=1, bitorder="little").astype(bool) if hits is not None else np.zeros_like(want)
        assert (got == want).all() and want.any()


def test_components_of_chains_and_loops(spark):
    from quire.llm.components import connected_components

    links = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (None, 3)] + [(200, 201 + i) for i in range(30)]
    out = {r["vid"]: r["root"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100, **{201 + i: 200 for i in range(30)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_groups(texts, size=5, similarity=0.8):
    """Texts with words -> smallest id of those reachable over similar sets of shingles."""
    sets = {}
    for d, t in texts:
        w = WORD.findall((t or "").translate(AZ))
        if w:
            sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}
    parent = {d: d for d in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for d in sets:
        for e in sets:
            if d < e and len(sets[d] & sets[e]) >= similarity * len(sets[d] | sets[e]) - 1e-9:
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("cells", [{}, {"cell_rows": 5, "cell_bytes": 4000}])
def test_near_duplicates_are_exact(spark, cells):
    from quire.llm.near_text import near_duplicates, text_keys

    rng = random.Random(12)
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for g in range(8):  # groups of copies with more and more changes, some on either side of 0.8
        base = words(rng.choice([4, 9, 30, 80, 250]), rng).split()
        for k in range(24):
            w = list(base)
            for _ in range(k % 6):
                w[rng.randrange(len(w))] = words(1, rng)
            texts.append((10_000 + 100 * g + k, " ".join(w).replace("a", "A" if k % 2 else "a")))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    groups = near_duplicates(df, **cells)
    got = {r["doc_id"]: r["component_id"] for r in df.select("doc_id", *text_keys()).join(groups, ["t1", "t2"]).collect()}
    want = brute_groups(texts)
    assert len(set(want.values())) < len(want) - 40
    assert got == want


def test_ids_with_several_texts_are_not_mixed_up(spark):
    from quire.llm.near_text import one_of_each_group

    rng = random.Random(4)
    a, b = words(60, rng), words(60, rng)
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (None, a), (None, b + " x")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in one_of_each_group(df).collect()) == sorted([(1, a), (1, b)])


def test_near_copies_leave_one(spark, docs, rows):
    from quire.llm.near_text import one_of_each_group

    rng = random.Random(8)
    base = [words(300, rng) for _ in range(12)]
    extra = []
    for i, t in enumerate(base):
        extra.append((5000 + 10 * i, t, None, None, 0))
        w = t.split()
        w[150] = "changed"
        extra.append((5001 + 10 * i, " ".join(w), None, None, 0))  # similarity 0.97
        extra.append((5002 + 10 * i, " ".join(w[:150]) + " " + words(150, rng), None, None, 0))  # 0.33
    out = [r["doc_id"] for r in one_of_each_group(spark.createDataFrame(extra, SCHEMA)).collect()]
    assert sorted(out) == sorted(x for i in range(12) for x in (5000 + 10 * i, 5002 + 10 * i))
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert 1006 not in ids and {1000, 1001, 1002} <= set(ids)
