"""Archives, chats and token ids: exact round trips."""

import base64
import glob
import hashlib
import io
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.llm import bpe, chat, warc

PAGES = "page_id long, url string, html string"


def test_archives_hold_what_was_written(spark, tmp_path):
    big, other = "<p>é" + "x" * 1200, "y" * 2000
    rows = [(i, f"http://h/{i}", big) for i in range(40)] + [
        (100, "http://a\r\nWARC-Type: x", other), (101, None, other), (102, "u", None), (103, "u", ""), (104, "u", "short"),
        (105, "u", "short"), (None, "u", other), (106, "u", "z" * 300_000), (106, "u", "z" * 300_000), (107, "u", "a\r\n\r\nb" * 300),
    ]
    pages = spark.createDataFrame(rows, PAGES).withColumn("path", F.lit("p")).withColumn("records", F.lit(1))
    manifest, place = warc.archive_pages(pages, f"file://{tmp_path}/own")
    back = warc.read_archives(manifest, place).collect()
    assert len(back) == len(rows)
    last = {}
    for k, _, html in rows:
        if len((html or "").encode()) >= 1000:
            last[html] = max(last.get(html, -1), -1 if k is None else k)
    want = sorted(
        (str(k), u and warc._header_text(u), hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode()),
         "revisit" if h in last and last[h] != k else "response", str(last[h]) if h in last and last[h] != k else "None")
        for k, u, h in rows
    )
    assert want == sorted(
        (str(r["page_id"]), r["url"], r["payload_digest"], r["payload_bytes"], r["record_type"], str(r["refers_to"])) for r in back
    )
    by_key = {k: (h or "").encode() for k, _, h in rows}
    assert all(bytes(r["payload"]) == by_key[r["page_id"]] for r in back if r["record_type"] == "response")
    for path in glob.glob(f"{tmp_path}/own/*.zst"):
        with open(path, "rb") as f:
            raw = f.read()
        assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_MAGIC
        # any reader that knows the dictionary can take a record by itself
        size = int.from_bytes(raw[4:8], "little")
        words = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
        assert zstandard.ZstdDecompressor(dict_data=words).decompressobj().decompress(raw[8 + size :]).startswith(b"WARC/1.1\r\n")


def test_no_pages_no_archives(spark, tmp_path):
    manifest, place = warc.archive_pages(spark.createDataFrame([], PAGES), f"file://{tmp_path}/none")
    assert manifest.count() == 0 and warc.read_archives(manifest, place).count() == 0


def test_archives_of_odd_sizes():
    draw = random.Random(3)
    for records in ([b"a"], [b""] * 3, [bytes(draw.randbytes(n)) for n in (0, 1, 70_000, 400_000)], [b"same text " * 50] * 2000):
        out = io.BytesIO()
        warc.write_archive(out, records)
        assert list(warc.read_archive(io.BytesIO(out.getvalue()))) == records
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(out.getvalue()[:-9])))


def test_dictionary_makes_archives_smaller():
    draw = random.Random(5)
    words = ["<div class='content'>", "</div>", "<a href='https://example.com/", "lorem", "ipsum", "dolor", "sit", "amet"]
    records = ["".join(draw.choices(words, k=60)).encode() for _ in range(800)]
    out = io.BytesIO()
    warc.write_archive(out, records)
    plain = sum(len(zstandard.compress(r)) for r in records)
    assert len(out.getvalue()) < 0.8 * plain


def plain_fold(events):
    """One message by a loop over its events."""
    role, text = "", ""
    for _, kind, r, t in sorted(events, key=lambda e: (e[0] is not None, e[0] or 0, e[1], e[2] or "", e[3] or "")):
        if kind == "start":
            role, text = r or "", ""
        elif kind == "regenerate":
            text = ""
        elif kind == "edit":
            text = t or ""
        elif kind == "delta":
            text += t or ""
    return role, text


EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"


def test_fold_equals_plain_loop(spark):
    draw = random.Random(1)
    rows = [
        (draw.choice([1, 2, None]), draw.choice([None, *range(12)]), draw.choice([0, 1, None]),
         draw.choice(["start", "delta", "delta", "delta", "edit", "regenerate", "other"]), draw.choice(["user", "assistant", None]),
         draw.choice(["a", "bc", "", None, "é🙂"]))
        for _ in range(300)
    ]
    found = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in chat.fold_events(spark.createDataFrame(rows, EVENTS)).collect()}
    want = {}
    for conv, seq, message, kind, role, text in rows:
        want.setdefault((conv, message), []).append((seq, kind, role, text))
    assert found == {k: plain_fold(v) for k, v in want.items()}


def test_chats_come_back(spark):
    hard = ["\\### Assistant: </turn> ok", "</turn>\n### assistant: no", "\\b\\h\\e\\c\\\\", "#" * 9, "</turn", "", None, "a\nb", "🙂" * 50, "\\"]
    rows = [(c, t, ("user", "assistant", "sys:tem\\")[t % 3], hard[(c + t) % len(hard)]) for c in range(12) for t in range(11)]
    rows += [(50, 0, "assistant", "same"), (50, 0, "assistant", "same"), (None, 1, None, "x"), (None, None, "assistant", "y"), (60, 0, "user", "u")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1))
    formatted = chat.format_chats(chat.events_of(table))
    back = {r["conv_id"]: [(m["role"], m["text"], m["loss"]) for m in r["messages"]] for r in chat.read_back(formatted).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or -1, r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or "", role == "assistant"))
    assert back == want
    for r in formatted.collect():
        for turn, (_, text, loss) in zip(r["turns"], want[r["conv_id"]], strict=True):
            assert turn["loss"] == loss
            escaped = r["formatted"][turn["start"] : turn["end"]]
            assert escaped == text.replace("\\", "\\b").replace("###", "\\h").replace("</turn>", "\\e")
    assert chat.format_chats(chat.events_of(table.limit(0))).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(vocabulary):
    places = [vocabulary.hash.place(t) for t in vocabulary.tokens]
    assert places == list(range(len(vocabulary.tokens)))
    for n in (1, 2, 3, 5, 40):
        keys = [str(i).encode() for i in range(n)]
        table = bpe.PerfectHash(keys)
        assert sorted(map(table.place, keys)) == list(range(n))


def test_ids_equal_the_library(vocabulary, reference, docs, hard_rows):
    draw = random.Random(2)
    letters = list("abcdefgh ABC  \n\n\t'sdretmve0123 .,!?<|>#$%&*é你好🙂\x1c\x85ßÀ×÷\u3000\u00a0")
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 60))) for _ in range(5000)]
    texts += [r["text"] for r in docs.collect()] + [r[1] or "" for r in hard_rows] + [" " * 300, "\n" * 7 + "x", "a.b", "x's", "<|endoftext|>"]
    codec = bpe.Codec(vocabulary)
    for text, want in zip(texts, reference.encode_ordinary_batch(texts), strict=True):
        decimals, packed = codec.encode(text)
        ids = np.frombuffer(packed, np.uint32)
        assert ids.tolist() == want, text
        assert decimals == " ".join(map(str, want)) and codec.decode(ids) == text.encode()


def test_merges_look_up_at_most_two_pairs_each(vocabulary):
    """Entries of the heap that are out of date are told by the ranks in place, not by another lookup."""

    class Counting(dict):
        looked = 0

        def get(self, *key):
            self.looked += 1
            return super().get(*key)

    def plain(piece):
        ids = [codec.byte_ids[b] for b in piece]
        while True:
            ranks = [pairs.get((a << 32) | b, 1 << 40) for a, b in zip(ids, ids[1:])]
            if not ranks or min(ranks) == 1 << 40:
                return ids
            at = ranks.index(min(ranks))
            ids[at : at + 2] = [ranks[at]]

    codec = bpe.Codec(vocabulary)
    pairs = codec.pairs
    rng = np.random.default_rng(3)
    words = [b"", b"a", b"aaaaaaaaaaaaaa", "ééé".encode(), *[bytes(rng.choice(list(b"  aehinorst"), int(n))) for n in rng.integers(1, 60, 300)]]
    for word in words:
        codec.pairs = Counting(pairs)
        ids = codec._merge(word)
        assert ids == plain(word)
        assert codec.pairs.looked <= 2 * (len(word) - len(ids))


def test_small_caches_give_the_same(vocabulary, reference, docs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1000)
    codec = bpe.Codec(vocabulary)
    for r in docs.limit(20).collect():
        assert np.frombuffer(codec.encode(r["text"])[1], np.uint32).tolist() == reference.encode_ordinary(r["text"])


def test_encode_and_decode_columns(vocabulary, hard, hard_rows, nothing):
    encoded = bpe.encode(hard.withColumn("pattern", F.lit(1)), vocabulary)
    rows = bpe.decode(encoded, vocabulary).collect()
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted((r[1] or "").encode() for r in hard_rows)
    digests = bpe.round_trip(hard, vocabulary).collect()
    assert all(r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in digests)
    assert bpe.round_trip(nothing, vocabulary).count() == 0 and bpe.encode(nothing, vocabulary).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(encoded, vocabulary)
    assert isinstance(encoded.schema["ids"].dataType, T.ArrayType)
