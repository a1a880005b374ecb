"""Shards: round trips, lookups, damage."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodeline.llm import sstable as S
from lodeline.llm.common import fresh_path


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_equals_the_tokenizer():
    rnd = random.Random(5)
    alphabet = "abcXYZ é ß 'sst'llre've  \n\n\t 0123 .,;!?_-#|× ÷ ñ 中文 ́ \xa0 \x85 \x1c ² ½ 𝔘 <|endoftext|>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 300))) for _ in range(400)]
    texts += ["word " * 70_000, "a" * 300_000, "\n" * 300_000, "it's we'll  don't\n\n x", "don'" + " 's 'S"]
    t, e = tokenizer(), S.Encoder(None)
    texts += ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "word " * 5_000 + "<|endoftext|>\n"]
    for text in texts:
        assert np.frombuffer(e.encode(text.encode()), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(e.encode(b"a <|endoftext|> b"), "<u2").tolist() == [64, 220, 50256, 275]
    plain = S.Encoder(None, marks_as_text=True)
    t.encode_special_tokens = True
    for text in texts[-4:]:
        assert np.frombuffer(plain.encode(text.encode()), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


def test_shard_lookup_and_damage():
    rnd = random.Random(2)
    rows = sorted((S.key_bytes(rnd.randrange(-50, 4000) if rnd.random() < 0.98 else None), np.array([rnd.randrange(60_000) for _ in range(rnd.randint(0, 40))], "<u2").tobytes()) for _ in range(3000))
    out = io.BytesIO()
    w = S.Writer(out, block_bytes=500)
    for k, v in rows:
        w.add(k, v)
    w.close()
    data = out.getvalue()
    r = S.Reader(io.BytesIO(data), len(data))
    assert list(r) == rows
    assert r.docs == len(rows) and r.tokens == sum(len(v) // 2 for _, v in rows)
    for k in {k for k, _ in rows}:
        assert [x.astype("<u2").tobytes() for x in r.get(k)] == [v for q, v in rows if q == k]
    absent = [S.key_bytes(i) for i in range(5000, 9000)]
    assert all(r.get(k) == [] for k in absent)
    assert sum(r.may_hold(k) for k in absent) < 100
    with pytest.raises(ValueError):
        w.add(S.key_bytes(-99), b"")
    broken = bytearray(data)
    broken[20] ^= 1
    with pytest.raises(ValueError):
        list(S.Reader(io.BytesIO(bytes(broken)), len(broken)))
    with pytest.raises(ValueError):
        S.Reader(io.BytesIO(data[:-1] + b"x"), len(data))


def test_keys_sort_as_ids():
    ids = [None, -(1 << 63), -5, -1, 0, 1, 255, 256, (1 << 63) - 1]
    keys = [S.key_bytes(i) for i in ids]
    assert keys == sorted(keys)
    assert [S.key_value(k) for k in keys] == ids
    assert S.key_value(S.key_bytes("aé")) == "aé"


def test_written_files(spark):
    texts = {i: ("Text %d. " % i) * (i % 7) or None for i in range(200)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(5)
    folder = fresh_path(spark, "test")
    m = S.write(docs, folder, partitions=4).orderBy("shard").collect()
    assert sum(r.n_docs for r in m) == 200 and len(m) > 1
    t, start = tokenizer(), 0
    rows = S.read(spark, folder, with_ids=True).orderBy("doc_id").collect()
    for r in rows:
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    found = S.lookup(spark, folder, [0, 77, 199, 500])
    assert found[500] == [] and found[77][0].tolist() == rows[77].ids


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "y z"), (None, "")], "doc_id string, text string")
    assert [r.doc_id for r in S.round_trip(docs).orderBy("start").collect()] == [None, "a", "b"]


def test_an_id_of_many_rows_takes_several_shards(spark):
    docs = spark.createDataFrame([(7, f"text {i % 5}") for i in range(400)] + [(i, "x") for i in range(20)], "doc_id long, text string").repartition(6)
    folder = fresh_path(spark, "test")
    m = S.write(docs, folder, partitions=8).collect()
    assert sum(bytes(r.first_key) <= S.key_bytes(7) <= bytes(r.last_key) for r in m) > 3
    assert max(r.n_docs for r in m) < 200
    rows = S.read(spark, folder).orderBy("start").collect()
    assert len(rows) == 420 and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert len(S.lookup(spark, folder, [7])[7]) == 401
