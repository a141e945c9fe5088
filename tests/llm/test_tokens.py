import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_text_dedup import docs_of, ordered, texts  # noqa: F401
from tokenizers import Tokenizer

from homolark.llm.packing import JOINED, STEP_TOKENS, Packer, pack
from homolark.llm.token_store import LEAST, Stored, compress, read_store, shard_starts, write_store
from homolark.llm.tokens import Encoder

ODD = ["", " ", "  a  b \n\n c", "it's IT'S 12.5$ <|endoftext|>x", "a b\x1cc  d", "é ́x", "\n", "a\n b", "Ünïcödé\tΣΑΣ.", "a b c", "你好 \U0001f600!", "x" * 5000]


def plain(name, some, marks_as_text=False):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = marks_as_text
    return [e.ids + [2] for e in t.encode_batch(some, add_special_tokens=False)]


def thue_morse(n):
    """Two words of bytes that polynomial hashes modulo a power of two cannot tell apart."""
    bits = [k.bit_count() & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("marks_as_text", [False, True])
def test_encoder_equals_library(name, marks_as_text):
    r = random.Random(2)
    chars = "abcAB 12.,!?'\n\té<|>"
    some = ODD + ["".join(r.choice(chars) for _ in range(r.randrange(80))) for _ in range(500)]
    some += [t for n in (64, 512, 1024, 2048) for t in thue_morse(n)] + ["a <|startoftext|> b<|endoftext|>", " x" * 9 + "<|endoftext|>" * 2]
    e = Encoder(public_tokenizers.path(name), marks_as_text)
    for again in range(2):
        ids, off = e.encode(some, 2)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == plain(name, some, marks_as_text)
    assert Encoder(public_tokenizers.path(name)).encode([], 2)[0].tolist() == []


def test_equal_hashes_are_told_apart():
    e = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = plain("byte_bpe_50k.json", ["one two", "three two"])
    e.encode(["one two"], 2)
    pieces = e._pieces

    def forged(data, off):
        s, t, h, check, first = pieces(data, off)
        h[0] = e.keys[0]
        return s, t, h, check, first

    e._pieces = forged
    ids, off = e.encode(["three two"], 2)
    assert ids.tolist() == want[1]


def test_compress_round_trip_and_random_access():
    r = np.random.default_rng(1)
    for ids in (np.zeros(0, np.int64), np.array([5]), np.full(1000, 7), r.integers(0, 9, 20000), np.tile(r.integers(0, 50000, 40), 300)):
        for vocab in (50257, 200000):
            symbols, rules, lengths = compress(ids.astype(np.int32), vocab)
            kind = "<u2" if vocab + len(rules) <= 1 << 16 else "<u4"
            s = Stored(vocab, int(kind[-1]), rules.astype(kind).tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(kind).tobytes())
            assert (s.ids() == ids).all()
            for a, b in r.integers(0, max(1, len(ids)), (20, 2)):
                assert s.ids(a, b).tolist() == ids[a:b].tolist()
            pairs = {}
            for p in zip(symbols[:-1].tolist(), symbols[1:].tolist()):
                pairs[p] = pairs.get(p, 0) + 1
            assert max(pairs.values(), default=0) < 2 * LEAST  # overlapping places apart, no frequent pair is left
    assert len(symbols) * 2 < len(ids) and LEAST > 1


def test_store(spark, texts, tmp_path):  # noqa: F811
    some = texts + [(100 + i, t) for i, t in enumerate(ODD)]
    path = str(tmp_path / "store")
    write_store(docs_of(spark, some), path, public_tokenizers.path("byte_bpe_50k.json"), 50257, 2)
    got = read_store(spark, path).join(shard_starts(spark, path), "shard").withColumn("start", F.col("base") + F.col("shard_start"))
    start, want = 0, []
    rows = ordered(some)
    for (i, _), ids in zip(rows, plain("byte_bpe_50k.json", [t or "" for _, t in rows])):
        want.append((start, i, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in got.collect()) == want


def test_pack(spark, texts):  # noqa: F811
    some = [t for t in texts if t[0] is not None and t[0] < 60] + [(100 + i, t) for i, t in enumerate(ODD)]
    want = dict(zip([i for i, _ in some], plain("word_bpe_49k.json", [t or "" for _, t in some])))
    rows = pack(docs_of(spark, some), public_tokenizers.path("word_bpe_49k.json"), 2, group_bytes=2000).collect()
    docs, seqs = {}, {}
    for r in rows:
        assert r.doc_tokens == len(want[r.doc_id]) and len(r.ids) == 4 * r.length
        docs.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length, r.tier))
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in docs.items()} == {i: np.array(x, "<u4").tobytes() for i, x in want.items()}
    for p in seqs.values():
        at = 0
        for o, n, t in sorted(p):
            assert o == at
            at += n
        assert at == t and t <= 4096 and t & (t - 1) == 0


def held_by(p, lengths):
    for d, n in enumerate(lengths):
        own = sorted(x[1:3] for x in p.out if x[0] == d) + [(a, k) for q, a, k in p.left if q == d]
        at = 0
        for a, k in sorted(own):
            assert a == at and k > 0
            at += k
        assert at == n
    for s, t in enumerate(p.tier_of):
        assert sum(x[2] for x in p.out if x[3] == s) == t and t <= 4096 and t & (t - 1) == 0


def test_packer_random():
    r = random.Random(3)
    for k in range(300):
        lengths = [r.choice([1, 7, 100, 511, 512, 513, 1500, 2048, 4095, 4096, 4097, 9000]) for _ in range(r.randrange(1, 30))]
        p = Packer()
        p.pack(lengths, last=k % 2 == 0)
        held_by(p, lengths)
        assert k % 2 or not p.left
        assert sum(x[2] for x in p.left) < 512 + 1024 + 2048 + 4096


def test_tiers_hold_their_own():
    r = random.Random(4)
    p = Packer()
    p.pack([r.randrange(50, 500) for _ in range(3000)])
    assert sum(t == 512 for t in p.tier_of) > 0.95 * len(p.tier_of)
    p = Packer()
    lengths = [r.choice((300, 700, 1500, 3000)) for _ in range(2000)]
    p.pack(lengths)
    held_by(p, lengths)
    by = {t: p.tier_of.count(t) for t in set(p.tier_of)}
    assert by[4096] > 400 and by[2048] > 100  # items of 3000 and 1500 open windows, filled from shorter ones


def test_steps_are_balanced(spark):
    some = [(i, "word " * (i * 37 % 900)) for i in range(2000)]
    rows = pack(docs_of(spark, some).coalesce(1), public_tokenizers.path("word_bpe_49k.json"), 2, group_bytes=100_000).collect()
    steps, tiers = {}, {}
    for r in rows:
        steps[r.step] = steps.get(r.step, 0) + r.length
        tiers.setdefault(r.step, set()).add(r.tier)
    assert sum(n != STEP_TOKENS for n in steps.values()) <= 1 and len(steps) > 5
    assert all(len(t) == 1 for k, t in tiers.items() if k & 15 != JOINED)
    assert sum(n for n in steps.values()) == sum(len(t.split()) + 1 for _, t in some)


def test_empty(spark, tmp_path):
    none = docs_of(spark, [(1, "x")]).where("doc_id > 9")
    write_store(none, str(tmp_path / "e"), public_tokenizers.path("byte_bpe_50k.json"), 50257, 2)
    assert read_store(spark, str(tmp_path / "e")).count() == 0
    assert pack(none, public_tokenizers.path("word_bpe_49k.json"), 2).count() == 0
    assert zlib.crc32(b"") == 0
