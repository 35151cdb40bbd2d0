"""Token counts, token files, SentencePiece and mixing against their libraries or brute force."""

import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from doctables.llm import mixing, pieces, tokencount, tokenfiles
from doctables.llm.work import shared_folder

SCHEMA = "doc_id long, text string, source string, size long, draw long, bin long, ids string, n long"
PARTS = ["a", "the", "The", "don't", "it's", " ", "  ", "\n", "\t", "é", "中文", "😀", "\x00", "ß", "ﬁ", "é", "́", " ", "\x1c",
         "<|endoftext|>", "<|startoftext|>", "<s>", "<0x41>", "▁", "0123", "aaaa", "ing", "https://x.y/z?q=1", "İ", "Σ"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    odd = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(300)]
    return odd + [None, "", " ", "x" * 3000, "ab" * 2000 + " é", " " * 200, " ".join(["thing", "other"] * 30_000)]


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3, "z", 4) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def test_counts_equal_library(spark, texts):
    model = Tokenizer.from_file(public_tokenizers.path(tokencount.MODEL))
    got = {r.doc_id: r for r in tokencount.count_tokens(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048), repr(t)
    assert tokencount.count_tokens(frame(spark, [])).collect() == []


def test_files_round_trip(spark, texts, monkeypatch):
    model = Tokenizer.from_file(public_tokenizers.path(tokenfiles.MODEL))
    ids = [5 * i - 40 for i in range(len(texts))]
    ids[3], ids[9] = None, ids[8]  # no id, and one id twice
    order = random.Random(1).sample(range(len(texts)), len(texts))
    docs = frame(spark, [texts[i] for i in order], [ids[i] for i in order])
    place = shared_folder(spark)
    files = tokenfiles.write_token_files(docs, place)
    got = sorted(tokenfiles.read_token_files(files, place).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((x for x in ids), key=lambda x: (x is not None, x))
    want = {}
    for i, t in zip(ids, texts):
        found = np.array(model.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want.setdefault(i, []).append((len(found), zlib.crc32(found.tobytes())))
    start = 0
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(docs.limit(0), place + "-0"), place + "-0").collect() == []


def test_one_document_is_read_alone_and_damage_is_seen():
    out = io.BytesIO()
    writer = tokenfiles.TokenFileWriter(out)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n, dtype=np.uint32) for n in (10, 0, 70_000, 3, 200_000, 1)]
    for i, ids in enumerate(docs):
        writer.add(i * 10, ids.tobytes())
    writer.close()
    raw = out.getvalue()
    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw)
    assert np.array_equal(np.frombuffer(whole, dtype="<u4"), np.concatenate(docs))
    assert raw.rfind(struct.pack("<I", tokenfiles.SEEK_END)) > 0
    reader = tokenfiles.TokenFileReader(io.BytesIO(raw))
    assert all(np.array_equal(reader.ids(i), ids) for i, ids in enumerate(docs))
    opened = []
    one = tokenfiles.TokenFileReader(io.BytesIO(raw))
    unpack = one._frame
    one._frame = lambda k: (opened.append(k), unpack(k))[1]
    assert np.array_equal(one.ids(3), docs[3]) and len(set(opened)) == 1
    broken = bytearray(raw)
    broken[int(reader.packed[1]) + 40] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(tokenfiles.TokenFileReader(io.BytesIO(bytes(broken))).parts(2))


def test_seek_table_ends_the_file():
    out = io.BytesIO()
    writer = tokenfiles.TokenFileWriter(out)
    sizes = [3, 0, tokenfiles.FRAME_IDS + 5, 1]
    for i, n in enumerate(sizes):
        writer.add(i, np.arange(n, dtype="<u4").tobytes())
    writer.close()
    raw = out.getvalue()
    count, flags, magic = struct.unpack("<IBI", raw[-9:])
    assert (count, flags, magic) == (3, 0x80, 0x8F92EAB1)  # two frames of ids and the index
    table = [struct.unpack_from("<III", raw, len(raw) - 9 - 12 * (count - k)) for k in range(count)]
    start = sum(packed for packed, _, _ in table)
    assert struct.unpack_from("<II", raw, start) == (0x184D2A5E, 12 * count + 9)
    assert start + 8 + 12 * count + 9 == len(raw)
    assert [unpacked for _, unpacked, _ in table] == [4 * tokenfiles.FRAME_IDS, 4 * (sum(sizes) - tokenfiles.FRAME_IDS), 0]
    first = zstandard.ZstdDecompressor().decompress(raw[: table[0][0]])
    assert xxhash.xxh64_intdigest(first) & 0xFFFFFFFF == table[0][2]
    empty = io.BytesIO()
    tokenfiles.TokenFileWriter(empty).close()
    assert len(tokenfiles.TokenFileReader(io.BytesIO(empty.getvalue())).index) == 0


def test_sentencepiece_equals_library(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    coded = pieces.encode_documents(frame(spark, texts)).withColumn("back", pieces.decode(F.col("ids")))
    got = {r.doc_id: r for r in coded.collect()}
    for i, t in enumerate(texts):
        want = model.encode(t or "")
        assert list(got[i].ids) == want and got[i].back == model.decode(want) == (t or "").replace("▁", " "), repr(t)
    assert got[0].draw == 2
    assert pieces.encode_documents(frame(spark, [])).collect() == []


def test_suffix_order():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 3, 300).astype(np.uint32)
    order = pieces.suffix_order(codes, 8)
    shown = [tuple(codes[i : i + 8]) for i in order]
    assert shown == sorted(shown)


@pytest.mark.parametrize("seed", range(6))
def test_fit_lengths_is_near(seed):
    rng = random.Random(seed)
    lengths = np.array(rng.sample(range(1, 400), rng.randrange(1, 40)), dtype=np.int64)
    counts = np.array([rng.randrange(1, 50) for _ in lengths], dtype=np.int64)
    total = int((lengths * counts).sum())
    for budget in (0, 1, total // 7, total // 2, total - 1, total, total + 5):
        taken = mixing.fit_lengths(lengths, counts, budget)
        assert ((taken >= 0) & (taken <= counts)).all()
        best = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            best = {s + k * n for s in best for k in range(c + 1)} if len(best) * c < 20_000 else None
            if best is None:
                break
        got = int((lengths * taken).sum())
        if best is not None:
            assert abs(got - budget) == min(abs(s - budget) for s in best)
        assert abs(got - min(budget, total)) <= lengths.max()


def test_mixing(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        source = rng.choice(["b", "a", "é", "Z", None, "big", "big", "big"])
        rows.append((i, rng.choice([" ".join(["w"] * rng.randrange(0, 60)), None, "one word two\x0bthree"]), source))
    rows += [(1000 + i, "same length text here", "big") for i in range(300)] + rows[:5] + [(None, "no id", "a"), (2000, "solo", "tiny")]
    docs = spark.createDataFrame([(d, t, s, 1, 2, 3, "z", 4) for d, t, s in rows], SCHEMA)
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = lambda t: len([w for w in (t or "").encode().split()])
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rate = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * rate > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    target = {s: 3 * sizes[s] if s in capped else weight[s] * rate for s in order}
    assert capped
    taken = {}
    for r in got:
        assert r.taken == r.passes * r.size and 0 <= r.passes <= 3 and r.source_size == sizes[r.source]
        assert abs(r.target - target[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 2 for s in order), (taken, target)
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    assert {r.taken for r in mixing.mix_sources(docs.filter("text is null")).collect()} == {0}


def test_accented_words_need_no_offsets_and_parts_outlive_a_generation():
    from doctables.llm import wordcache

    model = tokencount.tokenizer(public_tokenizers.path(tokencount.MODEL))
    by_offsets, encoded = [], []

    class Spied:
        get_vocab, encode_batch_fast = model.get_vocab, model.encode_batch_fast

        def encode_batch(self, texts, **more):
            by_offsets.extend(" ".join(texts).split())
            return model.encode_batch(texts, **more)

    words = ["ciónado", "été", "İki", "ǎb", "don't", "</w>", "中文", "abc", "ſs", "x1"]
    got = wordcache.encode_words(Spied(), [w.encode() for w in words])
    assert got == [np.array(model.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes() for w in words]
    assert set(by_offsets) == {"İki", "ǎb", "don't", "</w>", "中文", "x1"}

    cache = wordcache.WordCache(lambda found: encoded.extend(found) or found, wordcache.word_parts, kept=8)
    for i in range(8):
        fill = [b"%c%c" % (97 + i, 97 + k) for k in range(4)]
        assert cache.lists([[b"same" + b"!" * (i + 1), *fill]]) == [[b"same" + b"!" * (i + 1), *fill]]
    assert encoded.count(b"same") == 1


def test_token_files_read_letters_of_either_case_as_the_library():
    pick = random.Random(5)
    letters = [*"aAjJhHtT'.,!<|>09 \n", "̌", "̇", "é", "İ", "ß", "Σ", "K", "<|endoftext|>", "<|ENDOFTEXT|>", "'LL", "</w>"]
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 40))) for _ in range(3000)]
    model = tokencount.tokenizer(public_tokenizers.path(tokencount.MODEL))
    want = [np.array([*e.ids, 1], dtype="<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]
    assert list(tokenfiles.encoded([t.encode() for t in texts], end=1)) == want
