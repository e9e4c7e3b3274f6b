"""BPE, packing and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidewater.llm import bpe, packer, pieces, queries, tokenfile

SMOKE = "/root/testdata/sf0.001"
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ALPHABET = [*" \n\t'abstlmrevdS12²½ÀéΣͅ‍!$_-　字אًİÅK<|", "'s", "'ll", " 're", "<|endoftext|>", "  ",
            "\r\n", "é", "the", "ing", "tion", "\U0001F600"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)] + [
        "", None, " ", "  ", "'s", "''s", " 's", "x's", "'street", "a" * 3000, "the" * 500]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i}") for i, t in enumerate(random_texts(150))]
    return spark.createDataFrame([*rows, (3, rows[3][1], None, None), (None, "no id", "x", "y")],
                                 "doc_id long, text string, ids string, n_tokens string")


def text_of(row):
    return row.text or ""


def test_both_encoders_equal_the_library():
    texts = random_texts(4000)
    for path, encoder in ((WORD, bpe.codec(WORD)[0]), (BYTE, bpe.codec(BYTE)[0]),
                          (BYTE, pieces.byte_level(BYTE))):
        library = Tokenizer.from_file(path)
        ids, off = encoder.ids(texts)
        for i, t in enumerate(texts):
            assert ids[off[i]:off[i + 1]].tolist() == library.encode(
                t or "", add_special_tokens=False).ids, (path, t)


def test_backtracking_equals_plain_merges():
    vocab = bpe.Vocabulary(WORD)
    walker = bpe.Backtracker(vocab, most_pairs=500)
    rng = random.Random(2)
    for _ in range(3000):
        piece = "".join(rng.choice("aeinorstlh'") for _ in range(rng.randint(1, 14)))
        assert walker.encode(piece) == vocab.merge(vocab.word(piece))


def test_full_piece_table_is_emptied_without_loss():
    library = Tokenizer.from_file(BYTE)
    calls = []

    def encode(parts):
        calls.append(len(parts))
        return pieces.listed([library.encode(p, add_special_tokens=False).ids for p in parts])

    encoder = pieces.Encoder(BYTE, False, encode, {}, None)
    encoder.table = pieces.PieceTable(encode, slots=64, most=30)
    for k in range(4):
        texts = [" ".join(f"w{i * j + 7 * k}" for i in range(9)) for j in range(12)]
        ids, off = encoder.ids(texts)
        for i, t in enumerate(texts):
            assert ids[off[i]:off[i + 1]].tolist() == library.encode(t).ids
    assert len(calls) > 2


def test_encode_documents(docs):
    library = Tokenizer.from_file(WORD)
    texts = {r.doc_id: text_of(r) for r in docs.collect()}
    rows = bpe.encode_documents(docs, WORD).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(
            library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), WORD).count() == 0


def test_byte_level_round_trip(docs):
    rows = bpe.encode_documents(docs, BYTE, with_text=True).collect()
    texts = {r.doc_id: text_of(r) for r in docs.collect()}
    assert all(bytes(r.decoded).decode() == texts[r.doc_id] for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_segments_round_trip(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.choice([0, 1, 255, 256, 257, 5000]))
    ids = rng.integers(0, int(rng.choice([1, 2, 300, 2**16, 2**32])), n).astype(np.uint32)
    ids[rng.random(n) < 0.03] = 2**32 - 1
    lengths = np.array([n // 2, n - n // 2])
    seg = tokenfile.Segment(tokenfile.encode_segment(ids, [7, None], lengths, 0))
    assert (seg.ids() == ids).all() and seg.doc_ids == [7, None]
    for _ in range(20):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        if a < b:
            assert (seg.slice(a, b) == ids[a:b]).all()


def test_token_files(spark, docs, tmp_path):
    library = Tokenizer.from_file(BYTE)
    target = str(tmp_path / "t")
    tokenfile.write_tokens(docs, target, BYTE, segment_ids=500)
    rows = sorted(tokenfile.read_tokens(spark, target, with_ids=True).collect(), key=lambda r: r.start)
    order = [r.doc_id for r in rows]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    texts = {r.doc_id: text_of(r) for r in docs.collect()}
    at = 0
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids) == (at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    tokenfile.write_tokens(docs.limit(0), target + "0", BYTE)
    assert tokenfile.read_tokens(spark, target + "0").count() == 0


def check_packing(rows, docs, limit, segments, loss):
    library = Tokenizer.from_file(BYTE)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    copies = {}
    for d in docs:
        copies.setdefault(d.doc_id, []).append(d)
    assert set(by_doc) == set(copies)
    for k, own in by_doc.items():
        ids = library.encode(text_of(copies[k][0]), add_special_tokens=False).ids + [1]
        for r in own:
            part = ids[r.start:r.start + r.length]
            assert len(part) == r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        cover = np.zeros(len(ids), int)
        for r in own:
            cover[r.start:r.start + r.length] += 1
        assert (cover == len(copies[k])).all()
    padding = total = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit and len(own) <= segments and sum(r.loss_tokens for r in own) <= loss
        total += at
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding, total


@pytest.mark.parametrize("limits", [(2048, 64, 2048), (64, 3, 64), (64, 64, 40), (16, 2, 5)])
def test_packing_limits(docs, limits):
    rows = packer.pack_documents(docs, tokens=limits[0], segments=limits[1], loss=limits[2]).collect()
    padding, _ = check_packing(rows, docs.collect(), *limits)
    assert padding == 0
    assert packer.pack_documents(docs.limit(0)).count() == 0


def test_queries_on_whole_table(spark):
    table = spark.read.parquet(f"{SMOKE}/documents.parquet").collect()
    padding, total = check_packing(queries.QUERIES["op6_packing"](spark, SMOKE).collect(), table,
                                   2048, 64, 2048)
    assert padding <= 0.01 * total
    library = Tokenizer.from_file(WORD)
    rows = {r.doc_id: r for r in queries.QUERIES["op1_bpe"](spark, SMOKE).collect()}
    files = {r.doc_id: r for r in queries.QUERIES["op7_token_files"](spark, SMOKE).collect()}
    byte, at = Tokenizer.from_file(BYTE), 0
    for d in sorted(table, key=lambda d: d.doc_id):
        ids = library.encode(text_of(d), add_special_tokens=False).ids
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        ids = byte.encode(text_of(d), add_special_tokens=False).ids + [0]
        f = files[d.doc_id]
        assert (f.start, f.n_tokens) == (at, len(ids))
        assert f.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
