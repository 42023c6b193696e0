"""Byte-level BPE against the tiktoken library, and back."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken

from langmill.llm import bpe, queries, spans


def library(name="byte_bpe_50k.tiktoken"):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(bpe.default_path(), bpe.default_pattern())


def ids_of(coder, texts):
    found = []
    for *_, ids, cut in coder.encode(pa.array(texts, pa.string())):
        found += [x.tolist() for x in np.split(ids, cut[1:-1])]
    return found


def same(coder, texts):
    own = library()
    got = ids_of(coder, texts)
    assert [g for g, t in zip(got, texts) if g != own.encode_ordinary(t or "")] == []
    assert all(coder.decode(np.array(g, dtype=np.int32)).tobytes() == (t or "").encode() for g, t in zip(got, texts))


def test_pieces_of_all_kinds(coder):
    draw = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", " ", "　", "'s", "'", "'re", "a", "bc", "é", "日本", "1", "²",
             "!", "?!", "_", "՘", "́", "\U0001f600", "<|endoftext|>", "\x00", "Ⅷ", "࢏", "\U0001246f", "xxxxx", ""]
    same(coder, ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(8000)])


def test_any_characters(coder):
    draw = random.Random(2)
    texts = ["".join(chr(draw.choice([draw.randrange(32, 0x3000), draw.randrange(0x110000)])) for _ in range(20)) for _ in range(2000)]
    same(coder, [t.encode("utf-8", "ignore").decode() for t in texts])


def test_long_pieces(coder):
    draw = random.Random(3)
    letters = ["abcdefgh", "etaoinsr", "ab", "-=", [chr(c) for c in range(0x4E00, 0x9000)]]
    same(coder, ["a" * n for n in (*range(126, 134), 5001)] + ["ab" * 3000, " " * 4000, "\n" * 3001 + "x", "abc" * 2000])
    same(coder, ["".join(draw.choice(some) for _ in range(draw.choice([129, 200, 9001]))) for some in letters for _ in range(6)])


def test_long_rows_equal_matrix_rows(coder):
    """Both ways to merge, on ranks where a merged pair may have a lower rank than the pairs it came from."""
    draw = random.Random(4)
    own = bpe.Coder.__new__(bpe.Coder)
    for _ in range(40):
        pairs = {(draw.randrange(9), draw.randrange(9)) for _ in range(25)}
        ranks = draw.sample(range(3, 9 + 40), len(pairs))  # ids of results below those of their parts occur
        left, right = np.array(sorted(pairs)).T
        own.pairs = bpe.PairTable(left, right, np.array(ranks))
        rows = np.array([[draw.randrange(9) for _ in range(40)] for _ in range(50)], dtype=np.int32)
        merge = dict(zip(zip(left.tolist(), right.tolist()), ranks))
        for row, got in zip(rows, own.matrix(rows.copy())):
            plain = row.tolist()
            while found := [(merge[p], i) for i, p in enumerate(zip(plain, plain[1:])) if p in merge]:
                rank, i = min(found)
                plain[i : i + 2] = [rank]
                if len(plain) > 60:
                    break
            assert got.tolist() == plain == own.long(row.copy()).tolist()


def test_worker_table_starts_anew(coder, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 100)
    same(coder, [f"word{i} and more words {i}" for i in range(300)])
    monkeypatch.setattr(spans, "BLOCK", 64)
    for *_, ids, cut in coder.encode(pa.array(["kept " * 40, "kept", None])):
        assert len(cut) > 1


def test_equal_fingerprints(coder, monkeypatch):
    """Segments are told apart by their bytes even if all fingerprints agree."""
    monkeypatch.setattr(spans.Prints, "of", lambda self, start, end: np.zeros(len(start), dtype=np.uint64))
    same(coder, ["one two three two one", "two", ""])


@pytest.mark.parametrize("more", ["", "id ids n_tokens decoded _row"])
def test_query(spark, tmp_path, more):
    own = library()
    rows = [(1, "Plain text, it's 42!"), (2, None), (3, ""), (None, "a null id"), (5, "tie"), (5, "tie"), (6, " \n "), (7, "<|endoftext|>"),
            (8, "very long " * 300_000), (9, "x" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.selectExpr("*", *[f"'x' AS {name}" for name in more.split()]).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_byte_bpe(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for i, text in rows:
        ids = own.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_byte_bpe(spark, str(tmp_path)).count() == 0


def test_other_ranks():
    name = "byte_bpe_multi_50k.tiktoken"
    own, texts = library(name), ["Größe und Maß", "日本語のテキスト", "naïve café 123"]
    coder = bpe.Coder(public_tokenizers.path(name), bpe.default_pattern())
    assert ids_of(coder, texts) == [own.encode_ordinary(t) for t in texts]
