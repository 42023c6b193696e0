"""The Merkle manifest against a plain tree over lists."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from langmill.llm import merkle, queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, at):
    found = []
    for level in levels[:-1]:
        first = at // 3 * 3
        found.append((level[first:at], level[at + 1 : first + 3]))
        at //= 3
    return found


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in order])
    found = []
    for k, s in enumerate(order):
        for at, row in enumerate(groups[s]):
            steps = path(trees[s], at) + path(top, k)
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf((*row[:4], text))
            for left, right in steps:
                node = digest(*left, node, *right)
            proof = digest(*[x for left, right in steps for x in (*left, *right)])
            found.append((row[0], trees[s][0][at], trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return found


def spark_rows(spark, tmp_path, rows, more=""):
    docs = spark.createDataFrame(rows, SCHEMA)
    if more:  # a column with the name of one the operator makes itself
        docs = docs.selectExpr("*", *[f"'x' AS {name}" for name in more.split()])
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_merkle_manifest(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in found.collect()]


def same(got, want):
    key = lambda r: tuple(map(str, r))
    return sorted(got, key=key) == sorted(want, key=key)


HOT = [(i % 500, "hot" if i % 3 else [None, "", "b", "é", "a b"][i % 5], "en" if i % 2 else None, i if i % 7 else None,
        [None, "", "x\ny", "é\n", "\n" * 3000 + "long " * 30_000][i % 5 if i % 500 < 495 else 2]) for i in range(1500)]
ODD = [(None, "hot", "en", 1, "a\nb"), (None, "hot", "en", 1, "a\nb"), (7, "hot", "en", 1, "tie"), (7, "hot", "en", 1, "tie"), (-5, None, None, None, None)]


@pytest.mark.parametrize("rows", [HOT + ODD, ODD[:1], [], ODD])
def test_manifest(spark, tmp_path, rows):
    assert same(spark_rows(spark, tmp_path, rows, "" if len(rows) > 9 else "_row pos g block item hash later"), plain(rows))


def test_rounds(spark, tmp_path, monkeypatch):
    """Blocks of nine leaves: several rounds for a source, and for the tree of 40 sources."""
    monkeypatch.setattr(merkle, "DEPTH", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = [(i, f"s{i % 40}" if i > 200 else "hot", "en", i, f"t{i}\n") for i in range(400)]
    assert same(spark_rows(spark, tmp_path, rows), plain(rows))


def test_crc_parity(spark):
    """The tampered half is chosen by the unsigned checksum of the decimal id."""
    got = spark.range(100).selectExpr("id", "crc32(cast(id AS string)) AS c").collect()
    assert all(r.c == zlib.crc32(str(r.id).encode()) for r in got)
