"""Byte tokens and rewriting against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from langmill.functions import text
from langmill.operators import byte_rules, byte_tokens


def greedy(tokens, rules):
    """Longest rule at each place; a byte without a rule passes through."""
    table = {tuple(k.split(" ")): v.split(" ") for k, v in rules.items()}
    longest = max(map(len, table), default=1)
    out, i = [], 0
    while i < len(tokens):
        for size in range(min(longest, len(tokens) - i), 0, -1):
            found = table.get(tuple(tokens[i:i + size]))
            if found:
                out += found
                i += size
                break
        else:
            out.append(tokens[i])
            i += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_rewrite_equals_greedy_search(spark, seed):
    rng = random.Random(seed)
    byte = lambda: f"{rng.randint(0x60, 0x64):02x}"
    rules = {" ".join(byte() for _ in range(rng.randint(1, 4))): " ".join(byte() for _ in range(rng.randint(1, 3))) for _ in range(25)}
    inputs = [[byte() for _ in range(rng.randint(0, 40))] for _ in range(200)]
    df = spark.createDataFrame([(i, "".join(tokens)) for i, tokens in enumerate(inputs)], "i int, h string")
    for r in df.select("i", byte_tokens.hex_tokens(byte_tokens.rewrite_hex(F.col("h"), rules)).alias("t")).collect():
        assert r.t == greedy(inputs[r.i], rules)


def test_prefix_rules_prefer_the_longest_complete_match(spark):
    rules = {"61": "01", "61 62": "02", "61 62 63 64": "03"}
    df = spark.createDataFrame([("6162636461626365",)], "h string")
    assert df.select(byte_tokens.rewrite_hex(F.col("h"), rules).alias("x")).first().x == "0302" + "63" + "65"


def test_round_trip_with_invertible_rules(spark):
    decompose, merge = {"c3 a4": "01 61", "c3 b6": "01 6f"}, {"01 61": "02", "74 68": "03", "74 68 65": "04"}
    texts = ["the äther", "öä", "", "plain 😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    tokens = byte_tokens.encode(F.col("t"), decompose, merge)
    assert [r.x for r in df.select(byte_tokens.decode(tokens, decompose, merge).alias("x")).collect()] == texts
    want = [greedy(greedy([f"{b:02x}" for b in t.encode()], decompose), merge) for t in texts]
    assert [r.x for r in df.select(tokens.alias("x")).collect()] == want
    plain = df.select(byte_tokens.decode(byte_tokens.encode(F.col("t"), {}, {}), {}, {}).alias("x")).collect()
    assert [r.x for r in plain] == texts


def test_decoding_leaves_out_stray_bytes(spark):
    rng = random.Random(1)
    pool = [0x41, 0xC3, 0xA4, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xC0, 0xF5, 0xFF, 0xE0, 0x9F, 0xF4, 0x90]
    cases = [bytes(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(i, [f"{b:02x}" for b in case]) for i, case in enumerate(cases)], "i int, t array<string>")
    for r in df.select("i", text.decode_tokens(F.col("t")).alias("x")).collect():
        assert r.x == cases[r.i].decode("utf-8", errors="ignore")


def test_ids(spark):
    df = spark.createDataFrame([(["61", "ff", "abc"], [4, 1], [])], "t array<string>, ended array<int>, none array<int>")
    row = df.select(
        text.token_ids(F.col("t")).alias("ids"), text.append_end(F.col("ended")).alias("ended"),
        text.append_end(F.col("none")).alias("none"), text.id_tokens(F.array(F.lit(3), F.lit(258))).alias("back"),
    ).first()
    assert row.ids == [0x61 + 3, 258, None] and row.ended == [4, 1] and row.none == [1] and row.back == ["00", "ff"]


def test_tokenise_pads_and_masks(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abcdef"), (3, None)], "id int, text string")
    got = {r.id: (r.input_ids, r.attention_mask) for r in byte_tokens.tokenise(df, max_length=4).collect()}
    assert got == {1: ([100, 101, 1, 0], [1, 1, 1, 0]), 2: ([100, 101, 102, 103], [1, 1, 1, 1])}
    free = {r.id: len(r.attention_mask) for r in byte_tokens.tokenise(df).collect()}
    assert free == {1: 3, 2: 7}


def rule_table(spark, rules):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules.items())], byte_rules.RULES)


@pytest.mark.parametrize("seed", range(3))
def test_rules_of_a_table_equal_greedy_search(spark, seed, monkeypatch):
    monkeypatch.setattr(byte_rules, "BLOCK", 100)
    rng = random.Random(seed)
    byte = lambda: f"{rng.randint(0x60, 0x63):02x}"
    rules = {" ".join(byte() for _ in range(rng.randint(1, 5))): " ".join(byte() for _ in range(rng.randint(0, 3))) for _ in range(30)}
    inputs = [[byte() for _ in range(rng.randint(0, 60))] for _ in range(300)] + [None, []]
    df = spark.createDataFrame([(i, None if x is None else bytes.fromhex("".join(x)).decode()) for i, x in enumerate(inputs)], "i int, t string")
    step = byte_rules.automaton(rule_table(spark, rules))
    for r in byte_rules.rewritten(df.repartition(4), "t", [step], "out").collect():
        assert (None if r.out is None else bytes(r.out)) == (None if inputs[r.i] is None else bytes.fromhex("".join(x for x in greedy(inputs[r.i], rules) if x)))


def test_rule_tables_round_trip(spark):
    decompose, merge = {"c3 a4": "01 61", "c3 b6": "01 6f"}, {"01 61": "02", "74 68": "03", "74 68 65": "04"}
    tables = rule_table(spark, decompose), rule_table(spark, merge)
    texts = ["the äther", "öä", "", "plain 😀", None, "th" * 700_000, "the", "the"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, t string, _row string")
    rows = byte_rules.decode(byte_rules.encode(df, "t", *tables), "bytes", *tables).collect()
    assert sorted((r.i, r.decoded) for r in rows) == list(enumerate(texts))
    want = {i: greedy(greedy([f"{b:02x}" for b in t.encode()], decompose), merge) for i, t in enumerate(texts[:4])}
    assert {r.i: [f"{b:02x}" for b in r.bytes] for r in rows if r.i < 4} == want
    assert byte_rules.encode(df.limit(0), "t", *tables).count() == 0


def test_later_rules_win_and_stray_bytes_are_left_out(spark):
    rules = spark.createDataFrame([(2, "61", "7a"), (1, "61", "79"), (3, None, "00"), (4, "62", None)], byte_rules.RULES)
    df = spark.createDataFrame([("aab",)], "t string")
    assert bytes(byte_rules.rewritten(df, "t", [byte_rules.automaton(rules)], "x").first().x) == b"zzb"
    nothing = spark.createDataFrame([], byte_rules.RULES)
    stray = spark.createDataFrame([(bytes([0xFF, 0x61, 0xC3]),)], "b binary")
    assert byte_rules.decode(stray, "b", nothing, nothing).first().decoded == "a"


def test_cost_does_not_grow_with_the_rules():
    """A hundred thousand rules: the steps down the tree are those of the bytes that match."""
    rng = random.Random(5)
    rules = {bytes(rng.randrange(256) for _ in range(rng.randint(3, 6))): b"!" for _ in range(100_000)}
    data = np.frombuffer(bytes(rng.randrange(256) for _ in range(200_000)), dtype=np.uint8)
    visited = []

    class Counting(byte_rules.Automaton):
        def step(self, node, byte):
            visited.append(len(node))
            return super().step(node, byte)

    own = Counting(list(rules.items()))
    visited.clear()
    out, cuts = own.rewrite(data, np.array([0, len(data)]))
    assert sum(visited) < 5 * len(data) and len(out) == cuts[-1] <= len(data)
