"""Byte-token corpora, with greedy longest-match rewriting of byte sequences by a rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langmill.functions import text as text_fn


def reverse_rules(rules: dict[str, str]) -> dict[str, str]:
    """Rules in the other direction; of two rules with one target the later wins."""
    return {target: source for source, target in rules.items()}


def _alternation(tree: dict) -> str:
    """Regex for a prefix tree of byte sequences that prefers the longest match."""
    branches = []
    for byte, child in sorted(tree["next"].items()):
        tail = _alternation(child) if child["next"] else ""
        if tail and child["end"]:
            tail = f"(?:{tail})?"
        elif tail:
            tail = f"(?:{tail})"
        branches.append(byte + tail)
    return "|".join(branches)


def rule_pattern(rules: dict[str, str]) -> str:
    """Pattern over hex digits that cuts a text into rule sources and the bytes between them."""
    root: dict = {"next": {}, "end": False}
    for source in rules:
        node = root
        for byte in source.split(" "):
            node = node["next"].setdefault(byte, {"next": {}, "end": False})
        node["end"] = True
    alternatives = _alternation(root)
    # Bytes where no rule starts are cut in runs, so that most of a text is a few long pieces. The bound
    # keeps the regex engine's stack flat on long texts.
    return f"({alternatives}|(?:(?!{alternatives})..){{1,64}}+)" if alternatives else "(..)"


def rewrite_hex(digits: Column, rules: dict[str, str]) -> Column:
    """Hex digits of a text with every longest rule source replaced; other bytes pass through.

    The cut happens in one regex pass of the JVM. Since each piece is a whole number of bytes and
    pieces are adjacent, the match never slips by half a byte.
    """
    if not rules:
        return digits
    pieces = F.regexp_extract_all(digits, F.lit(rule_pattern(rules)), F.lit(1))
    table = F.map_from_arrays(
        F.array(*[F.lit(k.replace(" ", "")) for k in rules]), F.array(*[F.lit(v.replace(" ", "")) for v in rules.values()])
    )
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")


def hex_tokens(digits: Column) -> Column:
    return F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))


def encode(text: Column, decompose: dict[str, str], merge: dict[str, str]) -> Column:
    """Text to byte tokens: decompose, then merge."""
    return hex_tokens(rewrite_hex(rewrite_hex(text_fn.hex_bytes(text), decompose), merge))


def decode(tokens: Column, decompose: dict[str, str], merge: dict[str, str]) -> Column:
    """Byte tokens to text: undo the merge, then the decomposition; stray bytes are left out."""
    digits = rewrite_hex(rewrite_hex(F.array_join(tokens, ""), reverse_rules(merge)), reverse_rules(decompose))
    return text_fn.decode_tokens(hex_tokens(digits))


def tokenise(
    corpus: DataFrame, text: str = "text", decompose: dict[str, str] | None = None, merge: dict[str, str] | None = None,
    max_length: int | None = None,
) -> DataFrame:
    """Columns ``input_ids`` and ``attention_mask``; rows without text are dropped.

    Store the result with ``write.parquet`` to tokenise a corpus once.
    """
    tokens = encode(F.col(text), decompose or {}, merge or {})
    present = corpus.where(F.col(text).isNotNull())
    result = present.withColumn("input_ids", text_fn.append_end(text_fn.token_ids(tokens)))
    if max_length is None:
        return result.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    masked = result.withColumn("attention_mask", text_fn.attention_mask(F.col("input_ids"), max_length))
    return masked.withColumn("input_ids", text_fn.pad_ids(F.col("input_ids"), max_length))
