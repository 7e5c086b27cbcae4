"""Quality rules as a ledger of bits: each rule is evaluated once for each document, and policies only read the ledger.

A ledger row holds a document's measurements and one integer whose bit k says that rule k fails. A policy is a versioned mask of the
rules that reject; applying another policy, or asking what a policy would keep without one of its rules, is integer arithmetic on
the bits and never reads a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._session import chosen
from tidemark.llm.words import BYTE, COEF, chunks, hashes, mix, powers, sliced, spans

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rule:
    """``fails``: SQL over the measurements. A rule's bit is its place in the list; rules are only ever added at the end."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule("capitals", "n_letters >= 40 and 10 * n_upper > 7 * n_letters"),
    Rule("word_length", "n_words >= 10 and (word_chars < 2 * n_words or word_chars > 25 * n_words)"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rejects: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        names = [r.name for r in rules]
        return sum(1 << names.index(x) for x in self.rejects)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(r.name for r in RULES))


def measure(texts: pa.Array) -> np.ndarray:
    """One row of MEASURES for each text; equal lines and equal word windows are found by 64-bit hashes."""
    out = [np.zeros((0, len(MEASURES)), np.int64)]
    for _, data, offsets in chunks(texts):
        n = len(offsets) - 1
        start, end, row = spans(data, offsets)
        cell = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        chars = np.bincount(row, cell[end] - cell[start], minlength=n)
        totals = []
        for kind in (SYMBOLS[data], (data >= 65) & (data <= 90), ((data | 32) >= 97) & ((data | 32) <= 122)):
            c = np.concatenate([[0], np.cumsum(kind)])
            totals.append(c[offsets[1:]] - c[offsets[:-1]])
        words = np.bincount(row, minlength=n)
        h = hashes(data, start, end)
        repeat = np.zeros(len(h), bool)
        if len(h) >= 5:
            gram = mix(sum((h[j : len(h) - 4 + j] * COEF[j] for j in range(1, 5)), h[: len(h) - 4] * COEF[0]))
            at = np.flatnonzero(row[4:] == row[: len(h) - 4])
            order = at[np.lexsort((gram[at], row[at]))]
            same = (gram[order][1:] == gram[order][:-1]) & (row[order][1:] == row[order][:-1])
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            for j in range(5):
                repeat[j:] |= twice[: len(h) - j]
        # lines: cut at each newline and each text's start; those with a word count
        cut = np.union1d(np.flatnonzero(data == 10) + 1, offsets[:-1])
        cut = cut[cut < len(data)] if len(data) else cut[:0]
        line = np.searchsorted(cut, start, side="right") - 1
        used = np.unique(line)
        a = cut[used] if len(used) else np.zeros(0, np.int64)
        owner = np.searchsorted(offsets, a, side="right") - 1
        b = np.append(cut[1:], len(data))[used] if len(used) else a
        b = b - ((b > a) & (b <= len(data)) & (data[np.maximum(b - 1, 0)] == 10)) if len(used) else b
        up, down = powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
        key = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * COEF[6]) if len(used) else np.zeros(0, np.uint64)
        order = np.lexsort((key, owner))
        same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        lines = np.bincount(owner, minlength=n)
        again = np.bincount(owner[order][1:][same], minlength=n)
        out.append(np.stack([words, chars, totals[0], lines, again, np.bincount(row, repeat, minlength=n), totals[1], totals[2]], 1).astype(np.int64))
    return np.concatenate(out)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed``, the bits of the rules that fail, for every row. A null or empty text measures 0
    everywhere; null ids and repeated rows are rows like others; other columns are ignored; texts are read whole."""
    own = chosen(docs, id_col, text_col).toDF("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            m = measure(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[:, i]) for i in range(m.shape[1]))], names=["doc_id", *MEASURES])

    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES)
    bits = " + ".join(f"(case when {r.fails} then {1 << i}L else 0L end)" for i, r in enumerate(rules))
    return own.mapInArrow(run, schema).withColumn("failed", F.expr(bits))


def apply(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``rows`` of a ledger with kept and the policy's name and version."""
    return rows.select("*", (F.col("failed").bitwiseAND(policy.mask(rules)) == 0).alias("kept"), F.lit(f"{policy.name}:{policy.version}").alias("policy"))


def ablations(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule: documents that fail it, that the policy keeps, and that it would keep without the rule.

    The ledger shrinks to one row for each set of bits, at most 2**rules, before any rule is looked at.
    """
    mask = policy.mask(rules)
    sets = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    each = sets.select("n", "failed", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules)])).alias("r"))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    bit, failed = F.col("r.bit"), F.col("failed")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        count(failed.bitwiseAND(bit) != 0).alias("n_failed"),
        count(failed.bitwiseAND(F.lit(mask)) == 0).alias("n_kept"),
        count(failed.bitwiseAND(F.lit(mask)).bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"),
    )
