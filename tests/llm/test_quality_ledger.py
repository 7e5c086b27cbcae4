import random

import pyarrow as pa

from tests.llm.brute import quality
from tidemark.llm import quality_ledger as Q


def texts():
    r = random.Random(4)
    out = [None, "", " ", "\n\n", "one", "a b c d e a b c d e", "x\nx\nx", "x \nx\n\nx ", "é\té ß #*$%&|<>", "A\nA", "\nA\n\nA\n", "last line\nlast line"]
    for _ in range(300):
        vocab = ["the", "of", "é#", "ZZ", "b|", "word"][: r.randint(1, 6)]
        out.append("".join(r.choice(vocab) + r.choice([" ", "\n", "  ", "\t", " \n"]) for _ in range(r.randint(0, 40))))
    return out


def test_measures_equal_brute_force():
    t = texts()
    got = Q.measure(pa.array(t))
    for k, text in enumerate(t):
        m = dict(zip(Q.MEASURES, got[k], strict=True))
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == quality(text)[:5], repr(text)


def test_ledger_policies_and_ablations(spark):
    t = texts() + ["good words " + " ".join(f"word{i}" for i in range(30)), "LOUD " * 3 + " ".join(f"WORD{i}X" for i in range(40))]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    rows = Q.ledger(df)
    base = {r.doc_id: r.kept for r in Q.apply(rows, Q.BASE).collect()}
    assert base == {i: not quality(x)[5] for i, x in enumerate(t)}
    every = {r.doc_id: r for r in Q.apply(rows, Q.STANDARD).collect()}
    assert every[len(t) - 2].kept and not every[len(t) - 1].kept
    for a in Q.ablations(rows, Q.STANDARD).collect():
        bit = 1 << [r.name for r in Q.RULES].index(a.rule)
        assert a.n_failed == sum(bool(r.failed & bit) for r in every.values())
        assert a.n_kept == sum(r.failed == 0 for r in every.values())
        assert a.n_kept_without == sum(r.failed & ~bit == 0 for r in every.values())


def test_long_text_and_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    df = spark.createDataFrame([(None, long, 1), (1, None, None), (1, None, None)], "doc_id long, text string, failed int")
    rows = {str(r.doc_id): r for r in Q.ledger(df).collect()}
    assert rows["None"].n_words == 400_000 and rows["None"].n_repeat_words == 400_000 and rows["1"].n_words == 0
    assert Q.ledger(df.limit(0)).collect() == []
