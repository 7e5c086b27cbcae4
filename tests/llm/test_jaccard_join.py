import random

from tests.llm.brute import jaccard
from tidemark.llm import jaccard_join as J


def texts(seed, copies=60, plain=40):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    passage = r.choices(vocab, k=40)
    rows, base = [], [r.choices(vocab, k=r.randint(30, 160)) for _ in range(6)]
    for b in base:
        for _ in range(copies // 6):
            w = list(b)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append(" ".join(w[: len(w) - r.randint(0, 12)]))
    for _ in range(plain):
        w = r.choices(vocab, k=r.randint(1, 90))
        rows.append(" ".join(w + passage if r.random() < 0.6 else w))
    rows += ["", "a b", "A b", "a  b c", "one two three four five", "ONE two\tthree\nfour five", rows[0].upper(), rows[0]]
    r.shuffle(rows)
    return list(enumerate(rows, 1))


def test_equal_to_brute_force(spark, monkeypatch):
    for seed, long_, block in ((1, 16, 256), (2, 3, 4), (3, 2, 8)):
        monkeypatch.setattr(J, "LONG", long_)
        monkeypatch.setattr(J, "BLOCK_TOKENS", block * 40)
        monkeypatch.setattr(J, "BLOCK_ENTRIES", block)
        monkeypatch.setattr(J, "FEW_BLOCKS", 64 if seed == 1 else 1)
        monkeypatch.setattr(J, "MOST_TOKENS", 2_400_000 if long_ == 16 else 50 * block)
        monkeypatch.setattr(J, "DEAL_TOKENS", 800_000 if long_ == 16 else 20 * block)
        rows = texts(seed)
        got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == jaccard(rows)


def test_one_large_group_of_near_copies(spark):
    r = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == jaccard(rows)


def test_nulls_repeats_empty_and_clashing_columns(spark):
    t = " ".join(f"q{i}" for i in range(50))
    rows = [(1, t, 7, 1), (1, t, 7, 1), (None, t, 7, 1), (5, None, None, 1), (6, "", 1, 1), (9, t + " more", 2, None), (9, "other words stand here now", 2, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long, token long")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.jaccard_components(df).collect())
    assert got == sorted([("1", 46, "1"), ("1", 46, "1"), ("None", 46, "None"), ("5", 0, "5"), ("6", 0, "6"), ("9", 47, "1"), ("9", 1, "9")])
    assert J.jaccard_components(df.limit(0)).collect() == []


def test_very_long_text(spark):
    w = [f"z{i}" for i in range(300_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:-100])), (3, " ".join(w[:100_000]))]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}
