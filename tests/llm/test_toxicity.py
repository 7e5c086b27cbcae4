import os
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import subword as S
from tidemark.llm import toxicity as T
from tidemark.llm import words as W
from tidemark.llm._session import Scratch, fitted, labelled_sample

BAD = ["blorgish", "vexnard", "krumptish"]


def rows(n, seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(800)]
    out = []
    for i in range(n):
        w = r.choices(vocab, k=r.randint(5, 120))
        bad = r.random() < 0.3
        if bad:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_held_out_rows_and_misspellings(spark):
    data = rows(1500, 3) + [(9001, "", 0), (9002, None, 0), (9003, "a bl0rgish man", 1), (9004, "so krumptishly vexxnard", 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i < 9000], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    assert len(got) == len(data)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(got[i].predicted, y) for i, _, y in data if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert got[9001].predicted == got[9002].predicted == 0 and got[9003].predicted == got[9004].predicted == 1


def test_held_out_labels_are_never_learnt(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in held)) for i in range(400)], "doc_id long, toxic int")
    model = T.learn(docs, labels)  # all that may be learnt is of one class
    assert not model.weight.any() and model.shift < 0


def test_long_labelled_texts_do_not_use_the_sample_up(spark):
    r = random.Random(4)
    data = rows(300, 5)
    long_ = [(10_000 + i, " ".join(r.choices("some words of long clean texts".split(), k=2000)), 0) for i in range(2000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data + long_], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data + long_], "doc_id long, toxic int")
    scratch = Scratch(spark, "test")
    own = labels.select("doc_id", F.col("toxic").alias("y"))
    sample, counts = labelled_sample(scratch, docs, own, 40, 4000)
    got = fitted(sample, 40, lambda rows: rows)
    assert [sum(y == c for _, _, y in got) for c in (0, 1)] == [40, 40] and counts[0] > 2000 and got == sorted(got)
    scratch.close()


def brute_measures(model, text):
    """One word and one n-gram at a time."""
    words = ["".join(x) for x in re.findall(r"[^ ]+", re.sub(r"([a-z])\1+", r"\1", "".join(chr(b) if b < 128 else chr(b) for b in S.FOLD[list(text.lower().encode())])))]
    logits = []
    for w in words:
        raw = (" " + w + " ").encode("latin-1")
        ids = []
        for n in S.SIZES:
            for i in range(len(raw) - n + 1):
                h = sum(int(W.BYTE[b]) * pow(W.BASE, j, 1 << 64) for j, b in enumerate(raw[i : i + n])) % (1 << 64)
                ids.append((h * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - S.BITS))
        logits.append(sum(float(model.table[i]) for i in ids) / max(1, len(ids)))
    if not words:
        return [T.FLOOR] * 3
    k = T.WINDOW
    windows = [sum(logits[max(0, min(i, len(words) - k)) : max(0, min(i, len(words) - k)) + k]) / k for i in range(len(words))]
    return [sum(logits) / max(k, len(words)) + model.bias, max(windows) + model.bias, max(logits) + model.bias]


def test_measures_equal_brute_force():
    model = T.Model(np.random.default_rng(3).normal(size=1 << S.BITS).astype(np.float32), 0.25, np.array([0.2, 0.3, 0.5]), -1.0)
    texts = ["", "a", "Hello  wörld, he110 mooon!", "one two three four five six seven", " x\ty\nz ", "ab " * 40 + "idiot"]
    got = model.measures(pa.array(texts))
    assert np.allclose(got, [brute_measures(model, t) for t in texts], atol=1e-4)
    assert np.allclose(model.scores(pa.array(texts)), [1 / (1 + np.exp(-(np.dot(m, model.weight) - 1))) for m in got])


def test_equal_models_in_every_process():
    code = "import hashlib, pickle; from tests.llm.test_toxicity import rows; from tidemark.llm import toxicity as T; d = rows(200, 1); m = T.train([t for _, t, _ in d], [y for _, _, y in d]); print(hashlib.md5(m.table.tobytes() + m.weight.tobytes() + pickle.dumps((m.bias, m.shift))).hexdigest())"
    run = lambda seed: subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": seed}, cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout
    assert run("1") == run("2") != ""


def test_long_clean_texts_stay_clean_and_toxic_phrases_count(spark):
    data = rows(1200, 8)
    model = T.train([t for _, t, _ in data], [y for _, _, y in data], 3.0)
    clean = [t for _, t, y in rows(400, 12) if not y]
    r = random.Random(2)
    vocab = sorted({w for t in clean for w in t.split()})
    long_ = [" ".join(r.choices(vocab, k=20_000)) for _ in range(5)]
    assert (model.scores(pa.array(long_)) < 0.5).all()
    assert (model.scores(pa.array([t + " vexnard" for t in long_])) >= 0.5).all()


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a", 2.0, 1), (1, "a", 2.0, 1), (None, None, None, None)], "doc_id long, text string, score double, y int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in T.toxicity(docs, none).collect()] == [0, 0, 0]
    one = spark.createDataFrame([(None, 1), (2, None), (1, 0)], "doc_id long, toxic int")
    assert [r.predicted for r in T.toxicity(docs, one).collect()] == [0, 0, 0]
    assert T.toxicity(docs.limit(0), one).collect() == []
    kept = T.score(docs, T.constant(1), keep=True)  # a column called score gives way, the others stay
    assert kept.columns == ["doc_id", "text", "y", "score"] and {round(r.score, 6) for r in kept.collect()} == {1.0}
    twice = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, toxic int")
    assert [r.predicted for r in T.toxicity(docs, twice).collect()] == [0, 0, 0]
