from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline as P
from tests.llm import brute
from tests.llm.test_best_fit import check

DATA = Path("/root/testdata/sf0.001")


def check_places(rows, room):
    """Sequences without gaps, none longer than ``room``."""
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= room


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_every_stage_on_the_smallest_tables(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), []
    want = docs.schema.names
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.columns == want, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r.text for r in docs.collect()})
        assert name == "mixing" or docs.count() == len(kept[-1]), name  # before mixing no row is repeated
    first, groups, cut, mixed = kept
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    every = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    clean = [i for i in every if labels.get(i) == 0]
    assert sum(i in first for i in clean) >= 0.97 * len(clean)
    assert groups.keys() == {c for _, c, _ in brute.jaccard(list(first.items())).values()}
    assert cut.keys() == groups.keys() and not any(s[3] in ("assign", "access", "hex") for t in cut.values() for s in brute.secrets(t))
    assert {i for i in cut if cut[i] != groups[i]} >= {i for i in groups if brute.secrets(groups[i])}
    assert {i: groups[i] for i in groups if "[SECRET]" not in cut[i]} == {i: cut[i] for i in cut if "[SECRET]" not in cut[i]}
    assert mixed == cut
    copies = Counter((r.doc_id, r.text) for r in docs.collect())
    assert copies.keys() == set(cut.items()) and max(copies.values()) <= P.MOST_COPIES
    rows = P.STAGES[-1][1](spark, docs, str(DATA)).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter({i: n for (i, _), n in copies.items()})
    check_places(rows, 1024)
    once = spark.read.parquet(str(tmp_path / "mixing")).dropDuplicates(["doc_id"])
    check(P.STAGES[-1][1](spark, once, str(DATA)).collect(), [(r.doc_id, r.text) for r in once.collect()], 1024, 2)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_run_is_its_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        stage(spark, docs, str(DATA)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    digest = ("doc_id", "piece", "start", "length", "ids_crc32")
    want = Counter(map(tuple, P.STAGES[-1][1](spark, docs, str(DATA)).select(*digest).collect()))
    rows = P.run(spark, str(DATA)).collect()
    assert Counter(tuple(r[c] for c in digest) for r in rows) == want
    check_places(rows, 1024)


def test_repeated_ids_are_dropped_by_their_own_text(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, one), (2, one), (2, two), (3, three), (3, three), (4, three), (5, ""), (5, ""), (None, one), (None, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, one), (2, two), (3, three), (5, ""), (5, ""), (None, one), (None, one)]
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted((str(i), t) for i, t in want)


def test_repeated_rows_by_their_own_text_and_no_labels(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words), (9, words + " more"), (9, "other words stand here now"), (7, "x y z"), (7, "x y z")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.one_of_each_group(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, words), (9, "other words stand here now"), (7, "x y z")])
    for labels in ([], [(i, 1, 0) for i in range(5)]):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        assert sorted(map(str, P.mixed(spark, docs, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))
        assert sorted(map(str, P.without_toxic(spark, docs, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))


def test_odd_documents(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "token=abcdefgh and words", "en", "s", 24), (3, "token=abcdefgh and words", "en", "s", 24), (4, "w " * 50_000, "en", None, 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        if n < 4:
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            assert docs.count() >= 6, name
        else:
            assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, None}
