import random
import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.brute import best_fit_decreasing
from tidemark.llm import best_fit as B

PATH, RANKS = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("seed", range(40))
def test_plan_opens_as_many_bins_as_best_fit_decreasing(seed):
    r = random.Random(seed)
    room = r.choice([10, 16, 64, 100])
    lengths = [r.randint(1, room) if r.random() < 0.5 else r.randint(1, max(1, room // 3)) for _ in range(r.randint(0, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    fill, placed = {}, {n: 0 for n in counts}
    for length, first, pieces, bin0, each, at in B.plan(counts, room):
        assert first == placed[length]
        placed[length] += pieces
        for k in range(pieces):
            fill.setdefault(bin0 + k // each, []).append((at + k % each * length, length))
    assert placed == counts
    assert len(fill) == best_fit_decreasing(lengths, room)
    for parts in fill.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= room


def check(rows, docs, room, end_id):
    t = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [end_id]
        own = sorted(by_doc.pop(doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == room for r in own[1:]) and own[0].length <= room
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for parts in by_seq.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= room
    assert len(by_seq) == best_fit_decreasing([r.length for r in rows], room)


def test_packing_of_texts(spark):
    r = random.Random(5)
    docs = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, "it's  spaced\n\n\tout é\U0001f600 1234567"), (5, "word " * 3000)]
    docs += [(i, " ".join(r.choice(["the", "naïve", "über", "x1", "..."]) for _ in range(r.randint(0, 60)))) for i in range(6, 150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    check(B.pack_documents(df, PATH, 2, 64, RANKS, digest=True).collect(), docs, 64, 2)
    whole = B.pack_documents(df, PATH, 2, 64).collect()
    ids = [x for r in sorted((r for r in whole if r.doc_id == 3), key=lambda r: r.piece) for x in struct.unpack(f"<{r.length}I", r.ids)]
    assert ids == Tokenizer.from_file(PATH).encode("a <|endoftext|> b", add_special_tokens=False).ids + [2]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "x", 1, 1), (1, "x", 2, 2), (1, "x", 2, 2)], "doc_id long, text string, piece int, length long")
    rows = B.pack_documents(df, PATH, 2, 64, RANKS, digest=True).collect()
    assert len(rows) == 3 and {r.sequence_id for r in rows} == {0} and sorted(r.offset for r in rows) == [0, 2, 4]
    assert B.pack_documents(df.limit(0), PATH, 2, 64, RANKS).collect() == []
