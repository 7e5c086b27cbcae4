"""Best-fit decreasing packing of tokenised documents into sequences of at most ``max_len`` tokens.

Best-fit decreasing looks only at lengths, and lengths are whole numbers up to ``max_len``. So the packing itself is planned on the
driver from the ``max_len`` counts of pieces by length, however many pieces there are: a segment tree over the remaining
capacities finds the tightest open bin in O(log max_len), and equal pieces are placed a run at a time. The plan has a few runs for
each length. On the executors every piece finds its run by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._session import Scratch, chosen
from tidemark.llm.words import sliced

BROADCAST_ROWS = 500_000
_encoders: dict = {}


class CapacityTree:
    """Segment tree over capacities 0..max_len; a leaf is set while bins with just that much room are open."""

    def __init__(self, max_len: int):
        self.size = 1 << max_len.bit_length()
        self.tree = bytearray(2 * self.size)
        self.bins: list[deque] = [deque() for _ in range(max_len + 1)]

    def put(self, room: int, first: int, count: int, front: bool = False) -> None:
        if room and count:
            (self.bins[room].appendleft if front else self.bins[room].append)((first, count))
            i = room + self.size
            while i and not self.tree[i]:
                self.tree[i] = 1
                i >>= 1

    def take(self, room: int) -> tuple[int, int]:
        out = self.bins[room].popleft()
        if not self.bins[room]:
            i = room + self.size
            self.tree[i] = 0
            i >>= 1
            while i and not (self.tree[2 * i] or self.tree[2 * i + 1]):
                self.tree[i] = 0
                i >>= 1
        return out

    def tightest(self, length: int) -> int:
        """The least capacity of an open bin that is at least ``length``, 0 if there is none."""
        i = length + self.size
        if self.tree[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return 0


def plan(counts: dict[int, int], max_len: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces a sequence, offset) of best-fit decreasing over ``counts``."""
    tree, runs, opened = CapacityTree(max_len), [], 0
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room:
                first, bins = tree.take(room)
            else:
                room, first, bins = max_len, opened, -(-left // (max_len // length))
                opened += bins
            each = room // length
            full = min(bins, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, max_len - room))
                tree.put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < bins and left:  # fewer than fill one bin
                runs.append((length, rank, left, first + full, left, max_len - room))
                tree.put(room - left * length, first + full, 1)
                tree.put(room, first + full + 1, bins - full - 1, front=True)
                left = 0
            else:
                tree.put(room, first + full, bins - full, front=True)
    return runs


def encoder(path: str, ranks: str | None):
    """text -> uint32 ids by the tokenizer file ``path``. ``ranks``: the same vocabulary for tiktoken, which gives the same ids
    several times faster; texts that hold a special token's string still go to ``path``."""
    if (path, ranks) not in _encoders:
        loaded = []

        def plain(text: str) -> np.ndarray:
            if not loaded:  # large, and with ranks hardly ever wanted
                from tokenizers import Tokenizer

                loaded.append(Tokenizer.from_file(path))
            return np.array(loaded[0].encode(text, add_special_tokens=False).ids, np.uint32)

        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            special = [t["content"] for t in json.loads(Path(path).read_text())["added_tokens"]]
            merged = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks).read_bytes().splitlines())}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merged, special_tokens={})
            _encoders[path, ranks] = lambda text: plain(text) if any(s in text for s in special) else np.array(fast.encode_ordinary(text), np.uint32)
        else:
            _encoders[path, ranks] = plain
    return _encoders[path, ranks]


def _tokenise(path: str, ranks: str | None, end_id: int, max_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, ranks), TaskContext.get().partitionId()
        seen = np.zeros(max_len + 1, np.int64)
        for some in sliced(batches, 256):
            out: dict[str, list] = {c: [] for c in ("row", "piece", "start", "length", "ids", "rank")}
            for row, text in enumerate(some.column(0).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % max_len + 1
                cuts = [0, *range(first, len(ids) + 1, max_len)]
                for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    for c, v in (("row", row), ("piece", piece), ("start", a), ("length", b - a), ("ids", ids[a:b].tobytes()), ("rank", int(seen[b - a]))):
                        out[c].append(v)
                    seen[b - a] += 1
            rows = pa.array(out["row"], pa.int64())
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(some.column(i).take(rows) for i in range(1, some.num_columns)), *(pa.array(out[c], t) for c, t in zip(("piece", "start", "length", "ids", "rank"), kinds, strict=True)), pa.array([part] * len(rows), pa.int32())],
                names=[*some.schema.names[1:], "piece", "start", "length", "ids", "rank", "part"],
            )

    return run


def tokenise(docs: DataFrame, path: str, end_id: int, max_len: int = 1024, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the documents: doc_id, piece, start, length, ids (little-endian uint32), and (part, rank), the piece's place among
    those of its length within its task. A document is its ids, then ``end_id``; longer ones are cut so that all but the first
    piece have ``max_len`` ids. A null text counts as empty and makes one piece of ``end_id``. Extra columns are ignored."""
    own = chosen(docs, text_col, id_col).toDF("text", "doc_id")
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary, rank long, part int"
    return own.mapInArrow(_tokenise(path, ranks, end_id, max_len), schema)


def pack(pieces: DataFrame, max_len: int = 1024) -> DataFrame:
    """``pieces`` (a written table: it is read three times) with sequence_id and offset in place of (part, rank).

    Nulls, repeats and ties don't matter: each row is one piece, equal lengths are placed by (part, rank). An empty table gives
    an empty result.
    """
    spark = pieces.sparkSession
    by = pieces.groupBy("length", "part").count()
    counts = {r["length"]: r["n"] for r in by.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # max_len rows at most
    runs = plan(counts, max_len)
    table = spark.createDataFrame(runs, "length long, first long, pieces long, bin long, each long, at long")
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = by.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    base = F.broadcast(base) if by.count() <= BROADCAST_ROWS else base
    ranked = pieces.join(base, ["length", "part"]).withColumn("k", F.col("base") + F.col("rank"))
    # The runs of a length are disjoint: one matches. Their number depends on max_len alone.
    placed = ranked.join(F.broadcast(table), "length").where("k >= first and k < first + pieces").withColumn("k", F.col("k") - F.col("first"))
    keep = [F.col(f"`{c}`") for c in pieces.columns if c not in ("part", "rank")]
    return placed.select(*keep, F.expr("bin + k div each").alias("sequence_id"), F.expr("at + (k % each) * length").alias("offset"))


def pack_documents(docs: DataFrame, path: str, end_id: int, max_len: int = 1024, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs``: doc_id, piece, start, length, sequence_id, offset and the ids, or with ``digest`` only
    their crc32 (then the ids are never stored)."""
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = tokenise(docs, path, end_id, max_len, ranks, id_col, text_col)
    if digest:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(scratch.keep(pieces, "pieces"), max_len)
