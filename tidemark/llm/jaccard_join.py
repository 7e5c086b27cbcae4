"""Exact self-join of documents on the Jaccard similarity of their word n-gram sets, and the components of its links.

The plan follows set-relation skipping over an inverted index:

1. Equal sets fall together first; one node stands for all its copies.
2. The index holds, of each node, the lowest ``n - ceil(t n) + 1`` shingle hashes, its *low* part: two linked sets always
   share one of them. Some more follow, so that passages of many documents can be told from the rest. Tokens of one node only are dropped in the pass that builds the lists.
3. Each entry has a position: the low tokens before it that occur in few nodes. If the first token that two sets share stands at
   position i of R, at most n(R) - i tokens can be common, so entries, pairs and whole blocks of entries whose bound is under the
   needed overlap are skipped. Tokens in more than ``LONG`` nodes come last, so passages that many documents share make no pairs.
4. Long lists with (nearly) the same members are answered together, as the family of their pivot, in cells of two blocks. In a cell
   the answers of one set come from those of another: only the lists of the tokens in which the two differ are read.
   Links that join nothing new are counted but not returned, so a group of near copies gives about as many rows as members.
5. Pairs of short lists are verified on both whole sets. Components come from contraction rounds over the links.

All steps are shuffles by token, node, block or cell; nothing about all documents reaches the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm._session import Scratch, chosen, join_uneven, only
from tidemark.llm.words import COEF, mix, shingle_sets, sliced

LONG = 3  # a list with more nodes is long: its pairs are found through families and blocks
BLOCK_TOKENS = 200_000  # of whole sets in one block of a cell, or more if one set alone has more
BLOCK_ENTRIES = 1024
FEW_BLOCKS = 64  # so many cells of one family may be one task's; beyond that they are dealt out, with the same result
MARKS = 16
TOKENS_A_BUCKET = 400_000
MOST_TOKENS = 1_600_000  # held of one bucket; a token of very many nodes makes larger buckets, which are read in parts
DEAL_TOKENS = 500_000


def need(a: np.ndarray, b: np.ndarray, pct: int) -> np.ndarray:
    """The least overlap at which 100 * overlap >= pct * union: ceil(pct (a + b) / (100 + pct))."""
    return -((-pct * (a.astype(np.int64) + b.astype(np.int64))) // (100 + pct))


def low_count(n: int, pct: int) -> int:
    return min(n, n - -(-pct * n // 100) + 1 + n // 20 + min(n // 8, 24))


def node_of(s: np.ndarray) -> int:
    """The 64-bit name of a set, the same for equal sets; two of N different sets share one with a chance of about N**2 / 2**65."""
    total = mix(s * COEF[1]).sum(dtype=np.uint64, keepdims=True) + np.array([len(s)], np.uint64) * COEF[2]
    return int(mix(total).view(np.int64)[0])


def _sets(pct: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, node, low, marks = [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                node.append(node_of(s))
                own = s[: low_count(len(s), pct)]
                low.append(own.tobytes())
                at = -(-np.arange(1, MARKS + 1) * (len(own) - 1) // MARKS)
                marks.append((own[at] ^ np.uint64(1 << 63)).view(np.int64) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(low, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "n", "node", "low", "marks"])

    return run


def _deal(buckets: int):
    """Low tokens of runs of nodes with about DEAL_TOKENS tokens, packed into one row for each bucket of hashes that they meet."""

    def packed(parts: list[tuple]) -> pa.RecordBatch:
        lows = [np.frombuffer(x, np.uint64) for _, _, low in parts for x in low]
        nodes, ns = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        size = np.array([len(x) for x in lows], np.int64)
        token = np.concatenate(lows)
        row = np.repeat(np.arange(len(lows)), size)
        pos = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
        last = np.array([x[-1] if len(x) else 0 for x in lows], np.uint64) ^ np.uint64(1 << 63)  # signed order
        bucket = ((token >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        met, begin = np.unique(bucket[order], return_index=True)
        out = []
        for b, own in zip(met.tolist(), np.split(order, begin[1:]), strict=True):
            used, idx = np.unique(row[own], return_inverse=True)
            wide = pos[own].max() >= 65536
            out.append((b, token[own].tobytes(), idx.astype(np.uint16).tobytes(), pos[own].astype(np.uint32 if wide else np.uint16).tobytes(), nodes[used].tobytes(), ns[used].tobytes(), last[used].tobytes()))
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = tokens = 0
        for part in sliced(batches, 256):
            low = part.column(2).to_pylist()
            held.append((np.array(part.column(0)), np.array(part.column(1)).astype(np.uint32), low))
            rows, tokens = rows + len(low), tokens + sum(map(len, low)) // 8
            if tokens >= DEAL_TOKENS or rows > 60_000:
                yield packed(held)
                held, rows, tokens = [], 0, 0
        if tokens:
            yield packed(held)

    return run


DEALT = ["bucket", "token", "idx", "pos", "nodes", "ns", "last"]
DEALT_SCHEMA = "bucket int, token binary, idx binary, pos binary, nodes binary, ns binary, last binary"
POSTING = "token long, node long, n int, pos int, last long, df int"


def _postings(most: int):
    """Lists of two nodes or more. Rows come sorted by bucket; one bucket, or a part of it with ``most`` tokens, is held at a time. Of a
    bucket that is read in parts all entries come out, with df 0, to be counted by token afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            if not held:
                return
            token = np.concatenate([np.frombuffer(r[1], np.uint64) for r in held])
            size = [len(r[2]) // 2 for r in held]
            idx = np.concatenate([np.frombuffer(r[2], np.uint16) for r in held]).astype(np.int64)
            pos = np.concatenate([np.frombuffer(r[3], np.uint32 if len(r[3]) == 4 * s else np.uint16).astype(np.int32) for r, s in zip(held, size, strict=True)])
            nodes = np.concatenate([np.frombuffer(r[4], np.int64) for r in held])
            ns = np.concatenate([np.frombuffer(r[5], np.uint32) for r in held]).astype(np.int32)
            last = np.concatenate([np.frombuffer(r[6], np.int64) for r in held])
            base = np.cumsum([0, *[len(r[4]) // 8 for r in held]])[:-1]
            idx += np.repeat(base, size)
            held.clear()
            order = np.lexsort((nodes[idx], token))
            same = (token[order][1:] == token[order][:-1]) & (nodes[idx[order]][1:] == nodes[idx[order]][:-1])
            order = order[np.concatenate([[True], ~same])]  # of a repeated row one entry stays
            token = token[order]
            edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            df = np.diff(np.append(edge, len(token)))
            keep = np.repeat((df > 1) | (not whole), df)
            own = order[keep]
            at = idx[own]
            cols = [token[keep].view(np.int64), nodes[at], ns[at], pos[own], last[at], (np.repeat(df, df)[keep] * whole).astype(np.int32)]
            for a in range(0, len(own), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in cols], names=["token", "node", "n", "pos", "last", "df"])

        tokens, whole = 0, True
        for batch in sliced(batches, 64):
            cols = [c.to_pylist() for c in batch.columns]
            for r in zip(*cols, strict=True):
                if held and held[0][0] != r[0] or not whole and at_bucket != r[0]:
                    yield from flush(whole)
                    tokens, whole = 0, True
                elif tokens > most:
                    whole = False
                    yield from flush(whole)
                    tokens = 0
                at_bucket = r[0]
                held.append(r)
                tokens += len(r[1]) // 8
        yield from flush(whole)

    return run


def _short_pairs(pct: int):
    """Pairs of lists with up to LONG nodes, that pass the length and position bounds. Rows come sorted by token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf])
            token = pdf["token"].to_numpy()
            whole = int(np.searchsorted(token, token[-1])) if len(token) else 0
            rest = pdf.iloc[whole:]
            yield pairs(pdf.iloc[:whole])
        if rest is not None:
            yield pairs(rest)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        token, node, n, pos = (pdf[c].to_numpy() for c in ("token", "node", "n", "pos"))
        out = [np.zeros((0, 2), np.int64)]
        if len(token):
            edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(edge, len(token)))
            for d in range(2, int(size.max()) + 1):
                at = edge[size == d]
                if not len(at):
                    continue
                for i in range(d - 1):
                    for j in range(i + 1, d):
                        a, b = at + i, at + j
                        ok = np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need(n[a], n[b], pct)
                        ok &= 100 * np.minimum(n[a], n[b]) >= pct * np.maximum(n[a], n[b])
                        ok &= node[a] != node[b]
                        x, y = node[a[ok]], node[b[ok]]
                        out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])

    return run


def _light_pairs(pct: int):
    """Compare a block of heavy entries with a block of light ones. Only a heavy set can reach the overlap, and only if its low
    part ends first, for then it bounds the tokens that the two share. It has to end early in y, too: y's tokens of few nodes up to
    there are missing in x, or the two would meet in a short list, and y may lack only so many. y's marks, hashes at MARKS even
    steps of its low part, tell how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            for r in batch.to_pylist():
                x = {c: np.array(r["x_" + c]) for c in ("node", "n", "pos", "last")}
                y = {c: np.array(r["y_" + c]) for c in ("node", "n", "pos", "low_n", "marks")}
                none = np.full((len(y["n"]), 1), np.iinfo(np.int64).max)
                marks = np.concatenate([y["marks"].reshape(len(none), MARKS), none], 1)
                for i in range(len(x["n"])):
                    least = need(x["n"][i : i + 1], y["n"], pct)
                    ok = (x["n"][i] - x["pos"][i] >= least) & (100 * np.minimum(x["n"][i], y["n"]) >= pct * np.maximum(x["n"][i], y["n"]))
                    # the first mark at or behind the token that would be one too many
                    spare = y["n"] - least + y["low_n"] - y["pos"]
                    j = np.clip(-(-MARKS * spare // np.maximum(y["low_n"] - 1, 1)), 1, MARKS + 1) - 1
                    hit = y["node"][ok & (x["last"][i] < marks[np.arange(len(j)), j])]
                    found.append(np.stack([np.minimum(hit, x["node"][i]), np.maximum(hit, x["node"][i])], 1))
            got = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return run


def cell_links(xs: list[np.ndarray], ys: list[np.ndarray] | None, pct: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the j that set i of ``xs`` links with) among ``ys``, or among the later sets of ``xs`` if that is None."""
    same = ys is None
    ys = xs if same else ys
    n = np.array([len(y) for y in ys], np.int64)
    token = np.concatenate(ys)
    order = np.argsort(token, kind="stable")
    owner = np.repeat(np.arange(len(ys)), n)[order]
    known, begin = np.unique(token[order], return_index=True)
    size = np.diff(np.append(begin, len(token)))

    def tally(s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        at = at[known[at] == s]
        count = size[at]
        where = np.repeat(begin[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.bincount(owner[where], minlength=len(ys))

    first, answers = xs[0], tally(xs[0])
    for i, s in enumerate(xs):
        more, less = np.setdiff1d(s, first, assume_unique=True), np.setdiff1d(first, s, assume_unique=True)
        overlap = answers + tally(more) - tally(less) if len(more) + len(less) < len(s) else tally(s)
        hit = np.flatnonzero(overlap >= need(np.int64(len(s)), n, pct))
        yield i, hit[hit > i] if same else hit


def _cells(pct: int):
    """Rows (a, b, null): links enough to join what the cell joins; and (a, null, n): n documents that a links with in this cell.
    Two sets may meet in the cells of several families; they are counted in the family with the least name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k] for c in batch.schema.names}
                family, same = r["family"].as_py(), "by" not in r
                sides = [([np.frombuffer(v, np.uint64) for v in r[f"{s}_s"].as_py()], np.array(r[f"{s}_node"].as_py()), np.array(r[f"{s}_copies"].as_py()), r[f"{s}_in"].as_py()) for s in ("xx" if same else "xy")]
                (xs, x, x_copies, x_in), (ys, y, y_copies, y_in) = sides
                other: dict[int, np.ndarray] = {}
                for j, names in enumerate(y_in):
                    for name in names:
                        if name < family:
                            other.setdefault(name, np.zeros(len(y), bool))[j] = True
                known, place = np.unique(np.concatenate([x, y]), return_inverse=True)
                of_x, of_y, group = place[: len(x)], place[len(x) :], np.arange(len(known))
                x_links, y_links = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                for i, hit in cell_links(xs, None if same else ys, pct):
                    for j in hit[group[of_y[hit]] != group[of_x[i]]]:
                        if group[of_y[j]] != group[of_x[i]]:
                            out.append((min(x[i], y[j]), max(x[i], y[j]), None))
                            group[group == group[of_y[j]]] = group[of_x[i]]
                    for name in x_in[i]:
                        if name in other:
                            hit = hit[~other[name][hit]]
                    x_links[i] += y_copies[hit].sum()
                    y_links[hit] += x_copies[i]
                out += [(v, None, c) for side, links in ((x, x_links), (y, y_links)) for v, c in zip(side.tolist(), links.tolist(), strict=True) if c]
            yield pa.RecordBatch.from_arrays([pa.array([v[c] for v in out], pa.int64()) for c in range(3)], names=["a", "b", "n"])

    return run


def _whole_sets(k: int, pct: int, packed: bool):
    """node and its whole set: packed, or as an array with the upper halves of the low part beside it; there, hashes in signed
    order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [(node, s) for node, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k), strict=True) if node == node_of(s)]
            node = pa.array([x for x, _ in sets], pa.int64())
            if packed:
                yield pa.RecordBatch.from_arrays([node, pa.array([s.tobytes() for _, s in sets], pa.binary())], names=["node", "s"])
                continue
            signed = [(s ^ np.uint64(1 << 63)).view(np.int64) for _, s in sets]
            lows = [(s[: low_count(len(s), pct)] >> 32).astype(np.int32) for s in signed]
            yield pa.RecordBatch.from_arrays([node, pa.array(lows, pa.list_(pa.int32())), pa.array(signed, pa.list_(pa.int64()))], names=["node", "low", "s"])

    return run


def components(scratch: Scratch, links: DataFrame) -> DataFrame | None:
    """(node, label) of every node in ``links`` (a, b): rounds of hooking each node to its least neighbour and contracting.

    Each round at least halves the nodes that still have links, so the rounds grow with the logarithm of the largest component.
    """
    maps, links = [], links.select("a", "b")
    while links.count():
        hook = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"), F.count(F.lit(1)).alias("n_links"))
        hook = scratch.keep(hook.select("node", F.least("node", "up").alias("up"), "n_links"), f"hook{len(maps)}")
        maps.append(hook.drop("n_links"))
        left = join_uneven(links, hook.select(F.col("node").alias("a"), F.col("up").alias("ua"), "n_links"), "a", "n_links").drop("n_links")
        left = join_uneven(left, hook.select(F.col("node").alias("b"), F.col("up").alias("ub"), "n_links"), "b", "n_links")
        links = scratch.keep(left.where("ua != ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), f"links{len(maps)}")
    if not maps:
        return None
    label = maps[0].withColumnRenamed("up", "label")
    for m in maps[1:]:
        label = label.join(m.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return scratch.keep(label, "label")


def named(docs: DataFrame, k: int = 5, text_col: str = "text") -> DataFrame:
    """``docs`` with the size (n) and the name (node) of each text's set."""
    at = docs.columns.index(text_col)
    out = StructType([*docs.schema.fields, StructField("n", LongType()), StructField("node", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            sets = shingle_sets(batch.column(at), k)
            n, node = zip(*((len(s), node_of(s)) for s in sets), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(node, pa.int64())], names=out.names)

    return docs.mapInArrow(run, out)


def jaccard_components(docs: DataFrame, pct: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text", node: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_copies (rows with an equal set, itself
    included) and n_links (other rows that it links with); with ``node``, also the name of its set.

    Null or empty texts and texts without words have an empty set and link with nothing. Every row counts by its own text, also
    where a doc_id or a whole row repeats; a component's id is the least doc_id in it. A null doc_id has no links and a null
    component. Very long texts are read whole. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = chosen(docs, id_col, text_col).toDF("doc_id", "text")
    rows = scratch.keep(docs.mapInArrow(_sets(pct, k), "doc_id long, n long, node long, low binary, marks array<long>"), "sets")
    lows, rows = rows, scratch.keep(rows.drop("low"), "rows")
    in_play = rows.where("doc_id is not null and n > 0")
    classes = scratch.keep(in_play.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("marks").alias("marks")), "classes")
    repeated = join_uneven(in_play.select("node", "doc_id"), classes.where("n_copies > 1").select("node", "least_id", "n_copies"), "node", "n_copies").where("doc_id != least_id").select("node", "doc_id").distinct()
    heads = only(lows.where("doc_id is not null and n > 0"), repeated, ["node", "doc_id"], "left_anti")

    total = heads.agg(F.sum(F.expr("length(low) div 8"))).first()[0] or 0
    buckets = max(8, -(-total // TOKENS_A_BUCKET))
    dealt = heads.select("node", "n", "low").mapInArrow(_deal(buckets), DEALT_SCHEMA).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    raw = posting = scratch.keep(dealt.mapInArrow(_postings(MOST_TOKENS), POSTING), "postings")
    scratch.drop(lows)
    parts = posting.where("df = 0")
    if parts.limit(1).count():
        parts = parts.drop("df").dropDuplicates(["token", "node"])
        count = scratch.keep(parts.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1"), "hot")
        posting = posting.where("df > 0").unionByName(parts.join(count, "token"))

    by_node = Window.partitionBy("node")
    frequent = F.when(F.col("df") > LONG, 1).otherwise(0)
    before = F.sum(frequent).over(by_node.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    low_n = F.least(F.col("n"), F.expr(f"n - ceil({pct} * n / 100.0D) + 1 + n div 20 + least(n div 8, 24)")).cast("int")
    posting = posting.select("token", "node", "n", "last", "df", low_n.alias("low_n"), F.when(F.col("df") > LONG, low_n - F.sum(frequent).over(by_node)).otherwise(F.col("pos") - before).cast("int").alias("pos"))
    posting = scratch.keep(posting, "index")
    scratch.drop(raw)

    short = posting.where(f"df <= {LONG} and pos <= n - ceil({pct} * n / 100.0D)").select("token", "node", "n", "pos")
    pairs = short.repartition("token").sortWithinPartitions("token").mapInPandas(_short_pairs(pct), "a long, b long")
    def whole(nodes: DataFrame, packed: bool) -> DataFrame:
        wanted = scratch.keep(nodes.join(classes, "node").select("node", F.col("least_id").alias("doc_id")), "wanted")
        # Another text under the same doc_id has another node and is left out; a repeated row only repeats a link.
        texts = only(docs, wanted, "doc_id").select("node", "text")
        return scratch.keep(texts.mapInArrow(_whole_sets(k, pct, packed), "node long, s binary" if packed else "node long, low array<int>, s array<long>"), "whole")

    # Two sets whose first shared low token is a long one: the one whose low part ends first must be heavy.
    long_ = posting.where(f"df > {LONG}").withColumn("heavy", F.expr(f"n - pos >= ceil({pct} * n / 100.0D)"))
    # Written, so that the join can split the partition of a token with very many nodes.
    pivot = scratch.keep(long_.where("heavy").groupBy("token").agg(F.min_by("node", F.xxhash64("node")).alias("family")), "pivots")
    member = scratch.keep(long_.join(pivot, "token").select("family", "node", "n", "pos", "last", "low_n", "heavy").distinct(), "members")
    found, counted = [], []
    heavy = member.where("heavy").withColumn("class", F.floor(F.log(F.col("n")) / F.log(F.lit(100 / pct))))
    room = heavy.groupBy("family", "class").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("slots"), F.count(F.lit(1)).alias("c"))
    room = scratch.keep(room.withColumn("c", F.sum("c").over(Window.partitionBy("family"))), "room")
    heavy = heavy.join(room.where("c > 1"), ["family", "class"]).withColumn("block", F.xxhash64("family", "class", F.pmod(F.xxhash64("node", F.lit(1)), "slots")))
    heavy = scratch.keep(heavy, "heavy")
    if heavy.limit(1).count():
        sets = whole(heavy.select("node").distinct(), True)
        about = heavy.groupBy("family", "block").agg(F.min("class").alias("class"), F.max(F.expr("n - pos")).alias("reach"), F.min("n").alias("n0"), F.max("n").alias("n1"))
        x, y = (about.select("family", *[F.col(c).alias(f"{s}{c}") for c in ("block", "class", "reach", "n0", "n1")]) for s in "xy")
        cell = x.join(y, "family").where("yclass - xclass in (0, 1) and (xclass < yclass or xblock < yblock)").where(f"100 * xn1 >= {pct} * yn0 and greatest(xreach, yreach) >= {pct} / 100.0D * greatest(xn0, yn0)")
        about_node = heavy.groupBy("node").agg(F.collect_set("family").alias("in")).join(classes.select("node", F.col("n_copies").alias("copies")), "node")
        about_node = about_node.join(sets.dropDuplicates(["node"]), "node")
        blocks = heavy.select("family", "block", "node").join(about_node, "node").groupBy("family", "block").agg(*[F.collect_list(c).alias(c) for c in ("node", "in", "copies", "s")])
        blocks = scratch.keep(blocks, "blocks")
        x, y = (blocks.select(F.col("block").alias(f"b{s}"), *[F.col(c).alias(f"{s}_{c}") for c in ("node", "in", "copies", "s")]) for s in "xy")
        cross = cell.select("family", F.col("xblock").alias("bx"), F.col("yblock").alias("by")).join(x, "bx").join(y, "by")
        within = blocks.select("family", F.col("block").alias("bx"), *[F.col(c).alias(f"x_{c}") for c in ("node", "in", "copies", "s")])  # each block's cell with itself: no shuffle
        run = _cells(pct)
        cell = within.mapInArrow(run, "a long, b long, n long").union(cross.mapInArrow(run, "a long, b long, n long"))
        cells = scratch.keep(cell, "cells")
        found.append(cells.where("b is not null").select("a", "b").distinct())
        counted.append(cells.where("n is not null").select(F.col("a").alias("node"), "n"))

    def sides(df: DataFrame, s: str, cols: tuple[str, ...]) -> tuple[DataFrame, int]:
        slots = scratch.keep(df.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ENTRIES).alias("slots"), F.count(F.lit(1)).alias("n_rows")), "slots")
        most = slots.agg(F.max("slots")).first()[0] or 0
        slot = F.pmod(F.xxhash64("node", F.lit(2)), "slots")
        slotted = (df.join(slots, "family") if most <= FEW_BLOCKS else join_uneven(scratch.keep(df, "side"), slots, "family")).withColumn(f"{s}_slot", slot)
        return slotted.groupBy("family", f"{s}_slot").agg(*[F.collect_list(c).alias(f"{s}_{c}") for c in cols]), most

    light = member.where("not heavy").join(classes.select("node", "marks"), "node")
    (x, most_x), (y, most_y) = sides(member.where("heavy"), "x", ("node", "n", "pos", "last")), sides(light, "y", ("node", "n", "pos", "low_n", "marks"))
    if most_x * most_y <= FEW_BLOCKS:
        met = x.join(y, "family")
    else:
        # The numbers of the blocks are paired first, so that the blocks of one large family are dealt over all tasks.
        x, y = scratch.keep(x, "blocks"), scratch.keep(y, "blocks")
        met = x.select("family", "x_slot").join(y.select("family", "y_slot"), "family").join(x, ["family", "x_slot"]).join(y, ["family", "y_slot"])
    met = met.drop("family", "x_slot", "y_slot")
    pairs = scratch.keep(pairs.union(met.mapInArrow(_light_pairs(pct), "a long, b long")).distinct(), "pairs")
    sets = whole(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), False)
    # First on the low parts: a low token of one set before the end of the other's low part that isn't there is missing in it. Upper
    # halves of hashes do: where two agree by chance, a pair goes on to be compared as a whole.
    a, b = (sets.select(F.col("node").alias(c), F.col("low").alias(f"l{c}"), F.size("s").alias(f"n{c}")) for c in "ab")
    met = pairs.join(a, "a").join(b, "b").withColumn("end", F.least(F.element_at("la", -1), F.element_at("lb", -1)))
    met = met.withColumn("need", F.expr(f"ceil({pct} * (na + nb) / {100 + pct}.0D)"))
    for x, y in ("ab", "ba"):
        met = met.where(F.size(F.array_except(F.filter(f"l{x}", lambda t: t < F.col("end")), f"l{y}")) <= F.col(f"n{x}") - F.col("need"))
    close = scratch.keep(met.select("a", "b"), "close")
    a, b = (sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    met = close.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("o"), (F.size("sa") + F.size("sb")).alias("t"))
    sure = scratch.keep(met.where(f"{100 + pct} * o >= {pct} * t").select("a", "b").distinct(), "sure")
    found.append(sure)
    # Pairs that share a family are counted in its cells.
    x, y = (heavy.select(F.col("node").alias(c), "family") for c in "ab")
    apart = sure.join(sure.join(x, "a").join(y, ["b", "family"]).select("a", "b").distinct(), ["a", "b"], "left_anti")
    for one, two in ("ab", "ba"):
        counted.append(apart.join(classes.select(F.col("node").alias(two), F.col("n_copies").alias("n")), two).select(F.col(one).alias("node"), "n"))
    links = scratch.keep(reduce(DataFrame.union, found), "verified")
    label = components(scratch, links)

    linked = reduce(DataFrame.union, counted).groupBy("node").agg(F.sum("n").alias("n_linked"))
    known = classes.select("node", "least_id", "n_copies").join(linked, "node", "left")
    known = known.select("node", "least_id", "n_copies", (F.coalesce("n_linked", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    if label is not None:
        known = scratch.keep(known.join(label, "node", "left"), "labelled")
        linked = known.where("label is not null")
        top = scratch.keep(linked.groupBy("label").agg(F.min("least_id").alias("top"), F.count(F.lit(1)).alias("n_rows")), "tops")
        linked = join_uneven(linked, top, "label").select("node", "n_copies", "n_links", F.col("top").alias("component_id"))
        known = linked.union(known.where("label is null").select("node", "n_copies", "n_links", "least_id"))
    else:
        known = known.withColumnRenamed("least_id", "component_id")
    # Rows without a set or an id have a class of their own; they share one name, which must not be joined on.
    rows = rows.withColumn("alone", F.col("doc_id").isNull() | (F.col("n") == 0))
    known = scratch.keep(known, "known")
    met = join_uneven(rows.where("not alone"), known, "node", "n_copies")
    met = met.unionByName(rows.where("alone").withColumns({"n_copies": F.lit(1).cast("long"), "n_links": F.lit(0).cast("long"), "component_id": F.col("doc_id")}), allowMissingColumns=True)
    out = met.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_copies", F.col("n_links").cast("long").alias("n_links"), *(["node"] if node else []))
    out = scratch.keep(out, "result")
    scratch.close(out)
    return out
