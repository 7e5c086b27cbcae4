"""Incremental secret scan over a stored, content-addressed ledger, in DataFrame functions only.

Every version of every file is named by the SHA-256 of its bytes (its blob). The ledger holds, for each blob, the rule versions
that have read it and the spans that they found. A scan reads only blobs that lack a current rule version, one path of each, applies
only the rules that are missing, and adds what it found to the ledger; the findings are then joined back to all the paths that hold
the blob, however many copies there are. Only names move in shuffles while the rows that a scan treats unlike most are few.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._session import Scratch, chosen, delete, is_small, join_uneven

SPAN = "struct<start: bigint, ord: int, end: bigint, kind: string>"
ENTRY = f"array<struct<rule: string, version: int, spans: array<{SPAN}>>>"
LEDGER = f"blob binary, entries {ENTRY}"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a Java regex; a match counts if ``group`` has ``least`` characters. ``any_of``: strings of which a matching
    text must hold one, once ``folded`` to lower case; they spare most texts the regex and never change a result."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_of: tuple[str, ...] = ()
    folded: bool = False
    version: int = 1


# The base patterns and limits of the contract. ``{32,}`` and ``{12,}`` say "32+" and "16+ with AKIA": a shorter match
# would have ended where its run of characters ends, so dropping it hides no other.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key"), True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", any_of=("AKIA",)),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", any_of=("PRIVATE KEY-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", any_of=("eyJ",)),
    Rule("repo", r"gh[pousr]_[A-Za-z0-9]{36,}", any_of=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
RULES = BASE_RULES + MORE_RULES


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches in code points. The parts between the matches give the positions."""
    none = F.array().cast(f"array<{SPAN}>")
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    step = F.arrays_zip(parts.alias("p"), found.alias("m"), judged.alias("g"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["p"])
        end = start + F.char_length(x["m"])
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.char_length(x["g"]) >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(step, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    if rule.any_of:
        where = F.lower(text) if rule.folded else text
        return F.when(reduce(lambda a, b: a | b, [F.contains(where, F.lit(s)) for s in rule.any_of]), spans).otherwise(none)
    return F.when(F.regexp_like(text, pattern), spans).otherwise(none)


def _blob(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def paths(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(blob, doc_id, n): which blob each path holds, and in how many rows; a written table of names, without texts. Null texts count
    as empty, a null id is an id like others, and ``id_col`` may be of any type that can be compared, a struct of path and version too."""
    own = chosen(versions, id_col, text_col).toDF("doc_id", "text").select(_blob("text").alias("blob"), "doc_id")
    return Scratch(versions.sparkSession, "secrets").keep(own.groupBy("blob", "doc_id").agg(F.count(F.lit(1)).alias("n")), "paths")


def scan_unseen(
    versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", held: DataFrame | None = None
) -> DataFrame:
    """New ledger rows (blob, entries): one for each blob of ``versions`` that some rule version of ``rules`` hasn't read, with the entries
    of those rule versions only. ``held``: the ``paths`` of ``versions``, if they are known.

    Of the paths that hold a blob the least is read. Each path has a mask of the rules that are to read it; the most frequent mask is
    taken for granted, and the other paths are looked up by (blob, path): by broadcast while they are few, as copies are, or new blobs
    beside a ledger. Beyond that both sides are shuffled. Null texts count as empty, long texts are read whole, other columns are
    ignored; empty ``versions`` give an empty result.
    """
    scratch = Scratch(versions.sparkSession, "secrets")
    own = chosen(versions, id_col, text_col).toDF("doc_id", "text")
    held = paths(own) if held is None else held
    every = (1 << len(rules)) - 1
    blobs = held.groupBy("blob").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_rows"), F.max("n").alias("n_same"))
    if ledger is None:
        blobs = blobs.withColumn("missing", F.lit(every))
    else:
        done = ledger.select("blob", F.explode("entries").alias("e")).select("blob", F.concat_ws(":", "e.rule", "e.version").alias("r"))
        bit = reduce(lambda acc, x: F.when(F.col("r") == f"{x[1].kind}:{x[1].version}", F.lit(1 << x[0])).otherwise(acc), enumerate(rules), F.lit(0))
        read = done.groupBy("blob").agg(F.bit_or(bit).alias("read"))
        missing = F.lit(every).bitwiseAND(F.bitwise_not(F.coalesce("read", F.lit(0))))
        blobs = blobs.join(read, "blob", "left").withColumn("missing", missing).drop("read")
    blobs = scratch.keep(blobs, "blobs")
    mask = F.when(F.col("doc_id").eqNullSafe(F.col("least")), F.col("missing")).otherwise(0)
    rows = join_uneven(held, blobs, "blob").select("blob", "doc_id", "n_same", mask.alias("mask"))
    rows = scratch.keep(rows, "masks")
    counts = {r["mask"]: (r["count"], r["same"]) for r in rows.groupBy("mask").agg(F.count(F.lit(1)).alias("count"), F.max("n_same").alias("same")).collect()}
    usual = max(counts, key=lambda m: (counts[m][0], m)) if counts else 0
    few = rows.where(F.col("mask") != usual).select(F.col("blob").alias("_blob"), F.col("doc_id").alias("_id"), "mask")
    few = F.broadcast(few) if is_small(few.select("_blob", F.col("_id").cast("string"))) else few
    named = own.select(_blob("text").alias("blob"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    met = named.join(few, (F.col("blob") == F.col("_blob")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    texts = met.select("blob", "text", F.coalesce("mask", F.lit(usual)).alias("mask")).where("mask != 0")
    entries = []
    for i, rule in enumerate(rules):
        entry = F.struct(F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"), _spans(F.col("text"), rule, i).alias("spans"))
        entries.append(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, entry))
    found = texts.select("blob", F.array_compact(F.array(*entries)).cast(ENTRY).alias("entries"))
    if any(same > 1 for m, (_, same) in counts.items() if m):  # a path that repeats the same text was read as often
        found = found.groupBy("blob").agg(F.first("entries").alias("entries"))
    return found


class Ledger:
    """Ledger rows in a folder that all executors share. Every scan adds a part; parts only state what was read and found, so a part that
    is missing after a failure is scanned anew, and one that is there twice does no harm."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _parts(self) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [str(x.getPath().toString()) for x in fs.listStatus(p) if x.isDirectory()] if fs.exists(p) else []

    def rows(self) -> DataFrame:
        """(blob, entries); a blob may have several rows, each with other rule versions."""
        parts = self._parts()
        return self.spark.read.schema(LEDGER).parquet(*parts) if parts else self.spark.createDataFrame([], LEDGER)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", held: DataFrame | None = None) -> int:
        """Read what is unseen and add it; how many blobs were read."""
        seen = self.rows()
        part = f"{self.path}/scan-{uuid.uuid4().hex}"
        scan_unseen(versions, seen if self._parts() else None, rules, id_col, text_col, held).write.parquet(part)
        return self.spark.read.schema(LEDGER).parquet(part).count()

    def merge(self) -> None:
        """Bring all parts into one, with one row for each blob and each rule version once."""
        old = self._parts()
        if len(old) < 2:
            return
        flat = self.rows().select("blob", F.explode("entries").alias("e")).groupBy("blob", "e.rule", "e.version").agg(F.first("e.spans").alias("spans"))
        one = flat.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("rule", "version", "spans"))).cast(ENTRY).alias("entries"))
        one.write.parquet(f"{self.path}/merged-{uuid.uuid4().hex}")
        for part in old:
            delete(self.spark, part)


def findings(
    versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", held: DataFrame | None = None
) -> DataFrame:
    """(doc_id, blob, spans) for every row of ``versions``, from the ledger's entries of the current rule versions; spans by start,
    then kind as listed. Rows without findings have an empty list; repeated rows stay; null ids are ids like others. ``held``: the
    ``paths`` of ``versions``, if they are known; texts aren't read then."""
    scratch = Scratch(versions.sparkSession, "secrets")
    held = paths(versions, id_col, text_col) if held is None else held
    current = [f"{r.kind}:{r.version}" for r in rules]
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    hits = ledger.select("blob", F.explode(F.filter("entries", lambda e: F.concat_ws(":", e["rule"], e["version"]).isin(current) & (F.size(e["spans"]) > 0))).alias("e"))
    flat = hits.select("blob", F.transform("e.spans", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))
    by_blob = flat.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    known = held.groupBy("blob").agg(F.count(F.lit(1)).alias("n_rows"))
    known = scratch.keep(known.join(by_blob, "blob", "left"), "found")
    rows = join_uneven(held, known, "blob").select("doc_id", "blob", "n", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))
    return rows.select("doc_id", "blob", "spans", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("n")).drop("n")


def spans_string(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by ``mark``; ``spans`` sorted by start."""

    def add(acc: Column, s: Column) -> Column:
        gap = s["start"] - acc["at"]
        more = F.when(gap >= 0, F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), gap.cast("int")), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), add, rest))
