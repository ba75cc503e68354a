"""Secret scans: candidate spans per text, and corpus-wide ownership frequency of their values.

Three fixed kinds give the base spans. A fourth pattern takes other long mixed tokens as candidates; whether a candidate
or a base value looks live follows from the whole corpus: its hash is counted over distinct owners and repositories, and
a value that few owners have, in few repositories, is owner-specific; one that many owners have, or that lies in many
repositories, is a widely copied example. Owner-specific extra candidates add spans of kind `owned`; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fair_share, hot_join

KINDS = ("assign", "access", "hex", "owned")
# Fixed patterns: letters of the key words in either case, ASCII only.
ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same as [0-9a-f]+ of 24 or more: a match always takes a whole run
OTHER = re.compile(r"[A-Za-z0-9+/_-]{20,}")
MIN_ASSIGN, MIN_ACCESS, MIN_DIGITS = 6, 20, 4
MAX_OWNERS, MAX_REPOSITORIES = 3, 6

def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, secret value) of the three fixed kinds, in code points."""
    out = [(0, m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return out + [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]


def other_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens with letters in both cases and several digits that touch no base span."""
    out = []
    for m in OTHER.finditer(text):
        s = m[0]
        if sum(c.isdigit() for c in s) >= MIN_DIGITS and s.lower() != s != s.upper() and not any(a < m.end() and m.start() < b for _, a, b, _ in base):
            out.append((3, m.start(), m.end(), s))
    return out


def value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big", signed=True)


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs' columns and `spans`: all candidates of each whole text."""
    spans = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0):
                t = text.as_py() or ""
                base = base_spans(t)
                found.append([{"kind": k, "start": a, "end": b, "hash": value_hash(v)} for k, a, b, v in [*base, *other_spans(t, base)]])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, spans)], [*batch.schema.names[1:], "spans"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop(text_col).schema.fields)
    return docs.select(F.col(text_col), *[F.col(c) for c in docs.columns if c != text_col]).mapInArrow(scan, f"{kinds}, spans array<struct<kind:int,start:int,end:int,hash:bigint>>")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories, rows) of every candidate value, from (owner, repository, hash) rows.

    Distinct (hash, owner, repository) come first, with partial counts in each task, so a value in a third of all rows
    reaches no task more than once per task that has it.
    """
    pairs = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("rows"))
    per_owner = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("rows").alias("rows"))
    return per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("rows").alias("rows"))


def secret_spans(
    docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang")
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, verdicts, n_live, n_example for every row.

    spans lists kind:start:end of all spans by start, then kind; verdicts says live or example for each of them, in that
    order. A value is live if at most max_owners owners have it, in at most max_repositories repositories. n_live and
    n_example count all candidates, also the other tokens that make no span. Null texts are empty; a null owner or
    repository is one owner or repository. Repeated rows are rows of their own; an empty table has no rows.
    """
    null = F.lit("\u0000")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(owner_col).cast("string"), null).alias("owner"),
        F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), null) for c in repository_cols]).alias("repository"),
        F.col(text_col).cast("string").alias("text"),
    )
    found = cut(candidates(rows, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    each = found.select("row", "owner", "repository", F.explode("spans").alias("s")).select("row", "owner", "repository", "s.*")
    owned = ownership(each)
    known = owned.select("hash", ((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).alias("live"), "rows")
    # a document has few candidates: as many as its rows in the table that is counted here
    share = fair_share(docs.sparkSession, found.agg(F.sum(F.size("spans"))).first()[0] or 0)
    judged = hot_join(each.select("row", "kind", "start", "end", "hash"), known, "hash", "rows", share, F.struct("row", "start"))
    per_row = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when((F.col("kind") < 3) | F.col("live"), F.struct("start", "kind", "end", "live")))).alias("all"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )

    def listed(spans):
        name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")

    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")
    out = found.select("row", "doc_id").join(per_row, "row", "left").withColumn("all", F.coalesce("all", none))
    base = F.filter("all", lambda s: s["kind"] < 3)
    number = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"),
        F.array_join(F.transform("all", lambda s: F.when(s["live"], "live").otherwise("example")), ",").alias("verdicts"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )
