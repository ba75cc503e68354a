"""Merkle manifest of a table, one tree per group and one over the groups' roots, by time-forward processing.

Every node has a label (level, place), and labels are processed in order: a node waits until the digests of its children
have arrived under its label, is made from them, and sends its own digest on to its parent's label. Messages go through a
priority queue that is external in two steps. Levels are cut into bands of SLAB_LEVELS; inside a band the messages of one
subtree of at most 2 ** SLAB_LEVELS leaves, a slab, wait in a heap, and messages to labels above the band go to a kept
table that Spark's sort-based shuffle delivers to the slabs of the next band. A reversed sweep then sends proof suffixes
from the root down: in a slab from parent to child in descending order of labels, between bands one row a slab. So no
task holds more than slabs, whatever a tree's size, and a table of n rows needs log2(n) / SLAB_LEVELS bands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, numbered

SLAB_LEVELS = 10
TOP = -1  # the tree over the groups' roots
NODE = "tree long, m long, pos long, digest string"
STEPS = "proof array<string>, subroot string, root string"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 in lower-case hex of the fields one after another: `-` if null, else UTF-8 byte count, colon, value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof give."""

    def step(own: Column, s: Column) -> Column:
        other = F.substring(s, 2, 64)
        return F.sha2(F.when(s.startswith("<"), F.concat(other, own)).when(s.startswith(">"), F.concat(own, other)).otherwise(own), 256)

    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    """SHA-256 in lower-case hex of a proof's sibling digests, one after another."""
    return F.sha2(F.regexp_replace(F.array_join(proof, ""), "[<>=]", ""), 256)


def _digest(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def _levels(m: int, band: int) -> int:
    """The levels that a slab rises: a whole band, or fewer where the tree of m nodes ends."""
    return min(band, (m - 1).bit_length())


def forward(digests: list[str], levels: int) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """The slab's top digest, and (level, first child's place, children's digests) of every node that was made, in order of labels."""
    # a message is (level, place of the node that waits for it, place of the child, digest)
    queue = [(1, i >> 1, i, d) for i, d in enumerate(digests)]
    made: list[tuple[int, int, list[str]]] = []
    top = digests[0]
    while queue and levels:
        level, place = queue[0][:2]
        run = []
        while queue and queue[0][:2] == (level, place):
            run.append(heappop(queue))
        top = _digest([r[3] for r in run])
        made.append((level, run[0][2], [r[3] for r in run]))
        if level < levels:
            heappush(queue, (level + 1, place >> 1, place, top))
    return top, made


def backward(made: list[tuple[int, int, list[str]]], levels: int, suffix: list[str]) -> list[list[str]]:
    """The proof of every leaf of a slab: its siblings' steps up to the slab's top, then the top's own proof."""
    waiting = {(levels, 0): suffix}
    leaves: list[list[str]] = [] if levels else [suffix]
    for level, first, run in reversed(made):
        own = waiting.pop((level, first >> 1))
        if len(run) == 1:
            waiting[(level - 1, first)] = ["=", *own]
        else:
            waiting[(level - 1, first)] = [">" + run[1], *own]
            waiting[(level - 1, first + 1)] = ["<" + run[0], *own]
    return leaves or [waiting[(0, i)] for i in range(len(waiting))]


def _slab(band: int) -> Column:
    return F.shiftright("pos", band).alias("slab")


def _rise(nodes: DataFrame, largest: int, shelf: Shelf, band: int) -> list[DataFrame]:
    """The nodes of every band's lowest level, from the leaves to the one that has only roots."""

    def up(slab: pa.Table) -> pa.Table:
        slab = slab.sort_by("pos")
        m = slab["m"][0].as_py()
        top, _ = forward(slab["digest"].to_pylist(), _levels(m, band))
        return pa.table({"tree": slab["tree"][:1], "m": [-(-m >> band)], "pos": [slab["pos"][0].as_py() >> band], "digest": [top]})

    bands = [nodes]
    while largest > 1:
        low = bands[-1].filter("m > 1").select("tree", "m", "pos", "digest")
        bands.append(shelf.keep(low.groupBy("tree", _slab(band)).applyInArrow(up, NODE)))
        largest = -(-largest >> band)
    return bands


def _roots(bands: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree."""
    out = bands[0].filter("m = 1").select("tree", "digest")
    for band in bands[1:]:
        out = out.unionByName(band.filter("m = 1").select("tree", "digest"))
    return out


def _fall(bands: list[DataFrame], roots: DataFrame, shelf: Shelf, band: int) -> DataFrame:
    """The rows of the lowest band with their proof, subroot and root; roots has (tree, proof, subroot, root), a row a tree."""

    def steps(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
        lone = nodes.filter("m = 1").join(roots, "tree")
        if above is None:
            return lone
        names = nodes.columns
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)

        def down(slab: pa.Table, top: pa.Table) -> pa.Table:
            slab = slab.sort_by("pos")
            levels = _levels(slab["m"][0].as_py(), band)
            _, made = forward(slab["digest"].to_pylist(), levels)
            proofs = backward(made, levels, top["proof"][0].as_py())
            n = slab.num_rows
            same = lambda c: pa.array([top[c][0].as_py()] * n, pa.string())
            return pa.table([*[slab[c] for c in names], pa.array(proofs, pa.list_(pa.string())), same("subroot"), same("root")], names=[*names, "proof", "subroot", "root"])

        low = nodes.filter("m > 1").groupBy("tree", _slab(band))
        high = above.select("tree", "pos", "proof", "subroot", "root").groupBy("tree", F.col("pos").alias("slab"))
        return low.cogroup(high).applyInArrow(down, f"{kind}, {STEPS}").select(*lone.columns).unionByName(lone)

    above = None
    for i, nodes in enumerate(reversed(bands)):
        before, above = above, steps(nodes, above)
        if i < len(bands) - 1:
            above = shelf.keep(above)
            shelf.drop(nodes, *[before] * (before is not None))
    return above


def manifest(leaves: DataFrame, id_col: str = "doc_id", group_col: str = "lang", leaf_col: str = "leaf", band: int = SLAB_LEVELS) -> DataFrame:
    """leaves with proof, subroot and root: one binary tree per group, over its leaves in the order of id_col, and one over the groups' roots.

    A run of two nodes, or the last one alone, becomes the digest of its digests; a lone leaf is its group's root, a lone
    group's root the root. Groups are in the bytewise order of their names, null first, which is a group like others. A
    proof lists the steps from the leaf to the root: `<` and a sibling to its left, `>` and one to its right, `=` for none.
    Rows with null ids come last in their group; rows that share an id are in the order of their digests, and rows that
    repeat both are leaves of their own, which differ in nothing but their proofs. An empty table has no rows. Columns of
    leaves other than these must not be called tree, m, pos, digest, proof, subroot or root.
    """
    spark = leaves.sparkSession
    shelf = Shelf(spark)
    rows = leaves.withColumn("_none", F.col(id_col).isNull()).withColumn("_lang", F.col(group_col))
    order = numbered(rows.withColumn("_named", F.col(group_col).isNotNull()), ["_named", "_lang", "_none", id_col, leaf_col], shelf).drop("_none", "_named")
    order = order.withColumnRenamed("at", "_at")
    groups = shelf.keep(order.groupBy("_lang").agg(F.min("_at").alias("tree"), F.count("*").alias("m")))
    largest, n_groups = groups.agg(F.coalesce(F.max("m"), F.lit(0)), F.count("*")).first()
    # one row a group: Spark broadcasts them where they are few, and splits hot groups where not
    named = groups.withColumnRenamed("_lang", "_own")
    nodes = order.join(named, F.col("_lang").eqNullSafe(F.col("_own"))).drop("_lang", "_own")
    nodes = nodes.withColumn("pos", F.col("_at") - F.col("tree")).withColumn("digest", F.col(leaf_col)).drop("_at")
    bands = _rise(nodes, largest, shelf, band)
    subroots = shelf.keep(_roots(bands))
    top = numbered(groups.select("tree").join(subroots, "tree").select(F.col("tree").alias("own"), "digest"), ["own"], shelf)
    top = top.select("own", "digest", F.col("at").alias("pos"), F.lit(TOP).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("m"))
    top_bands = _rise(top, n_groups, shelf, band)
    root = shelf.keep(_roots(top_bands).select("tree", F.array().cast("array<string>").alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root")))
    ends = _fall(top_bands, root, shelf, band).select(F.col("own").alias("tree"), "proof", F.col("digest").alias("subroot"), "root")
    return _fall(bands, shelf.keep(ends), shelf, band).drop("tree", "m", "pos", "digest")


def checked_manifest(docs: DataFrame, band: int = SLAB_LEVELS) -> DataFrame:
    """The manifest of documents, and what each leaf, changed where 7 divides the checksum of its id, folds to with its own proof.

    The change adds 1 to n_chars; where that or the id is null nothing changes. Null ids, groups and fields, repeated rows
    and empty tables are as in `manifest`; other columns are not read.
    """
    fields = lambda n: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    leaf = fields(F.col("n_chars"))
    # the texts are hashed where they are read, and only digests go on
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf.alias("leaf"), F.when(hit, fields(F.col("n_chars") + 1)).alias("changed"))
    out = manifest(rows, band=band).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _level_sql(name: str, start: str) -> str:
    """All levels of binary trees as a recursive table (tree, level, pos, h, m) over start (tree, pos, h, m)."""
    return f"""{name} as (
  select tree, 0::bigint as level, pos, h, m from ({start})
  union all
  select tree, level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), any_value((m + 1) // 2) from {name} where m > 1 group by tree, level, pos // 2
)"""


def _walk_sql(name: str, start: str, levels: str) -> str:
    """Leaves walked up to their root as a recursive table (leaf_no, tree, level, pos, m, proof, acc) over start (leaf_no, tree, pos, m, proof, acc)."""
    return f"""{name} as (
  select leaf_no, tree, 0::bigint as level, pos, m, proof, acc from ({start})
  union all
  select w.leaf_no, w.tree, w.level + 1, w.pos // 2, (w.m + 1) // 2, w.proof || coalesce(l.h, ''), sha256(case when w.pos % 2 = 1 then coalesce(l.h, '') || w.acc else w.acc || coalesce(l.h, '') end)
  from {name} w left join {levels} l on l.tree = w.tree and l.level = w.level and l.pos = w.pos + 1 - 2 * (w.pos % 2)
  where w.m > 1
)"""


_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
_CHANGED = _LEAF.replace("n_chars", "(n_chars + 1)")

ORACLE = f"""
with recursive
crc_table as (
  select list(list_reduce([i::ubigint] || list_transform(range(8), lambda k: 0::ubigint), lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384::ubigint) else x // 2 end) order by i) tab from range(256) r(i)
),
crcs as (
  select doc_id did, xor(list_reduce([4294967295::ubigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint), lambda x, y: xor(tab[xor(x % 256, y)::bigint + 1], x // 256)), 4294967295::ubigint) crc
  from (select distinct doc_id from documents where doc_id is not null), crc_table
),
leaves as (
  select row_number() over () leaf_no, d.doc_id, lang, {_LEAF.replace("doc_id", "d.doc_id")} h, case when crc % 7 = 0 and n_chars is not null then {_CHANGED.replace("doc_id", "d.doc_id")} end changed
  from documents d left join crcs on did = d.doc_id
),
langs as (select lang, row_number() over (order by lang is not null, lang) - 1 tree, count(*) m from leaves group by lang),
placed as (
  select leaf_no, doc_id, h, changed, tree, m, row_number() over (partition by tree order by doc_id nulls last, h) - 1 pos
  from leaves join langs on leaves.lang is not distinct from langs.lang
),
{_level_sql("low", "select tree, pos, h, m from placed")},
subroots as (select tree, h from low where m = 1),
{_level_sql("high", "select 0::bigint as tree, tree as pos, h, (select count(*) from langs) as m from subroots")},
{_walk_sql("rise", "select leaf_no, tree, pos, m, '' as proof, coalesce(changed, h) as acc from placed", "low")},
{_walk_sql("rise2", "select leaf_no, 0::bigint as tree, tree as pos, (select count(*) from langs) as m, proof, acc from rise where m = 1", "high")}
select doc_id, placed.h leaf, subroots.h subroot, high.h root, sha256(rise2.proof) proof_sha256, rise2.acc folded_root, rise2.acc = high.h verified
from placed join subroots using (tree) join rise2 using (leaf_no) join high on high.m = 1 where rise2.m = 1
"""
