"""N-gram Jaccard join by MinHash banding.

Rows with equal n-gram sets form one set class, of which one row stands as the class's node. Its signature is cut into
bands; classes that share a band hash are candidates. Pairs of candidates are verified on the full n-gram sets in units
of bounded size: a small candidate component is one unit; a large one is dealt out by blocks, one unit per pair of
blocks, either of the whole component or of each of its band buckets, whichever sends fewer texts. A pair that shares
several buckets counts in the first. A unit emits one row per class in it (its number of links and a verified class that
it reaches), never its pairs. So no bucket is gathered whole, however many copies a text has, and no verified link
between different sets is lost. Joins on a component or a class are left to Spark's adaptive skew join; those on a digest or
a band, where one key may hold a third of all rows, deal hot keys out by their counts. Only texts of candidates are shuffled: a bounded bitmap of their digests keeps most
others out, and a join on the digest decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, fair_share, hot_join, maybe_in, row_hash
from .shingles import mix, shingle_sets

N, THRESHOLD, RECALL, MAX_HASHES, BLOCK = 5, 0.8, 0.9999, 128, 256
PACK = 300
TILE = 1 << 22


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, whose bands reach the recall at the threshold within max_hashes."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A hash per band of each set's MinHash signature; sets must not be empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    keys = np.random.default_rng(77).integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        held = np.full(len(sets), b + 1, np.uint64)
        for r in range(rows):
            h = flat * keys[b * rows + r]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            held = mix(held * np.uint64(31) + np.minimum.reduceat(h, starts))
        out[:, b] = held
    return out.view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest of the text, text) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.md5(F.encode(text, "UTF-8")).alias("t"), text.alias("text"))


def _sketched(texts: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, t, digest, bands) of every row; digest is of the whole n-gram set, bands are empty for an empty set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets, digests, hashes = [], [], []

                def close() -> None:
                    full = [s for s in sets if len(s)]
                    got = iter(band_hashes(full, bands, rows).tolist() if full else [])
                    hashes.extend(next(got) if len(s) else [] for s in sets)
                    sets.clear()

                held = 0
                for s in shingle_sets(part.column(2), n):
                    sets.append(s)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                    held += len(s)
                    if held > 1 << 15:
                        close()
                        held = 0
                close()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.string()), pa.array(hashes, pa.list_(pa.int64()))], ["id", "t", "digest", "bands"])

    return texts.mapInArrow(sketch, "id long, t string, digest string, bands array<long>")


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions in left, in right) of sets with Jaccard similarity of at least threshold, left before right where both are the same."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate([sets[i] for i in dict.fromkeys([*left, *right])])
    values, counts = np.unique(flat, return_counts=True)
    values = values[counts > 1]  # what one set alone has adds to no intersection
    shared = np.zeros((len(left), len(right)), np.float64)
    step = max(64, TILE // (len(left) + len(right)))

    def marks(own: np.ndarray, low: int, span: np.ndarray) -> np.ndarray:
        out = np.zeros((len(own), len(span)), np.float32)
        for k, i in enumerate(own):
            s = sets[i]
            s = s[np.searchsorted(s, span[0]) : np.searchsorted(s, span[-1], "right")]
            at = np.minimum(np.searchsorted(span, s), len(span) - 1)
            out[k, at[span[at] == s]] = 1
        return out

    for low in range(0, len(values), step):
        span = values[low : low + step]
        shared += marks(left, low, span) @ marks(right, low, span).T
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    good = shared >= threshold * union - 1e-9
    if left is right:
        good = np.triu(good, 1)
    return np.nonzero(good)


def _verified(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(node, links, near) per class and task unit from (pack, unit, side, node, band, bands, text); band is null where a unit is (part of) a whole component."""

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, unit in pdf.groupby("unit", sort=False):
            unit = unit.sort_values("node")
            sets = list(shingle_sets(pa.array(unit["text"], pa.string()), n))
            nodes, side = unit["node"].to_numpy(), unit["side"].to_numpy()
            if (side == 2).all():
                left = right = np.arange(len(nodes))
            else:
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            links = np.zeros(len(nodes), np.int64)
            root = np.arange(len(nodes))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            if len(left) and len(right):
                a, b = _links(sets, left, right, threshold)
                a, b = left[a], right[b]
                if len(a) and not pd.isna(band := unit["band"].iloc[0]) and band > 0:
                    # the pair has counted in the first bucket that it shares
                    before = np.stack(unit["bands"].to_list())[:, : int(band)]
                    first = ~(before[a] == before[b]).any(axis=1)
                    a, b = a[first], b[first]
                np.add.at(links, a, 1)
                np.add.at(links, b, 1)
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    x, y = find(x), find(y)
                    if x != y:
                        root[max(x, y)] = min(x, y)
            top = np.array([find(x) for x in range(len(nodes))])
            out.append(pd.DataFrame({"node": nodes, "links": links, "near": nodes[top]}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "near": []}).astype("int64")

    return texts.groupBy("pack").applyInPandas(verify, "node long, links long, near long")


def _units(groups: DataFrame, spread: DataFrame, block: int) -> DataFrame:
    """(node, unit, side, pack, band) of every task unit that a class of a candidate component (node, root) is part of."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("m"))
    packs = max(1, groups.count() // PACK)
    dealt = cut(groups.join(sizes, "root"))
    one = dealt.filter(F.col("m") <= block).select("node", F.col("root").cast("string").alias("unit"), F.lit(2).alias("side"), F.pmod(F.xxhash64("root"), F.lit(packs)).alias("pack"), F.lit(None).cast("int").alias("band"))
    large = dealt.filter(F.col("m") > block)
    placed = cut(spread.join(large, "node").select("node", "root", "m", "b", "band"))
    # buckets with the same classes are one; the first band's stands for them
    member = lambda salt: F.bit_xor(F.xxhash64("node", F.lit(salt)))
    buckets = placed.groupBy("band").agg(F.min("root").alias("root"), F.min("m").alias("m"), F.min("b").alias("b"), F.count("*").alias("k"), member(1).alias("x"), member(2).alias("y")).filter("k > 1")
    kept = cut(buckets.groupBy("root", "m", "k", "x", "y").agg(F.min(F.struct("b", "band")).alias("f")).select("root", "m", "k", F.col("f.band").alias("band")))
    blocks = lambda size: F.ceil(F.col(size) / block).cast("int")
    cost = kept.groupBy("root", "m").agg(F.sum(F.col("k") * blocks("k")).alias("by_bucket"))
    split = cost.filter(F.col("by_bucket") < F.col("m") * blocks("m")).select("root", "m")

    def paired(rows: DataFrame, size: str, band) -> DataFrame:
        """Rows of a group (head) of `size` classes in all pairs of blocks: a class of block i meets the blocks 0..i as their right side, and those after it as their left one."""
        rows = rows.withColumn("blocks", blocks(size)).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        unit = F.concat_ws(":", "head", F.least("own", "other"), F.greatest("own", "other"))
        return rows.select("node", unit.alias("unit"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), F.xxhash64(unit).alias("pack"), band.cast("int").alias("band"))

    whole = large.join(split.select("root"), "root", "left_anti").withColumn("head", F.concat(F.lit("c"), F.col("root").cast("string")))
    split_buckets = kept.join(split.select("root"), "root", "left_semi").select("band", "k")
    parts = placed.select("node", "b", "band").join(split_buckets, "band").withColumn("head", F.concat(F.lit("b"), F.col("band").cast("string")))
    return one.unionByName(paired(whole, "m", F.lit(None))).unionByName(paired(parts, "k", F.col("b")))


def _joined(docs: DataFrame, n: int, threshold: float, recall: float, max_hashes: int, block: int, id_col: str, text_col: str) -> DataFrame:
    """(id, t, set_id, class_id, n_links, n_copies, leads) for every row; one row of each class leads."""
    bands, rows = choose_bands(threshold, recall, max_hashes)
    texts = _texts(docs, id_col, text_col)
    sketched = cut(_sketched(texts, n, bands, rows).withColumn("row", F.monotonically_increasing_id()))
    share = fair_share(docs.sparkSession, sketched.count())
    place = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t", "row"))
    several = sketched.groupBy("digest").agg(F.min("row").alias("node"), place.alias("f"), F.count("*").alias("n_copies")).filter("n_copies > 1")
    several = cut(several.select("digest", "node", F.col("f.id").alias("set_id"), F.col("f.row").alias("leader"), "n_copies"))
    joined = hot_join(sketched, several, "digest", "n_copies", share, F.col("row"), "left").withColumn("node", F.coalesce("node", "row"))
    own = F.col("node") == F.col("row")
    classed = cut(
        joined.select(
            "row", "id", "t", "node", F.when(F.col("n_copies").isNull(), F.col("id")).otherwise(F.col("set_id")).alias("set_id"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
            (F.coalesce("leader", "row") == F.col("row")).alias("leader"), F.when(own, F.col("bands")).alias("bands"),
        )
    )
    heads = classed.filter("bands is not null")
    spread = heads.select("node", F.posexplode("bands").alias("b", "band"))
    hubs = cut(spread.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("k")).filter("k > 1"))
    edges = hot_join(spread, hubs, "band", "k", share, F.col("node")).filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    groups = cut(components(edges))
    units = cut(_units(groups, spread, block)).join(heads.select("node", "t", "bands"), "node").withColumn("bands", F.when(F.col("band").isNotNull(), F.col("bands")))
    wanted = heads.join(groups.select("node"), "node", "left_semi").select("t")
    # one text a digest, however many rows have it
    asked = maybe_in(texts.select("t", "text"), wanted, "t").filter("_maybe").groupBy("t").agg(F.first("text").alias("text"))
    found = cut(_verified(asked.join(units, "t").select("pack", "unit", "side", "node", "band", "bands", "text"), n, threshold))
    links = found.groupBy("node").agg(F.sum("links").alias("links")).filter("links > 0")
    near = found.filter("node <> near").select(F.col("near").alias("a"), F.col("node").alias("b")).distinct()
    linked = cut(links.join(components(near), "node").join(heads.select("node", "set_id", "t"), "node"))
    # the smallest id of each component, nulls last, and the class that has it
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("set_id").isNull().alias("none"), "set_id", "t", "node")).alias("f")).select("root", F.col("f.set_id").alias("class_id"), F.col("f.node").alias("lead"))
    known = cut(linked.select("node", "root", "links").join(first, "root").select("node", "links", "class_id", "lead"))
    out = classed.drop("bands").join(known, "node", "left").withColumn("class_id", F.when(F.col("lead").isNull(), F.col("set_id")).otherwise(F.col("class_id")))
    leads = F.col("leader") & (F.col("node") == F.coalesce("lead", "node"))
    return out.select("id", "t", "set_id", "class_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), "n_copies", leads.alias("leads"))


def ngram_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, set_id, n_links, n_copies for every row.

    set_id is the smallest id with the same n-gram set and n_copies the number of such rows; n_links is the number of
    other set classes with Jaccard similarity of at least threshold; class_id is the smallest id that is reached over
    links and equal sets. Words are runs outside [\\x20\\x09-\\x0D], lower-cased; texts of fewer than n words have one
    gram, texts without words (null, empty) none: those form one set class without links. Null ids come after all others
    and are null in the result; rows that share an id, or have none, are told apart by their sets. Repeated rows are
    copies like others. An empty table has no rows.
    """
    return _joined(docs, n, threshold, recall, max_hashes, block, id_col, text_col).select(F.col("id").alias("doc_id"), "class_id", "set_id", "n_links", "n_copies")


def drop_near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each class of ngram_join, with all its columns, whatever their names.

    It is the row with the smallest id (null last), then the smallest digest of its text; of rows that repeat this id and
    text that with the smallest hash of all its columns, whatever the input's order. Texts without words are one class, so one of them stays. An empty table stays empty.
    """
    judged = _joined(docs, n, threshold, recall, max_hashes, block, id_col, text_col)
    name = lambda i: F.concat(F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), F.col("t"))
    fate = cut(judged.groupBy("id", "t").agg(F.max("leads").alias("stays"), F.count("*").alias("k")).filter("not stays or k > 1").select(name(F.col("id")).alias("name"), "stays", "k"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.md5(F.encode(text, "UTF-8")).alias("t"), row_hash(docs).alias("at")).select("row", name(F.col("id")).alias("name"), "at")
    marked = maybe_in(rows, fate, "name")
    met = hot_join(marked.filter("_maybe").drop("_maybe"), fate, "name", "k", fair_share(docs.sparkSession, docs.count()), F.col("at"), "left")
    once = met.filter("stays").groupBy("name").agg(F.min_by("row", "at").alias("row")).select("row")
    return marked.filter("not _maybe").select("row").unionByName(met.filter("stays is null").select("row")).unionByName(once).select("row.*")
