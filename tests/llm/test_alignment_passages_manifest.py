"""Alignment, passage removal and manifest against brute force on awkward rows and on a small table."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hopmine.llm import alignment, entry, merkle, substring_dedup
from hopmine.llm.common import Shelf, numbered
from hopmine.llm.fm_index import Bits, FMIndex, WaveletTree
from hopmine.llm.token_counts import byte_symbols

from .cases import ROWS, docs, none

A, B = entry.vocabulary("byte_bpe_50k.json"), entry.vocabulary("piece_bpe_32k.model")


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, x if x is not None else 0) for x in r])


# -- 11 alignment ------------------------------------------------------------------------------------------------------


def spans(raw):
    at, out = 0, []
    for r in raw:
        out.append((at, at + len(r)))
        at += len(r)
    return out


def aligned_by_force(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(byte_symbols())}
    held, docs_ = defaultdict(set), []
    for k, (i, text) in enumerate(rows):
        whole = " " + (text or "")
        a = a_lib.encode(whole, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        a_raw = [bytes(byte[c] for c in a_lib.id_to_token(x)) for x in a]
        b_raw = [bytes([int(b_lib.id_to_piece(x)[3:5], 16)]) if b_lib.is_byte(x) else b_lib.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or b"".join(a_raw) != whole.encode() or b"".join(b_raw) != whole.encode():
            docs_.append((i, [], [], [], []))
            continue
        sa, sb = spans(a_raw), spans(b_raw)
        links, j = [], 0
        for x, (start, end) in zip(a, sa):
            while sb[j][1] <= start:
                j += 1
            m = j
            while m < len(sb) and sb[m][0] < end:
                links.append((x, b[m]))
                m += 1
        groups, x, y = [], 0, 0
        for end in sorted({e for _, e in sa} & {e for _, e in sb}):
            left, right = [], []
            while x < len(sa) and sa[x][1] <= end:
                left.append(str(a[x]))
                x += 1
            while y < len(sb) and sb[y][1] <= end:
                right.append(str(b[y]))
                y += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        for pair in set(links):
            held[pair].add(k)
        docs_.append((i, a, b, links, groups))
    count = {p: len(d) for p, d in held.items()}
    best = defaultdict(int)
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    return [
        (i, len(a), len(b), len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for i, a, b, links, g in docs_
    ]


def odd_texts(seed, n):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "a", "the", "'s", "1", "é", " ", "　", ".", "-", "\r\n", "\x0b", "\x1d", "▁", "<|endoftext|>", "<s>", "<0x41>", "\0", "😀", "日本", "x" * 30]
    return [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))) for k in range(n)]


def test_alignment_by_brute_force(spark):
    rows = [(r[0], r[1]) for r in ROWS] + odd_texts(1, 300) + [(900, "the the the the the"), (901, "a▁b"), (902, " "), (903, "\n"), (904, "foo\n\n  bar  ")]
    got = alignment.alignment(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), A, B)
    assert in_order(got.collect()) == in_order(aligned_by_force(rows))


def test_alignment_of_the_table_by_brute_force(spark, sf_dir):
    got = entry.op11_alignment(spark, sf_dir)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert in_order(got.collect()) == in_order(aligned_by_force(rows))


def test_alignment_takes_clashing_columns_and_empty_tables(spark):
    assert in_order(alignment.alignment(docs(spark), A, B).collect()) == in_order(aligned_by_force([(r[0], r[1]) for r in ROWS]))
    assert alignment.alignment(none(spark), A, B).collect() == []


def test_alignment_with_small_blocks_and_an_emptied_cache(monkeypatch):
    texts = [t for _, t in odd_texts(5, 200)]
    own = alignment.Aligner(A, B)
    want = [own.aligned([t]) for t in texts]
    monkeypatch.setattr(alignment, "CACHE_UNITS", 10)
    small = alignment.Aligner(A, B)
    for t, (counts, digests, _, links) in zip(texts, want):
        got = small.aligned([t])
        assert got[0].tolist() == counts.tolist() and got[1] == digests and sorted(got[3].tolist()) == sorted(links.tolist())


def test_bitmaps_hold_lists_and_plain_bits():
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([(7 << 13) | rng.integers(0, 500, 900), (2 << 13) | rng.integers(0, 500, 20), (9 << 13) | rng.integers(0, 500, 1)]))
    pairs, n, maps = alignment.bitmaps(keys >> 13, keys & 8191, 500)
    assert sorted(pairs.tolist()) == [2, 7, 9] and max(len(m.as_py()) for m in maps) == 63
    row, place = alignment.postings(n, maps, 500)
    assert sorted(((pairs[row] << 13) | place).tolist()) == keys.tolist()


def test_many_links_of_a_pair_need_planes(spark):
    rows = [(i, "the " * n) for i, n in enumerate((1, 2, 3, 6, 200, 1000))]
    assert in_order(alignment.alignment(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A, B).collect()) == in_order(aligned_by_force(rows))


# -- 12 passages -------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_by_force(rows, window=50):
    split = [WORD.findall(t or "") for _, t in rows]
    rank = lambda i: (i is None, i or 0)
    first = {}
    for (i, _), w in zip(rows, split):
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, rank(i)), rank(i))
    out = []
    for (i, _), w in zip(rows, split):
        covered = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < rank(i):
                covered[k : k + window] = [True] * window
        kept = [x for x, c in zip(w, covered) if not c]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def passages(seed, n):
    """Texts out of one sequence over few words, with edits, long repeats, shared and missing ids."""
    rng = random.Random(seed)
    base = [rng.choice("abcdefgh") for _ in range(400)]
    out = []
    for _ in range(n):
        at = rng.randrange(0, 300)
        w = base[at : at + rng.randrange(0, 100)]
        if w and rng.random() < 0.5:
            w[rng.randrange(len(w))] = "zz"
        if rng.random() < 0.2:
            w = ["x"] * rng.randrange(1, 60)
        out.append((rng.choice([None, *range(40)]), rng.choice([" ", "\n\t ", " \x0b"]).join(w)))
    return [*out, (1, None), (2, ""), (3, " "), (9, out[0][1]), out[0], out[0], (4, "no\xa0break " * 60), (2**63 - 1, out[0][1]), (None, out[0][1])]


@pytest.mark.parametrize(("window", "gram", "most"), [(7, 3, 4096), (7, 3, 2), (12, 5, 4096), (5, 5, 1), (50, 10, 4096), (50, 10, 2)])
def test_passages_by_brute_force(spark, window, gram, most):
    rows = passages(window, 120)
    got = substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), window=window, gram=gram, most=most, shard_words=500)
    assert in_order(got.collect()) == in_order(kept_by_force(rows, window))


def test_passages_of_the_table_by_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert in_order(entry.op12_substring_dedup(spark, sf_dir).collect()) == in_order(kept_by_force(rows))


def test_passages_take_clashing_columns_and_empty_tables(spark):
    assert in_order(substring_dedup.remove_repeated_passages(docs(spark)).collect()) == in_order(kept_by_force([(r[0], r[1]) for r in ROWS]))
    assert substring_dedup.remove_repeated_passages(none(spark)).collect() == []


def test_one_passage_in_most_documents(spark):
    """The edges of a common passage have other words around them in each document: its anchors are crowded."""
    rng = random.Random(9)
    common = " ".join(f"c{i}" for i in range(80))
    own = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 60)))
    rows = [(i, f"{own()} {common} {own()}") for i in range(120)]
    got = substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), most=20).collect()
    assert in_order(got) == in_order(kept_by_force(rows)) and {r.n_removed for r in got} == {0, 80}


def test_segments_cover_every_window_once():
    rng = np.random.default_rng(4)
    texts = pa.array([" ".join(rng.choice(list("ab"), n)) for n in (0, 3, 9, 10, 11, 200, 57)])
    hashes, offsets = substring_dedup.word_hashes(texts)
    doc, start, n, *_ = substring_dedup.segments(hashes, offsets, 10, 4)
    got = sorted((d, w) for d, s, k in zip(doc.tolist(), start.tolist(), n.tolist()) for w in range(s, s + k))
    assert got == [(i, w) for i, words in enumerate(np.diff(offsets)) for w in range(words - 9)]


def test_full_text_index_by_brute_force():
    rng = np.random.default_rng(2)
    for window in (1, 2, 3, 5, 8, 9, 50):
        base = rng.integers(1, 4 if window < 10 else 40, 300)
        sequences = [base[a : a + n].copy() for a, n in zip(rng.integers(0, 200, 30), rng.integers(1, 100, 30))]
        owners = rng.integers(0, 10, 30)
        best = {}
        for s, o in zip(sequences, owners.tolist()):
            for i in range(len(s) - window + 1):
                best[tuple(s[i : i + window])] = min(best.get(tuple(s[i : i + window]), 99), o)
        for s, found in zip(sequences, FMIndex(sequences, owners, window).smallest_owners(sequences)):
            assert found.tolist() == [best[tuple(s[i : i + window])] for i in range(len(s) - window + 1)]


def test_ranks_of_bits_and_symbols():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 500):
        bits = rng.integers(0, 2, n).astype(bool)
        assert Bits(bits).ones(np.arange(n + 1)).tolist() == [int(bits[:i].sum()) for i in range(n + 1)]
        symbols = rng.integers(0, 11, n)
        tree = WaveletTree(symbols)
        for s in set(symbols.tolist()):
            assert tree.rank(np.full(n + 1, s), np.arange(n + 1)).tolist() == [int((symbols[:i] == s).sum()) for i in range(n + 1)]


# -- 13 manifest -------------------------------------------------------------------------------------------------------


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_by_force(leaves):
    """(root, proof and sides per leaf) of one tree."""
    proofs, spots, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(spots):
            other = i ^ 1
            proofs[k].append((level[other], other < i) if other < len(level) else None)
            spots[k] = i // 2
        level = [digest("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], proofs


def manifest_by_force(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: digest("".join(map(field, r)))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        trees[g] = tree_by_force([leaf(r) for r in groups[g]])
    if not order:
        return []
    root, tops = tree_by_force([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for r, own in zip(groups[g], trees[g][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            at = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for step in own + top:
                at = digest(at if step is None else step[0] + at if step[1] else at + step[0])
            out.append((r[0], leaf(r), trees[g][0], root, digest("".join(s[0] for s in own + top if s)), at, at == root))
    return out


MANIFEST = "doc_id long, source string, lang string, n_chars int, text string"


def manifest_rows(seed, n):
    rng = random.Random(seed)
    out = [(rng.choice([None, *range(3 * n)]), rng.choice([None, "s", "ß"]), rng.choice([None, "", "de", "en", "en", "en", "日"]), rng.choice([None, 1, 20]), rng.choice([None, "", "text", "é😀"])) for _ in range(n)]
    return [*out, out[0], out[0], (2**63 - 1, "s", "de", 1, "x"), (-5, "s", "en", -1, "x")]


@pytest.mark.parametrize(("n", "band"), [(1, 10), (3, 1), (40, 2), (40, 10)])
def test_manifest_by_brute_force(spark, n, band):
    """Also with bands of one and two levels, which need many of them."""
    rows = manifest_rows(n, n)
    got = merkle.checked_manifest(spark.createDataFrame(rows, MANIFEST).withColumn("tree", F.lit("x")).withColumn("pos", F.lit("x")), band)
    # rows that repeat all fields differ in nothing but their proofs, which the brute force gives in the same order
    assert in_order(got.collect()) == in_order(manifest_by_force(rows))


def test_manifest_of_one_row_and_of_none(spark):
    one = [(7, "s", "en", 3, "abc")]
    df = spark.createDataFrame(one, MANIFEST)
    assert list(map(tuple, merkle.checked_manifest(df).collect())) == manifest_by_force(one)
    assert merkle.checked_manifest(df.limit(0)).collect() == []


def test_a_slab_sends_digests_up_and_suffixes_down():
    for n in (1, 2, 3, 5, 8, 13):
        leaves = [digest(str(i)) for i in range(n)]
        levels = (n - 1).bit_length()
        top, made = merkle.forward(leaves, levels)
        root, proofs = tree_by_force(leaves)
        assert top == root
        got = merkle.backward(made, levels, ["<" + "0" * 64])
        assert got == [[("=" if s is None else ("<" if s[1] else ">") + s[0]) for s in p] + ["<" + "0" * 64] for p in proofs]


def test_numbers_follow_the_order(spark):
    rows = [(random.Random(i).choice([None, 1, 2, 3]), i % 5) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "a long, b long").repartition(7), ["a", "b"], Shelf(spark)).collect()
    assert sorted(r.at for r in got) == list(range(500))
    order = [(r.a is not None, r.a or 0, r.b) for r in sorted(got, key=lambda r: r.at)]
    assert order == sorted(order)
