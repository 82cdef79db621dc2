"""Near-duplicates of the pipeline against brute force over all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from keyspan.llm import similar


def _set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def _bits(shingles):
    """64-bit SimHash of a set of shingles."""
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def kept_ids(rows):
    """Ids that stay: the least of each group that a Jaccard similarity of 0.8, or SimHashes within 2 bits, link."""
    sets = {i: _set(t) for i, t in rows}
    bits = {i: _bits(s) for i, s in sets.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared) or (bits[a] ^ bits[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in ids if find(i) == i)


def test_near_copies_go_and_clean_documents_stay(spark):
    draw = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    rows, copies = [], set()
    for i in range(0, 600, 6):
        text = draw.choices(words, k=draw.randint(60, 400))
        rows.append((i, " ".join(text)))
        for k in range(1, 1 + draw.randint(0, 5)):  # words changed, some of the copies below 0.8
            other = list(text)
            for at in draw.sample(range(len(other)), round(len(other) * k / 160)):
                other[at] = "changed"
            rows.append((i + k, " ".join(other)))
            copies.add(i + k)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert found == kept_ids(rows)
    assert set(range(0, 600, 6)) <= set(found) and len(copies - set(found)) > len(copies) / 2
    assert found == sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df.repartition(5), "").collect())


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert found == kept_ids([tuple(r) for r in docs.collect()])


def _linked(sets, similar_by):
    """Groups by all pairs."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    over, under = similar_by
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            shared = len(np.intersect1d(a, b))
            if under * shared >= over * (len(a) + len(b) - shared):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def test_stars_link_as_all_pairs_do():
    sets = [np.arange(a, b).astype(np.uint64) for a, b in [(0, 10), (1, 11), (2, 12), (50, 60), (0, 0), (0, 0), (50, 58)]]
    # 0-1 and 1-2 share 9 of 11, 0-2 only 8 of 12; 3-6 share 8 of 10; sets without members are alike
    assert similar.stars(sets, (4, 5)) == [(1, 0), (2, 0), (5, 4), (6, 3)]
    assert similar.stars(sets[:3], (9, 10)) == []
    draw = np.random.default_rng(1)
    for _ in range(60):  # chains, crowds of variants and strangers
        base = draw.integers(0, 1 << 62, 60, dtype=np.uint64)
        made = []
        for _ in range(int(draw.integers(2, 60))):
            one = (base if draw.random() < 0.6 else made[-1] if made else base).copy()
            at = draw.choice(len(one), int(draw.integers(0, 14)), replace=False)
            one[at] = draw.integers(0, 1 << 62, len(at), dtype=np.uint64)
            made.append(np.unique(one))
        label = list(range(len(made)))
        for member, least in similar.stars(made, (4, 5)):
            label[member] = least
        assert label == _linked(made, (4, 5))


@pytest.mark.parametrize("crowd", [5, 1024])
def test_crowds_in_blocks_lose_no_link(spark, crowd):
    """Many variants of few texts: buckets of several blocks, chains across them, and strangers that share bands."""
    draw = random.Random(6)
    rows = []
    for base in range(4):
        text = [f"b{base}w{k}" for k in range(150)]
        for _ in range(40):
            other = list(text if draw.random() < 0.7 or not rows else rows[-1][1].split())
            for at in draw.sample(range(len(other)), draw.randint(0, 4)):
                other[at] = f"n{draw.randint(0, 99999)}"
            rows.append((len(rows), " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(r["doc_id"] for r in similar.firsts(df, crowd=crowd).collect())
    assert found == kept_ids(rows)
