"""SimHash near-duplicates by anchor-point covering.

Anchors are the code words of a perfect covering code: two fingerprints of 64 bits
that differ in at most ``threshold`` = 2 bits differ in at most one bit in their left
or in their right half, and on a half (31 bits and one more) the code words of the
Hamming code, joined by a free bit, lie within covering radius R = 1 of every word.
So each fingerprint goes to every anchor within R + 1 of either half: 17 anchors a
half at most.  If x and y differ by one bit there, y reaches the anchor nearest to x.
Members of one anchor are compared; nothing else is.

Copies share a fingerprint and are one member.  Links are emitted as stars (to the
least linked member), not as pairs.  An anchor with more than ``CROWD`` members is not
compared pairwise: each of its members goes to the 65 points within one bit of it,
and members that meet in a point are within two bits of each other, while any two
within two bits do meet; so a minimum by point finds the same components by an
aggregation that combines before it shuffles.

Results for edge cases: null and empty texts, and texts without words, have
fingerprint zero and are linked to all that have a fingerprint within two bits of
it; repeated rows share a component; a null doc_id keeps its row and never is a
component's name unless all its ids are null; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyspan.llm.common import as_binary, map_arrow, written
from keyspan.llm.components import components

SEED = 42
#: Members of an anchor that are compared with each other; more go the other exact way.
CROWD = 1024
#: Shingles whose bits are unpacked at once.
_SLICE = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of a text's word shingles; 0 for a text without words."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
        stops = (ends - 1).tolist()
        pieces = [joined[a:b] for a, b in zip(starts, stops[shingle - 1 :])]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _SLICE):
        counts += np.unpackbits(hashes[k : k + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * counts > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and fp, the fingerprint as a signed 64-bit integer."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            texts = as_binary(batch.column(1)).to_pylist()
            values = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64)
            return {"id": batch.column(0), "fp": values.view(np.int64)}

        return work

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return map_arrow(rows, make, "id long, fp long", "text")


def _syndromes() -> np.ndarray:
    """Syndrome of each 16-bit part of a 31-bit word: the XOR of its set bits' numbers, from 1."""
    table = np.zeros((2, 1 << 16), np.uint32)
    for part in range(2):
        for bit in range(16 if part == 0 else 15):
            has = (np.arange(1 << 16) >> bit & 1).astype(bool)
            table[part, has] ^= np.uint32(16 * part + bit + 1)
    return table


_SYNDROMES = _syndromes()


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors within two bits of each 32-bit word: (position in ``half``, anchor)."""
    word = half & np.uint32(0x7FFFFFFF)
    s = _SYNDROMES[0, word & np.uint32(0xFFFF)] ^ _SYNDROMES[1, word >> np.uint32(16)]
    flip = lambda number: np.where(number > 0, np.uint32(1) << (np.maximum(number, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)
    nearest = half ^ flip(s)
    index = np.arange(len(half))
    found = [(index, nearest), (index, nearest ^ np.uint32(0x80000000))]
    off = np.flatnonzero(s)  # words that are one bit from their code word: 15 more are two bits away
    for one in range(1, 32):
        a = np.uint32(one)
        other = s[off] ^ a
        use = (other > a) & (a != s[off])  # each pair of flips once; flipping s itself leads to the nearest
        at = off[use]
        found.append((at, half[at] ^ flip(np.full(len(at), a, np.uint32)) ^ flip(other[use])))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            fps = batch.column(0).slice(k, 4096).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for side in range(2):
                half = (fps >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                at, anchor = anchors(half)
                yield pa.RecordBatch.from_pydict({"anchor": anchor.astype(np.int64) << 1 | side, "fp": fps[at].view(np.int64)})


def _stars(members: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among up to ``CROWD`` members, each as (member, least linked earlier one or more)."""
    apart = np.bitwise_count(members[:, None] ^ members[None, :])
    near = np.tril(apart <= threshold, -1)
    label = np.arange(len(members))
    while True:  # least label over neighbours until nothing moves
        linked = near | near.T
        reach = np.where(linked, label[None, :], len(members)).min(1)
        new = np.minimum(label, reach)
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(members)))
    return members[moved], members[label[moved]]


def _linked_runs(fp: np.ndarray, cuts: np.ndarray, threshold: int, small: int = 32) -> np.ndarray:
    """Runs with a pair within ``threshold``; runs of more than ``small`` are taken unseen."""
    sizes = np.diff(cuts)
    run_of = np.repeat(np.arange(len(sizes)), sizes)
    hit = sizes > small
    for d in range(1, min(small, int(sizes.max(initial=1)))):
        i = np.flatnonzero((run_of[d:] == run_of[:-d]) & ~hit[run_of[d:]])
        if not len(i):
            break
        hit[run_of[i[np.bitwise_count(fp[i] ^ fp[i + d]) <= threshold]]] = True
    return np.flatnonzero(hit)


def _links(threshold: int, crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept, over = None, np.zeros(0, np.uint64), False

        def out(rows: list[tuple[np.ndarray, np.ndarray, bool]]) -> pa.RecordBatch:
            a = np.concatenate([r[0] for r in rows]).view(np.int64)
            b = np.concatenate([r[1] for r in rows]).view(np.int64)
            return pa.RecordBatch.from_pydict({"a": a, "b": b, "crowded": np.concatenate([np.full(len(r[0]), r[2]) for r in rows])})

        for batch in batches:
            anchor = batch.column(0).to_numpy()
            fp = batch.column(1).to_numpy().view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)]])
            if current is not None and anchor[0] != current:
                if len(kept) > 1 and not over:
                    a, b = _stars(kept, threshold)
                    if len(a):
                        yield out([(a, b, False)])
                kept, over = np.zeros(0, np.uint64), False
            rows = []
            sizes = np.diff(cuts)
            # Only runs with a link, and those that touch the batch's ends, are looked at singly.
            runs = [k for k in _linked_runs(fp, cuts, threshold).tolist() if k not in (0, len(sizes) - 1)]
            for k in sorted({0, len(sizes) - 1, *runs}):
                members = fp[cuts[k] : cuts[k + 1]]
                if k == 0:
                    members = np.concatenate([kept, members])
                if k == 0 and over or len(members) > crowd:
                    rows.append((members, members, True))
                    kept, over = np.zeros(0, np.uint64), True
                else:
                    kept, over = members, False
                if k < len(sizes) - 1:
                    if not over and len(kept) > 1:
                        rows.append((*_stars(kept, threshold), False))
                    kept, over = np.zeros(0, np.uint64), False
            current = anchor[-1]
            rows = [r for r in rows if len(r[0])]
            if rows:
                yield out(rows)
        if len(kept) > 1 and not over:
            a, b = _stars(kept, threshold)
            if len(a):
                yield out([(a, b, False)])

    return run


def fingerprint_links(distinct: DataFrame, threshold: int = 2, crowd: int = CROWD) -> DataFrame:
    """a, b: links that join the same fingerprints as all pairs within ``threshold`` do.

    ``distinct`` has one column, fp, each value once. The code is made for 2 bits or fewer.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("anchors of this code serve thresholds of 0 to 2 bits")
    placed = distinct.select("fp").mapInArrow(_to_anchors, "anchor long, fp long")
    placed = placed.repartition("anchor").sortWithinPartitions("anchor", "fp")
    found = written(placed.mapInArrow(_links(threshold, crowd), "a long, b long, crowded boolean"), "links")
    links = found.where("not crowded").select("a", "b")
    if threshold < 2:  # points within one bit would join members two bits apart
        return links.union(_exact_crowds(found, threshold))
    points = F.concat(
        F.array(F.col("a")),
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("a").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))),
    )
    ball = found.where("crowded").select("a").distinct().select("a", F.explode(points).alias("point"))
    least = ball.groupBy("point").agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least <> most")
    # Every member of a point meets its least one: 65 rows a member, and no pairs.
    met = ball.join(least.select("point", "least"), "point").select("a", F.col("least").alias("b")).where("a <> b")
    return links.union(met).distinct()


def _exact_crowds(found: DataFrame, threshold: int) -> DataFrame:
    """Crowded members' links for 0 or 1 bit: a member's own neighbours, looked up."""
    members = found.where("crowded").select("a").distinct()
    if threshold == 0:
        return members.where("false").select("a", F.col("a").alias("b"))
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("a").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    return members.select("a", F.explode(flips).alias("b")).join(members.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")


def near_duplicates(df: DataFrame, shingle: int = 3, threshold: int = 2, id_column: str = "doc_id", text_column: str = "text", crowd: int = CROWD) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id of every row.

    The component is that of fingerprints linked by ``threshold`` or fewer bits; its
    name is the smallest id in it.
    """
    rows = written(fingerprints(df, shingle, id_column, text_column), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    linked = components(fingerprint_links(distinct, threshold, crowd))
    named = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    # Names go by distinct fingerprints, so a hot one is one row until the last join.
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("fp", "component_id")
    # The left side keeps its rows where they are split: Spark divides a hot fingerprint's.
    out = rows.join(named, "fp", "left")
    return out.select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
