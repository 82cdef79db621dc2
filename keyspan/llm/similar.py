"""Near-duplicate texts: SimHash links, and a second signature with a check for what they miss.

Texts are compared by their sets of word shingles.  Two ways lead to a link:

* 64-bit SimHashes of the sets that differ in two bits or fewer, by anchor-point covering
  (``simhash.fingerprint_links``): copies and the closest variants.
* A Jaccard similarity of 0.8 or more.  SimHashes of such pairs differ in some nine bits
  of 64, and the covering that would find them puts a text at hundreds of anchors, so
  candidates are texts that share a band of MinHash values: 24 bands of 5 values each, in which a
  pair with a similarity of 0.8 meets with probability 1 - (1 - 0.8 ** 5) ** 24 = 0.99993.
  Every pair that meets is verified on the shingles of its whole texts.

Bands are looked at in two steps; in the second only buckets whose texts are not yet
linked to each other are compared, so a large group of copies is not compared
24 times.  A bucket of many texts, or of many shingles, is dealt to blocks.  Within a
block the components are exact: texts are compared with all others, one at a time, until
all components but one are exhausted.  Last, where a bucket of several blocks still holds more
than one component, each text outside its largest one is compared with all blocks.  Links
leave a block as stars, one row a text at most, and a task holds one block (24 bytes a
shingle).

Shingles and texts go by 64-bit hashes: two of a million texts clash with a probability
of about 3 in 10^8.  Null texts, empty ones and texts without words have no shingles
and are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from keyspan.llm.common import CHUNK_BYTES, as_binary, map_arrow, pieces, written
from keyspan.llm.components import components
from keyspan.llm.simhash import fingerprint_links, majority

SEED = 42
SHINGLE = 5
BANDS, VALUES = 24, 5
#: Texts, and shingles, that a block holds about.
CROWD, BLOCK_SHINGLES = 1024, 4 << 20
#: Shingles whose hashes are permuted at once.
_SLICE = 1 << 11
_RANDOM = np.random.default_rng(SEED)
_MULTIPLY = _RANDOM.integers(0, 1 << 64, BANDS * VALUES, np.uint64) | np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 64, BANDS * VALUES, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text of fewer words is one, one without words has none."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    pieces = {b" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))}
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces)))


def buckets(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit value for each band, which tells bands apart."""
    import xxhash

    least = np.full(BANDS * VALUES, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), _SLICE):
        x = hashes[k : k + _SLICE, None] * _MULTIPLY + _ADD
        x ^= x >> np.uint64(32)
        np.minimum(least, (x * _MIX).min(0), out=least)
    values = [xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(least.reshape(BANDS, VALUES))]
    return np.array(values, np.uint64).view(np.int64).tolist()


def _sketched(texts: DataFrame) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = [shingles(t or b"") for t in as_binary(batch.column(1)).to_pylist()]
            fps = np.array([majority(h) if len(h) else 0 for h in found], np.uint64)
            return {"key": batch.column(0), "size": [len(h) for h in found], "fp": fps.view(np.int64), "buckets": [buckets(h) for h in found]}

        return work

    return map_arrow(texts, make, "key long, size long, fp long, buckets array<long>", "text")


#: A row for each place of a text: its bucket, block and label, whether it asks or is asked, and its shingles' hashes.
_PLACED = "bucket long, block int, key long, label long, asks boolean, shingles binary"


def _shingled(texts: DataFrame) -> DataFrame:
    """``_PLACED`` rows of texts (places, key, text), in batches of bounded size however many places a text has."""
    fields = to_arrow_schema(StructType.fromDDL(_PLACED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for part in pieces(batches, "text"):
            for places, key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_binary(part.column(2)).to_pylist()):
                body = shingles(text or b"").tobytes()
                for p in places:
                    rows.append((p["bucket"], p["block"], key, p["label"], p["asks"], body))
                    held += len(body) + 64
                    if held > CHUNK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return texts.mapInArrow(run, _PLACED)


class Shared:
    """How many shingles a text of a block has in common with each text of it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.hashes = flat[order]

    def counts(self, one: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.hashes, one), np.searchsorted(self.hashes, one, "right")
        total = high - low
        # All places of all runs, without a loop.
        places = np.repeat(low - (np.cumsum(total) - total), total) + np.arange(int(total.sum()))
        return np.bincount(self.owner[places], minlength=len(self.sizes))

    def similar(self, one: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
        """Texts whose similarity to the set ``one`` is at least the fraction ``similar``; empty sets are copies."""
        over, under = similar
        common = self.counts(one)
        return np.flatnonzero(under * common >= over * (len(one) + self.sizes - common))


def stars(sets: list[np.ndarray], similar: tuple[int, int]) -> list[tuple[int, int]]:
    """(member, least member of its group) for members that pairs of at least ``similar`` (a fraction) link.

    A member is asked for all its neighbours at once. A link between two groups is known
    once one of its ends was asked, so it is enough that all groups but one are asked whole: members
    of the largest one first, and of the rest as soon as they are fewer.
    """
    n, shared = len(sets), Shared(sets)
    label, asked, closed = np.arange(n), np.zeros(n, bool), np.zeros(n, bool)
    rounds = 0
    while True:
        open_ = np.flatnonzero(~closed)
        if not len(open_):
            break
        names, count = np.unique(label[open_], return_counts=True)
        largest = names[count.argmax()]
        inside = open_[(label[open_] == largest) & ~asked[open_]]
        outside = open_[(label[open_] != largest) & ~asked[open_]]
        if not len(outside):
            break
        if not len(inside):
            closed[label == largest] = True
            continue
        one = int(inside[0] if rounds < 16 or len(inside) <= len(outside) else outside[0])
        rounds += 1
        asked[one] = True
        near = shared.similar(sets[one], similar)
        joined = np.unique(label[near])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    return [(k, int(label[k])) for k in range(n) if label[k] != k]


_LINKS = "a long, b long"


def _linked(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _links(similar: tuple[int, int]):
    """Links within each block; rows come by bucket and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, sets = None, [], []

        def out() -> pa.RecordBatch:
            found = stars(sets, similar) if len(sets) > 1 else []
            return _linked([(keys[a], keys[b]) for a, b in found])

        for batch in batches:
            for bucket, block, key, body in zip(*(batch.column(k).to_pylist() for k in ("bucket", "block", "key", "shingles"))):
                if (bucket, block) != current:
                    yield out()
                    current, keys, sets = (bucket, block), [], []
                keys.append(key)
                sets.append(np.frombuffer(body, np.uint64))
        yield out()

    return run


def _answers(similar: tuple[int, int]):
    """Links of asking texts with a block's texts under another label; rows come by bucket and block, asking ones last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, labels, sets, shared = None, [], [], [], None
        for batch in batches:
            found = []
            for bucket, block, key, label, asks, body in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, block) != current:
                    current, keys, labels, sets, shared = (bucket, block), [], [], [], None
                one = np.frombuffer(body, np.uint64)
                if not asks:
                    keys.append(key)
                    labels.append(label)
                    sets.append(one)
                elif sets:
                    shared = shared or Shared(sets)
                    found += [(key, keys[k]) for k in shared.similar(one, similar).tolist() if labels[k] != label]
            yield _linked(found)

    return run


def _shared_buckets(sketches: DataFrame, crowd: int) -> DataFrame:
    """key, band, bucket and the bucket's number of blocks, where a bucket has several texts."""
    placed = sketches.select("key", "size", F.posexplode("buckets").alias("band", "bucket"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / crowd), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    several = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).where("n > 1")
    return placed.select("key", "band", "bucket").join(several.select("bucket", blocks.alias("blocks")), "bucket")


def _open(placed: DataFrame, labels: DataFrame) -> DataFrame:
    """The places in buckets whose texts are not all linked, with labels; buckets of the same texts once."""
    labelled = placed.join(labels, placed.key == labels.node, "left").select("key", "bucket", "blocks", F.coalesce("component", "key").alias("label"))
    members = labelled.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.bit_xor(F.xxhash64("key")).alias("all"),
        F.min("label").alias("x"), F.max("label").alias("y"),
    )
    once = members.where("x <> y").groupBy("n", "low", "high", "all").agg(F.min("bucket").alias("bucket")).select("bucket")
    return labelled.join(once, "bucket", "left_semi")


def _sets(texts: DataFrame, places: DataFrame) -> DataFrame:
    """Shingles of each text at each of its places (key, place), by bucket and block."""
    wanted = written(places.groupBy("key").agg(F.collect_list("place").alias("places")), "wanted")  # at most one place a band, or its blocks
    # Copies are combined before the join, so that a hot text is one row in it.
    first = texts.groupBy("key").agg(F.min("rid").alias("rid")).join(wanted, "key")
    whole = texts.select("rid", "key", "text").join(first.select("rid", "places"), "rid").select("places", "key", "text")
    return _shingled(whole).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "asks", "key")


def _place(block: Column, asks: bool) -> Column:
    return F.struct("bucket", block.cast("int").alias("block"), "label", F.lit(asks).alias("asks"))


def groups(texts: DataFrame, similar: tuple[int, int] = (4, 5), crowd: int = CROWD, steps: tuple[int, ...] = (4, BANDS)) -> DataFrame:
    """node, component: the keys that links join, each with the least of its group.

    ``texts``: columns rid (a row's own number), key (the same for the same text) and text; rows may repeat.
    """
    spark = texts.sparkSession
    sketches = written(_sketched(texts.select("key", "text")).groupBy("key").agg(*(F.first(c).alias(c) for c in ("size", "fp", "buckets"))), "sketches")
    by_bits = written(sketches.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    of = lambda side: by_bits.select(F.col("fp").alias(side), F.col("least").alias(f"key_{side}"))
    near = fingerprint_links(by_bits.select("fp"), 2).join(of("a"), "a").join(of("b"), "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    same = sketches.join(by_bits, "fp").where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    found = near.union(same)
    shared = written(_shared_buckets(sketches, crowd), "shared")
    at = F.pmod(F.xxhash64("key", "bucket"), F.col("blocks"))
    labels = spark.createDataFrame([], "node long, component long")
    first = 0
    for last in steps:
        places = _open(shared.where(F.col("band").between(first, last - 1)), labels).select("key", _place(at, False).alias("place"))
        found = written(found.union(_sets(texts, places).mapInArrow(_links(similar), _LINKS)).distinct(), "links")
        labels = components(found)
        first = last
    crowded = written(_open(shared.where("blocks > 1"), labels), "crowded")
    if crowded.isEmpty():
        return labels
    sizes = crowded.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    held = crowded.select("key", _place(at, False).alias("place"))
    asking = crowded.join(largest, "bucket").where("label <> largest").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = _sets(texts, held.union(asking.select("key", _place(F.col("at"), True).alias("place")))).mapInArrow(_answers(similar), _LINKS)
    return components(written(found.union(rest).distinct(), "links"))


def firsts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row of each group of texts that links join.

    It is the row with the least id, nulls last; among equal ids, that with the least
    hash of its text. Ids may repeat or be null, columns may have any name; an empty
    table gives an empty one.
    """
    text = F.col(f"`{text_column}`").cast("string")
    keyed = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = written(keyed, "rows")
    texts = rows.select("rid", "key", F.col("row").getField(text_column).cast("string").alias("text"))
    group = groups(texts, crowd=crowd)
    own = F.col("row").getField(id_column)
    # Copies meet by key before anything is joined, so a hot text is one row.
    best = rows.select("key", F.struct(own.isNull().alias("none"), own.alias("id"), "key", "rid").alias("best")).groupBy("key").agg(F.min("best").alias("best"))
    best = best.join(group, best.key == group.node, "left").groupBy(F.coalesce("component", "key").alias("group")).agg(F.min("best").alias("best"))
    return rows.join(best.select(F.col("best.rid").alias("rid")), "rid", "left_semi").select("row.*")
