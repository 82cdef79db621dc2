"""Binary token files: frequency-ranked ids, byte-aligned, control bytes apart.

The ids of a corpus are ranked by frequency (rank 0 is the commonest), and every
rank is stored in 1 to 4 bytes.  A block holds many documents: a header, one
control byte for each four ids (two bits each: bytes less one), then the data
bytes.  A reader decodes a block with numpy: a table of 256 rows gives the four
lengths behind a control byte, their running sum gives every id's place.

Blocks are rows of a dataset that Spark's own writer commits, so a lost executor
or a task tried twice leaves no half-written file, and any store that Spark writes
to will do.  Blocks are bounded by ``BLOCK_IDS`` ids; a longer document is a block
of its own.

Results for edge cases: a null or empty text is one end id; repeated doc_ids are
each stored, ordered by their text's hash; null doc_ids come first; an empty table gives
an empty dataset; columns other than id and text are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm.common import as_binary, delete, map_arrow, pieces, scratch_path, shared_dir
from keyspan.llm.segments import LOOKUP_BYTES, SegmentCache, added_strings, blank_segments, byte_level_segments, parts_of, tokenizer

#: Ids in a block, at most, but for a longer document.
BLOCK_IDS = 1 << 20
MAGIC = 0x314B4F54
HEADER = np.dtype([("magic", "<u4"), ("docs", "<u4"), ("ids", "<u8")])

#: Lengths of the four ids behind a control byte, and their sum.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2**32."""
    n = len(ranks)
    values = np.zeros(-(-n // 4) * 4, "<u4")
    values[:n] = ranks
    sizes = 1 + (values >= 1 << 8) + (values >= 1 << 16).astype(np.int64) + (values >= 1 << 24)
    codes = (sizes - 1).reshape(-1, 4)
    control = (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).astype(np.uint8)
    raw = values.view(np.uint8).reshape(-1, 4)[:n]
    data = raw[np.arange(4) < sizes[:n, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ranks behind control and data bytes."""
    sizes = LENGTHS[control].reshape(-1)[:n]
    starts = np.cumsum(sizes) - sizes
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    out = padded[starts].copy()
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        out[more] |= padded[starts[more] + k] << np.uint32(8 * k)
    return out


def block_bytes(doc_ids: list[int | None], counts: np.ndarray, ranks: np.ndarray) -> bytes:
    """One block: header, ids of documents, their token counts, control bytes, data bytes."""
    header = np.zeros(1, HEADER)
    header["magic"], header["docs"], header["ids"] = MAGIC, len(doc_ids), len(ranks)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([header.tobytes(), known.tobytes(), ids.tobytes(), counts.astype("<i8").tobytes(), *pack(ranks)])


def read_block(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, token counts and ranks of a block."""
    header = np.frombuffer(raw, HEADER, 1)[0]
    if header["magic"] != MAGIC:
        raise ValueError("not a block of token ids")
    docs, n, at = int(header["docs"]), int(header["ids"]), HEADER.itemsize
    known = np.frombuffer(raw, np.uint8, docs, at)
    ids = np.frombuffer(raw, "<i8", docs, at := at + docs)
    counts = np.frombuffer(raw, "<i8", docs, at := at + 8 * docs)
    control = np.frombuffer(raw, np.uint8, -(-n // 4), at := at + 8 * docs)
    data = np.frombuffer(raw, np.uint8, offset=at + len(control))
    return [d if k else None for d, k in zip(ids.tolist(), known.tolist())], counts, unpack(control, data, n)


def joined_encoder(path: str, kind: str):
    """A function from segments to the bytes of their ids.

    Where a segment starts with a blank and a non-blank there is a token border, whatever
    stands before.  So such segments that also end with a non-blank go through the
    library as one text.  They hold no other blank, so a token whose spelling starts with
    one starts a segment.
    """
    library = tokenizer(path)
    width = np.dtype(kind).itemsize
    opens = np.array([(library.id_to_token(i) or "").startswith("\u0120") for i in range(library.get_vocab_size())])

    def whole(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, kind) for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(segments: list[str]) -> list[bytes]:
        chains = [s.rfind(" ") == 0 and len(s) > 1 and not s[1].isspace() and not s[-1].isspace() for s in segments]
        out: list[bytes] = [b""] * len(segments)
        at = [i for i, c in enumerate(chains) if c]
        if at:
            ids = whole(["".join([segments[i] for i in at])])[0]
            starts = (width * np.flatnonzero(opens[ids])).tolist()
            raw = ids.tobytes()
            for i, a, b in zip(at, starts, [*starts[1:], len(raw)], strict=True):
                out[i] = raw[a:b]
        rest = [i for i, c in enumerate(chains) if not c]
        for i, ids in zip(rest, whole([segments[i] for i in rest])):
            out[i] = ids.tobytes()
        return out

    return encode


class TextEncoder:
    """The library's ids of whole texts, by segments that a worker remembers.

    A text is cut at blanks first.  A segment that is new is cut further, and those of its
    parts that are new go through the library.
    """

    def __init__(self, path: str, kind: str):
        self.added = added_strings(tokenizer(path))
        self.parts = SegmentCache(joined_encoder(path, kind))
        self.segments = SegmentCache(self._compose)
        self.segments.known = self.parts.known  # a segment of one part is that part

    def _compose(self, segments: list[str]) -> list[bytes]:
        lists = [[s] if s in self.added else byte_level_segments(s) for s in segments]
        values = self.parts.values([p for x in lists for p in x])
        bounds = np.cumsum([0, *map(len, lists)]).tolist()
        return [values[a] if b - a == 1 else b"".join(values[a:b]) for a, b in zip(bounds, bounds[1:])]

    def ids(self, texts: list[str]) -> list[bytes]:
        lists = []
        for text in texts:
            parts = parts_of(text, self.added)
            lists.append([s for p in parts for s in ([p] if p in self.added else blank_segments(p))])
        values = self.segments.values([s for x in lists for s in x])
        bounds = np.cumsum([0, *map(len, lists)]).tolist()
        return [b"".join(values[a:b]) for a, b in zip(bounds, bounds[1:])]


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def text_encoder(path: str, kind: str) -> TextEncoder:
    """One for each worker."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = TextEncoder(path, kind)
    return _ENCODERS[path, kind]


def id_type(vocabulary_size: int) -> str:
    """What ids are held in between encoding and coding."""
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


#: Ids and how often a task saw them, in a row of its own behind the task's documents.
SEEN = np.dtype([("token", "<u4"), ("n", "<i8")])
ENCODED = "id long, key long, ids binary, seen binary"


def encoded(df: DataFrame, vocabulary: str, end_id: int, vocabulary_size: int, kind: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, key (tie order of equal ids) and the ids of each text and its end; rows with ``seen`` count a task's ids."""
    end = np.array([end_id], kind).tobytes()
    names = [f.split()[0] for f in ENCODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = text_encoder(vocabulary, kind), np.zeros(vocabulary_size, np.int64)

        def row(ids: list, keys: list, values: list, seen: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(values, pa.binary()), pa.array(seen, pa.binary())], names=names)

        for batch in pieces(batches, "text", LOOKUP_BYTES):
            raw = [t or b"" for t in as_binary(batch.column(1)).to_pylist()]
            values = [ids + end for ids in encoder.ids([t.decode() for t in raw])]
            total += np.bincount(np.frombuffer(b"".join(values), kind), minlength=vocabulary_size)
            yield row(batch.column(0), [zlib.crc32(t) for t in raw], values, [None] * len(raw))
        found = np.zeros(np.count_nonzero(total), SEEN)
        found["token"], found["n"] = np.flatnonzero(total), total[total > 0]
        if len(found):
            yield row([None], [None], [None], [found.tobytes()])

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, ENCODED)


def frequency_ranks(seen: DataFrame, vocabulary_size: int) -> np.ndarray:
    """Ids by falling frequency (ties to the smaller). Tasks' counts are summed where they
    lie, so what reaches the driver is bounded by the vocabulary."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0).to_pylist():
                pairs = np.frombuffer(value, SEEN)
                yield pa.RecordBatch.from_pydict({"token": pairs["token"].astype(np.int64), "n": np.ascontiguousarray(pairs["n"])})

    counted = seen.mapInArrow(unpacked, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(vocabulary_size, np.int64)
    total[counted["token"].to_numpy()] = counted["n"].to_numpy()
    return np.lexsort((np.arange(vocabulary_size), -total)).astype(np.uint32)


def _blocks(by_rank: np.ndarray, kind: str):
    width = np.dtype(kind).itemsize
    rank_of = np.empty(len(by_rank), np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0

        def block(docs: list, parts: list) -> pa.RecordBatch:
            counts = np.array([len(p) // width for p in parts], np.int64)
            ranks = rank_of[np.frombuffer(b"".join(parts), kind)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([int(counts.sum())], pa.int64()),
                    pa.array([block_bytes(docs, counts, ranks)], pa.binary()),
                ],
                names=["part", "block", "n_ids", "bytes"],
            )

        docs: list = []
        parts: list = []
        held, part = 0, 0
        for batch in pieces(batches, "ids"):
            for p, d, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if docs and held + len(value) > width * BLOCK_IDS:
                    yield block(docs, parts)
                    docs, parts, held, number = [], [], 0, number + 1
                docs.append(d)
                parts.append(value)
                held, part = held + len(value), p
        if docs:
            yield block(docs, parts)

    return run


def write_tokens(df: DataFrame, path: str, vocabulary: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encodes all texts once and writes them under ``path`` in ascending id order.

    ``path/ranks`` holds the ids by rank, ``path/blocks`` the blocks, whose order is
    (part, block): parts are ranges of ids.
    """
    spark = df.sparkSession
    size = max(tokenizer(vocabulary).get_vocab_size(), end_id + 1)
    kind, ids_path = id_type(size), scratch_path(spark, "ids")
    encoded(df, vocabulary, end_id, size, kind, id_column, text_column).write.option("compression", "zstd").parquet(ids_path)
    both = spark.read.schema(ENCODED).parquet(ids_path)
    by_rank = frequency_ranks(both.where("seen is not null").select("seen"), size)
    ids = both.where("seen is null").select("id", "key", "ids")
    spark.createDataFrame(pa.table({"rank": np.arange(size, dtype=np.int64), "token": by_rank.astype(np.int64)})).coalesce(1).write.parquet(f"{path}/ranks")
    ordered = ids.repartitionByRange("id", "key").sortWithinPartitions("id", "key")
    rows = ordered.select(F.spark_partition_id().alias("part"), "id", "ids")
    rows.mapInArrow(_blocks(by_rank, kind), "part int, block long, n_ids long, bytes binary").write.option("compression", "zstd").parquet(f"{path}/blocks")
    delete(spark, ids_path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, block, seq, id, n_tokens, ids of every stored document."""
    by_rank = spark.read.parquet(f"{path}/ranks").toArrow().sort_by("rank")["token"].to_numpy().astype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "bytes"):
            for part, number, raw in zip(*(c.to_pylist() for c in batch.columns)):
                docs, counts, ranks = read_block(raw)
                ids = by_rank[ranks].tobytes()
                ends = np.cumsum(counts)
                n = len(docs)
                bounds = [0, *(4 * ends).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int64()),
                        pa.array(docs, pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                        pa.array([ids[a:b] for a, b in zip(bounds, bounds[1:])], pa.binary())
                    ],
                    names=["part", "block", "seq", "id", "before_in_block", "n_tokens", "ids"],
                )

    return spark.read.parquet(f"{path}/blocks").select("part", "block", "bytes").mapInArrow(
        run, "part int, block long, seq long, id long, before_in_block long, n_tokens long, ids binary",
    )


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, block and the ids of all blocks before it.

    There is one row for each million ids, and the running sum goes by part first:
    sums of parts, whose number is bounded by the writer, meet in one task.
    """
    from pyspark.sql import Window as W

    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block", "n_ids")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("of_part"))
    before_part = parts.select("part", (F.sum("of_part").over(W.orderBy("part")) - F.col("of_part")).alias("before_part"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("block")) - F.col("n_ids")
    return blocks.select("part", "block", inside.alias("inside")).join(before_part, "part").select(
        "part", "block", (F.col("inside") + F.col("before_part")).alias("before_block"),
    )


def stored_digests(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and ids_crc32 of every document, from the files."""
    raw = read_tokens(spark, path)
    checked = raw.select("part", "block", "id", "before_in_block", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return checked.join(block_starts(spark, path), ["part", "block"]).select(
        F.col("id").alias(id_column), (F.col("before_block") + F.col("before_in_block")).alias("start"), "n_tokens", "ids_crc32",
    )


def token_file_path(spark: SparkSession) -> str:
    """A new folder for token files beside the checkpoints."""
    return f"{shared_dir(spark)}/tokens-{scratch_path(spark, '')[-32:]}"
