"""What a worker of the byte-level BPE holds, while it encodes and after."""

import tracemalloc

import public_tokenizers as P
import pyarrow as pa

from keyspan.llm import bpe


class Rows:
    """Stands for a DataFrame: its batches go through the function in this process."""

    def __init__(self, batches):
        self.batches = batches

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return Rows(run(iter(self.batches)))

    def withColumnRenamed(self, *_):
        return self


def test_encoding_holds_little_at_once(spark):
    text = "some words of a text, 12 of them. " * 1000
    bpe.loaded(P.path("byte_bpe_50k.tiktoken"))
    batch = pa.RecordBatch.from_pydict({"id": list(range(200)), "text": [text] * 200})
    tracemalloc.start()
    made = bpe.round_trip_digests(Rows([batch]), P.path("byte_bpe_50k.tiktoken")).batches
    rows = sum(part.num_rows for part in made)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 200 and peak < 120e6, peak


def test_cache_holds_little():
    merger = bpe.Merger(bpe.loaded(P.path("byte_bpe_50k.tiktoken"))[0])
    merger.cache.encode = lambda pieces: [p[-4:] for p in pieces]
    tracemalloc.start()
    for k in range(0, 700_000, 10_000):
        merger.ids([b" %d" % i for i in range(k, k + 10_000)])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 80e6, held
