"""Byte-level BPE ids of a whole corpus by replaying the merges over distinct words.

Text splits into words by the vocabulary's pattern. A task takes its documents in blocks; of the words that a block adds
(those met before come from a bounded cache) all symbols lie in one sequence, and an inverted index leads from a merge
to the positions of its pair. Merges are applied in rank order, each at all its positions from left to right, and only
the neighbours of a merged pair are looked at again. A word costs one replay however often it comes, nothing is
shuffled, and memory is bounded by the block.

The vocabulary file (a public tokenizer's JSON, some MB) is read by the driver and broadcast; its size is fixed.

Defined results: null and empty texts have no ids; no special tokens are added, and their names in a text are text;
lone surrogates, which UTF-8 cannot hold, become U+FFFD.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How byte-level BPE splits text into words, and the printable stand-ins of its bytes.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

VOCABULARY = os.environ.get("PAIRLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")
#: Words kept from block to block, the longest word kept, and characters of text in a block.
CACHE_WORDS, CACHE_LENGTH, BLOCK = 300_000, 64, 4_000_000


class Merges:
    """The merge table of a byte-level BPE vocabulary file."""

    def __init__(self, text: str) -> None:
        model = json.loads(text)["model"]
        vocab = model["vocab"]
        stand_in, extra = {}, 0
        for byte in range(256):
            if byte in PRINTABLE:
                stand_in[byte] = chr(byte)
            else:
                stand_in[byte] = chr(256 + extra)
                extra += 1
        self.bytes = [vocab[stand_in[b]] for b in range(256)]
        #: (left id, right id) -> (rank, merged id)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))

    def replay(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by one replay of the merges over all of them."""
        symbol: list[int] = []
        after: list[int] = []  # the next position of the word, -1 at its end
        before: list[int] = []
        starts = []
        for word in words:
            starts.append(len(symbol))
            for byte in word.encode("utf-8", "replace"):
                symbol.append(self.bytes[byte])
                before.append(len(symbol) - 2)
                after.append(len(symbol))
            before[starts[-1]] = -1
            after[-1] = -1
        pairs = self.pairs
        index: dict[int, list[int]] = {}  # rank of a merge -> positions of its pair
        merged_id: dict[int, int] = {}
        for at, follower in enumerate(after):
            if follower >= 0 and (hit := pairs.get((symbol[at], symbol[follower]))):
                index.setdefault(hit[0], []).append(at)
                merged_id[hit[0]] = hit[1]
        queue = list(index)
        heapq.heapify(queue)
        gone = -1
        while queue:
            rank = heapq.heappop(queue)
            made = merged_id[rank]
            touched: set[int] = set()
            for at in sorted(index.pop(rank, ())):
                follower = after[at]
                if symbol[at] == gone or follower < 0 or pairs.get((symbol[at], symbol[follower]), (-1, 0))[0] != rank:
                    continue
                symbol[at], symbol[follower] = made, gone
                after[at] = after[follower]
                if after[at] >= 0:
                    before[after[at]] = at
                    touched.add(at)
                if before[at] >= 0:
                    touched.add(before[at])
            for at in touched:
                if symbol[at] != gone and after[at] >= 0 and (hit := pairs.get((symbol[at], symbol[after[at]]))):
                    if hit[0] not in index:
                        index[hit[0]] = []
                        merged_id[hit[0]] = hit[1]
                        heapq.heappush(queue, hit[0])
                    index[hit[0]].append(at)
        out = []
        for start in starts:
            ids, at = [], start
            while at >= 0:
                ids.append(symbol[at])
                at = after[at]
            out.append(ids)
        return out


class Encoder:
    """Encodes blocks of texts with a bounded cache of words."""

    def __init__(self, vocabulary: str) -> None:
        import regex

        self.merges = Merges(vocabulary)
        self.split = regex.compile(WORD_PATTERN).findall
        self.cache: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        words = [self.split(t) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(w for ws in words for w in ws) if w not in self.cache]
        known = self.cache
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list(dict.fromkeys(w for ws in words for w in ws))
        block = dict(zip(new, self.merges.replay(new)))
        known.update((w, ids) for w, ids in block.items() if len(w) <= CACHE_LENGTH)
        out = []
        for ws in words:
            ids: list[int] = []
            for w in ws:
                ids += known[w] if w in known else block[w]
            out.append(ids)
        return out


def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text or "")
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """Broadcast of the vocabulary file's text."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row."""
    table = read_vocabulary(df.sparkSession, vocabulary)
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(table.value)
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(1).to_pylist()):
                ids = pa.array(encoder.encode(block), type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), ids], names=[key, "ids"])
                at += len(block)

    return df.select(key, text).mapInArrow(run, schema)


def with_token_count(df: DataFrame, text: str, name: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the number of ids of its text, as a bigint column ``name``."""
    table = read_vocabulary(df.sparkSession, vocabulary)

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(table.value)
        for part in parts:
            yield pd.Series([len(ids) for block in _blocks(part.tolist()) for ids in encoder.encode(block)], dtype="int64")

    # Marked as not deterministic, so that a later filter on the count does not run the tokenizer twice.
    return df.withColumn(name, count.asNondeterministic()(text))
