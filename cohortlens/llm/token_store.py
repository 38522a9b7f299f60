"""Token ids in ORC, read back stripe by stripe.

Documents are range-partitioned and sorted by id, tokenised, and written as
ORC: the ids column takes ORC's integer run-length encoding, ``doc_id`` has
row indexes and a Bloom filter, and each file holds one id range, so a reader
splits by stripe and a filter on ``doc_id`` skips files, stripes and row
groups. Stream offsets come from the read files: totals per range (one row
each) and a running sum inside a range.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import materialise, row_slices
from .text import all_rows, ragged_take, spaced_pieces

SCHEMA = "doc_id bigint, range_id int, seq bigint, ids array<int>"
#: pieces kept by a worker, for either kind; more only cost another encoding
CACHE_PIECES = 200_000
SLICE_BYTES = 4 << 20
LONG_STRING = 1 << 16


class PieceEncoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    Pieces that came up in two slices are kept with their ids, those of one
    slice only until later ones fill ``CACHE_PIECES``; a kept dictionary is
    looked up by Arrow, as arrays. What is kept changes the cost alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab()
        # bytes of each token: one character of the byte alphabet each
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token)
        self.kept, self.recent = _Known(), _Known()

    def slow_pieces(self, text: str) -> list[str]:
        """The library's own pieces of a text, special tokens apart."""
        import re

        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]
        out: list[str] = []
        for part in parts:
            if part in self.special:
                out.append(part)
            else:
                out += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces made of a blank and letters, encoded in long strings; None if the cuts don't fit.

        Such pieces put together are cut at each blank again, and token bytes
        add up to text bytes, so the running sum finds every piece's tokens.
        """
        sizes = pc.binary_length(words).to_numpy().astype(np.int64)
        at = _offsets(words)
        data = words.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])).to_pybytes()
        ends = np.cumsum(sizes)
        cuts = [0, *ends[np.searchsorted(ends, np.arange(LONG_STRING, ends[-1], LONG_STRING))].tolist(), int(ends[-1])]
        texts = [data[i:j].decode() for i, j in zip(cuts[:-1], cuts[1:]) if i < j]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        done = np.cumsum(self.token_bytes[ids])
        last = np.searchsorted(done, ends)
        if last[-1] >= len(done) or not np.array_equal(done[last], ends):
            return None
        return ids, np.diff(last + 1, prepend=0)

    def _singly(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(pieces.to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.uint32, int(sizes.sum())), sizes

    def _encoded(self, new: pa.Array) -> tuple[_Known, np.ndarray]:
        """Pieces that are not known yet with their ids, and their places in ``new``."""
        plain = pc.match_substring_regex(new, r"^ \p{L}+$")
        words, others = pa.concat_arrays([new.filter(plain)]), new.filter(pc.invert(plain))
        found = self._words(words) if len(words) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if found is None:
            found = self._singly(words)
        rest = self._singly(others)
        mask = plain.to_numpy(zero_copy_only=False)
        return (_Known(pa.concat_arrays([words, others]), *(np.concatenate(x) for x in zip(found, rest))),
                np.concatenate([np.flatnonzero(mask), np.flatnonzero(~mask)]))

    def lists(self, values: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat id lists, their lengths, and for each of the distinct ``values`` the number of its list."""
        pieces = values if isinstance(values, pa.Array) else pa.array(values, pa.string())
        known = self.kept + self.recent
        at = pc.index_in(pieces, value_set=known.pieces).fill_null(-1).to_numpy().astype(np.int64)
        absent = np.flatnonzero(at < 0)
        again = np.zeros(len(known.sizes), bool)
        again[at[at >= 0]] = True
        again = again[len(self.kept.sizes):]
        new, places = self._encoded(pieces.take(pa.array(absent)))
        at[absent[places]] = len(known.sizes) + np.arange(len(places))
        everything = known + new
        self.kept = (self.kept + self.recent.take(again)).last(CACHE_PIECES)
        self.recent = (self.recent.take(~again) + new).last(CACHE_PIECES)
        return everything.ids, everything.sizes, at

    def encode(self, texts: pa.Array, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all rows, each row followed by ``last``, and the rows' ends."""
        pieces = all_rows(texts, spaced_pieces, self.slow_pieces)
        flat, lengths, lists = self.lists(pieces.values)
        ids, piece_ends = ragged_take(flat, lengths, lists[pieces.codes])
        row_ends = np.concatenate([[0], piece_ends])[pieces.ends[1:]]
        return np.insert(ids, row_ends, last), row_ends + np.arange(1, len(row_ends) + 1)


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)


@dataclass
class _Known:
    """Pieces and their ids: ``sizes[k]`` of ``ids`` for piece k, in order."""

    pieces: pa.Array = field(default_factory=lambda: pa.array([], pa.string()))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __add__(self, other: _Known) -> _Known:
        return _Known(pa.concat_arrays([self.pieces, other.pieces]), np.concatenate([self.ids, other.ids]),
                      np.concatenate([self.sizes, other.sizes]))

    def take(self, which: np.ndarray) -> _Known:
        return _Known(self.pieces.filter(pa.array(which)), self.ids[np.repeat(which, self.sizes)], self.sizes[which])

    def last(self, n: int) -> _Known:
        if len(self.sizes) <= n:
            return self
        return self.take(np.arange(len(self.sizes)) >= len(self.sizes) - n)


@lru_cache(maxsize=2)
def worker_encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker, so later tasks start with its known pieces."""
    return PieceEncoder(path)


def write_token_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int,
                      ranges: int | None = None) -> None:
    """Write ``doc_id, range_id, seq, ids`` as ORC at ``path``.

    ``range_id, seq`` is the ascending order of ``doc_id`` (nulls first;
    repeated ids by the text's hash, then by text, so that ranges can end
    among them). A null or empty text has ``end_id`` alone.
    """
    n = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, seq = worker_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for b in batches:
            for i, j in row_slices(b.column(1), SLICE_BYTES):
                ids, ends = encoder.encode(b.column(1).slice(i, j - i), end_id)
                rows = j - i
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()),
                                                 pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, rows), pa.array(np.full(rows, part, np.int32)),
                     pa.array(np.arange(seq, seq + rows)), lists], names=["doc_id", "range_id", "seq", "ids"])
                seq += rows

    ordered = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
               .withColumn("h", F.xxhash64("text"))
               .repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h"))
    (ordered.mapInArrow(run, SCHEMA).write
     .option("compression", "zstd").option("orc.stripe.size", str(64 << 20)).option("orc.row.index.stride", "1000")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path))


def read_token_store(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """``doc_id, range_id, seq, ids``; ``doc_ids`` reaches the ORC reader, which prunes by its metadata."""
    stored = spark.read.schema(SCHEMA).orc(path)
    return stored if doc_ids is None else stored.where(F.col("doc_id").isin(list(doc_ids)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(3)
        flat = lists.values.to_numpy().astype("<u4", copy=False)
        offsets = lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pc.list_value_length(lists).cast(pa.int64()),
             pa.array(crc, pa.int64())], names=["doc_id", "range_id", "seq", "n_tokens", "ids_crc32"])


def stream_index(stored: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document.

    ``start`` counts the ids of all documents before it. A range is one
    sorted partition of the writer, so its running sum stays bounded; ranges
    are added up from one row each. The ids are read once: counts and
    checksums are written before they are added up.
    """
    sums = materialise(stored.select("doc_id", "range_id", "seq", "ids").mapInArrow(
        _sums, "doc_id bigint, range_id int, seq bigint, n_tokens bigint, ids_crc32 bigint"), "token-sums")
    totals = sums.groupBy("range_id").agg(F.sum("n_tokens").alias("tokens"))
    # one row per written range: bounded by the writer's partition count
    before = totals.select("range_id", (F.sum("tokens").over(Window.orderBy("range_id")) - F.col("tokens")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("range_id").orderBy("seq")) - F.col("n_tokens")
    return (sums.withColumn("inside", inside).join(F.broadcast(before), "range_id")
            .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def store_path(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/token-store-{uuid.uuid4().hex}"
