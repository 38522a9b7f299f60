"""BPE encoding and decoding through a table of distinct words.

Words are split once per block of documents; a document becomes positions
into its block's word list. One row per (block, word) goes to the word, where
each distinct word is encoded once; its ids go back to the block and replace
the positions. A word as common as you like has one row per block. Documents
never move: they stay in a table bucketed by block, and only word lists are
shuffled. Decoding looks each id up in the id-to-piece table of the
vocabulary, whose size is fixed by the tokenizer file.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import row_slices
from .text import all_rows, lower_words, ragged_take

BLOCK_BYTES = 32 << 20
#: every call writes a bucketed table of this prefix; see :func:`drop_block_tables`
BLOCK_TABLES = "bpe_blocks_"
BLOCK_SCHEMA = "block bigint, idx int, word string, doc_id bigint, seq binary"
ANSWER_SCHEMA = "block bigint, idx binary, sizes binary, ids binary"


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def word_splitter(tokenizer) -> Callable[[str], list[str]]:
    """The library's own words of a text, special tokens apart (for rows that are not plain)."""
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    marks = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def split(text: str) -> list[str]:
        out: list[str] = []
        for part in marks.split(text) if marks else [text]:
            if part in special:
                out.append(part)
            elif part:
                norm = tokenizer.normalizer.normalize_str(part)
                out += [norm[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(norm)]
        return out

    return split


def _split_blocks(path: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = word_splitter(load_tokenizer(path))
        pack = zstandard.ZstdCompressor(level=3)
        part, number, held = TaskContext.get().partitionId(), 0, 0
        index: dict[str, int] = {}

        def out(n, idx=None, words=None, ids=None, seqs=None) -> pa.RecordBatch:
            block = np.full(n, (part << 24) + number, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(block), pa.array(idx, pa.int32()) if idx is not None else pa.nulls(n, pa.int32()),
                 pa.array(words, pa.string()) if words is not None else pa.nulls(n, pa.string()),
                 ids if ids is not None else pa.nulls(n, pa.int64()),
                 pa.array(seqs, pa.binary()) if seqs is not None else pa.nulls(n, pa.binary())],
                names=["block", "idx", "word", "doc_id", "seq"])

        def word_rows() -> Iterator[pa.RecordBatch]:
            words = list(index)
            for at in range(0, len(words), 20_000):
                some = words[at:at + 20_000]
                yield out(len(some), idx=np.arange(at, at + len(some), dtype=np.int32), words=some)

        for b in batches:
            for i, j in row_slices(b.column(1)):
                texts = b.column(1).slice(i, j - i)
                if held and held + texts.nbytes > block_bytes:
                    yield from word_rows()
                    index.clear()
                    number, held = number + 1, 0
                held += texts.nbytes
                pieces = all_rows(texts, lower_words, split)
                place = np.array([index.setdefault(v, len(index)) for v in pieces.values], np.uint32)
                seq = place[pieces.codes] if len(place) else np.zeros(0, np.uint32)
                packed = [pack.compress(seq[s:e].tobytes()) for s, e in zip(pieces.ends[:-1], pieces.ends[1:])]
                yield out(j - i, ids=b.column(0).slice(i, j - i), seqs=packed)
        yield from word_rows()

    return run


def _encode_words(path: str):
    """Words arrive sorted, so equal words of all blocks are neighbours; each is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(path)
        last_word, last_ids = None, None
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            coded = b.column(2).dictionary_encode()
            words = coded.dictionary.to_pylist()
            known = {last_word: last_ids} if last_word is not None and words and words[0] == last_word else {}
            new = [w for w in words if w not in known]
            for w, e in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                known[w] = array("I", e.ids).tobytes()
            if words:
                last_word, last_ids = words[-1], known[words[-1]]
            lists = [known[w] for w in words]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
            flat = np.frombuffer(b"".join(lists), np.uint32)
            codes = coded.indices.to_numpy()
            block, idx = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            rows = []
            for mine in np.split(order, cuts) if len(order) else []:
                ids, _ = ragged_take(flat, lengths, codes[mine])
                rows.append((int(block[mine[0]]), pack(idx[mine].astype(np.uint32).tobytes()),
                             pack(lengths[codes[mine]].astype(np.uint32).tobytes()), pack(ids.tobytes())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), *[pa.binary()] * 3))],
                names=["block", "idx", "sizes", "ids"])

    return run


def _restore(path: str, finish: Callable, names: list[str]):
    """Put ids in the place of word positions, one block at a time."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        tokenizer = load_tokenizer(path)
        pieces = np.array([tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())], object)

        unpack = zstandard.ZstdDecompressor()

        def joined(column: str) -> np.ndarray:
            return np.frombuffer(b"".join(map(unpack.decompress, answers.column(column).to_pylist())), np.uint32)

        idx, sizes, flat = joined("idx"), joined("sizes").astype(np.int64), joined("ids")
        ends = np.cumsum(sizes)
        n = int(idx.max()) + 1 if len(idx) else 0
        lengths, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lengths[idx], starts[idx] = sizes, ends - sizes
        rows = []
        for packed in docs.column("seq"):
            seq = np.frombuffer(unpack.decompress(packed.as_py()), np.uint32)
            parts = []
            for at in range(0, len(seq), 1 << 20):
                some = seq[at:at + (1 << 20)]
                size = lengths[some]
                stop = np.cumsum(size)
                total = int(stop[-1]) if len(stop) else 0
                parts.append(flat[np.repeat(starts[some] - (stop - size), size) + np.arange(total)])
            rows.append(finish(np.concatenate(parts) if parts else np.zeros(0, np.uint32), pieces))
        columns = [docs.column("doc_id").combine_chunks()]
        columns += [pa.array([r[k] for r in rows]) for k in range(len(names) - 1)]
        return pa.table(columns, names=names)

    return run


def drop_block_tables(spark: SparkSession) -> int:
    """Forget the block tables of earlier calls; results that have not been read yet need theirs.

    Returns how many there were. Their files stay in the shared folder.
    """
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith(BLOCK_TABLES)]
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return len(names)


def decode(ids: np.ndarray, pieces: np.ndarray) -> str:
    """Pieces of ``ids`` joined by blanks: what the library does for a file without a decoder."""
    return " ".join(pieces[ids].tolist())


def _digest(ids: np.ndarray, pieces: np.ndarray) -> tuple:
    return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
            hashlib.sha256(decode(ids, pieces).encode()).hexdigest())


def _whole(ids: np.ndarray, pieces: np.ndarray) -> tuple:
    return ids.astype(np.int64).tolist(), decode(ids, pieces)


def _through_words(docs: DataFrame, path: str, finish: Callable, schema: str, block_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    name = f"{BLOCK_TABLES}{uuid.uuid4().hex}"
    (source.mapInArrow(_split_blocks(path, block_bytes), BLOCK_SCHEMA).write.format("parquet")
     .option("compression", "zstd").option("path", f"{checkpoint_dir(spark).rstrip('/')}/{name}")
     .bucketBy(buckets, "block").saveAsTable(name))
    blocks = spark.table(name)
    asked = blocks.where("word is not null").select("block", "idx", "word")
    answers = (asked.repartition("word").sortWithinPartitions("word")
               .mapInArrow(_encode_words(path), ANSWER_SCHEMA))
    texts = blocks.where("seq is not null").select("block", "doc_id", "seq")
    names = [f.split()[0] for f in schema.split(", ")]
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _restore(path, finish, names), schema)


def encode_digests(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row.

    A null or empty text has no token. Repeated rows each get their row, a
    null ``doc_id`` stays null, extra columns are ignored, an empty table
    gives an empty result. A text longer than ``block_bytes`` is a block of
    its own.
    """
    return _through_words(docs, path, _digest,
                          "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", block_bytes)


def encode_documents(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, ids, decoded`` per row; cases as in :func:`encode_digests`."""
    return _through_words(docs, path, _whole, "doc_id bigint, ids array<bigint>, decoded string", block_bytes)
