"""Token ids in fixed-width bit-packed files.

A file image holds a run of whole documents in id order:

    magic "GLBP" | u32 width | u64 ids | u32 ids a block | u32 blocks | u64 offset of each block | blocks

Every id takes the bits that the largest id of the vocabulary needs; a block holds
a fixed number of ids and starts on a byte, so any id range is read by unpacking
only the blocks that it meets. Images are rows of a Parquet table, written by
Spark's committer: a lost executor leaves no half-written file, and any store that
Spark reaches will do. Beside an image stand its documents' ids and lengths.

Defined results: null and empty texts give the end id alone; repeated doc_ids
stand next to each other, by a hash of their texts; null doc_ids come first; an empty table gives an empty
file set; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, id_text

_MAGIC = b"GLBP"
BLOCK_IDS = 4096
FILE_IDS = 1 << 20
_FILE_SCHEMA = "part long, file long, first long, n_ids long, doc_ids array<long>, lengths array<long>, image binary"


def pack(ids: np.ndarray, width: int, block_ids: int = BLOCK_IDS) -> bytes:
    n = len(ids)
    n_blocks = -(-n // block_ids)
    if n and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit in {width} bits")
    body, offsets = [], []
    at = 24 + 8 * n_blocks
    for i in range(n_blocks):
        part = ids[i * block_ids : (i + 1) * block_ids].astype("<u4")
        if width % 8 == 0:
            raw = part.view(np.uint8).reshape(-1, 4)[:, : width // 8].tobytes()
        else:
            bits = (part[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
            raw = np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()
        offsets.append(at)
        at += len(raw)
        body.append(raw)
    head = _MAGIC + np.array([width], "<u4").tobytes() + np.array([n], "<u8").tobytes() + np.array(
        [block_ids, n_blocks], "<u4",
    ).tobytes()
    return head + np.array(offsets, "<u8").tobytes() + b"".join(body)


class PackedFile:
    """Random access to a file image."""

    def __init__(self, image: bytes):
        if image[:4] != _MAGIC:
            raise ValueError("not a packed id file")
        self.image = image
        self.width = int(np.frombuffer(image, "<u4", 1, 4)[0])
        self.n = int(np.frombuffer(image, "<u8", 1, 8)[0])
        self.block_ids, self.n_blocks = (int(x) for x in np.frombuffer(image, "<u4", 2, 16))
        self.offsets = np.frombuffer(image, "<u8", self.n_blocks, 24)

    def block(self, i: int) -> np.ndarray:
        n = min(self.block_ids, self.n - i * self.block_ids)
        size = -(-n * self.width // 8)
        raw = np.frombuffer(self.image, np.uint8, size, int(self.offsets[i]))
        if self.width % 8 == 0:
            wide = np.zeros((n, 4), np.uint8)
            wide[:, : self.width // 8] = raw.reshape(n, -1)
            return wide.reshape(-1).view("<u4")
        bits = np.unpackbits(raw, count=n * self.width, bitorder="little").reshape(n, self.width)
        return (bits.astype(np.uint32) << np.arange(self.width, dtype=np.uint32)).sum(1, dtype=np.uint32)

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n if stop is None else min(stop, self.n)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        got = np.concatenate([self.block(i) for i in range(first, last + 1)])
        return got[start - first * self.block_ids : stop - first * self.block_ids]


@cache
def encoder(path: str):
    """The tokenizer of a file; one for each worker process, whose next tasks use it again."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(tokenizer, texts: list[str]) -> list[np.ndarray]:
    """The ids of each whole text."""
    return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def vocabulary_bits(path: str) -> int:
    return max(1, (encoder(path).get_vocab_size(with_added_tokens=True) - 1).bit_length())


def write_tokens(
    docs: DataFrame, tokenizer_path: str, out: str, end_id: int | None = 2, id_col: str = "doc_id",
    text_col: str = "text", file_ids: int = FILE_IDS,
) -> None:
    """Tokenise docs and write the files to out, in ascending doc_id order over all parts.

    A file takes whole documents until it has file_ids ids; a longer document has a file of its own size.
    """
    width = vocabulary_bits(tokenizer_path)
    tail = np.array([] if end_id is None else [end_id], "<u4")

    def run(batches):
        from pyspark import TaskContext

        part, tokenizer = TaskContext.get().partitionId(), encoder(tokenizer_path)
        file = first = held = 0
        ids: list[np.ndarray] = []
        names: list = []

        def flush():
            nonlocal file, first, held, ids, names
            lengths = [len(x) for x in ids]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()), pa.array([file], pa.int64()), pa.array([first], pa.int64()),
                    pa.array([held], pa.int64()), pa.array([names], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([pack(np.concatenate(ids), width)], pa.binary()),
                ],
                ["part", "file", "first", "n_ids", "doc_ids", "lengths", "image"],
            )
            file, first, held, ids, names = file + 1, first + held, 0, [], []
            return out

        for b in batches:
            for at in range(0, b.num_rows, 100):
                cut = b.slice(at, 100)
                for name, got in zip(
                    cut.column(0).to_pylist(), encode(tokenizer, cut.column(1).to_pylist()), strict=True,
                ):
                    whole = np.concatenate([got, tail])
                    if held and held + len(whole) > file_ids:
                        yield flush()
                    ids.append(whole)
                    names.append(name)
                    held += len(whole)
        if names:
            yield flush()

    # The hash spreads the rows of one id, or without one, over several parts.
    rows = id_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    rows.select("doc_id", "text").mapInArrow(run, _FILE_SCHEMA).write.parquet(out)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of written files: doc_id, start, n_tokens, ids_crc32, and ids if asked for.

    start counts the ids of all documents before it. Only one sum for each written
    part, as many as the writing job had tasks, goes through the driver.
    """

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = PackedFile(r["image"]).read()
                ends = np.cumsum(r["lengths"])
                starts = ends - np.array(r["lengths"], np.int64)
                each = [ids[a:z] for a, z in zip(starts, ends, strict=True)]
                cols = [
                    pa.array([r["part"]] * len(each), pa.int64()), pa.array(r["doc_ids"], pa.int64()),
                    pa.array(starts + r["first"], pa.int64()), pa.array(r["lengths"], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64()),
                ]
                names = ["part", "doc_id", "local", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    files = spark.read.parquet(path)
    sums, total = [], 0
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        sums.append((r["part"], total))
        total += r["n"]
    base = spark.createDataFrame(sums, "part long, base long")
    rows = files.mapInArrow(
        run, "part long, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids,
    )
    more = ["ids"] if with_ids else []
    return rows.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *more,
    )


def token_output(
    docs: DataFrame, tokenizer_path: str, out: str | None = None, end_id: int | None = 2, **cols: str,
) -> DataFrame:
    """Write docs' ids to `out` (default: the shared folder) and return what read_tokens finds there."""
    spark = docs.sparkSession
    out = out or fresh_path(spark, "tokens")
    write_tokens(docs, tokenizer_path, out, end_id, **cols)
    return read_tokens(spark, out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
