"""Operator 1 - token-ID output: flat unsigned integer files with 64-bit offsets.

Layout of a folder written by :func:`write_token_files`::

    kind=ids/part-NNNNN-*.txt    token ids of shard NNNNN, little-endian, 2 or 4 bytes each, nothing else
    kind=index/part-NNNNN-*.txt  one record a document: id (int64), end offset in the shard (int64)
    manifest/                    Parquet: shard, base, n_docs, n_tokens, width

Shards follow one another in ascending id order; ``base`` is the number of ids
in all shards before, a prefix sum over the shards. Documents whose id is null
come first; equal ids are ordered by their text's hash, and rows equal in both,
which have the same ids, by their place in the input, so no shard holds all of
them. A null text is empty and holds the end id only. An empty table gives a
folder without shards. Extra columns are not read. Very long texts are encoded
whole. Shards are cut by bytes: about ``SHARD_BYTES`` of text each at most, and
not fewer than Spark's shuffle partitions.

Special tokens in a text are treated as the tokenizers library does by default:
their strings become their ids. ``special_as_text`` makes them ordinary text.

Spark's own text writer puts the bytes down: a row is a run of whole records
less its last byte, and that byte, zero for both kinds, is the line separator. So the files are exact binary images, on any file system Spark
knows, under Spark's commit protocol: a lost or repeated task leaves no trace.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NULL_ID = -(1 << 63)
CACHE_ENTRIES = 300_000  # chunks in each of two generations
SHARD_BYTES = 256 << 20
RUN_ROWS, RUN_BYTES = 1024, 8 << 20  # a run of records ends at either

_encoders: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """Token ids (as bytes) of texts, by chunk: a space and what follows up to the next one.

    A byte-level pre-tokeniser always cuts before a space that stands between two
    characters that are not white space, so ids of a text are those of its chunks
    in turn. The chunks of many texts that are not known yet are encoded by the
    tokenizers library in one call, in a row; each begins with a token that begins
    with the space, which no other has. Chunks are kept in two
    generations of ``CACHE_ENTRIES``: when the new one is full it becomes the old
    one, and what is used again moves over, so common ones stay and memory is
    bounded. Texts with white space beside a space or with a special token, and
    other kinds of tokenizer, are encoded whole.
    """

    def __init__(self, path: str, width: int, special_as_text: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype, self.code = np.dtype(f"<u{width}"), "H" if width == 2 else "I"
        tokens = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        self.spaced = np.array([t.startswith("Ġ") for t in tokens])
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        before = self.tokenizer.pre_tokenizer
        state = before.__getstate__() if before is not None else b""
        self.byte_level = self.tokenizer.normalizer is None and b'"ByteLevel"' in state and b'"add_prefix_space":false' in state and b'"use_regex":true' in state

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: set[str]) -> set[str]:
        """Encode the parts not known, each after a space; returns those with white space at an end, which cannot be."""
        if len(self.new) >= CACHE_ENTRIES:
            self.old, self.new = self.new, {}
        missing, odd, old = [], set(), self.old.get
        for part in parts - self.new.keys():
            if (ids := old(part)) is not None:
                self.new[part] = ids
            elif not part or part[0].isspace() or part[-1].isspace():
                odd.add(part)
            else:
                missing.append(part)
        if missing:
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(missing)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = (np.flatnonzero(self.spaced[ids]) * self.dtype.itemsize).tolist()
            body = ids.tobytes()
            self.new.update(zip(missing, map(body.__getitem__, map(slice, cuts, [*cuts[1:], len(body)])), strict=True))
        return odd

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.byte_level:
            return self.whole(texts)
        split = [[""] if any(s in t for s in self.special) else t.split(" ") for t in texts]
        odd = self.learn(set().union(*(s[1:] for s in split)))
        plain = [bool(s[0]) and not s[0][-1].isspace() and (not odd or odd.isdisjoint(s[1:])) for s in split]
        get = self.new.__getitem__
        first = iter(self.whole([s[0] if p else t for s, p, t in zip(split, plain, texts, strict=True)]))
        return [next(first) + b"".join(map(get, s[1:])) if p else next(first) for s, p in zip(split, plain, strict=True)]


def encoder(path: str, width: int, special_as_text: bool = False) -> ChunkEncoder:
    """The worker process's encoder, kept from task to task."""
    if (key := f"{width}:{special_as_text}:{path}") not in _encoders:
        _encoders[key] = ChunkEncoder(path, width, special_as_text)
    return _encoders[key]


def runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Cut rows into runs (from, to) of up to ``RUN_ROWS`` rows and ``RUN_BYTES`` bytes; a longer text is a run by itself."""
    first = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > first and (i - first >= RUN_ROWS or size + n > RUN_BYTES):
            yield first, i
            first, size = i, 0
        size += n
    if len(texts):
        yield first, len(texts)


def id_width(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else 4


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int = 2, special_as_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` into ``folder``; returns the manifest. ``end_id`` closes every document."""
    spark, width = docs.sparkSession, id_width(tokenizer_path)
    end = end_id.to_bytes(width, "little")
    if end[-1] != 0:
        raise ValueError("the end id must leave its top byte zero, as offsets do: that byte is the separator")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, done, seq = encoder(tokenizer_path, width, special_as_text).encode, 0, 0
        for batch in batches:
            for lo, hi in runs(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                bodies = [b + end for b in run([t or "" for t in part.column(1).to_pylist()])]
                index = []
                for doc, body in zip(part.column(0).to_pylist(), bodies, strict=True):
                    done += len(body) // width
                    index.append(struct.pack("<qq", NULL_ID if doc is None else doc, done))
                yield pa.record_batch({"kind": ["ids", "index"], "seq": pa.array([seq, seq], pa.int64()), "value": pa.array([b"".join(bodies)[:-1], b"".join(index)[:-1]], pa.binary())})
                seq += 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"), F.monotonically_increasing_id().alias("place"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    order = [F.asc_nulls_first("id"), F.asc("tie"), F.asc("place")]
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    records = dealt.select("id", "text").mapInArrow(encode, "kind string, seq long, value binary")
    lines = records.sortWithinPartitions("kind", "seq").select("kind", F.col("value").cast("string").alias("value"))
    lines.write.partitionBy("kind").option("lineSep", "\x00").text(folder)
    return write_manifest(spark, folder, width)


def shard_files(spark: SparkSession, folder: str, content: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.txt").load(folder)
    files = files.select("path", *(["content"] if content else []), F.regexp_extract("path", r"kind=(\w+)/", 1).alias("kind"), F.regexp_extract("path", r"part-(\d+)-", 1).cast("long").alias("shard"))
    return files


def write_manifest(spark: SparkSession, folder: str, width: int) -> DataFrame:
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                records = np.frombuffer(content, "<i8").reshape(-1, 2)
                yield pa.record_batch({"shard": pa.array([shard], pa.int64()), "n_docs": pa.array([len(records)], pa.int64()), "n_tokens": pa.array([int(records[-1, 1]) if len(records) else 0], pa.int64())})

    index = shard_files(spark, folder, True).where("kind = 'index'").select("shard", "content")
    sizes = index.mapInArrow(totals, "shard long, n_docs long, n_tokens long")
    manifest = sizes.selectExpr("shard", "coalesce(sum(n_tokens) over (order by shard rows between unbounded preceding and 1 preceding), 0) as base", "n_docs", "n_tokens", f"{width} as width")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32 (of little-endian uint32 ids).

    Where the folder is a mounted path the tasks memory-map the files; elsewhere
    Spark reads their bytes.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    mapped = folder.startswith(("file:", "/"))
    files = shard_files(spark, folder, not mapped)
    pair = [files.where(f"kind = '{k}'").select("shard", *(F.col(c).alias(f"{k}_{c}") for c in files.columns if c in ("path", "content"))) for k in ("ids", "index")]
    shards = pair[0].join(pair[1], "shard").join(manifest.select("shard", "base", "width"), "shard")
    if mapped:
        shards = shards.withColumn("ids_content", F.lit(None).cast("binary")).withColumn("index_content", F.lit(None).cast("binary"))
    columns = ["base", "width", "ids_path", "index_path", "ids_content", "index_content"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, index = (open_flat(row[f"{k}_path"], row[f"{k}_content"], t) for k, t in (("ids", f"<u{row['width']}"), ("index", "<i8")))
                index = index.reshape(-1, 2)
                ends, starts = index[:, 1], np.concatenate([[0], index[:-1, 1]])
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                keys = pa.array(index[:, 0].astype(np.int64), mask=index[:, 0] == NULL_ID)
                yield pa.record_batch({"doc_id": keys, "start": pa.array(starts.astype(np.int64) + row["base"]), "n_tokens": pa.array((ends - starts).astype(np.int64)), "ids_crc32": pa.array(crcs, pa.int64())})

    dealt = shards.select(*columns).repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def open_flat(path: str, content: bytes | None, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped by its path, or over the bytes given."""
    if content is not None:
        return np.frombuffer(content, dtype)
    from urllib.parse import unquote, urlparse

    return np.memmap(unquote(urlparse(path).path), dtype, "r")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.new_folder(spark, "tokens")
    write_token_files(common.read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, folder)


QUERIES = {"op1_token_files": op1_token_files}
ORACLES: dict[str, str] = {}
