"""Token-id files: documents compressed one by one under a shared zstandard dictionary.

Layout of a set of files under one folder::

    dict-<sha256>.zdict     the dictionary, trained on serialized id arrays
    shard-<number>.lxt      magic, width, dictionary hash, frames, index, end of file record

Ids are little-endian, two bytes wide where the vocabulary allows it, else four. The index has
(doc_id, null flag, offset, size, ids) for each document in file order, so a short document is
one seek and one small frame. Documents ascend by doc_id within and across shards.
"""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import fresh_path, shuffle_partitions, whole_text

#: Fixed values of the format.
MAGIC = b"LXT1"
HEAD = "<4sB32s"  # magic, bytes per id, dictionary hash
ENTRY = "<i8,<u1,<u8,<u4,<u8"  # doc_id, null flag, offset, size, ids
TAIL = "<QQ4s"  # index offset, documents, magic

END_ID = 2
DICTIONARY_BYTES = 64 * 1024
TRAINING_DOCS = 2000  # bounds of the sample that the dictionary learns from; it affects sizes, never contents
TRAINING_BYTES = 16 << 20
LEVEL = 3
MANIFEST = "shard bigint, path string, docs bigint, tokens bigint"
READ = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _index_type():
    import numpy as np

    return np.dtype([(n, t) for n, t in zip(("doc_id", "null", "offset", "size", "ids"), ENTRY.split(","))])


def _width(vocab: int) -> int:
    return 2 if vocab <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, tokenizer_path: str, out: str, end_id: int, size: int, rows: int) -> tuple[str, bytes]:
    """Train on whole texts of at most ``rows`` documents and ``TRAINING_BYTES``, and store the result.

    They are those with an id and a text of the smallest hashes; one that is too long for what is
    left of the bytes is passed over. The sample decides about sizes, never about contents.
    """
    import numpy as np
    import zstandard

    from lexweave.llm.tokens import encoder

    able = docs.where(F.col("doc_id").isNotNull() & (F.col("text") != "")).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    chosen, left = [], TRAINING_BYTES
    for r in able.select("h", F.octet_length("text").alias("n")).orderBy("h", "n").limit(rows).collect():
        if r["n"] <= left:
            chosen.append((r["h"],))
            left -= r["n"]
    known = docs.sparkSession.createDataFrame(sorted(set(chosen)), "_h long")
    some = able.join(F.broadcast(known), F.col("h") == F.col("_h")).groupBy("h").agg(F.max("text").alias("text")).orderBy("h")  # a hash is one text
    enc = encoder(tokenizer_path)
    kind = f"<u{_width(enc.vocab_size)}"
    texts = [r["text"].encode() for r in some.collect()]
    samples = [np.frombuffer(x, "<u4").astype(kind).tobytes() for i in range(0, len(texts), 200) for x in enc.encode(texts[i : i + 200])]
    try:
        raw = zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        raw = b""
    name = hashlib.sha256(raw).hexdigest()
    store, root = _store(out)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/dict-{name}.zdict") as f:
        f.write(raw)
    return name, raw


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = END_ID, dictionary_bytes: int = DICTIONARY_BYTES, training_docs: int = TRAINING_DOCS) -> list:
    """Encode whole texts, append ``end_id`` and write shards; returns the manifest, one row per shard.

    Null texts are empty (the end id alone), null ids come first, rows that repeat an id stay in
    text order, an empty table writes no shard. A task writes under a name of its own attempt
    and then renames, so a task that ran twice leaves one whole shard.
    """
    import pyspark

    name, _ = train_dictionary(docs, tokenizer_path, out, end_id, dictionary_bytes, training_docs)

    def write(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        from lexweave.llm.tokens import encoder, text_slices

        task = pyspark.TaskContext.get()
        shard = task.partitionId()
        store, root = _store(out)
        enc = encoder(tokenizer_path)
        width = _width(enc.vocab_size)
        kind, end = f"<u{width}", int(end_id).to_bytes(4, "little")
        with store.open_input_stream(f"{root}/dict-{name}.zdict") as f:
            known = f.read()
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(known) if known else None)
        tmp, final = f"{root}/.shard-{shard:08d}-{task.taskAttemptId()}", f"{root}/shard-{shard:08d}.lxt"
        f, index, at, tokens = None, [], struct.calcsize(HEAD), 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, texts in text_slices(batch.column(1)):
                if f is None:
                    f = store.open_output_stream(tmp)
                    f.write(struct.pack(HEAD, MAGIC, width, bytes.fromhex(name)))
                frames = []
                for i, raw in enumerate(enc.encode(texts)):
                    ids = np.frombuffer(raw + end, "<u4")
                    frame = press.compress(ids.astype(kind).tobytes())
                    d = doc_ids[first + i]
                    index.append((0 if d is None else d, d is None, at, len(frame), len(ids)))
                    frames.append(frame)
                    at += len(frame)
                    tokens += len(ids)
                f.write(b"".join(frames))
        if f is None:
            return
        f.write(np.array(index, _index_type()).tobytes())
        f.write(struct.pack(TAIL, at, len(index), MAGIC))
        f.close()
        store.move(tmp, final)
        yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([f"{out}/shard-{shard:08d}.lxt"]), pa.array([len(index)], pa.int64()), pa.array([tokens], pa.int64())], names=["shard", "path", "docs", "tokens"])

    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text")).repartitionByRange(shuffle_partitions(spark), "doc_id")
    # no sort in Spark: it would sample, and so write everything twice
    return sorted(ordered.sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST).collect())


class TokenFile:
    """Random access to one shard."""

    def __init__(self, uri: str):
        import numpy as np
        import zstandard

        self.store, self.path = _store(uri)
        self.file = self.store.open_input_file(self.path)
        size = self.file.size()
        magic, self.width, digest = struct.unpack(HEAD, self.file.read_at(struct.calcsize(HEAD), 0))
        at, count, tail = struct.unpack(TAIL, self.file.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError(f"{uri} is not a whole token file")
        kind = _index_type()
        self.index = np.frombuffer(self.file.read_at(count * kind.itemsize, at), kind)
        with self.store.open_input_stream(f"{self.path.rpartition('/')[0]}/dict-{digest.hex()}.zdict") as f:
            known = f.read()
        if hashlib.sha256(known).digest() != digest:
            raise ValueError(f"{uri}: the dictionary beside it is not the one it was written with")
        self.press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known) if known else None)

    def ids(self, row: int):
        """The ids of the document in place ``row``, as unsigned 32-bit integers."""
        import numpy as np

        e = self.index[row]
        raw = self.press.decompress(self.file.read_at(int(e["size"]), int(e["offset"])), max_output_size=int(e["ids"]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int):
        """The ids of a document by its id; None if the shard lacks it."""
        import numpy as np

        first = int(np.count_nonzero(self.index["null"]))  # null ids come first, the others ascend
        place = first + int(np.searchsorted(self.index["doc_id"][first:], doc_id))
        return self.ids(place) if place < len(self.index) and self.index["doc_id"][place] == doc_id else None


def read_token_files(spark: SparkSession, manifest: list) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document, read from the shards."""
    rows, before = [], 0
    for m in manifest:
        rows.append((m["path"], before))
        before += m["tokens"]

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = TokenFile(path)
                n = f.index["ids"].astype(np.int64)
                start = base + np.cumsum(n) - n
                for a in range(0, len(n), 1000):
                    part = f.index[a : a + 1000]
                    ids = [f.ids(i).tobytes() for i in range(a, a + len(part))]
                    yield pa.record_batch([pa.array(part["doc_id"].copy(), mask=part["null"].astype(bool)), pa.array(start[a : a + 1000]), pa.array(n[a : a + 1000]), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    shards = spark.createDataFrame(rows, "path string, base bigint").repartition(max(1, len(rows)))
    return shards.mapInArrow(read, READ)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and read them back."""
    out = fresh_path(docs.sparkSession, "token_files")
    return read_token_files(docs.sparkSession, write_token_files(docs, out, tokenizer_path, end_id))
