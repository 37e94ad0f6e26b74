"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are powers of two: as many of the longest
as fit, then the binary digits of the rest, longest first. A piece is a sequence of its own, so
no sequence crosses documents and none is padded. Equal lengths form a bucket: sequences leave
the tasks bucket by bucket and are numbered inside theirs, so all sequences of a bucket have
neighbouring numbers and batches of one length are ranges of them; :func:`write_buckets` lays the
buckets out as folders. The work is one pass over the texts without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import given_back, whole_text

END_ID = 1
MAX_LENGTH = 2048
PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, bucket int, sequence_id bigint, ids binary"
BUCKET_BITS, TASK_BITS = 58, 36  # of a sequence_id: bucket, task and number in both


def binary_lengths(n: int, longest: int) -> list[int]:
    """Piece lengths for n ids, longest first; ``longest`` is a power of two."""
    out = [longest] * (n // longest)
    rest = n % longest
    out += [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return out


def pack(docs: DataFrame, tokenizer_path: str, max_length: int = MAX_LENGTH, end_id: int = END_ID, memo_words: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket, sequence_id, ids (u32 little-endian), offset.

    ``memo_words`` bounds the words that a worker remembers: memory against time, the result is
    the same. ``bucket`` is the logarithm of the length. A null or empty text is the end id alone: one piece
    of length 1. Null and repeated ids pass through row by row. An empty table gives an empty
    result; other columns are ignored. ``max_length`` must be a power of two.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError(f"max_length must be a power of two, got {max_length}")

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from lexweave.llm.tokens import MEMO_WORDS, encoder, text_slices

        enc, end = encoder(tokenizer_path, memo_words or MEMO_WORDS), int(end_id).to_bytes(4, "little")
        task, numbered = TaskContext.get().partitionId() << TASK_BITS, [0] * max_length.bit_length()
        for batch in batches:
            doc_ids = batch.column(0)
            for first, texts in text_slices(batch.column(1)):
                buckets = [[] for _ in numbered]
                for i, raw in enumerate(enc.encode(texts)):
                    raw += end
                    n, at = len(raw) // 4, 0
                    for k in binary_lengths(n, max_length):
                        buckets[k.bit_length() - 1].append((first + i, at, n, raw[4 * at : 4 * (at + k)]))
                        at += k
                for b, held in enumerate(buckets):
                    if held:
                        rows, start, total, ids = zip(*held)
                        m, base = len(held), (b << BUCKET_BITS) + task + numbered[b]
                        numbered[b] += m
                        yield pa.record_batch(
                            [
                                doc_ids.take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(np.full(m, 1 << b)), pa.array(total, pa.int64()),
                                pa.array(np.full(m, b, np.int32)), pa.array(np.arange(base, base + m)), pa.array(ids, pa.binary()),
                            ],
                            names=["doc_id", "start", "length", "doc_tokens", "bucket", "sequence_id", "ids"],
                        )
        enc.forget()

    pieces = docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text")).mapInArrow(lambda b: given_back(cut(b)), PIECES)
    return pieces.withColumn("offset", F.lit(0).cast("bigint"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences as Parquet, one folder per length: a batch takes equal lengths from one folder."""
    pieces.write.partitionBy("length").parquet(path)
