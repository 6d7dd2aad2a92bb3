"""BPE encoding and decoding by forced-boundary splitting (see ``fragments``).

Contract for odd input: a null text counts as empty and gives no ids; null and repeated doc_ids are kept row by row; an
empty table gives an empty result; other columns are ignored, whatever their names; a text of any length is handled
whole, in pieces of the encoder's own cutting.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.fragments import FragmentEncoder, byte_alphabet, encoder
from palimpsest.llm.runtime import ENCODER_BYTES, bounded, chunks, text_bytes


class ByteDecoder:
    """ids to bytes for a byte-level vocabulary, special tokens included."""

    def __init__(self, source: FragmentEncoder):
        stand_in, added = byte_alphabet(), set(source.added)
        vocabulary = source.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = token.encode() if token in added else bytes(stand_in[c] for c in token)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids in a row, bytes before each id)."""
        counts = self.length[ids]
        ends = np.concatenate([[0], np.cumsum(counts)])
        take = np.arange(ends[-1], dtype=np.int64) + np.repeat(self.start[ids] - ends[:-1], counts)
        return self.data[take], ends


@functools.cache
def decoder(path: str) -> ByteDecoder:
    return ByteDecoder(encoder(path, "byte"))


def encode_ids(df: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", kind: str = "byte") -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit, n_tokens) of each row."""

    def run(batches):
        source = encoder(path, kind)
        for batch in chunks(batches, "text", ENCODER_BYTES):
            ids, before = source.encode(*text_bytes(batch.column(1)))
            data = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([data[a:b].tobytes() for a, b in zip(before, before[1:])], pa.binary()), pa.array(np.diff(before))], names=["id", "ids", "n_tokens"]
            )

    kind_of_id = df.schema[id_column].dataType.simpleString()
    return bounded(df).select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind_of_id}, ids binary, n_tokens bigint").withColumnRenamed("id", id_column)


def decode_ids(df: DataFrame, path: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text) of rows that hold ids as ``encode_ids`` gives them; bytes that are no UTF-8 become U+FFFD."""

    def run(batches):
        source = decoder(path)
        for batch in batches:
            texts = [source.decode(np.frombuffer(x or b"", "<u4").astype(np.int64))[0].tobytes().decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind_of_id = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column).alias("id"), F.col(ids).alias("ids")).mapInArrow(run, f"id {kind_of_id}, text string").withColumnRenamed("id", id_column)


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Encode each whole text, decode its ids, and return digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One pass without a shuffle: ids and decoded text never leave the task.
    """

    def run(batches):
        source, back = encoder(path, "byte"), decoder(path)
        for batch in chunks(batches, "text", ENCODER_BYTES):
            ids, before = source.encode(*text_bytes(batch.column(1)))
            data, at = back.decode(ids)
            wide = ids.astype("<u4")
            edges = before.tolist()
            in_ids, in_text = [], []
            for a, b, x, y in zip(edges[:-1], edges[1:], at[before[:-1]].tolist(), at[before[1:]].tolist(), strict=True):
                in_ids.append(hashlib.sha256(wide[a:b]).hexdigest())
                in_text.append(hashlib.sha256(data[x:y].tobytes().decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(before)), pa.array(in_ids, pa.string()), pa.array(in_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return bounded(df).select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
