"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, memory-mapped when read.

A written set is a folder of parts, one for each range of ids, and a manifest table. ``part.bin`` holds the ids of the
part's documents end to end, little-endian, in 2 bytes if the vocabulary has at most 65,536 ids, else in 4.
``part.idx`` holds signed 64-bit offsets into it, in ids, one more than documents; ``part.ids`` the 64-bit document
ids (the least number stands for null). The manifest has a row for each part: file, documents, ids, and base, the
number of ids before the part, which is a prefix sum over parts.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

NULL_ID = -(1 << 63)
#: Words kept with their ids by each worker; rarer ones are encoded again.
CACHE_WORDS = 400_000


# A pattern whose matches hold no white space, and normalizers that change nothing across a space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def splits_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer, by its file, is known to give a text the ids of its words by spaces, end to end: white space
    is dropped before pieces are merged, nothing is put before a text or between words, and no added token has a space."""
    normalizer, before, model = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = before.get("pretokenizers") or [before]
    cut = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
    plain = all(x in NORMALIZERS for x in normalizer.get("normalizers", [normalizer] if normalizer else []))
    rest = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in steps[1:])
    added = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens") or [])
    return plain and steps[0] == cut and rest and added and model.get("type") == "BPE" and not model.get("dropout")


class WordEncoder:
    """Ids of whole texts by a ``tokenizers`` file.

    Where ``splits_at_spaces`` holds, each distinct word is encoded once and looked up after that; the ids are those of
    the whole text. Any other tokenizer gets whole texts. ``by_word`` overrides what the file says.
    """

    def __init__(self, path: str, by_word: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = splits_at_spaces(json.loads(self.tokenizer.to_str())) if by_word is None else by_word
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {"": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._encode([text])[0]
        words = text.replace("\n", " ").split(" ")
        got = list(map(self.known.get, words))
        if None in got:
            new = list({w for w, g in zip(words, got, strict=True) if g is None})
            extra = dict(zip(new, self._encode(new), strict=True))
            got = [extra[w] if g is None else g for w, g in zip(words, got, strict=True)]
            if len(self.known) < CACHE_WORDS:
                self.known.update((w, v) for w, v in extra.items() if len(w) <= 40)
        return b"".join(got)


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, by_word: bool | None) -> WordEncoder:
    """One for each worker process and file."""
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = WordEncoder(path, by_word)
    return _encoders[path, by_word]


def _writer(folder: str, tokenizer: str, end_id: int, by_word: bool | None) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer, by_word)
        end = np.array([end_id], enc.dtype).tobytes()
        pid = TaskContext.get().partitionId()
        # Each attempt writes files of its own; the manifest, which is committed, names those that count.
        name = f"{folder}/part-{pid:05d}-{uuid.uuid4().hex}"
        lengths, ids, out = [], [], None
        for batch in batches:
            ids += [NULL_ID if x is None else x for x in batch.column(0).to_pylist()]
            for text in batch.column(1):
                if out is None:
                    out = common.open_out(f"{name}.bin")
                piece = enc.encode(text.as_py() or "") + end
                out.write(piece)
                lengths.append(len(piece) // enc.dtype.itemsize)
        if out is None:
            return
        out.close()
        offsets = np.zeros(len(lengths) + 1, "<i8")
        np.cumsum(lengths, out=offsets[1:])
        for kind, values in (("idx", offsets), ("ids", np.array(ids, "<i8"))):
            with common.open_out(f"{name}.{kind}") as f:
                f.write(values.tobytes())
        yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "file": [name], "width": pa.array([enc.dtype.itemsize], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([int(offsets[-1])], pa.int64())})

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, *, key: str = "doc_id", text: str = "text", by_word: bool | None = None) -> DataFrame:
    """Encode all texts, in ascending order of ``key``, into files under ``folder``; returns the manifest.

    A null text counts as empty and gets the end id alone; a null key sorts first. Rows with equal keys follow each
    other in the order of their texts. An empty table gives no files and an empty manifest. Long texts are taken
    whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    rows = rows.repartitionByRange(common.parts(spark), F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), F.col("t").asc_nulls_first())
    made = rows.mapInArrow(_writer(folder, tokenizer, end_id, by_word), "pid int, file string, width int, n_docs long, n_ids long")
    made = common.written(made, f"{folder}/parts.parquet")
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    return common.written(made.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), f"{folder}/manifest.parquet")


def open_part(file: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and document ids of a part, memory-mapped."""
    return tuple(np.frombuffer(common.map_in(f"{file}.{kind}"), dtype) for kind, dtype in (("bin", f"<u{width}"), ("idx", "<i8"), ("ids", "<i8")))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batch.to_pylist():
            data, offsets, ids = open_part(part["file"], part["width"])
            sums = np.empty(len(ids), np.int64)
            for i in range(len(ids)):
                sums[i] = zlib.crc32(data[offsets[i] : offsets[i + 1]].astype("<u4"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=ids == NULL_ID), pa.array(part["base"] + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(sums)],
                names=["key", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """From the files: for each document its key, first id's place in the whole, ids, and the crc32 of its ids as
    unsigned 32-bit integers."""
    n = min(common.parts(manifest.sparkSession), 4096)
    rows = manifest.select("file", "width", "base").repartition(n, "file").mapInArrow(_read, "key long, start long, n_tokens long, ids_crc32 long")
    return rows.withColumnRenamed("key", key)
