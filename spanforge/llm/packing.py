"""Packing (10): first-fit decreasing by a tournament tree of bin capacities, in randomised groups of documents.

One scan tokenizes a document, cuts it at multiples of the sequence length and keeps, for each piece,
its place, its length and the checksum of its ids. Only these short rows are shuffled: each group of
pieces, dealt by a hash, is packed on its own, so that groups run in parallel and none is unbounded.
"""

import base64
import json
import re
import zlib
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Scratch, columns_once, table
from ._util import pieces as in_pieces

SEQUENCE = 1024
END_ID = 0
#: Pieces that a group holds on average.
GROUP_PIECES = 16384

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of the tokenizer file as little-endian unsigned 32-bit bytes.

    Texts that spell a special token go to ``tokenizers``; the others take the same ranks through
    ``tiktoken``, which gives equal ids in a third of the time. Where no two white spaces meet, the
    look-ahead of the split pattern cannot matter and is left out.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, added))) if added else re.compile(r"(?!)")
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        make = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.full = make("full", public_tokenizers.PATTERN)
        self.plain = make("plain", public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", ""))
        self.double = re.compile(r"\s\s")

    @cached_property
    def slow(self):
        """The tokenizer file itself, read by the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if self.special.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        bpe = self.full if self.double.search(text) else self.plain
        return np.frombuffer(bpe.encode_to_tiktoken_buffer(text, set()), "<u4")


def pieces(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """One row a piece: (doc_id, start, length, ids_crc32, doc_tokens, deal). A null text is an empty one."""
    path = tokenizer or tokenizer_file()

    def cut(batches):
        from pyspark import TaskContext

        encode, task, row = Encoder(path), TaskContext.get().partitionId(), 0
        for batch in in_pieces(batches):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                raw, n = memoryview(ids.tobytes()), len(ids)
                # Equal rows get different deals; a retried task deals alike.
                deal = zlib.crc32(b"%d %d %r" % (task, row, str(doc_id).encode()))
                row += 1
                out += [(doc_id, at, min(sequence, n - at), zlib.crc32(raw[4 * at : 4 * (at + sequence)]), n, deal) for at in range(0, n, sequence)]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])

    slim = columns_once(docs, "doc_id", "text")
    return slim.select(slim.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, taken in the given order: each goes to the first bin that has room.

    The tree's leaves are the bins' free room and each node has the larger of its two children, so
    that the first fitting bin is found in one walk from the root.
    """
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for n in lengths:
        k = 1
        while k < leaves:
            k *= 2
            if tree[k] < n:
                k += 1
        bins.append(k - leaves)
        offsets.append(capacity - tree[k])
        tree[k] -= n
        while k > 1:
            k //= 2
            most = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == most:
                break
            tree[k] = most
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of all documents placed in sequences of at most ``sequence`` tokens.

    Every row of ``docs`` is packed, repeated rows and null ids included; an empty or null text is the
    single end id. Only doc_id and text are read, whatever else the table holds; no rows give no rows.
    sequence_id is the group's number times 2**32 plus the number of the bin in its group.
    """
    spark = docs.sparkSession
    cut = Scratch(spark, "packing").keep(pieces(docs, tokenizer, sequence), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))

    def fill(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "deal", "doc_id", "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit(pdf["length"].tolist(), sequence)
        return pdf.assign(sequence_id=np.array(bins, "int64") + (int(key[0]) << 32), offset=np.array(offsets, "int64"))[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    dealt = cut.withColumn("piece_group", F.pmod(F.xxhash64("deal", "start"), F.lit(groups)))
    return dealt.groupBy("piece_group").applyInPandas(fill, PACKED)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
