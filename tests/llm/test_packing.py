import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from spanforge.llm import packing as p

from .fixtures import empty, frame


def check(docs, rows):
    """Each document's ids, with the end id, lie in its pieces once and in order; sequences are gapless and not too long."""
    t = Tokenizer.from_file(p.tokenizer_file())
    expected = defaultdict(list)
    for i, text in docs:
        expected[i].append(t.encode(text or "", add_special_tokens=False).ids + [0])
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = {i: sorted((s, min(1024, len(x) - s), zlib.crc32(np.array(x[s : s + 1024], "<u4").tobytes()), len(x)) for x in ids for s in range(0, len(x), 1024)) for i, ids in expected.items()}
    assert {i: sorted(x) for i, x in got.items()} == want
    used = 0
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
        used += at
    return used / (1024 * len(sequences))


def test_awkward_rows(spark):
    df = frame(spark)
    check([(r.doc_id, r.text) for r in df.collect()], p.pack(df).collect())
    check([(r.doc_id, r.text) for r in df.collect()], p.pack(df, group_pieces=3).collect())
    assert p.pack(empty(spark)).count() == 0


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert check(docs, p.op10_packing(spark, d).collect()) > 0.98


def test_first_fit_against_plain_search():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 300):
        lengths = sorted(rng.integers(1, 1025, n).tolist(), reverse=True)
        room, expected = [], []
        for x in lengths:
            k = next((k for k, r in enumerate(room) if r >= x), len(room))
            if k == len(room):
                room.append(1024)
            expected.append((k, 1024 - room[k]))
            room[k] -= x
        assert list(zip(*p.first_fit(lengths, 1024), strict=True)) == expected


def test_encoder_equals_the_tokenizer_file():
    encode, t = p.Encoder(p.tokenizer_file()), Tokenizer.from_file(p.tokenizer_file())
    for text in ("", " ", "a\n", "a \n b", "x  y", "tab\t\tx   z", "don't  I'LL 've", "ﬁ ² ½ Ⅷ 漢字　 ", "\U0001f600 á \x1c\x85 b", "<|endoftext|> a", "12 345  6", "a b   c", " \n\n\n x"):
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_ids_equal_the_tokenizer_file():
    """Random texts of any characters, white space in all forms and special tokens among them."""
    import random

    from tokenizers import Tokenizer

    from spanforge.llm import packing

    encode, plain = packing.Encoder(packing.tokenizer_file()), Tokenizer.from_file(packing.tokenizer_file())
    draw = random.Random(1)
    for _ in range(2000):
        text = "".join(chr(draw.choice([32, 10, 9, 13, 65, 97, 39, 48, 233, 8364, 0x4E2D, 0x1F600, 0x200B, draw.randrange(1, 0xD7FF)])) for _ in range(draw.randrange(0, 40))) + draw.choice(["", "", "<|endoftext|>", " 's it"])
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
