"""Documents with the awkward cases: nulls, blanks, repeated rows, null and repeated ids, clashing columns."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, TEXT_HASH string, n_lines int, size int, root int, DOC_ID long, Text string, mix_n int, mix_of string, mix_copies int, mix_last long, c0 int, c1 string"
WORDS = [f"w{i}" for i in range(60)]
LONG = " ".join(WORDS)
#: Columns whose names differ from others by case only, or are those of working columns.
CLASHING = (-1, "another text", 1, "s", 2, 3, 4, "c")


def rows():
    texts = [
        (1, LONG), (2, LONG), (3, LONG.upper()), (4, " ".join(WORDS[:55])), (5, " ".join(WORDS[5:])), (6, None), (7, ""), (8, " \t\n"),
        (9, "one two"), (10, "ONE\ttwo"), (11, "x" * 30000), (12, "word " * 6000), (None, LONG), (None, None), (1, LONG), (1, "other text for the same id"),
        (13, "a  b\n\n c <|endoftext|> d\r\n"), (14, "Été ÉTÉ été naïve"), (15, " ".join(f"v{i}" for i in range(3000))),
    ]
    texts += [(100 + i, f"common line\n  Common LINE \nown {i}\n") for i in range(12)]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, "fp", "th", 1, 2, 3, *CLASHING) for k, (i, t) in enumerate(texts)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
