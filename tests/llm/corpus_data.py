"""Small corpora for the tests: prose of made-up words, copies, odd rows."""

import random

from pyspark.sql import types as T

SYLLABLES = "an ber con da el fi gor hu is jo ka lem mo nu or pas qui ra su tol ur ve wen xi yo za".split()
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def word(draw: random.Random) -> str:
    return "".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 3)))


def prose(draw: random.Random, words: int) -> str:
    out = [word(draw) for _ in range(words)]
    for at in range(9, words, 10):
        out[at] += "."
    return " ".join(out).capitalize()


def rows(count: int = 60, seed: int = 1) -> list[tuple]:
    """Documents with copies, near copies, repeated rows, null, empty, blank and long texts, null ids and sources."""
    draw = random.Random(seed)
    out = [(i, prose(draw, draw.randint(3, 120)), "en", f"src{i % 4}") for i in range(count)]
    text = prose(draw, 150)
    near = text.split(" ")
    near[70] = "Other"
    out += [
        (1000, text, "en", "src0"),
        (1001, text, "en", "src0"),
        (1002, " ".join(near), "de", "src1"),
        (1003, None, "en", "src2"),
        (1004, "", None, None),
        (1005, " \n\t ", "fr", None),
        (1006, prose(draw, 6000), "en", "src0"),
        (1007, "Straße naïve Été 漢字 😀 don't <|endoftext|>", "de", "src3"),
        (1008, "same row", "en", "src1"),
        (1008, "same row", "en", "src1"),
        (1008, "same id", "en", "src1"),
        (None, "no id here", "en", "src2"),
        (None, None, None, None),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in out]


def frame(spark, data=None, partitions: int = 3):
    """The documents as a frame, with columns that other operators would like to call theirs."""
    from pyspark.sql import functions as F

    data = rows() if data is None else data
    made = spark.createDataFrame(data, SCHEMA).repartition(partitions)
    return made.withColumns({c: F.lit("mine") for c in ("size", "start", "tokens", "spans", "root", "part", "score", "toxicity", "count", "block")})
