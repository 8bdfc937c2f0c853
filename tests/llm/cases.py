"""Documents that operators must take: nulls, blanks, long texts, repeated rows, columns with clashing names."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "fp long, node long, label string, row string, block int, text_hash string, score string, h string, content string, words string, __note string"
)


def prose(seed, n):
    r = random.Random(seed)
    syllables = "the an er in re ed nd ha en to or es hi st ou le tion ing ve ly".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


TEXTS = [
    None, "", " ", "\n\t ", "one", "two words", "a b c", "1234 5678", "   leading and trailing   ", "tabs\tand\nlines\r\nand  double  spaces",
    prose(1, 400), prose(1, 400), prose(2, 60_000), "ß É ñ ü 日本語 😀 é don't it's WE'LL 3.14 <|endoftext|> \x1c\x85\xa0", "x" * 70_000, "!? " * 200, "Same Same Same Same Same Same Same Same Same Same Same Same",
    "contact me at jane.doe@example.com or +1 (743) 555-3824, server 10.0.0.1, card 4111 1111 1111 1111", prose(3, 400) + " tail", prose(3, 400),
]


def rows():
    out = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    out += [(10, TEXTS[10], "en", "s0", 1), (10, TEXTS[10], "en", "s0", 1), (None, TEXTS[5], None, None, None), (None, None, None, None, None), (3, "another text under an id", "de", "s1", 5)]
    return [(*r, 1, 2, "x", "y", 3, "z", "s", "h", "c", "w", "n") for r in out]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    """(doc_id, text) of every row."""
    return [(r[0], r[1]) for r in rows()]
