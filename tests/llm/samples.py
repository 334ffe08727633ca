"""Small inputs that every operator must take, and plain-Python readings of the contracts."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, kept boolean, n_words int, bucket string, block string, h string"

_RANDOM = random.Random(5)
_SYLLABLES = "th an in er on re ed nd ha es".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


LONG = prose(20_000, 1)
ODD_TEXTS = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "É é ﬁ ẞ İ ΑΣ Σ. x̣́ <turn user> </turn> \\"), (6, prose(300, 2)),
    (7, prose(300, 2)), (7, prose(300, 2)), (8, prose(290, 2) + " new ending words here"), (9, LONG), (10, LONG + " tail"),
    (None, prose(40, 3)), (None, prose(40, 3)), (11, "a" * 500), (12, "x\x00y\u2028z\u00a0w"), (13, prose(40, 3)),
    (14, "### !!! $$$ " * 30), (15, "<|endoftext|>foo 'S 12"), (-4, "漢字 kana 👍🏽 " * 40),
]


def frame(spark, rows=None, schema=DOC_SCHEMA):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = ODD_TEXTS if rows is None else rows
    return spark.createDataFrame([(i, t, "en", None, -1, "b", "c", "d") for i, t in rows], schema).repartition(3)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size=5):
    words = WORD.findall(ascii_lower(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}
