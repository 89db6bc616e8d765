"""Small documents and brute-force versions that the tests share."""

import random
import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def bag(text):
    w = words(text)
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


#: Rows that every operator must take: nulls, empty and odd texts, repeated rows, and a repeated doc_id.
ODD = [
    (None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\t ", "en", "s", 6), (4, "one", "en", "s", 3), (5, "?!? ... 123 456", "en", None, 15),
    (6, "a b c d e f g h i j k l", "en", "s", 23), (6, "a b c d e f g h i j k l", "en", "s", 23), (6, "quite another text here for the same id of course it is so", "de", "s", 60), (None, "a b c d e f g h i j k l", "fr", "s", 23),
    (7, "x" * 300_000, "en", "s", 300_000), (8, "word " * 60_000, "en", "s", 300_000), (9, "Ünïcödé ǅ 漢字 \U0001f600 İ ß e\u0301 \u00a0 end", "de", "s", 30),
]


def odd(spark, clash=()):
    df = spark.createDataFrame(ODD, DOCS)
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(c) for c in clash))
