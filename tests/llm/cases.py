"""Small tables with nulls, empty and long texts, ties, repeats and clashing extra columns; plain versions of shared steps."""

import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def base_text(n, seed):
    """n words that differ with the seed."""
    return " ".join(f"w{(i * 7919 + seed * 104729) % 9973}{'.' if i % 11 == 10 else ''}" for i in range(n))


LONG = base_text(30_000, 99)
A, B = base_text(120, 1), base_text(90, 2)
TEXTS = [
    (1, A), (2, A.upper()), (3, A + " tail"), (4, A.replace(A.split()[60], "changed")), (5, B), (6, None), (7, ""), (8, "  \t\n "), (9, "one two"), (10, "One\ttwo"), (11, LONG), (12, LONG + " more"),
    (13, "é ü ñ 日本 語"), (14, B + "\n" + A), (15, "x" * 5000), (16, A), (16, A), (17, "a  b\n\nc  d e f g h"), (None, A), (18, "one two three four five"), (19, "ONE two three four five"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, size int, score double, component_id string"


def docs(spark, texts=TEXTS):
    rows = [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"s{n % 3}", None if t is None else len(t), n, n, 0.5, "c") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
