"""Small documents with every awkward case, and words as the contracts say."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda found: found[0].lower(), text or "")


def prose(seed: int, count: int) -> str:
    pick = random.Random(seed)
    syllables = ["an", "re", "thé", "on", "ti", "es", "Ou", "ñ", "lich", "wh"]
    return " ".join("".join(pick.choices(syllables, k=pick.randint(1, 4))) for _ in range(count))


def awkward() -> list[tuple]:
    """Nulls in every column, empty, blank, very long and repeated texts, equal ids."""
    long = prose(1, 40_000)
    rows = [
        (0, prose(2, 60), "en", "a", 1),
        (1, prose(2, 60), "en", "a", 1),
        (2, prose(2, 58) + " something else", None, "a", None),
        (3, None, "en", "b", 0),
        (4, "", "en", None, 0),
        (5, " \t\n", "de", "b", 3),
        (6, "one two", "de", "b", 7),
        (7, "ONE  two", "de", "b", 7),
        (8, long, "fr", "hot", len(long)),
        (9, long + " tail", "fr", "hot", len(long)),
        (10, prose(3, 80), "es", "hot", 5),
        (10, prose(4, 80), "es", "hot", 5),
        (11, prose(5, 30), "es", "hot", 5),
        (11, prose(5, 30), "es", "hot", 5),
        (None, prose(6, 30), "es", "hot", 5),
        (None, prose(6, 30), "es", "hot", 5),
    ]
    return rows + [(100 + k, prose(50 + k % 40, 50), "en", f"s{k % 3}", 9) for k in range(80)]


def frame(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def listed(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)
