"""Small document tables with every awkward case, and plain versions of the kernels."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Columns that operators use inside; a caller's table may have them too.
EXTRA = ("row", "size", "key", "hash", "node", "part", "tail", "rest", "cut", "n", "score",
         "_rank", "leaf", "copy", "lo", "hi", "digest", "bytes")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def table(spark, rows, parts=3):
    """(doc_id, text, lang, source) rows as documents with clashing extra columns."""
    full = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(parts)
    for name in EXTRA:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def prose(seed, n, vocabulary=2000):
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, share):
    pick = random.Random(seed)
    w = text.split(" ")
    for _ in range(max(1, int(len(w) * share))):
        w[pick.randrange(len(w))] = f"e{pick.randrange(10 ** 6)}"
    return " ".join(w)


AWKWARD = [
    (None, "text of a row without an id", "en", "s1"), (None, None, None, None),
    (901, None, "en", "s1"), (902, "", None, "s1"), (903, " \t\n ", "en", None),
    (904, "word", "en", "s2"), (905, "word", "en", "s2"), (906, "é¿ \x00 中文", "zh", "s2"),
    (907, "very " * 30000, "en", "s3"), (908, "x" * 120000, "en", "s3"),
    (904, "word", "en", "s2"), (909, "12345 !!! 678", "en", "s1"),
]
