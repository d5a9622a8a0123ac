"""Small tables with every awkward row, and helpers."""

from collections import Counter

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, score double, size string, "
           "fingerprint int, pieces string, taken date, held_out string, host string, `a.b` int")

LONG = " ".join(f"word{i % 977} over{i % 13}" for i in range(30_000))
ROWS = [
    (1, "the cat sat on the mat and looked out", "en", "b"), (1, "the cat sat on the mat and looked out", "en", "b"),
    (2, "the cat sat on the mat and looked out", "en", "a"), (3, "", "en", "a"), (4, None, None, None),
    (5, " \t\n ", "en", ""), (None, "no key here but words", "en", "b"), (None, None, None, "b"),
    (6, LONG, "de", "a"), (7, "one", "fr", "é"), (8, "ONE", "fr", "z"), (9, "a b c", "fr", "\U0001f600"),
    (10, "write to ann@example.com or +49 (30) 123-4567", "en", "z"), (2, "another text under a known key", "en", "a"),
    (11, "x\x00y \u2581 \ud7ff \u3000 tab\tnew\nline  two", "es", "z"),
]


def documents(spark, rows=ROWS):
    full = [(i, t, lang, s, None if t is None else len(t), 0.5, "s", 1, "p", None, "h", "w", 3) for i, t, lang, s in rows]
    return spark.createDataFrame(full, COLUMNS)


def bag(rows):
    return Counter(tuple(r) for r in rows)
