"""Odd documents that every operator must take, and brute-force counterparts."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, id long, items string, weight long"


def words(text):
    return WORD.findall(text or "")


def prose(seed, n):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i * (seed % 7 + 3)) % 997}" for i in range(n))


def documents(spark, extra=()):
    """Nulls, empties, blanks, repeats, a long text, odd white space; columns named like the operators' own."""
    texts = [None, "", "  \n\t\n ", "a", "a b c d e", prose(1, 120), prose(1, 120), prose(2, 80) + "\n" + prose(3, 60), prose(4, 6000), "é x 日本 🙂 " + prose(5, 70), *extra]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", None, "s1", "s0"][i % 4], len(t or ""), 7, 8, "x", 9) for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)
