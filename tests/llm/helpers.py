"""Plain definitions that operators are held against."""

from __future__ import annotations

import re

WORD = re.compile("[^\x20\x09-\x0d]+")
SMALL = "/root/testdata/sf0.001"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None, fold: bool = True) -> list[str]:
    return WORD.findall(lower(text or "") if fold else text or "")


def documents(spark, rows, extra: bool = True):
    """A documents table from (doc_id, text), with columns whose names operators use inside."""
    data = [(i, t, "en", "s", len(t or ""), 1, "x", 2.0) for i, t in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, a int, block string, score double")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


#: Nulls, empty and blank texts, a very long one, ties and repeated rows.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d"), (6, "word " * 30_000), (7, "Ünïcode   x\u0085y"), (7, "Ünïcode   x\u0085y"),
    (None, "no id here at all"), (None, None), (8, "one"), (9, "ONE"), (10, "x " * 10), (11, "\n\na\n\na\nb"), (12, "| " * 60), (13, "A!b #c $d " * 20),
]
