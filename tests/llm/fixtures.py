"""Small documents with every awkward case: nulls, empty and blank texts, repeated rows, a long text, odd signs."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def rows() -> list[tuple]:
    a, b, shared = words(1, 120), words(2, 90), words(3, 60)
    texts = [
        (1, a), (2, a), (3, a.replace(" ", "\n", 3)), (4, b), (5, b + " tail"), (5, b + " tail"), (6, None), (7, ""), (8, " \t\n"), (9, "one"), (10, "Two\x1cwords é İ"),
        (11, words(4, 70) + " " + shared + " " + words(5, 40)), (12, words(6, 50) + "\n" + shared + "\n" + words(7, 50)), (13, shared + " " + shared), (None, words(8, 30)), (None, None),
        (14, words(9, 3000)), (15, "x " * 200), (16, "# $ % & | < > * " * 40), (17, "line one here\nline one here\n\nother\nline one here"), (-5, words(10, 100)), (18, "a\x00b \x85 c\u3000d  e\r\n"),
    ]
    return [(i, t, ("en", "de", None)[k % 3], f"src{k % 4}" if k % 5 else None, len(t or "")) for k, (i, t) in enumerate(texts)]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)
