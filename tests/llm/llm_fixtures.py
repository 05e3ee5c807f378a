"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "river stone quiet harbour lantern winter orchard copper signal meadow thunder velvet marble cedar falcon ember willow granite beacon prairie".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def documents(n: int = 60, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    texts: list[str | None] = [prose(100 + i, r.randint(25, 120)) for i in range(n)]
    for i in range(0, n, 4):  # near copies of the document before
        w = (texts[i] or "").split(" ")
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], texts[3], None, "", "  \n\t ", "short one", "short one", "SHORT ONE", prose(7, 6000), "You are a stupid idiot. " + prose(9, 30), "x" * 5000]
    langs = ["en", "de", "fr", "es", None]
    return [(i, t, langs[i % 5], None if i % 7 == 0 else f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


def table(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS)
