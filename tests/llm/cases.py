"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the and of with that for ing tion her there which about over under again river stone house green".split()


def sentence(seed: int, n: int) -> str:
    x, out = seed * 2654435761 + 12345, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(WORDS[(x >> 33) % len(WORDS)] + WORDS[(x >> 40) % len(WORDS)])
    return " ".join(out)


def texts() -> list[tuple]:
    base = sentence(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, sentence(2, 80)), (5, None), (6, ""), (7, "  \n "), (8, "one"), (9, "One two"),
        (10, sentence(3, 30) + " " + base[:300]), (11, "ünï çødé " * 20), (11, "ünï çødé " * 20), (12, sentence(4, 3000)), (None, base), (13, base.upper()),
        (14, "mail a.b@c-d.example.com or call +1 (017) 555-7713, card 4111 1111 1111 1111, ip 10.0.0.255."), (15, "12345 !!! ???"),
    ]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


def documents(spark):
    return spark.createDataFrame(texts(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    """``df`` with columns that are named like results."""
    return df.withColumns({n: F.lit("clash") for n in names})
