"""Small hard documents: nulls, empty and long texts, ties, repeated rows, other columns with clashing names."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "of", "a", "wolf", "river", "stone", "und", "über", "été", "ñandú", "x" * rng.randint(1, 9)]) for _ in range(n))


def rows(seed: int = 1, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    shared = sentence(rng, 60)
    base = [sentence(rng, rng.randint(1, 120)) for _ in range(n)]
    texts = [
        *base,
        base[3], base[3], base[5] + " end", "pre " + shared + " one", "two " + shared, shared, shared + "\n" + shared,
        None, "", " \t\n", "a", "a a a a " * 30, "é" * 80, "zz " * 3000, base[0].upper(), "1234 5678",
    ]
    out = [(i * 3 % 101 + 1, t, ["en", "de", None][i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[4], out[4], (out[7][0], "another text of a document number that is taken", "en", "s", 1), (None, shared, "en", "s", 1)]


def documents(spark, values=None):
    return spark.createDataFrame(rows() if values is None else values, COLUMNS)


def saved(spark, tmp_path, **tables) -> str:
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
