"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, id long, key string, words string, size long"


def texts(seed: int = 7) -> list[str | None]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 5))) for _ in range(150)] + ["the", "of", "and", "La", "DE", "x" * 80]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out: list[str | None] = ["\n".join(line(rng.randint(0, 25)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    shared = line(25)
    for k in range(25):
        base = rng.choice(out[:60]).split(" ")
        base[rng.randrange(len(base))] = "changed"
        out.append(" ".join(base) + ("\n" + shared if k % 2 else ""))
    out += [out[3], out[3], out[5], "", None, None, "   \n\t\x0b ", "a", "the the the the the the " * 40, line(4000), "é" * 200, "é" * 199 + "e", "\x00\x01 " * 60, shared]
    return out


def frame(spark, rows: list[tuple] | None = None):
    """documents with columns whose names clash with those of intermediate results."""
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id at all " * 9), (None, "no id at all " * 9), (2, texts()[2])] if rows is None else rows
    return spark.createDataFrame([(i, t, ["en", "fr", None, "xx"][k % 4], ["b", "a", None, "ä", "a"][k % 5], len(t or ""), k, -k, "k", "w", 3) for k, (i, t) in enumerate(rows)], SCHEMA)


def rows_of(df) -> list[tuple]:
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
