"""Small hand-made tables with the awkward cases: nulls, empty and long texts, ties, copies, clashing names."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, key double, weight int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def texts(n=60, seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        lines = [prose(rng, rng.randint(3, 30), vocabulary).capitalize() + "." for _ in range(rng.randint(1, 8))]
        out.append("\n".join(lines))
    # copies, near copies, shared passages
    for i in range(0, 30, 3):
        words = out[i].split(" ")
        if len(words) > 30:
            words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    out += [out[1], out[1], out[2].upper(), out[4] + "\n" + out[5], out[5] + " tail"]
    out += [None, "", "   \n\t ", "one", "One", "a b c", "é à ü", "123 456", "\n".join(["same line here"] * 5),
            " ".join(["tic tac"] * 40), prose(rng, 20_000, vocabulary), "### $$$ " * 30]
    return out


def docs(spark, extra=()):
    langs, sources = ["en", "de", None], ["s0", "s0", "s1", "s2", None]
    rows = [(i, t, langs[i % 3], sources[i % 5], None, 7, "x", 0.5, 1) for i, t in enumerate([*texts(), *extra])]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")
