"""Documents with every awkward case, for all operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, score string, _row int, n int"
DOCS = SCHEMA.split(", n_chars")[0] + ", n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}{'abc'[rng.randrange(3)]}" for _ in range(n)]


def rows(seed=3):
    rng = random.Random(seed)
    base = words(rng, 120)
    out = [" ".join(base), " ".join(base)]
    for k in range(14):  # near copies, some closer than others
        own = list(base)
        for _ in range(k // 2):
            own[rng.randrange(len(own))] = f"x{rng.randrange(99)}"
        out.append(" ".join(own))
    passage = " ".join(words(rng, 30))
    for _ in range(12):
        a = words(rng, rng.randrange(1, 60))
        out.append(" ".join(a) + (" " + passage if rng.random() < 0.5 else ""))
    out += [None, "", "   ", "one", "One", "two words", "two words", "Two  words", "\t\n", "é ü 漢字 \x00 z", "!!! ???", "a " * 3000, passage.upper(), passage]
    langs, sources = ["en", "de", None], ["s1", "s2", "s3", None, "é"]
    made = [(k, t, langs[k % 3], sources[k % 5], None if t is None else len(t)) for k, t in enumerate(out)]
    return made + [made[3], made[-1]]  # repeated rows


def frame(spark, extra=False):
    if extra:
        return spark.createDataFrame([(*r, 1, "x", "y", 2, 3) for r in rows()], SCHEMA)
    return spark.createDataFrame(rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
