"""Small tables with awkward rows, and plain Python readings of the contracts."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "the of an re ion er ea in ou st nd é ñ ö".split()


def prose(rng, words):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(words))


def texts(seed=1, n=40):
    """Prose, copies, near copies, empty, blank, null and long texts."""
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(1, 300)) for _ in range(n)]
    out += [rng.choice(out) for _ in range(5)]
    for _ in range(5):
        words = rng.choice(out).split(" ")
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return out + ["", " \t\n", None, None, "one", "a b", "x " * 3000, prose(rng, 5000), "\x1c  no\x85space  here"]


def docs(spark, values=None, source=("b", "a", None)):
    """documents with columns that clash with those of operators."""
    values = texts() if values is None else values
    rows = [(i, t, "en", source[i % len(source)], None if t is None else len(t), -1, "mine", True) for i, t in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, fp string, kept boolean").repartition(3)


def empty(spark):
    return docs(spark, []).limit(0)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
