import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Names that operators use inside; inputs may have them.
CLASHES = ["part", "key", "ids", "n_words", "n_lines", "n_dropped", "kept", "row", "print", "base", "text_key", "owner", "lost", "c0", "at", "score", "start", "words"]


def hard_rows():
    rng = random.Random(5)
    made = ["".join(rng.choice(["ab", "ce", "di", "ou", "ä"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(made) for _ in range(n))
    passage, line = say(70), "This Line is held by many documents and it is long enough"
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "two words"), (6, say(20000)), (7, "x" * 50000)]
    rows += [(10 + i, f"{say(60)}\n {line.upper() if i % 2 else line}\t\n{say(5)}") for i in range(7)]
    rows += [(20 + i, say(15) + " " + passage + " " + say(30)) for i in range(4)]
    copy = say(120)
    rows += [(30 + i, copy) for i in range(5)] + [(40, copy + " more"), (41, copy.replace("ab", "ba", 1)), (42, passage), (43, passage + "\n" + line)]
    rows += [(50, "a\u00a0b <|endoftext|>  c\r\n\u2028 'll <|startoftext|> \U0001f600 \x1c \ufb01 \u0130"), (51, "aaaa" * 300), (52, say(49)), (53, (say(9) + "\n") * 1 + (say(10) + "\n") * 30)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return hard_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(d, t, None if d % 3 else "en", "s", None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES]).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
