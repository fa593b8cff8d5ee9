import random

import pytest

#: Column names that the operators use inside.
CLASHING = "block part data key n size target node signature carried digest last words offset cell run g v its_id kept_text row".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, letters="abcdefghij"):
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    return " ".join(rng.choice(words) for _ in range(n))


def corpus():
    """Rows with nulls, blanks, long texts, exact and near copies, shared passages and lines, ties and repeats."""
    rng = random.Random(7)
    passage, line = prose(rng, 90), "  The Same Line That Many Documents Have, 0123456789 \t"
    texts = [None, "", " \n\t", "7 % 8", "É à ü", "one two three", "One TWO three", "\n", "ß" * 39 + "\nx", "a" * 1300, "a" * 1300, "ab" * 500]
    texts += [prose(rng, rng.randint(20, 200)) for _ in range(20)]
    base = [prose(rng, 150) for _ in range(3)]
    texts += base * 2 + [b.upper() for b in base]
    for b in base:
        for k in range(4):
            w = b.split()
            w[10 * k + 5] = f"changed{k}"
            texts.append(" ".join(w))
    texts += [f"{prose(rng, 30)}\n{line.upper() if k % 2 else line}\n{passage} {prose(rng, 20)}\n{line}" for k in range(8)]
    texts.append(prose(rng, 60_000) + " " + passage)
    langs = ["en", "fr", None]
    rows = [(i, t, langs[i % 3], [None, "s1", "s2", "s0", "s1"][i % 5], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[-3], rows[15], (None, texts[20], None, None, None), (None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in CLASHING:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit(f"other {c}"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def unique(rows):
    """Rows whose doc_id is known and not repeated, for checks by id."""
    count = {}
    for r in rows:
        count[r[0]] = count.get(r[0], 0) + 1
    return {r[0]: r[1] or "" for r in rows if r[0] is not None and count[r[0]] == 1}
