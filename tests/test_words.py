import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossaria.functions import lemma, text
from glossaria.operators import words

LEMMAS = dict(
    running="run", ran="run", runs="run", Run="run", walked="walk", walking="walk", studies="study", went="go", took="take", saw="see", was="be", had="have", made="make",
    thought="think", knew="know", cats="cat", boxes="box", knives="knife", xylophone="xylophone", details="detail", users="user", visited="visit", jumping="jump",
    activities="activity", gardens="garden", serendipity="serendipity", changing="change", stopped="stop", hoping="hope", constructor="constructor", news="news", being="be",
)

#: A hand-made list: doubled letters that belong to the word or to the ending, and an e that was lost or never there.
BY_HAND = dict(
    adding="add", added="add", staffed="staff", sniffing="sniff", revved="rev", trekking="trek", begging="beg", egged="egg", purred="purr", stirred="stir", planned="plan", napping="nap",
    hopping="hop", fitted="fit", rubbed="rub", erred="err", calling="call", missed="miss", buzzing="buzz", quizzes="quiz", heated="heat", repeating="repeat", created="create", stated="state",
    floated="float", managed="manage", charged="charge", judging="judge", hanged="hang", measured="measure", poured="pour", required="require", repaired="repair", compared="compare", feared="fear",
    imagined="imagine", explained="explain", ruined="ruin", decided="decide", avoided="avoid", included="include", clouded="cloud", contributed="contribute", shouted="shout", supposed="suppose",
    promised="promise", accused="accuse", focused="focus", assumed="assume", evoked="evoke", looked="look", soaked="soak", loaded="load", invaded="invade", loved="love", continued="continue", danced="dance",
)


@pytest.mark.parametrize("how", ["column", "sql"])
def test_lemmas_by_hand(spark, how):
    if how == "sql":
        import duckdb

        got = dict(duckdb.execute(f"SELECT w, {lemma.lemma_sql('w')} FROM (SELECT unnest({list(BY_HAND)}) AS w)").fetchall())
    else:
        got = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in BY_HAND], "w string").select("w", lemma.lemma(F.col("w"))).collect()}
    assert got == BY_HAND


def lemmas_of(spark, sentence, **kw):
    docs = spark.createDataFrame([(sentence,)], "text string")
    return [r[0] for r in words.extract_entries(docs, **kw).orderBy("first_pos").select("lemma").collect()]


def test_lemmas(spark):
    got = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in LEMMAS], "w string").select("w", lemma.lemma(F.col("w"))).collect()}
    assert got == LEMMAS


def test_reasons(spark):
    cases = {
        "https://a.b": "url", "WWW.x": "url", "a@b.c": "email", "src/main": "path", "snake_case": "snake", "camelCase": "camel", "XMLHttp": "pascal", "NASA": "pascal",
        "$x": "dollar", "v2": "digit", "morning:": "shape", "word--word": "shape", "end.Next": "shape", "well-known": "accept", "don't": "accept", "O'Brien": "accept", "X-Ray": "accept", "a": "accept",
    }
    rows = spark.createDataFrame([(w,) for w in cases], "w string").select("w", text.reason(F.col("w")), text.is_word(F.col("w"))).collect()
    assert {r[0]: r[1] for r in rows} == cases
    assert all((r[1] == "accept") == r[2] for r in rows)


def test_extraction(spark):
    assert lemmas_of(spark, "He said don't panic; it's a well-known fact.") == ["he", "say", "don't", "panic", "it's", "a", "well-known", "fact"]
    assert lemmas_of(spark, "Running ran runs") == ["run"]
    assert lemmas_of(spark, "café naïve word—word ‘don’t’ ﬁne…") == ["caf", "na", "ve", "word-word", "don't", "fine"]
    assert lemmas_of(spark, "") == lemmas_of(spark, None) == []


def test_proper_nouns(spark):
    names = spark.createDataFrame([("alice",), ("bob",), ("london",)], "lower_name string")
    sentence = "Alice and Bob visited London yesterday"
    assert lemmas_of(spark, sentence, proper_nouns=names) == ["and", "visit", "yesterday"]
    assert lemmas_of(spark, sentence) == ["and", "visit", "yesterday"]  # by the case of the sentence alone
    assert {"alice", "bob", "london"} <= set(lemmas_of(spark, sentence, exclude_proper_nouns=False))
    assert lemmas_of(spark, "Running Cats alice", proper_nouns=names) == ["run", "cat", "alice"]


def entries(spark, rows):
    return spark.createDataFrame(rows, words.ENTRY)


flagged = st.lists(st.tuples(st.sampled_from(["a", "B", "b", "run", "Run"]), st.integers(0, 15)), max_size=6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(flagged, flagged)
def test_merge_is_a_semilattice(spark, a, b):
    x, y = entries(spark, a), entries(spark, b)
    once = sorted(words.merge_entries(x, y).collect())
    assert once == sorted(words.merge_entries(y, x).collect()) == sorted(words.merge_entries(x, y, x, words.merge_entries(x, y)).collect())
    want = {}
    for w, f in a + b:
        want[w.lower()] = want.get(w.lower(), 0) | f
    assert once == sorted(want.items())


def test_order_counts_and_marks(spark):
    a = spark.createDataFrame([("b", 1, 0), ("a", 0, 1)], "lemma string, flags int, pos long")
    b = spark.createDataFrame([("C", 0, 0), ("A", 4, 1)], "lemma string, flags int, pos long")
    assert [tuple(r)[:2] for r in words.merge_in_order(a, b).orderBy("seen").collect()] == [("b", 1), ("a", 4), ("c", 0)]
    e = entries(spark, [("run", 0), ("walk", 2), ("sit", 1)])
    marked = words.mark_pushed(e, spark.createDataFrame([("RUN",), ("run",), ("none",)], "lemma string"))
    assert sorted(map(tuple, marked.collect())) == [("run", 1), ("sit", 1), ("walk", 2)]
    assert tuple(words.counts(e).first()) == (3, 1) and words.pending(e).count() == 1


def test_create_entries(spark):
    rows = words.create_entries(spark.createDataFrame([("  Run﻿",), ("  ",), (None,)], "word string")).collect()
    assert rows[0]["lemma"] == "run" and rows[0]["error"] is None and rows[1]["error"] and rows[2]["error"]


@pytest.mark.parametrize("value", [text.FOLD_FROM])
def test_folds_match(value):
    assert len(value) == len(text.FOLD_TO) == 14


def test_normal_forms_without_python(spark):
    """Characters that become one other are replaced by Spark; the result is the normal form whatever stands beside them."""
    import random
    import unicodedata

    rng = random.Random(3)
    chars = [*"ab -", *"éüœ\xad\xa0ª½", *"\u0301\u0308\u3099ﬁ가ᄀ\u1161Ａ\U0001d400", *rng.sample(text.ONE_FROM, 60)]
    made = ["".join(rng.choice(chars) for _ in range(8)) for _ in range(300)] + ["", None, "ＡＢＣ"]
    fold = str.maketrans(text.FOLD_FROM, text.FOLD_TO)
    got = [r[0] for r in spark.createDataFrame([(t,) for t in made], "t string").coalesce(1).select(text.normalize(F.col("t"))).collect()]
    assert got == [t if t is None else unicodedata.normalize("NFKC", t.translate(fold)) for t in made]
    assert "ＡＢＣ".translate(str.maketrans(text.ONE_FROM, text.ONE_TO)) == "ABC"


def test_normal_forms_hold_few_texts(spark):
    """Of a batch of 20 MB a task holds a piece of about 1 MB as Python strings; nulls, empty texts and texts longer than a piece stay in their places."""
    import tracemalloc
    import unicodedata

    import pyarrow as pa

    batch = pa.array([f"½{k}" + "x" * 10_000 for k in range(2000)])
    tracemalloc.start()
    n = sum(len(piece) for piece in text._nfkc.func(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 and peak < 8 << 20
    made = [None, "½", "ﬁ" * 2 * text.PIECE_BYTES, "", None, *(f"{k}ﬁ" * 100_000 for k in range(9)), None]
    want = [t if t is None else unicodedata.normalize("NFKC", t) for t in made]
    assert [x for piece in text._nfkc.func(iter([pa.array(made), pa.array([], pa.string()), pa.array([None, None], pa.string())])) for x in piece.to_pylist()] == [*want, None, None]
    rows = spark.createDataFrame(enumerate(made), "k int, t string").repartition(3).select("k", text.normalize(F.col("t")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == want


def test_words_of_documents_move_once(spark):
    """With ids there is one shuffle of words, by document and base form."""
    names = spark.createDataFrame([("alice",)], "lower_name string")
    docs = spark.range(20).selectExpr("id AS doc_id", "'Alice runs and Cats ran' AS text")
    found = words.extract_entries(docs, "doc_id", proper_nouns=names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(r[0] for r in found.where("doc_id = 3").select("lemma").collect()) == ["and", "cat", "run"]
