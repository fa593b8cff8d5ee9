from pyspark.sql import functions as F

from glossaria.functions import responses
from glossaria.operators import delivery


def test_plan(spark):
    pending = spark.createDataFrame([(w,) for w in "abcdefg"], "lemma string")
    remote = spark.createDataFrame([("B",), ("g",)], "word string")
    script = spark.createDataFrame([("a", "server", 2), ("c", "server", 3), ("d", "client", 0), ("f", "auth", 0)], "lemma string, kind string, failures int")
    planned = delivery.plan(pending, remote, script)
    assert {r["lemma"]: tuple(r)[1:] for r in planned.collect()} == {
        "a": ("succeeded", 3, 2800), "b": ("existing", 0, 0), "c": ("failed", 3, 2800), "d": ("failed", 1, 0), "e": ("succeeded", 1, 0), "f": ("pending", 0, 0), "g": ("pending", 0, 0),
    }
    assert tuple(delivery.summary(planned).first()) == ("paused", 7, 5, 2, 1, 2, 2, 1600, "auth")
    assert delivery.summary(planned.limit(0)).first()["phase"] == "completed" and delivery.summary(planned.limit(0)).first()["error"] is None
    assert delivery.summary(planned.where("lemma <= 'd'")).first()["error"] == "client"
    assert tuple(delivery.summary(planned, "http").first()) == ("paused", 0, 0, 0, 0, 0, 0, 0, "http")
    assert [tuple(r) for r in delivery.progress(planned).orderBy("lemma").collect()] == [("a", 1, 1, 0, 0, 6), ("b", 2, 1, 1, 0, 5), ("c", 3, 1, 1, 1, 4), ("d", 4, 1, 1, 2, 3), ("e", 5, 2, 1, 2, 2)]


def test_delivery_runs(spark, tmp_path):
    import threading

    from glossaria.sources.store import VocabularyStore

    store = VocabularyStore(spark, str(tmp_path / "store"))
    store.merge_collected(spark.createDataFrame([(w, 0) for w in "abc"], "lemma string, flags int"))
    remote = lambda: spark.createDataFrame([("b",)], "word string")
    script = lambda _: spark.createDataFrame([("c", "client", 0)], "lemma string, kind string, failures int")
    gate, told = threading.Event(), []
    run = delivery.Delivery(store, remote, script, lambda: gate.wait(60) and "ok", told.append)
    assert run.status()["phase"] == "idle"
    first = run.start()
    assert run.start() is first and run.status()["phase"] == "running"
    gate.set()
    last = first.result(120)
    assert last == run.status() == {"phase": "completed", "total": 3, "processed": 3, "succeeded": 1, "existing": 1, "failed": 1, "pending": 0, "current": None, "error": "client"}
    assert [t["current"] for t in told if t["current"]] == ["a", "b", "c"] and told[0]["phase"] == "running"
    assert store.export_csv() == "lemma,flags\na,1\nb,1\nc,0\n"
    assert run.start() is not first
    run.start().result(120)
    for login, error in ((lambda: "auth", "auth"), (lambda: 1 / 0, "division by zero")):
        paused = delivery.Delivery(store, remote, script, login).start().result(120)
        assert (paused["phase"], paused["total"], paused["error"]) == ("paused", 0, error)


def test_collector(spark, tmp_path):
    import json

    from glossaria.operators import collector
    from glossaria.sources.store import VocabularyStore

    class Pushes:
        n, login = 0, staticmethod(lambda: "ok")

        def start(self):
            self.n += 1

        def status(self):
            return dict(delivery.IDLE)

    store, pushes, setting = VocabularyStore(spark, str(tmp_path / "store")), Pushes(), [None]
    c = collector.Collector(store, pushes, lambda: setting[0])
    send = lambda kind, **more: c.handle(json.dumps({"type": kind, **more}))
    assert send("WORDS_COLLECTED", entries=[{"lemma": "Run", "flags": 0}, {"lemma": "walk", "flags": 2}]) == {"total": 2, "pending": 1} and pushes.n == 1
    setting[0] = False
    assert send("IMPORT_CSV", csvText="h\nsit,0\n", fileName="f.csv") == {"total": 3, "pending": 2} == send("GET_COUNTS") and pushes.n == 1
    assert send("IMPORT_CSV", csvText="h\nsit,0\nx\n", fileName="f.csv") == {"ok": False, "error": "f.csv: CSV parse error at line 3: expected 2 columns, got 1"}
    assert send("MARK_PUSHED", lemmas=["RUN"]) == {"total": 3, "pending": 1} and send("EXPORT_CSV") == {"ok": True, "csv": "lemma,flags\nrun,1\nsit,0\nwalk,2\n"}
    assert send("RETRY_PUSH") is None and pushes.n == 2 and send("CHECK_LOGIN") == {"loggedIn": True} and pushes.n == 3 and send("GET_PUSH_STATUS")["phase"] == "idle"
    assert c.handle("nope") is None is send("X") is send("WORDS_COLLECTED", entries=[{"lemma": 1, "flags": 0}]) and send("COLLECT_WORDS") is None
    pages = spark.createDataFrame([("<p>Cats ran",), ("<p>cats",)], "html string")
    after = []
    assert collector.run_collection(pages, store, after=lambda: after.append(1)) == {"ok": True, "count": 2} and after == [1] and store.counts().first()["total"] == 4
    store.merge_collected = lambda _: 1 / 0
    assert send("WORDS_COLLECTED", entries=[]) == {"ok": False, "error": "merge-collected-failed"}


def test_lookups(spark):
    e = spark.createDataFrame([("run",), ("walk",)], "lemma string")
    book = spark.createDataFrame([("RUN",)], "word string")
    assert [r[0] for r in delivery.known_words(e, book).collect()] == ["run"] and [r[0] for r in delivery.new_words(e, book).collect()] == ["walk"]
    dictionary = spark.createDataFrame([("run", 2, "second"), ("run", 1, "first")], "word string, nth int, interpret string")
    assert sorted(map(tuple, delivery.with_definitions(e, dictionary).collect())) == [("run", "first"), ("walk", "")]


def column(spark, rows, schema, c):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(c).collect()]


def test_replies(spark):
    rows = [(401, ""), (403, "{}"), (500, "{}"), (200, "no"), (200, '{"result_code":200}'), (200, '{"resultCode":"200"}'), (200, '{"result_code":1}'), (200, "{}"), (None, None)]
    s, b = F.col("status"), F.col("body")
    assert column(spark, rows, "status int, body string", responses.classify_response(s, b)) == ["auth", "auth", "http", "malformed", "ok", "ok", "api", "api", "http"]
    again = [(404, "{}"), (500, "{}"), (200, '{"result_code":404}'), (200, '{"result_code":500}'), (200, '{"result_code":200}'), (401, "")]
    assert column(spark, again, "status int, body string", responses.retriable(s, b)) == [False, True, False, True, False, False]
    assert column(spark, rows, "status int, body string", responses.login_state(s, b)) == ["auth", "auth", "http", "malformed", "ok", "ok", "auth", "auth", "http"]
    assert column(spark, [('{"data_body":{"list":["a",{"word":"b"},{"x":1},2]}}',), ("{}",), ("x",), (None,)], "body string", responses.listed_words(b)) == [["a", "b"], [], [], []]
    assert column(spark, [('{"wordlist":[{"interpret":"i"},{"interpret":"j"}]}',), ('{"wordlist":[]}',), ("x",)], "body string", responses.definition(b)) == ["i", None, None]
    assert column(spark, [("w",)], "word string", responses.add_word_payload(F.col("word"), F.lit(None).cast("string"))) == ['{"word":"w","info":"","course":"*","wordidx":"*","infoidx":"100","selection":"*","opcode":"1"}']
    assert column(spark, [(["a", "b"],)], "words array<string>", responses.remove_words_payload(F.col("words"))) == ["a,b"]
    assert column(spark, [('{"data_body":{"list":[1]}}',), ('{"data_body":{"list":[]}}',), ("x",)], "body string", responses.exists_in_book(b)) == [True, False, False]


def test_messages(spark):
    good = ['{"type":"GET_COUNTS"}', '{"type":"WORDS_COLLECTED","entries":[]}', '{"type":"WORDS_COLLECTED","entries":[{"lemma":"a","flags":1}]}', '{"type":"MARK_PUSHED","lemmas":["a"]}', '{"type":"IMPORT_CSV","csvText":"","fileName":"f"}']
    bad = ['{"type":"X"}', "{}", "nope", '{"type":"WORDS_COLLECTED"}', '{"type":"WORDS_COLLECTED","entries":[{"lemma":"a","flags":"1"}]}', '{"type":"WORDS_COLLECTED","entries":[{"lemma":1,"flags":1}]}', '{"type":"MARK_PUSHED","lemmas":[1]}', '{"type":"IMPORT_CSV","csvText":1,"fileName":"f"}', None]
    got = column(spark, [(m,) for m in good + bad], "body string", responses.valid_message(F.col("body")))
    assert got == [True] * len(good) + [False] * len(bad)
    b = F.col("body")
    assert column(spark, [('{"ok":true,"csv":""}',), ('{"ok":false,"error":"e"}',), ('{"ok":true}',), ("[]",)], "body string", responses.valid_reply("export", b)) == [True, True, False, False]
    assert column(spark, [('{"loggedIn":true}',), ('{"loggedIn":"true"}',), ("x",), (None,)], "body string", responses.narrowed_login(b)) == [True, False, False, False]
    assert column(spark, [('{"ok":true,"csv":"c"}',), ('{"ok":false,"error":"e"}',), ('{"ok":true,"csv":1}',), ("x",)], "body string", responses.narrowed_export(b)) == [(True, "c", None), (False, None, "e"), (False, None, "export-unavailable"), (False, None, "export-unavailable")]
    assert column(spark, [('{"total":2,"pending":1}',), ('{"ok":false,"error":"e"}',), ("[]",)], "body string", responses.narrowed_import(b)) == [(True, 2, 1, None), (False, None, None, "e"), (False, None, None, "import-unavailable")]
    tallies = '"total":1,"processed":0,"succeeded":0,"existing":0,"failed":0,"pending":1'
    assert column(spark, [(f'{{"phase":"paused",{tallies}}}',), (f'{{"phase":"other",{tallies}}}',), ('{"phase":"idle","total":1}',)], "body string", responses.narrowed_status(b)) == ["paused", None, None]
    assert column(spark, [('{"loggedIn":false}',), ('{"ok":false}',)], "body string", responses.valid_reply("login", b)) == [True, False]
    assert column(spark, [('{"total":2,"pending":1}',), ('{"total":"2","pending":1}',)], "body string", responses.narrowed_counts(b)) == [(2, 1), None]
    assert column(spark, [("true",), ("false",), ("1",), (None,)], "body string", responses.auto_push(b)) == [True, False, True, True]
