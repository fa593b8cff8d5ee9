import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import glossaria
from glossaria import cli
from glossaria.operators import delivery, words
from glossaria.sources import files, html, list_files, list_sink, word_book, wordlist_csv
from glossaria.sources.store import VocabularyStore
from glossaria.streaming import changes, ingest


def bad(content):
    return [(r[0], r[3]) for r in wordlist_csv.parse(content) if r[3]]


def good(content):
    return [(r[1], r[2]) for r in wordlist_csv.parse(content) if not r[3]]


def test_csv_rows():
    assert good("lemma,flags\r\nRun,1\r\n walk , 0 \n\n\n") == [("run", 1), ("walk", 0)]
    assert good('x,y\n"a,b",1\n"q""q",2\n"two\nlines",3\n') == [("a,b", 1), ('q"q', 2), ("two\nlines", 3)]
    assert good("﻿lemma,flags\na,1") == [("a", 1)] and good("") == [] and good("run,1") == []
    assert bad("h\nrun\n") == [(2, "columns")] and bad("h\n,1") == [(2, "lemma")] and bad("h\nrun,abc") == [(2, "flags")] and bad("h\nrun,-1") == [(2, "flags")]
    assert bad('h\nrun,"1"') == [(2, "columns")] and bad("h\na,1\n\nb,2") == [(3, "columns")] and bad('h\n"a\nb",1\nc') == [(4, "columns")] and bad("h\na,4294967296") == [(2, "flags")]


@given(st.lists(st.tuples(st.text("ab\",\n x", min_size=1).filter(lambda s: s.strip(wordlist_csv.BLANKS) == s), st.integers(0, 2**31 - 1)), max_size=5))
def test_csv_round_trip(rows):
    quoted = ['"' + w.replace('"', '""') + '"' if set(w) & set(',"\n') else w for w, _ in rows]
    assert good("\n".join(["lemma,flags", *(f"{q},{f}" for q, (_, f) in zip(quoted, rows))]) + "\n") == rows


def test_html():
    assert html.page_text("<body><article><header>no</header><h1>Title</h1><p>foo <b>bar</b></p><p>baz<br>x</p></article>") == ("Title\nfoo \nbarbaz\n\nx\n", "article")
    assert html.page_text("<p>a<p>b<script>c</script><span hidden>d</span><i style='display: none'>e</i>") == ("a\nb\n", "body")
    assert html.page_text("<main>m &amp; n</main><div>x</div>") == ("m & n\n", "main")
    assert html.page_text("<body><pre>only pre</pre></body>") == ("only pre", "body")
    assert html.page_text("<p>x", "  chosen ") == ("  chosen ", "selection") and html.page_text("<p>x", "  ")[1] == "body"
    assert html.page_text("<article></article><p>outside") == ("", "article") and html.page_text("") == ("", "body") == html.page_text(None)
    assert html.page_text("<p>a <b>b</p><p>c</p>")[0] == "a \nbc"  # the unclosed tag is open again in the next paragraph
    assert html.page_text("<ul><li>a<li>b</ul>")[0].split() == ["a", "b"]


def test_files_and_cli(spark, tmp_path, capsys):
    for name, body in {"a.md": "﻿Cats sat", "B.TXT": "Dogs", "_c.md": "x", ".d.md": "no", "e.json": "no", "node_modules/f.md": "no", "g/h.txt": "walked"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    found = [r["file"] for r in files.listed(spark, str(tmp_path)).collect()]
    assert sorted(f.removeprefix(f"{tmp_path}/") for f in found) == ["B.TXT", "_c.md", "a.md", "g/h.txt"]
    assert cli.main(["extract", str(tmp_path)]) == 0
    assert (tmp_path / "a.words.csv").read_text() == "lemma,flags\ncat,0\nsit,0\n"
    assert cli.main(["extract", str(tmp_path), "-o", "x"]) == 1 and cli.main(["extract", str(tmp_path / "none")]) == 1
    (tmp_path / "empty").mkdir()
    capsys.readouterr()
    assert cli.main(["extract", str(tmp_path / "empty")]) == 0 and "no .md or .txt files" in capsys.readouterr().err
    assert cli.main(["extract", str(tmp_path / "a.md"), "-o", str(tmp_path / "new/a.csv")]) == 0 and "(2 words)" in capsys.readouterr().err
    assert (tmp_path / "new/a.csv").read_text() == "lemma,flags\ncat,0\nsit,0\n"
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    assert words.PUSHED_FLAG == 1 and glossaria.__version__ in capsys.readouterr().out
    (tmp_path / "m.csv").write_text("lemma,flags\nzoo,1\nCat,2\n")
    capsys.readouterr()
    assert cli.main(["merge", str(tmp_path / "m.csv"), str(tmp_path / "a.words.csv")]) == 0
    assert capsys.readouterr().out == "lemma,flags\nzoo,1\ncat,2\nsit,0\n"
    assert cli.main(["merge", str(tmp_path / "m.csv")]) == 1
    (tmp_path / "bad.csv").write_text("lemma,flags\nx\n")
    assert cli.main(["merge", str(tmp_path / "m.csv"), str(tmp_path / "bad.csv")]) == 1 and "line 2" in capsys.readouterr().err


def test_long_inputs_take_linear_time():
    import time

    n = 100_000
    pages = ["<p><b>x y" * 20_000, "<div>" * 20_000 + "x</i>" * 20_000, "<p><button>" + "<div>" * 20_000, "<b>" * 20_000 + "</b>" * 20_000]
    pages += [f"<style>{'a' * n}</style><p>x", "<b>" * n + "<i>" + "</b>" * n, f"<style>{'/*' * n}</style>", f"<style>{'@a{' * n}</style>", f"<style>{'p{' * n}</style>", f"<style>{'a ' * n}{{display:none}}</style><p>x"]
    pages += ["<style>" + "".join(f".c{k} p,#i{k}{{display:none}}" for k in range(20_000)) + "</style>" + "<div class=c7>" * 20_000, "<style>div div i{display:none}</style>" + "<div>" * 20_000, "<style>b~i{display:none}</style>" + "<b>x</b><i>y</i>" * 20_000]
    for page in pages:
        began = time.process_time()
        html.page_text(page)
        assert time.process_time() - began < 4, page[:40]
    began = time.process_time()
    assert len(bad('h\n"a,1\n' + "b,2\n" * 100_000)) == 1 and time.process_time() - began < 2


def test_html_formatting_is_reopened_three_times_at_most():
    assert html.page_text("<p><b><b><b><b>a</p><p>b")[0] == "ab"
    assert html.page_text("<p>a</p></b></i><p>b<i>c</p>d<p>e</i>f")[0] == "a\nb\ncdef\n"
    assert html.page_text("<p hidden>x<p>y", hidden=lambda tag, attrs: False)[0] == "x\ny\n"
    assert html.page_text("<p>x<code>y</code>", excluded=frozenset())[0] == "x\ny"


def test_html_style_sheets():
    css = "/* p{display:none} */ .ad, div.x.y , #z{color:red; display:none!important} @media print { p{display:none} } i{visibility:hidden} p b{display:none} q{display:block}"
    assert html.page_text(f"<style>{css}</style><p class='a ad'>1<p>2<div class='x'>3</div><div class='y x'>4</div><p id=z>5<p><i>6</i><b>7</b><q>8</q>")[0] == "2\n3\n8"
    assert html.page_text("<style>p{margin:0}</style><p>x")[0] == "x\n" and html.page_text("<style>*{display:none}</style><p>x")[0] == ""


#: Style sheet, page, and the marked texts that are seen.  By hand.
CASCADES = [
    ("p{display:none} p{display:block}", "<p>1", "1"),  # the later
    ("p{display:block} p{display:none}", "<p>1", ""),
    ("p.a{display:block} p{display:none}", "<p class=a>1<p>2", "1"),  # the more specific
    ("#x{display:block} p.a.b{display:none}", "<p id=x class='a b'>1<p class='b a'>2", "1"),
    ("p{display:none!important} #x{display:block}", "<p id=x>1", ""),  # the important
    ("p{display:none ! IMPORTANT;display:block}", "<p>1", ""),
    ("p{display:none}", "<p style='display:block'>1<p style='color:red'>2", "1"),  # its own style
    ("p{display:none!important}", "<p style='display:block'>1", ""),
    ("p{display:block!important}", "<p style='display:none'>1", "1"),
    ("p{display:block!important}", "<p hidden>1<p aria-hidden=true>2<p aria-hidden=false>3", "3"),  # attributes hide whatever styles say
    ("div i{display:none}", "<div><p><i>1</i>2</p></div><i>3</i>", "23"),  # around it
    ("div>i{display:none}", "<div><i>1</i><p><i>2</i></p></div>", "2"),  # its parent
    ("div > p > i, u{display:none}", "<div><p><i>1</i><u>2</u><b>3</b></p></div>", "3"),
    ("h1+p{display:none}", "<h1>1</h1><p>2</p><p>3</p>", "13"),  # right after
    ("h1~p{display:none}", "<p>1</p><h1>2</h1><div>3</div><p>4</p><p>5</p>", "123"),  # somewhere after
    ("h1 + br + p{display:none}", "<h1>1</h1><br><p>2</p><p>3</p>", "13"),
    ("h1+p{display:none}", "<div><h1>1</h1></div><p>2</p>", "12"),  # no sibling
    ("[data-x]{display:none}", "<p data-x>1<p data-y>2", "2"),
    ("[data-x=a],[data-x='b'],[data-x=\"c d\"]{display:none}", "<p data-x=a>1<p data-x=b>2<p data-x='c d'>3<p data-x=e>4", "4"),
    ("p[data-x^=a]{display:none} p[data-x$=z]{display:none} p[data-x*=mm]{display:none}", "<p data-x=ab>1<p data-x=yz>2<p data-x=kmmk>3<p data-x=b>4", "4"),
    ("p[data-x~=a]{display:none} p[lang|=en]{display:none}", "<p data-x='b a'>1<p data-x=ba>2<p lang=en-GB>3<p lang=end>4", "24"),
    ("p:hover,p::before,p:not(.a){display:none}", "<p>1", "1"),  # not understood
    ("p:hover,i{display:none}", "<p>1<i>2</i>", "1"),
    ("@media print{p{display:none} i{display:none}} b{display:none}", "<p>1<i>2</i><b>3</b>", "12"),
    ("@import 'x.css'; p{display:none}", "<p>1<div>2</div>", "2"),
    ("p{visibility:hidden} p.a{visibility:visible}", "<p>1<p class=a>2", "2"),
    ("p{visibility:collapse}", "<p>1<i>2</i></p>3", "3"),
    ("div{visibility:hidden} p{visibility:visible}", "<div>1<p>2</p></div>3", "3"),  # nothing is seen in what is hidden
    ("/* p{display:none} */ i{display:none} /* b{display:none}", "<p>1<i>2</i><b>3</b>", "13"),
    ("html p i{display:none} body>b{display:none}", "<p><i>1</i>2</p><b>3</b>", "2"),
    ("P.A{display:none} p.a{color:red}", "<p class=a>1<P class=A>2", "1"),  # tags in any case, classes not
    ("p{display:none", "<p>1<div>2</div>", "2"),  # the end is missing
    ("} p{display:none}", "<p>1<div>2</div>", "2"),
    ("div p{display:none}.a .b{display:none}", "<div class=a><div class=b>1</div></div><p class=b>2</p>", "2"),
]


@pytest.mark.parametrize("css, page, seen", CASCADES)
def test_cascade(css, page, seen):
    assert "".join(html.page_text(f"<html><head><style>{css}</style></head><body>{page}</body></html>")[0].split()) == seen


#: Pages with tags that are missing, crossed or misplaced, and their text by the standard's rules of tree construction.  By hand.
MALFORMED = [
    ("<b><p>x</b>y</p>", "xy\n"),
    ("<b><i>x</b>y</i>z", "xyz"),
    ("<b>x<div>y</b>z</div>w", "xyz\nw"),
    ("<i>a<b>b<p>c</i>d</b>e</p>", "abcde\n"),
    ("<b>1<p>2</b>3<p>4</b>5", "123\n45\n"),
    ("<em>a<ul><li>b</em>c</ul>d", "abc\nd"),
    ("<p><b>a<p>b</b>c", "abc\n"),
    ("<div><b>x</div>y</b>z", "xyz"),
    ("<a>x<a>y</a>z", "xyz"),
    ("<p>a</b>b", "ab\n"),
    ("<table>a<tr><td>b</td></tr></table>c", "ab\nc"),
    ("<div>a<table>b<tr><td>c</table>d</div>", "ab\nc\nd\n"),
    ("<table><b>x<tr><td>y</td></tr></table>z", "xy\nz"),
    ("<table><tr>x<td>a</td>y</tr></table>", "xya\n"),
    ("<div><table><div>x</div><tr><td>y</table>z</div>", "x\ny\nz\n"),
    ("<table><p>x<tr><td>y</table>", "x\ny\n"),
    ("<!DOCTYPE html><p>a<table><tr><td>b</table>c", "a\nb\nc"),
    ("<p>a<table><tr><td>b</table>c", "a\nb\nc\n"),  # without a doctype a table doesn't end a paragraph
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc\n"),
    ("<table><caption>t<tr><td>a</table>", "t\na\n"),
    ("<table> <tr> <td>a</td> </tr> </table>", " \n \na\n \n \n"),
    ("<table><td>a</table>b", "a\nb"),
    ("<table><tr><td><table><tr><td>a</table>b</table>c", "a\nb\nc"),
    ("<b><table><tr><td>x</b>y</td></tr></table>z", "xy\nz"),
    ("<table><tr><td><b>x</td><td>y</table>z", "xy\nz"),
    ("<table><tr><td>a</div>b</table>", "ab\n"),
    ("<div><table><tr><td>a</div>b</table>c</div>", "ab\nc\n"),
    ("<tr><td>a</td></tr>b", "ab"),
    ("<ul><li>a<li>b</ul>c", "a\nb\nc"),
    ("<li>a<div><li>b</div>c", "a\nbc\n"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc\n"),
    ("<p>a<div>b</p>c</div>", "a\nb\nc\n"),
    ("<p>a<p>b</p>c</p>d", "a\nb\ncd"),
    ("<div>a</p>b</div>", "a\nb\n"),
    ("<h1>a<h2>b</h1>c", "a\nb\nc"),
    ("<p>a<!-- c -->b</p>", "a\nb\n"),
    ("a<br/>b</br>c", "a\nb\nc"),
]


@pytest.mark.parametrize("page, text", MALFORMED)
def test_malformed_pages(page, text):
    assert html.page_text(page) == (text, "body")


def test_later_sheets_win():
    assert html.page_text("<style>p{display:none}</style><style>p{display:block}</style><p>x")[0] == "x\n"
    assert html.page_text("<body><p>x</p><style>p{display:none}</style><p>y</p>")[0] == "x\n"  # a sheet in the body holds for what follows


def test_remote_paths_and_names(spark, tmp_path):
    from datetime import datetime

    for name in ("a.md", ".b.md", "c/d.TXT", "node_modules/e.md", "_f.txt", "g.json", ".git/h.md", "c/.i/j.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    names = lambda path: sorted(r["file"] for r in files.listed(spark, path).collect())
    assert names(f"file://{tmp_path}") == [f"file://{tmp_path}/{n}" for n in ("_f.txt", "a.md", "c/d.TXT")]
    assert names(f"file://{tmp_path}/g.json") == [f"file://{tmp_path}/g.json"] and files._content(f"file://{tmp_path}/a.md") == b"x"
    with pytest.raises(FileNotFoundError):
        files.listed(spark, f"file://{tmp_path}/none")
    assert files.export_name(datetime(2024, 2, 9, 7, 5)) == "words-20240209-0705.csv" and files.output_name("/x/a.b.md") == "/x/a.b.words.csv"


def test_listing_a_deep_tree(spark, tmp_path):
    """A few thousand files on six levels, each level in one job."""
    want = set()
    for k in range(3000):
        at = tmp_path / "/".join(f"d{k // 7**i % 7}" for i in range(k % 6))
        at.mkdir(parents=True, exist_ok=True)
        (at / f"f{k}.{('md', 'TXT', 'json')[k % 3]}").write_text("")
        if k % 3 < 2:
            want.add(str(at / f"f{k}.{('md', 'TXT')[k % 3]}"))
    assert {r["file"] for r in files.listed(spark, f"{tmp_path}/").collect()} == want
    (tmp_path / "bare").mkdir()
    assert files.listed(spark, str(tmp_path / "bare")).isEmpty()


row_pieces = st.lists(st.sampled_from(['"', "\n", "\r\n", "\r", "a", ",", "1", "é", "b,2\n", "\ufeff"]), max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row_pieces, min_size=1, max_size=4), st.integers(1, 9))
def test_ranges_give_the_rows_of_the_whole(spark, tmp_path, contents, size):
    paths = []
    for k, c in enumerate(contents):
        (tmp_path / f"{k}.csv").write_bytes("".join(c).encode())
        paths.append((str(tmp_path / f"{k}.csv"),))
    got = sorted(map(tuple, list_files.read(spark.createDataFrame(paths, "file string"), size).collect()), key=repr)
    assert got == sorted(((p[0], *r) for p, c in zip(paths, contents) for r in wordlist_csv.parse("".join(c))), key=repr)


def test_a_large_list_in_ranges(spark, tmp_path):
    """20 MB with quoted line ends, errors, a row over several ranges and blank rows at the end, by many tasks and by one."""
    long = '"' + "x\n" * 1_500_000 + '",7\n'
    body = "lemma,flags\r\n" + "".join(f'"w{k}\nv, ""{k}""",{k % 9}\r\n' if k % 5 == 0 else f"w{k},x\n" if k % 100_003 == 1 else "\n" if k == 77 else f"w{k},{k % 9}\n" for k in range(900_000)) + long + "last,1\n" + "\r\n" * 3_000_000
    (tmp_path / "big.csv").write_text(body, newline="")
    got = list_files.read(spark.createDataFrame([(str(tmp_path / "big.csv"),)], "file string"), 1 << 20)
    want = [(str(tmp_path / "big.csv"), *r) for r in wordlist_csv.parse(body)]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert list_files.ranges(spark.createDataFrame([(str(tmp_path / "big.csv"),)], "file string"), 1 << 20).count() >= 20


def test_sink(spark, tmp_path):
    rows = spark.range(2000).select(F.format_string("w%05d,\"", "id").alias("lemma"), F.col("id").cast("int").alias("flags")).repartition(7)
    want = "lemma,flags\n" + "".join(f'"w{k:05d},""",{k}\n' for k in range(2000))
    for _ in range(2):  # the second replaces the first
        list_sink.write_list(rows, str(tmp_path / "one.csv"), single=True)
        list_sink.write_list(rows, f"file://{tmp_path}/parts", parts=3)
    assert (tmp_path / "one.csv").read_text() == want
    parts = sorted((tmp_path / "parts").iterdir())
    assert all(p.read_text().startswith("lemma,flags\n") for p in parts) and "lemma,flags\n" + "".join(p.read_text()[12:] for p in parts) == want and len(parts) > 1
    list_sink.write_list(rows.limit(0), str(tmp_path / "none.csv"), single=True)
    assert (tmp_path / "none.csv").read_text() == "lemma,flags\n"
    targets = rows.select(F.format_string(f"{tmp_path}/t/%d.csv", F.col("flags") % 3).alias("target"), F.when(F.col("flags") % 3 < 2, F.col("lemma")).alias("row"))
    list_sink.write_lists(targets.distinct(), "row")
    assert [(tmp_path / f"t/{k}.csv").read_text().count("\n") for k in range(3)] == [668, 668, 1]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["none.csv", "one.csv", "parts", "t"]  # nothing temporary is left


def test_a_sink_that_fails_leaves_nothing(spark, tmp_path):
    (tmp_path / "old.csv").write_text("lemma,flags\nold,1\n")
    list_sink.register(spark)
    fails = F.when(F.col("id") == 999, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string"))
    rows = spark.range(0, 1000, 1, 4).select(fails.alias("row"))
    with pytest.raises(Exception, match="no"):
        rows.write.format(list_sink.LIST_SINK).mode("overwrite").option("single", "true").save(str(tmp_path / "old.csv"))
    assert (tmp_path / "old.csv").read_text() == "lemma,flags\nold,1\n" and [p.name for p in tmp_path.iterdir()] == ["old.csv"]


def test_word_book(spark, tmp_path):
    word_book.register(spark)
    pages = [(k, 500 if k == 5 else 200, f'{{"result_code":200,"data_body":{{"list":["w{k}"]}}}}') for k in range(37)]
    spark.createDataFrame(pages, word_book.SCHEMA).repartition(3).write.format(word_book.WORD_BOOK).mode("append").save(str(tmp_path / "book"))
    read = spark.read.format(word_book.WORD_BOOK).option("pages_per_partition", 10).load(str(tmp_path / "book"))
    assert sorted(map(tuple, read.collect())) == pages and read.rdd.getNumPartitions() == 4
    assert sorted(r["word"] for r in delivery.listed(read).collect()) == sorted(f"w{k}" for k in range(37) if k != 5)
    assert spark.read.format(word_book.WORD_BOOK).option("pages", 3).load(str(tmp_path / "book")).count() == 3
    for n in (0, 1, 2, 3, 36, 37):
        assert word_book.n_pages(str(tmp_path / "none")) == 0
        (tmp_path / f"b{n}").mkdir()
        for k in range(n):
            (tmp_path / f"b{n}/page-{k}.json").write_text('{"status": 200, "body": ""}')
        assert word_book.n_pages(str(tmp_path / f"b{n}")) == n
    assert spark.read.format(word_book.WORD_BOOK).load(str(tmp_path / "b0")).collect() == []


def test_store_and_stream(spark, tmp_path):
    store = VocabularyStore(spark, str(tmp_path / "store"))
    assert store.get_all().count() == 0
    store.merge_collected(spark.createDataFrame([("run", 0), ("Walk", 2)], "lemma string, flags int"))
    assert store.mark_pushed(spark.createDataFrame([("RUN",)], "lemma string")) and not store.mark_pushed(spark.createDataFrame([("run",)], "lemma string"))
    assert store.export_csv() == "lemma,flags\nrun,1\nwalk,2\n"
    before = store.counts().first()
    with pytest.raises(wordlist_csv.WordListError, match="Error in b.csv: CSV parse error at line 2"):
        store.import_csv(spark.createDataFrame([("a.csv", "h\nsit,1\n"), ("b.csv", "h\nx,y\n")], "file string, content string"))
    assert store.counts().first() == before
    spark.createDataFrame([("Cats run",), (None,)], "text string").write.parquet(str(tmp_path / "docs"))
    for k in range(2):  # a second run sees the same files again and changes nothing
        ingest.ingest(ingest.document_stream(spark, str(tmp_path / "docs"), "text string"), store, str(tmp_path / f"cp{k}")).awaitTermination()
        assert store.export_csv() == "lemma,flags\ncat,0\nrun,1\nwalk,2\n"
    store.clear()
    assert tuple(store.counts().first()) == (0, 0)


def stored(store):
    return {r["lemma"]: r["flags"] for r in store.get_all().collect()}


def size_of_data(store):
    import pathlib

    return sum(p.stat().st_size for p in pathlib.Path(store.path).rglob("*.parquet"))


def test_store_writes_what_is_new(spark, tmp_path):
    """Merging a hundredth of a store writes about that much, also when what it brings is there already; reading doesn't move the base."""
    store = VocabularyStore(spark, str(tmp_path / "store"), buckets=3)
    words_ = spark.range(200_000).select(F.concat(F.lit("w"), F.sha1(F.col("id").cast("string").cast("binary"))).alias("lemma"), (F.col("id") % 3).cast("int").alias("flags"))
    store.merge_collected(words_)
    store.compact()
    base = size_of_data(store) / 2  # the first delta and the base
    for k in range(2):
        before = size_of_data(store)
        store.merge_collected(words_.where(F.col("lemma") < "w03").union(spark.createDataFrame([(f"new{k}", 4)], words.ENTRY)))
        assert size_of_data(store) - before < 0.03 * base
    found = store.get_all()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 200_002 and plan.count("Exchange hashpartitioning") == 2  # both of the deltas
    assert "Bucketed: true" in plan
    assert stored(VocabularyStore(spark, str(tmp_path / "store"))) == {r["lemma"]: r["flags"] for r in words_.collect()} | {"new0": 4, "new1": 4}


def test_store_of_several_writers(spark, tmp_path):
    """Three writers, one that compacts and one that marks at the same time: nothing is lost."""
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "store")
    VocabularyStore(spark, path, buckets=2).merge_collected(spark.createDataFrame([("all", 2), ("run", 0)], words.ENTRY))

    def write(k):
        store = VocabularyStore(spark, path, buckets=2, most_deltas=5)
        for n in range(6):
            store.merge_collected(spark.createDataFrame([(f"w{k}-{n}", k + 1), ("all", 8 << k)], words.ENTRY))

    def mark():
        assert VocabularyStore(spark, path, buckets=2).mark_pushed(spark.createDataFrame([("RUN",)], "lemma string"))

    def compact():
        for _ in range(3):
            VocabularyStore(spark, path, buckets=2).compact()

    with ThreadPoolExecutor(5) as pool:
        for f in [pool.submit(write, 0), pool.submit(write, 1), pool.submit(write, 2), pool.submit(mark), pool.submit(compact)]:
            f.result()
    store = VocabularyStore(spark, path)
    want = {f"w{k}-{n}": k + 1 for k in range(3) for n in range(6)} | {"all": 2 + 8 + 16 + 32, "run": 1}
    assert stored(store) == want
    versions = [e["version"] for e in store._entries()]
    assert versions == list(range(1, len(versions) + 1))
    store.compact()
    store.compact()
    assert store.vacuum() > 10 and stored(store) == want and stored(VocabularyStore(spark, path)) == want and store.vacuum() == 0
    store.merge_collected(spark.createDataFrame([("after", 0)], words.ENTRY))
    assert stored(store) == want | {"after": 0}


def test_store_cleared_meanwhile(spark, tmp_path, monkeypatch):
    """A mark and a base made of what a clear has taken away meanwhile bring nothing back; a merge that comes after it stays."""
    store = VocabularyStore(spark, str(tmp_path / "store"), buckets=2)
    store.merge_collected(spark.createDataFrame([("a", 0), ("b", 0)], words.ENTRY))
    commit = store._commit

    def late(entry, known):
        monkeypatch.setattr(store, "_commit", commit)
        store.clear()
        store.merge_collected(spark.createDataFrame([("c", 2)], words.ENTRY))
        return commit(entry, known)

    monkeypatch.setattr(store, "_commit", late)
    assert not store.mark_pushed(spark.createDataFrame([("a",)], "lemma string")) and stored(store) == {"c": 2}
    monkeypatch.setattr(store, "_commit", late)
    store.compact()
    assert stored(store) == {"c": 2}
    assert not store.mark_pushed(spark.createDataFrame([("a",)], "lemma string")) and store.mark_pushed(spark.createDataFrame([("C",), (None,)], "lemma string"))
    store.merge_collected(spark.createDataFrame([(None, 1)], words.ENTRY))
    assert stored(store) == {"c": 3}


def test_store_lists_as_files(spark, tmp_path):
    store = VocabularyStore(spark, str(tmp_path / "store"))
    store.merge_collected(spark.createDataFrame([("b,c", 1), ("a", 0)], words.ENTRY))
    store.export_file(str(tmp_path / "x.csv"))
    other = VocabularyStore(spark, str(tmp_path / "other"))
    other.import_files(spark.createDataFrame([(str(tmp_path / "x.csv"),)], "file string"))
    assert (tmp_path / "x.csv").read_text() == store.export_csv() == other.export_csv() == 'lemma,flags\na,0\n"b,c",1\n'
    (tmp_path / "bad.csv").write_text("h\nx\n")
    with pytest.raises(wordlist_csv.WordListError, match="line 2"):
        other.import_files(spark.createDataFrame([(str(tmp_path / "bad.csv"),)], "file string"))


def test_stream_of_changes(spark, tmp_path):
    """Words that come again give no rows, a stream that starts again goes on, and a batch that runs again replaces what it wrote."""
    schema, at = "text string, flags int", lambda name: str(tmp_path / name)

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at("in"))

    def run():
        changes.record(changes.entries_of(ingest.document_stream(spark, at("in"), schema, 1), flags="flags"), at("out"), at("progress")).awaitTermination()
        return {(r["lemma"], r["flags"], r["added"], r["batch"]) for r in spark.read.schema(f"{changes.CHANGE}, batch long").parquet(at("out")).collect()}

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    add([("Cats ran", 1), ("cat", 2), (None, 4), ("", 4)])
    first = run()
    assert first == {("cat", 3, 3, 0), ("run", 1, 1, 0)}
    assert run() == first  # nothing new
    add([("cats run", 1)])
    assert run() == first  # the same words again
    add([("Cats and dogs", 8)])
    assert run() - first == {("cat", 11, 8, 2), ("and", 8, 8, 2), ("dog", 8, 8, 2)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    import shutil

    (tmp_path / "progress/commits/.2.crc").unlink(missing_ok=True)  # as if the driver had died before the last batch was done
    (tmp_path / "progress/commits/2").unlink()
    shutil.rmtree(tmp_path / "out/batch=2")
    assert run() - first == {("cat", 11, 8, 2), ("and", 8, 8, 2), ("dog", 8, 8, 2)}


def test_references_without_a_semicolon():
    page = "<style>b{color:red}</style><script>a&amp</script><article><h1>a &amp</h1><p>&am b &lt;&amp;amp; &#65;&#66 R&D;&copy c</p></article>"
    assert html.page_text(page)[0] == "a &\n&am b <&amp; AB R&D;© c\n"  # by the standard
    assert html.page_text(page, open_references=False)[0] == "a &amp\n&am b <&amp; A&#66 R&D;&copy c\n"


def test_pages_cut_within_a_reference_equal_the_sql(spark, tmp_path):
    import duckdb

    from glossaria.plans import registry

    texts = ["One two &amp", "One two &am", "Cut &quot", "Three &amp; four &lt;five", "Six &copy"]
    body = [f'<!DOCTYPE html><html><head><style>p{{margin:0}}</style></head><body><article><h1>{t}</h1><p><b>{t}<br><p>said {t}</p></article></body></html>' for t in texts]
    spark.createDataFrame(list(enumerate(body)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("collect_pages", "page_collection", "page_vocabulary", "styled_pages", "pages_without_headings"):
        got, want = registry.QUERIES[name](spark, str(tmp_path)).collect(), con.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(map(tuple, got)) == sorted(want[list(got[0].asDict())].itertuples(index=False, name=None)), name


def test_rows_one_at_a_time():
    """The rows of every short text, against lines joined while a quote is open."""
    import itertools

    from glossaria.sources import wordlist_csv

    def plainly(text, whole):
        rows, open_ = [], False
        for n, line in enumerate(text.split("\n"), 1):
            if open_:
                rows[-1][1].append(line)
            else:
                rows.append((n, [line]))
            open_ ^= line.count('"') % 2 == 1
        while whole and rows and rows[-1][1] == [""]:
            rows.pop()
        return [(n, "\n".join(x)) for n, x in rows]

    for k in range(8):
        for t in itertools.product('a"\n', repeat=k):
            for whole in (True, False):
                assert list(wordlist_csv._each_row("".join(t), 1, whole)) == plainly("".join(t), whole)


def test_lists_are_handed_on_in_parts():
    """The rows of long lists leave the reader in batches of bounded size."""
    import pyarrow as pa

    from glossaria.sources import wordlist_csv

    class Files:  # gives the reader's function away
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    content = "lemma,flags\n" + "w,1\n" * 15_000
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array([content, None, content])], ["file", "content"])
    assert [b.num_rows for b in wordlist_csv.read_lists(Files())([batch])] == [wordlist_csv.ROWS, 30_000 - wordlist_csv.ROWS]


def test_a_stream_task_passes_a_word_on_once():
    import pyarrow as pa

    from glossaria.streaming import changes

    batch = lambda words, flags: pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(flags, pa.int32())], ["lemma", "flags"])
    out = [b.to_pylist() for b in changes._combined([batch(["a", None, "B"], [1, 1, None]), batch(["A", "b"], [2, 0])])]
    assert out == [[{"lemma": "a", "flags": 3}, {"lemma": "b", "flags": 0}]] and list(changes._combined([])) == []
