"""Fill-in-middle, chat formatting and the repair of conversations against plain versions of their own."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from glossaria.llm import chat, fim, repair, turns

SPACE = "[\x20\x09-\x0d]"
WORDS = re.compile(f"{SPACE}*[^\x20\x09-\x0d]+|{SPACE}+")
SCHEMA = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def cut_plainly(doc_id, text, seed=42):
    text, units = text or "", WORDS.findall(text or "")
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return len(units), "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{suf}<P>{pre}<M>{mid}") if h4 % 100 < 80 else ("psm", f"<P>{pre}<S>{suf}<M>{mid}")
    return len(units), form, len(pre), len(mid), sha(out), sha(text)


def test_fill_in_middle(spark, docs, no_docs, rows):
    def check(df, all_rows):
        got = sorted(map(repr, (tuple(r) for r in fim.digests(df).collect())))
        assert got == sorted(repr((r[0], *cut_plainly(r[0], r[1]))) for r in all_rows)

    check(docs, rows)
    odd = ["a <P> b", "<S>", "x<M>y", "<P", "<p> a", " \t\n", "a b　c \x1c", "\U0001f600 é́ " * 40, "\x00 \x0b\x0c", "end   "]
    extra = [(100 * k + j, t) for k, t in enumerate(odd) for j in range(12)]
    check(spark.createDataFrame(extra, "doc_id long, text string").withColumn("output", F.lit("x")).withColumn("n", F.lit(1)), extra)
    assert fim.digests(no_docs).collect() == []
    out = fim.transform(spark.createDataFrame(extra, "doc_id long, text string"), rate=100, spm_rate=0).collect()
    assert {r["form"] for r in out} == {"psm", "plain"} and all(r["output"] == dict(extra)[r["doc_id"]] for r in out if r["form"] == "plain")


def test_long_texts_in_windows(spark):
    """Windows of 7 and of the standard size give the places of the whole; one word or one blank of megabytes is a unit."""
    rng, splitter = random.Random(3), Split(Regex(fim.UNIT), "isolated")
    for _ in range(200):
        text = "".join(rng.choice("ab  \n\té\U0001f600") for _ in range(rng.randint(0, 60)))
        units, d = WORDS.findall(text), (rng.getrandbits(32), rng.getrandbits(32))
        a, b = sorted(x % (len(units) + 1) for x in d)
        assert fim.cut_at(text, d, splitter, 7) == (len(units), len("".join(units[:a])), len("".join(units[:b])))
    long = [(1, "w" * 3_000_000), (2, " " * 3_000_000), (3, "ab cé " * 300_000), (4, "x" + "\n" * 1_000_000 + "y")]
    got = {r["doc_id"]: tuple(r)[1:] for r in fim.digests(spark.createDataFrame(long, "doc_id long, text string")).collect()}
    assert got == {i: cut_plainly(i, t) for i, t in long}


def conversations():
    """Nulls, empty and long texts, repeated rows and turns, a conversation that holds most rows, texts that look like marks."""
    rng = random.Random(5)
    odd = [None, "", " \n", "Yes.", "No", "ok!", "\\### Assistant: </turn> ok", "<turn user>\nx\n</turn>\n", "<\\turn", "</\\\\turn>", "\\", "Why? ", "é\U0001f600.", "a" * 3000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "user", "assistant", None, "", "User", "tool", "a>b\n%3E<turn"]
    rows = []
    for conv in [*range(120), None]:
        rows += [(conv, rng.choice([t, t, t, 2 * t, None]), rng.choice(roles[: 3 if rng.random() < 0.4 else 12]), rng.choice(odd)) for t in range(rng.randint(1, 9))]
    rows += [(500, t, "user" if t % 2 else "assistant", f"{rng.choice(odd)}{t % 300}.") for t in range(2500)]
    rows += [(501, 3, "user", "same.")] * 300 + [(502, None, "user", None), (-2, -5, "assistant", "x" * 3_000_000 + " <turn")]
    rng.shuffle(rows)
    return rows


def in_turn(rows):
    first = lambda x: (x is not None, x)
    found = {}
    for r in sorted(rows, key=lambda r: (first(r[0]), first(r[1]), (r[2] or "").encode(), (r[3] or "").encode())):
        found.setdefault(r[0], []).append(r)
    return found


@pytest.fixture(scope="module")
def talks(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("piece", "chars", "starts", "position", "part", "tie", "kind", "state", "first", "segment", "edits", "n"):
        df = df.withColumn(c, F.lit(f"other {c}"))
    return rows, df


def test_positions_over_ranges(spark):
    """A key of two thirds of all rows, most of them alike, is in several ranges, and sums go on from one to the next."""
    data = [(1 if k % 3 else k % 7 if k % 5 else None, 0 if k % 2 else k, "x", k % 11) for k in range(3000)]
    df = spark.createDataFrame(data, "key long, turn long, text string, size long").repartition(3)
    got = turns.in_order(df, "key", ("turn",), {"before": "size"}, "test")
    assert got.columns == ["key", "turn", "text", "size", "position", "before"]
    by = {}
    for r in sorted(got.collect(), key=lambda r: (str(r["key"]), r["position"])):
        by.setdefault(r["key"], []).append(r)
    assert sum(map(len, by.values())) == 3000
    for own in by.values():
        assert [r["position"] for r in own] == list(range(len(own))) and [r["turn"] for r in own] == sorted(r["turn"] for r in own)
        assert [r["before"] for r in own] == [0, *itertools.accumulate(r["size"] for r in own)][:-1]


def test_chat(spark, talks):
    rows, df = talks
    want = {}
    for conv, own in in_turn(rows).items():
        text = lambda r: r[3] or ""
        loss = "".join(text(r) for r in own if r[2] == "assistant")
        want[conv] = len(own), sha("".join(f"{r[2] or ''}\n{text(r)}\n" for r in own)), len(loss), sha(loss)
    got = chat.digests(df).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == want and len(got) == len(want)
    assert all(r["formatted_chars"] >= r["loss_chars"] + 17 * r["n_turns"] for r in got)
    assert chat.digests(df.limit(0)).collect() == []


def test_examples_have_all_turns_before(spark, talks):
    """Each reply's example, written out whole: the turns up to it, with the reply alone under the mask."""
    rows, df = talks
    few = df.where("conv_id BETWEEN 0 AND 119 OR conv_id IS NULL")
    stream = chat.stream(few)
    found = chat.texts(stream, chat.examples(stream)).select("*", chat.turns_of(F.col("text")).alias("turns")).collect()
    want = {}
    for conv, own in in_turn([r for r in rows if r[0] is None or 0 <= r[0] < 120]).items():
        for k, r in enumerate(own):
            if r[2] == "assistant":
                want[conv, k] = [(x[2] or "", x[3] or "") for x in own[: k + 1]]
    assert {(r["conv_id"], r["position"]): [tuple(t) for t in r["turns"]] for r in found} == want and len(found) == len(want)
    for r in found:
        reply = r["text"][r["loss_from"] : r["loss_to"]]
        assert re.sub(r"(</?)\\(\\*turn)", r"\1\2", reply) == want[r["conv_id"], r["position"]][-1][1] and r["text"][r["loss_to"] :] == "\n</turn>\n"
    marks = [r["text"] for r in found]
    assert all(len(re.findall(r"<turn ", t)) == len(re.findall(r"</turn>", t)) == len(r["turns"]) for t, r in zip(marks, found))


def repaired_plainly(symbols):
    """(cost, labels, edits) by memo over (row, role state), whole label strings compared."""
    grammar, nothing = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}, (float("inf"), "~", ())

    @functools.cache
    def best(row, state, inserted=0):
        found = [nothing]
        if row == len(symbols) and state in (0, 3):
            found.append((0, "", ()))
        arcs = []
        if row < len(symbols):
            initial, fault = symbols[row]
            arcs.append((4, "D", "", row + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if initial in grammar[state]:
                    arcs.append((more, "K", initial, row + 1, grammar[state][initial], 0))
                arcs += [(3 + more, "R", x, row + 1, grammar[state][x], 0) for x in "ua" if x in grammar[state]]
        if inserted < 3:
            arcs += [(3, "I", x, row, grammar[state][x], inserted + 1) for x in "ua" if x in grammar[state]]
        for cost, label, role, *at in arcs:
            c, s, e = best(*at)
            found.append((c + cost, label + s, ((label, role), *e)))
        return min(found, key=lambda x: x[:2])

    return best(0, 0)


def test_shortest_paths():
    symbols = list(itertools.product("sua-", ("fine", "blank", "duplicate", "truncated")))
    rng, composed = random.Random(8), repair.Composed()
    cases = [list(c) for n in range(3) for c in itertools.product(symbols, repeat=n)]
    cases += [[rng.choice(symbols) for _ in range(rng.randint(3, 14))] for _ in range(1500)]
    for own in cases:
        cost, edits, tail = repair.shortest(own, composed)
        want = repaired_plainly(tuple(own))
        assert (cost, repair.labels(edits, tail)) == want[:2]
        given = [x for act, (initial, _) in zip(edits, own) for x in (initial if c == "K" else c.lower() for c in act if c != "D")] + list(tail)
        assert given == [role for label, role in want[2] if label != "D"] and re.fullmatch("(s?(ua)+)?", "".join(given))
    assert len(composed.known) < 2000  # what symbols do is worked out once for each way that weights differ


def damaged_plainly(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


@pytest.mark.parametrize("segment", [repair.SEGMENT, 7])
def test_repair(spark, talks, segment, monkeypatch):
    rows, df = talks
    monkeypatch.setattr(repair.repair, "__defaults__", (segment,))
    found = in_turn(damaged_plainly(rows))
    want = {}
    for conv in {r[0] for r in rows}:
        own, seen, symbols = found.get(conv, []), set(), []
        for r in own:
            text = r[3].strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not text else "duplicate" if r[2:] in seen else "truncated" if text[-1] not in ".!?" else "fine"
            seen.add(r[2:])
            symbols.append((r[2][:1] if r[2][:1] in tuple("sua") else "-", fault))
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        count = [sum(f == x for _, f in symbols) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        if len(own) > 200:
            cost, edits, tail = repair.shortest(symbols, repair.Composed())
            audit, path = repair.labels(edits, tail), [(("R" if c.isupper() else "I") if c.lower() in "ua" else c, c.lower()) for c in "".join(edits) + tail]
        else:
            cost, audit, path = repaired_plainly(tuple(symbols))
        lines, at = [], 0
        for label, role in path:
            name = {"u": "user", "a": "assistant"}.get(role)
            if label == "I":
                lines.append(f"{name}:")
                continue
            if label != "D":
                lines.append(f"{own[at][2] if label == 'K' else name}:{own[at][3]}")
            at += 1
        want[conv] = (gaps, *count, illegal, cost, audit, sha("\n".join(lines)))
    got = repair.digests(df).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert repair.digests(df.limit(0)).collect() == []


def test_examples_are_written_out(spark, talks):
    """Each reply's example holds its whole context, whatever the segments are, and is what digests read."""
    rows, df = talks
    few = df.where("conv_id BETWEEN 0 AND 60 OR conv_id IS NULL OR conv_id = 500 AND turn < 40")
    stream = chat.stream(few)
    pieces = {}
    for r in sorted(stream.collect(), key=lambda r: (str(r["conv_id"]), r["position"])):
        pieces.setdefault(r["conv_id"], []).append(r)
    want = {(c, r["position"]): ("".join(x["piece"] for x in own[: k + 1]), r["loss_from"], r["loss_to"]) for c, own in pieces.items() for k, r in enumerate(own) if r["loss_from"] is not None}
    for segment in (50, 5000, chat.SEGMENT):
        got = chat.examples(stream, segment).collect()
        assert {(r["conv_id"], r["position"]): (r["text"], r["loss_from"], r["loss_to"]) for r in got} == want and len(got) == len(want)
