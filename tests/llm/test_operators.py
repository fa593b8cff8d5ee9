import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from glossaria.llm import bpe, common, counts, knn, langid, linededup, media, mixing, neardup, repeats, substrings, suffixes

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SPACES = " \t\n\x0b\x0c\r"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def by_id(df, unique):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] in unique}


def lowered(s):
    return s.encode().lower().decode()


@pytest.mark.parametrize("run", [lambda d: bpe.digests(d, TOKENIZER), langid.identify, linededup.drop_repeated, neardup.near_duplicates, lambda d: media.read_back(media.headers(media.store(d))), mixing.taken, substrings.digests, suffixes.digests])
def test_every_row_and_no_rows(docs, no_docs, rows, run):
    assert sorted(str(r["doc_id"]) for r in run(docs).collect()) == sorted(str(r[0]) for r in rows)
    assert run(no_docs).collect() == []


def test_knn(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(300)]
    vectors += [(300 + i, [0.5] * 6) for i in range(80)]  # many ties
    vectors += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, [0.5, 0.5]), (405, []), (None, [1.0] * 6), (0, vectors[1][1])]
    data = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("cell", F.lit("x")).repartition(4)
    queries = data.where("vec_id % 20 = 0")
    fine = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v] + [0] * (6 - len(v))) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for settings in ({}, {"group_queries": 3, "run_data": 40}, {"group_queries": 3, "run_data": 40, "cell_queries": 2}):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in knn.top_k(queries, data, 20, **settings).collect())
        want = []
        for i, q in fine:
            if i % 20 == 0:
                best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i)[:20]
                want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
        assert got == sorted(want)
    assert knn.top_k(queries.limit(0), data).collect() == [] == knn.top_k(queries, data.limit(0)).collect()
    assert knn.top_k(queries.where("vec_id = 20"), data.where("vec_id in (20, 40)"), 20).count() == 1  # all, if fewer


def test_knn_of_one_id_far_apart(spark):
    """Two vectors of one id that lie in different cells are separate queries."""
    rng = np.random.default_rng(2)
    data = spark.createDataFrame([(i, [float(x) for x in rng.normal((-1) ** i, 0.1, 6)]) for i in range(200)], "vec_id long, embedding array<float>").repartition(4)
    queries = spark.createDataFrame([(900, [1.0] * 6), (900, [-1.0] * 6)] + [(901 + i, [float((-1) ** i)] * 6) for i in range(10)], data.schema)
    found = collections.Counter((r["query_id"], r["vec_id"] % 2) for r in knn.top_k(queries, data, 20, group_queries=2).collect())
    assert found[900, 0] == found[900, 1] == 20


def test_bounds_leave_out_other_clusters(spark):
    """Vectors of one length in tight clusters: most data go to few groups, and the answer is that of all pairs."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (16, 6))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = 4 * centres[rng.integers(0, 16, 2000)] + rng.normal(0, 0.02, (2000, 6))
    data = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    report = {}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in knn.top_k(data.where("vec_id % 5 = 0"), data, 5, group_queries=40, cell_queries=25, report=report).collect()}
    v = np.floor(64 * x).astype(np.int64)
    for q in range(0, 2000, 5):
        best = sorted((-int(v[q] @ v[j]), j) for j in range(2000) if j != q)[:5]
        assert [got[q, n + 1] for n in range(5)] == [(j, -s) for s, j in best]
    assert report["groups"] >= 8 and report["copied"] < 0.5 * report["groups"] * report["data"]


def test_bpe(spark, docs, unique):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    odd = {1: "a  <|endoftext|>  b<|endoftext|><|endoft", 2: "x y\x1c\x85 z　 ", 3: "\U0001f600 it's\tI'LL  \n\n ", 4: "٣½Ⅷ ǅ ́"}
    extra = spark.createDataFrame(list(odd.items()), "doc_id long, text string")
    for df, texts in ((docs, unique), (extra, odd)):
        got = by_id(bpe.digests(df, TOKENIZER), texts)
        for i, t in texts.items():
            ids = tokenizer.encode(t, add_special_tokens=False).ids
            assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False)))
        back = by_id(bpe.decode(bpe.encode(df, TOKENIZER), TOKENIZER), texts)
        assert {i: r["text"] for i, r in back.items()} == texts
    x = np.array([0, 191, 192, 447, 448, 16_319, 16_320, 70_000, 2**31])
    assert (bpe._unpack_ranks(bpe._pack_ranks(x)) == x).all()


def test_language(spark, docs, no_docs):
    rows = [(i, "the cat and the house of the king" if i % 2 else "le chat et la maison du roi", "en" if i % 2 else "fr") for i in range(60)]
    texts = spark.createDataFrame(rows + [(900, None, "en"), (901, "123 !", "fr"), (None, "the king", None)], "doc_id long, text string, lang string")
    got = langid.identify(texts).collect()
    for r in got:
        if r["doc_id"] is None:
            assert not r["held_out"]
            continue
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["lang_pred"] == ("und" if r["doc_id"] >= 900 else "en" if r["doc_id"] % 2 else "fr")
    unlearnt = langid.identify(texts.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlearnt} == {("und", 0.0)}
    kept = langid.recognized(docs, langid.train(docs))
    assert kept.columns == docs.columns and all(any(c.isalpha() for c in r["text"]) for r in kept.collect())


def test_code_lengths_by_hand():
    """In `abab` and `ac`: contexts of one byte; a was followed twice by b and once by c, b once by a."""
    m = langid.Model({"x": [b"abab", b"ac"]}, order=1)
    cost = lambda t: m.lengths([t])[0, 0] / langid.UNIT
    close = lambda x, *p: abs(x + sum(np.log2(p))) < 0.01
    assert close(cost(b"a"), 3 / 9) and close(cost(b"ab"), 3 / 9, 2 / 5) and close(cost(b"ac"), 3 / 9, 1 / 5)
    assert close(cost(b"aa"), 3 / 9, 2 / 5, 3 / 9)  # a was never followed by a: escape, then the empty context
    assert close(cost(b"z"), 3 / 9, 2**-8)  # unknown: escape, then one of 256
    assert (m.lengths([b"ab", b"ac", b"a"])[:, 0] == [m.lengths([t])[0, 0] for t in (b"ab", b"ac", b"a")]).all()


def ppm_by_force(texts, order, text):
    """Bits of a text: the longest known context first, escapes of method C down to the empty one, 8 bits more below it."""
    seen = collections.defaultdict(collections.Counter)
    for t in texts:
        for p in range(len(t)):
            for k in range(min(order, p) + 1):
                seen[t[p - k : p]][t[p]] += 1
    bits = 0.0
    for p in range(len(text)):
        for k in range(min(order, p), -2, -1):
            if k < 0:
                bits += 8
                break
            c = seen.get(text[p - k : p])
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if text[p] in c:
                bits -= np.log2(c[text[p]] / (n + d))
                break
            bits -= np.log2(d / (n + d))
    return bits


def test_code_lengths_by_force():
    rng = np.random.default_rng(4)
    texts = {lang: [bytes(rng.choice(list(letters), rng.integers(1, 40)).tolist()) for _ in range(12)] for lang, letters in (("x", b"abcd"), ("y", b"abez"), ("z", b"q"))}
    m = langid.Model(texts, order=3)
    for t in [b"a", b"abcdabez", b"qqqq", b"hello abc", *texts["y"][:3], bytes(rng.choice(list(b"abcdezq!"), 200).tolist())]:
        got = m.lengths([t])[0] / langid.UNIT
        assert np.allclose(got, [ppm_by_force(texts[lang], 3, t) for lang in m.langs], atol=0.01 * len(t))


def test_held_out_accuracy(spark):
    """Every language is learned, the one with long documents only, too, and held-out documents are told apart."""
    import random

    rng = random.Random(6)
    stock = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(80)] for lang, letters in (("en", "etaoinshr"), ("fr", "esaitnrul"), ("xx", "qwzkvjyb"))}
    rows = [(i, " ".join(rng.choice(stock[lang]) for _ in range(8000 if lang == "xx" else 40)), lang) for i in range(240) for lang in [("en", "fr", "xx")[i % 3]]]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=20).collect()
    held = [r["lang_pred"] == rows[r["doc_id"]][2] for r in got if r["held_out"]]
    assert len(held) > 40 and sum(held) >= 0.95 * len(held) and {r["lang_pred"] for r in got} == {"en", "fr", "xx"}


def test_rollup(spark):
    rollup = counts.Rollup(spark)
    signed = lambda rows: spark.createDataFrame(rows, "source string, lang string, tokenizer string, sign int, n_tokens long")
    totals = lambda: {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}
    assert totals() == {}
    assert rollup.commit("b1", signed([("s", "en", "v1", 1, 5), ("s", "en", "v1", 1, 5), (None, None, "v1", 1, 3), ("t", "en", "v1", None, 9)]))
    assert not rollup.commit("b1", signed([("s", "en", "v1", 1, 99)]))
    assert totals() == {("s", "en", "v1"): (2, 10), (None, None, "v1"): (1, 3)}
    rollup.compact()
    rollup.commit("b2", signed([("s", "en", "v1", -1, 5), ("s", "en", "v1", 1, 7), (None, None, "v1", -1, 3)]))
    rollup.commit("b3", signed([]))
    assert not rollup.commit("b1", signed([("s", "en", "v1", 1, 99)])) and totals() == {("s", "en", "v1"): (2, 12)}
    rollup.compact()
    rollup.compact()
    assert totals() == {("s", "en", "v1"): (2, 12)} and not rollup.commit("b2", signed([]))
    with pytest.raises(ValueError):
        rollup.commit("../x", signed([]))


def test_counts_by_document(spark, docs, rows):
    """The totals equal those of the documents counted one by one, after adds, removals, revisions and repeats."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    kept = counts.Counted(spark)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    assert kept.add("a", counts.counted(docs, "words-1")) and kept.add("b", counts.counted(docs, "bpe", path)) and not kept.add("a", counts.counted(docs, "words-1"))
    kept.rollup.compact()
    assert kept.remove("c", ids(3, 15, 15, 999)) and not kept.remove("c", ids(4))
    revised = docs.where("doc_id IN (17, 18)").withColumn("text", F.concat(F.lit("one two <|endoftext|> "), "text"))
    kept.revise("d", counts.counted(revised, "bpe", path))
    kept.revise("d", counts.counted(revised, "bpe", path))
    kept.remove("e", ids())
    want = collections.Counter()
    for i, t, lang, source, _ in rows:
        if i not in (3, 15):
            want[source, lang, "words-1"] += np.array([1, len((t or "").encode().split())])
            want[source, lang, "bpe"] += np.array([1, len(tokenizer.encode(("one two <|endoftext|> " if i in (17, 18) else "") + (t or ""), add_special_tokens=False).ids)])
    assert {tuple(r)[:3]: tuple(r)[3:] for r in kept.totals().collect()} == {k: tuple(v) for k, v in want.items()}
    empty = counts.Counted(spark)
    assert empty.totals().collect() == empty.documents().collect() == [] and empty.remove("x", ids(1)) and empty.totals().collect() == []


def lines_by_force(rows, least, copies):
    key = lambda x: lowered(x.strip(SPACES))
    held = collections.defaultdict(list)
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            if len(k) >= least:
                held[k].append(-1 if r[0] is None else r[0])
    last = {k: max(v) for k, v in held.items() if len(v) >= copies}
    return lambda i, t: [x for x in t.split("\n") if last.get(key(x), i) == i]


@pytest.mark.parametrize("settings", [{}, {"broadcast_keys": -1}, {"most_suspects": -1}])
def test_lines(docs, rows, unique, settings):
    stay = lines_by_force(rows, 40, 5)
    got = by_id(linededup.drop_repeated(docs, carry=("lang", "source"), **settings), unique)
    assert any(r["n_dropped"] for r in got.values())
    for i, t in unique.items():
        kept = stay(i, t)
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_text"]) == (t.count("\n") + 1, t.count("\n") + 1 - len(kept), "\n".join(kept))


def test_full_filters(spark):
    """Filters far too small let more through, never less."""
    rows = [(i, "\n".join(f"a line of its own, {i} {k}, long enough to count as a key" for k in range(50)) + ("\na line that a few have, which must be suspected" if i % 40 == 3 else "")) for i in range(200)]
    docs = common.id_and_text(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    few, many = (linededup.suspected(docs, 40, 3, bits) for bits in (1 << 20, 1 << 6))
    line = int(linededup._hashes([linededup._digest(linededup.key_of(rows[3][1].split("\n")[-1].encode(), 40))]).view(np.int64)[0])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        few, many = ({r[0] for r in x.collect()} for x in (few, many))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert line in few and len(few) < 100 and few <= many and len(many) > 5000


def components_by_force(rows, size):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < size else (tuple(w[k : k + size]) for k in range(len(w) - size + 1))))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return {r[0]: (len(s), least[g] if s else r[0]) for r, s, g in zip(rows, sets, group) if r[0] is not None}


@pytest.mark.parametrize(("part", "shingles", "tile"), [(2000, 1 << 22, 4096), (2, 1 << 22, 4096), (2000, 300, 2)])
@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, rows, unique, size, part, shingles, tile, monkeypatch):
    monkeypatch.setattr(neardup, "PART", part)
    monkeypatch.setattr(neardup, "PART_SHINGLES", shingles)
    monkeypatch.setattr(neardup, "TILE", tile)
    want, got = components_by_force(rows, size), by_id(neardup.near_duplicates(docs, size), unique)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: want[i] for i in unique}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items()) and sum(r["kept"] for r in got.values()) < len(got)


@pytest.mark.parametrize("part", [2, 5, 40])
def test_one_large_group(spark, part, monkeypatch):
    """Chains whose ends are far from each other, all in one group of candidates, in parts that cut them anywhere."""
    monkeypatch.setattr(neardup, "PART", part)
    rows = [(100 * c + k, " ".join(f"{'abcd'[c]}{n}" for n in range(6 * k, 6 * k + 90))) for c, length in enumerate((30, 3, 1, 1)) for k in range(length)]
    rows = [r for r in rows if r[0] != 20]  # the long chain in two
    docs = common.id_and_text(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).withColumn("its_row", F.col("doc_id"))
    names = {neardup.set_id(neardup.shingles_of(t.encode(), 4, neardup.WordHashes())): i for i, t in rows}
    groups = spark.createDataFrame([(bytearray(n), bytearray(b"root"), 87, i) for n, i in names.items()], "node binary, root binary, n_shingles long, holder long")
    got = {names[r[0]]: names[r[1]] for r in ([bytes(x) for x in r] for r in neardup.components(neardup.verified(docs, groups, 4, 80)).collect())}
    classes = collections.defaultdict(set)
    for i, _ in rows:
        classes[got.get(i, i)].add(i)
    want = collections.defaultdict(set)
    for i, (_, c) in components_by_force(rows, 4).items():
        want[c].add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values())) and len(want) == 5


@pytest.mark.parametrize("tile", [4096, 3])
def test_candidates_in_a_crowd(spark, tile, monkeypatch):
    """Two alike nodes with others between them, which are unlike, in each sorted order."""
    monkeypatch.setattr(neardup, "TILE", tile, raising=False)
    rng = np.random.default_rng(5)
    first = rng.integers(1 << 20, 1 << 31, 64)
    second, crowd = first.copy(), []
    second[3::4] += 1 << 20
    for tree in range(16):
        for k in range(12):
            other = rng.integers(1 << 20, 1 << 31, 64)
            other[4 * tree : 4 * tree + 4] = first[4 * tree : 4 * tree + 4] + [0, 0, 0, 1000 + k]
            crowd.append(other)
    rows = [(bytearray(b"%03d" % k), bytearray(s.astype(">u4").tobytes())) for k, s in enumerate([first, second, *crowd])]
    nodes = spark.createDataFrame(rows, "node binary, signature binary").repartition(3)
    assert {tuple(sorted(bytes(x) for x in r)) for r in neardup.candidates(nodes, 0.8).collect()} == {(b"000", b"001")}


@pytest.mark.parametrize("most_share", [512, 1])
@pytest.mark.parametrize("common", [0.5, 0.68, 0.8, 0.86])
def test_pages_of_one_template(spark, common, most_share, monkeypatch):
    """Pages that share most of their words, pairs of them at 0.8 and around it: every link, by prefixes of the sets and by parts of a crowd."""
    monkeypatch.setattr(neardup, "PART", 16)
    monkeypatch.setattr(neardup, "FEW_PARTS", 0)
    monkeypatch.setattr(neardup, "MOST_SHARE", most_share)
    rng, n = random.Random(4), 150
    shared = [f"t{k}" for k in range(int(100 * common))]
    texts = [" ".join(shared + [f"u{rng.getrandbits(40)}" for _ in range(100 - len(shared))]) for _ in range(n)]
    for k in range(40):
        w = texts[rng.randrange(n)].split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(4, len(w) - 4)] = f"x{rng.getrandbits(40)}"
        texts.append(" ".join(w[: len(w) - rng.randint(0, 6)]))
    rows = [(i, t) for i, t in enumerate(texts)]
    hashes = neardup.WordHashes()
    sets = [neardup.shingles_of(t.encode(), 4, hashes) for t in texts]
    names = {neardup.set_id(x): i for i, x in enumerate(sets)}
    groups = spark.createDataFrame([(neardup.set_id(x), b"g", len(x), i) for i, x in enumerate(sets)], "node binary, root binary, n_shingles long, holder long")
    docs = spark.createDataFrame([(i, t.encode()) for i, t in rows], "its_row long, text binary")
    links = neardup.verified(docs, groups, 4, 80)
    got = {names[bytes(r[0])]: names[bytes(r[1])] for r in neardup.components(links).collect()}
    want = components_by_force(rows, 4)
    classes = lambda of: sorted(sorted(i for i in range(len(rows)) if of(i) == c) for c in {of(i) for i in range(len(rows))})
    assert classes(lambda i: got.get(i, i)) == classes(lambda i: want[i][1])



def test_components_of_a_chain(spark):
    names = [bytes([k]) for k in range(40)]
    order = names[::2] + names[1::2]
    links = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in zip(order, order[1:])] + [(bytearray(b"x"), bytearray(b"y"))], "a binary, b binary")
    got = {bytes(r[0]): bytes(r[1]) for r in neardup.components(links).collect()}
    assert got == {n: names[0] for n in names} | {b"x": b"x", b"y": b"x"}


def test_media(docs, unique):
    got = by_id(media.read_back(media.headers(media.store(docs, shard_bytes=4096))), unique)
    for i, t in unique.items():
        payload = media.padded(t.encode())
        assert len(payload) % 576 == 0 and len(payload) - len(t.encode()) <= 576 and got[i]["payload_bytes"] == len(payload)
        picture = media.to_png(payload)
        assert media.from_png(picture) == payload and got[i]["media_sha256"] == sha(picture) and got[i]["media_bytes"] == len(picture)
        assert (got[i]["n_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(t.encode()), sha(payload), zlib.crc32(payload[-32:]))
        bins = collections.Counter(x // 32 for x in payload)
        assert got[i]["feature"] == f"576x{len(payload) // 576} mean={sum(payload) // len(payload)} min={min(payload)} max={max(payload)} hist={'/'.join(str(bins[k]) for k in range(8))}"


def test_one_address_for_a_content(spark, tmp_path):
    """Contents of several tasks have one address; the pictures and the shards are read by other readers."""
    import io
    import tarfile

    texts = [f"text {k % 7}" for k in range(60)] + ["x" * 3000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    stored = media.store(docs, f"file://{tmp_path}/media", shard_bytes=2000)
    places = {r["digest"]: (r["shard"], r["offset"]) for r in stored.collect()}
    assert len(places) == 9 == stored.select("digest", "shard", "offset").distinct().count()
    for r in stored.collect():
        with tarfile.open(r["shard"].removeprefix("file://")) as t:
            member = next(m for m in t.getmembers() if m.offset_data == r["offset"])
            data = t.extractfile(member).read()
        assert member.name == f"{r['digest']}.png" and len(data) == r["length"] and sha(data) == r["digest"]
        payload = media.padded((texts[r["doc_id"]] or "").encode())
        at, samples = 8, b""  # a PNG reader of its own: chunks with their checks, then lines without filters
        assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
        while at < len(data):
            n, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
            body = data[at + 8 : at + 8 + n]
            assert int.from_bytes(data[at + 8 + n : at + 12 + n]) == zlib.crc32(kind + body)
            if kind == b"IHDR":
                width, height, depth, color = int.from_bytes(body[:4]), int.from_bytes(body[4:8]), body[8], body[9]
            samples += body if kind == b"IDAT" else b""
            at += 12 + n
        lines = io.BytesIO(zlib.decompress(samples))
        assert (width, depth, color, kind) == (576, 8, 0, b"IEND")
        assert b"".join(line[1:] for line in (lines.read(width + 1) for _ in range(height)) if line[0] == 0) == payload and not lines.read()
    assert [media.arrow_name(x) for x in ("s3a://bucket/key", "/a/b", "file:///a")] == ["s3://bucket/key", "/a/b", "file:///a"]


def targets_by_force(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = left / (sum(weight[s] for s in names if s not in capped) or 1)
        target = {s: 3 * sizes[s] if s in capped else share * weight[s] for s in names}
        above = {s for s in names if target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


def test_mixing(docs, rows):
    size = lambda t: len((t or "").encode().split())
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    target, got = targets_by_force(sizes), mixing.taken(docs, block=16).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken(docs.repartition(7), block=16).collect()), key=str)
    source = {r[0]: r[3] for r in rows if r[0] is not None}
    taken = collections.Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        if r["doc_id"] is not None:
            s = source[r["doc_id"]]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        else:
            s = None
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 17 for s in sizes)


def test_counts_by_shard(docs):
    """The table of counts adds up to the sources' slots, slots fill it exactly, and counts scatter as a multinomial draw does."""
    sizes = docs.sparkSession.createDataFrame([("a", 40_000), ("b", 7_000), (None, 900)], "source string, size long")
    found = mixing.targets(sizes)
    counted = mixing.shard_counts(found, block=16, shard_slots=300)
    slots = mixing.slots(counted, block=16).collect()
    want = {(r["source_no"], r["shard"]): r["n_slots"] for r in counted.collect()}
    assert collections.Counter((r["source_no"], r["shard"]) for r in slots) == want and len({s for _, s in want}) > 5
    target = {r["source_no"]: r["target"] for r in found.collect()}
    words = collections.Counter()
    for r in slots:
        words[r["source_no"]] += r["words"]
    assert all(abs(words[k] - t) < 17 + 3 * 16 for k, t in target.items()) and len({(r["source_no"], r["slot"]) for r in slots}) == len(slots)
    n = np.array([c for (no, _), c in want.items() if no == 1])
    assert abs(n - n.mean()).max() < 6 * np.sqrt(n.mean()) and n.std() > 0.3 * np.sqrt(n.mean())
    shards = mixing.taken(docs, block=16, shard_slots=20).select("taken", "size", "n_shards").collect()
    assert all((r["n_shards"] > 0) == (r["taken"] > 0) for r in shards) and max(r["n_shards"] for r in shards) > 3


def test_permutation(spark):
    for n in (1, 2, 3, 17, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k"))).collect()]
        assert sorted(got) == list(range(n)) and (n < 17 or got != list(range(n)))


def test_capped_targets(spark):
    sizes = {"a": 1, "b": 0, "c": 1000, "d": 7, None: 50}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == pytest.approx(targets_by_force(sizes))


@pytest.mark.parametrize(("block_bytes", "window", "least"), [(1 << 12, 13, 7), (12 << 20, 13, 7), (1 << 14, 30, 7), (1 << 14, 13, 1), (1 << 14, 1, 7)])
def test_windows(docs, rows, unique, block_bytes, window, least, monkeypatch):
    monkeypatch.setattr(repeats.framed, "__defaults__", (block_bytes,))
    monkeypatch.setattr(substrings, "LEAST", least)
    first, words = {}, [(float("inf") if r[0] is None else r[0], (r[1] or "").encode().split()) for r in rows]
    for i, w in words:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, i), i)
    got = by_id(substrings.keep_first(docs, window), unique)
    for i, t in unique.items():
        w = t.encode().split()
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < i for q in range(p, p + window)}
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"].encode()) == (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone))
    assert any(r["n_removed"] for r in got.values())


def test_levels():
    assert [substrings.levels_of(n) for n in (1, 2, 12, 13, 14, 50, 100)] == [[1], [1], [6], [7], [7], [7, 13, 25], [7, 13, 25, 50]]


def test_nothing_repeats(spark):
    """No candidate survives the first level: all texts come back whole."""
    texts = spark.createDataFrame([(i, " ".join(f"{i}w{k}" for k in range(300))) for i in range(6)], "doc_id long, text string").repartition(3)
    assert all(r["n_removed"] == 0 and len(r["kept_text"].split()) == 300 for r in substrings.keep_first(texts).collect())
    assert all(r["n_removed"] == 0 and r["n_bytes"] == len(r["kept"]) for r in suffixes.remove_repeated(texts).collect())


def test_very_long_texts(spark):
    """Texts of 3 MB, longer than any block or window inside, twice with one word changed and once by itself."""
    rng = np.random.default_rng(9)
    words = [f"{x:x}" for x in rng.integers(1 << 24, 1 << 32, 330_000)]
    long, other = " ".join(words), " ".join(f"{x:x}" for x in rng.integers(1 << 24, 1 << 32, 330_000))
    changed = " ".join([*words[:200_000], "changed", *words[200_001:]])
    texts = [long, changed, other, "x" * 5000, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in suffixes.remove_repeated(docs).collect()}
    at = len(" ".join(words[:200_000])) + 1
    for i, (t, word) in enumerate(((long, words[200_000]), (changed, "changed"))):
        assert bytes(got[i]["kept"]).decode() == word and got[i]["n_removed"] == len(t) - len(word) and got[i]["n_spans"] == 2 and t[at : at + len(word)] == word
    assert got[2]["n_removed"] == 0 == got[4]["n_removed"] and got[3]["n_removed"] == 5000
    classes = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in neardup.near_duplicates(docs).collect()}
    assert classes == {0: (0, 329_996), 1: (0, 329_996), 2: (2, 329_996), 3: (3, 1), 4: (4, 0)}
    gone = {r["doc_id"]: r["n_removed"] for r in substrings.keep_first(docs).collect()}
    assert gone == {0: 0, 1: 329_999, 2: 0, 3: 0, 4: 0}
    line = linededup.drop_repeated(docs, copies=2).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], len(r["kept_text"])) for r in line} == {i: (1, 0, len(t)) for i, t in enumerate(texts)}
    assert linededup.key_of((b" " * 100_000) + b"A" * 100_000, 40) == b"a" * 100_000 and linededup.key_of("é".encode() * 39, 40) is None
    payload = {r["doc_id"]: r["payload_sha256"] for r in media.read_back(media.headers(media.store(docs, shard_bytes=1 << 20))).collect()}
    assert payload == {i: sha(media.padded(t.encode())) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("block_bytes", "sorted_bytes", "crowded"), [(1 << 12, 1 << 21, 1 << 14), (8 << 20, 1 << 21, 1 << 14), (8 << 20, 600, 1 << 14), (1 << 12, 1 << 21, 2), (1 << 12, 1 << 21, 6), (8 << 20, 1 << 21, 2)])
@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_suffixes(docs, rows, unique, block_bytes, sorted_bytes, crowded, chunk, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(repeats.framed, "__defaults__", (block_bytes,))
    monkeypatch.setattr(suffixes, "SORTED", sorted_bytes)
    monkeypatch.setattr(suffixes, "CROWDED", crowded)
    seen = collections.Counter(b[p : p + 400] for b in ((r[1] or "").encode() for r in rows) for p in range(len(b) - 399))
    got = by_id(suffixes.remove_repeated(docs), unique)
    for i, t in unique.items():
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) > 0).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes())
    assert any(r["n_removed"] for r in got.values())


@pytest.mark.parametrize(("n", "letters"), [(0, 1), (1, 1), (60, 1), (500, 2), (3000, 4), (3000, 256)])
def test_suffix_array(n, letters):
    text = np.random.default_rng(n).integers(256 - letters, 256, n).astype(np.uint8)
    raw = text.tobytes()
    order = sorted(range(n), key=lambda i: raw[i:])
    assert suffixes.suffix_array(text, n + 8).tolist() == order
    for share in (0.02, 0.3):
        needed = np.random.default_rng(1).random(n) < share
        some = suffixes.suffix_array(text, n + 8, needed)
        assert some[needed[some]].tolist() == [i for i in order if needed[i]]


def test_pipeline(spark, docs, rows):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    at = docs.select(*columns)
    results = []
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, "").cache()
        results.append(at.collect())
    known, deduped, kept, mixed, encoded = results
    assert all(stage[0].asDict().keys() == set(columns) for stage in results[:4])
    assert sorted(str(r["doc_id"]) for r in known) == sorted(str(r[0]) for r in rows if any(c.isalpha() for c in r[1] or ""))
    stay = lines_by_force([tuple(r) for r in known], 40, 5)
    assert {(r["doc_id"], r["text"]) for r in deduped} == {(r["doc_id"], "\n".join(stay(-1 if r["doc_id"] is None else r["doc_id"], r["text"]))) for r in known}
    assert all(r["n_chars"] == len(r["text"]) for r in deduped)
    want = components_by_force([tuple(r) for r in deduped], 5)
    assert {r["doc_id"] for r in kept} - {None} == {i for i, (_, c) in want.items() if i == c}
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in kept} and max(collections.Counter(r["doc_id"] for r in mixed if r["doc_id"] is not None).values()) <= 6
    assert sorted(str(r["doc_id"]) for r in encoded) == sorted(str(r["doc_id"]) for r in mixed)
    texts = collections.defaultdict(set)
    for r in mixed:
        texts[r["doc_id"]].add(sha(r["text"]))
    assert all(r["decoded_sha256"] in texts[r["doc_id"]] and len(r["ids"]) == r["n_tokens"] for r in encoded)


def test_stages_keep_other_columns(spark, docs, no_docs, rows):
    """Columns of any name, those used inside included, pass all stages but the last; empty tables stay empty; null ids stay."""
    import corpus_pipeline

    odd = "its_id times rate its_row doc its_key nth key stays row_taken its_node root lang_pred score hash".split()
    at, none = docs, no_docs
    for k, c in enumerate([*odd, "a.b", "back`tick"]):
        at = at.withColumn(c, F.concat(F.lit(f"{k} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))) if c not in docs.columns else at
        none = none.withColumn(c, F.lit("x")) if c not in no_docs.columns else none
    names, quoted = at.columns, lambda c: "`" + c.replace("`", "``") + "`"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at, none = stage(spark, at, "").cache(), stage(spark, none, "").cache()
        found = at.collect()
        assert at.columns == names and none.collect() == [] and found
        for k, c in enumerate([*odd, "a.b", "back`tick"]):
            if c not in docs.columns:
                assert all(r[c] == f"{k} {'none' if r['doc_id'] is None else r['doc_id']}" for r in found), c
        assert name not in ("language ID", "line dedup") or any(r["doc_id"] is None for r in found)  # later a row with an id stands for it
    assert corpus_pipeline.STAGES[-1][1](spark, none, "").collect() == [] and corpus_pipeline.STAGES[-1][1](spark, at, "").count() == at.count()
    known = corpus_pipeline.language(spark, docs.where("doc_id IS NOT NULL"), "").collect()
    langs = {r[0]: r[2] for r in rows if r[0] is not None}
    assert all(r["lang"] in ("en", "fr") and langs[r["doc_id"]] in (None, r["lang"]) for r in known)


def test_run_cleans_up(spark, docs, tmp_path):
    """The whole pipeline from a file; of its stages' tables only the last one's input and blocks stay."""
    import glob

    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    top = common.shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{top}/*"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 20
    left = {p.rpartition("/")[2].rpartition("-")[0] for p in set(glob.glob(f"{top}/*")) - before}
    assert left == {"mixing", "bpe_blocks"}


def test_near_copies_without_ids(spark):
    import corpus_pipeline

    text = " ".join(f"w{k}" for k in range(100))
    rows = [(None, text), (None, text + " more"), (3, text), (3, text), (9, text + " other"), (None, "one two three four five six"), (None, "one two three four five six"), (4, "7"), (None, ""), (None, "")]
    out = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [(3, text), (None, "one two three four five six"), (4, "7"), (None, ""), (None, "")]))


def test_mix_of_few_long_documents(spark):
    """Each source has three documents; its words stay within the longest of its target."""
    import corpus_pipeline

    rows = [(None if k == 40 else 7 if k in (3, 4) else k, f"{k} " * (280 + k % 3 * 20), f"s{k // 3:02}") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got, longest = collections.Counter(), 320
    for r in corpus_pipeline.mix(spark, docs, "").collect():
        got[r["source"]] += len(r["text"].split())
    sizes = spark.createDataFrame([(s, len(t.split())) for _, t, s in rows], "source string, size long")
    targets = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert len(targets) == 30 and all(abs(got[s] - t) <= longest + 1 for s, t in targets.items())
