"""Language identification by prediction by partial matching.

For each language a context tree of bytes, of up to `order` bytes of context, holds counts from a
bounded training sample.  The frozen trees give every byte an exact code length: in the longest
known context a symbol of count c costs -log2(c / (n + d)), and an escape to the next shorter
context -log2(d / (n + d)), n being the context's count and d its number of distinct symbols
(escape method C, without exclusions); a byte that no context knows costs 8 bits more.  Lengths are
whole numbers of 1/4096 bit, so sums don't depend on how texts are cut into batches.  The language
with the shortest code for the whole text wins, ties going to the smaller name.

Training takes up to `per_lang` documents of each language by the order of a hash of id and text, so
reruns agree, those of at most `max_bytes` bytes first and longer ones where these are too few, as long
as those before hold less than per_lang * max_bytes bytes.  The sample on the driver is bounded by that
and one more document a language; equal rows count once.  Prediction reads every whole text.

Null texts and texts without a letter are `und` with score 0, and so is everything if there is
nothing to learn from.  Rows that repeat are predicted alike; rows with a null doc_id are predicted
but never held out or learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossaria.llm.common import frozen, starts_of

UNIT = 4096.0
BROADCAST_PLACES = 200_000
_LETTER = regex.compile(r"\p{L}")


class Model:
    """Union of the languages' context trees: next_[k] leads from a k-gram and a symbol to a (k+1)-gram; 0 is none."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = 3):
        self.langs, self.order = sorted(texts), order
        joined = [t for lang in self.langs for t in texts[lang]]
        of = np.repeat(np.arange(len(self.langs)), [sum(map(len, texts[x])) for x in self.langs])
        data = np.frombuffer(b"".join(joined), np.uint8)
        first = np.zeros(len(data) + 1, bool)
        first[starts_of(list(map(len, joined)))] = True
        first = first[:-1]
        seen = np.unique(data)
        self.symbol = np.zeros(256, np.int64)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width, n_langs = len(seen) + 1, len(self.langs)
        symbol = self.symbol[data]
        grams, self.next_, shorter = [symbol], [None], [np.zeros(self.width, np.int64)]
        sizes = [self.width]
        for _ in range(order):
            before = np.concatenate(([0], grams[-1][:-1]))
            before[first] = 0
            keys, inverse = np.unique(np.where(before > 0, before * self.width + symbol, 0), return_inverse=True)
            if not len(keys) or keys[0] != 0:
                keys, inverse = np.concatenate(([0], keys)), inverse + 1
            table = np.zeros(sizes[-1] * self.width, np.int32)
            table[keys] = np.arange(len(keys))
            table[0] = 0
            down = np.zeros(len(keys), np.int64)
            down[inverse] = grams[-1]
            down[0] = 0
            self.next_.append(table)
            shorter.append(down)
            grams.append(inverse.astype(np.int64))
            sizes.append(len(keys))
        # costs, from the empty context up
        self.cost, self.escape = [], []
        lower = None
        for k in range(order + 1):
            counts = np.bincount(grams[k] * n_langs + of, minlength=sizes[k] * n_langs).reshape(-1, n_langs)
            if k:
                counts[0] = 0
            parent = np.zeros(sizes[k], np.int64)
            before = np.concatenate(([0], grams[k - 1][:-1])) if k else grams[0] * 0
            parent[grams[k]] = before
            parent[0] = 0
            n_contexts = sizes[k - 1] if k else 1
            total, kinds = np.zeros((n_contexts, n_langs)), np.zeros((n_contexts, n_langs))
            np.add.at(total, parent, counts)
            np.add.at(kinds, parent, counts > 0)
            if k:
                total[0] = kinds[0] = 0
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                hit = -np.log2(counts / (total + kinds)[parent])
            below = lower[shorter[k]] if k else np.full((sizes[0], n_langs), 8.0)
            cost = np.where(counts > 0, hit, escape[parent] + below)
            if k:
                cost[0] = 0
            lower = cost
            self.cost.append(np.rint(cost * UNIT).astype(np.int32))
            self.escape.append(np.rint(escape * UNIT).astype(np.int32))

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in 1/4096 bit: a row for each text (none empty), a column for each language."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = starts_of(list(map(len, texts)))[:-1]
        symbol = self.symbol[data]
        grams, contexts = [symbol], []
        for k in range(1, self.order + 1):
            before = np.empty_like(symbol)
            before[1:] = grams[-1][:-1]
            before[starts] = 0
            contexts.append(before)
            grams.append(self.next_[k].take(before * self.width + symbol).astype(np.int64))
        total = self.cost[self.order].take(grams[self.order], axis=0)
        at = np.flatnonzero(grams[self.order] == 0) if self.order else np.empty(0, np.int64)
        for k in range(self.order, 0, -1):
            extra = self.escape[k].take(contexts[k - 1][at], axis=0)
            gram = grams[k - 1][at]
            total[at] += extra + self.cost[k - 1].take(gram, axis=0)
            at = at[gram == 0]
        return np.add.reduceat(total.astype(np.int64), starts, axis=0)


def train(docs: DataFrame, per_lang: int = 250, max_bytes: int = 20_000, order: int = 3, held_out=None) -> Model | None:
    """A model of the documents that aren't held out; None if there are none."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") > 0))
    known = known.where(~held_out) if held_out is not None else known
    size = F.octet_length("text").cast("long")
    places = known.select("lang", (size > max_bytes).alias("long"), F.xxhash64("doc_id", "text", F.lit(17)).alias("place"), size.alias("size"))
    by_place = Window.partitionBy("lang").orderBy("long", "place")
    few = places.withColumn("nth", F.row_number().over(by_place)).where(F.col("nth") <= per_lang)  # so many of a language leave a task at most
    few = few.withColumn("before", F.coalesce(F.sum("size").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < per_lang * max_bytes)
    chosen = frozen(few.select(F.col("lang").alias("its_lang"), F.col("place").alias("its_place")).distinct(), "sample-places")
    if chosen.count() <= BROADCAST_PLACES:  # else languages without end: a join that moves the texts
        chosen = F.broadcast(chosen)
    rows = known.select("lang", F.xxhash64("doc_id", "text", F.lit(17)).alias("place"), F.col("text").cast("binary").alias("text"))
    sample = rows.join(chosen, (F.col("lang") == F.col("its_lang")) & (F.col("place") == F.col("its_place"))).select("lang", "place", "text").dropDuplicates(["lang", "place"])
    texts: dict[str, list[bytes]] = {}
    for r in sorted(sample.toLocalIterator(), key=lambda r: (r[0], r[1])):
        texts.setdefault(r[0], []).append(bytes(r[2]))
    return Model(texts, order) if texts else None


def predicted(m: Model | None, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Languages and scores of texts, a few at a time."""
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t.decode("utf-8", "replace"))] if m else []
    while known:
        part, size = [], 0
        while known and (not part or size < 1 << 20):
            part.append(known.pop())
            size += len(texts[part[-1]])
        lengths = m.lengths([texts[i] for i in part])
        best = lengths.argmin(axis=1)
        gap = (lengths - lengths.min(axis=1, keepdims=True)) / UNIT / np.array([[len(texts[i])] for i in part])
        score[part] = 1 / np.exp2(-gap).sum(axis=1)
        for i, x in zip(part, best):
            lang[i] = m.langs[x]
    return lang, score


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, held_out, text as bytes) with lang_pred and score instead of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            lang, score = predicted(shared.value, b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def recognized(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, with all columns, whose text isn't `und`; a null lang becomes the predicted one."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c.replace("`", "``")}`") for c in names)).alias("doc"))

    def run(batches):
        for b in batches:
            columns = b["doc"].flatten()
            lang, _ = predicted(shared.value, [(t.as_py() or "").encode() for t in columns[names.index("text")]])
            if "lang" in names:
                at = names.index("lang")
                columns[at] = pa.array([p if x is None else x for x, p in zip(columns[at].to_pylist(), lang)], pa.string())
            filled = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=list(b["doc"].type))], ["doc"])
            yield filled.filter(pa.array([x != "und" for x in lang], pa.bool_()))

    return whole.mapInArrow(run, whole.schema).select("doc.*")


def identify(docs: DataFrame, **training) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text, lang), learned from those not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(docs, held_out=held, **training)
    return predict(docs.select("doc_id", held.alias("held_out"), F.col("text").cast("binary").alias("text")), model)
