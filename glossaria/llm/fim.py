"""Fill-in-middle transformation: a text as prefix, suffix and middle, in the order that a model is to write them.

The tokenizers library's Split pre-tokenizer, each match isolated, gives the code-point offsets of a
text's units without any training: white space with the word after it, or white space at the end.  The
length of the offsets is n; two draws by hash rank two of the n + 1 places between units, and the offsets
there cut the text.  Sentinels mark the pieces; a text that holds one, and the share that isn't drawn,
stays plain, so that every output can be undone without its document (restored).

Long texts go through the splitter in windows that end between a word and white space, where a unit
always ends, so a task holds the offsets of one window at a time and of a text only two of them.  Null
and empty texts are plain and empty, with n = 0.  Rows that repeat are transformed alike; a null id is
drawn as an empty one.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from glossaria.llm.common import blocks, id_and_text

# A unit, and what marks prefix, suffix and middle.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SENTINELS = ("<P>", "<S>", "<M>")
WINDOW, BLOCK_BYTES = 1 << 18, 4 << 20
_SEAM = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def windows(text: str, size: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches of the text of about `size` code points, each ending where a unit ends."""
    out, at = [], 0
    while len(text) - at > size:
        seam = _SEAM.search(text, at + size)
        if not seam:
            break
        out.append((at, seam.start()))
        at = seam.start()
    return [*out, (at, len(text))] if at < len(text) else out


def cut_at(text: str, draws: tuple[int, int], splitter: Split, size: int = WINDOW) -> tuple[int, int, int]:
    """(n, a, b): the number of units, and the code points before the smaller and the larger of the places drawn % (n + 1)."""
    stretches = windows(text, size)
    found = [splitter.pre_tokenize_str(text[at:end]) if len(stretches) < 2 else None for at, end in stretches]  # of a long text only the numbers stay
    counts = [len(f or splitter.pre_tokenize_str(text[at:end])) for f, (at, end) in zip(found, stretches)]
    n, cuts = sum(counts), []
    for place in sorted(d % (n + 1) for d in draws):
        cuts.append(len(text))
        for f, (at, end), k in zip(found, stretches, counts):
            if place < k:
                cuts[-1] = at + (f or splitter.pre_tokenize_str(text[at:end]))[place][1][0]
                break
            place -= k
    return n, cuts[0], cuts[1]


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[8 * k : 8 * k + 8], 16) for k in range(4))


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, sentinels: tuple[str, str, str] = SENTINELS, window: int = WINDOW) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of docs(doc_id, text).

    form is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle): of all texts `rate` in a
    hundred are cut, and of those `spm_rate` in a hundred are spm.  The pieces' code points are null if plain.
    """
    p, s, m = sentinels

    def run(batches):
        splitter = Split(Regex(UNIT), "isolated")
        for ids, texts in blocks(batches, BLOCK_BYTES):
            rows = []
            for i, raw in zip(ids, texts):
                text = raw.decode("utf-8", "replace")
                h1, h2, h3, h4 = draws(seed, i)
                n, a, b = cut_at(text, (h1, h2), splitter, window)
                if not text or h3 % 100 >= rate or any(x in text for x in sentinels):
                    rows.append((i, n, "plain", None, None, text))
                elif h4 % 100 < spm_rate:
                    rows.append((i, n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"))
                else:
                    rows.append((i, n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"))
            kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return id_and_text(docs).mapInArrow(run, _SCHEMA)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of transform was made from."""
    parts = F.split(output, "|".join(re.escape(x) for x in sentinels), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digests(docs: DataFrame, seed: int = 42) -> DataFrame:
    """transform's columns with the output, and the text rebuilt from it, as SHA-256."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = transform(docs, seed)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
