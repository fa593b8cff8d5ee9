"""Normalising and tokenising text, and telling English words from other tokens, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters folded before compatibility normalisation, and what they become.
FOLD_FROM = "‘’ʼ‛“”‐‑‒–—―−­"
FOLD_TO = "''''\"\"--------"
# What a candidate is, what is cut from its end, and why one is refused, in this order.
CANDIDATE = r"[A-Za-z0-9$][A-Za-z0-9$.:'@/_-]*"
TRAILING = r"[.'-]+$"
CUT = ".'-"
REFUSALS = (
    ("url", r"^([Hh][Tt][Tt][Pp][Ss]?://|[Ww][Ww][Ww]\.)"),
    ("email", r"^[^@\s]+@[^@\s]+$"),
    ("path", r"/"),
    ("snake", r"_"),
    ("camel", r"[a-z][A-Z]"),
    ("pascal", r"^[A-Z][a-z]*[A-Z]"),
    ("dollar", r"\$"),
    ("digit", r"[0-9]"),
)
WORD = r"^[A-Za-z]+(['-][A-Za-z]+)*$"


#: What NFKC may change, or what may join the character before it: signs of Latin-1, and all beyond it.
MAY_CHANGE = r"[\xA0\xA8\xAA\xAD\xAF\xB2-\xB5\xB8-\xBA\xBC-\xBEĀ-\x{10FFFF}]"
#: Characters of the basic plane that NFKC makes one other character of, such as full-width forms, and what that is.
_ONE = [(chr(c), n) for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xE000 and chr(c) not in FOLD_FROM and len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n != chr(c)]
ONE_FROM, ONE_TO = "".join(c for c, _ in _ONE), "".join(n for _, n in _ONE)


#: Bytes of text that a task holds as Python strings at once; a longer text is held alone.  Spark's own batches are of up to 10,000 texts.
PIECE_BYTES = 1 << 20


@F.arrow_udf(T.StringType())
def _nfkc(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(before, before[start] + PIECE_BYTES, "right")) - 1)
            yield pa.array([t and unicodedata.normalize("NFKC", t) for t in batch[start:stop].to_pylist()], pa.string())
            start = stop


def normalize(text: Column) -> Column:
    """Quotes and hyphens folded, then NFKC.

    Characters that become one other are replaced beside the folded ones, which doesn't change the normal
    form; the Python worker gets texts in which something else may change, and nulls for the others.
    """
    may_change = lambda t: (F.octet_length(t) > F.length(t)) & t.rlike(MAY_CHANGE)  # noqa: E731  ASCII is told by its length
    folded = F.when(may_change(text), F.translate(text, FOLD_FROM + ONE_FROM, FOLD_TO + ONE_TO)).otherwise(text)
    return F.coalesce(_nfkc(F.when(may_change(folded), folded)), folded)


def token_of(candidate: Column) -> Column:
    """A candidate without trailing punctuation.  It begins with a letter, a digit or $, so something is always left."""
    return F.rtrim(candidate, F.lit(CUT))


def tokens(text: Column) -> Column:
    """The candidates of a normalised text without trailing punctuation; null for null."""
    return F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), token_of)


def reason(token: Column) -> Column:
    """Why a token is refused, or `accept`."""
    out = F.when(token.rlike(REFUSALS[0][1]), REFUSALS[0][0])
    for name, pattern in REFUSALS[1:]:
        out = out.when(token.rlike(pattern), name)
    return out.when(~token.rlike(WORD), "shape").otherwise("accept")


#: WORD without the shapes that are refused as camel or pascal case: in each part capitals come first, in the first part one at most.
ACCEPTED = r"^(?:[A-Z][a-z]*+|[a-z]++)(?:['-](?:[A-Z]++[a-z]*+|[a-z]++))*+$"


def is_word(token: Column) -> Column:
    """Equal to reason(token) == 'accept': the other refusals need characters that WORD has no room for."""
    return token.rlike(ACCEPTED)


#: A candidate with what stands between it and the one before; only the SQL uses it.
GAPPED = r"[^A-Za-z0-9$]*" + CANDIDATE
#: In a gap, and at the end of a candidate, what a sentence, a quotation or a line may begin after.
BREAK, BREAK_BEFORE = r"^[^A-Za-z0-9$]*[.!?:;\"()\[\]\n\r|*#]", r"[.:]$"
#: A candidate, with the gap before it from the first sign on that something begins; at the end of a text, such a gap alone.
PLACED = rf"[.!?:;\"()\[\]\n\r|*#][^A-Za-z0-9$]*+(?:{CANDIDATE}|\z)|{CANDIDATE}"
BREAKS = tuple('.!?:;"()[]\n\r|*#')
CAPITAL = r"^[A-Z].*[a-z]"
#: Words that no evidence makes names: I in all its forms, and what often begins a sentence about two.
NEVER_NAMES = ("i'm", "i'll", "i'd", "i've", "he", "she", "it", "we", "you", "they", "this", "that", "these", "those", "both", "who", "his", "her", "its", "our", "your", "their", "my")


def placed(found: Column) -> Column:
    """An array of (found, mid) from the array that PLACED finds in a normalised text; mid says that a capital letter there would tell a name.

    That is so for a token that nothing begins with, and for one that does if `and` or `or` joins it to
    a capitalised token that nothing begins with.  What something begins with has its gap in front, so
    it is no bare word.
    """
    ends = lambda x: x.endswith(".") | x.endswith(":")

    def one(x: Column, i: Column) -> Column:
        before = F.get(found, i - 1)
        begins = before.isNull() | ends(before) | x.substr(1, 1).isin(*BREAKS)
        paired = F.get(found, i + 1).isin("and", "or") & F.get(found, i + 2).rlike(CAPITAL) & ~ends(x)
        return F.struct(x.alias("found"), (~begins | F.coalesce(paired, F.lit(False))).alias("mid"))

    return F.transform(found, one)


def bare(found: Column) -> Column:
    """The token of what PLACED finds; empty for a gap alone."""
    return token_of(F.when(found.substr(1, 1).isin(*BREAKS), F.regexp_replace(found, "^[^A-Za-z0-9$]+", "")).otherwise(found))


# Fixed value: the characters that trimming removes.
_BLANKS = "\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"


def trim_all(text: Column) -> Column:
    """Without Unicode white space and byte order marks at both ends."""
    return F.regexp_replace(text, f"^[{_BLANKS}]+|[{_BLANKS}]+$", "")
