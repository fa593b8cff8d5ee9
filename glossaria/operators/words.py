"""Word lists: extracting, merging, counting and marking them.

A word list is (lemma STRING, flags INT); bit 0 of flags says the word was delivered to word book 1,
bits 1 to 3 are reserved, 0 is pending everywhere.  Merging is a bitwise OR, so it may be repeated,
reordered and retried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria.functions.lemma import candidates, lemma
from glossaria.functions.text import CANDIDATE, CAPITAL, NEVER_NAMES, PLACED, bare, is_word, normalize, placed, token_of, trim_all
from glossaria.shared import frozen

PUSHED_FLAG = 1 << 0
ENTRY = "lemma string, flags int"


#: Tables up to this size are spread over all cores before their text is cut; larger ones have enough partitions.
SMALL_BYTES = 1 << 30


def spread(docs: DataFrame) -> DataFrame:
    """A small table, often one file and one task, dealt out anew; others as they are."""
    few = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(few) if _size(docs) <= SMALL_BYTES else docs


def _size(docs: DataFrame) -> int:
    """Spark's own estimate of the bytes of a table; there is no public call for it."""
    return int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def word_tokens(docs: DataFrame, *ids: str, text: str = "text", exclude_proper_nouns: bool = True, proper_nouns: DataFrame | None = None) -> DataFrame:
    """(*ids, pos, token): the accepted tokens.  Capitalised tokens go if they are in proper_nouns(lower_name), by default those that the documents' own case tells."""
    found = _candidates(docs, text, CANDIDATE, *ids).select(*ids, "pos", token_of(F.col("found")).alias("token")).where(is_word(F.col("token")))
    return _without_names(found, _names_for(docs, text, proper_nouns)) if exclude_proper_nouns else found


def _candidates(docs: DataFrame, text: str, pattern: str, *ids: str) -> DataFrame:
    """(*ids, pos, found): what the pattern finds in each text."""
    return spread(docs.select(*ids, text)).select(*ids, F.posexplode(F.regexp_extract_all(normalize(F.col(text)), F.lit(pattern), F.lit(0))).alias("pos", "found"))


#: Names up to this number are copied to all tasks; more of them are joined by a shuffle.
BROADCAST_NAMES = 400_000


def _names_for(docs: DataFrame, text: str, given: DataFrame | None) -> DataFrame:
    """(its_name), written once, so that its size is known before the words are looked at."""
    names = names_by_case(docs, text) if given is None else given
    names = frozen(names.select(F.col("lower_name").alias("its_name")).where("its_name IS NOT NULL").distinct(), "names")
    return F.broadcast(names) if names.count() <= BROADCAST_NAMES else names


def _without_names(found: DataFrame, names: DataFrame) -> DataFrame:
    token = F.col("token")
    return found.join(names, (F.lower(token) == F.col("its_name")) & token.rlike("^[A-Z]"), "left_anti")


def _placed_tokens(docs: DataFrame, text: str) -> DataFrame:
    """(token, mid, pos, n): the accepted tokens with their first place and their number, by whether a capital letter would tell a name there (see text.placed)."""
    found = spread(docs.select(text)).select(F.regexp_extract_all(normalize(F.col(text)), F.lit(PLACED), F.lit(0)).alias("found"))
    cut = found.select(F.posexplode(placed(F.col("found"))).alias("pos", "at")).select(bare(F.col("at.found")).alias("token"), "at.mid", "pos")
    return cut.groupBy("token", "mid").agg(F.min("pos").alias("pos"), F.count("*").alias("n")).where(is_word(F.col("token")))


#: A name is capitalised in this share of the places where case tells something, and there so many times at least.
NAME_SHARE, NAME_LEAST = 0.75, 1


def _capital(token: str) -> Column:
    return F.col(token).rlike(CAPITAL) & ~F.lower(token).isin(*NEVER_NAMES)


def _told_by_case(capitals: Column, places: Column, share: float, least: int) -> Column:
    return (capitals >= least) & (capitals >= share * places)


def case_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(lower_name, n_capital, n_places): how often a spelling stands where a capital letter would tell a name, and how often it has one there."""
    at = _placed_tokens(docs, text).where("mid")
    return at.groupBy(F.lower("token").alias("lower_name")).agg(F.sum(F.when(_capital("token"), F.col("n")).otherwise(0)).alias("n_capital"), F.sum("n").alias("n_places"))


def names_by_case(docs: DataFrame, text: str = "text", share: float = NAME_SHARE, least: int = NAME_LEAST) -> DataFrame:
    """(lower_name, n_capital, n_places): the proper nouns of documents, told by how they are spelt within sentences.  A word seen only where sentences begin is none."""
    return case_counts(docs, text).where(_told_by_case(F.col("n_capital"), F.col("n_places"), share, least))


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each spelling occurs, in lower case."""
    return word_tokens(docs, text=text, exclude_proper_nouns=False).groupBy(F.lower("token").alias("word")).agg(F.count("*").alias("n"))


def base_forms(spellings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, lemma) for the distinct words of spellings(word): of what a word may be a form of, what vocabulary(word, n) has most often, the rules' own choice counting several times.

    If none of them is in the vocabulary, the rules' choice stays.
    """
    one = spellings.select(F.lower("word").alias("word")).distinct().select("word", F.posexplode(candidates(F.col("word"))).alias("nth", "may_be")).select("word", "nth", "may_be.base", "may_be.weight")
    known = vocabulary.groupBy(F.lower("word").alias("its_word")).agg(F.sum("n").alias("n"))
    rated = one.join(known, F.col("base") == F.col("its_word"), "left").withColumn("score", F.coalesce(F.col("n") * F.col("weight"), F.lit(0.0)))
    return rated.groupBy("word").agg(F.max_by("base", F.struct("score", -F.col("nth"))).alias("lemma"))


def spellings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(spelling, pos): the distinct words of documents in lower case, with the first place of any; names, told by case, are left out.  The text is read once, for the names and for the words."""
    capital, n = F.col("token").rlike("^[A-Z]"), F.col("n")
    seen = _placed_tokens(docs, text).groupBy(F.lower("token").alias("spelling"))
    told = F.when(F.col("mid") & _capital("token"), n).otherwise(0)
    found = seen.agg(F.min("pos").alias("any"), F.min(F.when(~capital, F.col("pos"))).alias("plain"), F.sum(told).alias("n"), F.sum(F.when(F.col("mid"), n).otherwise(0)).alias("of"))
    return found.select("spelling", F.when(_told_by_case(F.col("n"), F.col("of"), NAME_SHARE, NAME_LEAST), F.col("plain")).otherwise(F.col("any")).alias("pos")).where("pos IS NOT NULL")


def extract_entries(docs: DataFrame, *ids: str, text: str = "text", exclude_proper_nouns: bool = True, proper_nouns: DataFrame | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """(*ids, lemma, flags, first_pos): the base forms of each document, once, with the place of the first.

    With ids tokens go to their base forms where they are read, so one shuffle brings those of a
    document together; without ids each distinct spelling of the corpus is looked at once.  With a
    vocabulary(word, n) base forms are those of base_forms, found once per distinct word and joined back.
    """
    base = lemma(F.col("spelling"))
    if exclude_proper_nouns and proper_nouns is None and not ids:
        spelt = spellings(docs, text)
    else:
        found = word_tokens(docs, *ids, text=text, exclude_proper_nouns=exclude_proper_nouns, proper_nouns=proper_nouns)
        spelt = found.select(*ids, F.lower("token").alias("spelling"), "pos")
        if vocabulary is not None or not ids:
            spelt = spelt.groupBy(*ids, "spelling").agg(F.min("pos").alias("pos"))
    if vocabulary is not None:
        bases = base_forms(vocabulary, vocabulary).select(F.col("word").alias("its_word"), F.col("lemma").alias("its_lemma"))
        spelt, base = spelt.join(bases, F.col("spelling") == F.col("its_word"), "left"), F.coalesce(F.col("its_lemma"), base)
    return spelt.groupBy(*ids, base.alias("lemma")).agg(F.min("pos").cast("int").alias("first_pos")).select(*ids, "lemma", F.lit(0).alias("flags"), "first_pos")


def create_entries(words: DataFrame, word: str = "word", flags: int = 0) -> DataFrame:
    """(lemma, flags, error): trimmed and lower-cased; error says why a row can't be an entry."""
    clean = F.lower(trim_all(F.col(word)))
    return words.select(clean.alias("lemma"), F.lit(flags).alias("flags"), F.when(F.coalesce(clean, F.lit("")) == "", "lemma must not be empty").alias("error"))


def merge_entries(*lists: DataFrame) -> DataFrame:
    """One row per lower-cased lemma, flags combined by bitwise OR."""
    every = reduce(DataFrame.unionByName, (x.select("lemma", "flags") for x in lists))
    return every.groupBy(F.lower("lemma").alias("lemma")).agg(F.bit_or("flags").cast("int").alias("flags"))


def merge_in_order(*lists: DataFrame) -> DataFrame:
    """merge_entries of lists(lemma, flags, pos), with the list and place where each lemma is seen first, to sort by."""
    return merged_by_place(reduce(DataFrame.unionByName, (x.select("lemma", "flags", F.lit(k).alias("list_idx"), "pos") for k, x in enumerate(lists))))


def merged_by_place(rows: DataFrame) -> DataFrame:
    """(lemma, flags, seen) from rows(lemma, flags, list_idx, pos) of any number of lists."""
    first = F.min(F.col("list_idx").cast("long") * (1 << 40) + F.col("pos"))
    return rows.groupBy(F.lower("lemma").alias("lemma")).agg(F.bit_or("flags").cast("int").alias("flags"), first.alias("seen")).select("lemma", "flags", "seen")


def counts(entries: DataFrame) -> DataFrame:
    """(total, pending): pending are entries without any flag."""
    return entries.agg(F.count("*").alias("total"), F.count_if(F.col("flags") == 0).alias("pending"))


def pending(entries: DataFrame) -> DataFrame:
    return entries.where("flags = 0")


def pushed(entries: DataFrame, flag: int = PUSHED_FLAG) -> DataFrame:
    """Entries that were delivered; others than pending ones may be, too."""
    return entries.where(F.col("flags").bitwiseAND(F.lit(flag)) != 0)


def mark_pushed(entries: DataFrame, lemmas: DataFrame, flag: int = PUSHED_FLAG) -> DataFrame:
    """entries with the flag set on those in lemmas(lemma), in any case; unknown lemmas change nothing."""
    hits = lemmas.select(F.lower("lemma").alias("hit")).distinct()
    joined = entries.join(hits, F.col("lemma") == F.col("hit"), "left")
    set_: Column = F.when(F.col("hit").isNotNull(), F.col("flags").bitwiseOR(F.lit(flag))).otherwise(F.col("flags"))
    return joined.select("lemma", set_.cast("int").alias("flags"))
