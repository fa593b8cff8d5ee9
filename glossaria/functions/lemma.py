"""Base forms: a table of irregular forms, then suffix rules.  Deterministic and lexicon-free.

The rules are published ones (Porter's vowel and double-consonant conditions, WordNet's noun
endings) with a short list of words they would damage; they don't claim to equal an NLP library.
Each rule gives a Column here and the same rule as SQL text, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Irregular forms and their base.
IRREGULAR = {
    "am": "be", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be",
    "has": "have", "had": "have", "does": "do", "did": "do", "done": "do",
    "go": "go", "goes": "go", "went": "go", "gone": "go", "came": "come", "come": "come",
    "took": "take", "taken": "take", "gave": "give", "given": "give", "got": "get", "gotten": "get",
    "saw": "see", "seen": "see", "said": "say", "told": "tell", "knew": "know", "known": "know", "thought": "think",
    "made": "make", "found": "find", "felt": "feel", "left": "leave", "kept": "keep", "held": "hold",
    "brought": "bring", "began": "begin", "begun": "begin", "built": "build", "broke": "break", "broken": "break",
    "chose": "choose", "chosen": "choose", "drove": "drive", "driven": "drive",
    "ate": "eat", "eaten": "eat", "wrote": "write", "written": "write", "spoke": "speak", "spoken": "speak",
    "woke": "wake", "worn": "wear", "wore": "wear",
    "ran": "run", "sat": "sit", "stood": "stand", "lost": "lose", "met": "meet", "won": "win",
    "sang": "sing", "sung": "sing", "swam": "swim", "swum": "swim", "slept": "sleep",
    "caught": "catch", "bought": "buy", "taught": "teach", "forgot": "forget", "forgotten": "forget",
    "hid": "hide", "hidden": "hide", "paid": "pay", "sent": "send", "spent": "spend", "sold": "sell",
    "grew": "grow", "grown": "grow", "flew": "fly", "flown": "fly", "fell": "fall", "fallen": "fall",
    "drank": "drink", "drunk": "drink", "blew": "blow", "blown": "blow", "threw": "throw", "thrown": "throw",
    "drew": "draw", "drawn": "draw", "bore": "bear", "born": "bear",
}
#: Our own: forms that the rules below would not bring back.
OTHER_FORMS = {
    "knives": "knife", "lives": "life", "wives": "wife", "halves": "half", "wolves": "wolf", "shelves": "shelf", "thieves": "thief",
    "loaves": "loaf", "calves": "calf", "leaves": "leaf", "selves": "self", "elves": "elf", "scarves": "scarf",
    "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose",
    "using": "use", "used": "use", "shoes": "shoe", "agreed": "agree", "freed": "free", "dying": "die", "lying": "lie", "tying": "tie",
    "changing": "change", "changed": "change", "arranging": "arrange", "arranged": "arrange",
    "quizzes": "quiz", "quizzed": "quiz", "quizzing": "quiz", "murmured": "murmur", "murmuring": "murmur", "focused": "focus", "focusing": "focus",
}
KEEP = (
    "this his its thus news always perhaps yes us as gas bus plus lens series species morning evening nothing something anything "
    "everything during ceiling wedding indeed proceed exceed succeed hundred sacred naked hatred kindred"
).split()
TABLE = {**OTHER_FORMS, **IRREGULAR}

#: (pattern, least length, letters to cut, letters to add, whether the stem is repaired); the first that matches holds.
RULES = (
    (r"(ss|us|is)$", 0, 0, "", False),
    (r"ies$", 5, 3, "y", False),
    (r"ies$", 0, 1, "", False),
    (r"(sses|xes|zzes|ches|shes)$", 0, 2, "", False),
    (r"[^aeiou]oes$", 5, 2, "", False),
    (r"s$", 0, 1, "", False),
    (r"[aeiouy].*ing$", 5, 3, "", True),
    (r"ied$", 5, 3, "y", False),
    (r"ied$", 0, 1, "", False),
    (r"eed$", 0, 0, "", False),
    (r"[aeiouy].*ed$", 4, 2, "", True),
)
_DOUBLED = r"(bb|dd|gg|kk|mm|nn|pp|rr|tt|vv)$"
#: Stems that lost an e: endings that English hardly has without it, vowel pairs such as in "heat" or "rain" left out.
_MUTE_E = r"([^eo]at|creat|bl|iz|c|[^v]v|[^o]u|rs|ns|[aeiou][aeiou]s|[^i]as|[^aeiou]is|os|us|[aeioudlr]g|[^eo]ar|[^aeo][iu]r|[^aeou]in|[^aou]id|[^aeo]u[dt]|[^aeo]ad|[^aeo]um|[^eo]ak|[^o]ok)$"
#: Stems that end in two equal letters by themselves; those in -ff, -ll, -ss and -zz always do.
DOUBLE = "add ebb egg err odd purr burr whirr butt putt mutt watt inn boycott".split()
_SHORT = r"^[^aeiouy]*[aeiouy][^aeiouywx]$"


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _repaired(stem: Column) -> Column:
    mute = stem.rlike(_MUTE_E) | (stem.rlike(_SHORT) & (F.length(stem) >= 3))
    return F.when(stem.isin(*DOUBLE), stem).when(stem.rlike(_DOUBLED), _cut(stem, 1)).when(mute, F.concat(stem, F.lit("e"))).otherwise(stem)


def lemma(word: Column) -> Column:
    """The base form of a word; words with an apostrophe or hyphen are only lower-cased."""
    w = F.lower(word)
    table = F.create_map(*(F.lit(x) for pair in TABLE.items() for x in pair))
    # a hash lookup decides; the map is searched for hits only
    out = F.when(w.rlike("['-]"), w).when(w.isin(*TABLE), table[w])
    out = out.when(w.isin(*KEEP) | (F.length(w) < 4) | ~(w.endswith("s") | w.endswith("ed") | w.endswith("ing")), w)  # all rules are for these endings
    for pattern, least, cut, add, repair in RULES:
        stem = _cut(w, cut)
        out = out.when(w.rlike(pattern) & (F.length(w) >= least), _repaired(stem) if repair else F.concat(stem, F.lit(add)))
    return out.otherwise(w)


def lemma_sql(word: str) -> str:
    """The same as SQL text."""
    w = f"lower({word})"
    quoted = lambda words: ", ".join(f"'{x}'" for x in words)
    stem = lambda s, n: f"substr({s}, 1, length({s}) - {n})"
    table = f"map([{quoted(TABLE)}], [{quoted(TABLE.values())}])[{w}]"
    parts = [f"WHEN regexp_matches({w}, '[''-]') THEN {w}", f"WHEN {table} IS NOT NULL THEN {table}", f"WHEN {w} IN ({quoted(KEEP)}) OR length({w}) < 4 THEN {w}"]
    for pattern, least, cut, add, repair in RULES:
        s = stem(w, cut)
        fixed = f"CASE WHEN {s} IN ({quoted(DOUBLE)}) THEN {s} WHEN regexp_matches({s}, '{_DOUBLED}') THEN {stem(s, 1)} WHEN regexp_matches({s}, '{_MUTE_E}') OR (regexp_matches({s}, '{_SHORT}') AND length({s}) >= 3) THEN {s} || 'e' ELSE {s} END"
        parts.append(f"WHEN regexp_matches({w}, '{pattern}') AND length({w}) >= {least} THEN {fixed if repair else f"{s} || '{add}'"}")
    return f"CASE {' '.join(parts)} ELSE {w} END"


_TWICE = "(bb|cc|dd|ff|gg|kk|ll|mm|nn|pp|rr|ss|tt|vv|zz)"
#: (pattern, least length, letters to cut, letters to add, pattern of the stem that rules it out, weight): what a spelling may also be a form of.
#: What the rules give weighs most; -f and -fe only count where nothing else is a word.
LIKELY, POSSIBLE, LAST = 4.0, 1.0, 1e-9
CANDIDATES = (
    (r"[aeiouy].*ing$", 5, 3, "", _SHORT, POSSIBLE),
    (r"[aeiouy].*ing$", 5, 3, "e", r"[eoy]$", POSSIBLE),
    (rf"[aeiouy].*{_TWICE}ing$", 5, 4, "", "", POSSIBLE),
    (r"[aeiouy].*[^e]ed$", 4, 2, "", _SHORT, POSSIBLE),
    (r"[^e]ed$", 4, 1, "", "", POSSIBLE),
    (rf"[aeiouy].*{_TWICE}ed$", 4, 3, "", "", POSSIBLE),
    (r"ie[ds]$", 5, 3, "y", "", POSSIBLE),
    (r"ie[ds]$", 4, 1, "", "", POSSIBLE),
    (r"[^isu]s$", 4, 1, "", "", POSSIBLE),
    (r"(s|x|z|ch|sh|o)es$", 5, 2, "", "", POSSIBLE),
    (r"ves$", 5, 3, "f", "", LAST),
    (r"ves$", 5, 3, "fe", "", LAST),
)
#: A base has a vowel and two letters at least.
_BASE = r"^.*[aeiouy].*$"


def candidates(word: Column) -> Column:
    """An array of (base, weight): what the rules make of a word, then what else it may be a form of.  Irregular forms, short words, contractions and compounds have one."""
    w = F.lower(word)
    first = F.struct(lemma(word).alias("base"), F.lit(LIKELY).alias("weight"))
    more = []
    for pattern, least, cut, add, without, weight in CANDIDATES:
        base = F.concat(_cut(w, cut), F.lit(add))
        fits = w.rlike(pattern) & (F.length(w) >= least) & base.rlike(_BASE) & (F.length(base) >= 2)
        if without:
            fits &= ~_cut(w, cut).rlike(without)
        more.append(F.when(fits, F.struct(base.alias("base"), F.lit(weight).alias("weight"))))
    settled = w.rlike("['-]") | w.isin(*TABLE) | w.isin(*KEEP) | (F.length(w) < 4)
    return F.when(settled, F.array(first)).otherwise(F.array_compact(F.array(first, *more)))


def candidates_sql(word: str) -> str:
    """The same as SQL text: a list of structs."""
    w = f"lower({word})"
    quoted = lambda words: ", ".join(f"'{x}'" for x in words)
    first = f"{{'base': {lemma_sql(word)}, 'weight': CAST({LIKELY} AS DOUBLE)}}"
    more = []
    for pattern, least, cut, add, without, weight in CANDIDATES:
        stem = f"substr({w}, 1, length({w}) - {cut})"
        fits = f"regexp_matches({w}, '{pattern}') AND length({w}) >= {least} AND regexp_matches({stem} || '{add}', '{_BASE}') AND length({stem} || '{add}') >= 2" + (f" AND NOT regexp_matches({stem}, '{without}')" if without else "")
        more.append(f"CASE WHEN {fits} THEN {{'base': {stem} || '{add}', 'weight': CAST({weight} AS DOUBLE)}} END")
    settled = f"regexp_matches({w}, '[''-]') OR {w} IN ({quoted([*TABLE, *KEEP])}) OR length({w}) < 4"
    return f"CASE WHEN {settled} THEN [{first}] ELSE list_filter([{first}, {', '.join(more)}], lambda x: x IS NOT NULL) END"
