"""Names, slugs, tokens and numbers in strings, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.ranks import ranked

#: Latin letters with one accent and the plain ones, for places where no Python may run.
_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
WORD = r"\b[a-zA-Z]+(?:['’][a-zA-Z]+)?\b"
#: Plurals that the suffix rules get wrong.
IRREGULAR = {
    "elves": "elf", "faeries": "faerie", "werewolves": "werewolf", "dwarves": "dwarf", "wolves": "wolf", "mice": "mouse", "fungi": "fungus",
    "heroes": "hero", "pegasi": "pegasus", "leaves": "leaf", "knives": "knife", "selves": "self", "gods": "god",
}


def normalized(name: Column) -> Column:
    """Lower case without ligatures and accents; other characters than letters and digits become single spaces."""
    low = F.replace(F.replace(F.lower(name), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    return F.trim(F.regexp_replace(F.translate(low, _ACCENTED, _PLAIN), "[^a-z0-9]+", " "))


def normalized_any(name: Column) -> Column:
    """As `normalized`, over all of Unicode's compatibility decompositions (an Arrow UDF)."""
    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        strip = lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
        return s.map(strip, na_action="ignore")

    return normalized(plain(F.replace(F.replace(F.lower(name), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[',]", ""), " ", "-")


def pair_slug(*names: Column) -> Column:
    return F.array_join(F.array_sort(F.array_compact(F.array(*[slug(n) for n in names]))), "-")


def file_label(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(name, ",", 1)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def set_code(name: Column) -> Column:
    """The code in brackets at the end, null without one."""
    return F.nullif(F.regexp_extract(name, r"\(([A-Za-z0-9]+)\)\s*$", 1), F.lit(""))


def singular(word: Column) -> Column:
    out = F.when(word.rlike("ies$") & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y"))
    out = out.when(word.rlike("(ses|xes|ches|shes)$"), F.regexp_replace(word, "es$", "")).when(word.rlike("[^s]s$|^s$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    known = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    return F.coalesce(F.try_element_at(known, word), out)


def url_tail(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def split_pair(name: Column) -> Column:
    return F.split(name, " // ")


def slot_key(*ids: Column) -> Column:
    """Ids joined by '+', in the order given; nulls are left out."""
    return F.concat_ws("+", *ids)


def rules_text(text: Column, name: Column) -> Column:
    """Lower-cased, with a space for each bracketed part; the own name, whole and by face (longest first), becomes '~'."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\([^)]*\)", " ")
    low = F.lower(name)
    out = F.when(F.length(low) > 0, F.replace(out, low, F.lit("~"))).otherwise(out)
    faces = F.array_sort(F.split(low, " // "), lambda a, b: F.length(b) - F.length(a))
    out = F.aggregate(F.filter(faces, lambda f: F.length(f) > 0), out, lambda s, f: F.replace(s, f, F.lit("~")))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def repeated_words(text: Column) -> Column:
    """Words that stand twice in a row, with what is between them."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b([A-Za-z]{2,})\b[\s,.;:!?-]+\1\b"), F.lit(0))


def between(text: Column, start: str, end: str) -> Column:
    """What stands after the first `start` and before the next `end`; the whole text where one is missing."""
    tail = F.when(F.contains(text, F.lit(start)), F.expr("1")).otherwise(F.lit(0))
    after = F.when(tail == 1, F.substring(text, F.instr(text, start) + len(start), F.length(text))).otherwise(text)
    return F.when(F.contains(after, F.lit(end)), F.substring_index(after, end, 1)).otherwise(after)


def resplit(fragments: Column, known: list[str]) -> Column:
    """Greedy re-merge of names cut at ', ': the shortest run of fragments that is a known name; others stay alone."""
    names = set(known)

    def one(parts: list[str]) -> list[str]:
        out, i = [], 0
        while i < len(parts):
            width = next((w for w in range(1, len(parts) - i + 1) if ", ".join(parts[i : i + w]) in names), 1)
            out.append(", ".join(parts[i : i + width]))
            i += width
        return out

    @F.pandas_udf("array<string>")
    def merge(s: pd.Series) -> pd.Series:
        return s.map(lambda x: one(list(x)), na_action="ignore")

    return merge(fragments)


_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _porter(w: str) -> str:
    """The published suffix-stripping algorithm of 1980."""
    if len(w) < 3:
        return w
    vowel = lambda s, i: s[i] in "aeiou" or (s[i] == "y" and i > 0 and not vowel(s, i - 1))
    measure = lambda s: sum(vowel(s, i) and not vowel(s, i + 1) for i in range(len(s) - 1))
    has = lambda s: any(vowel(s, i) for i in range(len(s)))
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and not vowel(s, len(s) - 1)
    cvc = lambda s: len(s) > 2 and not vowel(s, len(s) - 3) and vowel(s, len(s) - 2) and not vowel(s, len(s) - 1) and s[-1] not in "wxy"
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, to in sorted((x.split(":") for x in table.split()), key=lambda x: -len(x[0])):
            if w.endswith(end):
                w = w[: -len(end)] + to if measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted([*_STEP4.split(), "ion"], key=lambda x: -len(x)):
        if w.endswith(end):
            stem = w[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if measure(w) > 1 and double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def stem(word: Column) -> Column:
    """Porter stems (an Arrow UDF; use it on distinct words)."""
    @F.pandas_udf("string")
    def porter(s: pd.Series) -> pd.Series:
        return s.map(lambda w: _porter(w.lower()), na_action="ignore")

    return porter(word)


def token_counts(docs: DataFrame, text: str = "text", stopwords: list[str] = ()) -> DataFrame:
    """(word, n, rank): counts of all words but the stop words, with ties by word."""
    words = docs.select(F.explode(tokens(F.col(text))).alias("word"))
    words = words.filter(~F.col("word").isin(*stopwords)) if stopwords else words
    return ranked(words.groupBy("word").agg(F.count("*").alias("n")), F.desc("n"), F.col("word")).select("word", "n", "rank")


def doc_freq(docs: DataFrame, text: str = "text", least: int = 40, longer: int = 2, stopwords: list[str] = ()) -> DataFrame:
    """(word, df, tf) of words of more than `longer` letters in at least `least` documents."""
    words = docs.select("doc_id", F.explode(tokens(F.col(text))).alias("word")).filter((F.length("word") > longer) & ~F.col("word").isin(*(stopwords or [""])))
    per = words.groupBy("doc_id", "word").agg(F.count("*").alias("c"))
    return per.groupBy("word").agg(F.count("*").alias("df"), F.sum("c").alias("tf")).filter(F.col("df") >= least)
