"""Suffix-stripping stemmer of 1980 (five steps), as SQL expressions.

A word runs beside its pattern of vowels and consonants (``v`` and ``c``; a y
is a consonant at the start and after a vowel). A stem's pattern is the
beginning of its word's, so the rules' conditions are tests on a beginning of
the pattern: the measure m counts its ``vc``. Only functions that engines share
are used, so one text serves Spark and the SQL twin. Words that are not all a-z,
or have fewer than three letters, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagtriage.session import cut_lineage

# Endings and what takes their place, by step.
STEP1A = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
         ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
         ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"),
         ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous",
         "ive", "ize"]
# passes that settle the y's of a word: a run of up to as many is read right
Y_PASSES = 4


def _pattern(w: str) -> str:
    p = f"translate({w}, 'aeioubcdfghjklmnpqrstvwxz', '{'v' * 5 + 'c' * 20}')"
    p = f"CASE WHEN left({p}, 1) = 'y' THEN concat('c', substr({p}, 2)) ELSE {p} END"
    for _ in range(Y_PASSES):
        p = f"replace(replace({p}, 'cy', 'cv'), 'vy', 'vc')"
    return p


def _m(p: str) -> str:
    return f"(length({p}) - length(replace({p}, 'vc', ''))) / 2"


def _cut(k: int, of: str = "w") -> str:
    return f"left({of}, length({of}) - {k})"


def _ends(s: str) -> str:
    return f"(length(w) > {len(s)} AND right(w, {len(s)}) = '{s}')"


def _double(w: str, p: str) -> str:
    return f"(length({w}) >= 2 AND right({w}, 1) = right(left({w}, length({w}) - 1), 1) AND right({p}, 1) = 'c')"


def _cvc(w: str, p: str) -> str:
    return f"(right({p}, 3) = 'cvc' AND right({w}, 1) NOT IN ('w', 'x', 'y'))"


def _longest(rules: list, condition) -> str:
    """The longest ending decides, whether or not its condition then holds."""
    whens = []
    for end, put in sorted(rules, key=lambda r: -len(r[0])):
        whens.append(f"WHEN {_ends(end)} THEN CASE WHEN {condition(end)} THEN concat({_cut(len(end))}, '{put}') ELSE w END")
    return "CASE " + " ".join(whens) + " ELSE w END"


def steps() -> list[str]:
    """Expressions of (w, p) that give the next w, in order."""
    vowel = lambda k: f"contains({_cut(k, 'p')}, 'v')"
    m = lambda k: _m(_cut(k, "p"))
    out = [_longest(STEP1A, lambda e: "true")]
    # 1b: marked by a trailing 1 where an ending was taken off and the stem is to be mended
    out.append(f"CASE WHEN {_ends('eed')} THEN CASE WHEN {m(3)} > 0 THEN {_cut(1)} ELSE w END "
               f"WHEN {_ends('ing')} AND {vowel(3)} THEN concat({_cut(3)}, '1') "
               f"WHEN {_ends('ed')} AND {vowel(2)} THEN concat({_cut(2)}, '1') ELSE w END")
    s, q = _cut(1), _cut(1, "p")  # the pattern of the mark is the mark
    out.append(f"CASE WHEN right(w, 1) <> '1' THEN w WHEN right({s}, 2) IN ('at', 'bl', 'iz') THEN concat({s}, 'e') "
               f"WHEN {_double(s, q)} AND right({s}, 1) NOT IN ('l', 's', 'z') THEN {_cut(2)} "
               f"WHEN {_m(q)} = 1 AND {_cvc(s, q)} THEN concat({s}, 'e') ELSE {s} END")
    out.append(f"CASE WHEN right(w, 1) = 'y' AND {vowel(1)} THEN concat({_cut(1)}, 'i') ELSE w END")
    out.append(_longest(STEP2, lambda e: f"{m(len(e))} > 0"))
    out.append(_longest(STEP3, lambda e: f"{m(len(e))} > 0"))
    out.append(_longest([(e, "") for e in STEP4], lambda e: f"{m(len(e))} > 1" + (
        f" AND right({_cut(3)}, 1) IN ('s', 't')" if e == "ion" else "")))
    out.append(f"CASE WHEN right(w, 1) = 'e' AND ({m(1)} > 1 OR ({m(1)} = 1 AND NOT {_cvc(_cut(1), _cut(1, 'p'))})) THEN {_cut(1)} ELSE w END")
    out.append(f"CASE WHEN {_m('p')} > 1 AND {_double('w', 'p')} AND right(w, 1) = 'l' THEN {_cut(1)} ELSE w END")
    return out


def stems(df, word: str = "form"):
    """D7 vocabulary: (form, value) for the distinct words of ``df``; one projection
    a step, all built-in functions. The vocabulary is stored: a predicate on it
    would otherwise be pushed through all steps, each of which repeats its input."""
    out = df.select(F.col(word).alias("form")).where("form IS NOT NULL").distinct().withColumn("w", F.col("form"))
    for e in steps():
        out = out.select("form", "w", F.expr(_pattern("w")).alias("p")).select("form", F.expr(e).alias("w"))
    plain: Column = F.col("form").rlike("^[a-z]{3,}$")
    return cut_lineage(out.select("form", F.when(plain, F.col("w")).otherwise(F.col("form")).alias("value")))


def stems_sql(words: str) -> str:
    """The same for a table ``words`` (form): a subquery a step."""
    q = f"SELECT form, form AS w FROM (SELECT DISTINCT form FROM {words} WHERE form IS NOT NULL)"
    for e in steps():
        q = f"SELECT form, {e} AS w FROM (SELECT form, w, {_pattern('w')} AS p FROM ({q}))"
    return f"SELECT form, CASE WHEN regexp_full_match(form, '[a-z]{{3,}}') THEN w ELSE form END AS value FROM ({q})"
