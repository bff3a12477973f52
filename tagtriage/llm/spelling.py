"""Spelling variants by a variable-length gram index.

Words one edit apart are found through the grams that the edit leaves alone:

* Gram dictionary, pruned by frequency: a gram grows by a letter while more than
  ``common`` word positions hold it, so the dictionary is given by its common
  grams alone (every gram's beginnings are common).
* Decomposition: at each position the longest gram of the dictionary. (Grams
  inside a longer one stay: with all positions kept, the number of grams that
  an edit affects is exact.)
* Affected grams: an edit affects the grams that read its place, their
  lengthening included. A word keeps at least B grams under any single edit, so
  two near words meet in one of their rarest ``grams - B + 1`` grams, at
  matching places: only those lists are merged.
* Lists: keyed by the longer word's length, the gram and its place there; pairs
  of a list are verified by edit distance. A list over ``long_list`` words is
  split by what is left of the word without the gram and one more letter:
  near words agree there, so its work grows with its words, not their pairs.
"""

from __future__ import annotations

import math
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtriage.llm.common import arrow_rows, store

RUN = "[A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT, RATIO, ERASE = 6, 5, 5, 199
SHORT, LONG = 3, 8
COMMON, LONG_LIST = 100, 400


def cap(family: int) -> int:
    """The longest gram where the longer word has ``family`` letters. With
    ``family - 4`` at most, every edit leaves a gram alone (see ``lists``)."""
    return min(LONG, max(SHORT, family - 4))


def _lower(run: Column) -> Column:
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(
        F.translate(run, string.ascii_uppercase, string.ascii_lowercase))


def words_of(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): maximal runs of letters, A-Z lowered, after the planted slips:
    where 199 divides h = crc32("<doc_id>:<run>"), the run loses code point h %
    length. Words have at least ``min_chars`` code points and ``min_count``
    occurrences. A null id counts as empty text before the colon."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("__doc"), F.explode(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")),
                                                                         F.lit(RUN), F.lit(0))).alias("__run"))
    runs = runs.where(F.length("__run") >= min_chars).select("__doc", _lower(F.col("__run")).alias("__run"))
    runs = runs.select("__run", F.crc32(F.concat("__doc", F.lit(":"), "__run")).alias("__h"))
    cut = (F.col("__h") % F.length("__run")).cast("int")
    word = F.when(F.col("__h") % ERASE == 0, F.concat(F.substring("__run", F.lit(1), cut), F.substring("__run", cut + 2, F.length("__run")))) \
        .otherwise(F.col("__run"))
    return (runs.select(word.alias("word")).where(F.length("word") >= min_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def _grams(words: DataFrame) -> DataFrame:
    """(word, at, size, gram): every gram of SHORT to LONG letters, named by a 64-bit hash."""
    most = F.least(F.lit(LONG), F.greatest(F.lit(SHORT), F.length("word") - 3))
    at = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - SHORT + 1)).alias("at"), most.alias("most"))
    sized = at.select("word", "at", F.explode(F.sequence(F.lit(SHORT), F.least("most", F.length("word") - F.col("at") + 1))).alias("size"))
    return sized.select("word", "at", "size", F.xxhash64(F.substring("word", F.col("at"), F.col("size"))).alias("gram"))


def lists(word: str, hot: dict[tuple[int, int], int], family: int) -> list[tuple[int, int]]:
    """(place, length) of the grams whose lists a word is put into, in the family
    of pairs whose longer word has ``family`` letters. ``hot``: (place, length)
    -> frequency of the word's common grams.

    A gram reads up to its last letter, and one place more if it would go on but
    for the word's end. An edit at place i leaves alone the grams that end their
    reading before i and those that start after it; at most ``cap`` letters long,
    the first gram or one of the last is always among them, so kept >= 1."""
    n, longest, shorter = len(word), cap(family), len(word) < family
    grams = []
    for p in range(1, n - SHORT + 2):
        q = SHORT
        while q < longest and p + q <= n and (p, q) in hot:
            q += 1
        reads = n + 1 if q < longest and (p, q) in hot else p + q - 1
        grams.append((hot.get((p, q), 0), word[p - 1:p - 1 + q], p, q, reads))
    # affected by an edit at i: p <= i <= reads; by an insertion before i into the shorter word: p < i <= reads
    change = [0] * (n + 3)
    for _, _, p, _, reads in grams:
        change[p + shorter] += 1
        change[reads + 1] -= 1
    now = worst = 0
    for c in change[:n + 1 + shorter]:
        now += c
        worst = max(worst, now)
    grams.sort()
    return [(p, q) for _, _, p, q, _ in grams[:worst + 1]]


def _postings(words: DataFrame) -> DataFrame:
    """(family, role, place, gram, own, word): role 1 for words of ``family``
    letters, 0 for those a letter shorter, which stand at both places that the
    gram can have in the longer word. ``own`` is the gram's place in the word."""
    schema = pa.schema([("family", pa.int32()), ("role", pa.int32()), ("place", pa.int32()), ("own", pa.int32()),
                        ("gram", pa.string()), ("word", pa.string())])

    def work(batches):
        for b in batches:
            rows = []
            for word, ats, sizes, freqs in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                hot = dict(zip(zip(ats or [], sizes or [], strict=True), freqs or [], strict=True))
                n = len(word)
                rows += [(n, 1, p, p, word[p - 1:p - 1 + q], word) for p, q in lists(word, hot, n)]
                for p, q in lists(word, hot, n + 1):
                    gram = word[p - 1:p - 1 + q]
                    rows += [(n + 1, 0, p, p, gram, word), (n + 1, 0, p + 1, p, gram, word)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                                 schema=schema)

    return words.mapInArrow(work, "family int, role int, place int, own int, gram string, word string")


def _split(lists_: DataFrame) -> DataFrame:
    """Words of long lists, keyed anew by the list and what is left of the word:
    without the gram, and without one letter more. Words of equal length that
    are near agree in that and in the letter's place; of unequal length, the
    longer word's is the shorter one's rest as it is."""
    rest = F.concat(F.substring("word", F.lit(1), F.col("own") - 1), F.lit("\n"),
                    F.substring("word", F.col("own") + F.col("size"), F.length("word")))
    rows = lists_.select("key", "role", "word", "own", rest.alias("rest"))
    i = F.col("i")
    cut = (rows.where("role = 1").select("*", F.explode(F.sequence(F.lit(1), F.length("rest"))).alias("i")).where("i <> own")
           .withColumn("cut", F.concat(F.substring("rest", F.lit(1), i - 1), F.substring("rest", i + 1, F.length("rest")))))
    same = cut.select(F.xxhash64("key", i, "cut").alias("key"), F.lit(1).alias("role"), F.lit(1).alias("equal"), "word")
    longer = cut.select(F.xxhash64("key", F.lit(0), "cut").alias("key"), F.lit(1).alias("role"), F.lit(0).alias("equal"), "word")
    shorter = rows.where("role = 0").select(F.xxhash64("key", F.lit(0), "rest").alias("key"), "role", F.lit(0).alias("equal"), "word")
    return same.unionByName(longer).unionByName(shorter).distinct()


def near_pairs(words: DataFrame, common: int = COMMON, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b), every pair of words one edit apart once, in either order. ``words``
    holds each word (column ``word``, of six letters at least) once. Results do
    not depend on ``common`` and ``long_list``: they balance the work."""
    arrow_rows(words.sparkSession, 2000)
    grams = store(_grams(words), "grams")
    hot = store(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") > common), "common-grams")
    held = grams.join(hot, "gram").groupBy("word").agg(F.collect_list(F.struct("at", "size", "freq")).alias("g"))
    posted = store(_postings(words.select("word").join(held, "word", "left").select("word", "g.at", "g.size", "g.freq"))
                   .select(F.xxhash64("family", "place", "gram").alias("key"), "role", "own", F.length("gram").alias("size"), "word"),
                   "postings")
    long = store(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long_list).select("key"), "long-lists")
    split = store(_split(posted.join(long, "key", "left_semi")), "split-lists")
    near = F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1

    def pairs(x: DataFrame, y: DataFrame, also: Column) -> DataFrame:
        met = x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & also & near)
        return met.select(F.col("x.word").alias("a"), F.col("y.word").alias("b"))

    rest = posted.join(long, "key", "left_anti").select("key", "role", "word")
    once = F.col("x.word") < F.col("y.word")
    found = pairs(rest.where("role = 1"), rest, (F.col("y.role") == 0) | once) \
        .unionByName(pairs(split.where("equal = 1"), split.where("equal = 1"), once)) \
        .unionByName(pairs(split.where("equal = 0 AND role = 1"), split.where("equal = 0 AND role = 0"), F.lit(True)))
    return found.distinct()


def variants(words: DataFrame, ratio: int = RATIO, **balance) -> DataFrame:
    """``words`` (word, n: each word once) with its form, form_n, n_near and root.

    A word's form is its near word (one code point inserted, deleted or
    replaced) of largest n, ties to the smallest in code-point order, if that n
    is at least ``ratio`` times the word's; else null. The root follows forms to
    the last; a word without form is its own. As n grows ``ratio``-fold at each
    step, the number of doublings that reach every root follows from the largest n."""
    words = words.select("word", F.col("n").cast("long").alias("n"))
    pairs = store(near_pairs(words, **balance), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    best = (both.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
            .groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("b")))
    led = (F.col("b.m") * -1) >= F.col("n") * ratio
    links = store(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(led, F.col("b.other")).alias("form"), F.when(led, -F.col("b.m")).alias("form_n")), "forms")
    largest = words.agg(F.max("n")).first()[0] or 1
    steps = math.ceil(math.log(largest, ratio)) + 1
    roots = links.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while steps > 1:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = store(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        steps = (steps + 1) // 2
    return links.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Words of whole ``docs`` (doc_id, text; other columns are left aside) with
    their spelling variants, see ``words_of`` and ``variants``. Null and empty
    texts have no words; repeated rows count as often as they occur."""
    return variants(store(words_of(docs), "words"))
