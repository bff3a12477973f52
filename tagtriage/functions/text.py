"""Text normalisation as Column expressions.

Everything here is a built-in Spark SQL function (regexp_replace, split,
transform, filter, element_at on a literal map ...), so whole normalisation
chains are one projection that never leaves the JVM; the lambdas over arrays are
interpreted there, the rest is generated code.
Patterns are written so Java regex and RE2 agree: explicit Unicode classes,
no look-behind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagtriage.functions import fixed


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _str_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def remove_urls(c) -> Column:
    """URLs and @mentions become one space."""
    return F.regexp_replace(_c(c), fixed.URL_MENTION_RE, " ")


def tweet_tokens(c) -> Column:
    """Tweet tokens (URLs, #tags, @names, words, single symbols)."""
    return F.regexp_extract_all(_c(c), F.lit(fixed.TWEET_TOKEN_RE), 0)


def remove_stop_words(c, extra: list[str] | None = None) -> Column:
    """Tokenise, drop stop words (case-sensitive) and punctuation tokens.

    A token is also dropped when it is a substring of Python's
    ``string.punctuation`` (the reference's test); tokens are re-joined with
    one space.
    """
    # ``isin`` over many literals becomes a hash-set lookup (InSet) in the
    # optimised plan; a literal array would be scanned for every token.
    stop = fixed.stop_words() + list(extra or [])
    punct = F.lit(fixed.PUNCTUATION)
    kept = F.filter(tweet_tokens(c), lambda t: ~t.isin(stop) & (F.instr(punct, t) == 0))
    return F.array_join(kept, " ")


def remove_sign(c) -> Column:
    """D3: ``#tag`` / ``@name`` -> ``tag '`` (a space and a quote appended)."""
    return F.regexp_replace(_c(c), fixed.SIGN_RE, "$1 '")


def remove_emoji(c, mode: str = "ref") -> Column:
    """Emoji runs -> one space.

    ``ref`` keeps the reference's class, which also removes every code point
    from U+24C2 up (CJK, Hangul ...); ``emoji_only`` omits that wide span.
    """
    pat = fixed.EMOJI_RE if mode == "ref" else fixed.EMOJI_ONLY_RE
    return F.regexp_replace(_c(c), pat, " ")


def _literal_map(d: dict[str, str]) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def _lookup(d: dict[str, str], key: Column, default: Column) -> Column:
    """Table lookup: a hash-set membership test (InSet) first, so the
    literal map (scanned linearly) is only consulted for real keys."""
    return F.when(key.isin(list(d)), F.element_at(_literal_map(d), key)).otherwise(default)


def expand_slang(c, table: dict[str, str] | None = None) -> Column:
    """Split on single spaces; a token whose letters/digits, upper-cased,
    equal a slang key becomes the phrase; other tokens stay as they were."""
    m = table or fixed.slang_map()
    toks = F.split(_c(c), " ", -1)
    out = F.transform(toks, lambda w: _lookup(
        m, F.upper(F.regexp_replace(w, fixed.SLANG_STRIP_RE, "")), w))
    return F.array_join(out, " ")


def lemmatize(c, table: dict[str, str] | None = None) -> Column:
    """D6 (fixed-table form): split on whitespace, map each word through a
    small literal lemma table, identity when absent, join with one space.
    For a large vocabulary table use ``operators.textops.apply_vocab``."""
    m = table or fixed.VERB_LEMMAS
    toks = F.filter(F.split(F.trim(_c(c)), r"\s+", -1), lambda w: w != "")
    return F.array_join(F.transform(toks, lambda w: _lookup(m, w, w)), " ")


def lower_words(c) -> Column:
    """Lower-case, collapse whitespace runs to one space, trim."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), r"\s+", " "))


_STEPS = {
    "urls": remove_urls,
    "stop": remove_stop_words,
    "emoji": remove_emoji,
    "sign": remove_sign,
    "slang": expand_slang,
    "lemma": lemmatize,
    "lower": lower_words,
}

# Step orders of the two chains (fixed by the reference).
SCORE_CHAIN = ["urls", "stop", "emoji", "sign", "slang", "lemma", "lower"]
TRAIN_CHAIN = ["urls", "emoji", "sign", "slang", "lemma", "lower", "stop"]


def normalise(c, chain: str = "score") -> Column:
    """The scoring or the training chain as one expression."""
    steps = SCORE_CHAIN if chain == "score" else TRAIN_CHAIN
    return reduce(lambda acc, s: _STEPS[s](acc), steps, _c(c))


def strip_accents(c) -> Column:
    src, dst = fixed.accent_table()
    return F.translate(_c(c), src, dst)


def simple_tokens(c, min_len: int = 1, max_len: int = 20) -> Column:
    """Lower, strip accents, alphabetic runs with min_len..max_len chars."""
    toks = F.regexp_extract_all(strip_accents(F.lower(_c(c))), F.lit(fixed.ALPHA_TOKEN_RE), 0)
    return F.filter(toks, lambda t: (F.length(t) >= min_len) & (F.length(t) <= max_len))


def clean_sentence(c) -> Column:
    """Drop e-mail-like tokens, collapse whitespace, drop single quotes,
    then D12 with lengths 2..15."""
    col = _c(c)
    # the e-mail pattern backtracks on every word; texts without '@' skip it
    s = F.when(F.instr(col, "@") > 0, F.regexp_replace(col, r"\S*@\S*\s?", "")).otherwise(col)
    s = F.regexp_replace(s, r"\s+", " ")
    s = F.regexp_replace(s, "'", "")
    return simple_tokens(s, 2, 15)


def word_tokens(c) -> Column:
    """G3 tokens: lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(fixed.WORD_TOKEN_RE), 0)


def keyword_vote(c, words: list[str], vote: int, abstain: int = -1) -> Column:
    """``vote`` if any keyword is a substring of the lower-cased text."""
    low = F.lower(_c(c))
    hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return F.when(hit, F.lit(vote)).otherwise(F.lit(abstain))


def word_in_text(c, word: str) -> Column:
    """Case-insensitive regex search of ``word`` in the text."""
    return F.lower(_c(c)).rlike(word.lower())


def ascii_only(c) -> Column:
    """Drop every non-ASCII character."""
    return F.regexp_replace(_c(c), r"[^\x00-\x7F]", "")
