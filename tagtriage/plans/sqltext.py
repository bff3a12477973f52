"""DuckDB twins of the text Column builders, for the oracles only."""

from __future__ import annotations

from functools import reduce

from tagtriage.functions import fixed


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def _case(expr: str, table: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"(CASE {expr} {whens} ELSE {default} END)"


def remove_urls(x: str) -> str:
    return f"regexp_replace({x}, {q(fixed.URL_MENTION_RE)}, ' ', 'g')"


def tweet_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {q(fixed.TWEET_TOKEN_RE)}, 0)"


def remove_stop_words(x: str) -> str:
    stop = _list(fixed.stop_words())
    return (f"array_to_string(list_filter({tweet_tokens(x)}, lambda t: NOT list_contains({stop}, t) "
            f"AND strpos({q(fixed.PUNCTUATION)}, t) = 0), ' ')")


def remove_sign(x: str) -> str:
    return f"regexp_replace({x}, {q(fixed.SIGN_RE)}, '\\1 ''', 'g')"


def remove_emoji(x: str, mode: str = "ref") -> str:
    pat = fixed.EMOJI_RE if mode == "ref" else fixed.EMOJI_ONLY_RE
    return f"regexp_replace({x}, {q(pat)}, ' ', 'g')"


def expand_slang(x: str) -> str:
    key = f"upper(regexp_replace(w, {q(fixed.SLANG_STRIP_RE)}, '', 'g'))"
    return (f"array_to_string(list_transform(string_split({x}, ' '), "
            f"lambda w: {_case(key, fixed.slang_map(), 'w')}), ' ')")


def lemmatize(x: str) -> str:
    toks = f"list_filter(string_split_regex(trim({x}), '\\s+'), lambda w: w <> '')"
    return (f"array_to_string(list_transform({toks}, "
            f"lambda w: {_case('w', fixed.VERB_LEMMAS, 'w')}), ' ')")


def lower_words(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


_STEPS = {"urls": remove_urls, "stop": remove_stop_words, "emoji": remove_emoji,
          "sign": remove_sign, "slang": expand_slang, "lemma": lemmatize, "lower": lower_words}


def normalise(x: str, chain: str = "score") -> str:
    from tagtriage.functions.text import SCORE_CHAIN, TRAIN_CHAIN
    steps = SCORE_CHAIN if chain == "score" else TRAIN_CHAIN
    return reduce(lambda acc, s: _STEPS[s](acc), steps, x)


def strip_accents(x: str) -> str:
    src, dst = fixed.accent_table()
    return f"translate({x}, {q(src)}, {q(dst)})"


def simple_tokens(x: str, lo: int = 1, hi: int = 20) -> str:
    toks = f"regexp_extract_all({strip_accents(f'lower({x})')}, {q(fixed.ALPHA_TOKEN_RE)}, 0)"
    return f"list_filter({toks}, lambda t: length(t) >= {lo} AND length(t) <= {hi})"


def clean_sentence(x: str) -> str:
    s = f"regexp_replace({x}, '\\S*@\\S*\\s?', '', 'g')"
    s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
    s = f"replace({s}, '''', '')"
    return simple_tokens(s, 2, 15)


def word_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(fixed.WORD_TOKEN_RE)}, 0)"


# Templates with a {c} slot for the input column.
NORMALISE_SCORE_SQL = normalise("{c}", "score").replace("{", "{{").replace("}", "}}").replace(
    "{{c}}", "{c}")
