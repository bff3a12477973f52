"""Queries: text normalisation and tokenisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtriage.functions import fixed, stem
from tagtriage.functions import text as tx
from tagtriage.operators import textops
from tagtriage.plans import fixtures as fx
from tagtriage.plans import sqltext as st
from tagtriage.plans.util import rounded, with_ctes
from tagtriage.sources.tables import table

Q = {}
DM = with_ctes(fx.DOC_MESSAGES_SQL)


def _col_query(name, col_fn, sql_fn):
    Q[name] = (lambda s, d: fx.doc_messages(s, d).select("id", col_fn(F.col("fulltext")).alias("out")),
               DM + f"SELECT id, {sql_fn('fulltext')} AS out FROM doc_messages")


_col_query("D1_remove_urls", tx.remove_urls, st.remove_urls)
_col_query("D2_remove_stop_words", tx.remove_stop_words, st.remove_stop_words)
_col_query("D3_remove_sign", tx.remove_sign, st.remove_sign)
_col_query("D4_remove_emoji_ref", tx.remove_emoji, st.remove_emoji)
_col_query("D4_remove_emoji_only", lambda c: tx.remove_emoji(c, "emoji_only"),
           lambda x: st.remove_emoji(x, "emoji_only"))
_col_query("D5_expand_slang", tx.expand_slang, st.expand_slang)
_col_query("D6_lemmatize", tx.lemmatize, st.lemmatize)
_col_query("D8_lower_words", tx.lower_words, st.lower_words)
_col_query("D9_normalise_score", lambda c: tx.normalise(c, "score"),
           lambda x: st.normalise(x, "score"))
_col_query("D10_normalise_train", lambda c: tx.normalise(c, "train"),
           lambda x: st.normalise(x, "train"))
_col_query("D11_tweet_tokens", tx.tweet_tokens, st.tweet_tokens)
_col_query("D12_simple_tokens", tx.simple_tokens, st.simple_tokens)
_col_query("D13_clean_sentence", tx.clean_sentence, st.clean_sentence)
_col_query("D16_keyword_vote", lambda c: tx.keyword_vote(c, ["food", "game", "apple"], 1),
           lambda x: f"""CASE WHEN contains(lower({x}), 'food') OR contains(lower({x}), 'game')
           OR contains(lower({x}), 'apple') THEN 1 ELSE -1 END""")


def _d6_vocab(s, d):
    """D6 join form: the lemma table as a DataFrame, applied by a join."""
    m = fx.doc_messages(s, d).select("id", tx.lower_words(tx.remove_urls("fulltext")).alias("t"))
    vocab = s.createDataFrame(sorted(fixed.VERB_LEMMAS.items()), "form string, value string")
    return textops.apply_vocab(m, "t", vocab).select("id", F.col("t").alias("out"))


Q["D6_apply_vocab_join"] = (_d6_vocab, DM + f"""SELECT id, {st.lemmatize(st.lower_words(st.remove_urls('fulltext')))} AS out
FROM doc_messages""")

def _d7_stem(s, d):
    """Every word through the stems of the corpus's own distinct words."""
    m = fx.doc_messages(s, d).select("id", tx.lower_words("fulltext").alias("t"))
    words = m.select(F.explode(textops.split_words("t")).alias("form"))
    return textops.apply_vocab(m, "t", stem.stems(words)).select("id", F.col("t").alias("out"))


LOWERED_SQL = f"low AS (SELECT id, string_split_regex(trim({st.lower_words('fulltext')}), '\\s+') AS ws FROM doc_messages),\n" \
    "forms AS (SELECT DISTINCT unnest(ws) AS form FROM low)"

Q["D7_stem_vocab"] = (_d7_stem, DM + f""",
{LOWERED_SQL},
stems AS ({stem.stems_sql('forms')}),
spread AS (SELECT id, unnest(ws) AS form, unnest(range(len(ws))) AS pos FROM low),
joined AS (SELECT id, string_agg(value, ' ' ORDER BY pos) AS out FROM spread JOIN stems USING (form) WHERE form <> '' GROUP BY id)
SELECT d.id, coalesce(out, '') AS out FROM doc_messages d LEFT JOIN joined j ON j.id = d.id""")


def _d6_rules(s, d):
    """D6 vocabulary job: the corpus's words, lemmas accepted where ``benchmark`` uses
    the word, the fixed irregular forms as exceptions."""
    words = fx.doc_messages(s, d).select(tx.lower_words("fulltext").alias("t")).select(F.explode(textops.split_words("t")).alias("form"))
    lexicon = table(s, d, "benchmark").select(F.explode(tx.word_tokens("text")).alias("w")).select(F.lower("w").alias("form"))
    irregular = s.createDataFrame(sorted(fixed.VERB_LEMMAS.items()), "form string, value string")
    return textops.verb_lemmas(words, lexicon, irregular)


Q["D6_verb_lemmas"] = (_d6_rules, DM + f""",
{LOWERED_SQL},
lexicon AS (SELECT DISTINCT lower(w) AS form FROM (SELECT unnest({st.word_tokens('text')}) AS w FROM benchmark)),
irregular AS (SELECT * FROM (VALUES {', '.join(f"({st.q(a)}, {st.q(b)})" for a, b in sorted(fixed.VERB_LEMMAS.items()))}) AS t(form, value)),
tried AS (SELECT form, 0 AS r, form AS value FROM forms UNION ALL """ + " UNION ALL ".join(
    f"SELECT form, {r}, left(form, length(form) - {len(e)}) || '{put}' FROM forms WHERE length(form) > {len(e)} AND ends_with(form, '{e}')"
    for r, (e, put) in enumerate(textops.DETACH, 1)) + """),
ruled AS (SELECT form, arg_min(value, r) AS value FROM tried WHERE value IN (SELECT form FROM lexicon) GROUP BY form)
SELECT form, value FROM irregular WHERE form IN (SELECT form FROM forms WHERE form <> '')
UNION ALL SELECT form, value FROM ruled WHERE form <> '' AND form NOT IN (SELECT form FROM irregular)""")


def _d14(s, d):
    m = fx.doc_messages(s, d).select("id", tx.clean_sentence("fulltext").alias("toks"))
    return rounded(textops.phrases(m, "toks", 5, 100.0))


Q["D14_phrases"] = (_d14, DM + f"""WITH_T""".replace("WITH_T", "") + f"""
, toks AS (SELECT id, {st.clean_sentence('fulltext')} AS toks FROM doc_messages),
uni AS (SELECT w, COUNT(*) AS n FROM (SELECT unnest(toks) AS w FROM toks) GROUP BY w),
pairs AS (SELECT toks[i] AS a, toks[i + 1] AS b FROM (
  SELECT toks, unnest(range(1, len(toks))) AS i FROM toks WHERE len(toks) >= 2)),
bi AS (SELECT a, b, COUNT(*) AS n_ab FROM pairs GROUP BY a, b),
v AS (SELECT (SELECT COUNT(*) FROM uni) + (SELECT COUNT(*) FROM bi) AS V)
SELECT bi.a, bi.b, bi.n_ab, ROUND((bi.n_ab - 5) * v.V / (ua.n * ub.n), 6) AS score
FROM bi JOIN uni ua ON bi.a = ua.w JOIN uni ub ON bi.b = ub.w, v
WHERE (bi.n_ab - 5) * v.V / (ua.n * ub.n) > 100.0""")


def _d15(s, d):
    vocab = (table(s, d, "benchmark").select(F.explode(tx.word_tokens("text")).alias("word")))
    return textops.corpus_tokens(fx.doc_messages(s, d), "fulltext", vocab)


Q["D15_corpus_tokens"] = (_d15, DM + f"""
, toks AS (SELECT unnest(regexp_extract_all(regexp_replace(fulltext, '[0-9]', '', 'g'),
    {st.q(textops.WORDPUNCT_RE)}, 0)) AS token FROM doc_messages),
vocab AS (SELECT DISTINCT lower(w) AS lw FROM (SELECT unnest({st.word_tokens('text')}) AS w FROM benchmark))
SELECT token, COUNT(*) AS n FROM toks
WHERE NOT regexp_matches(token, '^\\p{{L}}+$') OR lower(token) IN (SELECT lw FROM vocab)
GROUP BY token""")


def _d14_tri(s, d):
    m = fx.doc_messages(s, d).select("id", tx.clean_sentence("fulltext").alias("toks"))
    return rounded(textops.trigram_phrases(m, "toks", 5, 100.0))


def _phrase_sql(src: str, prefix: str) -> str:
    return f"""{prefix}uni AS (SELECT w, COUNT(*) AS n FROM (SELECT unnest(toks) AS w FROM {src}) GROUP BY w),
{prefix}pairs AS (SELECT id, i, toks[i] AS a, toks[i + 1] AS b FROM (
  SELECT id, toks, unnest(range(1, len(toks))) AS i FROM {src} WHERE len(toks) >= 2)),
{prefix}bi AS (SELECT a, b, COUNT(*) AS n_ab FROM {prefix}pairs GROUP BY a, b),
{prefix}v AS (SELECT (SELECT COUNT(*) FROM {prefix}uni) + (SELECT COUNT(*) FROM {prefix}bi) AS V),
{prefix}ph AS (SELECT bi.a, bi.b, bi.n_ab, (bi.n_ab - 5) * v.V / (ua.n * ub.n) AS score
  FROM {prefix}bi bi JOIN {prefix}uni ua ON bi.a = ua.w JOIN {prefix}uni ub ON bi.b = ub.w, {prefix}v v
  WHERE (bi.n_ab - 5) * v.V / (ua.n * ub.n) > 100.0)"""


Q["D14_trigram_phrases"] = (_d14_tri, DM + f"""
, toks AS (SELECT id, {st.clean_sentence('fulltext')} AS toks FROM doc_messages),
""" + _phrase_sql("toks", "p1_") + """,
hits AS (SELECT p.id, p.i, p.a, p.b FROM p1_pairs p JOIN p1_ph ph ON p.a = ph.a AND p.b = ph.b),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY i) AS g FROM hits),
applied AS (SELECT id, i, a, b FROM (
  SELECT *, row_number() OVER (PARTITION BY id, g ORDER BY i) - 1 AS o FROM runs) WHERE o % 2 = 0),
tk AS (SELECT id, unnest(range(1, len(toks) + 1)) AS pos, unnest(toks) AS w FROM toks),
merged AS (SELECT tk.id, tk.pos, coalesce(ap.a || '_' || ap.b, tk.w) AS w FROM tk
  LEFT JOIN applied ap ON tk.id = ap.id AND tk.pos = ap.i
  WHERE NOT EXISTS (SELECT 1 FROM applied a2 WHERE a2.id = tk.id AND a2.i + 1 = tk.pos)),
mt AS (SELECT t.id, coalesce(m.toks, []) AS toks FROM toks t LEFT JOIN (
  SELECT id, list(w ORDER BY pos) AS toks FROM merged GROUP BY id) m ON t.id = m.id),
""" + _phrase_sql("mt", "p2_") + """
SELECT a, b, n_ab, ROUND(score, 6) AS score FROM p2_ph""")
