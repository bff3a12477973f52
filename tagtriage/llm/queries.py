"""Registered queries of the subpackage: name -> (fn(spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from tagtriage.llm import bpe, conversation_trie, fingerprint, line_dedup, mixing, probminhash, quality, shard, spelling, suffix_dedup, token_counts, topk, warc
from tagtriage.sources.tables import table

Q: dict = {}


def _docs(spark, d, *cols):
    return table(spark, d, "documents").select(*cols)


# ---- 1 exact top-k: every 20th vector against all others
Q["op1_top_k"] = (
    lambda s, d: topk.top_k(table(s, d, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v")),
                            F.col("vec_id") % 20 == 0, 20),
    """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= 20""")

# ---- 2 byte-level BPE
Q["op2_byte_bpe"] = (
    lambda s, d: bpe.encode_decode_digests(_docs(s, d, "doc_id", "text"),
                                           public_tokenizers.path("byte_bpe_50k.tiktoken")),
    None)

# ---- 3 sharding: the shards are written, and the digests come from the written rows
SHARDS = 40


def _op3(s, d):
    docs = table(s, d, "documents")
    path = shard.write_shards(docs, SHARDS)
    text = F.coalesce("text", F.lit(""))
    return shard.read_shards(s, path, docs.schema).select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


Q["op3_shards"] = (_op3, None)

# ---- 4 repeated strings of 400 bytes
Q["op4_suffix_dedup"] = (
    lambda s, d: suffix_dedup.remove_repeats(_docs(s, d, "doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_bytes") - F.col("n_removed")).alias("n_kept")),
    None)

# ---- 5 line dedup
Q["op5_line_dedup"] = (
    lambda s, d: line_dedup.drop_repeated_lines(_docs(s, d, "doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")),
    r"""WITH lines AS (
  SELECT doc_id, i AS pos, line, translate(trim(line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
repeated AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.*, r.last IS NOT NULL AND l.doc_id < r.last AS dropped FROM lines l LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")

# ---- 6 near duplicates: a row a document with its class
Q["op6_near_duplicates"] = (
    lambda s, d: probminhash.near_duplicates(_docs(s, d, "doc_id", "text")).select("doc_id", "class_id", "keep"),
    None)

# ---- 7 mixing: sources weighted by size ** 0.7
Q["op7_mix_sources"] = (
    lambda s, d: mixing.mix(_docs(s, d, "doc_id", "source", "text")).select(
        "doc_id", "source", "copy", "place", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")),
    f"""WITH sized AS (SELECT source, sum(strlen(coalesce(text, '')))::DOUBLE AS b FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN b > 0 THEN round(pow(b, {mixing.ALPHA}) / (SELECT sum(pow(b, {mixing.ALPHA})) FROM sized)
    * (SELECT sum(b) FROM sized) / b, 9) ELSE 0 END AS rate FROM sized),
steps AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM (SELECT source, rate, unnest(range(0, (rate + 12 * sqrt(rate) + 25)::INT)) AS k FROM rates WHERE rate > 0)),
drawn AS (
  SELECT doc_id, source, text,
    ('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
counted AS (
  SELECT d.doc_id, d.source, d.text, count(*) FILTER (s.c <= d.u) AS n
  FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source GROUP BY d.doc_id, d.source, d.text)
SELECT doc_id, source, copy::INT AS copy, md5('order {mixing.SEED}:' || doc_id || ':' || copy) AS place,
  sha256(coalesce(text, '')) AS text_sha256
FROM (SELECT doc_id, source, text, unnest(range(1, n + 1)) AS copy FROM counted WHERE n > 0)""")

# ---- 8 token counts
Q["op8_token_counts"] = (
    lambda s, d: token_counts.token_counts(_docs(s, d, "doc_id", "text"),
                                           public_tokenizers.path("byte_bpe_50k.tiktoken")),
    None)


# ---- 9 quality: three grades (toxic, poor, good); good is wanted
def _op9(s, d):
    docs = _docs(s, d, "doc_id", "text")
    marks = table(s, d, "labels").select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality.classify(docs, quality.train(docs, marks)).drop("text")


Q["op9_quality"] = (_op9, None)

# ---- 10 fingerprints
Q["op10_fingerprints"] = (lambda s, d: fingerprint.fingerprints(_docs(s, d, "doc_id", "text")), None)


# ---- 11 prefix trie of conversations: nodes are distinct beginnings of rebuilt conversations
Q["op11_conversation_trie"] = (
    lambda s, d: conversation_trie.prefix_trie(table(s, d, "conversations")),
    r"""WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
    md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tid
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, tid) AS s FROM t GROUP BY conv_id),
crc AS (
  SELECT conv_id, s, list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS c
  FROM own),
headed AS (SELECT conv_id, s, xor(c, 4294967295) % 4 AS h FROM crc),
built AS (
  SELECT a.conv_id, list_concat(coalesce(b.s, [])[1:a.h], a.s[a.h + 1:]) AS s
  FROM headed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
steps AS (SELECT conv_id, unnest(range(len(s) + 1)) AS depth, s FROM built),
nodes AS (
  SELECT s[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = depth), '') AS ends
  FROM steps GROUP BY ALL),
named AS (
  SELECT *, CASE WHEN depth > 0 THEN p[1:depth - 1] END AS up,
    CASE WHEN depth > 0 THEN len(regexp_extract_all(p[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM nodes),
kids AS (SELECT up, count(*) AS n_children FROM named WHERE depth > 0 GROUP BY up),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM named n LEFT JOIN kids k ON n.p = k.up),
paths AS (SELECT p, depth, n_convs, words, n_children, unnest(range(depth + 1)) AS d FROM full_nodes),
below AS (
  SELECT p[1:d] AS p, sum((n_convs - 1) * words)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM paths GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens,
  sha256(n.ends) AS ends_sha256, n.words
FROM full_nodes n JOIN below b ON n.p = b.p LEFT JOIN full_nodes u ON n.up = u.p""")

# ---- 13 WARC: pages written as archives and read back
Q["op13_warc"] = (
    lambda s, d: warc.archive_pages(table(s, d, "pages")).drop("url"),
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
named AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM named""")

# ---- 12 spelling variants: the slips are found by crc32, near words by what is left without a letter
Q["op12_spelling_variants"] = (
    lambda s, d: spelling.spelling_variants(_docs(s, d, "doc_id", "text")),
    """WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS t),
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
  WHERE length(r) >= 6 GROUP BY ALL),
hashed AS (
  SELECT w, k, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
      string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
  FROM runs, crc),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cuts AS (
  SELECT word, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cuts a JOIN words b ON a.v = b.word
  UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.v = b.word),
best AS (
  SELECT p.a AS word, p.b AS other, w.n AS m, count(*) OVER (PARTITION BY p.a) AS n_near,
    row_number() OVER (PARTITION BY p.a ORDER BY w.n DESC, p.b) AS r
  FROM pairs p JOIN words w ON w.word = p.b),
links AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.other END AS form,
    CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.r = 1),
walk AS (
  SELECT word, word AS at FROM links
  UNION ALL SELECT walk.word, links.form FROM walk JOIN links ON links.word = walk.at WHERE links.form IS NOT NULL)
SELECT l.word, l.form, walk.at AS root, l.n, l.n_near, l.form_n
FROM links l JOIN walk USING (word) JOIN links e ON e.word = walk.at AND e.form IS NULL""")
