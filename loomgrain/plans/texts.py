"""String operators over whole tables."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrain.functions import text as T
from loomgrain.plans import sqltext as S
from loomgrain.session import dealt as table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def normalize_text(spark, sf):
    n = T.normalize("text")
    return _docs(spark, sf).select("doc_id", F.length(n).cast("long").alias("n_chars"), F.md5(n.cast("binary")).alias("digest"))


def estimate_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", T.estimate_tokens("text").alias("tokens"))


def word_count(spark, sf):
    return _docs(spark, sf).select("doc_id", T.word_count("text").alias("words"))


def sentence_split(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def bm25_tokens(spark, sf):
    return _docs(spark, sf).select(F.explode(T.bm25_tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def bag_tokens(spark, sf):
    return table(spark, sf, "conversations").select(F.explode(T.bag_tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


#: The tables hold no CJK text, so letters are read as these characters, which also make some of the stop words.
CJK_LETTERS = "我们他可以这个些什么没有不是就因为所如果哪多少怎种一"


def _cjk(spark: SparkSession, sf: str) -> DataFrame:
    text = F.translate(F.lower(F.concat("text", F.lit(" BM25 x2 in"))), string.ascii_lowercase[:20], CJK_LETTERS[:20])
    return table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text"))


def cjk_ngrams(spark, sf):
    """Terms of the 2_4gram profile over every turn read as CJK text."""
    return _cjk(spark, sf).select(F.explode(T.cjk_tokens("text", 4)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def cjk_sizes(spark, sf):
    """Token estimates of CJK text, and its windows of single tokens, joined without spaces."""
    rows = _cjk(spark, sf)
    windows = F.transform(T.word_windows("text", 64, 16), lambda w: F.md5(w.cast("binary")))
    return rows.select("conv_id", "turn", T.estimate_tokens("text").alias("tokens"), F.array_join(windows, ",").alias("windows"))


def normalize_tags(spark, sf):
    """Every word of every turn, and its CJK reading, as a tag."""
    words = table(spark, sf, "conversations").select(F.explode(F.split("text", " ")).alias("w")).unionByName(_cjk(spark, sf).select(F.explode(F.split("text", " ")).alias("w")))
    return words.select(T.normalize_tag("w").alias("tag")).filter("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


def entities(spark, sf):
    """Capitalised phrases of all documents; characters beyond ASCII are read as x, as word edges differ for them."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    return _docs(spark, sf).select(F.explode(T.entities(plain)).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


def word_windows(spark, sf):
    each = _docs(spark, sf).select("doc_id", F.posexplode(T.word_windows("text", 64, 16)).alias("pos", "w"))
    return each.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("w").cast("binary")).alias("digest"))


def summary_first_sentence(spark, sf):
    return _docs(spark, sf).select("doc_id", T.summary("text").alias("summary"))


def safe_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_id("url").alias("id"), T.stable_hash("url").alias("hash"))


def previews(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", T.preview("text").alias("preview"), T.ellipsis_preview("text").alias("long_preview"), T.cut_at_word("text", 180).alias("cut")
    )


def section_path(spark, sf):
    """The opening of each document with its words as section names, some of them empty."""
    named = F.replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), F.lit(" "), F.lit(" :::  ::: "))
    return _docs(spark, sf).select("doc_id", F.array_join(T.section_path(named), "/").alias("path"))


def caption_type(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.caption_type(F.concat(F.initcap("role"), F.lit(" "), "text")).alias("type"))


def token_f1(spark, sf):
    near = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(near))
    return turns.filter("before IS NOT NULL").select("conv_id", "turn", F.round(T.token_f1(F.col("before"), F.col("text")), 6).alias("f1"))


def compact_answer(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", T.compact_answer(F.transform("t", lambda x: x["text"])).alias("answer"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, estimate_tokens, word_count, sentence_split, bm25_tokens, bag_tokens, cjk_ngrams, cjk_sizes, normalize_tags, entities, word_windows,
        summary_first_sentence, safe_id, previews, section_path, caption_type, token_f1, compact_answer,
    )
}

_N = S.normalize("text")
_TURN = f"translate(lower(text || ' BM25 x2 in'), '{string.ascii_lowercase[:20]}', '{CJK_LETTERS[:20]}')"
_STOPS = ", ".join(f"'{w}'" for w in T.QUERY_STOPWORDS + T.QUERY_STOPWORDS_ZH)
_GRAMS = """list_concat([sp][1:CASE WHEN len(sp) < 2 THEN 1 ELSE 0 END], flatten(list_transform(range(2, least(4, len(sp)) + 1), lambda k: list_transform(range(1, len(sp) - k + 2), lambda i: substring(sp, i, k)))))"""
_STRIP = r" \t\r\n,，.;；:：!?！？()\[\]{}<>《》【】\"''“”‘’"
_WINDOWED = "list_transform(range(0, greatest(0, CAST(ceil((len(w) - 64) / 48) AS BIGINT)) + 1), lambda p: w[p * 48 + 1 : p * 48 + 64])"
SQL = {
    "normalize_text": f"SELECT doc_id, len({_N}) AS n_chars, md5({_N}) AS digest FROM documents",
    "estimate_tokens": f"SELECT doc_id, {S.tokens('text')} AS tokens FROM documents",
    "word_count": f"SELECT doc_id, CASE WHEN {_N} = '' THEN 0 ELSE len(string_split({_N}, ' ')) END AS words FROM documents",
    "sentence_split": f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents)",
    "bm25_tokens": f"SELECT term, count(*) AS n FROM (SELECT unnest({S.bm25_tokens('text')}) AS term FROM documents) GROUP BY term",
    "bag_tokens": f"SELECT term, count(*) AS n FROM (SELECT unnest({S.bag('text')}) AS term FROM conversations) GROUP BY term",
    "cjk_ngrams": f"""WITH t AS (SELECT {_TURN} AS t FROM conversations),
      e AS (SELECT unnest(list_concat(list_transform(regexp_extract_all(t, '{S.LATIN}'), lambda x: lower(x)), flatten(list_transform(regexp_extract_all(t, '[{S.CJK}]+'), lambda sp: {_GRAMS})))) AS term FROM t)
      SELECT term, count(*) AS n FROM e WHERE term NOT IN ({_STOPS}) AND NOT (len(term) = 1 AND NOT regexp_matches(term, '[{S.CJK}]')) GROUP BY term""",
    "cjk_sizes": f"""WITH t AS (SELECT conv_id, turn, {_TURN} AS t FROM conversations), n AS (SELECT conv_id, turn, {S.tokens('t')} AS tokens, {S.normalize('t')} AS t FROM t),
      w AS (SELECT *, CASE WHEN tokens > 64 AND regexp_matches(t, '[{S.CJK}]') THEN regexp_extract_all(t, '{S.LATIN}|[{S.CJK}]|[^\\s]') ELSE string_split(t, ' ') END AS w FROM n)
      SELECT conv_id, turn, tokens, CASE WHEN t = '' THEN '' ELSE array_to_string(list_transform({_WINDOWED}, lambda x:
        md5(CASE WHEN len(list_filter(x, lambda y: regexp_matches(y, '[{S.CJK}]'))) > 0 THEN array_to_string(x, '') ELSE array_to_string(x, ' ') END)), ',') END AS windows FROM w""",
    "normalize_tags": f"""WITH w AS (SELECT unnest(string_split(text, ' ')) AS w FROM conversations UNION ALL SELECT unnest(string_split({_TURN}, ' ')) FROM conversations),
      s AS (SELECT regexp_replace(regexp_replace({S.normalize('w')}, '^[{_STRIP}]+', ''), '[{_STRIP}]+$', '') AS t FROM w),
      k AS (SELECT CASE WHEN regexp_matches(t, '[{S.CJK}]') THEN t ELSE lower(t) END AS tag FROM s WHERE lower(t) NOT IN ({", ".join(f"'{x}'" for x in T.TAG_STOPWORDS)})
        AND t NOT IN ({", ".join(f"'{x}'" for x in T.TAG_STOPWORDS_ZH)}) AND NOT regexp_matches(t, '^[{S.CJK}]$') AND regexp_matches(t, '[\\p{{L}}\\p{{N}}]'))
      SELECT tag, count(*) AS n FROM k GROUP BY tag""",
    "entities": rf"""WITH t AS (SELECT regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS t FROM documents),
      e AS (SELECT trim(regexp_replace(unnest(regexp_extract_all(t, '{T.ENTITY}')), '\s+', ' ', 'g')) AS entity FROM t)
      SELECT entity, count(*) AS n FROM e WHERE entity NOT IN ({", ".join(f"'{x}'" for x in T.NO_ENTITIES)}) AND NOT regexp_matches(entity, '^(BIBREF|FIGREF|TABREF|SECREF)') GROUP BY entity""",
    "word_windows": f"""
      SELECT doc_id, pos, md5(array_to_string(list_slice(w, pos * 48 + 1, pos * 48 + 64), ' ')) AS digest
      FROM (SELECT doc_id, w, unnest(range(0, greatest(0, CAST(ceil((len(w) - 64) / 48) AS BIGINT)) + 1)) AS pos
            FROM (SELECT doc_id, string_split({_N}, ' ') AS w FROM documents WHERE {_N} <> ''))""",
    "summary_first_sentence": f"""
      SELECT doc_id, CASE WHEN len(string_split(f, ' ')) <= 48 THEN f
                          ELSE array_to_string(list_slice(string_split(f, ' '), 1, 48), ' ') || ' ...' END AS summary
      FROM (SELECT doc_id, coalesce({S.sentences('text')}[1], '') AS f FROM documents)""",
    "safe_id": r"""SELECT page_id, regexp_replace(regexp_replace(url, '[^0-9A-Za-z_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS id,
                   left(sha1(url), 12) AS hash FROM pages""",
    "previews": f"""
      SELECT doc_id, left(n, 240) AS preview, CASE WHEN len(n) > 900 THEN rtrim(left(n, 900)) || '...' ELSE n END AS long_preview,
             CASE WHEN len(n) > 180 THEN regexp_replace(left(n, 180), ' [^ ]*$', '') || ' ...' ELSE n END AS cut
      FROM (SELECT doc_id, {_N} AS n FROM documents)""",
    "section_path": f"""WITH n AS (SELECT doc_id, replace(left(coalesce(text, ''), 60), ' ', ' :::  ::: ') AS n FROM documents),
      p AS (SELECT doc_id, n, list_filter(list_transform(string_split(n, ':::'), lambda x: {S.normalize('x')}), lambda x: x <> '') AS p FROM n)
      SELECT doc_id, CASE WHEN len(p) > 0 THEN array_to_string(p, '/') ELSE {S.normalize('n')} END AS path FROM p""",
    "caption_type": "SELECT conv_id, turn, CASE WHEN lower(role || ' ' || text) LIKE 'table%' THEN 'table' WHEN lower(role || ' ' || text) LIKE 'figure%' THEN 'figure' ELSE 'caption' END AS type FROM conversations",
    "token_f1": f"""
      WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
      s AS (SELECT conv_id, turn, list_distinct(string_split(lower({S.normalize('before')}), ' ')) AS a,
                   list_distinct(string_split(lower({S.normalize('text')}), ' ')) AS b,
                   {S.normalize('before')} = '' OR {S.normalize('text')} = '' AS blank FROM p WHERE before IS NOT NULL)
      SELECT conv_id, turn, round(CASE WHEN blank THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM s""",
    "compact_answer": f"""
      SELECT conv_id, coalesce(string_agg(n, '；' ORDER BY turn), '') AS answer
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM (SELECT conv_id, turn, {_N} AS n FROM conversations WHERE {_N} <> ''))
      WHERE r <= 3 GROUP BY conv_id""",
}
