"""String functions of the chunking and retrieval operators, as JVM-side Column expressions.

Every function takes and returns Columns, so Catalyst can fold, prune and push them.
Token classes are ASCII on purpose: accented words split at the accent, as the data
model's token estimates define it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token classes and word lists that results depend on.
CJK = "\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff"
LATIN_TOKEN = "[A-Za-z0-9_]+(?:[-'][A-Za-z0-9_]+)?"
SYMBOL = "[$€£¥]|[=<>≤≥±×÷]"
QUERY_STOPWORDS = (
    "a an and are as at be by for from how in is it of on or that the this to what when where which who why with"
).split()
QUERY_STOPWORDS_ZH = (
    "一个 一种 一些 以及 可以 我们 他们 这个 这些 进行 没有 不是 就是 因为 所以 如果 什么 怎么 如何 哪些 多少 为什么"
).split()
TAG_STOPWORDS = (
    "the and for with that this from are was were have has into using based paper model method results approach"
).split()
TAG_STOPWORDS_ZH = (
    "一个 一种 一些 以及 可以 我们 他们 这个 这些 进行 没有 不是 就是 因为 所以 如果 的 了 和 是 在 与 及 或 等 年 月 日"
).split()


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a lambda an expression would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(text: Column | str) -> Column:
    """Null becomes empty; runs of Unicode white space become one space; both ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?U)\s+", " "))


def normalize_for_match(text: Column | str) -> Column:
    return F.lower(normalize(text))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def estimate_tokens(text: Column | str) -> Column:
    """Latin tokens + CJK characters + currency and comparison symbols; 0 if blank, else at least 1."""
    t = F.coalesce(_col(text), F.lit(""))
    found = F.size(_all(t, f"{LATIN_TOKEN}|[{CJK}]|{SYMBOL}"))  # no token spans a character of another class
    return F.when(~t.rlike(r"(?U)\S"), F.lit(0)).otherwise(F.greatest(F.lit(1), found)).cast("long")


def word_count(text: Column | str) -> Column:
    """White-space words; 0 for blank text."""
    n = normalize(text)
    return F.when(n == "", F.lit(0)).otherwise(F.size(F.split(n, " "))).cast("long")


def sentences(text: Column | str) -> Column:
    """After . ! ? and white space, or after an ideographic stop; stripped, empties dropped."""
    parts = F.split(normalize(text), r"(?U)(?<=[.!?])\s+|(?<=[。！？])\s*")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")  # F.trim itself would get the index as the characters to trim


def sentences_spaced(text: Column | str) -> Column:
    """As sentences(), but white space is required after every mark."""
    parts = F.split(normalize(text), r"(?U)(?<=[.!?。！？])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def bag_tokens(text: Column | str) -> Column:
    """Lower-cased latin tokens and CJK characters; one-character ASCII tokens dropped; stop words kept."""
    found = _all(F.lower(F.coalesce(_col(text), F.lit(""))), f"{LATIN_TOKEN}|[{CJK}]")
    return F.filter(found, lambda t: ~((F.length(t) == 1) & t.rlike("^[ -~]$")))


def bm25_tokens(text: Column | str) -> Column:
    """The 'mixed' profile: latin tokens or single CJK characters, lower-cased, less English stop words."""
    found = F.transform(_all(F.coalesce(_col(text), F.lit("")), f"{LATIN_TOKEN}|[{CJK}]"), F.lower)
    return F.filter(found, lambda t: ~t.isin(QUERY_STOPWORDS))


def cjk_tokens(text: Column | str, most: int = 3) -> Column:
    """Latin tokens and the 2..most-grams of every CJK span; shorter spans stay whole."""
    t = F.coalesce(_col(text), F.lit(""))
    latin = F.transform(_all(t, LATIN_TOKEN), F.lower)
    spans = _all(t, f"[{CJK}]+")

    def grams(span: Column) -> Column:
        sizes = F.sequence(F.lit(2), F.least(F.lit(most), F.length(span)))
        each = F.transform(
            sizes,
            lambda k: F.transform(F.sequence(F.lit(1), F.length(span) - k + 1), lambda i: F.substring(span, i, k)),
        )
        return F.when(F.length(span) < 2, F.array(span)).otherwise(F.flatten(each))

    every = F.concat(latin, F.flatten(F.transform(spans, grams)))
    stop = QUERY_STOPWORDS + QUERY_STOPWORDS_ZH
    return F.filter(every, lambda w: ~w.isin(stop) & ~((F.length(w) == 1) & ~w.rlike(f"[{CJK}]")))


def tokens(text: Column | str, profile: str = "mixed") -> Column:
    """Tokens by profile name; an unknown profile is an error. ('jieba' is a table function: with_tokens.)"""
    makers = {"mixed": bm25_tokens, "cjk_bigram": cjk_tokens, "cjk_2_4gram": lambda t: cjk_tokens(t, 4)}
    if profile not in makers:
        raise ValueError(f"unknown tokenizer profile {profile!r}; known: {', '.join(sorted(makers))}")
    return makers[profile](text)


def with_tokens(rows: DataFrame, profile: str = "mixed") -> DataFrame:
    """rows (with text) and their tokens under the profile; 'jieba' needs a segmenter and falls back to bigrams without it."""
    if profile != "jieba":
        return rows.withColumn("tokens", tokens("text", profile))
    try:
        import jieba  # noqa: F401
    except ImportError:
        return rows.withColumn("tokens", cjk_tokens("text"))
    return rows.withColumn("tokens", F.pandas_udf(_segmented, "array<string>")("text"))


def _segmented(texts):
    """Segmented words of two characters or more, with the 2- and 3-grams of each CJK word; latin tokens as they are."""
    import re

    import jieba

    latin, span = re.compile(LATIN_TOKEN), re.compile(f"[{CJK}]+")
    stop = {*QUERY_STOPWORDS, *QUERY_STOPWORDS_ZH}

    def cut(text: str | None) -> list[str]:
        found: list[str] = []
        for word in (w.strip().lower() for w in jieba.lcut(text or "", cut_all=False)):
            if latin.fullmatch(word):
                found.append(word)
            elif span.fullmatch(word):
                grams = [word[i : i + n] for n in (2, 3) for i in range(len(word) - n + 1)]
                found += [word, *grams] if len(word) > 1 else [word]
        return [w for w in found if w not in stop and (len(w) > 1 or span.fullmatch(w))]

    return texts.map(cut)


def join_pieces(pieces: Column) -> Column:
    """With spaces, or without any where a piece holds a CJK character."""
    cjk = F.exists(pieces, lambda p: p.rlike(f"[{CJK}]"))
    return F.when(cjk, F.array_join(pieces, "")).otherwise(F.array_join(pieces, " "))


def word_windows(text: Column | str, most: int, overlap: int = 0) -> Column:
    """Windows of most words that step by most - overlap and stop with the one that reaches the end.

    White-space words; of text that is over-long in tokens and holds CJK, single tokens.
    """
    t = normalize(text)
    mixed = _all(t, f"{LATIN_TOKEN}|[{CJK}]|[^\\s]")
    over = estimate_tokens(t) > most
    words = F.when(over & t.rlike(f"[{CJK}]"), mixed).otherwise(F.split(t, " "))
    step = max(1, most - max(0, overlap))


    def cut(held: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(held) - most) / step)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: join_pieces(F.slice(held, i * step + 1, most)))

    windows = let(words, cut)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(windows)


def block_text(text: Column, title_path: Column, titled: bool) -> Column:
    """Normalised text, led by [A > B] unless that title is in its first 120 characters already."""
    t = normalize(text)
    if not titled:
        return t
    title = F.array_join(title_path, " > ")
    known = F.instr(F.lower(F.substring(t, 1, 120)), F.lower(title)) > 0
    return F.when((F.coalesce(F.size(title_path), F.lit(0)) > 0) & (title != "") & ~known, F.concat(F.lit("["), title, F.lit("] "), t)).otherwise(t)


def summary(text: Column | str, most: int = 48) -> Column:
    """First sentence, cut to most words with an ellipsis."""
    first = F.coalesce(F.get(sentences(text), F.lit(0)), F.lit(""))
    words = F.split(first, " ")
    return F.when(F.size(words) <= most, first).otherwise(F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit(" ...")))


def preview(text: Column | str, size: int = 240) -> Column:
    return F.substring(normalize(text), 1, size)


def ellipsis_preview(text: Column | str, size: int = 900) -> Column:
    t = normalize(text)
    return F.when(F.length(t) > size, F.concat(F.rtrim(F.substring(t, 1, size)), F.lit("..."))).otherwise(t)


def cut_at_word(text: Column | str, size: int) -> Column:
    t = normalize(text)
    return F.when(F.length(t) > size, F.concat(F.regexp_replace(F.substring(t, 1, size), " [^ ]*$", ""), F.lit(" ..."))).otherwise(t)


def safe_id(text: Column | str) -> Column:
    """Runs of characters outside 0-9 A-Z a-z _ . - become one underscore; outer underscores go."""
    return F.regexp_replace(F.regexp_replace(_col(text), "[^0-9A-Za-z_.-]+", "_"), "^_+|_+$", "")


def safe_id_or_hash(text: Column | str) -> Column:
    """safe_id; an id of which nothing is left becomes the hash of the empty text."""
    found = safe_id(F.coalesce(_col(text), F.lit("")))
    return F.when(found != "", found).otherwise(stable_hash(F.lit("")))


def stable_hash(text: Column | str) -> Column:
    return F.substring(F.sha1(_col(text).cast("binary")), 1, 12)


def token_f1(left: Column, right: Column) -> Column:
    """F1 of the sets of white-space words of two texts, case-insensitive."""
    a = F.array_distinct(F.split(normalize_for_match(left), " "))
    b = F.array_distinct(F.split(normalize_for_match(right), " "))
    shared = F.size(F.array_intersect(a, b))
    blank = (normalize(left) == "") | (normalize(right) == "")
    return F.when(blank | (shared == 0), F.lit(0.0)).otherwise(2.0 * shared / (F.size(a) + F.size(b)))


def section_path(name: Column | str) -> Column:
    """Parts between ::: normalised, empties dropped; the whole name if nothing is left."""
    parts = F.filter(F.transform(F.split(_col(name), ":::"), normalize), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(normalize(name)))


def caption_type(caption: Column | str) -> Column:
    c = F.lower(normalize(caption))
    return F.when(c.startswith("table"), "table").when(c.startswith("figure"), "figure").otherwise("caption")


def compact_answer(answers: Column | str) -> Column:
    """The first three non-empty answers, joined by a full-width semicolon."""
    kept = F.filter(F.transform(_col(answers), normalize), lambda x: x != "")
    return F.array_join(F.slice(kept, 1, 3), "；")


# Characters stripped from tags, the entity pattern, and headings that are no entities.
TAG_STRIP = " \\t\\r\\n,，.;；:：!?！？()\\[\\]{}<>《》【】\"'“”‘’"
ENTITY = r"\b(?:[A-Z]{2,}[A-Za-z0-9+\-]*|[A-Z][A-Za-z0-9+\-]{2,}(?:\s+[A-Z][A-Za-z0-9+\-]{2,}){0,3})\b"
NO_ENTITIES = (
    "Abstract|Introduction|Related Work|Proposed Method|Experiments|Conclusion|Appendices|Acknowledgments"
    "|BIBREF|FIGREF|TABREF|SECREF|FLOAT|SELECTED"
).split("|")


def normalize_tag(tag: Column | str) -> Column:
    """Outer punctuation stripped, lower-cased unless CJK; empty for stop words, bare punctuation and single CJK characters."""
    t = F.regexp_replace(F.regexp_replace(normalize(tag), f"^[{TAG_STRIP}]+", ""), f"[{TAG_STRIP}]+$", "")
    drop = (
        F.lower(t).isin(TAG_STOPWORDS) | t.isin(TAG_STOPWORDS_ZH) | t.rlike(f"^[{CJK}]$") | t.rlike(r"(?U)^[\W_]*$")
    )
    return F.when(drop, F.lit("")).when(t.rlike(f"[{CJK}]"), t).otherwise(F.lower(t))


def entities(text: Column | str) -> Column:
    """Capitalised phrases and acronyms in order, less headings and reference marks."""
    found = F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(f"(?U)({ENTITY})"), F.lit(1)), normalize)
    return F.filter(found, lambda e: (e != "") & ~e.isin(NO_ENTITIES) & ~e.rlike("^(BIBREF|FIGREF|TABREF|SECREF)"))


def common_path(paths: Column) -> Column:
    """Longest common prefix of the non-empty paths, else the first four distinct first elements."""
    held = F.filter(paths, lambda p: F.size(p) > 0)

    def shared(a: Column, b: Column) -> Column:
        n = F.least(F.size(a), F.size(b))
        differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
        return F.slice(a, 1, F.when(n <= 0, 0).when(F.size(differ) > 0, differ[0] - 1).otherwise(n))

    prefix = F.aggregate(held, F.get(held, F.lit(0)), shared)
    tops = F.slice(F.array_distinct(F.transform(held, lambda p: p[0])), 1, 4)
    empty = F.array().cast("array<string>")
    return F.when(F.size(held) == 0, empty).when(F.size(prefix) > 0, prefix).otherwise(tops)


def runs(words: Column) -> Column:
    """Each different word with its count n and its first place p (from 0), in order of words: one sort, and a walk over the ends of runs."""
    sorted_ = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))

    def cut(held: Column) -> Column:
        size = F.size(held)
        at = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(at, lambda i: (i == 0) | (F.get(held, i)["w"] != F.get(held, i - 1)["w"]))

        def counted(s: Column) -> Column:
            return F.transform(
                s, lambda i, j: F.struct(F.get(held, i)["w"].alias("w"), (F.coalesce(F.get(s, j + 1), size) - i).alias("n"), F.get(held, i)["p"].alias("p"))
            )

        return let(starts, counted)

    return let(sorted_, cut)


def frequent(words: Column, most: int) -> Column:
    """The most frequent words; ties go to the one met first."""
    ranked = F.transform(runs(words), lambda r: F.struct((-r["n"]).alias("n"), r["p"].alias("p"), r["w"].alias("w")))
    return F.transform(F.slice(F.array_sort(ranked), 1, most), lambda s: s["w"])


def nearest_rank(values: Column, q: float) -> Column:
    """The value at index round-half-even((n - 1) q) of the sorted values; 0 for none."""
    at = F.bround((F.size(values) - 1) * F.lit(q), 0).cast("int")
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.get(F.sort_array(values), at).cast("double"))
