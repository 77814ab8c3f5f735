"""SQL fragments that the DuckDB checks share."""

from __future__ import annotations

from loomgrain.functions.text import QUERY_STOPWORDS

CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
LATIN = "[A-Za-z0-9_]+(?:[-''][A-Za-z0-9_]+)?"
STOP = ", ".join(f"'{w}'" for w in QUERY_STOPWORDS)


def normalize(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))"


def bm25_tokens(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), '{LATIN}|[{CJK}]'), lambda w: lower(w)),"
        f" lambda w: w NOT IN ({STOP}))"
    )


def tokens(x: str) -> str:
    latin = f"len(regexp_extract_all(regexp_replace({x}, '[{CJK}]', ' ', 'g'), '{LATIN}'))"
    more = f"len(regexp_extract_all({x}, '[{CJK}]')) + len(regexp_extract_all({x}, '[$€£¥]|[=<>≤≥±×÷]'))"
    return f"(CASE WHEN {normalize(x)} = '' THEN 0 ELSE greatest(1, {latin} + {more}) END)"


def bag(x: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '{LATIN}|[{CJK}]'),"
        " lambda w: NOT (len(w) = 1 AND regexp_matches(w, '^[ -~]$')))"
    )


def sentences(x: str) -> str:
    marked = rf"regexp_replace(regexp_replace({normalize(x)}, '([.!?])\s+', '\1' || chr(1), 'g'), '([。！？])\s*', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"
