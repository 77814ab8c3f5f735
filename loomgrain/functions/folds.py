"""Plain-Python text rules for the folds that built-in expressions can't state; one document at a time, in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain
from math import ceil, floor, log, sqrt

from loomgrain.functions.text import CJK, LATIN_TOKEN, SYMBOL

SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # as (?U)\s of the expressions; Python's \s has \x1c to \x1f too
_SPACE = re.compile(f"[{SPACE}]+")
_CJK = re.compile(f"[{CJK}]")
_LATIN = re.compile(LATIN_TOKEN)
_SYMBOL = re.compile(SYMBOL)
_MIXED = re.compile(f"{LATIN_TOKEN}|[{CJK}]|[^{SPACE}]")
_BAG = re.compile(f"{LATIN_TOKEN}|[{CJK}]")
_RUN = re.compile(r"\w[\w\-']*")
_TERM = re.compile(r"[a-z][a-z0-9_\-']+")
_SENTENCE = re.compile(f"(?<=[.!?])[{SPACE}]+|(?<=[。！？])[{SPACE}]*")


def normalize(text: str | None) -> str:
    return _SPACE.sub(" ", text or "").strip(" ")


def size(text: str) -> int:
    """The token estimate of normalised text."""
    if not text:
        return 0
    wide = len(_CJK.findall(text))
    rest = _CJK.sub(" ", text) if wide else text
    return max(1, wide + len(_LATIN.findall(rest)) + len(_SYMBOL.findall(rest)))


def join(parts: list[str]) -> str:
    return ("" if any(map(_CJK.search, parts)) else " ").join(parts)


def has_cjk(text: str) -> bool:
    return _CJK.search(text) is not None


def mixed(text: str) -> list[str]:
    """Latin tokens, CJK characters and single other characters."""
    return _MIXED.findall(text)


def windows(text: str, most: int) -> list[str]:
    words = [w for w in _SPACE.split(text) if w]
    if size(text) > most and _CJK.search(text):
        words = _MIXED.findall(text)
    return [join(words[i : i + most]) for i in range(0, len(words), most)]


def packings(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of greedy groups: each reaches as far as the running total allows; what is too large by itself stands alone."""
    totals = [0, *accumulate(sizes)]
    at = 0
    while at < len(sizes):
        to = max(at + 1, bisect_right(totals, totals[at] + most) - 1)
        yield at, to
        at = to


def packed_sentences(text: str, most: int) -> list[str]:
    """Sentences packed greedily; one that is too long by itself is cut into windows."""
    if size(text) <= most:
        return [text] if text else []
    sentences = [s for s in (s.strip(" ") for s in _SENTENCE.split(text)) if s]
    if len(sentences) < 2:
        return windows(text, most)
    sizes = list(map(size, sentences))
    cut = [windows(sentences[a], most) if sizes[a] > most else [join(sentences[a:b])] for a, b in packings(sizes, most)]
    return list(chain.from_iterable(cut))


def sentence_distances(texts: list[str], stop: frozenset[str], most: int) -> list[float] | None:
    """1 - cosine of each text and the next, by TF-IDF over these texts' most frequent terms (idf ln((1+n)/(1+df))+1, unit length); None if no text has a term."""
    found = []
    for text in texts:
        runs = (t.rstrip("-'") for t in _RUN.findall(text.lower()))
        found.append(Counter(t for t in runs if _TERM.fullmatch(t) and t not in stop))
    df = Counter(chain.from_iterable(found))
    if not df:
        return None
    if len(df) > most:
        total = Counter()
        for c in found:
            total.update(c)
        kept = set(sorted(total, key=lambda t: (-total[t], t))[:most])
        found = [Counter({t: n for t, n in c.items() if t in kept}) for c in found]
        df = Counter(chain.from_iterable(found))
    idf = {t: log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    weights = [{t: n * idf[t] for t, n in c.items()} for c in found]
    size = [sqrt(sum(w * w for w in c.values())) for c in weights]
    dots = [sum(w * b[t] for t, w in a.items() if t in b) for a, b in zip(weights, weights[1:])]
    return [1.0 - (dot / (a * b) if dot else 0.0) for dot, a, b in zip(dots, size, size[1:], strict=False)]


def linear_percentile(values: list[float], q: float) -> float:
    """The value at (n - 1) q of the sorted values, between neighbours by proportion."""
    held = sorted(values)
    at = (len(held) - 1) * q
    low, high = floor(at), ceil(at)
    return held[low] if held[low] == held[high] else (high - at) * held[low] + (at - low) * held[high]


def bag(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for token in map(str.lower, _BAG.findall(text)):
        if len(token) > 1 or not token.isascii():
            out[token] = out.get(token, 0) + 1
    return out


def cosine(a: dict[str, int], b: dict[str, int]) -> float:
    """Of two bags, rounded to four places; 0 if one is empty."""
    if not a or not b:
        return 0.0
    dot = sum(n * b.get(t, 0) for t, n in a.items())
    norm = (sum(n * n for n in a.values()) * 1.0) ** 0.5 * (sum(n * n for n in b.values()) * 1.0) ** 0.5
    return round(max(0.0, min(1.0, dot / norm)), 4)
