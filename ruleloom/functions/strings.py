"""String similarity and text cleaning.

Functions of columns are built-in expressions wherever those can say it; the
dynamic-programming distances are Arrow-batched pandas UDFs.  A null on either
side gives null.  Shingle functions first make each run of white space one space.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- shingles and set measures: built-in expressions ---------------------------------


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def shingles(c: Column, k: int) -> Column:
    """Every k-character window in order; empty for shorter strings."""
    s = collapse(c)
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substr(s, i, F.lit(k)))).when(s.isNotNull(), F.array().cast("array<string>"))


def profile(c: Column, k: int) -> Column:
    """Map of shingle to count."""
    s = shingles(c, k)
    names = F.array_distinct(s)
    return F.map_from_arrays(names, F.transform(names, lambda x: F.size(F.filter(s, lambda y: y == x))))


def _sizes(a: Column, b: Column, k: int) -> tuple[Column, Column, Column]:
    x, y = F.array_distinct(shingles(a, k)), F.array_distinct(shingles(b, k))
    return F.size(F.array_intersect(x, y)), F.size(x), F.size(y)


def _guard(a: Column, b: Column, equal: Column, short: Column, k: int, value: Column) -> Column:
    out = F.when(a == b, equal).when((F.length(collapse(a)) < k) | (F.length(collapse(b)) < k), short).otherwise(value)
    return F.when(a.isNotNull() & b.isNotNull(), out)


def jaccard(a: Column, b: Column, k: int = 3) -> Column:
    """Similarity of the shingle sets; 0 if a different string is shorter than k."""
    common, x, y = _sizes(a, b, k)
    return _guard(a, b, F.lit(1.0), F.lit(0.0), k, common / (x + y - common))


def sorensen_dice(a: Column, b: Column, k: int = 3) -> Column:
    common, x, y = _sizes(a, b, k)
    return _guard(a, b, F.lit(1.0), F.lit(0.0), k, 2.0 * common / (x + y))


def overlap_coefficient(a: Column, b: Column, k: int = 3) -> Column:
    common, x, y = _sizes(a, b, k)
    return _guard(a, b, F.lit(1.0), F.lit(0.0), k, common / F.least(x, y))


def _counts(names: Column, s: Column) -> Column:
    return F.transform(names, lambda x: F.size(F.filter(s, lambda y: y == x)).cast("double"))


def qgram_distance(a: Column, b: Column, k: int = 3) -> Column:
    """L1 distance of the shingle counts."""
    x, y = shingles(a, k), shingles(b, k)
    names = F.array_union(x, y)
    diff = F.zip_with(_counts(names, x), _counts(names, y), lambda p, q: F.abs(p - q))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, F.lit(0.0)).otherwise(F.aggregate(diff, F.lit(0.0), lambda s, v: s + v)))


def cosine(a: Column, b: Column, k: int = 3) -> Column:
    """Cosine of the shingle counts."""
    x, y = shingles(a, k), shingles(b, k)
    names = F.array_union(x, y)
    p, q = _counts(names, x), _counts(names, y)
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, z: s + z)
    dot = add(F.zip_with(p, q, lambda m, n: m * n))
    return _guard(a, b, F.lit(1.0), F.lit(0.0), k, dot / F.sqrt(add(F.transform(p, lambda m: m * m)) * add(F.transform(q, lambda m: m * m))))


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def normalized_levenshtein(a: Column, b: Column) -> Column:
    """Distance over the longer length; 0 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


# --- distances by dynamic programming: python kernels and their pandas UDFs ------------


def weighted_levenshtein_py(a: str, b: str, sub: Callable[[str, str], float] = lambda x, y: 1.0, ins: Callable[[str], float] = lambda x: 1.0, rem: Callable[[str], float] = lambda x: 1.0) -> float:
    row = [0.0]
    for y in b:
        row.append(row[-1] + ins(y))
    for x in a:
        new = [row[0] + rem(x)]
        for j, y in enumerate(b):
            new.append(min(row[j] + (0.0 if x == y else sub(x, y)), row[j + 1] + rem(x), new[-1] + ins(y)))
        row = new
    return row[-1]


def damerau_py(a: str, b: str) -> float:
    """Unrestricted transpositions (Damerau 1964, Lowrance and Wagner 1975)."""
    far = len(a) + len(b)
    last: dict[str, int] = {}
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            same = a[i - 1] == b[j - 1]
            if same:
                match = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return float(d[len(a), len(b)])


def osa_py(a: str, b: str) -> float:
    """Optimal string alignment: no substring is edited twice."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            best = min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1)
            if i and j and x == b[j - 1] and a[i - 1] == y:
                best = min(best, before[j - 1] + 1)
            new.append(best)
        before, row = row, new
    return float(row[-1])


def lcs_length_py(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def lcs_distance_py(a: str, b: str) -> float:
    return float(len(a) + len(b) - 2 * lcs_length_py(a, b))


def metric_lcs_py(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 0.0 if longest == 0 else 1.0 - lcs_length_py(a, b) / longest


def jaro_winkler_py(a: str, b: str, threshold: float = 0.7) -> float:
    """Similarity; the prefix counts min(0.1, 1 / longer length) a character from ``threshold`` on."""
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    reach = max(len(long) // 2 - 1, 0)
    taken = [False] * len(long)
    hits = []
    for i, x in enumerate(short):
        for j in range(max(i - reach, 0), min(i + reach + 1, len(long))):
            if not taken[j] and long[j] == x:
                taken[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    others = [y for y, t in zip(long, taken, strict=True) if t]
    m, half = len(hits), sum(x != y for x, y in zip(hits, others, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        prefix += 1
    return jaro if jaro < threshold else jaro + min(0.1, 1.0 / len(long)) * prefix * (1 - jaro)


def ngram_py(a: str, b: str, n: int = 2, compat: bool = False) -> float:
    """Normalised n-gram distance (Kondrak 2005); ``compat``: short strings give the share of matches instead.

    Every character stands for the window of n that ends with it.  Windows at the start are filled
    with None, which no text holds; where both have a filler, that place doesn't count.
    """
    if a == b:
        return 0.0
    if not a or not b:
        return 1.0
    if min(len(a), len(b)) < n:
        share = sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b))
        return share if compat else 1.0 - share

    def windows(text: str) -> list[list[str | None]]:
        filled = [*[None] * (n - 1), *text]
        return [filled[i : i + n] for i in range(len(text))]

    def unlike(g: list, h: list) -> float:
        counted = [(x, y) for x, y in zip(g, h, strict=True) if x is not None or y is not None]
        return sum(x != y for x, y in counted) / len(counted)

    others = windows(b)
    reached = [float(j) for j in range(len(b) + 1)]
    for i, g in enumerate(windows(a)):
        replaced = [reached[j] + unlike(g, h) for j, h in enumerate(others)]
        removed = [x + 1 for x in reached[1:]]
        reached = [i + 1.0]
        for x in map(min, replaced, removed):
            reached.append(min(x, reached[-1] + 1))
    return reached[-1] / max(len(a), len(b))


# Sift4 (published by Siderite Zackwehdex): first a scan pairs up equal tokens, then the pairs that
# cross each other are counted, then runs, crossings and lengths make the distance.


def _sift_scan(a: Sequence, b: Sequence, reach: int, same: Callable[[object, object], bool]) -> Iterator[tuple[int, int, bool]]:
    """The pairs of places compared, and whether their tokens are equal.

    Equal tokens are passed together.  After unequal ones, and where one side ends, both sides go on from
    the smaller place; the nearest token within ``reach`` that equals the other side's is gone to.
    """
    i = j = 0
    while True:
        if i >= len(a) or j >= len(b):
            i = j = min(i, j)
            if i >= min(len(a), len(b)):
                return
        equal = same(a[i], b[j])
        yield i, j, equal
        if equal:
            i, j = i + 1, j + 1
            continue
        i = j = min(i, j)
        for step in range(reach):
            if i + step < len(a) and same(a[i + step], b[j]):
                i += step
                break
            if j + step < len(b) and same(a[i], b[j + step]):
                j += step
                break
        else:
            i, j = i + 1, j + 1


def _sift_crossings(pairs: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The pairs that stand against an earlier one's order, each told once.

    Of two that cross, the one with the wider gap between its places is out of order.
    """
    open_: list[tuple[int, int, list[bool]]] = []
    for i, j in pairs:
        told, left = [False], []
        for at, (p, q, before) in enumerate(open_):
            if i <= p or j <= q:
                late = abs(i - j) >= abs(p - q)
                if late or not before[0]:
                    (told if late else before)[0] = True
                    yield i, j
                left += open_[at:]
                break
            if i <= q or j <= p:  # else nothing to come can cross it
                left.append((p, q, before))
        open_ = [*left, (i, j, told)]


def sift_words(text: str) -> list[str]:
    return text.split()


def sift_ngrams(n: int) -> Callable[[str], list[str]]:
    return lambda text: [text[i : i + n] for i in range(len(text) - n + 1)]


def sift_letter_counts(text: str) -> list[int]:
    low = text.lower()
    return [low.count(x) for x in "abcdefghijklmnopqrstuvwxyz"]


def sift_alike(x: str, y: str) -> float:
    """Likeness of two tokens by the distance itself."""
    return 1.0 - sift4_py(x, y) / max(len(x), len(y), 1)


def sift_longer_cost(i: int, j: int) -> float:
    """A crossing costs more the farther it goes."""
    return 1.0 + abs(i - j) / 9


def sift4_py(
    a: str,
    b: str,
    max_offset: int = 5,
    max_distance: int = 0,
    tokens: Callable[[str], Sequence] = list,
    same: Callable[[object, object], bool] = lambda x, y: x == y,
    weight: Callable[[object, object], float] = lambda x, y: 1.0,
    run_value: Callable[[float], float] = lambda n: n,
    crossing_cost: Callable[[int, int], float] = lambda i, j: 1.0,
    kept: Callable[[float, float], float] = lambda runs, crossings: runs - crossings,
) -> float:
    """Sift4: the longer side's length less the common runs, plus the crossings.

    ``max_distance`` (0: none) cuts off: distances from there on are reported as ``max_distance``.
    The callables are the general form: how to cut tokens, which are the same, what an equal pair, a
    run of them and a crossing are worth, and what is kept of runs after crossings.
    """
    x, y = tokens(a), tokens(b)
    longest = max(len(x), len(y))
    if not x or not y:
        return float(longest)
    runs, run, last, pairs = 0.0, 0.0, None, []
    for i, j, equal in _sift_scan(x, y, max_offset, same):
        if last != (i - 1, j - 1) or not equal:
            runs, run = runs + run_value(run), 0.0
        if equal:
            run += weight(x[i], y[j])
            pairs.append((i, j))
            last = (i, j)
    crossed = sum(crossing_cost(i, j) for i, j in _sift_crossings(pairs))
    out = float(round(longest - kept(runs + run_value(run), crossed)))
    return min(out, float(max_distance)) if max_distance else out


def _udf(kernel: Callable[..., float], **fixed):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(kernel(x, y, **fixed)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")


def damerau(a: Column, b: Column) -> Column:
    return _udf(damerau_py)(a, b)


def optimal_string_alignment(a: Column, b: Column, compat: bool = False) -> Column:
    """``compat``: 0 where either string is empty."""
    d = _udf(osa_py)(a, b)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(d) if compat else d


def weighted_levenshtein(a: Column, b: Column, substitute: float = 1.0, insert: float = 1.0, remove: float = 1.0) -> Column:
    return _udf(lambda x, y: weighted_levenshtein_py(x, y, lambda p, q: substitute, lambda p: insert, lambda p: remove))(a, b)


def lcs_distance(a: Column, b: Column) -> Column:
    return _udf(lcs_distance_py)(a, b)


def metric_lcs(a: Column, b: Column) -> Column:
    return _udf(metric_lcs_py)(a, b)


def jaro_winkler(a: Column, b: Column, threshold: float = 0.7) -> Column:
    return _udf(jaro_winkler_py, threshold=threshold)(a, b)


def ngram_distance(a: Column, b: Column, n: int = 2, compat: bool = False) -> Column:
    return _udf(ngram_py, n=n, compat=compat)(a, b)


def sift4(a: Column, b: Column, max_offset: int = 5) -> Column:
    return _udf(sift4_py, max_offset=max_offset)(a, b)


def _edit_kernels(a: pd.Series, b: pd.Series) -> pd.Series:
    """All dynamic-programming measures of a pair at once."""
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        common, longest = lcs_length_py(x, y), max(len(x), len(y), 1)
        out.append([damerau_py(x, y), osa_py(x, y), jaro_winkler_py(x, y), float(len(x) + len(y) - 2 * common), 1.0 - common / longest, ngram_py(x, y), sift4_py(x, y)])
    return pd.Series(out)


def similarity_vector(a: Column, b: Column) -> Column:
    """Sixteen measures of a pair; zeros if either side is null or empty."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    lev = F.levenshtein(a, b) / longest
    # Only unequal, non-empty pairs are worth sending to Python; equal ones have fixed values.
    work = a.isNotNull() & b.isNotNull() & (F.length(a) > 0) & (F.length(b) > 0) & (a != b)
    known = F.pandas_udf(_edit_kernels, "array<double>")(F.when(work, a), F.when(work, b))
    same = F.array(*[F.lit(x) for x in (0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)])
    k = F.coalesce(known, same)
    parts = [F.levenshtein(a, b).cast("double"), lev, 1.0 - lev, k[0], k[1], k[2], 1.0 - k[2], k[3], k[4], k[5], qgram_distance(a, b), cosine(a, b, 2), jaccard(a, b, 2), sorensen_dice(a, b, 2), overlap_coefficient(a, b, 2), k[6]]
    empty = a.isNull() | b.isNull() | (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(empty, F.array_repeat(F.lit(0.0), len(parts))).otherwise(F.array(*[F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts]))


def token_vector(a: Column, b: Column) -> Column:
    """Four measures of a pair of tokens."""
    return F.array(1.0 - normalized_levenshtein(a, b), jaro_winkler(a, b), jaccard(a, b, 2), 1.0 - metric_lcs(a, b))


#: Similarity predicates by name; each takes two columns and gives 0 to 1.
SIMILARITIES: dict[str, Callable[[Column, Column], Column]] = {
    "levenshtein": lambda a, b: 1.0 - normalized_levenshtein(a, b),
    "cosine": cosine,
    "jaro_winkler": jaro_winkler,
    "jaccard": jaccard,
    "dice": sorensen_dice,
    "overlap": overlap_coefficient,
}


def similar(name: str, threshold: float, a: Column, b: Column) -> Column:
    """A similarity predicate from the registry."""
    return F.coalesce(SIMILARITIES[name](a, b) >= threshold, F.lit(False))


# --- cleaning -----------------------------------------------------------------------


def spaced_punctuation(c: Column) -> Column:
    """Lower case, a space around punctuation, ends trimmed, one space between words."""
    return F.trim(collapse(F.regexp_replace(F.lower(c), r"([!-/:-@\[-`{-~])", " $1 ")))


def keep_cjk_alnum(c: Column) -> Column:
    """CJK characters, letters and digits; a symbol stays between two digits."""
    return F.regexp_replace(c, r"(?<![0-9])[^0-9A-Za-z一-龥]|[^0-9A-Za-z一-龥](?![0-9])", "")


def remove_stop_words(c: Column, words: list[str]) -> Column:
    return F.array_join(F.filter(F.split(F.trim(collapse(c)), " "), lambda w: ~w.isin(words)), " ")


def drop_parenthesised(c: Column) -> Column:
    """Without parenthesised text and 11-digit numbers."""
    return F.regexp_replace(F.regexp_replace(c, r"[\(（][^\)）]*[\)）]", ""), r"(?<![0-9])[0-9]{11}(?![0-9])", "")


def cjk_digits(c: Column) -> Column:
    """CJK numerals as digits."""
    return F.translate(c, "零一二三四五六七八九", "0123456789")


def keep_letters_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9A-Za-z]", "")


def letter_digit_runs(c: Column, longest: int = 8) -> Column:
    """Runs of letters and digits joined by ``-``; runs of ``longest`` or more are dropped."""
    runs = F.split(F.trim(F.regexp_replace(c, r"[^0-9A-Za-z]+", " ")), " ")
    return F.array_join(F.filter(runs, lambda w: (F.length(w) > 0) & (F.length(w) < longest)), "-")


def before_keyword(c: Column, keyword: str) -> Column:
    """The letters and digits right before a keyword."""
    return F.regexp_extract(c, rf"([0-9A-Za-z]+){re.escape(keyword)}", 1)


def trailing_alnum(c: Column) -> Column:
    return F.regexp_extract(c, r"([0-9A-Za-z]+)$", 1)


def keyword_features(c: Column, keywords: list[str]) -> Column:
    return F.array(*[before_keyword(c, k) for k in keywords])


def char_ngrams(c: Column, n: int) -> Column:
    return shingles(c, n)


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: F.length(w) > 0)


def is_integer(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[+-]?[0-9]+$"), F.lit(False))


def is_double(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.lit(False))


def is_blank_or_punctuation(c: Column) -> Column:
    """Constants that say nothing: blanks and punctuation only."""
    return F.coalesce(c.rlike(r"^[\s\p{Punct}]*$"), F.lit(True))


def multiset_profile(s: str, k: int) -> Counter:
    """Plain-python profile, for tests and pluggable scorers."""
    s = " ".join(s.split()) if s.strip() else s
    return Counter(s[i : i + k] for i in range(len(s) - k + 1))
