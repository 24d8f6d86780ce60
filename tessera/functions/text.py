"""Text functions: tokens, templates, tags and normal forms, as built-in expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import col

CJK = r"㐀-鿿"


def regexp_all(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0))


def let(value: Column, f) -> Column:
    """f(value) with value computed once: a lambda that named the expression would compute it for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def windows(values: Column, n: int) -> Column:
    """Each n neighbours of an array of strings, joined by spaces."""

    def of(t: Column) -> Column:
        joined = F.transform(F.slice(t, F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, *[F.get(t, i + k) for k in range(1, n)]))
        return joined

    return let(values, of)


def bigrams(c: Column) -> Column:
    """Adjacent two-character strings."""
    return let(c, lambda v: F.when(F.length(v) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(v) - 1), lambda i: F.substring(v, i, F.lit(2)))))


def lexical_tokens(c: Column | str) -> Column:
    """Lower-cased ASCII words; of CJK runs each character and each adjacent pair."""
    words = F.transform(regexp_all(c, r"[A-Za-z0-9_]+"), F.lower)
    runs = regexp_all(c, rf"[A-Za-z0-9_]+|[{CJK}]+")
    chars = lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(1)))
    mixed = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]"), F.concat(chars(r), bigrams(r))).otherwise(F.array(F.lower(r)))))
    # texts without such characters, most of them, need no look at each run
    return F.when(col(c).rlike(f"[{CJK}]"), mixed).otherwise(words)


def term_bigrams(c: Column | str) -> Column:
    """Distinct character pairs of what is left without non-word characters."""
    return F.array_distinct(bigrams(F.regexp_replace(col(c), r"(?U)\W+", "")))


def word_tokens(c: Column | str) -> Column:
    """Lower-cased words and single other signs."""
    return regexp_all(F.lower(col(c)), r"(?U)\w+|[^\w\s]")


def token_shingles(c: Column | str, n: int = 3) -> Column:
    """Distinct n-tuples of ``word_tokens``, joined by spaces."""
    return F.array_distinct(windows(word_tokens(c), n))


#: Characters that compatibility forms leave as they are, so that texts of them alone need no Python: ASCII, Latin letters with marks, common ideographs.
_STABLE = r"\x00-\x7F\u00A1\u00AB\u00BB\u00BF\u00C0-\u0131\u4E00-\u9FFF"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t and unicodedata.normalize("NFKC", t))


def nfkc(c: Column | str) -> Column:
    """Compatibility forms folded; only texts that hold a character which may change are handed to Python."""
    value = col(c)
    return F.coalesce(_nfkc(F.when(value.rlike(f"[^{_STABLE}]"), value)), value)


def meaningful(c: Column | str) -> Column:
    """ASCII letters, digits and CJK characters alone, after ``nfkc``."""
    return F.regexp_replace(nfkc(c), rf"[^A-Za-z0-9{CJK}]", "")


def template(c: Column | str) -> Column:
    """What is alike in texts that differ by numbers and signs: ``nfkc``, lower case, meaningful characters, digit runs dropped, one # at the end if there were any digits or #."""
    low = F.regexp_replace(F.lower(nfkc(c)), r"(?U)\d", "#")
    body = F.regexp_replace(low, rf"[^a-z0-9{CJK}]", "")
    return F.concat(body, F.when(F.contains(low, F.lit("#")), F.lit("#")).otherwise(F.lit("")))


def last_match(c: Column | str, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def tags(c: Column | str, patterns: dict[str, str]) -> Column:
    """Sorted names of the patterns that occur."""
    return F.array_sort(F.array_compact(F.array(*[F.when(col(c).rlike(p), F.lit(n)) for n, p in patterns.items()])))


@F.pandas_udf(T.StringType())
def _normal(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = unicodedata.normalize("NFKC", t).replace("\r\n", "\n").replace("\r", "\n")
        t = "".join(x for x in t if x in "\n\t" or unicodedata.category(x)[0] != "C")
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()

    return texts.map(one)


def normalized(c: Column | str) -> Column:
    """NFKC, newlines as \\n, control characters dropped, blanks squeezed, two newlines at most, trimmed; null as empty.

    Texts of stable characters alone stay in expressions, the others are handed to Python.
    """
    value = F.coalesce(col(c), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(value, r"\r\n?", "\n"), r"[\x00-\x08\x0B-\x1F\x7F]", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[ \t]{2,}|\t", " "), r"\n{3,}", "\n\n")  # a single blank stays as it is
    return F.coalesce(_normal(F.when(value.rlike(f"[^{_STABLE}]"), value)), F.btrim(plain, F.lit(" \n\t")))


def masked_text(c: Column | str, most: int | None = None) -> Column:
    """The text with the values of bearer, key, token, password and secret masked, quoted ones too; ``most`` cuts it for display."""
    whole = col(c) if most is None else F.substring(col(c), 1, most)
    return F.regexp_replace(whole, r"""(?iU)(bearer\s+|(?:api[_-]?key|token|password|secret)["']?\s*[:=]\s*["']?)[^\s,;"'}]+""", "$1[REDACTED]")
