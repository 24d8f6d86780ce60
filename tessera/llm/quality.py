"""Quality rules as learned decision lists, built from DataFrame functions only.

Statistics of a text are columns; a decision list is an ordered ``CASE WHEN`` over
thresholds on them.  Lists are learned by sequential covering: a rule is grown by
adding the threshold condition of highest information gain, pruned on rows kept
apart, accepted if it is precise there, and the rows it covers go before the next
rule grows.  Learning sees the statistics of at most ``SAMPLE`` labelled rows, the
ones with the lowest hash of their id among those whose id stands in one row; this bound is its only use of a sample, and
every statistic and verdict covers all rows and whole texts.

Main path: built-in expressions alone, one scan, no shuffle.  Windows of five words
are compared by 64-bit hash within one text: sorted as numbers that carry hash
bits above the position, so equal windows stand side by side, and the full hashes
of neighbours are compared too.

Defined results: null and empty texts have no words, hence fail the base rule; null
ids are kept as rows; repeated rows get the same verdict; labels without a document
or without a verdict are unused, of several labels of an id the lowest counts; no
labels at all, or of one class only, give an empty list, so the base rule decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import labelled_ids, table

#: Labelled rows that learning sees, at most.
SAMPLE = 20_000
SPACE = " \t\n\x0b\f\r"


def _dropped(text: Column, chars: str) -> Column:
    """Code points of the text that belong to a character class."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{chars}+", ""))).cast("long")


def with_statistics(df: DataFrame, text: str) -> DataFrame:
    """``df`` plus the columns of ``COUNTS``, which replace columns of these names; on the way the row is carried as a struct, so no name clashes."""
    keep = [c for c in df.columns if c not in COUNTS]
    trimmed = F.btrim(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(SPACE))
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), trimmed.alias("__t"), raw.alias("__raw"))
    out = out.withColumns({"__w": F.when(F.col("__t") == "", F.array().cast("array<string>")).otherwise(F.split("__t", r"[ \t-\r]+")), "__l": F.expr(r"filter(split(__raw, '\n'), l -> btrim(l, ' \t\u000b\f\r') <> '')")})
    out = out.withColumns({"n_words": F.size("__w").cast("long"), "__h": F.expr("transform(slice(__w, 1, greatest(size(__w) - 4, 0)), (w, i) -> xxhash64(w, get(__w, i + 1), get(__w, i + 2), get(__w, i + 3), get(__w, i + 4)))")})
    out = out.withColumn("__b", F.length(F.bin("n_words")).cast("int"))
    out = out.withColumn("__k", F.expr("CASE WHEN size(array_distinct(__h)) < size(__h) THEN sort_array(transform(__h, (h, i) -> shiftleft(h, __b) | i)) ELSE cast(array() AS array<bigint>) END"))
    same = "(shiftright(get(__k, i {0} 1), __b) = shiftright(k, __b) AND get(__h, cast(get(__k, i {0} 1) & (shiftleft(1L, __b) - 1) AS int)) = get(__h, cast(k & (shiftleft(1L, __b) - 1) AS int)))"
    out = out.withColumn("__p", F.expr(f"sort_array(transform(filter(__k, (k, i) -> coalesce({same.format('-')}, false) OR coalesce({same.format('+')}, false)), k -> k & (shiftleft(1L, __b) - 1)))"))
    out = out.withColumns(
        {
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": _dropped(F.col("__raw"), "[#*$%&|<>]"),
            "n_upper": _dropped(F.col("__raw"), r"\p{Lu}"),
            "n_marks": _dropped(F.col("__raw"), "[!?]"),
            "n_digits": _dropped(F.col("__raw"), "[0-9]"),
            "n_lines": F.size("__l").cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_distinct": F.size(F.array_distinct("__w")).cast("long"),
            "n_repeat_words": F.expr("CASE WHEN size(__p) = 0 THEN 0L ELSE aggregate(sequence(0, size(__p) - 1), 0L, (a, i) -> a + least(5L, coalesce(get(__p, i + 1) - get(__p, i), 5L))) END"),
        }
    )
    return out.select(*[F.col("__row")[c].alias(c) for c in keep], *COUNTS)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_digits", "n_lines", "n_dup_lines", "n_distinct", "n_repeat_words")
#: What rules may test, as SQL over the counts; shares are 0 where there is nothing to share.
STATISTICS = {
    "n_words": "cast(n_words AS double)",
    "mean_word": "coalesce(try_divide(word_chars, n_words), 0)",
    "symbols_per_word": "coalesce(try_divide(n_symbols, n_words), 0)",
    "upper_share": "coalesce(try_divide(n_upper, word_chars), 0)",
    "marks_per_word": "coalesce(try_divide(n_marks, n_words), 0)",
    "digit_share": "coalesce(try_divide(n_digits, word_chars), 0)",
    "dup_line_share": "coalesce(try_divide(n_dup_lines, n_lines), 0)",
    "distinct_share": "coalesce(try_divide(n_distinct, n_words), 0)",
    "repeat_share": "coalesce(try_divide(n_repeat_words, n_words), 0)",
    "words_per_line": "coalesce(try_divide(n_words, n_lines), 0)",
}
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


@dataclass(frozen=True)
class Rule:
    """Rows that meet every condition (statistic, at least?, threshold) are rejected."""

    conditions: tuple[tuple[str, bool, float], ...]

    def sql(self) -> str:
        return " AND ".join(f"{STATISTICS[name]} {'>=' if above else '<='} {float(bound)!r}D" for name, above, bound in self.conditions)


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds rejects, and rows that none covers are kept."""

    rules: tuple[Rule, ...]

    def rejected(self) -> Column:
        if not self.rules:
            return F.lit(False)
        chain = " ".join(f"WHEN {r.sql()} THEN true" for r in self.rules)
        return F.expr(f"CASE {chain} ELSE false END")


def _holds(x: np.ndarray, names: list[str], conditions: list[tuple[str, bool, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, bound in conditions:
        v = x[:, names.index(name)]
        out &= v >= bound if above else v <= bound
    return out


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """Information that a condition gains about the rows to be rejected."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], most: int) -> list[tuple[str, bool, float]]:
    conditions: list[tuple[str, bool, float]] = []
    inside = np.ones(len(x), bool)
    while len(conditions) < most and bad[inside].any() and not bad[inside].all():
        best: tuple[float, tuple[str, bool, float] | None] = (1e-9, None)
        xs, ys = x[inside], bad[inside]
        p0, n0 = int(ys.sum()), int((~ys).sum())
        for j, name in enumerate(names):
            order = np.argsort(xs[:, j], kind="stable")
            v, y = xs[order, j], ys[order]
            cuts = np.flatnonzero(v[1:] > v[:-1]) + 1  # the first row above each cut
            if not len(cuts):
                continue
            p, n = np.cumsum(y)[cuts - 1], np.cumsum(~y)[cuts - 1]
            middle = (v[cuts] + v[cuts - 1]) / 2
            for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                g = _gain(a, b, p0, n0)
                k = int(np.argmax(g))
                if g[k] > best[0]:
                    best = (float(g[k]), (name, above, float(middle[k])))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= _holds(x, names, [best[1]])
    return conditions


def learn(x: np.ndarray, bad: np.ndarray, hold: np.ndarray, names: list[str], precision: float = 0.9, least: int = 5, most_rules: int = 16, most_conditions: int = 4) -> DecisionList:
    """Sequential covering. x: a row of statistics for each label; bad: to be rejected; hold: rows kept apart for pruning."""
    rules: list[Rule] = []
    grow, prune = ~hold, hold.copy()
    for _ in range(most_rules):
        if bad[grow].sum() < least:
            break
        conditions = _grow(x[grow], bad[grow], names, most_conditions)

        def worth(k: int, conditions=conditions) -> float:
            inside = _holds(x, names, conditions[:k]) & prune
            p, n = int(bad[inside].sum()), int((~bad)[inside].sum())
            return (p - n) / (p + n) if p + n else -1.0

        if not conditions:
            break
        kept = max(range(1, len(conditions) + 1), key=lambda k: (worth(k), -k))
        conditions = conditions[:kept]
        inside = _holds(x, names, conditions)
        for part, enough in ((inside & prune, 2), (inside & grow, least)):
            p, n = int(bad[part].sum()), int((~bad)[part].sum())
            if p < enough or p < precision * (p + n):
                return DecisionList(tuple(rules))
        rules.append(Rule(tuple(conditions)))
        grow, prune = grow & ~inside, prune & ~inside
    return DecisionList(tuple(rules))


def learn_from(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> DecisionList:
    """A decision list from the documents that ``labels`` covers (label 0: to be rejected), ``sample`` of them at most."""
    known = labelled_ids(docs, labels, key, label, False, sample, 5)
    # `sample` ids of eight bytes each: the side that is broadcast has a proven bound.
    rows = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__text")).join(F.broadcast(known), "__id")
    stats = with_statistics(rows, "__text").select("__o", "__y", F.expr(BASE_FAILED).alias("__failed"), *[F.expr(sql).alias(f"s_{name}") for name, sql in STATISTICS.items()])
    found = stats.orderBy("__o", *[f"s_{n}" for n in STATISTICS]).limit(sample).collect()
    names = list(STATISTICS)
    # Base rules have their own verdict; the list learns what they leave.
    found = [r for r in found if not r["__failed"]]
    if not found:
        return DecisionList(())
    x = np.array([[r[f"s_{n}"] for n in names] for r in found], float)
    bad = np.array([r["__y"] == 0 for r in found])
    hold = np.array([r["__o"] % 3 == 0 for r in found])
    return learn(x, bad, hold, names)


def judge(df: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """``df`` plus the counts, base_failed and kept, which replace columns of these names."""
    named = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("base_failed", "kept")])
    return with_statistics(named, text).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & ~rules.rejected())


def keep_good(df: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with its own columns.

    Rows go by a generator: a filter would be pushed below the statistics and each of
    its references would then compute them anew.
    """
    judged = judge(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(f"`{text}`").alias("__text")), rules, "__text")
    chosen = judged.select("__row", F.explode(F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))).alias("__one"))
    return chosen.select("__row.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict for every whole text of ``documents``; the list is learned from ``labels.quality``."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rules = learn_from(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
