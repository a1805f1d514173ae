"""Quality rules: a table of thresholds compiled into one Spark projection.

Measures are plain column expressions over the words and lines of a text;
``RULES`` names a measure, a bound and a direction; ``compile_rules`` turns
any such table into one Boolean expression plus the name of the first rule
that failed. No user functions, no shuffle: the plan is scan → project.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import fresh, words_of

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Function words of the corpus languages, lower case (fixed values).
STOP_WORDS = (
    "a an and are as at be by for from in is it not of on or that the this to was with "
    "das der die den ein eine in ist mit nicht sich und von zu "
    "au avec dans de des du elle en est et la le les par pas pour que qui sur un une "
    "con de del el en es la las lo los no para por que se su un una y"
)


class Rule(NamedTuple):
    """``measure`` must be at least (``least``) or at most (``most``) a bound."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The production table. Ratios are per word or per line.
RULES = (
    Rule("words", "n_words", least=MIN_WORDS),
    Rule("repeated_windows", "repeat_ratio", most=MAX_REPEAT_PERCENT / 100),
    Rule("word_length", "mean_word_chars", least=1.5, most=25.0),
    Rule("symbols", "symbol_ratio", most=0.5),
    Rule("stop_words", "stop_ratio", least=0.01),
    Rule("repeated_lines", "dup_line_ratio", most=0.7),
)


def repeated_window_words(words: Column, n: int = WINDOW_WORDS) -> Column:
    """Number of words inside n-word windows that occur twice or more in the
    text, every occurrence counted, the first included.

    Windows are 64-bit hashes. A text whose windows all differ (one hash set,
    no sort) answers 0; otherwise (hash, position) pairs are sorted, those
    equal to a neighbour kept, and the covered length summed over the sorted
    positions. O(w log w) for w words.
    """
    count = F.size(words)
    hashes = F.when(count >= n, F.transform(F.sequence(F.lit(1), count - (n - 1)),
                                            lambda i: F.xxhash64(F.slice(words, i, n)))
                    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def repeats(s: Column) -> Column:
            return F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - x, F.lit(n))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, s: a + s)

        pos = _bind(_bind(pairs, repeats), lambda r: F.sort_array(F.transform(r, lambda x: x["p"])))
        return _bind(pos, length)

    return _bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint"))
                 .otherwise(covered(h)))


def _bind(value: Column, f) -> Column:
    """``f`` of ``value`` computed once: a one-element array and a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def measures(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with a words and a lines column, and the measures over them."""
    ws = fresh(df.columns, "words_")
    out = df.withColumn(ws, words_of(F.col(text_col)))
    ln = fresh(out.columns, "lines_")
    out = out.withColumn(ln, F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"),
                                      lambda x: F.regexp_like(x, F.lit("[^ \\t-\\r]"))))
    w, lines = F.col(ws), F.col(ln)
    stops = sorted(set(STOP_WORDS.split()))
    base = {
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("bigint"),
        "n_symbols": F.coalesce(F.regexp_count(F.col(text_col), F.lit("[#*$%&|<>]")), F.lit(0)).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": repeated_window_words(w),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(stops))).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
    }
    names = {}
    for name in base:
        names[name] = fresh([*out.columns, *names.values()], name)
    out = out.select("*", *[c.alias(names[k]) for k, c in base.items()])
    col = {k: F.col(v) for k, v in names.items()}

    def ratio(a: str, b: str) -> Column:
        return F.when(col[b] > 0, col[a] / col[b]).otherwise(F.lit(0.0))

    return out.drop(ws, ln), col | {
        "mean_word_chars": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_ratio": ratio("n_stop_words", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
    }


def compile_rules(rules, col: dict[str, Column]) -> Column:
    """Name of the first rule that the row breaks, null if none."""
    tests = []
    for r in rules:
        m = col[r.measure]
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (m < r.least)
        if r.most is not None:
            bad = bad | (m > r.most)
        tests.append(F.when(bad, F.lit(r.name)))
    return F.coalesce(*tests, F.lit(None).cast("string"))


def quality_report(df: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the measures, ``base_failed``, ``kept`` and ``failed_rule``.

    Null and empty texts have no words: every count is 0, ``base_failed`` is
    true. Rows are judged one by one, so repeated rows, ties, null ids, empty
    tables and extra columns (not returned) need nothing special.
    """
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out, col = measures(src)
    base_failed = (col["n_words"] < MIN_WORDS) | (100 * col["n_repeat_words"] > MAX_REPEAT_PERCENT * col["n_words"])
    failed = compile_rules(rules, col)
    return out.select(
        "doc_id", *[col[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed.alias("base_failed"), (~base_failed & failed.isNull()).alias("kept"),
        F.when(base_failed & failed.isNull(), F.lit("base")).otherwise(failed).alias("failed_rule"))


def quality_filter(df: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that break no rule, with their own columns."""
    out, col = measures(df, text_col)
    return out.where(compile_rules(rules, col).isNull()).select(*df.columns)
