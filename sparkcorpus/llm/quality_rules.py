"""Quality rules: a table of thresholds compiled into one projection of text statistics.

Everything is built-in SQL functions over one row at a time: no shuffle, no Python.

Edge cases: a null text counts as a text without words (counts and ratios 0, so the base length rule fails). A very long
text is counted whole, in n log n. A value on a threshold passes. Rows are
judged alone, so ties and repeated rows change nothing. Other columns are kept untouched; the statistics live in one
struct column. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_words

#: Frequent words of four languages. Fixed values.
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from or an not "
    "der die und in den von zu das sich mit des auf für ist im nicht dem ein eine als "
    "de la le et les en des un du une que est pour par dans avec qui pas sur au "
    "de la que el en y los las se del un por con no una su para es al lo"
)


@dataclass(frozen=True)
class Rule:
    """A document fails if `metric` is below `least` or above `most`."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


COUNTS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word_chars", "symbol_word_ratio", "stop_word_ratio", "dup_line_ratio", "repeat_word_ratio", "upper_ratio")

#: Fixed by the query's contract: too few words, or over half of them in repeated 3-word windows.
BASE_RULES = (Rule("base_length", "n_words", least=50), Rule("base_repeats", "repeat_word_ratio", most=0.5))
#: The method's own thresholds.
RULES = (
    Rule("word_length", "mean_word_chars", least=2.0, most=16.0),
    Rule("symbols", "symbol_word_ratio", most=0.25),
    Rule("stop_words", "stop_word_ratio", least=0.02),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
    Rule("upper_case", "upper_ratio", most=0.5),
)


def fails(rules: Iterable[Rule], of: Column) -> Column:
    """The rules compiled to one boolean expression over a statistics struct."""
    tests = [of[r.metric] < r.least for r in rules if r.least is not None] + [of[r.metric] > r.most for r in rules if r.most is not None]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def failed_names(rules: Iterable[Rule], of: Column) -> Column:
    """Names of the rules that a document fails, in table order."""
    return F.array_compact(F.array(*(F.when(fails([r], of), r.name) for r in rules)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where the optimizer moves or copies the whole expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column) -> Column:
    """64-bit hash of the three words from each position on."""
    whole = F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 2))
    return F.transform(whole, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def _repeated(hashes: Column) -> Column:
    """Sorted positions of the hashes that occur twice or more.

    Numbers sort much faster than pairs, so the last bits of each hash give way to its position. Where that puts different
    hashes beside each other, which is rare, pairs are sorted.
    """
    no = F.lit(False)

    def place(x: Column, bits: Column) -> Column:
        return F.call_function("shiftrightunsigned", x, bits)

    def numbered(bits: Column) -> Column:
        cleared = lambda h: F.call_function("shiftleft", place(h, bits), bits)
        sorted_numbers = F.sort_array(F.transform(hashes, lambda h, i: cleared(h).bitwiseOR(i.cast("long"))))
        return let(sorted_numbers, lambda run: let(beside(run, bits), lambda near: positions(near, bits)))

    def beside(run: Column, bits: Column) -> Column:
        alike = lambda x, k: F.coalesce(place(F.get(run, k), bits) == place(x, bits), no)
        return F.filter(run, lambda x, k: alike(x, k - 1) | alike(x, k + 1))

    def positions(near: Column, bits: Column) -> Column:
        at = F.transform(near, lambda x: (x - F.call_function("shiftleft", place(x, bits), bits)).cast("int"))
        full = F.transform(near, lambda x, k: F.struct(place(x, bits).alias("p"), F.get(hashes, (x - F.call_function("shiftleft", place(x, bits),
            bits)).cast("int")).alias("h")))
        differ = lambda pairs: F.exists(F.transform(pairs, lambda x, k: F.coalesce((F.get(pairs, k - 1)["p"] == x["p"]) & (F.get(pairs,
            k - 1)["h"] != x["h"]), no)), lambda x: x)
        return F.when(let(full, differ), by_pairs()).otherwise(F.sort_array(at))

    def by_pairs() -> Column:
        same = lambda runs, x, k: F.coalesce(F.get(runs, k)["h"] == x["h"], no)
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return let(pairs, lambda runs: F.sort_array(F.transform(F.filter(runs, lambda x, k: same(runs, x, k - 1) | same(runs, x, k + 1)), lambda x: x["at"])))

    return let(F.length(F.bin(F.size(hashes).cast("long"))), numbered)


def _covered(at: Column) -> Column:
    """How many words lie in the 3-word windows at the sorted positions."""
    return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)


def statistics(text: Column) -> Column:
    """Struct of the counts of a text and their ratios.

    Repeated windows are found by sorting them and comparing neighbours, n log n for a long text; a text without
    repeated windows isn't sorted.
    """
    stop = sorted({x for w in STOP_WORDS.split() for x in (w, w.capitalize())})
    body = F.coalesce(text, F.lit(""))
    positions = lambda hashes: F.when(F.size(F.array_distinct(hashes)) < F.size(hashes),
        _repeated(hashes)).otherwise(F.array().cast("array<int>"))
    repeats = lambda words: let(let(_windows(words), positions), _covered)

    def counts(words: Column, lines: Column) -> dict[str, Column]:
        return {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", "")),
            "n_upper": F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}", "")),
            "n_stop_words": F.size(F.filter(words, lambda w: w.isin(*stop))),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeats(words),
        }

    def ratios(n: Column) -> dict[str, Column]:
        ratio = lambda a, b: F.coalesce(F.try_divide(n[a], n[b]), F.lit(0.0))
        return {
            "mean_word_chars": ratio("word_chars", "n_words"),
            "symbol_word_ratio": ratio("n_symbols", "n_words"),
            "stop_word_ratio": ratio("n_stop_words", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "repeat_word_ratio": ratio("n_repeat_words", "n_words"),
            "upper_ratio": ratio("n_upper", "word_chars"),
        }

    struct = lambda columns: F.struct(*(c.alias(k) for k, c in columns.items()))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = split_words(body)
    counted = let(words, lambda w: let(lines, lambda x: struct({k: c.cast("long") for k, c in counts(w, x).items()})))
    return let(counted, lambda n: struct({k: n[k] for k in COUNTS} | ratios(n)))


def verdict(text: Column, rules: Iterable[Rule] = RULES) -> Column:
    """The statistics with base_failed, failed_rules (names) and kept."""
    rules = (*BASE_RULES, *rules)
    return let(statistics(text), lambda q: F.struct(*(q[k].alias(k) for k in (*COUNTS, *RATIOS)), fails(BASE_RULES, q).alias("base_failed"),
        failed_names(rules, q).alias("failed_rules"), (~fails(rules, q)).alias("kept")))


def judge(docs: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text", into: str = "quality") -> DataFrame:
    """Adds the verdict as the struct column `into`."""
    return docs.withColumn(into, verdict(F.col(f"`{text}`"), rules))


def keep_good(docs: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows that pass every rule, with their own columns."""
    return docs.where(verdict(F.col(f"`{text}`"), rules)["kept"])
