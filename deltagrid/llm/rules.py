"""Quality rules by weak supervision.

Each rule looks at one statistic of a text and votes bad (-1), good (1) or abstains (0). Expectation-maximisation over the
histogram of vote patterns estimates the share of good texts and each rule's vote probabilities for good and for bad
texts; a text is kept if its posterior probability of being good is at least `threshold`. The histogram has at most
3 ** len(RULES) rows whatever the corpus, so it alone comes to the driver; everything else is DataFrame expressions.

Nulls and empty texts have no words: all counts are 0, base_failed is true and kept false. Very long texts are handled
whole (counts cost n log n in the words). Equal texts get equal verdicts; an empty table gives an empty table. Other
columns pass through; an input column with an output's name is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, fresh, others, row_key

BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Weight of the prior belief about each rule, as a share of the rows.
PRIOR = 0.02
#: The largest share of good texts on which a rule may be thought to vote bad; without it a frequent fault that few rules see would pass for a trait of good texts.
FALSE_ALARMS = 0.01
ROUNDS = 60


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(value: Column, bad: Column, good: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


#: name -> votes; thresholds are parameters of the rules.
RULES = {
    "symbols": lambda: _vote(x := _share("n_symbols", "n_words"), x > 0.1, x < 0.02),
    "repeats": lambda: _vote(x := _share("n_repeat_words", "n_words"), x > 0.25, x < 0.1),
    "lines": lambda: _vote(x := _share("n_dup_lines", "n_lines"), x > 0.3, x < 0.1),
    "capitals": lambda: _vote(x := _share("n_capitals", "word_chars"), x > 0.3, x < 0.1),
    "distinct": lambda: _vote(x := _share("n_distinct", "n_words"), x < 0.2, x > 0.35),
    "shouts": lambda: _vote(x := _share("n_shouts", "n_words"), x > 0.1, x < 0.02),
    "letters": lambda: _vote(x := _share("n_letters", "word_chars"), x < 0.75, x > 0.88),
    "bare": lambda: _vote(x := _share("n_bare", "word_chars"), x > 0.05, x < 0.02),
    "sentences": lambda: _vote(x := _share("n_stops", "n_words"), x < 0.004, (x > 0.01) & (x < 0.4)),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_capitals", "n_distinct", "n_shouts", "n_letters", "n_bare", "n_stops")


def _covered(ws: str, n: Column) -> Column:
    """How many words lie in 3-word windows found twice or more, comparing windows as texts."""
    triples = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.slice(ws, i + 1, F.lit(3))).alias("w"), i.alias("i")))
    return F.aggregate(
        F.array(F.sort_array(triples)),
        F.lit(0),
        lambda _, at: F.size(F.array_distinct(F.flatten(F.transform(F.filter(at, lambda x, k: F.coalesce(F.get(at, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(at, k + 1)["w"] == x["w"], F.lit(False))), lambda x: F.sequence(x["i"], x["i"] + 2))))),
    )


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with BASE and MORE (all long)."""
    t, ws, ls = fresh(df, "_t", "_words", "_lines")
    held = F.coalesce(F.col(text), F.lit(""))
    out = df.select("*", held.alias(t)).withColumns({ws: F.array_remove(F.split(t, BLANK), ""), ls: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    less = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    n = F.size(ws)
    # every 3-word window as one number: its hash above, its place in the lowest bits
    windows, width, again, places = fresh(out, "_windows", "_width", "_again", "_places")
    high = lambda x: F.call_function("shiftright", x, F.col(width))
    word = lambda i: F.get(F.col(ws), i)
    window = lambda i: F.call_function("shiftleft", F.xxhash64(word(i), word(i + 1), word(i + 2)), F.col(width)).bitwiseOR(i.cast("bigint"))
    out = out.withColumn(width, F.length(F.bin(n)))
    out = out.withColumn(windows, F.when(n > 2, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))).otherwise(F.array().cast("array<bigint>")))
    of = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(width)) - 1).cast("int")
    beside = lambda x, i, step: F.coalesce(high(x) == high(F.get(windows, i + step)), F.lit(False))
    out = out.withColumn(again, F.filter(windows, lambda x, i: beside(x, i, -1) | beside(x, i, 1)))
    out = out.withColumn(places, F.sort_array(F.transform(again, of)))
    covered = F.aggregate(F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    # windows of one hash that differ: rare, and then windows are compared as texts
    differ = lambda p, q: (word(p) != word(q)) | (word(p + 1) != word(q + 1)) | (word(p + 2) != word(q + 2))
    pairs = F.zip_with(again, F.slice(again, F.lit(2), F.greatest(F.size(again) - 1, F.lit(0))), lambda x, y: F.coalesce((high(x) == high(y)) & differ(of(x), of(y)), F.lit(False)))
    clash = F.exists(pairs, lambda x: x)
    covered = F.when(F.size(places) == 0, 0).when(clash, _covered(ws, n)).otherwise(covered)
    counts = {
        "n_words": n,
        "word_chars": F.length(F.translate(t, SPACES, "")),
        "n_symbols": less(SYMBOL),
        "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
        "n_repeat_words": covered,
        "n_lines": F.size(ls),
        "n_capitals": less(r"\p{Lu}+"),
        "n_distinct": F.size(F.array_distinct(ws)),
        "n_shouts": less(r"!(?=!)"),
        "n_letters": less(r"\p{L}+"),
        "n_bare": less(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"),
        "n_stops": less(r"[.?!](?=[\x20\x09-\x0D]|$)"),
    }
    return out.select(*others(df, *counts), *(v.cast("bigint").alias(k) for k, v in counts.items()))


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int = len(RULES)) -> tuple[float, list[dict[str, list[float]]]]:
    """The share of good texts and, for each rule, P(vote) for good and bad texts (votes -1, 0, 1), by expectation-maximisation with Dirichlet priors that say which class is which."""
    rules, total = len(patterns[0][0]) if patterns else rules, sum(n for _, n in patterns)
    first = {"good": [0.02, 0.18, 0.80], "bad": [0.40, 0.25, 0.35]}
    share, table = 0.85, [{k: list(v) for k, v in first.items()} for _ in range(rules)]
    for _ in range(ROUNDS if total else 0):
        heft = PRIOR * total
        sums, mass = [{k: [heft * x for x in v] for k, v in first.items()} for _ in range(rules)], 0.85 * heft
        for votes, n in patterns:
            p = posterior(votes, share, table)
            mass += n * p
            for r, v in enumerate(votes):
                sums[r]["good"][v + 1] += n * p
                sums[r]["bad"][v + 1] += n * (1 - p)
        share = mass / (total + heft)
        table = [{k: [x / sum(v) for x in v] for k, v in s.items()} for s in sums]
        for t in table:
            if (alarms := t["good"][0]) > FALSE_ALARMS:
                t["good"] = [FALSE_ALARMS] + [x * (1 - FALSE_ALARMS) / (1 - alarms) for x in t["good"][1:]]
    return share, table


def posterior(votes: tuple[int, ...], share: float, table: list[dict[str, list[float]]]) -> float:
    logit = math.log(share / (1 - share)) + sum(math.log(t["good"][v + 1] / t["bad"][v + 1]) for v, t in zip(votes, table, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, logit))))


def _verdict(ruled: DataFrame, threshold: float) -> DataFrame:
    """ruled, which holds votes and statistics and is kept somewhere, with p_good, base_failed and kept."""
    votes = [f"vote_{r}" for r in RULES]
    share, table = fit(sorted((tuple(r[:-1]), r[-1]) for r in ruled.groupBy(*votes).count().collect()))
    logit = F.lit(math.log(share / (1 - share)))
    for v, t in zip(votes, table, strict=True):
        odds = [math.log(g / b) for g, b in zip(t["good"], t["bad"], strict=True)]
        logit = logit + F.when(F.col(v) == -1, odds[0]).when(F.col(v) == 0, odds[1]).otherwise(odds[2])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = ruled.withColumns({"p_good": 1 / (1 + F.exp(-logit)), "base_failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def _voted(df: DataFrame, text: str) -> DataFrame:
    rules = {f"vote_{r}": rule for r, rule in RULES.items()}
    ruled = statistics(df.select(*others(df, *rules, "p_good", "base_failed", "kept")), text)
    return ruled.withColumns({v: rule().cast("int") for v, rule in rules.items()})


def apply_rules(df: DataFrame, text: str = "text", threshold: float = 0.5, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the statistics, each rule's vote, p_good, base_failed and kept. All but the columns in `drop` is written to the shared folder, so that texts are read once."""
    ruled = _voted(df, text)
    return _verdict(cut(ruled.select(*others(ruled, *drop)), "rules"), threshold)


def kept_rows(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df that the rules keep. Only votes and a name of each row are written to the shared folder; the rows are found by it."""
    (name,) = fresh(df, "_row")
    keyed = df.select("*", row_key(df, text).alias(name))
    votes = _voted(keyed.select(name, F.col(text).alias("text")), "text").select(name, "n_words", "n_repeat_words", *(f"vote_{r}" for r in RULES))
    kept = cut(_verdict(cut(votes, "votes"), threshold).where("kept").select(name).distinct(), "kept")
    out = keyed.join(kept, name, "left_semi")
    return out.select(*others(out, name))
