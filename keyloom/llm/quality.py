"""Quality rules whose cutoffs carry a guarantee, with DataFrame functions only.

Each rule rejects a document when one measure exceeds a cutoff. A cutoff is certified for a stratum
if, over the labelled holdout of good documents, the exact binomial test rejects "the cutoff rejects
more than alpha of the good documents" at level delta / m, where m counts all tests made: strata times
rules times candidate cutoffs (Bonferroni). The strictest certified cutoff of each rule and stratum is
used; with no certified cutoff the rule is off there. alpha is shared among the rules, so all rules
together falsely reject at most alpha of each stratum, with confidence 1 - delta over all strata.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import cut, let, words

SYMBOLS = "#*$%&|<>"
#: Words in a window of the repeat measure.
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """alpha: the share of good documents that may be rejected per stratum; delta: the risk that any
    certified cutoff breaks this. In a stratum with fewer than min_labels good holdout rows nothing is
    certified, so all rules are off there."""

    alpha: float = 0.04
    delta: float = 0.05
    min_labels: int = 40

    #: measure -> candidate cutoffs, strictest first.
    GRID = {
        "symbol_rate": (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35),
        "shout_rate": (0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
        "dup_line_rate": (0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
        "repeat_rate": (0.02, 0.05, 0.1, 0.2, 0.3),
    }


def repeated_words(ws: Column, width: int = WINDOW) -> Column:
    """Words lying in a width-word window (a power of two) that is found twice or more in the array."""

    def covered(hashes):
        def marked(pairs):
            same = F.filter(
                pairs, lambda p, i: (F.get(pairs, i - 1)["h"] == p["h"]) | F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False))
            )
            starts = F.array_sort(F.transform(same, lambda p: p["i"]))
            return F.aggregate(
                starts,
                F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
                lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last")),
                lambda acc: acc["n"],
            )

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, let(pairs, marked)).otherwise(0)

    def doubled(hashes, step):
        """Hashes of windows twice as wide: those at i and i + step, as far as both exist."""
        at = lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - F.lit(step + 1)), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + F.lit(step)))
        )
        return let(hashes, at)

    def hashed(w):
        h = F.transform(w, lambda x: F.xxhash64(x))
        step = 1
        while step < width:
            h, step = doubled(h, step), 2 * step
        return F.when(F.size(w) > width, let(h, covered)).otherwise(0)

    return let(ws, hashed)


def occurrences(text: Column, characters: str) -> Column:
    """How many of these ASCII characters a text has; replacing one at a time is a plain byte search."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def counts(text: Column) -> Column:
    """Array of one struct with the base counts of a whole text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    per_text = F.struct(words(text).alias("w"), lines.alias("x"))
    return F.transform(
        F.array(per_text),
        lambda t: F.struct(
            F.size(t["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(t["w"], "")).cast("long").alias("word_chars"),
            occurrences(text, SYMBOLS).alias("n_symbols"),
            occurrences(text, "!").alias("n_shout"),
            F.size(t["x"]).cast("long").alias("n_lines"),
            (F.size(t["x"]) - F.size(F.array_distinct(t["x"]))).cast("long").alias("n_dup_lines"),
            repeated_words(t["w"]).cast("long").alias("n_repeat_words"),
        ),
    )


def measured(docs: DataFrame, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """keep, the base counts and the rates, per document. inline() evaluates the counts once a row,
    which a projection that later ones are merged into would not."""
    raw = docs.select(*(v.alias(k) for k, v in keep.items()), F.inline(counts(F.col(text_col))))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return raw.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per("n_symbols", "word_chars").alias("symbol_rate"),
        per("n_shout", "word_chars").alias("shout_rate"),
        per("n_dup_lines", "n_lines").alias("dup_line_rate"),
        per("n_repeat_words", "n_words").alias("repeat_rate"),
    )


def binomial_cdf(k: str, n: str, p: float) -> Column:
    """P(Bin(n, p) <= k) for bigint columns k and n, summed term by term in log space."""
    return F.expr(
        f"""least(1D, aggregate(if({k} > 0, sequence(1L, {k}), cast(array() as array<bigint>)),
            named_struct('t', {n} * ln(1 - {p}D), 's', exp({n} * ln(1 - {p}D))),
            (a, j) -> named_struct('t', a.t + ln(({n} - j + 1) / j) + ln({p}D / (1 - {p}D)),
                                   's', a.s + exp(a.t + ln(({n} - j + 1) / j) + ln({p}D / (1 - {p}D)))),
            a -> a.s))"""
    )


def certified_cutoffs(holdout: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(stratum, good_rows, a cutoff or null per rule) of every stratum of min_labels rows.

    holdout: stratum and the rates of labelled good documents. Counts are partial sums per candidate
    cutoff, so no holdout row meets another of its stratum. What holds for all strata together guarantees
    nothing for any one of them, so no stratum gets cutoffs that are not its own.
    """
    grid = [(name, c) for name, cutoffs in rules.GRID.items() for c in cutoffs]
    alpha = rules.alpha / len(rules.GRID)
    tests = [F.sum((F.col(name) > c).cast("long")).alias(f"k{i}") for i, (name, c) in enumerate(grid)]
    per_stratum = holdout.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *tests)
    strata = per_stratum.where(F.col("stratum").isNotNull() & (F.col("n") >= rules.min_labels))
    strata = strata.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) * len(grid))  # a row per min_labels labels at most
    passed = [binomial_cdf(f"k{i}", "n", alpha) <= rules.delta / F.col("m") for i in range(len(grid))]
    chosen = []
    for name in rules.GRID:
        best = F.coalesce(*(F.when(passed[i], F.lit(c)) for i, (rule, c) in enumerate(grid) if rule == name))
        chosen.append(best.alias(f"cut_{name}"))
    return strata.select("stratum", F.col("n").alias("good_rows"), *chosen)


def judge(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), stratum_col: str = "lang") -> DataFrame:
    """Base counts, base_failed and the verdict of the certified rules for every document.

    docs: doc_id, text and the stratum column; labels: doc_id, quality (1 is good), with one judgement
    for an id that has several rows (good only if all are). The holdout is every good labelled document
    that the base rules keep. base_failed: under 20 words, or over 30 % repeated words. A null text has
    no words and fails; rows without a stratum are a stratum; where nothing is certified no rule is on.
    Equal rows get equal verdicts; other columns of docs are not read.
    """
    seen = measured(docs, {"doc_id": F.col("doc_id"), "stratum": F.col(stratum_col).cast("string")})
    seen = seen.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    seen = cut(seen)  # a few numbers a row: texts are measured once, though two branches follow
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"))
    held = seen.where(~F.col("base_failed")).join(good.where("q = 1").select("doc_id"), "doc_id", "left_semi")
    of = F.coalesce(F.concat(F.lit("="), "stratum"), F.lit(""))
    cutoffs = certified_cutoffs(held.withColumn("stratum", of), rules)

    names = [f"cut_{name}" for name in rules.GRID]
    some = F.coalesce(*names).isNotNull()  # hundreds of labels each, so these strata are few
    own = cutoffs.where(some).select(F.col("stratum").alias("of"), F.struct(*names).alias("own"))
    out = seen.withColumn("of", of).join(F.broadcast(own), "of", "left")
    cuts = F.col("own")
    rejected = [F.coalesce(F.col(name) > cuts[f"cut_{name}"], F.lit(False)) for name in rules.GRID]
    hit = rejected[0]
    for r in rejected[1:]:
        hit = hit | r
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~hit).alias("kept"), "stratum", *rules.GRID, *(cuts[n].alias(n) for n in names),
    )
