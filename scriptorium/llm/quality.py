"""Quality rules as weak supervision, by DataFrame functions alone.

Each rule votes -1 (bad), 1 (good) or abstains (0). ``HARD`` rules see clear signs
of junk; an all-must-pass filter would drop whatever one of them votes against.
``SOFT`` rules see slight signs, and the rules of ``FOR`` see prose. Counts of the
vote patterns over all documents (at most 2 ** rules rows, and few in practice)
feed an expectation-maximisation of a mixture of classes: good texts, and one
class for each kind of junk named in ``KINDS``. It estimates the share of each
class and how often each rule speaks in it, and so each rule's accuracy. A
document's posterior probability of being good follows from its votes and
silences, and replaces the all-must-pass filter: a text with one bad vote stays
if all else speaks for it, and one that no hard rule votes against goes if many
slight signs meet.

One class for all junk would be taken by the kind whose rules speak together most;
so each kind has its own, which starts from the texts that its hard rule votes
against. Priors weigh as much as ``ANCHOR`` documents: hard rules seldom speak in
good texts and each kind's own rule mostly does in that kind.

Defined cases: a null or blank text has no words, so that the base rules fail
it; repeated rows count and are judged each; an empty table gives an empty
result; a posterior of exactly one half is good. ``judge`` reads ``doc_id`` and
``text`` and ignores other columns; ``keep`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import words

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
ITERATIONS = 100
#: Documents' worth of prior belief in what a rule is for, and in any rate.
ANCHOR, SMOOTH = 20.0, 0.5
HARD = ["symbols", "shouting", "exclaim", "stutter", "dup_lines", "word_length", "length"]
SOFT = ["some_symbols", "loud", "some_exclaim", "some_stutter", "some_dup", "odd_words"]
FOR = ["prose", "closed", "commas", "sentences"]
RULES = HARD + SOFT + FOR
#: Kinds of junk, by the hard rule that sees them.
KINDS = ["symbols", "shouting", "stutter"]


def _count(marks: Column, char: str) -> Column:
    return (F.length(marks) - F.length(F.replace(marks, F.lit(char), F.lit("")))).cast("long")


def _measure(df: DataFrame, text: str) -> DataFrame:
    """Adds the struct ``_m`` of whatever rules vote on; df keeps its columns."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # One pass leaves only the signs that are counted, a few in a hundred of all.
    signs = F.regexp_replace(body, r"[^A-Z#*$%&|<>!.,]+", "")
    marks = F.translate(signs, UPPER + SYMBOLS, "A" * len(UPPER) + "#" * len(SYMBOLS))
    return (
        df.withColumn("_w", words(F.col(text)))
        .withColumn("_l", lines)
        .withColumn("_marks", marks)
        .withColumn(
            "_m",
            F.struct(
                F.size("_w").cast("long").alias("n_words"),
                F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
                *[_count(F.col("_marks"), c).alias(n) for c, n in (("#", "n_symbols"), ("A", "upper"), ("!", "exclaims"), (".", "dots"), (",", "commas"))],
                F.coalesce(F.right(F.rtrim(body), F.lit(1)) == ".", F.lit(False)).alias("closed"),
                F.size("_l").cast("long").alias("lines"),
                (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                F.expr("size(filter(_w, (x, i) -> i > 0 AND x = _w[i - 1]))").cast("long").alias("stutters"),
            ),
        )
        .drop("_l", "_marks")
    )


def _once(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it: a name bound in a lambda is never replaced by its expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _votes(m: Column) -> Column:
    """The rules' votes, in the order of RULES, from the struct m."""
    c = lambda k: m[k].cast("double")
    n, chars = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("word_chars"), F.lit(1.0))
    above = lambda k, share, of: c(k) > share * of
    lines = F.greatest(c("lines"), F.lit(1.0))
    calm = c("n_symbols") <= 0.05 * n
    said = {
        "symbols": above("n_symbols", 0.2, n),
        "shouting": above("upper", 0.4, chars),
        "exclaim": above("exclaims", 0.3, n),
        "stutter": above("stutters", 0.2, n),
        "dup_lines": above("n_dup_lines", 0.5, lines),
        "word_length": (chars / n < 2) | (chars / n > 20),
        "length": c("n_words") < 20,
        "some_symbols": above("n_symbols", 0.05, n),
        "loud": above("upper", 0.15, chars),
        "some_exclaim": above("exclaims", 0.1, n),
        "some_stutter": above("stutters", 0.05, n),
        "some_dup": above("n_dup_lines", 0.2, lines),
        "odd_words": (chars / n < 3.5) | (chars / n > 8),
        "prose": calm & (c("n_words") > 0) & ~above("upper", 0.15, chars) & ~above("stutters", 0.05, n),
        "closed": calm & m["closed"],
        "commas": calm & c("commas").between(0.01 * n, 0.2 * n),
        "sentences": calm & c("dots").between(0.02 * n, 0.25 * n),
    }
    return F.array(*[F.when(said[r], 1 if r in FOR else -1).otherwise(0) for r in RULES])


class Model:
    """Shares of the classes (good first, then KINDS), and how often each rule speaks in each."""

    def __init__(self, shares: list[float], rates: list[list[float]]):
        self.shares, self.rates = shares, rates

    def class_logs(self) -> list[tuple[float, list[float]]]:
        """For each class, the logarithm of its share and of all rules' silence, and what each vote adds."""
        return [(math.log(s) + sum(math.log1p(-p) for p in r), [math.log(p) - math.log1p(-p) for p in r]) for s, r in zip(self.shares, self.rates, strict=True)]

    def good(self, votes: tuple[int, ...]) -> float:
        """The posterior probability of being good."""
        logs = [base + sum(a for a, v in zip(adds, votes, strict=True) if v) for base, adds in self.class_logs()]
        return 1 / sum(math.exp(min(700.0, x - logs[0])) for x in logs)

    def accuracy(self) -> dict[str, float]:
        """How often each rule is right where it speaks."""
        out = {}
        for j, rule in enumerate(RULES):
            said = [s * r[j] for s, r in zip(self.shares, self.rates, strict=True)]
            good = said[0] / sum(said)
            out[rule] = good if rule in FOR else 1 - good
        return out


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> Model:
    """The model of (votes, documents)."""
    own = [RULES.index(k) for k in KINDS]
    weights = []
    for v, _ in patterns:
        hit = [float(v[j] != 0) for j in own]
        weights.append([h / sum(hit) for h in [0.0, *hit]] if any(hit) else [1.0] + [0.0] * len(own))
    model = Model([1 / (1 + len(own))] * (1 + len(own)), [[0.5] * len(RULES) for _ in range(1 + len(own))])
    for _ in range(ITERATIONS):
        shares, rates = [], []
        for k in range(1 + len(own)):
            mass = sum(n * w[k] for w, (_, n) in zip(weights, patterns, strict=True))
            shares.append(mass + SMOOTH)
            row = []
            for j in range(len(RULES)):
                spoke = sum(n * w[k] for w, (v, n) in zip(weights, patterns, strict=True) if v[j])
                yes = SMOOTH + ANCHOR * (k > 0 and own[k - 1] == j)
                no = SMOOTH + ANCHOR * (k == 0 and j < len(HARD))
                row.append((spoke + yes) / (mass + yes + no))
            rates.append(row)
        model = Model([s / sum(shares) for s in shares], rates)
        logs = model.class_logs()
        weights = []
        for v, _ in patterns:
            x = [base + sum(a for a, y in zip(adds, v, strict=True) if y) for base, adds in logs]
            e = [math.exp(y - max(x)) for y in x]
            weights.append([y / sum(e) for y in e])
    return model


def _good(votes: Column, model: Model) -> Column:
    """The posterior probability of being good."""

    def logs(v: Column) -> Column:
        return F.array(*[sum((F.abs(F.get(v, F.lit(j))) * add for j, add in enumerate(adds)), F.lit(base)) for base, adds in model.class_logs()])

    def posterior(x: Column) -> Column:
        return 1 / F.aggregate(x, F.lit(0.0), lambda total, y: total + F.exp(F.least(F.lit(700.0), y - F.get(x, F.lit(0)))))

    return _once(_once(votes, logs), posterior)


def _measured(df: DataFrame, text: str, model: Model) -> DataFrame:
    """Adds ``_w`` and the struct ``_r`` of measures and the posterior; df keeps its columns."""
    with_good = lambda m: F.struct(m.alias("m"), _good(_votes(m), model).alias("good"))
    return _measure(df, text).withColumn("_r", _once(F.col("_m"), with_good)).drop("_m")


def _repeats() -> Column:
    """Words in windows found twice or more. The windows' hashes are sorted
    first; only where two are equal are the windows sorted with their places."""
    return F.expr(
        f"""
        CASE WHEN size(_d) = 0 THEN 0L ELSE aggregate(
          sort_array(transform(
            filter(_s, (x, i) -> (i > 0 AND _s[i - 1].h = x.h) OR (i + 1 < size(_s) AND _s[i + 1].h = x.h)),
            x -> x.p)),
          named_struct('t', 0L, 'e', 0L),
          (a, p) -> named_struct('t', a.t + p + {WINDOW}L - greatest(p, a.e), 'e', p + {WINDOW}L)).t END
        """
    )


def _with_repeats(df: DataFrame) -> DataFrame:
    sorted_hashes = F.expr(f"CASE WHEN size(_w) <= {WINDOW} THEN array() ELSE sort_array(transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64(slice(_w, i + 1, {WINDOW})))) END")
    places = F.expr(f"CASE WHEN size(_d) = 0 THEN array() ELSE sort_array(transform(sequence(0, size(_w) - {WINDOW}), i -> named_struct('h', xxhash64(slice(_w, i + 1, {WINDOW})), 'p', cast(i AS bigint)))) END")
    return (
        df.withColumn("_h", sorted_hashes)
        .withColumn("_d", F.expr("filter(_h, (x, i) -> i > 0 AND x = _h[i - 1])"))
        .withColumn("_s", places)
        .withColumn("_repeat", _repeats())
        .drop("_h", "_d", "_s")
    )


def _failed() -> Column:
    n = F.col("_r.m.n_words")
    return (n < 20) | (100 * F.col("_repeat") > 30 * n)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept of every row."""
    full = _held(_with_repeats(_measured(docs.select("doc_id", "text"), "text", fit(_patterns(docs))).drop("text")))
    return full.select(
        "doc_id",
        *[F.col(f"_r.m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")],
        F.col("_repeat").alias("n_repeat_words"),
        _failed().alias("base_failed"),
        F.col("_r.good").alias("quality"),
        _kept().alias("kept"),
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that ``judge`` keeps, with their columns."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["text"].alias("_text"))
    full = _with_repeats(_measured(packed, "_text", fit(_patterns(docs))))
    return _held(full).where(_kept()).select("_row.*")


def _held(df: DataFrame) -> DataFrame:
    """A barrier: no filter on what ``_kept`` says is pushed below the features, where Catalyst
    would put their expressions in place of their names and compute them per element. It rests
    on Spark's rule that filters don't pass nondeterministic columns."""
    return df.withColumn("_held", F.monotonically_increasing_id())


def _kept() -> Column:
    return (F.col("_held") >= 0) & ~_failed() & (F.col("_r.good") >= 0.5)


def _patterns(docs: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """The vote patterns and their documents. There are 2 ** len(RULES) at most, and as soft rules speak wherever hard ones do, far fewer."""
    voted = _measure(docs.select("text"), "text").select(_once(F.col("_m"), _votes).alias("v"))
    rows = voted.groupBy("v").count().collect()
    return sorted((tuple(r["v"]), r["count"]) for r in rows)
