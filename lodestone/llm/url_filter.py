"""URL filtering by host and path rules, with a character language-model ratio for URLs that no rule decides.

Two smoothed variable-order Markov models give the probability of each character of a URL after its longest known
context, one trained on accepted and one on rejected URLs. With n(s) occurrences of a string s and smoothing weight L,

    P_k(c | x) = (n(xc) + L * P_{k-1}(c | x without its first character)) / (n(x) + L),    P_{-1}(c) = 1 / ALPHABET.

If xc was never seen, P_k differs from P_{k-1} by the factor L / (n(x) + L) alone, and not at all if x was never seen.
The log ratio of the two models over a URL is therefore a sum over its substrings of weights that depend on nothing but
the substring, so scoring is a join of substrings with the weights. Every substring of the examples has its weight,
however rare. Those that make up at least ``BROADCAST_SHARE`` of their length's occurrences, of which there can't be more
than (ORDER + 1) / BROADCAST_SHARE, are broadcast; the others meet their substrings in a shuffle. The threshold comes from
examples that the models haven't seen. Everything is DataFrame operations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Longest context in characters.
ORDER = 4
SMOOTHING = 4.0
ALPHABET = 256.0
#: Substrings of at least this share of their length's occurrences are broadcast; it only decides where a join is done.
BROADCAST_SHARE = 2e-5
#: One labelled URL in so many is kept from training for the threshold.
CALIBRATION = 5
#: Marks before and after each URL.
START, END = "\x02", "\x03"
#: Bins of the calibration histogram over the length-normalised ratio, which is clipped to [-SPAN, SPAN].
BINS, SPAN = 400, 4.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"


#: The rules of the registered query.
RULES = (
    Rule("block", "com", "en/"),
    Rule("allow", "example.com", "en/7"),
    Rule("allow", "net", "de/"),
    Rule("block", "example.net", "de/8"),
    Rule("block", "org", "es/"),
)


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next of ``/ ? #``, A-Z lower-cased; empty without ``://`` or url."""
    rest = _after_scheme(url)
    return common.ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def with_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add host, path, rule and rule_verdict. The rule with the longest host and path that fits wins."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    pages = pages.withColumns({"host": host, "path": path})
    chosen = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.host) - len(r.path), r.name)):
        own = F.col("host") == rule.host
        fits = (own | F.endswith("host", F.lit(f".{rule.host}"))) & F.startswith("path", F.lit(f"/{rule.path}"))
        chosen = F.when(fits, rule.name) if chosen is None else chosen.when(fits, rule.name)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return pages.withColumns({"rule": none if chosen is None else chosen, "rule_verdict": none if verdict is None else verdict})


def _grams(url: Column) -> Column:
    """Every substring of 1 to ORDER + 1 characters, one array element for each place it occurs at."""
    text = F.concat(F.lit(START), url, F.lit(END))

    def of_length(n: int) -> Column:
        last = F.length(text) - (n - 1)
        found = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(last >= 1, found).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of_length(n) for n in range(1, ORDER + 2)]))


def gram_counts(urls: DataFrame) -> DataFrame:
    """(gram, n_good, n_bad) over ``urls`` (url, good): how often each substring occurs in either kind."""
    found = (
        urls.select(F.explode(_grams(F.col("url"))).alias("gram"), F.col("good").cast("long").alias("good"))
        .groupBy("gram")
        .agg(F.sum("good").alias("n_good"), F.sum(1 - F.col("good")).alias("n_bad"))
    )
    return common.materialise(found, "url-grams")


def _frequent(counts: DataFrame) -> DataFrame:
    """(gram) of the substrings that are broadcast: at most (ORDER + 1) / BROADCAST_SHARE."""
    totals = {r["n"]: r["total"] for r in counts.groupBy(F.length("gram").alias("n")).agg(F.sum(F.col("n_good") + F.col("n_bad")).alias("total")).collect()}
    least = F.element_at(F.create_map(*[F.lit(x) for n in range(1, ORDER + 2) for x in (n, totals.get(n, 0) * BROADCAST_SHARE)]), F.length("gram"))
    return counts.where(F.col("n_good") + F.col("n_bad") >= least).select("gram")


def weights(counts: DataFrame) -> tuple[DataFrame, float]:
    """(gram, weight): what one occurrence of a substring adds to log P_good - log P_bad of a URL.

    The number that comes with it is what each character adds whatever it is: the share of the empty context.
    """
    sides = ("good", "bad")
    contexts = counts.where((F.length("gram") <= ORDER) & ~F.endswith("gram", F.lit(END)))  # nothing follows the end
    level = counts.where(F.length("gram") == 1)
    total = level.agg(*[F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(f"t_{s}") for s in sides]).first()
    level = level.select("gram", *[((F.col(f"n_{s}") + SMOOTHING / ALPHABET) / (total[f"t_{s}"] + SMOOTHING)).alias(f"p_{s}") for s in sides])
    base = math.log(total["t_bad"] + SMOOTHING) - math.log(total["t_good"] + SMOOTHING)
    level = level.withColumn("own", F.log("p_good") - F.log("p_bad") - base)
    levels = [level]
    for n in range(2, ORDER + 2):
        shorter = level.select(F.col("gram").alias("tail"), *[F.col(f"p_{s}").alias(f"q_{s}") for s in sides])
        before = contexts.where(F.length("gram") == n - 1).select(F.col("gram").alias("head"), *[F.col(f"n_{s}").alias(f"m_{s}") for s in sides])
        level = (
            counts.where(F.length("gram") == n)
            .withColumns({"head": F.substring("gram", 1, n - 1), "tail": F.substring("gram", 2, n - 1)})
            .join(shorter, "tail")
            .join(before, "head")
            .select("gram", *[c for s in sides for c in (((F.col(f"n_{s}") + SMOOTHING * F.col(f"q_{s}")) / (F.col(f"m_{s}") + SMOOTHING)).alias(f"p_{s}"), F.col(f"q_{s}"), F.col(f"m_{s}"))])
            # over the shorter context, and less what the context gives to any character that follows it
            .withColumn("own", F.log("p_good") - F.log("p_bad") - F.log("q_good") + F.log("q_bad") - _unseen("m"))
            .select("gram", "p_good", "p_bad", "own")
        )
        level = common.materialise(level, "url-level")
        levels.append(level)
    own = levels[0].select("gram", "own")
    for x in levels[1:]:
        own = own.unionByName(x.select("gram", "own"))
    table = own.join(contexts, "gram", "left").select("gram", (F.col("own") + F.coalesce(_unseen("n"), F.lit(0.0))).alias("weight"))
    return table, base


def _unseen(n: str) -> Column:
    """log ratio that a context with counts ``n_good`` and ``n_bad`` adds for a character never seen after it."""
    return F.log(F.col(f"{n}_bad") + SMOOTHING) - F.log(F.col(f"{n}_good") + SMOOTHING)


def scored(urls: DataFrame, table: DataFrame, base: float, frequent: DataFrame | None = None) -> DataFrame:
    """(url, score): the log ratio per character of each distinct url, from the weights of its substrings.

    ``frequent`` (gram) has at most (ORDER + 1) / BROADCAST_SHARE rows, whose weights are broadcast; the others, and all
    without it, are met in a shuffle. Substrings that no example has weigh nothing.
    """
    table = common.materialise(table, "url-weights")
    grams = urls.select("url", F.explode(_grams(F.col("url"))).alias("gram"))
    parts = []
    if frequent is not None:
        held = common.materialise(table.join(frequent, "gram", "left_semi"), "url-frequent")
        parts.append(grams.join(F.broadcast(held), "gram").groupBy("url").agg(F.sum("weight").alias("total")))
        grams, table = grams.join(F.broadcast(held.select("gram")), "gram", "left_anti"), table.join(held, "gram", "left_anti")
    rare = grams.groupBy("url", "gram").agg(F.count(F.lit(1)).alias("times")).join(table, "gram")
    parts.append(rare.groupBy("url").agg(F.sum(F.col("times") * F.col("weight")).alias("total")))
    sums = reduce(DataFrame.unionByName, parts).groupBy("url").agg(F.sum("total").alias("total"))
    score = F.coalesce("total", F.lit(0.0)) / (F.length("url") + 2) + base
    return urls.join(sums, "url", "left").select("url", score.alias("score"))


def threshold(scores: DataFrame) -> float:
    """The score from which URLs are accepted: the cut of a histogram that maximises balanced accuracy.

    ``scores`` (score, good) are reduced to BINS counts for each label. With one label only, or none, nothing is
    rejected.
    """
    clipped = F.greatest(F.least(F.col("score"), F.lit(SPAN)), F.lit(-SPAN))
    at = F.least(F.floor((clipped + SPAN) * (BINS / (2 * SPAN))), F.lit(BINS - 1)).cast("int")
    rows = scores.groupBy(at.alias("at"), "good").count().collect()
    count = {(r["at"], r["good"]): r["count"] for r in rows}
    goods, bads = (sum(n for (_, g), n in count.items() if g is side) for side in (True, False))
    if not goods or not bads:
        return -math.inf
    best, cut, good_under, bad_under = 0.0, 0, 0, 0
    for b in range(BINS):
        balanced = (goods - good_under) / goods + bad_under / bads
        if balanced > best:
            best, cut = balanced, b
        good_under += count.get((b, True), 0)
        bad_under += count.get((b, False), 0)
    return cut * 2 * SPAN / BINS - SPAN


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages`` (page_id, url).

    URLs that a rule decides are the accepted and rejected examples, of which one in CALIBRATION sets the threshold and
    the others train the models; the model's verdict counts where no rule fits. A null url has an empty host and path and
    is allowed, as is everything if the rules give examples of one kind only. URLs of any length are whole. Repeated rows
    give repeated verdicts. Other columns are ignored; an empty table gives no rows.
    """
    rows = common.materialise(with_rules(pages.select("page_id", "url"), rules), "urls")
    distinct = rows.where("url is not null").groupBy("url").agg(F.first("rule_verdict").alias("rule_verdict"))
    distinct = common.materialise(distinct, "distinct-urls")
    labelled = distinct.where("rule_verdict is not null").select("url", (F.col("rule_verdict") == "allow").alias("good"))
    # little data but much work: a stated number of parts isn't coalesced by size
    kept_out = F.pmod(F.xxhash64("url"), F.lit(CALIBRATION)) == 0
    counts = gram_counts(common.spread(labelled.where(~kept_out), "url"))
    table, base = weights(counts)
    scores = common.materialise(scored(common.spread(distinct.select("url"), "url"), table, base, _frequent(counts)), "url-scores")
    cut = threshold(scores.join(labelled.where(kept_out), "url").select("score", "good"))
    verdict = F.coalesce(F.col("rule_verdict"), F.when(F.col("score") < cut, "block").otherwise("allow"))
    # both sides are plain scans, so a hot url is split by the adaptive skew join
    return rows.join(scores, "url", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
