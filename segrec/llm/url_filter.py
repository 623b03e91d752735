"""URL filter: allow and block rules, and a character language-model ratio for the URLs that no rule fits.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, share one tree of
character n-grams. The models learn from all distinct URLs that rules decide, but for one fold that
sets the threshold. An n-gram's conditional probability is interpolated with that of its suffix; its
weight is how much it moves the log ratio away from its suffix's, so a URL's log-likelihood difference
is the sum of the weights of all its n-grams in the tree: each position counts with the longest
context that the tree holds. Divided by the URL's length, the sum is compared with the threshold of
best balanced accuracy on the held-out fold. The tree holds every n-gram of up to ``ORDER`` characters
that the learned URLs have, so it grows with them; up to ``BROADCAST_GRAMS`` weights are broadcast, more
are met by a shuffle on the n-gram.

Nulls: a null url, or one without ``://``, has an empty host and path and fits no rule. Very long
urls are read whole. Repeated rows and ties give equal rows. If rules decide no URL of one of the two
kinds, every other URL is allowed with a null score. An empty table gives an empty result.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segrec.llm.common import materialise, packed_row, spread

#: (verdict, host, start of path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
ORDER = 6
ALPHABET = 48
BROADCAST_GRAMS = 300_000
FOLDS = 5
#: Weight of the suffix's estimate, in observations.
PRIOR = 4.0
#: Held-out scores are counted in bins of this width, from -LIMIT to LIMIT.
BIN, LIMIT = 0.01, 10.0


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = after_scheme(url)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name, verdict = F.when(fits, domain + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _characters(url: Column) -> Column:
    """Letters lower-cased, digits as 0, rare characters as ~, between starts and an end."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(after_scheme(url)), "[0-9]", "0"), r"[^a-z0./?=&#_%:\-]", "~")
    return F.split(F.concat(F.lit("<" * (ORDER - 1)), plain, F.lit(">")), "")


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    chars = urls.select(*keep, _characters(F.col("url")).alias("chars"))

    def of_size(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("chars") - (n - 1)), lambda i: F.array_join(F.slice(F.col("chars"), i, n), ""))

    own = F.flatten(F.array(*[of_size(n) for n in range(1, ORDER + 1)]))
    return chars.select(*keep, F.size("chars").alias("size"), F.explode(own).alias("gram"))


def _weights(labelled: DataFrame) -> DataFrame:
    """(gram, weight) of all n-grams of the labelled URLs."""
    counts = _grams(spread(labelled.select("verdict", "url")), "verdict").groupBy("gram").agg(*[F.count(F.when(F.col("verdict") == kind, 1)).cast("double").alias(kind) for kind in ("allow", "block")])
    tree = materialise(counts, "grams")
    level = tree.where(F.length("gram") == 1)
    every = level.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    chance = {kind: (F.col(kind) + PRIOR) / (F.lit(every[kind] or 0.0) + PRIOR * ALPHABET) for kind in ("allow", "block")}
    level = level.select("gram", "allow", "block", *[c.alias(f"p_{k}") for k, c in chance.items()], F.lit(0.0).alias("s_ratio"))
    weights = None
    for n in range(1, ORDER + 1):
        if n > 1:
            context = level.select(F.col("gram").alias("context"), F.col("allow").alias("c_allow"), F.col("block").alias("c_block"))
            lower = level.select(F.col("gram").alias("suffix"), F.col("p_allow").alias("s_allow"), F.col("p_block").alias("s_block"), F.col("ratio").alias("s_ratio"))
            grams = tree.where(F.length("gram") == n).withColumns({"context": F.substring("gram", 1, n - 1), "suffix": F.substring("gram", 2, n - 1)})
            joined = grams.join(context, "context").join(lower, "suffix")
            chance = {kind: (F.col(kind) + PRIOR * F.col(f"s_{kind}")) / (F.col(f"c_{kind}") + PRIOR) for kind in ("allow", "block")}
            level = joined.select("gram", "allow", "block", "s_ratio", *[c.alias(f"p_{k}") for k, c in chance.items()])
        level = materialise(level.withColumn("ratio", F.ln("p_allow") - F.ln("p_block")), f"level{n}")
        own = level.select("gram", (F.col("ratio") - F.col("s_ratio")).alias("weight"))
        weights = own if weights is None else weights.unionByName(own)
    return weights


def _scores(urls: DataFrame, weights: DataFrame) -> DataFrame:
    """(url, score): length-normalised log-likelihood difference."""
    small = weights.count() <= BROADCAST_GRAMS
    met = _grams(spread(urls.select("url")), "url").join(F.broadcast(weights) if small else weights, "gram", "left")
    return met.groupBy("url").agg((F.coalesce(F.sum("weight"), F.lit(0.0)) / F.max("size")).alias("score"))


def _threshold(scored: DataFrame) -> float:
    """The score of best balanced accuracy over rows (score, verdict), from a histogram of bounded size."""
    slot = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score"))) / BIN).cast("int")
    rows = scored.groupBy(slot.alias("slot")).agg(*[F.count(F.when(F.col("verdict") == k, 1)).alias(k) for k in ("allow", "block")]).orderBy("slot").collect()
    if not rows:
        return 0.0
    allow, block = (np.array([r[k] for r in rows], float) for k in ("allow", "block"))
    kept = np.cumsum(allow[::-1])[::-1] / max(allow.sum(), 1)  # accepted at or above each slot
    passed = np.cumsum(block[::-1])[::-1] / max(block.sum(), 1)
    at = int(np.argmax(kept - passed))
    below = rows[at - 1]["slot"] + 1 if at else rows[at]["slot"]
    return (below + rows[at]["slot"]) / 2 * BIN  # the middle of the gap under the lowest accepted slot


def judge(df: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """The rows of ``df`` with host, path, rule, verdict and score (null where a rule decides)."""
    host, path = host_and_path(F.col("url"))
    urls = df.select(F.col(url_col).cast("string").alias("url")).distinct().select("url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    urls = materialise(urls.select("*", rule.alias("rule"), verdict.alias("verdict")), "urls")
    decided = urls.where("verdict IS NOT NULL")
    open_urls = urls.where("verdict IS NULL").select(F.coalesce("url", F.lit("")).alias("url")).distinct()
    held_out = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0
    kinds = {r[0] for r in decided.select("verdict").distinct().collect()}
    if kinds == {"allow", "block"}:
        weights = _weights(decided.where(~held_out))
        proof = decided.where(held_out)
        limit = _threshold(_scores(proof, weights).join(proof.select("url", "verdict"), "url"))
        scored = _scores(open_urls, weights)
    else:
        limit, scored = 0.0, open_urls.select("url", F.lit(None).cast("double").alias("score"))
    told = urls.join(scored.withColumnRenamed("url", "__scored"), F.coalesce("url", F.lit("")) == F.col("__scored"), "left").select(
        F.col("url").alias("__url"),
        F.struct("host", "path", "rule", F.coalesce("verdict", F.when(F.col("score") < limit, "block").otherwise("allow")).alias("verdict"), "score").alias("__told"),
    )
    rows = df.select(packed_row(df).alias("__row"), F.col(url_col).cast("string").alias("__asked"))
    return rows.join(told, F.col("__asked").eqNullSafe(F.col("__url")), "left").select("__row.*", "__told.*")
