"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source, language, topic) are raked: each margin in turn is scaled to its
target shares of the tokens to keep, until all agree. A cell's ratio of raked to present tokens is the
probability with which each of its documents is kept; no probability passes 1, and what a full cell
cannot give is raked over the others. A document's draw is a hash of its id and text.

Targets are shares by value of each margin, given or, by default, the present shares raised to a power
below 1 (small values gain). Every source, language and topic has cells of its own, unless ``sources`` or
``languages`` ask to fold all but the values with the most tokens into one. Up to ``CELLS`` cells are
raked on the driver, more as a table, by the same steps. Raking ends when every margin is met to 1e-9 or
after ``CYCLES`` cycles; ``residual`` tells by how much the worst margin is then missed.

Topics are those of a given column, or told by keyword patterns: the topic with the most matches, ties
to the first, ``general`` without any. A document's tokens are its runs of non-space characters.

Nulls: a null source or language is the value ``unknown``; null text has no tokens and no topic
keyword. Rows that tie on id and text share their draw. A target for a value that no document has is
spread over the others. An empty table gives an empty result. Extra columns are carried and may have
any names.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segrec.llm.common import materialise, packed_row, text_or_empty

#: Patterns of the topics; fixed values.
TOPICS = {
    "legal": r"(?i)licen[cs]e|copyright|warranty|all rights reserved",
    "tables": r" \| ",
    "contact": r"[\w.]+@[\w.]+|https?://",
    "numbers": r"\d{4,}",
}
#: Lower-case literals that are as many as a pattern's matches: they can't overlap.
LITERALS = {
    TOPICS["legal"]: ("license", "licence", "copyright", "warranty", "all rights reserved"),
    TOPICS["tables"]: (" | ",),
}
GENERAL, UNKNOWN, OTHER = "general", "unknown", "(other)"
#: Cells that the driver rakes; more are raked as a table.
CELLS = 100_000
#: Powers of the present shares that are the default targets.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.9}
KEEP = 0.6
CYCLES = 500
SEED = 17


def _times(text: Column, word: str) -> Column:
    """How often a literal occurs in a text; plain byte search, much cheaper than a pattern."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(word), F.lit("")))) / len(word.encode())


def _matches(text: Column, pattern: str) -> Column:
    """How often a pattern matches; by literals where these agree with it on every text."""
    if pattern in LITERALS:
        low = F.lower(text) if pattern.startswith("(?i)") else text
        words = LITERALS[pattern]
        return sum((_times(low, w) for w in words[1:]), _times(low, words[0]))
    count = F.regexp_count(text, F.lit(pattern)).cast("double")
    if pattern == TOPICS["contact"]:  # an address can hold the start of a link, but only where there is an @
        return F.when(F.contains(text, F.lit("@")), count).otherwise(_times(text, "http://") + _times(text, "https://"))
    return count


def topic_of(text: Column, topics: Mapping[str, str] = TOPICS) -> Column:
    counts = F.array(*[_matches(text, pattern) for pattern in topics.values()])
    most = F.array_max(counts)
    return F.when(most > 0, F.element_at(F.array(*[F.lit(t) for t in topics]), F.array_position(counts, most).cast("int"))).otherwise(GENERAL)


def tokens_of(text: Column) -> Column:
    r"""Runs of non-space characters, as many as ``\S+`` has matches."""
    for space in "\t\n\v\f\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.size(F.array_remove(F.split(text, " ", -1), "")).cast("bigint")


def rake_cells(tokens: np.ndarray, at: list[np.ndarray], targets: list[np.ndarray], keep: float, cycles: int = CYCLES) -> tuple[np.ndarray, float]:
    """(probability of each cell, worst miss of a margin) so that kept tokens have the target shares along each axis.

    ``at`` holds, for each axis, the number of each cell's value.
    """
    total = tokens.sum() * keep
    chance = np.where(tokens > 0, keep, 0.0)
    goals = []
    for k, target in zip(at, targets, strict=True):
        goal = np.where(np.bincount(k, tokens, len(target)) > 0, target, 0.0)
        goals.append(goal / goal.sum() * total if goal.sum() else np.bincount(k, tokens * chance, len(target)).astype(float))

    def missed(k: np.ndarray, goal: np.ndarray) -> np.ndarray:
        now = np.bincount(k, tokens * chance, len(goal))
        return np.divide(goal, now, out=np.ones_like(goal), where=now > 0)

    worst = 0.0
    for _ in range(cycles):
        worst = 0.0
        for k, goal in zip(at, goals, strict=True):
            scale = missed(k, goal)
            worst = max(worst, np.abs(scale - 1).max(initial=0.0))
            chance = chance * scale[k]
        chance = np.minimum(chance, 1.0)
        if worst < 1e-9:
            break
    return chance, max([np.abs(missed(k, goal) - 1).max(initial=0.0) for k, goal in zip(at, goals, strict=True)], default=0.0)


def rake(tokens: np.ndarray, targets: list[np.ndarray], keep: float, cycles: int = CYCLES) -> np.ndarray:
    """``rake_cells`` for an array with one axis for each margin."""
    at = [k.ravel() for k in np.indices(tokens.shape)]
    return rake_cells(tokens.ravel(), at, targets, keep, cycles)[0].reshape(tokens.shape)


MARGINS = ("source", "lang", "topic")


def _goal(margin: str, value: Column, present: Column, targets: Mapping[str, Mapping[str, float]] | None) -> Column:
    if not targets or margin not in targets:
        return present ** POWERS[margin]
    goal = F.lit(0.0)
    for name, share in targets[margin].items():
        goal = F.when(value == name, float(share)).otherwise(goal)
    return F.when(present > 0, goal).otherwise(0.0)


def rake_table(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, keep: float, cycles: int = CYCLES) -> tuple[DataFrame, float]:
    """``rake_cells`` for a table (source, lang, topic, n) of any size: (the cells with their probability, worst miss)."""
    total = (cells.agg(F.sum("n")).first()[0] or 0) * keep
    goals = {}
    for m in MARGINS:
        shares = materialise(cells.groupBy(m).agg(F.sum("n").cast("double").alias("n")).select(m, _goal(m, F.col(m), F.col("n"), targets).alias("goal")), f"goals_{m}")
        whole = shares.agg(F.sum("goal")).first()[0]
        goals[m] = shares.withColumn("goal", F.col("goal") / whole * total) if whole else None
    cells = cells.withColumn("probability", F.when(F.col("n") > 0, F.lit(keep)).otherwise(0.0))

    def scales(m: str) -> DataFrame:
        return cells.groupBy(m).agg(F.sum(F.col("n") * F.col("probability")).alias("now")).join(goals[m], m).select(m, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(1.0).alias("scale"))

    for _ in range(cycles):
        worst = 0.0
        for m in MARGINS:
            if goals[m] is not None:
                step = materialise(scales(m), f"scales_{m}")
                worst = max(worst, step.agg(F.max(F.abs(F.col("scale") - 1))).first()[0] or 0.0)
                cells = materialise(cells.join(step, m).withColumn("probability", F.col("probability") * F.col("scale")).drop("scale"), "raked")
        cells = cells.withColumn("probability", F.least(F.lit(1.0), "probability"))
        if worst < 1e-9:
            break
    left = [scales(m).agg(F.max(F.abs(F.col("scale") - 1))).first()[0] or 0.0 for m in MARGINS if goals[m] is not None]
    return cells.select(*MARGINS, "probability"), max(left, default=0.0)


def _raked(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, keep: float, cycles: int) -> tuple[DataFrame, float]:
    rows = cells.limit(CELLS + 1).collect()
    if len(rows) > CELLS:
        return rake_table(cells, targets, keep, cycles)
    at, goals = [], []
    tokens = np.array([r["n"] for r in rows], float)
    for m in MARGINS:
        values = sorted({r[m] for r in rows})
        number = {v: i for i, v in enumerate(values)}
        at.append(np.array([number[r[m]] for r in rows], np.int64))
        given = targets.get(m) if targets else None
        goals.append(np.array([given.get(v, 0.0) for v in values], float) if given is not None else np.bincount(at[-1], tokens, len(values)) ** POWERS[m])
    chance, residual = rake_cells(tokens, at, goals, keep, cycles)
    table = [(*(r[m] for m in MARGINS), float(p)) for r, p in zip(rows, chance, strict=True)]
    # at most CELLS rows, so they can be broadcast
    return F.broadcast(cells.sparkSession.createDataFrame(table, "source string, lang string, topic string, probability double")), float(residual)


def _frame(df: DataFrame, carried: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str | None) -> DataFrame:
    text = text_or_empty(text_col)
    return df.select(
        packed_row(carried).alias("__row"),
        F.coalesce(F.col(source_col).cast("string"), F.lit(UNKNOWN)).alias("__source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("__lang"),
        (F.coalesce(F.col(topic_col).cast("string"), F.lit(UNKNOWN)) if topic_col else topic_of(text)).alias("__topic"),
        tokens_of(text).alias("__tokens"),
        ((F.xxhash64(F.col(id_col), text, F.lit(SEED)).bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)).alias("__draw"),
    )


def _named(rows: DataFrame, column: str, most: int | None) -> list[str] | None:
    if most is None:
        return None
    top = rows.groupBy(column).agg(F.sum("__tokens").alias("n")).orderBy(F.desc("n"), column).limit(most).collect()
    return [r[0] for r in top]


def _folded(column: str, values: list[str] | None) -> Column:
    return F.col(column) if values is None else F.when(F.col(column).isin(values), F.col(column)).otherwise(OTHER)


def annotate(
    df: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    keep: float = KEEP,
    sources: int | None = None,
    languages: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic_col: str | None = None,
    carry_text: bool = True,
    cycles: int = CYCLES,
) -> DataFrame:
    """Rows (__row, topic, tokens, probability, residual, kept): ``df``'s columns in the struct __row, and the decision.

    ``targets`` maps ``source``, ``lang`` and ``topic`` to shares by value. Without ``carry_text`` the
    struct leaves the text out, and texts are read once: what is told of them is kept in a table.
    """
    rows = _frame(df, df if carry_text else df.drop(text_col), id_col, text_col, source_col, lang_col, topic_col)
    if not carry_text:
        rows = materialise(rows, "told")
    fine = materialise(rows.groupBy("__source", "__lang", "__topic").agg(F.sum("__tokens").alias("__tokens")), "cells")
    fold = {"__source": _folded("__source", _named(fine, "__source", sources)), "__lang": _folded("__lang", _named(fine, "__lang", languages))}
    cells = fine.groupBy(fold["__source"].alias("source"), fold["__lang"].alias("lang"), F.col("__topic").alias("topic")).agg(F.sum("__tokens").alias("n"))
    chances, residual = _raked(cells, targets, keep, cycles)
    chances = chances.withColumnsRenamed({m: f"c_{m}" for m in MARGINS})
    met = (fold["__source"] == F.col("c_source")) & (fold["__lang"] == F.col("c_lang")) & (F.col("__topic") == F.col("c_topic"))
    told = rows.join(chances, met, "left")
    return told.select("__row", F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), "probability", F.lit(residual).alias("residual"), (F.col("__draw") < F.col("probability")).alias("kept"))


def sample(df: DataFrame, **parameters) -> DataFrame:
    """The rows of ``df`` that are kept, with its columns."""
    return annotate(df, **parameters).where("kept").select("__row.*")
