"""Problem 8: mixing sources to target shares of all tokens.

Documents fall into cells of (source, language, topic). The tokens of each cell
are counted over the whole corpus; on the table of cells, iterative proportional
fitting rakes one weight per cell so that the weighted tokens meet the marginals
of source, language and topic in turn, until no weight moves any more. Weights
never exceed the source's ``max_repeats``, and the total is the largest at which
every source can still give its share. Source shares are the contract and are
fitted last and exactly; language and topic keep the corpus' own shares as far
as caps allow, and ``marginals`` reports how far that is.

Up to ``DRIVER_CELLS`` cells are raked as arrays on the driver. More are raked by
the same rounds as aggregations and joins on the executors; no cell or topic is
merged or left out for its number.

A document is then taken ``floor(weight)`` times and once more with the
probability of the rest, by a hash of its id. The cut on that hash is calibrated
per source from a histogram of tokens, so that the sampled tokens, not only the
expected ones, reach the share to within a histogram bin or a document.

Edge cases: sources without target, and null sources, are not in the mix; a
target without documents gets share 0 and its part goes to the others in
proportion; texts without tokens (null, empty) are left out; a null share counts
as 0, null repeats as 1; no reachable target gives an empty mix. The topic is the
first tag, the empty text where there is none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import lookup
from ..runtime import cut, discard
from .tokenize import token_counts

#: Cells that are raked on the driver, at about 100 bytes each; targets are
#: configuration and at most this many.
DRIVER_CELLS, MOST_TARGETS = 200_000, 10_000
#: Rounds end when no weight moves by this part of itself, or after so many.
TOLERANCE, ROUNDS = 1e-6, 200
BINS = 4096


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    repeats: int


def targets_of(table: DataFrame) -> list[Target]:
    """Targets are configuration: one row per source."""
    rows = table.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError("more sources than a table of targets can have")
    return [Target(r.source, max(0.0, r.share or 0.0), max(1, r.repeats or 1)) for r in sorted(rows, key=lambda r: r.source or "") if r.source is not None]


def sized(docs: DataFrame, targets: list[Target]) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of the documents of the targets'
    sources that have tokens, written once."""
    listed = docs.filter(F.col("source").isin([t.source for t in targets]))
    lang = F.regexp_extract(F.lower(F.trim(F.coalesce("lang", F.lit("")))), "^([a-z]{2,3})", 1)
    topic = F.lower(F.trim(F.split_part(F.coalesce("tags", F.lit("")), F.lit(","), F.lit(1))))
    # the text is replaced by its size on the way; all else travels in one key
    key = F.struct("doc_id", "source", F.when(lang == "", "und").otherwise(lang).alias("lang"), topic.alias("topic")).alias("key")
    sizes = token_counts(listed.select(key, "text"), "key", "text")
    return cut(sizes.filter("n_tokens > 0").select("key.*", "n_tokens"), "sized")


def rake(source: np.ndarray, lang: np.ndarray, topic: np.ndarray, tokens: np.ndarray, share: np.ndarray, cap: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of cells. ``source``, ``lang`` and ``topic`` are level numbers,
    ``share`` and ``cap`` belong to source levels."""
    have = np.bincount(source, tokens, len(share))
    share = np.where(have > 0, share, 0.0)
    if share.sum() <= 0:
        return np.zeros(len(tokens))
    share = share / share.sum()
    total = min(cap[s] * have[s] / share[s] for s in range(len(share)) if share[s] > 0)
    limit = cap[source].astype(float)
    wanted = share[source] > 0
    w = np.where(wanted, np.minimum(1.0, limit), 0.0)
    lang_goal = np.bincount(lang, tokens * wanted) / (tokens * wanted).sum() * total
    topic_goal = np.bincount(topic, tokens * wanted) / (tokens * wanted).sum() * total
    for _ in range(rounds):
        before = w
        for level, goal in ((topic, topic_goal), (lang, lang_goal)):
            now = np.bincount(level, w * tokens, len(goal))
            w = np.minimum(w * np.divide(goal, now, out=np.ones_like(goal), where=now > 0)[level], limit)
        w = _fit_sources(w, source, tokens, share * total, limit)
        if np.abs(w - before).max(initial=0) <= TOLERANCE * max(w.max(initial=0), 1e-300):
            break
    return w


def _fit_sources(w, source, tokens, goal, limit):
    """Scale each source to its goal; what hits the cap stays there and the rest
    takes over, so the goal is met exactly as long as the caps allow it."""
    w = w.copy()
    for s in np.flatnonzero(goal > 0):
        own = np.flatnonzero(source == s)
        free = np.ones(len(own), bool)
        for _ in range(len(own) + 1):
            fixed = (limit[own] * tokens[own])[~free].sum()
            now = (w[own] * tokens[own])[free].sum()
            if now <= 0:
                break
            scaled = w[own] * (goal[s] - fixed) / now
            over = free & (scaled > limit[own] * (1 + 1e-12))
            if not over.any():
                w[own[free]] = scaled[free]
                break
            free &= ~over
            w[own[over]] = limit[own[over]]
        w[own[~free]] = limit[own[~free]]
    return np.where(goal[source] > 0, w, 0.0)


def _rake_on_driver(cells: DataFrame, targets: list[Target]) -> DataFrame:
    pdf, names = cells.toPandas(), [t.source for t in targets]
    source = pdf.source.map({n: k for k, n in enumerate(names)}).to_numpy()
    codes = [pdf[c].astype("category").cat.codes.to_numpy() for c in ("lang", "topic")]
    pdf["w"] = rake(source, *codes, pdf.n.to_numpy(float), np.array([t.share for t in targets]), np.array([t.repeats for t in targets]))
    return cells.sparkSession.createDataFrame(pdf, "source string, lang string, topic string, n long, w double")


def _rake_on_executors(cells: DataFrame, targets: list[Target], rounds: int) -> DataFrame:
    """The rounds of ``rake`` over a table of cells; the driver sees sums per
    source only."""
    have = {r.source: float(r.n) for r in cells.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    wanted = [t for t in targets if t.share > 0 and have.get(t.source, 0) > 0]
    if not wanted:
        return cells.withColumn("w", F.lit(0.0))
    whole, all_tokens = sum(t.share for t in wanted), sum(have[t.source] for t in wanted)
    total = min(t.repeats * have[t.source] * whole / t.share for t in wanted)
    goals = {t.source: t.share / whole * total for t in wanted}
    caps = _of_source({t.source: float(t.repeats) for t in wanted})
    state = cut(cells.filter(caps.isNotNull()).withColumn("cap", caps).withColumn("w", F.least(F.lit(1.0), "cap")), "raked")
    for _ in range(rounds):
        moved = state.withColumn("was", F.col("w"))
        for level in ("topic", "lang"):
            now = moved.groupBy(F.col(level).alias("__level")).agg(F.sum(F.col("w") * F.col("n")).alias("__now"), F.sum("n").alias("__have"))
            scaled = F.when(F.col("__now") > 0, F.col("w") * F.col("__have") * (total / all_tokens) / F.col("__now")).otherwise(F.col("w"))
            moved = lookup(moved, level, now, "__level", "inner").withColumn("w", F.least(scaled, "cap")).drop("__level", "__now", "__have")
        moved = cut(moved, "moved")
        factor = dict.fromkeys(goals, 1.0)
        for _ in range(len(goals) + 100):  # what hits the cap stays there, the rest takes over
            s = F.col("w") * _of_source(factor)
            capped = s >= F.col("cap")
            sums = moved.groupBy("source").agg(F.sum(F.when(capped, F.col("cap") * F.col("n")).otherwise(0.0)).alias("fixed"), F.sum(F.when(~capped, F.col("w") * F.col("n")).otherwise(0.0)).alias("free")).collect()
            new = {r.source: (goals[r.source] - r.fixed) / r.free if r.free > 0 else factor[r.source] for r in sums}
            still = all(abs(new[k] - factor[k]) <= 1e-12 * abs(new[k]) for k in new)
            factor = factor | new
            if still:
                break
        fitted = cut(moved.withColumn("w", F.least(F.col("w") * _of_source(factor), "cap")), "raked")
        discard(state, moved)
        off = fitted.agg(F.max(F.abs(F.col("w") - F.col("was"))).alias("off"), F.max("w").alias("most")).first()
        state = fitted.drop("was")
        state._scratch = fitted._scratch
        if off.off <= TOLERANCE * off.most:
            break
    return state.select("source", "lang", "topic", "n", "w")


def _of_source(values: dict[str, float]):
    """A number by source; at most MOST_TARGETS of them."""
    if not values:
        return F.lit(None).cast("double")
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("source"))


def weights(rows: DataFrame, targets: list[Target], driver_cells: int = DRIVER_CELLS, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, n tokens, w) of every cell."""
    cells = cut(rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n")), "cells")
    return _rake_on_driver(cells, targets) if cells.count() <= driver_cells else _rake_on_executors(cells, targets, rounds)


def marginals(cells: DataFrame) -> DataFrame:
    """(kind, level, corpus_share, mixed_share): the shares of languages and
    topics in the sources of the mix, before and after."""
    used, out = cells.withColumn("mixed", F.col("w") * F.col("n")), None
    for kind in ("lang", "topic"):
        g = used.groupBy(F.col(kind).alias("level")).agg(F.sum("n").alias("n"), F.sum("mixed").alias("m"))
        whole = used.agg(F.sum("n").alias("all_n"), F.sum("mixed").alias("all_m"))  # one row
        part = g.crossJoin(whole).select(F.lit(kind).alias("kind"), "level", (F.col("n") / F.col("all_n")).alias("corpus_share"), (F.col("m") / F.nullif("all_m", F.lit(0.0))).alias("mixed_share"))
        out = part if out is None else out.unionByName(part)
    return out


def mix(rows: DataFrame, targets: list[Target], seed: int = 7, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents taken."""
    cells = weights(rows, targets, driver_cells)
    cell = F.xxhash64("source", "lang", "topic")  # equal hashes are told apart below
    table = cells.groupBy(cell.alias("__cell")).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("source", "lang", "topic"), "w"))).alias("__w"))
    keyed = lookup(rows.withColumn("cell", cell), "cell", table, "__cell", "inner")
    drawn = keyed.withColumn("w", F.element_at("__w", F.struct("source", "lang", "topic")))
    lot = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor(F.col("w") + 1e-9).cast("int")
    part = F.greatest(F.col("w") - whole, F.lit(0.0))
    drawn = drawn.select("doc_id", "source", "n_tokens", whole.alias("whole"), F.when(part > 1e-9, lot / part).alias("q"))
    bin_ = F.least(F.floor(F.col("q") * (BINS / 2)), F.lit(BINS - 1)).cast("int")
    counted = drawn.groupBy("source", bin_.alias("bin")).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("whole")).alias("sure"))
    # per source at most BINS rows: the edge at which the drawn tokens come closest to what is left to draw
    goal = cells.groupBy("source").agg(F.sum(F.col("w") * F.col("n")).alias("goal"))
    sure = counted.groupBy("source").agg(F.sum("sure").alias("sure")).join(goal, "source").select("source", (F.col("goal") - F.col("sure")).alias("rest"))
    edges = counted.filter("bin is not null").select("source", (F.col("bin") + 1).alias("edge"), "n").unionByName(sure.select("source", F.lit(0).alias("edge"), F.lit(0).cast("long").alias("n")))
    upto = edges.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("edge"))).join(sure, "source")
    limits = upto.groupBy("source").agg((F.min_by("edge", F.struct(F.abs(F.col("upto") - F.col("rest")), "edge")) / (BINS / 2)).alias("cut"))
    extra = F.coalesce(F.col("q") < F.col("cut"), F.lit(False)).cast("int")
    taken = drawn.join(F.broadcast(limits), "source")  # one row per target, MOST_TARGETS at most
    return taken.withColumn("copies", F.col("whole") + extra).filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(rows: DataFrame, taken: DataFrame, targets: list[Target]) -> DataFrame:
    """One row per target with what the mix reached."""
    spark = rows.sparkSession
    have = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens_available"))
    got = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_mixed"), F.max("copies").alias("most_copies"), F.sum("copies").alias("documents_mixed"))
    table = spark.createDataFrame([(t.source, float(t.share), int(t.repeats)) for t in targets], "source string, target_share double, max_repeats int")
    out = table.join(have, "source", "left").join(got, "source", "left").fillna(0)
    total = F.sum("tokens_mixed").over(Window.partitionBy())  # one row per target
    return out.withColumn("actual_share", F.when(total > 0, F.col("tokens_mixed") / total).otherwise(0.0))
