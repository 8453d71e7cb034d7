"""Problem 5: parent-child links to roots, depths, rings, paths, descendants.

Every node has at most one parent, so links form trees and rings. A weighted
disjoint-set forest finds them: within a bucket of links each node is pointed
at the farthest ancestor the bucket knows, with the number of steps (offset) and
the smallest id passed. Buckets are ranges of ids with at most ``BUCKET_LINKS``
links each, whoever their parents are. They are merged hierarchically: each
level looks the pointed-at ancestor up in the level's results (which joins two
sets and adds their offsets), drops what is settled, and cuts the rest into
buckets anew, each of a wider range of ids, until all that is left fits in one.
A ring is a chain that comes back to its start; its id is the smallest id passed.

Looking up doubles every chain, so log2(chain) levels settle all trees however
the links are spread; what is unsettled after more levels than log2(nodes) lies
on, or runs into, a ring that has been passed whole. An ancestor that many nodes
point at is looked up by salted rows (``relational.lookup``). A row is written
again only while it is unsettled.

Edge cases: a category's rows of the latest ``_batch_date`` hold, and of those
the latest ``_ingested_at``, then the larger row position; null ids are left
out; a parent that is null or not in the table makes a root; a node that is its
own parent is a ring of one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, discard
from .relational import HOT_ROWS, lookup
from .segments import in_pieces

#: Most links of a bucket.
BUCKET_LINKS = 25_000

_STATE = "id long, anchor long, steps long, low long, done boolean, ring boolean"


def latest(categories: DataFrame) -> DataFrame:
    """(id, parent, name) of each category's holding row."""
    order = F.struct("_batch_date", "_ingested_at", "_source_object_row_position", "_batch_id", "_source_object")
    rows = categories.filter(F.col("category_id").isNotNull()).groupBy(F.col("category_id").cast("long").alias("id"))
    best = rows.agg(F.max_by(F.struct(F.col("parent_category_id").cast("long").alias("parent"), "name"), order).alias("r"))
    return best.select("id", "r.parent", "r.name")


def merge_bucket(pdf):
    """Weighted union of one bucket's links (id -> anchor): each id is pointed
    at the farthest anchor known here. ``done`` marks ids on or before a ring
    that lies in this bucket; their anchor is then the ring's smallest id."""
    import pandas as pd

    ids, anchors, steps, lows = (pdf[c].tolist() for c in ("id", "anchor", "steps", "low"))
    link = {i: (a, s, m) for i, a, s, m in zip(ids, anchors, steps, lows, strict=True)}
    out: dict[int, tuple] = {}
    for start in ids:
        if start in out:
            continue
        trail, at, seen = [], start, {}
        while at in link and at not in out and at not in seen:
            seen[at] = len(trail)
            trail.append(at)
            at = link[at][0]
        if at in seen and at not in out:  # a ring: everything from seen[at] on
            ring = trail[seen[at] :]
            low = min(link[n][2] for n in ring)
            for n in ring:
                out[n] = (low, 0, low, True, True)
            trail, at = trail[: seen[at]], ring[0]
        for n in reversed(trail):
            a, s, m = link[n]
            if a not in out:
                out[n] = (a, s, m, False, False)
            else:
                a2, s2, m2, done, ring = out[a]
                out[n] = (a2, 0, a2, True, True) if ring else (a2, s + s2, min(m, m2), done, False)
    rows = [(i, *out[i]) for i in ids]
    return pd.DataFrame(rows, columns=["id", "anchor", "steps", "low", "done", "ring"])


def roots(nodes: DataFrame, bucket_links: int = BUCKET_LINKS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, root, depth) of (id, parent) rows with unique ids. Depth -1 marks a
    chain that never ends; root is then the smallest id of its ring."""
    links = nodes.select("id", "parent")
    links = cut(links, "nodes")
    total = links.count()
    linked = lookup(links, "parent", links.select(F.col("id").alias("__p")), "__p", hot_rows=hot_rows, rows=total)
    anchor = F.coalesce("__p", "id")
    state = linked.select(
        "id",
        anchor.alias("anchor"),
        F.when(F.col("__p").isNull(), 0).otherwise(1).cast("long").alias("steps"),
        F.least("id", anchor).alias("low"),
        F.col("__p").isNull().alias("done"),
        F.lit(False).alias("ring"),
    )
    state = cut(state, "links")
    written, settled = [links, state], state.filter("done")
    for _ in range(total.bit_length() + 2):
        waiting = state.filter("not done")
        n = waiting.count()
        if n == 0:
            break
        placed = in_pieces(waiting, ["id"], bucket_links, "bucket", "buckets", -(-n // bucket_links))
        merged = cut(placed.groupBy("bucket").applyInPandas(merge_bucket, _STATE), "merged")
        discard(placed)
        known = merged.unionByName(settled).select(F.col("id").alias("__i"), F.col("anchor").alias("__a"), F.col("steps").alias("__s"), F.col("low").alias("__l"), F.col("done").alias("__d"), F.col("ring").alias("__r"))
        moved = lookup(merged.filter("not done"), "anchor", known, "__i", hot_rows=hot_rows, rows=n).select(
            "id",
            F.coalesce("__a", "anchor").alias("anchor"),
            (F.col("steps") + F.coalesce("__s", F.lit(0))).alias("steps"),
            F.least("low", F.coalesce("__l", "low")).alias("low"),
            F.coalesce("__d", F.lit(True)).alias("done"),
            F.coalesce("__r", F.lit(False)).alias("ring"),
        )
        state = cut(moved, "links")
        written += [merged, state]
        settled = settled.unionByName(merged.filter("done")).unionByName(state.filter("done"))
    # unsettled after all levels: the chain has passed its whole ring; the
    # anchor lies on it, and what the anchor passed is that ring
    left = state.filter("not done")
    lows = left.select(F.col("id").alias("__i"), F.col("low").alias("__l"))
    rest = lookup(left, "anchor", lows, "__i", "inner", hot_rows, left.count()).select("id", F.col("__l").alias("anchor"), "steps", "low", "done", F.lit(True).alias("ring"))
    out = settled.unionByName(rest).select("id", F.col("anchor").alias("root"), F.when(F.col("ring"), -1).otherwise(F.col("steps")).cast("long").alias("depth"))
    out = cut(out, "roots")
    discard(*written)
    return out


def paths(nodes: DataFrame, found: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, root, depth, path): the ids from the root down to the node. Nodes on
    or before a ring have no path (null). The parent index is traversed by
    doubling: each round looks up the ancestor reached so far and puts that
    one's piece of path in front, so log2(depth) rounds do."""
    depth = found.agg(F.max("depth")).first()[0] or 0
    state = found.filter("depth >= 0").join(nodes.select("id", "parent"), "id")
    state = state.select("id", "root", "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("anchor"), F.array("id").alias("path"))
    state, total = cut(state, "paths"), found.count()
    for _ in range(int(depth).bit_length()):
        index = state.select(F.col("id").alias("__i"), F.col("anchor").alias("__a"), F.col("path").alias("__p"))
        longer = F.when(F.col("__p").isNull(), F.col("path")).otherwise(F.concat("__p", "path")).alias("path")
        before, state = state, cut(lookup(state, "anchor", index, "__i", hot_rows=hot_rows, rows=total).select("id", "root", "depth", F.col("__a").alias("anchor"), longer), "paths")
        discard(before)
    rings = found.filter("depth < 0").select("id", "root", "depth", F.lit(None).cast("array<bigint>").alias("path"))
    return state.select("id", "root", "depth", "path").unionByName(rings)


def whole_paths(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, root, depth, path, chain) of every node, rings included. On or before
    a ring (depth -1) the path starts at the ring's smallest id and follows the
    ring to the node. The chain holds all ancestors, the farthest first and the
    node last; it is the path, led there by the ring's ids that the path misses,
    as each id of a ring descends from every other."""
    trees = paths(nodes, found).filter("depth >= 0").withColumn("chain", F.col("path"))
    looped = cut(found.filter("depth < 0").join(nodes.select("id", "parent"), "id"), "looped")
    opened = looped.select("id", F.when(F.col("id") != F.col("root"), F.col("parent")).alias("parent"))
    p = cut(paths(opened, roots(opened)).select("id", "root", "path"), "opened")
    # the parent of a ring's smallest id is the last on its path, which is the ring
    last = looped.filter("id = root").select(F.col("parent").alias("id"))
    rings = p.join(last, "id").select(F.col("root").alias("__root"), F.col("path").alias("__ring"))
    chain = F.concat(F.array_except("__ring", "path"), F.col("path"))
    return trees.unionByName(lookup(p, "root", rings, "__root", "inner").select("id", "root", F.lit(-1).cast("long").alias("depth"), "path", chain.alias("chain")))


def descendants(with_chains: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every pair along a chain, the node
    itself at distance 0; distances in a ring count the links upwards."""
    pairs = with_chains.select(F.posexplode("chain").alias("at", "ancestor"), F.col("id").alias("descendant"), F.size("chain").alias("n"))
    return pairs.select("ancestor", "descendant", (F.col("n") - 1 - F.col("at")).cast("long").alias("distance"))
