"""Small graphs within a row: token trees, paths, spans and identity closures, as expressions over arrays.

A tree is an array of heads: heads[i] is the place of node i's head, or -1 at a root. Rows hold a sentence each, so the
arrays are short; nothing is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(heads: Column, node: Column, limit: int = 64) -> Column:
    """The node and its heads up to a root, nearest first; at most limit of them, so a cycle ends too."""
    start = F.array(node.cast("int"))

    def climb(chain: Column, _: Column) -> Column:
        head = F.get(heads, F.element_at(chain, -1))
        return F.when(F.coalesce(head, F.lit(-1)) < 0, chain).otherwise(F.concat(chain, F.array(head.cast("int"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(limit)), start, climb)


def tree_path(up_a: Column, up_b: Column, max_hops: int = 8) -> Column:
    """The nodes from the first of up_a to the first of up_b over their lowest common ancestor, of two ancestor chains; empty
    where there is none or the path has more than max_hops edges. In a tree it is the shortest path."""
    apex = F.get(F.filter(up_a, lambda x: F.array_contains(up_b, x)), F.lit(0))
    at_a, at_b = F.array_position(up_a, apex).cast("int"), F.array_position(up_b, apex).cast("int")
    path = F.concat(F.slice(up_a, F.lit(1), at_a), F.reverse(F.slice(up_b, F.lit(1), at_b - 1)))
    return F.when(apex.isNull() | (at_a + at_b - 2 > max_hops), F.array().cast("array<int>")).otherwise(path)


def nodes_in_span(nodes: Column, start: Column, end: Column) -> Column:
    """Nodes (char_start, char_end) that overlap a half-open span."""
    return F.filter(nodes, lambda n: (n["char_start"] < end) & (n["char_end"] > start))


def nearest_before(nodes: Column, start: Column) -> Column:
    """The node that ends last of those that end at or before start."""
    before = F.filter(nodes, lambda n: n["char_end"] <= start)
    return F.get(F.reverse(F.array_sort(F.transform(before, lambda n: F.struct(n["char_end"].alias("end"), n.alias("node"))))), F.lit(0))["node"]


def identity_closure(n: Column, edges: Column) -> Column:
    """For 0 .. n-1 the least member of each one's class, where edges (a, b) join classes. Each edge relabels the greater class to the lesser, so one pass does."""
    labels = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def join(acc: Column, e: Column) -> Column:
        x, y = F.get(acc, e["a"]), F.get(acc, e["b"])
        low, high = F.least(x, y), F.greatest(x, y)
        return F.transform(acc, lambda v: F.when((v == high) & x.isNotNull() & y.isNotNull(), low).otherwise(v))

    return F.aggregate(edges, labels, join)


def role_pairs(sources: Column, targets: Column) -> Column:
    """Unordered distinct pairs of each source with each target, without pairs of one with itself, sorted."""
    crossed = F.flatten(F.transform(sources, lambda a: F.transform(targets, lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))))
    return F.array_sort(F.array_distinct(F.filter(crossed, lambda p: p["a"] < p["b"])))


def projected_pairs(assertion: Column, relational: Column, directed: Column, sources: Column, targets: Column, participants: Column, same_slots: Column) -> tuple[Column, Column]:
    """Final pairs of an event and the reason: events that aren't asserted have none, relational ones none of their own; directed
    ones each source with each target, by position where the slots are aligned; others every pair of participants."""
    empty = F.array().cast("array<struct<a:int,b:int>>")
    aligned = F.filter(
        F.slice(F.zip_with(sources, targets, lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))), F.lit(1), F.least(F.size(sources), F.size(targets))),
        lambda p: p["a"] != p["b"],
    )
    diagonal = same_slots & (F.size(sources) == F.size(targets))
    pairs = F.when(assertion != "asserted", empty).when(relational, empty).when(directed & diagonal, F.array_sort(F.array_distinct(aligned))).when(directed, role_pairs(sources, targets)).otherwise(role_pairs(participants, participants))
    reason = F.when(assertion != "asserted", "not_asserted").when(relational, "relational").when(directed & diagonal, "aligned").when(directed, "directed").otherwise("undirected")
    return pairs, reason


def render_tree(df: DataFrame, key: str, words: str, heads: str) -> DataFrame:
    """key and tree, the tree as indented lines, children in word order below their head."""

    def lines(w: list, h: list) -> str:
        below: dict[int, list[int]] = {}
        for i, x in enumerate(h):
            below.setdefault(x if 0 <= x < len(h) and x != i else -1, []).append(i)
        out, stack, seen = [], [(i, 0) for i in reversed(below.get(-1, []))], set()
        while stack:
            i, depth = stack.pop()
            if i in seen:
                continue
            seen.add(i)
            out.append("  " * depth + str(w[i]))
            stack += [(c, depth + 1) for c in reversed(below.get(i, []))]
        return "\n".join(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "tree": [lines(list(w), list(h)) if w is not None and h is not None else "" for w, h in zip(b[words], b[heads])]})

    return df.select(key, words, heads).mapInPandas(run, f"{key} {df.select(key).schema[0].dataType.simpleString()}, tree string")
