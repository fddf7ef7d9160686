"""Trees over node tables by an index: the place of each node in a walk from the top, its depth and how many nodes it has under it.

`tree_index` follows all pointers to heads twice as far in each round, so a tree of depth d takes about log2(d) joins; paths from the top, compared as arrays, give the
order of the walk. With it what stands below a head is a range (`below`), a tree's text needs no recursion (`outline`, `nested`), and a reduced tree is the index of a contracted
table (`reduced`): coordinations become one node, function words and what hangs on them go.

What the rounds store is dealt by sentence: over nodes that are dealt so, no step within `scratch.co_located` shuffles.

Nodes are rows of sentence_id, i, head_i (-1 at a top), dep, word or lemma. A head that isn't there makes a top. Nodes on a cycle, or under one, have no place: they are left out, as
are the sentences that have no others. Children stand in the order of i. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import dealt
from .references import asof_equal, lemma

# Dependencies of function words, and lemmas that part alternatives.
FUNCTION = ("det", "case", "punct", "cc", "mark", "aux", "cop")
ALTERNATIVE = ("or", "nor", "either")

S = "sentence_id"


def paths(nodes: DataFrame) -> DataFrame:
    """sentence_id, i and path, the nodes from the top to it, of every node that hangs on a top."""
    known = nodes.select(S, F.col("i").alias("head_i"), F.lit(True).alias("_known"))
    at = nodes.select(S, "i", "head_i").join(known, [S, "head_i"], "left")
    at = dealt(at.select(S, "i", F.when(F.col("_known"), F.col("head_i")).alias("on"), F.array("i").alias("path")), "paths", S, already=True)
    done = at.filter("on IS NULL")
    while True:
        # A path that meets itself is on a cycle or comes from one.
        open_ = at.filter("on IS NOT NULL").filter(F.size(F.array_distinct("path")) == F.size("path"))
        if open_.isEmpty():
            return done.select(S, "i", "path")
        step = at.select(S, F.col("i").alias("on"), F.col("on").alias("_on"), F.col("path").alias("_path"))
        moved = open_.join(step, [S, "on"]).select(S, "i", F.col("_on").alias("on"), F.concat("_path", "path").alias("path"))
        at = dealt(moved.unionByName(done.select(S, "i", F.lit(None).cast("int").alias("on"), "path")), "paths", S, already=True)
        done = at.filter("on IS NULL")


def tree_index(nodes: DataFrame) -> DataFrame:
    """sentence_id, i, pre (from 0), depth, size (with itself) and path."""
    at = dealt(paths(nodes), "paths", S, already=True)
    size = at.select(S, F.explode("path").alias("i")).groupBy(S, "i").agg(F.count(F.lit(1)).alias("size"))
    pre = F.row_number().over(Window.partitionBy(S).orderBy("path")) - 1
    return at.withColumns({"pre": pre, "depth": F.size("path") - 1}).join(size, [S, "i"]).select(S, "i", "pre", "depth", "size", "path")


def below(index: DataFrame, heads: DataFrame, strict: bool = True) -> DataFrame:
    """The nodes below each head (sentence_id, head), by a range of the walk; with strict false the head too."""
    span = index.join(heads.select(S, F.col("head").alias("i")).distinct(), [S, "i"]).select(S, F.col("i").alias("head"), F.col("pre").alias("lo"), (F.col("pre") + F.col("size")).alias("hi"))
    return index.join(span, S).filter((F.col("pre") >= F.col("lo") + int(strict)) & (F.col("pre") < F.col("hi"))).select(S, "head", "i", "pre", "depth", "size")


def conjunct_roots(nodes: DataFrame) -> DataFrame:
    """sentence_id, i and root, the node that its conjunction starts with (itself, if it is no conjunct)."""
    chain = nodes.select(S, "i", F.when(F.col("dep") == "conj", F.col("head_i")).otherwise(-1).alias("head_i"))
    return paths(chain).select(S, "i", F.element_at("path", 1).alias("root"))


def coordination_groups(nodes: DataFrame) -> DataFrame:
    """Coordinations of two members or more: sentence_id, root, members (in order: node, its own entities, those of its compounds and appositions that it lacks) and alternative."""
    none = F.array().cast("array<int>")
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    own = nodes.select(S, "i", F.array_sort(F.array_distinct(F.coalesce("entities", none))).alias("own"))
    more = nodes.filter(F.col("dep").isin("compound", "appos", "amod")).groupBy(S, F.col("head_i").alias("i")).agg(merged("entities").alias("more"))
    signs = nodes.filter((F.col("dep") == "cc") & lemma().isin(*ALTERNATIVE)).select(S, F.col("head_i").alias("i"), F.lit(True).alias("or")).distinct()
    rows = conjunct_roots(nodes).join(own, [S, "i"]).join(more, [S, "i"], "left").join(signs, [S, "i"], "left")
    member = F.struct(F.col("i").alias("node"), F.col("own").alias("head_entities"), F.array_except(F.coalesce("more", none), F.col("own")).alias("modifier_entities"))
    out = rows.groupBy(S, "root").agg(F.array_sort(F.collect_list(member)).alias("members"), F.coalesce(F.bool_or("or"), F.lit(False)).alias("alternative"))
    return out.filter(F.size("members") > 1)


def slots(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Compounds of a coordination's head that are no members of it go to the slot of the last member before them (the first, if none is): sentence_id, root, i and slot, from 0."""
    members = groups.select(S, "root", F.posexplode("members").alias("slot", "m")).select(S, "root", "slot", F.col("m.node").alias("i"))
    heads = nodes.select(S, F.col("i").alias("root"), F.col("head_i").alias("head"))
    loose = nodes.filter("dep = 'compound'").select(S, "i", F.col("head_i").alias("head")).join(members.select(S, "i"), [S, "i"], "left_anti")
    asked = groups.select(S, "root").join(heads, [S, "root"]).join(loose, [S, "head"]).select(S, "root", "i")
    return asof_equal(asked, members, [S, "root"], "i", "slot").withColumn("slot", F.coalesce("slot", F.lit(0)))


def outline(nodes: DataFrame, index: DataFrame, word: str = "word") -> DataFrame:
    """sentence_id and tree: its words as indented lines."""
    rows = index.join(nodes.select(S, "i", word), [S, "i"]).select(S, F.struct("pre", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.coalesce(word, F.lit(""))).alias("line")).alias("x"))
    return rows.groupBy(S).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("tree"))


def nested(index: DataFrame, label: Column) -> DataFrame:
    """sentence_id and tree, a list of objects as JSON: label gives the text of a node's fields. A node closes as many brackets as the walk then leaves levels."""
    rows = index.withColumn("_next", F.lead("depth").over(Window.partitionBy(S).orderBy("pre")))
    closes = F.col("depth") - F.coalesce("_next", F.lit(0)) + 1
    after = F.when(F.col("_next").isNull(), "").when(closes > 0, ",").otherwise("")
    text = F.concat(F.lit("{"), label, F.lit(',"children":['), F.when(closes > 0, F.repeat(F.lit("]}"), closes)).otherwise(""), after)
    rows = rows.select(S, F.struct("pre", text.alias("t")).alias("x"))
    return rows.groupBy(S).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), ""), F.lit("]")).alias("tree"))


def reduced(nodes: DataFrame) -> DataFrame:
    """The contracted table: sentence_id, i, head_i, dep, word and members (the nodes that it stands for). Function words go with all that hangs on them;
    conjuncts become part of the node that their conjunction starts with, and what hung on them hangs on it."""
    chain = dealt(paths(nodes), "paths", S, already=True)
    gone = nodes.filter(F.col("dep").isin(*FUNCTION)).select(S, F.col("i").alias("x"))
    dropped = chain.select(S, "i", F.explode("path").alias("x")).join(gone, [S, "x"], "left_semi").select(S, "i").distinct()
    content = dealt(nodes.select(S, "i", "head_i", "dep", "word").join(chain.select(S, "i"), [S, "i"], "left_semi").join(dropped, [S, "i"], "left_anti"), "content", S, already=True)
    roots = dealt(conjunct_roots(content), "roots", S, already=True)
    members = roots.groupBy(S, F.col("root").alias("i")).agg(F.array_sort(F.collect_list("i")).alias("members"))
    heads = roots.select(S, F.col("i").alias("head_i"), F.col("root").alias("_head"))
    return content.join(members, [S, "i"]).join(heads, [S, "head_i"], "left").select(S, "i", F.coalesce("_head", F.lit(-1)).alias("head_i"), "dep", "word", "members")


def reduced_trees(nodes: DataFrame) -> DataFrame:
    """sentence_id and tree: the reduced tree as JSON, each node with its id, kind (group or lexical), role, text and members."""
    small = dealt(reduced(nodes), "reduced", S, already=True)
    rows = tree_index(small).join(small.select(S, "i", "dep", "word", "members"), [S, "i"])
    fields = F.struct(F.col("i").alias("id"), F.when(F.size("members") > 1, "group").otherwise("lexical").alias("kind"), F.coalesce("dep", F.lit("")).alias("role"), F.coalesce("word", F.lit("")).alias("text"), "members")
    return nested(rows.withColumn("_t", F.to_json(fields)), F.substr("_t", F.lit(2), F.length("_t") - 2))
