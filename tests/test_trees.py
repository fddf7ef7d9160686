import json
import random

from accordant.operators import trees as X

NODES = "sentence_id string, i int, head_i int, dep string, word string, lemma string, entities array<int>"


def table(spark, rows, name="s"):
    return spark.createDataFrame([(name, i, h, d, w, w, list(e)) for i, h, d, w, e in rows], NODES)


def test_index_against_a_walk(spark):
    random.seed(6)
    heads = [-1] + [random.randrange(-1, i) for i in range(1, 80)]
    order = list(range(80))
    random.shuffle(order)
    name = {old: new for new, old in enumerate(order)}
    rows = [(name[i], name[h] if h >= 0 else -1, "x", f"w{i}", []) for i, h in enumerate(heads)]
    nodes = table(spark, rows)
    kids = {}
    for i, h, *_ in rows:
        kids.setdefault(h, []).append(i)
    walk = []

    def down(i, depth):
        at = len(walk)
        walk.append([i, at, depth, 0])
        for k in sorted(kids.get(i, [])):
            down(k, depth + 1)
        walk[at][3] = len(walk) - at

    for top in sorted(kids[-1]):
        down(top, 0)
    index = X.tree_index(nodes)
    assert sorted((r.i, r.pre, r.depth, r.size) for r in index.collect()) == sorted(map(tuple, walk))
    under = {(r.head, r.i) for r in X.below(index, nodes.selectExpr("sentence_id", "i AS head")).collect()}
    assert under == {(i, walk[at + k][0]) for i, at, _, n in walk for k in range(1, n)}


def test_cycles_and_lost_heads(spark):
    rows = [(0, 1, "x", "a", []), (1, 2, "x", "b", []), (2, 0, "x", "c", []), (3, 2, "x", "d", []), (4, 4, "x", "e", []), (5, 99, "x", "f", []), (6, 5, "x", "g", []), (7, None, "x", "h", [])]
    assert sorted((r.i, r.path) for r in X.tree_index(table(spark, rows)).collect()) == [(5, [5]), (6, [5, 6]), (7, [7])]
    assert X.tree_index(table(spark, rows[:3])).count() == 0 and X.tree_index(table(spark, [])).count() == 0
    long = table(spark, [(i, i - 1, "x", "w", []) for i in range(200)])
    assert max(r.depth for r in X.tree_index(long).collect()) == 199


def test_groups_and_slots(spark):
    rows = [(0, 5, "compound", "A", [1]), (1, 0, "compound", "a", [7, 1]), (2, 0, "cc", "Or", []), (3, 0, "conj", "B", [2]), (4, 5, "compound", "C", [3]), (5, -1, "root", "complexes", []), (6, 5, "compound", "D", [4])]
    nodes = table(spark, rows)
    groups = X.coordination_groups(nodes)
    r = groups.first()
    assert groups.count() == 1 and r.root == 0 and r.alternative and [(m.node, m.head_entities, m.modifier_entities) for m in r.members] == [(0, [1], [7]), (3, [2], [])]
    assert {(s.i, s.slot) for s in X.slots(nodes, groups).collect()} == {(4, 1), (6, 1)}
    first = table(spark, [(0, 3, "compound", "C", [3]), (1, 3, "compound", "A", [1]), (2, 1, "conj", "B", [2]), (3, -1, "root", "x", [])])
    assert {(s.i, s.slot) for s in X.slots(first, X.coordination_groups(first)).collect()} == {(0, 0)}


def test_reduced_tree(spark):
    rows = [(0, 4, "nsubj", "A", []), (1, 0, "cc", "and", []), (2, 0, "conj", "B", []), (3, 2, "amod", "new", []), (4, -1, "root", "bind", []), (5, 6, "case", "to", []), (6, 4, "obl", "C", []), (7, 5, "x", "under to", [])]
    tree = json.loads(X.reduced_trees(table(spark, rows)).first().tree)
    brief = lambda n: (n["id"], n["kind"], n["members"], [brief(c) for c in n["children"]])
    assert [brief(n) for n in tree] == [(4, "lexical", [4], [(0, "group", [0, 2], [(3, "lexical", [3], [])]), (6, "lexical", [6], [])])]
    two = json.loads(X.reduced_trees(table(spark, [(0, -1, "root", "a", []), (1, 0, "x", 'b"\\', []), (2, -1, "root", "c", [])])).first().tree)
    assert [n["id"] for n in two] == [0, 2] and two[0]["children"][0]["text"] == 'b"\\'


def test_outline(spark):
    nodes = table(spark, [(0, 1, "x", "a", []), (1, -1, "x", "b", []), (2, 0, "x", None, []), (3, 1, "x", "d", [])])
    assert X.outline(nodes, X.tree_index(nodes)).first().tree == "b\n  a\n    \n  d"


def test_trees_of_dealt_nodes_are_not_shuffled(spark):
    from accordant.operators import trees
    from accordant.scratch import co_located, dealt

    nodes = spark.createDataFrame([(f"s{k}", i, i - 1) for k in range(9) for i in range(6)], "sentence_id string, i int, head_i int")
    with co_located(spark):
        index = trees.tree_index(dealt(nodes, "nodes", "sentence_id"))
        rows = {(r.i, r.pre, r.depth, r["size"]) for r in index.collect()}
        assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert rows == {(i, i, i, 6 - i) for i in range(6)}
