from accordant.operators import projection as J

EVENT = f"id int, event_type string, asserted boolean, negated boolean, directed boolean, nested boolean, pattern_supported boolean, group_supported boolean, arguments array<{J.ARGUMENT}>, role_pairs array<{J.PAIR}>, compound_pairs array<{J.PAIR}>, internal_pairs array<{J.PAIR}>"


def arg(slot, *entities, allowed=True, exemplar=False, group=False, members=None):
    return (slot, list(entities), allowed, exemplar, group, members)


def planned(spark, *arguments, event_type="INTERACTION", asserted=True, negated=False, directed=False, nested=False, pattern=True, group=True, role=None, compound=None, internal=None):
    df = spark.createDataFrame([(1, event_type, asserted, negated, directed, nested, pattern, group, list(arguments), role, compound, internal)], EVENT)
    r = J.plan(df).first()
    return [(p.a, p.b) for p in r.final_pairs], r.reason_code, r.application_status, r.projection_mode


def test_gates(spark):
    two = (arg("participants", 1), arg("participants", 2))
    assert planned(spark, *two) == ([(1, 2)], J.PROJECTION, "applied", "undirected")
    assert planned(spark, *two, asserted=None)[:3] == ([], J.NOT_ASSERTED, "not_applied") and planned(spark, *two, negated=True)[1] == J.NEGATED
    assert planned(spark, *two, pattern=False)[1] == J.NO_PATTERN and planned(spark, *two, event_type=None)[1:] == (J.NO_PAIRS, "not_applied", "unknown")
    assert planned(spark, event_type=J.STATEMENT)[1:] == (J.REVIEW, "review_only", "relational")
    assert planned(spark, event_type=J.STATEMENT, role=[(4, 2), (3, 3)]) == ([(2, 4)], J.ROLE, "applied", "relational_role_nominal")
    assert planned(spark)[1] == J.NO_PAIRS


def test_directed(spark):
    assert planned(spark, arg("sources", 3, 1), arg("targets", 1, 2), directed=True)[0] == [(1, 2), (1, 3), (2, 3)]
    assert planned(spark, arg("sources", 1), arg("targets", 2, allowed=False), directed=True)[:2] == ([], J.NO_PAIRS)
    aligned = (arg("sources", 1, 2, members=[[1], [2]]), arg("targets", 3, 4, members=[[3], [4, 2]]))
    assert planned(spark, *aligned, directed=True)[0] == [(1, 3), (2, 4)]
    uneven = (aligned[0], arg("targets", 3, 4, 5, members=[[3], [4], [5]]))
    assert len(planned(spark, *uneven, directed=True)[0]) == 6
    assert planned(spark, arg("sources", 1, 2), arg("sources", 3), arg("targets", group=True), directed=True)[0] == [(1, 2), (1, 3), (2, 3)]
    assert planned(spark, arg("sources", 1, 2), arg("targets"), directed=True)[0] == []


def test_nested_and_groups(spark):
    two = (arg("participants", 1), arg("participants", 2))
    assert planned(spark, *two, nested=True, group=False)[1] == J.NO_GROUP
    assert planned(spark, *two, nested=True, group=False, compound=[(9, 8)]) == ([(8, 9)], J.WITHIN, "applied", "predicate_compound_internal_pairs")
    assert planned(spark, *two, internal=[(5, 6)]) == ([(5, 6)], J.WITHIN, "applied", "shared_group_internal_pairs")
    some = (arg("participants", 1, 2, exemplar=True), arg("participants", 3, exemplar=True), arg("participants", 4, 5), arg("participants", 6, allowed=None))
    assert planned(spark, *some)[0] == [(1, 4), (1, 5), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5)]
