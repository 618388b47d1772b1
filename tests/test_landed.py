"""Documents of two versions, and broken ones."""

from pitchline.sources.landed import Field, Layout, extracted, good_and_aside, merged_schema, parsed, versions

OLD = '{"matchId": 7, "venue": {"name": "Oval"}, "balls": [{"over": 0, "runs": "4", "batsmanId": 3}, {"over": 1, "runs": "x", "batsmanId": 3}, 5], "players": [{"id": 3, "name": "A"}]}'
NEW = '{"match": {"id": "8", "ground": "Lord\'s"}, "innings": {"deliveries": [{"over": 2, "runs": 6, "batter": 4}, {"over": null, "runs": null, "batter": 4}]}, "squad": [{"id": 4, "name": null}]}'
MATCH = Layout((), {"match": Field("bigint", ("$.match.id", "$.matchId"), required=True), "venue": Field("string", ("$.match.ground", "$.venue.name"))})
BALLS = Layout(("$.innings.deliveries", "$.balls"), {"match": Field("bigint", ("$.match.id", "$.matchId"), True, True), "over": Field("int", ("$.over",)), "runs": Field("int", ("$.runs",)), "batter": Field("bigint", ("$.batter", "$.batsmanId"), True)})
PLAYERS = Layout(("$.squad", "$.players"), {"id": Field("bigint", ("$.id",), True), "name": Field("string", ("$.name",))})


def _docs(spark):
    texts = [("old", OLD), ("new", NEW), ("cut", OLD[:40]), ("list", "[1]"), ("none", None), ("bare", "{}"), ("odd", '{"matchId": 9, "balls": {"over": 1}}')]
    return parsed(spark.createDataFrame(texts, "file string, text string"), "text")


def test_two_versions_give_one_table_each(spark):
    docs = _docs(spark)
    good, aside = good_and_aside(extracted(docs, MATCH, ["file"]))
    assert {(r.file, r.match, r.venue) for r in good.collect()} == {("old", 7, "Oval"), ("new", 8, "Lord's"), ("odd", 9, None)}
    assert {(r.file, r.reason) for r in aside.collect()} == {("cut", "not JSON"), ("list", "not an object"), ("none", "no text"), ("bare", "no match")}
    good, aside = good_and_aside(extracted(docs, BALLS, ["file"]))
    assert {(r.file, r.place, r.match, r.over, r.runs, r.batter) for r in good.collect()} == {("old", 0, 7, 0, 4, 3), ("new", 0, 8, 2, 6, 4), ("new", 1, 8, None, None, 4)}
    got = {(r.file, r.place): r.reason for r in aside.collect()}
    assert got == {("old", 1): "runs is not int", ("old", 2): "no batter", ("cut", None): "not JSON", ("list", None): "not an object", ("none", None): "no text", ("odd", None): "rows are not an array"}
    good, _ = good_and_aside(extracted(docs, PLAYERS, ["file"]))
    assert {(r.file, r.id, r.name) for r in good.collect()} == {("old", 3, "A"), ("new", 4, None)}


def test_shapes_are_found_over_all_documents(spark):
    docs = _docs(spark)
    shapes = {r["shape"]: r["n"] for r in versions(docs).collect()}
    assert sum(shapes.values()) == 4 and len(shapes) == 4
    merged = merged_schema(docs)
    assert "matchId" in merged and "deliveries" in merged
    assert extracted(docs.where("false"), BALLS, ["file"]).count() == 0


def test_documents_are_parsed_once(spark):
    plan = extracted(_docs(spark), BALLS, ["file"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and "schemaOfVariant" not in plan
    texts = [("space", ' \n\t{"balls": []}'), ("text", '" {"'), ("null", "null"), ("number", "3")]
    docs = parsed(spark.createDataFrame(texts, "file string, text string"), "text")
    assert {r.file: r.reason for r in docs.collect()} == {"space": None, "text": "not an object", "null": "not an object", "number": "not an object"}
