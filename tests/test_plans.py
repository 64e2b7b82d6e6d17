"""Desired-versus-live plans, membership reconcile, references (FX7-FX10, FX12)."""

from pyspark.sql import functions as F

from tablework.operators import filters as flt
from tablework.operators import quality as q
from tablework.operators import shape
from tablework.plans import changes as ch

DESIRED = ("package string, type string, key string, name string, deploy boolean, run_on_deploy boolean, "
           "managed boolean, desired_status string, roles array<string>, producer string, output string")
LIVE = "type string, name string, id string, status string"


def plan(spark, desired, live):
    out = ch.plan_changes(spark.createDataFrame(desired, DESIRED), spark.createDataFrame(live, LIVE))
    return {(r["type"], r["key"]): r for r in out.collect()}


def test_all_live_is_update_and_stable(spark):
    desired = [
        ("bp", "flight", "f", "F", True, False, None, None, [], None, None),
        ("bp", "dive", "d", "D", True, None, None, "ready", [], None, None),
        ("bp", "share", "s", "S", True, None, True, None, [], None, None),
    ]
    live = [("flight", "F", "f1", None), ("dive", "D", "d1", "ready"), ("share", "S", "md:_share/s", None)]
    p1 = plan(spark, desired, live)
    p2 = plan(spark, desired, live)
    assert p1[("flight", "f")]["action"] == "update" and p1[("flight", "f")]["id"] == "f1"
    assert p1[("dive", "d")]["action"] == "update" and p1[("dive", "d")]["status_label"] == "ready"
    assert p1[("share", "s")]["action"] == "update"
    assert {k: tuple(v) for k, v in p1.items()} == {k: tuple(v) for k, v in p2.items()}


def test_status_transitions(spark):
    desired = [
        ("bp", "dive", "d1", "D1", True, None, None, "draft", [], None, None),
        ("bp", "dive", "d2", "D2", True, None, None, None, [], None, None),
        ("bp", "dive", "d3", "D3", True, None, None, None, [], None, None),
    ]
    live = [("dive", "D1", "x1", "ready"), ("dive", "D3", "x3", "ready")]
    p = plan(spark, desired, live)
    assert p[("dive", "d1")]["status_label"] == "ready -> draft"
    assert p[("dive", "d2")]["status_label"] == "draft (default)"
    assert p[("dive", "d3")]["status_label"] == "preserve ready"


def test_share_and_input_rules(spark):
    desired = [
        ("prod_bp", "flight", "f", "F", True, True, None, None, [], None, None),
        ("prod_bp", "share", "s", "S", True, None, None, None, [], None, None),
        ("cons", "input", "i", "S", True, None, None, None, [], "prod_bp", "data"),
        ("cons", "input", "j", "T", True, None, None, None, [], "other", "data"),
        ("lonely", "share", "s", "U", True, None, None, None, [], None, None),
        ("roles", "share", "r", "V", True, None, None, None, ["missing_role"], None, None),
        ("roles", "role", "x", "R", False, None, None, None, [], None, None),
    ]
    p = plan(spark, desired, [])
    assert p[("share", "s")]["action"] in ("pending", "error")
    acts = {(r, k): v["action"] for (r, k), v in p.items()}
    assert acts[("input", "i")] == "pending"
    assert acts[("input", "j")] == "error"
    assert acts[("share", "r")] == "error"
    assert p[("share", "r")]["notes"].endswith("missing_role")
    assert acts[("role", "x")] == "skipped"
    rows = ch.plan_changes(spark.createDataFrame(desired, DESIRED), spark.createDataFrame([], LIVE))
    by = {(r["package"], r["key"]): r["action"] for r in rows.where(F.col("type") == "share").collect()}
    assert by[("prod_bp", "s")] == "pending" and by[("lonely", "s")] == "error"


def test_duplicates_give_one_error_row_per_wanted_row(spark):
    desired = [("bp", "flight", "f", "F", True, False, None, None, [], None, None)]
    live = [("flight", "F", "a", None), ("flight", "F", "b", None)]
    out = ch.plan_changes(spark.createDataFrame(desired, DESIRED), spark.createDataFrame(live, LIVE)).collect()
    assert sorted((r["action"], r["id"]) for r in out) == [("error", "a,b")]
    assert out[0]["notes"] == "duplicate Flight name; expected 0 or 1"


def test_membership_authoritative_and_additive(spark):
    desired = spark.createDataFrame([("finance", "role"), ("analyst@example.com", "user")], "member string, kind string")
    current = spark.createDataFrame([("old-role", "role"), ("old-user", "user")], "member string, kind string")
    auth = shape.reconcile_members(desired, current, ["member", "kind"], "authoritative")
    assert sorted(r["action"] for r in auth.collect()) == ["GRANT", "GRANT", "REVOKE", "REVOKE"]
    add = shape.reconcile_members(desired, current, ["member", "kind"], "additive")
    assert sorted(r["action"] for r in add.collect()) == ["GRANT", "GRANT"]


def test_reference_canonicalisation(spark):
    rows = [
        ('[{"type": "dive", "dive_id": "u1", "description": null}]', '[{"type": "dive", "uuid": "u1"}]', True),
        ('[{"type": "dive", "uuid": "u1"}]', "[]", False),
        ("not json", "not json", True),
        ("[]", "[]", True),
    ]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    got = [(r["want"], r["eq"]) for r in df.select("want", ch.refs_equal(F.col("a"), F.col("b")).alias("eq")).collect()]
    assert all(w == e for w, e in got)


def test_append_versions(spark):
    cur = spark.createDataFrame([("g1", "text", "", "[]", "T", "topic", "", "user", 3)],
                                "id string, content string, ext string, refs string, title string, topic string, description string, access string, version long")
    same = cur.drop("version")
    out = ch.append_versions(cur, same, "id", "content", "ext", "refs", ["title", "topic", "description"], "access").first()
    assert (out["append_version"], out["next_version"], out["changed_metadata"], out["access_changed"]) == (False, 3, [], False)
    changed = same.withColumn("refs", F.lit('[{"type": "dive", "uuid": "x"}]')).withColumn("title", F.lit("New"))
    out = ch.append_versions(cur, changed, "id", "content", "ext", "refs", ["title", "topic", "description"], "access").first()
    assert (out["append_version"], out["next_version"], out["changed_metadata"]) == (True, 4, ["title"])


def test_cleanup_order_and_guard(spark):
    cand = spark.createDataFrame(
        [
            ("consumer", "dive", "d", "Dive (preview x)", 1, False, None, None),
            ("consumer", "flight", "f", "flight_preview_x", 1, False, None, None),
            ("producer", "flight", "f", "flight_preview_x2", 0, False, None, None),
            ("producer", "share", "s", "share_preview_x", 0, True, "db_preview_x", None),
            ("producer", "guide", "g", "Guide preview x", 0, False, None, True),
            ("producer", "guide", "h", "Hidden preview x", 0, False, None, False),
            ("producer", "share", "t", "kept_preview_x", 0, False, None, None),
        ],
        "package string, type string, key string, name string, level int, drop_database boolean, database string, deploy boolean",
    ).withColumn("cleanup", F.col("key") != "t")
    live = spark.createDataFrame([("dive", "Dive (preview x)", "d1"), ("flight", "flight_preview_x", "f1"), ("share", "share_preview_x", "url")], "type string, name string, id string")
    production = spark.createDataFrame(
        [("producer", "guide", "g", "Guide preview x"), ("producer", "share", "s", "share_prod")],
        "package string, type string, key string, production_name string",
    )
    out = ch.order_deletes(ch.plan_deletes(cand, live, production, ["preview_x", "preview x"])).collect()
    got = [(r["type"], r["package"], r["action"]) for r in out]
    assert got == [
        ("guide", "producer", "error"),
        ("dive", "consumer", "delete"),
        ("flight", "consumer", "delete"),
        ("flight", "producer", "missing"),
        ("share", "producer", "drop_share"),
        ("database", "producer", "drop_database"),
    ]
    assert out[0]["notes"] == "refusing to delete preview guide because it matches production: Guide preview x"


def test_scope_guard_messages(spark):
    df = spark.createDataFrame([("share", "s_main"), ("dive", "d_main"), ("dive", "d_feat")], "type string, name string")
    got = {r["name"]: r["guard_error"] for r in flt.scope_guard(df, "name", ["feat", ""]).collect()}
    assert got == {
        "s_main": "refusing to drop preview share without branch slug feat",
        "d_main": "refusing to delete preview dive without branch slug feat",
        "d_feat": None,
    }


def test_row_rules(spark):
    df = spark.createDataFrame([(1, "s", "u", None), (2, None, None, "x"), (3, "s", None, None)], "id int, share string, url string, alias string")
    rules = [q.Rule("exactly_one", "share", ["share", "url"]), q.Rule("required", "alias")]
    got = sorted((r["id"], r["rule"]) for r in q.check_rows(df, rules, ["id"]).collect())
    assert got == [(1, "exactly_one"), (1, "required"), (2, "exactly_one"), (3, "required")]
    dup = spark.createDataFrame([("a",), ("a",), ("b",)], "alias string")
    assert [r["alias"] for r in q.check_unique(dup, ["alias"]).collect()] == ["a"]


def test_guide_rules(spark):
    desired = spark.createDataFrame(
        [
            ("bp", "guide", "off", "Off", False, None, None),
            ("bp", "guide", "byid", "Any", True, "g1", None),
            ("bp", "guide", "gone", "Any", True, "g404", None),
            ("bp", "guide", "topic", "T", True, None, "ops"),
            ("bp", "guide", "blank", "B", True, None, ""),
            ("bp", "guide", "dup", "D", True, None, None),
        ],
        "package string, type string, key string, name string, deploy boolean, id string, topic string",
    )
    live = spark.createDataFrame(
        [("guide", "X", "g1", None, "ops"), ("guide", "T", "g2", None, "other"), ("guide", "B", "g3", None, None),
         ("guide", "D", "g4", None, ""), ("guide", "D", "g5", None, None)],
        "type string, name string, id string, status string, topic string",
    )
    rows = ch.plan_changes(desired, live).collect()
    got = sorted((r["key"], r["action"], r["id"]) for r in rows)
    assert got == [
        ("blank", "update", "g3"),
        ("byid", "update", "g1"),
        ("dup", "error", "g4,g5"),
        ("gone", "error", "g404"),
        ("off", "validated_only", None),
        ("topic", "create", None),
    ]
    notes = {r["key"]: r["notes"] for r in rows}
    assert notes["off"] == "set deploy: true to publish this Guide"
    assert notes["gone"] == "configured Guide id does not exist"
    assert notes["dup"] == "duplicate Guide topic/title; set id explicitly"


def test_guide_references_must_resolve(spark):
    own = ("bp", "guide")
    ref = lambda kind, uuid=None, package=None, resource=None: (kind, uuid, package, resource)
    cases = {
        "fine": ([ref("catalog"), ref("flight", package="other", resource="loader"), ref("guide", resource="base"), ref("dive", uuid="d1")], ""),
        "missing": ([ref("flight", package="other", resource="gone")], "Guide reference other.flight.gone resolved to 0 live resources; expected exactly one"),
        "doubled": ([ref("dive", package="other", resource="twice")], "Guide reference other.dive.twice resolved to 2 live resources; expected exactly one"),
        "check_only": ([ref("guide", resource="draft")], "Guide reference bp.guide.draft is a validation-only Guide; set deploy: true or configure its id"),
        "uuid": ([ref("flight", uuid="f404")], "Guide flight reference f404 does not resolve to exactly one live resource"),
        "nowhere": ([ref("dive", package="lost", resource="x")], "Guide reference package lost is not available"),
        "undeclared": ([ref("dive", package="other", resource="x")], "Guide reference other.dive.x is not declared"),
        "by_id": ([ref("guide", package="other", resource="kept")], ""),
        "topic": ([ref("guide", package="other", resource="topical")], ""),
        "first": ([ref("dive", package="lost", resource="x"), ref("flight", uuid="f404")], "Guide reference package lost is not available"),
        "none": ([], ""),
        "null": (None, ""),
    }
    schema = "package string, type string, key string, name string, deploy boolean, id string, topic string, references " + ch.REFERENCES
    desired = [(*own, key, f"T {key}", True, None, None, refs) for key, (refs, _) in cases.items()]
    desired += [(*own, "base", "Base", True, None, None, []), (*own, "draft", "Draft", False, None, None, [ref("dive", uuid="nothing")])]
    declared = [*desired] + [
        ("other", "flight", "loader", "Loader", None, None, None, None), ("other", "flight", "gone", "Gone", None, None, None, None),
        ("other", "dive", "twice", "Twice", None, None, None, None), ("other", "guide", "kept", "Kept", False, "g9", None, None),
        ("other", "guide", "topical", "Topical", True, None, "ops", None),
    ]
    live = [("flight", "Loader", "f1", None, None), ("dive", "Twice", "d1", None, None), ("dive", "Twice", "d2", None, None),
            ("guide", "Other title", "g9", None, None), ("guide", "Topical", "g8", None, "ops"), ("guide", "Topical", "g7", None, "")]
    lv = spark.createDataFrame(live, "type string, name string, id string, status string, topic string")
    rows = ch.plan_changes(spark.createDataFrame(desired, schema), lv, spark.createDataFrame(declared, schema)).collect()
    got = {r["key"]: r for r in rows}
    assert len(rows) == len(desired)
    for key, (_, note) in cases.items():
        assert (got[key]["action"], got[key]["exists"], got[key]["notes"]) == (("error", None, note) if note else ("create", False, "")), key
    assert got["draft"]["action"] == "validated_only"
    # without the table of declared resources the other package is unknown
    alone = {r["key"]: r["notes"] for r in ch.plan_changes(spark.createDataFrame(desired, schema), lv).collect()}
    assert alone["missing"] == "Guide reference package other is not available"


def test_duplicate_share_is_one_row(spark):
    desired = [("bp", "share", "s", "S", True, None, None, None, [], None, None)]
    live = [("share", "S", "url2", None), ("share", "S", "url1", None)]
    out = ch.plan_changes(spark.createDataFrame(desired, DESIRED), spark.createDataFrame(live, LIVE)).collect()
    assert [(r["action"], r["id"]) for r in out] == [("present", "url1")]


def test_role_membership_direct_only_and_case_insensitive(spark):
    desired = spark.createDataFrame([("explorer", "role"), ("new", "user")], "member string, kind string")
    current = spark.createDataFrame(
        [("analyst", "ROLE", True), ("inherited", "role", False), ("old", "User", True)], "member string, kind string, direct boolean"
    )
    out = shape.reconcile_members(desired, current, ["member", "kind"], "authoritative", kind_col="kind", direct_col="direct")
    got = sorted((r["action"], r["kind"], r["member"]) for r in out.collect())
    assert got == [("GRANT", "role", "explorer"), ("GRANT", "user", "new"), ("REVOKE", "role", "analyst"), ("REVOKE", "user", "old")]


# FX13: the "operations" manifest of the complex fixture, already parsed
OPERATIONS_PROD = [
    ("operations", "share", "raw", "operations_raw", True, None, None, None, [], None, None),
    ("operations", "share", "marts", "operations_marts", True, None, None, None, [], None, None),
    ("operations", "flight", "ingest", "operations-ingest", True, True, None, None, [], None, None),
    ("operations", "flight", "transform", "operations-transform", True, True, None, None, [], None, None),
    ("operations", "dive", "dashboard", "Operations Dashboard", True, None, None, None, [], None, None),
    ("operations", "context", "policy", "policy.md", False, None, None, None, [], None, None),
]


def test_operations_manifest_first_deploy(spark):
    p = plan(spark, OPERATIONS_PROD, [])
    got = {k: (v["action"], v["status_label"]) for k, v in p.items()}
    assert got == {
        ("share", "raw"): ("pending", ""),
        ("share", "marts"): ("pending", ""),
        ("flight", "ingest"): ("create", ""),
        ("flight", "transform"): ("create", ""),
        ("dive", "dashboard"): ("create", "draft (default)"),
        ("context", "policy"): ("validated_only", ""),
    }
    assert p[("context", "policy")]["notes"] == "context deployment is not available yet"


def test_operations_manifest_preview_cleanup(spark):
    suffix = "_preview_feature_x"
    cand = spark.createDataFrame(
        [
            ("operations", "share", "raw", "operations_raw" + suffix, 0, True, "operations_raw" + suffix, 0),
            ("operations", "share", "marts", "operations_marts" + suffix, 0, True, "operations_marts" + suffix, 1),
            ("operations", "flight", "ingest", "operations-ingest:feature-x (Preview)", 0, False, None, 0),
            ("operations", "flight", "transform", "operations-transform:feature-x (Preview)", 0, False, None, 1),
            ("operations", "dive", "dashboard", "Operations Dashboard:feature-x (Preview)", 0, False, None, 0),
        ],
        "package string, type string, key string, name string, level int, drop_database boolean, database string, ordinal int",
    )
    live = spark.createDataFrame(
        [("share", "operations_raw" + suffix, "url_raw"), ("flight", "operations-ingest:feature-x (Preview)", "f1"),
         ("dive", "Operations Dashboard:feature-x (Preview)", "d1")],
        "type string, name string, id string",
    )
    production = spark.createDataFrame(
        [("operations", "share", "raw", "operations_raw"), ("operations", "database", "raw", "operations_raw")],
        "package string, type string, key string, production_name string",
    )
    out = ch.order_deletes(ch.plan_deletes(cand, live, production, ["feature_x", "feature-x"])).collect()
    assert [(r["type"], r["key"], r["action"]) for r in out] == [
        ("dive", "dashboard", "delete"),
        ("flight", "ingest", "delete"),
        ("flight", "transform", "missing"),
        ("share", "raw", "drop_share"),
        ("database", "raw", "drop_database"),
        ("share", "marts", "missing"),
        ("database", "marts", "drop_database"),
    ]


def test_share_access_rules(spark):
    df = spark.createDataFrame(
        [(1, "HIDDEN", "RESTRICTED"), (2, "HIDDEN", "ORGANIZATION"), (3, "DISCOVERABLE", "UNRESTRICTED"), (4, "SECRET", None)],
        "id int, visibility string, access string",
    )
    rules = [
        q.Rule("enum", "visibility", ["DISCOVERABLE", "HIDDEN"]),
        q.Rule("implies", "visibility", ("HIDDEN", "access", "RESTRICTED"), message="HIDDEN shares must use RESTRICTED access"),
    ]
    got = sorted((r["id"], r["rule"], r["message"]) for r in q.check_rows(df, rules, ["id"]).collect())
    assert got == [(2, "implies", "HIDDEN shares must use RESTRICTED access"), (4, "enum", "visibility must be one of DISCOVERABLE, HIDDEN")]
