"""Desired-versus-live reconciliation as DataFrame plans.

Inputs are tables, not manifests:

* ``desired``: package, type, key, name, deploy, run_on_deploy, managed,
  desired_status, roles (array<string>), producer and output (for
  inputs), id, topic and references (for guides: array of structs of type,
  uuid, package, resource)
* ``live``: type, name, id, status, topic

Every rule is a ``when`` chain over joined columns; lookups are equi
joins on (type, name), never one query per resource.  A name that resolves
to several live rows gives one ``error`` row whose id holds the live ids
joined by ``,``: up to ``ID_CHUNK`` of them, in order; ``ambiguous_ids``
gives all of any number of ids, in rows of that size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.operators.filters import scope_guard
from tablework.operators.ranges import Ranges

PLAN_COLUMNS = ("package", "type", "key", "name", "action", "exists", "id", "notes", "current_status", "desired_status")

# Notes of the plan rows.
NOTE_DUPLICATE = {"flight": "duplicate Flight name; expected 0 or 1", "dive": "duplicate Dive title; expected 0 or 1"}
NOTE_ROLE_SKIPPED = "roles deploy only when resources.roles.<key>.deploy is true"
NOTE_ROLE_MISSING = "included role(s) do not exist and are not selected for deployment: "
NOTE_GRANT_MISSING = "grant role(s) do not exist and are not selected for deployment: "
NOTE_SHARE_UPDATE = "share is available; filter and/or grants will be reconciled"
NOTE_SHARE_PRESENT = "share is available"
NOTE_SHARE_PENDING = "will be produced by a Flight configured with runOnDeploy"
NOTE_SHARE_ERROR = "share is missing and no Flight in this package is configured with runOnDeploy"
NOTE_ENDORSE = "endorsing requires an organization admin"
NOTE_OFF_ENDORSED = "moving off endorsed may be one-way unless the deployer is an organization admin"
NOTE_STAY_ENDORSED = "content update remains endorsed"
NOTE_CONTEXT = "context deployment is not available yet"
NOTE_GUIDE_SKIPPED = "set deploy: true to publish this Guide"
NOTE_GUIDE_ID_MISSING = "configured Guide id does not exist"
NOTE_DUPLICATE_GUIDE = "duplicate Guide topic/title; set id explicitly"
NOTE_DROP_DATABASE = "database existence is not inspected; cleanup uses DROP DATABASE IF EXISTS"
NOTE_INPUT_PRESENT = "resolved from {}"
NOTE_REFERENCE_UUID = "Guide {} does not resolve to exactly one live resource"
NOTE_REFERENCE_COUNT = "Guide reference {} live resources; expected exactly one"
NOTE_INPUT_MISSING = "required production output {} is not available"
# Notes of this library's own wording.
NOTE_INPUT_PENDING = "package {} is part of this plan and produces it"
NOTE_INPUT_NO_FLIGHT = "package {} is part of this plan but runs nothing on deploy"
NOTE_REFERENCE_PACKAGE = "Guide reference package {} is not available"
NOTE_REFERENCE_RESOURCE = "Guide reference {} is not declared"
NOTE_REFERENCE_VALIDATION_ONLY = "Guide reference {} is a validation-only Guide; set deploy: true or configure its id"


def _fill(template: str, value: Column) -> Column:
    """A note template with one ``{}`` slot filled by a column."""
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


# ---------------------------------------------------------------- J6
def lookup_one(df: DataFrame, live: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """Resolve each row of ``df`` to live rows on ``keys``.

    Adds ``n_live`` (0, 1 or more) and the smallest live id with its status
    (NULL when absent): one output row per row of ``df``, also where a name is
    live several times.  The live side is one partial aggregate, so a name with
    a third of all live rows is reduced before it moves.
    """
    status = F.col("status") if "status" in live.columns else F.lit(None).cast("string")
    found = live.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_live"), F.min(F.struct(F.col(id_col).alias("id"), status.alias("status"))).alias("__first"))
    joined = df.join(found, list(keys), "left").withColumn("n_live", F.coalesce("n_live", F.lit(0)))
    return joined.withColumns({"live_id": F.col("__first.id"), "live_status": F.col("__first.status")}).drop("__first")


ID_CHUNK = 1000  # ids in one text


def _joined_ids(ids: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_list(ids)), ",")


def ambiguous_ids(wanted: DataFrame, live: DataFrame, keys: Sequence[str], id_col: str = "id", chunk: int = ID_CHUNK) -> DataFrame:
    """All live ids of the wanted names that are live several times:
    ``(*keys, seq, n_live, ids)``, ids in order, joined by ``,``, cut into rows
    of at most ``chunk`` ids; ``n_live`` stands on the first row (``seq`` 0).
    The rows of a name, joined by ``,`` in the order of ``seq``, are the whole
    list.

    The ids are placed in ranges of (name, id), so a name with a third of all
    rows spreads over many tasks, and a text never holds more than a chunk.
    """
    names = wanted.select(*keys).distinct()
    several = live.join(names, list(keys), "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_live")).where("n_live > 1")
    hits = live.select(*keys, F.col(id_col).cast("string").alias("__id")).join(several, list(keys))
    ranges = Ranges(hits, [*[F.col(k).asc() for k in keys], F.col("__id").asc()])
    at = F.floor((F.col("__at") - 1) / chunk).cast("long")
    placed = ranges.numbered("__at").withColumn("__chunk", at)
    # whole chunks go to as many tasks as there are ranges, so that a task gathers a bounded number of ids
    dealt = placed.repartition(ranges.parts, "__chunk") if ranges.parts else placed.repartition("__chunk")
    texts = dealt.groupBy(*keys, "n_live", "__chunk").agg(_joined_ids(F.col("__id")).alias("ids"))
    first = texts.groupBy(*keys).agg(F.min("__chunk").alias("__first"))
    seq = (F.col("__chunk") - F.col("__first")).alias("seq")
    return texts.join(first, list(keys)).select(*keys, seq, F.when(seq == 0, F.col("n_live")).alias("n_live"), "ids")


def _first_ids(names: DataFrame, live: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """``(*keys, live_ids)``: the first ``ID_CHUNK`` ids of each name, as text;
    the limit applies in every task before anything moves."""
    place = Window.partitionBy(*keys).orderBy(id_col)
    ranked = live.join(names, list(keys), "left_semi").withColumn("__at", F.row_number().over(place)).where(F.col("__at") <= ID_CHUNK)
    return ranked.groupBy(*keys).agg(_joined_ids(F.col(id_col)).alias("live_ids"))


# ---------------------------------------------------------------- C3
def status_label(type_col: Column, current: Column, desired: Column, action: Column) -> Column:
    """Dive status text: ``preserve X``, ``draft (default)``, ``unmanaged``,
    ``X`` or ``X -> Y``; empty for other types."""
    return (
        F.when(type_col != F.lit("dive"), F.lit(""))
        .when(desired.isNull() & current.isNotNull() & (current != F.lit("")), F.concat(F.lit("preserve "), current))
        .when(desired.isNull() & (action == F.lit("create")), F.lit("draft (default)"))
        .when(desired.isNull(), F.lit("unmanaged"))
        .when(current.isNull(), desired)
        .when(current == desired, desired)
        .otherwise(F.concat(current, F.lit(" -> "), desired))
    )


def _missing_roles(desired: DataFrame, live: DataFrame, row_keys: Sequence[str]) -> DataFrame:
    """Per desired row: sorted roles named in ``roles`` that are neither
    live nor deployed in this run (bounded by the row's own array)."""
    managed = desired.where((F.col("type") == "role") & F.coalesce(F.col("deploy"), F.lit(False))).select(F.col("name").alias("role"))
    known = live.where(F.col("type") == "role").select(F.col("name").alias("role")).unionByName(managed).distinct()
    wanted = desired.select(*row_keys, F.explode_outer("roles").alias("role")).where(F.col("role").isNotNull())
    missing = wanted.join(known, "role", "left_anti")
    return missing.groupBy(*row_keys).agg(F.array_join(F.array_sort(F.collect_set("role")), ", ").alias("missing_roles"))


SINGLE_TYPES = ("share", "input", "role")  # existence checks: one plan row


def _with_defaults(df: DataFrame, cols: Sequence[tuple[str, str]]) -> DataFrame:
    for c, t in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    return df


REFERENCES = "array<struct<type:string,uuid:string,package:string,resource:string>>"
_ROW_KEYS = ("package", "type", "key")


def _match_key() -> Column:
    """What a resource row is looked up by: guides by their id when they have
    one, else by title and topic (none matches ''); others by name."""
    topic_key = F.concat(F.lit("t:"), F.col("name"), F.lit("\u0001"), F.coalesce(F.col("topic"), F.lit("")))
    return F.when(F.col("type") != "guide", F.col("name")).when(F.col("id").isNotNull(), F.concat(F.lit("id:"), F.col("id"))).otherwise(topic_key)


def _live_keys(live: DataFrame) -> DataFrame:
    """(lookup_type, mkey, id, status): a live guide can be found by its id or
    by its (title, topic)."""
    topic_key = F.concat(F.lit("t:"), F.col("name"), F.lit("\u0001"), F.coalesce(F.col("topic"), F.lit("")))
    keys = F.when(F.col("type") == "guide", F.array(F.concat(F.lit("id:"), F.col("id")), topic_key)).otherwise(F.array(F.col("name")))
    return live.select(F.col("type").alias("lookup_type"), F.explode(keys).alias("mkey"), "id", "status")


def guide_reference_errors(desired: DataFrame, live: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """``(package, type, key, reference_error)`` of the deployed guides
    with a reference that does not resolve; the first such reference counts.

    A reference by ``uuid`` needs exactly one live row of its type with that
    id.  One by (package, resource) names a declared resource (``declared``:
    package, type, key, name, id, topic, deploy of all packages; default: the
    desired rows; no package means the guide's own).  It is fine if its package
    is part of the plan (a guide: and is deployed); else exactly one live row
    must match it.  A guide that is neither deployed nor has an id cannot be
    referenced.  Catalog references are not checked.

    The nested arrays become rows, are resolved by equi joins on typed keys,
    and fold back into one row per guide in one aggregate.
    """
    d, lv = _with_defaults(desired, _DESIRED_DEFAULTS), _with_defaults(live, _LIVE_DEFAULTS)
    known = _with_defaults(declared, _DESIRED_DEFAULTS) if declared is not None else d
    refs = d.where((F.col("type") == "guide") & F.coalesce("deploy", F.lit(False))).select(*_ROW_KEYS, F.posexplode(F.col("references").cast(REFERENCES)).alias("pos", "ref"))
    refs = refs.where(F.coalesce(F.col("ref.type"), F.lit("")) != "catalog").select(
        *_ROW_KEYS, "pos", F.col("ref.type").alias("ref_type"), F.nullif(F.col("ref.uuid"), F.lit("")).alias("uuid"),
        F.coalesce("ref.package", "package").alias("ref_package"), F.col("ref.resource").alias("ref_key"),
    )
    by_id = lv.groupBy(F.col("type").alias("ref_type"), F.col("id").alias("uuid")).agg(F.count(F.lit(1)).alias("n_id"))
    by_key = _live_keys(lv).groupBy(F.col("lookup_type").alias("ref_type"), "mkey").agg(F.count(F.lit(1)).alias("n_key"))
    packages = known.select(F.col("package").alias("ref_package")).distinct().withColumn("known_package", F.lit(True))
    planned = d.select(F.col("package").alias("ref_package")).distinct().withColumn("planned", F.lit(True))
    target = known.select(
        F.col("package").alias("ref_package"), F.col("type").alias("ref_type"), F.col("key").alias("ref_key"),
        F.coalesce("deploy", F.lit(False)).alias("target_deploy"), F.col("id").isNotNull().alias("target_has_id"), _match_key().alias("mkey"),
    ).dropDuplicates(["ref_package", "ref_type", "ref_key"])
    joined = (
        refs.join(by_id, ["ref_type", "uuid"], "left")
        .join(packages, "ref_package", "left").join(planned, "ref_package", "left")
        .join(target, ["ref_package", "ref_type", "ref_key"], "left")
        .join(by_key, ["ref_type", "mkey"], "left")
    )
    label = F.concat_ws(".", "ref_package", "ref_type", "ref_key")
    is_guide = F.col("ref_type") == "guide"
    n_id, n_key = F.coalesce("n_id", F.lit(0)), F.coalesce("n_key", F.lit(0))
    deployed_here = F.col("planned").isNotNull() & (~is_guide | F.col("target_deploy"))
    problem = (
        F.when(F.col("uuid").isNotNull(), F.when(n_id != 1, _fill(NOTE_REFERENCE_UUID, F.concat("ref_type", F.lit(" reference "), "uuid"))))
        .when(F.col("known_package").isNull(), _fill(NOTE_REFERENCE_PACKAGE, F.col("ref_package")))
        .when(F.col("mkey").isNull(), _fill(NOTE_REFERENCE_RESOURCE, label))
        .when(is_guide & ~F.col("target_deploy") & ~F.col("target_has_id"), _fill(NOTE_REFERENCE_VALIDATION_ONLY, label))
        .when(~deployed_here & (n_key != 1), _fill(NOTE_REFERENCE_COUNT, F.concat(label, F.lit(" resolved to "), n_key.cast("string"))))
    )
    failed = joined.select(*_ROW_KEYS, "pos", problem.alias("problem")).where("problem IS NOT NULL")
    return failed.groupBy(*_ROW_KEYS).agg(F.min_by("problem", "pos").alias("reference_error"))


_DESIRED_DEFAULTS = (
    ("producer", "string"), ("output", "string"), ("id", "string"), ("managed", "boolean"), ("run_on_deploy", "boolean"), ("desired_status", "string"),
    ("deploy", "boolean"), ("topic", "string"), ("roles", "array<string>"), ("references", REFERENCES),
)
_LIVE_DEFAULTS = (("status", "string"), ("topic", "string"))


def plan_changes(desired: DataFrame, live: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """One plan row per desired row.

    Roles, shares and inputs are existence checks (the smallest live id);
    flights, dives and guides resolve to 0, 1 or several live rows, and several
    are an error that names their ids.  Guides resolve by configured id when
    given, else by title and topic (an empty topic matches NULL or ''); a
    deployed guide whose references do not resolve is an error
    (:func:`guide_reference_errors`, also for ``declared``).
    """
    row_keys = ["package", "type", "key"]
    d, lv = _with_defaults(desired, _DESIRED_DEFAULTS), _with_defaults(live, _LIVE_DEFAULTS)
    selected = d.select(F.col("package").alias("producer")).distinct().withColumn("producer_selected", F.lit(True))
    producing = (
        d.where((F.col("type") == "flight") & F.coalesce("run_on_deploy", F.lit(False)))
        .select(F.col("package").alias("__bp"))
        .distinct()
        .withColumn("can_produce", F.lit(True))
    )
    producer_can = producing.select(F.col("__bp").alias("producer"), F.col("can_produce").alias("producer_can_produce"))
    missing = _missing_roles(d, lv, row_keys)

    typ = F.col("type")
    by_id = (typ == "guide") & F.col("id").isNotNull()
    d = d.withColumn("lookup_type", F.when(typ == "input", F.lit("share")).otherwise(typ)).withColumn("mkey", _match_key())
    lookup = ["lookup_type", "mkey"]
    live_k = _live_keys(lv)
    found = lookup_one(d, live_k, lookup, "id")
    several = live_k.where(~F.col("lookup_type").isin(*SINGLE_TYPES)).groupBy(*lookup).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*lookup)
    found = found.join(_first_ids(several.join(d.select(*lookup).distinct(), lookup, "left_semi"), live_k, lookup), lookup, "left")
    if "references" in desired.columns:
        found = found.join(guide_reference_errors(desired, live, declared), row_keys, "left")
    else:
        found = found.withColumn("reference_error", F.lit(None).cast("string"))
    j = (
        found.withColumn("live_status", F.when(~typ.isin(*SINGLE_TYPES), F.col("live_status")))
        .join(missing, row_keys, "left")
        .join(producing, F.col("package") == F.col("__bp"), "left")
        .drop("__bp")
        # most rows have no producer; each gets a key of its own that matches nothing, or they would meet in one task
        .withColumn("__producer", F.coalesce("producer", F.concat(F.lit("\u0000"), F.xxhash64("package", "type", "key").cast("string"))))
        .join(selected.withColumnRenamed("producer", "__producer"), "__producer", "left")
        .join(producer_can.withColumnRenamed("producer", "__producer"), "__producer", "left")
        .drop("__producer")
    )
    n = F.col("n_live")
    miss = F.col("missing_roles")
    can = F.coalesce("can_produce", F.lit(False))
    managed = F.coalesce("managed", F.lit(False))
    psel = F.coalesce("producer_selected", F.lit(False))
    pcan = F.coalesce("producer_can_produce", F.lit(False))
    deployed = F.coalesce("deploy", F.lit(False))
    guide_off = (typ == "guide") & ~deployed  # no flag: not deployed
    guide_id_missing = (typ == "guide") & by_id & (n == 0)
    bad_reference = F.col("reference_error").isNotNull()
    dstat = F.col("desired_status")
    cur = F.col("live_status")
    out_ref = F.concat_ws(".", F.col("producer"), F.coalesce(F.col("output"), F.col("key")))

    action = (
        F.when(typ == "role", F.when(~deployed, "skipped").when(miss.isNotNull(), "error").when(n > 0, "update").otherwise("create"))
        .when(typ == "share", F.when(miss.isNotNull(), "error").when((n > 0) & managed, "update").when(n > 0, "present").when(can, "pending").otherwise("error"))
        .when(typ == "input", F.when(n > 0, "present").when(psel & pcan, "pending").otherwise("error"))
        .when(typ == "context", "validated_only")
        .when(guide_off, "validated_only")
        .when(guide_id_missing | bad_reference, "error")
        .when(n == 0, "create")
        .when(n == 1, "update")
        .otherwise("error")
    )
    notes = (
        F.when(typ == "role", F.when(~deployed, NOTE_ROLE_SKIPPED).when(miss.isNotNull(), F.concat(F.lit(NOTE_ROLE_MISSING), miss)).otherwise(""))
        .when(
            typ == "share",
            F.when(miss.isNotNull(), F.concat(F.lit(NOTE_GRANT_MISSING), miss))
            .when((n > 0) & managed, NOTE_SHARE_UPDATE)
            .when(n > 0, NOTE_SHARE_PRESENT)
            .when(can, NOTE_SHARE_PENDING)
            .otherwise(NOTE_SHARE_ERROR),
        )
        .when(
            typ == "input",
            F.when(n > 0, _fill(NOTE_INPUT_PRESENT, out_ref))
            .when(psel & pcan, _fill(NOTE_INPUT_PENDING, out_ref))
            .when(psel, _fill(NOTE_INPUT_NO_FLIGHT, out_ref))
            .otherwise(_fill(NOTE_INPUT_MISSING, out_ref)),
        )
        .when(typ == "context", NOTE_CONTEXT)
        .when(guide_off, NOTE_GUIDE_SKIPPED)
        .when(bad_reference, F.col("reference_error"))
        .when(guide_id_missing, NOTE_GUIDE_ID_MISSING)
        .when((typ == "guide") & (n > 1), NOTE_DUPLICATE_GUIDE)
        .when(n > 1, F.coalesce(F.element_at(F.create_map(*[x for k, v in NOTE_DUPLICATE.items() for x in (F.lit(k), F.lit(v))]), typ), F.lit("duplicate name; expected 0 or 1")))
        .when((typ == "dive") & (n == 0), F.when(dstat == "endorsed", NOTE_ENDORSE).otherwise(""))
        .when(
            (typ == "dive") & (n == 1),
            F.when((cur == "endorsed") & dstat.isNotNull() & (dstat != "endorsed"), NOTE_OFF_ENDORSED)
            .when((dstat == "endorsed") & (F.coalesce(cur, F.lit("")) != "endorsed"), NOTE_ENDORSE)
            .when(cur == "endorsed", NOTE_STAY_ENDORSED)
            .otherwise(""),
        )
        .otherwise("")
    )
    exists = (
        F.when(((typ == "role") & ~deployed) | bad_reference, F.lit(None).cast("boolean"))
        .when((typ == "context") | guide_off | guide_id_missing, F.lit(False))
        .otherwise(n > 0)
    )
    ident = (
        F.when((typ == "context") | guide_off, F.lit(None).cast("string"))
        .when(guide_id_missing | bad_reference, F.col("id"))
        .when(typ == "role", F.when(deployed & (n > 0), F.col("name")))
        .otherwise(F.coalesce("live_ids", "live_id"))
    )
    res = j.select(
        "package",
        "type",
        "key",
        "name",
        action.alias("action"),
        exists.alias("exists"),
        ident.alias("id"),
        notes.alias("notes"),
        F.when(typ == "dive", cur).alias("current_status"),
        F.when(typ == "dive", dstat).alias("desired_status"),
    )
    return res.withColumn("status_label", status_label(F.col("type"), F.col("current_status"), F.col("desired_status"), F.col("action")))


# ---------------------------------------------------------------- C2
KIND_RANK = {"guide": 0, "dive": 1, "flight": 2, "share": 3, "database": 3}


def plan_deletes(
    candidates: DataFrame,
    live: DataFrame,
    production: DataFrame | None,
    markers: Sequence[str],
) -> DataFrame:
    """Delete plan rows (order them with ``order_deletes``).

    ``candidates``: package, type, key, name, level (dependency level of
    the package), drop_database, database, and optionally cleanup
    (default true), deploy (guides) and topic (guides).  ``production``:
    package, type, key, production_name (for shares also the production
    database under type ``database``).  Guides are cleaned only when
    deployed and not opted out, shares only when not opted out.  Guarded
    names (P10) give ``error``; no live row gives ``missing``; every live
    id gives one ``delete`` (``drop_share`` for shares) row; the database
    row (``drop_database``) exists only when flagged.  Guides are found by
    title and topic.
    """
    c = _with_defaults(candidates, [("cleanup", "boolean"), ("deploy", "boolean"), ("topic", "string"), ("drop_database", "boolean"), ("database", "string")])
    keep = F.coalesce(F.col("cleanup"), F.lit(True)) & (
        (F.col("type") != "guide") | F.coalesce(F.col("deploy"), F.lit(False))
    )
    c = c.where(keep)
    # optional declaration order inside a package (``ordinal``) is carried
    # through so ``order_deletes`` can follow it
    extra = ["ordinal"] if "ordinal" in candidates.columns else []
    shares = c.where((F.col("type") == "share") & F.coalesce("drop_database", F.lit(False)))
    dbs = shares.select("package", F.lit("database").alias("type"), "key", F.col("database").alias("name"), "level", F.lit(None).cast("string").alias("topic"), *extra)
    rows = c.select("package", "type", "key", "name", "level", "topic", *extra).unionByName(dbs)
    guarded = scope_guard(rows, "name", markers, production, ["package", "type", "key"]) if production is not None else scope_guard(rows, "name", markers)
    ok = guarded.where(F.col("guard_error").isNull() & (F.col("type") != "database"))
    lv = _with_defaults(live, [("topic", "string")])
    topic_key = lambda: F.when(F.col("type") == "guide", F.coalesce(F.col("topic"), F.lit(""))).otherwise(F.lit(""))
    ok = ok.withColumn("__tk", topic_key())
    lv = lv.select(F.col("type").alias("__lt"), F.col("name").alias("__ln"), topic_key().alias("__ltk"), F.col("id").alias("live_id"))
    lk = ok.join(lv, (F.col("type") == F.col("__lt")) & (F.col("name") == F.col("__ln")) & (F.col("__tk") == F.col("__ltk")), "left")
    resolved = lk.select(
        "package",
        "type",
        "key",
        "name",
        "level",
        *extra,
        F.when(F.col("live_id").isNull(), "missing").when(F.col("type") == "share", "drop_share").otherwise("delete").alias("action"),
        F.col("live_id").isNotNull().alias("exists"),
        F.col("live_id").alias("id"),
        F.lit("").alias("notes"),
    )
    errors = guarded.where(F.col("guard_error").isNotNull()).select(
        "package", "type", "key", "name", "level", *extra, F.lit("error").alias("action"), F.lit(None).cast("boolean").alias("exists"), F.lit(None).cast("string").alias("id"), F.col("guard_error").alias("notes")
    )
    dropdb = guarded.where(F.col("guard_error").isNull() & (F.col("type") == "database")).select(
        "package", "type", "key", "name", "level", *extra, F.lit("drop_database").alias("action"), F.lit(True).alias("exists"), F.lit(None).cast("string").alias("id"),
        F.lit(NOTE_DROP_DATABASE).alias("notes"),
    )
    allr = resolved.unionByName(errors).unionByName(dropdb)
    rank = F.create_map(*[x for k, v in KIND_RANK.items() for x in (F.lit(k), F.lit(v))])
    return allr.withColumn("kind_rank", F.element_at(rank, F.col("type"))).withColumn(
        "sub_rank", F.when(F.col("type") == "database", 1).otherwise(0)
    )


def order_deletes(plan: DataFrame) -> DataFrame:
    """Guides, dives, flights, then shares each followed by its database;
    consumers before producers (higher level first); inside a package the
    declaration order (``ordinal``) when given, else the key."""
    within = [F.col("ordinal").asc_nulls_last()] if "ordinal" in plan.columns else []
    return plan.orderBy(
        F.col("kind_rank").asc(),
        F.col("level").desc(),
        F.col("package").asc(),
        *within,
        F.col("key").asc(),
        F.col("sub_rank").asc(),
        F.col("id").asc_nulls_first(),
    )


# ---------------------------------------------------------------- C5
REF_FIELDS = ("type", "url", "schema", "table", "column", "view", "macro", "uuid", "description")


def refs_equal(a: Column, b: Column) -> Column:
    """C5 equality: canonical arrays, other JSON by value, else as text."""
    return canonical_equal(canonical_refs(a), a, canonical_refs(b), b)


def canonical_equal(canon_a: Column, text_a: Column, canon_b: Column, text_b: Column) -> Column:
    """C5 equality on already canonicalised references (so callers that also
    read fields of the canonical arrays parse each side once)."""
    return F.coalesce(canonical_key(canon_a, text_a) == canonical_key(canon_b, text_b), F.lit(False))


def canonical_key(canon: Column, text: Column) -> Column:
    """Text that is equal for equal references: the canonical array, else the
    parsed JSON value (white space and key order do not count), else the text."""
    parsed = F.to_json(F.try_parse_json(text))
    return F.when(canon.isNotNull(), F.to_json(canon)).otherwise(F.coalesce(parsed, F.concat(F.lit("text:"), F.coalesce(text, F.lit("")))))


def canonical_refs(json_text: Column) -> Column:
    """JSON array of references -> array of fixed 9-field structs, with
    ``uuid`` falling back to ``<type>_id`` (a per-element computed JSON
    path); NULL when the text is not a JSON array of objects (such values
    compare as text)."""
    elems = F.from_json(json_text, "array<string>")
    objects_only = F.forall(elems, lambda e: F.trim(e).startswith("{"))

    def canon(e: Column) -> Column:
        typ = F.coalesce(F.get_json_object(e, "$.type"), F.lit(""))
        # literal paths for the known kinds; a computed path only for others
        dynamic = F.call_function("get_json_object", e, F.concat(F.lit("$."), typ, F.lit("_id")))
        fallback = (
            F.when(typ == "dive", F.get_json_object(e, "$.dive_id"))
            .when(typ == "flight", F.get_json_object(e, "$.flight_id"))
            .when(typ == "guide", F.get_json_object(e, "$.guide_id"))
            .otherwise(dynamic)
        )
        uid = F.coalesce(F.get_json_object(e, "$.uuid"), fallback)
        fields = []
        for f in REF_FIELDS:
            if f == "type":
                fields.append(typ.alias(f))
            elif f == "uuid":
                fields.append(uid.alias(f))
            else:
                fields.append(F.get_json_object(e, f"$.{f}").alias(f))
        return F.struct(*fields)

    return F.when(objects_only, F.transform(elems, canon))


# ---------------------------------------------------------------- C4
def append_versions(
    current: DataFrame,
    desired: DataFrame,
    id_col: str,
    content_col: str,
    external_id_col: str,
    refs_col: str,
    metadata_cols: Sequence[str],
    access_col: str,
    version_col: str = "version",
) -> DataFrame:
    """C4: per id, whether a new version is needed (content, external id
    when given, or canonical references differ), which metadata fields
    changed, whether access changed, and the next version number."""
    # Content is compared by SHA-256 digest computed before the join, so the
    # shuffle moves 32 bytes per row instead of whole documents.
    others = (external_id_col, refs_col, access_col, *metadata_cols)
    cur = current.select(
        id_col,
        F.sha2(F.col(content_col), 256).alias(f"cur__{content_col}"),
        *[F.col(c).alias(f"cur__{c}") for c in (*others, version_col)],
    )
    des = desired.select(id_col, F.sha2(F.col(content_col), 256).alias(f"des__{content_col}"), *[F.col(c).alias(f"des__{c}") for c in others])
    j = des.join(cur, id_col, "inner")
    ext_given = F.coalesce(F.col(f"des__{external_id_col}"), F.lit("")) != F.lit("")
    same_content = F.col(f"cur__{content_col}").eqNullSafe(F.col(f"des__{content_col}"))
    same_ext = ~ext_given | (F.coalesce(F.col(f"cur__{external_id_col}"), F.lit("")) == F.col(f"des__{external_id_col}"))
    same_refs = refs_equal(F.col(f"cur__{refs_col}"), F.col(f"des__{refs_col}"))
    append = ~(same_content & same_ext & same_refs)
    changed = F.filter(
        F.array(*[F.when(F.coalesce(F.col(f"cur__{m}"), F.lit("")) != F.coalesce(F.col(f"des__{m}"), F.lit("")), F.lit(m)) for m in metadata_cols]),
        lambda x: x.isNotNull(),
    )
    access_changed = F.coalesce(F.col(f"cur__{access_col}"), F.lit("")) != F.coalesce(F.col(f"des__{access_col}"), F.lit("user"))
    return j.select(
        id_col,
        append.alias("append_version"),
        F.when(append, F.col(f"cur__{version_col}") + 1).otherwise(F.col(f"cur__{version_col}")).alias("next_version"),
        changed.alias("changed_metadata"),
        access_changed.alias("access_changed"),
    )


def version_rows(
    decisions: DataFrame,
    desired: DataFrame,
    id_col: str,
    content_col: str,
    external_id_col: str,
    refs_col: str,
    metadata_cols: Sequence[str],
) -> DataFrame:
    """C4: the version rows to append, from :func:`append_versions`: the new
    number, content, external id and references, and of the metadata only the
    values that changed (others NULL).  Content moves only for these rows' ids."""
    wanted = decisions.where("append_version").select(id_col, F.col("next_version").alias("version"), "changed_metadata")
    rows = desired.select(id_col, content_col, external_id_col, refs_col, *metadata_cols).join(wanted, id_col)
    changed = [F.when(F.array_contains("changed_metadata", m), F.col(m)).alias(m) for m in metadata_cols]
    return rows.select(id_col, "version", content_col, external_id_col, refs_col, *changed)
