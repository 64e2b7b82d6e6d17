"""Registered queries for plans (C1-C5), lineage (L2, L3), the path-prefix
join (J7), projections (P1), scalar functions (F1, F5, F7-F13) and the
catalog inventory (S9, A5, J3, M10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablework import testdata as td
from tablework.contracts import Contract
from tablework.functions import columns as fx
from tablework.operators import joins as jn
from tablework.operators import lineage as lg
from tablework.plans import changes as ch
from tablework.queries import register
from tablework.sources.json_scan import drop_matching_lines, project


def _t(spark, sf_dir, name):
    return td.table(spark, sf_dir, name)


# ====================================================================
# C1 / C3 desired-versus-live plan on customers
# ====================================================================
PLAN_TYPE_SQL = """CASE c_mktsegment WHEN 'BUILDING' THEN 'dive' WHEN 'FURNITURE' THEN 'share'
         WHEN 'HOUSEHOLD' THEN '{input}'
         WHEN 'MACHINERY' THEN CASE WHEN c_acctbal < 3000 THEN 'role' ELSE 'guide' END
         ELSE 'flight' END"""

PLAN_INPUT_SQL = f"""
desired AS (
  SELECT 'bp_' || CAST(c_nationkey AS VARCHAR) AS package,
    {PLAN_TYPE_SQL.format(input="input")} AS type,
    'k' || CAST(c_custkey AS VARCHAR) AS key,
    c_name AS name,
    CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 3000 THEN c_acctbal > 500
         WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal < 9000
         ELSE true END AS deploy,
    c_acctbal > 5000 AS run_on_deploy,
    c_acctbal < 2000 AS managed,
    CASE WHEN c_mktsegment = 'BUILDING' THEN
      CASE WHEN c_acctbal > 7000 THEN 'endorsed' WHEN c_acctbal > 3000 THEN 'draft' END END AS desired_status,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'bp_' || CAST(c_nationkey + 3 AS VARCHAR) END AS producer,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'out' END AS output,
    CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal BETWEEN 3000 AND 3500 THEN 'id_' || CAST(c_custkey AS VARCHAR)
         WHEN c_mktsegment = 'MACHINERY' AND c_acctbal BETWEEN 8000 AND 8500 THEN 'gid_' || CAST(c_custkey AS VARCHAR) END AS id,
    CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal > 4000 THEN 'ops' END AS topic,
    CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal BETWEEN 1500 AND 3000
           THEN ['Customer#' || lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0')]
         WHEN c_mktsegment = 'FURNITURE' AND c_acctbal > 7000
           THEN ['Customer#' || lpad(CAST(c_custkey + 2 AS VARCHAR), 9, '0')]
         ELSE CAST([] AS VARCHAR[]) END AS roles,
    c_custkey, c_acctbal, c_nationkey
  FROM customer WHERE c_acctbal >= 0
),
refs AS (
  SELECT package, type, key, 1 AS pos, 'guide' AS rt, CAST(NULL AS VARCHAR) AS uuid, 'archive' AS rp, 'k' || CAST(c_custkey + 5 AS VARCHAR) AS rk
  FROM desired WHERE type = 'guide' AND deploy AND c_acctbal > 4500
  UNION ALL
  SELECT package, type, key, 2, 'dive', NULL, 'archive', 'k' || CAST(c_custkey + 1 AS VARCHAR)
  FROM desired WHERE type = 'guide' AND deploy AND c_acctbal BETWEEN 3500 AND 5500
  UNION ALL
  SELECT package, type, key, 3, 'flight', 'id_' || CAST(c_custkey + 3 AS VARCHAR), NULL, NULL
  FROM desired WHERE type = 'guide' AND deploy AND c_acctbal > 4000
  UNION ALL
  SELECT package, type, key, 4, 'guide', NULL, 'bp_' || CAST(c_nationkey + 2 AS VARCHAR), key
  FROM desired WHERE type = 'guide' AND deploy AND c_acctbal < 3300
  UNION ALL
  SELECT package, type, key, 5, 'guide', NULL, package, key FROM desired WHERE type = 'guide' AND deploy
),
declared AS (
  SELECT 'bp_' || CAST(c_nationkey AS VARCHAR) AS package, {PLAN_TYPE_SQL.format(input="input")} AS type, 'k' || CAST(c_custkey AS VARCHAR) AS key, c_name AS name,
    CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal BETWEEN 3000 AND 3500 THEN 'id_' || CAST(c_custkey AS VARCHAR)
         WHEN c_mktsegment = 'MACHINERY' AND c_acctbal BETWEEN 8000 AND 8500 THEN 'gid_' || CAST(c_custkey AS VARCHAR) END AS id,
    CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal > 4000 THEN 'ops' END AS topic,
    CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 3000 THEN c_acctbal > 500 WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal < 9000 ELSE true END AS deploy
  FROM customer
),
all_declared AS (SELECT * FROM declared UNION ALL SELECT 'archive', type, key, name, id, topic, deploy FROM declared),
live AS (
  SELECT {PLAN_TYPE_SQL.format(input="share")} AS type,
    c_name AS name, 'id_' || CAST(c_custkey AS VARCHAR) AS id,
    CASE WHEN c_acctbal > 4000 THEN 'endorsed' ELSE 'draft' END AS status,
    CASE WHEN c_acctbal > 4500 THEN 'ops' ELSE '' END AS topic
  FROM customer WHERE c_acctbal < 6000
  UNION ALL
  SELECT {PLAN_TYPE_SQL.format(input="share")},
    c_name, 'id_' || CAST(c_custkey AS VARCHAR) || '_b', 'draft',
    CASE WHEN c_acctbal > 4500 THEN 'ops' ELSE '' END
  FROM customer WHERE c_acctbal BETWEEN 1000 AND 1400
)"""


def plan_inputs(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
    machinery_type = F.when(bal < 3000, "role").otherwise("guide")

    def typ(input_type):
        return (
            F.when(seg == "BUILDING", "dive").when(seg == "FURNITURE", "share").when(seg == "HOUSEHOLD", input_type)
            .when(seg == "MACHINERY", machinery_type).otherwise("flight")
        )

    def customer_name(offset):
        return F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") + offset).cast("string"), 9, "0"))

    desired = c.where(bal >= 0).select(
        F.concat(F.lit("bp_"), F.col("c_nationkey").cast("string")).alias("package"),
        typ("input").alias("type"),
        F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"),
        F.col("c_name").alias("name"),
        F.when((seg == "MACHINERY") & (bal < 3000), bal > 500).when(seg == "MACHINERY", bal < 9000).otherwise(F.lit(True)).alias("deploy"),
        (bal > 5000).alias("run_on_deploy"),
        (bal < 2000).alias("managed"),
        F.when(seg == "BUILDING", F.when(bal > 7000, "endorsed").when(bal > 3000, "draft")).alias("desired_status"),
        F.when(seg == "HOUSEHOLD", F.concat(F.lit("bp_"), (F.col("c_nationkey") + 3).cast("string"))).alias("producer"),
        F.when(seg == "HOUSEHOLD", F.lit("out")).alias("output"),
        F.when((seg == "MACHINERY") & bal.between(3000, 3500), F.concat(F.lit("id_"), F.col("c_custkey").cast("string")))
        .when((seg == "MACHINERY") & bal.between(8000, 8500), F.concat(F.lit("gid_"), F.col("c_custkey").cast("string")))
        .alias("id"),
        F.when((seg == "MACHINERY") & (bal > 4000), F.lit("ops")).alias("topic"),
        F.when((seg == "MACHINERY") & bal.between(1500, 3000), F.array(customer_name(1)))
        .when((seg == "FURNITURE") & (bal > 7000), F.array(customer_name(2)))
        .otherwise(F.array().cast("array<string>"))
        .alias("roles"),
        _references(bal).alias("references"),
    )
    declared = c.select(
        F.concat(F.lit("bp_"), F.col("c_nationkey").cast("string")).alias("package"),
        typ("input").alias("type"),
        F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"),
        F.col("c_name").alias("name"),
        F.when((seg == "MACHINERY") & bal.between(3000, 3500), F.concat(F.lit("id_"), F.col("c_custkey").cast("string")))
        .when((seg == "MACHINERY") & bal.between(8000, 8500), F.concat(F.lit("gid_"), F.col("c_custkey").cast("string")))
        .alias("id"),
        F.when((seg == "MACHINERY") & (bal > 4000), F.lit("ops")).alias("topic"),
        F.when((seg == "MACHINERY") & (bal < 3000), bal > 500).when(seg == "MACHINERY", bal < 9000).otherwise(F.lit(True)).alias("deploy"),
    )
    declared = declared.unionByName(declared.withColumn("package", F.lit("archive")))
    live_topic = F.when(bal > 4500, "ops").otherwise("")
    live1 = c.where(bal < 6000).select(
        typ("share").alias("type"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("id_"), F.col("c_custkey").cast("string")).alias("id"),
        F.when(bal > 4000, "endorsed").otherwise("draft").alias("status"),
        live_topic.alias("topic"),
    )
    live2 = c.where(bal.between(1000, 1400)).select(
        typ("share").alias("type"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("id_"), F.col("c_custkey").cast("string"), F.lit("_b")).alias("id"),
        F.lit("draft").alias("status"),
        live_topic.alias("topic"),
    )
    return desired, live1.unionByName(live2), declared


def _references(bal):
    """What a customer's guide refers to: an archived guide and dive, a flight by
    id, a guide of another package, and itself."""
    text = lambda prefix, offset: F.concat(F.lit(prefix), (F.col("c_custkey") + offset).cast("string"))

    def ref(kind, uuid=None, package=None, resource=None):
        given = {"uuid": uuid, "package": package, "resource": resource}
        return F.struct(F.lit(kind).alias("type"), *[(F.lit(None).cast("string") if v is None else v).alias(k) for k, v in given.items()])

    refs = F.array(
        ref("catalog"),
        F.when(bal > 4500, ref("guide", package=F.lit("archive"), resource=text("k", 5))),
        F.when(bal.between(3500, 5500), ref("dive", package=F.lit("archive"), resource=text("k", 1))),
        F.when(bal > 4000, ref("flight", uuid=text("id_", 3))),
        F.when(bal < 3300, ref("guide", package=F.concat(F.lit("bp_"), (F.col("c_nationkey") + 2).cast("string")), resource=text("k", 0))),
        ref("guide", resource=text("k", 0)),
    )
    return F.filter(refs, lambda r: r.isNotNull())


@register(
    "plan_changes",
    f"""
WITH {PLAN_INPUT_SQL},
lk AS (
  SELECT type AS lookup_type, name AS mkey, id, status FROM live WHERE type <> 'guide'
  UNION ALL SELECT type, 'id:' || id, id, status FROM live WHERE type = 'guide'
  UNION ALL SELECT type, 't:' || name || chr(1) || coalesce(topic, ''), id, status FROM live WHERE type = 'guide'
),
counts AS (
  SELECT lookup_type, mkey, count(*) AS n_live, min(id) AS min_id, min_by(status, id) AS min_status, string_agg(id, ',' ORDER BY id) AS ids FROM lk GROUP BY lookup_type, mkey
),
targets AS (
  SELECT *, CASE WHEN type = 'guide' AND id IS NOT NULL THEN 'id:' || id WHEN type = 'guide' THEN 't:' || name || chr(1) || coalesce(topic, '') ELSE name END AS mkey
  FROM all_declared
),
ref_errors AS (
  SELECT r.package, r.type, r.key, r.pos, CASE
      WHEN r.uuid IS NOT NULL THEN CASE WHEN (SELECT count(*) FROM live l WHERE l.type = r.rt AND l.id = r.uuid) <> 1
        THEN 'Guide ' || r.rt || ' reference ' || r.uuid || ' does not resolve to exactly one live resource' END
      WHEN r.rp NOT IN (SELECT package FROM all_declared) THEN 'Guide reference package ' || r.rp || ' is not available'
      WHEN t.mkey IS NULL THEN 'Guide reference ' || r.rp || '.' || r.rt || '.' || r.rk || ' is not declared'
      WHEN r.rt = 'guide' AND NOT t.deploy AND t.id IS NULL
        THEN 'Guide reference ' || r.rp || '.' || r.rt || '.' || r.rk || ' is a validation-only Guide; set deploy: true or configure its id'
      WHEN r.rp IN (SELECT package FROM desired) AND (r.rt <> 'guide' OR t.deploy) THEN NULL
      WHEN coalesce(c.n_live, 0) <> 1
        THEN 'Guide reference ' || r.rp || '.' || r.rt || '.' || r.rk || ' resolved to ' || coalesce(c.n_live, 0) || ' live resources; expected exactly one'
    END AS message
  FROM refs r LEFT JOIN targets t ON t.package = r.rp AND t.type = r.rt AND t.key = r.rk LEFT JOIN counts c ON c.lookup_type = r.rt AND c.mkey = t.mkey
),
bad AS (SELECT package, type, key, min_by(message, pos) AS message FROM ref_errors WHERE message IS NOT NULL GROUP BY package, type, key),
known AS (SELECT name FROM live WHERE type = 'role' UNION SELECT name FROM desired WHERE type = 'role' AND deploy),
missing AS (
  SELECT package, type, key, string_agg(DISTINCT r, ', ' ORDER BY r) AS missing_roles
  FROM (SELECT package, type, key, unnest(roles) AS r FROM desired) x
  WHERE r IS NOT NULL AND r NOT IN (SELECT name FROM known)
  GROUP BY package, type, key
),
producing AS (SELECT DISTINCT package FROM desired WHERE type = 'flight' AND run_on_deploy),
selected AS (SELECT DISTINCT package FROM desired),
d AS (
  SELECT *, CASE WHEN type = 'input' THEN 'share' ELSE type END AS lookup_type,
    CASE WHEN type = 'guide' AND id IS NOT NULL THEN 'id:' || id
         WHEN type = 'guide' THEN 't:' || name || chr(1) || coalesce(topic, '')
         ELSE name END AS mkey
  FROM desired
),
j AS (
  SELECT d.*, coalesce(c.n_live, 0) AS n_live,
    CASE WHEN d.type NOT IN ('share', 'input', 'role') THEN c.ids ELSE c.min_id END AS live_id,
    b.message AS reference_error,
    CASE WHEN d.type NOT IN ('share', 'input', 'role') THEN c.min_status END AS live_status,
    m.missing_roles,
    coalesce(d.package IN (SELECT package FROM producing), false) AS can_produce,
    coalesce(d.producer IN (SELECT package FROM selected), false) AS psel,
    coalesce(d.producer IN (SELECT package FROM producing), false) AS pcan,
    coalesce(d.deploy, false) AS deployed,
    d.type = 'guide' AND NOT coalesce(d.deploy, false) AS guide_off,
    d.type = 'guide' AND d.id IS NOT NULL AND coalesce(c.n_live, 0) = 0 AS guide_id_missing
  FROM d
  LEFT JOIN counts c ON c.lookup_type = d.lookup_type AND c.mkey = d.mkey
  LEFT JOIN missing m ON m.package = d.package AND m.type = d.type AND m.key = d.key
  LEFT JOIN bad b ON b.package = d.package AND b.type = d.type AND b.key = d.key
),
p AS (
  SELECT package, type, key, name,
    CASE
      WHEN type = 'role' THEN CASE WHEN NOT deployed THEN 'skipped' WHEN missing_roles IS NOT NULL THEN 'error'
                                   WHEN n_live > 0 THEN 'update' ELSE 'create' END
      WHEN type = 'share' THEN CASE WHEN missing_roles IS NOT NULL THEN 'error'
                                    WHEN n_live > 0 AND coalesce(managed, false) THEN 'update' WHEN n_live > 0 THEN 'present'
                                    WHEN can_produce THEN 'pending' ELSE 'error' END
      WHEN type = 'input' THEN CASE WHEN n_live > 0 THEN 'present' WHEN psel AND pcan THEN 'pending' ELSE 'error' END
      WHEN guide_off THEN 'validated_only'
      WHEN guide_id_missing OR reference_error IS NOT NULL THEN 'error'
      WHEN n_live = 0 THEN 'create' WHEN n_live = 1 THEN 'update' ELSE 'error' END AS action,
    CASE WHEN (type = 'role' AND NOT deployed) OR reference_error IS NOT NULL THEN CAST(NULL AS BOOLEAN)
         WHEN guide_off OR guide_id_missing THEN false
         ELSE n_live > 0 END AS "exists",
    CASE WHEN guide_off THEN CAST(NULL AS VARCHAR)
         WHEN guide_id_missing OR reference_error IS NOT NULL THEN id
         WHEN type = 'role' THEN CASE WHEN deployed AND n_live > 0 THEN name END
         ELSE live_id END AS id,
    CASE
      WHEN type = 'role' THEN CASE WHEN NOT deployed THEN 'roles deploy only when resources.roles.<key>.deploy is true'
                                   WHEN missing_roles IS NOT NULL THEN 'included role(s) do not exist and are not selected for deployment: ' || missing_roles
                                   ELSE '' END
      WHEN type = 'share' THEN CASE WHEN missing_roles IS NOT NULL THEN 'grant role(s) do not exist and are not selected for deployment: ' || missing_roles
                                    WHEN n_live > 0 AND coalesce(managed, false) THEN 'share is available; filter and/or grants will be reconciled'
                                    WHEN n_live > 0 THEN 'share is available'
                                    WHEN can_produce THEN 'will be produced by a Flight configured with runOnDeploy'
                                    ELSE 'share is missing and no Flight in this package is configured with runOnDeploy' END
      WHEN type = 'input' THEN CASE WHEN n_live > 0 THEN 'resolved from ' || producer || '.' || output
                                    WHEN psel AND pcan THEN 'package ' || producer || '.' || output || ' is part of this plan and produces it'
                                    WHEN psel THEN 'package ' || producer || '.' || output || ' is part of this plan but runs nothing on deploy'
                                    ELSE 'required production output ' || producer || '.' || output || ' is not available' END
      WHEN guide_off THEN 'set deploy: true to publish this Guide'
      WHEN reference_error IS NOT NULL THEN reference_error
      WHEN guide_id_missing THEN 'configured Guide id does not exist'
      WHEN type = 'guide' AND n_live > 1 THEN 'duplicate Guide topic/title; set id explicitly'
      WHEN n_live > 1 THEN CASE type WHEN 'flight' THEN 'duplicate Flight name; expected 0 or 1' WHEN 'dive' THEN 'duplicate Dive title; expected 0 or 1'
                                     ELSE 'duplicate name; expected 0 or 1' END
      WHEN type = 'dive' AND n_live = 0 THEN CASE WHEN desired_status = 'endorsed' THEN 'endorsing requires an organization admin' ELSE '' END
      WHEN type = 'dive' AND n_live = 1 THEN CASE
        WHEN live_status = 'endorsed' AND desired_status IS NOT NULL AND desired_status <> 'endorsed' THEN 'moving off endorsed may be one-way unless the deployer is an organization admin'
        WHEN desired_status = 'endorsed' AND coalesce(live_status, '') <> 'endorsed' THEN 'endorsing requires an organization admin'
        WHEN live_status = 'endorsed' THEN 'content update remains endorsed'
        ELSE '' END
      ELSE '' END AS notes,
    CASE WHEN type = 'dive' THEN live_status END AS current_status,
    CASE WHEN type = 'dive' THEN desired_status END AS desired_status
  FROM j
)
SELECT *,
  CASE WHEN type <> 'dive' THEN ''
       WHEN desired_status IS NULL AND current_status IS NOT NULL AND current_status <> '' THEN 'preserve ' || current_status
       WHEN desired_status IS NULL AND action = 'create' THEN 'draft (default)'
       WHEN desired_status IS NULL THEN 'unmanaged'
       WHEN current_status IS NULL THEN desired_status
       WHEN current_status = desired_status THEN desired_status
       ELSE current_status || ' -> ' || desired_status END AS status_label
FROM p
""",
)
def q_plan_changes(spark, sf_dir):
    return ch.plan_changes(*plan_inputs(spark, sf_dir))


# ====================================================================
# C2 guarded delete plan on suppliers
# ====================================================================
DELETE_INPUT_SQL = """
cand AS (
  SELECT 'bp_' || CAST(s_nationkey AS VARCHAR) AS package,
    CASE WHEN s_acctbal < 2000 THEN 'guide' WHEN s_acctbal < 5000 THEN 'dive' WHEN s_acctbal < 8000 THEN 'flight' ELSE 'share' END AS type,
    'k' || CAST(s_suppkey AS VARCHAR) AS key,
    s_name || CASE WHEN s_acctbal > 500 THEN '__preview_x' ELSE '' END AS name,
    CASE WHEN s_nationkey < 10 THEN 0 WHEN s_nationkey < 20 THEN 1 ELSE 2 END AS level,
    s_acctbal > 9000 AS drop_database,
    'db_' || lower(s_name) || '__preview_x' AS database,
    NOT (s_acctbal BETWEEN 3000 AND 3300) AS cleanup,
    s_acctbal > 300 AS deploy,
    CASE WHEN s_acctbal > 1000 THEN 'ops' END AS topic,
    s_name,
    s_acctbal
  FROM supplier
),
live AS (
  SELECT type, name, 'id_' || key AS id, CASE WHEN s_acctbal > 1500 THEN 'ops' ELSE '' END AS topic FROM cand WHERE s_acctbal > 1000
  UNION ALL
  SELECT type, name, 'id_' || key || '_b', CASE WHEN s_acctbal > 1500 THEN 'ops' ELSE '' END FROM cand WHERE s_acctbal > 9500
),
production AS (
  SELECT package, type, key, CASE WHEN s_acctbal > 9800 THEN name ELSE s_name || '_prod' END AS production_name FROM cand
  UNION ALL
  SELECT package, 'database', key, CASE WHEN s_acctbal > 9900 THEN database ELSE 'db_prod' END FROM cand WHERE type = 'share'
)"""


def delete_inputs(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    bal = F.col("s_acctbal")
    cand = s.select(
        F.concat(F.lit("bp_"), F.col("s_nationkey").cast("string")).alias("package"),
        F.when(bal < 2000, "guide").when(bal < 5000, "dive").when(bal < 8000, "flight").otherwise("share").alias("type"),
        F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("key"),
        F.concat(F.col("s_name"), F.when(bal > 500, F.lit("__preview_x")).otherwise(F.lit(""))).alias("name"),
        F.when(F.col("s_nationkey") < 10, 0).when(F.col("s_nationkey") < 20, 1).otherwise(2).alias("level"),
        (bal > 9000).alias("drop_database"),
        F.concat(F.lit("db_"), F.lower("s_name"), F.lit("__preview_x")).alias("database"),
        (~bal.between(3000, 3300)).alias("cleanup"),
        (bal > 300).alias("deploy"),
        F.when(bal > 1000, F.lit("ops")).alias("topic"),
        "s_name",
        bal,
    )
    live_topic = F.when(bal > 1500, "ops").otherwise("")
    live = cand.where(bal > 1000).select("type", "name", F.concat(F.lit("id_"), F.col("key")).alias("id"), live_topic.alias("topic")).unionByName(
        cand.where(bal > 9500).select("type", "name", F.concat(F.lit("id_"), F.col("key"), F.lit("_b")).alias("id"), live_topic.alias("topic"))
    )
    production = cand.select(
        "package", "type", "key", F.when(bal > 9800, F.col("name")).otherwise(F.concat("s_name", F.lit("_prod"))).alias("production_name")
    ).unionByName(
        cand.where(F.col("type") == "share").select(
            "package", F.lit("database").alias("type"), "key", F.when(bal > 9900, F.col("database")).otherwise(F.lit("db_prod")).alias("production_name")
        )
    )
    return cand.drop("s_acctbal", "s_name"), live, production


@register(
    "plan_deletes",
    f"""
WITH {DELETE_INPUT_SQL},
kept AS (SELECT * FROM cand WHERE coalesce(cleanup, true) AND (type <> 'guide' OR coalesce(deploy, false))),
rows AS (
  SELECT package, type, key, name, level, topic FROM kept
  UNION ALL
  SELECT package, 'database', key, database, level, CAST(NULL AS VARCHAR) FROM kept WHERE type = 'share' AND drop_database
),
g AS (
  SELECT r.*,
    CASE WHEN p.production_name IS NOT NULL AND r.name = p.production_name
           THEN 'refusing to delete preview ' || r.type || ' because it matches production: ' || r.name
         WHEN NOT contains(r.name, '__preview_x')
           THEN 'refusing to ' || CASE WHEN r.type IN ('share', 'database') THEN 'drop' ELSE 'delete' END
                || ' preview ' || r.type || ' without branch slug __preview_x'
    END AS guard_error
  FROM rows r LEFT JOIN production p ON p.package = r.package AND p.type = r.type AND p.key = r.key
),
resolved AS (
  SELECT g.package, g.type, g.key, g.name, g.level,
    CASE WHEN l.id IS NULL THEN 'missing' WHEN g.type = 'share' THEN 'drop_share' ELSE 'delete' END AS action,
    l.id IS NOT NULL AS "exists", l.id AS id, '' AS notes
  FROM g LEFT JOIN live l ON l.type = g.type AND l.name = g.name
    AND (CASE WHEN g.type = 'guide' THEN coalesce(g.topic, '') ELSE '' END) = (CASE WHEN l.type = 'guide' THEN coalesce(l.topic, '') ELSE '' END)
  WHERE g.guard_error IS NULL AND g.type <> 'database'
  UNION ALL
  SELECT package, type, key, name, level, 'error', CAST(NULL AS BOOLEAN), CAST(NULL AS VARCHAR), guard_error FROM g WHERE guard_error IS NOT NULL
  UNION ALL
  SELECT package, type, key, name, level, 'drop_database', true, CAST(NULL AS VARCHAR),
    'database existence is not inspected; cleanup uses DROP DATABASE IF EXISTS' FROM g WHERE guard_error IS NULL AND type = 'database'
)
SELECT *, CASE type WHEN 'guide' THEN 0 WHEN 'dive' THEN 1 WHEN 'flight' THEN 2 ELSE 3 END AS kind_rank,
  CASE WHEN type = 'database' THEN 1 ELSE 0 END AS sub_rank
FROM resolved
""",
)
def q_plan_deletes(spark, sf_dir):
    cand, live, production = delete_inputs(spark, sf_dir)
    return ch.plan_deletes(cand, live, production, ["__preview_x"])


# ====================================================================
# C4 change-detected versions, C5 canonical references on documents
# ====================================================================
def _doc_versions(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    stored_refs = F.concat(F.lit('[{"type": "dive", "dive_id": "d'), F.col("doc_id").cast("string"), F.lit('", "description": null}]'))
    wanted_refs = F.when(F.col("source") == "src7", F.concat(F.lit('[{"type": "dive", "uuid": "x'), F.col("doc_id").cast("string"), F.lit('"}]'))).otherwise(
        F.concat(F.lit('[{"uuid": "d'), F.col("doc_id").cast("string"), F.lit('", "type": "dive"}]'))
    )
    current = d.select(
        "doc_id",
        F.col("text").alias("content"),
        F.col("source").alias("external_id"),
        stored_refs.alias("refs"),
        F.col("lang").alias("title"),
        F.col("source").alias("topic"),
        F.lit("").alias("description"),
        F.lit("user").alias("access"),
        F.lit(1).cast("bigint").alias("version"),
    )
    desired = d.select(
        "doc_id",
        F.when(F.col("lang") == "de", F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("content"),
        F.when(F.col("lang") == "es", F.lit("")).otherwise(F.col("source")).alias("external_id"),
        wanted_refs.alias("refs"),
        F.when(F.col("lang") == "fr", F.upper("lang")).otherwise(F.col("lang")).alias("title"),
        F.col("source").alias("topic"),
        F.lit("").alias("description"),
        F.when(F.col("n_chars") > 20000, F.lit("org")).otherwise(F.lit("user")).alias("access"),
    )
    return current, desired


DOC_VERSIONS_SQL = """
cur AS (
  SELECT doc_id, text AS content, source AS external_id,
    '[{"type": "dive", "dive_id": "d' || CAST(doc_id AS VARCHAR) || '", "description": null}]' AS refs,
    lang AS title, source AS topic, '' AS description, 'user' AS access, CAST(1 AS BIGINT) AS version
  FROM documents
),
des AS (
  SELECT doc_id, CASE WHEN lang = 'de' THEN text || chr(10) ELSE text END AS content,
    CASE WHEN lang = 'es' THEN '' ELSE source END AS external_id,
    CASE WHEN source = 'src7' THEN '[{"type": "dive", "uuid": "x' || CAST(doc_id AS VARCHAR) || '"}]'
         ELSE '[{"uuid": "d' || CAST(doc_id AS VARCHAR) || '", "type": "dive"}]' END AS refs,
    CASE WHEN lang = 'fr' THEN upper(lang) ELSE lang END AS title,
    source AS topic, '' AS description,
    CASE WHEN n_chars > 20000 THEN 'org' ELSE 'user' END AS access
  FROM documents
)"""


@register(
    "append_versions",
    f"""
WITH {DOC_VERSIONS_SQL},
canon AS (
  SELECT c.doc_id,
    c.content IS NOT DISTINCT FROM d.content AS same_content,
    (coalesce(d.external_id, '') = '' OR coalesce(c.external_id, '') = d.external_id) AS same_ext,
    coalesce(json_extract_string(c.refs, '$[0].uuid'), json_extract_string(c.refs, '$[0].dive_id'))
      = coalesce(json_extract_string(d.refs, '$[0].uuid'), json_extract_string(d.refs, '$[0].dive_id')) AS same_refs,
    c.version, c.title AS ct, d.title AS dt, c.topic AS cto, d.topic AS dto, c.description AS cde, d.description AS dde,
    c.access AS ca, d.access AS da
  FROM cur c JOIN des d USING (doc_id)
)
SELECT doc_id,
  NOT (same_content AND same_ext AND same_refs) AS append_version,
  CASE WHEN NOT (same_content AND same_ext AND same_refs) THEN version + 1 ELSE version END AS next_version,
  array_to_string(list_filter([CASE WHEN coalesce(ct, '') <> coalesce(dt, '') THEN 'title' END,
                               CASE WHEN coalesce(cto, '') <> coalesce(dto, '') THEN 'topic' END,
                               CASE WHEN coalesce(cde, '') <> coalesce(dde, '') THEN 'description' END], lambda x: x IS NOT NULL), ',') AS changed_metadata,
  coalesce(ca, '') <> coalesce(da, 'user') AS access_changed
FROM canon
""",
)
def q_append_versions(spark, sf_dir):
    current, desired = _doc_versions(spark, sf_dir)
    out = ch.append_versions(current, desired, "doc_id", "content", "external_id", "refs", ["title", "topic", "description"], "access")
    return out.withColumn("changed_metadata", F.array_join("changed_metadata", ","))


@register(
    "appended_versions",
    f"""
WITH {DOC_VERSIONS_SQL},
pair AS (
  SELECT d.*, c.version AS old_version, c.title AS old_title, c.topic AS old_topic, c.description AS old_description,
    c.content IS DISTINCT FROM d.content
    OR (ifnull(d.external_id, '') <> '' AND ifnull(c.external_id, '') <> d.external_id)
    OR ifnull(json_extract_string(c.refs, '$[0].uuid'), json_extract_string(c.refs, '$[0].dive_id'))
       <> ifnull(json_extract_string(d.refs, '$[0].uuid'), json_extract_string(d.refs, '$[0].dive_id')) AS appends
  FROM des d JOIN cur c ON c.doc_id = d.doc_id
)
SELECT doc_id, old_version + 1 AS version, sha256(content) AS content_sha256, external_id, refs,
  CASE WHEN ifnull(title, '') <> ifnull(old_title, '') THEN title END AS title,
  CASE WHEN ifnull(topic, '') <> ifnull(old_topic, '') THEN topic END AS topic,
  CASE WHEN ifnull(description, '') <> ifnull(old_description, '') THEN description END AS description
FROM pair WHERE appends
""",
)
def q_appended_versions(spark, sf_dir):
    current, desired = _doc_versions(spark, sf_dir)
    metadata = ["title", "topic", "description"]
    decisions = ch.append_versions(current, desired, "doc_id", "content", "external_id", "refs", metadata, "access")
    rows = ch.version_rows(decisions, desired, "doc_id", "content", "external_id", "refs", metadata)
    return rows.withColumn("content_sha256", F.sha2("content", 256)).drop("content")


@register(
    "canonical_references",
    f"""
WITH {DOC_VERSIONS_SQL}
SELECT c.doc_id,
  'dive' AS ref_type,
  coalesce(json_extract_string(c.refs, '$[0].uuid'), json_extract_string(c.refs, '$[0].dive_id')) AS stored_uuid,
  json_extract_string(d.refs, '$[0].uuid') AS wanted_uuid,
  coalesce(json_extract_string(c.refs, '$[0].uuid'), json_extract_string(c.refs, '$[0].dive_id'))
    = json_extract_string(d.refs, '$[0].uuid') AS refs_equal
FROM cur c JOIN des d USING (doc_id)
""",
)
def q_canonical_references(spark, sf_dir):
    current, desired = _doc_versions(spark, sf_dir)
    j = current.select("doc_id", F.col("refs").alias("c_refs")).join(desired.select("doc_id", F.col("refs").alias("d_refs")), "doc_id")
    # canonicalise each side once, then read fields and compare
    canon = j.select("doc_id", "c_refs", "d_refs", ch.canonical_refs(F.col("c_refs")).alias("cc"), ch.canonical_refs(F.col("d_refs")).alias("dc"))
    return canon.select(
        "doc_id",
        F.element_at("cc", 1)["type"].alias("ref_type"),
        F.element_at("cc", 1)["uuid"].alias("stored_uuid"),
        F.element_at("dc", 1)["uuid"].alias("wanted_uuid"),
        ch.canonical_equal(F.col("cc"), F.col("c_refs"), F.col("dc"), F.col("d_refs")).alias("refs_equal"),
    )


# ====================================================================
# L2 / L3 lineage over region -> nation -> customer/supplier -> orders
# ====================================================================
EDGES_SQL = """
edges AS (
  SELECT 'nation:' || CAST(n_nationkey AS VARCHAR) AS consumer, 'region:' || CAST(n_regionkey AS VARCHAR) AS producer FROM nation
  UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), 'nation:' || CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR), 'nation:' || CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'order:' || CAST(o_orderkey AS VARCHAR), 'customer:' || CAST(o_custkey AS VARCHAR) FROM orders
)"""


def _edges(spark, sf_dir):
    return lg.graph_from_tables(
        spark, _t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "orders")
    )


@register(
    "lineage_downstream",
    f"""
WITH RECURSIVE {EDGES_SQL},
walk(node, depth) AS (
  SELECT 'region:1', 0
  UNION ALL
  SELECT e.consumer, w.depth + 1 FROM walk w JOIN edges e ON e.producer = w.node
)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node
""",
)
def q_lineage_downstream(spark, sf_dir):
    seeds = spark.createDataFrame([("region:1",)], "node string")
    return lg.expand_lineage(_edges(spark, sf_dir), seeds, "prod").select("node", F.col("depth").cast("int").alias("depth"))


@register(
    "lineage_component",
    f"""
WITH RECURSIVE {EDGES_SQL},
und AS (SELECT producer AS src, consumer AS dst FROM edges UNION SELECT consumer, producer FROM edges),
walk(node, depth) USING KEY (node) AS (
  SELECT 'nation:3', 0
  UNION
  SELECT u.dst, w.depth + 1 FROM walk w JOIN und u ON u.src = w.node
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.node = u.dst AND r.depth <= w.depth + 1)
)
SELECT node, CAST(depth AS INTEGER) AS depth FROM walk
""",
)
def q_lineage_component(spark, sf_dir):
    seeds = spark.createDataFrame([("nation:3",)], "node string")
    return lg.expand_lineage(_edges(spark, sf_dir), seeds, "preview").select("node", F.col("depth").cast("int").alias("depth"))


@register(
    "lineage_levels",
    f"""
WITH RECURSIVE {EDGES_SQL},
nodes AS (SELECT consumer AS node FROM edges UNION SELECT producer FROM edges),
walk(node, depth) AS (
  SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT consumer FROM edges)
  UNION ALL
  SELECT e.consumer, w.depth + 1 FROM walk w JOIN edges e ON e.producer = w.node
)
SELECT node, CAST(max(depth) AS INTEGER) AS level FROM walk GROUP BY node
""",
)
def q_lineage_levels(spark, sf_dir):
    levels, _ = lg.topological_levels(_edges(spark, sf_dir))
    return levels.select("node", F.col("level").cast("int").alias("level"))


@register(
    "lineage_edges",
    """
SELECT DISTINCT consumer, producer FROM (
  SELECT 'nation:' || CAST(n_nationkey AS VARCHAR) AS consumer, 'region:' || CAST(n_regionkey AS VARCHAR) AS producer FROM nation
  UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), 'nation:' || CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR), 'nation:' || CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'customer:' || CAST(c_custkey AS VARCHAR), 'nation:' || CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_acctbal > 5000
) e
""",
)
def q_lineage_edges(spark, sf_dir):
    """L1: declared inputs (nation -> region, customer -> nation) plus
    references (supplier -> nation, repeated customer references, and
    same-package self references, which add no edge)."""
    nation, customer, supplier, region = (_t(spark, sf_dir, n) for n in ("nation", "customer", "supplier", "region"))
    node = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    inputs = nation.select(node("nation:", "n_nationkey").alias("consumer"), node("region:", "n_regionkey").alias("producer")).unionByName(
        customer.select(node("customer:", "c_custkey").alias("consumer"), node("nation:", "c_nationkey").alias("producer"))
    )
    references = (
        supplier.select(node("supplier:", "s_suppkey").alias("consumer"), node("nation:", "s_nationkey").alias("producer"))
        .unionByName(customer.where(F.col("c_acctbal") > 5000).select(node("customer:", "c_custkey").alias("consumer"), node("nation:", "c_nationkey").alias("producer")))
        .unionByName(region.select(node("region:", "r_regionkey").alias("consumer"), node("region:", "r_regionkey").alias("producer")))
    )
    return lg.build_edges(inputs, references)


CYCLE_EDGES_SQL = EDGES_SQL.rstrip().rstrip(")") + """
  UNION ALL SELECT 'region:' || CAST(n_regionkey AS VARCHAR), 'nation:' || CAST(n_nationkey AS VARCHAR)
  FROM nation WHERE n_nationkey = n_regionkey
)"""


@register(
    "lineage_cycle_nodes",
    f"""
WITH RECURSIVE {CYCLE_EDGES_SQL},
reach(start, node) AS (
  SELECT consumer, producer FROM edges
  UNION
  SELECT r.start, e.producer FROM reach r JOIN edges e ON e.consumer = r.node
)
SELECT DISTINCT start AS node FROM reach WHERE start = node
""",
)
def q_lineage_cycle_nodes(spark, sf_dir):
    """L4: nodes on dependency cycles in the table graph plus a back edge
    region -> nation wherever a nation's key equals its region's key."""
    return lg.cycle_set(_cyclic_edges(spark, sf_dir))


def _cyclic_edges(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation")
    back = nation.where(F.col("n_nationkey") == F.col("n_regionkey")).select(
        F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("consumer"),
        F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("producer"),
    )
    return _edges(spark, sf_dir).unionByName(back)


# nations also consume the customer of their own number, so cycles run over customers and other nations
CHAIN_EDGES_SQL = CYCLE_EDGES_SQL.rstrip().rstrip(")") + """
  UNION ALL SELECT 'nation:' || CAST(n_nationkey AS VARCHAR), 'customer:' || CAST(c_custkey AS VARCHAR)
  FROM nation JOIN customer ON c_custkey = n_nationkey
)"""


@register(
    "lineage_cycle_chain",
    f"""
WITH RECURSIVE {CHAIN_EDGES_SQL},
reach(start, node) AS (
  SELECT consumer, producer FROM edges WHERE consumer NOT LIKE 'order:%' AND consumer NOT LIKE 'supplier:%'
  UNION
  SELECT r.start, e.producer FROM reach r JOIN edges e ON e.consumer = r.node
),
mutual AS (SELECT a.start AS node, a.node AS other FROM reach a JOIN reach b ON a.start = b.node AND a.node = b.start),
parts AS (SELECT node, min(other) AS part FROM mutual GROUP BY node),
nxt AS (
  SELECT e.consumer AS node, min(e.producer) AS nxt FROM edges e JOIN mutual m ON m.node = e.consumer AND m.other = e.producer GROUP BY e.consumer
),
walk(part, path, node) AS (
  SELECT DISTINCT part, [part], part FROM parts
  UNION ALL
  SELECT w.part, list_append(w.path, n.nxt), n.nxt FROM walk w JOIN nxt n ON n.node = w.node
  WHERE len(list_distinct(w.path)) = len(w.path)
),
whole AS (SELECT part, path[list_position(path, node):] AS chain FROM walk WHERE len(list_distinct(path)) < len(path)),
hops AS (SELECT part, chain, unnest(range(1, len(chain))) AS i FROM whole)
SELECT part, CAST(i - 1 AS BIGINT) AS hop, chain[i] AS consumer, chain[i + 1] AS producer FROM hops
""",
)
def q_lineage_cycle_chain(spark, sf_dir):
    """L4: the chain of every cyclic part, a row per hop."""
    own = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("consumer"),
        F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("producer"),
    )
    return lg.cycle_chains(_cyclic_edges(spark, sf_dir).unionByName(own))


# Orders consume their customer and all suppliers of their items: nodes with several dependencies.
ORDER_EDGES_SQL = EDGES_SQL.rstrip().rstrip(")") + """
  UNION ALL SELECT DISTINCT 'order:' || CAST(l_orderkey AS VARCHAR), 'supplier:' || CAST(l_suppkey AS VARCHAR) FROM lineitem
),
k0 AS (SELECT DISTINCT producer AS node, [producer] AS k FROM edges WHERE producer NOT IN (SELECT consumer FROM edges)),
k1 AS (SELECT consumer AS node, list_append(list_filter(max(k), lambda x: x > consumer), consumer) AS k FROM edges JOIN k0 ON producer = node GROUP BY consumer),
k2 AS (SELECT consumer AS node, list_append(list_filter(max(k), lambda x: x > consumer), consumer) AS k FROM edges JOIN k1 ON producer = node GROUP BY consumer),
k3 AS (SELECT consumer AS node, list_append(list_filter(max(k), lambda x: x > consumer), consumer) AS k FROM edges JOIN k2 ON producer = node GROUP BY consumer),
ks AS (SELECT node, 0 AS level, k FROM k0 UNION ALL SELECT node, 1, k FROM k1 UNION ALL SELECT node, 2, k FROM k2 UNION ALL SELECT node, 3, k FROM k3),
placed AS (SELECT node, level, row_number() OVER (ORDER BY k) AS place FROM ks)"""


def _order_edges(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("consumer"),
        F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("producer"),
    )
    return _edges(spark, sf_dir).unionByName(items)


@register(
    "lineage_order",
    f"""
WITH {ORDER_EDGES_SQL}
SELECT node, CAST(level AS INTEGER) AS level, CAST(place AS BIGINT) AS rank FROM placed
""",
)
def q_lineage_order(spark, sf_dir):
    """L3: the smallest producer-first order; it differs from (level, name)."""
    return lg.producer_first(_order_edges(spark, sf_dir)).select("node", F.col("level").cast("int").alias("level"), "rank")


@register(
    "lineage_downstream_order",
    f"""
WITH RECURSIVE {ORDER_EDGES_SQL},
walk(node, depth) AS (
  SELECT 'nation:3', 0
  UNION
  SELECT e.consumer, w.depth + 1 FROM walk w JOIN edges e ON e.producer = w.node
)
SELECT w.node, CAST(min(depth) AS INTEGER) AS depth, row_number() OVER (ORDER BY min(p.place)) AS rank
FROM walk w JOIN placed p ON p.node = w.node GROUP BY w.node
""",
)
def q_lineage_downstream_order(spark, sf_dir):
    """L2: what depends on nation 3, producers first."""
    seeds = spark.createDataFrame([("nation:3",)], "node string")
    return lg.ordered_selection(_order_edges(spark, sf_dir), seeds, "prod").select("node", F.col("depth").cast("int").alias("depth"), "rank")


@register(
    "lineage_component_order",
    f"""
WITH RECURSIVE {ORDER_EDGES_SQL},
und AS (SELECT producer AS src, consumer AS dst FROM edges UNION SELECT consumer, producer FROM edges),
walk(node, depth) USING KEY (node) AS (
  SELECT 'nation:3', 0
  UNION
  SELECT u.dst, min(w.depth) + 1 FROM walk w JOIN und u ON u.src = w.node
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.node = u.dst AND r.depth <= w.depth + 1)
  GROUP BY u.dst
)
SELECT w.node, CAST(depth AS INTEGER) AS depth, row_number() OVER (ORDER BY p.place) AS rank FROM walk w JOIN placed p ON p.node = w.node
""",
)
def q_lineage_component_order(spark, sf_dir):
    """L2 in both directions from nation 3, producers first."""
    seeds = spark.createDataFrame([("nation:3",)], "node string")
    return lg.ordered_selection(_order_edges(spark, sf_dir), seeds, "preview").select("node", F.col("depth").cast("int").alias("depth"), "rank")


# ====================================================================
# J7 path-prefix join on page URLs
# ====================================================================
@register(
    "url_owners",
    """
WITH files AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages),
owners AS (
  SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+/[^/?#]+)', 1) AS dir
  FROM pages WHERE url LIKE 'https://%'
)
SELECT o.dir, CAST(count(*) AS BIGINT) AS n_files
FROM files f JOIN owners o ON f.path = o.dir OR starts_with(f.path, o.dir || '/')
GROUP BY o.dir
""",
)
def q_url_owners(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    files = p.select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"))
    owners = p.where(F.col("url").startswith("https://")).select(F.regexp_extract("url", "^[a-z]+://([^/?#]+/[^/?#]+)", 1).alias("dir")).distinct()
    pairs = jn.prefix_join(files, owners, "path", "dir")
    return pairs.groupBy("dir").agg(F.count(F.lit(1)).cast("bigint").alias("n_files"))


# ====================================================================
# P1 rename-and-cast projection, F1 epoch milliseconds, F5 time text
# ====================================================================
LINEITEM_CONTRACT: Contract = [
    ("l_orderkey", "bigint", "order_id"),
    ("l_linenumber", "int", "line_no"),
    ("l_quantity", "int", "quantity"),
    ("l_extendedprice", "double", "price"),
    ("l_returnflag", "string", "return_flag"),
    ("l_shipdate", "date", "ship_date"),
]


@register(
    "lineitem_projection",
    """
SELECT CAST(l_orderkey AS BIGINT) AS order_id, CAST(l_linenumber AS INTEGER) AS line_no,
  CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DOUBLE) AS price,
  CAST(l_returnflag AS VARCHAR) AS return_flag, CAST(l_shipdate AS DATE) AS ship_date
FROM lineitem
""",
)
def q_lineitem_projection(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("l_quantity", F.round("l_quantity"))
    return project(li, LINEITEM_CONTRACT)


@register(
    "time_functions",
    """
SELECT o_orderkey,
  epoch_ms(o_orderdate) AS order_ms,
  epoch_ms(epoch_ms(o_orderdate)) AS order_ts,
  CAST(epoch_ms(epoch_ms(o_orderdate)) AS DATE) AS order_day,
  strftime(o_orderdate, '%Y-%m-%d %H:%M UTC') AS order_text,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '+00' AS order_tstz_text,
  CAST(CAST(o_orderdate AS DATE) - INTERVAL 7 DAY AS DATE) AS week_before
FROM orders
""",
)
def q_time_functions(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        "o_orderkey",
        ms.alias("order_ms"),
        fx.from_epoch_ms(ms).alias("order_ts"),
        fx.from_epoch_ms(ms, as_date=True).alias("order_day"),
        fx.fmt_utc("o_orderdate").alias("order_text"),
        fx.tstz_text("o_orderdate").alias("order_tstz_text"),
        F.date_sub(F.to_date("o_orderdate"), 7).alias("week_before"),
    )


# ====================================================================
# F7-F12 text functions
# ====================================================================
@register(
    "text_functions",
    """
WITH p AS (SELECT p_partkey, p_name, p_brand, p_type, p_brand || ', ' || p_type || ',, ' || p_name || ' ,' AS csv FROM part),
s AS (
  SELECT p_partkey, p_name, p_brand, p_type, csv,
    substr(trim(regexp_replace(lower(p_name || ' -- ' || p_brand || ' ' || p_type || ' ' || p_type || ' ' || p_type), '[^a-z0-9]+', '_', 'g'), '_'), 1, 48) AS cut
  FROM p
)
SELECT p_partkey,
  CASE WHEN cut = '' THEN 'preview' ELSE cut END AS slug,
  replace(p_type || '_' || p_brand, '_', ' ') AS label,
  array_to_string(list_filter(list_transform(string_split(csv, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts,
  CAST(len(list_filter(list_transform(string_split(csv, ','), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS n_parts,
  regexp_full_match(p_brand, 'Brand#[0-9]+') AS brand_ok,
  p_type || '|' || p_name AS joined,
  split_part(p_type || '|' || p_name, '|', 1) AS head
FROM s
""",
)
def q_text_functions(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    csv = F.concat_ws("", F.col("p_brand"), F.lit(", "), F.col("p_type"), F.lit(",, "), F.col("p_name"), F.lit(" ,"))
    parts = fx.split_list(csv)
    head, _ = fx.split_first(fx.join_pair("p_type", "p_name"))
    slug_src = F.concat_ws(" ", F.col("p_name"), F.lit("--"), F.col("p_brand"), F.col("p_type"), F.col("p_type"), F.col("p_type"))
    return p.select(
        "p_partkey",
        fx.branch_slug(slug_src).alias("slug"),
        fx.metric_label(F.concat_ws("_", "p_type", "p_brand")).alias("label"),
        F.array_join(parts, "|").alias("parts"),
        F.size(parts).cast("int").alias("n_parts"),
        fx.full_match(F.col("p_brand"), "Brand#[0-9]+").alias("brand_ok"),
        fx.join_pair("p_type", "p_name").alias("joined"),
        head.alias("head"),
    )


@register(
    "document_line_filter",
    """
SELECT doc_id,
  sha256(regexp_replace(text, '[^\\n]*(?:[Ll][Ii][Cc][Ee][Nn][Ss][Ee])[^\\n]*\\n?', '', 'g')) AS cleaned_sha256,
  CAST(length(regexp_replace(text, '[^\\n]*(?:[Ll][Ii][Cc][Ee][Nn][Ss][Ee])[^\\n]*\\n?', '', 'g')) AS BIGINT) AS cleaned_chars,
  CAST(length(text) AS BIGINT) AS raw_chars
FROM documents
""",
)
def q_document_line_filter(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    cleaned = drop_matching_lines(F.col("text"), "[Ll][Ii][Cc][Ee][Nn][Ss][Ee]")
    return d.select(
        "doc_id",
        F.sha2(cleaned, 256).alias("cleaned_sha256"),
        F.length(cleaned).cast("bigint").alias("cleaned_chars"),
        F.length("text").cast("bigint").alias("raw_chars"),
    )


@register(
    "json_props",
    """
SELECT event_id,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  to_json({'event_type': event_type, 'k': CAST(json_extract_string(props, '$.k') AS BIGINT)})::VARCHAR AS packed
FROM events
""",
)
def q_json_props(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    parsed = F.from_json("props", "k bigint")
    return e.select(
        "event_id",
        parsed["k"].alias("k"),
        F.to_json(F.struct(F.col("event_type").alias("event_type"), parsed["k"].alias("k"))).alias("packed"),
    )


# ====================================================================
# S9 / A5 / J3 / M10 catalog inventory of the test tables
# ====================================================================
@register(
    "catalog_inventory",
    """
SELECT t.table_schema, t.table_name, CAST(count(c.column_name) AS BIGINT) AS column_count
FROM information_schema.tables AS t
LEFT JOIN information_schema.columns AS c
  ON t.table_catalog = c.table_catalog AND t.table_schema = c.table_schema AND t.table_name = c.table_name
WHERE t.table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
                       'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')
GROUP BY ALL
""",
)
def q_catalog_inventory(spark, sf_dir):
    from tablework.sources.catalog import catalog_inventory

    for name in td.TABLES:  # S8: the test tables as named views (reads reused)
        td.table(spark, sf_dir, name).createOrReplaceTempView(name)
    inv = catalog_inventory(spark, td.TABLES)
    return inv.select("table_schema", "table_name", "column_count")
