"""Release verification over the manifest and the coding tables, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.functions import text as T
from packetlens.operators import verification as V
from packetlens.operators.checks import Check, report
from packetlens.operators.components import token_components
from packetlens.plans.observations import table

ATTRIBUTES = ("campaign", "os", "browser", "network")
CELL = ("configuration_id", "class_name")


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted records once each, with known parents and digests, cell in one spelling."""
    m = table(spark, sf_dir, "session_manifest").where("status = 'accepted'")
    return m.select(
        "record_no", "session_id", T.relation_key(F.col("parent_group_id")).alias("parent"), T.relation_key(F.col("pcap_sha256")).alias("digest"),
        F.upper(F.trim("configuration_id")).alias("configuration_id"), F.lower(F.trim("class_name")).alias("class_name"),
        F.lower(F.trim("split")).alias("split"), *[F.lower(F.trim(a)).alias(a) for a in ("os", "browser", "network", "campaign")], "page_id",
    ).distinct()


def split_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the shipped split breaks; the parent is the declared leakage group."""
    m = _accepted(spark, sf_dir).withColumn("leakage_group_id", F.col("parent"))
    return V.split_violations(m, parent="parent", digest="digest", cell=CELL, split="split", leakage="leakage_group_id")


def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_violations(spark, sf_dir).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings of sessions to captured bytes: one-sided, and used more than once."""
    return V.manifest_violations(_accepted(spark, sf_dir), path="digest", digest="parent", session="session_id")


def component_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leakage components that lie in more than one cell, with their numbers."""
    m = _accepted(spark, sf_dir)
    comp = token_components(m, node="session_id", tokens=[F.col("parent"), F.col("digest")])
    cells = m.select("session_id", *CELL).distinct().join(comp, F.col("session_id") == F.col("node"))
    per = cells.groupBy("component", *CELL).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("component").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("members")).where("cells > 1")


def schedule_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose attributes are not those of their configuration; the configuration's are
    the most frequent ones, the smaller on ties."""
    m = _accepted(spark, sf_dir)
    counts = m.groupBy("configuration_id", *ATTRIBUTES).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("configuration_id").agg(F.min(F.struct((-F.col("n")).alias("n"), *ATTRIBUTES)).alias("b"))
    declared = best.select("configuration_id", *[F.col(f"b.{a}").alias(a) for a in ATTRIBUTES])
    return V.attribute_conflicts(m, declared, key="configuration_id", attributes=ATTRIBUTES)


def schedule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that every configuration and class declares (all delivered) against those accepted."""
    m = table(spark, sf_dir, "session_manifest").select("record_no", F.upper(F.trim("configuration_id")).alias("configuration_id"), F.lower(F.trim("class_name")).alias("class_name"), "status")
    m = m.where("configuration_id is not null and class_name is not null").distinct()

    def count(df):
        return df.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))

    return V.declared_against_observed(count(m), count(m.where("status = 'accepted'")), keys=CELL, count="n")


_FKS = (
    ("evaluation_designs", "paper_id", "publications", "record_id", False), ("evaluation_designs", "dataset_ids", "canonical_datasets", "dataset_id", True),
    ("evaluation_designs", "scheme_ids", "class_schemes", "scheme_id", True), ("evidence", "paper_id", "publications", "record_id", False),
    ("evidence", "design_id", "evaluation_designs", "design_id", False), ("evidence", "scheme_id", "class_schemes", "scheme_id", False),
    ("evidence", "dataset_id", "canonical_datasets", "dataset_id", False), ("class_schemes", "dataset_id", "canonical_datasets", "dataset_id", False),
    ("rq2_paper_summary", "paper_id", "publications", "record_id", False),
)
_KEYS = (
    ("publications", "record_id"), ("evaluation_designs", "design_id"), ("evidence", "evidence_id"), ("class_schemes", "scheme_id"),
    ("canonical_datasets", "dataset_id"), ("rq2_paper_summary", "rq2_paper_summary_id"), ("structural_corrections", "normalization_id"),
)
_ROWS = (
    ("rq2_paper_summary", "outcome_enum", "outcome is null or outcome not in ('documented_holdout','documented_no_holdout','not_documented')"),
    ("rq2_paper_summary", "count_not_negative", "evaluation_count < 0"),
    ("rq2_paper_summary", "holdout_has_designs", "outcome = 'documented_holdout' and coalesce(trim(holdout_design_ids),'') = ''"),
    ("evaluation_designs", "eligibility_enum", "eligibility_status is null or eligibility_status not in ('eligible','excluded')"),
    ("evaluation_designs", "split_unit_given", "split_unit is null"),
    ("evidence", "dimension_given", "dimension is null"),
    ("class_schemes", "cardinality_positive", "class_cardinality is null or class_cardinality < 1"),
    ("evidence", "withdrawn_after_recorded", "withdrawn_at < recorded_at"),
)


def corpus_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, references and row rules of the coding tables: ``check, passed, observed, expected``.
    A row delivered twice counts once; a reference is counted once per distinct id."""

    def rows(name):
        t = table(spark, sf_dir, name)
        return t.drop("loaded_at").distinct() if "loaded_at" in t.columns else t

    checks = [Check(f"{t}.{k}.key", rows(t).groupBy(k).agg(F.count(F.lit(1)).alias("n")).where("n > 1")) for t, k in _KEYS]
    for t, c, target, key, listed in _FKS:
        values = T.split_ids(F.col(c)) if listed else F.array(F.trim(c))
        ids = table(spark, sf_dir, t).select(F.explode(values).alias("v")).select(F.upper("v").alias("k"))
        there = table(spark, sf_dir, target).select(F.upper(F.trim(key)).alias("k"))
        checks.append(Check(f"{t}.{c}.reference", ids.where("k <> ''").distinct().join(there, "k", "left_anti")))
    checks += [Check(f"{t}.{n}", rows(t).where(cond)) for t, n, cond in _ROWS]
    return report(spark, checks)


QUERIES = {
    f.__name__: f
    for f in (split_violations, split_report, manifest_violations, component_purity, schedule_conflicts, schedule_coverage, corpus_checks)
}

_UNKNOWN = ", ".join(f"'{w}'" for w in T.UNKNOWN_WORDS)


def _known(c: str) -> str:
    k = f"lower(trim({c}))"
    return f"CASE WHEN {k} NOT IN ({_UNKNOWN}) AND NOT regexp_matches({k},'^0{{32,}}$') THEN {k} END"


_ACC = f"""ac AS (SELECT DISTINCT record_no, session_id, {_known('parent_group_id')} AS parent, {_known('pcap_sha256')} AS digest, upper(trim(configuration_id)) AS configuration_id, lower(trim(class_name)) AS class_name,
 lower(trim(split)) AS split, lower(trim(os)) AS os, lower(trim(browser)) AS browser, lower(trim(network)) AS network, lower(trim(campaign)) AS campaign, page_id FROM session_manifest WHERE status='accepted')"""


def _several_sql(rule: str, key: str, over: str) -> str:
    return f"SELECT '{rule}' AS rule, {key} AS subject, CAST(COUNT(*) AS VARCHAR) AS observed FROM (SELECT DISTINCT {key}, {over} FROM ac WHERE {key} IS NOT NULL) GROUP BY {key} HAVING COUNT(*)>1"


_WHERE = "configuration_id, class_name, split"
_SPLIT_SQL = f"""WITH {_ACC}, vi AS (SELECT DISTINCT 'invalid_split' AS rule, coalesce(split,'') AS subject, '1' AS observed FROM ac WHERE split IS NULL OR split NOT IN ('train','validation','test')
 UNION ALL {_several_sql('parent_crosses', 'parent', _WHERE)} UNION ALL {_several_sql('content_crosses', 'digest', _WHERE)} UNION ALL {_several_sql('leakage_crosses', 'parent', _WHERE)}
 UNION ALL SELECT 'leakage_missing', '', CAST(COUNT(*) AS VARCHAR) FROM ac WHERE parent IS NULL HAVING COUNT(*)>0 UNION ALL {_several_sql('leakage_torn', 'digest', 'parent')}
 UNION ALL SELECT 'quota', coalesce(configuration_id,'')||'/'||coalesce(class_name,''), tr||' '||va||' '||te FROM (SELECT configuration_id, class_name, COUNT(*) AS n, COUNT(*) FILTER (WHERE split='train') AS tr,
 COUNT(*) FILTER (WHERE split='validation') AS va, COUNT(*) FILTER (WHERE split='test') AS te FROM ac GROUP BY ALL) WHERE va<>n*15//100 OR te<>n*15//100 OR tr<>n-2*(n*15//100))"""
_CORPUS_SQL = " UNION ALL ".join(
    [f"SELECT '{t}.{k}.key' AS \"check\", COUNT(*) AS observed FROM (SELECT {k} FROM (SELECT DISTINCT * EXCLUDE ({x}) FROM {t}) GROUP BY 1 HAVING COUNT(*)>1)"
     for t, k, x in ((t, k, "loaded_at") if t not in ("class_schemes", "canonical_datasets") else (t, k, "recorded_at") for t, k in _KEYS)]
    + [f"SELECT '{t}.{c}.reference', COUNT(*) FROM (SELECT DISTINCT upper(trim({f'UNNEST(string_split({c},' + chr(39) + '|' + chr(39) + '))' if listed else c})) AS k FROM {t}) WHERE k<>'' AND k NOT IN (SELECT upper(trim({key})) FROM {target})"
       for t, c, target, key, listed in _FKS]
    + [f"SELECT '{t}.{n}', COUNT(*) FROM (SELECT DISTINCT * EXCLUDE ({'loaded_at' if t != 'class_schemes' else 'recorded_at'}) FROM {t}) WHERE {cond}" if "recorded_at" not in cond else
       f"SELECT '{t}.{n}', COUNT(*) FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM {t}) WHERE {cond}" for t, n, cond in _ROWS]
)
ORACLE = {
    "split_violations": f"{_SPLIT_SQL} SELECT rule, subject, observed FROM vi",
    "split_report": f"{_SPLIT_SQL} SELECT rule, COUNT(*) AS violations FROM vi GROUP BY 1",
    "manifest_violations": f"""WITH {_ACC} SELECT 'partial_binding' AS rule, coalesce(digest, parent) AS subject, CAST(COUNT(*) AS VARCHAR) AS observed FROM ac WHERE (digest IS NULL)<>(parent IS NULL) GROUP BY 2
 UNION ALL SELECT 'duplicate_path', digest, CAST(COUNT(*) AS VARCHAR) FROM ac WHERE digest IS NOT NULL AND parent IS NOT NULL GROUP BY digest HAVING COUNT(*)>1
 UNION ALL SELECT 'duplicate_session', session_id, CAST(COUNT(*) AS VARCHAR) FROM ac WHERE digest IS NOT NULL AND parent IS NOT NULL AND session_id IS NOT NULL GROUP BY session_id HAVING COUNT(*)>1""",
    "component_purity": f"""WITH RECURSIVE {_ACC}, t AS (SELECT session_id AS s, 'p'||parent AS k FROM ac WHERE parent IS NOT NULL UNION SELECT session_id, 'd'||digest FROM ac WHERE digest IS NOT NULL),
 h AS (SELECT k, MIN(s) AS m FROM t GROUP BY k), e AS (SELECT s AS a, m AS b FROM t JOIN h USING (k) WHERE s<>m UNION SELECT m, s FROM t JOIN h USING (k) WHERE s<>m),
 w(x,y) AS (SELECT DISTINCT session_id, session_id FROM ac UNION SELECT w.x, e.b FROM w JOIN e ON w.y=e.a), g AS (SELECT x AS session_id, MIN(y) AS component FROM w GROUP BY x),
 c AS (SELECT component, configuration_id, class_name, COUNT(*) AS n FROM (SELECT DISTINCT session_id, configuration_id, class_name FROM ac) JOIN g USING (session_id) GROUP BY ALL)
 SELECT component, COUNT(*) AS cells, CAST(SUM(n) AS BIGINT) AS members FROM c GROUP BY 1 HAVING COUNT(*)>1""",
    "schedule_conflicts": f"""WITH {_ACC}, n AS (SELECT configuration_id, campaign, os, browser, network, COUNT(*) AS n FROM ac GROUP BY ALL),
 b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY configuration_id ORDER BY n DESC, campaign NULLS FIRST, os NULLS FIRST, browser NULLS FIRST, network NULLS FIRST)=1)
 {" UNION ALL ".join(f"SELECT configuration_id, '{a}' AS attribute, n.{a} AS stated, b.{a} AS declared, CAST(SUM(n.n) AS BIGINT) AS rows FROM n LEFT JOIN b USING (configuration_id) WHERE n.{a} IS DISTINCT FROM b.{a} GROUP BY ALL" for a in ATTRIBUTES)}""",
    "schedule_coverage": """WITH m AS (SELECT DISTINCT record_no, upper(trim(configuration_id)) AS configuration_id, lower(trim(class_name)) AS class_name, status FROM session_manifest WHERE configuration_id IS NOT NULL AND class_name IS NOT NULL),
 c AS (SELECT configuration_id, class_name, COUNT(*) AS declared, nullif(COUNT(*) FILTER (WHERE status='accepted'),0) AS observed FROM m GROUP BY ALL)
 SELECT *, CASE WHEN observed IS NULL THEN 'unobserved' WHEN declared=observed THEN 'equal' ELSE 'different' END AS state FROM c""",
    "corpus_checks": f"WITH c AS ({_CORPUS_SQL}) SELECT \"check\", observed=0 AS passed, observed, CAST(0 AS BIGINT) AS expected FROM c",
}
