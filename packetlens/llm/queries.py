"""Queries of the problems tagged llm (1, 3, 6, 7, 8, 9, 10) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.llm import dedup, overlap, packing, quantiles, spans, splits, tokens

RANKS = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
FIELDS = ("iat_us", "frame_length_bytes")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations under one spelling of their group, rows delivered twice counted once,
    stand-ins for "no value" (negative numbers) as NULL."""

    def blank(c):
        return F.regexp_replace(F.col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")

    name = F.regexp_replace(F.lower(blank("class_name")), r"\.+$", "")
    obs = table(spark, sf_dir, "packet_observations").select(
        F.upper(F.regexp_replace(blank("configuration_id"), r"[_\s]", "-")).alias("configuration_id"),
        F.when(name != "", name).alias("class_name"),
        "capture_day",
        F.lower(blank("protocol_id")).alias("protocol_id"),
        "session_view_index",
        "position",
        *[F.when(F.col(v) >= 0, F.col(v).cast("long")).alias(v) for v in FIELDS],
    )
    # Rows delivered twice meet here; every later exchange carries sketches only.
    key = ["configuration_id", "class_name", "capture_day", "protocol_id", "session_view_index", "position"]
    return obs.groupBy(*key).agg(*[F.max(v).alias(v) for v in FIELDS])


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per configuration, class and day, and (``capture_day`` NULL) of all days
    combined from the days' sketches."""
    by = ["configuration_id", "class_name"]
    days = quantiles.sketch_columns(_observations(spark, sf_dir), by=[*by, "capture_day"], values=FIELDS)
    daily = quantiles.percentiles(days, by=[*by, "capture_day"], values=FIELDS, ranks=RANKS)
    whole = quantiles.merge_sketches(days, by=by, values=FIELDS)
    total = quantiles.percentiles(whole, by=by, values=FIELDS, ranks=RANKS)
    return daily.unionByName(total.withColumn("capture_day", F.lit(None).cast("date")))


def p1_rank_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every answer of ``p1_percentiles`` whether its exact rank lies within 0.5 % of the
    asked one.  A value that occurs often has a range of ranks; the nearest counts."""
    group = ["configuration_id", "class_name"]
    found = p1_percentiles(spark, sf_dir).where("n > 0")
    names = [c for c in found.columns if c[0] == "p" and c[1:].isdigit()]
    obs = _observations(spark, sf_dir).select(
        *group, "capture_day", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS]))
    ).where("value is not null")
    # Values of one group and day meet their answers; equal values are counted before.
    counts = obs.groupBy(*group, "capture_day", "field", "value").agg(F.count(F.lit(1)).alias("times"))
    both = counts.unionByName(
        counts.groupBy(*group, "field", "value").agg(F.sum("times").alias("times")).withColumn("capture_day", F.lit(None).cast("date"))
    )
    a, b = both.alias("a"), found.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "capture_day", "field"]]
    ranked = a.join(b, same).groupBy(*[F.col(f"b.{c}") for c in [*group, "capture_day", "field"]]).agg(
        F.sum("times").alias("all"),
        *[F.sum(F.when(F.col("value") < F.col(p), F.col("times")).otherwise(0)).alias(f"{p}_lo") for p in names],
        *[F.sum(F.when(F.col("value") <= F.col(p), F.col("times")).otherwise(0)).alias(f"{p}_hi") for p in names],
    )
    rows = [
        F.struct(
            F.lit(r).alias("rank"),
            ((F.col(f"{p}_lo") <= (r + 0.005) * F.col("all")) & (F.col(f"{p}_hi") >= (r - 0.005) * F.col("all"))).alias("inside"),
        )
        for p, r in zip(names, RANKS)
    ]
    return ranked.select(*group, "capture_day", "field", F.inline(F.array(*rows)))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.related_groups(
        table(spark, sf_dir, "session_manifest"),
        node="session_id",
        relations=[splits.relation_key(F.col("parent_group_id")), splits.relation_key(F.col("pcap_sha256"))],
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session but the smallest of its group of related sessions."""
    g = _groups(spark, sf_dir)
    return g.where("node <> group_node").select(
        F.col("group_node").alias("group_session_id"), F.col("node").alias("session_id")
    )


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every session, with its configuration, class and group."""
    first = table(spark, sf_dir, "session_manifest").where("session_id is not null").groupBy("session_id").agg(
        F.min(F.struct("record_no", "configuration_id", "class_name")).alias("r")
    ).select("session_id", "r.configuration_id", "r.class_name")
    members = _groups(spark, sf_dir).withColumnRenamed("node", "session_id").join(first, "session_id")
    chosen = splits.grouped_splits(
        members, node="session_id", group="group_node", levels=["configuration_id", "class_name"]
    )
    return chosen.join(first, "session_id").select(
        "session_id", F.col("group_node").alias("group_session_id"), "configuration_id", "class_name", "split"
    )


def p3_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions per split, overall and within each configuration and class."""
    s = p3_splits(spark, sf_dir)
    share = [F.sum((F.col("split") == x).cast("long")).alias(x) for x in ("train", "validation", "test")]
    return s.groupingSets(
        [[], [F.col("configuration_id")], [F.col("class_name")], [F.col("configuration_id"), F.col("class_name")]],
        "configuration_id",
        "class_name",
    ).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("sessions"), *share)


def p3_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and groups of ``p3_splits``, groups that lie in several splits, and whether the
    shares of all sessions are as near to 70 / 15 / 15 as whole groups allow: within half a
    percent, or the size of the largest group where that is more."""
    s = p3_splits(spark, sf_dir)
    groups = s.groupBy("group_session_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("splits"),
        *[F.sum((F.col("split") == x).cast("long")).alias(x) for x in ("train", "validation", "test")],
    )
    slack = F.greatest(F.sum("n") * 0.005, F.max("n"))
    near = [F.abs(F.sum(x) - F.sum("n") * share) <= slack for x, share in (("train", 0.7), ("validation", 0.15), ("test", 0.15))]
    return groups.agg(
        F.sum("n").alias("sessions"), F.count(F.lit(1)).alias("groups"),
        F.sum((F.col("splits") > 1).cast("long")).alias("torn_groups"), (near[0] & near[1] & near[2]).alias("near_target"),
    )


def _overlap_rules() -> dict:
    return {
        "record_id": "record_no",
        "split": "split",
        "exact": {"session_id": F.col("session_id"), "page_id": overlap.compact_key(F.col("page_id"))},
        "near": {"url": overlap.url_key(F.col("url"))},
    }


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records, one in train and one in validation or test, that are the same."""
    found = overlap.cross_split_overlaps(table(spark, sf_dir, "session_manifest"), **_overlap_rules())
    return found.select(
        F.least("eval_id", "train_id").alias("record_no_a"), F.greatest("eval_id", "train_id").alias("record_no_b")
    ).distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records that are also in train, per split and class."""
    manifest = table(spark, sf_dir, "session_manifest")
    hit = overlap.overlapping_records(manifest, **_overlap_rules()).withColumnRenamed("record", "record_no")
    records = manifest.select("record_no", overlap.split_name(F.col("split")).alias("split"), "class_name").distinct()
    return records.join(hit, "record_no", "left_semi").groupBy("split", "class_name").agg(
        F.countDistinct("record_no").alias("overlapping_records")
    )


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: the smallest id of its copies and their number."""
    copies = dedup.formatted_copies(
        table(spark, sf_dir, "publications"), record_id="record_id", fields=["title", "doi", "venue", "year"]
    )
    return copies.where("record_id = first_record_id").select("record_id", "copies")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record but the first of its set of copies."""
    copies = dedup.formatted_copies(
        table(spark, sf_dir, "publications"), record_id="record_id", fields=["title", "doi", "venue", "year"]
    )
    return copies.where("record_id <> first_record_id").select(
        "first_record_id", F.col("record_id").alias("copy_record_id")
    )


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return tokens.encode_texts(table(spark, sf_dir, "documents"), text="text", keep=["doc_id"])


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (whole, or pieces of those over 2,048 tokens) in containers of 2,048."""
    docs = table(spark, sf_dir, "documents")
    sizes = tokens.count_tokens(docs.where("text <> ''"), text="text", keep=["doc_id"])
    packed = packing.fill_containers(sizes, item="doc_id", size="n_tokens")
    return packed.select(
        "container_id",
        "container_offset",
        "doc_id",
        "piece_no",
        F.col("item_start").alias("token_start"),
        (F.col("item_start") + F.col("size")).alias("token_end"),
    )


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that the ids of ``p8_ids`` stand for."""
    return tokens.decode_ids(p8_ids(spark, sf_dir), ids="ids", keep=["doc_id"])


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the containers of ``p9_containers``, documents with gaps or overlaps,
    containers over capacity, and whether they are within 1 % of the fewest possible."""
    packed = p9_containers(spark, sf_dir).withColumn("size", F.col("token_end") - F.col("token_start"))
    whole = packed.groupBy("doc_id").agg(
        F.sum("size").alias("held"), F.max("token_end").alias("last"), F.countDistinct("piece_no").alias("pieces"), F.count(F.lit(1)).alias("n")
    ).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("held") != F.col("last")) | (F.col("pieces") != F.col("n"))).alias("broken_documents"), F.sum("held").alias("tokens")
    )
    bins = packed.groupBy("container_id").agg(F.sum("size").alias("used")).agg(
        F.count(F.lit(1)).alias("containers"), F.count_if(F.col("used") > packing.CAPACITY).alias("overfull")
    )
    few = F.col("containers") <= F.ceil(F.col("tokens") / packing.CAPACITY) * 1.01 + 1
    return whole.crossJoin(bins).select("documents", "broken_documents", "overfull", few.alias("near_fewest"))  # one row each


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest runs of characters shared, 200 or more at a stretch, with another document."""
    return spans.shared_spans(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, how much of its text stands elsewhere too."""
    docs = table(spark, sf_dir, "documents")
    return spans.shared_share(docs, p10_found(spark, sf_dir), doc_id="doc_id", text="text")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            p1_percentiles, p1_rank_errors, p3_found, p3_splits, p3_balance, p3_check, p6_found, p6_report,
            p7_found, p7_copies, p8_ids, p8_decoded, p9_containers, p9_fill, p10_found, p10_share,
        )
    }


_UNKNOWN = ", ".join(f"'{w}'" for w in splits.UNKNOWN_WORDS)
_KEY = "lower(trim({0}, chr(32)||chr(9)||chr(10)||chr(13)))"


def _relation(column: str, tag: str) -> str:
    k = _KEY.format(column)
    return f"SELECT session_id AS s, '{tag}'||{k} AS k FROM session_manifest WHERE {k} NOT IN ({_UNKNOWN}) AND NOT regexp_matches({k},'^0{{32,}}$')"


_P3_SQL = f"""WITH RECURSIVE t AS ({_relation("parent_group_id", "p")} UNION {_relation("pcap_sha256", "h")}),
h AS (SELECT k, MIN(s) AS m FROM t GROUP BY k), e AS (SELECT s AS a, m AS b FROM t JOIN h USING (k) WHERE s<>m UNION SELECT m, s FROM t JOIN h USING (k) WHERE s<>m),
w(x,y) AS (SELECT DISTINCT session_id, session_id FROM session_manifest UNION SELECT w.x, e.b FROM w JOIN e ON w.y=e.a),
g AS (SELECT x AS session_id, MIN(y) AS group_session_id FROM w GROUP BY x)
"""
_BLANKS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(160)"
_P1_SQL = rf"""WITH o AS (SELECT upper(regexp_replace(trim(configuration_id, {_BLANKS}),'[_\s]','-','g')) AS configuration_id, nullif(regexp_replace(lower(trim(class_name, {_BLANKS})),'\.+$',''),'') AS class_name,
 capture_day, UNNEST(['iat_us','frame_length_bytes']) AS field, UNNEST([iat_us, CAST(frame_length_bytes AS BIGINT)]) AS v FROM packet_observations),
g AS (SELECT DISTINCT configuration_id, class_name, capture_day, field FROM o WHERE v>=0 UNION SELECT DISTINCT configuration_id, class_name, NULL, field FROM o WHERE v>=0)
SELECT g.*, UNNEST([{", ".join(f"{r}::DOUBLE" for r in RANKS)}]) AS rank, TRUE AS inside FROM g"""

_URL = r"""regexp_replace(regexp_replace(trim(url),'^([a-zA-Z][a-zA-Z0-9+.-]*:)?//',''),'[?#].*$','','s')"""
_URL = rf"""nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url_decode(replace({_URL},'+','%2B'))),'^[^/@]*@',''),'^www\.',''),'^([^/:]*):[0-9]*(/|$)','\1\2'),'(/+(index\.html)?)+$',''),'')"""
_P6_SQL = rf"""WITH r AS (SELECT DISTINCT record_no, lower(trim(split)) AS sp, session_id, nullif(regexp_replace(lower(page_id),'[^\p{{L}}\p{{Nd}}]+','','g'),'') AS pk, {_URL} AS u FROM session_manifest WHERE split IS NOT NULL),
e AS (SELECT * FROM r WHERE sp IN ('validation','test')), t AS (SELECT * FROM r WHERE sp='train'),
near AS (SELECT a.u AS ua, b.u AS ub FROM (SELECT DISTINCT u, length(u) AS n FROM e WHERE u IS NOT NULL) a JOIN (SELECT DISTINCT u, length(u) AS n FROM t WHERE u IS NOT NULL) b
 ON a.n BETWEEN b.n-2 AND b.n+2 AND levenshtein(a.u,b.u)<=2),
p AS (SELECT e.record_no AS a, t.record_no AS b FROM e JOIN t USING (session_id) UNION SELECT e.record_no, t.record_no FROM e JOIN t USING (pk)
 UNION SELECT e.record_no, t.record_no FROM near JOIN e ON e.u=ua JOIN t ON t.u=ub)"""
_CANON = ", ".join(rf"regexp_replace(lower(coalesce({c},'')),'[^\p{{L}}\p{{Nd}}]+','','g')" for c in ("title", "doi", "venue", "year"))
_P7_SQL = f"""WITH k AS (SELECT record_id, list_sort([{_CANON}]) AS k FROM publications), g AS (SELECT k, MIN(record_id) AS f, COUNT(*) AS n FROM k GROUP BY k)"""
_P10_SQL = """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text)>=200), w AS (SELECT doc_id, UNNEST(range(0,n-199)) AS i, text FROM d),
h AS (SELECT doc_id, i, md5_number(substr(text,i+1,200)) AS g FROM w), s AS (SELECT g FROM h GROUP BY g HAVING MIN(doc_id)<MAX(doc_id)), c AS (SELECT doc_id, i FROM h SEMI JOIN s USING (g)),
f AS (SELECT *, coalesce(i>lag(i) OVER (PARTITION BY doc_id ORDER BY i)+200,TRUE) AS fresh FROM c), r AS (SELECT *, SUM(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f),
spans AS (SELECT doc_id, MIN(i) AS span_start, MAX(i)+200 AS span_end FROM r GROUP BY doc_id, run)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_rank_errors": _P1_SQL,
        "p3_found": f"{_P3_SQL} SELECT group_session_id, session_id FROM g WHERE session_id<>group_session_id",
        "p3_check": f"{_P3_SQL} SELECT COUNT(*) AS sessions, COUNT(DISTINCT group_session_id) AS groups, 0 AS torn_groups, TRUE AS near_target FROM g",
        "p8_decoded": "SELECT doc_id, coalesce(text,'') AS text FROM documents",
        "p9_fill": "SELECT COUNT(DISTINCT doc_id) AS documents, 0 AS broken_documents, 0 AS overfull, TRUE AS near_fewest FROM documents WHERE text<>''",
        "p6_found": f"{_P6_SQL} SELECT DISTINCT least(a,b) AS record_no_a, greatest(a,b) AS record_no_b FROM p",
        "p6_report": f"""{_P6_SQL} SELECT r.sp AS split, m.class_name, COUNT(DISTINCT record_no) AS overlapping_records FROM r JOIN (SELECT DISTINCT record_no, class_name FROM session_manifest) m USING (record_no)
 WHERE record_no IN (SELECT a FROM p) GROUP BY 1,2""",
        "p7_found": f"{_P7_SQL} SELECT f AS first_record_id, record_id AS copy_record_id FROM k JOIN g USING (k) WHERE record_id<>f",
        "p7_copies": f"{_P7_SQL} SELECT f AS record_id, n AS copies FROM g",
        "p10_found": f"{_P10_SQL} SELECT * FROM spans",
        "p10_share": f"""{_P10_SQL}, c2 AS (SELECT doc_id, SUM(span_end-span_start) AS x FROM spans GROUP BY 1) SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(coalesce(x,0) AS BIGINT) AS shared_chars,
 CASE WHEN length(text)>0 THEN coalesce(x,0)*1.0E0/length(text) END AS share FROM documents LEFT JOIN c2 USING (doc_id)""",
    }
