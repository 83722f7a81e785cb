"""Relational audit queries over publications, coding tables and manifests, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlens.functions import text as T
from packetlens.operators import relational as R
from packetlens.operators import rollups
from packetlens.operators.components import token_components
from packetlens.plans.observations import table

#: fixed values: patterns of the grouped title-and-abstract route
TRAFFIC_PATTERNS = (
    r"\bnetwork traffic\b", r"\binternet traffic\b", r"\bencrypted traffic\b", r"\btraffic analys(?:is|es)\b",
    r"\btraffic classif", r"\btraffic detect", r"\btraffic fingerprint", r"\bpacket(?:s| level| trace| metadata| length)?\b",
    r"\bpcap\b", r"\bnetflow\b", r"\bnetwork flow(?:s)?\b", r"\bflow based\b", r"\bflow level\b", r"\btraffic trace(?:s)?\b",
    r"\bnetwork session(?:s)?\b", r"\bwebsite fingerprint", r"\bwebpage fingerprint", r"\bapp(?:lication)? fingerprint",
    r"\bdevice fingerprint", r"\bnetwork intrusion\b", r"\bnetwork anomaly\b", r"\bmalicious traffic\b", r"\bmalware traffic\b",
    r"\bbotnet traffic\b", r"\bddos\b", r"\bdenial of service\b", r"\biot traffic\b", r"\bindustrial traffic\b",
    r"\bwireless traffic\b", r"\bcellular traffic\b", r"\btor traffic\b", r"\bvpn traffic\b", r"\btls traffic\b",
    r"\bhttps traffic\b", r"\bquic traffic\b", r"\bdns traffic\b",
)
TASK_PATTERNS = (
    r"\bclassif", r"\bdetect", r"\bidentif", r"\brecogn", r"\binfer", r"\bfingerprint", r"\banomal", r"\bintrusion",
    r"\bmalicious", r"\bmalware", r"\bbotnet", r"\battack", r"\bddos\b",
)
#: fixed values: patterns of the title route
TITLE_TRAFFIC = (
    r"\b(?:ssh|internet|vpn|tor|quic|tls|https?|dns|udp|tcp|wireless|wi-fi|wifi|bluetooth|5g|cellular|ads-b|network request"
    r"|server request|web request|network detection|proxy networks?|network attack|scanning organization|traffic|packet|flow"
    r"|session|pcap|netflow|intrusion|malware|botnet|ddos)\b"
)
TITLE_TASK = (
    r"\b(?:classif\w*|detect\w*|identif\w*|recogn\w*|infer\w*|fingerprint\w*|anomal\w*|intrusion\w*|malicious\w*|malware\w*"
    r"|bot\w*|attack\w*)\b"
)
TITLE_EXCLUDED = r"\btext classification\b"
FAMILIES = ("Networking", "Measurement", "Security and privacy", "Artificial intelligence", "Systems")
DIMENSIONS = ("client", "network", "temporal")


def _pubs(spark, sf_dir):
    return table(spark, sf_dir, "publications")


def _retained(spark, sf_dir):
    return _pubs(spark, sf_dir).where(T.truth(F.col("retained_for_candidate_identification")))


def route_r(pubs: DataFrame) -> DataFrame:
    """Ids whose normalised title and abstract match a traffic and a task pattern."""
    t = T.normalize_text(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))))
    rows = pubs.select("record_id", t.alias("t"))
    return rows.where(F.col("t").rlike("|".join(TRAFFIC_PATTERNS)) & F.col("t").rlike("|".join(TASK_PATTERNS))).select("record_id")


def route_p(pubs: DataFrame) -> DataFrame:
    """Ids whose raw title matches both title patterns and not the exclusion."""
    t = F.col("title")
    return pubs.where(
        t.rlike("(?iU)" + TITLE_TRAFFIC) & t.rlike("(?iU)" + TITLE_TASK) & ~t.rlike("(?iU)" + TITLE_EXCLUDED)
    ).select("record_id")


def route_g(pubs: DataFrame) -> DataFrame:
    """Recorded membership: here the measurement venues."""
    return pubs.where("venue_family = 'Measurement'").select("record_id")


def route_grouped_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_r(_retained(spark, sf_dir))


def route_title_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route_p(_retained(spark, sf_dir))


def _flagged(spark, sf_dir):
    p = _retained(spark, sf_dir)
    routes = {"G": route_g(p), "R": route_r(p), "P": route_p(p)}
    return R.member_flags(p.select("record_id", "venue_family"), key="record_id", routes=routes)


def route_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flagged(spark, sf_dir).where("G or R or P")
    return f.select("record_id", "G", "R", "P", R.membership_label(["G", "R", "P"]).alias("membership"))


def venn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.venn_cells(_flagged(spark, sf_dir), flags=["G", "R", "P"])


_STRIP = (
    r"regexp_replace(regexp_replace(coalesce(title,'')||' '||coalesce(abstract,''),'https?\s*:\s*//[\w./?=&%#~:+-]+',' ','gi'),"
    r"'\bwww\.[\w./?=&%#~:+-]+',' ','gi')"
)
_NORM_SQL = rf"trim(regexp_replace(lower(regexp_replace(strip_accents({_STRIP}),'ﬁ','fi','g')),'[^a-z0-9+.-]+',' ','g'))"
_TRUE = "lower(trim(retained_for_candidate_identification))='true'"
ROUTES_SQL = f"""ret AS (SELECT * FROM publications WHERE {_TRUE}),
rr AS (SELECT record_id FROM (SELECT record_id, {_NORM_SQL} AS t FROM ret) WHERE regexp_matches(t,'{"|".join(TRAFFIC_PATTERNS)}') AND regexp_matches(t,'{"|".join(TASK_PATTERNS)}')),
rp AS (SELECT record_id FROM ret WHERE regexp_matches(title,'{TITLE_TRAFFIC}','i') AND regexp_matches(title,'{TITLE_TASK}','i') AND NOT regexp_matches(title,'{TITLE_EXCLUDED}','i')),
fl AS (SELECT record_id, venue_family='Measurement' AS G, record_id IN (SELECT record_id FROM rr) AS R, record_id IN (SELECT record_id FROM rp) AS P FROM ret),
lb AS (SELECT *, concat_ws(' | ', CASE WHEN G THEN 'G' END, CASE WHEN R THEN 'R' END, CASE WHEN P THEN 'P' END) AS membership FROM fl WHERE G OR R OR P)"""

#: fixed values: patterns of the ordered rules
SIDE_TRACKS = "workshop|soups|cset|woot|foci|bridge|supplement"
SHORT_FORMS = "poster|demo|competition"


def classify_records(df: DataFrame) -> DataFrame:
    """First of eleven ordered rules that a record meets: ``record_id, track, publication_type,
    retained, code``.  ``df`` has ``record_id, title, toc, label, types`` (letter case does not
    matter), ``venue`` (canonical) and ``year``; missing texts count as empty.  The clause that
    names a venue binds closer than the alternative before it."""
    title, toc, label, types = (F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("title", "toc", "label", "types"))
    main = F.coalesce(toc == T.main_toc(F.col("venue"), F.col("year")), F.lit(False))
    named = F.coalesce(F.nullif("label", F.lit("")), "toc")
    journal = F.coalesce(F.nullif(label, F.lit("")), toc)

    def at(venue: str) -> Column:
        return F.coalesce(F.col("venue") == venue, F.lit(False))

    def among(pattern: str, *parts: Column) -> Column:
        return F.concat_ws(" ", *parts).rlike(pattern)

    rules = (
        (types.contains("editorship"), F.lit("Proceedings metadata record"), "Proceedings container", "E01"),
        (at("PETS/PoPETs") & main & types.contains("article"), F.lit("PoPETs full research paper presented at PETS"), "Full research paper PoPETs article", "R01"),
        (types.contains("article"), journal, "Journal article cross-listed in conference stream", "E01"),
        (among(SIDE_TRACKS, label, toc), named, "Non-main or associated track", "E01"),
        (label.contains("companion") | toc.rlike(r"www\d{4}c$"), named, "Companion paper", "E01"),
        (among(SHORT_FORMS, label, toc, title), named, "Poster demo or competition item", "E02"),
        (among("abstract", label, title) | (at("SIGMETRICS") & main), named, "Abstract-only publication", "E02"),
        (label.contains("short paper") | toc.rlike("conext2023c$") | (at("CoNEXT") & (F.col("year") >= 2024) & main), named, "Venue-designated short paper", "E02"),
        (at("NeurIPS") & (toc == "neurips2021db"), F.lit("Datasets and Benchmarks full archival special track"), "Full research paper", "R01"),
        (~main, named, "Non-main track", "E01"),
    )

    def outcome(track: Column, kind: str, code: str) -> Column:
        return F.struct(track.alias("track"), F.lit(kind).alias("publication_type"), F.lit(code == "R01").alias("retained"), F.lit(code).alias("code"))

    chain = F
    for met, *rest in rules:
        chain = chain.when(met, outcome(*rest))
    last = outcome(F.lit("Main research proceedings"), "Full-paper status to verify", "R01")
    return df.select("record_id", chain.otherwise(last).alias("c")).select("record_id", "c.*")


def classify_case_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain over all publications.  Streams, table-of-contents keys and record types, which
    the table does not have, are dealt out by the length of the title, so every rule is met."""
    n = F.length(F.coalesce("title", F.lit("")))
    stream = F.concat(F.lit("<https://streams.example/conf/"), F.element_at(F.array(*[F.lit(k) for k in T.VENUES]), n % len(T.VENUES) + 1), F.lit("/>"))
    year = F.coalesce(F.nullif(F.regexp_extract("year", "20[0-9]{2}", 0), F.lit("")).cast("int"), F.lit(2021))
    p = _pubs(spark, sf_dir).select(
        "record_id", "title", F.col("publication_type").alias("label"), T.canonical_venue(stream).alias("venue"), year.alias("year"), n.alias("n"),
    )
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("", "c", "db", "", "w-foci", "")]), F.col("n") % 6 + 1)
    types = F.when(F.col("n") % 11 == 0, "Editorship").when(F.col("n") % 7 == 0, "Article").otherwise("Inproceedings")
    return classify_records(p.withColumn("toc", F.concat(T.main_toc(F.col("venue"), F.col("year")), suffix)).withColumn("types", types))


_CLASSIFY_SQL = f"""WITH b AS (SELECT record_id, lower(coalesce(title,'')) AS title, publication_type AS label_, lower(coalesce(publication_type,'')) AS label, length(coalesce(title,'')) AS n,
 coalesce(CAST(nullif(regexp_extract(year,'20[0-9]{{2}}'),'') AS INTEGER),2021) AS y FROM publications),
c AS (SELECT *, {[v for v, _ in T.VENUES.values()]}[n%16+1] AS venue, {[t for _, t in T.VENUES.values()]}[n%16+1]||y AS expected, ['','c','db','','w-foci',''][n%6+1] AS suf,
 CASE WHEN n%11=0 THEN 'editorship' WHEN n%7=0 THEN 'article' ELSE 'inproceedings' END AS types FROM b),
t AS (SELECT *, expected||suf AS toc, suf='' AS main FROM c),
k AS (SELECT *, CASE WHEN types='editorship' THEN 1 WHEN venue='PETS/PoPETs' AND main AND types='article' THEN 2 WHEN types='article' THEN 3
 WHEN regexp_matches(label||' '||toc,'{SIDE_TRACKS}') THEN 4 WHEN label LIKE '%companion%' OR regexp_matches(toc,'www[0-9]{{4}}c$') THEN 5
 WHEN regexp_matches(label||' '||toc||' '||title,'{SHORT_FORMS}') THEN 6 WHEN label||' '||title LIKE '%abstract%' OR (venue='SIGMETRICS' AND main) THEN 7
 WHEN label LIKE '%short paper%' OR toc LIKE '%conext2023c' OR (venue='CoNEXT' AND y>=2024 AND main) THEN 8 WHEN venue='NeurIPS' AND toc='neurips2021db' THEN 9 WHEN NOT main THEN 10 ELSE 11 END AS r FROM t)
SELECT record_id, CASE r WHEN 1 THEN 'Proceedings metadata record' WHEN 2 THEN 'PoPETs full research paper presented at PETS' WHEN 3 THEN coalesce(nullif(label,''),toc)
 WHEN 9 THEN 'Datasets and Benchmarks full archival special track' WHEN 11 THEN 'Main research proceedings' ELSE coalesce(nullif(label_,''),toc) END AS track,
 ['Proceedings container','Full research paper PoPETs article','Journal article cross-listed in conference stream','Non-main or associated track','Companion paper','Poster demo or competition item',
 'Abstract-only publication','Venue-designated short paper','Full research paper','Non-main track','Full-paper status to verify'][r] AS publication_type,
 r IN (2,9,11) AS retained, ['E01','R01','E01','E01','E01','E02','E02','E02','R01','E01','R01'][r] AS code FROM k"""


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First delivered record of every DOI-or-title key, numbered in order of appearance."""
    p = _pubs(spark, sf_dir).select("loaded_at", "record_id", "title", "doi", "venue", "year")
    key = T.dedup_key(F.col("doi"), F.col("title"), F.col("venue"), F.col("year"))
    out = R.first_wins(p, key=key, order=["loaded_at", "record_id"], number="new_id")
    return out.select("new_id", "record_id", "dedup_key")


_DOI_SQL = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(coalesce(doi,'')),'^<|>$','','g')),'^https?://(?:dx\.)?doi\.org/',''),'\?+$',''))"
_DEDUP_SQL = rf"""WITH k AS (SELECT record_id, loaded_at, CASE WHEN {_DOI_SQL}<>'' THEN 'doi:'||{_DOI_SQL} ELSE
 'title:'||trim(regexp_replace(lower(coalesce(title,'')),'[^a-z0-9]+',' ','g'))||'|venue:'||coalesce(venue,'')||'|year:'||coalesce(year,'') END AS dedup_key FROM publications),
f AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY loaded_at, record_id) AS n FROM k)
SELECT 'P'||lpad(CAST(row_number() OVER (ORDER BY loaded_at, record_id) AS VARCHAR),5,'0') AS new_id, record_id, dedup_key FROM f WHERE n=1"""


def candidate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designs with their publication and evidence, one row per distinct design and evidence."""
    d = table(spark, sf_dir, "evaluation_designs").select("design_id", "paper_id", "task_family").distinct()
    p = _pubs(spark, sf_dir).select("record_id", "venue_family", "year")
    e = table(spark, sf_dir, "evidence").where("design_id is not null").select("evidence_id", "design_id", "confidence").distinct()
    return d.join(p, d["paper_id"] == p["record_id"]).join(e, "design_id").select(
        "design_id", "record_id", "venue_family", "year", "task_family", "evidence_id", "confidence"
    )


def _rq2(spark, sf_dir):
    """Decisions by dimension; a row delivered twice counts once."""
    r = table(spark, sf_dir, "rq2_paper_summary")
    return r.drop("loaded_at").distinct()


def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.outcome_summary(
        _rq2(spark, sf_dir), dimensions=[*DIMENSIONS, "campaign"], outcome="outcome",
        positive="documented_holdout", negative="documented_no_holdout",
    )


def outcome_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each paper over its dimensions: any positive, else any undocumented, else negative."""
    paper = F.upper(F.trim("paper_id"))
    return rollups.precedence_rollup(
        _rq2(spark, sf_dir).withColumn("paper", paper), keys=["paper"], outcome="outcome",
        order=["documented_holdout", "not_documented", "documented_no_holdout"],
    )


def screening_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage counts by subtraction, in order."""
    f = _flagged(spark, sf_dir)
    designs = table(spark, sf_dir, "evaluation_designs").select(F.col("paper_id").alias("record_id")).distinct()
    included = R.member_flags(f, key="record_id", routes={"D": designs})
    c = included.agg(
        F.count(F.lit(1)).alias("retained"), F.sum((F.col("G") | F.col("R") | F.col("P")).cast("long")).alias("candidates"),
        F.sum(((F.col("G") | F.col("R") | F.col("P")) & F.col("D")).cast("long")).alias("included"),
    ).crossJoin(_pubs(spark, sf_dir).agg(F.count(F.lit(1)).alias("records")))
    stages = (
        ("records", F.col("records")), ("not_retained", F.col("records") - F.col("retained")), ("retained", F.col("retained")),
        ("not_candidates", F.col("retained") - F.col("candidates")), ("candidates", F.col("candidates")),
        ("excluded", F.col("candidates") - F.col("included")), ("included", F.col("included")),
    )
    return c.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("stage"), v.cast("long").alias("records"))
        for i, (n, v) in enumerate(stages, 1)
    ])))


def family_summary_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed families, and a total over all rows (not only those of the fixed families)."""
    p = _pubs(spark, sf_dir)
    kept = F.sum(T.truth(F.col("retained_for_candidate_identification")).cast("long"))
    by = p.groupBy("venue_family").agg(F.count(F.lit(1)).alias("records"), kept.alias("retained"))
    fixed = spark.createDataFrame([(f,) for f in FAMILIES], "venue_family string").join(by, "venue_family", "left")
    zero = F.lit(0).cast("long")
    fixed = fixed.select("venue_family", F.coalesce("records", zero).alias("records"), F.coalesce("retained", zero).alias("retained"))
    return fixed.unionByName(p.agg(F.lit("Total").alias("venue_family"), F.count(F.lit(1)).alias("records"), F.coalesce(kept, zero).alias("retained")))


def structural_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row, filtered and distinct counts of the coding tables."""
    d, e, s = (table(spark, sf_dir, t) for t in ("evaluation_designs", "evidence", "class_schemes"))
    counts = (
        d.agg(F.lit("evaluation_designs").alias("item"), F.count(F.lit(1)).alias("rows"), F.countDistinct("design_id").alias("ids"),
              F.sum((F.col("eligibility_status") == "eligible").cast("long")).alias("matching")),
        e.agg(F.lit("evidence"), F.count(F.lit(1)), F.countDistinct("evidence_id"), F.sum((F.col("confidence") == "high").cast("long"))),
        s.agg(F.lit("class_schemes"), F.count(F.lit(1)), F.countDistinct("scheme_id"), F.sum(T.truth(F.col("complete_scheme_in_dataset")).cast("long"))),
    )
    return counts[0].union(counts[1]).union(counts[2])


def list_ids_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "evaluation_designs").select("design_id", "scheme_ids").distinct()
    ids = T.split_ids(F.col("scheme_ids"))
    return d.select("design_id", F.size(ids).cast("long").alias("n"), T.join_ids(ids).alias("joined")).distinct()


def list_fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset and scheme ids in design lists that name no record in force."""
    d = table(spark, sf_dir, "evaluation_designs")
    parts = []
    for column, target, key in (("dataset_ids", "canonical_datasets", "dataset_id"), ("scheme_ids", "class_schemes", "scheme_id")):
        ids = d.select("design_id", F.lit(column).alias("field"), F.explode(T.split_ids(F.col(column))).alias("id")).distinct()
        there = table(spark, sf_dir, target).where("withdrawn_at is null").select(F.col(key).alias("id"))
        parts.append(ids.join(there, "id", "left_anti").select("design_id", "field", "id"))
    return parts[0].unionByName(parts[1])


def _manifest(spark, sf_dir):
    return table(spark, sf_dir, "session_manifest").drop("loaded_at").distinct()


def host_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = T.normalize_host(F.try_parse_url(F.col("url"), F.lit("HOST")))
    return _manifest(spark, sf_dir).where("url is not null").groupBy(host.alias("host")).agg(F.countDistinct("record_no").alias("records"))


def https_url_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _manifest(spark, sf_dir).where("url is not null")
    return m.select("record_no", T.https_url(F.col("url")).alias("valid")).distinct()


_HOST_SQL = r"nullif(regexp_extract(url,'^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)',1),'')"


def allowlist_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First reason to reject a record: too few packets, its session names no host, several
    hosts, a host that is not allowed, or one of another class.  Every class that is the name
    of a host allows that host."""
    m = _manifest(spark, sf_dir)
    host = T.normalize_host(F.regexp_replace(F.try_parse_url(F.col("url"), F.lit("HOST")), r"(?i)^www\.", ""))
    m = m.select("record_no", "session_id", "packet_count", F.lower(F.trim("class_name")).alias("class_name"), host.alias("host"))
    named = m.groupBy("session_id").agg(F.min("host").alias("host"), F.max("host").alias("other"))
    allowed = m.where("class_name like '%.%'").select(F.rtrim("class_name", F.lit(".")).alias("host")).distinct()
    j = m.drop("host").join(named, "session_id").join(allowed.withColumn("annotated_class", F.col("host")), "host", "left")
    reason = (
        F.when(F.col("packet_count") < 10, "below_minimum_session_packets").when(F.col("host").isNull(), "no_sni")
        .when(F.col("host") != F.col("other"), "ambiguous_sni").when(F.col("annotated_class").isNull(), "sni_not_allowlisted")
        .when(~F.rtrim("class_name", F.lit(".")).eqNullSafe(F.col("annotated_class")), "scheduled_class_mismatch").otherwise("")
    )
    return j.select("record_no", reason.alias("rejection_reason"), "annotated_class")


def reject_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce(F.nullif("rejection_reason", F.lit("")), F.lit("accepted"))
    return allowlist_cascade(spark, sf_dir).groupBy(reason.alias("outcome")).agg(F.count(F.lit(1)).alias("sessions"))


_ALLOW_SQL = rf"""m AS (SELECT *, rtrim(lower(trim(class_name)),'.') AS cls FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM session_manifest)),
al AS (SELECT DISTINCT cls AS host FROM m WHERE lower(trim(class_name)) LIKE '%.%'),
h AS (SELECT *, nullif(regexp_replace(regexp_replace(lower({_HOST_SQL}),'^www\.',''),'\.+$',''),'') AS host_ FROM m),
nm AS (SELECT session_id, MIN(host_) AS host_, MAX(host_) AS other FROM h GROUP BY 1),
ac AS (SELECT record_no, CASE WHEN packet_count<10 THEN 'below_minimum_session_packets' WHEN nm.host_ IS NULL THEN 'no_sni' WHEN nm.host_<>other THEN 'ambiguous_sni' WHEN al.host IS NULL THEN 'sni_not_allowlisted'
 WHEN cls IS DISTINCT FROM al.host THEN 'scheduled_class_mismatch' ELSE '' END AS rejection_reason, al.host AS annotated_class FROM m JOIN nm USING (session_id) LEFT JOIN al ON al.host=nm.host_)"""


def attempt_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _manifest(spark, sf_dir)
    return R.attempt_lineage(m, visit="session_id", order=["captured_at", "record_no"], attempt="record_no", status="status")


def digest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each cell in pseudo-random but fixed order, numbered by ranges of that order."""
    m = _manifest(spark, sf_dir).select("session_id", "configuration_id", "class_name").distinct()
    d = T.digest(F.lit("selection-v1"), F.col("configuration_id"), F.col("class_name"), F.col("session_id"))
    n = R.numbered(m.withColumn("digest", d), by=["configuration_id", "class_name"], order=["digest", "session_id"], out="selection_rank")
    return n.drop("digest")


def session_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for every record of a parent capture, from the parent and the record's ordinal in it."""
    m = _manifest(spark, sf_dir).select("record_no", "parent_group_id", "captured_at").where("parent_group_id is not null").distinct()
    m = R.numbered(m, by=["parent_group_id"], order=["captured_at", "record_no"], out="ordinal")
    d = T.digest(F.lit("session-v1"), F.col("parent_group_id"), F.col("ordinal"))
    return m.select("record_no", F.concat(F.lit("session_"), F.substring(d, 1, 24)).alias("token"))


def label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_ids(_manifest(spark, sf_dir), value="class_name", out="label_id")


def leakage_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents tied by record or by identical text: component by smallest document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "record_id", F.sha2("text", 256).alias("digest"))
    return token_components(d, node="doc_id", tokens=[F.col("record_id"), F.col("digest")]).select(
        F.col("node").alias("doc_id"), "component"
    )


def split_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents and digests that stand in more than one split."""
    m = _manifest(spark, sf_dir).where("split is not null").withColumn("split", F.lower(F.trim("split")))
    parts = []
    for kind in ("parent_group_id", "pcap_sha256"):
        k = m.select(T.relation_key(F.col(kind)).alias("value"), "split").where("value is not null").distinct()
        parts.append(k.groupBy("value").agg(F.count(F.lit(1)).alias("splits")).where("splits > 1").select(F.lit(kind).alias("kind"), "value", "splits"))
    return parts[0].unionByName(parts[1])


def uniqueness_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicates(_manifest(spark, sf_dir), keys=["session_id"])


def left_anti_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions outside the test split (all minus held-out)."""
    m = _manifest(spark, sf_dir)
    test = m.where(F.lower(F.trim("split")) == "test").select("session_id")
    return m.select("session_id").distinct().join(test, "session_id", "left_anti")


def semi_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _manifest(spark, sf_dir)
    test = m.where(F.lower(F.trim("split")) == "test").select("session_id")
    return m.select("session_id").distinct().join(test, "session_id", "left_semi")


def inventory_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration and class cells in the manifest and in the observations: which side lacks which."""
    m = _manifest(spark, sf_dir).groupBy("configuration_id", "class_name").agg(F.countDistinct("session_id").alias("declared"))
    o = table(spark, sf_dir, "packet_observations").groupBy("configuration_id", "class_name").agg(F.countDistinct("session_view_index").alias("observed"))
    return m.join(o, ["configuration_id", "class_name"], "full").select(
        "configuration_id", "class_name", "declared", "observed",
        F.when(F.col("observed").isNull(), "not_observed").when(F.col("declared").isNull(), "not_declared").otherwise("both").alias("state"),
    )


def token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a forbidden token, whatever its letter case."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    toks = F.array(*[F.lit(t) for t in ("confidential", "visit_timeout", "status=accepted", "sni")])
    return d.select("doc_id", F.explode(F.filter(toks, lambda x: F.contains(F.col("t"), x))).alias("token"))


def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Battery of declared constraints: name, pass, observed violations."""
    from packetlens.operators.checks import Check, report

    d, e, s, p = (table(spark, sf_dir, t) for t in ("evaluation_designs", "evidence", "class_schemes", "publications"))
    return report(spark, [
        Check("publications.primary_key", R.duplicates(p, keys=["record_id"])),
        Check("designs.primary_key", R.duplicates(d.drop("loaded_at").distinct(), keys=["design_id"])),
        Check("designs.paper_fk", d.select("paper_id").distinct().join(p.select(F.col("record_id").alias("paper_id")), "paper_id", "left_anti")),
        Check("evidence.design_fk", e.where("design_id is not null").select("design_id").distinct().join(d, "design_id", "left_anti")),
        Check("evidence.scheme_fk", e.where("scheme_id is not null").select("scheme_id").distinct().join(s, "scheme_id", "left_anti")),
        Check("evidence.confidence_enum", e.where("confidence is null or confidence not in ('high','medium','low')")),
    ])


QUERIES = {
    f.__name__: f
    for f in (
        route_grouped_regex, route_title_regex, route_membership, venn_cells, classify_case_chain, dedup_first_wins, candidate_join,
        outcome_summary, outcome_rollup, screening_flow, family_summary_total, structural_counts, list_ids_roundtrip, list_fk_violations,
        host_normalize, https_url_valid, allowlist_cascade, reject_histogram, attempt_lineage, digest_rank, session_token, label_ids,
        leakage_components, split_verify, uniqueness_checks, left_anti_sessions, semi_sessions, inventory_full_outer, token_scan, constraint_report,
    )
}

_DM = "m AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM session_manifest)"
_RQ = "r AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM rq2_paper_summary)"
ORACLE = {
    "route_grouped_regex": f"WITH {ROUTES_SQL} SELECT record_id FROM rr",
    "route_title_regex": f"WITH {ROUTES_SQL} SELECT record_id FROM rp",
    "route_membership": f"WITH {ROUTES_SQL} SELECT record_id, G, R, P, membership FROM lb",
    "venn_cells": f"WITH {ROUTES_SQL} SELECT membership AS cell, COUNT(*) AS records FROM lb GROUP BY 1 UNION ALL SELECT 'union', COUNT(*) FROM lb",
    "classify_case_chain": _CLASSIFY_SQL,
    "dedup_first_wins": _DEDUP_SQL,
    "candidate_join": """SELECT d.design_id, p.record_id, p.venue_family, p.year, d.task_family, e.evidence_id, e.confidence FROM (SELECT DISTINCT design_id, paper_id, task_family FROM evaluation_designs) d
 JOIN publications p ON d.paper_id=p.record_id JOIN (SELECT DISTINCT evidence_id, design_id, confidence FROM evidence WHERE design_id IS NOT NULL) e USING (design_id)""",
    "outcome_summary": f"""WITH {_RQ} SELECT dimension, COUNT(outcome) AS total, CAST(COALESCE(SUM(CASE WHEN outcome='documented_holdout' THEN 1 END),0) AS BIGINT) AS positive,
 CAST(COALESCE(SUM(CASE WHEN outcome='documented_no_holdout' THEN 1 END),0) AS BIGINT) AS negative, CAST(COALESCE(SUM(CASE WHEN outcome='not_documented' THEN 1 END),0) AS BIGINT) AS not_documented
 FROM (VALUES ('client'),('network'),('temporal'),('campaign')) v(dimension) LEFT JOIN r USING (dimension) GROUP BY dimension""",
    "outcome_rollup": f"""WITH {_RQ} SELECT upper(trim(paper_id)) AS paper, CASE WHEN MAX(CASE WHEN outcome='documented_holdout' THEN 1 ELSE 0 END)=1 THEN 'documented_holdout'
 WHEN MAX(CASE WHEN outcome='not_documented' THEN 1 ELSE 0 END)=1 THEN 'not_documented' ELSE 'documented_no_holdout' END AS outcome, COUNT(outcome) AS members FROM r GROUP BY 1""",
    "screening_flow": f"""WITH {ROUTES_SQL}, c AS (SELECT (SELECT COUNT(*) FROM publications) AS a, (SELECT COUNT(*) FROM ret) AS b, (SELECT COUNT(*) FROM lb) AS k,
 (SELECT COUNT(*) FROM lb WHERE record_id IN (SELECT paper_id FROM evaluation_designs)) AS i)
 SELECT 1 AS ordinal,'records' AS stage,a AS records FROM c UNION ALL SELECT 2,'not_retained',a-b FROM c UNION ALL SELECT 3,'retained',b FROM c UNION ALL SELECT 4,'not_candidates',b-k FROM c
 UNION ALL SELECT 5,'candidates',k FROM c UNION ALL SELECT 6,'excluded',k-i FROM c UNION ALL SELECT 7,'included',i FROM c""",
    "family_summary_total": f"""SELECT v.venue_family, COUNT(p.record_id) AS records, CAST(COALESCE(SUM(CASE WHEN {_TRUE} THEN 1 ELSE 0 END),0) AS BIGINT) AS retained
 FROM (VALUES {','.join(f"('{f}')" for f in FAMILIES)}) v(venue_family) LEFT JOIN publications p USING (venue_family) GROUP BY 1
 UNION ALL SELECT 'Total', COUNT(*), CAST(SUM(CASE WHEN {_TRUE} THEN 1 ELSE 0 END) AS BIGINT) FROM publications""",
    "structural_counts": """SELECT 'evaluation_designs' AS item, COUNT(*) AS rows, COUNT(DISTINCT design_id) AS ids, CAST(SUM(CASE WHEN eligibility_status='eligible' THEN 1 ELSE 0 END) AS BIGINT) AS matching FROM evaluation_designs
 UNION ALL SELECT 'evidence', COUNT(*), COUNT(DISTINCT evidence_id), CAST(SUM(CASE WHEN confidence='high' THEN 1 ELSE 0 END) AS BIGINT) FROM evidence
 UNION ALL SELECT 'class_schemes', COUNT(*), COUNT(DISTINCT scheme_id), CAST(SUM(CASE WHEN lower(trim(complete_scheme_in_dataset))='true' THEN 1 ELSE 0 END) AS BIGINT) FROM class_schemes""",
    "list_ids_roundtrip": """SELECT DISTINCT design_id, CAST(len(l) AS BIGINT) AS n, array_to_string(list_sort(list_distinct(l)),' | ') AS joined FROM
 (SELECT design_id, [trim(x) for x in string_split(coalesce(scheme_ids,''),'|') if trim(x)<>''] AS l FROM evaluation_designs)""",
    "list_fk_violations": """SELECT DISTINCT * FROM (SELECT design_id, 'dataset_ids' AS field, trim(UNNEST(string_split(coalesce(dataset_ids,''),'|'))) AS id FROM evaluation_designs
 UNION ALL SELECT design_id, 'scheme_ids', trim(UNNEST(string_split(coalesce(scheme_ids,''),'|'))) FROM evaluation_designs)
 WHERE id<>'' AND CASE field WHEN 'dataset_ids' THEN id NOT IN (SELECT dataset_id FROM canonical_datasets WHERE withdrawn_at IS NULL) ELSE id NOT IN (SELECT scheme_id FROM class_schemes WHERE withdrawn_at IS NULL) END""",
    "host_normalize": rf"""WITH {_DM} SELECT nullif(regexp_replace(lower({_HOST_SQL}),'\.+$',''),'') AS host, COUNT(DISTINCT record_no) AS records FROM m WHERE url IS NOT NULL GROUP BY 1""",
    "https_url_valid": rf"""WITH {_DM} SELECT DISTINCT record_no, url LIKE 'https://%' AND {_HOST_SQL} IS NOT NULL AND position('#' IN url)=0 AND NOT regexp_matches(url,'^https://[^/?#]*@') AS valid FROM m WHERE url IS NOT NULL""",
    "allowlist_cascade": f"WITH {_ALLOW_SQL} SELECT * FROM ac",
    "reject_histogram": f"WITH {_ALLOW_SQL} SELECT coalesce(nullif(rejection_reason,''),'accepted') AS outcome, COUNT(*) AS sessions FROM ac GROUP BY 1",
    "attempt_lineage": f"""WITH {_DM}, l AS (SELECT session_id, record_no, status, row_number() OVER (PARTITION BY session_id ORDER BY captured_at, record_no) AS attempt_index, lag(record_no) OVER (PARTITION BY session_id ORDER BY captured_at, record_no) AS previous_attempt,
 row_number() OVER (PARTITION BY session_id ORDER BY captured_at DESC, record_no DESC)=1 AS is_terminal FROM m) SELECT session_id, record_no, attempt_index, previous_attempt, is_terminal, is_terminal AND status='accepted' AS selected FROM l""",
    "digest_rank": """WITH m AS (SELECT DISTINCT session_id, configuration_id, class_name FROM session_manifest)
 SELECT session_id, configuration_id, class_name, row_number() OVER (PARTITION BY configuration_id, class_name ORDER BY sha256(concat_ws(chr(0),'selection-v1',configuration_id,class_name,session_id)), session_id) AS selection_rank FROM m""",
    "session_token": """SELECT record_no, 'session_'||substr(sha256('session-v1'||chr(0)||parent_group_id||chr(0)||n),1,24) AS token FROM
 (SELECT record_no, parent_group_id, row_number() OVER (PARTITION BY parent_group_id ORDER BY captured_at, record_no) AS n FROM (SELECT DISTINCT record_no, parent_group_id, captured_at FROM session_manifest WHERE parent_group_id IS NOT NULL))""",
    "label_ids": "SELECT class_name, row_number() OVER (ORDER BY class_name)-1 AS label_id FROM (SELECT DISTINCT class_name FROM session_manifest WHERE class_name IS NOT NULL)",
    "leakage_components": """WITH RECURSIVE t AS (SELECT doc_id, 'r'||record_id AS k FROM documents WHERE record_id IS NOT NULL UNION ALL SELECT doc_id, 's'||sha256(text) FROM documents WHERE text IS NOT NULL),
 h AS (SELECT k, MIN(doc_id) AS m FROM t GROUP BY k), e AS (SELECT DISTINCT doc_id AS a, m AS b FROM t JOIN h USING (k) WHERE doc_id<>m UNION SELECT m, doc_id FROM t JOIN h USING (k) WHERE doc_id<>m),
 w(x,y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT w.x, e.b FROM w JOIN e ON w.y=e.a) SELECT x AS doc_id, MIN(y) AS component FROM w GROUP BY x""",
    "split_verify": f"""WITH m AS (SELECT lower(trim(split)) AS split, UNNEST(['parent_group_id','pcap_sha256']) AS kind, UNNEST([lower(trim(parent_group_id)), lower(trim(pcap_sha256))]) AS value FROM session_manifest WHERE split IS NOT NULL)
 SELECT kind, value, COUNT(DISTINCT split) AS splits FROM m WHERE value NOT IN ({", ".join(f"'{w}'" for w in T.UNKNOWN_WORDS)}) AND NOT regexp_matches(value,'^0{{32,}}$') GROUP BY ALL HAVING COUNT(DISTINCT split)>1""",
    "uniqueness_checks": f"WITH {_DM} SELECT session_id, COUNT(*) AS copies FROM m GROUP BY 1 HAVING COUNT(*)>1",
    "left_anti_sessions": "SELECT DISTINCT session_id FROM session_manifest WHERE session_id NOT IN (SELECT session_id FROM session_manifest WHERE lower(trim(split))='test')",
    "semi_sessions": "SELECT DISTINCT session_id FROM session_manifest WHERE session_id IN (SELECT session_id FROM session_manifest WHERE lower(trim(split))='test')",
    "inventory_full_outer": """SELECT configuration_id, class_name, declared, observed, CASE WHEN observed IS NULL THEN 'not_observed' WHEN declared IS NULL THEN 'not_declared' ELSE 'both' END AS state
 FROM (SELECT configuration_id, class_name, COUNT(DISTINCT session_id) AS declared FROM session_manifest GROUP BY ALL) FULL JOIN
 (SELECT configuration_id, class_name, COUNT(DISTINCT session_view_index) AS observed FROM packet_observations GROUP BY ALL) USING (configuration_id, class_name)""",
    "token_scan": "SELECT doc_id, token FROM documents JOIN (VALUES ('confidential'),('visit_timeout'),('status=accepted'),('sni')) v(token) ON contains(lower(text), token)",
    "constraint_report": """WITH c AS (SELECT 'publications.primary_key' AS "check", COUNT(*) AS observed FROM (SELECT record_id FROM publications GROUP BY 1 HAVING COUNT(*)>1)
 UNION ALL SELECT 'designs.primary_key', COUNT(*) FROM (SELECT design_id FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM evaluation_designs) GROUP BY 1 HAVING COUNT(*)>1)
 UNION ALL SELECT 'designs.paper_fk', COUNT(DISTINCT paper_id) FROM evaluation_designs WHERE paper_id NOT IN (SELECT record_id FROM publications)
 UNION ALL SELECT 'evidence.design_fk', COUNT(DISTINCT design_id) FROM evidence WHERE design_id NOT IN (SELECT design_id FROM evaluation_designs)
 UNION ALL SELECT 'evidence.scheme_fk', COUNT(DISTINCT scheme_id) FROM evidence WHERE scheme_id NOT IN (SELECT scheme_id FROM class_schemes)
 UNION ALL SELECT 'evidence.confidence_enum', COUNT(*) FROM evidence WHERE confidence IS NULL OR confidence NOT IN ('high','medium','low'))
 SELECT "check", observed=0 AS passed, observed, CAST(0 AS BIGINT) AS expected FROM c""",
}
