"""Queries for scans, projections, joins, aggregates, ordering, sets and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import matching as M
from ..operators import ontology as O
from ..sources import evidence, scans, status
from ..storage import fan_out, shared_dir
from .inputs import ctes, frame

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    """Registers a function of (t, spark), t giving an input by name, and the SQL of its rows."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda n: frame(spark, sf_dir, n), spark)
        if sql:
            SQL[name] = sql
        return f

    return register


def scratch(spark, name: str = "") -> str:
    """A new path in the folder that all executors see."""
    return f"{shared_dir(spark)}/corrobora/{uuid.uuid4().hex}{name}"


# Scans and sinks. Files are written from the given tables first, and read back by the scan in question.


@query("s1_scan_parquet", "SELECT p_partkey, p_name FROM part")
def _(t, spark):
    path = scratch(spark, "/it's parts")
    scans.sink_table(t("part"), path)
    return scans.scan(spark, path, ["p_partkey", "p_name"])


@query("s2_scan_parquet_dir", "SELECT p_partkey, p_brand FROM part")
def _(t, spark):
    path = scratch(spark)
    scans.sink_table(t("part").repartition(4), path)
    return scans.scan(spark, path, ["p_partkey", "p_brand"])


@query("s3_scan_parquet_filtered", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def _(t, spark):
    path = scratch(spark, "/it's orders")
    scans.sink_table(t("orders"), path)
    return scans.scan(spark, path, ["o_orderkey", "o_custkey"], (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000))


@query("s4_scan_tsv", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def _(t, spark):
    path = scratch(spark)
    scans.sink_table(t("supplier").select("s_suppkey", "s_name"), path, "tsv")
    return scans.scan_tsv(spark, path, comment="#")


@query("s5_scan_tsv_lazy_filtered", "SELECT o_orderkey AS id, o_orderpriority AS source_type FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t, spark):
    path = scratch(spark)
    scans.sink_table(t("orders").select("o_orderkey", "o_orderpriority"), path, "tsv")
    return scans.scan_tsv(spark, path, schema="id long, source_type string").where(F.col("source_type").isin("1-URGENT", "2-HIGH"))


@query("s6_scan_line_list", "SELECT DISTINCT trim(p_brand) AS value FROM part WHERE trim(p_brand) <> ''")
def _(t, spark):
    path = scratch(spark)
    t("part").select(F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("value")).write.text(path)
    return scans.scan_lines(spark, path)


STANZA = "'[Term]' || chr(10) || 'id: X:' || p_partkey || chr(10) || 'name: ' || p_name || chr(10) || 'is_a: X:' || CAST(floor(p_partkey / 2) AS BIGINT) || ' {source=\"a\"} ! parent' || chr(10) || CASE WHEN p_size % 10 = 0 THEN 'is_obsolete: true' || chr(10) || 'replaced_by: X_' || p_size ELSE 'synonym: ' || p_type END || chr(10)"


def stanzas(t, spark):
    path = scratch(spark)
    t("part").select(F.expr(STANZA).alias("value")).write.text(path)
    return spark.read.text(path, lineSep="\n\n")


@query("s7_scan_ontology_terms", "SELECT 'X:' || p_partkey AS id, p_name AS name, p_size % 10 = 0 AS is_obsolete, 'X:' || CAST(floor(p_partkey / 2) AS BIGINT) AS is_a, CASE WHEN p_size % 10 = 0 THEN 'X_' || p_size ELSE '' END AS replaced_by FROM part")
def _(t, spark):
    joined = lambda c: F.array_join(c, "|").alias(c)
    return O.parse_terms(stanzas(t, spark)).select("id", "name", "is_obsolete", joined("is_a"), joined("replaced_by"))


@query("s7_scan_ontology_windows", "SELECT 'X:' || p_partkey AS id, p_name AS name, p_size % 10 = 0 AS is_obsolete FROM part")
def _(t, spark):
    """Stanzas whose lines end with CRLF, with no blank line between them."""
    path = scratch(spark)
    t("part").select(F.replace(F.expr(STANZA), F.lit("\n"), F.lit("\r\n")).alias("value")).write.text(path)
    return O.scan_terms(spark, path).select("id", "name", "is_obsolete")


@query("s8_scan_ontology_edges", "SELECT 'X:' || p_partkey AS child, 'X:' || CAST(floor(p_partkey / 2) AS BIGINT) AS parent FROM part")
def _(t, spark):
    return O.is_a_edges(O.parse_terms(stanzas(t, spark)))


@query("s9_scan_mesh_descriptors", "SELECT DISTINCT 'D' || p_partkey AS id FROM part WHERE p_size % 5 = 4 OR p_size % 3 = 1")
def _(t, spark):
    path = scratch(spark)
    record = "concat('*NEWRECORD', chr(10), 'RECTYPE = D', chr(10), 'MN = ', if(p_size % 5 = 4, 'C04', 'D12'), '.588', chr(10), 'MN = ', if(p_size % 3 = 1, 'C04', 'A01'), chr(10), 'UI = D', p_partkey)"
    t("part").select(F.expr(record).alias("value")).write.text(path)
    return O.mesh_descriptors(scans.scan_records(spark, path, "*NEWRECORD"), "C04")


@query("s10_scan_variant_info", "SELECT l_orderkey AS pos, 'Pathogenic' AS clnsig, 'G' || l_partkey || ':' || l_suppkey AS geneinfo, CASE WHEN l_linenumber > 1 THEN 'cond ' || l_linenumber END AS clndn FROM lineitem")
def _(t, spark):
    path = scratch(spark)
    info = "concat('AF=0.1;CLNSIG=Pathogenic;GENEINFO=G', l_partkey, ':', l_suppkey, if(l_linenumber > 1, concat(';CLNDN=cond ', l_linenumber), ''))"
    line = F.concat_ws("\t", F.lit("1"), "l_orderkey", F.lit("."), F.lit("A"), F.lit("C"), F.lit("."), F.lit("PASS"), F.expr(info))
    t("lineitem").select(line.alias("value")).write.text(path)
    return scans.scan_variants(spark, path).select("pos", "clnsig", "geneinfo", "clndn")


@query("s11_scan_relational_export", "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t, spark):
    rows = scans.scan_export(t("orders"), ("o_custkey", t("customer"), "c_custkey"), ("c_nationkey", t("nation"), "n_nationkey"), ("n_regionkey", t("region"), "r_regionkey"))
    return rows.select("o_orderkey", "c_name", "n_name", "r_name")


@query("s12_filter_matrix_entries", "SELECT l_partkey, l_suppkey, l_discount FROM lineitem WHERE l_discount < 0.03")
def _(t, spark):
    return scans.filter_entries(t("lineitem"), ["l_partkey", "l_suppkey", "l_discount"], 0.03, "l_discount")


@query("s13_discover_sources", f"WITH {ctes('gd', 'di')} SELECT 'a' AS source, 'gene_drug' AS leg, count(*) AS n FROM gd UNION ALL SELECT 'b', 'drug_indication', count(*) FROM di")
def _(t, spark):
    first, second = scans.discover_sources({"a": (t("gd"), None), "b": (None, t("di"))})
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(s).alias("source"), F.lit(leg).alias("leg"), "n") for legs, leg in ((first, "gene_drug"), (second, "drug_indication")) for s, df in legs.items()]
    return scans.concat_parts(*parts)


@query("s13_discover_folder", f"WITH {ctes('gd', 'di')} SELECT 'a' AS source, 'gene_drug' AS leg, count(*) AS n FROM gd UNION ALL SELECT 'b', 'drug_indication', count(*) FROM di")
def _(t, spark):
    path = scratch(spark)
    scans.sink_table(t("gd"), f"{path}/a_gene_drug.parquet")
    scans.sink_table(t("di"), f"{path}/b_drug_indication.parquet")
    scans.sink_table(t("region"), f"{path}/a_other.parquet")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(s).alias("source"), F.lit(leg).alias("leg"), "n") for legs, leg in zip(scans.discover_folder(spark, path), scans.LEGS) for s, df in legs.items()]
    return scans.concat_parts(*parts)


@query("s14_concat_parts", "SELECT p_partkey, p_size FROM part UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def _(t, spark):
    return scans.concat_parts(t("part").select("p_partkey", "p_size"), t("supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_nationkey").alias("p_size")))


@query("s15_sink_table", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(t, spark):
    path = scratch(spark)
    scans.sink_table(t("supplier").select("s_suppkey", "s_acctbal"), path, "csv")
    return spark.read.schema("s_suppkey long, s_acctbal double").option("header", True).csv(path)


@query("s16_sink_line_list", "SELECT DISTINCT p_brand AS value FROM part")
def _(t, spark):
    path = scratch(spark)
    scans.sink_lines(t("part"), path, "p_brand")
    return spark.read.text(path)


@query("s17_require_columns", "SELECT r_regionkey, r_name FROM region")
def _(t, spark):
    return M.require_columns(t("region"), ["r_regionkey", "r_name"], "region")


# Projections and filters.


@query("p1_project_rename", "SELECT p_partkey AS drug_id, p_name AS drug_name FROM part")
def _(t, spark):
    return t("part").select("p_partkey", "p_name").withColumnsRenamed({"p_partkey": "drug_id", "p_name": "drug_name"})


@query("p2_add_constant", "SELECT p_partkey, 'DGIdb' AS source FROM part")
def _(t, spark):
    return t("part").select("p_partkey", F.lit("DGIdb").alias("source"))


NULLED = "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS k, CASE o_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN o_orderpriority END AS g FROM orders"


def nulled(t):
    rows = t("orders")
    return rows.select("o_orderkey", F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END").alias("k"), F.expr("CASE o_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN o_orderpriority END").alias("g"))


@query("p3_filter_not_null", f"SELECT * FROM ({NULLED}) WHERE k IS NOT NULL")
def _(t, spark):
    return nulled(t).dropna(subset=["k"])


@query("p4_filter_not_blank", f"SELECT * FROM ({NULLED}) WHERE g IS NOT NULL AND trim(g) NOT IN ('', 'UNKNOWN')")
def _(t, spark):
    return nulled(t).filter(X.not_blank(F.col("g")))


@query("p5_filter_threshold_strict", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount < 0.05")
def _(t, spark):
    return t("lineitem").filter(X.strict(F.col("l_discount"), 0.05)).select("l_orderkey", "l_linenumber", "l_discount")


@query("p5_filter_threshold_inclusive", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount >= 0.05")
def _(t, spark):
    return t("lineitem").filter(X.at_least(F.col("l_discount"), 0.05)).select("l_orderkey", "l_linenumber", "l_discount")


@query("p6_filter_in_set", f"SELECT * FROM ({NULLED}) WHERE k IN ('1-URGENT', '2-HIGH')")
def _(t, spark):
    return nulled(t).filter(F.col("k").isin("1-URGENT", "2-HIGH"))


@query("p6_filter_not_in_set", f"SELECT * FROM ({NULLED}) WHERE NOT coalesce(k IN ('1-URGENT', '2-HIGH'), false)")
def _(t, spark):
    return nulled(t).filter(~F.coalesce(F.col("k").isin("1-URGENT", "2-HIGH"), F.lit(False)))


@query("p7_filter_regex_any", r"SELECT p_partkey, p_type FROM part WHERE NOT coalesce(regexp_matches(lower(p_type), 'steel|copper|\?'), false)")
def _(t, spark):
    return t("part").filter(F.coalesce(~F.col("p_type").rlike(r"(?i)STEEL|Copper|\?"), F.lit(True))).select("p_partkey", "p_type")


@query("p8_filter_prefix", "SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1') AND p_size = 7")
def _(t, spark):
    return t("part").filter(F.col("p_brand").startswith("Brand#1") & (F.col("p_size") == 7)).select("p_partkey", "p_brand")


@query("p9_filter_substring", f"SELECT * FROM ({NULLED}) WHERE coalesce(contains(k, 'HIGH'), false)")
def _(t, spark):
    return nulled(t).filter(F.coalesce(F.col("k").contains("HIGH"), F.lit(False)))


@query("p10_filter_array_overlap", "SELECT o_orderkey FROM orders WHERE NOT list_has_any([o_orderstatus, o_orderpriority], ['P', '5-LOW'])")
def _(t, spark):
    controls = F.array("o_orderstatus", "o_orderpriority")
    return t("orders").filter(~F.arrays_overlap(controls, F.array(F.lit("P"), F.lit("5-LOW")))).select("o_orderkey")


RAW_PHASE = "CASE l_linenumber % 5 WHEN 0 THEN '0.5' WHEN 1 THEN '2' WHEN 2 THEN 'n/a' WHEN 3 THEN '4.0' ELSE '7' END"


@query("p11_filter_integer_valued", f"SELECT l_orderkey, l_linenumber, CAST(p AS INT) AS phase FROM (SELECT *, TRY_CAST({RAW_PHASE} AS DOUBLE) AS p FROM lineitem) WHERE p BETWEEN 1 AND 4 AND p = floor(p)")
def _(t, spark):
    rows = t("lineitem").withColumn("p", F.expr(f"try_cast({RAW_PHASE} AS DOUBLE)"))
    return rows.filter(F.col("p").between(1, 4) & (F.col("p") == F.floor("p"))).select("l_orderkey", "l_linenumber", F.col("p").cast("int").alias("phase"))


TRAITS = "CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ', ' || p_type END"


@query("p12_filter_single_valued", f"SELECT p_partkey, u FROM (SELECT p_partkey, {TRAITS} AS u FROM part) WHERE u IS NOT NULL AND len(string_split(u, ',')) = 1")
def _(t, spark):
    rows = t("part").select("p_partkey", F.expr(TRAITS).alias("u"))
    return rows.filter(F.col("u").isNotNull() & (F.size(F.split("u", ",")) == 1))


@query("p13_filter_any_term_in_set", "SELECT p_partkey FROM part WHERE list_has_any(list_transform(regexp_split_to_array(p_type || '| ' || p_brand, '[|,]'), lambda x: trim(x)), ['Brand#11', 'Brand#22'])")
def _(t, spark):
    terms = X.split_trim(F.concat("p_type", F.lit("| "), "p_brand"), "[|,]")
    return t("part").filter(F.arrays_overlap(terms, F.array(F.lit("Brand#11"), F.lit("Brand#22")))).select("p_partkey")


@query("p14_filter_null_or_threshold", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice >= 2000")
def _(t, spark):
    score = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return t("orders").filter(score.isNull() | X.at_least(score, 2000)).select("o_orderkey")


@query("p15_assert_known_values", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def _(t, spark):
    return status.unknown_values(t("orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


# Joins.


@query("j1_match_exact", f"WITH {ctes('ct', 'ge')} SELECT DISTINCT gene, efo_id FROM ct WHERE EXISTS (SELECT 1 FROM ge WHERE ge.gene = ct.gene AND ge.efo_id = ct.efo_id)")
def _(t, spark):
    return M.matched_pairs(t("ge"), t("ct"))


SIMILAR = "SELECT DISTINCT ct.gene, ct.efo_id FROM ct JOIN sim ON ct.efo_id = sim.efo_id_2 AND sim.similarity >= 0.8 JOIN ge ON ge.gene = ct.gene AND ge.efo_id = sim.efo_id_1"


@query("j2_match_similar", f"WITH {ctes('ct', 'ge', 'sim')} {SIMILAR}")
def _(t, spark):
    return M.matched_pairs(t("ge"), t("ct"), t("sim"), 0.8)


def universe(t):
    return t("part").select(F.concat(F.lit("G"), (F.col("p_size") * 7 % 997)).alias("gene"))


UNIVERSE = "(SELECT DISTINCT 'G' || (p_size * 7 % 997) AS gene FROM part)"


@query("j3_gene_universe_join", f"WITH {ctes('ct')} SELECT * FROM ct WHERE gene IN (SELECT gene FROM {UNIVERSE})")
def _(t, spark):
    return M.in_universe(t("ct"), universe(t)).select("gene", "efo_id", "max_phase", "is_ongoing")


@query("j4_left_join_unmatched_count", "SELECT n_name AS name, count(*) AS n, count(*) FILTER (WHERE o_orderkey IS NULL) AS n_unmatched FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY n_name")
def _(t, spark):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey").isNull()).alias("n_unmatched"))


LOPSIDED = "(SELECT * FROM sim WHERE NOT (efo_id_1 < efo_id_2 AND similarity < 0.7))"


@query("j5_anti_join_mirror", f"WITH {ctes('sim')}, l AS {LOPSIDED} SELECT efo_id_1, efo_id_2 FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE a.efo_id_1 = b.efo_id_2 AND a.efo_id_2 = b.efo_id_1)")
def _(t, spark):
    rows = t("sim").filter(~((F.col("efo_id_1") < F.col("efo_id_2")) & (F.col("similarity") < 0.7)))
    return M.lookup_violations(rows, require_diagonal=False).select("efo_id_1", "efo_id_2")


@query("j6_anti_join_diagonal", f"WITH {ctes('sim')}, r AS (SELECT * FROM sim WHERE NOT (efo_id_1 = efo_id_2 AND efo_id_1 LIKE '%3')) SELECT term FROM (SELECT efo_id_1 AS term FROM r UNION SELECT efo_id_2 FROM r) WHERE term NOT IN (SELECT efo_id_1 FROM r WHERE efo_id_1 = efo_id_2)")
def _(t, spark):
    rows = t("sim").filter(~((F.col("efo_id_1") == F.col("efo_id_2")) & F.col("efo_id_1").endswith("3")))
    return M.lookup_violations(rows).filter("kind = 'diagonal'").select(F.col("efo_id_1").alias("term"))


FLAGGED = "SELECT ct.*, EXISTS (SELECT 1 FROM ge WHERE source = 'click' AND ge.gene = ct.gene AND ge.efo_id = ct.efo_id) AS has_genetic_evidence, EXISTS (SELECT 1 FROM ge WHERE ge.gene = ct.gene AND ge.efo_id = ct.efo_id) AS has_baseline FROM ct"


@query("j7_membership_flag", f"WITH {ctes('ct', 'ge')} SELECT gene, efo_id, has_genetic_evidence FROM ({FLAGGED}) WHERE has_genetic_evidence OR NOT has_baseline")
def _(t, spark):
    return M.annotate_evidence(t("ct"), t("ge").filter("source = 'click'"), t("ge")).select("gene", "efo_id", "has_genetic_evidence")


@query("j8_multiway_join", "SELECT DISTINCT p_brand, s_name, r_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t, spark):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("p_brand", "s_name", "r_name").distinct()


@query("j9_left_join_aggregated_side", "SELECT c_custkey, n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def _(t, spark):
    side = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return t("customer").join(side, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "n_orders")


@query("j10_join_by_typed_identifier", f"WITH {ctes('ids')} SELECT i.record_id, m.v FROM ids i JOIN (SELECT DISTINCT 'chembl_id' AS k, chembl_id AS id, length(chembl_id) AS v FROM ids) m ON m.k = 'chembl_id' AND m.id = i.chembl_id WHERE trim(i.chembl_id) <> ''")
def _(t, spark):
    from ..operators.aggregate import by_identifier

    rows = t("ids")
    members = rows.select(F.lit("chembl_id").alias("id_type"), F.col("chembl_id").alias("id_value"), F.length("chembl_id").cast("long").alias("our_drug_id")).dropna().distinct()
    return by_identifier(rows, "chembl_id", members).select("record_id", F.col("our_drug_id").alias("v"))


@query("j11_join_edges_through_hub", f"WITH {ctes('gd', 'dim')} SELECT gene, efo_id, count(*) AS n FROM (SELECT DISTINCT gene, drug FROM gd) JOIN dim USING (drug) GROUP BY gene, efo_id")
def _(t, spark):
    return t("gd").select("gene", "drug").distinct().join(t("dim"), "drug").groupBy("gene", "efo_id").agg(F.count("*").alias("n"))


@query("j12_inner_then_left_chain", "SELECT l_orderkey, l_linenumber, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey WHERE c_name IS NOT NULL")
def _(t, spark):
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.dropna(subset=["c_name"]).select("l_orderkey", "l_linenumber", "c_name")


@query("j13_crosswalk_join_fanout", "SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey")
def _(t, spark):
    suppliers = t("supplier").select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey")
    return fan_out(t("customer").select("c_custkey", "c_nationkey"), suppliers, "c_nationkey", "s_suppkey").select("c_custkey", "s_suppkey")


@query("j14_null_as_value_join", f"WITH a AS ({NULLED}), b AS (SELECT k, count(*) AS n FROM a GROUP BY k) SELECT a.o_orderkey, b.n FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def _(t, spark):
    rows = nulled(t)
    side = rows.groupBy(F.col("k").alias("k2")).agg(F.count("*").alias("n"))
    return rows.join(side, F.col("k").eqNullSafe(F.col("k2"))).select("o_orderkey", "n")


@query("j15_dictionary_lookup", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name IS NOT NULL")
def _(t, spark):
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).dropna(subset=["n_name"]).select("s_suppkey", "n_name")


@query("j16_semi_join_studies", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(t, spark):
    return t("lineitem").join(t("orders").filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


NESTED = "SELECT l_orderkey AS report, list(l_partkey ORDER BY l_linenumber) AS drugs, list(l_suppkey ORDER BY l_linenumber) FILTER (WHERE l_linenumber < 3) AS diseases FROM lineitem GROUP BY l_orderkey"


def nested(t):
    ordered = lambda c, cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("l_linenumber", c)))), lambda x: x[c])
    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("report")).agg(ordered("l_partkey", F.lit(True)).alias("drugs"), ordered("l_suppkey", F.col("l_linenumber") < 3).alias("diseases"))
    return rows.withColumn("diseases", F.when(F.size("diseases") > 0, F.col("diseases")))


@query("j17_lateral_unnest", f"WITH n AS ({NESTED}), a AS (SELECT report, unnest(drugs) AS drug, diseases FROM n) SELECT report, drug, unnest(diseases) AS disease FROM a")
def _(t, spark):
    return nested(t).select("report", F.explode("drugs").alias("drug"), "diseases").select("report", "drug", F.explode("diseases").alias("disease"))


@query("j18_join_using_left", f"WITH {ctes('gd')} SELECT gene, drug, name FROM gd LEFT JOIN (SELECT 'D' || p_partkey AS drug, p_name AS name FROM part WHERE p_size > 10) USING (drug)")
def _(t, spark):
    names = t("part").filter("p_size > 10").select(F.concat(F.lit("D"), "p_partkey").alias("drug"), F.col("p_name").alias("name"))
    return t("gd").join(names, "drug", "left").select("gene", "drug", "name")


# Aggregates.


@query("a1_agg_max_min", f"WITH {ctes('di')} SELECT drug, max(phase) AS phase, min(mesh_id) AS mesh_id FROM di GROUP BY drug")
def _(t, spark):
    return t("di").groupBy("drug").agg(F.max("phase").alias("phase"), F.min("mesh_id").alias("mesh_id"))


@query("a2_agg_filtered", f"WITH {ctes('di')} SELECT drug, efo_id, max(phase) FILTER (WHERE coalesce(is_concluded, true)) AS phase_concluded FROM di GROUP BY drug, efo_id")
def _(t, spark):
    from ..operators.aggregate import concluded_phase

    return t("di").groupBy("drug", "efo_id").agg(concluded_phase().alias("phase_concluded"))


@query("a3_agg_string_set", f"SELECT o_orderkey % 1000 AS b, string_agg(DISTINCT k, '&' ORDER BY k) AS ks FROM ({NULLED}) GROUP BY b")
def _(t, spark):
    return nulled(t).groupBy((F.col("o_orderkey") % 1000).alias("b")).agg(X.string_set(F.col("k")).alias("ks"))


@query("a4_agg_string_set_py", f"WITH {ctes('ge')} SELECT gene, string_agg(DISTINCT source, '&' ORDER BY source) AS source FROM ge GROUP BY gene")
def _(t, spark):
    return t("ge").groupBy("gene").agg(X.string_set(F.col("source")).alias("source"))


@query("a5_agg_first_ordered", f"WITH {ctes('di')} SELECT drug, efo_id, first(mesh_id ORDER BY mesh_id) AS mesh_id, first(mesh_heading ORDER BY mesh_id) AS mesh_heading FROM di GROUP BY drug, efo_id")
def _(t, spark):
    return t("di").groupBy("drug", "efo_id").agg(F.min(F.struct("mesh_id", "mesh_heading")).alias("m")).select("drug", "efo_id", "m.*")


@query("a6_agg_first_nonnull_per_column", f"SELECT o_orderkey % 1000 AS b, first(k ORDER BY o_orderkey) FILTER (WHERE k IS NOT NULL) AS k, first(g ORDER BY o_orderkey) FILTER (WHERE g IS NOT NULL) AS g FROM ({NULLED}) GROUP BY b")
def _(t, spark):
    first = lambda c: X.first_nonnull(F.col(c), F.col("o_orderkey")).alias(c)
    return nulled(t).groupBy((F.col("o_orderkey") % 1000).alias("b")).agg(first("k"), first("g"))


@query("a7_agg_count_rows", "SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def _(t, spark):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").count().groupBy("l_returnflag").agg(F.sum("count").alias("n"))


@query("a8_agg_count_distinct", f"WITH {ctes('gd')} SELECT source, count(DISTINCT gene) AS genes, count(DISTINCT drug) AS drugs FROM gd GROUP BY source")
def _(t, spark):
    return t("gd").groupBy("source").agg(F.count_distinct("gene").alias("genes"), F.count_distinct("drug").alias("drugs"))


@query("a9_agg_conditional_counts", f"WITH {ctes('di')} SELECT source, count(*) FILTER (WHERE phase = 1) AS p1, count(*) FILTER (WHERE phase >= 3) AS p3, count(*) FILTER (WHERE is_concluded) AS c FROM di GROUP BY source")
def _(t, spark):
    return t("di").groupBy("source").agg(F.count_if(F.col("phase") == 1).alias("p1"), F.count_if(F.col("phase") >= 3).alias("p3"), F.count_if("is_concluded").alias("c"))


@query("a10_agg_list_distinct_slice", f"SELECT o_orderkey % 100 AS b, array_to_string(list_slice(list_sort(list(DISTINCT g) FILTER (WHERE k IS NOT NULL)), 1, 3), ',') AS x FROM ({NULLED}) WHERE g IS NOT NULL GROUP BY b")
def _(t, spark):
    values = F.slice(F.array_sort(F.collect_set(F.when(F.col("k").isNotNull(), F.col("g")))), 1, 3)
    return nulled(t).filter("g IS NOT NULL").groupBy((F.col("o_orderkey") % 100).alias("b")).agg(F.nullif(F.array_join(values, ","), F.lit("")).alias("x"))


@query("a11_agg_flatten_collect", f"WITH n AS ({NESTED}) SELECT report % 100 AS b, array_to_string(list_sort(list_distinct(flatten(list(drugs)))), '|') AS x FROM n GROUP BY b")
def _(t, spark):
    return nested(t).groupBy((F.col("report") % 100).alias("b")).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("drugs")))), "|").alias("x"))


@query("a12_agg_group_by_all", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t, spark):
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ALL", lineitem=t("lineitem"))


@query("a13_agg_group_concat", "SELECT l_orderkey, array_to_string(list_sort(list(l_returnflag || ':' || l_partkey)), '|') AS refs FROM lineitem GROUP BY l_orderkey")
def _(t, spark):
    return t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "l_returnflag", "l_partkey"))), "|").alias("refs"))


@query("a14_distinct_rows", f"WITH {ctes('gd')} SELECT DISTINCT gene, drug, source FROM gd")
def _(t, spark):
    return t("gd").select("gene", "drug", "source").distinct()


SETS = "SELECT o_custkey AS c, CASE o_orderstatus WHEN 'F' THEN 'A&B' WHEN 'O' THEN 'B&C' ELSE 'D' END AS s FROM orders"


@query("a15_correlated_set_agg", f"WITH m AS ({SETS}), x AS (SELECT c, unnest(string_split(s, '&')) AS src FROM m) SELECT c, string_agg(DISTINCT src, '&' ORDER BY src) AS s FROM x GROUP BY c")
def _(t, spark):
    rows = t("orders").select(F.col("o_custkey").alias("c"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'A&B' WHEN 'O' THEN 'B&C' ELSE 'D' END").alias("s"))
    return rows.groupBy("c").agg(X.split_set(F.col("s")).alias("s"))


@query("a16_value_counts", "SELECT p_type AS value, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC")
def _(t, spark):
    return t("part").groupBy(F.col("p_type").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


@query("a17_pivot_metric", "SELECT l_linestatus, a, r, CAST(a AS DOUBLE) / CAST(r AS DOUBLE) - 1 AS movement FROM (SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY l_linestatus) WHERE r > 0")
def _(t, spark):
    counts = t("lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "R"]).count()
    wide = counts.select("l_linestatus", F.coalesce("A", F.lit(0)).alias("a"), F.coalesce("R", F.lit(0)).alias("r")).filter("r > 0")
    return wide.withColumn("movement", X.relative_movement(F.col("r").cast("double"), F.col("a").cast("double")))


@query("a18_any_all_checks", "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_p, bool_and(o_totalprice > 1000) AS all_big FROM orders GROUP BY o_custkey")
def _(t, spark):
    return t("orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("any_p"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_big"))


# Windows and ordering.


@query("w1_dedup_keep_best", f"WITH {ctes('ge')} SELECT gene, efo_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY gene, efo_id ORDER BY score DESC, source) AS n FROM ge) WHERE n = 1")
def _(t, spark):
    return evidence.dedup_keep_best(t("ge").select("gene", "efo_id", "source", "score"), ["gene", "efo_id"], F.desc("score"))


@query("w2_dedup_keep_priority", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_orderkey) AS n FROM orders) WHERE n = 1")
def _(t, spark):
    rank = X.map_case(F.col("o_orderstatus"), {"P": 1, "F": 2}, F.lit(3))
    return evidence.dedup_keep_best(t("orders").select("o_custkey", "o_orderkey", rank.alias("rank")), ["o_custkey"], F.asc("rank")).drop("rank")


@query("w3_dedup_keep_first", "SELECT p_brand, min(p_name) AS p_name FROM part GROUP BY p_brand")
def _(t, spark):
    return evidence.dedup_keep_best(t("part").select("p_brand", "p_name"), ["p_brand"])


@query("w4_flag_duplicates", f"WITH {ctes('gd')} SELECT gene, drug, count(*) AS n FROM gd GROUP BY gene, drug HAVING count(*) > 1")
def _(t, spark):
    return t("gd").groupBy("gene", "drug").agg(F.count("*").alias("n")).filter("n > 1")


@query("w5_sort_rows", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def _(t, spark):
    return t("supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey")


@query("w6_limit_rows", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 5")
def _(t, spark):
    return t("supplier").select("s_suppkey").orderBy("s_suppkey").limit(5)


@query("w7_topk_combinations", f"WITH {ctes('ge')}, c AS (SELECT s, count(*) AS n FROM (SELECT gene, string_agg(DISTINCT source, '&' ORDER BY source) AS s FROM ge GROUP BY gene, efo_id) GROUP BY s) SELECT s AS source, n FROM c ORDER BY n DESC, s LIMIT 5")
def _(t, spark):
    combos = t("ge").groupBy("gene", "efo_id").agg(X.string_set(F.col("source")).alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    return combos.orderBy(F.desc("n"), "source").limit(5)


# Sets.


@query("u1_union_all_hetero", "SELECT p_partkey AS id, p_brand AS brand, NULL AS balance, 'part' AS source FROM part UNION ALL SELECT s_suppkey, NULL, s_acctbal, 'supplier' FROM supplier")
def _(t, spark):
    a = t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.lit("part").alias("source"))
    b = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("source"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u2_union_distinct", f"WITH {ctes('sim')} SELECT efo_id_1 AS id FROM sim UNION SELECT efo_id_2 FROM sim")
def _(t, spark):
    return t("sim").select(F.col("efo_id_1").alias("id")).union(t("sim").select("efo_id_2")).distinct()


@query("u3_set_union_expand", f"WITH {ctes('ge', 'sim')}, i AS (SELECT DISTINCT efo_id FROM ge WHERE source = 'click' AND score > 0.5) SELECT efo_id FROM i UNION SELECT efo_id_2 FROM sim WHERE similarity >= 0.9 AND efo_id_1 IN (SELECT efo_id FROM i)")
def _(t, spark):
    return M.expand_disease_set(t("ge").filter("source = 'click' AND score > 0.5"), t("sim"), 0.9)


@query("u4_set_difference", f"WITH {ctes('live', 'replaced')} SELECT id FROM replaced EXCEPT SELECT replace(successor, 'http://x/obo/EFO_', 'EFO:') FROM replaced")
def _(t, spark):
    rows = t("replaced")
    return rows.select("id").subtract(rows.select(X.to_curie(F.col("successor"))))


@query("u5_set_intersection", f"WITH {ctes('live', 'replaced')} SELECT replace(successor, 'http://x/obo/EFO_', 'EFO:') AS id FROM replaced INTERSECT SELECT id FROM live")
def _(t, spark):
    return t("replaced").select(X.to_curie(F.col("successor")).alias("id")).intersect(t("live"))


@query("u6_concat_arms", f"WITH {ctes('gd')} SELECT 'all' AS arm, count(*) AS n FROM gd UNION ALL SELECT 'inhibitors', count(*) FROM gd WHERE action_type = 'INHIBITOR'")
def _(t, spark):
    arms = F.when(F.col("action_type") == "INHIBITOR", F.array(F.lit("all"), F.lit("inhibitors"))).otherwise(F.array(F.lit("all")))
    return t("gd").select(F.explode(arms).alias("arm")).groupBy("arm").agg(F.count("*").alias("n"))


# Scalar functions.

F_SOURCES = {
    "f1_to_curie": ("orders", "o_orderkey", "CASE o_custkey % 3 WHEN 0 THEN 'http://x.org/obo/MONDO_' || o_custkey WHEN 1 THEN 'efo:EFO_' || o_custkey ELSE 'EFO_' || o_custkey END", X.to_curie, r"regexp_replace(x, '^(?:.*/|efo:)([A-Z][A-Za-z]*)_([A-Za-z0-9]+)$', '\1:\2')"),
    "f2_first_underscore_to_colon": ("orders", "o_orderkey", "o_orderstatus || '_a_' || o_custkey", X.first_underscore_to_colon, "regexp_replace(x, '_', ':')"),
    "f3_all_underscores_to_colon": ("orders", "o_orderkey", "o_orderstatus || '_a_' || o_custkey", X.all_underscores_to_colon, "replace(x, '_', ':')"),
    "f4_last_path_segment": ("orders", "o_orderkey", "'http://a/b/' || o_custkey", X.last_path_segment, "regexp_extract(x, '[^/]*$')"),
    "f5_normalize_name": ("part", "p_partkey", "CASE WHEN p_size < 5 THEN '  ' WHEN p_size < 9 THEN NULL ELSE ' ' || upper(p_name) || '  ' END", X.normalize_name, "nullif(trim(lower(x)), '')"),
    "f6_strip_prefix": ("part", "p_partkey", "CASE WHEN p_size < 5 THEN 'MeSH:' WHEN p_size < 20 THEN 'MeSH:' || p_size ELSE p_name END", lambda c: X.strip_prefix(c, "MeSH:"), "nullif(trim(regexp_replace(x, '^MeSH:', '')), '')"),
    "f14_list_to_joined": ("part", "p_partkey", "p_brand || '|' || CASE WHEN p_size < 9 THEN ' ' ELSE p_type END", lambda c: X.joined_list(F.split(c, r"\|")), "nullif(array_to_string(list_filter(string_split(x, '|'), lambda y: trim(y) <> ''), '|'), '')"),
}
for _name, (_t, _id, _in, _f, _sql) in F_SOURCES.items():
    query(_name, f"SELECT {_id}, {_sql} AS y FROM (SELECT {_id}, {_in} AS x FROM {_t})")(lambda t, spark, a=(_t, _id, _in, _f): t(a[0]).select(a[1], F.expr(a[2]).alias("x")).select(a[1], a[3](F.col("x")).alias("y")))


@query("f7_split_genes", "SELECT p_partkey, upper(trim(g)) AS gene FROM (SELECT p_partkey, unnest(string_split(replace(replace(p_brand || ' - a' || p_size || ' x , b', ' - ', ','), ' x ', ','), ',')) AS g FROM part) WHERE trim(g) <> ''")
def _(t, spark):
    raw = F.expr("p_brand || ' - a' || p_size || ' x , b'")
    return t("part").select("p_partkey", F.explode(X.split_genes(raw)).alias("gene"))


@query("f8_split_explode_trim", "SELECT p_partkey, trim(g) AS part FROM (SELECT p_partkey, unnest(string_split(p_brand || '; ' || p_type || ';;', ';')) AS g FROM part) WHERE trim(g) <> ''")
def _(t, spark):
    return t("part").select("p_partkey", F.explode(X.split_trim(F.expr("p_brand || '; ' || p_type || ';;'"), ";")).alias("part"))


@query("f9_gene_info_pairs", "SELECT p_partkey, split_part(g, ':', 1) AS symbol, split_part(g, ':', 2) AS id FROM (SELECT p_partkey, unnest(string_split(p_brand || ':' || p_size || '|none|G:' || p_partkey, '|')) AS g FROM part) WHERE contains(g, ':')")
def _(t, spark):
    return t("part").select("p_partkey", F.explode(X.gene_info_pairs(F.expr("p_brand || ':' || p_size || '|none|G:' || p_partkey"))).alias("g")).select("p_partkey", "g.*")


XREF = "'MONDO:MONDO:' || p_partkey || ',MeSH:D' || p_size || CASE WHEN p_size > 20 THEN ',Orphanet:' || p_size ELSE ',Human:HP:' || p_size END"


@query("f10_xref_extract_by_prefix", f"SELECT p_partkey, 'MONDO:' || p_partkey AS mondo, CASE WHEN p_size > 20 THEN 'Orphanet:' || p_size ELSE '' END AS orphanet, 'MeSH:D' || p_size AS mesh, CASE WHEN p_size > 20 THEN '' ELSE 'HP:' || p_size END AS hp FROM part")
def _(t, spark):
    c = F.expr(XREF)
    return t("part").select("p_partkey", *[F.array_join(X.xrefs(c, p), "|").alias(n) for p, n in zip(X.XREF_PREFIXES, ("mondo", "orphanet", "mesh", "hp"))])


@query("f11_map_case", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS phase FROM orders")
def _(t, spark):
    return t("orders").select("o_orderkey", X.map_case(F.col("o_orderpriority"), {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}).alias("phase"))


@query("f12_status_to_concluded", f"WITH {ctes('di')} SELECT drug, efo_id, phase, status, status <> 'Recruiting' AS is_concluded FROM di")
def _(t, spark):
    return t("di").select("drug", "efo_id", "phase", "status", status.is_concluded(F.col("status"), status.LABELS).alias("is_concluded"))


@query("f13_concluded_without_status", "SELECT o_orderkey, coalesce(o_orderstatus = 'F' OR o_orderpriority ILIKE '%LOW%', false) AS concluded FROM orders")
def _(t, spark):
    stage = F.when(F.col("o_orderstatus") == "F", "APPROVAL").otherwise("PHASE_2")
    text = F.when(F.col("o_orderpriority").contains("LOW"), "was Discontinued (2)")
    return t("orders").select("o_orderkey", status.concluded_without_status(stage, text).alias("concluded"))


@query("f15_struct_field_set", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS x FROM lineitem GROUP BY l_orderkey")
def _(t, spark):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("niceName"), F.col("l_partkey").alias("url"))).alias("urls"))
    return rows.select("l_orderkey", F.array_join(X.set_of_field(F.col("urls"), "niceName"), "|").alias("x"))


@query("f16_list_comprehension_filter", "SELECT l_orderkey, array_to_string(list_sort(coalesce(list(l_partkey) FILTER (WHERE l_returnflag = 'A'), [])), '|') AS x FROM lineitem GROUP BY l_orderkey")
def _(t, spark):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("level"), F.col("l_partkey").alias("label"))).alias("c"))
    return rows.select("l_orderkey", F.array_join(F.array_sort(F.transform(F.filter("c", lambda x: x["level"] == "A"), lambda x: x["label"])), "|").alias("x"))


@query("f17_phase_label", "SELECT DISTINCT CAST(l_linenumber - 1 AS INT) AS a, CASE l_linenumber - 1 WHEN 0 THEN 'Pre' WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'Approved' ELSE CAST(l_linenumber - 1 AS VARCHAR) END || '→Approved' AS label FROM lineitem")
def _(t, spark):
    a = F.col("l_linenumber") - 1
    return t("lineitem").select(a.cast("int").alias("a"), X.phase_label(a, F.lit(4)).alias("label")).distinct()


@query("f18_coalesce_fields", f"SELECT o_orderkey, coalesce(k, g) AS x FROM ({NULLED})")
def _(t, spark):
    return nulled(t).select("o_orderkey", F.coalesce("k", "g").alias("x"))


@query("f19_cast_int_equality", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity / 2 = floor(l_quantity / 2)")
def _(t, spark):
    half = F.col("l_quantity") / 2
    return t("lineitem").filter(half == F.floor(half)).select("l_orderkey", "l_linenumber")


@query("f20_relative_movement", "SELECT p_partkey, round(p_retailprice / nullif(p_size - 1, 0) - 1, 6) AS x FROM part")
def _(t, spark):
    return t("part").select("p_partkey", F.round(X.relative_movement((F.col("p_size") - 1).cast("double"), F.col("p_retailprice")), 6).alias("x"))
