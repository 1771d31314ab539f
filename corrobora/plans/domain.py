"""Queries for matching, enrichment, bootstrap, entities and ontology."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import enrichment as E
from ..operators import entities, graph, intervals
from ..operators import matching as M
from ..operators import ontology as O
from .evaluate import evaluate
from .inputs import ctes, frame

QUERIES, SQL = {}, {}
DIGITS = 6


def query(name: str, sql: str | None = None):
    """Registers a function of t, which gives an input by name, and the SQL of its rows."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda n: frame(spark, sf_dir, n))
        if sql:
            SQL[name] = sql
        return f

    return register


def tidy(df):
    """Doubles rounded, NaN as null, so that engines agree."""
    return df.select(*[F.when(~F.isnan(c), F.round(c, DIGITS)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


STEPS = "(VALUES (1, 2), (2, 3), (3, 4), (1, 4)) s(phase_from, phase_to)"


def counts_sql(source: str, keys: str = "") -> str:
    """x and n of both arms by transition, of a relation with max_phase, is_ongoing and yes."""
    ok = "max_phase >= phase_from AND NOT (is_ongoing AND max_phase < phase_to)"
    k = keys + ", " if keys else ""
    return f"""SELECT {k}phase_from, phase_to, count(*) FILTER (WHERE {ok} AND yes AND max_phase >= phase_to) AS x_yes, count(*) FILTER (WHERE {ok} AND yes) AS n_yes,
        count(*) FILTER (WHERE {ok} AND NOT yes AND max_phase >= phase_to) AS x_no, count(*) FILTER (WHERE {ok} AND NOT yes) AS n_no FROM {source}, {STEPS} GROUP BY {k}phase_from, phase_to"""


def ratios_sql(counts: str, more: str = "", digits: int = DIGITS) -> str:
    """counts with rates, ratios and intervals."""
    z = "1.959963984540054"
    return f"""SELECT * EXCLUDE (h, a, b, c, d, m, n, e1, e2), {more}
        round(CASE WHEN n_yes > 0 THEN x_yes / n_yes ELSE 0 END, {digits}) AS rate_yes, round(CASE WHEN n_no > 0 THEN x_no / n_no ELSE 0 END, {digits}) AS rate_no,
        CASE WHEN n_yes > 0 AND n_no > 0 THEN round((a / m) / (c / n), {digits}) END AS rr,
        CASE WHEN n_yes > 0 AND n_no > 0 THEN round(exp(ln((a / m) / (c / n)) - {z} * e1), {digits}) END AS rr_lower, CASE WHEN n_yes > 0 AND n_no > 0 THEN round(exp(ln((a / m) / (c / n)) + {z} * e1), {digits}) END AS rr_upper,
        CASE WHEN n_yes > 0 AND n_no > 0 THEN round((a * d) / (b * c), {digits}) END AS "or",
        CASE WHEN n_yes > 0 AND n_no > 0 THEN round(exp(ln((a * d) / (b * c)) - {z} * e2), {digits}) END AS or_lower, CASE WHEN n_yes > 0 AND n_no > 0 THEN round(exp(ln((a * d) / (b * c)) + {z} * e2), {digits}) END AS or_upper
        FROM (SELECT *, CASE WHEN n_yes > 0 AND n_no > 0 THEN sqrt(1 / a - 1 / m + 1 / c - 1 / n) END AS e1, CASE WHEN n_yes > 0 AND n_no > 0 THEN sqrt(1 / a + 1 / b + 1 / c + 1 / d) END AS e2
        FROM (SELECT *, x_yes + h AS a, n_yes - x_yes + h AS b, x_no + h AS c, n_no - x_no + h AS d, n_yes + 2 * h AS m, n_no + 2 * h AS n
        FROM (SELECT *, CASE WHEN x_yes = 0 OR x_yes = n_yes OR x_no = 0 OR x_no = n_no THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS h FROM ({counts}))))"""


LABEL = "CASE phase_from WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' END || '→' || CASE phase_to WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'Approved' END"


def fisher_sql(counts: str) -> str:
    """counts with the exact two-sided p-value, over all tables with the same margins."""
    choose = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
    log_p = lambda k: f"({choose('n_yes', k)} + {choose('n_no', f'(s - {k})')} - {choose('(n_yes + n_no)', 's')})"
    return f"""SELECT * EXCLUDE (s, ps), round(least(1, list_sum(list_transform(list_filter(ps, lambda p: p <= {log_p('x_yes')} + 1e-7), lambda p: exp(p)))), {DIGITS}) AS p_value
        FROM (SELECT *, list_transform(range(greatest(0, s - n_no), least(n_yes, s) + 1), lambda k: {log_p('k')}) AS ps FROM (SELECT *, x_yes + x_no AS s FROM ({counts})))"""


# Matching and annotation.


@query("m1_expand_disease_set", f"WITH {ctes('ge', 'sim')} SELECT DISTINCT efo_id FROM (SELECT efo_id FROM ge WHERE source = 'view' UNION ALL SELECT efo_id_2 FROM sim JOIN ge ON efo_id_1 = efo_id AND source = 'view' WHERE similarity >= 0.9)")
def _(t):
    return M.expand_disease_set(t("ge").filter("source = 'view'"), t("sim"), 0.9)


SUPPORTED = "SELECT DISTINCT ge.source, ge.gene, sim.efo_id_2 AS efo_id FROM ge JOIN sim ON ge.efo_id = sim.efo_id_1 AND sim.similarity >= 0.8"


@query("m2_matched_pairs_set", f"WITH {ctes('ct', 'ge', 'sim')}, s AS ({SUPPORTED}) SELECT DISTINCT ct.gene, ct.efo_id FROM ct JOIN s USING (gene, efo_id) WHERE ct.gene IN (SELECT 'G' || p_partkey FROM part)")
def _(t):
    return M.matched_pairs(t("ge"), t("ct"), t("sim"), 0.8, t("part").select(F.concat(F.lit("G"), "p_partkey").alias("gene")))


AUDIT = "SELECT DISTINCT ge.source, ct.gene, ct.efo_id AS ct_efo_id, ge.efo_id AS ge_efo_id, sim.similarity, CASE WHEN ct.efo_id = ge.efo_id THEN 'exact' ELSE 'similar' END AS match_type FROM ge JOIN sim ON ge.efo_id = sim.efo_id_1 AND sim.similarity >= 0.8 JOIN ct ON ct.gene = ge.gene AND ct.efo_id = sim.efo_id_2"


@query("m3_matched_pairs_audit", f"WITH {ctes('ct', 'ge', 'sim')} SELECT DISTINCT * EXCLUDE (source) FROM ({AUDIT})")
def _(t):
    return M.matched_pairs_audit(t("ge"), t("ct"), t("sim"), 0.8)


@query("m4_check_similarity_lookup", f"WITH {ctes('sim')}, l AS (SELECT * FROM sim WHERE similarity < 1 OR efo_id_1 LIKE '%7'), d AS (SELECT efo_id_1 AS t FROM l UNION SELECT efo_id_2 FROM l EXCEPT SELECT efo_id_1 FROM l WHERE efo_id_1 = efo_id_2) SELECT 'diagonal' AS kind, t AS efo_id_1, t AS efo_id_2 FROM d UNION ALL SELECT DISTINCT 'mirror', efo_id_1, efo_id_2 FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE a.efo_id_1 = b.efo_id_2 AND a.efo_id_2 = b.efo_id_1)")
def _(t):
    return M.lookup_violations(t("sim").filter((F.col("similarity") < 1) | F.col("efo_id_1").endswith("7")))


@query("m5_clean_trials", f"WITH {ctes('ct')} SELECT gene, efo_id, max_phase, coalesce(CASE WHEN max_phase < 3 THEN is_ongoing END, false) AS is_ongoing FROM ct WHERE max_phase > 0")
def _(t):
    return M.clean_trials(t("ct").withColumn("is_ongoing", F.when(F.col("max_phase") < 3, F.col("is_ongoing").cast("int"))))


@query("m6_drop_unmatchable", f"WITH {ctes('ct', 'sim')} SELECT * FROM ct WHERE efo_id IN (SELECT efo_id_2 FROM sim WHERE efo_id_2 NOT LIKE '%5')")
def _(t):
    return M.drop_unmatchable(t("ct"), t("sim").filter(~F.col("efo_id_2").endswith("5"))).select("gene", "efo_id", "max_phase", "is_ongoing")


@query("m7_unmatchable_report", f"WITH {ctes('ge', 'sim')}, k AS (SELECT DISTINCT efo_id_1 FROM sim WHERE efo_id_1 NOT LIKE '%5'), j AS (SELECT source, efo_id, efo_id_1 IS NULL AS lost FROM ge LEFT JOIN k ON efo_id = efo_id_1) SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE lost) AS n_unmatched, round(count(*) FILTER (WHERE lost) / count(*), 6) AS share, array_to_string(list_slice(list_sort(list(DISTINCT efo_id) FILTER (WHERE lost)), 1, 3), ',') AS examples FROM j GROUP BY source")
def _(t):
    return tidy(M.unmatchable_report(t("ge"), t("sim").filter(~F.col("efo_id_1").endswith("5"))))


@query("m8_narrow_lookup", f"WITH {ctes('sim')} SELECT * FROM sim WHERE similarity >= 0.8")
def _(t):
    return M.narrow_lookup(t("sim"), 0.8)


YES = "EXISTS (SELECT 1 FROM ge WHERE ge.gene = ct.gene AND ge.efo_id = ct.efo_id)"
CLICK = YES.replace("WHERE ", "WHERE ge.source = 'click' AND ")


@query("m9_annotate_evidence", f"WITH {ctes('ct', 'ge')} SELECT *, {YES} AS has_genetic_evidence FROM ct")
def _(t):
    return M.annotate_evidence(t("ct"), t("ge")).select("gene", "efo_id", "max_phase", "is_ongoing", "has_genetic_evidence")


FLAGS = "f AS (SELECT a.source, ct.*, s.gene IS NOT NULL AS yes FROM ct CROSS JOIN (SELECT DISTINCT source FROM ge) a LEFT JOIN s ON s.source = a.source AND s.gene = ct.gene AND s.efo_id = ct.efo_id)"
BATCH = f"WITH {ctes('ct', 'ge', 'sim')}, s AS ({SUPPORTED}), {FLAGS}"


@query("m10_validate", f"{BATCH} {fisher_sql(ratios_sql(counts_sql('f', 'source'), LABEL + ' AS transition,'))}")
def _(t):
    return tidy(evaluate(t("ct"), t("ge"), t("sim")).enrichment)


@query("m10_validate_clustered")
def _(t):
    return evaluate(t("ct"), t("ge"), t("sim"), cluster="gene").enrichment.select("source", "phase_from", "phase_to", "rr", "rr_boot_lower", "rr_boot_upper", "or", "or_boot_lower", "or_boot_upper")


@query("m11_validate_batch", f"{BATCH} SELECT source, gene, efo_id, max_phase, is_ongoing, yes AS has_genetic_evidence FROM f")
def _(t):
    return evaluate(t("ct"), t("ge"), t("sim")).trials.select("source", "gene", "efo_id", "max_phase", "is_ongoing", "has_genetic_evidence")


INCREMENT = f"{BATCH}, g AS (SELECT * FROM f WHERE source <> 'purchase' AND (yes OR NOT EXISTS (SELECT 1 FROM s WHERE s.source = 'purchase' AND s.gene = f.gene AND s.efo_id = f.efo_id)))"


@query("m12_incremental_over_baseline", f"{INCREMENT} {ratios_sql(counts_sql('g', 'source'))}")
def _(t):
    rest, base = t("ge").filter("source <> 'purchase'"), t("ge").filter("source = 'purchase'")
    return tidy(evaluate(t("ct"), rest, t("sim"), baseline=base).enrichment.drop("p_value", "transition"))


# Enrichment and statistics.

ARM = f"WITH {ctes('ct', 'ge')}, f AS (SELECT ct.*, {YES} AS yes FROM ct)"


def arm(t):
    return M.annotate_evidence(t("ct"), t("ge"))


@query("e1_transition_counts", f"{ARM} {counts_sql('f')}")
def _(t):
    return E.transition_counts(arm(t))


@query("e2_enrichment", f"{ARM} {fisher_sql(ratios_sql(counts_sql('f'), LABEL + ' AS transition,'))}")
def _(t):
    return tidy(E.enrichment(arm(t)))


@query("e3_censoring_conventions", f"{ARM}, c AS (SELECT convention, max_phase, is_ongoing AND convention = 'per transition' AS is_ongoing, yes FROM f, (VALUES ('none'), ('entry gate'), ('per transition')) v(convention) WHERE NOT (convention = 'entry gate' AND is_ongoing AND max_phase < 2)) {counts_sql('c', 'convention')}")
def _(t):
    return E.transition_counts(E.by_convention(arm(t)), keys=["convention"])


TABLES = "SELECT c_nationkey AS id, count(*) FILTER (WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING') AS x_yes, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS n_yes, count(*) FILTER (WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING') AS x_no, count(*) FILTER (WHERE c_mktsegment <> 'BUILDING') AS n_no FROM customer GROUP BY c_nationkey"


def tables(t):
    big, building = F.col("c_acctbal") > 5000, F.col("c_mktsegment") == "BUILDING"
    return t("customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count_if(big & building).alias("x_yes"), F.count_if(building).alias("n_yes"), F.count_if(big & ~building).alias("x_no"), F.count_if(~building).alias("n_no"))


@query("t1_risk_ratio_katz", f"SELECT id, rr, rr_lower, rr_upper FROM ({ratios_sql(TABLES)})")
def _(t):
    return tidy(E.with_ratios(tables(t))).select("id", "rr", "rr_lower", "rr_upper")


@query("t2_odds_ratio_woolf", f'SELECT id, "or", or_lower, or_upper FROM ({ratios_sql(TABLES)})')
def _(t):
    return tidy(E.with_ratios(tables(t))).select("id", "or", "or_lower", "or_upper")


@query("t3_fisher_exact_two_sided", f"SELECT id, CASE WHEN n_yes > 0 AND n_no > 0 THEN p_value END AS p_value FROM ({fisher_sql(TABLES)})")
def _(t):
    from ..functions.stats import with_fisher

    return tidy(with_fisher(tables(t), "x_yes", "n_yes", "x_no", "n_no", ["id"])).select("id", "p_value")


@query("t4_bootstrap_cluster_cells", f"{ARM.replace('ct.*', 'ct.*, ct.gene AS cluster')} SELECT * FROM ({counts_sql('f', 'cluster')}) WHERE n_yes + n_no > 0")
def _(t):
    return B.cluster_cells(arm(t), "gene")


#: Replicates of the hash-drawn bootstrap, which DuckDB repeats.
DRAWN = B.REPLICATES
CELLS = f"{ARM.replace('ct.*', 'ct.*, ct.gene AS cluster')}, c AS (SELECT *, row_number() OVER (PARTITION BY phase_from, phase_to ORDER BY cluster NULLS FIRST) - 1 AS slot FROM ({counts_sql('f', 'cluster')}) WHERE n_yes + n_no > 0), k AS (SELECT phase_from, phase_to, count(*) AS n FROM c GROUP BY ALL), r AS (SELECT phase_from, phase_to, n, r, unnest(range(n)) AS j FROM k, range({DRAWN}) x(r)), d AS (SELECT phase_from, phase_to, r, CAST('0x' || substr(md5('0:' || r || ':' || j), 1, 12) AS BIGINT) % n AS slot FROM r), w AS (SELECT d.phase_from, d.phase_to, CAST(r AS INT) AS r, sum(x_yes)::DOUBLE AS a, sum(n_yes)::DOUBLE AS m, sum(x_no)::DOUBLE AS c, sum(n_no)::DOUBLE AS n FROM d JOIN c ON c.phase_from = d.phase_from AND c.phase_to = d.phase_to AND c.slot = d.slot GROUP BY ALL), z AS (SELECT phase_from, phase_to, r, CASE WHEN m > 0 AND n > 0 AND c > 0 THEN a * n / (c * m) WHEN m > 0 AND n > 0 AND a > 0 THEN 'inf'::DOUBLE END AS rr, CASE WHEN m > 0 AND n > 0 AND (m - a) * c > 0 THEN a * (n - c) / ((m - a) * c) WHEN m > 0 AND n > 0 AND a * (n - c) > 0 THEN 'inf'::DOUBLE END AS or_ FROM w)"


@query("t5_bootstrap_replicates", f"{CELLS} SELECT phase_from, phase_to, r, CASE WHEN isfinite(rr) THEN rr END AS rr, CASE WHEN isfinite(or_) THEN or_ END AS or_ FROM z")
def _(t):
    drawn = B.hashed_replicates(B.cluster_cells(arm(t), "gene"), DRAWN)
    finite = lambda c: F.when(F.col(c) < float("inf"), F.col(c)).alias(c)
    return drawn.select("phase_from", "phase_to", "r", finite("rr"), finite("or_"))


@query("t6_bootstrap_interval", f"{CELLS} SELECT phase_from, phase_to, round(list_sort(list(rr) FILTER (WHERE rr IS NOT NULL))[CAST(floor((count(rr) - 1) * 0.025) AS INT) + 1], 6) AS rr_boot_lower, round(list_sort(list(rr) FILTER (WHERE rr IS NOT NULL))[CAST(ceil((count(rr) - 1) * 0.975) AS INT) + 1], 6) AS rr_boot_upper FROM z WHERE EXISTS (SELECT 1 FROM c q WHERE q.phase_from = z.phase_from AND q.phase_to = z.phase_to HAVING sum(x_yes) > 0 AND sum(x_no) > 0 AND sum(x_yes) < sum(n_yes) AND sum(x_no) < sum(n_no) AND count(*) FILTER (WHERE n_yes > 0) > 1 AND count(*) FILTER (WHERE n_no > 0) > 1) GROUP BY ALL")
def _(t):
    cells = B.cluster_cells(arm(t), "gene")
    out = tidy(B.intervals(B.hashed_replicates(cells, DRAWN), B.arm_sums(cells)))
    return out.select("phase_from", "phase_to", "rr_boot_lower", "rr_boot_upper").filter("rr_boot_lower IS NOT NULL")


@query("t7_bootstrap_ci")
def _(t):
    return B.bootstrap(arm(t))


def bounds_sql(unit: str) -> str:
    """Bounds of the hash-drawn bootstrap of an arm, whose clusters are those of a column."""
    usable = "sum(x_yes) > 0 AND sum(x_no) > 0 AND sum(x_yes) < sum(n_yes) AND sum(x_no) < sum(n_no) AND count(*) FILTER (WHERE n_yes > 0) > 1 AND count(*) FILTER (WHERE n_no > 0) > 1"
    values = lambda c: f"list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL))"
    bound = lambda v, side, at: f"CASE WHEN usable AND least(len(rrs), len(ors)) >= {1 - B.MOST_UNDEFINED} * times THEN {v}s[CAST({at} AS INT) + 1] END AS {v}_boot_{side}".replace("LEN", f"(len({v}s) - 1)")
    bounds = [bound(v, side, at) for v in ("rr", "or") for side, at in (("lower", "floor(LEN * 0.025)"), ("upper", "ceil(LEN * 0.975)"))]
    return f"""{CELLS.replace('ct.gene AS cluster', f'ct.{unit} AS cluster')}, q AS (SELECT phase_from, phase_to, {usable} AS usable FROM c GROUP BY ALL),
        v AS (SELECT phase_from, phase_to, count(*) AS times, {values('rr')} AS rrs, {values('or_')} AS ors FROM z GROUP BY ALL)
        SELECT phase_from, phase_to, {', '.join(bounds)} FROM q JOIN v USING (phase_from, phase_to)"""


@query("t7_bootstrap_ci_hashed", f"SELECT phase_from, phase_to, {', '.join(f'round({c}, {DIGITS}) AS {c}' for c in ('rr_boot_lower', 'rr_boot_upper', 'or_boot_lower', 'or_boot_upper'))} FROM ({bounds_sql('gene')})")
def _(t):
    return tidy(B.bootstrap(arm(t), n=DRAWN, hashed=True))


# Entities.

IDS = ("chembl_id", "drugbank_id", "drug_name_normalized", "stitch_id")
NODE = lambda c: f"CASE WHEN trim({c}) <> '' THEN '{c}:' || {c} END"
CLUSTERS = f"""WITH RECURSIVE {ctes('ids')}, k AS (SELECT *, coalesce({', '.join(NODE(c) for c in IDS)}) AS first FROM ids),
    e AS (SELECT DISTINCT first AS a, b FROM k, unnest([{', '.join(NODE(c) for c in IDS)}]) x(b) WHERE b IS NOT NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a), l AS (SELECT a, min(b) AS label FROM reach GROUP BY a),
    g AS (SELECT k.*, coalesce(label, 'record:' || record_id) AS drug_cluster FROM k LEFT JOIN l ON first = a)"""


@query("g1_connected_entities", f"{CLUSTERS} SELECT record_id, drug_cluster FROM g")
def _(t):
    return entities.connected_entities(t("ids")).select("record_id", "drug_cluster")


@query("g2_cluster_membership", f"{CLUSTERS} {' UNION '.join(f'''SELECT '{c}' AS id_type, {c} AS id_value, drug_cluster AS our_drug_id FROM g WHERE trim({c}) <> '' ''' for c in IDS)}")
def _(t):
    return entities.membership(t("ids"))


@query("g3_cluster_representative", f"{CLUSTERS} SELECT drug_cluster AS our_drug_id, first(drug_name ORDER BY CASE source WHEN 'ChEMBL' THEN 1 WHEN 'DGIdb' THEN 4 ELSE 6 END, drug_name) AS drug_name, min(chembl_id) AS chembl_id, min(drugbank_id) AS drugbank_id, min(stitch_id) AS stitch_id, string_agg(DISTINCT source, '&' ORDER BY source) AS source FROM g GROUP BY drug_cluster")
def _(t):
    return entities.representatives(entities.connected_entities(t("ids"))).select("our_drug_id", "drug_name", "chembl_id", "drugbank_id", "stitch_id", "source")


CLAIMS = "SELECT ' ' || p_type || ' ' AS claim_name, CASE WHEN p_size % 3 = 0 THEN lower(p_type) ELSE p_brand END AS drug_name, CASE WHEN p_size % 2 = 0 THEN 'Primary Drug Name' ELSE 'Alias' END AS nomenclature FROM part"


@query("g4_synonym_edges", f"SELECT a, max(b) AS b FROM (SELECT trim(lower(claim_name)) AS a, trim(lower(drug_name)) AS b FROM ({CLAIMS}) WHERE nomenclature = 'Primary Drug Name') WHERE a <> b GROUP BY a")
def _(t):
    rows = t("part").select(F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("claim_name"), F.when(F.col("p_size") % 3 == 0, F.lower("p_type")).otherwise(F.col("p_brand")).alias("drug_name"), F.when(F.col("p_size") % 2 == 0, "Primary Drug Name").otherwise("Alias").alias("nomenclature"))
    return entities.synonym_edges(rows)


# Ontology.

RESOLVED = f"""WITH RECURSIVE {ctes('live', 'replaced')}, e AS (SELECT DISTINCT id AS old, replace(successor, 'http://x/obo/EFO_', 'EFO:') AS nxt FROM replaced WHERE successor IS NOT NULL AND id NOT IN (SELECT id FROM live)),
    s AS (SELECT old, count(DISTINCT nxt) AS n, count(DISTINCT CASE WHEN l.id IS NOT NULL THEN nxt END) AS m, min(nxt) AS one, min(CASE WHEN l.id IS NOT NULL THEN nxt END) AS alive FROM e LEFT JOIN live l ON l.id = nxt GROUP BY old),
    c AS (SELECT old, CASE WHEN n = 1 THEN one WHEN m = 1 THEN alive END AS nxt FROM s WHERE n = 1 OR m = 1),
    f(id, cur) AS (SELECT old, nxt FROM c UNION SELECT f.id, c.nxt FROM f JOIN c ON f.cur = c.old), d AS (SELECT f.id, f.cur AS successor FROM f JOIN live ON live.id = f.cur)"""


def release(t):
    live, replaced = t("live"), t("replaced")
    return live, O.resolve_replacements(live, replaced), replaced.select("id").distinct().join(live, "id", "left_anti")


@query("g5_resolve_replacements", f"{RESOLVED} SELECT id, successor FROM d")
def _(t):
    return release(t)[1]


RECORDS = "(SELECT o_orderkey AS n, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_custkey % 9 = 0 THEN 'Y:' || o_orderkey ELSE 'EFO:' || o_orderkey END AS efo_id FROM orders)"


def records(t):
    return t("orders").select(F.col("o_orderkey").alias("n"), F.expr("CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_custkey % 9 = 0 THEN 'Y:' || o_orderkey ELSE 'EFO:' || o_orderkey END").alias("efo_id"))


GONE = "o AS (SELECT DISTINCT id FROM replaced WHERE id NOT IN (SELECT id FROM live))"


@query("g6_remap_ids", f"{RESOLVED}, {GONE} SELECT n, coalesce(successor, r.efo_id) AS efo_id FROM {RECORDS} r LEFT JOIN d ON d.id = r.efo_id WHERE successor IS NOT NULL OR r.efo_id IS NULL OR r.efo_id NOT IN (SELECT id FROM o)")
def _(t):
    _, replacements, obsolete = release(t)
    return O.remap(records(t), replacements, obsolete)


@query("g7_remap_report", f"{RESOLVED}, {GONE}, x AS (SELECT efo_id, CASE WHEN efo_id IN (SELECT id FROM d) THEN 'replaced' WHEN efo_id IN (SELECT id FROM o) THEN 'dropped' WHEN efo_id IN (SELECT id FROM live) THEN 'live' ELSE 'unknown' END AS fate FROM {RECORDS} WHERE efo_id IS NOT NULL) SELECT {', '.join(f'''count(*) FILTER (WHERE fate = '{f}') AS rows_{f}, count(DISTINCT efo_id) FILTER (WHERE fate = '{f}') AS ids_{f}''' for f in ('replaced', 'dropped', 'unknown'))} FROM x")
def _(t):
    live, replacements, obsolete = release(t)
    return O.remap_report(records(t), replacements, obsolete, live)


BELOW = f"WITH RECURSIVE {ctes('is_a')}, b(id) AS (SELECT 'X:3' UNION SELECT child FROM is_a JOIN b ON parent = b.id)"


@query("g8_ontology_descendants", f"{BELOW} SELECT id FROM b")
def _(t):
    return graph.descendants(t("is_a"), "X:3")


@query("g8_descendants_by_interval", f"{BELOW} SELECT id FROM b")
def _(t):
    return intervals.descendants(intervals.label(t("is_a")), "X:3")


CONTENT = f"WITH RECURSIVE {ctes('is_a')}, n AS (SELECT child AS id FROM is_a UNION SELECT parent FROM is_a), up(id, ancestor) AS (SELECT id, id FROM n UNION SELECT up.id, parent FROM up JOIN is_a ON child = ancestor), ic AS (SELECT ancestor AS id, -ln(count(*) / (SELECT count(*) FROM n)) AS ic FROM up GROUP BY ancestor)"


@query("g9_information_content", f"{CONTENT} SELECT id, round(ic + 0, 6) AS ic FROM ic")
def _(t):
    return O.information_content(t("is_a"))[0].select("id", F.round(F.col("ic") + 0.0, DIGITS).alias("ic"))


@query("g9_information_content_by_interval", f"{CONTENT} SELECT id, round(ic + 0, 6) AS ic FROM ic")
def _(t):
    return intervals.information_content(intervals.label(t("is_a"))).select("id", F.round(F.col("ic") + 0.0, DIGITS).alias("ic"))


TERMS = "SELECT CASE p_size % 8 WHEN 0 THEN 'EFO:' WHEN 1 THEN 'PR:' WHEN 2 THEN 'x:' WHEN 3 THEN 'Orphanet:' WHEN 4 THEN 'abc:' WHEN 5 THEN 'MonDo:' WHEN 6 THEN 'A_1:' ELSE 'none' END || p_partkey AS id, CASE WHEN p_size > 45 THEN ' ' ELSE p_name END AS name, p_size % 11 = 0 AS is_obsolete FROM {part}"


@query("g10_valid_terms", f"SELECT id, name FROM ({TERMS.replace('{part}', 'part')}) WHERE trim(name) <> '' AND NOT is_obsolete AND regexp_matches(id, '^(EFO|Orphanet|MonDo|A_1):')")
def _(t):
    part = t("part")
    return O.valid_terms(part.sparkSession.sql(TERMS, part=part)).select("id", "name")


TOP = "(SELECT max(ic) FROM ic)"
SCORED = f"p AS (SELECT a.id AS x, b.id AS y, max(m.ic) AS m FROM up a JOIN up b ON a.ancestor = b.ancestor AND a.id < b.id JOIN ic m ON m.id = a.ancestor GROUP BY ALL), q AS (SELECT x, y, (CASE WHEN i.ic + j.ic > 0 THEN 2 * m / (i.ic + j.ic) ELSE 0 END + m / {TOP}) / 2 AS s FROM p JOIN ic i ON i.id = x JOIN ic j ON j.id = y)"


def similar_sql(least: float) -> str:
    return f"{CONTENT}, {SCORED}, r AS (SELECT x, y, s FROM q WHERE s >= {least}) SELECT x AS efo_id_1, y AS efo_id_2, round(s, 6) + 0 AS similarity FROM r UNION ALL SELECT y, x, round(s, 6) + 0 FROM r UNION ALL SELECT id, id, 1 FROM n"


@query("g11_semantic_similarity", similar_sql(0.5))
def _(t):
    return tidy(O.semantic_similarity(t("is_a"), 0.5))


COARSE = "SELECT DISTINCT 'B:' || (p_size % 50) AS child, 'B:' || CAST(floor((p_size % 50) / 2) AS BIGINT) AS parent FROM {part} WHERE p_size % 50 > 0 UNION SELECT 'B:' || (p_size % 50), 'B:' || CAST(floor((p_size % 50) / 3) AS BIGINT) FROM {part} WHERE p_size % 50 > 0"


@query("g12_similarity_full_matrix", similar_sql(0.0).replace(ctes("is_a"), "is_a AS (" + COARSE.replace("{part}", "part") + ")"))
def _(t):
    """Unthresholded, over the coarse ontology of part sizes: every pair of terms is asked for."""
    part = t("part")
    return tidy(O.semantic_similarity(part.sparkSession.sql(COARSE, part=part), 0.0))


@query("g12_similarity_rows", f"{CONTENT}, p AS (SELECT a.id AS x, b.id AS y, max(m.ic) AS m FROM up a JOIN up b ON a.ancestor = b.ancestor JOIN ic m ON m.id = a.ancestor WHERE CAST(substr(a.id, 3) AS BIGINT) % 20 = 0 GROUP BY ALL) SELECT x AS efo_id_1, y AS efo_id_2, round(CASE WHEN x = y THEN 1 ELSE (CASE WHEN i.ic + j.ic > 0 THEN 2 * m / (i.ic + j.ic) ELSE 0 END + m / {TOP}) / 2 END, 6) + 0 AS similarity FROM p JOIN ic i ON i.id = x JOIN ic j ON j.id = y")
def _(t):
    """Unthresholded rows of the whole ontology's matrix: terms with numbers divisible by 20 against all terms."""
    edges = t("is_a")
    terms = edges.select(F.explode(F.array("child", "parent")).alias("id")).distinct()
    return O.similarity_rows(edges, terms.filter(F.substring("id", 3, 99).cast("long") % 20 == 0), DIGITS)
