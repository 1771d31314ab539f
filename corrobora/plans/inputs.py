"""Domain-shaped inputs, derived from the whole of the given tables by SQL that Spark and DuckDB read alike.

{name} stands for a table or another input. `frame` gives an input as a DataFrame, `ctes` as the WITH list of a query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..storage import dealt, table, tasks

INPUTS = {
    # Gene-drug edges.
    "gd": """SELECT 'G' || ((l_partkey * 13 + l_linenumber % 2) % 997) AS gene, 'D' || l_partkey AS drug,
        CASE l_returnflag WHEN 'A' THEN 'ChEMBL' WHEN 'N' THEN 'DGIdb' ELSE 'STITCH' END AS source,
        CASE l_linestatus WHEN 'O' THEN 'INHIBITOR' ELSE 'AGONIST' END AS action_type, l_discount * 100 AS score FROM {lineitem}""",
    # Drug-indication records.
    "di": """SELECT 'D' || l_partkey AS drug, 'EFO:' || (o_custkey % 701) AS efo_id, 'M' || (o_custkey % 1402) AS mesh_id, 'Heading ' || (o_custkey % 1402) AS mesh_heading,
        CAST(floor((l_linenumber + 1) / 2) AS INT) AS phase,
        CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Recruiting' ELSE 'Unknown status' END AS status, o_orderstatus <> 'O' AS is_concluded,
        CASE l_linestatus WHEN 'O' THEN 'OpenTargets' ELSE 'TrialPanorama' END AS source FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "dim": """SELECT drug, efo_id, max(phase) AS phase, max(CASE WHEN coalesce(is_concluded, true) THEN phase END) AS phase_concluded FROM {di} GROUP BY drug, efo_id""",
    # Trial pairs.
    "ct": """SELECT gene, efo_id, max(phase) AS max_phase, coalesce(max(phase) < 4, true) AND coalesce(max(phase_concluded) < max(phase), true) AS is_ongoing
        FROM (SELECT DISTINCT gene, drug FROM {gd}) g JOIN {dim} m ON g.drug = m.drug GROUP BY gene, efo_id""",
    # Trial pairs with their least descriptor.
    "ctm": """SELECT ct.gene, ct.efo_id, ct.max_phase, ct.is_ongoing, m.mesh_id FROM {ct} ct JOIN (SELECT gene, efo_id, min(mesh_id) AS mesh_id
        FROM (SELECT DISTINCT gene, drug FROM {gd}) g JOIN (SELECT drug, efo_id, min(mesh_id) AS mesh_id FROM {di} GROUP BY drug, efo_id) d ON g.drug = d.drug GROUP BY gene, efo_id) m
        ON m.gene = ct.gene AND m.efo_id = ct.efo_id""",
    # Evidence pairs.
    "ge": """SELECT 'G' || (user_id % 997) AS gene, 'EFO:' || ((event_id * 7 + user_id) % 701) AS efo_id, event_type AS source, value / 500 AS score FROM {events}""",
    # Similarity lookup: symmetric, with its diagonal.
    "sim": " UNION ".join(f"SELECT 'EFO:' || (p_partkey % 701) AS efo_id_1, 'EFO:' || ((p_partkey + {o % 701}) % 701) AS efo_id_2, CAST({1 - abs(o) * 0.08:.2f} AS DOUBLE) AS similarity FROM {{part}}" for o in range(-5, 6)),
    # Ontology: edges from each part to its half and third; names; obsolete ids with successors.
    "is_a": """SELECT 'X:' || p_partkey AS child, 'X:' || CAST(floor(p_partkey / 2) AS BIGINT) AS parent FROM {part} WHERE p_partkey > 1
        UNION SELECT 'X:' || p_partkey, 'X:' || CAST(floor(p_partkey / 3) AS BIGINT) FROM {part} WHERE p_partkey > 2""",
    "live": "SELECT DISTINCT 'EFO:' || o_orderkey AS id FROM {orders} WHERE o_orderpriority <> '1-URGENT'",
    "replaced": """SELECT 'EFO:' || o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_custkey % 7 = 0 THEN 'EFO:' || o_orderkey ELSE 'http://x/obo/EFO_' || (o_orderkey + o_custkey % 4) END AS successor
        FROM {orders} WHERE o_orderpriority = '1-URGENT'
        UNION SELECT 'EFO:' || o_orderkey, 'EFO:' || (o_orderkey + 1) FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_custkey % 5 = 0""",
    # Identifier records: drugs under one to three identifiers.
    "ids": """SELECT l_orderkey * 10 + l_linenumber AS record_id, CASE WHEN l_linenumber % 3 <> 0 THEN 'CHEMBL' || l_orderkey END AS chembl_id,
        CASE WHEN l_linenumber % 2 = 0 THEN 'DB' || (l_orderkey - l_orderkey % 2) END AS drugbank_id, CASE WHEN l_linenumber = 7 THEN ' ' WHEN l_linenumber > 4 THEN 'name ' || (l_orderkey - l_orderkey % 6) END AS drug_name_normalized,
        CASE WHEN l_returnflag = 'R' AND l_linenumber = 3 THEN 'CID' || l_orderkey END AS stitch_id, 'Name ' || l_partkey AS drug_name, CASE l_returnflag WHEN 'A' THEN 'ChEMBL' WHEN 'N' THEN 'DGIdb' ELSE 'STITCH' END AS source FROM {lineitem}""",
}


def needed(*names: str) -> list[str]:
    """The inputs that these need, before those that need them."""
    out: list[str] = []
    for n in names:
        if n in INPUTS:
            for x in [*needed(*re.findall(r"\{(\w+)\}", INPUTS[n])), n]:
                if x not in out:
                    out.append(x)
    return out


def ctes(*names: str) -> str:
    """"name AS (...), ..." for DuckDB."""
    return ", ".join(f"{n} AS ({re.sub(r'[{}]', '', INPUTS[n])})" for n in needed(*names))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in INPUTS:
        return table(spark, sf_dir, name)
    return spark.sql(INPUTS[name], **{n: frame(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", INPUTS[name]))})


def records(t) -> DataFrame:
    """The input `di`, lines joined to their orders in tasks by the number of lines. t gives an input by name."""
    lines = t("lineitem")
    return lines.sparkSession.sql(INPUTS["di"], lineitem=dealt(lines, tasks(lines), "l_orderkey"), orders=t("orders"))
