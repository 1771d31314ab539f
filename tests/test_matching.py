import pytest
from pyspark.sql import functions as F

from corrobora.operators import bootstrap as B
from corrobora.operators import enrichment as E
from corrobora.operators import matching as M
from corrobora.plans.evaluate import evaluate

TRIALS = [("GENE1", "EFO:001", 1), ("GENE1", "EFO:002", 2), ("GENE2", "EFO:001", 2), ("GENE2", "EFO:003", 3), ("GENE3", "EFO:001", 1), ("GENE3", "EFO:004", 4), ("GENE4", "EFO:002", 3), ("GENE4", "EFO:005", 2), ("GENE5", "EFO:003", 4), ("GENE5", "EFO:006", 1)]
EVIDENCE = [("GENE1", "001"), ("GENE1", "010"), ("GENE2", "001"), ("GENE3", "020"), ("GENE4", "002"), ("GENE5", "030"), ("GENE6", "001"), ("GENE7", "001")]
SIMILAR = [("001", "001", 1.0), ("010", "002", 0.85), ("020", "004", 0.75), ("030", "003", 0.6), ("001", "005", 0.55), ("002", "002", 1.0)]


@pytest.fixture(scope="module")
def trials(spark):
    return spark.createDataFrame(TRIALS, "gene string, efo_id string, max_phase int")


@pytest.fixture(scope="module")
def evidence(spark):
    return spark.createDataFrame([(g, f"EFO:{d}", "s") for g, d in EVIDENCE], "gene string, efo_id string, source string")


@pytest.fixture(scope="module")
def similarity(spark):
    return spark.createDataFrame([(f"EFO:{a}", f"EFO:{b}", s) for a, b, s in SIMILAR], "efo_id_1 string, efo_id_2 string, similarity float")


def pairs(df):
    return {(r["gene"], r["efo_id"]) for r in df.collect()}


def test_exact(trials, evidence):
    assert pairs(M.matched_pairs(evidence, trials)) == {("GENE1", "EFO:001"), ("GENE2", "EFO:001"), ("GENE4", "EFO:002")}


@pytest.mark.parametrize("threshold, more", [(0.8, {("GENE1", "EFO:002")}), (0.7, {("GENE1", "EFO:002"), ("GENE3", "EFO:004")}), (1.0, set()), (0.75, {("GENE1", "EFO:002"), ("GENE3", "EFO:004")})])
def test_similar(trials, evidence, similarity, threshold, more):
    exact = {("GENE1", "EFO:001"), ("GENE2", "EFO:001"), ("GENE4", "EFO:002")}
    assert pairs(M.matched_pairs(evidence, trials, similarity, threshold)) == exact | more


def test_universe(spark, trials, evidence):
    one = spark.createDataFrame([("GENE1",)], "gene string")
    assert pairs(M.matched_pairs(evidence, trials, genes=one)) == {("GENE1", "EFO:001")}
    assert len(pairs(M.matched_pairs(evidence, trials, genes=one.limit(0)))) == 3


def test_expansion_stops_at_one(spark, similarity):
    ids = spark.createDataFrame([("EFO:010",)], "efo_id string")
    assert M.expand_disease_set(ids, similarity, 0.8).count() == 2
    assert M.expand_disease_set(ids, similarity, 1.0).count() == 1


def test_lookup_contract(spark, similarity):
    kinds = {r["kind"] for r in M.lookup_violations(similarity).collect()}
    assert kinds == {"mirror", "diagonal"}
    with pytest.raises(ValueError):
        M.check_similarity_lookup(similarity)
    good = spark.createDataFrame([("a", "a", 1.0), ("b", "b", 1.0), ("a", "b", 0.9), ("b", "a", 0.9)], "efo_id_1 string, efo_id_2 string, similarity double")
    M.check_similarity_lookup(good)


def test_trials_are_checked(spark, trials):
    with pytest.raises(ValueError, match="repeated"):
        M.clean_trials(trials.union(trials))
    with pytest.raises(ValueError, match="lacks"):
        M.clean_trials(trials.drop("gene"))
    with pytest.raises(ValueError, match="text"):
        M.clean_trials(trials.withColumn("is_ongoing", F.lit("yes")))
    with pytest.warns(UserWarning):
        assert M.clean_trials(trials).filter("is_ongoing").count() == 0
    nulls = trials.withColumn("is_ongoing", F.when(F.col("max_phase") == 1, F.lit(1.0)))
    assert M.clean_trials(nulls).filter("is_ongoing").count() == 3


def jobs_of(spark, name, f):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = f()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_trials_are_checked_in_the_pass_that_writes_them(spark, trials, similarity):
    flags = trials.withColumn("is_ongoing", F.when(F.col("max_phase") == 1, F.lit(1.0)))
    with pytest.warns(M.UnmatchableDiseaseWarning, match="1 of 10 trial pairs"):
        out = M.checked_trials(flags.withColumn("note", F.lit("x")), similarity)
    assert out.columns == [*trials.columns, "is_ongoing", "note"] and out.count() == 9 and out.filter("is_ongoing").count() == 2
    with pytest.raises(ValueError, match="10 pairs are repeated, such as"):
        M.checked_trials(flags.union(flags), similarity)
    with pytest.raises(ValueError, match="lacks"):
        M.checked_trials(trials.drop("gene"))
    with pytest.raises(ValueError, match="text"):
        M.checked_trials(trials.withColumn("is_ongoing", F.lit("yes")))
    with pytest.raises(ValueError, match="other values"):
        M.checked_trials(trials.withColumn("is_ongoing", F.lit(2)))
    with pytest.raises(ValueError, match="knows"):
        M.checked_trials(flags, similarity.withColumn("efo_id_2", F.lit("EFO_1")))
    with pytest.warns(M.MissingOngoingWarning):
        assert M.checked_trials(trials).filter("is_ongoing").count() == 0
    assert M.checked_trials(flags.limit(0)).count() == 0
    booleans = trials.withColumn("is_ongoing", F.when(F.col("gene") == "GENE1", F.lit(True)))
    assert sorted(M.checked_trials(booleans).collect()) == sorted(M.clean_trials(booleans).collect())
    small_lookup = similarity.filter("similarity < 2").cache()
    small_lookup.count()
    _, n = jobs_of(spark, "check", lambda: M.checked_trials(booleans.withColumn("k", F.lit(1))))
    assert n <= 2  # the write, of which adaptive execution may run the shuffle on its own


def test_evidence_is_checked_in_one_pass(spark, evidence, similarity):
    rows = evidence.withColumn("source", F.lit("a")).unionByName(spark.createDataFrame([("GENE1", "EFO:777", "b"), ("GENE1", "EFO:777", "b"), ("GENE1", None, "b"), ("GENE1", "EFO:001", "b")], "gene string, efo_id string, source string"))
    with pytest.warns(M.UnmatchableDiseaseWarning, match=r"b: 2 of 3 rows \(66.7 %\).*EFO:777"):
        pairs, report = M.checked_evidence(rows, similarity)
    assert pairs.count() == 8 + 3
    assert sorted(map(tuple, report.collect())) == sorted(map(tuple, M.unmatchable_report(rows, similarity).collect()))
    assert M.checked_evidence(rows, None)[1] is None


def test_censoring_is_by_transition(spark):
    df = spark.createDataFrame([("G1", "E1", 1, True, True), ("G3", "E1", 1, False, False)], "gene string, efo_id string, max_phase int, is_ongoing boolean, has_genetic_evidence boolean")
    row = E.transition_counts(df, ((1, 2),)).first()
    assert (row["n_yes"], row["n_no"]) == (0, 1)
    assert E.transition_counts(df.drop("is_ongoing"), ((1, 2),)).first()["n_yes"] == 1


def test_evaluation(spark, trials, evidence, similarity):
    with pytest.warns(UserWarning):
        out = evaluate(trials, evidence, similarity, threshold=0.8)
    rows = {(r["phase_from"], r["phase_to"]): r for r in out.enrichment.collect()}
    # GENE5/EFO:006 is unknown to the lookup at any similarity; EFO:003 is known below the threshold and stays.
    assert rows[(1, 2)]["n_yes"] + rows[(1, 2)]["n_no"] == 9
    assert out.pairs.filter("match_type = 'similar'").count() == 1
    report = out.report.first()
    assert (report["n_rows"], report["n_unmatched"]) == (8, 0)
    with pytest.raises(ValueError, match="resample"):
        evaluate(trials, evidence, cluster="nothing")


def test_baseline_drops_what_it_alone_supports(trials, evidence):
    target = evidence.filter("gene = 'GENE1'")
    out = M.annotate_evidence(trials, target, evidence)
    assert out.count() == 8 and out.filter("has_genetic_evidence").count() == 1


def test_evaluation_by_path_and_with_clusters(spark, trials, evidence, similarity, tmp_path):
    paths = {}
    for name, df in {"trials": trials.withColumn("is_ongoing", F.lit(False)), "evidence": evidence, "similarity": similarity}.items():
        paths[name] = f"{tmp_path}/it's {name}"
        df.write.parquet(paths[name])
    out = evaluate(paths["trials"], paths["evidence"], paths["similarity"], cluster="gene", replicates=300)
    with pytest.warns(UserWarning):
        frames = evaluate(trials, evidence, similarity)
    names = ["source", "phase_from", "phase_to", "x_yes", "n_yes", "x_no", "n_no"]
    assert sorted(out.enrichment.select(names).collect()) == sorted(frames.enrichment.select(names).collect())
    boot = B.bootstrap(out.trials, "gene", 300, keys=["source"])
    own = ["source", "phase_from", "phase_to", "rr_boot_lower", "or_boot_upper"]
    assert sorted(map(repr, out.enrichment.select(own).collect())) == sorted(map(repr, boot.select(own).collect()))


def test_counts_by_arm_are_those_of_flags(trials, evidence, similarity):
    flags = trials.withColumn("is_ongoing", F.col("max_phase") == 2)
    two = evidence.withColumn("source", F.when(F.col("gene") < "GENE4", "a").otherwise("b"))
    supported = M.supporting_pairs(two, similarity, 0.5, ["source"])
    want = E.transition_counts(E.flag_sources(flags, supported, ["a", "b"]), keys=["source"])
    assert sorted(E.counts_by_arm(flags, supported, ["source"]).collect()) == sorted(want.collect())
    assert E.counts_by_arm(flags.limit(0), supported, ["source"]).count() == 0


def test_arms_without_support_have_rows(spark, trials, evidence, similarity):
    """Evidence on a disease that the lookup lacks, and on a pair that no trial has, is an arm with nothing in it."""
    from corrobora.plans import analysis

    lone = spark.createDataFrame([("GENE1", "EFO:999", "unmatched"), ("GENE999", "EFO:001", "no trial")], "gene string, efo_id string, source string")
    every = evidence.withColumn("source", F.lit("some")).unionByName(lone)
    flags = trials.withColumn("is_ongoing", F.col("max_phase") == 2)
    for out in (evaluate(flags, every, similarity).enrichment, analysis.enrich_arms(flags, every, ["source"], similarity)):
        rows = out.filter("phase_from = 1 AND phase_to = 2").collect()
        assert {r["source"]: r["n_yes"] > 0 for r in rows} == {"some": True, "unmatched": False, "no trial": False}
        assert len({r["n_yes"] + r["n_no"] for r in rows}) == 1
    grid = analysis.arm_grid(flags.withColumn("trial_table", F.lit("all")), every, similarity)
    assert grid.count() == 3 * 4 * 2 and grid.filter("source = 'unmatched' AND n_yes = 0 AND n_no > 0").count() == 8


def test_counts_beside_a_baseline_and_within_groups_are_those_of_flags(trials, evidence, similarity):
    flags = trials.withColumn("is_ongoing", F.col("max_phase") == 2).withColumn("half", F.when(F.col("gene") < "GENE3", "x").otherwise("y"))
    two = evidence.withColumn("source", F.when(F.col("gene") < "GENE4", "a").otherwise("b"))
    supported, base = M.supporting_pairs(two, similarity, 0.5, ["source"]), M.supporting_pairs(evidence, similarity, 0.5)
    flagged = M.membership_flags(E.flag_sources(flags, supported, ["a", "b"]), {"_base": base}).filter(F.col("has_genetic_evidence") | ~F.col("_base"))
    want = E.transition_counts(flagged, keys=["half", "source"])
    got = E.counts_by_arm(flags, supported, ["source"], within=["half"], without=base)
    columns = ["half", "source", "phase_from", "phase_to", "x_yes", "n_yes", "x_no", "n_no"]
    filled = lambda rows: sorted(tuple(r) for r in rows if r["n_yes"] + r["n_no"])
    assert filled(got.select(columns).collect()) == filled(want.select(columns).collect())


def test_validate_clustered_by_hashed_draws(spark, trials, evidence, similarity):
    """m10_validate_clustered: the bounds of each source are those of its own bootstrap, and those of DuckDB's draws (t7_bootstrap_ci_hashed)."""
    flags = trials.withColumn("is_ongoing", F.lit(False))
    two = evidence.withColumn("source", F.lit("a")).unionByName(evidence.filter("gene < 'GENE5'").withColumn("source", F.lit("b")))
    out = evaluate(flags, two, similarity, threshold=0.5, cluster="gene", replicates=200, hashed=True)
    names = ["phase_from", "phase_to", "rr_boot_lower", "rr_boot_upper", "or_boot_lower", "or_boot_upper"]
    for source in "ab":
        alone = M.annotate_evidence(M.drop_unmatchable(M.clean_trials(flags), similarity), M.supporting_pairs(two.filter(F.col("source") == source), similarity, 0.5))
        boot = B.bootstrap(alone, "gene", 200, hashed=True)
        assert sorted(map(repr, out.enrichment.filter(F.col("source") == source).select(names).collect())) == sorted(map(repr, boot.select(names).collect()))


def test_stored_tables_are_joined_without_moving_rows(spark, trials, evidence, similarity):
    """Only sums are exchanged: below each join stand scans of buckets."""
    from corrobora.plans import analysis

    flags = trials.withColumn("is_ongoing", F.col("max_phase") == 2).withColumn("trial_table", F.lit("all"))
    two = evidence.withColumn("source", F.when(F.col("gene") < "GENE4", "a").otherwise("b"))
    stored = analysis.store(flags, two, ["source"], similarity, buckets=4)
    assert sorted(map(repr, analysis.grid_of(stored).collect())) == sorted(map(repr, analysis.arm_grid(flags, two, similarity).collect()))
    assert sorted(map(repr, analysis.arms_of(stored).collect())) == sorted(map(repr, analysis.enrich_arms(flags, two, ["source"], similarity).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stored.trials.join(stored.supported, M.PAIR).groupBy("source").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan and "Exchange" not in plan[plan.index("SortMergeJoin") :]


def test_a_hot_disease_is_dealt_out(spark, monkeypatch):
    """A disease on half of all evidence rows, a lookup that isn't broadcast: no task has three times the median's rows, and the pairs are those of a plain join."""
    from corrobora import storage

    n = 40_000
    pairs = spark.range(n).select(F.concat(F.lit("G"), "id").alias("gene"), F.when(F.col("id") % 2 == 0, F.lit("EFO:0")).otherwise(F.concat(F.lit("EFO:"), F.col("id") % 500)).alias("efo_id"))
    lookup = spark.range(500).select(F.concat(F.lit("EFO:"), "id").alias("efo_id"), F.concat(F.lit("EFO:"), (F.col("id") * 7) % 500).alias("efo_id_2")).unionByName(spark.createDataFrame([("EFO:0", "EFO:1")], "efo_id string, efo_id_2 string"))
    plain = sorted(pairs.join(lookup, "efo_id").collect())
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        joined = storage.join_dealt(pairs, lookup, "efo_id", 200)
        assert sorted(joined.collect()) == plain
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(sizes) == 8 and sizes[-1] < 3 * sizes[4]


@pytest.mark.parametrize("list_rows, listed_rows", [(10_000, 1_000_000), (7, 1_000_000), (7, 0)])
def test_a_join_that_fans_out_is_dealt_to_tasks(spark, monkeypatch, tmp_path, list_rows, listed_rows):
    """One key has most rows of both sides, in one file; null keys, null values, repeated rows and rows without a match stay."""
    from corrobora import storage
    from corrobora.plans.relational import QUERIES

    for name, n in (("LIST_ROWS", list_rows), ("LISTED_ROWS", listed_rows), ("FAN_ROWS", 10), ("HOT_ROWS", 10)):
        monkeypatch.setattr(storage, name, n, raising=False)
    customers = [*((i, 1) for i in range(50)), (50, 2), (50, 2), (51, None), (52, 3), (None, 1)]
    suppliers = [*((i, 1) for i in range(40)), (40, 2), (40, 2), (None, 2), (41, None), (42, 4)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    rows = QUERIES["j13_crosswalk_join_fanout"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    wanted = [(c, s) for c, k in customers for s in ([s for s, n in suppliers if n == k and k is not None] or [None])]
    order = lambda r: [(x is None, x or 0) for x in r]
    assert sorted(((r[0], r[1]) for r in rows), key=order) == sorted(wanted, key=order)
    assert len({r["task"] for r in rows if r[0] is not None and r[0] < 50}) > 1


def test_rows_that_fan_out_are_written_as_runs_and_cycles(spark, tmp_path):
    """A million rows of 25 keys take under four bits each in a file, and are those of a plain join."""
    from corrobora import storage

    side = lambda c, salt: spark.range(5000, numPartitions=1).select(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(25)).cast("int").alias("k"), F.col("id").alias(c))
    left, right = side("a", 1), side("b", 2)
    storage.fan_out(left, right, "k", "b").select("a", "b").write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out")
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    assert total(rows) == total(left.join(right, "k").select("a", "b"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < rows.count() / 2
