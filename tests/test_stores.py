"""What is kept and read again: tallies, tables, alignments, sequences; tuned and weighted graphs."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import filters, graph, loci, nulls, similarity
from weftline.sources import formats, sinks


def test_tallies_go_on_where_they_stopped(spark, tmp_path):
    rng = random.Random(3)
    values = {(size, part): [float(rng.randint(0, 5)) for _ in range(40)] for size in (3, 4, 5) for part in range(4)}
    values[4, 1], values[3, 3] = [0.0] * 40, []
    asked = []

    def make(size, parts):
        if len(asked) == 3:
            raise RuntimeError("stopped")
        asked.append((size, tuple(parts)))
        return spark.createDataFrame([(p, v) for p in parts for v in values[size, p]], "part int, value double")

    folder = str(tmp_path / "nulls")
    with pytest.raises(RuntimeError):
        nulls.stored_tallies(spark, folder, [3, 4, 5], list(range(4)), make, 2)
    half = list(asked)
    asked.clear()
    again = nulls.stored_tallies(spark, folder, [3, 4], list(range(4)), make, 2)
    assert half == [(3, (0, 1)), (3, (2, 3)), (4, (0, 1))] and asked == [(4, (2, 3))]
    more = nulls.stored_tallies(spark, folder, [3, 4, 5], list(range(4)), make, 2)
    assert asked == [(4, (2, 3)), (5, (0, 1)), (5, (2, 3))] and again.count() < more.count()
    bars = {(r.size, r.part): r.threshold for r in nulls.tallied_thresholds(more, 0.61).collect()}
    for size in (3, 4, 5):
        rows = spark.createDataFrame([(p, v) for p in range(4) for v in values[size, p]], "part int, value double")
        assert {r.part: r.threshold for r in nulls.thresholds(rows, 0.61).collect()} == {p: b for (s, p), b in bars.items() if s == size}
    assert (3, 3) not in bars
    # Draws of two runs add up; a zero holds for larger sizes.
    twice = nulls.tallied_thresholds(more.unionAll(more), 0.61)
    assert {(r.size, r.part) for r in twice.collect()} == set(bars)
    carried = {(r.size, r.part): r.threshold for r in nulls.carried(nulls.tallied_thresholds(more, 0.61)).collect()}
    assert carried == {k: 0.0 if k in ((4, 1), (5, 1)) or any(bars.get((s, k[1])) == 0 for s in range(3, k[0])) else b for k, b in bars.items()}


def test_tables_of_all_versions(spark, tmp_path):
    df = spark.createDataFrame([([1, 2], 1, 0, 0.5, 0.1, 0.2, 40.0, 80.0, 0.3, ["a", "b"]), ([], 2, 0, 0.9, 0.1, 0.25, 40.0, None, None, ["a"])], "hgs array<int>, hlg long, hlc long, nrm_log_tmd double, pds double, gcl double, mmi double, mmp double, apds double, omes array<string>")
    sinks.families(df, f"{tmp_path}/new")
    sinks.families(df.withColumn("hlg", F.col("hlg") + 10), f"{tmp_path}/old", positives=False)
    got = {r.hlg: r for r in formats.families(spark, f"{tmp_path}/new", f"{tmp_path}/old").collect()}
    assert {k: (r.hgs, r.gcl, r.mmp, r.csb, r.apds, r.omes) for k, r in got.items()} == {
        1: ([1, 2], 0.2, 80.0, 0.5, 0.3, ["a", "b"]), 2: ([], 0.25, None, None, None, ["a"]), 11: ([1, 2], 0.2, None, None, None, ["a", "b"]), 12: ([], 0.25, None, None, None, ["a"]),
    }
    one = spark.createDataFrame([("o", "s_0", [1, None], ["g1", "g2"], [7]), ("p", "s_0", [None], ["g3"], [])], "ome string, name string, hgs array<int>, genes array<string>, families array<long>")
    sinks.loci(one, f"{tmp_path}/loci")
    assert sorted(map(tuple, formats.loci(spark, f"{tmp_path}/loci").collect())) == [("o", "s_0", [1, None], ["g1", "g2"], [7]), ("p", "s_0", [None], ["g3"], [])]
    spark.createDataFrame([("1\t2\t0.5",), ("1\t3\t0.2",), ("2\t9\t0.9",)], "value string").write.text(f"{tmp_path}/adj")
    kept = formats.edges(spark, f"{tmp_path}/adj", spark.createDataFrame([(1,), (2,), (3,)], "locus long"), 0.4)
    assert [tuple(r) for r in kept.collect()] == [(1, 2, 0.5)]
    sinks.itemsets(spark.createDataFrame([([1, 2, 3], [1, 2], 2.0), ([1, 2, 4], [1], 8.0)], "items array<int>, omes array<int>, score double"), f"{tmp_path}/sets")
    rows = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/sets").collect()
    assert [(r["items"], r.nrm_log_score, r.omes) for r in rows] == [("1,2,4", "1.0", "1"), ("1,2,3", "0.0", "1,2")]


def test_a_threshold_reads_the_row_groups_that_can_pass(spark, tmp_path):
    df = spark.range(4000).select(F.array(F.col("id").cast("int")).alias("hgs"), F.col("id").alias("hlg"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("nrm_log_tmd"), F.lit(0.5).alias("gcl"))
    for _ in range(2):  # the second takes the first one's place
        sinks.family_store(df, f"{tmp_path}/store")
    kept = filters.passing(spark.read.parquet(f"{tmp_path}/store"), tmd=0.9, gcl=0.2)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(nrm_log_tmd,0.9)" in plan and kept.count() == df.where("nrm_log_tmd >= 0.9").count()
    assert os.listdir(tmp_path) == ["store"]
    files = spark.read.parquet(f"{tmp_path}/store").groupBy(F.input_file_name()).agg(F.min("nrm_log_tmd").alias("a"), F.max("nrm_log_tmd").alias("b")).orderBy("a").collect()
    assert all(x.b <= y.a for x, y in itertools.pairwise(files))


def test_a_file_for_each_group(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 1000).alias("hg"), F.concat(F.lit("g"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("name"), F.lit("MK").alias("sequence"))
    path = f"{tmp_path}/fa"
    for _ in range(2):
        sinks.group_fasta(rows, path)
    folders = [x for x in os.listdir(path) if x.startswith("hg=")]
    assert len(folders) == 1000 and os.listdir(tmp_path) == ["fa"] and "_SUCCESS" in os.listdir(path)
    assert all(len([f for f in os.listdir(f"{path}/{x}") if f.startswith("part-")]) == 1 for x in folders)
    names = [r.name for r in formats.fasta(spark, f"{path}/hg=7").collect()]
    assert names == ["g0007", "g1007", "g2007", "g3007", "g4007"]

    with pytest.raises(Exception, match="lost"):
        sinks.group_fasta(rows.withColumn("sequence", F.when(F.col("hg") == 999, F.raise_error(F.lit("lost"))).otherwise(F.col("sequence"))), path)
    assert len([x for x in os.listdir(path) if x.startswith("hg=")]) == 1000  # the old whole is still there
    assert {r.ome: r.n for r in formats.sequence_counts(spark, f"{path}/hg=7").collect()} and formats.sequence_counts(spark, f"{path}/hg=7").agg(F.sum("n")).first()[0] == 5


def test_stored_alignments_are_not_shuffled_again(spark, tmp_path):
    rng = random.Random(5)
    genes = [(b, 10 * b + i, rng.randint(0, 4), f"g{b}_{i}_{k}") for b in (0, 1) for i in range(6) for k in range(4)]
    names = [g[3] for g in genes]
    algn = [(*rng.sample(names, 2), float(rng.randint(20, 99))) for _ in range(900)]
    locus_genes = spark.createDataFrame(genes, "block int, locus int, hg int, gene string")
    identities = spark.createDataFrame(algn, "q string, s string, pident double")
    store = similarity.alignment_store(identities, "alignments_of_test", f"{tmp_path}/store", 4)
    rows = lambda df: sorted((r.block, r.i, r.j, round(r.weight, 9)) for r in df.collect())
    assert rows(similarity.locus_similarity(locus_genes, store)) == rows(similarity.locus_similarity(locus_genes, identities))
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = similarity.locus_similarity(locus_genes, store)._jdf.queryExecution().sparkPlan().toString()
        executed = similarity.locus_similarity(locus_genes, store)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
        spark.sql("drop table alignments_of_test")
    assert "alignments_of_test" in plan or "store" in plan
    lines = executed.split("\n")
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and "Bucketed: true" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-|"))
    above, least = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < least:
            least = depth(x)
            above.append(x)
            if "Join" in x:
                break
    assert "Join" in above[-1] and not any("Exchange" in x for x in above)


def test_weighted_transitivity(spark):
    rng = random.Random(2)
    edges = [(a, b, float(rng.randint(1, 5))) for a, b in itertools.combinations(range(12), 2) if rng.random() < 0.5] + [(20, 21, 2.0)]
    w = {frozenset((a, b)): x for a, b, x in edges}
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    open_, closed = dict.fromkeys(nodes, 0.0), dict.fromkeys(nodes, 0.0)
    for v in nodes:
        for x, y in itertools.combinations([n for n in nodes if frozenset((v, n)) in w], 2):
            open_[v] += w[frozenset((v, x))] * w[frozenset((v, y))]
            closed[v] += w[frozenset((v, x))] * w[frozenset((v, y))] * w.get(frozenset((x, y)), 0.0)
    c, o = sum(closed.values()), sum(open_.values())
    spread = sum((c / o - (c - closed[v]) / (o - open_[v])) ** 2 for v in nodes) ** 0.5
    row = graph.weighted_transitivity(spark.createDataFrame(edges, "a long, b long, w double")).first()
    assert (row.transitivity, row.spread) == (pytest.approx(c / o), pytest.approx(spread))
    lone = graph.weighted_transitivity(spark.createDataFrame([(1, 2, 3.0)], "a long, b long, w double")).first()
    assert (lone.transitivity, lone.spread) == (0.0, 0.0)


def test_the_first_inflation_that_finds_the_known(spark):
    """Two cliques that hang together by one edge: a low inflation leaves them one family, a higher one parts them."""
    cliques = [(a + o, b + o, 1.0) for o in (0, 10) for a, b in itertools.combinations(range(5), 2)] + [(a, b, 0.6) for a in range(3) for b in range(10, 13)]
    weights = spark.createDataFrame(cliques, "i long, j long, weight double")
    places = spark.createDataFrame([(0, n, n % 10) for n in (*range(5), *range(10, 15))], "block int, locus long, ome long").withColumn("ome", F.col("ome") + F.when(F.col("locus") >= 10, 20).otherwise(0))
    genes = places.select("block", "locus", F.explode(F.when(F.col("locus") < 10, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(3), F.lit(4)))).alias("hg")).withColumn("gene", F.concat_ws("_", "locus", "hg"))
    tune = lambda omes, false: spark.createDataFrame([("k", [1, 2], omes, false)], "name string, hgs array<int>, omes array<long>, false_omes array<long>")
    steps = [1.05, 1.1, 1.2, 1.5, 2.0, 3.0]
    whole = {i: loci.tuned(weights, places, genes, tune([0, 4], []), [i])[0] for i in steps}
    assert whole == {i: i for i in steps}
    found, members, families = loci.tuned(weights, places, genes, tune([0, 4], [20]), steps)
    assert found > steps[0] and any(r.omes == [0, 1, 2, 3, 4] for r in families.collect())
    with pytest.raises(ValueError, match="k"):
        loci.tuned(weights, places, genes, tune([0, 4], [20]), steps[:1])
    with pytest.raises(ValueError, match="k"):
        loci.tuned(weights, places, genes, tune([0, 20], [1]), steps)


def test_taxa(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c"), (6, "c"), (7, "c")], "ome int, phylum string")
    assert sorted(r.ome for r in filters.populous_taxa(df, "phylum", 1).collect()) == [1, 2, 5, 6, 7]
    assert [tuple(r) for r in filters.taxa_by_size(df, "phylum").orderBy("place").collect()] == [("b", 1, 0), ("a", 2, 1), ("c", 3, 2)]


def test_the_store_holds_what_blocks_ask_for(spark, monkeypatch, tmp_path):
    """Alignments of loci of one block: a quarter of all."""
    from weftline.plans import stores

    rng, rows = random.Random(2), []
    spark.createDataFrame([(g, [rng.uniform(0, 1) for _ in range(3)], g % 2) for g in range(80)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    keep = similarity.alignment_store

    def kept(identities, *more):
        rows.extend((r.lo, r.hi) for r in identities.collect())
        return keep(identities, *more)

    monkeypatch.setattr(similarity, "alignment_store", kept)
    assert stores.stored_similarity(spark, str(tmp_path)).count()
    assert sorted(rows) == [(a, b) for a in range(80) for b in range(a + 1, 80) if a % 2 == b % 2 and a // 5 % 4 == b // 5 % 4]
