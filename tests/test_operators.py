"""Small fixtures with results worked out by hand."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import scalars
from weftline.operators import filters, graph, itemsets, loci, nulls, positional, statistics, tree
from weftline.sources import formats, sinks

NEWICK = "((A:1,B:2)n1:0.5,(C:1,(D:1,E:3)n3:0.5)n2:1)root;"


def genes(spark, hgs, ome=1, scaffold=1):
    return spark.createDataFrame([(ome, scaffold, i, f"{ome}_{i}", h) for i, h in enumerate(hgs)], "ome long, scaffold int, pos int, gene string, hg int")


@pytest.fixture(scope="module")
def on_tree(spark):
    t = tree.tree_frame(spark, formats.newick(NEWICK))
    closure = tree.closure(t)
    return closure, tree.node_stats(t, closure)


def test_distances(spark, on_tree):
    closure, stats = on_tree
    want = {"A,B": (3, 3, 0, 0), "A,C": (2, 7, 0.8, 3), "A,D,E": (5, 7, 0.5, 2), "C,D,E": (5, 4.5, 0, 0), "A,B,C": (4, 7, 0.6, 2), "B,E": (5, 7, 0.5, 3), "A,B,C,D,E": (8.5, 7, 0, 0)}
    sets = spark.createDataFrame([(k, k.split(",")) for k in want], "set_id string, omes array<string>")
    got = {r.set_id: (r.tmd, r.mmd, round(r.pds, 9), r.n_missing) for r in tree.set_distances(sets, stats, closure).collect()}
    assert got == {k: (pytest.approx(v[0]), pytest.approx(v[1]), pytest.approx(v[2]), v[3]) for k, v in want.items()}
    missing = {(r.set_id, r.tip) for r in tree.missing_tips(sets, stats, closure).collect()}
    assert {t for k, t in missing if k == "A,C"} == {"B", "D", "E"} and not {k for k, _ in missing} & {"A,B", "C,D,E"}
    pair = spark.createDataFrame([(1, ["A", "B"], ["A", "B", "C"])], "pair_id int, a array<string>, b array<string>")
    assert tree.branch_similarity(pair, stats, closure).first().similarity == pytest.approx(0.75)


def test_trees_as_text():
    rows = formats.newick(NEWICK)
    assert {r[3] for r in rows if r[3]} == set("ABCDE")
    cut = formats.pruned(rows, {"A", "C", "E"})
    assert sorted((r[3], r[2]) for r in cut if r[3]) == [("A", 1.5), ("C", 1.0), ("E", 3.5)]
    assert {r[3] for r in formats.rooted(rows, {"D", "E"}) if r[3]} == set("ABCDE")
    with pytest.raises(ValueError):
        formats.newick("((A,B);")


def test_windows(spark):
    g = genes(spark, [1, 2, 3, None, 4, 1])
    pairs = lambda w: sorted((r.hg0, r.hg1) for r in positional.window_pairs(g, w).collect())
    triples = lambda w: sorted(tuple(r["items"]) for r in positional.window_combinations(g, 3, w).collect())
    assert pairs(1) == [(1, 2), (1, 3), (1, 4), (2, 3), (3, 4)]
    assert triples(1) == [(1, 2, 3)] and triples(2) == [(1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)]
    r = random.Random(1)
    hgs = [r.choice([None, 1, 2, 3, 4, 5]) for _ in range(40)]
    want = {tuple(sorted(c)) for i in range(40) for c in itertools.combinations({h for h in hgs[max(0, i - 2) : i + 3] if h}, 3)}
    assert set(tuple(x["items"]) for x in positional.window_combinations(genes(spark, hgs), 3).collect()) == want


def test_runs_and_merges(spark):
    g = genes(spark, [1, 1, 1, 9, 1, 1, 9, 9, 9, 1])
    assert [(r["first"], r["last"], r.n) for r in positional.runs(g, F.col("hg") == 1, 2).orderBy("first").collect()] == [(0, 2, 3), (4, 5, 2)]
    places = spark.createDataFrame([(1, 1, 1, a, b) for a, b in ((0, 1), (3, 3), (6, 7), (11, 11))], "ome int, scaffold int, family int, first int, last int")
    merged = lambda **k: [(r["first"], r["last"]) for r in positional.merge_neighbours(places, **k).orderBy("first").collect()]
    assert merged() == [(0, 7), (11, 11)] and merged(exact=True) == [(0, 1), (3, 7), (11, 11)]


def test_shared_and_closed_sets(spark):
    rows = [(1, 2, "a", 1, [1, 2, 3, 4]), (1, 2, "b", 2, [1, 2, 3]), (1, 2, "c", 3, [1, 2]), (1, 2, "d", 2, [1, 2, 4, 3])]
    df = spark.createDataFrame(rows, "hg0 int, hg1 int, anchor string, ome int, items array<int>")
    shared = {(r.a, r.b): r["items"] for r in itemsets.shared_sets(df).collect()}
    assert shared == {("a", "b"): [1, 2, 3], ("a", "d"): [1, 2, 3, 4]}
    sets = spark.createDataFrame([([1, 2], [7, 8]), ([1, 3], [7, 8, 9]), ([1, 2, 3], [7, 8])], "items array<int>, omes array<int>")
    assert sorted(r["items"] for r in itemsets.closed(sets, (2, 3)).collect()) == [[1, 2, 3], [1, 3]]


def test_percentiles(spark):
    index = lambda p, n: spark.range(1).select(scalars.percentile_index(p, F.lit(n))).first()[0]
    assert [index(p, n) for p, n in ((0.2, 10), (0.61, 10), (0.2, 10000), (0.61, 10000))] == [2, 7, 2000, 6100]
    medians = [[spark.range(1).select(scalars.lower_median_index(F.lit(n), w)).first()[0] for n in range(1, 8)] for w in (True, False)]
    assert medians == [[-1, 0, 1, 1, 1, 2, 3], [0, 0, 0, 1, 2, 2, 2]]
    assert scalars.percent_flag("5") == 0.05 and scalars.percent_flag("61") == 0.61
    values = spark.createDataFrame([(0, float(v)) for v in range(10)], "part int, value double")
    assert nulls.thresholds(values, 0.61).first().threshold == 7.0


def test_coefficients(spark):
    row = spark.range(1).select(*[f(F.lit(2), F.lit(3), F.lit(4)).alias(n) for n, f in scalars.COEFFICIENTS.items()]).first()
    assert (round(row.sorensen, 6), round(row.jaccard, 6), round(row.overlap, 6)) == (0.571429, 0.4, 0.666667)
    assert spark.range(1).select(scalars.substitution_bias(F.lit(40.0), F.lit(80.0))).first()[0] == 0.5


def test_upper_tail(spark):
    def by_hand(k, total, marked, drawn):
        return sum(math.comb(marked, i) * math.comb(total - marked, drawn - i) for i in range(k, min(marked, drawn) + 1)) / math.comb(total, drawn)

    cases = [(2, 10, 4, 3), (0, 10, 4, 3), (4, 10, 4, 3), (5, 200, 60, 20), (120, 3000, 900, 300), (7, 9, 8, 8), (1, 1, 1, 1)]
    df = spark.createDataFrame(cases, "k long, n long, m long, d long")
    got = [r[0] for r in df.select(statistics.upper_tail(*(F.col(c) for c in "knmd"))).collect()]
    assert got == [pytest.approx(by_hand(*c), rel=1e-7, abs=1e-12) for c in cases]


def test_extension(spark):
    g = genes(spark, [5, 1, 2, 3, 4, 9, 4])
    rows = spark.createDataFrame([(1, 1, 1, 2, 3)], "family int, ome long, scaffold int, first int, last int")
    fam = spark.createDataFrame([(1, [1, 2, 3, 4])], "family int, hgs array<int>")
    got = loci.extended(rows, g, fam).first()
    assert (got.new_first, got.new_last) == (1, 4)


def test_clusters_and_components(spark):
    cliques = [(a + o, b + o, 1.0) for o in (0, 10) for a, b in itertools.combinations(range(5), 2)]
    edges = spark.createDataFrame([*cliques, (0, 10, 0.05), (30, 31, 1.0)], "a long, b long, w double")
    want = {frozenset(range(5)), frozenset(range(10, 15)), frozenset({30, 31})}
    for dense in (2000, 1):
        found = {}
        for r in graph.markov_clusters(edges, 2.0, dense).collect():
            found.setdefault(r.cluster, set()).add(r.node)
        assert {frozenset(v) for v in found.values()} == want and all(k == min(v) for k, v in found.items())
    sets = spark.createDataFrame([(i,) for i in (0, 1, 2, 99)], "set_id long")
    assert {r.set_id: r.clan for r in graph.clans(sets, edges).collect()} == {0: 0, 1: 0, 2: 0, 99: 99}


def test_network_statistics(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4)], "a long, b long")
    row = graph.graph_summary(edges).first()
    assert (row.n_nodes, row.n_edges, round(row.density, 6), round(row.transitivity, 6)) == (4, 4, 0.666667, 0.6)
    assert {r.node: round(r.clustering, 6) for r in graph.local_clustering(edges).collect()} == {1: 1.0, 2: 1.0, 3: 0.333333, 4: 0.0}
    assert {r.node: r.betweenness for r in graph.betweenness(edges).collect()} == {1: 0.0, 2: 0.0, 3: 2.0, 4: 0.0}
    w = spark.createDataFrame([(1, 2, 5.0), (1, 3, 4.0), (2, 3, 4.0), (3, 4, 1.0)], "a long, b long, w double")
    assert graph.capped_edges(w, 2).count() == 1 and graph.capped_edges(w, 3).count() == 3


def test_filters(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5, 0.5, 40.0, 80.0), (2, 0.1, 0.5, 0.5, 40.0, None), (3, 1.0, 0.5, 0.5, 40.0, 41.0)], "hlg int, nrm_log_tmd double, gcl double, pds double, mmi double, mmp double")
    ids = lambda **k: sorted(r.hlg for r in filters.passing(df, **k).collect())
    assert ids() == [1, 2, 3] and ids(csb=0.4) == [1, 2] and ids(tmd=0.5) == [1, 3] and ids(mmp=50, positives=False) == [1, 2, 3]


def test_text_formats(spark, tmp_path):
    w = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    gff = w("o.gff3", "##gff-version 3\ns1\tx\tCDS\t50\t90\t.\t+\t0\tID=c;Alias=o_2\ns1\tx\tCDS\t1\t9\t.\t+\t0\tID=c;Alias=o_1;x=y\ns1\tx\tCDS\t20\t30\t.\t+\t0\tAlias=o_1\ns1\tx\tgene\t1\t30\t.\t+\t.\tAlias=o_9\ns1\tx\tCDS\t1\t3\t.\t+\t0\tAlias=;\n")
    features = formats.gff(spark, gff)
    order = formats.gene_order(features)
    assert [(r.ome, r.pos, r.gene, r["first"], r["last"]) for r in order.orderBy("pos").collect()] == [("o", 0, "o_1", 1, 30), ("o", 1, "o_2", 50, 90)]
    assert len(formats.with_features(order, features).where("gene = 'o_1'").first().cds) == 2
    fa = w("p.faa", ">a first one\nMKV\nLL\n>b\nMM\n")
    assert [(r.name, r.description, r.sequence) for r in formats.fasta(spark, fa).orderBy("name").collect()] == [("a", "first one", "MKVLL"), ("b", "", "MM")]
    line = lambda gene, pf, e, a, b: f"{gene} - 100 nm_{pf} {pf}.3 200 {e} 50.0 0 1 1 1e-5 {e} 50 0 {a} {b} 5 90 1 99 0.9 text\n"
    dom = w("d.txt", "# comment\n" + line("g1", "PF00001", "1e-9", 1, 180) + line("g1", "PF00002", "1e-4", 1, 150) + line("g1", "PF00003", "1", 1, 190) + line("g2", "PF00001", "1e-9", 1, 40))
    rows = formats.domains(spark, dom, 1e-3, 0.5).orderBy("pfam").collect()
    assert [(r.gene, r.pfam) for r in rows] == [("g1", "PF00001"), ("g1", "PF00002")] and formats.domains(spark, dom, 1e-3, 0.5, 1).count() == 1
    terms = w("o.obo", "format: 1\n\n[Term]\nid: GO:1\nis_a: GO:2 ! x\nis_a: GO:3\n\n[Term]\nid: GO:2\nis_a: GO:4\n\n[Typedef]\nid: r\nis_a: GO:9\n")
    up = {(r.term, r.ancestor) for r in statistics.ancestors(formats.obo(spark, terms)).collect()}
    assert up == {("GO:1", "GO:2"), ("GO:1", "GO:3"), ("GO:1", "GO:4"), ("GO:2", "GO:4")}
    p2g = w("p2g", "!x\nPfam:PF00001 7tm > GO:G protein ; GO:0004930\n")
    assert [tuple(r) for r in formats.pfam2go(spark, p2g).collect()] == [("PF00001", "G protein", "GO:0004930")]
    assert sorted(tuple(r) for r in formats.partition_file(spark, w("part", "#one\na b\nc\n#two\nd\n")).collect()) == [("one", "a"), ("one", "b"), ("one", "c"), ("two", "d")]
    assert [tuple(r) for r in formats.rules(spark, w("rules", "(A|B);C\tX\n")).orderBy("clause", "term").collect()] == [("X", 0, "A"), ("X", 0, "B"), ("X", 1, "C")]
    tune = formats.tunes(spark, w("tune", 'k\t"3,1 3"\ta b\n')).first()
    assert (tune.hgs, tune.omes, tune.false_omes) == ([1, 3], ["a", "b"], [])
    named = formats.tunes(spark, w("named", "k\t3,g1,g2,g9\ta\n"), spark.createDataFrame([("g1", 7), ("g2", 5), ("g9", None)], "gene string, hg int")).first()
    assert named.hgs == [3, 5, 7]
    with pytest.raises(Exception, match="fewer than 5"):
        formats.genomes(spark, w("meta", "only\ttwo\n")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([([1, 2], 1, 0, 0.5, 0.1, 0.2, 40.0, 80.0, ["a", "b"]), ([3], 2, 0, 0.9, 0.1, 0.2, 40.0, None, ["a"])], "hgs array<int>, hlg int, hlc int, nrm_log_tmd double, pds double, gcl double, mmi double, mmp double, omes array<string>")
    sinks.families(df, f"{tmp_path}/f")
    rows = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/f").collect()
    assert [r.hlg for r in rows] == ["2", "1"] and {r.hlg: r.csb for r in rows} == {"1": "50.0", "2": "na"}
    one = spark.createDataFrame([(1, "s_0", [1, None], ["g1", "g2"], [7])], "ome int, name string, hgs array<int>, genes array<string>, families array<int>")
    sinks.loci(one, f"{tmp_path}/l")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/l").first().hgs == "1,"
    sinks.fasta(spark.createDataFrame([(1, "g", "MK")], "hlg int, name string, sequence string"), f"{tmp_path}/fa")
    assert spark.read.text(f"{tmp_path}/fa/hlg=1").count() == 2


def test_stream(spark, tmp_path, on_tree):
    from weftline.streaming import ingest

    rows = [(i, 0, p, f"{i}_{p}", h) for i in range(4) for p, h in enumerate([1, 2, 3])]
    t = tree.tree_frame(spark, []).select("node", "parent", "length", F.col("tip").cast("long").alias("tip"))
    t = t.unionAll(spark.createDataFrame([(0, None, 0.0, None), *[(i + 1, 0, 1.0, i) for i in range(4)]], t.schema))
    closure = tree.closure(t)
    stats = tree.node_stats(t, closure)
    schema = "ome long, scaffold int, pos int, gene string, hg int"
    for k in range(2):
        spark.createDataFrame([r for r in rows if r[0] // 2 == k], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        ingest.ingest_pairs(stream, stats, closure, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {(r.hg0, r.hg1): (r.n_omes, r.tmd) for r in ingest.pair_distances(spark, f"{tmp_path}/out").collect()}
    assert got == {p: (4, 4.0) for p in ((1, 2), (1, 3), (2, 3))}


def test_run(spark, tmp_path):
    from weftline.plans.pipeline import Run, Settings, stage_key

    r = random.Random(8)
    rows = []
    for ome in range(6):
        block = [[1, 2, 3, 4], [11, 12, 13]]
        for scaffold, own in enumerate(block):
            track = [r.randrange(50, 400) for _ in range(12)] + own + [r.randrange(50, 400) for _ in range(12)]
            rows += [(ome, scaffold, p, f"{ome}_{scaffold}_{p}", h) for p, h in enumerate(track)]
    g = spark.createDataFrame(rows, "ome long, scaffold int, pos int, gene string, hg int")
    genomes = spark.createDataFrame([(i, f"sp{i}", "p") for i in range(6)], "ome long, species string, phylum string")
    t = spark.createDataFrame([(0, None, 0.0, None), (1, 0, 1.0, None), (2, 0, 1.0, None), *[(3 + i, 1 + i // 3, 1.0, i) for i in range(6)]], "node long, parent long, length double, tip long")
    same = g.alias("a").join(g.alias("b"), "hg").where("a.gene <> b.gene").select(F.col("a.gene").alias("q"), F.col("b.gene").alias("s"), F.lit(80.0).alias("ppos"), F.lit(60.0).alias("pident"))
    s = Settings(rank="phylum", samples=200, pair_percentile=0.2, set_percentile=0.61, least_identity=30.0, least_locus_weight=0.1)
    run = Run(g, genomes, t, same, str(tmp_path), s)
    found = run.clusters().collect()
    assert any(set(x.hgs) >= {1, 2, 3, 4} and len(x.omes) == 6 for x in found) and any(set(x.hgs) >= {11, 12, 13} for x in found)
    assert all(x.mmi == 60 and x.pds == 0 for x in found)
    run.outputs(f"{tmp_path}/results")
    again = {r.hlg: r for r in formats.families(spark, f"{tmp_path}/results/hlgs", f"{tmp_path}/results/gcfs").collect()}
    assert {(tuple(r.hgs), tuple(r.omes)) for r in again.values()} == {(tuple(x.hgs), tuple(map(str, x.omes))) for x in run.scores().collect()}
    held = formats.loci(spark, f"{tmp_path}/results/loci").collect()
    assert {r.ome for r in held} == set(range(6)) and all(len(r.hgs) == len(r.genes) >= 2 for r in held)
    assert {tuple(h for h in r.hgs if h in (1, 2, 3, 4)) for r in held if 1 in r.hgs} == {(1, 2, 3, 4)}
    assert stage_key(s, "families") == stage_key(Settings(**{**s.__dict__, "tmd": 0.5}), "families") != stage_key(Settings(**{**s.__dict__, "coefficient": "jaccard"}), "families")
    with pytest.raises(ValueError):
        Settings(max_distance=True, unique_species=True)
