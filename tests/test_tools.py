"""The commands on a run's results."""

from weftline.plans import tools
from weftline.sources import formats, sinks


def test_commands(spark, tmp_path):
    results, out = f"{tmp_path}/results", f"{tmp_path}/out"
    families = [([1, 2], 1, 0, 0.2, 0.5, 0.9, 40.0, 80.0, ["o", "p"]), ([3], 2, 0, 0.9, 0.5, 0.4, 40.0, None, ["p"])]
    df = spark.createDataFrame(families, "hgs array<int>, hlg long, hlc long, nrm_log_tmd double, pds double, gcl double, mmi double, mmp double, omes array<string>")
    sinks.family_store(df, f"{results}/store")
    loci = [("o", "s_0", [1, 2, None], ["g1", "g2", "g3"], [1]), ("p", "s_0", [1, 2, 3], ["h1", "h2", "h3"], [1, 2]), ("p", "s_1", [3, 3], ["h4", "h5"], [2])]
    sinks.loci(spark.createDataFrame(loci, "ome string, name string, hgs array<int>, genes array<string>, families array<long>"), f"{results}/loci")

    tools.main(["rethreshold", "--results", results, "--out", f"{out}/again", "--gcl", "50"])
    assert [r.hlg for r in formats.families(spark, f"{out}/again/gcfs").collect()] == [1]
    assert sorted((r.ome, r.name, r.families) for r in formats.loci(spark, f"{out}/again/loci").collect()) == [("o", "s_0", [1]), ("p", "s_0", [1])]

    line = lambda gene, pf: f"{gene} - 100 nm_{pf} {pf}.3 200 1e-9 50.0 0 1 1 1e-5 1e-9 50 0 1 180 5 90 1 99 0.9 text\n"
    (tmp_path / "domains").write_text(line("g1", "PF00001") + line("g3", "PF00002") + line("h4", "PF00001") + line("h5", "PF00009"))
    (tmp_path / "rules").write_text("PF00001;PF00002\tboth\n")
    for extract in ([], ["--extract"]):
        tools.main(["annotate", "--results", results, "--domains", f"{tmp_path}/domains", "--rules", f"{tmp_path}/rules", "--out", f"{out}/named{len(extract)}", *extract])
    assert {(r.ome, r.name) for r in formats.loci(spark, f"{out}/named0/loci").collect()} == {("o", "s_0_both"), ("p", "s_0"), ("p", "s_1")}
    assert {(r.ome, r.name) for r in formats.loci(spark, f"{out}/named1/loci").collect()} == {("o", "s_0_both")}
    genes = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/named0/genes").collect()
    assert {(r.gene, r.annotation) for r in genes} == {("g1", "both"), ("g3", "both"), ("h4", "both"), ("h5", "PF00009")}

    tools.main(["network", "--results", results, "--out", f"{out}/net"])
    edges = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/net/edges").collect()
    assert {(int(r.a), int(r.b), int(r.w)) for r in edges} == {(1, 2, 2), (1, 3, 1), (2, 3, 1)}
    row = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/net/summary").first()
    assert (row.n_nodes, row.n_edges, round(float(row.weighted_transitivity), 6)) == ("3", "3", 1.2)
