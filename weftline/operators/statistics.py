"""Per-genome and per-taxon statistics, enrichment, annotation and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.frames import dealt, known, once
from weftline.functions.scalars import lower_median_index


def shannon(terms: DataFrame, by: str, term: str) -> DataFrame:
    """by, shannon: entropy, in nats, of the terms of each group."""
    counts = terms.where(F.col(term).isNotNull()).groupBy(by, term).agg(F.count("*").alias("k"))
    # -sum(p ln p) = ln(n) - sum(k ln k) / n, so one more aggregation does.
    sums = counts.groupBy(by).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.ln("k")).alias("s"))
    return sums.select(by, (F.ln("n") - F.col("s") / F.col("n")).alias("shannon"))


def genome_stats(genes: DataFrame, loci: DataFrame) -> DataFrame:
    """ome, n_genes, n_clustered, clustered (share), n_loci, mean_genes. loci: (ome, n), n being a locus's genes."""
    whole = genes.groupBy("ome").agg(F.count("*").alias("n_genes"))
    own = loci.groupBy("ome").agg(F.sum("n").alias("n_clustered"), F.count("*").alias("n_loci"), F.avg("n").alias("mean_genes"))
    rows = whole.join(own, "ome", "left").fillna(0, ["n_clustered", "n_loci"])
    return rows.withColumn("clustered", F.col("n_clustered") / F.col("n_genes"))


def taxon_means(measures: DataFrame, taxa: DataFrame, columns: Sequence[str]) -> DataFrame:
    """taxon and the mean of each measure over its genomes. taxa: (ome, taxon)."""
    return measures.join(taxa, "ome").groupBy("taxon").agg(F.count("*").alias("n_omes"), *[F.avg(c).alias(c) for c in columns])


def lower_medians(measures: DataFrame, taxa: DataFrame, columns: Sequence[str], whole: bool = True) -> DataFrame:
    """taxon and the lower median of each measure over its genomes; an index of -1 takes the last, as a list's does."""
    rows = measures.join(taxa, "ome").select("taxon", F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns])).alias("m")).select("taxon", "m.*").where("value is not null")
    order = Window.partitionBy("taxon", "measure").orderBy("value")
    ranked = rows.withColumns({"at": (F.row_number().over(order) - 1).cast("long"), "n": F.count("*").over(Window.partitionBy("taxon", "measure"))})
    place = lower_median_index(F.col("n"), whole)
    return ranked.where(F.col("at") == F.when(place < 0, F.col("n") - 1).otherwise(place)).groupBy("taxon").pivot("measure", list(columns)).agg(F.first("value"))


def alien_index(algn: DataFrame, taxa: DataFrame, floor: float = 1e-3) -> DataFrame:
    """taxon, alienness: the mean over its genes of ln(best identity inside the taxon) - ln(best outside); sides without
    a hit count as ``floor``, and genes without either don't count."""
    own = taxa.select(F.col("ome").alias("q_ome"), "taxon")
    other = taxa.select(F.col("ome").alias("s_ome"), F.col("taxon").alias("s_taxon"))
    best = algn.join(own, "q_ome").join(other, "s_ome").groupBy("taxon", "q").agg(*[F.max(F.when(test, F.col("pident"))).alias(c) for c, test in (("inside", F.col("taxon") == F.col("s_taxon")), ("outside", F.col("taxon") != F.col("s_taxon")))])
    log = lambda c: F.ln(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(floor)))
    return best.groupBy("taxon").agg(F.avg(log("inside") - log("outside")).alias("alienness"))


def log_factorial(n: Column) -> Column:
    """ln n!: a table up to 15, Stirling's series beyond."""
    table, total = [0.0], 0.0
    import math

    for i in range(1, 16):
        total += math.log(i)
        table.append(total)
    small = F.get(F.array(*[F.lit(x) for x in table]), n.cast("int"))
    x = n.cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n < 16, small).otherwise(series)


def upper_tail(k: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """P(X >= k) for the marked among ``drawn`` of ``total`` without replacement.

    The first term comes from logarithms of factorials, the others from their ratios.
    """
    choose = lambda n, r: log_factorial(n) - log_factorial(r) - log_factorial(n - r)
    top = F.least(marked, drawn)
    low = F.greatest(k, drawn + marked - total, F.lit(0))
    first = F.exp(choose(marked, low) + choose(total - marked, drawn - low) - choose(total, drawn))
    step = lambda s, i: F.struct((s["p"] * (marked - i) * (drawn - i) / ((i + 1) * (total - marked - drawn + i + 1))).alias("p"), (s["sum"] + s["p"] * (marked - i) * (drawn - i) / ((i + 1) * (total - marked - drawn + i + 1))).alias("sum"))
    rest = F.aggregate(F.when(top > low, F.sequence(low, top - 1)).otherwise(F.array().cast("array<bigint>")), F.struct(first.alias("p"), first.alias("sum")), step, lambda s: s["sum"])
    return F.when(k > top, 0.0).when(low <= F.greatest(drawn + marked - total, F.lit(0)), 1.0).otherwise(F.least(rest, F.lit(1.0)))


def enrichment(rows: DataFrame, background: Column, foreground: Column, alpha: float = 0.05) -> DataFrame:
    """taxon, term, k_background, k, p, significant, background and foreground shares of each term.

    rows: (taxon, term, ...), a row a gene; foreground genes are background genes too. A term is significant at
    ``alpha`` over the number of its taxon's terms.
    """
    fore = background & foreground
    terms = rows.groupBy("taxon", "term").agg(F.count_if(background).alias("k_background"), F.count_if(fore).alias("k"))
    sums = terms.groupBy("taxon").agg(F.sum("k_background").alias("n_background"), F.sum("k").alias("n"))
    tested = terms.where("k_background > 0")
    tests = tested.groupBy("taxon").agg(F.count("*").alias("tests"))
    joined = tested.join(sums, "taxon").join(tests, "taxon")
    p = upper_tail(F.col("k"), F.col("n_background"), F.col("k_background"), F.col("n"))
    return joined.withColumn("p", p).select("taxon", "term", "k_background", "k", (F.col("k_background") / F.col("n_background")).alias("background"), F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0).alias("foreground"), "p", (F.col("p") <= F.lit(alpha) / F.col("tests")).alias("significant"))


def best_terms(hits: DataFrame, by: Sequence[str], term: str, score: str, most: int = 1) -> DataFrame:
    """Each group's ``most`` terms of the highest score, a term once, ties by term: by, term, score, rank."""
    best = hits.where(F.col(term).isNotNull()).groupBy(*by, term).agg(F.max(score).alias(score))
    order = Window.partitionBy(*by).orderBy(F.desc(score), term)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def concatenated(hits: DataFrame, locus: str, gene: str, term: str) -> DataFrame:
    """locus, terms: the distinct terms of each gene joined by |, genes in order joined by ;."""
    by_gene = hits.groupBy(locus, gene).agg(F.array_join(F.array_sort(F.collect_set(term)), "|").alias("t"))
    return by_gene.groupBy(locus).agg(F.array_sort(F.collect_list(F.struct(gene, "t"))).alias("g")).select(locus, F.array_join(F.col("g.t"), ";").alias("terms"))


def rule_labels(terms: DataFrame, rules: DataFrame, locus: str, rows: int | None = None) -> DataFrame:
    """locus, labels ($ between them): rules all of whose clauses have a term in the locus.

    terms: (locus, term), of about ``rows`` rows (counted, if not given); rules: (label, clause, term), terms of a clause being
    alternatives. All groups of a locus's rows are made in the task of bounded rows that holds it.
    """
    terms = terms.select(locus, "term").where("term is not null")
    own = dealt(terms, terms.count() if rows is None else rows, locus).distinct()
    clauses = known(rules.select("label", "clause", "term").distinct())
    needed = known(rules.groupBy("label").agg(F.count_distinct("clause").alias("needed")))
    met = own.join(clauses, "term").select(locus, "label", "clause").distinct().groupBy(locus, "label").agg(F.count("clause").alias("n"))
    met = met.join(needed, "label").where("n = needed")
    return met.groupBy(locus).agg(F.array_join(F.array_sort(F.collect_set("label")), "$").alias("labels"))


def renamed_terms(terms: DataFrame, rules: DataFrame) -> DataFrame:
    """Terms (locus, term and others) with name: the label of a rule that knows the term (of several, the first), or the term itself."""
    known = rules.groupBy("term").agg(F.min("label").alias("_label"))
    return terms.join(known, "term", "left").withColumn("name", F.coalesce("_label", "term")).drop("_label")


def labelled(loci: DataFrame, labels: DataFrame, locus: str, name: str = "name", extract: bool = False) -> DataFrame:
    """Loci with their labels behind their names, after a _; ``extract``: those with labels only. labels: what ``rule_labels`` returns."""
    met = loci.join(labels, locus, "inner" if extract else "left")
    return met.withColumn(name, F.concat_ws("_", name, "labels")).drop("labels")


def contrasts(rows: DataFrame, terms: DataFrame, alpha: float = 0.05) -> DataFrame:
    """taxon, contrast, term, clusters, k_background, k, p, significant of terms in clustered genes against all genes (total) and
    against those of families (family), each against the other as well (family against total).

    rows: (taxon, gene, family, cluster), a row a gene, null for none; terms: (gene, term). clusters: distinct clusters with the term,
    beside the number of genes, on which the test is made.
    """
    return term_contrasts(rows, rows.join(terms.distinct(), "gene"), alpha)


def term_contrasts(rows: DataFrame, named: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``contrasts`` of rows whose terms are known: named has ``rows`` with a term, a row for each.

    A gene's rows come together once, with what each contrast asks of it, so all contrasts count genes in one pass, and clusters and families in
    another.
    """
    family, cluster = F.col("family").isNotNull(), F.col("cluster").isNotNull()
    kinds = {"cluster_total": (F.lit(True), cluster), "cluster_family": (family, cluster), "family_total": (F.lit(True), family)}
    asked = [F.bool_or(test).alias(f"{c}_{side}") for c, (back, fore) in kinds.items() for side, test in (("back", back), ("fore", back & fore))]
    sides = [F.count_if(f"{c}_{side}").alias(f"{c}_{side}") for c in kinds for side in ("back", "fore")]
    genes = named.where("gene is not null").groupBy("gene", "taxon", "term").agg(*asked).groupBy("taxon", "term").agg(*sides)
    kept = F.array(F.struct(F.lit("cluster").alias("kind"), F.col("cluster").cast("string").alias("value"), family.alias("both")), F.struct(F.lit("family").alias("kind"), F.col("family").cast("string").alias("value"), F.lit(True).alias("both")))
    groups = named.select("taxon", "term", F.explode(kept).alias("g")).where("g.value is not null").groupBy("taxon", "term", F.col("g.kind").alias("kind"), F.col("g.value").alias("value")).agg(F.bool_or("g.both").alias("both"))
    own = {"cluster_total": F.col("kind") == "cluster", "cluster_family": (F.col("kind") == "cluster") & F.col("both"), "family_total": F.col("kind") == "family"}
    groups = groups.groupBy("taxon", "term").agg(*[F.count_if(test).alias(f"{c}_groups") for c, test in own.items()])
    names = [f"{c}_{x}" for c in kinds for x in ("back", "fore", "groups")]
    wide = genes.unionByName(groups, allowMissingColumns=True).groupBy("taxon", "term").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    sizes = rows.where("gene is not null").groupBy("gene", "taxon").agg(*asked).groupBy("taxon").agg(*[s.alias(f"n_{c}_{side}") for s, (c, side) in zip(sides, ((c, side) for c in kinds for side in ("back", "fore")), strict=True)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("contrast"), *[F.col(n).alias(as_) for n, as_ in ((f"{c}_groups", "clusters"), (f"{c}_back", "k_background"), (f"{c}_fore", "k"), (f"n_{c}_back", "n_background"), (f"n_{c}_fore", "n"))]) for c in kinds])).alias("e")
    met = wide.join(sizes, "taxon").select("taxon", "term", each).select("taxon", "term", "e.*").where("k_background > 0")
    met = met.withColumn("tests", F.count("*").over(Window.partitionBy("taxon", "contrast"))).withColumn("p", upper_tail(F.col("k"), F.col("n_background"), F.col("k_background"), F.col("n")))
    return met.select("taxon", "contrast", "term", "clusters", "k_background", "k", "p", (F.col("p") <= F.lit(alpha) / F.col("tests")).alias("significant"))


def ancestors(edges: DataFrame, max_depth: int = 100) -> DataFrame:
    """(term, ancestor) of an is-a relation (child, parent), a term not being its own; cycles end by themselves."""
    edges = once(edges.where("child is not null and parent is not null").distinct())
    known = new = once(edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor")))
    for _ in range(max_depth):
        step = new.join(edges.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("term", F.col("parent").alias("ancestor")).distinct()
        new = once(step.join(known, ["term", "ancestor"], "left_anti"))
        if new.isEmpty():
            return known.where("term <> ancestor")
        known = once(known.unionAll(new))
    raise ValueError(f"terms lie more than {max_depth} levels apart")


def pair_counts(locus_groups: DataFrame) -> DataFrame:
    """ome, hg0, hg1, n: how often two different groups stand in one locus; repeats in a locus count. (ome, locus, hg)."""
    groups = locus_groups.where("hg is not null").groupBy("ome", "locus", "hg").agg(F.count("*").alias("k"))
    other = groups.select("ome", "locus", F.col("hg").alias("hg1"), F.col("k").alias("k1"))
    met = groups.withColumnRenamed("hg", "hg0").join(other, ["ome", "locus"]).where("hg0 < hg1")
    return met.groupBy("ome", "hg0", "hg1").agg(F.sum(F.col("k") * F.col("k1")).alias("n"))


def species_averages(counts: DataFrame, species: DataFrame) -> DataFrame:
    """hg0, hg1, w: counts averaged over each species' genomes, rounded up (ties to even), summed over species."""
    sizes = species.groupBy("species").agg(F.count("*").alias("genomes"))
    sums = counts.join(species, "ome").groupBy("species", "hg0", "hg1").agg(F.sum("n").alias("n")).join(sizes, "species")
    return sums.groupBy("hg0", "hg1").agg(F.sum(F.bround(F.col("n") / F.col("genomes") + 0.5).cast("long")).alias("w"))


def presence(members: DataFrame, columns: Sequence, row: str = "ome", column: str = "family") -> DataFrame:
    """A row for each genome, a 0/1 column for each family of the given list."""
    return members.groupBy(row).pivot(column, list(columns)).agg(F.lit(1)).fillna(0)
