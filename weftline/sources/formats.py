"""Readers of the domain's text formats, as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import genome_of, items

GFF = "seqid string, source string, type string, first long, last long, score string, strand string, phase string, attributes string"


def gff(spark: SparkSession, path: str) -> DataFrame:
    """Features of GFF3 files, with the file's name as ome unless a gene's alias names it."""
    rows = spark.read.schema(GFF).option("sep", "\t").option("comment", "#").csv(path)
    return rows.withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.gff3?)?(\.gz)?$", 1))


def gene_order(features: DataFrame) -> DataFrame:
    """ome, scaffold, pos, gene, first, last: coding genes by their smallest coordinate on each scaffold.

    A gene is the alias of its CDS rows; rows without one are left out. Ties go by the gene's name.
    """
    alias = F.regexp_extract("attributes", r"(?:^|;)Alias=([^;]*)", 1)
    cds = features.where("type = 'CDS'").withColumn("gene", alias).where("gene <> ''")
    ends = cds.groupBy(F.col("seqid").alias("scaffold"), "gene").agg(F.min(F.least("first", "last")).alias("first"), F.max(F.greatest("first", "last")).alias("last"))
    named = ends.withColumn("ome", genome_of(F.col("gene")))
    pos = F.row_number().over(Window.partitionBy("ome", "scaffold").orderBy("first", "gene")) - 1
    return named.select("ome", "scaffold", pos.alias("pos"), "gene", "first", "last")


def with_features(order: DataFrame, features: DataFrame) -> DataFrame:
    """Each gene with the rows of its coding sequence."""
    alias = F.regexp_extract("attributes", r"(?:^|;)Alias=([^;]*)", 1)
    cds = features.where("type = 'CDS'").select(alias.alias("gene"), F.struct("seqid", "first", "last", "strand", "phase").alias("cds"))
    return order.join(cds.groupBy("gene").agg(F.array_sort(F.collect_list("cds")).alias("cds")), "gene")


def with_groups(genes: DataFrame, groups: DataFrame) -> DataFrame:
    """Genes with their group; null for a gene of none. groups: (gene, hg)."""
    return genes.join(groups, "gene", "left")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, description, sequence of FASTA records; records are cut at their headers, not at lines."""
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", r"^>", "")).where("trim(value) <> ''")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_extract(head, r"^\S*\s*(.*)$", 1)).alias("description"), body.alias("sequence"))


def newick(text: str) -> list[tuple[int, int | None, float, str | None]]:
    """(node, parent, length, tip name) of a tree in Newick form; the root is node 0. A tree is a dimension: it is read
    on the driver, and its rows go to a frame."""
    rows: list[list] = [[0, None, 0.0, None]]
    at, inner = 0, {0}
    for token in re.findall(r"'[^']*'|[^\s(),:;]+|[(),:;]", re.sub(r"\[[^\]]*\]", "", text)):
        if token == "(":
            inner.add(at)
            rows.append([len(rows), at, 0.0, None])
            at = len(rows) - 1
        elif token == ",":
            rows.append([len(rows), rows[at][1], 0.0, None])
            at = len(rows) - 1
        elif token == ")":
            if rows[at][1] is None:
                raise ValueError("a bracket closes that wasn't opened")
            at = rows[at][1]
        elif token == ";":
            break
        elif token == ":":
            rows[at].append("length")
        elif rows[at][-1] == "length":
            rows[at].pop()
            rows[at][2] = float(token)
        else:
            rows[at][3] = token.strip("'")
    if at:
        raise ValueError("a bracket isn't closed")
    return [(n, p, length, None if n in inner else name) for n, p, length, name in rows]


def pruned(rows: list[tuple], keep: set[str]) -> list[tuple]:
    """The tree of some tips: other branches go, and nodes with one child are merged into it."""
    below: dict = {}
    for n, p, length, name in rows:
        below.setdefault(p, []).append((n, length, name))

    def cut(n, length, name):
        children = [c for c in (cut(*c) for c in below.get(n, [])) if c]
        if not below.get(n):
            return (length, name, []) if name in keep else None
        if not children:
            return None
        return (children[0][0] + length, *children[0][1:]) if len(children) == 1 else (length, None, children)

    out: list[tuple] = []

    def number(node, parent):
        n = len(out)
        out.append((n, parent, node[0] if parent is not None else 0.0, node[1]))
        for child in node[2]:
            number(child, n)

    if top := cut(*below[None][0]):
        number(top, None)
    return out


def rooted(rows: list[tuple], tips: set[str]) -> list[tuple]:
    """The tree rooted above the smallest clade that holds all of some tips (above the tip itself, if there is one)."""
    parent = {n: p for n, p, _, _ in rows}
    paths = []
    for n, _, _, name in rows:
        if name in tips:
            path = [n]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            paths.append(path[::-1])
    if not paths:
        raise ValueError("the tree has none of the tips to root on")
    top = [level[0] for level in zip(*paths) if len(set(level)) == 1][-1]
    if parent[top] is None:
        return rows
    near: dict[int, list[tuple[int, float]]] = {}
    for n, p, length, _ in rows:
        if p is not None:
            near.setdefault(n, []).append((p, length))
            near.setdefault(p, []).append((n, length))
    names = {n: name for n, _, _, name in rows}
    up = parent[top]
    whole = next(length for n, length in near[up] if n == top)
    out: list[tuple] = [(0, None, 0.0, None)]
    stack = [(top, up, 0, whole / 2), (up, top, 0, whole / 2)]
    while stack:
        n, before, above, length = stack.pop()
        me = len(out)
        out.append((me, above, length, names[n]))
        stack += [(m, n, me, d) for m, d in near[n] if m != before]
    kept = {name for *_, name in out if name}
    return pruned(out, kept)


def alignments(spark: SparkSession, path: str, positives: bool = True) -> DataFrame:
    """q, s, ppos, pident of tab-separated alignments; ppos is null without positives."""
    columns = "q string, s string, ppos double, pident double" if positives else "q string, s string, pident double"
    rows = spark.read.schema(columns).option("sep", "\t").option("comment", "#").csv(path)
    return (rows if positives else rows.withColumn("ppos", F.lit(None).cast("double"))).select("q", "s", "ppos", "pident")


def identities(algn: DataFrame, genes: DataFrame, least: float = 30.0) -> DataFrame:
    """q, s, identity (share) of pairs of given genes, the best of each; self-hits and those below ``least`` are left out."""
    rows = algn.where((F.col("q") != F.col("s")) & (F.col("pident") >= least))
    for end in ("q", "s"):
        rows = rows.join(genes.select(F.col("gene").alias(end)).distinct(), end, "left_semi")
    return rows.groupBy("q", "s").agg((F.max("pident") / 100).alias("identity"))


def domains(spark: SparkSession, path: str, evalue: float = 1e-3, coverage: float = 0.5, most: int = 0) -> DataFrame:
    """gene, pfam, name, coverage, evalue, score, first, last of a domain table in fixed columns of white space.

    Coverage is the aligned share of the model; both bounds are strict. most: hits a gene, by e-value; 0: all.
    """
    columns = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("not value like '#%' and trim(value) <> ''").select(columns.alias("c")).where("size(c) >= 22")
    number = lambda i, kind="double": F.try_element_at("c", F.lit(i + 1)).try_cast(kind)
    text = lambda i: F.element_at("c", i + 1)
    share = (number(16) - number(15)) / number(5)
    found = rows.select(text(0).alias("gene"), F.regexp_extract(text(4), r"^(PF\d+|[^.]*)", 1).alias("pfam"), text(3).alias("name"), share.alias("coverage"), number(6).alias("evalue"), number(7).alias("score"), number(17, "long").alias("first"), number(18, "long").alias("last"))
    found = found.where((F.col("coverage") > coverage) & (F.col("evalue") < evalue))
    best = Window.partitionBy("gene", "pfam").orderBy("evalue", F.desc("score"), "first")
    found = found.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    if most:
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("gene").orderBy("evalue", F.desc("score"), "pfam"))).where(F.col("r") <= most).drop("r")
    return found


def obo(spark: SparkSession, path: str) -> DataFrame:
    """child, parent of the is_a lines of an ontology's terms."""
    terms = spark.read.option("lineSep", "\n\n").text(path).where("value rlike '(?m)^\\\\[Term\\\\]'")
    parents = F.regexp_extract_all("value", F.lit(r"(?m)^is_a:\s*(\S+)"), F.lit(1))
    return terms.select(F.regexp_extract("value", r"(?m)^id:\s*(\S+)", 1).alias("child"), F.explode(parents).alias("parent"))


def pfam2go(spark: SparkSession, path: str) -> DataFrame:
    """pfam, label, go of a mapping's lines."""
    part = lambda pattern: F.regexp_extract("value", pattern, 1)
    return spark.read.text(path).select(part(r"(PF\d+)").alias("pfam"), part(r"> GO:(.*?) ; GO:\d+").alias("label"), part(r"; (GO:\d+)").alias("go")).where("pfam <> '' and go <> ''")


def partition_file(spark: SparkSession, path: str) -> DataFrame:
    """lineage, ome: headers of the form #lineage, then genomes, as many a line as there are."""
    blocks = spark.read.option("lineSep", "#").text(path).where("trim(value) <> ''")
    names = F.split(F.trim(F.regexp_replace("value", r"^[^\r\n]*", "")), r"\s+")
    return blocks.select(F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1)).alias("lineage"), F.explode(names).alias("ome")).where("ome <> ''")


def tunes(spark: SparkSession, path: str, genes: DataFrame | None = None) -> DataFrame:
    """name, hgs, omes, false_omes of known clusters. With ``genes`` (gene, hg), genes' names stand for their groups."""
    rows = spark.read.schema("name string, hgs string, omes string, false_omes string").option("sep", "\t").option("comment", "#").csv(path)
    clean = lambda c: F.array_sort(F.array_distinct(items(F.coalesce(c, F.lit("")))))
    rows = rows.select("name", clean("hgs").alias("hgs"), clean("omes").alias("omes"), clean("false_omes").alias("false_omes"))
    if genes is not None:
        named = rows.select("name", F.explode("hgs").alias("gene")).join(genes.where("hg is not null").select("gene", "hg").distinct(), "gene")
        groups = named.groupBy("name").agg(F.collect_set(F.col("hg").cast("string")).alias("_found"))
        numbers = F.filter("hgs", lambda x: x.rlike(r"^\d+$"))
        rows = rows.join(groups, "name", "left").withColumn("hgs", F.array_union(numbers, F.coalesce("_found", F.array().cast("array<string>")))).drop("_found")
    return rows.withColumn("hgs", F.array_sort(F.col("hgs").cast("array<int>"))).select("name", "hgs", "omes", "false_omes")


def rules(spark: SparkSession, path: str) -> DataFrame:
    """label, clause, term of annotation rules: ; joins clauses, | alternatives; brackets aren't nested."""
    rows = spark.read.schema("expr string, label string").option("sep", "\t").option("comment", "#").csv(path)
    clauses = rows.select("label", F.posexplode(F.split(F.regexp_replace("expr", r"[()\s]", ""), ";")).alias("clause", "any"))
    return clauses.select("label", "clause", F.explode(F.split("any", r"\|")).alias("term")).where("term <> ''")


def genomes(spark: SparkSession, path: str) -> DataFrame:
    """genus, species, strain, assembly, gff of a table of genomes; rows with fewer columns raise an error."""
    rows = spark.read.text(path).where("not value like '#%' and trim(value) <> ''").select(F.split("value", "\t").alias("c"))
    whole = F.when(F.size("c") >= 5, F.col("c")).otherwise(F.raise_error(F.concat(F.lit("fewer than 5 columns: "), F.array_join("c", " "))))
    return rows.select(whole.alias("c")).select(*[F.col("c")[i].alias(n) for i, n in enumerate(("genus", "species", "strain", "assembly", "gff"))])


def seed_pairs(spark: SparkSession, path: str) -> DataFrame:
    """hg0, hg1 of a pair table."""
    rows = spark.read.option("sep", "\t").option("comment", "#").schema("hg0 int, hg1 int, n_omes long, score double").csv(path)
    return rows.select("hg0", "hg1")


#: Columns of result tables and their types; a table has those that its version knew.
RESULT = {"hgs": "array<int>", "hlg": "long", "hlc": "long", "nrm_log_tmd": "double", "pds": "double", "gcl": "double", "mmi": "double", "mmp": "double", "csb": "double", "apds": "double", "omes": "array<string>"}


def families(spark: SparkSession, *paths: str) -> DataFrame:
    """Result tables of families, of any version: columns are taken by name, those that a table lacks are null.

    csb is read as the share that it was before it was written as a percentage.
    """
    out = None
    for path in paths:
        rows = spark.read.option("sep", "\t").option("header", True).csv(path)
        one = lambda c: F.when(F.col(c) != "na", F.col(c))
        typed = [(F.when(F.coalesce(c, F.lit("")) == "", F.array()).otherwise(F.split(one(c), ",")) if kind.startswith("array") else one(c)).cast(kind).alias(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in RESULT.items()]
        rows = rows.select(*typed).withColumn("csb", F.col("csb") / 100)
        out = rows if out is None else out.unionByName(rows)
    return out


def loci(spark: SparkSession, path: str) -> DataFrame:
    """ome, name, hgs (null for genes of no group), genes, families of loci written in a folder for each genome."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    listed = lambda c: F.split(F.coalesce(c, F.lit("")), ",")
    hgs = F.transform(listed("hgs"), lambda h: F.when(h != "", h.cast("int")))
    return rows.select("ome", "name", hgs.alias("hgs"), listed("genes").alias("genes"), F.transform(F.filter(listed("families"), lambda x: x != ""), lambda x: x.cast("long")).alias("families"))


def edges(spark: SparkSession, path: str, loci_: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """i, j, weight of a table of locus similarities, of at least that weight and between given loci (locus)."""
    rows = spark.read.option("sep", "\t").schema("i long, j long, weight double").csv(path).where(F.col("weight") >= least)
    for end in ("i", "j") if loci_ is not None else ():
        rows = rows.join(loci_.select(F.col("locus").alias(end)), end, "left_semi")
    return rows.select("i", "j", "weight")


def sequence_counts(spark: SparkSession, path: str) -> DataFrame:
    """ome, n: records of FASTA files, named for their genomes."""
    return fasta_by_file(spark, path).groupBy("ome").agg(F.count("*").alias("n"))


def fasta_by_file(spark: SparkSession, path: str) -> DataFrame:
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?(\.gz)?$", 1)
    return spark.read.option("lineSep", "\n>").text(path).select("value", name.alias("ome")).where("trim(value) <> '' and trim(value) <> '>'")


def transcript_counts(features: DataFrame) -> DataFrame:
    """ome, n: distinct genes that coding features name."""
    return gene_order(features).groupBy("ome").agg(F.count_distinct("gene").alias("n"))
