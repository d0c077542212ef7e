"""Tables as text: sample metadata, corpus lists, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import to_precision
from ..operators.hits import hits_with_genes, metadata_parts
from ..plans.tables import ranked

# Headings of the report of hits, by the field they show, in their order; behind them, of hits in contigs or of hits in genes.
REPORT = {
    "sample": "Sample", "database_version": "Database version", "index_alphabet": "Index alphabet", "index_k": "Index k", "query_id": "Query", "unit_id": "Unit ID", "unit_label": "Unit label",
    "call_type": "Call", "type_name": "Category", "subtype": "Subtype", "element_symbol": "Element symbol", "gene_symbol": "Gene symbol", "allele_symbol": "Allele symbol",
    "gene_group": "Gene group", "hierarchy_node": "Hierarchy node", "class_name": "Class", "subclass": "Subclass", "call_fraction": "Call fraction",
    "first_pass_distinct": "Diagnostic k-mers matched", "first_pass_diagnostic_total": "Diagnostic k-mers total",
}
PLACES = {"start": "Start", "end": "End", "member_count": "Member count"}
GENE_PLACES = {"contig": "Contig", "gene_start": "Gene start", "gene_end": "Gene end", "strand": "Strand", "start": "Match start in query", "end": "Match end in query", "member_count": "Member count"}
DATE = r"^\d{4}-\d{2}-\d{2}$"


def metadata_rows(texts: DataFrame, text: str = "text") -> DataFrame:
    """(ord, id, date, location) of metadata texts: a header with id, date and location in any order and case, then rows.

    Fields are cut at commas as they stand. Rows without an id are left out. All dates that are not of the form
    yyyy-mm-dd are reported together; line numbers are those of the text. Fails on fewer than two lines and on missing columns.
    """
    numbered = texts.select(F.filter(F.transform(F.split(text, r"\r?\n"), lambda line, i: F.struct((i + 1).alias("no"), line.alias("line"))), lambda x: F.trim(x["line"]) != "").alias("l"))
    header = F.transform(F.split(F.col("l")[0]["line"], ","), lambda c: F.lower(F.trim(c)))
    at = numbered.select("l", header.alias("h"), *(F.array_position(header, n).alias(f"at_{n}") for n in ("id", "date", "location")))
    bad = F.when(F.size("l") < 2, F.lit("metadata: a header and a row are needed")).when((F.col("at_id") == 0) | (F.col("at_date") == 0) | (F.col("at_location") == 0), F.lit("metadata: id, date and location are needed"))
    field = lambda f, n: F.coalesce(F.trim(F.get(f, (F.col(f"at_{n}") - 1).cast("int"))), F.lit(""))
    rows = F.transform(F.slice("l", 2, 1 << 30), lambda x: F.struct(x["no"].alias("ord"), *(field(F.split(x["line"], ","), n).alias(n) for n in ("id", "date", "location"))))
    kept = at.select(F.filter(F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(rows), lambda r: r["id"] != "").alias("r"))
    wrong = F.filter("r", lambda r: (r["date"] != "") & ~r["date"].rlike(DATE))
    told = F.array_join(F.transform(wrong, lambda r: F.concat(F.lit("line "), r["ord"].cast("string"), F.lit(": date "), r["date"])), "; ")
    return kept.select(F.explode(F.when(F.size(wrong) > 0, F.raise_error(told)).otherwise(F.col("r"))).alias("r")).select(F.col("r.ord").cast("long").alias("ord"), "r.id", "r.date", "r.location")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return metadata_rows(spark.read.text(path, wholetext=True), "value")


def read_corpus_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, label) of a tab-separated list; '#' begins a comment line; relative paths are taken from the list's folder."""
    rows = spark.read.option("sep", "\t").option("comment", "#").schema("path string, label string").csv(path)
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    return rows.where(F.trim("path") != "").select(F.when(F.col("path").rlike(r"^(?:/|\w+:)"), F.trim("path")).otherwise(F.concat(F.lit(f"{folder}/"), F.trim("path"))).alias("path"), F.coalesce(F.trim("label"), F.lit("")).alias("label"))


def hit_report(hits: DataFrame, places: dict[str, str] = PLACES) -> DataFrame:
    """A report of hits as text under its headings: fractions with four decimals, nothing for null; fields that the hits lack are ''."""
    text = lambda c: F.format_string("%.4f", F.col(c)) if c == "call_fraction" else F.col(c).cast("string")
    return hits.select(*((F.coalesce(F.when(F.col(c).isNotNull(), text(c)), F.lit("")) if c in hits.columns else F.lit("")).alias(heading) for c, heading in (REPORT | places).items()))


def gene_report(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """The report of hits in genes, with each gene's contig, start, end and strand (see ``hits.hits_with_genes``)."""
    return hit_report(hits_with_genes(hits, genes), GENE_PLACES)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def embedding_columns(id_col: str, vec: str, dim: int) -> list[Column]:
    return [F.col(id_col), *(F.col(vec)[i].alias(f"dim_{i}") for i in range(dim))]


def distance_lines(distances: DataFrame, value: str = "snp_distance") -> DataFrame:
    """(place, value): lines of a table of distances, comma-separated: the samples, then a line for each with its distance to every one.

    From (a, b, distance) of each pair a < b; a sample's distance to itself is 0. A line holds one number for each sample.
    """
    one = distances.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col(value).cast("string").alias("d"))
    names = one.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    full = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).unionByName(names.select("a", F.col("a").alias("b"), F.lit("0").alias("d")))
    row = F.array_sort(F.collect_list(F.struct("b", "d")))
    lines = full.groupBy("a").agg(row.alias("r_")).select("a", F.concat_ws(",", "a", F.transform("r_", lambda x: x["d"])).alias("value"))
    header = names.agg(F.concat_ws(",", F.lit(""), F.array_sort(F.collect_list("a"))).alias("value")).select(F.lit(0).cast("long").alias("place"), "value")
    return header.unionByName(ranked(lines, "place", "a").select("place", "value"))


def newick(edges: DataFrame) -> str:
    """The tree of ``trees.neighbour_joining`` (parent, child, name, length) in Newick form: one text with every sample, put together on the driver."""
    rows = edges.collect()
    below: dict[int, list] = {}
    for r in rows:
        below.setdefault(r["parent"], []).append(r)
    roots = set(below) - {r["child"] for r in rows}
    if not roots:
        return ";"
    # children before parents, without recursion, as a tree can be as deep as it has samples
    order, text = [roots.pop()], {}
    for node in order:
        order += [r["child"] for r in below.get(node, ())]
    for node in reversed(order):
        parts = [f"{text.pop(r['child'], None) or _quoted(r['name'])}:{r['length']:g}" for r in sorted(below.get(node, ()), key=lambda r: r["child"])]
        if parts:
            text[node] = f"({','.join(parts)})"
    return text[order[0]] + ";"


def _quoted(name) -> str:
    name = str(name)
    return name if name and not set(name) & set(" ()[]:;,'\t\n") else "'" + name.replace("'", "''") + "'"


def graph_text(edges: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """(value): lines of a GFA file, a segment for each contig and a link for each edge (source, target, overlap)."""
    links = edges.select(F.concat_ws("\t", F.lit("L"), F.col("source").cast("string"), F.lit("+"), F.col("target").cast("string"), F.lit("+"), F.concat(F.col("overlap").cast("string"), F.lit("M"))).alias("value"))
    if contigs is None:
        return links
    return contigs.select(F.concat_ws("\t", F.lit("S"), F.col("name").cast("string"), "contig").alias("value")).unionByName(links)


def dot_text(edges: DataFrame) -> DataFrame:
    """(value): one line of a DOT graph for each edge."""
    return edges.select(F.concat(F.lit('  "'), F.col("source").cast("string"), F.lit('" -> "'), F.col("target").cast("string"), F.lit('";')).alias("value"))


# The columns of the taxonomy report.
TAXONOMY = ("Sample", "Rank", "Species", "ANI (%)", "Species (metadata)", "Gemsparcl ID", "GTDB species composition")


def taxonomy_report(candidates: DataFrame) -> DataFrame:
    """The taxonomy report, one row for each candidate (sample, rank, species, ani, metadata): ANI in per cent with two decimals, metadata in its parts."""
    values = (F.col("sample").cast("string"), F.col("rank").cast("string"), F.col("species"), F.format_string("%.2f", F.col("ani") * 100), *metadata_parts(F.col("metadata")))
    return candidates.select(*(v.alias(name) for v, name in zip(values, TAXONOMY, strict=True)))


def cluster_report(samples: DataFrame) -> DataFrame:
    """(Sample, Cluster), sorted by cluster and then by sample."""
    return samples.select(F.col("name").alias("Sample"), F.col("cluster").alias("Cluster")).orderBy("Cluster", "Sample")


def embedding_report(rows: DataFrame, dim: int) -> DataFrame:
    """protein_id, length, truncated, umap_1, umap_2 and dim_0 to the last from (id, length, truncated, coords, v), numbers in seven digits."""
    named = [("umap_1", F.col("coords")[0]), ("umap_2", F.col("coords")[1]), *((f"dim_{i}", F.col("v")[i]) for i in range(dim))]
    return rows.select(F.col("id").alias("protein_id"), F.col("length").cast("string").alias("length"), F.col("truncated").cast("string").alias("truncated"), *(to_precision(v).alias(n) for n, v in named))


def graph2_text(edges: DataFrame, contigs: DataFrame) -> DataFrame:
    """(value): lines of a GFA 2 file: a segment for each contig (name, contig), an edge for each (source, target, overlap) of whole ends."""
    size = contigs.select(F.col("name").alias("source"), F.length("contig").alias("n_"))
    text = lambda *c: F.concat_ws("\t", *c)
    end = lambda c, at: F.concat(c.cast("string"), F.when(c == at, "$").otherwise(""))
    segments = contigs.select(text(F.lit("S"), F.col("name").cast("string"), F.length("contig").cast("string"), "contig").alias("value"))
    to = size.select(F.col("source").alias("target"), F.col("n_").alias("m_"))
    links = edges.join(size, "source").join(to, "target").select(text(
        F.lit("E"), F.lit("*"), F.concat(F.col("source").cast("string"), F.lit("+")), F.concat(F.col("target").cast("string"), F.lit("+")), (F.col("n_") - F.col("overlap")).cast("string"), F.concat(F.col("n_").cast("string"), F.lit("$")),
        F.lit("0"), end(F.col("overlap"), F.col("m_")), F.concat(F.col("overlap").cast("string"), F.lit("M"))).alias("value"))
    return segments.unionByName(links)
