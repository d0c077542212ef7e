"""Hits of genes: the hits source, best hits, annotation, reports, metadata joins, taxonomy rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import append_attributes, gff_escape, gff_id, without_extensions

TEXT_FIELDS = "query_id unit_id unit_label call_type element_symbol gene_symbol allele_symbol gene_group family type_name subtype class_name subclass".split()
HIT_SCHEMA = "hits array<struct<" + ",".join(f"{f}:string" for f in TEXT_FIELDS) + ",call_fraction:double,first_pass_distinct:bigint,first_pass_diagnostic_total:bigint>>"


def hits_from_json(documents: DataFrame, column: str = "json") -> DataFrame:
    """One row for each hit with a query id, ``ord`` its place; malformed documents have none. Missing texts are '', numbers 0."""
    parsed = documents.select(F.from_json(column, HIT_SCHEMA).alias("d")).select(F.posexplode("d.hits").alias("ord", "h"))
    texts = [F.coalesce(F.col(f"h.{f}"), F.lit("")).alias(f) for f in TEXT_FIELDS if f not in ("gene_group", "family")]
    group = F.coalesce(F.nullif(F.col("h.gene_group"), F.lit("")), F.col("h.family"), F.lit("")).alias("gene_group")
    numbers = [F.coalesce(F.col("h.call_fraction"), F.lit(0.0)).alias("call_fraction"), *(F.coalesce(F.col(f"h.{f}"), F.lit(0)).alias(f) for f in ("first_pass_distinct", "first_pass_diagnostic_total"))]
    return parsed.select("ord", *texts, group, *numbers).where("query_id <> ''")


def best_hits(hits: DataFrame, query: str = "query_id", call_type: str = "call_type", fraction: str = "call_fraction", matched: str = "first_pass_distinct", order: str = "ord") -> DataFrame:
    """Of each query's hits the best: genes before groups, then the larger fraction (to a millionth), more matches, the first seen."""
    w = Window.partitionBy(query).orderBy(F.desc(F.col(call_type) == "gene"), F.desc(F.round(F.col(fraction) * 1_000_000)), F.desc(matched), F.asc(order))
    return hits.withColumn("best_", F.row_number().over(w)).where("best_ = 1").drop("best_")


def above_thresholds(hits: DataFrame, least_gene: float = 0.1, least_group: float = 0.1) -> DataFrame:
    return hits.where(F.col("call_fraction") >= F.when(F.col("call_type") == "gene", least_gene).otherwise(least_group))


def diagnostic_hits(kmers: DataFrame, index: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, unit_id, matched, total, call_fraction): distinct diagnostic k-mers of a unit (index: kmer, unit_id) that a query has."""
    from ..plans.tables import checked_broadcast

    total = index.groupBy("unit_id").agg(F.countDistinct("kmer").alias("total"))
    # only k-mers that the index has are shuffled
    found = kmers.select(query, "kmer").join(checked_broadcast(index.select("kmer", "unit_id").distinct()), "kmer").distinct().groupBy(query, "unit_id").agg(F.count("*").alias("matched"))
    return found.join(total, "unit_id").select(query, "unit_id", "matched", "total", (F.col("matched") / F.col("total")).alias("call_fraction"))


def annotation_text(prefix: str = "") -> Column:
    c = lambda name: gff_escape(F.coalesce(F.col(prefix + name), F.lit("")))
    return F.concat(
        F.lit("Name="), c("unit_label"), F.lit(";amr_unit_id="), c("unit_id"), F.lit(";amr_unit_label="), c("unit_label"), F.lit(";amr_call_type="), c("call_type"), F.lit(";amr_element_symbol="), c("element_symbol"),
        F.lit(";amr_gene_symbol="), c("gene_symbol"), F.lit(";amr_allele_symbol="), c("allele_symbol"), F.lit(";amr_gene_group="), c("gene_group"), F.lit(";amr_category="), c("type_name"), F.lit(";amr_subtype="), c("subtype"),
        F.lit(";amr_class="), c("class_name"), F.lit(";amr_subclass="), c("subclass"), F.lit(";amr_call_fraction="), F.format_string("%.4f", F.col(prefix + "call_fraction")),
        F.lit(";amr_diagnostic_kmers="), F.col(prefix + "first_pass_distinct").cast("string"), F.lit("/"), F.col(prefix + "first_pass_diagnostic_total").cast("string"))


def annotated_gff(lines: DataFrame, best: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with the attributes of CDS features extended by their best hit. Comments, lines without nine columns and other features pass as they are."""
    parts = F.split(line, "\t")
    is_cds = ~F.col(line).startswith("#") & (F.size(parts) == 9) & (F.get(parts, F.lit(2)) == "CDS")
    keyed = lines.withColumn("gene_", F.when(is_cds, gff_id(F.get(parts, F.lit(8)))))
    text = best.select(F.col("query_id").alias("gene_"), annotation_text().alias("added_"))
    joined = keyed.join(text, "gene_", "left")
    new = F.concat_ws("\t", F.slice(parts, 1, 8), append_attributes(F.get(parts, F.lit(8)), F.col("added_")))
    return joined.withColumn(line, F.when(F.col("added_").isNotNull(), new).otherwise(F.col(line))).select(*lines.columns)


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last."""
    return rows.withColumn("last_", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("last_ = 1").drop("last_")


def hits_with_genes(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Hits with their gene's contig, start, end and strand as text, '' where there is none."""
    g = genes.select(F.col("gene_id").alias("query_id"), "contig", F.col("start").cast("string").alias("gene_start"), F.col("end").cast("string").alias("gene_end"), F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(".").alias("strand"))
    return hits.join(g, "query_id", "left").na.fill("", ["contig", "gene_start", "gene_end", "strand"])


def with_first_metadata(samples: DataFrame, metadata: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """Samples with date and location of the first metadata row whose id is the sample's name, with or without its extensions.

    Either key is tried as an equi-join; a disjunctive condition would compare all pairs.
    """
    keys = samples.select(name).distinct().withColumn("id", F.explode(F.array_distinct(F.array(F.col(name), without_extensions(F.col(name))))))
    found = keys.join(metadata, "id").withColumn("first_", F.row_number().over(Window.partitionBy(name).orderBy(order))).where("first_ = 1").select(name, "date", "location")
    return samples.join(found, name, "left")


def compact_taxa(rows: DataFrame, sample: str = "sample") -> DataFrame:
    """One row for each sample from (sample, rank, ord, species, cluster_id): the first-ranked one, with ties at rank 1 named by their species, their genus or neither."""
    genus = F.element_at(F.split(F.trim("species"), r"\s+"), 1)
    ties = rows.where("rank = 1").groupBy(sample).agg(F.count("*").alias("n_ties"), F.countDistinct("species").alias("n_species"), F.countDistinct(F.nullif(genus, F.lit(""))).alias("n_genera"), F.min(F.nullif(genus, F.lit(""))).alias("genus"), F.array_sort(F.collect_list(F.struct("ord", "cluster_id"))).alias("ids_"))
    first = rows.withColumn("f_", F.row_number().over(Window.partitionBy(sample).orderBy(F.when(F.col("rank") == 1, 0).otherwise(1), "ord"))).where("f_ = 1")
    label = F.when(F.coalesce("n_ties", F.lit(0)) <= 1, F.col("species")).when(F.col("n_species") == 1, F.col("species")).when(F.col("n_genera") == 1, F.concat("genus", F.lit(" spp."))).otherwise("Unknown (tie)")
    ids = F.when(F.coalesce("n_ties", F.lit(0)) <= 1, F.col("cluster_id")).otherwise(F.array_join(F.filter(F.transform("ids_", lambda x: x["cluster_id"]), lambda c: c != ""), ", "))
    return first.join(ties, sample, "left").select(sample, "rank", label.alias("species"), ids.alias("cluster_ids"))


def composition_percentages(text: Column) -> Column:
    """'name (count);...' with each count's share; the text itself if an entry cannot be read or all counts are 0."""
    entries = F.transform(F.split(text, ";"), lambda e: F.struct(F.trim(F.regexp_extract(F.trim(e), r"^(.*)\s+\((\d+)\)$", 1)).alias("name"), F.regexp_extract(F.trim(e), r"^(.*)\s+\((\d+)\)$", 2).alias("n")))
    total = F.aggregate(entries, F.lit(0).cast("long"), lambda s, e: s + F.coalesce(e["n"].try_cast("bigint"), F.lit(0)))
    shown = F.array_join(F.transform(entries, lambda e: F.concat(e["name"], F.lit(" ("), e["n"], F.lit("; "), F.round(e["n"].try_cast("double") / total * 100, 1).cast("decimal(20,1)").cast("string"), F.lit("%)"))), " ; ")
    return F.when(F.exists(entries, lambda e: e["n"] == "") | (total == 0), text).otherwise(shown)


def metadata_parts(text: Column) -> list[Column]:
    """species, cluster and composition of 'species|cluster|composition', trimmed, '' where missing."""
    parts = F.split(text, r"\|")
    return [F.coalesce(F.trim(F.get(parts, F.lit(i))), F.lit("")) for i in range(3)]


def confidence_class(ani: Column) -> Column:
    percent = ani * 100
    return F.when(percent <= 80.95, "low").when(percent <= 87.19, "medium").otherwise("high")


def unit_calls(kmers: DataFrame, index: DataFrame, query: str = "query_id", least_gene: float = 0.1, least_group: float = 0.1) -> DataFrame:
    """(query, call_type, name, matched, total, call_fraction): genes and, rolled up, their groups whose share of diagnostic k-mers is large enough.

    ``index`` is (kmer, unit_id, gene_group). A k-mer of several genes of a group counts once for the group. The queries' k-mers are read once for both levels.
    """
    level = lambda kind, name: F.struct(F.lit(kind).alias("call_type"), F.col(name).cast("string").alias("name"))
    both = index.select("kmer", F.explode(F.array(level("gene", "unit_id"), level("gene_group", "gene_group"))).alias("unit_id")).distinct()
    found = diagnostic_hits(kmers, both, query).select(query, "unit_id.call_type", "unit_id.name", "matched", "total", "call_fraction")
    return above_thresholds(found, least_gene, least_group)


def call_totals(genes: DataFrame, contigs: DataFrame, contig: str = "contig") -> DataFrame:
    """(gene_count, sequence_count): genes on the contigs that were analysed, and those contigs, with genes or without."""
    per = genes.groupBy(contig).agg(F.count("*").alias("n_"))
    return contigs.select(contig).distinct().join(per, contig, "left").agg(F.coalesce(F.sum("n_"), F.lit(0)).alias("gene_count"), F.count("*").alias("sequence_count"))


def upserted(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` and those of ``held`` whose key ``new`` has not."""
    return held.join(new.select(key), key, "left_anti").select(*held.columns).unionByName(new.select(*held.columns))
