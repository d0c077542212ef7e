"""More registered queries: read quality, repeats, sketches of samples, calls, result reports, orders of batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence, vectors
from ..operators import clusters, genes, hits, kmers
from ..operators import vectors as vec
from ..sources import fastq_splits, fastx, tabular
from . import queries as core
from .queries import query
from .tables import new_path, ranked, table

# --- reads and k-mers --------------------------------------------------------------------------------------------------

_READ_K, _LEAST = 5, 20
#: Reads with qualities: of digits and letters a to f, Phred 15 to 24 and 64 to 69.
_READS = "r AS (SELECT p_partkey, translate(md5(p_name || p_partkey), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq, md5('q' || p_partkey) AS qual FROM part)"
_WINDOWS = f"w AS (SELECT substr(seq, i::INTEGER, {_READ_K}) AS kmer, [ascii(substr(qual, (i + j)::INTEGER, 1)) - 33 for j in range({_READ_K})] AS q FROM (SELECT seq, qual, unnest(range(1, length(seq) - {_READ_K - 2})) AS i FROM r))"


@query(f"""WITH {_READS}, {_WINDOWS} SELECT 0 AS mode, kmer, count(*) AS n FROM w GROUP BY kmer UNION ALL SELECT 1, kmer, count(*) FROM w WHERE q[{_READ_K // 2 + 1}] >= {_LEAST} GROUP BY kmer
UNION ALL SELECT 2, kmer, count(*) FROM w WHERE list_min(q) >= {_LEAST} GROUP BY kmer""")
def quality_kmers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    reads = p.select(F.translate(F.md5(F.concat("p_name", "p_partkey")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"), F.md5(F.concat(F.lit("q"), "p_partkey")).alias("qual"))
    modes = [kmers.quality_kmers(reads, "seq", "qual", _READ_K, _LEAST, m).groupBy("kmer").agg(F.count("*").alias("n")).select(F.lit(m).alias("mode"), "kmer", "n") for m in (0, 1, 2)]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


@query("SELECT 'c' || conv_id || ':' || turn AS header, upper(md5(coalesce(text, ''))) AS seq, reverse(md5(coalesce(text, ''))) AS qual FROM conversations")
def fastx_file_scan(spark, sf_dir):
    """Reads written as FASTQ files and read back in splits."""
    path, code = new_path(spark, "reads"), F.md5(F.coalesce("text", F.lit("")))
    reads = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn").alias("header"), F.upper(code).alias("seq"), F.reverse(code).alias("qual"))
    fastx.write_reads(reads, path, "none")
    return fastq_splits.read_fastq(spark, path).select("header", "seq", "qual")


@query(f"""WITH {core._COLUMNS}, m AS (SELECT item_id, i, substr(mapped, i::INTEGER, 1) AS c FROM c) SELECT item_id % 7 AS sample, string_agg(CASE WHEN c IN ('', '-') THEN '-' ELSE c END, '' ORDER BY item_id, i) AS aligned FROM m GROUP BY 1""")
def mapped_alignment(spark, sf_dir):
    """Chromosomes of a sample one after another; each item is a chromosome of one of seven samples."""
    pairs = core._aligned_pairs(spark, sf_dir).select((F.col("item_id") % 7).alias("sample"), F.col("item_id").alias("chrom"), "reference", "mapped")
    letters = pairs.select("sample", "chrom", F.posexplode(F.split(F.col("mapped").substr(F.lit(1), F.length("reference")), "")).alias("pos", "mapped")).where("mapped <> '-'").withColumn("pos", F.col("pos").cast("long"))
    return kmers.sample_alignment(letters, pairs.select("chrom", F.col("reference").alias("seq"), "sample"), "sample", "chrom", "seq")


_MASK_K = 11


@query(f"""WITH k AS ({core._kmers_sql('benchmark', 'item_id', _MASK_K)}), c AS (SELECT DISTINCT item_id, pos + j AS pos FROM (SELECT item_id, pos, unnest(range({_MASK_K})) AS j FROM k WHERE kmer IN (SELECT kmer FROM k GROUP BY kmer HAVING count(*) > 1))),
l AS (SELECT item_id, i - 1 AS pos, substr(text, i::INTEGER, 1) AS c FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark))
SELECT l.item_id, string_agg(CASE WHEN c.pos IS NULL THEN l.c ELSE 'N' END, '' ORDER BY l.pos) AS masked FROM l LEFT JOIN c ON c.item_id = l.item_id AND c.pos = l.pos GROUP BY l.item_id""")
def repeat_mask(spark, sf_dir):
    return kmers.repeats_masked(table(spark, sf_dir, "benchmark"), "item_id", "text", _MASK_K)


@query(f"""WITH d AS (SELECT source, text FROM documents WHERE ('0x' || substr(md5('7:' || doc_id), 1, 8))::BIGINT < floor(0.5 * 4294967296)), c AS (SELECT source, kmer FROM ({core._kmers_sql('d', 'source', core.SKETCH_K)}) GROUP BY ALL HAVING count(*) >= 5)
SELECT source, md5(kmer) AS hash FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(kmer)) <= {core.SKETCH}""")
def sample_sketches(spark, sf_dir):
    """Half of the reads, k-mers seen five times or more."""
    reads = vec.subsample(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", 0.5, seed=7)
    return kmers.sample_sketches(reads, "source", "text", core.SKETCH_K, core.SKETCH, 5)


@query(f"""WITH q AS ({core._sketch_sql('benchmark', 'item_id')}), d AS ({core._sketch_sql('documents', 'doc_id')})
SELECT item_id, doc_id, count(*) AS shared, round(count(*) / any_value(n), 9) AS containment FROM q JOIN d USING (hash) JOIN (SELECT item_id, count(*) AS n FROM q GROUP BY 1) USING (item_id) GROUP BY item_id, doc_id""")
def sketch_containment(spark, sf_dir):
    q = kmers.sketches(table(spark, sf_dir, "benchmark"), "item_id", "text", core.SKETCH_K, core.SKETCH)
    d = kmers.sketches(table(spark, sf_dir, "documents"), "doc_id", "text", core.SKETCH_K, core.SKETCH)
    return kmers.containment(q, d, "item_id", "doc_id")


# --- calls -------------------------------------------------------------------------------------------------------------


@query(f"""WITH k AS ({core._kmers_sql('benchmark', 'item_id', 23)}), u AS (SELECT DISTINCT 'gene' AS call_type, item_id::VARCHAR AS name, kmer FROM k UNION ALL SELECT DISTINCT 'gene_group', (item_id % 5)::VARCHAR, kmer FROM k),
t AS (SELECT call_type, name, count(*) AS total FROM u GROUP BY ALL), q AS (SELECT DISTINCT doc_id, kmer FROM ({core._kmers_sql('documents', 'doc_id', 23)}))
SELECT doc_id, call_type, name, count(*) AS matched, total, round(count(*) / total, 9) AS call_fraction FROM q JOIN u USING (kmer) JOIN t USING (call_type, name) GROUP BY doc_id, call_type, name, total HAVING count(*) / total >= CASE WHEN call_type = 'gene' THEN 0.1 ELSE 0.05 END""")
def unit_calls(spark, sf_dir):
    unit = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("unit_id"), (F.col("item_id") % 5).alias("gene_group"), "text")
    index = kmers.kmers(unit, "text", 23)
    own = kmers.kmers_in(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 23, index)
    return hits.unit_calls(own, index, "doc_id", 0.1, 0.05).withColumn("call_fraction", F.round("call_fraction", 9))


@query("SELECT count(l_orderkey) AS gene_count, count(DISTINCT o_orderkey) AS sequence_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'")
def call_totals(spark, sf_dir):
    contigs = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("contig"))
    return hits.call_totals(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("contig")), contigs)


@query("SELECT doc_id, coalesce(length(text), 0) AS n, 'skipped: ' || coalesce(length(text), 0) || ' of at least 96 letters' AS warning FROM documents WHERE coalesce(length(text), 0) < 96")
def skipped_contigs(spark, sf_dir):
    return genes.skipped_contigs(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


_LAST = "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE {} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"
_HELD, _NEW = _LAST.format("o_orderkey % 3 > 0"), _LAST.format("o_orderkey % 3 = 0")


@query(f"WITH h AS ({_HELD}), n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT * FROM h WHERE o_custkey NOT IN (SELECT o_custkey FROM n)")
def upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    last = lambda rows: hits.last_per_key(rows, "o_custkey", "at").select("o_custkey", "o_orderkey", "o_totalprice")
    return hits.upserted(last(o.where("o_orderkey % 3 > 0")), last(o.where("o_orderkey % 3 = 0")), "o_custkey")


# --- reports -----------------------------------------------------------------------------------------------------------


@query("""SELECT vec_id::VARCHAR AS "Sample", (1 + vec_id % 3)::VARCHAR AS "Rank", 'G sp' || label AS "Species", printf('%.2f', (0.75 + label / 40.0) * 100) AS "ANI (%)", 'G sp' || label AS "Species (metadata)", CASE WHEN vec_id % 2 = 0 THEN 'c' || label ELSE '' END AS "Gemsparcl ID",
CASE WHEN vec_id % 2 = 0 THEN 'G sp (1)' ELSE '' END AS "GTDB species composition" FROM embeddings""")
def taxonomy_report(spark, sf_dir):
    e, species = table(spark, sf_dir, "embeddings"), F.concat(F.lit("G sp"), "label")
    metadata = F.when(F.col("vec_id") % 2 == 0, F.concat(species, F.lit(" | c"), "label", F.lit("|G sp (1) "))).otherwise(species)
    return tabular.taxonomy_report(e.select(F.col("vec_id").alias("sample"), (1 + F.col("vec_id") % 3).alias("rank"), species.alias("species"), (0.75 + F.col("label") / 40.0).alias("ani"), metadata.alias("metadata")))


@query(f"WITH {core._SAMPLES} SELECT name AS \"Sample\", cluster AS \"Cluster\" FROM s ORDER BY 2, 1")
def cluster_report(spark, sf_dir):
    return tabular.cluster_report(core._samples(spark, sf_dir))


_DIMS = 64
_SEVEN = "printf('%.6e', {}::DOUBLE)::DOUBLE AS {}"


@query(f"SELECT vec_id AS protein_id, (label * 150)::VARCHAR AS length, CASE WHEN label * 150 > 1022 THEN 'true' ELSE 'false' END AS truncated, {_SEVEN.format('embedding[1] * 1000', 'umap_1')}, {_SEVEN.format('embedding[2] / 100000', 'umap_2')}, " + ", ".join(_SEVEN.format(f"embedding[{i + 1}]", f"dim_{i}") for i in range(_DIMS)) + " FROM embeddings")
def embedding_report(spark, sf_dir):
    """Its numbers are read back from their text, since the last digit of ties depends on the formatter."""
    n = F.col("label") * 150
    coords = F.array(F.col("embedding")[0] * 1000, F.col("embedding")[1] / 100_000)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), n.alias("length"), (n > sequence.MAX_RESIDUES).alias("truncated"), coords.alias("coords"), F.col("embedding").alias("v"))
    return tabular.embedding_report(rows, _DIMS).withColumns({c: F.col(c).cast("double") for c in ("umap_1", "umap_2", *(f"dim_{i}" for i in range(_DIMS)))})


@query("""SELECT 'S' || chr(9) || item_id || chr(9) || length(text) || chr(9) || text AS value FROM benchmark UNION ALL SELECT 'E' || chr(9) || '*' || chr(9) || a.item_id || '+' || chr(9) || b.item_id || '+' || chr(9) || (length(a.text) - 10) || chr(9) || length(a.text) || '$' || chr(9) || '0' || chr(9) || '10' || CASE WHEN length(b.text) = 10 THEN '$' ELSE '' END || chr(9) || '10M'
FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1""")
def assembly_graph2(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    known = b.select((F.col("item_id") - 1).alias("source"))
    edges = b.select(F.col("item_id").alias("source")).join(known, "source").select("source", (F.col("source") + 1).alias("target"), F.lit(10).alias("overlap"))
    return tabular.graph2_text(edges, b.select(F.col("item_id").alias("name"), F.col("text").alias("contig")))


@query("SELECT doc_id, to_json({'id': doc_id, 'lang': lang, 'n': n_chars}) AS json FROM documents WHERE lang IS NOT NULL")
def results_json(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    return d.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "lang", F.col("n_chars").alias("n"))).alias("json"))


# --- vectors and batches -----------------------------------------------------------------------------------------------


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v) SELECT vec_id, round(CASE WHEN n > 0 THEN v[1] / n ELSE v[1] END, 6) AS first, round(CASE WHEN n > 0 THEN v[64] / n ELSE v[64] END, 6) AS last FROM n")
def l2_normalised(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", vectors.normalised(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


@query(f"WITH p AS ({core.ORACLES['batch_plan']}), b AS (SELECT count(*) AS n FROM p GROUP BY padded, batch_no) SELECT min(n) AS batch_min, max(n) AS batch_max FROM b")
def batch_bounds(spark, sf_dir):
    return vec.batch_bounds(core.batch_plan(spark, sf_dir), "padded", "batch_no")


@query(f"WITH p AS ({core.ORACLES['batch_plan']}) SELECT doc_id, padded, cap, batch_no, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM p")
def input_order(spark, sf_dir):
    return vec.in_input_order(core.batch_plan(spark, sf_dir), "doc_id")


@query("SELECT vec_id, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) AS place FROM embeddings")
def seeded_shuffle(spark, sf_dir):
    return vec.seeded_shuffle(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")


@query(f"WITH c AS ({core.ORACLES['cluster_timeline']}) SELECT *, row_number() OVER (ORDER BY cluster, date) AS place FROM c")
def sorted_timeline(spark, sf_dir):
    return ranked(clusters.timeline(core._samples(spark, sf_dir)), "place", "cluster", "date")
