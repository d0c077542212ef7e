"""The registered queries of the operators outside ``llm``, each with its DuckDB equivalent where SQL has one.

The driver's tables stand in for sequences: documents for reads, benchmark for the index and for aligned sequences,
conversations for sequence files, lineitem for hits and features, orders and customer for samples, embeddings for vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bins, sequence, vectors
from ..operators import assembly, clusters, counting, genecalls, genes, hits, intervals, kmers, layout, trees
from ..operators import vectors as vec
from ..sources import fastx, regions, tabular
from .tables import checked_broadcast, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- k-mers of documents and benchmark ---------------------------------------------------------------------------------

K, W, SKETCH_K, SKETCH = 31, 15, 17, 50


def _kmers_sql(of: str, id_: str, k: int) -> str:
    # texts are cut into blocks of 256 places first: reaching into a long text costs time in proportion to the place
    cut = f"SELECT {id_}, b, substr(text, (b * 256 + 1)::INTEGER, {255 + k}) AS piece FROM (SELECT {id_}, text, unnest(range(0, (length(text) - {k}) // 256 + 1)) AS b FROM {of} WHERE length(text) >= {k})"
    return f"SELECT {id_}, b * 256 + i - 1 AS pos, substr(piece, i::INTEGER, {k}) AS kmer FROM (SELECT {id_}, b, piece, unnest(range(1, length(piece) - {k - 2})) AS i FROM ({cut}))"


def _minimizers_sql(of: str, id_: str) -> str:
    return f"""SELECT DISTINCT {id_}, m.pos AS pos, m.kmer AS kmer FROM (
      SELECT {id_}, pos, n, min({{'h': md5(kmer), 'pos': pos, 'kmer': kmer}}) OVER (PARTITION BY {id_} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS m
      FROM (SELECT *, count(*) OVER (PARTITION BY {id_}) AS n FROM ({_kmers_sql(of, id_, K)}))) WHERE pos <= greatest(n - {W}, 0)"""


def _counts_sql(k: int) -> str:
    return f"counts AS (SELECT kmer, count(*) AS n FROM ({_kmers_sql('documents', 'doc_id', k)}) GROUP BY kmer)"


_COUNTS = _counts_sql(K)
_VERDICTS = f"""m AS ({_minimizers_sql('documents', 'doc_id')}), ix AS (SELECT DISTINCT kmer FROM ({_minimizers_sql('benchmark', 'item_id')})),
n AS (SELECT doc_id, count(*) AS n_minimizers, count(DISTINCT CASE WHEN kmer IN (SELECT kmer FROM ix) THEN kmer END) AS hits FROM m GROUP BY doc_id),
v AS (SELECT d.doc_id, length(d.text) AS bases, coalesce(n_minimizers, 0) AS n_minimizers, coalesce(hits, 0) AS hits, greatest(1, CASE WHEN coalesce(n_minimizers, 0) = 0 THEN 0 ELSE greatest(1, round(0.05 * n_minimizers)) END) AS need FROM documents d LEFT JOIN n USING (doc_id))"""
_DEPLETED = f"CASE WHEN bases < {K} THEN true ELSE hits < need END"


@query(f"WITH {_COUNTS} SELECT least(n, 500)::BIGINT AS multiplicity, count(*) AS n_kmers FROM counts GROUP BY 1")
def kmer_spectrum(spark, sf_dir):
    return kmers.spectrum_of(table(spark, sf_dir, "documents"), "text", K)


@query(f"WITH {_COUNTS} SELECT kmer, n FROM counts WHERE n >= 5")
def kmer_min_count(spark, sf_dir):
    return kmers.counts(table(spark, sf_dir, "documents"), "text", K, least=5)


@query(f"WITH {_COUNTS} SELECT kmer, n FROM counts WHERE n >= 5")
def kmer_min_count_bloom(spark, sf_dir):
    return counting.prefiltered_counts(table(spark, sf_dir, "documents"), "text", K)


@query(f"""WITH k AS (SELECT item_id, kmer, reverse(translate(upper(kmer), 'ACGTU', 'TGCAA')) AS rc FROM ({_kmers_sql("(SELECT item_id, translate(text, 'ßſı', '???') AS text FROM benchmark)", 'item_id', K)}))
SELECT item_id, count(*) AS n, count(DISTINCT least(kmer, rc)) AS n_distinct, md5(min(least(kmer, rc))) AS smallest FROM k GROUP BY item_id""")
def kmer_canonical(spark, sf_dir):
    k = kmers.kmers(table(spark, sf_dir, "benchmark").select("item_id", F.translate("text", "ßſı", "???").alias("text")), "text", K, both_strands=True)
    return k.groupBy("item_id").agg(F.count("*").alias("n"), F.countDistinct("kmer").alias("n_distinct"), F.md5(F.min("kmer")).alias("smallest"))


@query(f"""WITH {_COUNTS}, s AS (SELECT i AS multiplicity, coalesce(n_kmers, 0) AS n FROM (SELECT unnest(range(1, 501)) AS i) LEFT JOIN (SELECT least(n, 500) AS m, count(*) AS n_kmers FROM counts GROUP BY 1) ON i = m),
l AS (SELECT multiplicity, n, lag(n) OVER (ORDER BY multiplicity) AS b, lead(n) OVER (ORDER BY multiplicity) AS a FROM s)
SELECT coalesce(min(multiplicity), 1)::BIGINT AS min_count FROM l WHERE n <= b AND n <= a""")
def min_count_fit(spark, sf_dir):
    return kmers.fitted_min_count(kmers.spectrum_of(table(spark, sf_dir, "documents"), "text", K))


@query(f"SELECT doc_id, pos::BIGINT AS pos, md5(kmer) AS kmer FROM ({_minimizers_sql('documents', 'doc_id')})")
def minimizers(spark, sf_dir):
    return kmers.minimizers(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", K, W).select("doc_id", "pos", F.md5("kmer").alias("kmer"))


def _verdicts(spark: SparkSession, sf_dir: str, deplete: bool = True) -> DataFrame:
    index = kmers.minimizers(table(spark, sf_dir, "benchmark").select("text"), "text", K, W)
    return kmers.contained(table(spark, sf_dir, "documents"), index, "doc_id", "text", K, W, deplete=deplete)


@query(f"WITH {_VERDICTS} SELECT doc_id, n_minimizers, hits, {_DEPLETED} AS kept FROM v")
def host_depletion(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query(f"WITH {_VERDICTS} SELECT doc_id, n_minimizers, hits, CASE WHEN bases < {K} THEN false ELSE hits >= need END AS kept FROM v")
def host_search(spark, sf_dir):
    return _verdicts(spark, sf_dir, deplete=False)


@query(f"WITH {_VERDICTS} SELECT count(*) AS reads_in, count(*) FILTER ({_DEPLETED}) AS reads_out, sum(bases)::BIGINT AS bases_in, sum(CASE WHEN {_DEPLETED} THEN bases ELSE 0 END)::BIGINT AS bases_out FROM v")
def depletion_stats(spark, sf_dir):
    return kmers.filter_stats(_verdicts(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {_VERDICTS} SELECT source AS sample, count(*) AS total, count(*) FILTER ({_DEPLETED}) AS kept, count(*) - count(*) FILTER ({_DEPLETED}) AS removed FROM v JOIN documents USING (doc_id) GROUP BY source")
def paired_totals(spark, sf_dir):
    d = _verdicts(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return d.groupBy(F.col("source").alias("sample")).agg(F.count("*").alias("total"), F.count_if("kept").alias("kept"), (F.count("*") - F.count_if("kept")).alias("removed"))


def _sketch_sql(of: str, id_: str) -> str:
    return f"SELECT {id_}, hash FROM (SELECT {id_}, hash, row_number() OVER (PARTITION BY {id_} ORDER BY hash) AS r FROM (SELECT DISTINCT {id_}, md5(kmer) AS hash FROM ({_kmers_sql(of, id_, SKETCH_K)}))) WHERE r <= {SKETCH}"


@query(f"""WITH q AS ({_sketch_sql('benchmark', 'item_id')}), d AS ({_sketch_sql('documents', 'doc_id')}),
s AS (SELECT item_id, doc_id, count(*) AS shared FROM q JOIN d USING (hash) GROUP BY ALL),
j AS (SELECT s.*, shared / (nq + nr - shared) AS j FROM s JOIN (SELECT item_id, count(*) AS nq FROM q GROUP BY 1) USING (item_id) JOIN (SELECT doc_id, count(*) AS nr FROM d GROUP BY 1) USING (doc_id))
SELECT item_id, doc_id, shared, round(j, 9) AS jaccard, round(1 + ln(2 * j / (1 + j)) / {SKETCH_K}, 9) AS ani, rank() OVER (PARTITION BY item_id ORDER BY round(j, 9) DESC) AS rank FROM j QUALIFY rank <= 3""")
def sketch_jaccard_top3(spark, sf_dir):
    q = kmers.sketches(table(spark, sf_dir, "benchmark"), "item_id", "text", SKETCH_K, SKETCH)
    d = kmers.sketches(table(spark, sf_dir, "documents"), "doc_id", "text", SKETCH_K, SKETCH)
    return kmers.inverted_index_top(q, d, "item_id", "doc_id", SKETCH_K, SKETCH)


@query(f"WITH a AS ({_kmers_sql('documents', 'doc_id', K)}), b AS ({_kmers_sql('benchmark', 'item_id', K)}) SELECT md5(kmer) AS kmer FROM (SELECT kmer FROM a INTERSECT SELECT kmer FROM b)")
def exact_intersection(spark, sf_dir):
    b = kmers.kmers(table(spark, sf_dir, "benchmark").select("text"), "text", K)
    a = kmers.kmers_in(table(spark, sf_dir, "documents").select("text"), "text", K, b)
    # only k-mers that the smaller side has are shuffled
    return a.join(checked_broadcast(b.distinct()), "kmer", "left_semi").distinct().select(F.md5("kmer").alias("kmer"))


@query("SELECT doc_id, n_chars FROM documents WHERE ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT < (0.3 * 4294967296)::BIGINT")
def subsample_hash(spark, sf_dir):
    return vec.subsample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 0.3)


#: Length of the assembly's k-mers and the least number of times they stand in the documents.
ASSEMBLY_K, ASSEMBLY_COUNT = 21, 5
_ASSEMBLY = f"{_counts_sql(ASSEMBLY_K)}, c AS (SELECT kmer FROM counts WHERE n >= {ASSEMBLY_COUNT}), e AS (SELECT a.kmer AS source, b.kmer AS target FROM c a JOIN c b ON substr(a.kmer, 2) = substr(b.kmer, 1, {ASSEMBLY_K - 1}))"


@query(f"WITH {_ASSEMBLY} SELECT source, target FROM e")
def debruijn_edges(spark, sf_dir):
    return kmers.debruijn_edges(_assembly_kmers(spark, sf_dir))


def _assembly_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(kmers.counts(table(spark, sf_dir, "documents"), "text", ASSEMBLY_K, least=ASSEMBLY_COUNT), "kmers")


@query(f"""WITH {_ASSEMBLY}, i AS (SELECT target AS kmer, count(*) AS n_in FROM e GROUP BY target), o AS (SELECT source AS kmer, count(*) AS n_out FROM e GROUP BY source)
SELECT kmer, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM c LEFT JOIN i USING (kmer) LEFT JOIN o USING (kmer)""")
def debruijn_degree(spark, sf_dir):
    c = _assembly_kmers(spark, sf_dir)
    return kmers.debruijn_degrees(c, kmers.debruijn_edges(c))


@query()
def unitigs(spark, sf_dir):
    return kmers.unitigs(_assembly_kmers(spark, sf_dir))


@query()
def assembly_corrected(spark, sf_dir):
    return assembly.assemble(table(spark, sf_dir, "documents"), "text", ASSEMBLY_K)


_SPLIT = "SELECT {id}, pos + 15 AS pos, substr(kmer, 1, 15) || substr(kmer, 17, 15) AS flanks, substr(kmer, 16, 1) AS middle FROM ({k})"
_MAPPED = f"""r AS ({_SPLIT.format(id='item_id', k=_kmers_sql('benchmark', 'item_id', K))}), u AS (SELECT flanks, min(item_id) AS item_id, min(pos) AS pos, min(middle) AS ref FROM r GROUP BY flanks HAVING count(*) = 1),
s AS ({_SPLIT.format(id='doc_id', k=_kmers_sql('documents', 'doc_id', K))}),
h AS (SELECT doc_id, item_id, u.pos AS pos, ref, middle, count(*) AS n FROM s JOIN u USING (flanks) GROUP BY ALL),
m AS (SELECT doc_id, item_id, pos, ref, middle AS mapped FROM h QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, pos ORDER BY n DESC, middle) = 1)"""


_CHANGED = "(SELECT doc_id, replace(text, 'w', 'q') AS text FROM documents)"


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ref = table(spark, sf_dir, "benchmark")
    return kmers.map_to_reference(table(spark, sf_dir, "documents"), ref, "doc_id", "item_id", "text"), ref


@query(f"WITH {_MAPPED} SELECT doc_id, item_id, pos::BIGINT AS pos, ref, mapped FROM m")
def split_kmer_map(spark, sf_dir):
    return _mapped(spark, sf_dir)[0].select("doc_id", "item_id", "pos", "ref", "mapped")


@query(f"WITH {_MAPPED} SELECT doc_id, count(*) FILTER (mapped <> ref) AS nb_variants, round(count(*) / (SELECT sum(length(text)) FROM benchmark), 9) AS coverage FROM m GROUP BY doc_id")
def mapping_summary(spark, sf_dir):
    mapped, ref = _mapped(spark, sf_dir)
    return kmers.mapping_summary(mapped, ref, "doc_id", "item_id", "text")


@query(f"WITH {_MAPPED.replace('documents', _CHANGED)} SELECT item_id AS chrom, (pos + 1)::BIGINT AS pos, ref, mapped AS alt, doc_id FROM m WHERE mapped <> ref")
def vcf_rows(spark, sf_dir):
    """Samples are the documents with one letter for another, so that places between flanks without it are variants."""
    samples = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("w"), F.lit("q")).alias("text"))
    return kmers.vcf_rows(kmers.map_to_reference(samples, table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text"), "doc_id", "item_id")


@query(f"""WITH s AS ({_SPLIT.format(id='doc_id', k=_kmers_sql('documents', 'doc_id', K))}), o AS (SELECT flanks, doc_id, CASE WHEN min(middle) = max(middle) THEN min(middle) ELSE 'N' END AS base FROM s GROUP BY ALL)
SELECT md5(flanks) AS flanks, doc_id, base FROM o WHERE flanks IN (SELECT flanks FROM o GROUP BY flanks HAVING count(*) >= 3 AND min(base) <> max(base))""")
def split_kmer_align(spark, sf_dir):
    return kmers.split_kmer_alignment(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.md5("flanks").alias("flanks"), "doc_id", "base")


# --- functions of sequences --------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in columns.items()))


@query("SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^GCgc]', '', 'g')) / length(text) ELSE 0 END, 9)::DOUBLE AS gc FROM documents")
def gc_content(spark, sf_dir):
    return _documents(spark, sf_dir, gc=F.round(sequence.gc_content(F.col("text")), 9))


@query(r"SELECT doc_id, length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) AS clean FROM documents")
def clean_length(spark, sf_dir):
    return _documents(spark, sf_dir, clean=sequence.clean_length(F.col("text")))


@query("SELECT item_id, reverse(translate(upper(translate(text, 'ßſı', '???')), 'ACGTU', 'TGCAA')) AS rc FROM benchmark")
def reverse_complement(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", sequence.reverse_complement(F.translate("text", "ßſı", "???")).alias("rc"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '([^\n]{80})([^\n])', '\1' || chr(10) || '\2', 'g')) AS h, 0::BIGINT AS z FROM documents WHERE false UNION ALL SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN length(l) = 0 THEN '' ELSE array_to_string([substr(l, i::INTEGER, 80) for i in range(1, length(l) + 1, 80)], chr(10)) END), chr(10))) AS h, 0::BIGINT AS z FROM documents")
def wrap80(spark, sf_dir):
    return _documents(spark, sf_dir, h=F.md5(sequence.wrapped(F.col("text"))), z=F.lit(0).cast("long"))


_CLEAN = r"upper(regexp_replace(regexp_replace(translate(text, 'ßſı', '???'), '[ \t\n\x0B\f\r]', '', 'g'), '\*$', ''))"
_TOKENS = "map {" + ", ".join(f"'{k}': {v}" for k, v in sequence.RESIDUE_TOKENS.items()) + "}"


def _residues():
    return sequence.residues(F.translate("text", "ßſı", "???"))


@query(f"""WITH c AS (SELECT doc_id, {_CLEAN} AS s FROM documents), t AS (SELECT doc_id, length(s) AS n, list_transform(list_filter(string_split(substr(s, 1, 1022), ''), lambda x: x <> ''), lambda x: coalesce({_TOKENS}[x], 3)) AS ids FROM c)
SELECT doc_id, (len(ids) + 2)::BIGINT AS n_tokens, md5('0,' || array_to_string(list_transform(ids, lambda x: x::VARCHAR), ',') || ',2') AS ids, len(list_filter(ids, lambda x: x = 3))::BIGINT AS unknown FROM t""")
def residue_tokens(spark, sf_dir):
    t = _documents(spark, sf_dir, ids=sequence.residue_tokens(_residues()))
    return t.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("ids"), F.size(F.filter("ids", lambda x: x == sequence.UNKNOWN)).cast("long").alias("unknown"))


@query(f"WITH c AS (SELECT doc_id, length({_CLEAN}) AS n FROM documents) SELECT doc_id, n AS residues, n > 1022 AS truncated, (ceil((least(n, 1022) + 2) / 128) * 128)::BIGINT AS padded, least(n, 1022)::BIGINT AS pooled, (least(n, 1022) + 2)::BIGINT AS attended FROM c")
def encode_masks(spark, sf_dir):
    c = _documents(spark, sf_dir, s=_residues()).withColumn("ids", sequence.residue_tokens(F.col("s"))).withColumn("padded", sequence.padded_length(F.size("ids") - 2))
    full = c.withColumn("row", sequence.padded_to(F.col("ids"), F.col("padded")))
    attended = F.size(F.filter("row", lambda x: x != sequence.PAD)).cast("long")
    return full.select("doc_id", F.length("s").cast("long").alias("residues"), sequence.truncated(F.col("s")).alias("truncated"), F.size("row").cast("long").alias("padded"), (attended - 2).alias("pooled"), attended.alias("attended"))


@query(f"""WITH c AS (SELECT doc_id, least(length({_CLEAN}), 1022) AS n FROM documents), p AS (SELECT doc_id, n, (ceil((n + 2) / 128) * 128)::BIGINT AS padded FROM c), b AS (SELECT *, greatest(1, least(64, floor(16000000 / (20 * padded * padded))))::BIGINT AS cap FROM p)
SELECT doc_id, padded, cap, ((row_number() OVER (PARTITION BY padded ORDER BY n, doc_id) - 1) // cap)::BIGINT AS batch_no FROM b""")
def batch_plan(spark, sf_dir):
    return vec.batch_plan(_documents(spark, sf_dir, n=F.least(F.length(_residues()), F.lit(1022))), "doc_id", "n")


@query(f"""WITH c AS (SELECT doc_id, source, length({_CLEAN}) AS n FROM documents) SELECT doc_id, source, ((row_number() OVER (PARTITION BY source ORDER BY n, doc_id) - 1) // 8)::BIGINT AS batch_no FROM c""")
def fixed_batches(spark, sf_dir):
    return vec.fixed_batches(_documents(spark, sf_dir, source=F.col("source"), n=F.length(_residues())), "doc_id", "n", 8, "source")


@query("SELECT item_id, regexp_matches(upper(substr(text, 1, 50)), '[EFILPQXZJO]') AS protein FROM benchmark")
def alphabet_sniff(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", sequence.looks_like_protein(F.col("text")).alias("protein"))


@query("SELECT item_id, regexp_replace(text, '[^ACGTUacgtu-]', 'N', 'g') AS masked FROM benchmark")
def ambiguous_masked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", sequence.masked_ambiguous(F.col("text")).alias("masked"))


# --- sequence files ----------------------------------------------------------------------------------------------------

_FASTA = "'>' || conv_id || '.' || turn || ' ' || role || chr(10) || text || chr(10) || '>tail ' || turn || chr(13) || chr(10) || role || chr(10)"


def _fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit(">"), "conv_id", F.lit("."), "turn", F.lit(" "), "role", F.lit("\n"), "text", F.lit("\n>tail "), "turn", F.lit("\r\n"), "role", F.lit("\n"))
    return c.select("conv_id", "turn", text.alias("fasta"))


_RECORDS = f"p AS (SELECT conv_id, turn, string_split(chr(10) || replace({_FASTA}, chr(13), ''), chr(10) || '>') AS ps FROM conversations), r AS (SELECT conv_id, turn, unnest(ps[2:]) AS record, unnest(range(len(ps) - 1)) AS ord FROM p), s AS (SELECT conv_id, turn, ord, string_split(record, chr(10)) AS l FROM r)"


@query(f"WITH {_RECORDS} SELECT conv_id, turn, ord::BIGINT AS ord, l[1] AS header, array_to_string(l[2:], '') AS seq FROM s")
def fasta_parse(spark, sf_dir):
    return fastx.fasta_records(_fasta(spark, sf_dir), "fasta")


@query(rf"WITH {_RECORDS} SELECT conv_id, turn, ord::BIGINT AS ord, string_split(l[1], ' ')[1] AS id, trim(substr(l[1], strpos(l[1], ' ') + 1)) AS desc, regexp_replace(array_to_string(l[2:], ''), '[ \t]', '', 'g') AS seq FROM s")
def protein_fasta_parse(spark, sf_dir):
    return fastx.protein_records(_fasta(spark, sf_dir), "fasta")


@query(rf"WITH {_RECORDS} SELECT conv_id, turn, ord::BIGINT AS ord, trim(l[1]) AS id, regexp_replace(array_to_string(l[2:], ''), '[ \t]', '', 'g') AS sequence FROM s")
def alignment_parse(spark, sf_dir):
    return fastx.alignment_records(_fasta(spark, sf_dir), "fasta")


@query("WITH s AS (SELECT conv_id, turn, replace(text, chr(10), ' ') AS seq FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, o::BIGINT AS ord, turn || '/' || o AS header, seq, repeat(CASE WHEN o = 0 THEN 'I' ELSE '#' END, length(seq)) AS qual FROM s, (SELECT unnest([0, 1]) AS o)")
def fastq_parse(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.replace("text", F.lit("\n"), F.lit(" ")).alias("s"))
    record = lambda o, q: F.concat(F.lit("@"), "turn", F.lit(f"/{o}\n"), "s", F.lit("\n+\n"), F.repeat(F.lit(q), F.length("s")), F.lit("\n\n"))
    return fastx.fastq_records(c.select("conv_id", "turn", F.concat(record(0, "I"), record(1, "#")).alias("fastq")), "fastq")


_FAI_TEXT = "'>' || turn || ' ' || role || chr(10) || text || chr(10) || '>tail' || chr(10) || role"


@query(f"""WITH t AS (SELECT conv_id * 1000 + turn AS key, string_split(chr(10) || {_FAI_TEXT}, chr(10) || '>') AS ps FROM conversations),
r AS (SELECT key, i - 2 AS ord, ps[i] AS record, list_sum(list_transform(ps[1:i - 1], lambda p: octet_length(encode(p)) + 2)) - 1 AS start FROM (SELECT key, ps, unnest(range(2, len(ps) + 1)) AS i FROM t)),
s AS (SELECT key, ord, start, string_split(record, chr(10)) AS l, instr(record, chr(10)) AS cut, record FROM r)
SELECT key, ord::BIGINT AS ord, string_split(l[1], ' ')[1] AS name, length(regexp_replace(array_to_string(l[2:], ''), '[^!-~]', '', 'g')) AS length, (start + octet_length(encode(l[1])) + 1)::BIGINT AS offset, length(regexp_replace(coalesce(l[2], ''), '[^!-~]', '', 'g')) AS linebases, (octet_length(encode(coalesce(l[2], ''))) + CASE WHEN len(l) > 2 THEN 1 ELSE 0 END)::BIGINT AS linewidth FROM s""")
def fai_index(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit(">"), "turn", F.lit(" "), "role", F.lit("\n"), "text", F.lit("\n>tail\n"), "role")
    return fastx.fai_index(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), text.alias("text")), "key")


@query("WITH f AS (SELECT o_orderkey, 's' || o_custkey || '_' || (1 + o_orderkey % 2) || CASE WHEN o_orderkey % 3 = 0 THEN '.fastq.gz' ELSE '.fq' END AS name FROM orders), s AS (SELECT regexp_extract(name, '^(s[0-9]+)_', 1) AS sample, name, name LIKE '%\\_1.%' ESCAPE '\\' AS first FROM f) SELECT sample, min(name) FILTER (first) AS read1, min(name) FILTER (NOT first) AS read2 FROM s GROUP BY sample")
def sample_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    names = o.select(F.concat(F.lit("s"), "o_custkey", F.lit("_"), (1 + F.col("o_orderkey") % 2).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ".fastq.gz").otherwise(".fq")).alias("name"))
    mate = F.regexp_extract("name", r"_([12])\.", 1)
    return names.groupBy(sequence.sample_name(F.col("name")).alias("sample")).agg(F.min(F.when(mate == "1", F.col("name"))).alias("read1"), F.min(F.when(mate == "2", F.col("name"))).alias("read2"))


# --- hits --------------------------------------------------------------------------------------------------------------

_HITS = "SELECT l_orderkey AS query_id, l_linenumber AS ord, CASE WHEN l_returnflag = 'N' THEN 'gene' ELSE 'gene_group' END AS call_type, l_discount AS call_fraction, l_quantity::BIGINT AS matched, l_partkey, l_extendedprice FROM lineitem"
_BEST = f"b AS (SELECT * FROM ({_HITS}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN call_type = 'gene' THEN 1 ELSE 0 END DESC, round(call_fraction * 1000000) DESC, matched DESC, ord, l_partkey) = 1)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.struct("l_linenumber", "l_partkey").alias("ord"), F.when(F.col("l_returnflag") == "N", "gene").otherwise("gene_group").alias("call_type"), F.col("l_discount").alias("call_fraction"), F.col("l_quantity").cast("long").alias("matched"), "l_partkey")


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.best_hits(_hits(spark, sf_dir), matched="matched")


@query(f"WITH {_BEST} SELECT query_id, call_type, call_fraction, matched, l_partkey FROM b")
def best_hit(spark, sf_dir):
    return _best(spark, sf_dir).drop("ord")


@query("SELECT l_orderkey AS query_id, count(*) AS n FROM lineitem WHERE l_discount >= CASE WHEN l_returnflag = 'N' THEN 0.05 ELSE 0.08 END GROUP BY 1")
def call_thresholds(spark, sf_dir):
    return hits.above_thresholds(_hits(spark, sf_dir), 0.05, 0.08).groupBy("query_id").agg(F.count("*").alias("n"))


_ESC = "replace(replace(replace(replace(replace(replace(replace({}, '%', '%25'), ';', '%3B'), '=', '%3D'), '&', '%26'), ',', '%2C'), '#', '%23'), '?', '%3F')"


@query(f"SELECT page_id, {_ESC.format('url')} AS escaped FROM pages")
def gff_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", sequence.gff_escape(F.col("url")).alias("escaped"))


def _gff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "O", "CDS").otherwise("exon")
    line = F.concat_ws("\t", F.lit("c1"), F.lit("src"), kind, F.lit("1"), F.lit("9"), F.lit("."), F.lit("+"), F.lit("0"), F.concat(F.lit("ID="), "o_orderkey", F.lit(";partial=00;;")))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("#"), line)).otherwise(line).alias("line"))


@query(f"""WITH {_BEST}, a AS (SELECT query_id, p_name AS label, p_brand, p_type, call_type, call_fraction, matched FROM b JOIN part ON l_partkey = p_partkey),
g AS (SELECT o_orderkey, (CASE WHEN o_orderkey % 7 = 0 THEN '#' ELSE '' END) || 'c1' || chr(9) || 'src' || chr(9) || CASE WHEN o_orderstatus = 'O' THEN 'CDS' ELSE 'exon' END || chr(9) || '1' || chr(9) || '9' || chr(9) || '.' || chr(9) || '+' || chr(9) || '0' || chr(9) AS head, o_orderstatus FROM orders)
SELECT o_orderkey, head || CASE WHEN o_orderstatus = 'O' AND o_orderkey % 7 <> 0 AND query_id IS NOT NULL THEN 'ID=' || o_orderkey || ';partial=00;Name=' || {_ESC.format('label')} || ';amr_unit_id=' || {_ESC.format('p_brand')} || ';amr_unit_label=' || {_ESC.format('label')} || ';amr_call_type=' || call_type || ';amr_element_symbol=;amr_gene_symbol=;amr_allele_symbol=;amr_gene_group=' || {_ESC.format('p_type')} || ';amr_category=;amr_subtype=;amr_class=;amr_subclass=;amr_call_fraction=' || printf('%.4f', call_fraction) || ';amr_diagnostic_kmers=' || matched || '/50' ELSE 'ID=' || o_orderkey || ';partial=00;;' END AS line
FROM g LEFT JOIN a ON query_id = o_orderkey""")
def best_hit_annotated(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("unit_label"), F.col("p_brand").alias("unit_id"), F.col("p_type").alias("gene_group"))
    best = _best(spark, sf_dir).join(part, "l_partkey").withColumn("query_id", F.col("query_id").cast("string"))
    none = {c: F.lit("") for c in ("element_symbol", "gene_symbol", "allele_symbol", "type_name", "subtype", "class_name", "subclass")}
    best = best.withColumns(none | {"first_pass_distinct": F.col("matched"), "first_pass_diagnostic_total": F.lit(50)})
    return hits.annotated_gff(_gff(spark, sf_dir), best)


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    strand = F.when(F.col("o_orderpriority").startswith("1"), "+").when(F.col("o_orderpriority").startswith("2"), "-").otherwise("?")
    return o.select(F.col("o_orderkey").alias("gene_id"), F.col("o_orderstatus").alias("contig"), (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + 9).alias("end"), strand.alias("strand"))


_STRAND = "CASE WHEN o_orderkey IS NULL THEN '' WHEN o_orderpriority LIKE '1%' THEN '+' WHEN o_orderpriority LIKE '2%' THEN '-' ELSE '.' END"
_SHOWN = {"sample": "l_suppkey::VARCHAR", "index_k": "'23'", "query_id": "l_orderkey::VARCHAR", "unit_id": "p_brand", "unit_label": "p_name", "call_type": "CASE WHEN l_returnflag = 'N' THEN 'gene' ELSE 'gene_group' END", "gene_group": "p_type", "call_fraction": "printf('%.4f', l_discount)", "first_pass_distinct": "l_quantity::BIGINT::VARCHAR", "first_pass_diagnostic_total": "'50'", "start": "l_linenumber::VARCHAR", "end": "(l_linenumber + 30)::VARCHAR"}
_GENE = {"contig": "coalesce(o_orderstatus, '')", "gene_start": "coalesce((o_orderkey * 10)::VARCHAR, '')", "gene_end": "coalesce((o_orderkey * 10 + 9)::VARCHAR, '')", "strand": _STRAND}


def _report_sql(places: dict[str, str]) -> str:
    shown = ", ".join(f"{(_SHOWN | _GENE).get(c, chr(39) * 2)} AS \"{heading}\"" for c, heading in (tabular.REPORT | places).items())
    return f"SELECT {shown} FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey"


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("unit_id"), F.col("p_name").alias("unit_label"), F.col("p_type").alias("gene_group"))
    rows = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    call = F.when(F.col("l_returnflag") == "N", "gene").otherwise("gene_group")
    return rows.select(F.col("l_suppkey").alias("sample"), F.lit(23).alias("index_k"), F.col("l_orderkey").alias("query_id"), "unit_id", "unit_label", call.alias("call_type"), F.lit(None).cast("string").alias("subtype"), "gene_group", F.col("l_discount").alias("call_fraction"), F.col("l_quantity").cast("long").alias("first_pass_distinct"), F.lit(50).alias("first_pass_diagnostic_total"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 30).alias("end"))


@query(_report_sql(tabular.PLACES))
def resistance_report(spark, sf_dir):
    return tabular.hit_report(_shown(spark, sf_dir))


@query(_report_sql(tabular.GENE_PLACES))
def gene_resistance_report(spark, sf_dir):
    return tabular.gene_report(_shown(spark, sf_dir), _genes(spark, sf_dir))


@query("SELECT l_orderkey || ':' || l_linenumber AS hit, coalesce(o_orderstatus, '') AS contig, coalesce((o_orderkey * 10)::VARCHAR, '') AS gene_start, coalesce((o_orderkey * 10 + 9)::VARCHAR, '') AS gene_end, CASE WHEN o_orderkey IS NULL THEN '' WHEN o_orderpriority LIKE '1%' THEN '+' WHEN o_orderpriority LIKE '2%' THEN '-' ELSE '.' END AS strand FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey")
def hit_metadata_tsv(spark, sf_dir):
    g = _genes(spark, sf_dir)
    h = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat("l_orderkey", F.lit(":"), "l_linenumber").alias("hit"))
    return hits.hits_with_genes(h, g).drop("query_id")


@query("SELECT event_type AS query_id, count(*) AS n, coalesce(max(value), 0) AS top FROM events WHERE event_type <> '' GROUP BY 1")
def hits_from_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    doc = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("query_id"), F.col("value").alias("call_fraction")), F.struct(F.lit("").alias("query_id"), F.lit(0.0).alias("call_fraction"))).alias("hits")))
    broken = F.when(F.col("event_id") < 0, F.lit("{")).otherwise(doc)
    return hits.hits_from_json(e.select(broken.alias("json"))).groupBy("query_id").agg(F.count("*").alias("n"), F.max("call_fraction").alias("top"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def last_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return hits.last_per_key(o, "o_custkey", "at").select("o_custkey", "o_orderkey", "o_totalprice")


_TAXA = "SELECT l_orderkey AS sample, rank() OVER (PARTITION BY l_orderkey ORDER BY l_tax) AS rank, l_linenumber AS ord, l_partkey, CASE WHEN l_partkey % 2 = 0 THEN 'Genus' || l_partkey % 3 ELSE 'Other' END || ' sp' || l_partkey % 5 AS species, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'c' || l_suppkey END AS cluster_id FROM lineitem"


@query(f"""WITH x AS (SELECT sample, rank, species, cluster_id, row_number() OVER (PARTITION BY sample ORDER BY ord, l_partkey) AS ord FROM ({_TAXA})),
t AS (SELECT sample, count(*) AS n, count(DISTINCT species) AS ns, count(DISTINCT string_split(species, ' ')[1]) AS ng, min(string_split(species, ' ')[1]) AS g, array_to_string(list_filter(list(cluster_id ORDER BY ord), lambda c: c <> ''), ', ') AS ids FROM x WHERE rank = 1 GROUP BY sample),
f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY sample ORDER BY CASE WHEN rank = 1 THEN 0 ELSE 1 END, ord) = 1)
SELECT f.sample, f.rank, CASE WHEN n <= 1 OR ns = 1 THEN species WHEN ng = 1 THEN g || ' spp.' ELSE 'Unknown (tie)' END AS species, CASE WHEN n <= 1 THEN cluster_id ELSE ids END AS cluster_ids FROM f JOIN t USING (sample)""")
def taxon_compact(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    species = F.concat(F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("Genus"), F.col("l_partkey") % 3)).otherwise(F.lit("Other")), F.lit(" sp"), F.col("l_partkey") % 5)
    w = Window.partitionBy("l_orderkey")
    rows = l.select(F.col("l_orderkey").alias("sample"), F.rank().over(w.orderBy("l_tax")).cast("long").alias("rank"), F.row_number().over(w.orderBy("l_linenumber", "l_partkey")).alias("ord"), species.alias("species"), F.when(F.col("l_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("c"), "l_suppkey")).alias("cluster_id"))
    return hits.compact_taxa(rows)


@query("""WITH p AS (SELECT p_partkey, p_size AS a, p_partkey % 7 AS b FROM part) SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'A b (x); c (1)' WHEN a + b = 0 THEN 'A b (0); c d (0)'
ELSE 'A b (' || a || '; ' || round(a::DOUBLE / (a + b) * 100, 1)::DECIMAL(20,1) || '%) ; c d (' || b || '; ' || round(b::DOUBLE / (a + b) * 100, 1)::DECIMAL(20,1) || '%)' END AS shown FROM p""")
def composition_pct(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a, b = F.col("p_size"), F.col("p_partkey") % 7
    text = F.when(F.col("p_partkey") % 10 == 0, F.lit("A b (x); c (1)")).otherwise(F.concat(F.lit("A b ("), a, F.lit("); c d ("), b, F.lit(")")))
    return p.select("p_partkey", hits.composition_percentages(text).alias("shown"))


@query("SELECT vec_id, CASE WHEN (0.75 + label / 40.0) * 100 <= 80.95 THEN 'low' WHEN (0.75 + label / 40.0) * 100 <= 87.19 THEN 'medium' ELSE 'high' END AS class FROM embeddings")
def ani_class(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", hits.confidence_class(0.75 + F.col("label") / 40.0).alias("class"))


# --- intervals ---------------------------------------------------------------------------------------------------------

_FEATURES = "SELECT l_suppkey AS seq, (l_partkey * 7919 + l_orderkey * 31) % 3000000 AS beg, (l_partkey * 7919 + l_orderkey * 31) % 3000000 + 1 + l_quantity::BIGINT * 400 AS \"end\", l_orderkey AS \"offset\" FROM lineitem"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    beg = (F.col("l_partkey") * 7919 + F.col("l_orderkey") * 31) % 3_000_000
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("seq"), beg.alias("beg"), (beg + 1 + F.col("l_quantity").cast("long") * 400).alias("end"), F.col("l_orderkey").alias("offset"))


_BIN = "CASE " + " ".join(f"WHEN beg >> {bins.MIN_SHIFT + 3 * (bins.LEVELS - level)} = (\"end\" - 1) >> {bins.MIN_SHIFT + 3 * (bins.LEVELS - level)} THEN {bins.bin_first(level)} + (beg >> {bins.MIN_SHIFT + 3 * (bins.LEVELS - level)})" for level in range(bins.LEVELS, 0, -1)) + " ELSE 0 END"


@query(f"SELECT seq, {_BIN} AS bin, count(*) AS n FROM ({_FEATURES}) GROUP BY ALL")
def interval_bins(spark, sf_dir):
    return intervals.with_bin(_features(spark, sf_dir)).groupBy("seq", "bin").agg(F.count("*").alias("n"))


@query(f"WITH f AS ({_FEATURES}), q AS (SELECT p_partkey AS q_id, p_partkey % 10 + 1 AS q_seq, (p_partkey * 104729) % 3000000 AS q_beg, (p_partkey * 104729) % 3000000 + 20000 AS q_end FROM part) SELECT q_id, count(*) AS n, min(beg) AS first_beg, max(\"end\") AS last_end FROM q JOIN f ON seq = q_seq AND beg < q_end AND \"end\" > q_beg GROUP BY q_id")
def interval_overlap(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    beg = (F.col("p_partkey") * 104_729) % 3_000_000
    q = p.select(F.col("p_partkey").alias("q_id"), (F.col("p_partkey") % 10 + 1).alias("q_seq"), beg.alias("q_beg"), (beg + 20_000).alias("q_end"))
    return intervals.overlaps(_features(spark, sf_dir), q).groupBy("q_id").agg(F.count("*").alias("n"), F.min("beg").alias("first_beg"), F.max("end").alias("last_end"))


@query(f"WITH f AS ({_FEATURES}), m AS (SELECT *, CASE WHEN beg > max(\"end\") OVER (PARTITION BY seq ORDER BY beg, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2000 THEN 1 ELSE 0 END AS n FROM f), r AS (SELECT *, sum(n) OVER (PARTITION BY seq ORDER BY beg, \"end\" ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT seq, min(beg) AS beg, max(\"end\") AS \"end\", count(*) AS n FROM r GROUP BY seq, run")
def interval_merge(spark, sf_dir):
    return intervals.merged(_features(spark, sf_dir), "seq", gap=2000)


@query(f"""WITH f AS ({_FEATURES}), t AS (SELECT seq, "offset", unnest(range(beg >> 14, (("end" - 1) >> 14) + 1)) AS win FROM f), x AS (SELECT seq, win, min("offset") AS o FROM t GROUP BY ALL),
e AS (SELECT seq, unnest(range(0, max(win) + 1)) AS win FROM x GROUP BY seq)
SELECT seq, win::BIGINT AS "window", first_value(o IGNORE NULLS) OVER (PARTITION BY seq ORDER BY win ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS "offset" FROM e LEFT JOIN x USING (seq, win)""")
def linear_index(spark, sf_dir):
    return intervals.linear_index(_features(spark, sf_dir))


_WINDOW = "CASE " + " ".join(f"WHEN bin >= {bins.bin_first(level)} THEN (bin - {bins.bin_first(level)}) << {3 * (bins.LEVELS - level)}" for level in range(bins.LEVELS, 0, -1)) + " ELSE 0 END"


@query(f"""WITH f AS ({_FEATURES}), b AS (SELECT seq, {_BIN} AS bin, "offset" AS o FROM f), r AS (SELECT seq, bin, o, CASE WHEN o > max(o + 1) OVER (PARTITION BY seq, bin ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 65536 THEN 1 ELSE 0 END AS n FROM b),
c AS (SELECT seq, bin, count(*) AS n_features, sum(n) + 1 AS n_chunks, min(o) AS first_begin, max(o) + 1 AS last_end, {_WINDOW} AS win FROM r GROUP BY seq, bin),
t AS (SELECT seq, "offset" AS o, unnest(range(beg >> 14, (("end" - 1) >> 14) + 1)) AS win FROM f), x AS (SELECT seq, win, min(o) AS o FROM t GROUP BY ALL), e AS (SELECT seq, unnest(range(0, max(win) + 1)) AS win FROM x GROUP BY seq),
l AS (SELECT seq, win, first_value(o IGNORE NULLS) OVER (PARTITION BY seq ORDER BY win ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS o FROM e LEFT JOIN x USING (seq, win)), z AS (SELECT seq, arg_max(o, win) AS o FROM l GROUP BY seq)
SELECT c.seq AS seq, bin, coalesce(l.o, z.o) AS loff, n_chunks::BIGINT AS n_chunks, first_begin, last_end FROM c LEFT JOIN l ON c.seq = l.seq AND c.win = l.win JOIN z ON c.seq = z.seq""")
def interval_index(spark, sf_dir):
    f = _features(spark, sf_dir).select("seq", "beg", "end", F.col("offset").alias("voffset"), (F.col("offset") + 1).alias("end_voffset"))
    chunk = lambda i, c: F.element_at("chunks", i)[c]
    return regions.index_rows(f).select("seq", "bin", "loff", F.size("chunks").cast("long").alias("n_chunks"), chunk(1, "begin").alias("first_begin"), chunk(-1, "end").alias("last_end"))


# --- aligned sequences and clusters ------------------------------------------------------------------------------------

_PAIR = "SELECT a.item_id AS item_id, a.text AS reference, replace(b.text, 'e', '-') AS mapped FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1"


def _aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.col("text").alias("reference")).join(b.select((F.col("item_id") - 1).alias("item_id"), F.replace("text", F.lit("e"), F.lit("-")).alias("mapped")), "item_id")


_COLUMNS = f"c AS (SELECT item_id, unnest(range(1, length(reference) + 1)) AS i, reference, mapped FROM ({_PAIR}))"


@query(f"WITH {_COLUMNS}, s AS (SELECT item_id, i, upper(translate(substr(reference, i::INTEGER, 1), 'ßſı', '???')) AS r, upper(translate(substr(mapped, i::INTEGER, 1), 'ßſı', '???')) AS m, length(mapped) AS n FROM c) SELECT item_id, string_agg(CASE WHEN m = r THEN '-' WHEN m = '-' THEN ' ' ELSE m END, '' ORDER BY i) AS states FROM s WHERE i <= n GROUP BY item_id")
def column_state(spark, sf_dir):
    p = _aligned_pairs(spark, sf_dir).select("item_id", F.translate("reference", "ßſı", "???").alias("reference"), F.translate("mapped", "ßſı", "???").alias("mapped"))
    n = F.least(F.length("reference"), F.length("mapped"))
    cut = p.select("item_id", F.col("reference").substr(F.lit(1), n).alias("reference"), F.col("mapped").substr(F.lit(1), n).alias("mapped"))
    return cut.select("item_id", clusters.column_states("reference", "mapped").alias("states"))


@query(f"""WITH {_COLUMNS}, s AS (SELECT item_id, i, CASE WHEN substr(mapped, i::INTEGER, 1) IN ('-', '') THEN 'unmapped' WHEN substr(mapped, i::INTEGER, 1) = substr(reference, i::INTEGER, 1) THEN 'match' ELSE 'mismatch' END AS state FROM c),
g AS (SELECT *, i - row_number() OVER (PARTITION BY item_id, state ORDER BY i) AS grp FROM s), r AS (SELECT item_id, state, min(i) - 1 AS start, count(*) AS length FROM g GROUP BY item_id, state, grp)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY start) - 1 AS run, start::BIGINT AS start, length, state FROM r""")
def match_runs(spark, sf_dir):
    return clusters.match_runs(_aligned_pairs(spark, sf_dir), "item_id", "reference", "mapped")


@query(f"""WITH {_COLUMNS}, s AS (SELECT item_id, i - 1 AS pos, substr(mapped, i::INTEGER, 1) IN ('-', '') AS gap FROM c), g AS (SELECT *, pos - row_number() OVER (PARTITION BY item_id, gap ORDER BY pos) AS run FROM s)
SELECT item_id, min(pos)::BIGINT AS start, (max(pos) + 1)::BIGINT AS "end", gap FROM g GROUP BY item_id, gap, run""")
def gap_collapse(spark, sf_dir):
    p = _aligned_pairs(spark, sf_dir)
    columns = p.select("item_id", F.posexplode(F.split(F.rpad("mapped", F.greatest(F.length("reference"), F.length("mapped")), F.lit("-")), "")).alias("pos", "base"), F.length("reference").alias("n")).where("pos < n")
    return clusters.collapsed_gaps(columns.drop("n"), "item_id")


_SNP = """x AS (SELECT item_id, translate(upper(translate(text, 'ßſı', '???')), 'U', 'T') AS s FROM benchmark),
d AS (SELECT a.item_id AS a, b.item_id AS b, list_sum([CASE WHEN a.s[i] <> b.s[i] AND a.s[i] IN ('A','C','G','T') AND b.s[i] IN ('A','C','G','T') THEN 1 ELSE 0 END for i in range(1, least(length(a.s), length(b.s)) + 1)])::BIGINT AS snp_distance FROM x a JOIN x b ON a.item_id < b.item_id)"""
_THRESHOLD = 2


def _snp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.pairwise_snp(table(spark, sf_dir, "benchmark").select("item_id", F.translate("text", "ßſı", "???").alias("text")), "item_id", "text")


@query(f"WITH {_SNP} SELECT a, b, snp_distance FROM d")
def snp_distance(spark, sf_dir):
    return _snp(spark, sf_dir)


@query(f"""WITH {_SNP}, f AS (SELECT a, b, snp_distance FROM d UNION ALL SELECT b, a, snp_distance FROM d UNION ALL SELECT DISTINCT item_id, item_id, 0 FROM x)
SELECT 0::BIGINT AS place, ',' || string_agg(a::VARCHAR, ',' ORDER BY a::VARCHAR) AS value FROM (SELECT DISTINCT a FROM f)
UNION ALL SELECT row_number() OVER (ORDER BY a::VARCHAR), a::VARCHAR || ',' || string_agg(snp_distance::VARCHAR, ',' ORDER BY b::VARCHAR) FROM f GROUP BY a""")
def distance_table(spark, sf_dir):
    return tabular.distance_lines(_snp(spark, sf_dir))


@query()
def nj_tree(spark, sf_dir):
    return trees.neighbour_joining(_snp(spark, sf_dir))


@query(f"WITH {_SNP} SELECT a, b, snp_distance FROM d WHERE snp_distance <= {_THRESHOLD}")
def snp_edges(spark, sf_dir):
    return _snp(spark, sf_dir).where(F.col("snp_distance") <= _THRESHOLD)


@query(f"""WITH RECURSIVE {_SNP}, e AS (SELECT a, b FROM d WHERE snp_distance <= {_THRESHOLD} UNION ALL SELECT b, a FROM d WHERE snp_distance <= {_THRESHOLD}), r(n, m) AS (SELECT item_id, item_id FROM benchmark UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a)
SELECT n AS item_id, dense_rank() OVER (ORDER BY min(m)) AS cluster FROM r GROUP BY n""")
def single_linkage(spark, sf_dir):
    return clusters.single_linkage(table(spark, sf_dir, "benchmark"), _snp(spark, sf_dir), _THRESHOLD, "item_id")


@query(f"""WITH {_SNP}, k AS (SELECT * FROM d WHERE snp_distance <= {_THRESHOLD} AND a % 3 > 0 AND b % 3 > 0) SELECT a AS source, b AS target, snp_distance, round(0.3 + 0.7 * (1 - snp_distance / greatest((SELECT max(snp_distance) FROM k), 1)), 9) AS opacity FROM k""")
def link_prune_opacity(spark, sf_dir):
    links = _snp(spark, sf_dir).where(F.col("snp_distance") <= _THRESHOLD).withColumnsRenamed({"a": "source", "b": "target"})
    return clusters.known_links(links, table(spark, sf_dir, "benchmark").where("item_id % 3 > 0"), "item_id")


_SAMPLES = "s AS (SELECT o_orderkey AS ord, 'cust' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '.fa.gz' ELSE '' END AS name, o_orderkey % 20 AS cluster FROM orders), m AS (SELECT c_custkey AS ord, 'cust' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '2024-01-' || lpad((1 + c_custkey % 28)::VARCHAR, 2, '0') END AS date, c_mktsegment AS location FROM customer)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("cust"), "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, ".fa.gz").otherwise("")).alias("name"), (F.col("o_orderkey") % 20).alias("cluster"))
    date = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("c_custkey") % 28).cast("string"), 2, "0")))
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("cust"), "c_custkey").alias("id"), date.alias("date"), F.col("c_mktsegment").alias("location"))
    return hits.with_first_metadata(s, m)


_LOCATED = f"{_SAMPLES}, j AS (SELECT s.*, date, coalesce(location, '') AS location FROM s LEFT JOIN m ON m.id = regexp_replace(s.name, '(\\.[^.]+)+$', ''))"


@query(f"WITH {_LOCATED}, n AS (SELECT cluster, location, row_number() OVER (ORDER BY min(ord)) AS id FROM j GROUP BY ALL) SELECT j.name, n.id AS cluster FROM j JOIN n USING (cluster, location)")
def cluster_location(spark, sf_dir):
    return clusters.split_by_location(_samples(spark, sf_dir))


@query(f"WITH {_LOCATED}, c AS (SELECT cluster, date, count(*) AS cases FROM j WHERE date <> '' GROUP BY ALL) SELECT cluster, date, sum(cases) OVER (PARTITION BY cluster)::BIGINT AS cluster_size, cases FROM c")
def cluster_timeline(spark, sf_dir):
    return clusters.timeline(_samples(spark, sf_dir))


# --- vectors -----------------------------------------------------------------------------------------------------------

_VEC = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_KNN = _VEC + ", k AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) <= 15)"


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


@query(f"WITH {_KNN} SELECT id, neighbour, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) AS rank, score FROM k")
def cosine_knn(spark, sf_dir):
    return vec.knn(_embeddings(spark, sf_dir), "vec_id", "embedding", 15)


@query(f"""WITH {_KNN}, l AS (SELECT a.vec_id AS id, b.vec_id AS neighbour FROM v a JOIN v b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(list_cosine_similarity(a.v[1:16], b.v[1:16]), 9) DESC, neighbour) <= 15)
SELECT count(DISTINCT id) AS n, 15::BIGINT AS k, round((SELECT count(*) FROM k JOIN l USING (id, neighbour)) / (count(DISTINCT id) * 15), 9) AS preservation, round(15 / (count(DISTINCT id) - 1), 9) AS baseline FROM k""")
def neighbourhood_preservation(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return vec.neighbourhood_preservation(vec.knn(e, "vec_id", "embedding", 15), vec.knn(e.select("vec_id", F.slice("embedding", 1, 16).alias("low")), "vec_id", "low", 15))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text FROM documents GROUP BY text")
def vector_dedupe(spark, sf_dir):
    return vec.first_of_equal(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", F.md5("text").alias("text"))


@query("WITH p AS (SELECT unnest(embedding)::DOUBLE AS t, unnest(list_transform(embedding, lambda x: round(x::DOUBLE, 1))) AS p FROM embeddings) SELECT count(*) AS n, round(avg((p - t) ** 2), 9) AS mse, round(var_pop(t), 9) AS variance, round(1 - avg((p - t) ** 2) / var_pop(t), 6) AS r2 FROM p")
def mse_r2(spark, sf_dir):
    e = _embeddings(spark, sf_dir).select("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 1)).alias("p"))
    return vec.fit_measures(e, "p", "embedding")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS finite FROM embeddings")
def vector_norms(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", F.round(vectors.l2_norm(F.col("embedding")), 6).alias("norm"), vectors.finite(F.col("embedding")).alias("finite"))


@query("WITH p AS (SELECT vec_id, label, embedding[1:4] AS a, embedding[5:8] AS b, embedding[9:12] AS c FROM embeddings) SELECT vec_id, round(CASE WHEN label % 3 = 0 THEN a[1]::DOUBLE WHEN label % 3 = 1 THEN (a[1]::DOUBLE + b[1]::DOUBLE) / 2 ELSE (a[1]::DOUBLE + b[1]::DOUBLE + c[1]::DOUBLE) / 3 END, 9) AS m1, round(CASE WHEN label % 3 = 0 THEN a[4]::DOUBLE WHEN label % 3 = 1 THEN (a[4]::DOUBLE + b[4]::DOUBLE) / 2 ELSE (a[4]::DOUBLE + b[4]::DOUBLE + c[4]::DOUBLE) / 3 END, 9) AS m4 FROM p")
def mean_pool(spark, sf_dir):
    positions = F.array(F.slice("embedding", 1, 4), F.slice("embedding", 5, 4), F.slice("embedding", 9, 4))
    mask = F.array(F.lit(1), (F.col("label") % 3 >= 1).cast("int"), (F.col("label") % 3 >= 2).cast("int"))
    pooled = vectors.mean_pooled(positions, mask, 4)
    return _embeddings(spark, sf_dir).select("vec_id", pooled.alias("p")).select("vec_id", F.round(F.col("p")[0], 9).alias("m1"), F.round(F.col("p")[3], 9).alias("m4"))


@query()
def mlp_project(spark, sf_dir):
    rng = np.random.default_rng(42)
    sizes = (64, 256, 128, 2)
    layers = [(rng.normal(0, a**-0.5, (b, a)), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    p = vec.mlp_project(_embeddings(spark, sf_dir), "vec_id", "embedding", layers)
    return p.select("id", F.col("projected")[0].alias("umap_1"), F.col("projected")[1].alias("umap_2"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of the usual length without nulls."""
    return _embeddings(spark, sf_dir).where(F.size("embedding") == 64).where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))


@query()
def umap_graph(spark, sf_dir):
    near = vec.knn(_vectors(spark, sf_dir), "vec_id", "embedding", 15).select("id", "neighbour", (1 - F.col("score")).alias("distance"))
    return layout.fuzzy_graph(near).select("a", "b", F.round("weight", 6).alias("weight"))


@query()
def umap_layout(spark, sf_dir):
    return layout.embed(_vectors(spark, sf_dir), "vec_id", "embedding")


@query()
def umap_projection(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    places = layout.embed(v, "vec_id", "embedding", rounds=20)
    rows = v.select("vec_id", "embedding").join(places, F.col("vec_id") == F.col("id")).select("embedding", F.array("x", "y").alias("place"))
    layers, _ = layout.train_projection(rows, "embedding", "place", steps=40)
    return vec.mlp_project(v, "vec_id", "embedding", layers).select("id", F.col("projected")[0].alias("umap_1"), F.col("projected")[1].alias("umap_2"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def manifest_resume(spark, sf_dir):
    return vec.remaining(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT vec_id, label, ('0x' || substr(md5('42:' || vec_id), 1, 8))::BIGINT < floor(0.15 * 4294967296) AS holdout FROM embeddings")
def seeded_split(spark, sf_dir):
    return vec.seeded_split(_embeddings(spark, sf_dir).select("vec_id", "label"), "vec_id")


# --- genes and diagnostic k-mers ---------------------------------------------------------------------------------------

_DNA = ("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


@query("""WITH d AS (SELECT doc_id AS contig, regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', '', 'g') AS seq FROM documents), s AS (SELECT contig, length(seq) AS n, '+' AS strand, seq AS s FROM d WHERE length(seq) >= 96 UNION ALL SELECT contig, length(seq), '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM d WHERE length(seq) >= 96),
c AS (SELECT contig, n, strand, i, i % 3 AS frame, substr(s, i::INTEGER, 3) AS codon FROM (SELECT *, unnest(range(1, n - 1)) AS i FROM s)),
g AS (SELECT *, count(*) FILTER (codon IN ('TAA', 'TAG', 'TGA')) OVER (PARTITION BY contig, strand, frame ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stops FROM c),
o AS (SELECT contig, n, strand, min(i) FILTER (codon IN ('ATG', 'GTG', 'TTG')) AS a, max(i) FILTER (codon IN ('TAA', 'TAG', 'TGA')) AS z FROM g GROUP BY contig, n, strand, frame, stops)
SELECT contig, CASE WHEN strand = '+' THEN a ELSE n - z - 1 END::BIGINT AS start, CASE WHEN strand = '+' THEN z + 2 ELSE n - a + 1 END::BIGINT AS "end", strand FROM o WHERE z + 3 - a >= 90""")
def open_reading_frames(spark, sf_dir):
    return genes.open_reading_frames(genes.long_contigs(_dna(spark, sf_dir)))


def _dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("contig"), F.regexp_replace(F.translate(F.lower("text"), *_DNA), "[^ACGT]", "").alias("seq"))


@query()
def gene_calls(spark, sf_dir):
    return genecalls.call_genes(_dna(spark, sf_dir))


@query(f"""WITH u AS (SELECT DISTINCT kmer, item_id AS unit_id FROM ({_kmers_sql('benchmark', 'item_id', 23)})), t AS (SELECT unit_id, count(*) AS total FROM u GROUP BY 1), q AS (SELECT DISTINCT doc_id, kmer FROM ({_kmers_sql('documents', 'doc_id', 23)}))
SELECT doc_id, unit_id, count(*) AS matched, total, round(count(*) / total, 9) AS call_fraction FROM q JOIN u USING (kmer) JOIN t USING (unit_id) GROUP BY doc_id, unit_id, total""")
def diagnostic_hits(spark, sf_dir):
    index = kmers.kmers(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("unit_id"), "text"), "text", 23)
    own = kmers.kmers_in(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 23, index)
    return hits.diagnostic_hits(own, index, "doc_id").withColumn("call_fraction", F.round("call_fraction", 9))


# --- metadata and streams ----------------------------------------------------------------------------------------------


@query("SELECT (c_custkey % 50) * 1000000 + c_custkey AS key, 'c' || c_custkey AS id, '2024-02-' || lpad((1 + c_custkey % 28)::VARCHAR, 2, '0') AS date, c_mktsegment AS location FROM customer WHERE c_custkey % 9 > 0")
def metadata_parse(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    id_ = F.when(F.col("c_custkey") % 9 == 0, "").otherwise(F.concat(F.lit("c"), "c_custkey"))
    line = F.concat(F.lit("Location, DATE ,id\r\n\n"), "c_mktsegment", F.lit(",2024-02-"), F.lpad((1 + F.col("c_custkey") % 28).cast("string"), 2, "0"), F.lit(","), id_, F.lit("\n"))
    rows = tabular.metadata_rows(c.select(line.alias("text")))
    number = F.substring("id", 2, 20).cast("long")
    return rows.select((number % 50 * 1_000_000 + number).alias("key"), "id", "date", "location")


@query(f"WITH {_VERDICTS} SELECT source, count(*) AS reads_in, count(*) FILTER ({_DEPLETED}) AS reads_out, sum(bases)::BIGINT AS bases_in, sum(CASE WHEN {_DEPLETED} THEN bases ELSE 0 END)::BIGINT AS bases_out FROM v JOIN documents USING (doc_id) GROUP BY source")
def stream_filter(spark, sf_dir):
    """Running counts of a stream of documents, each batch filtered as ``host_depletion`` does, once the stream is read."""
    from ..streaming.reads import depleted_stream_counts

    index = kmers.minimizers(table(spark, sf_dir, "benchmark").select("text"), "text", K, W)
    return depleted_stream_counts(spark, f"{sf_dir}/documents.parquet", index, "doc_id", "text", "source", K, W)


@query(f"WITH {_COUNTS} SELECT kmer, n FROM counts WHERE n >= 5")
def stream_kmer_counts(spark, sf_dir):
    """k-mers of documents counted chunk of files after chunk, once the stream is read."""
    from ..streaming.reads import chunked_kmer_counts

    return chunked_kmer_counts(spark, f"{sf_dir}/documents.parquet", "text", K, files_a_chunk=4, least=5)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_depletion(spark, sf_dir)


from . import results  # noqa: E402, F401 (registers its queries)
