"""Literal cases and laws of functions, sources and small operators."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kmerloom.functions import bins, sequence, vectors
from kmerloom.operators import clusters, genes, hits, intervals, kmers
from kmerloom.operators import vectors as vec
from kmerloom.operators.components import components
from kmerloom.sources import binary, fastx, tabular
from kmerloom.streaming import reads
from pyspark.sql import functions as F


def values(spark, column_of, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(column_of(F.col("s"))).collect()]


def test_reverse_complement(spark):
    assert values(spark, sequence.reverse_complement, "acgtn", "", None, "U") == ["NACGT", "", None, "A"]
    texts = ["".join(random.Random(i).choices("ACGT", k=i)) for i in range(30)]
    assert values(spark, lambda s: sequence.reverse_complement(sequence.reverse_complement(s)), *texts) == texts


def test_gff_escape(spark):
    assert values(spark, sequence.gff_escape, "aac(6')-Ib", "a;b=c&d,e%f#q?\tg", "é\n", None) == ["aac(6')-Ib", "a%3Bb%3Dc%26d%2Ce%25f%23q%3F%09g", "%C3%A9%0A", None]


def test_gff_attributes(spark):
    assert values(spark, sequence.gff_id, "ID=g1;x=2", "x=1;ID=g2", "x=1", "XID=3", "ID=") == ["g1", "g2", None, None, ""]
    assert values(spark, lambda s: sequence.append_attributes(s, F.lit("n=1")), "a=1;;", "", "a") == ["a=1;n=1", "n=1", "a;n=1"]


def test_best_hit_annotation(spark):
    hit = '{"query_id":"gene_1","unit_id":"%s","unit_label":"%s","call_type":"%s","call_fraction":%s,"first_pass_distinct":%d,"first_pass_diagnostic_total":10}'
    json = '{"hits":[%s,%s,{"query_id":""}]}' % (hit % ("u1", "group", "gene_group", "0.5", 5), hit % ("u2", "aac(6')-Ib", "gene", "0.4", 4))
    best = hits.best_hits(hits.hits_from_json(spark.createDataFrame([(json,), ("{",), (None,)], "json string")))
    line = "c\ts\tCDS\t1\t9\t.\t+\t0\tID=gene_1;partial=00;"
    out = hits.annotated_gff(spark.createDataFrame([(line,), ("# c",), ("c\ts\tgene\t1\t9\t.\t+\t0\tID=gene_1",)], "line string"), best)
    got = sorted(r[0] for r in out.collect())
    assert got[0] == "# c" and got[2].endswith("gene\t1\t9\t.\t+\t0\tID=gene_1")
    assert "ID=gene_1;partial=00;Name=aac(6')-Ib;" in got[1] and "amr_call_type=gene;" in got[1] and got[1].endswith("amr_diagnostic_kmers=4/10")


def proteins(spark, text, **k):
    return [(r["id"], r["desc"], r["seq"]) for r in fastx.protein_records(spark.createDataFrame([(text,)], "text string"), **k).orderBy("ord").collect()]


def test_protein_fasta(spark):
    assert proteins(spark, ">p1 first protein\nMKAL\nVGT\n>p2\nWWW\n") == [("p1", "first protein", "MKALVGT"), ("p2", "", "WWW")]
    assert proteins(spark, ">p1\r\nMK\r\n\r\nAL\r\n>p2\r\nWW") == [("p1", "", "MKAL"), ("p2", "", "WW")]
    assert proteins(spark, "; c\n>p1\tx y\n;z\nMK\n") == [("p1", "x y", "MK")]
    assert proteins(spark, ">p1\n>p2\nMK") == [("p1", "", ""), ("p2", "", "MK")]
    for bad in ("MK\n>p", "> \nMK", "", "\n"):
        with pytest.raises(Exception, match="FASTA"):
            proteins(spark, bad)


def test_fastq(spark):
    def read(text):
        return [(r["header"], r["seq"], r["qual"]) for r in fastx.fastq_records(spark.createDataFrame([(text,)], "text string")).orderBy("ord").collect()]

    assert read("@a b\r\nAC\r\n+\r\nII\r\n\n\n@c\nG\n+c\n@\n") == [("a b", "AC", "II"), ("c", "G", "@")]
    assert read("") == []
    for bad in ("a\nAC\n+\nII\n", "@a\nAC\n-\nII\n", "@a\nAC\n+\nI\n", "@a\nAC\n+\nII\n@b\nA\n"):
        with pytest.raises(Exception, match="FASTQ"):
            read(bad)


def test_reads_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "ACGT", "IIII"), ("b", "GG", "##")], "header string, seq string, qual string")
    fastx.write_reads(df, f"{tmp_path}/q", "none")
    assert sorted(map(tuple, fastx.read_reads(spark, f"{tmp_path}/q/*.txt").select("header", "seq", "qual").collect())) == [("a", "ACGT", "IIII"), ("b", "GG", "##")]
    (tmp_path / "x.fa").write_text(">a > b\nAC\nGT\n>c\n")
    assert sorted(map(tuple, fastx.read_fasta(spark, f"{tmp_path}/x.fa").select("header", "seq").collect())) == [("a > b", "ACGT"), ("c", "")]


def tokens(spark, *texts, most=sequence.MAX_RESIDUES):
    return values(spark, lambda s: sequence.residue_tokens(sequence.residues(s), most), *texts)


def test_residue_tokens(spark):
    assert tokens(spark, "MK", "XBUZO", "J1", "mk", "MK*", "MK*\n", "MK**", "M*K", "") == [[0, 20, 15, 2], [0, 24, 25, 26, 27, 28, 2], [0, 3, 3, 2], [0, 20, 15, 2], [0, 20, 15, 2], [0, 20, 15, 2], [0, 20, 15, 3, 2], [0, 20, 3, 15, 2], [0, 2]]
    assert len(tokens(spark, "A" * 10, most=4)[0]) == 6
    assert values(spark, lambda s: sequence.truncated(s, 4), "A" * 10, "A" * 4) == [True, False]


def test_batches(spark):
    n = spark.createDataFrame([(1,), (126,), (127,), (1022,)], "n int")
    assert [r[0] for r in n.select(sequence.padded_length(F.col("n"))).collect()] == [128, 128, 256, 1024]
    p = spark.createDataFrame([(1024,), (512,), (256,), (128,)], "p int")
    assert [r[0] for r in p.select(sequence.batch_cap(F.col("p"), 16_000_000, 20, 32)).collect()] == [1, 3, 12, 32]
    plan = vec.batch_plan(spark.createDataFrame([(i, 60) for i in range(100)], "id int, n int"), "id", "n", most=32)
    assert sorted(r[1] for r in plan.groupBy("batch_no").count().collect()) == [4, 32, 32, 32]
    fixed = vec.fixed_batches(spark.createDataFrame(list(enumerate([100, 5, 50, 5, 900])), "id int, n int"), "id", "n", 2)
    assert {r["id"] for r in fixed.where("batch_no = 0").collect()} == {1, 3}


def plain_bin(beg, end):
    last, shift, first = end - 1, 14, ((1 << 27) - 1) // 7
    for level in range(8, 0, -1):
        first -= 1 << 3 * level
        if beg >> shift == last >> shift:
            return first + (beg >> shift)
        shift += 3
    return 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**30), st.integers(1, 2**22)), min_size=1, max_size=200))
def test_bins(spark, spans):
    spans = [(a, a + n) for a, n in spans] + [(16383, 16384), (16383, 16385), (131071, 131073), (0, 1)]
    df = spark.createDataFrame(spans, "beg long, end long").select("beg", "end", bins.bin_of(F.col("beg"), F.col("end")).alias("b"), bins.bins_touched(F.col("beg"), F.col("end")).alias("t"))
    for r in df.collect():
        assert r["b"] == plain_bin(r["beg"], r["end"]) and r["b"] in r["t"]


def test_overlaps_and_merge(spark):
    r = random.Random(4)
    f = [(r.choice("ab"), a := r.randrange(10**6), a + r.randrange(1, 50_000)) for _ in range(300)]
    q = [(i, r.choice("ab"), a := r.randrange(10**6), a + r.randrange(1, 90_000)) for i in range(40)]
    got = intervals.overlaps(spark.createDataFrame(f, "seq string, beg long, end long"), spark.createDataFrame(q, "q_id int, q_seq string, q_beg long, q_end long"))
    want = sorted((i, b, e) for i, s, qb, qe in q for t, b, e in f if s == t and b < qe and e > qb)
    assert sorted((x["q_id"], x["beg"], x["end"]) for x in got.collect()) == want
    m = intervals.merged(spark.createDataFrame([("a", 0, 5), ("a", 6, 9), ("a", 20, 30), ("a", 21, 22)], "k string, beg long, end long"), "k", gap=1)
    assert sorted(map(tuple, m.collect())) == [("a", 0, 9, 2), ("a", 20, 30, 2)]


def test_depletion_edges(spark):
    index = kmers.kmers(spark.createDataFrame([("ACGTTGCATGGA",)], "s string"), "s", 5)
    rows = [(1, "ACG"), (2, "ACGTTGCATGGA"), (3, "TTTTTTTTTTTT"), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, "id long, s string")
    kept = {r["id"]: r["kept"] for r in kmers.contained(df, index, "id", "s", 5, 3).collect()}
    assert kept == {1: True, 2: False, 3: True, 4: True, 5: True}
    found = {r["id"]: r["kept"] for r in kmers.contained(df, index, "id", "s", 5, 3, deplete=False).collect()}
    assert found == {1: False, 2: True, 3: False, 4: False, 5: False}
    n = spark.createDataFrame([(0,), (10,), (30,), (50,)], "n long").select(kmers.required_hits(F.col("n"), 1, 0.05))
    assert [r[0] for r in n.collect()] == [1, 1, 2, 3]


def test_minimizers_across_blocks(spark):
    from hashlib import md5

    r = random.Random(2)
    for size in (5, 30, 255, 256, 257, 300, 900):
        s, k, w = "".join(r.choices("ACGT", k=size)), 7, 4
        n = size - k + 1
        want = {min(range(i, min(i + w, n)), key=lambda p: (md5(s[p : p + k].encode()).hexdigest(), p)) for i in range(max(n - w + 1, 1))} if n > 0 else set()
        got = [x["pos"] for x in kmers.minimizers(spark.createDataFrame([(1, s)], "id int, s string"), "s", k, w).collect()]
        assert sorted(got) == sorted(want)


def test_unitigs(spark):
    c = kmers.counts(spark.createDataFrame([("ACGTTGCATGGAC",)], "s string"), "s", 5)
    assert [r[0] for r in kmers.unitigs(c).collect()] == ["ACGTTGCATGGAC"]
    circle = kmers.counts(spark.createDataFrame([("AACGTCAACG",)], "s string"), "s", 4)  # six k-mers in a ring
    got = [r[0] for r in kmers.unitigs(circle).collect()]
    assert len(got) == 1 and len(got[0]) == 9 and got[0][:4] == min(r["kmer"] for r in circle.collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusters(spark):
    s = spark.createDataFrame([("a", "ACGU"), ("b", "ACGT"), ("c", "TTTT"), ("d", "N-GT")], "sample string, seq string")
    d = {(r["a"], r["b"]): r["snp_distance"] for r in clusters.pairwise_snp(s).collect()}
    assert d == {("a", "b"): 0, ("a", "c"): 3, ("a", "d"): 0, ("b", "c"): 3, ("b", "d"): 0, ("c", "d"): 1}
    got = dict(map(tuple, clusters.single_linkage(s, clusters.pairwise_snp(s), 0).collect()))
    assert got == {"a": 1, "b": 1, "d": 1, "c": 2}


def test_orfs(spark):
    contig = "CC" + "ATG" + "AAA" * 5 + "TAA" + "GG"
    got = genes.open_reading_frames(spark.createDataFrame([("c", contig), ("r", "")], "contig string, seq string"), least=12)
    assert [tuple(r) for r in got.where("strand = '+'").collect()] == [("c", 3, 23, "+")]
    cds = genes.coding_sequences(got.where("strand = '+'"), spark.createDataFrame([("c", contig)], "contig string, seq string"))
    assert cds.collect()[0]["cds"] == contig[2:23]
    with pytest.raises(ValueError):
        genes.check_table(7)


def test_metadata(spark):
    def read(text):
        return [(r["id"], r["date"], r["location"]) for r in tabular.metadata_rows(spark.createDataFrame([(text,)], "text string")).orderBy("ord").collect()]

    assert read("Location,id,DATE\n\nX,a,2024-99-99\nY,,2024-01-01\nZ,b,\n") == [("a", "2024-99-99", "X"), ("b", "", "Z")]
    with pytest.raises(Exception, match="line 2: date x; line 4: date y"):
        read("id,date,location\na,x,\n\nb,y,\n")
    for bad in ("id,date,location", "id,date\na,b"):
        with pytest.raises(Exception, match="metadata"):
            read(bad)


def test_taxa(spark):
    assert values(spark, hits.composition_percentages, "a b (3); c (1)", "a (x)", "a (0)") == ["a b (3; 75.0%) ; c (1; 25.0%)", "a (x)", "a (0)"]


def test_fnv(spark):
    def plain(s):
        h = 14695981039346656037
        for c in s.encode():
            h = (h ^ c) * 1099511628211 % 2**64
        return h

    texts = ["MK", "", "a", "hello world"]
    assert [int(x) for x in values(spark, sequence.fnv1a, *texts)] == [plain(t) for t in texts]
    assert plain("MK") == 654839471802238953


def test_knn_takes_all_rows(spark):
    """More than 4,000 rows, each one's nearest neighbours by brute force."""
    n, k = 4500, 3
    x = np.random.default_rng(1).normal(size=(n, 8))
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    norms = np.sqrt((x * x).sum(1))
    score = np.round(x @ x.T / np.where(np.outer(norms, norms) > 0, np.outer(norms, norms), 1), 9)
    np.fill_diagonal(score, -np.inf)
    want = {(i, int(j), r + 1) for i in range(n) for r, j in enumerate(np.lexsort((np.arange(n), -score[i]))[:k])}
    assert {(r["id"], r["neighbour"], r["rank"]) for r in vec.knn(df, "id", "v", k).collect()} == want


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([float("nan"), 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.finite(F.col("a")), vectors.squared_distance(F.col("a"), F.col("b"))).collect()
    assert r[0][0] == pytest.approx(0.5**0.5) and r[1][0] == 0 and [x[1] for x in r] == [True, True, False] and r[0][2] == 1


def test_binary(spark, tmp_path):
    m = np.arange(12, dtype="f4").reshape(3, 4)
    (tmp_path / "m.npy").write_bytes(binary.npy_bytes(m))
    assert (np.load(tmp_path / "m.npy") == m).all()
    assert [r["v"] for r in binary.read_matrices(spark, f"{tmp_path}/m.npy").orderBy("ord").collect()] == m.tolist()
    with pytest.raises(ValueError):
        binary.parse_f32(b"123", 1)
    import gzip
    import os

    lines = [os.urandom(700).hex() for _ in range(200)]
    data = "\n".join(lines).encode() + b"\n"
    packed = binary.bgzf_compress(data)
    assert gzip.decompress(packed) == data and binary.gzi_entries(packed)[0][1] == binary.BLOCK_BYTES
    (tmp_path / "x.bgz").write_bytes(packed)
    assert [r["line"] for r in binary.read_bgzf_lines(spark, f"{tmp_path}/x.bgz").orderBy("ord").collect()] == lines
    with pytest.raises(ValueError):
        list(binary.bgzf_blocks(packed[:-10]))


def test_stream_of_chunks(spark, tmp_path):
    text = ">a x\nACGT\nAC\n>b\n\n>c\nG" + "T" * 50
    parts = [text[i : i + 7] for i in range(0, len(text), 7)]
    rows = [("f", i, p, i == len(parts) - 1) for i, p in enumerate(parts)]
    schema = "file string, chunk long, text string, last boolean"
    random.Random(1).shuffle(rows)
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = reads.fasta_from_chunks(stream).writeStream.format("memory").queryName("records").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["header"], r["seq"]) for r in spark.sql("SELECT * FROM records ORDER BY ord").collect()] == [("a x", "ACGTAC"), ("b", ""), ("c", "G" + "T" * 50)]


def test_significant_digits(spark):
    values = [0.0, 1.0, -1234.5678, 123456.78, 1234567.8, 12345678.0, 0.000012345678, 0.0000001234, 1e21, -9.9999999]
    want = ["0.000000", "1.000000", "-1234.568", "123456.8", "1234568", "1.234568e+7", "0.00001234568", "1.234000e-7", "1.000000e+21", "-10.00000"]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", sequence.to_precision(F.col("x")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == want
    odd = spark.sql("SELECT double('NaN') x UNION ALL SELECT double('inf') UNION ALL SELECT null").select(sequence.to_precision(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in odd] == ["NaN", "Infinity", None]


def test_quality_modes(spark):
    reads = spark.createDataFrame([("acgta", "II#II"), ("AC", "I"), ("GGG", None)], "s string, q string")
    got = {m: sorted(r["kmer"] for r in kmers.quality_kmers(reads, "s", "q", 3, 20, m).collect()) for m in (0, 1, 2)}
    assert got == {0: ["ACG", "CGT", "GGG", "GTA"], 1: ["ACG", "GTA"], 2: []}
    with pytest.raises(ValueError):
        kmers.quality_kmers(reads, "s", "q", 3, 20, 3)


def test_repeats_are_masked_over_all_references(spark):
    refs = spark.createDataFrame([(1, "AACGTT"), (2, "CACGCC"), (3, None)], "id int, s string")
    assert sorted(map(tuple, kmers.repeats_masked(refs, "id", "s", 3).collect())) == [(1, "ANNNTT"), (2, "CNNNCC")]


def test_upsert_and_call_totals(spark):
    held, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, hits.upserted(held, new, "k").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    genes_, contigs = spark.createDataFrame([("x",), ("x",), ("gone",)], "contig string"), spark.createDataFrame([("x",), ("y",)], "contig string")
    assert tuple(hits.call_totals(genes_, contigs).first()) == (2, 2)
    assert tuple(hits.call_totals(genes_.limit(0), contigs.limit(0)).first()) == (0, 0)


def test_orfs_of_long_and_many_contigs(spark):
    """Equal to walking every frame, with other letters and short contigs; a contig of 600,000 letters and some thousand frames in time that follows its length."""
    import time

    rng = random.Random(9)
    texts = ["".join(rng.choices("ACGTNé", [9, 9, 9, 9, 0.2, 0.1], k=n)) for n in (0, 1, 2, 3, 4, 12, 13, 95, 300, 301, 302, 2000)]

    def walked(s, strand, n, least):
        for f in range(3):
            first = None
            for p in range(f, len(s) - 2, 3):
                codon = s[p : p + 3]
                if codon in ("TAA", "TAG", "TGA"):
                    if first is not None and p + 3 - first >= least:
                        a, b = (first + 1, p + 3) if strand == "+" else (n - p - 2, n - first)
                        yield a, b, strand
                    first = None
                elif first is None and codon in ("ATG", "GTG", "TTG"):
                    first = p

    mirror = lambda s: s.upper().translate(str.maketrans("ACGTU", "TGCAA"))[::-1]
    want = {(i, *x) for i, t in enumerate(texts) for strand, s in (("+", t.upper()), ("-", mirror(t))) for x in walked(s, strand, len(t), 30)}
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "contig int, seq string")
    got = genes.open_reading_frames(df, least=30).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20
    long = spark.createDataFrame([("long", ("ATG" + "AAA" * 30 + "TAAC") * 6000)], "contig string, seq string")
    began = time.time()
    assert genes.open_reading_frames(long).where("strand = '+'").count() == 6000
    assert time.time() - began < 20


def test_unitigs_by_numbers(spark, monkeypatch):
    """Long paths, branches, rings and self loops are those of a walk, whether what is looked for is broadcast or not."""
    rng = random.Random(2)
    texts = ["".join(rng.choices("ACGT", k=90)), "AAAAAAAA", "ACGTTGCATGGACTTTTGCATGGCA"] + [(ring := "".join(rng.choices("CG", k=17))) + ring[:6]]
    held = {t[i : i + 7] for t in texts for i in range(len(t) - 6)}
    after = {x: [x[1:] + c for c in "ACGT" if x[1:] + c in held] for x in held}
    before = {x: [c + x[:-1] for c in "ACGT" if c + x[:-1] in held] for x in held}
    link = {x: after[x][0] for x in held if len(after[x]) == 1 and len(before[after[x][0]]) == 1 and after[x][0] != x}
    want, seen = [], set()
    for x in [*sorted(held - set(link.values())), *sorted(held)]:
        if x not in seen:
            text = x
            seen.add(x)
            while x in link and link[x] not in seen:
                x = link[x]
                seen.add(x)
                text += x[-1]
            want.append(text)
    counted = spark.createDataFrame([(x,) for x in held], "kmer string")
    for few in (kmers.FEW_STEPS, 0):
        monkeypatch.setattr(kmers, "FEW_STEPS", few)
        assert sorted(r[0] for r in kmers.unitigs(counted).collect()) == sorted(want)
