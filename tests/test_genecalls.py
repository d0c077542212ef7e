"""Gene calling against plain scans, all chains, and planted genes."""

import itertools
import math
import random

import numpy as np
import pytest
from kmerloom.functions import codons
from kmerloom.operators import genecalls
from kmerloom.operators.genecalls import Gene, Settings, best_chain, candidates

PAIR = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(PAIR)[::-1]


def plain_candidates(text, settings, left, right):
    """(start, end, strand, codon, no stop) by walking every frame."""
    out, stops = set(), codons.stops(settings.table)
    starts = [c for c in ("ATG", "GTG", "TTG") if c in codons.starts(settings.table)]
    for strand, s, l, r in (("+", text, left, right), ("-", rc(text), right, left)):
        n = len(s)
        for f in range(3):
            begun = [(f, "edge")] if l and not settings.closed_ends else []
            p = f
            while True:
                codon = s[p : p + 3]
                done = len(codon) < 3
                if done or codon in stops:
                    end = p if done else p + 3
                    if not done or (r and not settings.closed_ends):
                        for q, c in begun:
                            short = genecalls.LEAST_PARTIAL if c == "edge" or done else settings.least
                            if end - q >= short and (c == "edge" or (q, "edge") not in begun):
                                a, b = (q, end) if strand == "+" else (n - end, n - q)
                                out.add((a, b, strand, c, done))
                    begun = []
                elif codon in starts:
                    begun.append((p, codon))
                if done:
                    break
                p += 3
    return out


@pytest.mark.parametrize("table,closed,ends", [(11, True, (True, True)), (11, False, (True, True)), (11, False, (False, True)), (4, False, (True, False)), (1, True, (True, True)), (6, False, (True, True))])
def test_candidates(table, closed, ends):
    rng = random.Random(table)
    settings = Settings(table=table, closed_ends=closed, least=30)
    for n in (0, 1, 5, 96, 300, 301, 302):
        text = "".join(rng.choice("ACGT") for _ in range(n))
        model = genecalls.Model(np.zeros(4096), np.zeros(3), np.zeros(5))
        got = {(g.start, g.end, g.strand, genecalls.START_CODONS[g.codon] if g.codon >= 0 else "edge", g.no_stop) for g in candidates(text, model, settings, *ends)}
        assert got == plain_candidates(text, settings, *ends)


def test_scores():
    """A gene's score is the sum of its hexamers, its start's and its motif's odds."""
    rng = np.random.default_rng(3)
    model = genecalls.Model(rng.normal(size=4096), rng.normal(size=3), rng.normal(size=5))
    body = "ATG" + "AAACCCGGG" * 12 + "TAA"
    text = "CCCC" + "AGGAGG" + "TTTTTTT" + body + "CC"
    g = max((g for g in candidates(text, model, Settings(), False, False) if g.strand == "+" and g.start == 17), key=lambda g: g.end)
    number = lambda s: sum("ACGT".index(c) * 4 ** (len(s) - 1 - i) for i, c in enumerate(s))
    inside = sum(model.hexamers[number(body[i : i + 6])] for i in range(0, len(body) - 8, 3))
    assert g.end == 17 + len(body) and g.motif == 4 and g.score == pytest.approx(inside + model.starts[0] + model.motifs[4])


def test_best_chain_of_all_chains():
    rng = random.Random(5)
    for _ in range(60):
        genes = []
        for _ in range(9):
            a = rng.randint(0, 500)
            genes.append(Gene(a, a + rng.randint(90, 260), rng.choice("+-"), rng.uniform(-3, 12), 0, 0, False))

        def value(chain):
            total = 0.0
            for g, h in itertools.pairwise(chain):
                over = g.end - h.start
                if not (g.start < h.start and g.end < h.end and over < genecalls.OVERLAP):
                    return -math.inf
                total -= genecalls.OVERLAP_COST * max(over, 0)
            return total + sum(g.score for g in chain)

        every = sorted(genes, key=lambda g: (g.end, g.start))
        best = max(value(c) for k in range(10) for c in itertools.combinations(every, k) if all(g.score > 0 for g in c))
        assert value(best_chain(genes)) == pytest.approx(best)


def planted(rng, n_genes):
    """A contig of genes with few kinds of codons, on both strands, most behind a motif, and where they are."""
    usual = [c for c in codons.table(11) if codons.table(11)[c] != "*"]
    weights = [rng.random() ** 4 + 0.01 for _ in usual]
    text, places = "", []
    for _ in range(n_genes):
        text += "".join(rng.choice("ACGT") for _ in range(rng.randint(40, 160)))
        gene = "ATG" + "".join(rng.choices(usual, weights, k=rng.randint(60, 300))) + rng.choice(["TAA", "TGA", "TAG"])
        front = "AGGAGG" + "".join(rng.choice("ACT") for _ in range(7))
        if rng.random() < 0.5:
            places.append((len(text) + len(front) + 1, len(text) + len(front) + len(gene), "+"))
            text += front + gene
        else:
            places.append((len(text) + 1, len(text) + len(gene), "-"))
            text += rc(front + gene)
    return text + "".join(rng.choice("ACGT") for _ in range(100)), places


def test_planted_genes(spark):
    rng = random.Random(11)
    text, places = planted(rng, 90)
    rows = [("one", text, 1, "x"), ("short", "ATG" * 20, 1, "x"), (None, None, 1, "x"), ("empty", "", 1, "x")]
    df = spark.createDataFrame(rows, "contig string, seq string, at int, text string")
    got = genecalls.call_genes(df).collect()
    assert {r["contig"] for r in got} == {"one"}
    found = {(r["start"], r["end"], r["strand"]) for r in got}
    stops = {(s, e if s == "+" else b) for b, e, s in found}
    assert sum((s, e if s == "+" else b) in stops for b, e, s in places) >= 0.95 * len(places)
    assert len(found & set(places)) >= 0.8 * len(places) and len(found) <= 1.15 * len(places)
    # pieces with margins give what the whole gives
    cut = {(r["start"], r["end"], r["strand"]) for r in genecalls.call_genes(df, core=9_000, margin=4_000).collect()}
    assert len(cut ^ found) <= 0.04 * len(found)
    lines = genecalls.gff_lines(genecalls.call_genes(df)).orderBy("start").collect()
    assert len(lines) == len(got) and lines[0]["value"].split("\t")[8].startswith("ID=one_1;partial=") and len(lines[0]["value"].split("\t")) == 9


def test_no_contigs_and_masks(spark):
    empty = spark.createDataFrame([], "contig long, seq string")
    assert genecalls.call_genes(empty).count() == 0
    with pytest.raises(ValueError):
        genecalls.call_genes(empty, settings=Settings(table=7))
    gene = "ATG" + "AAA" * 40 + "N" * 60 + "CCC" * 40 + "TAA"
    over = lambda mask: [g for g in candidates(gene, None, Settings(mask_n_runs=mask), False, False) if g.start < 120 and g.end > 190]
    assert over(False) and not over(True)


def test_genetic_codes(spark):
    assert set(codons.CHANGES) == set(codons.STARTS) == set(range(1, 26)) - {7, 8, 17, 18, 19, 20}
    assert codons.table(0) == codons.table(11) and codons.stops(11) == {"TAA", "TAG", "TGA"} and codons.stops(4) == {"TAA", "TAG"} and codons.stops(2) == {"TAA", "TAG", "AGA", "AGG"}
    assert codons.stops(6) == {"TGA"} and codons.table(12)["CTG"] == "S" and codons.table(25)["TGA"] == "G"
    df = spark.createDataFrame([("GTGAAATGGTAA",), ("ttgnnnTGA",), ("ATGUGATAA",), ("AT",), (None,)], "cds string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(codons.protein(F.col("cds"), 11)).collect()] == ["MKW", "MX", "M*", "", None]
    assert df.select(codons.protein(F.col("cds"), 4)).collect()[2][0] == "MW"


def test_pieces_together_are_pieces_alone():
    """Texts looked at together have the candidates and chains that each has alone."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("ACGTN", [9, 9, 9, 9, 0.3], k=n)) for n in (0, 1, 2, 4, 95, 96, 97, 400, 3001, 700)]
    left, right = [[rng.random() < 0.5 for _ in texts] for _ in range(2)]
    model = genecalls.Model(*(np.random.default_rng(1).normal(size=n) for n in (4096, 3, 5)))
    settings = Settings(mask_n_runs=True)
    both = genecalls.Pieces(texts, left, right, settings)
    alone = [candidates(t, model, settings, a, b) for t, a, b in zip(texts, left, right, strict=True)]
    assert both.genes(both.found(model)) == alone and sum(map(len, alone)) > 20
    assert both.chains(model) == [best_chain(own) for own in alone]
    held = [sum(len(p.lengths) for p, _ in genecalls.together(iter([(300, 0, 0, 300, "ACG" * 100)] * n), settings)) for n in (0, 1, 5000)]
    assert held == [0, 1, 5000]
