"""Sequence files of all kinds in one folder, in ranges of any size, and files that fail."""

import gzip
import os
import random

import pytest
from kmerloom.sources import sniffed


def fastq(rng, n):
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 7, 60])
        # qualities may begin with '@' and '+', as headers and third lines do
        qual = "".join(rng.choice("@+>IIIF#") for _ in range(size))
        out.append((f"r{i} é" if i % 5 == 0 else f"@r{i}", "".join(rng.choice("ACGTN") for _ in range(size)), qual))
    return out


def text_of(records, end="\n"):
    return end.join(f"@{h}{end}{s}{end}+{h if len(h) % 2 else ''}{end}{q}" for h, s, q in records) + end


def read(spark, path, split=None):
    sniffed.register(spark)
    reader = spark.read.format("sequence_files")
    df = (reader.option("splitBytes", split) if split else reader).load(str(path))
    by = {}
    for r in df.collect():
        by.setdefault(os.path.basename(r["file"]), []).append((r["at"], r["header"], r["seq"], r["qual"]))
    return {k: [x[1:] for x in sorted(v)] for k, v in by.items()}


@pytest.mark.parametrize("split", [None, 1000, 97])
def test_one_folder_of_everything(spark, tmp_path, split):
    rng = random.Random(5)
    reads = fastq(rng, 150)
    genomes = [(f"chr{i} x", "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 5, 300])))) for i in range(40)]
    fasta = "".join(f">{h}\n" + "".join(s[k : k + 60] + "\n" for k in range(0, len(s), 60)) for h, s in genomes)
    (tmp_path / "a.fastq").write_text(text_of(reads))
    (tmp_path / "b.fa").write_bytes(text_of(reads, "\r\n").encode())  # FASTQ under a FASTA name
    (tmp_path / "c.fastq").write_bytes(gzip.compress(text_of(reads[:70]).encode()) + gzip.compress(text_of(reads[70:]).encode()))  # gzipped, two members, without .gz
    (tmp_path / "d.fa.gz").write_text("\n\n" + fasta)  # plain, with .gz
    (tmp_path / "e.gz").write_bytes(gzip.compress(fasta.removesuffix("\n").encode()))
    spaced = [("x", "ACGT", "IIII"), ("y", "", ""), ("z", "A", "@")]
    (tmp_path / "f.fq").write_text("\n" + "\n\n".join(text_of([r]) for r in spaced) + "\n\n")
    (tmp_path / "empty.fq").write_text("")
    (tmp_path / "blank.fq.gz").write_bytes(gzip.compress(b"\n\n"))
    (tmp_path / "_SUCCESS").write_text("")
    got = read(spark, tmp_path, split)
    plain = [(h, s, None) for h, s in genomes]
    if split:
        assert len(sniffed.SequenceReader(str(tmp_path / "a.fastq"), split).partitions()) > 5
    assert got == {"a.fastq": reads, "b.fa": reads, "c.fastq": reads, "d.fa.gz": plain, "e.gz": plain, "f.fq": spaced}


@pytest.mark.parametrize("content,told", [
    (b"ACGT\n", "neither FASTA nor FASTQ"), (b"@r\nACGT\n-\nIIII\n", "third line"), (b"@r\nACGT\n+\nIII\n", "unequal length"), (b"@r\nACGT\n+\n", "partial record"),
    (b"@r\nA\n+\nI\nr2\nA\n+\nI\n", "without @"), (gzip.compress(b"@r\nACGT\n+\nIIII\n" * 999)[:-30], "end-of-stream|damaged|EOF")])
def test_bad_files(spark, tmp_path, content, told):
    (tmp_path / "x.fq").write_bytes(content)
    with pytest.raises(Exception, match=told):
        read(spark, tmp_path / "x.fq")


def test_no_files(spark, tmp_path):
    assert read(spark, tmp_path) == {}
    with pytest.raises(Exception, match="there is no"):
        read(spark, tmp_path / "none")
