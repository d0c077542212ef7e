import gzip
import random

import pytest
from kmerloom.sources import fastq_splits


def records(n, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        size = r.choice([0, 1, 7, 40, 150])
        qual = "".join(r.choice("@+IF#5") for _ in range(size))
        out.append((f"r{i} x", "".join(r.choice("ACGT") for _ in range(size)), qual))
    return out


def text_of(rows, end="\n", blank_every=5):
    return "".join(("" if i % blank_every else end * 2) + f"@{h}{end}{s}{end}+{end}{q}{end}" for i, (h, s, q) in enumerate(rows))


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_files_in_many_splits(spark, tmp_path, small_splits, monkeypatch, end, few):
    if not few:
        monkeypatch.setattr(fastq_splits, "MOST_BROADCAST_SPLITS", 0)
    want = {}
    for k, n in enumerate((300, 77, 1, 0)):
        rows = records(n, seed=k)
        (tmp_path / f"f{k}.fastq").write_bytes(text_of(rows, end).encode())
        want |= {(k, i): r for i, r in enumerate(rows)}
    members = records(120, seed=9)
    half = text_of(members[:60]).encode(), text_of(members[60:], blank_every=7).encode()
    (tmp_path / "f8.fastq.gz").write_bytes(gzip.compress(half[0]) + gzip.compress(half[1]))
    want |= {(8, i): r for i, r in enumerate(members)}
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    got = fastq_splits.read_fastq(spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    assert {(int(r["file"].rsplit("/f", 1)[1].split(".")[0]), r["ord"]): (r["header"], r["seq"], r["qual"]) for r in got} == want


@pytest.mark.parametrize("text, message", [("@a\nAC\n+\nII\n@b\nA\n", "partial"), ("a\nAC\n+\nII\n", "without @"), ("@a\nAC\n-\nII\n", "without +"), ("@a\nAC\n+\nIII\n", "unequal")])
def test_what_is_no_record_fails(spark, tmp_path, text, message):
    (tmp_path / "x.fq").write_text(text)
    with pytest.raises(Exception, match=message.replace("+", r"\+")):
        fastq_splits.read_fastq(spark, str(tmp_path)).collect()
