"""Binary interval indexes: round trip, and regions read by them against a scan of all features."""

import random

import pytest
from kmerloom.functions.bins import LEVELS, bin_first
from kmerloom.sources import bgzf_splits, binary, regions


@pytest.fixture(scope="module")
def gff(tmp_path_factory):
    """A file of sorted features on three sequences, from one letter to a million, in small blocks."""
    rng, lines = random.Random(8), ["##gff-version 3", "#comment"]
    for seq, n in (("chr2", 900), ("chr1", 300), ("plasmid é", 40)):
        features = []
        for _ in range(n):
            beg = rng.randrange(3_000_000)
            features.append((beg, beg + rng.choice([1, 300, 5000, 40_000, 1_000_000])))
        lines += ["\t".join([seq, "src", "CDS", str(b + 1), str(e), ".", "+", "0", f"ID={seq}{i}"]) for i, (b, e) in enumerate(sorted(features))]
    text = ("\n".join(lines) + "\n").encode()
    path = tmp_path_factory.mktemp("gff") / "a.gff.bgz"
    path.write_bytes(b"".join(binary.bgzf_block(text[k : k + 1500]) for k in range(0, len(text), 1500)) + binary.END_BLOCK)
    return str(path), lines


def test_index_and_regions(spark, gff):
    path, lines = gff
    features = regions.gff_features(bgzf_splits.read_lines(spark, path))
    rows = regions.index_rows(features)
    content = regions.csi_bytes(rows)
    index = regions.parse_csi(content)
    assert list(index) == ["chr2", "chr1", "plasmid é"]
    pseudo = bin_first(LEVELS + 1) + 1
    assert [index[s].pop(pseudo)[1][1] for s in index] == [(900, 0), (300, 0), (40, 0)]
    assert {(r["seq"], r["bin"]): (r["loff"], [tuple(c) for c in r["chunks"]]) for r in rows.collect()} == {(s, b): v for s, own in index.items() for b, v in own.items()}
    plain = [x.split("\t") for x in lines if not x.startswith("#")]
    rng = random.Random(1)
    for seq in ("chr1", "chr2", "plasmid é", "none"):
        for _ in range(2):
            beg = rng.randrange(3_200_000)
            end = beg + rng.choice([1, 16_384, 90_000])
            want = sorted("\t".join(f) for f in plain if f[0] == seq and int(f[3]) - 1 < end and int(f[4]) > beg)
            assert sorted(r["line"] for r in regions.read_region(spark, path, content, seq, beg, end).collect()) == want


def test_a_region_opens_its_chunks_only(spark, gff):
    path, _ = gff
    content = regions.csi_bytes(regions.index_rows(regions.gff_features(bgzf_splits.read_lines(spark, path))))
    size = len(open(path, "rb").read())
    own = regions.chunks_of(regions.parse_csi(content)["chr1"], 1_000_000, 1_010_000)
    assert own and sum((hi >> 16) - (lo >> 16) for lo, hi in own) < size / 3

    class Counted:
        read_ = 0

        def __init__(self):
            self.file = open(path, "rb")

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            Counted.read_ += n
            return self.file.read(n)

    for lo, hi in own:
        assert list(regions._block_lines(Counted(), lo, hi))
    assert Counted.read_ < size / 2


def test_bad_and_empty_indexes(spark):
    with pytest.raises(ValueError):
        regions.parse_csi(binary.bgzf_compress(b"BAI\x01" + bytes(40)))
    empty = spark.createDataFrame([], "seq string, beg long, end long, voffset long, end_voffset long")
    assert regions.parse_csi(regions.csi_bytes(regions.index_rows(empty))) == {}


def test_tasks_follow_the_features(spark, monkeypatch):
    """Tasks grow with the features, and rows are those of a plain form whatever their number; windows without a feature or an offset take the next one's."""
    from kmerloom.operators import intervals

    rng = random.Random(3)
    rows = [(rng.choice("abc"), beg, beg + rng.choice([1, 20_000, 90_000]), rng.choice([None, i]) if i % 5 == 0 else i, i + 1) for i, beg in enumerate(rng.randrange(3_000_000) for _ in range(300))]
    df = spark.createDataFrame([*rows, ("d", -5, 0, 7, 8)], "seq string, beg long, end long, voffset long, end_voffset long")
    want = {}
    for name in "abc":
        first = {}
        for seq, beg, end, at, _ in rows:
            for w in range(beg >> 14, (end - 1 >> 14) + 1) if seq == name else ():
                first[w] = min((x for x in (first.get(w), at) if x is not None), default=None)
        for w in range(max(first) + 1):
            want[name, w] = next((first[x] for x in range(w, max(first) + 1) if first.get(x) is not None), None)
    before = sorted(map(str, regions.index_rows(df.where("voffset is not null")).collect()))
    assert intervals.tasks_for(df) == 1
    monkeypatch.setattr(intervals, "TASK_ROWS", 40)
    linear = intervals.linear_index(df, offset="voffset")
    assert intervals.tasks_for(df) == linear.rdd.getNumPartitions() == 8
    assert {(r["seq"], r["window"]): r["voffset"] for r in linear.collect()} == want
    assert sorted(map(str, regions.index_rows(df.where("voffset is not null")).collect())) == before
