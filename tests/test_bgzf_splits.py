"""Block-compressed text in many ranges equals one read; the sink's files are what other readers expect."""

import glob
import gzip
import os
import random
import struct

import pytest
from kmerloom.sources import bgzf_splits, binary


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("ACGTé\t ") for _ in range(rng.choice([0, 3, 40, 200]))) for _ in range(n)]


def plain_lines(content):
    """(place, line, virtual offset of its begin) by walking the blocks."""
    data, blocks = b"", []
    for at, out, part in binary.bgzf_blocks(content):
        if part:
            blocks.append((out, at))
        data += part
    out, place = [], 0
    for raw in data.split(b"\n")[: -1 if data.endswith(b"\n") or not data else None]:
        o, at = max(b for b in blocks if b[0] <= place)
        out.append((place, raw.decode().removesuffix("\r"), at << 16 | place - o))
        place += len(raw) + 1
    return out


@pytest.mark.parametrize("size", ["1m", "30k", "9k"])
def test_ranges_equal_one_read(spark, tmp_path, size):
    lines = texts(1, 6000) + ["x" * 200_000, "carriage\r", "last without a line feed"]
    content = binary.bgzf_compress("\n".join(lines).encode())
    blocks = b"".join(binary.bgzf_block(p.encode()) for p in ("one\ntwo", "\n", "th", "ree\n\nfive")) + binary.END_BLOCK  # small blocks, cut anywhere
    (tmp_path / "a.bgz").write_bytes(content)
    (tmp_path / "b.bgz").write_bytes(blocks)
    (tmp_path / "c.bgz").write_bytes(binary.END_BLOCK)
    (tmp_path / "d.gz").write_bytes(blocks)
    (tmp_path / "e.bgz").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = bgzf_splits.read_lines(spark, str(tmp_path))
        by = {}
        for r in got.collect():
            by.setdefault(os.path.basename(r["file"]), []).append((r["place"], r["line"], r["voffset"]))
        assert {k: sorted(v) for k, v in by.items()} == {"a.bgz": plain_lines(content), "b.bgz": plain_lines(blocks), "d.gz": plain_lines(blocks)}
        if size != "1m":
            assert bgzf_splits._pieces(spark, str(tmp_path / "a.bgz")).rdd.getNumPartitions() > 3
        rows = bgzf_splits.gzi_rows(spark, str(tmp_path / "a.bgz"))
        assert sorted((r["compressed"], r["uncompressed"]) for r in rows.collect()) == binary.gzi_entries(content)
        index = bgzf_splits.gzi_bytes(rows)
        assert struct.unpack("<Q", index[:8])[0] == rows.count() and len(index) == 8 + 16 * rows.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_magic_inside_a_block(spark, tmp_path):
    """Stored blocks that hold the very bytes by which files are cut."""
    data = (b"abc" + bgzf_splits.MAGIC + b"def\n") * 50
    body = struct.pack("<BHH", 1, len(data), len(data) ^ 0xFFFF) + data
    import zlib

    block = struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))
    (tmp_path / "m.bgz").write_bytes(block * 3 + binary.END_BLOCK)
    assert sum(len(r["data"]) for r in bgzf_splits.read_blocks(spark, str(tmp_path / "m.bgz")).collect()) == 3 * len(data)


def test_damage_fails(spark, tmp_path):
    content = bytearray(binary.bgzf_compress("\n".join(texts(2, 3000)).encode()))
    for name, change in (("sum", -40), ("body", 300)):
        bad = bytearray(content)
        bad[change] ^= 0xFF
        (tmp_path / f"{name}.bgz").write_bytes(bad)
        with pytest.raises(Exception, match="damaged|not a BGZF|cut short"):
            bgzf_splits.read_lines(spark, str(tmp_path / f"{name}.bgz")).count()
    (tmp_path / "cut.bgz").write_bytes(content[:-60])
    with pytest.raises(Exception, match="damaged|not a BGZF|cut short"):
        bgzf_splits.read_lines(spark, str(tmp_path / "cut.bgz")).count()


def test_sink(spark, tmp_path):
    lines = texts(5, 9000)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)] + [(9000, None)], "i int, line string").repartitionByRange(3, "i").sortWithinPartitions("i")
    bgzf_splits.write_lines(df, str(tmp_path / "out"))
    files = sorted(glob.glob(str(tmp_path / "out" / "part-*")))
    assert len(files) == 3
    text = ""
    for f in files:
        raw = open(f, "rb").read()
        assert raw.endswith(binary.END_BLOCK)
        sizes = [len(d) for *_, d in binary.bgzf_blocks(raw) if d]
        assert sizes and all(s == binary.BLOCK_BYTES for s in sizes[:-1])
        text += gzip.decompress(raw).decode()
    assert text.split("\n")[:-1] == lines + [""]
    back = bgzf_splits.read_lines(spark, str(tmp_path / "out")).orderBy("file", "place").collect()
    assert [r["line"] for r in back] == lines + [""]
    bgzf_splits.write_lines(df.limit(0), str(tmp_path / "none"))
    assert bgzf_splits.read_lines(spark, str(tmp_path / "none")).count() == 0
