"""k-mers counted by runs: equal to plain counts, on both strands and by group, however small the chunks; runs, not k-mers, are shuffled."""

import random
from collections import Counter

import pytest
from kmerloom.operators import kmers, runs


def reads():
    rng = random.Random(5)
    text = "".join(rng.choice("ACGT") for _ in range(3000))
    odd = ["Straße ﬁn ΐ " * 9, "STRASSE" * 5, "".join(rng.choice("acgtuACGTUßΐ\U0001f600漢") for _ in range(400)), "A" * 3000, "ab" * 700, "ACGU" * 20]
    return [text[i : i + 100] for i in range(0, 2900, 9)] + odd + [None, "", "ACG", "A"]


def mirror(s):
    return s.upper().translate(str.maketrans("ACGTU", "TGCAA"))[::-1]


def plain(texts, k, both=False):
    own = Counter(t[i : i + k] for t in texts if t for i in range(len(t) - k + 1))
    if not both:
        return own
    out = Counter()
    for s, n in own.items():
        out[min(s, mirror(s))] += n
    return out


@pytest.mark.parametrize("k,both,least", [(31, False, 1), (21, True, 1), (31, False, 5), (8, True, 3), (1, False, 1), (2, True, 1), (9, False, 2)])
def test_equal_to_plain_counts(spark, k, both, least):
    df = spark.createDataFrame([(t, 1) for t in reads()], "seq string, place int").repartition(5)
    want = plain(reads(), k, both)
    got = runs.counts(df, "seq", k, both, least).collect()
    assert len(got) == len({r["kmer"] for r in got})
    assert {r["kmer"]: r["n"] for r in got} == {s: n for s, n in want.items() if n >= least}
    spectrum = Counter(want.values())
    assert {r["n"]: r["n_kmers"] for r in runs.multiplicities(df, "seq", k, both).collect()} == spectrum
    assert {r[0]: r[1] for r in kmers.spectrum_of(df, "seq", k, both, bins=4).collect()} == dict(Counter(min(n, 4) for n in want.values()))


def test_groups_and_no_rows(spark):
    texts = reads()
    df = spark.createDataFrame([(t, None if i % 3 == 2 else f"g{i % 3}") for i, t in enumerate(texts)], "seq string, g string").repartition(3)
    got = {(r["g"], r["kmer"]): r["n"] for r in runs.counts(df, "seq", 17, least=2, by="g").collect()}
    want = {(g, s): n for at, g in enumerate(("g0", "g1", None)) for s, n in plain(texts[at::3], 17).items() if n >= 2}
    assert got == want
    assert runs.counts(df.where("false"), "seq").count() == 0 and runs.multiplicities(df.where("false"), "seq").count() == 0


@pytest.mark.parametrize("both", [False, True])
def test_chunks_of_any_size(both):
    """A place that is taken in many chunks counts as in one; held are a chunk and the distinct k-mers."""
    texts, k = reads(), 8
    held = [Counter(runs._cut([t], k, 1, both)) for t in texts if t]
    small = runs.Counted(k, both)
    before, runs.CHUNK = runs.CHUNK, 500
    try:
        for h in held:
            for row in runs._packed(h, None):
                small.add(row["runs"], row["size"], row["data"])
    finally:
        runs.CHUNK = before
    codes, starts, n = small.settle()
    got = dict(zip(runs.windows_at(codes, starts, k).to_pylist(), n.tolist(), strict=True)) | dict(small.odd)
    assert got == plain(texts, k, both)


def test_runs_are_a_few_letters_a_kmer():
    """Plain k-mers of a text take 31 letters each in the shuffle."""
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(20000))
    own = list(runs._cut([text], 31, 7, False))
    assert sum(len(r) - 30 for _, r in own) == len(text) - 30
    assert sum(len(r) for _, r in own) < 6 * len(text)
    # equal runs of many copies go once
    assert len(Counter(runs._cut([text] * 3, 31, 7, False))) <= len(own)


def test_no_sketch_where_it_would_let_all_through():
    from kmerloom.operators import counting

    assert counting.counter_bits(25_000_000, 5) == 26
    assert counting.counter_bits(1_500_000_000, 5) is None


def test_flanks_around_different_letters(spark):
    """Flanks meet in one place whatever stands between them; before, all split k-mers of all samples were shuffled."""
    rng = random.Random(6)
    text = "".join(rng.choice("ACGTé") for _ in range(600))
    texts = [text, text[:200] + "x" + text[201:], text[:400] + "y" + text[401:] + text, None, "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string").repartition(3)
    for flank in (1, 2, 4, 15):
        middles = {}
        for t in texts:
            for i in range(len(t or "") - 2 * flank):
                middles.setdefault(t[i : i + flank] + t[i + flank + 1 : i + 2 * flank + 1], []).append(t[i + flank])
        want = sorted(x for x, own in middles.items() if len(own) >= 3 and len(set(own)) > 1)
        assert sorted(r[0] for r in runs.varied_flanks(df, "s", flank, 3).collect()) == want and want
    own = list(runs._cut([text], 31, 7, False, 15))
    assert sum(len(r) - 30 for _, r in own) == 570


@pytest.mark.parametrize("at_once,compared", [(1 << 22, 1 << 20), (700, 1 << 20), (300, 5)])
def test_a_place_of_any_size_is_taken_in_parts(monkeypatch, at_once, compared):
    """However many flanks meet in a place, no more than some are held; before, the letters of all its k-mers were. Rows that are spilled to a file are the same."""
    rng = random.Random(9)
    text = "".join(rng.choice("ACGTé漢") for _ in range(900))
    texts = [text, "".join(x if rng.random() < 0.9 else "\U0001f600" for x in text), "abcab" * 60, text[:300], "ab"]
    for flank in (2, 15):
        k = 2 * flank + 1
        middles = {}
        for t in texts:
            for i in range(len(t) - k + 1):
                middles.setdefault(t[i : i + flank] + t[i + flank + 1 : i + k], []).append(t[i + flank])
        want = sorted(x for x, own in middles.items() if len(own) >= 2 and len(set(own)) > 1)
        for name, value in (("AT_ONCE", at_once), ("COMPARED", compared), ("STEP", 400), ("SPOOLED", 1000)):
            monkeypatch.setattr(runs, name, value)
        rows = runs._Spooled(k, flank)
        for t in texts:
            for row in runs._packed(Counter(runs._cut([t], k, 1, False, flank)), None):
                rows.add(row["runs"], row["size"], runs.pa.py_buffer(row["data"]))
        most, sort = [], runs.np.argsort
        monkeypatch.setattr(runs.np, "argsort", lambda a, *b, **c: most.append(len(a)) or sort(a, *b, **c))
        got = [x for found in runs.varied_in(rows, 2) for x in found]
        monkeypatch.setattr(runs.np, "argsort", sort)
        assert sorted(got) == want and want and len(set(got)) == len(got)
        assert len(most) > 1 and (at_once > 1000 or max(most) < 2 * at_once < rows.kmers)


@pytest.mark.parametrize("k,both,flank", [(8, False, None), (21, True, None), (31, False, 15), (1, False, None), (3, False, 1)])
def test_runs_in_arrays_are_the_runs_of_texts(k, both, flank):
    """Packed in arrays, equal runs once, with their number; before, each run was a text in a dictionary, some 270 bytes each."""
    texts = [t for t in reads() if t] * 2
    n = 5
    want = Counter(x for t in texts for x in runs._cut([t], k, n, both, flank))
    held, got = runs._Held(k, n, both, flank), {}
    for part in (texts[:50], texts[50:51], texts[51:]):
        held.add(part)
    for row in held.packed():
        letters, lengths, numbers = runs._unpacked(row["runs"], row["size"], row["data"])
        text = letters.astype("<u4").tobytes().decode("utf-32-le")
        for i, (size, times) in enumerate(zip(lengths.tolist(), numbers.tolist())):
            at = int(lengths[:i].sum())
            assert (row["place"], text[at : at + size]) not in got
            got[row["place"], text[at : at + size]] = times
    assert got == want and max(want.values()) > 1
    assert not list(held.packed())
