"""Assembly against a plain form over dictionaries, on reads with planted errors and on odd graphs."""

import random
from collections import Counter

import pytest
from kmerloom.operators import assembly, kmers

PAIR = str.maketrans("ACGTU", "TGCAA")


def rc(s):
    return s.upper().translate(PAIR)[::-1]


class Plain:
    """Segments by their first k-mer: [last, text, k-mers, depth]."""

    def __init__(self, counts):
        self.segments = {}
        for x, n in counts.items():
            for s in {x, rc(x)}:
                self.segments[s] = (s, s, 1, n)

    def links(self):
        by = {}
        for first in self.segments:
            by.setdefault(first[:-1], []).append(first)
        return [(s, t) for s, (last, *_) in self.segments.items() for t in by.get(last[1:], [])]

    def key(self, first):
        return min(first, rc(self.segments[first][0]))

    def rank(self, first):
        _, _, n, depth = self.segments[first]
        return (-depth / n, self.key(first))

    def compact(self):
        links = self.links()
        n_out, n_in = Counter(s for s, _ in links), Counter(t for _, t in links)
        onward = {s: t for s, t in links if n_out[s] == 1 and n_in[t] == 1 and s != t}
        back = {t: s for s, t in onward.items()}
        done, new = set(), {}

        def take(first):
            at, parts = first, []
            while at is not None and at not in done:
                done.add(at)
                parts.append(at)
                at = onward.get(at)
            k = len(first)
            text = self.segments[parts[0]][1] + "".join(self.segments[p][1][k - 1 :] for p in parts[1:])
            new[first] = (self.segments[parts[-1]][0], text, sum(self.segments[p][2] for p in parts), sum(self.segments[p][3] for p in parts))

        for first in list(self.segments):
            if first not in back:
                take(first)
        while len(done) < len(self.segments):
            ring, at = [], next(x for x in self.segments if x not in done)
            while at not in ring:
                ring.append(at)
                at = onward[at]
            least = min(map(self.key, ring))
            if least in ring:
                take(least)
            else:
                take(onward[next(x for x in ring if self.key(x) == least)])
        self.segments = new

    def correct(self, longest):
        self.compact()
        while True:
            links = self.links()
            into, out = {}, {}
            for s, t in links:
                into.setdefault(t, []).append(s)
                out.setdefault(s, []).append(t)
            gone = {self.key(f) for f, (_, _, n, _) in self.segments.items() if f not in into and f in out and n <= longest and any(self.rank(o) < self.rank(f) and min(map(self.rank, into[t]))[1] != self.key(f) for t in out[f] for o in into[t])}
            if not gone:
                arms = {}
                for f, (_, _, n, _) in self.segments.items():
                    if n <= longest and len(into.get(f, [])) == 1 and len(out.get(f, [])) == 1 and into[f][0] != f and out[f][0] != f:
                        arms.setdefault((into[f][0], out[f][0]), []).append(f)
                gone = {self.key(f) for own in arms.values() for f in own if min(map(self.rank, own))[1] != self.key(f)}
            if not gone:
                return self
            self.segments = {f: v for f, v in self.segments.items() if self.key(f) not in gone}
            self.compact()

    def contigs(self):
        return sorted((min(text, rc(text)), n, round(depth / n, 9)) for text, n, depth in {min(t, rc(t)): (t, n, d) for _, t, n, d in self.segments.values()}.values())


def counted(reads, k, least):
    c = Counter()
    for r in reads:
        r = r.upper().replace("U", "T")
        for i in range(len(r) - k + 1):
            c[min(r[i : i + k], rc(r[i : i + k]))] += 1
    return {x: n for x, n in c.items() if n >= least}


def both(spark, reads, k, least, longest=None):
    df = spark.createDataFrame([(r, 1, "x", 2) for r in reads], "seq string, kmer int, first string, n int").repartition(4)
    got = sorted(map(tuple, assembly.assemble(df, "seq", k, least, longest=longest).collect()))
    want = Plain(counted([r for r in reads if r], k, least)).correct(k if longest is None else longest).contigs()
    assert got == want
    return got


def genome(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_planted_tips_and_bubbles(spark):
    rng = random.Random(2)
    text, k = genome(rng, 400), 15
    reads = []
    for i in range(0, 341, 3):
        r = text[i : i + 60]
        reads += [r if rng.random() < 0.5 else rc(r)] * 3
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    bubble = text[150:210][:30] + other[text[180]] + text[181:210]  # an error in the middle, on both sides whole
    tip = text[300:330] + other[text[330]] + text[331:336]  # an error near a read's end
    got = both(spark, [*reads, bubble, bubble, rc(tip), tip, None, "", "ACG"], k, 2)
    whole = text[:399]  # where the last read ends
    assert len(got) == 1 and got[0][0] in (whole, rc(whole))
    # without correction the graph stays in parts
    c = spark.createDataFrame(list(counted([*reads, bubble, bubble, tip, tip], k, 2).items()), "kmer string, n long")
    assert assembly.contigs(assembly.compacted(assembly.segments_of(c))).count() > 1


def test_rings_and_mirrors(spark):
    rng = random.Random(4)
    ring = genome(rng, 60)
    hairpin = genome(rng, 40)
    both(spark, [ring + ring[:10], hairpin + rc(hairpin), "Q" * 30, "XYXY" * 8, "LEVELNOON" * 3, "xyz abba xyz abba"], 9, 1)
    both(spark, [ring + ring[:10], ring[20:40] + genome(rng, 30)], 7, 1)
    both(spark, [], 7, 1)


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    text = genome(rng, 120)
    text += text[20:50] + genome(rng, 40)
    reads = [text[i : i + 25] for i in range(0, len(text) - 24, 2)]
    for _ in range(25):
        r = list(rng.choice(reads))
        r[rng.randrange(25)] = rng.choice("ACGTN")
        reads.append("".join(r))
    both(spark, reads, 7 + 2 * seed, 1, longest=[None, 4][seed])


def test_quality_and_fitted_count(spark):
    rng = random.Random(9)
    text = genome(rng, 200)
    rows = [(text[i : i + 50], "I" * 50) for i in range(0, 151) for _ in range(3)] + [("ACGTACGTACGTTGCA" * 3, "#" * 48)] * 9
    rows += [(genome(rng, 40), "I" * 40) for _ in range(40)]
    df = spark.createDataFrame(rows, "seq string, qual string")
    counts = assembly.counted_kmers(df, "seq", 21, "qual")
    least = kmers.fitted_min_count(kmers.spectrum(counts)).first()[0]
    assert least > 1 and assembly.solid_kmers(counts).count() == counts.where(f"n >= {least}").count()
    got = assembly.assemble(df, "seq", 21, qual="qual").collect()
    longest = max(got, key=lambda r: r["n_kmers"])["contig"]
    assert len(longest) > 150 and (longest in text or rc(longest) in text)
    assert not any("ACGTACGTACGTTGCAACGTA" in r["contig"] for r in got)


@pytest.mark.parametrize("share,few", [(8, 500_000), (8, 0), (1 << 18, 0)])
def test_any_number_of_places_and_links(spark, monkeypatch, share, few):
    """Stretches of one or many places, joined up in arrays or by joins, are the same; rings, also across places, begin at their smallest k-mer."""
    monkeypatch.setattr(assembly, "SHARE", share)
    monkeypatch.setattr(assembly, "FEW_LINKS", few)
    rng = random.Random(12)
    rings = [genome(rng, n) for n in (23, 60, 200)]
    texts = [genome(rng, 300), *(r + r[:12] for r in rings), "Q" * 30, "XYXY" * 8, "LEVELNOON" * 3, "Straße \U0001f600 漢字 " * 4]
    texts += [texts[0][:150] + "C" + texts[0][151:170], genome(rng, 20) + texts[0][200:230], rc(texts[0])[40:90]]
    both(spark, texts, 9, 1)
    both(spark, [r + r[:8] for r in rings], 7, 1, longest=2)


def test_kmers_are_joined_where_they_are(spark):
    """Most of a path is joined in its place, so far fewer stretches than k-mers meet; before, each strand of a k-mer was a row in every step."""
    rng = random.Random(13)
    own = sorted(counted([genome(rng, 3000)], 21, 1))
    texts = assembly.pa.array(own + [rc(x) for x in own])
    begins, ends = assembly._overlap_places(texts, 50)
    rows = sum(assembly._stretches(texts, assembly.np.ones(len(texts), "i8"), begins == p, ends == p).num_rows for p in range(50) if (ends == p).any())
    assert 2 < rows < len(texts) / 5


def test_counted_once_or_again(spark, monkeypatch):
    """The k-mers above the first valley: in one pass; again, where a task kept too few."""
    rng = random.Random(14)
    often, odd = [genome(rng, 60) for _ in range(8)], ["ΐ" * 5 + genome(rng, 30)]
    texts = often * 12 + odd * 12 + [genome(rng, 40) for _ in range(80)] + [genome(rng, 40) for _ in range(20)] * 2
    df = spark.createDataFrame([(t,) for t in texts], "seq string").repartition(4)
    own = spark.createDataFrame(list(counted(texts, 15, 1).items()), "kmer string, n long")
    least = kmers.fitted_min_count(kmers.spectrum(own)).first()[0]
    want = sorted((x, n) for x, n in kmers.runs.counts(df, "seq", 15, True).collect() if n >= least)
    assert least > 2 and want
    passes, counts = [], kmers.runs.counts
    monkeypatch.setattr(kmers.runs, "counts", lambda *a, **b: passes.append(1) or counts(*a, **b))
    assert sorted(map(tuple, kmers.valley_counts(df, "seq", 15, True).collect())) == want and not passes
    likely = kmers.runs.likely_counts
    monkeypatch.setattr(kmers.runs, "likely_counts", lambda *a, **b: likely(*a, **b).where(f"kmer is null or n > {least}").withColumn("bound", assembly.F.lit(least + 1)))
    assert sorted(map(tuple, kmers.valley_counts(df, "seq", 15, True).collect())) == want and passes
    assert kmers.valley_counts(df.where("false"), "seq", 15, True).count() == 0
