"""The training-data operators against brute force, on edge cases and on the smallest tables."""

import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from kmerloom.llm import base, decontaminate, hash_forest, html_text, language, licenses, quality, sentencepieces, sharding, simhash, token_frames
from kmerloom.llm import queries as llm
from pyspark.sql import functions as F
from support import rows_of_duck, rows_of_spark

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "\n\n", "é" * 3, "word " * 20_000, "x" * 50_000, "same text here", "same text here", "MIT License. mit license", "<p>\x00</p>", "<|endoftext|> <|ENDOFTEXT|>", "don't, I'll 'S he's.", "🙂,🙂 漢字"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, row_ string, component_id string, hash_ int, lower int, words int, v int, shard int"


def odd_documents(spark):
    rows = [(i if i != 5 else None, t, "en" if i % 2 else None, "s", len(t or ""), 0.5, 1, "r", "c", 1, 2, 3, 4, 5) for i, t in enumerate(ODD)]
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op6_license_scan", "op8_feistel_shards"])
def test_against_sql(spark, data, duck, name):
    assert rows_of_spark(llm.queries()[name](spark, data)) == rows_of_duck(duck, llm.oracle_sql()[name])


# 1


def test_main_text_of_pages(spark, data):
    pages = base.table(spark, data, "pages")
    out = html_text.extract_main_text(pages)
    assert out.count() == pages.count()
    for r, p in zip(out.orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        want = [" ".join(html_text.html_lib.unescape(re.sub(r"<[^>]*>", " " if re.match("<br", x) else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
        assert r["text"] == "\n".join(re.sub(r"<[^>]*>", "", x) for x in want if x) and r["n_chars"] == len(r["text"])


def test_main_text_without_article():
    chrome = '<div class="cookie-banner">We use cookies on this page, please accept all of them now</div><div id="comments"><p>First! This is a reader comment of some length.</p></div>'
    page = f'<html><head><title>t</title></head><body><header>Site</header><ul class="menu"><li><a href=1>Home</a></ul><div><h1>Head</h1><p>One  &amp; two&nbsp;three, four five six seven eight nine ten.<p>short<p>Another paragraph of the same article, with text.</div>{chrome}<form>Name <input></form><script>if (a<b) "<p>no</p>"</script></body>'
    assert html_text.main_text(page) == "Head\nOne & two three, four five six seven eight nine ten.\nshort\nAnother paragraph of the same article, with text."
    for odd in ("", "<", "<p", "<!--", "<script>", "<div class='x", "a < b", "<" * 2000, '<a "' * 2000, "<p>" * 5000):
        html_text.main_text(odd)
    assert html_text.main_text("plain text") == "plain text"


TWO = "<p>The first paragraph of the article has a good deal of text, enough for a surge.</p><p>The second paragraph of it goes on for some while, too, as it has to.</p>"


@pytest.mark.parametrize("wrap", ['<form id="aspnetForm"><div id="nav"><a href="/">Home</a></div>%s<div class="footer">Copyright</div></form>', '<div id="social-science-story">%s</div>', '<div class="search-result-content">%s</div>', '<section class="post widget-area-none">%s</section>', '<div class="page-with-sidebar">%s</div>', '<div class="content-sidebar-wrap"><main>%s</main></div><div>A long line that says what the site is about, in more than eighty characters.</div>', '<form><div class="content-sidebar-wrap"><main>%s</main><aside>Aside</aside></div></form>'])
def test_names_do_not_hide_the_article(wrap):
    page = f'<html><head><title>t</title></head><body><nav><a href="/a">Menu</a></nav>{wrap % TWO}<div id="comments"><p>{"A comment. " * 6}</p></div><footer>Foot</footer></body></html>'
    assert html_text.main_text(page) == "\n".join(re.findall("<p>(The.*?)</p>", TWO))


def test_parts_of_an_article_stay():
    assert html_text.main_text(f'<article>{TWO}<p class="legal-opinion">So it was held.</p><aside class="pullquote">A quote.</aside></article><footer>Foot</footer>').endswith("\nSo it was held.\nA quote.")
    assert html_text.main_text(f'<div class="x">{TWO}<ul><li><a href="1">l</a><li><a href="2">l</a><li><a href="3">l</a></ul><p>Short end.</p></div>').endswith("\nShort end.")
    assert html_text.main_text(f'<div><p><a href="1">A paragraph that is a link</a></p>{TWO.replace("</p><p>", "</p><p><a href=2>between</a></p><p>")}</div>').count("\n") == 2
    assert html_text.main_text("<p>one <svg><title>t</title></svg><select><option>a<option>b</select> line <button>go</button>of text</p>") == "one line of text"


def plain_kept(weights, window=3, surge=80):
    """The search by definition: lines of a run of positive window sums that reaches the surge, between its first and last weight."""
    n = len(weights)
    sums = [sum(weights[k : k + window]) for k in range(n)]
    top, kept = min(surge, max(sums, default=0)), set()
    for a in range(n):
        for b in range(a + 1, n + 1):
            whole = all(sums[a:b]) and (a == 0 or not sums[a - 1]) and (b == n or not sums[b])
            if whole and top and max(sums[a:b]) >= top:
                held = [i for i in range(a, min(n, b + window - 1)) if weights[i]]
                kept |= set(range(held[0], held[-1] + 1))
    return [i in kept for i in range(n)]


def test_search_by_definition():
    r = random.Random(2)
    for _ in range(300):
        w = [r.choice((0, 0, 0, r.randint(1, 90))) for _ in range(r.randint(0, 14))]
        assert html_text.kept_lines(w) == plain_kept(w)


def test_search_decides_pages_without_article():
    """Pages of plain elements: only the distribution of text tells the article from what stands around it."""
    r, changed = random.Random(8), 0
    for _ in range(60):
        sentence = lambda: " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 9))) for _ in range(r.randint(15, 40)))
        paragraphs = [sentence() for _ in range(r.randint(2, 6))]
        links = "".join(f'<div><a href="/{k}">link {k}</a></div>' for k in range(4))
        page = f"<body><div>Some site</div>{links}<div><h2>Head line</h2>{''.join(f'<p>{x}</p>' for x in paragraphs)}</div>{links}<div>All of it 2024</div></body>"
        assert html_text.main_text(page) == "\n".join(["Head line", *paragraphs])
        found = html_text.lines(page)
        weight, free = html_text.weights_of(found)
        changed += html_text.main_text(page) != "\n".join(t for t, w in zip(found.texts, weight.tolist(), strict=True) if w)
    assert changed == 60


@pytest.mark.parametrize("part", ["<b>", "<b><p>", '<a "', "<div class=ad>t", "<!--", "<", "<a \"'>", "<ul><li>x", "<script>", "</i>", "<form><article>x"])
def test_hostile_pages_take_time_in_proportion(part):
    def took(n):
        began = time.perf_counter()
        html_text.main_text(part * n + "x" + "</i></b>" * n)
        return time.perf_counter() - began

    took(1000)
    assert took(100_000) < max(15 * took(20_000), 5)


def test_pages_edge_cases(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>" + "long " * 50_000, "x")], "page_id long, url string, html string, text string")
    assert sorted(r["n_chars"] for r in html_text.extract_main_text(df).collect()) == [0, 0, 249_999]
    assert html_text.extract_main_text(df.limit(0)).count() == 0


# 2


def test_languages_held_out(spark, data):
    docs = base.table(spark, data, "documents")
    out = llm.queries()["op2_language_id"](spark, data).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97


def test_kernel_is_shared_ngrams():
    texts = ["the cat sat", "the dog sat on", "über allen"]
    grams = [{t[i : i + n] for n in language.ORDERS for i in range(len(t) - n + 1)} for t in (f" {x} " for x in texts)]
    for i in range(3):
        assert len(language.distinct_ngrams(texts[i])) == len(grams[i])
        for j in range(3):
            assert len(np.intersect1d(language.distinct_ngrams(texts[i]), language.distinct_ngrams(texts[j]))) == len(grams[i] & grams[j])


def test_languages_edge_cases(spark):
    docs = odd_documents(spark)
    out = language.identify(docs, language.fit(docs)).collect()
    assert len(out) == len(ODD) + 1
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2, 4)) and all(0 <= r["score"] <= 1 for r in out)
    assert language.fit(no_documents(spark)) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}


def test_kernel_rows_equal_brute_force(monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(400)]
    texts = {f"l{k:03}": [" ".join(r.choices(words[k : k + 40], k=30)) for _ in range(4)] for k in range(30)}
    model = language.fit_texts(texts, landmarks=2)
    marks = [t for own in texts.values() for t in own[:2]]
    queries = [" ".join(r.choices(words, k=n)) for n in (1, 5, 60, 400)]
    grams = lambda t: {f" {t} "[i : i + n] for n in language.ORDERS for i in range(len(t) + 3 - n)}
    want = [[len(grams(q) & grams(m)) / (len(grams(q)) * len(grams(m))) ** 0.5 for m in marks] for q in queries]
    assert np.allclose(model.kernel(queries), want)
    monkeypatch.setattr(language, "PRODUCT_BYTES", 1)
    assert np.allclose(model.kernel(queries), want)
    assert len(np.unique(model.table.find(model.table.grams))) == len(model.table.grams)


def test_many_languages(spark):
    r = random.Random(6)
    rows, n = [], 405
    for k in range(n):
        own = ["".join(chr(0x4E00 + 20 * k + r.randrange(20)) for _ in range(3)) for _ in range(12)]
        rows += [(k * 10 + i, " ".join(r.choices(own, k=15)), f"l{k:03}") for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert len(model.languages) == n
    out = language.identify(docs, model).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(x["lang"] == x["lang_pred"] for x in out) > 0.97 * len(out)
    other = spark.createDataFrame([(1, "entirely other words of a language not learned"), (2, ""), (3, rows[0][1])], "doc_id long, text string")
    assert [x["doc_id"] for x in language.known_rows(other, model).collect()] == [3]
    assert [x["doc_id"] for x in language.known_rows(other, None).collect()] == [1, 3]


def test_long_texts_are_read_whole(spark, data):
    model = language.fit(base.table(spark, data, "documents"))
    text = language.letters_only("the and of to in " * 40_000)
    whole = model.kernel([text])
    stretch, language.STRETCH = language.STRETCH, 1 << 30
    try:
        assert np.allclose(model.kernel([text]), whole)
    finally:
        language.STRETCH = stretch


# 3


def test_token_files(spark, data, tmp_path):
    from tokenizers import Tokenizer

    docs = base.table(spark, data, "documents").unionByName(odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    token_frames.write_frames(docs, f"{tmp_path}/t", BPE)
    out = token_frames.file_digest(spark, f"{tmp_path}/t").orderBy("start").collect()
    t, at = Tokenizer.from_file(BPE), 0
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert len(out) == len(rows)
    for r, (doc_id, text) in zip(out, rows, strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_one_document_is_read_alone(spark, tmp_path):
    import zstandard

    token_frames.write_frames(spark.createDataFrame([(7, "b c"), (3, "a"), (7, "b b")], "doc_id long, text string"), f"{tmp_path}/t", BPE)
    file = next(tmp_path.glob("t/part-*"))
    with file.open("rb") as f:
        reader = token_frames.FrameReader(f)
        assert len(reader) == 3 and reader.find(7) == [1, 2] and reader.find(4) == []
        assert reader.ids(1)[-1] == 1
    content = file.read_bytes()
    assert len(zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()) == 4 * int(reader.entries["n_tokens"].sum())
    broken = bytearray(content)
    broken[int(reader.entries[1]["offset"]) + 12] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_frames.FrameReader(bytes(broken)).raw(1)
    with pytest.raises(ValueError):
        token_frames.FrameReader(content[:-3])


def test_no_documents_to_tokens(spark):
    assert token_frames.encode_to_files(no_documents(spark), BPE).count() == 0


# 4


def brute_nearest(rows, k=10, every=100):
    usable = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return {q: sorted(((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in usable if i != q))[:k] for q, x in usable if q % every == 0}


def test_forest_recall(spark, data):
    rows = [tuple(r) for r in base.table(spark, data, "embeddings").select("vec_id", "embedding").collect()]
    want, found = brute_nearest(rows), {}
    for r in llm.queries()["op4_hash_forest"](spark, data).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(want)
    hit = total = 0
    for q, near in want.items():
        own = sorted(found[q])
        assert [r for r, _, _ in own] == list(range(1, 11)) and [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        hit += sum(s <= near[-1][0] + 1e-12 for _, _, s in own)
        total += len(near)
    assert hit / total >= 0.9


def test_forest_edge_cases(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(1, 60)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)]
    rows += [(0, [0.0] * 4), (200, None), (300, [1.0, None, 2.0, 3.0]), (400, [float("nan"), 1.0, 1.0, 1.0]), (500, [1.0, 2.0, 3.0, 4.0]), (600, [float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, v int")
    got = {}
    for x in hash_forest.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["score"], x["vec_id"]))
    assert got == brute_nearest(rows)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in hash_forest.nearest(few).select("query_id", "rank", "vec_id").collect()] == [(0, 1, 1)]
    assert hash_forest.nearest(few.limit(0)).count() == 0


def test_forest_of_many_blocks(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(8, 16))
    rows = [(i, [float(x) for x in centres[i % 8] + 0.3 * r.normal(size=16)]) for i in range(1, 2400)] + [(100 * k, [float(k), 1.0, 2.0]) for k in range(1, 25)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, dim int, block long")
    want = brute_nearest([x for x in rows if len(x[1]) == 16], every=20)
    alone = brute_nearest([x for x in rows if len(x[1]) == 3], every=20)
    for how in ({}, {"block_rows": 150, "query_bytes": 1000}):
        found = {}
        for x in hash_forest.nearest(df, every=20, **how).collect():
            found.setdefault(x["query_id"], []).append((x["score"], x["vec_id"]))
        assert set(found) == set(want) | set(alone)
        hit = sum(len(set(near) & set(found[q])) for q, near in want.items())
        assert hit >= 0.9 * sum(map(len, want.values()))
        assert {q: sorted(found[q])[:10] for q in alone if q not in want} == {q: x for q, x in alone.items() if q not in want}


# 5


def test_quality_held_out(spark, data):
    out = llm.queries()["op5_quality"](spark, data).join(base.table(spark, data, "labels"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in out) / len(out) > 0.9


def test_quality_edge_cases(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, 1, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(ODD) + 1 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(no_documents(spark), labels).count() == 0


def test_isotonic():
    v, w = np.array([3.0, 1.0, 2.0, 5.0, 4.0]), np.ones(5)
    assert quality.isotonic(v, w) == [(2, 3), (4.5, 2)]


def test_calibration_keeps_order():
    r = np.random.default_rng(4)
    n = r.integers(0, 5, 64)
    for ones in (n, np.zeros(64, int), np.where(np.arange(64) > 30, n, 0), r.binomial(n, np.linspace(0, 1, 64))):
        at, level = quality.calibrated(n, ones, -0.5, 1.5)
        assert (np.diff(at) > 0).all() and (np.diff(level) > 0).all() and 0 < level[0] and level[-1] < 1


def test_quality_scores_are_apart(spark, data):
    docs, labels = base.table(spark, data, "documents"), base.table(spark, data, "labels")
    scores = [r["score"] for r in quality.classify(docs, labels).collect()]
    texts = docs.select("text").distinct().count()
    assert all(0 < s < 1 for s in scores) and len(set(scores)) > 0.9 * texts


# 6


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_license_scan_edge_cases(spark):
    texts = [*ODD, "mit license mit license", "CC BY-NC 4.0, cc, by", "K mit İ license", "MİT License", licenses.TEMPLATES["mit"].upper(), "x " + licenses.TEMPLATES["bsd"] + " y\nz"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    out = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        assert tuple(out[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == plain_scan(t)
    assert out[len(texts) - 2]["labels"] == "mit" and out[len(texts) - 1]["labels"] == "bsd" and out[len(texts) - 1]["score"] == 1
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_wrapped_notices_are_found(spark):
    def wrapped(label, width, mark):
        words, line, out = licenses.TEMPLATES[label].split(), "", []
        for w in words:
            line = f"{line} {w}" if line else w
            if len(line) > width:
                out, line = [*out, mark + line], ""
        return "Some code before it.\n\n" + "\n".join([*out, mark + line]) + "\n\nint main() { return 0; }"

    rows = [(k, wrapped(label, width, mark), label) for k, (label, width, mark) in enumerate((x, w, m) for x in licenses.TEMPLATES for w, m in ((40, "// "), (76, " * ")))]
    words = licenses.words_of(licenses.TEMPLATES["bsd"])
    rows.append((1000, " and some ".join(f"{w} {'filler ' * 30}" for w in words), ""))  # scattered words are no notice
    rows.append((1001, "word " * 5000 + licenses.TEMPLATES["isc"] + " word" * 5000, "isc"))
    found = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")).collect()}
    for k, _, label in rows:
        assert label in found[k]["labels"].split(",") and (not label or found[k]["score"] == 1)


def test_containment_join_is_exact(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    templates = {f"t{k}": " ".join(r.sample(vocabulary, r.randint(3, 14))) for k in range(12)}
    rows = [(i, r.sample(vocabulary, r.randint(0, 25))) for i in range(300)]
    got = {(x["id"], x["label"]): x["containment"] for x in licenses.containment_join(spark.createDataFrame(rows, "id long, words array<string>"), templates, 0.7).collect()}
    want = {}
    for i, b in rows:
        for label, t in templates.items():
            share = len(set(b) & set(t.split())) / len(t.split())
            if share >= 0.7 - 1e-9:
                want[i, label] = share
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


# 7


def test_pieces_equal_the_library(spark, data):
    from sentencepiece import SentencePieceProcessor

    sp, m = SentencePieceProcessor(model_file=PIECES), sentencepieces.model(PIECES)
    r = random.Random(5)
    junk = ["".join(r.choice("aábeE thing▁ \n\t🙂漢字ßéing0123.,!<0x41></s>    ") for _ in range(r.randint(0, 60))) for _ in range(500)]
    texts = [x["text"] for x in base.table(spark, data, "documents").collect()] + junk + [t or "" for t in ODD]
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        for text, ids, want in zip(part, m.encode(part), sp.encode(part), strict=True):
            got = np.frombuffer(ids, "<u4")
            assert got.tolist() == want
            assert m.decode(got) == text.replace("▁", " ")


def test_pieces_edge_cases(spark):
    docs = odd_documents(spark)
    assert all(r["round_trip"] for r in sentencepieces.digest(docs, PIECES).collect())
    encoded = sentencepieces.encode_documents(docs, PIECES)
    back = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in sentencepieces.decode_documents(encoded, PIECES).collect())
    assert back == sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    assert sentencepieces.encode_documents(no_documents(spark), PIECES).count() == 0


# 8


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 100, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(F.expr(sharding.place_sql("id", n, 3))).collect()]
    assert sorted(got) == list(range(n)) and sorted(sharding.place(i, n, 3) for i in range(n)) == list(range(n))
    assert [sharding.place(i, n, 3) for i in range(n)] == [r[0] for r in spark.range(n).orderBy("id").select(F.expr(sharding.place_sql("id", n, 3))).collect()]


def test_shards_edge_cases(spark):
    out = sharding.feistel_shards(odd_documents(spark), shards=4).collect()
    assert len(out) == len(ODD) + 1
    for s in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(len([r for r in out if r["shard"] == s])))
    assert max(r["slot"] for r in out) == (len(out) - 1) // 4
    assert sharding.feistel_shards(no_documents(spark)).count() == 0


# 9


def plain_fingerprint(text, n=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def chains(fps, distance=3):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_fingerprints_and_components(spark, data):
    docs = base.table(spark, data, "documents").select("doc_id", "text").unionByName(odd_documents(spark).select(F.when(F.col("doc_id").isNotNull(), F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    out = simhash.near_duplicates(docs).collect()
    texts = docs.collect()
    assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in out) == sorted((r["doc_id"] or -1, format(plain_fingerprint(r["text"]), "016x")) for r in texts)
    distinct = sorted({int(r["fingerprint"], 16) for r in out})
    root = dict(zip(distinct, chains(distinct), strict=True))
    least = {}
    for r in out:
        if r["doc_id"] is not None:
            k = root[int(r["fingerprint"], 16)]
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least.get(root[int(r["fingerprint"], 16)]) for r in out)
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


@pytest.mark.parametrize("limit", [4096, 60, 8])
def test_links_within_groups(limit):
    r = random.Random(limit)
    centres = [r.getrandbits(64) for _ in range(12)]
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for c in centres for _ in range(25)})
    assert simhash.links_within(np.array(fps, "u8"), 3, simhash.ALL, limit).tolist() == chains(fps)


@pytest.mark.parametrize("parts", [[(16, 0)] * 4, [(32, 1)] * 2, [(22, 1), (21, 0), (21, 0)], [(13, 0)] * 4 + [(12, -1)]])
def test_hot_signatures(spark, parts, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 20)
    r, at, split = random.Random(9), 0, []
    for size, t in parts:
        if t >= 0:
            split.append((list(range(at, at + size)), t))
        at += size
    assert sum(t + 1 for _, t in parts) >= 4 or len(parts) == 5
    centre = r.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)})
    edges = [tuple(x % 2**64 for x in e) for e in simhash.link_edges(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long"), split).collect()]
    label = list(range(len(fps)))
    at = {f: i for i, f in enumerate(fps)}
    for a, b in edges:
        x, y = label[at[a]], label[at[b]]
        label = [min(x, y) if v in (x, y) else v for v in label]
    assert label == chains(fps)


def test_plan_covers_every_link():
    r = np.random.default_rng(2)
    x = (r.random((500, 64)) < r.random(64)).astype(float)
    for n in (500, 10**6, 10**9):
        parts = simhash.plan(n, x.T @ x * n / 500)
        # thresholds of -1 are left out of the plan
        assert sum(t + 1 for _, t in parts) == 4 and len({b for bits, _ in parts for b in bits}) == sum(len(b) for b, _ in parts)


def test_similar_groups(spark, data):
    docs = base.table(spark, data, "documents")
    kept = {r["doc_id"] for r in simhash.first_of_each_group(docs).collect()}
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    sets = [(r["doc_id"], set(simhash.word_hashes(r["text"], 5))) for r in rows]
    lone = set()
    for i, a in sets:
        best = max((len(a & b) / max(1, len(a | b)) for j, b in sets if j != i), default=0)
        first = min([i] + [j for j, b in sets if j != i and len(a & b) >= 0.9 * len(a | b)])
        if first < i:
            assert i not in kept
        if best < 0.5:
            lone.add(i)
    assert lone <= kept


def test_similar_groups_are_exact(spark):
    """Pairs of similarity 0.8 are one group and pairs just below it are two, at every pair; brute force decides."""
    r, texts = random.Random(5), []
    for k in range(120):
        words = [f"w{r.randrange(10**9)}" for _ in range(94)]
        shared = (80, 79, 75, 70)[k % 4]  # of 90 shingles each: 0.8, 0.782, 0.714, 0.636
        texts += [" ".join(words), " ".join(words[: shared + 4] + [f"v{r.randrange(10**9)}" for _ in range(90 - shared)])]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    want = {i for i, a in enumerate(sets) if not any(len(a & b) * 5 >= len(a | b) * 4 for b in sets[:i])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.first_of_each_group(docs).collect()} == want and len(want) == 210


def test_recall_of_the_stage(spark):
    """Planted pairs: every one at the threshold or above is found, through the stage, and none below it."""
    r, rows, n = random.Random(80), [], 200
    # of 200 shingles each, so many are shared: similarities of 0.802, 0.852, 0.905 and, below, 0.794, 0.75, 0.7
    for k, shared in enumerate(x for x in (178, 184, 190, 177, 171, 165) for _ in range(100)):
        words = [f"w{r.randrange(10**9)}" for _ in range(n + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: shared + 4] + [f"v{r.randrange(10**9)}" for _ in range(n - shared)]))]
    kept = {x["doc_id"] for x in simhash.first_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0 or i >= 600}


def test_widest_plan_covers_its_distance():
    r = np.random.default_rng(5)
    x = (r.random((300, 256)) < r.random(256)).astype(float)
    x[:, 128:160] = x[:, :32]  # bits that go together
    for n in (300, 10**5, 10**8):
        distance, parts = simhash.widest_plan(n, x.T @ x * n / 300, simhash.WIDE_BUDGET)
        assert sum(t + 1 for _, t in parts) == distance + 1 and len({b for bits, _ in parts for b in bits}) == sum(len(b) for b, _ in parts)


def test_wide_links_of_hot_signatures(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 20)
    r = random.Random(4)
    centre = r.getrandbits(256)
    fps = sorted({centre ^ sum(1 << b for b in r.sample(range(256), r.randint(0, 6))) for _ in range(120)} | {r.getrandbits(256) for _ in range(40)})
    words = ["w0", "w1", "w2", "w3"]
    df = spark.createDataFrame([(i, *(simhash._signed(f >> 64 * k & simhash.ALL) for k in range(4))) for i, f in enumerate(fps)], "fp long, w0 long, w1 long, w2 long, w3 long")
    parts = [(list(range(32 * k, 32 * k + 32)), 0) for k in range(7)]
    edges = simhash.link_edges(df, parts, 6, 9, tuple(words)).collect()
    assert all((fps[a] ^ fps[b]).bit_count() <= 9 for a, b in edges)
    label = list(range(len(fps)))
    for a, b in edges:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    near = chains(fps, 6)
    assert all(label[i] == label[j] for i in range(len(fps)) for j in range(i) if near[i] == near[j])


def test_majorities():
    r = np.random.default_rng(0)
    hashes = [r.integers(0, 1 << 63, n).astype("u8") for n in (0, 1, 2, 254, 255, 256, 511, 3000, 0, 5)]
    want = [sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h)) for h in hashes]
    assert simhash.majorities(hashes).tolist() == want == simhash.majorities(hashes, 300).tolist()


def test_similar_groups_edge_cases(spark):
    docs = odd_documents(spark)
    out = simhash.first_of_each_group(docs)
    assert out.columns == docs.columns
    texts = [r["text"] or "" for r in out.collect()]
    words = [tuple(t.lower().split()) for t in texts]
    assert len(set(words)) == len(words) == len({tuple((t or "").lower().split()) for t in ODD})
    assert simhash.first_of_each_group(no_documents(spark)).count() == 0


# 10


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    r = random.Random(1)
    for _ in range(150):
        a = "".join(r.choice("abc ") for _ in range(r.randint(1, 90)))
        b = "".join(r.choice("abc ") for _ in range(r.randint(0, 60))) + a[: r.randint(0, 90)]
        best, end = decontaminate.least_distance(decontaminate.masks_of(a), len(a), b)
        assert best == plain_distance(a, b) and plain_distance(a, b[:end]) == best


def test_leaks_equal_brute_force(spark, data):
    r = random.Random(7)
    items = [(x["item_id"], x["text"]) for x in base.table(spark, data, "benchmark").collect()][:12] + [(900, None), (901, ""), (902, "ab"), (902, "ab")]
    docs = [(i, x["text"][:400]) for i, x in enumerate(base.table(spark, data, "documents").limit(30).collect())]
    for i in range(30):
        item = list(decontaminate.plain(r.choice(items[:12])[1]))
        for _ in range(r.randint(0, len(item) // 7)):
            at = r.randrange(len(item))
            item[at : at + r.randint(0, 1)] = r.choice(["", "x", "q"])
        docs.append((100 + i, "Some text before " + "".join(item).upper() + "\n\nand after."))
    docs += [(500, None), (501, ""), (None, items[0][1]), (100, docs[31][1])]
    schema = "doc_id long, text string"
    got = decontaminate.find_leaks(spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id long, text string"), block_bytes=600)
    want = []
    for doc_id, text in docs:
        for item_id, item in items:
            p = decontaminate.plain(item)
            if p and (d := plain_distance(p, decontaminate.plain(text))) <= decontaminate.budget(p):
                want.append((doc_id or -1, item_id, d))
    assert sorted((x["doc_id"] or -1, x["item_id"], x["distance"]) for x in got.collect()) == sorted(want)


def test_matchers_of_other_items():
    """A matcher is never used for other items, even where a list of them takes the place of one that is gone."""
    for k in range(200):
        items = [(k, f"item number {k} of some length")]
        assert [x[0] for x in decontaminate._matcher(items, 0.1).find(f"here is item number {k} of some length")] == [k]
        assert decontaminate._matcher(items, 0.1) is decontaminate._matcher(items, 0.1)
        del items


def test_two_blocks_in_one_worker(spark):
    docs = spark.createDataFrame([(i, f"text with secret passage {'abc'[i % 3] * 20} in it") for i in range(30)], "doc_id long, text string").coalesce(1)
    for letter in "abcab":
        items = spark.createDataFrame([(1, f"secret passage {letter * 20}")], "item_id long, text string")
        assert sorted(r["doc_id"] for r in decontaminate.find_leaks(docs, items).collect()) == [i for i in range(30) if "abc"[i % 3] == letter]


def test_decontaminate_edge_cases(spark, data):
    benchmark = base.table(spark, data, "benchmark")
    docs = odd_documents(spark)
    assert decontaminate.decontaminate(docs, benchmark).count() == docs.count()
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).count() == docs.count()
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.find_leaks(no_documents(spark), benchmark).count() == 0
