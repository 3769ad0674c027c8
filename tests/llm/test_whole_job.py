"""Cases in which an operator once did less than its whole job."""

import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ledgerloom.llm import exact_dedup, jaccard_join, lang_id, queries, secrets, token_counts, tokens
from ledgerloom.llm import html_extract as hx

PAGES = "page_id bigint, url string, html string"


def extracted(spark, pages, **options):
    return {r.page_id: r.text for r in hx.extract(spark.createDataFrame(pages, PAGES), **options).collect()}


def site(host, n, body):
    return [(f"http://{host}/{i}", f"<html><body>{body(i)}</body></html>") for i in range(n)]


def sites():
    """Hosts of 8 pages and more, with and without landmarks, and text of the branches."""
    marked = site("marked.example", 12, lambda i: f"<div><p>Around all.</p></div><main><div><h1>Own {i}</h1><p>Text {i}.</p></div><section><p>In main, on all pages.</p></section></main>")
    bare = site("bare.example", 9, lambda i: f"<section><p>On all pages.</p></section><div><p>Only here {i}.</p></div>")
    teaser = site("teaser.example", 10, lambda i: f"<article><p>See page {i + 1}.</p></article><div><p>Main text {i}.</p></div>")
    empty = site("empty.example", 8, lambda i: f"<article></article><div><p>Other text {i}.</p></div>")
    partly = site("partly.example", 20, lambda i: f"<main><div><p>Either {i if i % 4 == 0 else 'one'}</p></div></main><div><p>Or {i if i % 10 == 0 else 'one'}</p></div>")
    few = site("few.example", 7, lambda i: "<div><p>The same on too few pages.</p></div>")
    return [(i, *x) for i, x in enumerate(marked + bare + teaser + empty + partly + few)]


@pytest.mark.parametrize("send", [hx.SEND, 0])
def test_html_landmarks_are_a_weight(spark, send):
    got = extracted(spark, sites(), send=send)
    pages = {i: (u.split("/")[2], int(u.rsplit("/", 1)[1])) for i, u, _ in sites()}
    for i, (host, n) in pages.items():
        if host == "marked.example":
            assert got[i] == f"Own {n}\nText {n}."
        elif host == "bare.example":
            assert got[i] == f"Only here {n}."
        elif host == "teaser.example":
            assert got[i] == f"See page {n + 1}.\nMain text {n}."
        elif host == "empty.example":
            assert got[i] == f"Other text {n}."
        elif host == "few.example":
            assert got[i] == "The same on too few pages."


def brute(pages, landmark=("article", "main")):
    """Importance of every (host, path, content) from the pages as they are, one loop a node."""
    seen = {}
    for url, html in {(u.split("/")[2], h) for _, u, h in pages}:
        for node, _, style, content in hx.branches(hx.parse(html), url):
            own = seen.setdefault((url, node.path), {"pages": set(), "style": {}, "content": {}, "inside": any(t.split(".")[0] in landmark for t in node.path.split("/"))})
            own["pages"].add(html)
            own["style"].setdefault(style, set()).add(html)
            own["content"].setdefault(content, set()).add(html)
    out = {}
    for (host, path), own in seen.items():
        n, sizes = len(own["pages"]), [len(x) for x in own["style"].values()]
        entropy = -sum(k / sum(sizes) * math.log(k / sum(sizes)) for k in sizes)
        style = entropy / math.log(sum(sizes)) if sum(sizes) > 1 else 1
        for content, x in own["content"].items():
            if len(x) > 1:
                mean = 0.1 * style + 0.9 * (1 - math.log(len(x)) / math.log(n))
                out[hx._hash(f"{host}\0{path}"), content] = (n, own["inside"], (1 + n * mean) / (1 + n))
    return out


def test_html_importance_against_brute_force(spark):
    pages = sites() + [(1000 + i, u, h) for i, u, h in sites()[:30]]  # equal pages count once
    got = {(r.place, r.content): (r.pages, r.inside, r.importance) for r in hx.importance(spark.createDataFrame(pages, PAGES)).collect()}
    want = brute(pages)
    assert got.keys() == want.keys() and len(got) > 10
    for k, (n, inside, importance) in want.items():
        assert got[k][:2] == (n, inside) and abs(got[k][2] - importance) < 1e-9


@pytest.mark.parametrize("send", [hx.SEND, 0])
def test_html_repetition_is_of_pages_and_contents(spark, send):
    rows = [(f"http://rows.example/{i}", "<div><p>One page, in 8 rows.</p></div>") for i in range(8)]
    copies = site("copies.example", 100, lambda i: f"<div><p>{'Said again and again.' if i >= 10 else f'Said once {i}.'}</p></div>" + f"<section>{i}</section>")
    table = [("http://table.example/", "<table>" + "<tr><td>yes</td></tr>" * 9 + "</table>")]
    beside = site("beside.example", 30, lambda i: f"<article><p>Own {i}.</p><p>Sign up here.</p></article>")
    pages = [(i, *x) for i, x in enumerate(rows + copies + table + beside)]
    got = extracted(spark, pages, send=send)
    for i, url, _ in pages:
        n = url.rsplit("/", 1)[1]
        if "rows." in url:
            assert got[i] == "One page, in 8 rows."
        elif "copies." in url:
            assert got[i] == (n if int(n) >= 10 else f"Said once {n}.\n{n}")
        elif "table." in url:
            assert got[i].split() == ["yes"] * 9
        else:
            assert got[i] == f"Own {n}."


def test_html_elements_without_an_end_tag(spark):
    article = "<article><p>Text of the page.</p></article>"
    heads = [
        "<svg viewBox='0 0 1 1' />", "<math/>", "<object data=x>", "<noscript>", "<svg>", "<iframe src=x>", "<svg><path/></svg>", "<svg/><p>Between.</p><svg><text>no</text></svg>",
        "<object>" * 3 + "<svg/>", "<script>var x = 1;", "<style>p{}", "<textarea>", "<title>",
    ]
    got = extracted(spark, [(i, f"http://{i}.example/", f"<body>{x}{article}</body>") for i, x in enumerate(heads)])
    assert [got[i] for i in range(9)] == ["Text of the page."] * 7 + ["Between.\nText of the page.", "Text of the page."]
    assert [got[i] for i in range(9, 13)] == [""] * 4


def test_html_contract_cases(spark):
    bodies = [
        ("<p>foo <b>bar</b>\n<i>baz</i></p>", "foo bar baz"),
        ("<p title=\"foo>bar</p><p>next</p>", "bar\nnext"),
        ("<article><div class='ad-free'>a</div><p class=legal>b</p><div class='search-engines'>c</div><p title='a hidden gem'>d</p><div class='ad'>e</div><div id='cookie-notice'>f</div></article>", "a\nb\nc\nd"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("a < b <3 c", "a < b <3 c"),
        ("<p>x<hr>y<br>z", "x\ny z"),
        ("<p a='1>2' b=\">\">in</p><!-- <p>no</p> --><p>out", "in\nout"),
        ("<p>end <b", "end <b"),
        ("<article>" + "<p>t</p>\n" * 2 + "</article>", "t\nt"),
    ]
    got = extracted(spark, [(i, f"http://{i}.example/", x) for i, (x, _) in enumerate(bodies)])
    assert [got[i] for i in range(len(bodies))] == [want for _, want in bodies]


def test_html_extra_columns_repeats_and_nulls(spark):
    rows = [(1, "u", "<p>a</p>", "x", 5), (1, "u", "<p>a</p>", "y", 6), (None, None, "<p>b</p>", None, None), (2, "u", None, "z", 0)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in hx.extract(table).collect()), key=str)
    assert got == [(1, "a", 1), (1, "a", 1), (2, "", 0), (None, "b", 1)]
    assert hx.extract(table.limit(0)).count() == 0


@pytest.mark.parametrize("odd", ["<a b=\"", "<p", "<svg>", "</x>", "<div>", "<!--", "<p title='x>"])
def test_html_time_is_linear(odd):
    def took(n):
        start = time.process_time()
        hx.main_text(root := hx.parse(odd * n))
        hx.branches(root, "h")
        return time.process_time() - start

    took(100)
    assert took(80_000) < 40 * max(took(8_000), 0.02)


def test_html_tree_decides(spark, monkeypatch):
    pages = [(i, *x) for i, x in enumerate(site("tree.example", 20, lambda i: f"<div><p>Subscribe to our letters.</p></div><article><p>Own {i}.</p><p>All rights are ours.</p></article>"))]
    assert set(extracted(spark, pages).values()) == {f"Own {i}." for i in range(20)}
    assert extracted(spark, pages, least=0.0)[3] == "Subscribe to our letters.\nOwn 3.\nAll rights are ours."


DOCS = "doc_id bigint, text string"


def chain(tag, n=104):
    """Texts of which the second is a near copy of the first and the third, which are none of one another."""
    words = [f"{tag}{i}" for i in range(n)]
    put = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    return put(10, 20), put(), put(60, 70)


def test_jaccard_null_id_links(spark):
    (a, bridge, b), (c, only, d) = chain("p"), chain("q")
    rows = [(7, a), (None, bridge), (5, b), (None, c), (None, only), (None, d), (9, "other text"), (None, None)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, DOCS)).collect())
    assert got == Counter([(7, 100, 5), (None, 100, 5), (5, 100, 5), *[(None, 100, None)] * 3, (9, 1, 9), (None, 0, None)])


def test_pipeline_near_decides_on_rows(spark):
    (a, bridge, b), (c, only, d), (e, f, _) = chain("p"), chain("q"), chain("r")
    rows = [(7, a), (None, bridge), (5, b), (None, c), (None, only), (None, d), (3, e), (3, f), (3, f), (None, "lone text"), (None, "lone two"), (None, None), (None, ""), (4, None), (4, None)]
    got = Counter(map(tuple, cp.near(spark, spark.createDataFrame(rows, DOCS), "").collect()))
    assert got.pop((5, b)) == got.pop((None, "lone text")) == got.pop((None, "lone two")) == 1
    assert got.pop((None, None)) == got.pop((None, "")) == 1 and got.pop((4, None)) == 2
    assert sum(got[None, t] for t in (c, only, d)) == 1 and got[3, e] + got[3, f] == 1 and got.total() == 2


def test_pipeline_clean_decides_on_rows(spark, tmp_path):
    item = "which of the quick brown foxes jumps over the lazy dog at noon"
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"so {item} then"), (None, "a clean text"), (None, None), (2, item), (2, "another clean text"), (3, "third")]
    got = Counter(map(tuple, cp.clean(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()))
    assert got == Counter([(None, "a clean text"), (None, None), (2, "another clean text"), (3, "third")])


def test_packing_special_strings_of_other_case():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    texts = ["a <|EndOfText|> b", "<|STARTOFTEXT|> c", "x <|endoftext|> y", "plain Words"]
    own = tokens.word_ids(path)
    got = [np.frombuffer(x, own.kind).tolist() for x in own.ids(texts)]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_packing_words_joined_as_alone():
    own, rnd = tokens.word_ids(queries.tokenizer_file("word_bpe_49k.json")), np.random.default_rng(3)
    kinds = [c for c in map(chr, range(33, 256)) if tokens.SAFE.fullmatch(c) and c == c.lower() and c.strip()]
    words = ["".join(kinds[i] for i in rnd.integers(0, len(kinds), n)) for n in rnd.integers(1, 12, 3000)]
    words += ["don't", "'s", "it's'", "a" * 5000, "1.5e-3", "|", "<|", "</w>", *kinds]
    assert own._ask_words(words) == own._ask(words)
    assert own._ask_words([]) == []


def test_language_id_learns_every_language(spark):
    rows = [(10 * i + j, f"Text {chr(97 + i % 26) * 5} {chr(97 + i // 26) * 5}", f"l{i:03}") for i in range(230) for j in range(10)]
    net = lang_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert net.langs == [f"l{i:03}" for i in range(230)]
    assert cp.least_score(0) == cp.least_score(1) == cp.least_score(4) == cp.LEAST_SCORE and cp.least_score(230) < 2 / 230


def test_exact_dedup_spreads_the_batch_over_buckets(spark, monkeypatch):
    seen, screened = [], exact_dedup.screened

    def watched(incoming, filters, buckets):
        seen.append(incoming.groupBy(exact_dedup._bucket(buckets)).count().agg(F.max("count")).first()[0])
        return screened(incoming, filters, buckets)

    monkeypatch.setattr(exact_dedup, "screened", watched)
    rows = [(i, f"text {i % 900}") for i in range(1000)]
    for new in (F.lit(True), F.col("doc_id") > 0):  # an empty snapshot, and one of a single row
        got = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS), new, bucket_size=50).collect()
        assert len(got) == 1000 and sum(r.kept for r in got) == 900 and all(r.keep_id % 900 == r.doc_id % 900 for r in got)
    assert len(seen) == 2 and max(seen) < 200


def scripts():
    """Texts whose words end at different kinds of places, and texts that hold no end of a word."""
    rnd = np.random.default_rng(7)
    letters = {"russian": (0x430, 32), "greek": (0x3B1, 24), "hindi": (0x915, 37), "arabic": (0x628, 20), "latin": (97, 26)}
    for first, n in letters.values():
        yield " ".join("".join(map(chr, first + rnd.integers(0, n, rnd.integers(1, 9)))) for _ in range(900))
    yield "".join(chr(c) if c % 17 else "，。、！\u3000"[c % 5] for c in (0x4E00 + rnd.integers(0, 5000, 5000)).tolist())  # blanks are rare
    yield "".join(map(chr, 0x4E00 + rnd.integers(0, 5000, 5000)))
    yield "it's 'sad' we'll''s 12'd a'1 <|endoftext|>\u0301x\u200b\u180ey \x1c\x85z😀👍🏽 " * 90
    yield "<|endoftext|>" * 400
    yield "'" * 900 + "s" * 900 + " " * 900 + "\n\r\t " * 300


@pytest.mark.parametrize(("chunk", "overlap"), [(256, 40), (700, 150), (1000, 1000)])
def test_token_counts_spliced_against_the_library(chunk, overlap):
    own = tokens.byte_counts(queries.tokenizer_file("byte_bpe_50k.json"))
    for text in [*scripts(), " ".join(scripts())]:
        assert token_counts.spliced(own, text, chunk, overlap) == len(own.tokenizer.encode(text, add_special_tokens=False)), text[:40]


def test_token_counts_stable_places():
    """Every stable place is a boundary of the whole text, and each script has some."""
    own = tokens.byte_counts(queries.tokenizer_file("byte_bpe_50k.json"))
    for text in list(scripts())[:6]:
        starts = {s for s, _ in own.tokenizer.encode(text, add_special_tokens=False).offsets}
        places = {p for p in range(1, len(text)) if tokens.stable(text, p)}
        assert len(places) > 100 and places <= starts


@pytest.mark.parametrize("kind", [0, 5, 6])
def test_token_counts_time_is_linear(kind):
    own, text = tokens.byte_counts(queries.tokenizer_file("byte_bpe_50k.json")), list(scripts())[kind]

    def took(n):
        whole = (text * (n // len(text) + 1))[:n]
        start = time.process_time()
        token_counts.spliced(own, whole)
        return time.process_time() - start

    took(10_000)
    assert took(1_000_000) < 30 * max(took(100_000), 0.05)


def test_secret_scan_scans_by_increments(spark, tmp_path):
    """A second batch adds ledger rows for its new blobs alone, and its old blobs' findings come from the ledger."""
    key, ledger = "AKIA" + "A" * 16, f"file://{tmp_path}/ledger"
    table = spark.createDataFrame([(1, key), (2, "plain"), (3, key), (4, f"so {key}"), (None, None), (5, "plain")], DOCS)
    secrets.record(table.where("doc_id <= 2"), ledger)
    assert spark.read.parquet(ledger).count() == 2
    secrets.record(table.where("doc_id > 2 or doc_id is null"), ledger)
    assert spark.read.parquet(ledger).count() == 4
    got = secrets.digest_columns(secrets.report(table, spark.read.parquet(ledger))).collect()
    assert Counter((r.doc_id, r.spans) for r in got) == Counter([(1, "access:0:20"), (2, ""), (3, "access:0:20"), (4, "access:3:23"), (None, ""), (5, "")])
    whole = secrets.digest_columns(secrets.secret_scan(table)).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole))
