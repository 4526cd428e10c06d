"""HTML extraction, WARC, BPE, neighbours, language and the pipeline."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from skein.llm import ann, bpe, html_extract, language, warc

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PAGES = "page_id long, url string, html string, path string, text string, host string, digest string, value string"


def pages(spark, *rows):
    """Pages with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], PAGES)


ARTICLE = "<p>The first paragraph of the article runs on for a while &amp; says a thing.</p><p>The <b>sec</b>ond one is\n  also&nbsp;long enough to count<br>here.<p>An unclosed one ends it all &lt;well&gt;."
TEXT = "The first paragraph of the article runs on for a while & says a thing. The second one is also long enough to count here. An unclosed one ends it all <well>."
FRAMES = [
    "<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article>{}</article><footer>f</footer></body></html>",
    "<html><head><title>t</title><style>p{{}}</style><script>var x='<p>no</p>';</script></head><body><header><h2>Site</h2></header><div class='content post-12'>{}</div><div class='sidebar'><p>Some text that is beside the point but is fairly long, to tempt.</p></div></body></html>",
    "<body><div id=menu>Menu here</div><main><div class=body>{}<div class='comments'><p>I disagree with the whole of this article, and at length too!</p></div><form>Subscribe <input></form></div></main><aside>ad</aside>",
    "<div class='cookie-notice'>We use cookies, and talk about it at length before anything else.</div><section class='story'>{}</section><div class='ad'>Buy this excellent thing now, it is long and good.</div>",
]


def test_articles_come_out_whole(spark):
    rows = [(10 * k + j, f"https://h{k}.example/{j}", frame.format(ARTICLE.replace("first", f"first {j}"))) for k, frame in enumerate(FRAMES) for j in range(3)]
    found = {r["page_id"]: r["text"] for r in html_extract.extract(pages(spark, *rows)).collect()}
    assert found == {i: TEXT.replace("first", f"first {i % 10}") for i, _, _ in rows}


def test_marked_paragraphs_are_left_out():
    page = "<article><p class=lead>Lead of it.</p><p class='notice'>Terms <b>have</b> changed.<br>Read them.</p><p>Body &eacute;.<br/>More</p><h4 id=comments>3 comments</h4><div class='comment-body'>No!</div><br/>End</article>"
    assert html_extract.Page(page).text(None) == "Lead of it. Body é. More End"


def test_text_beside_the_innermost_container_is_kept():
    body = "<p>" + "A long paragraph of the article's own body text. " * 20 + "</p>"
    lead, close = "<h1>A headline of the article</h1><p>The lead of it.</p>", "<p>A closing word.</p>"
    for frame in ("<article>{}<div class=body>{}</div>{}</article>", "<div class=post>{}<div><div class=body>{}</div></div>{}</div>", "<main><div>{}<section>{}</section>{}</div></main>"):
        page = html_extract.Page("<body><nav>Menu</nav>" + frame.format(lead, body, close) + "<div class=extra>Not of it, but running text all the same.</div>")
        for path in (None, *page.scores()):
            if path is None or "extra" not in path and path != "/body":
                text = page.text(path)
                assert text.startswith("A headline of the article The lead of it. A long") and text.endswith("A closing word.")
    # Several articles stay apart; an empty container is no reason for an empty text.
    page = html_extract.Page(f"<main><article class=a>{lead}</article><article class=b>{body}</article></main>")
    assert page.text("/main/article.a") == "A headline of the article The lead of it."
    assert html_extract.Page(f"<body><div class=main></div><div class=extra>{close}</div>").text("/body/div.main") == "A closing word."


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "http://h.x/", "<p>"), (4, "nonsense", "just text, a < b and no tags at all"), (None, "http://h.x/", "<div><p>One paragraph without an id that still is read.</div>"), (5, "http://h.x/", "<script>no end <p>here"), (6, "http://h.x/", "<div>" * 3000 + "deep text in many containers</div>"), (6, "http://h.x/", "<div>" * 3000 + "deep text in many containers</div>")]
    found = html_extract.extract(pages(spark, *rows)).collect()
    texts = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows) and texts[1] == texts[2] == texts[3] == texts[5] == ""
    assert texts[4] == "just text, a < b and no tags at all" and texts[6] == "deep text in many containers" and texts[None].startswith("One paragraph")
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert html_extract.extract(pages(spark)).count() == 0


def test_a_host_outvotes_a_page(spark):
    usual = "<body><div class='main'>{}</div><div class='extra'>{}</div>"
    long, short = "<p>" + "A long paragraph of the usual article text. " * 20 + "</p>", "<p>A short paragraph that is beside it.</p>"
    rows = [(i, "http://same.example/", usual.format(long, short)) for i in range(8)] + [(9, "http://same.example/", usual.format(short, long))]
    found = {r["page_id"]: r["text"] for r in html_extract.extract(pages(spark, *rows)).collect()}
    assert found[9] == "A short paragraph that is beside it."


def test_names_go_by_whole_words():
    body = "<p>A paragraph of the article that is long enough to count.</p>"
    text = "A paragraph of the article that is long enough to count."
    for names in ("content has-sidebar", "hentry comments-open", "story side-by-side", "no-ads post", "elementor-widget-container", "threads", "adapted unrelated", "post with-comments"):
        page = html_extract.Page(f"<body><nav>Menu</nav><div class='{names}'>{body}</div><div class=sidebar>{body}</div><footer>f</footer>")
        assert page.text(None) == text, names
    for names in ("sidebar", "site-header", "ad", "ad_box", "comment-body", "postComments", "relatedPosts", "ad-12", "left-sidebar wide", "side"):
        page = html_extract.Page(f"<body><article>{body}<div class='{names}'>Beside the point, at some length to tempt.</div></article>")
        assert page.text(None) == text, names
    # The article's own headline, adverts inside of paragraphs, scripts with odd quotes, tags that cannot close themselves.
    read = lambda x: html_extract.Page(x).text(None)
    assert read("<article><div class=entry-header><h1>The headline</h1></div>" + body) == read("<article><header><h1>The headline</h1></header>" + body) == "The headline " + text
    assert read("<p>One <span class=ad>buy <b>this</b> now</span>two <a class='share' href=x>tell</a>three.</p><p>Four <em class=comments>5</p><p>six</p>") == "One two three. Four six"
    assert read("<script data-x=it's>var x='<p>no</p>'</script><p>yes</p>") == read("<script src=x />no</script><p>yes</p>") == "yes"
    assert read("<p data-id=ad data-class='ad'>kept</p><!--><p>also</p><svg width=1 /><p>and this</p>") == "kept also and this"
    assert read("<ul><li class=comment><p>No</p><li><p>Yes</ul><table><tr><td class=ad>No<td>Cell") == "Yes Cell"


def test_deep_and_broken_pages_take_memory_in_proportion():
    import tracemalloc

    for page in ("<div>" * 100_000 + "deep text" + "</div>" * 100_000, "<div class=a>x" * 50_000, "<div>" * 50_000 + "</section>" * 50_000, "<p a='" * 50_001, "<script x" * 50_000, "<li><p class=ad>x" * 50_000):
        tracemalloc.start()
        page = html_extract.Page(page)
        votes = page.scores()
        page.text(next(iter(votes), None))
        assert tracemalloc.get_traced_memory()[1] < 200e6 and all(len(p) <= html_extract.PATH_CHARS for p in votes)
        tracemalloc.stop()


def made_page(rnd, template):
    """A page and its article's text by construction."""
    say = lambda n: " ".join(rnd.choice(["river", "stone", "&amp;", "walks", "blue", "é", "of", "the", "long", "x&lt;y"]) for _ in range(n))
    plain = lambda t: t.replace("&amp;", "&").replace("&lt;", "<")
    blocks, texts = [], []
    for _ in range(rnd.randint(3, 7)):
        t = say(rnd.randint(12, 40))
        tag = rnd.choice(["p", "p", "p", "li", "blockquote", "h2"])
        inner = t.replace(" of ", " <b>of</b>\n ").replace(" long ", " long<!-- note --> ")
        if rnd.random() < 0.3:
            inner += rnd.choice(["<span class='ad'>buy this</span>", "<script>no('</p>')</script>", "<a class=share href=#>Share it</a>"])
        blocks.append(f"<ul><{tag}>{inner}</ul>" if tag == "li" else f"<{tag}>{inner}</{tag}>")
        texts.append(plain(t))
        if rnd.random() < 0.4:
            blocks.append(rnd.choice([f"<div class='{c}'><p>{say(30)}</p></div>" for c in ("ad", "comments", "related-posts", "newsletter_box")] + [f"<aside>{say(9)}</aside>", f"<form>{say(5)}<input></form>", "<style>p{}</style>"]))
    around = [f"<div class='{c}'><p>{say(rnd.randint(5, 60))}</p></div>" for c in ("sidebar", "cookie-notice", "site-footer", "navbar")]
    rnd.shuffle(around)
    return f"<html><head><title>{say(4)}</title></head><body>{around[0]}{around[1]}" + template.format("".join(blocks)) + f"{around[2]}<footer>{say(20)}</footer></body></html>", " ".join(texts)


TEMPLATES = ["<article>{}</article>", "<div id=page><div class='content has-sidebar'>{}</div></div>", "<main><div class='story side-by-side'><div>{}</div></div></main>", "<div class='hentry comments-open post-77'>{}</div>", "<table><tr><td>{}</table>", "<section class='entry'>{}</section>"]


@pytest.mark.parametrize("seed", range(3))
def test_made_pages_give_what_they_were_made_of(spark, seed):
    rnd = random.Random(seed)
    rows, want = [], {}
    for i in range(120):
        # Hosts of one template, of several, and without a name.
        host = rnd.randrange(8)
        template = TEMPLATES[host % 6] if host < 6 else rnd.choice(TEMPLATES)
        page, want[i] = made_page(rnd, template)
        rows.append((i, f"http://h{host}.example/{i}" if host < 7 else None, page))
    found = {r["page_id"]: r["text"] for r in html_extract.extract(pages(spark, *rows, *rows[:3])).collect()}
    assert found == want


def test_the_host_decides_between_templates(spark):
    """Each page alone would take its longer half; the host's winner is the template of most of its text, where a page has it."""
    long, short = "<p>" + "Much running text stands in this part of it. " * 12 + "</p>", "<p>Little running text is in here.</p>"
    two = "<body><div class='story'>{}</div><div class='extra'>{}</div>"
    rows = [(i, "http://a.example/", two.format(long, short)) for i in range(6)] + [(6, "http://a.example/", two.format(short, long)), (7, "http://a.example/", f"<body><section>{long}</section>{short}"), (8, "http://b.example/", two.format(short, long))]
    found = {r["page_id"]: (r["path"], r["text"][:6]) for r in html_extract.extract(pages(spark, *rows)).collect()}
    assert {found[i] for i in range(6)} == {("/body/div.story", "Much r")} and found[6] == ("/body/div.story", "Little")
    assert found[7] == ("/body/div.story", "Much r") and found[8] == ("/body/div.extra", "Much r")
    # Ties go to the longer, then the greater path.
    rows = [(i, "http://t.example/", f"<body><div class={c}>{short}</div>") for i, c in enumerate("ab")]
    assert {r["path"] for r in html_extract.extract(pages(spark, *rows)).collect()} == {"/body/div.b"}


PAYLOADS = [None, "", "a" * 99, "a" * 100, "é" * 50, "x" * 120 + "\r\n\r\n" + warc.separator("0") + "tail", "line\r\n\r\n", "cr\r", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3, "z" * 200_000]


def test_payloads_that_look_like_records_round_trip(spark, tmp_path):
    payloads = [warc.VERSION + "WARC-Type: response\r\n\r\n" + "x" * 100, "\r\n" + warc.VERSION, "\n" + warc.VERSION + "tail", "WARC", warc.separator("") * 40, "W" * 65_536 + warc.VERSION, "\r\n" * 40_000 + "WARC"]
    rnd = random.Random(1)
    payloads += ["".join(rnd.choice(["\r\n", "\r", "\n", "WARC/1.1", "WARC-", "WARC-Warcinfo-ID: <urn:uuid:", "x", "é"]) for _ in range(rnd.randrange(60))) for _ in range(80)]
    df = pages(spark, *[(i, "http://h.example/", p) for i, p in enumerate(payloads)])
    want = {i: (len(p.encode()), hashlib.sha256(p.encode()).hexdigest()) for i, p in enumerate(payloads)}
    path = str(tmp_path / "a")
    name = warc.write_archives(df.coalesce(1), path)
    assert warc.archive_id_of(spark, path) == name
    # However the files are split among tasks.
    for size in ("128m", "1009b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = warc.resolve_revisits(warc.read_histories(spark, path, [])).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in found} == want and len(found) == len(payloads)


def test_records_are_those_of_the_standard(spark, tmp_path):
    html = "<p>" + "é" * 100
    path = str(tmp_path / "a")
    warc.write_archives(pages(spark, (2, "http://b.example/?a=%20b", html), (1, "http://a.example/\n", html), (3, None, "")).coalesce(1), path)
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "a").glob("part*")))
    seen = {}
    while data:  # by lengths alone
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        assert version == "WARC/1.1" and rest[n : n + 4] == b"\r\n\r\n"
        seen[fields.get("X-Page-Id", "info")], data = (fields, rest[:n]), rest[n + 4 :]
    assert list(seen)[0] == "info" and seen["info"][0]["WARC-Type"] == "warcinfo" and len(seen) == 4
    (one, block), (two, again) = seen["1"], seen["2"]
    assert block.partition(b"\r\n\r\n")[2] == html.encode() and again.endswith(b"\r\n\r\n") and again in block
    assert two["WARC-Type"] == "revisit" and two["WARC-Profile"] == warc.PROFILE and two["WARC-Refers-To"] == one["WARC-Record-ID"] and two["WARC-Refers-To-Date"] == one["WARC-Date"]
    assert two["WARC-Target-URI"] == "http://b.example/?a=%20b" and one["WARC-Target-URI"] == two["WARC-Refers-To-Target-URI"] == "http://a.example/%0A"


def test_archives_round_trip(spark):
    rows = [(i, f"http://www.h{i % 3}.example:80/P{i}?q=%0A\n", p) for i, p in enumerate(PAYLOADS + PAYLOADS + PAYLOADS[:4])] + [(None, None, "b" * 300), (None, None, "b" * 300), (500, "u", "b" * 300), (500, "u", "b" * 300), (501, "u", "b" * 300)]
    found = warc.archive(pages(spark, *rows)).collect()
    first = {}
    for i, _, p in rows:
        data = (p or "").encode()
        if i is not None and len(data) >= 100:
            first[data] = min(i, first.get(data, i))
    want = []
    for i, url, p in rows:
        data = (p or "").encode()
        to = first.get(data) if i is not None and first.get(data, i) < i else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to, url or ""))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["url"]) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    ordered = sorted(found, key=lambda r: (r["range"], r["position"]))
    keys = [(r["urlkey"], r["time"], -1 if r["page_id"] is None else r["page_id"]) for r in ordered]
    assert keys == sorted(keys)
    assert warc.archive(pages(spark)).count() == 0


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/A?B#c") == "com,example)/a?b" == warc.url_key("http://example.com/a?b")
    assert warc.url_key("http://x.org") == "org,x)/" and warc.url_key("") == ""


@pytest.mark.parametrize("seed", range(6))
def test_loser_tree_merge(seed):
    rnd = random.Random(seed)
    entry = lambda n: {"urlkey": str(rnd.randrange(30)).zfill(2), "time": str(rnd.randrange(3)), "page_id": n, "record_type": "r"}
    runs = [sorted((entry(n) for n in range(rnd.randrange(40))), key=warc._order) for _ in range(rnd.randrange(1, 9))]
    pieces = [(k, run[i : i + 7]) for k, run in enumerate(runs) for i in range(0, len(run), 7)]
    pieces.sort(key=lambda p: (warc._order(p[1][0]), p[0]))
    merged = list(warc.merge_runs(pieces))
    every = sorted((x for run in runs for x in run), key=warc._order)
    assert [warc._order(x) for x in merged] == [warc._order(x) for x in every]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_reference(reference):
    coder = bpe.load(open(RANKS, "rb").read(), PATTERN)
    rnd = random.Random(3)
    letters = "ab \n\t  'stre're \x1c\x1f\xa0é1²Ⅷªµ漢字😀!?--\r ́"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(16))) for _ in range(4000)]
    texts += ["<|endoftext|> is text", "don't WE'LL  go", "   lead and trail   ", "été,", "word" * 3000, " " * 999]
    for text, packed in zip(texts, coder.encode_packed(texts), strict=True):
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == reference.encode_ordinary(text), text
        assert coder.decode_packed(packed) == text.encode()


def test_encoded_rows(spark, reference):
    rows = [(1, None), (2, ""), (3, "The 漢字 and 😀 split."), (3, "The 漢字 and 😀 split."), (None, "x"), (4, "very long " * 40_000)]
    df = spark.createDataFrame([(i, t, "a", 5) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    found = bpe.encode(df, RANKS, PATTERN, with_offsets=True).collect()
    assert len(found) == len(rows)
    for r, (i, t) in zip(sorted(found, key=lambda r: r["doc_id"] or 0), sorted(rows, key=lambda r: r[0] or 0), strict=True):
        ids = reference.encode_ordinary(t or "")
        assert (r["doc_id"], list(r["ids"]), r["n_tokens"], r["decoded"]) == (i, ids, len(ids), t or "")
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        whole = "".join
        for k, (a, b) in enumerate(zip(r["token_starts"], r["token_ends"], strict=True)):
            piece = reference.decode_single_token_bytes(ids[k])
            assert piece in whole((t or "")[a:b]).encode()
    coder = bpe.load(open(RANKS, "rb").read(), PATTERN)
    tokens = [coder.token_bytes[i] for i in reference.encode_ordinary("a 😀漢b")]
    assert "".join(bpe.decode_stream(iter(tokens))) == "a 😀漢b" and len(list(bpe.decode_stream(iter(tokens)))) < len(tokens)
    assert bpe.encode(df.limit(0), RANKS, PATTERN).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rep int, v string")


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 16)).astype(np.float32) * rng.uniform(0.5, 2, size=(700, 1)).astype(np.float32)
    v[100:160] = v[100]
    rows = [(i, v[i].tolist()) for i in range(700)] + [(701, None), (702, [0.0] * 16), (703, [float("nan")] + [1.0] * 15), (704, [float("inf")] + [1.0] * 15), (705, [None] + [1.0] * 15), (None, v[0].tolist()), (706, [1.0]), (20, v[20].tolist()), (720, None)]
    found = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=20).collect()
    exact = v.astype(float) @ v.astype(float).T
    right = total = 0
    for q in range(0, 700, 20):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 21)) and q not in {r[1] for r in own}
        assert all(abs(exact[q][i] - s) < 1e-9 for _, i, s in own)
        assert own == [(k + 1, i, s) for k, (i, s) in enumerate(sorted(((i, s) for _, i, s in own), key=lambda x: (-x[1], x[0])))]
        want = [i for i in np.lexsort((np.arange(700), -exact[q])) if i != q][:20]
        right += len({r[1] for r in own} & set(want))
        total += 20
    assert len(found) == total and right / total >= 0.9


def test_recall_on_the_embeddings_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found: dict[int, list] = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    right = 0
    for q in ids[ids % 20 == 0].tolist():
        score = ann.products(v[ids == q][0], v)
        exact = [int(ids[i]) for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        own = sorted(found[q])
        assert [r[0] for r in own] == list(range(1, 21)) and len({r[1] for r in own}) == 20
        assert all(score[ids == i][0] == s for _, i, s in own)
        right += len({r[1] for r in own} & set(exact))
    assert len(found) == (ids % 20 == 0).sum() and right >= 0.95 * 20 * len(found)


def test_an_id_with_different_vectors_counts_once(spark):
    rows = [(i, [1.0, i / 50]) for i in range(40)] + [(7, [3.0, 3.0]), (7, [1.0, 0.14]), (20, [0.5, -2.0]), (7, [3.0, 3.0])]
    found = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=10).collect()
    for q in (0, 20):
        own = [r["vec_id"] for r in found if r["query_id"] == q]
        assert len(own) == len(set(own)) == 10


def test_blocks_and_short_queries_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 7)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    rows = [(i, [1.0, i / 100, 0.0]) for i in range(60)] + [(900, [-1.0, -3.0, 5.0])]
    found = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=10, tables=1, projections=2).collect()
    own = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20, 40, 900)}
    assert len(own[900]) == 10 and all(len(x) == 10 for x in own.values())


def test_few_and_no_vectors(spark):
    found = ann.search(vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (3, [0.5, 0.5])]), F.col("vec_id") == 0)
    assert [(r["rank"], r["vec_id"], r["score"]) for r in found.orderBy("rank").collect()] == [(1, 1, 0.5), (2, 3, 0.5)]
    assert ann.search(vectors(spark, [(0, [1.0])]), F.col("vec_id") == 0).count() == 0
    assert ann.search(vectors(spark, []), F.col("vec_id") == 0).count() == 0


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return language.train(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 2 = 0"))


def test_held_out_accuracy(spark, sf_dir, model):
    held = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 2 = 1")
    blind = held.withColumns({"label": F.col("lang"), "lang": F.lit(None).cast("string")})
    found = language.identify_documents(blind, model, ["doc_id", "label"]).collect()
    assert len(found) == held.count()
    assert np.mean([r["language"] == r["label"] for r in found]) >= 0.97


def test_evidence_for_pages(spark, model):
    german = "Der schen mit und die nicht auf ein das von ist den zu sich."
    page = "<html lang='{}'><body><p>{}</p></body></html>"
    rows = [(1, "http://a.x.org/fr/1", page.format("fr", "")), (2, "http://b.x.de/1", None), (3, None, None), (4, "http://c.x.org/en/3", page.format("de", german)), (None, "::", "<"), (4, "http://c.x.org/en/3", page.format("de", german))]
    found = language.identify_pages(pages(spark, *rows), model).collect()
    named = {r["page_id"]: (r["language"], r["accepted"]) for r in found}
    assert len(found) == len(rows) and named[1] == ("fr", False) and named[2] == ("de", False) and named[4][0] == "de"
    assert not named[3][1] and not named[None][1]
    assert language.identify_pages(pages(spark), model).count() == 0


def plain_posteriors(documents, judged):
    """Posteriors by the formulas, one number at a time; documents are (text, label), what is judged (text, declared, address, host)."""
    from math import exp, log

    def codes(text):
        folded, last = [], None
        for b in (text or "").encode():
            c = b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20
            if c != 0x20 or last != 0x20:
                folded.append(c)
            last = c
        if len(folded) < 3 or set(folded) == {0x20}:
            return []
        return [((x * 961 + y * 31 + z) * 2654435761 >> 7) % 32768 for x, y, z in zip(folded, folded[1:], folded[2:], strict=False)]

    names = sorted({label for _, label in documents if label})
    counts = {n: {} for n in names}
    for text, label in documents:
        for c in codes(text) if label else ():
            counts[label][c] = counts[label].get(c, 0) + 1
    total = {n: sum(counts[n].values()) + 0.2 * 32768 for n in names}
    logs = []
    for text, declared, address, _ in judged:
        own = codes(text)
        like = {n: (sum(log((counts[n].get(c, 0) + 0.2) / total[n]) for c in own) / len(own) * min(len(own), 120) if own else 0.0) for n in names}
        logs.append((bool(own), {n: like[n] + (log(20.0) if declared == n else 0.0) + (log(10.0) if address == n else 0.0) for n in names}))

    def normal(x):
        top = max(x.values())
        weights = {n: exp(v - top) for n, v in x.items()}
        return {n: w / sum(weights.values()) for n, w in weights.items()}

    hosts, domains, whole = {}, {}, dict.fromkeys(names, 1.0)
    for (own, x), (_, _, _, host) in zip(logs, judged, strict=True):
        for n, p in normal(x).items() if own else ():
            for table, key in ((hosts, host), (domains, ".".join(host.split(".")[-2:]))):
                table.setdefault(key, dict.fromkeys(names, 0.0))[n] += p
            whole[n] += p
    out = []
    for (own, x), (_, _, _, host) in zip(logs, judged, strict=True):
        prior = {n: whole[n] / sum(whole.values()) for n in names}
        if host in hosts:
            for table, key, weight in ((domains, ".".join(host.split(".")[-2:]), 50.0), (hosts, host, 20.0)):
                prior = {n: (table[key][n] + weight * prior[n]) / (sum(table[key].values()) + weight) for n in names}
        post = normal({n: x[n] + log(prior[n]) for n in names})
        best = max(names, key=lambda n: post[n])
        out.append((best, post[best], own and post[best] >= 0.6))
    return out


def test_posteriors_equal_brute_force(spark):
    rnd = random.Random(12)
    words = {"en": "the of and that with tion".split(), "de": "der die und nicht schen ein".split(), "fr": "le la des une et ê".split()}
    say = lambda k, n: " ".join(rnd.choice(words[k]) for _ in range(n))
    labels = [*words, *words, None]
    documents = [(say(k or "en", rnd.randint(1, 30)), k) for k in (rnd.choice(labels) for _ in range(60))] + [(None, "en"), ("", "fr")]
    model = language.train(spark.createDataFrame(documents, "text string, lang string"))
    judged, rows = [], []
    for i in range(120):
        k = rnd.choice(list(words))
        text = rnd.choice([say(k, rnd.randint(1, 4)), say(k, 40), say(k, 3) + " " + say("en", 3), "", "12 34", None, say(k, 9) * 300])
        declared, address, host = rnd.choice([None, k, "de", "xx"]), rnd.choice([None, None, k, "fr"]), rnd.choice(["a.x.org", "b.x.org", "c.y.org"])
        judged.append((f" {text or str()} ", declared, address, host))  # a tag is a space
        rows.append((i, f"http://{host}/{address + '/' if address else ''}p{i}", None if text is None and declared is None else f"<html{f' lang={declared}' if declared else ''}><p>{text or ''}</p></html>"))
    found = {r["page_id"]: r for r in language.identify_pages(pages(spark, *rows), model).collect()}
    for i, (name, posterior, accepted) in enumerate(plain_posteriors(documents, judged)):
        assert abs(found[i]["posterior"] - posterior) < 1e-4, i
        assert (found[i]["language"], found[i]["accepted"]) == (name, accepted) or posterior < 0.5 + 1e-4 or abs(posterior - 0.6) < 1e-4


def test_no_text_is_judged_by_its_own_label(spark):
    """A label that only one text has counts for nothing but a declaration; dirty labels beyond the bound are not learnt."""
    rows = [(i, f"the and of with that {'tion' * (i % 5)} x{i}", "en", "s") for i in range(40)] + [(100 + i, f"der und nicht die schen {i}", "de", "s") for i in range(40)]
    rows += [(900, "the and of with that quite alone", "de", "s"), (901, None, "de", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    models = language.train_folds(df)
    assert [m.languages for m in models] == [("de", "en")] * 2
    blind = language.identify_documents(df.withColumn("lang", F.lit(None).cast("string")), models, ["doc_id"])
    found = {r["doc_id"]: (r["language"], r["accepted"]) for r in blind.collect()}
    assert len(found) == len(rows) and found[900] == ("en", True) and not found[901][1]
    many = spark.createDataFrame([(f"text {i}", f"l{i:03}") for i in range(100)] + [("more text", "l099")] * 2, "text string, lang string")
    assert len(language.train(many).languages) == language.LANGUAGES and "l099" in language.train(many).languages


def test_host_priors_are_smoothed(spark, model):
    evidence = [(i, [0.0] * 4, None, None, "h", "d") for i in range(3)]
    clear = [(10 + i, [50.0 if x == "es" else 0.0 for x in model.languages], None, None, "h", "d") for i in range(200)]
    df = spark.createDataFrame(evidence + clear + [(999, None, None, None, "other", "e")], "id long, evidence array<double>, declared string, address string, host string, domain string")
    found = {r["id"]: r for r in language.fuse(df, model.languages, ["id"]).collect()}
    assert found[0]["language"] == "es" and found[0]["posterior"] > 0.8
    assert found[999]["language"] == "es" and not found[999]["accepted"]
