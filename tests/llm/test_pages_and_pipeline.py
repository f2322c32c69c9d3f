"""HTML, WARC and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from tallysheaf.llm import html, warc

PAGES = "page_id long, url string, html string, host string, token long, text string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows], PAGES).repartition(3)


def page(title, paragraphs, extra=""):
    body = "".join(f"<p>{p}" for p in paragraphs)
    return f"""<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>if (a < b) document.write("</p>")</script></head>
    <body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a><li><a href=/b>More</a></ul></nav><div id=cookie-notice>We use cookies</div>
    <div class="main-col"><article class="post-{len(title)}"><h2>{title}</h2>{body}<div class="share">Share this</div><span>Read on for more</span></article>
    <div class=sidebar><p>Side text that is long enough to be mistaken for content, were it not for its place.</p></div></div>
    <section class="comments"><p>Reader says no</p></section>{extra}<form>Name <input name=q></form><footer>&copy; all</footer></body></html>"""


def test_main_text_of_hosts(spark):
    rng = random.Random(1)
    rows = []
    for i in range(12):
        rows.append((i, f"https://Host.example/{i}", page(f"T{i} &amp; co", [f"para {i} {n}  <b>bold</b>\n{'w ' * rng.randrange(5, 60)}" for n in range(3)])))
    rows += [(90, None, None), (91, "http://other.example/x", ""), (92, "http://third.example/x", "<p>just<br>text <i>here"), (93, "not a url", "no tags &lt;here&gt;")]
    got = {r["page_id"]: r["text"] for r in html.extract(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        lines = got[i].split("\n")
        assert lines[0] == f"T{i} & co" and len(lines) == 4 and lines[1].startswith(f"para {i} 0 bold w")
        assert "Share" not in got[i] and "Read on" not in got[i] and "Side" not in got[i] and "Reader" not in got[i]
    assert (got[90], got[91], got[92], got[93]) == ("", "", "just text here", "no tags <here>")


def test_main_text_of_copies(spark):
    """Pages that are all copies of one article, with and without other marks around it, keep its text."""
    same = page("One story", ["the first paragraph", "the second paragraph"])
    rows = [(i, "https://copies.example/a", same) for i in range(6)]
    rows += [(10 + i, None, same) for i in range(6)]  # null urls share one host
    rows += [(20 + i, f"https://marks.example/{i}", page("One story", ["the first paragraph", "the second paragraph"], f"<p>served in {i} ms")) for i in range(6)]
    rows += [(30 + i, "https://few.example/", page("Story %d" % (i % 2), ["a shared paragraph", f"own {i % 2}"])) for i in range(8)]
    rows += [(40 + i, "https://many.example/", page("Story %d" % (i % 6), [f"own {i % 6} words"])) for i in range(12)]
    got = {r["page_id"]: r["text"].split("\n") for r in html.extract(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in [*range(6), *range(10, 16), *range(20, 26)]:
        assert got[i][:3] == ["One story", "the first paragraph", "the second paragraph"]
    for i in range(8):
        assert got[30 + i][:3] == [f"Story {i % 2}", "a shared paragraph", f"own {i % 2}"]
    for i in range(12):
        assert got[40 + i] == [f"Story {i % 6}", f"own {i % 6} words"]  # repeats do not hide the template's words


STORY = "<h2>Title</h2><p>first paragraph of the story</p><p>second paragraph of the story</p>"
SIDE = "<div class=sidebar><p>aside</p></div><div id=comments><article class=comment><p>reader words</p></article></div>"


@pytest.mark.parametrize("around", ["class='layout no-sidebar'", "class=has-sidebar", "class='page with-comments'", "id=page-with-toolbar", "class='post has-share'", "class='row sidebar-left'", "class=has-header", "class='wrap menu'"])
def test_class_names_around_the_content(around):
    want = "Title\nfirst paragraph of the story\nsecond paragraph of the story"
    for inner in (f"<article>{STORY}</article>", f"<div class=content>{STORY}</div>", f"<main><div {around}>{STORY}</div></main>", f"<div {around}><article>{STORY}</article></div>"):
        assert html.main_text(f"<body><div {around}>{inner}{SIDE}</div></body>", None, set()) == want
        assert html.main_text(f"<body {around}><div class=text-logo><p>My site</p></div><div {around}>{inner}</div>{SIDE}</body>", None, set()) == want
    assert html.main_text(f"<main><p>Lead</p><div {around}><article>{STORY}</article></div></main>", None, set()).endswith(want)
    assert html.main_text(f"<body><div {around}>{STORY}</div></body>", None, set()).endswith(want.partition("\n")[2])


def test_class_names_beside_and_inside_the_content():
    many = "<article class=comment><p>reader words that go on and on</p></article>" * 9
    short = "<p>short story</p>"
    for page_ in (f"<article>{short}<div class=comments>{many}</div></article>", f"<main><div class=post>{short}</div><div id=comments>{many}</div></main>", f"<div class='layout no-sidebar'><article>{short}</article><div class=comments>{many}</div></div>"):
        assert html.main_text(page_, None, set()) == "short story"
    assert html.main_text(f"<div class=content>{STORY}</div><div class=sidebar><div class=sidebar-content><p>aside</p></div></div>", None, set()).endswith("second paragraph of the story")


def test_host_with_class_names_around_the_content(spark):
    rows = [(i, f"https://wraps.example/{i}", page(f"T{i}", [f"para {i} {n}" for n in range(3)]).replace('"main-col"', '"main-col layout has-sidebar sidebar-left"')) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html.extract(pages(spark, rows)).collect()}
    assert got == {i: "\n".join([f"T{i}", *(f"para {i} {n}" for n in range(3))]) for i in range(8)}


def test_unclosed_and_nested_markup():
    text = html.main_text('<div class="content"><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><!-- <p>no</p> -->tail <b>bo<i>ld</b> x<p hidden>gone</p></div>', None, set())
    assert text == "one\ntwo\na b\nc\ntail bold x"
    assert html.main_text("<" * 2000 + "p>" + "<div>" * 3000 + "deep", None, set()).endswith("deep")


def test_broken_quotes_and_many_openings():
    assert html.main_text('<div class="content"><p>a <a href="x>b</a> c</p><p>d</p></div>', None, set()) == "a b c\nd"
    assert "end" in html.main_text('<p title="' * 3000 + "x</p>end", None, set())
    assert html.main_text("<script>" * 2000 + "</script>x", None, set()) == "x"


def test_warc_round_trip_and_damage(spark):
    rows = [(i, f"http://h.example/{i}", "x" * (i * 997 % 5000)) for i in range(300)] + [(7, None, None), (7, None, None)]
    store = warc.stage(warc.write_segments(pages(spark, rows)), "store")
    written = warc.index(store)
    assert written.count() == len(rows)
    seen = [(h["warc-target-uri"], p) for r in store.collect() for _, h, p in warc.records(bytes(r["data"]))]
    assert sorted(seen) == sorted((u or "", (h or "").encode()) for _, u, h in rows)
    one = warc.tree(written.select("segment", "place", "hash"))
    assert warc.audit(one, warc.tree(warc.read_back(store))).count() == 0
    victim = written.orderBy("segment", "place").collect()[5]
    broken = store.withColumn("data", F.when(F.col("segment") == victim["segment"], F.expr(f"overlay(data placing X'00' from {victim['start'] + 3} for 1)")).otherwise(F.col("data")))
    bad = [r["number"] for r in warc.audit(one, warc.tree(warc.read_back(broken))).collect()]
    assert bad == [victim["segment"] * warc.RECORDS + victim["place"]]


def test_warc_reader_goes_on_after_damage():
    data = b"".join(warc.record(f"http://e/{i}", b"p" * i) for i in range(5))
    at = data.index(b"http://e/2")
    broken = data[:at] + b"\r\n\r\n" + data[at:]
    assert [len(p) for _, _, p in warc.records(broken)] == [0, 1, 3, 4]


def test_empty_pages(spark):
    none = pages(spark, [(1, "u", "h")]).filter("page_id > 5")
    assert html.extract(none).count() == 0
    store = warc.stage(warc.write_segments(none), "store")
    assert warc.audit(warc.tree(warc.index(store).select("segment", "place", "hash")), warc.tree(warc.read_back(store))).count() == 0


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    head, tail = ([rng.choice(vocabulary) for _ in range(40)] for _ in range(2))
    texts, labels = [], []
    for i in range(240):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))]
        if i % 4 == 0:
            w[3], w[9], w[14], w[20] = "zorgblat", "zorgblats", "zorgblatter", "zorgo"
        texts.append(" ".join(w))
        labels.append((i, 1, int(i % 4 == 0)))
    near = [*base]
    near[75] = "changed"
    texts += [" ".join(base), " ".join(base).replace(" ", "  ", 1), " ".join(near), " ".join([*passage, *tail]), " ".join([*head, *passage]), None]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (name, step) in enumerate(pipeline.STAGES):
        docs = step(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        seen.append(docs.toPandas())
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic, exact, near_, cut, packed = seen
    clean = {i for i in range(240) if i % 4} | set(range(240, 246))
    assert set(toxic.doc_id) == clean
    assert set(exact.doc_id) == clean - {241}
    assert set(near_.doc_id) == clean - {241, 242}
    assert dict(zip(cut.doc_id, cut.text))[244].strip() == " ".join(head) and dict(zip(cut.doc_id, cut.n_chars))[244] == len(dict(zip(cut.doc_id, cut.text))[244])
    assert set(packed.doc_id) == set(cut.doc_id)
    assert pipeline.run(spark, str(tmp_path)).count() == len(packed)


def plain(i, story, place="mid", order=0):
    """A page of a host that marks nothing: long words of the site around a short story, in divs."""
    lines = ["<div>About this site and all that we have written on it since the beginning of the century.</div>", "<div>Our editors meet every day and talk about the things that matter to our readers.</div>"]
    left = f"<div class=alpha>{lines[order]}{lines[1 - order]}</div>"
    right = "<div class=beta><span>All articles are the work of their authors, who answer for what they say here.</span></div><div class=gamma>Written by hand in a small town at the sea, printed on the first of every month.</div>"
    body = f"<div class=b1><h2>{story[0]}</h2>" + "".join(f"<p>{x}</p>" for x in story[1:]) + "</div>"
    return f"<html><body><div class={place}>{left}{body}{right}</div></body></html>"


def stories(n):
    rng = random.Random(n)
    return [[f"Story {i}", *(" ".join(rng.choice(["sun", "moon", "tide", "rain", "wind"]) + str(rng.randrange(99)) for _ in range(rng.randrange(4, 9))) for _ in range(3))] for i in range(n)]


def test_template_of_pages_that_mark_nothing(spark):
    told = stories(7)
    rows = [(i, f"https://bare.example/{i}", plain(i, s)) for i, s in enumerate(told)]
    rows += [(100 + i, "https://bare.example/again", rows[i][2]) for i in (0, 0, 3)]  # repeated pages
    rows += [(200 + i, "https://two.example/", plain(i, s)) for i, s in enumerate(told[:2])]  # too few to tell
    got = {r["page_id"]: r["text"] for r in html.extract(pages(spark, rows)).collect()}
    for i, s in enumerate(told):
        assert got[i] == "\n".join(s)
        assert html.main_text(rows[i][2], None, set()) != got[i]  # a page alone does not show its template
    assert got[100] == got[0] and got[103] == got[3]
    assert all(got[200 + i] == html.main_text(rows[i][2], None, set()) for i in (0, 1))


def test_template_words_inside_sentences_and_in_changing_order(spark):
    told = stories(6)
    mark = lambda s, i: [s[0], f"<b>Note</b> {s[1]}", *s[2:]]
    rows = [(i, "https://note.example/", plain(i, mark(s, i))) for i, s in enumerate(told)]
    rows += [(50 + i, "https://turns.example/", plain(i, s, "t", i % 2)) for i, s in enumerate(told)]
    got = {r["page_id"]: r["text"] for r in html.extract(pages(spark, rows)).collect()}
    for i, s in enumerate(told):
        assert got[i] == "\n".join([s[0], "Note " + s[1], *s[2:]])
        assert "Our editors" in got[50 + i] and "printed on" not in got[50 + i]  # texts without one order are no template


def test_slot_of_the_frame(spark):
    """What the host's pages share decides on the slot, also where a page alone would be read in another way."""
    told, rows, want = stories(6), [], {}

    def add(base, host, make):
        for i, s in enumerate(told):
            body = f"<h2>{s[0]}</h2>" + "".join(f"<p>{x} and so on for some more words</p>" for x in s[1:])
            rows.append((base + i, f"https://{host}.example/{i}", make(i, body)))
            want[base + i] = "\n".join([s[0], *(f"{x} and so on for some more words" for x in s[1:])])

    menu = lambda i: f"<ul class=zq><li><a href=/{i}>thing {i}</a></ul><div class=yx>Passing line {i}.</div>"
    # A form around the whole page, parts with names that say nothing, an article that a comment article follows.
    add(0, "form", lambda i, b: f"<body><form>{menu(i)}<article>{b}<select><option>no</select></article></form></body>")
    add(100, "names", lambda i, b: f"<body>{menu(i)}<article>{b}</article><div class=qq>{'Passing words of day ' + str(i)}</div></body>")
    add(200, "talk", lambda i, b: f"<body>{menu(i)}<article>{b}<div class=comments><article><p>{'reader words ' * 3} {i}</p></article></div></article></body>")
    # Nothing marks the larger part: what stands beside it stays.
    for i, s in enumerate(told):
        rows.append((300 + i, "https://beside.example/", f"<body><div class=p1><p>Lead {i} of the story</p></div><div class=p2><p>{' '.join(s[1:])} {'more ' * 20}</p></div></body>"))
        want[300 + i] = " ".join(f"Lead {i} of the story".split()) + "\n" + " ".join(f"{' '.join(s[1:])} {'more ' * 20}".split())
    with_host = pages(spark, rows).withColumn("host", html.host_of(F.col("url")))
    slots = {r["host"]: r["slot"] for r in html.templates(with_host).collect()}
    assert {h.split(".")[0] for h, s in slots.items() if s is not None} == {"form", "names", "talk"}
    got = {r["page_id"]: r["text"] for r in html.extract(pages(spark, rows)).collect()}
    assert got == want
    assert html.main_text(rows[0][2], None, set()) == ""  # a page alone is all form


def test_classes_equal_all_vectors(spark):
    rng = random.Random(4)
    bits = ["<div class=n1><p>note one</p></div>", "<div class=n2>other <i>words</i></div>", "<ul><li>x</li><li>y</li></ul>", "<section><h3>head</h3>tail</section>"]
    rows = [(i, f"https://{'ab'[i % 2]}.example/", f"<body>{''.join(b * rng.randrange(3) for b in bits)}<div>own {i}</div></body>") for i in range(14)]
    by: dict = {}
    for i, url, page_ in rows:
        for token, kind, *_, n, _ in html.tokens_of(page_):
            by.setdefault((url[8:17], token, kind), {})[i] = n
    want: dict = {}
    for (host, token, _), vector in by.items():
        if len(vector) > 1 or token == html.ROOT:
            want.setdefault((host, tuple(sorted(vector.items()))), set()).add(token)
    got: dict = {}
    for r in html.classes(html.page_tokens(pages(spark, rows).withColumn("host", html.host_of(F.col("url"))))).collect():
        got.setdefault((r["host"], r["vector"]), set()).add(r["token"])
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_nothing_of_the_content_is_cut():
    text = lambda page_: html.main_text(page_, None, set())
    rest = " ".join(["and so the story goes on for many words"] * 6)
    assert text(f"<div class=content><p>The standfirst.</p></div><div><p>{rest}</p></div>") == f"The standfirst.\n{rest}"
    assert text("<article><p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then</p><xmp>raw words</xmp><noscript><p>shown without scripts</p></noscript></article>") == "If x=1 then\nraw words\nshown without scripts"
    assert text(f"<noscript>Turn scripts on</noscript><article><p>{rest}</p></article>") == rest
    for name in ("class=related-work", "id=main-share", "class=search-methods"):
        assert text(f"<article><p>{rest}</p><section {name}><p>one more part</p></section></article>") == f"{rest}\none more part"
    for name in ("class=related-posts", "class=share-buttons", "id=search", "class=related"):
        assert text(f"<article><p>{rest}</p><section {name}><p>no part</p></section></article>") == rest
    assert text(f"<ul><li><a href=x>one</a><li><a href=y>two</a></ul><div><p>{rest}</p><p>see <a href=z>there</a></p></div><p>end, <a href=q>too</a></p>") == f"{rest}\nsee there\nend, too"


def test_a_page_of_many_megabytes(spark):
    long = page("Long", [f"paragraph {i} " + "w " * 400 for i in range(4000)])
    got = html.extract(pages(spark, [(1, "https://long.example/", long)])).first()["text"]
    assert got.split("\n")[0] == "Long" and len(got.split("\n")) >= 4001 and "paragraph 3999 w" in got


def run_stages(spark, folder, rows, labels, columns="doc_id long, text string, lang string, source string, n_chars long"):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame(rows, columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for n, (_, step) in enumerate(pipeline.STAGES):
        docs = step(spark, docs, str(folder))
        docs.write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        seen.append(docs)
    return seen


def test_pipeline_without_labels_repeated_ids_and_clashing_columns(spark, tmp_path):
    """Nothing is dropped but equal texts; ids that repeat with other texts stay."""
    names = "doc_id long, text string, `row` string, `on` int, `key` string, gone int, hash string, cuts string, id long, n long"
    row = lambda i, t: (i, t, "r", 1, "k", 2, "h", "c", 9, None)
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "red green blue black white grey")
    rows = [row(1, a), row(1, b), row(2, a), row(2, c), row(3, None), row(3, None), row(None, ""), row(4, "")]
    toxic, exact, near, cut, packed = run_stages(spark, tmp_path, rows, [], names)
    assert toxic.count() == len(rows) and all(x.columns == toxic.columns for x in (exact, near, cut))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in exact.collect()) == sorted([(1, a), (1, b), (2, c), (3, "")])
    # 1 and 2 are one document each, but nothing links them any more.
    assert near.count() == exact.count() and cut.count() == near.count() and packed.select("doc_id").count() == 4


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert [x.count() for x in run_stages(spark, tmp_path, [], [(1, 1, 1)])] == [0] * 5
