"""Page templates on written-out pages, toxicity on held-out labels, and the pipeline."""

import random
import zlib

import pytest

import corpus_pipeline
from moltraj.llm import pages, toxicity
from moltraj.llm.shared import written
from tests.llm import cases

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home {n}</a></li></ul></nav><div class="ad banner">Buy {n}</div>
<article><h1>Title {n}</h1><p>First&nbsp;&amp; <b>bold {n}<br>line<p>Second   {n}</p><form>Name <input></form></article>
<aside>Aside {n}</aside><div id="comments"><p>Nice {n}</p></div><footer>Foot</footer>"""
EXPECTED = "Title {n}\nFirst & bold {n} line\nSecond {n}"


def test_single_pages():
    assert pages.main_text(PAGE.replace("{n}", "7"), None) == EXPECTED.replace("{n}", "7")
    assert pages.main_text("", None) == ""
    assert pages.main_text("plain  words\n only", None) == "plain words only"
    assert pages.main_text("<div><p>a<p>b</div> c &lt;x&gt; <", None) == "a\nb\nc <x> <"
    assert pages.main_text("<!-- x --><script>y", None) == ""
    assert pages.main_text("<p>" * 3000 + "deep", None) == "deep"
    assert pages.main_text("<div hidden>no</div><main><p>yes</main><a href='>'>after", None) in ("yes", "yes\nafter")


def test_templates_find_the_container_and_constant_blocks(spark):
    """Without article elements: a container found by its share of the host's text, and a notice on every page."""
    rows = []
    for n in range(12):
        body = " ".join(f"w{n}x{i}" for i in range(80))
        page = f"<body><div class='top'><span>Welcome to our site</span></div><div class='box'><h1>T{n}</h1><p>{body}</p></div><div class='end'>All rights reserved</div></body>"
        rows.append((n, f"http://host.example/{n}", page))
    rows += [(100, "http://single.example/", PAGE.replace("{n}", "1")), (101, None, None), (101, None, None), (None, "odd", ""), (102, "HTTP://host.example/z", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'own' AS text", "'own' AS _host")
    got = {(r["page_id"], r["url"]): r["text"] for r in pages.main_texts(df).collect()}
    for n in range(12):
        assert got[n, f"http://host.example/{n}"] == f"T{n}\n" + " ".join(f"w{n}x{i}" for i in range(80))
    assert got[100, "http://single.example/"] == EXPECTED.replace("{n}", "1")
    assert got[101, None] == "" and got[None, "odd"] == "" and pages.main_texts(df).count() == len(rows)
    template = pages.site_templates(df).where("_host = 'host.example'").first()["_template"]
    assert {node["path"] for node in template if node["path"] is not None} >= {"", "body", "body/div.box", "body/div.box/p"}
    assert sum(node["path"] is None for node in template) == 2
    assert pages.main_texts(df.limit(0)).count() == 0


def corpus(spark, n=600):
    draw = random.Random(9)
    words = [f"{a}{b}" for a in ("ba", "ko", "li", "mu", "re") for b in ("ta", "no", "si", "du", "we", "pa")]
    rows, labels = [], []
    for i in range(n):
        text = [draw.choice(words) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            text[draw.randrange(60)] = draw.choice(["idiot", "scum", "zorkta", "zorkel", "zorkum"])
            text[draw.randrange(60)] = draw.choice(["moron", "zorkin"])
        rows.append((i, " ".join(text), "en", f"s{i % 3}", None))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    model, cast = toxicity.fitted(docs, labels)
    assert "zork" in model.stems and cast.count() == 600
    got = {r["doc_id"]: r["score"] for r in cast.select("doc_id", model.score(cast["counts"]).alias("score")).collect()}
    held_out = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 6 == 0) for i in held_out) and len(held_out) > 60
    direct = {r["doc_id"]: r["score"] for r in docs.select("doc_id", model.score_text().alias("score")).collect()}
    assert direct == got
    hidden = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    assert toxicity.fitted(docs, hidden)[0].stems == model.stems


@pytest.mark.parametrize("labelled", [False, True])
def test_toxicity_of_odd_rows(spark, labelled):
    docs = cases.documents(spark, True)
    labels = spark.createDataFrame([(1, 0, 0), (16, 1, None), (None, 1, 1)] if labelled else [], "doc_id bigint, quality int, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.dtypes == docs.dtypes and kept.count() == docs.count()
    assert toxicity.scores(cases.empty(spark), labels).count() == 0


def test_pipeline_stages_follow_each_other(spark, tmp_path):
    docs, labels = corpus(spark, 240)
    docs = docs.unionByName(docs.limit(5)).unionByName(cases.documents(spark).selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars"))
    benchmark = spark.createDataFrame([(1, cases.BODY)], "item_id bigint, text string")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        table.coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kinds = current.dtypes
    before = current
    for name, stage in corpus_pipeline.STAGES:
        before, current = current, written(stage(spark, current, str(tmp_path)))
        if name != "packing":
            assert current.dtypes == kinds, name
        if name == "toxicity":
            texts = " ".join(r["text"] or "" for r in current.collect())
            assert "scum" not in texts and "zork" not in texts and current.count() < before.count()
        if name == "line_dedup":
            assert current.count() == before.count()
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in current.collect())
        if name == "near_dedup":
            assert current.count() == current.select("doc_id").distinct().count() < before.count()
        if name == "decontamination":
            assert not any(cases.BODY in (r["text"] or "") for r in current.collect())
    ids = {r["doc_id"] for r in current.collect()}
    assert ids == {r["doc_id"] for r in before.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_all_stems_with_support_are_mined(spark):
    """Forty families of insults, more than any fixed number of slots used to hold."""
    families = [f"{a}{b}rk" for a in "bcdfghlk" for b in "aeiou"]
    rows = [(i, f"{families[i % 40]}on calm words only", "en", "s", None) for i in range(800)]
    rows += [(i, "calm words only", "en", "s", None) for i in range(800, 2400)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i < 800)) for i in range(2400)], "doc_id bigint, quality int, toxic int")
    model, cast = toxicity.fitted(docs, labels)
    assert {stem[:4] for stem in model.stems} == set(families)
    low = cast.where("doc_id < 800").where(model.score(cast["counts"]) < 0.5)
    assert low.count() == 0


@pytest.mark.parametrize("wrapper", ["<div class='layout has-sidebar'>", "<div class='no-sidebar'>", "<div id='search-page'>", "<div class='share-price-report'>"])
@pytest.mark.parametrize("inner", ["<article><p>{}</p></article>", "<article class='post comments-open'><p>{}</p></article>", "<div><p>{}</p></div>"])
def test_marked_wrappers_keep_the_article(wrapper, inner):
    body = "a report of some length about the price of a share"
    page = f"<body><nav>menu</nav>{wrapper}{inner.format(body)}<div class='sidebar'>x</div></div><div class='comments'>y</div></body>"
    assert pages.main_text(page, None) == body


def test_marks_that_say_nothing_else_hold():
    assert pages.main_text("<body><div id='comments'><p>only a reader</p></div></body>", None) == ""
    longer = "<article><p>word of a reader, longer than the story</p></article>"
    assert pages.main_text(f"<article><p>story</p></article><section class='comments'>{longer}</section>", None) == "story"
    assert pages.main_text("<div><p>story of some length</p></div><div id='comments'><article class='comment'>a</article></div>", None) == "story of some length"


def neutral(n, words=60):
    body = " ".join(f"w{n}x{i}" for i in range(words))
    return (
        f"<body><div><div>Home News Sport {'menu ' * 30}</div></div><div><div>Headline {n}</div><div>{body}</div><div>Sign up for our paper</div>"
        f"<div>{body[::-1]}</div></div><div><div>All rights reserved {'legal ' * 30}</div></div></body>"
    )


def neutral_text(n, words=60):
    body = " ".join(f"w{n}x{i}" for i in range(words))
    return f"Headline {n}\n{body}\n{body[::-1]}"


def test_neutral_tags_are_told_apart_by_the_template_alone(spark):
    """Only div elements without classes: constants go outside and inside the container, slots are extracted."""
    rows = [(n, f"http://plain.example/{n}", neutral(n)) for n in range(9)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.main_texts(df).collect()}
    assert got == {n: neutral_text(n) for n in range(9)}
    assert all(pages.main_text(page, None) != got[n] for n, _, page in rows)


def test_near_copies_of_one_page_keep_their_shared_text(spark):
    shared = "".join(f"<div>passage {i} that all of them share</div>" for i in range(8))
    rows = [(n, f"http://copies.example/{n}", f"<body><article><h1>Copy {n}</h1>{shared}</article></body>") for n in range(8)]
    rows += [(100 + n, "http://twins.example/", f"<article><p>twin page</p></article>") for n in range(8)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.main_texts(df).collect()}
    lines = "\n".join(f"passage {i} that all of them share" for i in range(8))
    assert got == {n: f"Copy {n}\n{lines}" for n in range(8)} | {100 + n: "twin page" for n in range(8)}


def test_classes_agree_with_brute_force(spark):
    """Occurrence vectors written out page by page; repeated rows count as pages of their own."""
    draw = random.Random(4)
    rows = []
    for n in range(40):
        parts = [f"<div class='{draw.choice('abc')}'><p>{draw.choice(['same', 'other', f'own {n}'])}</p></div>" for _ in range(draw.randrange(1, 5))]
        rows.append((n // 2 if n % 5 == 0 else n, f"http://h{n % 3}.example/{n % 7}", f"<body>{''.join(parts)}<section><p>end</p></section></body>"))
    rows += rows[:6]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["_host"]: {node["token"] for node in r["_template"]} for r in pages.site_templates(df).collect()}
    for host in {url.split("/")[2] for _, url, _ in rows}:
        # Rows with equal id and address are one page number: their counts add up under it.
        counts, parents, support = {}, {}, {}
        of_host = [(page_id, url, page) for page_id, url, page in rows if url.split("/")[2] == host]
        for page_id, url, page in of_host:
            for name, parent, _, n, _ in pages.page_tokens(page):
                vector = counts.setdefault(name, [])
                vector.append((page_id, url, n))
                support[name] = support.get(name, 0) + 1
                parents[name] = parent
        classes = {}
        for name, vector in counts.items():
            if 2 * support[name] > len(of_host):
                classes.setdefault(tuple(sorted(vector)), set()).add(name)
        def nested(name, classes):
            """Whether a token and all around it are in classes that are left."""
            return name == -1 or any(name in group for group in classes) and nested(parents[name], classes)

        left = list(classes.values())
        while bad := [group for group in left if not all(nested(name, left) for name in group)]:
            left = [group for group in left if group not in bad]
        assert got[host] == set().union(*left)
