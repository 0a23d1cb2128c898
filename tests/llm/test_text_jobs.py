"""Toxicity, license scans, HTML wrappers and chat formatting on small tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loopsight.llm import chat, html, license, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(11)
    words = [f"{a}{b}" for a in ("lo", "ta", "mi", "re", "su", "ka") for b in ("ne", "ro", "ti", "la", "vo")]
    docs, labels = [], []
    for i in range(900):
        w = [r.choice(words) for _ in range(r.randrange(5, 60))]
        bad = r.random() < 0.25
        if bad:
            for _ in range(r.randrange(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "glorpf" + r.choice(words), "glorpf" + r.choice(words)]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad), 1))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    scored = toxicity.fit(docs, labels).score(docs).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    rows = scored.collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    toxic, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.03 * len(clean)


def test_labels_of_held_out_rows_are_not_used(labelled):
    docs, labels = labelled
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.learn_lexicons(toxicity.training_sample(docs, x)) for x in (labels, turned))
    assert a == b and any(e.startswith("glorp") for e in a[2])


def test_toxicity_edges(labelled, odd, empty):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    out = model.score(odd.drop("score").withColumn("predicted", F.lit("old")))
    assert out.count() == odd.count() and dict(out.dtypes)["predicted"] == "int" and out.filter("score is null").count() == 0
    assert model.score(empty).count() == 0
    assert [r["score"] for r in toxicity.fit(docs, labels.filter("toxic = 0")).score(odd).select("score").collect()] == [0.0] * odd.count()
    assert toxicity.fit(docs, labels.limit(0)).constant == 0.0


def test_features_see_obfuscation_and_address():
    odds = toxicity.Odds({"=idiot": 7.0})
    f = dict(zip(toxicity.FEATURES, toxicity.features("you 1d!ot, you are an idiot", odds)))
    assert f["obfuscated_odds"] == 7 and f["strong_count"] == 1 and f["nearness"] == pytest.approx(1 / 4)
    assert dict(zip(toxicity.FEATURES, toxicity.features(None, odds)))["log_words"] == 0


def test_patience_alignment():
    a, b = "x a b c d e f y".split(), "a b q c d r e f".split()
    pairs = license.patience(a, b)
    assert [a[i] for i, _ in pairs] == list("abcdef") and all(a[i] == b[j] for i, j in pairs)
    assert pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
    assert license._increasing([(0, 3), (1, 1), (2, 2), (3, 5), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]


def test_scans(odd, empty, spark):
    t = license.prepare(license.TEMPLATES)
    filler = " ".join(f"z{k}" for k in range(5000))
    mit = license.TEMPLATES["MIT-text"]
    changed = mit.replace("free of charge", "free of any charge").replace("without limitation", "")
    found = license.scan(f"{filler} {changed} {filler} Released under the MIT License. {filler} Released under the MIT License.", t)
    assert [x["license"] for x in found] == ["MIT-text", "MIT", "MIT"] and 0.9 < found[0]["coverage"] < 1 and found[1]["coverage"] == 1
    assert license.scan("the license of the work is under the version", t) == [] and license.scan(None, t) == []
    for name, text in license.TEMPLATES.items():
        assert name in {x["license"] for x in license.scan(text, t)}
    out = license.scan_licenses(odd)
    assert out.filter(F.size("licenses") > 0).count() == 0 and out.count() == odd.count()
    assert license.scan_licenses(empty).count() == 0


def test_scans_repeated_notices():
    t = license.prepare(license.TEMPLATES)
    note, mit = license.TEMPLATES["CC-BY-NC-4.0"], license.TEMPLATES["MIT-text"]
    places = lambda text, name: [(x["first_word"], x["last_word"]) for x in license.scan(text, t) if x["license"] == name]
    assert places(f"x {note} {note} y", "CC-BY-NC-4.0") == [(1, 6), (7, 12)]
    assert places(" ".join(["x", *[note] * 50, "y"]), "CC-BY-NC-4.0") == [(1 + 6 * k, 6 + 6 * k) for k in range(50)]
    n = len(license.words_of(mit))
    filler = " ".join("software z z copy z z" for _ in range(900))
    m = len(license.words_of(filler))
    assert places(f"{mit} {filler} {mit}", "MIT-text") == [(0, n - 1), (n + m, 2 * n + m - 1)]
    assert {x["license"] for x in license.scan("\n".join([*license.TEMPLATES.values()] * 2), t)} == set(t)
    for name in t:
        assert len(places("\n".join([*license.TEMPLATES.values()] * 2), name)) == 2
    # Each copy lacks another word: still two finds, not one over both.
    cut = license.words_of(mit)
    assert len(places(" ".join([*cut[:-3], *cut[3:]]), "MIT-text")) == 2


PAGE = '<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="wrap">{ads}<div class="post"><h1>{t}</h1>{ps}</div><div id="comments"><p>first!</p></div></div><aside>more</aside><form>mail <input></form><footer>&copy; x</footer>'


def page(k, words=30):
    r = random.Random(k)
    ps = [" ".join(f"w{r.randrange(99)}" for _ in range(words)) for _ in range(1 + k % 3)]
    body = "".join(f"<p>{p}&amp;\n <b>in</b>line" + ("</p>" if k % 2 else "") for p in ps)
    return PAGE.format(t=f"Title {k}", ps=body, ads=f'<div class="ad">buy {k}</div>' * (k % 3)), " ".join([f"Title {k}", *[f"{p}& inline" for p in ps]])


def test_main_text(spark):
    made = [page(k) for k in range(12)]
    rows = spark.createDataFrame([(k, f"https://h.example/{k}", h) for k, (h, _) in enumerate(made)] + [(90, None, None), (91, "https://h.example/x", ""), (92, "https://alone.example", "<p>only &lt;b&gt; &am <p>two"), (93, "no url", "<div><nav>menu</nav>kept<br>text</div>")], "page_id long, url string, html string")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(rows).collect()}
    for k, (_, want) in enumerate(made):
        assert found[k] == (want, len(want))
    assert found[90] == ("", 0) and found[91] == ("", 0) and found[92][0] == "only <b> &am two" and found[93][0] == "kept text"
    w = {r["host"]: r for r in html.infer_wrappers(rows).collect()}["h.example"]
    assert w["region"].endswith("div.post") and ")+" in w["expression"] and ")?" in w["expression"]


def test_text_beside_the_region_stays_and_constant_blocks_go(spark):
    def made(k):
        r = random.Random(k)
        lead, end = (" ".join(f"w{r.randrange(999)}" for _ in range(8)) for _ in range(2))
        body = [" ".join(f"w{r.randrange(999)}" for _ in range(50)) for _ in range(2)]
        if k == 7:  # its story stands elsewhere
            return f"<div class=body><p>note {k}</p></div><div class=story><p>{body[0]}</p></div>", f"note {k} {body[0]}"
        return f"<div>Read this too</div><article><p>{lead}</p><div class=body>{''.join(f'<p>{b}</p>' for b in body)}</div><p>{end}</p></article>", " ".join([lead, *body, end])

    rows = [(k, f"https://h.example/{k}", f"<html><body>{made(k)[0]}</body></html>") for k in range(12)]
    near = [(100 + k, f"https://near.example/{k}", f"<div><p>one story of some length</p><p>{k}</p></div>") for k in range(5)]
    same = [(200 + k, "https://same.example/", "<p>one page, many times</p>") for k in range(5)]
    df = spark.createDataFrame([*rows, *near, *same], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert {k: found[k] for k in range(12)} == {k: made(k)[1] for k in range(12)}
    assert all(found[100 + k] == f"one story of some length {k}" and found[200 + k] == "one page, many times" for k in range(5))


def test_layout_classes_keep_the_text():
    story = "<h1 class='post-header'>Title</h1><p>A story that is long enough.</p>"
    want = "Title A story that is long enough."
    for label in ("layout with-sidebar", "has-sidebar", "no-sidebar content", "related-work", "social-science", "notice-of-appeal", "search-results", "article-header", "sidebar", "search", "footer"):
        for kept in (f"<div class='{label}'>{story}</div>", f"<div id='{label}'><article>{story}</article></div>", f"<div class='{label}'><main>{story}</main><aside>more</aside></div>"):
            assert html.main_text(f"<body><nav><a>Home</a></nav>{kept}<footer>end</footer></body>", None) == want
    part = "<p>A part of the page that counts too.</p>"
    for label in ("related-work", "social-science", "notice-of-appeal", "search-results", "post-header"):
        assert html.main_text(f"<article>{story * 3}</article><section class='{label}'>{part}</section>", None).endswith("counts too.")
    assert html.main_text(f"<form><div>{story}</div></form>", None) == want
    for label in ("ad", "x sidebar", "cookie-banner", "site-footer", "related-posts", "comments", "ad-slot"):
        assert html.main_text(f"<div class='{label}'>gone <article>short</article></div><article>{story}</article><div id='{label.split()[-1]}'>gone</div>", None) == want


def test_pages_by_a_shuffle_give_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"https://h{k % 2}.example/{k}", page(k)[0]) for k in range(8)], "page_id long, url string, html string")
    a = sorted(map(str, html.extract(rows).collect()))
    monkeypatch.setattr(html, "BROADCAST_BYTES", 0)
    assert sorted(map(str, html.extract(rows).collect())) == a
    assert html.extract(rows.limit(0)).count() == 0


def test_folding_and_alignment():
    li = ["<li>", "#", "</li>"]
    folded, made = html.fold(["<ul>", *li * 3, "</ul>"])
    assert folded == ["<ul>", ["+", *li], "</ul>"] and made == [[0], [[1, 4, 7], [2, 5, 8], [3, 6, 9]], [10]]
    w = html.align(html.fold(["<ul>", *li * 3, "</ul>", "<hr>"])[0], html.fold(["<ul>", *li, "</ul>"])[0])
    assert w == ["<ul>", ["+", *li], "</ul>", ["?", "<hr>"]] and html.expression(w) == "<ul>(<li>#</li>)+</ul>(<hr>)?"


def test_folding_undone_gives_the_stream():
    """Whatever the stream: the folded one with its groups repeated covers each item once, and long groups fold too."""
    r = random.Random(12)
    for _ in range(400):
        unit = [r.choice("abc#") for _ in range(r.randrange(1, 5))]
        items = [x for _ in range(r.randrange(1, 6)) for x in (unit * r.randrange(1, 4) + [r.choice("abc#")] * r.randrange(2))]
        folded, made = html.fold(items)
        leaves = html._leaves(made)
        assert sorted(n for x in leaves for n in x) == list(range(len(items)))
        assert all(items[n] == x for (x, _), own in zip(html.flat(folded), leaves, strict=True) for n in own)
    long = [f"<t{k}>" for k in range(45)] + ["#"]
    assert html.fold(long * 3)[0] == [["+", *long]]


def site(seed):
    """A site's pages and their main texts: a story between what the site says everywhere, comments and adverts under names that tell nothing."""
    r = random.Random(seed)
    say = lambda n: " ".join(f"w{r.randrange(9999)}" for _ in range(n))
    name = lambda: f"x{r.randrange(10**6)}"
    box, note, who, what, promo = (name() for _ in range(5))
    notice, motto, tag, shared = say(12), say(4), r.choice(["article", "main"]), say(9)
    pages = []
    for k in range(9):
        ps = [say(r.randrange(20, 60)) for _ in range(r.randrange(2, 6))]
        ps.insert(r.randrange(len(ps)), shared)  # a paragraph that all stories have
        title = say(5)
        story = f"<{tag}><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + f"</{tag}>"
        comments = "".join(f"<div class={who}><b>{say(1)}</b><div class={what}>{say(6)}</div></div>" for _ in range(r.randrange(2, 5)))
        advert = f"<div class='top-advert {promo}'>{say(7)}</div>" * r.randrange(2)
        pages.append((f"<html><body><div class={note}>{notice}</div><header>{motto}</header>{advert}{story}<section class={box}>{comments}</section><div class=user-comment>{say(3)}</div><p class={name()}></p><footer>{motto}</footer></body></html>", " ".join([title, *ps])))
    return pages


def test_sites_whose_names_tell_nothing(spark):
    rows = {f"https://s{s}.example/{k}": x for s in range(6) for k, x in enumerate(site(s))}
    alone = "<div class=q><p>Only page</p><p>of its host.</p></div><div class=reader-comments>gone</div>"
    df = spark.createDataFrame([*((n, u, h) for n, (u, (h, _)) in enumerate(rows.items())), (999, "https://one.example", alone)], "page_id long, url string, html string").repartition(4)
    found = {x["url"]: x["text"] for x in html.extract(df).collect()}
    assert found.pop("https://one.example") == "Only page of its host."
    assert found == {u: want for u, (_, want) in rows.items()}


def test_words_of_names():
    for label in ("comment-body", "user-comment", "reader-comments", "notice-box", "site-notice", "advert-top", "userComment", "post_ad"):
        assert html.marked(label), label
    for label in ("no-comments", "layout-sidebar", "has-ads", "with-notice", "notice-of-appeal", "article-body", "header-image", "adapter", "shadow-box", "comments-wrapper"):
        assert not html.marked(label), label


def test_long_streams_align_in_linear_memory():
    import tracemalloc

    r = random.Random(3)
    a, b = ([r.choice([f"<t{k}>" for k in range(60)]) for _ in range(4000)] for _ in range(2))
    tracemalloc.start()
    html.align(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20
    a, b = a[:300], b[:280]
    best = [[0] * 281 for _ in range(301)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    pairs = html.common_items(a, b)
    assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs) and all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:]))


def test_wrappers_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(html, "FAN", 2)
    rows = spark.createDataFrame([(k, f"https://h{k % 13 // 12}.example/{k}", f"<div><p>a<div class=c{k}>b</div>") for k in range(26)], "page_id long, url string, html string")
    found = {x["host"]: x for x in html.infer_wrappers(rows).collect()}
    assert set(found) == {"h0.example", "h1.example"} and found["h0.example"]["region"].startswith("div")
    assert all(f"<div.c{k}>" in found[f"h{k % 13 // 12}.example"]["expression"] for k in range(26))


def test_escapes_are_reversible():
    r = random.Random(4)
    for _ in range(2000):
        t = "".join(r.choice(["\\", "<", ">", "[", "]", "/", "s", "INST", "<s>", "[/INST]", "<<SYS>>", "\n", "é"]) for _ in range(r.randrange(12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not chat._CONTROL.search(e)
        turns = [("user", t), ("assistant", t), ("tool", t), ("", t), ("system", t)]
        assert chat.read_turns(chat.instruct_template(turns)) == turns


def digests(turns):
    text = "".join(x for r, x in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest(), len(chat.instruct_template(turns))


def test_conversations(spark):
    r = random.Random(6)
    convs = {c: [(r.choice(["user", "assistant", "system", "tool"]), r.choice(["", "</s>[INST] ok", "a\\b", "é😀" * 5])) for _ in range(n)] for c, n in enumerate([1, 2, 31, 32, 33, 34, 150])}
    rows = [(c, k, role, text) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    df = spark.createDataFrame([*rows, (99, 0, None, None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    found = {x["conv_id"]: tuple(x)[1:] for x in chat.digest(chat.format_chats(df)).collect()}
    for c, turns in convs.items():
        assert found[c] == digests(turns)
    assert found[99] == digests([("", "")]) and found[None] == digests([("user", "x")])
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


def test_spans_of_a_black_box_and_rewritten_history():
    s = chat.Spans(lambda turns: "".join(f"<{r}:{t}>" for r, t in turns))
    assert [s.add("user", "<a"), s.add("assistant", "a>a")] == [("<user:<a>", 6, 8, False), ("<assistant:a>a>", 11, 14, False)]
    last_only = chat.Spans(lambda turns: "".join(t if k + 1 == len(turns) else "..." for k, (_, t) in enumerate(turns)))
    assert not last_only.add("user", "one")[3] and last_only.add("user", "two")[3]
    numbered = chat.Spans(lambda turns: "".join(f"{k}={t};" for k, (_, t) in enumerate(turns)))
    assert "".join(numbered.add("user", "x")[0] for _ in range(100)) == "".join(f"{k}=x;" for k in range(100))


def test_rewrites_past_the_window_are_seen():
    def late_system_first(turns):
        return "".join(f"<{r}:{t}>" for r, t in sorted(turns, key=lambda x: x[0] != "system"))

    s = chat.Spans(late_system_first)
    assert not any(s.add("user", f"t{k}")[3] for k in range(40))
    piece, _, _, rewritten = s.add("system", "be kind")
    assert rewritten and "system:be kind" in piece and all(f"t{k}>" in piece for k in range(40))


def test_short_probes_may_raise():
    def strict(turns):
        if turns and turns[0][0] != "user":
            raise ValueError("begins with user")
        return "".join(f"<{r}:{t}>" for r, t in turns)

    for local in (False, True):
        s = chat.Spans(strict, local)
        turns = [(("user", "assistant")[k % 2], f"t{k}") for k in range(80)]
        assert [s.add(*t)[0] for t in turns] == [f"<{r}:{t}>" for r, t in turns]


def test_tags_with_odd_quotes():
    cases = {
        '<p title="5" tall">Hello</p>': "Hello", "<p title='a>b'>x</p>": "x", '<p title = "a>b" x>y</p>': "y", '<div class="a>x</div><p>y</p>': "x y", "a < b <3 <p": "a < b <3", "<p a=''>t<br/>u</p><!-- x --><![CDATA[z]]>w": "t u w",
        "<p a=b'c>d</p>'": "d '", "<P CLASS=x>A&amp;B</P>": "A&B", "x<!-- never closed <p>y": "x", "<a\"b>z": "z", "<p =\"q>\">k": "k",
    }
    for page_, want in cases.items():
        assert html.main_text(page_, None) == want, page_


def test_unclosed_quotes_and_long_pages_take_linear_time():
    import time

    def seconds(text):
        began = time.process_time()
        html.main_text(text, None)
        return time.process_time() - began

    for unit in ("<b x='1", '<p a="', "<!", "<", "<p>word </p>", "<x a='1' b=\"2\" c=3>w"):
        small, large = seconds(unit * 20_000), seconds(unit * 160_000)
        assert large < 30 * max(small, 0.02), unit


def test_pages_with_columns_named_like_results(spark):
    rows = spark.createDataFrame([(1, "https://h.example/1", "<p>new</p>", "old", "7", "k")], "page_id long, url string, html string, text string, n_chars string, host string")
    out = html.extract(rows).first()
    assert (out["text"], out["n_chars"], out["host"]) == ("new", 3, "k")


def test_markers_in_roles_and_stored_pieces(spark, tmp_path):
    template = lambda turns: "".join(f"<{r}|{t}>" for r, t in turns)
    s = chat.Spans(template)
    assert s.add("ab", "xy") == ("<ab|xy>", 5, 8, False)
    rows = [(c, k, ("user", "assistant")[k % 2], "same" if k < 4 else f"t{c} {k}") for c in range(5) for k in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chat.format_chats(df).orderBy("piece").write.parquet(str(tmp_path / "pieces"))
    stored = {x["conv_id"]: tuple(x)[1:] for x in chat.digest(spark.read.parquet(str(tmp_path / "pieces"))).collect()}
    assert stored == {c: digests([(r, t) for d, _, r, t in rows if d == c]) for c in range(5)}
    equal = chat.format_chats(spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, 0, "assistant", "b")], df.schema)).orderBy("n").collect()
    assert "".join(x["piece"] for x in equal) == chat.instruct_template([("assistant", "b"), ("assistant", "b"), ("user", "a"), ("user", "b")])


def test_documents_with_a_column_named_licenses(spark):
    out = license.scan_licenses(spark.createDataFrame([(1, "Released under the MIT License. Released under the MIT License.", "x")], "doc_id long, text string, licenses string")).first()
    assert [f["license"] for f in out["licenses"]] == ["MIT", "MIT"]
