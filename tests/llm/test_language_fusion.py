import math
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_fusion as L

WORDS = {"en": "the and that with have this from they were which".split(), "de": "der und nicht mit das ist von sich auch eine".split(), "fr": "les des dans pour que est sur avec plus une".split()}
LANGS = ("en", "de", "fr")


def text(r, lang, n):
    return " ".join(r.choices(WORDS[lang], k=n))


def model():
    r = random.Random(1)
    pairs = [(text(r, x, 80), x) for x in LANGS for _ in range(30)]
    return L.fit_text([t for t, _ in pairs], [x for _, x in pairs], LANGS)


def page(lang, body):
    return f"<html lang=\"{lang}\"><script>the and that</script><body><p>{body}</p></body></html>"


def test_evidence_is_fused(spark):
    r = random.Random(7)
    rows = []
    for i in range(120):
        x = LANGS[i % 3]
        rows.append((i, f"http://www.{x}-site.example.{'org' if x == 'fr' else 'com'}/a{i}", page(x, text(r, x, 40))))
    rows += [
        (1000, "http://www.de-site.example.com/x", page("", "")),  # only its host speaks
        (1001, "http://new.example.net/x", page("fr", "")),  # only its declaration
        (1002, "http://www.de-site.example.com/y", page("en", text(r, "fr", 60))),  # the text outweighs both
        (1003, None, None), (1004, "not a url", page("xx", text(r, "en", 30))),
    ]
    got = {r.page_id: r for r in L.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model()).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang == LANGS[i % 3] for i in range(120))
    assert [got[i].lang for i in (1000, 1001, 1002, 1004)] == ["de", "fr", "fr", "en"]
    assert got[1003].lang in LANGS and got[1003].host == "" and all(0 < r.p <= 1 for r in got.values())


def test_a_lone_page_does_not_confirm_itself(spark):
    rows = [(i, f"http://h{i}.example.com/", page("en", text(random.Random(i), "en", 30))) for i in range(20)] + [(99, "http://odd.example.org/", page("de", ""))]
    got = {r.page_id: r for r in L.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model()).collect()}
    assert got[99].p < 0.95


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, None, "q"), (1, None, None, "q"), (None, "http://a.b/", "<p>the and that with have", "r")], "page_id long, url string, html string, host string")
    rows = L.identify(df, model()).collect()
    assert len(rows) == 3
    assert L.identify(df.limit(0), model()).collect() == []


def test_a_clear_foreign_page_stays_itself_on_a_hot_host(spark):
    r, two = random.Random(3), ("en", "de")
    bodies = [page("en", text(r, "en", 60)) for _ in range(100)]
    rows = [(i, "http://hot.example.com/", bodies[i % 100]) for i in range(10_000)] + [(20_000, "http://hot.example.com/", f"<p>{text(r, 'de', 60)}</p>")]
    fitted = L.fit_text([text(r, x, 80) for x in two for _ in range(30)], [x for x in two for _ in range(30)], two)
    got = L.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), fitted).where("page_id = 20000").collect()
    assert [x.lang for x in got] == ["de"]
    rows[-1] = (20_000, "http://hot.example.com/", "")  # a page without text is still its host's
    got = L.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), fitted).where("page_id = 20000").collect()
    assert [x.lang for x in got] == ["en"]


def test_text_evidence_grows_with_length(spark):
    few, many = model().scores(pa.array([text(random.Random(1), "de", n) for n in (60, 600)]))
    assert few[1] - few[0] > 12 and many[1] - many[0] > 5 * (few[1] - few[0])


def test_hostile_pages_are_quick():
    start = time.time()
    for bad in ("<script>" * 130_000, "<!--" * 260_000, "<" * 1_000_000, "<html " * 170_000, "<meta content-language " * 45_000, "<style" * 170_000, "<html lang=" * 90_000):
        L.TAG.sub(" ", bad)
        L.declared(bad)
    assert time.time() - start < 7


@pytest.mark.parametrize("source,lang", [
    ("<html lang=de-AT>", "de"), ("<HTML class=x LANG = 'FR'>", "fr"), ("<html data-lang=xx><p lang=en>", None), ("<html hreflang=xx>", None), ("<html><html lang=es>", "es"), ("<html lang=english>", None),
    ('<meta http-equiv="content-language" content="de">', "de"), ("<meta content=fr http-equiv=Content-Language><html lang=es>", "es"), ("<meta name=x content=de>", None), ("", None), ("<html lang=", None),
])
def test_declared(source, lang):
    assert L.declared(source) == lang


def test_addresses(spark):
    want = {
        "http://www.a.example.co.uk/x": ("www.a.example.co.uk", "example.co.uk", "co.uk"), "https://user:pw@B.Example.com:80/": ("b.example.com", "example.com", "com"), "http://127.0.0.1/x": ("127.0.0.1",) * 3, "http://[::1]:8080/": ("[::1]",) * 3,
        "http://co.uk/": ("co.uk", "co.uk", "uk"), "http://localhost/": ("localhost",) * 3, "http://a.b.io./": ("a.b.io", "b.io", "io"), None: ("", "", ""), "mailto:x": ("", "", ""),
    }
    df = spark.createDataFrame(list(enumerate(want)), "n int, url string")
    got = {r.url: (r.h, r.d, r.s) for r in df.select("url", *[c.alias(x) for c, x in zip(L.address(F.col("url")), "hds", strict=True)]).collect()}
    assert got == want


def brute(rows, model):
    """The fusion in plain Python, a page at a time."""
    k, s = len(LANGS), L.PSEUDO
    norm = lambda v: [x / sum(v) for x in v]
    soft = lambda z: norm([math.exp(x - max(z)) for x in z])
    page = []
    for i, url, html in rows:
        host = re.match(r"http://([^/]+)", url or "")
        host = host[1] if host else ""
        parts = host.split(".")
        z = list(model.scores(pa.array([L.TAG.sub(" ", html or "")]))[0])
        says = re.search(r'<html lang="(\w+)"', html or "")
        says = LANGS.index(says[1]) if says and says[1] in LANGS else None
        page.append([i, host, ".".join(parts[-2:]), parts[-1], z, soft(z), says])
    table = [[0.5 + 4.0 * (a == b) + sum(p[5][a] for p in page if p[6] == b) for b in range(k)] for a in range(k)]
    for p in page:
        z = [x + (math.log(table[a][p[6]] / sum(table[a])) if p[6] is not None else 0) for a, x in enumerate(p[4])]
        p += [z, soft(z)]
    total = lambda sel: [sum(p[8][a] for p in sel) for a in range(k)]
    top = [(x + 1) / (len(page) + k) for x in total(page)]
    out = {}
    for p in page:
        above = top
        for col, name in ((3, "suffix"), (2, "domain")):
            sel = [q for q in page if all(q[c] == p[c] for c in range(col, 4))]
            above = [(x + s[name] * above[a]) / (len(sel) + s[name]) for a, x in enumerate(total(sel))]
        sel = [q for q in page if q[1] == p[1]]
        prior = [math.log((max(x - p[8][a], 0) + s["host"] * above[a]) / (len(sel) - 1 + s["host"])) for a, x in enumerate(total(sel))]
        post = soft([x + max(y, max(prior) - L.PRIOR_ODDS) for x, y in zip(p[7], prior, strict=True)])
        out[p[0]] = (LANGS[post.index(max(post))], max(post), p[5][post.index(max(post))])
    return out


def test_fusion_equals_brute_force(spark):
    r = random.Random(11)
    rows = []
    for i in range(150):
        x = r.choice(LANGS)
        host = r.choice([f"{x}.site.com", "mixed.site.com", "a.other.org", f"h{i}.many.net"])
        rows.append((i, f"http://{host}/{i}", page(r.choice([x, x, "xx", r.choice(LANGS)]), text(r, x, r.choice([0, 1, 2, 30])))))
    fitted = model()
    got = {x.page_id: (x.lang, x.p, x.p_text) for x in L.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), fitted).collect()}
    want = brute(rows, fitted)
    for i in want:
        assert got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-6 and abs(got[i][2] - want[i][2]) < 2e-6


def test_sample_and_long_texts(spark):
    r = random.Random(5)
    rows = [(i, text(r, LANGS[i % 3], 60), LANGS[i % 3]) for i in range(90)] + [(100, text(r, "en", 5000), "en"), (None, text(r, "en", 60), "en"), (101, None, "de"), (102, text(r, "en", 60), "xx")]
    learnt = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), LANGS)
    assert [LANGS[z.argmax()] for z in learnt.scores(pa.array([text(r, x, 20) for x in LANGS]))] == list(LANGS)
    none = L.learn(spark.createDataFrame([], "doc_id long, text string, lang string"), LANGS)
    assert not none.scores(pa.array(["some words"])).any()
