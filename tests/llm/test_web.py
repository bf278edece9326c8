"""WARC round trips, HTML main text, licences, decontamination."""

import gzip
import hashlib
import io
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from corpuswright.llm import decontaminate, html_text, licenses, warc
from corpuswright.llm.store import new_dir, qualified


def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    rows = [(r.page_id, r.url, r.html) for r in pages] + [(r.page_id + 1000, r.url, r.html) for r in pages[:20]] + [(r.page_id, r.url, r.html) for r in pages[:3]]
    rows += [(5000, None, None), (5001, "u\nx", "a"), (5002, "u", "a"), (5003, None, ""), (None, "n", pages[0].html), (5004, "u", "é" * 49), (5005, "u", "é" * 49), (5006, "u", "é" * 50), (5007, "u", "é" * 50)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    folder = qualified(spark, new_dir(spark, "test"))
    got = sorted([tuple(r) for r in warc.read(warc.normalise(warc.write(df, folder), folder), folder).collect()], key=str)
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    wanted = []
    for body, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        for n, i in enumerate(ids):
            again = len(body) >= 100 and n > 0
            wanted.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    assert got == sorted(wanted, key=str)
    empty = df.limit(0)
    folder = qualified(spark, new_dir(spark, "test"))
    assert warc.read(warc.normalise(warc.write(empty, folder), folder), folder).count() == 0


def test_inflates_any_gzip_in_small_pieces(monkeypatch):
    body = b"".join(warc.record(i, f"http://h/{i}", bytes([65 + i % 26]) * (i * 37), "d", None, False) for i in range(60))
    half = body.index(b"WARC/1.1", len(body) // 2)
    monkeypatch.setattr(warc, "CHUNK", 97)
    for data in (gzip.compress(body), gzip.compress(body[:half]) + gzip.compress(body[half:])):
        found = list(warc.records(warc.inflated(io.BytesIO(data))))
        assert b"".join(w for _, w in found) == body and len(found) == 60
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.records(iter([body[:-3]])))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &lt;b&gt;  text", "plain <b> text"),
        ("<p>one<p>two<br>three <b>th</b>ree", "one\n\ntwo three three"),
        ("<nav>menu</nav><article><h1>T &amp; x</h1><p>a</p><aside>no</aside><div class='share-box'>no</div></article><footer>f</footer>", "T & x\n\na"),
        ("<body class='no-sidebar'><div id=ad-1>no</div><div>yes</div><script>var a='</p>'</script><style>p{}</style><form>no</form></body>", "yes"),
        ("<main><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table></main>outside", "a\n\nb\n\n1\n\n2\n\n3"),
        ("<article>story<section id=comments><article class=comment>reader</article></section></article>", "story"),
        ("<div>k<!-- no --><div class=ad>no</div>l</div>", "k\n\nl"),
        ("<div style='display:none'>no</div><p hidden>no<p>yes", "yes"),
        ("<p>broken <a href='x", "broken <a href='x"),
        ("<article><div class='social-history'>a</div><p class='notice'>b</p><p class='legal-theory'>c</p><math><mi>x</mi></math><label>d</label></article>", "a\n\nb\n\nc\n\nx\n\nd"),
        ("<main><p>The long story</p><article>related teaser</article></main>", "The long story\n\nrelated teaser"),
        ("<main><p>By us</p><article>a story far longer than that</article></main><p>out</p>", "a story far longer than that"),
        ("<article><div class='cookie-notice'>no</div><div class='ad_unit'>no</div><ul class='socialLinks'><li>no</ul>yes</article>", "yes"),
    ],
)
def test_main_text(html, text):
    assert html_text.Page(html).text() == text


def site_rows():
    """Hosts whose boilerplate declares nothing: around the text, within the article, and a host that repeats one article."""
    around = "<body><div class=top><span>Home</span> About</div><div class=story><p>Story {0} begins</p><p>and {1} ends</p></div><div class=low><p>All our pages 2024</p></div></body>"
    within = "<body><div><a>Home</a></div><article><h1>Title {0}</h1><div class=x7><i>Read us daily</i></div><p>Text {0} of this page</p><div class=deep><div><section><p>More {1}</p></section></div></div></article></body>"
    copied = "<body><article><h1>Title {0}</h1><p>The same long text on all pages of this host</p></article></body>"
    rows = [(i, f"http://A.example/{i}", around.format(i, 7 * i), 1) for i in range(8)]
    rows += [(20 + i, f"https://b.example/{i}", within.format(i, 7 * i), 1) for i in range(9)]
    rows += [(40 + i, f"https://c.example/{i}", copied.format(i), 1) for i in range(9)]
    rows += [(60 + i, f"https://d.example/{i}", around.format(i, 7 * i), 1) for i in range(4)]
    return rows + [(100, None, None, 1), (101, "http://e.example", "<div class=low><p>once</p></div>", 1), (0, "http://A.example/0", around.format(0, 0), 1), (102, "http://f.example", "<div>" * 300 + "deep" + "<p>" * 9, 1)]


@pytest.mark.parametrize("most", [200_000, 0])
def test_site_style_tree(spark, monkeypatch, most):
    monkeypatch.setattr(html_text, "BROADCAST", most)
    rows = site_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df.withColumnRenamed("host", "paths"), keep=("page_id", "paths")).collect()}
    assert got[0] == ("Story 0 begins\n\nand 0 ends", 26) and got[100] == ("", 0) and got[101] == ("once", 4) and got[102] == ("deep", 4)
    assert got[23][0] == "Title 3\n\nText 3 of this page\n\nMore 21", "a notice within the article goes"
    assert got[44][0] == "Title 4\n\nThe same long text on all pages of this host", "an article that the site repeats stays"
    assert got[61][0].startswith("Home About"), "four pages are too few for a tree"
    off = {r[0]: html_text.Page(r[2] or "").text() for r in rows}
    assert {i // 20 for i in off if off[i] != got[i][0]} == {0, 1}, "without the tree its hosts keep their boilerplate"
    assert html_text.extract(df.limit(0)).count() == 0


def plain_noise(rows):
    """Noise of all hosts by their pages' own lists, recursively."""
    hosts = defaultdict(list)
    for _, url, html, _ in rows:
        hosts[html_text.host(url)].append(html_text.Page(html or ""))
    out = set()

    def entropy(counts, base):
        total = sum(counts)
        return -sum(c / total * math.log(c / total) for c in counts) / math.log(max(base, 2))

    for h, pages in hosts.items():
        parent, declared = {}, {}
        for page in pages:
            for path, (up, _, bits, _) in page.seen.items():
                parent[path], declared[path] = up, bits & declared.get(path, bits)
        n = {x: sum(x in page.seen for page in pages) for x in parent}

        def value(x, h=h, pages=pages, parent=parent, declared=declared, n=n):
            kids = [value(c) for c in parent if parent[c] == x]
            weights = [n[c] for c in parent if parent[c] == x]
            if n[x] < html_text.PAGES:
                return 1.0, False
            texts = Counter(t for page in pages for t in {t for t, paths, _, _ in page.blocks if paths[-1] == x})
            looks = Counter(y for page in pages if x in page.seen for y in page.seen[x][3])
            # The mean entropy of a text over the pages that show it.
            own = 1 - sum(entropy([1] * c, n[x]) for c in texts.values()) / len(texts) if texts else None
            if kids:
                keep = html_text.DAMPING ** len(kids)
                inner = (1 - keep) * entropy(looks.values(), n[x]) + keep * sum(w * k[0] for w, k in zip(weights, kids, strict=True)) / sum(weights)
                v = inner if own is None else max(inner, own)
            else:
                v = own or 0.0
            limit = html_text.IMPORTANCE * (2 if declared[x] & html_text.HINT else 1) * (0.5 if declared[x] & html_text.INSIDE else 1)
            noise = v < limit and all(k[1] for k in kids)
            if noise:
                found.add(x)
            return v, noise

        found = set()
        for x in parent:
            if parent[x] == 0:
                value(x)
        out |= {(h, x) for x in found if parent[x] not in found}
    return out


def test_style_tree_equals_plain_version(spark, sf):
    r = random.Random(3)
    rows = site_rows() + [(p.page_id, p.url, p.html, 1) for p in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    for i in range(60):
        parts = [f"<{t} class={r.choice(['a', 'b', 'notice'])}>{r.choice(['x', 'y', str(i)])}<div>{r.choice(['same', str(i)])}</div></{t}>" for t in r.choices(["div", "p", "section"], k=r.randint(1, 5))]
        rows.append((i, f"http://r{i % 3}.example", "<body>" + "".join(parts) + "</body>", 1))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {tuple(x) for x in html_text.noise_paths(df).collect()}
    assert got == plain_noise(rows) and len(got) > 5


def test_pages_equal_their_articles(spark, sf):
    from html import unescape

    for r in html_text.op10_query(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def plain_licenses(text, threshold=0.8):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: list(zip(w, w[1:], strict=False))
    text, found = grams(words(text)), []
    for i, (_, t) in enumerate(licenses.TEMPLATES):
        whole = grams(words(t))
        s = set(whole)
        for a in range(len(text)):
            best = (threshold - 1e-9, None)
            for n in licenses.widths(len(whole), threshold) if text[a] in s else ():
                own = set(text[a : a + n])
                dice = 2 * len(own & s) / (len(own) + len(s))
                if a + n <= len(text) and dice > best[0] + 1e-12 * (best[1] is not None):
                    best = (dice, a + n)
            if best[1]:
                found.append((i, best[0], a, best[1], len(s)))
    found.sort(key=lambda f: (-round(f[1], 12), -f[4], f[2], f[3], licenses.TEMPLATES[f[0]][0], f[0]))
    kept = []
    for f in found:
        if all(f[3] < k[2] or f[2] > k[3] for k in kept):
            kept.append(f)
    return sorted((i, round(d, 9), a, z) for i, d, a, z, _ in kept)


def test_licenses(spark):
    named = lambda name, least: next(t for n, t in licenses.TEMPLATES if n == name and len(t) > least)
    mit, r = named("MIT", 300), random.Random(8)
    worn = " ".join(w for w in named("BSD-3-Clause", 300).split() if r.random() > 0.04)
    prose = " ".join(r.choice("the of software and in this for any use with license copy".split()) for _ in range(400))
    texts = [
        None, "", "License", "x\nLicensed under CC BY-NC 4.0.\nThe text", "intro line\n" + mit.replace(". ", ".\n") + "\nend of it",
        mit.replace(", ", ",\n") + "\nAll rights reserved.\nLicensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 9.",
        f"Much is said here. Licensed under the MIT License. And more of it follows, all in {prose} one line", f"{prose} {worn} {prose}", "All rights reserved.\n" * 30, "SPDX-License-Identifier: EUPL-1.2", "SPDX-License-Identifier: ISC", mit + " " + mit,
    ]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)]
    got = defaultdict(list)
    for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license int")).collect():
        got[x.doc_id].append((x.template, round(x.dice, 9), x.first_word, x.last_word))
    for i, t in enumerate(texts):
        assert sorted(got[i]) == sorted(plain_licenses(t) * (1 + (i == 3))), i
    names = lambda i: [licenses.TEMPLATES[f[0]][0] for f in sorted(got[i], key=lambda f: f[2])]
    assert names(7) == ["MIT"] and "BSD-3-Clause" in names(8) and len(got[9]) == 30 and names(10) == [] and names(11) == ["ISC"] and names(12) == ["MIT", "MIT"]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    by_id = {x.license: (x.first_line, x.last_line) for x in licenses.scan(spark.createDataFrame([(1, texts[5])], "doc_id long, text string")).collect()}
    assert by_id["Apache-2.0"] == (texts[5].count("\n"),) * 2


def test_licenses_in_the_midst_of_lines_and_in_long_texts():
    r, t = random.Random(2), licenses.Templates(licenses.TEMPLATES)
    noise = lambda n: " ".join("".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(n))
    found = [any(licenses.TEMPLATES[f[1]][0] == name for f in t.find([f"{noise(50)} {text} {noise(50)}"], 0.8)) for name, text in licenses.TEMPLATES]
    assert all(found)
    for notice in ("All rights reserved.\n", licenses.TEMPLATES[4][1] + "\n"):
        n = 4000 if len(notice) < 50 else 400
        began = time.perf_counter()
        assert len(t.find([notice * n], 0.8)) >= n * 0.99
        assert time.perf_counter() - began < 10
    began = time.perf_counter()
    t.find(["All rights reserved.\n" * 4000], 0.8)
    assert time.perf_counter() - began < 2


def test_decontamination_equals_brute_force(spark):
    r = random.Random(6)
    text = lambda k: [f"w{r.randint(0, 300)}" for _ in range(k)]
    items = [text(k) for k in (5, 12, 20, 35, 36, 60, 200)] + [["only", "three", "words"], []]
    docs = [None, "", "Only, three words!", " ".join(text(3000))]
    for item in items[:7]:
        docs.append(" ".join(text(400) + item + text(300)).upper())
        half = len(item) // 2
        docs.append(" ".join(text(200) + item[:half] + text(150) + item[half:] + text(10)))
        docs.append(" ".join(text(50) + item[:half] + text(20)))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)] + [(5, docs[4], 1)], "doc_id long, text string, n_item int")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(99, None)], "item_id long, text string")

    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    wanted = []
    for i, t in [*enumerate(docs), (5, docs[4])]:
        for j, item in enumerate(items):
            g = grams(" ".join(item))
            common = len(g & grams(t))
            if g and common >= 0.8 * len(g):
                wanted.append((i, j, len(g), common))
    got = sorted((r.doc_id, r.item_id, r.n_item, r.n_common) for r in decontaminate.matches(df, bench).collect())
    assert got == sorted(wanted) and len(got) >= 10
    clean = sorted(r.doc_id for r in decontaminate.keep_clean(df, bench).collect())
    hits = {i for i, *_ in sorted(wanted) if i != 5}
    assert clean == [i for i in range(len(docs)) if i not in hits], "the second row with id 5 goes, the first stays"
    assert decontaminate.matches(df, bench.limit(0)).count() == 0 and decontaminate.matches(df.limit(0), bench).count() == 0


def test_decontamination_keys_of_any_type(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([("a", 1, text + " nine"), ("b", None, "clean"), (None, 3, text.upper() + " word" * 60_000), ("a", 1, text + " nine")], "id string, item_id int, text string")
    for kind, keys in (("int", [None, 7]), ("string", [None, "x"]), ("date", [None, None]), ("array<int>", [[1], None])):
        bench = spark.createDataFrame([(keys[0], text), (keys[1], text), (keys[1], None)], f"item_id {kind}, text string")
        got = decontaminate.matches(docs, bench, key="id").collect()
        assert Counter((r.id, str(r.item_id)) for r in got) == Counter((d, str(k)) for d in ("a", "a", None) for k in keys)
        assert [r.id for r in decontaminate.keep_clean(docs, bench).collect()] == ["b"]
    same = decontaminate.matches(docs, bench, key="item_id")
    assert same.columns[:2] == ["item_id", "item_item_id"] and same.count() == 6
