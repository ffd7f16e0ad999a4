"""The ten operators: contracts against brute force, edge cases, and held-out accuracy."""

import collections
import hashlib
import html
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafmill.llm import decontam, html_extract, line_dedup, mixing, pii, quality, queries, simhash, syncmer, toxicity, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, score double, copy int, term string"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and extra columns whose names clash."""
    long_text = " ".join(f"w{i} foo{i}@bar.com" for i in range(3000))
    rows = [
        (1, "plain words are here, and more of them follow\nAll rights reserved.", "en", "a", 5, "x", 1, 0.5, 9, "t"),
        (2, None, None, None, None, None, None, None, None, None),
        (3, "", "en", "b", 0, "x", 1, 0.5, 9, "t"),
        (4, long_text, "en", "b", 9, "x", 1, 0.5, 9, "t"),
        (5, "same text twice over and over again so it is", "en", "b", 9, "x", 1, 0.5, 9, "t"),
        (5, "same text twice over and over again so it is", "en", "b", 9, "x", 1, 0.5, 9, "t"),
        (6, "same text twice over and over again so it is", "en", "c", 9, "x", 1, 0.5, 9, "t"),
        (None, "no id at all\n\n \n", "en", "c", 9, "x", 1, 0.5, 9, "t"),
        (7, "a" * 30000, "en", "c", 9, "x", 1, 0.5, 9, "t"),
    ]
    return spark.createDataFrame(rows, DOCS)


def ids(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in df.collect())


def test_odd_rows_and_empty_tables(spark, odd):
    """Reports give a row for every row; filters keep columns; nothing fails on empty tables."""
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "plain words are here and more of them follow all rights"), (2, None), (3, "")], "item_id long, text string")
    none = odd.limit(0)
    reports = {
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)), "lines": line_dedup.report, "simhash": simhash.components,
        "quality": lambda d: quality.score(d, quality.train(d, labels)), "syncmer": syncmer.compare_with_next, "decontam": lambda d: decontam.report(d, bench),
        "mixing": mixing.mix_report, "pii": pii.spans_report,
    }
    for name, f in reports.items():
        assert ids(f(odd)) == ids(odd), name
        assert f(none).count() == 0, name
    for f in (lambda d: toxicity.reject(d, None), line_dedup.dedup_lines, simhash.deduplicate, lambda d: decontam.decontaminate(d, bench)):
        assert f(odd).columns == odd.columns
        assert f(none).count() == 0
    assert mixing.mix(odd).columns == [*odd.columns, "mix_copy"]
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd.withColumn("mix_copy", F.lit(1))).columns[-1] == "mix_mix_copy"
    assert line_dedup.dedup_lines(odd).count() == odd.count()
    kept = [r["doc_id"] for r in simhash.deduplicate(odd).collect()]
    assert kept.count(5) == 1 and 6 not in kept
    pages = spark.createDataFrame([(1, None, None), (2, "junk", ""), (2, "http://A.net?x", "<p>"), (None, "http://ä.org/fr/" + "x" * 5000, "<div>" * 2000)], "page_id long, url string, html string")
    assert url_filter.judge(pages).count() == html_extract.extract(pages).count() == 4
    assert url_filter.judge(pages.limit(0)).count() == html_extract.extract(pages.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, "documents", sf), table(spark, "labels", sf)
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    # this small table has noise in its labels, so ranks are asked for, not decisions
    assert np.mean([a > b for a in toxic for b in clean]) > 0.8
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_kernel():
    k = toxicity.Kernel(["worthless", "idiot"])
    v = k.values(["worthless", "worthlless", "idiot", "weather", "xx", ""])
    assert v[0, 0] == pytest.approx(1) and v[2, 1] == pytest.approx(1)
    assert v[1, 0] > 0.8 and not v[3].any() and not v[4].any() and not v[5].any()
    assert toxicity.forms("i.d.i.o.t!") == ["idiot"] and toxicity.forms("well,idiot") == ["wellidiot", "well", "idiot"] and toxicity.forms("1d10t") == ["diot", "idiot"]
    assert toxicity.spaced_out("so i d i o t ok") == ["idiot", "diot", "iot"] and "idiot" in toxicity.spaced_out("you are a i d i o t")

    def phi(s):
        s = "^" + s + "$"
        out = collections.Counter()
        for i in range(len(s)):
            for a in range(1, 4):
                if i + a < len(s):
                    out[s[i] + s[i + a]] += 0.5 * 0.5 ** (a - 1)
                for b in range(1, 5 - a):
                    if i + a + b < len(s):
                        out[s[i] + s[i + a] + s[i + a + b]] += 0.5 ** (a + b - 2)
        return out

    for s in ("moronic", "widiott", "idiotidiot", "zz"):
        p, q = phi(s), phi("idiot")
        want = sum(p[u] * q[u] for u in p) / np.sqrt(sum(x * x for x in p.values()) * sum(x * x for x in q.values()))
        assert k.values([s], 0.0)[0, 1] == pytest.approx(want, abs=1e-6)


def test_toxicity_of_edited_insults(spark):
    """Trained on sf0.1: held-out accuracy, and ten insults with one letter put in, repeated, left out, or set apart."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, "documents", sf), table(spark, "labels", sf)
    model = toxicity.train(docs, labels)
    held = docs.join(labels.select("doc_id", "toxic"), "doc_id").where("crc32(cast(string(doc_id) as binary)) % 3 = 1")
    rows = toxicity.score(held, model).join(labels, "doc_id").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == k] for k in (1, 0))
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.01
    of = toxicity._scorer(model)
    for w in "idiot moron stupid loser trash clown scum pathetic worthless disgusting".split():
        for edit in (w, w[:2] + "x" + w[2:], w[:2] + w[1] + w[2:], w[:3] + w[4:], " ".join(w), "well," + w):
            assert of(f"you are a {edit} and more words here") >= 0.7, edit
    assert of("you are a good friend and more words here") < 0.5


def test_line_dedup_matches_sql(spark):
    got = {r["doc_id"]: r[1:] for r in line_dedup.report(table(spark, "documents")).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[0]: tuple(r[1:]) for r in con.execute(line_dedup.SQL).fetchall()}
    assert {k: tuple(v) for k, v in got.items()} == want


def test_line_dedup_small(spark):
    docs = spark.createDataFrame([(i, f"own {i}\nshared\n", f"s{i % 12}", "") for i in range(30)], "doc_id long, text string, source string, extra string")
    texts = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert texts[0] == "own 0\nshared\n" and texts[5] == "own 5\n"
    assert line_dedup.boilerplate(line_dedup.lines_of(docs), 13).count() == 0
    # a null site and an empty one are two; null ids lose lines text by text, and none where no id is known
    odd = [(i, "shared", None if i % 2 else "", "") for i in range(20)] + [(100 + i, "shared", f"s{i}", "") for i in range(8)] + [(None, f"shared\nown {i}", "s0", "") for i in range(3)]
    texts = sorted((r["doc_id"] or -1, r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(odd, "doc_id long, text string, source string, extra string")).collect())
    assert texts[:3] == [(-1, "own 0"), (-1, "own 1"), (-1, "own 2")] and [t for _, t in texts if t == "shared"] == ["shared"]
    nameless = [(None, f"all\nown {i}", f"s{i}", "") for i in range(12)]
    assert line_dedup.dedup_lines(spark.createDataFrame(nameless, "doc_id long, text string, source string, extra string")).where("text not like 'all%'").count() == 0


def test_url_rules_and_model(spark):
    urls = ["http://A.Example.NET/en/1?x", "https://example.net/de/", "http://x.example.com/de/", "http://org/fr/2", "http://notorg/fr/", "http://net", "nothing", None, "http://www.cheap-pills.example.com/en/3", "http://garden.example.org/en/2#top"]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).orderBy("page_id").collect()
    assert [r["rule"] for r in rows[:6]] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, None]
    assert [r["verdict"] for r in rows[:4]] == ["allow", "block", "block", "allow"]
    assert (rows[0]["host"], rows[0]["path"], rows[5]["path"], rows[6]["host"]) == ("a.example.net", "/en/1", "", "")
    assert rows[8]["verdict"] == "block" and rows[9]["verdict"] == "allow"
    weights = url_filter.train(spark)
    labelled = url_filter.labelled_urls()
    scored = spark.createDataFrame([(y, u) for u, y in labelled], "y int, url string").select("y", url_filter.score(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), weights).alias("s")).collect()
    assert sum((r["s"] >= 0.5) == (r["y"] == 1) for r in scored) == len(labelled)


def test_url_parts_and_rules_by_brute_force(spark):
    rng = random.Random(5)
    hosts = ["example.net", "A.Example.NET", "net", "org", "x.org", "notorg", "example.com", "www.example.com", "fooexample.net", "example.net.", "", "ä.net", "a.b.c.net"]
    paths = ["", "/", "/en/", "/EN/", "/en", "/fr/1", "/de/x?y", "#/fr/", "?/fr/", "/fr/a://b", "/en/a#b?c"]
    urls = [rng.choice(["http://", "ftp://", "//", "", "x://y://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(400)] + [None, "", "://", "a://b"]
    for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect():
        url = urls[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] >= 0.5 else "allow"))


def test_url_model_on_sites_it_was_not_trained_on(spark):
    """Held-out names, and the score of the SQL expression against the weights by hand."""
    bad = "viagra-online.example.com lottery-prize.com www.pokerstars-win.com payday-loans.org cheapest-replica-watches.com free-adult-cams.info bestbets.example.net casino-royal.example.org".split()
    good = "gitlab.com/inkscape/inkscape en.wikipedia.org/wiki/Casino realpython.com/python-strings www.cancer.gov/about www.gutenberg.org/ebooks/1342 www.smithsonianmag.com/history/poker-face docs.oracle.com/javase www.washingtonpost.com/politics".split()
    known = {u.split("://")[1].split("/")[0].removeprefix("www.") for u, _ in url_filter.labelled_urls()}
    assert not known & {u.split("/")[0].removeprefix("www.") for u in bad + good if not u.startswith("en.")}
    weights = url_filter.train(spark)
    urls = [f"https://{u}/en/12" if "/" not in u else f"https://{u}" for u in bad + good]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), rules=(), weights=weights).orderBy("page_id").collect()
    assert [r["verdict"] for r in rows] == ["block"] * len(bad) + ["allow"] * len(good)
    one = spark.createDataFrame([(r["host"], r["path"], r["score"]) for r in rows], "host string, path string, score double")
    for r in one.select("score", url_filter.features(F.col("host"), F.col("path")).alias("x")).collect():
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-sum(weights[b] for b in set(r["x"])) - weights[-1])), abs=1e-5)


def test_covering_masks_cover():
    masks = [m % 2**64 for m in simhash.covering_masks(2)]
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks)


def brute_components(prints):
    """prints: id -> fingerprint; the smallest id reachable over at most two differing bits."""
    left, out = dict(prints), {}
    while left:
        start = min(left)
        todo, group = [start], set()
        while todo:
            x = todo.pop()
            if x in left:
                fp = left.pop(x)
                group.add(x)
                todo += [y for y, v in left.items() if (v ^ fp).bit_count() <= 2]
        out |= dict.fromkeys(group, min(group))
    return out


def test_simhash_components(spark):
    rows = simhash.components(table(spark, "documents")).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    prints = {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]]))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if words else 0
        assert r["fingerprint"] == f"{want:016x}"
        prints[r["doc_id"]] = want
    want = brute_components(prints)
    assert all(r["component_id"] == want[r["doc_id"]] for r in rows)


def test_simhash_links_of_chains(spark):
    rng = random.Random(3)
    base, prints = [rng.getrandbits(64) for _ in range(30)], {}
    for k in range(400):
        v = rng.choice(base)
        for _ in range(rng.randrange(5)):
            v ^= 1 << rng.randrange(64)
        prints[k] = v
    signed = lambda v: v - 2**64 if v >> 63 else v
    distinct = spark.createDataFrame([(signed(v),) for v in set(prints.values())], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.connected(simhash.links(distinct)).collect()}
    want = brute_components(prints)
    got: dict = {}
    for k, v in prints.items():
        got.setdefault(roots.get(signed(v), signed(v)), set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(sorted(k for k in want if want[k] == w) for w in set(want.values()))


def test_connected_components_of_a_path(spark):
    n = 60
    order = list(range(n))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101)], "a int, b int")
    roots = {r["node"]: r["root"] for r in simhash.connected(edges).collect()}
    assert {roots[i] for i in range(n)} == {0} and roots[101] == 100


def test_connected_components_of_an_ascending_path(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(simhash, "materialize", lambda df, tag, f=simhash.materialize: rounds.append(tag) or f(df, tag))
    edges = spark.createDataFrame([(i, i + 1) for i in range(999)], "a int, b int")
    roots = {r["node"]: r["root"] for r in simhash.connected(edges).collect()}
    assert set(roots) == set(range(1000)) and set(roots.values()) == {0} and len(rounds) < 20


def test_near_duplicates(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()]
    rng = random.Random(1)
    for k, (_, text) in enumerate(docs[:40]):
        words = text.split(" ")
        if len(words) > 60:
            words[rng.randrange(len(words))] = "changed"
            docs.append((10_000 + k, " ".join(words)))
    groups = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {}
    for i, text in docs:
        w = text.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    alike = lambda a, b: len(a & b) / len(a | b)
    names = sorted(sets)
    close = [(i, j) for i in names for j in names if i < j and alike(sets[i], sets[j]) >= 0.8]
    assert close and sum(groups[i] == groups[j] for i, j in close) / len(close) > 0.97
    for i in names:
        if groups[i] != i:
            assert max(alike(sets[i], sets[j]) for j in names if j != i and groups[j] == groups[i]) > 0.6


def shingled(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def alike(a, b):
    return len(shingled(a) & shingled(b)) / len(shingled(a) | shingled(b))


def test_near_duplicates_with_blocks_added_cut_and_moved(spark):
    rng = random.Random(8)
    words = lambda n: [f"w{int(rng.paretovariate(0.9))}" for _ in range(n)]
    docs, pairs = [], []
    for k in range(150):
        base = words(rng.randrange(150, 600))
        n = len(base) // 6
        copy = [base + words(n), words(n) + base, base[n:], base[len(base) // 2 :] + base[: len(base) // 2]][k % 4]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        if alike(docs[-1][1], docs[-2][1]) >= 0.8:
            pairs.append((2 * k, 2 * k + 1))
    groups = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(pairs) > 120
    assert np.mean([groups[a] == groups[b] for a, b in pairs]) > 0.97


def test_near_duplicates_of_one_original(spark):
    """Copies that resemble their original, but hardly one another, are one group whichever leads a bucket."""
    rng = random.Random(4)
    docs = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(1000)]
        docs.append((1000 * g, " ".join(base)))
        for k in range(1, 121):
            copy = list(base)
            for at in rng.sample(range(1000), 20):
                copy[at] = f"new{k}x{at}"
            docs.append((1000 * g + k, " ".join(copy)))
    assert all(alike(docs[0][1], docs[k][1]) >= 0.8 for k in range(1, 121)) and alike(docs[1][1], docs[2][1]) < 0.7
    groups = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(groups[i] == i // 1000 * 1000 for i, _ in docs)


def test_near_duplicates_links_nothing_below_the_resemblance(spark):
    rng = random.Random(6)
    docs = []
    for k in range(200):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        copy = list(base)
        n = rng.randrange(6, 22)
        copy[:n] = [f"n{rng.randrange(10**6)}" for _ in range(n)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    groups = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    wanted = [alike(docs[2 * k][1], docs[2 * k + 1][1]) >= 0.8 for k in range(200)]
    assert 0 < sum(wanted) < 150 and sum(0.65 < alike(docs[2 * k][1], docs[2 * k + 1][1]) < 0.8 for k in range(200)) > 50
    assert [groups[2 * k] == groups[2 * k + 1] for k in range(200)] == wanted


def test_near_duplicates_come_from_fingerprints(spark, monkeypatch):
    """Without any bands, linked fingerprints alone lead to all near duplicates among their texts, and to nothing else."""
    monkeypatch.setattr(simhash, "sketch", lambda shingles, f=simhash.sketch: ([], f(shingles)[1]))
    rng = random.Random(9)
    docs = []
    for k in range(30):  # one word of many is another one
        base = [f"k{k}w{i}" for i in range(400)]
        docs += [(10 * k, " ".join(base)), (10 * k + 1, " ".join([*base[:-1], "changed"]))]
    for k in range(6):  # the repeated head alone decides the fingerprint of these; their tails, in threes, the resemblance
        tail = [f"t{k}x{i}" for i in range(100)]
        docs += [(1000 + 10 * k + j, " ".join(["one", "two", "three"] * 200 + tail + [f"end{j}"])) for j in range(3)]
    docs += [(2000 + k, " ".join(f"r{rng.randrange(10**6)}" for _ in range(100))) for k in range(20)]
    prints = {i: simhash.fingerprint(t.encode()) % 2**64 for i, t in docs}
    linked = brute_components(prints)
    assert len({linked[i] for i in prints if 1000 <= i < 2000}) == 1 and sum(linked[10 * k] == linked[10 * k + 1] for k in range(30)) > 10
    groups = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert groups == {i: min(j for j, u in docs if linked[i] == linked[j] and alike(t, u) >= 0.8) for i, t in docs}


def test_deduplicate_keeps_unlike_texts_of_one_id(spark):
    one, two, three, four = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    rows = [(None, one), (None, two), (None, two), (1, three), (7, three), (7, four), (7, four), (None, three), (2, "")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, one), (None, two), (1, three), (7, four), (2, "")], key=str)


def test_html_extraction(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies on this site.</div>
    <article><header><h1>The  head</h1></header><p>First &amp; best<br>para&shy;graph.</p><ul><li>one thing</li></ul><aside>Related: <a>more</a></aside>
    <form>Name <input></form><div class="ad">Buy now</div><p>Short.</p><script>var a="</p>";</script></article>
    <section id="comments"><p>I think this is great.</p></section><footer>&copy; all</footer></body></html>"""
    assert html_extract.main_text(page, html_extract.train()) == "The head\n\nFirst & best para\xadgraph.\n\none thing\n\nShort."
    tree = html_extract.train()
    text = lambda x: html_extract.main_text(x, tree)
    assert text("<article><p><a>Linked paragraph of main text as a whole sentence</a></p></article>") == "Linked paragraph of main text as a whole sentence"
    assert text("<article><h1>T</h1><p>Some words here that go on.</p><p>See all the links</p></article>").endswith("See all the links")
    assert text("<article><p class='notice-text'>This is a text of the article that goes on.</p><p class='search'>We search for meaning in this article.</p></article>").count("article") == 2
    assert text("<article><p>The main text goes on here and on.</p></article><div>Copyright 2024 acme</div>") == "The main text goes on here and on."
    body = " ".join(f"word{i}" for i in range(60)) + "."
    plain = f"<body><div><a href=/>Home</a> <a href=/n>News</a></div><div><h1>A title of it</h1><p>{body}</p><p>{body}</p></div><div class=sidebar><p>{body}</p></div></body>"
    assert text(plain) == f"A title of it\n\n{body}\n\n{body}"
    parts = [html_extract.blocks(p) for p in html_extract.labelled_pages()]
    wrong = sum(int((tree.predict(x) != y).sum()) for _, x, y in parts)
    assert wrong <= 0.01 * sum(len(y) for _, _, y in parts)
    right = total = 0
    for r, got in zip(table(spark, "pages").orderBy("page_id").collect(), html_extract.extract(table(spark, "pages")).orderBy("page_id").collect(), strict=True):
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1].replace("<br>", " ")
        want = "\n\n".join(b for b in (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)) if b)
        total, right = total + 1, right + (want == got["text"])
    assert right == total


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, "documents", sf), table(spark, "labels", sf)
    rows = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def brute_anchors(text):
    """Closed syncmers by their definition, with the hashes computed one by one."""
    m = 2**64

    def h(part):
        v = 0
        for c in part:
            v = (v * syncmer._BASE + ord(c) + 1) % m
        v = ((v ^ (v >> 33)) * 0xFF51AFD7ED558CCD) % m
        return v ^ (v >> 29)

    out = []
    for i in range(len(text) - syncmer.K + 1):
        inner = [h(text[i + j : i + j + syncmer.S]) for j in range(syncmer.K - syncmer.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, h(text[i : i + syncmer.K]) >> 32))
    return out


def brute_likeness(a, b):
    """Occurrences of a hash paired in order, and the longest chain by dynamic programming."""
    if not a or not b:
        return float(not a and not b)

    def keyed(x):
        seen, out = collections.Counter(), {}
        for k, (_, h) in enumerate(x):
            out[(h, seen[h])] = k
            seen[h] += 1
        return out

    ka, kb = keyed(a), keyed(b)
    pairs = sorted((ka[k], kb[k]) for k in ka.keys() & kb.keys())
    best = []
    for i, (_, q) in enumerate(pairs):
        best.append(1 + max((best[j] for j in range(i) if pairs[j][1] < q), default=0))
    return max(best, default=0) / (len(a) + len(b) - len(pairs))


def test_syncmer_fingerprints_by_definition():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab c\u00e9\U0001f600") for _ in range(n)) for n in (0, 1, 23, 24, 25, 60, 200)] + ["a" * 90, "abc" * 40, "the quick brown fox jumps over the lazy dog and runs away " * 3]
    prints = []
    for t in texts:
        want = brute_anchors(t)
        spots, hashes = syncmer.fingerprint(t)
        if want:
            assert list(zip(spots.tolist(), hashes.tolist())) == want
            assert max(np.diff(spots), default=0) <= syncmer.K - syncmer.S
        else:
            assert len(spots) == (1 if t else 0)
        prints.append(list(zip(spots.tolist(), hashes.tolist())))
        back = [(t2[:4], t2[4:]) for t2 in re.findall(".{12}", syncmer.written((spots, hashes)))]
        assert np.cumsum([int(d, 16) for d, _ in back]).tolist() == spots.tolist() and [int(x, 16) for _, x in back] == hashes.tolist()
    for a, x in zip(prints, texts):
        for b, y in zip(prints, texts):
            assert syncmer.likeness(syncmer.fingerprint(x), syncmer.fingerprint(y)) == pytest.approx(brute_likeness(a, b))
    swapped = "one passage that is long enough to hold anchors of its own ", "and another one that holds some of its own, too, as it is long "
    assert syncmer.likeness(syncmer.fingerprint(swapped[0] + swapped[1]), syncmer.fingerprint(swapped[1] + swapped[0])) < 0.7
    # anchors don't depend on what stands around them
    inner = "the quick brown fox jumps over the lazy dog and runs away"
    a, b = (set(syncmer.anchors(t)[1].tolist()) for t in (inner, "some other words " + inner + " and an end"))
    assert a <= b


def test_syncmers(spark, monkeypatch):
    """Every document with its next, whichever stretches they are in; ids that repeat, null and very large ids."""
    monkeypatch.setattr(syncmer, "STRETCH_BYTES", 9_000)
    some = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()]
    some += [(None, f"without an id {k} " * 9) for k in range(40)] + [(7, f"one id for many texts {k} " * 9) for k in range(60)] + [(2**60 + k, f"large {k}") for k in range(5)] + [(-5, None), (-5, "")]
    same = [(7, "repeated whole row, as often as it is")] * 3
    rows = syncmer.compare_with_next(spark.createDataFrame(some + same, "doc_id long, text string")).collect()
    ties = {r["text"]: r["t"] for r in spark.createDataFrame([(t or "",) for _, t in some + same], "text string").select("text", F.xxhash64("text").alias("t")).distinct().collect()}
    order = sorted(((i is not None, i or 0, ties[t or ""], t or "", i) for i, t in some + same), reverse=True)
    want = []
    for k, (_, _, _, x, i) in enumerate(order):
        y = order[(k + 1) % len(order)][3]
        new = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        p, q, r = (syncmer.fingerprint(t) for t in (x, new, y))
        want.append((i, len(x), hashlib.sha256(new.encode()).hexdigest(), syncmer.written(p), syncmer.written(q), syncmer.likeness(p, q), syncmer.likeness(p, r)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows)


def test_suffix_automaton_matches_windows():
    rng = random.Random(2)
    for _ in range(60):
        items = [(k, [rng.choice("abc").encode() for _ in range(rng.randrange(0, 9))]) for k in range(4)]
        text = [rng.choice("abcd").encode() for _ in range(60)]
        model = decontam.SuffixAutomaton(items, window=4)
        hit, found = set(), set()
        for k, item in items:
            n = min(4, len(item))
            for i in range(len(item) - n + 1 if n else 0):
                for at in range(len(text) - n + 1):
                    if text[at : at + n] == item[i : i + n]:
                        hit |= set(range(at, at + n))
                        found.add(str(k))
        spans, names = model.match(text)
        assert {p for a, b in spans for p in range(a, b)} == hit and names == found


def test_decontamination(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(con.execute(decontam.SQL).fetchall())
    assert sorted(tuple(r) for r in decontam.report(table(spark, "documents"), table(spark, "benchmark")).collect()) == want
    item = "One two three four five six seven eight nine ten eleven."
    model = decontam.SuffixAutomaton([(1, decontam.words(item.encode()))])
    filler = " ".join(f"x{i}" for i in range(30))
    assert decontam.clean(f"{filler} — {item} {filler}", model) == f"{filler} — . {filler}"
    assert decontam.clean(item, model) is None and decontam.clean(filler, model) == filler


def test_decontamination_in_parts(spark, monkeypatch):
    """A benchmark beyond one automaton, an item among it that is longer than a part, gives the same as a whole one."""
    docs, items = table(spark, "documents").limit(150).cache(), [tuple(r) for r in table(spark, "benchmark").select("item_id", "text").collect()]
    text = next(r["text"] for r in docs.collect() if r["text"] and len(r["text"].split()) > 120)
    bench = spark.createDataFrame([*items, (10_001, "\n".join(text.split()[:90])), (10_002, " ".join(text.split()[84:100])), (10_003, None)], "item_id long, text string")
    results = []
    for most in (1_000_000, 60):
        monkeypatch.setattr(decontam, "MAX_ITEM_WORDS", most)
        results.append([sorted(map(tuple, f(docs, bench).collect()), key=str) for f in (decontam.report, decontam.decontaminate)])
    assert all(sum(len(w) for _, w in p) <= 60 for p in decontam.parts(bench)) and len(list(decontam.parts(bench))) > 3
    assert results[0] == results[1] and any(r[5] for r in results[0][0])


def test_mixing(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(tuple(r) for r in mixing.mix_report(table(spark, "documents")).collect()) == sorted(con.execute(mixing.SQL).fetchall())
    rng = random.Random(4)
    sizes = [(f"s{k}", rng.randrange(0, 1000)) for k in range(7)] + [(None, 50)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    order = sorted((s for s, _ in sizes if s is not None)) + [None]
    weights, size = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, dict(sizes)
    open_, left, want = set(order), 1.5 * sum(size.values()), {}
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 2 * size[s]}
        if not over:
            want |= {s: level * weights[s] for s in open_}
            break
        for s in over:
            want[s] = 2 * size[s]
            left -= want[s]
        open_ -= over
    assert got == pytest.approx(want)


def brute_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        d = [int(c) for c in digits(s)][::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(v)), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def test_pii_base_spans(spark):
    rng = random.Random(6)
    pieces = ["a.b@c.d", "x@y", "@", ".", "_", "1.2.3.4", "1.2.3.256", "001.0.0.9", "4111 1111 1111 1111", "4111111111111111", "4111-1111", " ", "é😀", "+1 (234) 555-7777", "+", "12", "-", "\n", "foo%bar@baz-q.org.uk", "5.6.7.8.9.10.11.12"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(300)] + ["1" * 20000, "a" * 20000 + "@", "a@b.c " * 700]
    rows = pii.spans_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_pii(texts[r["doc_id"]])
        assert [s for s in r["spans"].split(",") if s and not s.startswith("term")] == want, texts[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()


def brute_terms(texts):
    """Of each text its "term" spans, by the definition in the module's docstring."""
    import regex

    term, end = regex.compile(pii.TERM), re.compile(r"[.!?](?=[ \t\n\x0b\f\r])|\n")
    low = lambda t: t.lower()
    occurrences, entities, sentences = collections.Counter(), collections.Counter(), []
    for k, text in enumerate(texts):
        occurrences.update(m[0] for m in term.finditer(low(text)))
        for span in brute_pii(text):
            kind, s, e = span.split(":")
            s, e = int(s), int(e)
            entity = kind + ":" + low(text[s:e])
            entities[entity] += 1
            before, after = text[max(0, s - pii.REACH) : s], text[e : e + pii.REACH]
            parts = end.split(before)
            b = re.sub(r"^[^ \t\n\x0b\f\r]*", "", parts[-1]) if s > pii.REACH and len(parts) == 1 else parts[-1]
            parts = end.split(after)
            a = re.sub(r"[^ \t\n\x0b\f\r]*$", "", parts[0]) if len(after) == pii.REACH and len(parts) == 1 else parts[0]
            around = low(b + " \n " + a)
            sentences.append((k, entity, around, {m[0] for m in term.finditer(around)}))
    net, different = collections.Counter(), collections.defaultdict(set)
    for _, entity, around, found in sentences:
        for t in found:
            net[entity, t] += 1
            different[entity, t].add(around)
    total = sum(occurrences.values())
    out = [set() for _ in texts]
    for k, entity, _, found in sentences:
        bits = -np.log2(min(1, entities[entity] / total))
        for t in found:
            d = len(different[entity, t])
            if bits > 0 and np.log2(min(1, net[entity, t] / occurrences[t]) * d / (d + 1)) + bits >= pii.SHARE * bits:
                out[k].add(t)
    return [[(m.start(), m.end()) for m in term.finditer(text) if low(m[0]) in found] for text, found in zip(texts, out)]


def test_pii_terms_by_brute_force(spark):
    """On the test table: terms there are, and just those of the definition; texts without base spans have none."""
    rows = [(r["doc_id"], r["text"] or "") for r in table(spark, "documents", "/root/testdata/sf0.01").collect()]
    rows += [(10**6 + k, f"On day {k} Zebulon Quaggle wrote to zeb@corp.example again. Others wrote nothing.\nNobody knows Quaggle.") for k in range(4)] + [(10**7, ""), (10**7, rows[0][1])]
    want = brute_terms([t for _, t in rows])
    got = collections.Counter()
    for r in pii.spans_report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans = [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("term")]
        got[r["doc_id"], tuple(spans)] += 1
        assert not spans or r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]
    assert got == collections.Counter((i, tuple(x)) for (i, _), x in zip(rows, want))
    assert sum(len(x) for x in want[: -6]) > 20
    assert ["Zebulon", "Quaggle", "Quaggle"] == [rows[-6][1][s:e] for s, e in want[-6] if rows[-6][1][s:e][0] in "ZQ"]


def test_pii_sanitize(spark):
    rng = random.Random(8)
    common = "they met and spoke about many things today while others waited outside".split()
    rows = [(i, f"{rng.choice(common)} {rng.choice(common)} Zebulon wrote to zeb@corp.example from {rng.choice(common)} number{i}x") for i in range(12)]
    rows += [(100 + i, " ".join(rng.choice(common + ["wrote", "from"]) for _ in range(40))) for i in range(60)] + [(200, None), (None, ""), (100, rows[0][1]), (100, rows[0][1])]
    clean = pii.sanitize(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, h string")).collect()
    texts = collections.defaultdict(list)
    for r in clean:
        texts[r["doc_id"]].append(r["text"])
    assert len(clean) == len(rows) and "[TERM] wrote to [EMAIL] from" in texts[0][0] and texts[101] == [rows[13][1]]
    assert sum("[TERM] wrote to [EMAIL]" in t for t in texts[100]) == 2 and texts[200] == texts[None] == [""]
    assert pii.sanitize(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_queries_are_registered():
    found = queries.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in found) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(found)
