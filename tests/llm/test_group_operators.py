"""Near-duplicates, components, url filter, sharding."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from sentiscope.llm import common, minhash, sharding, url_filter
from sentiscope.llm.components import connected_components


# --- components ---------------------------------------------------------------------

def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)],  # a chain
    [(50, i) for i in range(40)] + [(100, 101), (102, 101)],  # a star
    [(random.Random(i).randint(0, 80), random.Random(-i).randint(0, 80)) for i in range(1, 70)],
    [],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges + [(None, 3), (7, None), (9, 9)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == roots({x for e in real for x in e}, real)


# --- near-duplicates -------------------------------------------------------------------

def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    n = min(5, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_components(rows, num, den):
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    top = roots(range(len(rows)), pairs)
    least = {}
    for i, r in top.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return Counter((rows[i][0], len(sets[i]), least.get(top[i]), rows[i][0] == least.get(top[i])) for i in range(len(rows)))


def family(rnd, start, n, words, edits):
    """A text and copies of it, each with some words replaced."""
    base = [f"t{rnd.randint(0, 10 ** 6)}" for _ in range(words)]
    out = [(start, " ".join(base))]
    for i in range(1, n):
        own = list(base)
        for _ in range(rnd.randint(0, edits)):
            own[rnd.randrange(words)] = f"e{rnd.randint(0, 10 ** 6)}"
        out.append((start + i, " ".join(own)))
    return out


def check(spark, rows, num, den):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.near_duplicates(df, num, den).collect()
    assert Counter(map(tuple, got)) == brute_components(rows, num, den)


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(11)
    rows = [(i, " ".join(rnd.choice(["the", "of", "and", "cat", "sat"]) for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    rows += family(rnd, 100, 70, 120, 6)  # one group larger than SMALL, similarities on both sides of the bound
    rows += family(rnd, 200, 6, 60, 2) + family(rnd, 300, 5, 40, 1) + [(400, None), (401, ""), (402, " \n")]
    rnd.shuffle(rows)
    check(spark, rows, 85, 100)


def test_large_buckets_in_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)  # on the driver: how many blocks a bucket is cut into
    rnd = random.Random(4)
    rows = family(rnd, 0, 90, 90, 5) + family(rnd, 500, 30, 90, 3)
    check(spark, rows, 80, 100)


def test_group_of_copies_on_both_sides_of_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 100)
    rnd = random.Random(7)
    base = [f"t{i}" for i in range(200)]

    def copy(edits):
        own = list(base)
        for at in rnd.sample(range(3, 197), edits):
            own[at] = f"e{rnd.randint(0, 10 ** 6)}"
        return " ".join(own)

    # two of 3 edits each share about 0.74, two of 1 edit about 0.91; 30 chains of neighbours across the main group
    rows = [(i, copy(3)) for i in range(500)] + [(1000 + i, copy(1)) for i in range(60)]
    check(spark, rows, 85, 100)


def test_intersections_are_exact(monkeypatch):
    rng = np.random.default_rng(0)
    for columns in (2048, 3):
        monkeypatch.setattr(minhash, "COLUMNS", columns)
        for _ in range(60):
            a, b = ([np.unique(rng.integers(0, rng.choice([20, 200, 5000]), rng.integers(1, 60))) for _ in range(rng.integers(1, 30))]
                    for _ in range(2))
            assert (minhash.intersections(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_near_duplicates_edge_rows(spark, edge_docs, edge_rows, no_docs):
    got = minhash.near_duplicates(edge_docs, 80, 100).collect()
    want = brute_components([(r[0], r[1]) for r in edge_rows], 80, 100)
    assert Counter((r[0], r[1], r[2], r[3]) for r in got if r[0] is not None) == Counter(
        {k: v for k, v in want.items() if k[0] is not None})
    assert minhash.near_duplicates(no_docs, 80, 100).count() == 0
    kept = minhash.drop_near_duplicates(edge_docs, 80, 100)
    assert kept.columns == edge_docs.columns
    rows = kept.collect()
    ids = Counter(r["doc_id"] for r in rows)
    assert {1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15, 16, 17} == set(ids) - {None} and max(ids.values()) == 1
    assert all(r["digest"] == "digest" and r["_g"] == "row" for r in rows)


def test_repeated_kept_rows_leave_one(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text)] * 4 + [(6, text), (8, "another text of six words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in minhash.drop_near_duplicates(df).collect()) == [5, 8]


def test_texts_under_one_id_are_judged_apart(spark):
    def text(name):
        return " ".join(f"{name}{i}" for i in range(30))

    rows = [(None, text(c)) for c in "abc"] + [(None, text("a")), (None, text("z")), (None, None), (None, "")]
    rows += [(1, text("z")), (2, text("d")), (2, text("e")), (2, text("z")), (2, text("d")), (3, text("e"))]
    rows += [(4, text("f") + " end"), (4, text("f")), (None, text("f"))]  # near copies under one id: one stays
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], (r["text"] or "")[:1]) for r in minhash.drop_near_duplicates(df).collect())
    assert got == Counter([(None, "a"), (None, "b"), (None, "c"), (None, ""), (None, ""), (1, "z"), (2, "d"), (2, "e"), (4, "f")])


def test_signature_estimates_similarity_and_is_circulant():
    rng = np.random.default_rng(1)
    ids = np.unique(rng.integers(0, 2 ** 63, 4000).astype(np.uint64))
    a, b = np.sort(ids[:3000]), np.sort(ids[500:3500])
    agree = (minhash.coordinates(a, 0, 2000) == minhash.coordinates(b, 0, 2000)).mean()
    assert abs(agree - 2500 / 3500) < 0.05
    assert (minhash.coordinates(a, 7, 50) == minhash.coordinates(a, 0, 57)[7:]).all()


# --- url filter -----------------------------------------------------------------------

def judged(spark, rows, **kw):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: (r["rule"], r["verdict"], r["why"]) for r in url_filter.judge_pages(df, **kw).collect()}


def test_rules_hosts_and_paths(spark):
    rows = [(1, "HTTP://A.Example.NET/en/1?q=1", None), (2, "http://example.net/de/", None), (3, "https://net/", None),
            (4, "http://x.net", None), (5, "http://internet/", None), (6, "http://example.com/de/5#x", ""),
            (7, "http://badexample.com/de/5", None), (8, "http://a.b.org/fr/", None), (9, None, None), (10, "no scheme", None),
            (11, "http://example.net?x=/en/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.judge_pages(df).collect()}
    want = {1: ("a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("example.net", "/de/", "net/", "block"),
            3: ("net", "/", "net/", "block"), 4: ("x.net", "", None, "allow"), 5: ("internet", "/", None, "allow"),
            6: ("example.com", "/de/5", "example.com/de/", "block"), 7: ("badexample.com", "/de/5", None, "allow"),
            8: ("a.b.org", "/fr/", "org/fr/", "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"),
            11: ("example.net", "", None, "allow")}
    assert {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()} == want


def test_blocks_travel_along_links_and_allow_wins(spark):
    def canonical(u):
        return f'<html><head><LINK href="{u}" rel="canonical"></head></html>'

    def refresh(u):
        return f"<meta http-equiv='refresh' content='0; url={u}'>"

    rows = [
        (1, "http://a.org/1", canonical("http://b.org/2")),  # 1 - 2 - 3 -> blocked host
        (2, "https://b.org/2/?utm_source=x", refresh("http://c.org/3")),
        (3, "http://c.org/3#top", canonical("//spam.net/x")),
        (4, "http://d.org/4", canonical("http://bad.net/y")),  # block and allow: allow wins
        (5, "http://e.org/5", canonical("http://d.org/4")),
        (6, "http://z.example.net/en/6", canonical("http://e.org/5")),
        (7, "http://f.org/7", "<link rel=stylesheet href='http://spam.net/style'>"),  # no canonical link
        (8, "http://g.org/8", canonical("/other")),
        (9, "http://g.org/other?b=2&a=1", None), (10, "http://g.org/other?a=1&b=2&ref=x", None),
        (11, "http://h.org/r", None), (12, "http://bad.net/z", canonical("http://h.org/keep")),
        (12, "http://bad.net/z", None),
    ]
    redirects = spark.createDataFrame([("http://h.org/r", "http://bad.net/q"), (None, "http://x.org/")], "src string, dst string")
    got = judged(spark, rows, redirects=redirects)
    assert got[1] == got[2] == got[3] == (None, "block", "alias")
    assert got[4] == got[5] == (None, "allow", "alias")
    assert got[6] == ("example.net/en/", "allow", "rule") and got[12] == ("net/", "block", "rule")
    assert got[7] == got[8] == got[9] == got[10] == (None, "allow", "default")
    assert got[11] == (None, "block", "alias")
    assert judged(spark, []) == {}


def test_page_relative_targets_carry_the_block(spark):
    base = "http://a.org/x/y/page?q=1#top"
    want = {"page2.html": "http://a.org/x/y/page2.html", "../de/z?k=../1": "http://a.org/x/de/z?k=../1",
            "./b": "http://a.org/x/y/b", "?id=3": "http://a.org/x/y/page?id=3", "../../../up/..": "http://a.org/",
            "..": "http://a.org/x/", "/r/./s/../t": "http://a.org/r/t", "#f": "http://a.org/x/y/page?q=1#f",
            "//b.org/1": "http://b.org/1", "http://c.org/../1": "http://c.org/../1", "mailto:a@b.org": None, "": None}
    df = spark.createDataFrame([(h, base) for h in want], "h string, b string")
    got = df.select("h", url_filter.absolute(url_filter.F.col("h"), url_filter.F.col("b")).alias("u")).collect()
    assert {r["h"]: r["u"] for r in got} == want
    link = "<link rel='canonical' href='{}'>".format
    rows = [(1, "http://example.com/x/1", link("../de/9")), (2, "http://h.org", "<meta http-equiv=refresh content='0; url=next.html'>"),
            (3, "http://h.org/next.html", link("http://spam.net/x")), (4, "http://h.org/l?id=1", link("?id=3")),
            (5, "http://h.org/l?id=3", link("http://spam.net/y"))]
    assert {k: v[1:] for k, v in judged(spark, rows).items()} == {k: ("block", "alias") for k in range(1, 6)}


# --- sharding -------------------------------------------------------------------------

def leaves_of(rows, limit, low):
    """Brute force: split the space from depth ``low`` until each bucket fits or has one hash."""
    out, todo = {}, [(low, p, [r for r in rows if r[0] >> (sharding.BITS - low) == p]) for p in range(1 << low)]
    while todo:
        depth, p, own = todo.pop()
        if not own:
            continue
        if sum(b for _, b in own) <= limit or len({h for h, _ in own}) == 1:
            out[depth, p] = len(own)
            continue
        for bit in (0, 1):
            todo.append((depth + 1, 2 * p + bit, [r for r in own if r[0] >> (sharding.BITS - depth - 1) & 1 == bit]))
    return out


def test_directory_splits_only_what_is_too_large(spark):
    rnd = random.Random(8)
    rows = [(rnd.getrandbits(sharding.BITS), rnd.randint(1, 40)) for _ in range(400)]
    rows += [((5 << (sharding.BITS - 3)) + rnd.getrandbits(30), 30) for _ in range(60)]  # long common prefix
    df = spark.createDataFrame(rows, "_sh_h long, _sh_b long")
    got = sharding.directory(df, 500).select("depth", "leaf").distinct().collect()
    total = sum(b for _, b in rows)
    low = max(0, int(np.ceil(np.log2(total / 500))) - 1)
    assert {(r["depth"], r["leaf"]) for r in got} == set(leaves_of(rows, 500, low))


def test_every_shard_fits(spark, edge_docs, edge_rows, no_docs):
    copies = spark.createDataFrame([(77, "the same row " * 3)] * 300 + [(i, "x" * (i % 50)) for i in range(200)],
                                   "doc_id long, text string")
    got = sharding.shard_report(copies, 1000).toPandas()
    sizes = got.groupby("shard").bytes.sum()
    assert len(got) == 500 and sizes.max() <= 1000 and not got.oversize.any()
    edge = sharding.shard_report(edge_docs, 50_000).toPandas()
    assert len(edge) == len(edge_rows)
    for _, g in edge.groupby("shard"):
        assert g.bytes.sum() <= 50_000 or (len(g) == 1 and g.oversize.all())
    assert sharding.shard_report(no_docs).count() == 0


def test_write_shards(spark, edge_docs, edge_rows, tmp_path):
    sharding.write_shards(edge_docs, str(tmp_path / "out"), 200_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(edge_rows) and "row" in back.columns


def test_cache_is_bounded_and_right():
    c = common.Cache(lambda k: k * 2, 4)
    for i in range(100):
        assert c[f"k{i % 11}"] == f"k{i % 11}" * 2 and len(c) <= 4
    assert c["x" * 100] == "x" * 200 and "x" * 100 not in c
