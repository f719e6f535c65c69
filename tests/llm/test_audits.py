"""URL filter, source divergence and filter interactions: against their SQL and against plain Python, on odd cases and the small tables."""

import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import divergence, filter_audit, url_filter
from seqloom.llm.oracle import ORACLE

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(params=["docs", "sample", "no_docs"])
def table(request):
    return request.getfixturevalue(request.param)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (3, 0, 1), (7, 1, 1), (8, 1, 0), (8, 0, 1), (9, None, 1), (None, 1, 1), (101, 1, 0), (103, 2, 1), (999, 1, 1)]
    odd = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    return odd.unionByName(spark.read.parquet(f"{SMALL}/labels.parquet")).withColumn("mask", F.lit("x")).withColumn("n", F.lit(None).cast("int"))


def against_sql(name, found, tmp_path, **tables):
    duck = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(str(tmp_path / t))
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}/*.parquet'")
    wanted = duck.sql(ORACLE[name])
    cols = sorted(wanted.columns)
    assert sorted(found.columns) == cols
    got = Counter(tuple(map(str, r)) for r in found.select(*cols).collect())
    assert got == Counter(tuple(map(str, r)) for r in wanted.select(", ".join(cols)).fetchall())
    return got


# 11 url filter

URLS = [
    None, "", "no scheme/fr/x", "http://", "://", "http:///fr/", "https://Example.NET/en/1", "https://a.b.EXAMPLE.net/en/", "http://example.net/en", "http://example.net/EN/x", "http://notexample.net/en/",
    "http://example.net", "http://example.net?x=/en/", "http://example.net#/en/", "http://x.org/fr/1", "http://org/fr/1", "http://x.org/de/1", "http://www.example.com/de/9?x", "http://example.com.au/de/",
    "http://user@example.com/de/", "http://example.com:8080/de/", "http://example.com./de/", "http://.net/", "http://a..net/x", "ftp://é.ÄÖ.net/ü", "http://a.net/x://b.org/fr/", "a://b://c.net/", "http://listed.example/a",
    "https://www.LISTED.example:443/a/?utm_source=x&ref=y#top", "http://u:p@listed.example/a?b=2&a=1", "http://listed.example/a/?a=1&utm_x=1&b=2", "http://listed.example/A", "http://listed.example/", "http://listed.example",
    "http://listed.example.net/q", "http://new\nline.net/\n", "http://" + "a." * 3000 + "net/" + "p" * 50_000,
]


@pytest.fixture(scope="module")
def pages(spark):
    notice = "<p>ALL rights Reserved.</p>"
    rows = [(k, u, "<p>text</p>") for k, u in enumerate(URLS)] + [(None, "http://x.net/", None), (3, "http://x.net/", ""), (3, "http://x.net/", "")]
    rows += [(900, "http://listed.example/a", notice), (901, "https://listed.example/a/?b=2&a=1&gclid=7", notice), (902, "nothing", notice), (903, None, notice), (904, "http://listed.example.net/q", notice)]
    rows += [(1000 + k, "http://hot.example.net/en/1" if k % 2 else f"http://h{k}.example.com/fr/{k}", "x") for k in range(300)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'c' AS host", "1 AS path", "2 AS keys", "3 AS uid", "4 AS key")


def judged(pages, **options):
    return url_filter.judge(pages, url_filter.rule_table(pages.sparkSession), url_filter.reserved(pages), **options)


@pytest.mark.parametrize("most_blocks", [url_filter.MOST_BLOCKS, 0])
def test_urls_same_as_sql(pages, tmp_path, most_blocks):
    got = against_sql("op11_url_filter", judged(pages, most_blocks=most_blocks), tmp_path, pages=pages.select("page_id", "url", "html"))
    assert sum(got.values()) == pages.count()


def test_small_pages_same_as_sql(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    against_sql("op11_url_filter", judged(pages), tmp_path, pages=pages)
    assert judged(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, url_filter.rule_table(spark).limit(0), url_filter.reserved(pages.limit(0))).collect()} == {"allow"}


def test_urls_against_plain_rules(pages):
    def plain(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best and best[0] + best[1], best and best[2]

    for r in judged(pages.select("page_id", "url", "html").filter("page_id is not null").withColumn("html", F.lit(""))).collect():
        if r["page_id"] < len(URLS) and r["page_id"] != 3:
            host, path, rule, verdict = plain(URLS[r["page_id"]])
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def test_canonical_forms_and_longest_rule(spark, pages):
    blocked = {r["page_id"] for r in judged(pages).collect() if r["rule"] is None and r["verdict"] == "block"}
    want = {k for k, u in enumerate(URLS) if u and "listed.example" in u.lower() and re.search(r"/a(/|\?|$)", u)}
    assert blocked == want | {900, 901}
    rules = spark.createDataFrame([("b.c", "/", "allow"), ("c", "/xyz", "block"), ("c", "/xyz", "allow"), ("c", "/xyzz", "block"), ("b.c", "/xyzz", "allow")], "host string, path string, verdict string")
    asked = spark.createDataFrame([(1, "h://a.b.c/xyz"), (2, "h://a.b.c/xyzz"), (3, "h://c/xyzz"), (4, "h://b.c/")], "page_id bigint, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(asked, rules, spark.createDataFrame([], "url string")).collect()}
    assert got == {1: ("c/xyz", "block"), 2: ("b.c/xyzz", "allow"), 3: ("c/xyzz", "block"), 4: ("b.c/", "allow")}


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(40_000).select(F.concat(F.lit("u k"), "id").alias("key"))
    bloom = url_filter.BlockedBloom(keys, 40_000)
    others = spark.range(40_000, 80_000).select(F.concat(F.lit("u k"), "id").alias("key"))
    assert bloom.possible(keys).count() == 40_000
    passed = bloom.possible(others)
    assert passed.count() < 400
    table = bloom.array()
    h = keys.unionByName(passed).select(F.xxhash64("key").alias("a"), F.xxhash64("key", F.lit(1)).alias("b")).toPandas()
    words = table[np.mod(h["a"].to_numpy(), len(table))]
    assert all(((words[:, k] >> ((h["b"].to_numpy() >> (6 * k)) & 63)) & 1).all() for k in range(url_filter.WORDS))
    assert table.shape == (-(-40_000 * 16 // 512), 8)


# 12 source divergence


def test_divergence_same_as_sql(table, tmp_path):
    against_sql("op12_source_divergence", divergence.audit(table), tmp_path, documents=table)


@pytest.mark.parametrize("least", [1, 3])
def test_divergence_against_fractions(docs, least):
    counts, found, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in docs.collect():
        lang, source = r["lang"] or "", r["source"] or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), r["text"] or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        found[lang].update(set(terms))
    want = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in found[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def price(c, kept=kept):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + int(Fraction(10**9 * (c[t] + 5), total)) for t in kept}

        p, q = {s: price(counts[lang, s]) for s in sources}, price(whole)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            over = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:50]
            for part, rows in (("pair", pairs), ("term", over)):
                want |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(rows, 1)}
    rows = divergence.audit(docs, least).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_long_texts_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 64)
    text = ("Ünï " + "word of " * 40).encode()
    assert Counter(t for s in divergence.slices(text.replace(b"W", b"w") * 3) for t in s) == Counter({"Ünï".encode(): 3, b"word": 120, b"of": 120})
    assert [t for s in divergence.slices(b"x" * 500) for t in s] == [b"x" * 500]


def test_totals_past_bigint_are_exact(spark):
    n, total, v = 3 * 10**13 + 7, 10**14 + 3, 12345
    got = spark.range(1).select(divergence._price(F.lit(n).cast("bigint"), F.lit(total).cast("bigint"), F.lit(v).cast("bigint"))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)


# 13 filter interactions


def test_interactions_same_as_sql(table, labels, tmp_path):
    got = against_sql("op13_filter_interactions", filter_audit.audit(table, labels), tmp_path, documents=table, labels=labels.select("doc_id", "quality", "toxic"))
    assert len(got) == 600 * len({r["source"] or "" for r in table.select("source").distinct().collect()})


def test_interactions_against_plain(docs, labels, monkeypatch):
    monkeypatch.setattr(filter_audit, "SLICE", 2)  # a bincount takes two parts
    monkeypatch.setattr(filter_audit, "HELD", 1)  # and arrays are handed out and summed
    known = defaultdict(set)
    for r in labels.collect():
        known[r["doc_id"]] |= {k for k in ("quality", "toxic") if r[k] == 1}
    del known[None]
    rows = docs.select("doc_id", "text", "source").collect()
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            least[r["text"] or ""] = min(least.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    each = []
    for r in rows:
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = r["doc_id"] is not None and r["doc_id"] > least[t]
        each.append((r["source"] or "", {f for f, x in fails.items() if x}, known.get(r["doc_id"], set())))
    want = Counter()
    for part in {p for p, _, _ in each}:
        own, shapley, out = [x[1:] for x in each if x[0] == part], Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                good, toxic = (sum(k in x[1] for x in gone) for k in ("quality", "toxic"))
                failing = sum(f in x[0] for x in own)
                out.append((part, order, step, f, len(left), len(gone), failing - len(gone), sum(x[0] == {f} for x in own), good, toxic))
        want.update((p, o, s, *rest, shapley[f]) for p, o, s, f, *rest in out)
    assert Counter(map(tuple, filter_audit.audit(docs, labels).collect())) == want


def test_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120)
    for m in range(32):
        for k, o in enumerate(filter_audit.orders_of("ABCDE")):
            assert table[m, k] == next((i for i, f in enumerate(o) if m >> "ABCDE".index(f) & 1), 5)


def test_copies_of_a_hot_text(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"), F.lit("s").alias("source"))
    got = {r["mask"]: r["n"] for r in filter_audit.masks(rows).groupBy("mask").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 1501, 17: 1499}
