"""Top-k search, URL verdicts, license scans and shards against brute force."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import texts_of
from pyspark.sql import functions as F

from autolens.llm import licenses, sharding, topk, url_filter
from autolens.llm.oracles import ORACLES
from autolens.llm.queries import QUERIES
from tools.check import compare, connect


# -- top-k ---------------------------------------------------------------------------


def brute_topk(rows, k):
    """rows: (vec_id, integer vector); distinct rows, as the operator counts them."""
    rows = list(dict.fromkeys((i, tuple(v)) for i, v in rows))
    best = {}
    for q, v in rows:
        if q % 3:
            continue
        found = best.setdefault(q, set())
        found |= {(sum(a * b for a, b in zip(v, w, strict=True)), -i) for i, w in rows if i != q and len(w) == len(v)}
    return sorted(
        (q, r, -i, s) for q, found in best.items() for r, (s, i) in enumerate(sorted(found, reverse=True)[:k], 1)
    )


def as_rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("shard_rows", [7, 40, 4096])
def test_topk_random(spark, shard_rows):
    rng = random.Random(shard_rows)
    rows = [(i, [rng.choice((-1.0, -0.25, 0.0, 0.1, 0.5, 3.7)) for _ in range(4)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x"))
    want = brute_topk([(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, v in rows], 5)
    assert as_rows(topk.top_k(df, F.col("vec_id") % 3 == 0, 5, shard_rows=shard_rows)) == want


def test_topk_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]),
        (6, [1.0, 2.0]), (7, []), (8, [1.0]), (9, [0.0, -1.0]), (9, [2.0, 2.0]), (None, [9.0, 9.0]), (10, [-inf, 0.0]), (12, []),
        (15, [2.0**30, 1.0]), (16, [2.0**9, 2.0**9]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    good = [
        (i, np.floor(1024 * np.array(v)).astype(np.int64).tolist()) for i, v in rows
        if i is not None and v is not None and None not in v and np.isfinite(v).all()
    ]
    for shard_rows in (2, 4096):
        assert as_rows(topk.top_k(df, F.col("vec_id") % 3 == 0, 3, shard_rows=shard_rows)) == brute_topk(good, 3)


def test_topk_copies_of_one_vector(spark):
    rows = [(i, [0.5, 0.5, 0.25]) for i in range(400)] + [(1000 + i, [0.1 * i, 0.5, 0.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    good = [(i, np.floor(1024 * np.array(v)).astype(int).tolist()) for i, v in rows]
    assert as_rows(topk.top_k(df, F.col("vec_id") % 3 == 0, 4, shard_rows=50)) == brute_topk(good, 4)


def test_topk_no_rows(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 3 == 0).count() == 0


def test_tree_opens_few_nodes_on_clusters():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 8)) * 5000
    points = (centres[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 8)) * 10).astype(np.int64)
    tree = topk.KDTree(np.arange(4000), points)
    opened = 0

    class Counted:
        def __getitem__(self, rows):
            nonlocal opened
            opened += 1
            return points_in_order[rows]

    points_in_order, query = tree.points, points[17]
    want = sorted(((int(s), -i) for i, s in enumerate(points @ query) if i != 17), reverse=True)[:10]
    tree.points = Counted()
    got = tree.search(query, 17, tree.bounds(query[None])[0], 10, None)
    assert got == [(s, -i) for s, i in want]
    assert opened < len(tree.spans) // 6


# -- URLs ----------------------------------------------------------------------------


def brute_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def brute_rule(host, path):
    fits = [
        (len(h + p), h + p, verdict) for verdict, h, p in url_filter.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits, default=None)


def brute_score(host, path, weights, intercept, bucket_of):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in path)
    found = {
        bucket_of(t[i : i + n], mark) for mark, t in ((0, f"^{host}$"), (1, lowered)) for n in url_filter.GRAMS
        for i in range(len(t) - n + 1)
    }
    total = sum(weights[b] for b in found) / max(1, len(found)) ** 0.5 + intercept
    return 1 / (1 + np.exp(-total))


def xxh(spark, pairs):
    rows = spark.createDataFrame(pairs, "t string, m int").select(
        "t", "m", F.pmod(F.xxhash64("t", "m"), F.lit(url_filter.BUCKETS)).alias("b")
    )
    return {(r["t"], r["m"]): r["b"] for r in rows.collect()}


URLS = [
    "http://A.Example.NET/en/1?x=/de/", "https://example.net/EN/", "http://x.net", "http://net/a", "http://notnet/", "http://y.org/fr/",
    "http://y.org/fr", "ftp://www.example.com/de/9#t", "http://example.com.evil.test/de/", None, "", "no scheme", "://", "http:///path",
    "http://h?q", "http://h#f/en/", "a://b://c/d", "http://é.org/fr/ü", "http://x.org/\nfr/", "http://casino-win.org/" + "x" * 5000,
    "http://spam-links.example/buy-now", "http://library.example/books",
]


def test_url_verdicts_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (0, URLS[0])], "page_id bigint, url string")
    pages = pages.withColumn("host", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("found", F.lit(2))
    weights, intercept = url_filter.train(url_filter.labelled(spark))
    got = url_filter.verdicts(pages).collect()
    assert len(got) == len(URLS) + 2
    parts = {(t[i : i + n], mark) for u in URLS for mark, t in zip((0, 1), (f"^{brute_parts(u)[0]}$", brute_parts(u)[1].lower()), strict=True)
             for n in url_filter.GRAMS for i in range(len(t) - n + 1)}
    buckets = xxh(spark, sorted(parts))
    for r in got:
        url = URLS[r["page_id"] or 0]
        host, path = brute_parts(url)
        rule = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule[1] if rule else None)
        score = brute_score(host, path, weights, intercept, lambda t, m: buckets.get((t, m)) if (t, m) in buckets else 0)
        if path.isascii():
            assert abs(r["score"] - score) < 1e-9
            assert r["verdict"] == (rule[2] if rule else "block" if score >= 0.5 else "allow")


def test_url_model_tells_unseen_hosts_apart(spark):
    bad = ["http://mega-casino.example.org/en/1", "http://cheap-pills-shop.example.com/x", "http://spam-farm.example.org/y"]
    good = ["http://www.tionther.example.org/en/1", "http://blog.thering.example.com/fr/4", "http://library-news.example.org/9"]
    got = url_filter.verdicts(spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "page_id bigint, url string"))
    assert [r["verdict"] for r in got.orderBy("page_id").collect()] == ["block"] * 3 + ["allow"] * 3


def test_url_model_on_labelled_hosts_held_out(spark):
    rows = url_filter.label_rows()
    assert len({url.split("/")[2] for url, _ in rows}) == len(rows)

    def held(url):
        return zlib.crc32(url.split("/")[2].encode()) % 5 == 0

    kind = "url string, blocked double"
    weights, intercept = url_filter.train(spark.createDataFrame([r for r in rows if not held(r[0])], kind))
    host, path = url_filter.host_and_path(F.col("url"))
    got = spark.createDataFrame([r for r in rows if held(r[0])], kind).select(
        "blocked", (url_filter.score(host, path, weights, intercept) >= 0.5).alias("found")
    ).collect()
    bad, good = [r["found"] for r in got if r["blocked"]], [r["found"] for r in got if not r["blocked"]]
    assert len(bad) > 60 and sum(bad) >= 0.9 * len(bad)
    assert len(good) > 60 and sum(good) <= 0.1 * len(good)


def test_url_labels_hold_no_host_of_the_pages_and_the_model_finds_theirs(spark, folder):
    pages = [(r["host"], r["verdict"]) for r in QUERIES["op4_url_filter"](spark, folder).where("rule is null").collect()]
    names = {name for url, _ in url_filter.label_rows() for name in [url.split("/")[2].rsplit(".", 1)[0]]}
    assert not any(host.startswith(name + ".") for host, _ in pages for name in names)
    planted = [v == "block" for h, v in pages if "-" in h]  # the unwanted hosts of the pages have a hyphen
    others = [v == "block" for h, v in pages if "-" not in h]
    assert sum(planted) >= 0.9 * len(planted) and sum(others) <= 0.03 * len(others)


def test_url_no_rows_and_no_python(spark, folder):
    assert url_filter.verdicts(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    for name in ("op4_url_filter", "op8_exact_dedup"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_longest_rule_wins_and_first_of_equals(spark):
    rules = [("allow", "a.test", "/x/"), ("block", "a.test", "/"), ("block", "a.test", "/x/")]
    host, path = F.lit("s.a.test"), F.lit("/x/1")
    row = spark.range(1).select(url_filter.rule_struct(rules, host, path).alias("r")).first()["r"]
    assert (row["rule"], row["verdict"]) == ("a.test/x/", "allow")


# -- licenses ------------------------------------------------------------------------


def brute_lis(places):
    best = [1] * len(places)
    for i in range(len(places)):
        for j in range(i):
            if places[j] < places[i]:
                best[i] = max(best[i], best[j] + 1)
    return max(best, default=0)


def test_longest_increasing_matches_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        places = rng.sample(range(50), rng.randint(0, 12))
        kept = licenses.longest_increasing(places)
        assert len(kept) == brute_lis(places)
        assert [places[i] for i in kept] == sorted(places[i] for i in kept)


def test_alignment_pairs_rise_and_match():
    assert licenses.align([], []) == licenses.align(["a"], []) == []
    rng = random.Random(7)
    for _ in range(300):
        b = [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 25))]
        a = [w for w in b if rng.random() < 0.9] + [rng.choice("xyz") for _ in range(rng.randint(0, 3))]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[k] for i, k in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))
    words = [f"w{i}" for i in range(40)]
    assert len(licenses.align(words[:10] + ["x"] + words[12:], words)) == 38


def test_license_scan_of_planted_passages(spark, no_docs):
    rng = random.Random(8)
    noise = [f"wa{i}" for i in range(400)]
    rows, want = [], []
    for i in range(120):
        words = [rng.choice(noise) for _ in range(rng.randint(0, 100))]
        for t in rng.sample(range(len(licenses.WORDS)), rng.randint(0, 2)):
            passage = list(licenses.WORDS[t][1])
            if len(passage) > 12:  # a tenth of the words changed
                for j in rng.sample(range(len(passage)), len(passage) // 12):
                    passage[j] = "changed"
            words += [*passage, *(rng.choice(noise) for _ in range(rng.randint(1, 100)))]
            want.append((i, licenses.WORDS[t][0]))
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (None, "Released under the MIT License."), (502, "license " * 3000), (503, "Released under the MIT License. " * 40)]
    want += [(None, "MIT")] + [(503, "MIT")] * 40
    got = licenses.license_passages(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("license", F.lit("x"))).collect()
    assert sorted(map(str, ((r["doc_id"], r["license"]) for r in got))) == sorted(map(str, want))
    assert all(0.8 <= r["coverage"] <= 1 and r["n_words"] > 0 for r in got)
    assert licenses.license_passages(no_docs).count() == 0


def test_each_notice_is_found_as_its_own_license():
    for name, template in licenses.WORDS:
        words = ["before", *template, "behind"]
        seeds = [(p, w) for p, w in enumerate(words) if w in licenses.SEEDS]
        assert licenses.settled(licenses.passages(seeds, words)) == [(name, 1.0, 1, len(template))]


def test_of_kindred_licenses_the_longer_or_closer_is_kept():
    isc = next(t for n, t in licenses.WORDS if n == "ISC")
    words = [*isc[:-2], "every", "copy"]
    seeds = [(p, w) for p, w in enumerate(words) if w in licenses.SEEDS]
    assert {n for n, *_ in licenses.scan("", seeds, words)} == {"ISC", "0BSD"}
    assert [n for n, *_ in licenses.settled(licenses.passages(seeds, words))] == ["ISC"]
    apart = [("B", 0.8, 6, 10, 8), ("C", 1.0, 6, 9, 9), ("A", 0.9, 0, 11, 10)]
    assert licenses.settled(apart) == [("A", 0.9, 0, 11), ("B", 0.8, 6, 10)]  # five of nine words are shared, five of ten
    assert licenses.settled([*apart[:2], ("A", 0.9, 0, 10, 10)]) == [("A", 0.9, 0, 10), ("C", 1.0, 6, 9)]


def test_license_templates_are_an_argument(spark):
    own = {"House": ["These pages may be copied by members of the house during the summer months"]}
    rows = [(1, "x these pages may be copied by members of the house during the summer y"), (2, "Released under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [(r["doc_id"], r["license"]) for r in licenses.license_passages(docs, templates=own).collect()] == [(1, "House")]
    for wrong in ({"A": ["of the"]}, {"A": ["x" * (licenses.MAX_TEMPLATE_CHARS + 1)]}):
        with pytest.raises(ValueError, match="template"):
            licenses.license_passages(docs, templates=wrong)


def test_license_query_finds_all_lines(spark, folder):
    lines = {"Released under the MIT License": "MIT", "Licensed under CC BY-NC": "CC-BY-NC", "GNU General Public License": "GPL", "Apache License, Version": "Apache"}
    want = sorted((d, name) for d, t in texts_of(folder).items() for line, name in lines.items() for _ in range((t or "").count(line)))
    assert sorted((r["doc_id"], r["license"]) for r in QUERIES["op6_licenses"](spark, folder).collect()) == want


# -- shards --------------------------------------------------------------------------


def check_shards(report, texts):
    assert sorted(str(r["doc_id"]) for r in report) == sorted(str(d) for d, _ in texts)
    by = {}
    for r in report:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    sizes = [len(by.get(s, [])) for s in range(sharding.SHARDS)]
    assert max(sizes) - min(sizes) <= 1
    want = sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in report) == want


def test_shards_odd_rows(odd_docs, no_docs):
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check_shards(sharding.shard_report(odd_docs).collect(), texts)
    assert sharding.shard_report(no_docs).count() == 0


def test_shards_query_and_repeatability(spark, folder):
    texts = list(texts_of(folder).items())
    first = QUERIES["op10_sharding"](spark, folder).collect()
    check_shards(first, texts)
    again = QUERIES["op10_sharding"](spark, folder).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_copies_and_small_buckets(spark):
    docs = spark.createDataFrame([(1, "copy")] * 900 + [(i, f"text {i}") for i in range(600)], "doc_id bigint, text string")
    rows, n = sharding.shuffled(docs, bucket_bytes=600)
    assert n == 1500
    places = sorted(r["place"] for r in rows.collect())
    assert places == list(range(1500))


def test_permutations_are_uniform():
    seen = {}
    for s in range(6000):
        p = tuple(sharding.permutation(3, s, 1).tolist())
        seen[p] = seen.get(p, 0) + 1
    assert len(seen) == 6 and min(seen.values()) > 850
    assert sorted(sharding.permutation(1000, 1, 2).tolist()) == list(range(1000))
    assert len(sharding.permutation(0, 1, 2)) == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, folder, name):
    verdict, _ = compare(spark, connect(folder), folder, name)
    assert verdict.startswith("ok"), verdict
