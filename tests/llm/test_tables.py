"""Mixing, embeddings, URLs, components, pipeline."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cotravel.llm import embedding_dedup, graphs, hnsw, mixing, queries, shared, url_reputation


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components_leave_no_tables(spark):
    before = len(shared._staged)
    found = shared.connected_components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    assert len(shared._staged) == before + 1 and found.select("root").distinct().count() == 1
    shared.drop_staged(found)
    assert len(shared._staged) == before


def test_components_of_paths_stars_and_cliques(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + k) for k in range(1, 40)]
    clique = [(a, b) for a in range(2000, 2012) for b in range(2000, a)]
    edges = path + star + clique + [(5, 5), (1, 0)]
    got = {r.node: r.root for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find({x for e in edges for x in e}, edges)
    assert set(got) == set(want)
    for a in got:
        assert (got[a] == got[0]) == (want[a] == want[0]) and (got[a] == got[1000]) == (want[a] == want[1000])
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_spans():
    rng = np.random.default_rng(0)
    u, v = rng.integers(0, 200, 300), rng.integers(0, 200, 300)
    a, b = graphs.forest(u, v)
    assert len(a) < len(np.unique(np.r_[u, v]))
    assert union_find(range(200), zip(u.tolist(), v.tolist())) == union_find(range(200), zip(a.tolist(), b.tolist()))


def clusters(seed=1, n=60, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[:20, None, :] + rng.normal(size=(20, 12, dim)) * 0.08
    return np.concatenate([base, near.reshape(-1, dim), base[:5]])


def test_links_equal_brute_force(spark):
    x = clusters()
    odd = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [math.nan] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, [math.inf] * 16), (9006, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(i, v, 1) for i, v in odd], "vec_id long, embedding array<double>, kept int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, ef=8).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(u @ u.T >= 0.95)
    links = [(int(p), int(q)) for p, q in zip(a, b) if p != q]
    comp = union_find(range(len(x)), links)
    assert len(links) > 100
    for i in range(len(x)):
        assert got[i].n_links == sum(p == i for p, _ in links) and got[i].component_id == comp[i] and got[i].kept == (comp[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd)
    assert embedding_dedup.near_duplicates(df.filter("false")).count() == 0


def test_vectors_that_share_an_id_are_told_apart(spark):
    d = lambda a: [math.cos(math.radians(a)), math.sin(math.radians(a))]
    rows = [(5, d(0)), (5, d(90)), (100, d(5)), (20, d(86)), (101, d(95)), (5, d(0)), (None, d(180)), (None, d(183))]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        got = sorted(((r.vec_id or -1), r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
        assert got == [(-1, 1, None, True), (-1, 1, None, True), (5, 2, 5, True), (5, 2, 5, True), (5, 2, 5, True), (20, 2, 5, False), (100, 2, 5, False), (101, 2, 5, False)]


def dense(n, dim=16, seed=6):
    """A cluster whose members all link, besides small groups and singles."""
    rng = np.random.default_rng(seed)
    near = rng.normal(size=dim) * 10 + rng.normal(size=(n, dim)) * 0.3
    pairs = rng.normal(size=(60, dim))
    return np.concatenate([near, pairs, pairs + rng.normal(size=pairs.shape) * 0.02, rng.normal(size=(200, dim))])


def test_dense_cluster_and_small_groups(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD_BYTES", 1 << 18)
    x = dense(1500)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, ef=16).collect()}
    near = embedding_dedup.unit(x) @ embedding_dedup.unit(x).T >= 0.95
    comp = union_find(range(len(x)), np.argwhere(near).tolist())
    assert {i: got[i].n_links for i in got} == {i: int(near[i].sum()) - 1 for i in range(len(x))}
    assert {i: got[i].component_id for i in got} == comp


def test_a_dense_cluster_needs_little_memory():
    """All pairs of 4,096 queries with 30,000 vectors link; only counts and a forest are held."""
    import pickle
    import tracemalloc

    x = dense(30000, 8)
    pdf = {"raw": x.astype(np.float32), "graphs": [np.zeros((len(x), 32), np.int32)], "node": np.arange(len(x)), "m": np.ones(len(x), np.int64)}
    links = embedding_dedup.Links(pickle.dumps(pdf), 0.95)
    q = embedding_dedup.unit(x[:4096].astype(np.float32))
    tracemalloc.start()
    found = embedding_dedup.Found(len(q))
    links.brute(q, np.arange(len(q)), np.arange(len(q)), found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.links.min() > 29000 and peak < 400e6
    u, v = links.forest()
    assert len(u) < len(x) and len(set(union_find(range(30000), zip(u.tolist(), v.tolist())).values())) == 1


def test_rows_meet_in_few_lists_whatever_the_number_of_hubs(spark, monkeypatch):
    """Four times the rows have four times the hubs; a row is compared with as many others, links count once."""
    monkeypatch.setattr(embedding_dedup, "LIST_ROWS", 16)
    monkeypatch.setattr(embedding_dedup, "PART_ROWS", 100)
    met, build = [], embedding_dedup.compared
    monkeypatch.setattr(embedding_dedup, "compared", lambda linked, *args: met.append(linked) or build(linked, *args))
    rng = np.random.default_rng(8)
    for n in (400, 1600):
        base = rng.normal(size=(n, 32))
        x = np.concatenate([base, base[: n // 4] + rng.normal(size=(n // 4, 32)) * 0.15, base[0] + rng.normal(size=(150, 32)) * 0.1])
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        monkeypatch.setattr(embedding_dedup, "drop_staged", lambda *tables: None)
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
        near = embedding_dedup.unit(x) @ embedding_dedup.unit(x).T >= 0.95
        true, n_links = near.sum(axis=1) - 1, np.array([got[i].n_links for i in range(len(x))])
        comp = union_find(range(len(x)), np.argwhere(near).tolist())
        assert len(got) == len(x) and (n_links <= true).all() and (n_links[true > 0] / true[true > 0]).mean() >= 0.95
        assert all(comp[got[i].component_id] == comp[i] for i in got)
        held = [r.lists for r in met[-1].collect()]
        assert len({k for v in held for k in v}) > n / 32 and max(map(len, held)) <= 2 * embedding_dedup.LISTS


def test_index_recall():
    x = embedding_dedup.unit(np.random.default_rng(2).normal(size=(3000, 32))).astype(np.float32)
    ids, _ = hnsw.Index(x).search(x[:200], 64)
    best = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(np.intersect1d(i, b)) / 10 for i, b in zip(ids, best)]) > 0.9


def test_url_query_equals_oracle(spark, small):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    got = sorted(map(tuple, queries.op10_url_reputation(spark, small).select(*cols).collect()))
    assert got == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({url_reputation.ORACLE})").fetchall())


def test_url_parts_and_rules(spark):
    cases = {
        None: ("", "", None), "no scheme": ("", "", None), "": ("", "", None),
        "http://A.Example.COM/en/7x?q#f": ("a.example.com", "/en/7x", "example.com/en/7"),
        "http://com/en/": ("com", "/en/", "com/en/"), "x://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/"),
        "http://example.net/de/8": ("example.net", "/de/8", "example.net/de/8"), "http://é.ORG#/es/": ("é.org", "", None),
        "a://b.org/es/://c": ("b.org", "/es/://c", "org/es/"), "http://telecom/en/": ("telecom", "/en/", None), "://h?x://y": ("h", "", None),
    }
    pages = spark.createDataFrame([(i, u, "verdict") for i, u in enumerate(cases)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(0, 0, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_reputation.filter_urls(pages, labels).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_reputation.filter_urls(pages.filter("false"), labels).count() == 0


def test_url_rules_give_their_word(spark):
    """The contract's list: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/;
    labels that speak against a rule's word don't change it."""
    cases = {
        "http://a.com/en/6": "block", "http://a.example.com/en/6": "block", "http://a.example.com/en/71": "allow", "http://a.net/de/8": "allow", "http://net/de/": "allow",
        "http://a.example.net/de/7": "allow", "http://a.example.net/de/81": "block", "http://a.org/es/x": "block",
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(list(cases) * 20)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(v == "block"), 0) for i, v in enumerate(list(cases.values()) * 20)], "doc_id long, quality int, toxic int")
    got = url_reputation.filter_urls(pages, labels).filter("rule is not null").collect()
    assert [(r.page_id, r.verdict) for r in sorted(got)] == list(enumerate(list(cases.values()) * 20))


def test_sites_and_their_levels(spark):
    cases = {
        "a.b.example.com": ("a.b.example.com", "example.com", "com"), "example.co.uk:8080": ("example.co.uk", "example.co.uk", "co.uk"),
        "u:p@x.shop.com.au": ("x.shop.com.au", "shop.com.au", "com.au"), "10.0.0.1:80": ("10.0.0.1",) * 3, "[::1]:443": ("[::1]",) * 3, "[::1]": ("[::1]",) * 3,
        "co.uk": ("co.uk", "co.uk", "co.uk"), "localhost": ("localhost",) * 3, "": ("",) * 3, "x.tesco.uk": ("x.tesco.uk", "tesco.uk", "uk"),
    }
    df = spark.createDataFrame([(h,) for h in cases], "host string").withColumn("site", url_reputation.site(F.col("host")))
    domain, suffix = url_reputation.levels(F.col("site"))
    assert {r.host: (r.site, r.d, r.s) for r in df.select("host", "site", domain.alias("d"), suffix.alias("s")).collect()} == cases


def test_odd_hosts_equal_oracle(spark):
    hosts = ["a.co.uk", "b.co.uk", "b.co.uk:8080", "x@b.co.uk", "10.0.0.1", "10.0.0.1:81", "10.0.0.2", "[::1]:80", "good.de", "bad.good.de", "", "localhost"] * 6
    pages = [(i, f"http://{h}/p{i}") for i, h in enumerate(hosts)] + [(900, None), (901, "no scheme"), (None, "http://a.co.uk/"), (3, "http://bad.good.de/again"), (902, "http://a.co.uk/" + "x" * 100_000)]
    labels = [(i, int(i % 3 > 0), int(i % 12 in (1, 4))) for i in range(60)] + [(3, None, None), (None, 0, 1), (900, 0, 0)]
    p, l = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    con.register("pages_", p.toPandas().astype({"page_id": "Int64"}))
    con.register("labels_", l.toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
    con.sql("CREATE VIEW pages AS SELECT * FROM pages_; CREATE VIEW labels AS SELECT * FROM labels_")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    got = sorted(map(str, map(tuple, url_reputation.filter_urls(p, l).select(*cols).collect())))
    assert got == sorted(map(str, con.sql(f"SELECT {', '.join(cols)} FROM ({url_reputation.ORACLE})").fetchall())) and len(got) == len(pages)


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 40 else 'good' if i < 90 else 'new'}.site.info/{i}") for i in range(91)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 40 and i < 90), 0) for i in range(91)], "doc_id long, quality int, toxic int")
    got = {r.host.split(".")[0]: r.verdict for r in url_reputation.filter_urls(pages, labels).collect()}
    assert got == {"bad": "block", "good": "allow", "new": "allow"}


def test_mixing_meets_targets(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.mix(docs, labels).collect()
    r, t, p = np.array([x.rate for x in rows]), np.array([x.n_tokens for x in rows]), np.array([x.posteriors for x in rows])
    got = (r * t) @ p
    assert len(rows) == docs.count() and (r >= 0).all() and p.sum(axis=1) == pytest.approx(np.ones(len(p)))
    assert got / got.sum() == pytest.approx(np.array(list(mixing.TARGETS.values())), abs=2e-3)
    assert all(x.copies in (math.floor(x.rate), math.floor(x.rate) + 1) for x in rows)


def test_mixing_odd_rows(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "a b", 2.0), (4, "x " * 5000, 3.0), (4, "x " * 5000, 3.0)], "doc_id long, text string, rate double")
    assert mixing.mix(df, labels).count() == 5
    out = mixing.resample(df, labels)
    assert out.columns == df.columns and out.count() >= 5 and {r.doc_id for r in out.collect()} == {1, 2, None, 4}
    assert mixing.mix(df.filter("false"), labels).count() == 0


def rates_of(df, shares, floor=0.0):
    steps, gap = mixing.fit_rates(df, shares, floor)
    return np.array([x.r for x in df.select("i", F.expr(mixing.rate_sql(steps, floor)).alias("r")).orderBy("i").collect()]), gap


def least_squares(t, p, want, floor, rounds=200_000):
    """The least value of the same objective by plain projected gradient in numpy."""
    a = (p * t[:, None]).T
    r, rate = np.ones(len(t)), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(rounds):
        r = np.maximum(floor, r - rate * (a.T @ (a @ r - want)))
    return np.sum((a @ r - want) ** 2)


@pytest.mark.parametrize("floor", [0.0, 1.0])
@pytest.mark.parametrize("case", ["reachable", "unreachable"])
def test_rates_equal_direct_least_squares(spark, case, floor):
    rng = np.random.default_rng(7)
    t = rng.integers(1, 60, 40)
    first = rng.random(40) if case == "reachable" else 0.75 + 0.25 * rng.random(40)
    p = np.stack([first, 1 - first], axis=1)
    df = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(t, p))], "i int, n_tokens long, p array<double>")
    if case == "unreachable":
        with pytest.warns(UserWarning, match="misses its targets"):
            r, gap = rates_of(df, [0.2, 0.8], floor)
    else:
        r, gap = rates_of(df, [0.45, 0.55], floor)
    share = np.array([0.2, 0.8] if case == "unreachable" else [0.45, 0.55])
    budget = np.max((p.T @ t) / share)
    got = np.sum((p.T @ (t * r) - budget * share) ** 2)
    least = least_squares(t.astype(float), p, budget * share, floor)
    assert r.min() >= floor and (gap < 1e-4 if case == "reachable" and not floor else gap < 0.01 if case == "reachable" else gap > 0.1)
    assert got <= least * 1.05 + (0.01 * budget) ** 2  # within a hundredth of all tokens
    assert gap == pytest.approx(np.max(np.abs(p.T @ (t * r) - budget * share)) / budget)


def test_posteriors_equal_counting(spark, small):
    """Naive Bayes by plain counting of the same words, and calibrated: the chosen scale is the likeliest of all."""
    import re

    docs, labels = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{small}/labels.parquet")
    found = mixing.fit(docs, labels, [(1,), (0,)])
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    odd = spark.createDataFrame([(-1, "tab\tline\nfeed\x0bone\x0cpage  two\r"), (-2, None), (-3, " ")], "doc_id long, text string")
    df = docs.limit(25).unionByName(odd)
    every = sorted({w for r in df.collect() for w in words(r.text)})
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in every], "w string").withColumn("b", mixing.feature("w")).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in mixing.posteriors(df, found, ["doc_id"]).collect():
        w = words(texts[r.doc_id])
        e = np.array([sum(x[bucket[v]] for v in w) for x in found.logs])
        z = np.array(found.prior) + found.scale * (e - e.max())
        assert r.n_tokens == len(w) and r.p == pytest.approx((np.exp(z - z.max()) / np.exp(z - z.max()).sum()).tolist(), abs=1e-5)


def test_pipeline_run(spark, small, tmp_path):
    """run() over usual, odd and empty tables; nothing is left of the stages' intermediate tables."""
    import pathlib
    import shutil

    shared_folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    for case in ("odd", "empty"):
        home = tmp_path / case
        home.mkdir()
        for t in ("labels", "benchmark"):
            shutil.copy(f"{small}/{t}.parquet", home)
        docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
        if case == "odd":
            more = [(10**6 + i, t, None, None, None) for i, t in enumerate([None, "", " \n", "one", "word " * 20000, "same words here now again", "same words here now again"])] + [(None, "no id at all", "x", "y", 1), (0, "a second text of document zero", "x", "y", 1)]
            docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
        docs = (docs.filter("false") if case == "empty" else docs).withColumn("score", F.lit(1)).withColumn("row", F.lit("x")).withColumn("n_tokens", F.lit(2))
        docs.write.parquet(f"{home}/documents.parquet")
        before = {p.name.rsplit("-", 1)[0] for p in shared_folder.iterdir()}
        out = corpus_pipeline.run(spark, str(home))
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        rows = out.collect()
        left = {p.name.rsplit("-", 1)[0] for p in shared_folder.iterdir()} - before
        assert all(name.startswith(("pipeline", "tokens")) for name in left), left
        if case == "empty":
            assert rows == []
            continue
        ids = [r.doc_id for r in rows]
        assert None in ids and 10**6 + 3 in ids and 10**6 + 4 in ids and len({10**6, 10**6 + 1, 10**6 + 2} & set(ids)) == 1
        assert (10**6 + 5 in ids) and (10**6 + 6 not in ids) and 0 in ids
        assert sorted(r.start for r in rows) == np.cumsum([0, *[r.n_tokens for r in sorted(rows, key=lambda r: r.start)]])[:-1].tolist()


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        path = shared.new_path(spark, f"test-{name}")
        out.write.parquet(path)
        if name != "token_output":
            assert out.columns == docs.columns
        docs = spark.read.parquet(path)
        if name in ("toxicity", "simhash_dedup", "decontamination"):
            assert 0.7 * before < docs.count() < before
            before = docs.count()
        if name == "mixing":
            assert docs.select("doc_id").distinct().count() == before
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_words_keep_the_letter_f(spark):
    """Spark's SQL strings don't know the escape of the form feed, so it stands by its number; else each f parts a word."""
    df = spark.createDataFrame([(1, "five of fluff\x0coff\tif"), (2, "f"), (3, "\x0c")], "doc_id long, text string")
    got = {r.doc_id: r.w for r in df.selectExpr("doc_id", f"{mixing.WORDS} AS w").collect()}
    assert got == {1: ["five", "of", "fluff", "off", "if"], 2: ["f"], 3: []}


def test_components_by_rounds_and_by_the_driver(spark, monkeypatch):
    """The same components, whether the driver ends the contraction at once, later, or not at all."""
    rng = np.random.default_rng(3)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(int(a), int(b)) for a, b in rng.integers(100, 400, (150, 2))], "a long, b long")
    found = []
    for few in (0, 20, shared.LOCAL):
        monkeypatch.setattr(shared, "LOCAL", few)
        groups = {}
        for r in shared.connected_components(edges).collect():
            groups.setdefault(r.root, set()).add(r.node)
        assert all(root in g for root, g in groups.items())
        found.append(sorted(sorted(g) for g in groups.values()))
    assert found[0] == found[1] == found[2] and found[0][0] == list(range(41))
