"""PII, SimHash, token counts, ORC output, toxicity, quality: brute force, round trips and edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cotravel.llm import decontam, encode, pii, quality, queries, simhash, token_counts, token_orc, toxicity

DOCS = "doc_id long, text string"
ODD = [None, "", " ", "\n", "a", "A b", "x  y\n\n z", "é ü\t1.2.3.4", "word " * 3000, "z" * 20000, "same text here", "same text here", "\0 nul", "a\x1cb"]


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts, a null id, and columns whose names clash with the operators' own."""
    rows = [(i if i != 4 else None, t, 1, "x", 0.5) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, spans string, rate double").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")


# --- PII ---


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def base_spans(t):
    t = t or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    find = lambda r, ok=lambda m: True: [m.span() for m in re.finditer(r, t) if ok(m)]
    return [
        find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
        find(r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        find(r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]


def test_pii_base_equals_brute_force(spark, docs):
    texts = [
        "a@b.c_d@e.f x", "1.2.3.4.5.6.7.8 999.1.1.1 007.1.1.1", "4242 4242 4242 4242-1 5", "+1 (017) 555-7713 +12 3", "x.a@b..c a@b.c-.d",
        "é@x.y é.z@x.yé", "4111111111111111", "4111-1111-1111-1111, 4111 1111  11111111", "1" * 3000 + "@x.y", "@" * 50 + "a@a.a" * 30, None, "", "12 " * 1000, "a@b.co " * 700,
    ]
    rows = [(10**6 + i, t) for i, t in enumerate(texts)] + [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in pii.digest(pii.spans(spark.createDataFrame(rows, DOCS))).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        b, r = base_spans(t), got[i]
        text = ",".join(f"{k}:{x}:{y}" for k, s in zip(pii.KINDS, b) for x, y in s)
        assert [len(x) for x in b] == [r.n_email, r.n_ip, r.n_card, r.n_phone], i
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_pii_learns_secrets(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(10**6, 'with token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" in it')]
    got = {r.doc_id: r.spans for r in pii.digest(pii.spans(spark.createDataFrame(rows, DOCS))).collect()}
    assert got[10**6] == "secret:14:54"


def test_pii_long_secrets_are_candidates(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" * 5
    found = pii.candidates(spark.createDataFrame([(1, f'with token = "{key}" in it')], DOCS)).first().c
    assert [(c.kind, c.start, c.end) for c in found if c.kind == "secret"] == [("secret", 14, 14 + len(key))]


def test_em_finds_the_reliable_labeler():
    patterns = [("ip", (1, 1, 0, 1, 0), 90), ("ip", (1, -1, 0, 1, 0), 10), ("ip", (-1, 1, 0, -1, 0), 5), ("ip", (-1, -1, 0, -1, -1), 95)]
    post, _ = pii.em(patterns)
    assert post[0] > 0.9 and post[1] > 0.5 > post[2] and post[3] < 0.1


def test_em_reliabilities_are_each_kinds_own():
    """A labeler that is right for one kind and wrong for another, which a common reliability would confuse."""
    good = [("ip", (1, 1, 0, 1, 0), 100), ("ip", (-1, -1, 0, -1, 0), 100)]
    bad = [("card", (1, -1, 0, 1, 0), 100), ("card", (-1, 1, 0, -1, 0), 100)]
    post, par = pii.em(good + bad)
    assert post[0] > 0.9 > 0.1 > post[1] and post[2] > 0.9 > 0.1 > post[3]
    assert par["vote"]["ip", 1, 1, 1] > 0.8 > 0.2 > par["vote"]["card", 1, 1, 1]
    assert pii.em([("phone", (1, 0, 0, 1, 0), 3)])[0][0] > 0.5 > pii.em([("phone", (-1, 0, 0, -1, -1), 3)])[0][0]


def test_pii_odd_rows(odd, none):
    got = pii.digest(pii.spans(odd))
    assert got.count() == len(ODD) and pii.digest(pii.spans(none)).count() == 0
    long = odd.sparkSession.createDataFrame([(1, "a" * 300_000 + " 1.2.3.4 " + "9 " * 200_000)], DOCS)
    row = pii.digest(pii.spans(long)).first()
    assert row.n_ip == 1 and row.n_spans >= 1


# --- SimHash ---


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    count = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if count[b] * 2 > len(sh))


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n"), (10**6 + 3, "one two")]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS), tile=8).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    ids = sorted(prints)
    want = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert {i: r.component_id for i, r in got.items()} == want


@pytest.mark.parametrize("words", [2, 4])
def test_simhash_links_random_clusters(spark, words):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40)
    fps = np.unique([int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4, 5)]).astype(np.uint64).view(np.int64)
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), tile=4, words=words).collect()
    want = [(int(a), int(b)) for k, a in enumerate(fps) for b in fps[k + 1 :] if (int(a) ^ int(b)).bit_count() <= 3]
    assert components(map(int, fps), want) == components(map(int, fps), [(r.a, r.b) for r in edges])


def test_simhash_odd_rows(odd, none):
    got = simhash.near_duplicates(odd)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == len(ODD) and simhash.near_duplicates(none).count() == 0


# --- tokens ---


SPECIAL = ["<|endoftext|>", "a<|endoftext|>b", "one <|endoftext|> two\n<|endoftext|>", "<|endoftext", "|endoftext|> <|endof text|>"]


@pytest.fixture(scope="module")
def library():
    """The library itself, untouched by the operators."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.mark.parametrize("pieces", [1_000_000, 200, 0])
def test_encoder_equals_library(docs, library, monkeypatch, pieces):
    monkeypatch.setattr(encode, "PIECES", pieces)
    rng = np.random.default_rng(1)
    marks = list(" \n\n  ab.,'s1é!\t ?;") + ["<|endoftext|>"]
    texts = [t or "" for t in ODD] + SPECIAL + [r.text for r in docs.limit(40).collect()] + ["".join(rng.choice(marks, rng.integers(0, 14))) for _ in range(800)]
    for spans in (False, True):
        enc = encode.Encoder(queries.tokenizer_path(), spans)
        assert enc.pieces
        if not pieces:
            enc.pieces = False  # as for a file of another kind
        for k in range(0, len(texts), 50):
            got = enc.encode(texts[k : k + 50])
            at = np.concatenate([[0], np.cumsum(got[1])])
            for i, t in enumerate(texts[k : k + 50]):
                want = library.encode(t, add_special_tokens=False)
                assert want.ids == got[0][at[i] : at[i + 1]].tolist(), t[:50]
                if spans:
                    assert want.offsets == list(zip(got[2][at[i] : at[i + 1]].tolist(), got[3][at[i] : at[i + 1]].tolist()))


def test_other_files_are_encoded_whole():
    import public_tokenizers

    enc = encode.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not enc.pieces
    assert enc.encode(["Two words", "", "<|endoftext|>"])[0].tolist() == [i for t in ("Two words", "", "<|endoftext|>") for i in enc.tok.encode(t, add_special_tokens=False).ids]


def test_orc_round_trip(spark, odd, library, tmp_path):
    path = f"file://{tmp_path}/t"
    special = spark.createDataFrame([(100 + i, t, 1, "x", 0.5) for i, t in enumerate(SPECIAL)], "doc_id long, text string, score int, spans string, rate double")
    df = odd.unionByName(special)
    got = token_orc.token_output(df, queries.tokenizer_path(), path).collect()
    rows = sorted([*((i if i != 4 else None, t or "") for i, t in enumerate(ODD)), *((100 + i, t) for i, t in enumerate(SPECIAL))], key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    back = token_orc.read(spark, path)
    assert [r.n_tokens for r in back.filter("doc_id = 8").collect()] == [w[2] for w in want if w[0] == 8]
    assert token_orc.token_output(spark.createDataFrame([], DOCS), queries.tokenizer_path()).count() == 0


def brute_counts(library, text, sections, rule):
    """Character by character: a token's share of each section it overlaps (None: between sections)."""
    owner = {c: k for k, (a, b) in enumerate(sections) for c in range(a, min(b, len(text)))}
    n, crossing = [0.0] * len(sections), [0] * len(sections)
    for a, b in library.encode(text, add_special_tokens=False).offsets:
        chars = [owner.get(c) for c in range(a, max(b, a + 1))]
        parts = list(dict.fromkeys(chars))
        # two gaps about a section are two parts
        runs = [chars[0]] + [y for x, y in zip(chars, chars[1:]) if x != y]
        if len(runs) > 1:
            for k in parts:
                if k is not None:
                    crossing[k] += 1
        if rule == "split":
            for k in parts:
                if k is not None:
                    n[k] += chars.count(k) / len(chars)
            continue
        spans, at = [], 0
        for k in runs:
            m = at
            while m < len(chars) and chars[m] == k:
                m += 1
            spans.append((m - at, k))
            at = m
        k = runs[0] if rule == "start" else max(spans, key=lambda s: s[0])[1]
        if k is not None:
            n[k] += 1
    return n, crossing


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_equal_brute_force(spark, odd, docs, none, library, rule):
    df = docs.limit(20).select("doc_id", "text").unionByName(odd.select((F.monotonically_increasing_id() + 10**7).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    got = token_counts.token_counts(df, queries.tokenizer_path(), rule).collect()
    for i, t in texts.items():
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
        assert "".join(t[r.start : r.end] for r in mine) == t and all(r.start == 0 or t[r.start - 1] == "\n" for r in mine)
        n, crossing = brute_counts(library, t, [(r.start, r.end) for r in mine], rule)
        assert [r.n_tokens for r in mine] == pytest.approx(n) and [r.n_crossing for r in mine] == crossing
        assert sum(r.n_tokens for r in mine) == pytest.approx(len(library.encode(t, add_special_tokens=False).ids))
    # intervals that cut words, with gaps between them, without length, beyond the text's end, none and null
    rng, rows = np.random.default_rng(5), []
    for i, t in texts.items():
        cuts = sorted(rng.integers(0, len(t) + 3, 2 * int(rng.integers(0, 6))).tolist())
        rows.append((i, t, [{"start": a, "end": b} for a, b in zip(cuts[::2], cuts[1::2])], 1))
    given = spark.createDataFrame(rows + [(None, "a b", None, 1)], "doc_id long, text string, parts array<struct<start:int,end:int>>, section int")
    got = token_counts.token_counts(given, queries.tokenizer_path(), rule, "parts").collect()
    for i, t, parts, _ in rows:
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
        n, crossing = brute_counts(library, t, [(min(p["start"], len(t)), min(p["end"], len(t))) for p in parts], rule)
        assert [r.n_tokens for r in mine] == pytest.approx(n) and [r.n_crossing for r in mine] == crossing
    assert not [r for r in got if r.doc_id is None] and token_counts.token_counts(none, queries.tokenizer_path(), rule).count() == 0


def test_fields_are_sections_of_one_text(spark, library):
    df = token_counts.with_fields(spark.createDataFrame([(1, "A title", None, "é body\nof two")], "doc_id long, title string, kicker string, `b.c` string"), ["title", "kicker", "b.c"], " | ")
    row = df.first()
    assert row.text == "A title |  | é body\nof two" and [row.text[s.start : s.end] for s in row.sections] == ["A title", "", "é body\nof two"]
    got = sorted(token_counts.token_counts(df, queries.tokenizer_path(), "majority", "sections").collect(), key=lambda r: r.section)
    assert [r.n_tokens for r in got] == brute_counts(library, row.text, [(s.start, s.end) for s in row.sections], "majority")[0]


def test_crossing_rules():
    cuts, lo, hi = np.array([0, 3, 6]), np.array([0, 2, 5]), np.array([2, 5, 6])
    assert token_counts.allocate(cuts, lo, hi, "start")[0].tolist() == [2, 1]
    assert token_counts.allocate(cuts, lo, hi, "majority")[0].tolist() == [1, 2]
    assert token_counts.allocate(cuts, lo, hi, "split")[0] == pytest.approx([4 / 3, 5 / 3])


# --- toxicity and quality ---


def test_toxicity_catches_misspellings_and_spares_clean():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ou", "in", "re", "st"], 3))
    clean = [" ".join(word() for _ in range(60)) for _ in range(300)]
    bad = [c.replace(" ", f" {w} ", 2) for c, w in zip(clean[:120], ["worthless", "pathetic", "disgusting"] * 40)]
    model = toxicity.train(bad + clean[120:], np.array([1] * 120 + [0] * 180), epochs=15)
    import pyarrow as pa

    score = lambda x: model.scores(pa.array(x, pa.string()))
    fresh = [" ".join(word() for _ in range(200)) for _ in range(50)]
    assert (score(fresh) < 0.5).mean() > 0.95
    assert (score([f + " worthles" for f in fresh]) >= 0.5).mean() > 0.8
    assert (score([None, "", "  "]) < 0.5).all()


def test_toxicity_held_out_accuracy(spark):
    """On the labelled documents that training leaves out, of a larger table; some labelled toxic hold no toxic word."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").collect()
    for held in (True, False):
        mine = [r for r in rows if r.held_out == held]
        bad, good = [r.predicted for r in mine if r.toxic == 1], [r.predicted for r in mine if r.toxic == 0]
        assert len(bad) >= 50 and len(bad) < 1000 and np.mean(bad) >= 0.7 and np.mean(good) <= 0.01


def test_toxicity_trains_on_distinct_words():
    """The texts' numbered words stand for just the n-grams that scoring sees."""
    import pyarrow as pa

    texts = ["Two words two\twords", "", " \n", "é two ü", "x" * 50 + " words"] * 3
    seen = toxicity.Texts()
    for k in range(0, len(texts), 4):
        seen.add(texts[k : k + 4])
    want = []
    for ids, begin, first in toxicity.bags(pa.array(texts, pa.string())):
        byte = np.append(begin, ids.shape[1])
        for r in range(len(first) - 1):
            want.append([sorted(x[x >= 0].tolist()) for x in (ids[:, byte[k] : byte[k + 1]].ravel() for k in range(first[r], first[r + 1]))])
    assert [[sorted(seen.grams[w].tolist()) for w in words] for words in seen.words] == want and len(seen.grams) == 5


def test_toxicity_held_out_and_odd_rows(odd, none, docs, labels):
    model = toxicity.fit(docs, labels)
    rows = toxicity.classify(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert toxicity.keep_clean(odd, model).columns == odd.columns and toxicity.classify(none, model).count() == 0
    empty = labels.filter("false")
    assert {r.predicted for r in toxicity.classify(docs, toxicity.fit(docs, empty)).collect()} == {0}


def test_kth_largest(spark):
    df = spark.range(5000).select(((F.col("id") * 7919 % 5000) / 7).alias("v"))
    values = sorted((r.v for r in df.collect()), reverse=True)
    for k in (1, 17, 2500, 5000):
        assert quality.kth_largest(df, "v", k, bins=16) == values[k - 1]
    assert quality.kth_largest(df.filter("false"), "v", 3) is None


def test_quality_weights_equal_plain_counting(spark, docs, labels):
    """n-grams counted one by one; buckets by the operator's own hash of each word and pair."""
    import pyarrow as pa

    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [(i, t, 1) for i, t in texts.items()] + [(10**6, None, 1), (10**6 + 1, " ", 1), (10**6 + 2, "One  two\tOne", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, log_weight int")
    names: dict = {}

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    def bucket(g):
        if g not in names:
            ids = next(quality.grams(pa.array([g], pa.string())))[0]
            names[g] = int(ids[1]) if " " in g else int(ids[0])
        return names[g]

    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    raw, ours = np.zeros(1 << quality.BITS), np.zeros(1 << quality.BITS)
    for i, t, _ in rows:
        for g in grams(t):
            raw[bucket(g)] += 1
            ours[bucket(g)] += i in good
    ratio = np.log((ours + 1) / (ours.sum() + len(ours))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    for r in quality.resample(df, labels).collect():
        want = [ratio[bucket(g)] for g in grams(dict((i, t) for i, t, _ in rows[-3:]).get(r.doc_id, texts.get(r.doc_id)))]
        assert r.n_grams == len(want) and r.log_weight == pytest.approx(sum(want), abs=1e-6)


def test_quality_prefers_good_text(docs, labels, odd, none):
    got = quality.resample(docs, labels)
    rows = got.join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(r.kept for r in got.collect()) == round(quality.good_share(labels) * docs.count()) and np.mean(good) > np.mean(bad) + 0.3
    assert sum(r.kept for r in quality.resample(docs, labels, 0.25).collect()) == round(docs.count() / 4)
    again = {r.doc_id: r.kept for r in quality.resample(docs.repartition(3), labels).collect()}
    assert again == {r.doc_id: r.kept for r in got.collect()}
    assert quality.resample(odd, labels).count() == len(ODD) and quality.resample(none, labels).count() == 0


# --- decontamination ---


def test_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    rng = np.random.default_rng(4)
    for _ in range(100):
        a, b = rng.integers(0, 6, rng.integers(1, 30)).tolist(), rng.integers(0, 6, rng.integers(0, 40)).tolist()
        assert decontam.common(decontam.bits(a), len(a), b) == slow(a, b)


def test_decontamination_finds_copies_and_paraphrases(spark, docs, small, odd, none):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    norm = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    item = max(items, key=lambda i: len(items[i]))
    words = items[item].split()
    para = " ".join(w for k, w in enumerate(words) if k % 6 != 2)
    filler = " ".join(next(r.text for r in docs.collect() if len(r.text) > 3000).split()[:200])
    extra = spark.createDataFrame([(10**6, filler + " " + para.upper() + " " + filler), (10**6 + 1, None), (10**6 + 2, "")], DOCS)
    df = docs.select("doc_id", "text").unionByName(extra)
    got = {r.doc_id: r.item_ids for r in decontam.find_leaks(df, bench).collect()}
    want = {r.doc_id: sorted(i for i, t in items.items() if norm(t) in norm(r.text)) for r in df.collect()}
    want[10**6] = sorted({*want[10**6], item})
    assert got == want
    assert decontam.keep_clean(odd, bench).columns == odd.columns
    assert decontam.find_leaks(none, bench).count() == 0
    assert not any(r.contaminated for r in decontam.find_leaks(odd, bench.filter("false")).collect())


def paraphrased(rng, words, pool, how):
    """An item's words with a share replaced, dropped or doubled, or its first three quarters alone."""
    if how == "head":
        return words[: -(-3 * len(words) // 4)]
    out = []
    for w in words:
        u = rng.random()
        if how == "replace" and u < 0.2:
            out.append(str(rng.choice(pool)))
        elif how == "insert" and u < 0.2:
            out += [w, str(rng.choice(pool))]
        elif not (how == "drop" and u < 0.2):
            out.append(w)
    return out


def test_candidate_recall_against_all_windows(spark, docs, small, monkeypatch):
    """Texts with planted paraphrases: what the cosine search finds, against the same checks on all windows."""
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    rng, clean = np.random.default_rng(12), [r.text.split() for r in docs.collect() if 200 < len(r.text.split()) < 400][:60]
    pool = [w for t in clean for w in t]
    items, rows = [(r.item_id, r.text.split()) for r in bench.collect()], []
    for k, (i, words) in enumerate(items * 4):
        if len(words) >= 12:
            t = list(clean[k % len(clean)])
            at = int(rng.integers(0, len(t)))
            t[at:at] = paraphrased(rng, words, pool, ("replace", "drop", "insert", "head")[k % 4])
            rows.append((k, " ".join(t)))
    df = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, i) for r in decontam.find_leaks(docs.select("doc_id", "text").unionByName(df.withColumn("doc_id", F.col("doc_id") + 10**6)), bench).collect() for i in r.item_ids if r.doc_id >= 10**6}
    groups = decontam.items_of(bench)
    monkeypatch.setattr(decontam, "COSINE", -2.0)  # every window is a candidate for every item
    want = set()
    for g in groups:
        blob = decontam.space_of(g, np.unique(np.concatenate(g.words)), np.ones(len(np.unique(np.concatenate(g.words))), np.float32), np.zeros((len(np.unique(np.concatenate(g.words))), 0)), decontam.Vocabulary(np.unique(np.concatenate(g.words))))
        search = decontam.Search(blob)
        at = 0
        import pyarrow as pa

        for h, first in decontam.passages(pa.array([t for _, t in rows], pa.string())):
            want |= {(10**6 + rows[at + row][0], g.ids[item]) for row, item in search.found(h, first)}
            at += len(first) - 1
    assert len(want) > 0.6 * len(rows)
    assert len(got & want) >= 0.9 * len(want) and got <= want


def test_items_of_several_groups_are_searched_in_one_scan(spark, docs, small, monkeypatch):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    want = sorted(map(str, decontam.find_leaks(docs, bench).collect()))
    monkeypatch.setattr(decontam, "ITEMS", 7)
    found = decontam.find_leaks(docs, bench)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = sorted(map(str, found.collect()))
    assert [r.split(", share")[0] for r in got] == [r.split(", share")[0] for r in want]


def test_reading_tokens_back_forgets_the_encoder():
    """A worker that checks written files holds no pieces any more, whatever it does next."""
    from cotravel.llm import encode, token_orc

    encode._kept["some file", False] = object()
    token_orc.checksum()
    assert not encode._kept


def test_words_after_line_feeds_go_to_the_model_directly():
    """Such words, with a mark at their end or not, need no pre-tokens of the library, and their ids equal its own."""
    from cotravel.llm import encode, queries

    enc = encode.Encoder(queries.tokenizer_path())
    new = ["\nThe", "\nÉeuxch", "\nThen,", "\nQué!", "\n4a", "\n", "\n.", "\nit's", "word", "word.", "mid\nword"]
    ids, other = enc._lists(new)
    assert [new[k] for k in other] == ["\n4a", "\n", "\n.", "\nit's", "mid\nword"]
    assert ids == [enc.tok.encode(encode.whole(p), add_special_tokens=False).ids for p in new]
    texts = ["One\nThe two\nQué! \nThen, x\n", "\n\nÉeuxch a\nb.\nc", "x \n", "I\n'll go"]
    flat, size = encode.Encoder(queries.tokenizer_path()).encode(texts)
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert flat.tolist() == sum(want, []) and size.tolist() == [len(w) for w in want]


def test_tile_pairs_of_a_task_return_one_forest():
    """Many small batches with the same links: no more edges than a forest of them has."""
    import pyarrow as pa

    x = pa.array([[0, 1, 3, 7, 1 << 40]], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([x, x, pa.array([True])], ["fps", "other", "same"])
    edges = [(a, b) for out in simhash.compare(3)([batch] * 50) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    assert len(edges) == 4 and set(components([0, 1, 3, 7, 1 << 40], edges).values()) == {0}


def test_words_with_runs_of_marks_go_to_the_model_directly():
    """Any marks after letters are one pre-token, so such words need none of the library's own, and ids equal its own."""
    from cotravel.llm import encode, queries

    enc = encode.Encoder(queries.tokenizer_path())
    new = ["word$$$", "word", "été.%%%", "\nab&&&", "a.'", "x_", "Qué!!", "it's", "$$$", "don't.", "a-b,"]
    ids, other = enc._lists(new)
    assert [new[k] for k in other] == ["it's", "$$$", "don't.", "a-b,"]
    assert ids == [enc.tok.encode(encode.whole(p), add_special_tokens=False).ids for p in new]
