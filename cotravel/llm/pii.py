"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides. SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged

KINDS = ["email", "ip", "card", "phone", "secret"]
# The base definitions in equivalent forms that never backtrack over a long run: possessive where nothing that
# follows could use what is given back, and a start only where a run starts (or the last match ended).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Further candidates, which stay only if the classifier accepts them.
LOCAL_PHONE = r"(?<![0-9+().\x20-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"
SPELLED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]{1,63}+){1,4}"
SECRET = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+(?![A-Za-z0-9_+/=-])"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
LEFT, RIGHT, BLOCK = 24, 12, 256
# Gazetteers: fixed values, plainly listed.
TLDS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info|biz|example"
CARD_HEADS = "4|5[1-5]|2[2-7]|3[47]|6"
COUNTRY_CODES = "1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
KEY_WORDS = "token|secret|passw|api_?key|apikey|bearer|credential"
KEY_HEADS = "AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|sk[-_]|pk[-_]|rk_|xox[abprs]-|ya29|eyJ|SG[.]|npm_|hf_"
CONTEXT = {
    "email": "mail|contact|write|reply|cc:|to:|from:",
    "ip": r"\bip\b|host|server|addr|ping|node",
    "card": "card|visa|master|amex|pay|credit|account",
    "phone": "phone|call|tel|fax|mobile|cell|dial",
    "secret": KEY_WORDS + "|key|auth",
}
AGAINST = r"(?:version|\bv|isbn|\bid|#|sha256|md5|commit|figure|page|§)\s*[:=]?\s*$"
LABELERS = ["pattern", "gazetteer", "context", "check", "against"]
ROUNDS = 25
# Prior of a labeler's votes in each class, as so many candidates: better than chance, without evidence where it abstains.
PRIOR, AS_MANY = {(-1, 1): 0.1, (0, 1): 0.4, (1, 1): 0.5, (-1, 0): 0.5, (0, 0): 0.4, (1, 0): 0.1}, 10.0


def _q(regex: str) -> str:
    """A Java regex as a raw SQL string."""
    return "r\"" + regex.replace('"', '\\x22') + "\""


def _prefix_sums(arr: str) -> str:
    """SQL: exclusive prefix sums of an int array, in blocks so that the work stays near linear."""
    blocks = f"transform(sequence(0, (size({arr}) - 1) div {BLOCK}), b -> slice({arr}, b * {BLOCK} + 1, {BLOCK}))"
    total = "aggregate(k, 0, (s, v) -> s + v)"
    heads = f"aggregate(transform({blocks}, k -> {total}), named_struct('p', 0, 'o', cast(array() as array<int>)), (s, v) -> named_struct('p', s.p + v, 'o', array_append(s.o, s.p)), s -> s.o)"
    inner = "aggregate(z.k, named_struct('p', z.h, 'o', cast(array() as array<int>)), (s, v) -> named_struct('p', s.p + v, 'o', array_append(s.o, s.p)), s -> s.o)"
    return f"flatten(transform(zip_with({blocks}, {heads}, (k, h) -> named_struct('k', k, 'h', h)), z -> {inner}))"


def _found(df: DataFrame, regex: str, kind: str, base: bool, worth: str, keep: str) -> DataFrame:
    """Append the matches of ``regex`` in texts where ``worth`` holds, filtered by ``keep`` (over x), to column c.

    Positions come from the lengths, in code points, of the texts between the matches."""
    q = _q(regex)
    df = df.withColumn("m", F.expr(f"CASE WHEN {worth} THEN regexp_extract_all(t, {q}, 0) ELSE cast(array() as array<string>) END"))
    df = df.withColumn("p", F.expr(f"CASE WHEN size(m) > 0 THEN transform(slice(split(t, {q}, -1), 1, size(m)), x -> length(x)) ELSE cast(array() as array<int>) END"))
    df = df.withColumn("o", F.expr(f"CASE WHEN size(m) > 0 THEN {_prefix_sums('zip_with(p, m, (a, x) -> a + length(x))')} ELSE cast(array() as array<int>) END"))
    item = f"named_struct('kind', '{kind}', 'base', {str(base).lower()}, 'start', s, 'end', s + length(x), 'x', x)"
    made = f"zip_with(m, zip_with(o, p, (a, b) -> a + b), (x, s) -> {item})"
    return df.withColumn("c", F.expr(f"concat(c, filter({made}, y -> {keep.replace('{x}', 'y.x')}))")).drop("m", "p", "o")


DIGITS = "regexp_replace({x}, '[^0-9]', '')"
LUHN = f"aggregate(transform(sequence(1, length({DIGITS})), i -> int(substr(reverse({DIGITS}), i, 1)) * IF(i % 2 = 0, 2, 1)), 0, (a, v) -> a + IF(v > 9, v - 9, v)) % 10 = 0"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and c: base matches of the four kinds (with overlaps between kinds) and further candidates."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    df = df.withColumn("c", F.expr("cast(array() as array<struct<kind:string,base:boolean,start:int,end:int,x:string>>)"))
    df = df.withColumn("d", F.expr("t rlike '[0-9]'"))
    df = _found(df, EMAIL, "email", True, "contains(t, '@')", "true")
    df = _found(df, IP, "ip", True, "d", f"{{x}} rlike {_q(f'^{OCTET}(?:[.]{OCTET}){{3}}$')}".replace("{3}", "{3}"))
    df = _found(df, CARD, "card", True, "d", LUHN)
    df = _found(df, PHONE, "phone", True, "d AND contains(t, '+')", f"length({DIGITS}) BETWEEN 9 AND 15")
    df = _found(df, LOCAL_PHONE, "phone", False, "d", "true")
    df = _found(df, SPELLED_EMAIL, "email", False, "t rlike '[\\\\[(](?:at|AT)[\\\\])]'", "true")
    return _found(df, SECRET, "secret", False, "d", "{x} rlike '[0-9]' AND {x} rlike '[A-Za-z]'")


def votes(df: DataFrame) -> DataFrame:
    """Each candidate with its labelers' votes (1 for, -1 against, 0 none) and the classifier's further features."""
    by = lambda cases, other="0": "CASE " + " ".join(f"WHEN y.kind = '{k}' THEN {v}" for k, v in cases.items()) + f" ELSE {other} END"
    vote = lambda cond, no="0": f"IF({cond}, 1, {no})"
    pattern = by({
        "email": vote(f"y.x rlike {_q(r'^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+[.])+[A-Za-z]{2,}$')}", "-1"),
        "ip": vote(f"y.x rlike {_q(r'^(?:0|[1-9][0-9]*)(?:[.](?:0|[1-9][0-9]*)){3}$')}", "-1"),
        "card": vote(f"y.x rlike {_q(r'^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$')}"),
        "phone": vote(f"y.x rlike {_q(r'[()-]| ')}"),
        "secret": vote(f"y.x rlike {_q(r'^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[A-Z0-9]{20})$')}"),
    })
    gazetteer = by({
        "email": vote(f"lower(y.x) rlike {_q(f'(?:[.]|dot[)] ?|dot] ?)(?:{TLDS})$')}"),
        "ip": vote(f"y.x rlike {_q('^(?:0|127|22[4-9]|2[3-5][0-9])[.]')}", "0").replace("1, 0)", "-1, 0)"),
        "card": vote(f"y.x rlike {_q(f'^(?:{CARD_HEADS})')}", "-1"),
        "phone": vote(f"y.x rlike {_q(f'^[+](?:{COUNTRY_CODES})')}"),
        "secret": vote(f"y.x rlike {_q(f'^(?:{KEY_HEADS})')}"),
    })
    context = by({k: vote(f"y.l rlike {_q(f'(?i){v}')}") for k, v in CONTEXT.items()})
    check = by({
        "email": vote("length(y.x) BETWEEN 6 AND 100", "-1"),
        "ip": vote("NOT y.x rlike '[.]0[.]0[.]'", "-1"),
        "card": vote("NOT y.x rlike '^([0-9])(?:[ -]?\\\\1)+$'", "-1"),
        "phone": vote("length(regexp_replace(y.x, '[^0-9]', '')) BETWEEN 9 AND 13", "0"),
        "secret": vote("size(array_distinct(split(lower(y.x), ''))) >= 10", "-1"),
    })
    against = f"IF(y.l rlike {_q(f'(?i){AGAINST}')} OR y.r rlike '^[0-9A-Za-z]', -1, 0)"
    shape = "IF(y.l = '', 0, IF(y.l rlike '[\\\\s\"]$', 1, 2)) * 3 + IF(y.r = '', 0, IF(y.r rlike '^[\\\\s\".,;]', 1, 2))"
    near = f"transform(c, y -> named_struct('kind', y.kind, 'base', y.base, 'start', y.start, 'end', y.end, 'x', y.x, 'l', substring(t, greatest(1, y.start - {LEFT} + 1), least({LEFT}, y.start)), 'r', substring(t, y.end + 1, {RIGHT})))"
    item = (
        "named_struct('kind', y.kind, 'base', y.base, 'start', y.start, 'end', y.end, "
        f"'pattern', {pattern}, 'gazetteer', {gazetteer}, 'context', {context}, 'check', {check}, 'against', {against}, "
        f"'shape', {shape}, 'size', least(3, int(length(y.x) / 12)))"
    )
    return df.withColumn("c", F.expr(near)).select("doc_id", F.expr(f"transform(c, y -> {item})").alias("c"))


def em(patterns: list[tuple], rounds: int = ROUNDS) -> tuple[list[float], dict]:
    """Reliabilities by expectation-maximisation over counted vote patterns (kind, votes, n).

    Two classes, labelers independent given the class. A labeler is another rule for each kind, so it has the
    probabilities of its three votes by class and kind, with the same prior for all, and each kind has its share of
    true spans. Returns the posterior of each pattern and the parameters."""
    post = [min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for _, v, _ in patterns]
    par: dict = {}
    for _ in range(rounds):
        par = {"kind": {}, "vote": {}}
        for k in KINDS:
            n = sum(c for kind, _, c in patterns if kind == k)
            par["kind"][k] = (sum(c * p for (kind, _, c), p in zip(patterns, post) if kind == k) + 1) / (n + 2)
        for k in KINDS:
            mine = [(c * p, c * (1 - p), votes_) for (kind, votes_, c), p in zip(patterns, post) if kind == k]
            for j in range(len(LABELERS)):
                for y in (0, 1):
                    total = sum(m[1 - y] for m in mine)
                    for v in (-1, 0, 1):
                        hit = sum(m[1 - y] for m in mine if m[2][j] == v)
                        par["vote"][k, j, v, y] = (hit + AS_MANY * PRIOR[v, y]) / (total + AS_MANY)
        post = []
        for kind, v, _ in patterns:
            z = math.log(par["kind"][kind]) - math.log(1 - par["kind"][kind])
            z += sum(math.log(par["vote"][kind, j, v[j], 1]) - math.log(par["vote"][kind, j, v[j], 0]) for j in range(len(v)))
            post.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
    return post, par


def fit(voted: DataFrame) -> dict[tuple[str, int], float]:
    """Weights of the span classifier, a logistic regression on votes, kind, neighbours and length.

    It learns the EM posteriors from counts per distinct feature combination: the kinds, votes and features have
    few values each, so these are at most 5 * 3^5 * 9 * 4 rows however large the input."""
    keys = ["kind", *LABELERS, "shape", "size"]
    rows = voted.select(F.explode("c").alias("y")).groupBy(*[F.col(f"y.{k}").alias(k) for k in keys]).agg(F.count("*").alias("n")).collect()
    rows = sorted(tuple(r) for r in rows)
    counted: dict = {}
    for r in rows:
        counted[r[0], r[1:6]] = counted.get((r[0], r[1:6]), 0) + r[8]
    patterns = [(k, v, n) for (k, v), n in counted.items()]
    post, _ = em(patterns)
    truth = {(k, v): p for (k, v, _), p in zip(patterns, post)}
    active = [[("bias", 0), *[(f"{k}:{r[0]}", v) for k, v in zip(keys[1:], r[1:8])], ("kind:" + r[0], 0)] for r in rows]
    total = sum(r[8] for r in rows) or 1
    weights: dict = {f: 0.0 for a in active for f in a}
    square = dict.fromkeys(weights, 1e-6)
    for _ in range(150):
        grad = dict.fromkeys(weights, 0.0)
        for r, a in zip(rows, active):
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(weights[f] for f in a)))))
            g = (p - truth[r[0], r[1:6]]) * r[8] / total
            for f in a:
                grad[f] += g
        for f, g in grad.items():
            g += 1e-5 * weights[f]
            square[f] += g * g
            weights[f] -= 0.5 * g / math.sqrt(square[f])
    return weights


def spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and spans: array of (kind, base, start, end, score), by kind as in KINDS, then start.

    Base spans are exactly the definition's; further candidates stay if the classifier gives them ``threshold``.
    Positions are code points, end exclusive. Null and empty texts have no spans; each row of the input gives one
    row, repeated ones and those with null ids too; an empty table an empty result. Texts are searched whole by
    patterns that don't backtrack, so very long ones take time in proportion. Other columns aren't read. One scan of
    the text; no shuffle of it.
    """
    voted = staged(votes(candidates(docs)), "votes")
    weights = fit(voted)
    z = [f"{weights.get(('bias', 0), 0.0)!r}D"]
    for name in [*LABELERS, "shape", "size"]:
        cases = [(f.split(":")[1], v, w) for (f, v), w in weights.items() if f.startswith(name + ":")]
        z.append("CASE " + " ".join(f"WHEN y.kind = '{k}' AND y.{name} = {v} THEN {w!r}D" for k, v, w in cases) + " ELSE 0D END" if cases else "0D")
    z.append("CASE " + " ".join(f"WHEN y.kind = '{k}' THEN {weights.get(('kind:' + k, 0), 0.0)!r}D" for k in KINDS) + " ELSE 0D END")
    rank = "CASE " + " ".join(f"WHEN y.kind = '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    scored = f"transform(c, y -> named_struct('rank', {rank}, 'start', y.start, 'end', y.end, 'kind', y.kind, 'base', y.base, 'score', 1D / (1D + exp(-({' + '.join(z)})))))"
    return voted.select("doc_id", F.expr(f"array_sort(filter({scored}, y -> y.base OR y.score >= {threshold}D))").alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all, as kind:start:end), n_secret, n_spans (all)."""
    text = "array_join(transform({}, y -> concat(y.kind, ':', y.start, ':', y.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, y -> y.base AND y.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select(
        "doc_id", *counts, F.sha2(F.expr(text.format("filter(spans, y -> y.base)")), 256).alias("base_sha256"), F.expr(text.format("spans")).alias("spans"),
        F.expr("cast(size(filter(spans, y -> y.kind = 'secret')) as long)").alias("n_secret"), F.size("spans").cast("long").alias("n_spans"),
    )
