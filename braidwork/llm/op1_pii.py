"""Personal data by weak supervision.

Base: regular expressions with checks (octets, Luhn, number of digits). The method looks at further candidates, too:
loose forms (obfuscated addresses, national telephone numbers, card numbers with other separators) next to the base's
own matches and failures. Labelers vote on every candidate, for (1), against (-1) or not at all (0):
  shape       the regular expression and its check;
  gazetteer   lists of top-level domains, card issuers' prefixes, reserved address ranges, calling codes;
  context     words before the candidate that announce or contradict such data;
  border      what directly surrounds it.
Expectation-maximisation over the counts of vote patterns (at most 3^4 per kind, whatever the corpus' size) estimates each labeler's
reliability and each pattern's posterior. A logistic regression on the votes and on features of the span that no labeler sees (its length,
share of digits, separators, neighbours) is trained on the posteriors and is the final span classifier; it alone decides on what is not
base. Only counts of equal patterns reach the driver, at most 4 * 3^4 * 4^5 whatever the corpus, and a few hundred in practice. The
weights become a column expression, so that both passes run in the JVM, within rows, without shuffling texts. Base spans stay in any case.

Defined results: null text is empty, and stays null in ``redact``; spans are code points, end exclusive; long texts are searched whole, in time
that grows with them and with the number of spans; of overlapping accepted spans the first by (start, kind) stays, and none that overlaps a base span; rows that
repeat give a row each; extra columns, whatever their names, pass through ``redact`` and are dropped by ``detect``; an empty table gives an
empty one (and a classifier with zero weights).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import table, text_of
from braidwork.shared import written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("shape", "gazetteer", "context", "border")
THRESHOLD = 0.5
NEAR = 32
#: Features of a span beside the votes, each with LEVELS values.
FEATURES, LEVELS = ("length", "digits", "separators", "before", "after"), 4
#: Spans whose places are summed at a time.
PART = 64

# Possessive forms of the contract's patterns (no match changes): linear time on long runs, no deep recursion.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": (f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@"),
    "ip": ("(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "."),
    "card": ("[0-9](?:[\\x20-]?[0-9]){11,}+", None),
    "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", "+"),
}
LOOSE = {
    "email": ("(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}+\\x20?(?:\\[at\\]|\\(at\\)|\\{at\\}|\\x20at\\x20)\\x20?[A-Z0-9-]++(?:(?:\\x20?(?:\\[dot\\]|\\(dot\\)|\\{dot\\})\\x20?|\\x20dot\\x20|\\.)[A-Z0-9-]++)++", None),
    "card": ("(?<![0-9._/-])[0-9]{4}([._/])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}(?![0-9])", None),
    "phone": ("(?<![0-9+.A-Za-z-])(?:\\([0-9]{3}\\)\\x20?|[0-9]{3}[\\x20.-])[0-9]{3}[\\x20.-][0-9]{4}(?![0-9-])", None),
}
# Lists of the gazetteer and of the context labeler.
DOMAINS = "com|net|org|edu|gov|info|biz|io|de|fr|es|uk|us|in|it|nl|eu|ch|at|be|pl|ru|jp|cn|br|mx|ca|au"
LOOSE_END = f"(?:\\.|dot[\\])}}\\x20])\\x20?(?:{DOMAINS})$"
FOR = {
    "email": "e-?mail|mail|contact|write|kontakt|correo|courriel|adresse",
    "ip": "\\bip\\b|address|server|host|addr|login|adresse",
    "card": "card|visa|master|amex|credit|karte|tarjeta|carte|payment",
    "phone": "phone|tel\\b|tel[.:]|call|mobile|fax|cell|telefon|anruf|whatsapp",
}
AGAINST = "version|isbn|order|invoice|serial|release|build|part no|article no|section|chapter|figure|id[:=]"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the sum of the digits, every second from the right doubled, ends in zero."""
    back = F.split(F.reverse(digits), "(?<=.)(?=.)")

    def value(x, i):
        d = x.cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(back, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), -3, 3).cast("int") <= 255))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(9, 15)


def _spans(df: DataFrame, out: str, pattern: str, gate: Column) -> DataFrame:
    """Adds array<struct<s, e, m>> of all matches in column _t. split() gives the gaps, hence the places."""
    df = df.withColumn("_gaps", F.when(gate, F.split("_t", pattern, -1)))
    df = df.withColumn("_found", F.when(F.size("_gaps") > 1, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))))
    df = df.withColumn("_steps", F.zip_with("_found", F.slice("_gaps", F.lit(1), F.size("_found")), lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m"))))
    kind = "array<struct<s:int,e:int,m:string>>"
    start = lambda at: F.struct(at.alias("at"), F.array().cast(kind).alias("out"))

    def add(acc, x):
        s = acc["at"] + x["g"]
        return F.struct((s + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["m"].alias("m")))).alias("out"))

    # Adding to an array copies it: places are summed in parts of PART spans, first the parts' own starts, then within each.
    part = lambda k: F.slice("_steps", k * PART + 1, F.lit(PART))
    df = df.withColumn("_sums", F.when(F.size("_steps") > 0, F.transform(F.expr(f"sequence(0, cast((size(_steps) - 1) div {PART} as int))"), lambda k: F.aggregate(part(k), F.lit(0), lambda a, x: a + x["g"] + x["n"]))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    df = df.withColumn("_sums", F.aggregate("_sums", first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"])
    found = F.flatten(F.transform("_sums", lambda at, k: F.aggregate(part(k), start(at), add)["out"]))
    return df.withColumn(out, F.coalesce(found, F.array().cast(kind))).drop("_gaps", "_found", "_steps", "_sums")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, x: Column, passes: Column) -> list[Column]:
    m = x["m"]
    before = F.substring(F.col("_t"), F.greatest(x["s"] - NEAR + 1, F.lit(1)), F.least(x["s"], F.lit(NEAR)))
    after = F.substring(F.col("_t"), x["e"] + 1, F.lit(2))
    if kind == "email":
        gazetteer = _vote(F.lower(m).rlike(f"(?:\\.|dot[\\])}}]?|\\x20)\\x20?(?:{DOMAINS})$"), m.rlike("[0-9]$"))
    elif kind == "ip":
        gazetteer = _vote(m.rlike("^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\\."), m.rlike("^0|^(?:22[4-9]|2[3-9][0-9])\\."))
    elif kind == "card":
        gazetteer = _vote(_digits(m).rlike("^(?:4|5[1-5]|2[2-7]|3[4-7]|6(?:011|4|5))"), _digits(m).rlike("^(?:0|1|9|(.)\\1{5})"))
    else:
        gazetteer = _vote(m.rlike("^(?:\\+[1-9]|\\(?[2-9][0-9]{2})"), m.rlike("^(?:\\+0|\\(?[01])"))
    low = F.lower(before)
    return [_vote(passes, ~passes), gazetteer, _vote(low.rlike(FOR[kind]), low.rlike(AGAINST)), _vote(after.rlike("^(?:$|[\\s,;:!?)\\]\"'<]|\\.(?:\\s|$))") & before.rlike("(?:^|[\\s(\\[\"'<:=])$"), after.rlike("^[A-Za-z0-9_]"))]


def _features(x: Column) -> list[Column]:
    """Features of a candidate, integers below LEVELS."""
    m = x["m"]
    n, digits = F.length(m), F.length(_digits(m))
    separators = F.length(F.regexp_replace(m, "[A-Za-z0-9]", ""))
    level = lambda v, *cuts: F.when(v < cuts[0], 0).when(v < cuts[1], 1).when(v < cuts[2], 2).otherwise(3)
    sort = lambda c: F.when(c == "", 0).when(c.rlike("^[\\s]"), 1).when(c.rlike("^[A-Za-z0-9_]"), 2).otherwise(3)
    before = F.when(x["s"] > 0, F.substring(F.col("_t"), x["s"], F.lit(1))).otherwise("")
    return [level(n, 11, 15, 20), level(10 * digits / n, 1, 5, 8), level(separators, 2, 4, 6), sort(before), sort(F.substring(F.col("_t"), x["e"] + 1, F.lit(1)))]


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds cands, array<struct<kind, s, e, base, v, f>>: v holds the votes, f the features, kind counts from 0 as KINDS, base tells the contract's spans.

    Names that start with an underscore are used within: give only columns without.
    """
    df = docs.withColumn("_t", text_of(text))
    digit = F.col("_t").rlike("[0-9]")
    parts = []
    for i, kind in enumerate(KINDS):
        for loose, (pattern, sign) in enumerate([BASE[kind], *([LOOSE[kind]] if kind in LOOSE else [])]):
            gate = F.col("_t").contains(sign) if sign else digit
            if kind == "email" and loose:
                gate = F.col("_t").rlike("(?i)[\\[({ ]at[\\])} ]") & F.col("_t").rlike("(?i)dot[\\])} ]|\\.[a-z]")
            name = f"_{kind}{loose}"
            df = _spans(df, name, pattern, gate)

            def candidate(i, kind, loose):
                def make(x):
                    passes = F.lower(x["m"]).rlike(LOOSE_END) if loose and kind == "email" else _passes(kind, x["m"])
                    return F.struct(F.lit(i).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), (passes & F.lit(not loose)).alias("base"), F.array(*_votes(kind, x, passes)).alias("v"), F.array(*_features(x)).alias("f"))

                return make

            parts.append(F.transform(name, candidate(i, kind, loose)))
    names = [c for c in df.columns if c.startswith("_") and c not in docs.columns]
    return df.withColumn("cands", F.flatten(F.array(*parts))).drop(*names)


def estimate(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posterior of each (kind, votes) from the counts: labelers are independent given the truth, their reliability is estimated per kind."""
    posterior = {}
    for kind in range(len(KINDS)):
        rows = [(v, n) for k, v, n in counts if k == kind]
        total = sum(n for _, n in rows)
        if not total:
            continue
        # The start has the labelers right more often than not; a half row of each outcome smooths.
        p = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in rows}
        for _ in range(rounds):
            yes = sum(n * p[v] for v, n in rows)
            share = (yes + 1) / (total + 2)
            like = [[{x: (sum(n * (p[v] if truth else 1 - p[v]) for v, n in rows if v[j] == x) + 0.5 + (x == (1 if truth else -1))) / ((yes if truth else total - yes) + 2.5) for x in (-1, 0, 1)} for j in range(len(LABELERS))] for truth in (0, 1)]
            for v, _ in rows:
                a, b = (math.log(share if truth else 1 - share) + sum(math.log(like[truth][j][x]) for j, x in enumerate(v)) for truth in (1, 0))
                p[v] = 1 / (1 + math.exp(max(-50.0, min(50.0, b - a))))
        posterior |= {(kind, v): q for v, q in p.items()}
    return posterior


def _encoded(kind: int, v: tuple[int, ...], f: tuple[int, ...]) -> list[int]:
    """Places of the weights that count for a pattern: its kind, each vote for and against, each feature's level by kind."""
    n = len(KINDS)
    at = [kind] + [n + 2 * j + (x < 0) for j, x in enumerate(v) if x]
    return at + [n + 2 * len(LABELERS) + (kind * len(FEATURES) + j) * LEVELS + x for j, x in enumerate(f)]


N_WEIGHTS = len(KINDS) + 2 * len(LABELERS) + len(KINDS) * len(FEATURES) * LEVELS


def train(counts: list[tuple[int, tuple[int, ...], tuple[int, ...], int]], steps: int = 400, rate: float = 0.5) -> list[float]:
    """Weights of the classifier, as ``_encoded`` numbers them. Soft targets from the votes' posteriors; a pattern weighs the log of its count."""
    import numpy as np

    votes: dict[tuple[int, tuple[int, ...]], int] = {}
    for k, v, _, n in counts:
        votes[k, v] = votes.get((k, v), 0) + n
    posterior = estimate(sorted((k, v, n) for (k, v), n in votes.items()))
    w = np.zeros(N_WEIGHTS)
    if not counts:
        return w.tolist()
    x = np.zeros((len(counts), N_WEIGHTS))
    for i, (k, v, f, _) in enumerate(counts):
        x[i, _encoded(k, v, f)] = 1
    target = np.array([posterior[k, v] for k, v, _, _ in counts])
    weight = np.log1p([n for *_, n in counts])
    weight /= weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w -= rate * 4 * (x.T @ (weight * (p - target)) + 1e-3 * w)
    return [round(float(a), 6) for a in w]


def fit(cands: DataFrame) -> list[float]:
    """Weights from all candidates; only counts of equal patterns come to the driver."""
    x = cands.select(F.explode("cands").alias("x")).groupBy("x.kind", "x.v", "x.f").count().collect()
    return train(sorted((r[0], tuple(r[1]), tuple(r[2]), r[3]) for r in x))


def accepted(weights: list[float]) -> Column:
    """cands without those that are neither base nor over THRESHOLD, sorted; what overlaps a base span or an earlier one goes."""
    n, labelers, features = len(KINDS), len(LABELERS), len(FEATURES)
    cut = math.log(THRESHOLD / (1 - THRESHOLD))
    table_ = F.array(*[F.lit(a) for a in weights])

    def score(x):
        out = F.get(table_, x["kind"])
        for j in range(labelers):
            vote = F.get(x["v"], F.lit(j))
            out = out + F.when(vote == 1, weights[n + 2 * j]).when(vote == -1, weights[n + 2 * j + 1]).otherwise(0.0)
        for j in range(features):
            out = out + F.get(table_, F.lit(n + 2 * labelers) + (x["kind"] * features + j) * LEVELS + F.get(x["f"], F.lit(j)))
        return out

    base = F.filter("cands", lambda x: x["base"])
    more = F.filter("cands", lambda x: ~x["base"] & (score(x) > cut))
    more = F.filter(more, lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    span = lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"), x["base"].alias("base"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<s:int,kind:int,e:int,base:boolean>>").alias("out"))
    first = lambda a, x: F.when(a["end"] <= x["s"], F.struct(x["e"].alias("end"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a)
    more = F.aggregate(F.array_sort(F.transform(more, span)), start, first)["out"]
    return F.array_sort(F.concat(F.transform(base, span), more))


def said(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): spans is array<struct<s, kind, e, base>>, sorted."""
    cands = written(with_candidates(docs.select(F.col(key).alias("key"), text), text).select("key", "cands"), "pii-candidates")
    return cands.select("key", accepted(fit(cands)).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets; where spans of two kinds overlap they merge under the first's name."""
    # The caller's columns travel in one struct, so that no name clashes; texts are searched once.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(text).alias("text"))
    found = with_candidates(packed, "text").select("own", "cands")
    found = written(found, "pii-found")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    spans = found.select("own", accepted(fit(found.select("cands"))).alias("spans"))
    t = F.col("own").getField(text)

    def add(acc, x):
        fresh = F.array(F.substring(t, acc["at"] + 1, x["s"] - acc["at"]), F.element_at(names, x["kind"] + 1))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], F.concat(acc["out"], fresh)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("spans", start, add, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))))
    cleaned = F.when(F.size("spans") > 0, done).otherwise(t)
    return spans.select(*[cleaned.alias(c) if c == text else F.col("own").getField(c).alias(c) for c in docs.columns])


def op1_weak_pii(spark, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])

    def count(i):
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == F.lit(i)))).cast("long")

    return found.select(F.col("key").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
