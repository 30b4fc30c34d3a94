"""Mixing a corpus to target token weights of soft domains, in DataFrame operations.

1. A bounded sample of labelled rows (``SAMPLE_ROWS``, in the order of a hash of the
   id) trains a naive Bayes classifier: words that are typical of a domain are picked
   from document frequencies, and per domain the frequencies of binned features
   (symbol share, distinct word share, length, typical words of each domain) counted.
2. Every document gets its domain posteriors p.
3. Each document's rate r >= 0 is fitted so that the expected domain totals
   sum(r * tokens * p) match the targets: projected gradient least squares, with the
   residual of a domain weighted by one over its tokens and a document's step by one over
   its tokens. A step is ``r <- clip(r - p . g, 0, max_rate)``; it depends on the
   posteriors alone, so documents with equal posteriors are summed to one row first,
   and each round is one distributed sum over those rows.

Targets are shares of tokens. The total is set so that the ``anchor`` domain keeps its
tokens. ``copies`` is the rate rounded up or down by a hash of the id, with the rate as
its mean; rates within 1/1000 of a whole number are that number.

Cases: null and empty texts have no tokens; they get posteriors as any other and no
weight. Labels with a null id or domain are not used; repeated labels count
each. Without any labels all domains are equally likely. An empty corpus gives no rows.
A domain without tokens has no residual. Rates have no upper bound unless ``max_rate`` sets
one, as the pipeline does; a target that the bound does not allow is then lowered to what it
allows, which ``reached_totals`` shows. Null ids share one hash. Repeated rows get the
same rate. Extra columns are ignored, or carried by ``mixed_documents``.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlake.llm import query
from answerlake.llm.common import col, table
from answerlake.runtime import cut_lineage

SAMPLE_ROWS = 10_000
TYPICAL_WORDS, MIN_LIFT, MIN_SHARE, MIN_DOCS = 60, 4.0, 0.004, 3
MAX_ROUNDS, TOLERANCE = 40, 1e-6
BINS = 10
TARGETS = {"good": 0.93, "low": 0.06, "toxic": 0.01}
SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _sum(columns):
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def _let(value, body):
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _whole(text: str):
    return F.coalesce(col(text).cast("string"), F.lit(""))


def _words(text):
    """The words of a text, with a blank one before or after where the text's ends are no word."""
    return F.split(F.lower(text), SPLIT)


def _features(text, words, different, typical: dict):
    """n_tokens and one small number per feature, as one struct."""
    last = F.size(words)
    blank = (words[0] == "").cast("int") + F.when(
        last > 1, (F.element_at(words, -1) == "").cast("int")).otherwise(0)
    n_tokens, chars = (last - blank).cast("long"), F.char_length(text)
    symbols = chars - F.char_length(F.translate(text, "#*$%&|<>!", ""))

    def share(part, whole):
        return F.when(whole > 0, F.least(F.lit(BINS - 1), F.floor(BINS * part / whole))).otherwise(0).cast("int")

    features = [share(4 * symbols, chars), share(F.size(different), last),
                F.least(F.lit(BINS - 1), F.floor(F.log2(n_tokens + 1) * 0.75)).cast("int")]
    for own in typical.values():
        hits = F.size(F.array_intersect(different, F.array(*[F.lit(w) for w in own]))) if own else F.lit(0)
        features.append(F.least(F.lit(BINS - 1), hits).cast("int"))
    return F.struct(n_tokens.alias("n_tokens"), *[f.alias(f"f{i}") for i, f in enumerate(features)])


def _described(text, typical: dict):
    return _let(_words(text), lambda w: _let(F.array_distinct(w), lambda d: _features(text, w, d, typical)))


def _sample(labels: DataFrame, key: str, domain: str, rows: int) -> DataFrame:
    used = labels.select(col(key).alias("doc"), col(domain).cast("string").alias("domain")).dropna()
    return cut_lineage(used.orderBy(F.xxhash64("doc"), "doc", "domain").limit(rows), "sample")


def _typical_words(texts: DataFrame, sample: DataFrame, domains: list) -> dict:
    """Words of each domain whose document frequency is far above that of the others."""
    sized = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sized.values())
    counted = (texts.join(F.broadcast(sample), "doc")
               .select("domain", F.explode(F.array_distinct(_words("text"))).alias("word")).where("word <> ''")
               .groupBy("word").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}")
                                      for i, d in enumerate(domains)]))
    all_n = _sum([F.col(f"n{i}") for i in range(len(domains))])
    found = []
    for i, d in enumerate(domains):
        n = sized.get(d, 0)
        own, rest = (F.col(f"n{i}") + 0.5) / (n + 1), (all_n - F.col(f"n{i}") + 0.5) / (total - n + 1)
        found.append(F.when((F.col(f"n{i}") >= max(MIN_DOCS, MIN_SHARE * n)) & (own >= MIN_LIFT * rest),
                            F.col(f"n{i}") * F.log(own / rest)))
    scored = cut_lineage(counted.select("word", *[f.alias(f"s{i}") for i, f in enumerate(found)])
                         .where(F.coalesce(*[F.col(f"s{i}") for i in range(len(domains))]).isNotNull()), "words")
    return {d: [r["word"] for r in scored.where(F.col(f"s{i}").isNotNull())
                .orderBy(F.col(f"s{i}").desc(), "word").limit(TYPICAL_WORDS).collect()]
            for i, d in enumerate(domains)}


def _posteriors(features: DataFrame, sample: DataFrame, domains: list):
    """A function from a struct of features to the posteriors p0, p1, ... as a struct, from
    the bin frequencies of the sample."""
    names = [c for c in features.columns if c.startswith("f") and c[1:].isdigit()]
    stacked = ", ".join(f"{i}, {n}" for i, n in enumerate(names))
    rows = (features.select("doc", *names).join(F.broadcast(sample), "doc")
            .select("domain", F.expr(f"stack({len(names)}, {stacked}) AS (feature, bin)"))
            .groupBy("domain", "feature", "bin").agg(F.count(F.lit(1)).alias("n")).collect())
    n = {(r["domain"], r["feature"], r["bin"]): r["n"] for r in rows}
    size = {d: sum(v for (e, f, _), v in n.items() if e == d and f == 0) for d in domains}
    prior = [math.log((size[d] + 1) / (sum(size.values()) + len(domains))) for d in domains]
    tables = [[[math.log((n.get((d, f, b), 0) + 0.1) / (size[d] + 0.1 * BINS)) for b in range(BINS)]
               for f in range(len(names))] for d in domains]

    def posteriors(features):
        logs = F.array(*[_sum([F.lit(prior[i]), *[
            F.element_at(F.array(*[F.lit(x) for x in tables[i][f]]), features[name] + 1)
            for f, name in enumerate(names)]]) for i in range(len(domains))])
        scaled = lambda x: F.transform(x, lambda y: F.exp(y - F.array_max(x)))
        return _let(logs, lambda x: _let(scaled(x), lambda w: _let(
            F.aggregate(w, F.lit(0.0), lambda a, y: a + y),
            lambda total: F.struct(*[F.round(w[i] / total, 4).alias(f"p{i}") for i in range(len(domains))]))))

    return posteriors


def _rate(history: list, n_domains: int, max_rate: float, p=None):
    """The rate after the steps so far, from posteriors: a struct, or columns p0, p1, ..."""
    own = [F.col(f"p{d}") if p is None else p[f"p{d}"] for d in range(n_domains)]
    if not history:
        return F.lit(min(1.0, max_rate))
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in history])
    return F.aggregate(steps, F.lit(min(1.0, max_rate)), lambda r, g: F.least(
        F.lit(float(max_rate)), F.greatest(F.lit(0.0), r - _sum([own[d] * g[d] for d in range(n_domains)]))))


def _solve(matrix: list, right: list) -> list:
    """x of ``matrix x = right``, both small, by elimination with pivots."""
    k = len(right)
    rows = [[*matrix[i], right[i]] for i in range(k)]
    for i in range(k):
        best = max(range(i, k), key=lambda r: abs(rows[r][i]))
        rows[i], rows[best] = rows[best], rows[i]
        for r in range(k):
            if r != i:
                by = rows[r][i] / rows[i][i]
                rows[r] = [x - by * y for x, y in zip(rows[r], rows[i])]
    return [rows[i][k] / rows[i][i] for i in range(k)]


def _fit(scored: DataFrame, targets: dict, anchor: str, max_rate: float) -> list:
    """Steps of the projected gradient descent, as lists of a number per domain.

    Two aggregates a round: the domain totals at the present rates, and the second
    moments of the posteriors over rows that no bound holds back. The gradient is
    scaled with the inverse of those moments, and made smaller while it does not help.
    """
    domains, k = list(targets), len(targets)
    p = [f"p{d}" for d in range(k)]
    groups = cut_lineage(scored.groupBy(*p).agg(F.sum("n_tokens").cast("double").alias("tokens"))
                         .where(F.col("tokens") > 0), "groups")
    mass = [float(m or 0) for m in groups.agg(*[F.sum(F.col("tokens") * F.col(c)) for c in p]).first()]
    total = mass[domains.index(anchor)] / targets[anchor] if targets[anchor] else sum(mass)
    goal = [min(total * targets[d], m * max_rate) if m else 0.0 for d, m in zip(domains, mass)]

    def gaps(history):
        sums = groups.withColumn("rate", _rate(history, k, max_rate)).agg(
            *[F.sum(F.col("tokens") * F.col(c) * F.col("rate")) for c in p]).first()
        gap = [float(s or 0) - g for s, g in zip(sums, goal)]
        return sum(x * x / max(m, 1.0) for x, m in zip(gap, mass)), gap

    def moments(history, gap):
        rated = groups.withColumn("rate", _rate(history, k, max_rate)).withColumn(
            "down", _sum([F.col(c) * (x / max(m, 1.0)) for c, x, m in zip(p, gap, mass)]))
        free = F.when(((F.col("rate") < max_rate) | (F.col("down") > 0))
                      & ((F.col("rate") > 0) | (F.col("down") < 0)), F.col("tokens")).otherwise(0.0)
        found = rated.agg(*[F.sum(free * F.col(c) * F.col(e)) for c in p for e in p]).first()
        return [[float(found[i * k + j] or 0) + (1e-3 * mass[i] + 1e-9) * (i == j) for j in range(k)]
                for i in range(k)]

    history, scale = [], 1.0
    if not sum(mass):
        return history
    error, gap = gaps(history)
    step = _solve(moments(history, gap), gap)
    for _ in range(MAX_ROUNDS):
        if scale < 1e-2 or all(abs(x) <= TOLERANCE * sum(mass) for x in gap):
            break
        tried = [*history, [max(-2 * max_rate, min(2 * max_rate, scale * x)) for x in step]]
        found, found_gap = gaps(tried)
        if found < error:
            enough = found > error * (1 - 1e-4)
            history, error, gap, scale = tried, found, found_gap, min(1.0, 2 * scale)
            if enough:
                break
            step = _solve(moments(history, gap), gap)
        else:
            scale /= 4
    return history


def _copies(rate, doc, seed: int):
    chance = F.pmod(F.xxhash64(doc, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    return F.when(F.abs(rate - F.round(rate)) < 0.001, F.round(rate)).otherwise(
        F.floor(rate + chance)).cast("int")


def _model(docs, labels, targets, anchor, key, text, label_key, domain, sample_rows, max_rate):
    """Typical words, compact features of all documents, posteriors, and the steps of the fit."""
    domains = list(targets)
    sample = _sample(labels.where(col(domain).isin(domains)), label_key, domain, sample_rows)
    texts = docs.select(col(key).alias("doc"), _whole(text).alias("text"))
    typical = _typical_words(texts, sample, domains)
    features = cut_lineage(texts.select("doc", _described(F.col("text"), typical).alias("own"))
                           .select("doc", "own.*"), "features")
    posteriors = _posteriors(features, sample, domains)
    scored = features.select("n_tokens", posteriors(F.struct(*features.columns[2:])).alias("p"))
    history = _fit(scored.select("n_tokens", "p.*"), targets, anchor, max_rate)
    return typical, features, posteriors, history


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict, anchor: str, key: str = "doc_id",
                 text: str = "text", label_key: str = "doc_id", domain: str = "domain",
                 sample_rows: int = SAMPLE_ROWS, max_rate: float = math.inf, seed: int = 0) -> DataFrame:
    """Per document: key, n_tokens, p_<domain>, rate, copies."""
    domains = list(targets)
    _, features, posteriors, history = _model(docs, labels, targets, anchor, key, text, label_key, domain,
                                              sample_rows, max_rate)
    rated = features.select("doc", "n_tokens", _let(posteriors(F.struct(*features.columns[2:])), lambda p: F.struct(
        *[p[f"p{i}"].alias(f"p_{d}") for i, d in enumerate(domains)],
        F.round(_rate(history, len(domains), max_rate, p), 6).alias("rate"))).alias("own"))
    return (rated.select(F.col("doc").alias(key), "n_tokens", "own.*",
                         _copies(F.col("own.rate"), F.col("doc"), seed).alias("copies")))


def reached_totals(rates: DataFrame, targets: dict, anchor: str) -> DataFrame:
    """Per domain of ``mixing_rates``: the tokens asked for and those that the rates give."""
    own = lambda d: F.col("n_tokens") * col(f"p_{d}")
    sums = rates.agg(F.sum(own(anchor)).alias("anchor"), *[F.sum(own(d) * F.col("rate")).alias(f"r{i}") for i, d in enumerate(targets)])
    return sums.select(F.inline(F.array(*[F.struct(
        F.lit(d).alias("domain"), (F.col("anchor") * (share / targets[anchor])).alias("target"), F.col(f"r{i}").alias("reached"))
        for i, (d, share) in enumerate(targets.items())])))


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict, anchor: str, key: str = "doc_id",
                    text: str = "text", label_key: str = "doc_id", domain: str = "domain",
                    sample_rows: int = SAMPLE_ROWS, max_rate: float = 1.0, seed: int = 0) -> DataFrame:
    """The documents, each as often as ``copies`` says; same columns.

    The copies are computed from the text once more, so documents are neither shuffled
    nor stored.
    """
    typical, _, posteriors, history = _model(docs, labels, targets, anchor, key, text, label_key, domain,
                                             sample_rows, max_rate)
    copies = _let(_described(_whole(text), typical), lambda f: _let(posteriors(f), lambda p: _let(
        F.round(_rate(history, len(targets), max_rate, p), 6), lambda rate: _copies(rate, col(key), seed))))
    if max_rate <= 1:
        return docs.where(copies > 0)
    repeated = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), copies.alias("copies")).where("copies > 0")
    return repeated.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id and domain (toxic, low or good) of rows with both labels."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low")
                         .when(F.col("quality") == 1, "good").alias("domain"))


@query("op9_mixing_weights")
def op9(spark, sf_dir):
    return mixing_rates(table(spark, sf_dir, "documents"),
                        domain_labels(table(spark, sf_dir, "labels")), TARGETS, "good")
