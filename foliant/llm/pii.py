"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them.

Only DataFrame functions are used.  Patterns propose spans: the strict ones of the
contract (whose valid matches always stay) and looser ones, also for US social security
numbers and for secrets such as access tokens.  Six labelers vote 1, 0 or
-1 on each: pattern and checksum, shape, a gazetteer of prefixes and endings, words
before it that speak for or against it, and its edges.  Counts of the vote patterns over
the whole corpus are a table of at most kinds x 3**6 rows; in it expectation-maximisation
finds, by one SQL fold for each kind, how reliable each labeler is.  (Two are given, not
learned: nine of ten numbers that are no card fail the check, and a word such as "commit"
before a number names what it is.)  The resulting
probabilities are the soft labels from which a naive Bayes span classifier over votes
and surface features is fitted, again by counting over the whole corpus.  That classifier
alone decides which further spans are added.

Positions are code points, end exclusive.  Defined cases: a null or empty text has no
span; rows that repeat are judged alone; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, texts

KINDS = ["email", "ip", "card", "phone"]
#: Patterns of the contract; where a run is scanned once only, its start is given by \G or what is before it.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser proposals: the kind that they may be.
LOOSE = [
    ("email", r"(?i)\b[a-z0-9._-]{2,64} ?(?:\[at\]|\(at\)) ?[a-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)) ?[a-z]{2,24}){1,3}\b"),
    ("phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,199}[0-9])(?=[0-9+/_-]{0,199}[A-Za-z])[A-Za-z0-9+/_-]{20,200}(?![A-Za-z0-9+/_-])"),
]
#: What must be in a text for a loose pattern to be tried.
_HINT = {"email": r"(?i)[\[(]at[\])]", "phone": r"[0-9]{3}[ .-][0-9]{4}", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "secret": r"[A-Za-z0-9+/_-]{20}"}

#: Gazetteers, and words that speak for or against a kind.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|dev|app|co|uk|de|fr|es|it|nl|eu|us|ca|au|ch|at|be|se|no|dk|fi|pl|pt|br|mx|jp|cn|in"
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
ISSUERS = "4|5[1-5]|2[2-7]|3[4-9]|6011|6[2-5]"
WORDS_FOR = {
    "email": r"e-?mail|contact|write|reach|mailto|from|to",
    "ip": r"ip|host|server|addr(?:ess)?|client|login|from",
    "card": r"card|visa|master ?card|amex|credit|debit|payment|pan",
    "phone": r"phone|tel|call|mobile|cell|fax|contact|whatsapp|sms",
    "ssn": r"ssn|social|security|tax|id",
    "secret": r"tokens?|secret|(?:api|access|private)[_-]?key|key|password|passwd|pwd|auth|bearer|credentials?",
}
WORDS_AGAINST = r"version|release|build|isbn|issn|order|invoice|serial|model|figure|fig|table|page|section|doi|part|lot|sku"
DIGESTS = r"sha-?(?:1|256|512)?|md5|commit|digest|checksum|hash|etag|revision"
KEYS = r"AKIA|ASIA|gh[pousr]_|glpat-|sk[_-]|pk_|xox[abprs]-|AIza|ya29|eyJ"

LABELERS, ROUNDS, ACCEPT = 6, 20, 0.9
#: Log-odds of the votes -1, 0 and 1 that are given: of pattern and checksum, and of words that speak against a kind.
GIVEN = "map(0, array(-4D, 0D, 4D), 4, array(-3D, 0D, 0D))"
ALL_KINDS = [*KINDS, "ssn", "secret"]
#: Kinds that may be one pattern's: how much each vote weighs at first.
_CONTEXT = 32


def luhn(digits: Column) -> Column:
    """Whether the digits pass the check: every second one from the right counts double."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substr(digits, n - i, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    size = F.length(_digits(match))
    if kind == "card":
        return F.when(size.between(13, 19), luhn(_digits(match))).otherwise(False)
    return size.between(9, 15)


def _found(text: Column, pattern: str, wanted: Column, keep) -> Column:
    """array<struct(start, end, match, before, after)> of the matches that `keep` wants, leftmost first."""
    kind = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.split(text, pattern, -1)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        span = F.struct(
            start.cast("int").alias("start"),
            end.cast("int").alias("end"),
            x["match"].alias("match"),
            F.right(x["piece"], F.lit(_CONTEXT)).alias("before"),
            F.left(x["next"], F.lit(1)).alias("after"),
        )
        return F.struct(end.cast("int").alias("at"), F.when(keep(x["match"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    rows = F.zip_with(
        F.arrays_zip(pieces.alias("piece"), matches.alias("match")),
        F.slice(pieces, F.lit(2), F.size(pieces)),
        lambda a, b: F.struct(a["piece"].alias("piece"), a["match"].alias("match"), b.alias("next")),
    )
    rows = F.filter(rows, lambda x: x["match"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))
    return F.when(wanted, F.aggregate(rows, start, step, lambda s: s["spans"])).otherwise(F.array().cast(kind))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def _votes(kind: str, strict: Column, s: Column) -> Column:
    """The six labelers' votes on a span."""
    m, digits = s["match"], _digits(s["match"])
    size = F.length(digits)
    checked = valid(kind, m) if kind in KINDS else F.lit(False)
    pattern = F.when(strict, F.when(checked, 1).otherwise(-1)).otherwise(0).cast("int")
    if kind == "email":
        shape = _vote(F.length(m).between(6, 64), F.length(m) > 128)
        listed = m.rlike(rf"(?i)(?:{DOMAINS})$")
        unlisted = ~listed
    elif kind == "ip":
        shape = _vote(~m.rlike(r"(?:^|\.)0[0-9]"), m.rlike(r"(?:^|\.)0[0-9]"))
        listed = checked & ~m.rlike(r"^(?:0|255)\.")
        unlisted = ~listed
    elif kind == "card":
        shape = _vote(m.rlike(r"^(?:[0-9]{13,16}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"), m.rlike(r"[ -][0-9]{1,2}[ -]"))
        listed = digits.rlike(rf"^(?:{ISSUERS})")
        unlisted = ~listed
    elif kind == "phone":
        shape = _vote(m.rlike(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), size < 7)
        listed = F.when(F.startswith(m, F.lit("+")), digits.rlike(rf"^(?:{CALLING})")).otherwise(digits.rlike(r"^[2-9][0-9]{2}[2-9]"))
        unlisted = ~listed
    elif kind == "ssn":
        shape = _vote(size == 9, size != 9)
        listed = ~m.rlike(r"^(?:000|666|9)") & ~m.rlike(r"-00-|-0000$")
        unlisted = ~listed
    else:
        shape = _vote(m.rlike(r"^(?:(?:[0-9a-f]{32}|[0-9A-F]{32})(?:[0-9a-fA-F]{8}|[0-9a-fA-F]{32})?|[A-Za-z0-9]{20,64})$"), m.rlike(r"[/_-][^/_-]*[/_-][^/_-]*[/_-]"))
        listed = m.rlike(rf"^(?:{KEYS})")
        unlisted = F.lit(False)
    context = _vote(s["before"].rlike(rf"(?i)\b(?:{WORDS_FOR[kind]})\b[^\n]{{0,12}}$"), F.lit(False))
    words = DIGESTS if kind == "secret" else WORDS_AGAINST
    against = _vote(F.lit(False), s["before"].rlike(rf"(?i)\b(?:{words})\b[^\n]{{0,8}}$"))
    clear = s["before"].rlike(r"(?:^|[^A-Za-z0-9_.@/-])$") & s["after"].rlike(r"^(?:$|[^A-Za-z0-9_@/-])")
    return F.array(pattern, shape, _vote(listed, unlisted), context, against, _vote(clear, ~clear))


def _features(s: Column) -> Column:
    """Surface features with few values each."""
    size = F.length(_digits(s["match"]))
    return F.array(
        F.concat(F.lit("digits"), F.least(size, F.lit(20)).cast("string")),
        F.concat(F.lit("length"), F.least(F.length(s["match"]), F.lit(40)).cast("string")),
        F.concat(F.lit("mark"), F.regexp_extract(s["match"], r"[^A-Za-z0-9]", 0)),
        F.concat(F.lit("before"), F.regexp_replace(F.right(s["before"], F.lit(1)), r"[A-Za-z0-9]", "a")),
        F.concat(F.lit("after"), F.regexp_replace(s["after"], r"[A-Za-z0-9]", "a")),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, the valid strict spans of each kind, and all proposals with votes and features."""
    docs = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("numeric", F.col("text").rlike("[0-9]"))
    wanted = {"email": F.contains("text", F.lit("@")), "ip": F.col("numeric"), "card": F.col("numeric"), "phone": F.contains("text", F.lit("+"))}
    anyway = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: F.lit(True),
        "card": lambda m: F.length(_digits(m)).between(13, 19),
        "phone": lambda m: F.length(_digits(m)).between(7, 18),
    }
    table = docs.select("doc_id", "text", *[_found(F.col("text"), STRICT[k], wanted[k], anyway[k]).alias(f"s_{k}") for k in KINDS])
    table = table.select("*", *[_found(F.col("text"), p, F.col("text").rlike(_HINT[k]), lambda m: F.lit(True)).alias(f"l_{k}") for k, p in LOOSE]).drop("text")

    def judged(column: str, kind: str, strict: bool) -> Column:
        return F.transform(
            column,
            lambda s: F.struct(
                F.lit(kind).alias("kind"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                (F.lit(strict) & (valid(kind, s["match"]) if strict else F.lit(False))).alias("base"),
                _votes(kind, F.lit(strict), s).alias("votes"),
                _features(s).alias("features"),
            ),
        )

    every = [judged(f"s_{k}", k, True) for k in KINDS] + [judged(f"l_{k}", k, False) for k, _ in LOOSE]
    return table.select("doc_id", F.concat(*every).alias("spans"))


#: One kind's patterns, an array of struct(votes, n), to labeler log-odds and the prior's, by expectation-maximisation.
_EM = f"""
aggregate(sequence(1, {ROUNDS}),
  named_struct('prior', 0D, 'odds', transform(sequence(0, {LABELERS - 1}), j -> coalesce(try_element_at({GIVEN}, j), array(-1D, 0D, 1D)))),
  (s, i) -> transform(array(
      transform(patterns, p -> named_struct('votes', p.votes, 'n', p.n, 'q',
        1D / (1D + exp(-(s.prior + aggregate(sequence(0, {LABELERS - 1}), 0D, (t, j) -> t + s.odds[j][p.votes[j] + 1]))))))
    ), post -> named_struct(
      'prior', ln((aggregate(post, 0D, (t, p) -> t + p.n * p.q) + 1D) / (aggregate(post, 0D, (t, p) -> t + p.n * (1D - p.q)) + 1D)),
      'odds', transform(sequence(0, {LABELERS - 1}), j -> coalesce(try_element_at({GIVEN}, j), transform(sequence(-1, 1), v ->
        ln((aggregate(post, 0D, (t, p) -> t + if(p.votes[j] = v, p.n * p.q, 0D)) + 1D) / (aggregate(post, 0D, (t, p) -> t + p.n * p.q) + 3D))
        - ln((aggregate(post, 0D, (t, p) -> t + if(p.votes[j] = v, p.n * (1D - p.q), 0D)) + 1D) / (aggregate(post, 0D, (t, p) -> t + p.n * (1D - p.q)) + 3D))))))
  )[0])
"""


def reliabilities(spans: DataFrame) -> DataFrame:
    """kind, model: struct(prior, odds[labeler][vote + 1]); one row for each kind."""
    patterns = spans.groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n"))
    by_kind = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    return by_kind.select("kind", F.expr(_EM).alias("model"))


def _posterior(models: list, kind: Column, votes: Column) -> Column:
    """The label model's probability of a span, with its few numbers as constants."""
    out = F.lit(0.5)
    for row in models:
        odds = F.array(*[F.array(*[F.lit(float(x)) for x in o]) for o in row["model"]["odds"]])
        total = reduce(lambda a, b: a + b, [F.get(F.get(odds, F.lit(j)), F.get(votes, F.lit(j)) + 1) for j in range(LABELERS)])
        out = F.when(kind == row["kind"], 1.0 / (1.0 + F.exp(-(F.lit(float(row["model"]["prior"])) + total)))).otherwise(out)
    return out


def _evidence(votes: Column, features: Column) -> Column:
    return F.concat(F.transform(votes, lambda v, i: F.concat_ws("", F.lit("vote"), i.cast("string"), F.lit("="), v.cast("string"))), features)


def classifier(spans: DataFrame, models: list) -> dict[str, float]:
    """Log-odds for kind, and for kind and feature value, from soft labels over all spans."""
    soft = spans.select("kind", _posterior(models, F.col("kind"), F.col("votes")).alias("q"), _evidence(F.col("votes"), F.col("features")).alias("evidence"))
    each = soft.select("kind", "q", F.explode(F.array_append("evidence", F.lit(""))).alias("feature"))
    sums = each.groupBy("kind", "feature").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")).collect()
    total = {r["kind"]: (r["yes"], r["no"]) for r in sums if not r["feature"]}
    out = {f"{k}|": math.log((yes + 1) / (no + 1)) for k, (yes, no) in total.items()}
    for r in sums:
        if r["feature"]:
            yes, no = total[r["kind"]]
            out[f"{r['kind']}|{r['feature']}"] = math.log((r["yes"] + 1) / (yes + 2)) - math.log((r["no"] + 1) / (no + 2))
    return out


def find_pii(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    table = cut(candidates(docs))
    spans = table.select(F.explode("spans").alias("s")).select("s.*")
    models = reliabilities(spans).collect()  # one row for each kind
    odds = classifier(spans, models)  # a few values for each kind
    weights = F.create_map(*[x for k, v in sorted(odds.items()) for x in (F.lit(k), F.lit(v))]) if odds else F.create_map(F.lit("|"), F.lit(0.0))

    def score(s: Column) -> Column:
        names = F.array_append(_evidence(s["votes"], s["features"]), F.lit(""))
        total = F.aggregate(names, F.lit(0.0), lambda t, x: t + F.coalesce(F.element_at(weights, F.concat(s["kind"], F.lit("|"), x)), F.lit(0.0)))
        return F.when(s["base"], F.lit(1.0)).otherwise(1 / (1 + F.exp(-total)))

    rank = F.create_map(*[x for i, k in enumerate(ALL_KINDS) for x in (F.lit(k), F.lit(i))])

    def ranked(s: Column) -> Column:
        return F.struct(F.element_at(rank, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"), score(s).alias("score"))

    ordered = F.array_sort(F.transform("spans", ranked))
    table = table.select("doc_id", ordered.alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    fresh = lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    table = table.withColumn("base", base)
    table = table.withColumn("final", F.filter("spans", lambda s: s["base"] | ((s["score"] >= accept) & fresh(s))))
    of_kind = lambda k: lambda s: s["kind"] == k
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return table.select(
        "doc_id",
        *[F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        text(F.col("final")).alias("spans"),
        F.size("final").cast("long").alias("n_spans"),
    )
