"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from the four fixed patterns below (email, ip, card, phone), leftmost and non-overlapping for each
kind; matches that fail their check are dropped.  The method adds spans: addresses spelled with (at) and [dot], ip numbers with
guarded dots, cards in a row of digits that fails as a whole or with other separators, phones without a plus.  Loose patterns give
candidates; four labelers vote on each (1 for, -1 against, 0 abstains): the strict pattern with its check, a gazetteer (top-level
domains, card issuers, address ranges, area codes), the words to the left, and the shape.  Votes are counted by pattern;
expectation-maximisation over the counts estimates for each kind the prior and every labeler's reliability.  The posteriors train
the span classifier, a log-linear model over length, share of digits, neighbouring characters, check, gazetteer, the hashed
word before and the hashed shape.  Counts by kind, votes, feature and value are all that is collected, at most
4 * 3**4 * (number of feature values) rows.  A candidate is added where the classifier's posterior reaches ACCEPT and it overlaps
no base span.

Candidates stay in an array beside the base spans of their document, so there is one scan of the texts and no join;
what is collected is the table of counts.

Patterns are written possessively and start only where a match can start, so they take time linear in the text; they
match what the fixed patterns match.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; repeated rows get equal
results; an empty table gives no rows; without candidates nothing is added.  Columns of the input stay;
``base`` and ``added`` replace columns of those names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")

#: The fixed patterns, in possessive form.
_LOCAL = "[A-Za-z0-9._%+-]"
_START = rf"(?:\G|(?<!{_LOCAL}))"
STRICT = {
    "email": rf"{_START}{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates.
LOOSE_EMAIL = rf"{_START}{_LOCAL}++(?:@|\x20?\(at\)\x20?|\x20?\[at\]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++"
LOOSE_NUMBER = r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().-]{0,2}+[0-9])++(?![0-9A-Za-z])"
LOOSE_CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20.-][0-9]{4}){3}|3[0-9]{3}[\x20.-][0-9]{6}[\x20.-][0-9]{5})(?![0-9])"
_DOT = r"(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?|\x20dot\x20)"
LOOSE_IP = rf"(?<![0-9])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}(?![0-9])"

#: Gazetteers (fixed values).
TOP_LEVEL = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ca|ch|at|it|nl"
ISSUERS = "^(?:4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|35|6011|65)"
CUES = {
    "email": ("mail|contact|write|reach|send", "version"),
    "ip": (r"\bip\b|host|server|addr|ping|login", r"version|section|release|chapter"),
    "card": ("card|visa|credit|debit|amex|account|pay", "isbn|order|invoice|serial|sha"),
    "phone": ("call|phone|tel|fax|mobile|cell|whatsapp|dial|ring", "isbn|order|invoice|version|serial|sha"),
}
LEFT = 24
ROUNDS = 40
ACCEPT = 0.5

_SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once."""
    return F.transform(F.array(value), body)[0]


def located(text: Column, pattern: str, guard: Column) -> Column:
    """Matches with their offsets, the characters before and the character after, where ``guard`` says that there can be any.

    Splitting by the pattern gives the texts between the matches, and their lengths give the offsets.
    """
    none = F.array().cast(_SPAN)
    found = F.when(guard, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))

    def places(hits: Column) -> Column:
        def walk(between: Column) -> Column:
            def step(state: Column, i: Column) -> Column:
                start = state["at"] + F.char_length(F.get(between, i))
                end = start + F.char_length(F.get(hits, i))
                here = F.struct(start.alias("start"), end.alias("end"), F.get(hits, i).alias("value"), F.right(F.get(between, i), F.lit(LEFT)).alias("left"), F.left(F.get(between, i + 1), F.lit(1)).alias("right"))
                return F.struct(end.alias("at"), F.concat(state["out"], F.array(here)).alias("out"))

            first = F.struct(F.lit(0).alias("at"), none.alias("out"))
            return F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), first, step, lambda s: s["out"])

        return F.when(F.size(hits) == 0, none).otherwise(bound(F.split(text, pattern, -1), walk))

    return bound(found, places)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""

    def add(total: Column, i: Column) -> Column:
        x = F.substr(d, F.length(d) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


def octets(value: Column) -> Column:
    """Whether every part is at most 255, leading zeros aside."""
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substr(p, F.lit(1), F.lit(3)).cast("int") <= 255))


def passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets(value)
    n = F.length(digits(value))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), bound(digits(value), luhn)).otherwise(False)


def base_spans(text: Column) -> Column:
    """array<struct<kind:int, start:int, end:int>> by kind, then start."""
    digit = text.rlike("[0-9]")
    guards = {"email": F.contains(text, F.lit("@")), "ip": digit & F.contains(text, F.lit(".")), "card": digit, "phone": digit & F.contains(text, F.lit("+"))}

    def spans(k: int, kind: str) -> Column:
        good = F.filter(located(text, STRICT[kind], guards[kind]), lambda s: passes(kind, s["value"]))
        return F.transform(good, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*(spans(k, kind) for k, kind in enumerate(KINDS)))


def _vote(yes: Column, no: Column | None = None) -> Column:
    against = F.lit(0) if no is None else F.when(no, -1).otherwise(0)
    return F.when(yes, 1).otherwise(against)


def _votes(kind: str, s: Column) -> list[Column]:
    """Strict pattern and check, gazetteer, context and shape on candidate ``s``."""
    v, d, left = s["value"], digits(s["value"]), F.lower(s["left"])
    n = F.length(d)
    if kind == "email":
        host = F.regexp_extract(F.lower(v), r"([a-z0-9-]+)$", 1)
        strict = _vote(v.rlike(rf"^{_LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"))
        known = _vote(host.rlike(f"^(?:{TOP_LEVEL})$"), F.lit(True))
        shape = _vote(v.rlike(r"^.{2,40}(?:@|at)") & host.rlike("[a-z]"), ~host.rlike("[a-z]"))
    elif kind == "ip":
        dotted = F.regexp_replace(v, "[^0-9]+", ".")
        strict = _vote(octets(dotted), F.lit(True))
        known = _vote(dotted.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\."), dotted.rlike(r"^(?:0|22[4-9]|2[3-9][0-9])"))
        shape = _vote(~dotted.rlike(r"(?:^|\.)0[0-9]"), dotted.rlike(r"(?:^|\.)0[0-9]"))
    elif kind == "card":
        strict = _vote(bound(d, luhn), F.lit(True))
        known = _vote(d.rlike(ISSUERS), F.lit(True))
        shape = _vote(n.isin(15, 16) | v.rlike("[^0-9]"))
    else:
        strict = _vote(v.startswith("+") & n.between(9, 15))
        known = _vote(v.rlike(r"^(?:\+[1-9][0-9]{0,2}[\x20.-]?)?\(?[2-9][0-9]{2}\)?[\x20.-]"), F.lit(True))
        shape = _vote(v.rlike(r"[0-9][\x20().-]+[0-9]+[\x20().-]+[0-9]") & n.between(9, 15), F.lit(True))
    context = _vote(left.rlike(CUES[kind][0]), left.rlike(CUES[kind][1]))
    return [x.cast("int") for x in (strict, known, context, shape)]


#: Values of the classifier's features: length, share of digits, character before and after, check, gazetteer, word before, shape.
_FEATURES = (8, 4, 3, 3, 3, 3, 64, 64)


def _features(s: Column, votes: list[Column]) -> Column:
    size = F.greatest(F.length(s["value"]), F.lit(1))
    side = lambda c: F.when(c.rlike(r"^\s?$"), 0).when(c.rlike(r"^[\p{L}0-9]$"), 2).otherwise(1)
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(64))
    word = F.regexp_extract(F.lower(s["left"]), r"(\p{L}*)[^\p{L}]*$", 1)
    shape = F.regexp_replace(F.regexp_replace(s["value"], "[A-Za-z]+", "a"), "[0-9]+", "9")
    cells = (F.least(F.lit(7), F.floor(size / 4)), F.least(F.lit(3), F.floor(F.length(digits(s["value"])) * 4 / size)), side(F.right(s["left"], F.lit(1))), side(s["right"]), votes[0] + 1, votes[1] + 1, hashed(word), hashed(shape))
    return F.array(*(c.cast("int") for c in cells))


def candidates(text: Column) -> Column:
    """Loose matches with kind, offsets, votes and features."""
    digit = text.rlike("[0-9]")
    hidden = F.contains(text, F.lit("@")) | text.rlike(r"[(\[]at[)\]]|\x20dot\x20")
    guarded = digit & text.rlike(r"[0-9]\x20?[(\[](?:\.|dot)[)\]]|[0-9]\x20dot\x20[0-9]")

    def found(kind: str, pattern: str, guard: Column, keep: Callable[[Column], Column]) -> Column:
        def judged(s: Column) -> Column:
            votes = _votes(kind, s)
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *(x.alias(f"v{i}") for i, x in enumerate(votes)), _features(s, votes).alias("f"))

        return F.transform(F.filter(located(text, pattern, guard), keep), judged)

    dotted = r"^[0-9]+(?:\.[0-9]+){3}$"
    # A phone has separators or a leading mark; plain runs of digits are no candidates.
    phone = lambda s: F.length(digits(s["value"])).between(9, 15) & s["value"].rlike("[^0-9]") & ~s["value"].rlike(dotted) & ~s["value"].rlike(f"^{LOOSE_CARD}$")
    plain = lambda _: F.lit(True)
    return F.concat(
        found("email", LOOSE_EMAIL, hidden, plain), found("ip", LOOSE_IP, guarded, plain), found("ip", STRICT["ip"], digit & F.contains(text, F.lit(".")), plain),
        found("card", LOOSE_CARD, digit, plain), found("phone", LOOSE_NUMBER, digit, phone),
    )


def reliabilities(counts: dict[tuple[int, ...], float], rounds: int = ROUNDS) -> tuple[dict, dict]:
    """EM for one kind over counts by votes: posteriors by votes, and (prior, P(vote | real), P(vote | not))."""
    votes = (-1, 0, 1)
    post = {v: min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v in counts}
    total = sum(counts.values())
    out = {}
    for _ in range(rounds):
        real = sum(n * post[v] for v, n in counts.items())
        prior = (real + 1) / (total + 2)
        tables = []
        for truth, mass in ((1, real), (0, total - real)):
            tables.append([
                {x: (sum(n * (post[v] if truth else 1 - post[v]) for v, n in counts.items() if v[i] == x) + 1) / (mass + 3) for x in votes}
                for i in range(len(next(iter(counts))))
            ])
        for v in counts:
            a = math.log(prior) + sum(math.log(tables[0][i][x]) for i, x in enumerate(v))
            b = math.log(1 - prior) + sum(math.log(tables[1][i][x]) for i, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(max(-50.0, min(50.0, b - a))))
        out = {"prior": prior, "real": tables[0], "not": tables[1]}
    return post, out


def span_classifier(counts: dict[tuple[int, int], dict[bool, float]], mass: dict[bool, float]) -> tuple[float, list[list[float]]]:
    """Log-linear weights (bias, by feature and value) from expected counts of real and other spans by (feature, value)."""
    bias = math.log((mass[True] + 1) / (mass[False] + 1))
    weights = []
    for j, size in enumerate(_FEATURES):
        row = []
        for x in range(size):
            n = counts.get((j, x), {True: 0.0, False: 0.0})
            row.append(math.log((n[True] + 1) / (mass[True] + size)) - math.log((n[False] + 1) / (mass[False] + size)))
        weights.append(row)
    return bias, weights


def learn(found: DataFrame) -> dict[int, tuple[float, list[list[float]]]]:
    """Classifier weights by kind from the candidates of all documents."""
    votes = [f"v{i}" for i in range(4)]
    rows = found.select(F.inline("candidates")).select("kind", *votes, F.posexplode("f").alias("j", "x"))
    table = rows.groupBy("kind", *votes, "j", "x").count().collect()
    out = {}
    for k in range(len(KINDS)):
        mine = [(tuple(r[v] for v in votes), r["j"], r["x"], float(r["count"])) for r in table if r["kind"] == k]
        if not mine:
            continue
        by: dict[tuple[int, ...], float] = {}
        for v, j, _, n in sorted(mine):
            by[v] = by.get(v, 0.0) + n * (j == 0)
        post, _ = reliabilities(by)
        counts: dict[tuple[int, int], dict[bool, float]] = {}
        for v, j, x, n in sorted(mine):
            cell = counts.setdefault((j, x), {True: 0.0, False: 0.0})
            cell[True] += n * post[v]
            cell[False] += n * (1 - post[v])
        real = sum(n * post[v] for v, n in sorted(by.items()))
        out[k] = span_classifier(counts, {True: real, False: sum(by.values()) - real})
    return out


def _accepted(weights: dict[int, tuple[float, list[list[float]]]]) -> Callable[[Column], Column]:
    def one(s: Column) -> Column:
        score = F.lit(-50.0)
        for k, (bias, w) in weights.items():
            table = lambda row: F.array(*(F.lit(float(x)) for x in row))
            z = sum((F.get(table(row), F.get(s["f"], F.lit(j))) for j, row in enumerate(w)), F.lit(bias))
            score = F.when(s["kind"] == k, z).otherwise(score)
        return score >= math.log(ACCEPT / (1 - ACCEPT))

    return one


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with base and added: arrays of (kind, start, end)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.drop("base", "added", "candidates").withColumns({"base": base_spans(text), "candidates": candidates(text)}).drop("text")
    found = common.stored(found, "spans")
    fresh = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    added = F.filter(fresh, _accepted(learn(found)))
    return found.withColumn("added", F.transform(added, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))).drop("candidates")


def span_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
