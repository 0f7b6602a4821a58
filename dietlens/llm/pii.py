"""Personal data by weak supervision, by DataFrame and SQL functions only.

The base patterns with their checks give the base spans. Wider patterns give candidates: numbers, contacts written around the
at sign, and names. Regex, gazetteer and context labelers vote on each candidate (yes, no or nothing). Candidates are
counted by kind and votes; expectation-maximisation over these counts estimates how often each labeler votes how on personal and
on other spans, with candidates on base spans as known personal ones. The probabilities it gives weigh the candidates for a
naive Bayes classifier of form and surroundings, which is compiled into a projection. Base spans stay whatever it says.

What reaches the driver is one row per kind and votes (at most 3 * 3^6) and one per kind, feature and value (at most a few hundred).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dietlens.functions.text import let
from dietlens.llm.spans import digits, find_all, of_kind, passes_luhn
from dietlens.session import materialize, new_path, remove

# Fixed patterns of the contract. The look-behinds and possessive forms match the same and never read a run twice.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

# Wider patterns of the candidates. Groups repeated without a bound are possessive: others recurse once per repetition.
NUMBER = r"(?<![0-9A-Za-z])\+?\(?[0-9][0-9 ().-]{5,22}[0-9](?![0-9A-Za-z])"
CONTACT = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]+"
    r"(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[A-Za-z0-9-]++)++"
)
NAME = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}{1,20}+(?: \p{Lu}\p{Ll}{1,20}+){1,2}(?!\p{L})"
KINDS = ("number", "contact", "name")

# Gazetteers. Fixed values.
FIRST_NAMES = (
    "Anna Maria John James Mary Robert Patricia Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas "
    "Sarah Charles Karen Peter Paul Laura Emma Olivia Lucas Hans Klaus Jürgen Karl Heinz Ursula Monika Sabine Pierre Jean Marie "
    "Camille Luc Claire Hélène François José Juan Carlos Luis Miguel Carmen Lucía Pablo Javier Ana Sofia Daniel Martin Julia Sophie"
).split()
TOP_LEVELS = "com org net edu gov info biz io co de fr es it nl eu uk us ca ch at".split()
CUES = {
    "number": r"(?i)(?:phone|tel|call|mobile|cell|fax|ssn|social security|passport|card|account|konto|iban|teléfono|téléphone|telefon)\W{0,4}(?:no|number|is|#)?\W{0,4}$",
    "contact": r"(?i)(?:mail|contact|write to|reach|kontakt|correo|courriel)\W{0,6}$",
    "name": r"(?i)(?:\bmr|\bmrs|\bms|\bdr|\bprof|\bname|\bname is|\bdear|\bsigned|\bherr|\bfrau|\bmme|\bsra?|\bseñora?)\W{0,3}$",
}
OTHER_CUES = r"(?i)(?:version|isbn|issn|invoice|order|page|item|price|token|hash|license|build|no\.|§|\$|€)\W{0,4}$"

CONTEXT = 32
ROUNDS = 50
#: Least probability by the votes, and by the classifier, of a span that is added.
VOTED, SURE = 0.9, 0.9


def _ip(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda p: F.coalesce(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.lit(False)) & (F.concat(F.lit("0"), F.right(p, F.lit(3))).cast("int") <= 255))


def base_spans(text: Column) -> Column:
    """Array of (kind, rank, start, end) of the base patterns whose matches pass their checks."""

    def card(t: Column) -> Column:
        return let(digits(t), lambda d: F.length(d).between(12, 19) & F.when(F.length(d) <= 19, passes_luhn(d)).otherwise(False))

    checks = (
        ("email", EMAIL, lambda t: F.lit(True)),
        ("ip", IP, _ip),
        ("card", CARD, card),
        ("phone", PHONE, lambda t: F.length(digits(t)).between(9, 15)),
    )
    return F.concat(*[
        of_kind(F.filter(find_all(text, pattern), lambda s: check(s["text"])), kind, rank)
        for rank, (kind, pattern, check) in enumerate(checks)
    ])


def _vote(yes: Column | None = None, no: Column | None = None) -> Column:
    out = F.when(F.lit(False), "")
    if yes is not None:
        out = out.when(yes, "1")
    if no is not None:
        out = out.when(no, "0")
    return out.otherwise("-")


def votes(c: Column, kind: str) -> Column:
    """One character per labeler: 1 yes, 0 no, - nothing."""
    text, before = c["text"], c["before"]
    cue = _vote(before.rlike(CUES[kind]))
    other = _vote(None, before.rlike(OTHER_CUES))
    if kind == "number":
        number = digits(text)
        luhn = F.length(number).between(13, 19) & F.when(F.length(number) <= 24, passes_luhn(number)).otherwise(False)
        form = _vote(text.rlike(r"^(?:\+?1[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$") | luhn, text.rlike(r"^[0-9]+$"))
        unlike = _vote(None, text.rlike(r"^[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}$|[0-9]\.[0-9]+\.[0-9]+\.[0-9]+|0{5}"))
        listed = _vote(text.rlike(r"^\+[1-9]"), F.length(F.array_join(F.array_distinct(F.split(number, "")), "")) <= 2)
        alone = _vote(None, c["after"].rlike(r"^[%$€.][0-9]"))
    elif kind == "contact":
        form = _vote(text.rlike(r"[A-Za-z]{2,}$") & ~text.rlike(r"\. "), text.rlike(r"\. [A-Z]"))
        unlike = _vote(None, text.rlike(r"^[.%+-]|\.\."))
        last = F.lower(F.regexp_extract(text, r"([A-Za-z0-9-]+)$", 1))
        listed = _vote(last.isin(TOP_LEVELS), ~last.isin(TOP_LEVELS))
        alone = _vote(c["after"].rlike(r"^(?:[\s.,;:!?)>\]\"']|$)"), c["after"].rlike(r"^[@/\w]"))
    else:
        first = F.regexp_extract(text, r"^(\p{L}+)", 1)
        form = _vote(None, text.rlike(r"^\p{Lu}\p{Ll}? "))
        unlike = _vote(None, before.rlike(r"(?:^|[.!?|]\s*|\n)$"))
        listed = _vote(first.isin(FIRST_NAMES), ~first.isin(FIRST_NAMES))
        alone = _vote(None, c["after"].rlike(r"^ \p{Lu}"))
    return F.concat(form, unlike, listed, cue, other, alone)


LABELERS = 6


def features(c: Column) -> list[Column]:
    """Form and surroundings of a candidate, each of few values."""
    text = c["text"]
    n_digits = F.length(digits(text))
    marks = F.length(F.regexp_replace(text, r"[\p{L}\p{N}]", ""))

    def side(value: Column) -> Column:
        return (
            F.when(value == "", "none").when(value.rlike(r"\n"), "line").when(value.rlike(r"\s"), "space")
            .when(value.rlike(r"\p{L}"), "letter").when(value.rlike(r"\p{N}"), "digit").otherwise("mark")
        )

    values = {
        "length": F.least(F.floor(F.length(text) / 3), F.lit(12)), "digits": F.least(n_digits, F.lit(20)), "marks": F.least(marks, F.lit(8)),
        "first": side(F.left(text, F.lit(1))), "last": side(F.right(text, F.lit(1))),
        "before": side(F.right(c["before"], F.lit(1))), "after": side(F.left(c["after"], F.lit(1))),
        "cue": F.regexp_extract(c["votes"], "^...(.)", 1),
    }
    return [F.concat(c["kind"], F.lit(f":{name}:"), v.cast("string")) for name, v in values.items()]


def _overlaps(spans: Column, start: Column, end: Column) -> Column:
    """Whether one of `spans`, which stand in order and do not overlap each other, has a place between `start` and `end`.

    Bisection for the last span that begins before `end`: a text may hold very many spans and candidates.
    """
    size = F.size(spans)
    steps = F.sequence(F.lit(1), F.ceil(F.log2(size + 1)).cast("int") + 1)
    bounds = F.struct(F.lit(0).alias("low"), size.alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        less = (at["low"] < at["high"]) & (F.get(spans, middle)["start"] < end)
        return F.struct(
            F.when(less, middle + 1).otherwise(at["low"]).alias("low"),
            F.when(less | (at["low"] >= at["high"]), at["high"]).otherwise(middle).alias("high"),
        )

    last = F.aggregate(steps, bounds, halve, lambda at: F.get(spans, at["low"] - 1)["end"])
    return F.when(size == 0, F.lit(False)).otherwise(F.coalesce(last > start, F.lit(False)))


def candidates(text: Column, base: Column) -> Column:
    """Array of (kind, start, end, text, before, after, votes, known); known: it overlaps a base span."""

    def only(kind: str) -> Column:
        return F.filter(base, lambda b: b["kind"] == kind).alias(kind)

    return let(F.struct(*[only(k) for k in BASE]), lambda found: _candidates(text, found))


def _candidates(text: Column, base: Column) -> Column:
    def of(kind: str, pattern: str) -> Column:
        def one(c: Column) -> Column:
            known = reduce(lambda a, b: a | b, [_overlaps(base[k], c["start"], c["end"]) for k in BASE])
            fields = [c[name].alias(name) for name in ("start", "end", "text", "before", "after")]
            return F.struct(F.lit(kind).alias("kind"), *fields, votes(c, kind).alias("votes"), known.alias("known"))

        return F.transform(find_all(text, pattern, CONTEXT), one)

    return F.concat(*[of(kind, pattern) for kind, pattern in zip(KINDS, (NUMBER, CONTACT, NAME), strict=True)])


@dataclass(frozen=True)
class Model:
    """Probability by kind and votes, and the classifier's log odds by feature; `kind:` holds the prior."""

    voted: dict[str, float]
    odds: dict[str, float]


def expectation_maximisation(counts: dict[tuple[str, str, bool], int], rounds: int = ROUNDS) -> dict[str, float]:
    """Probability of being personal by `kind votes`, from counts of (kind, votes, known).

    Dawid and Skene's model per kind: labelers vote independently given the class, each with a distribution of its own over yes, no
    and nothing. Known candidates stay personal; the others start from a low prior and labelers that are mostly right.
    """
    out = {}
    for kind in sorted({k for k, _, _ in counts}):
        rows = [(v, known, n) for (k, v, known), n in sorted(counts.items()) if k == kind]
        start = {True: {"1": 0.5, "0": 0.1, "-": 0.4}, False: {"1": 0.1, "0": 0.5, "-": 0.4}}
        tables = {y: [dict(start[y]) for _ in range(LABELERS)] for y in (True, False)}
        prior = 0.05  # of the candidates that are not known

        def posterior(v: str, tables: dict = tables) -> float:
            yes = math.log(prior) + sum(math.log(tables[True][j][x]) for j, x in enumerate(v))
            no = math.log(1 - prior) + sum(math.log(tables[False][j][x]) for j, x in enumerate(v))
            return 1 / (1 + math.exp(min(700.0, no - yes)))

        for _ in range(rounds):
            weights = [(v, n, 1.0 if known else posterior(v)) for v, known, n in rows]
            open_rows = [(n, posterior(v)) for v, known, n in rows if not known]
            total = sum(n for n, _ in open_rows)
            prior = min(0.5, (1 + sum(n * p for n, p in open_rows)) / (20 + total))
            for y in (True, False):
                for j in range(LABELERS):
                    sums = {x: 10 * start[y][x] for x in "10-"}  # ten made-up votes hold the labelers to their side
                    for v, n, p in weights:
                        sums[v[j]] += n * (p if y else 1 - p)
                    whole = sum(sums.values())
                    tables[y][j].update({x: s / whole for x, s in sums.items()})
        out |= {f"{kind} {v}": posterior(v) for v, _, _ in rows}
    return out


def _lookup(values: dict[str, float], key: Column, default: float) -> Column:
    if not values:
        return F.lit(default)
    table = F.map_from_arrays(F.lit(list(values)), F.lit([float(v) for v in values.values()]))
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def train(found: DataFrame, rounds: int = ROUNDS) -> Model:
    """Label model and classifier from the candidates of all rows. `found` is a written table."""
    each = found.select(F.explode("candidates").alias("c")).select("c.*")
    counted = each.groupBy("kind", "votes", "known").count().collect()
    voted = expectation_maximisation({(r["kind"], r["votes"], r["known"]): r["count"] for r in counted}, rounds)
    p = F.when(F.col("known"), F.lit(1.0)).otherwise(_lookup(voted, F.concat_ws(" ", "kind", "votes"), 0.0))
    whole = F.struct(*[F.col(c) for c in each.columns])
    keys = F.array(*features(whole), F.concat("kind", F.lit(":")))
    # Probabilities are summed as integers, so that the order of the rows does not matter.
    sums = each.select(F.explode(keys).alias("key"), F.round(p * 1_000_000).cast("long").alias("p")).groupBy("key").agg(
        F.sum("p").alias("p"), F.count("*").alias("n")
    ).collect()
    yes = {r["key"]: r["p"] / 1e6 for r in sums}
    no = {r["key"]: r["n"] - r["p"] / 1e6 for r in sums}
    odds = {}
    for key in sorted(yes):
        kind = key.split(":")[0] + ":"
        if key == kind:
            odds[key] = math.log((yes[key] + 0.5) / (no[key] + 0.5))
        else:
            odds[key] = math.log((yes[key] + 0.5) / (yes[kind] + 10)) - math.log((no[key] + 0.5) / (no[kind] + 10))
    return Model(voted, odds)


def added_spans(found: Column, model: Model, voted: float = VOTED, sure: float = SURE) -> Column:
    """The candidates that are not known and that both the votes and the classifier find personal."""

    def keep(c: Column) -> Column:
        score = F.aggregate(F.array(*features(c), F.concat(c["kind"], F.lit(":"))), F.lit(0.0), lambda a, key: a + _lookup(model.odds, key, 0.0))
        label = _lookup(model.voted, F.concat_ws(" ", c["kind"], c["votes"]), 0.0)
        return ~c["known"] & (label >= voted) & F.when(label >= voted, score >= math.log(sure / (1 - sure))).otherwise(False)

    rank = {k: len(BASE) + i for i, k in enumerate(KINDS)}
    return F.transform(F.filter(found, keep), lambda c: F.struct(
        c["kind"].alias("kind"),
        F.coalesce(*[F.when(c["kind"] == k, r) for k, r in rank.items()]).alias("rank"), c["start"].alias("start"), c["end"].alias("end"),
    ))


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), rounds: int = ROUNDS
) -> tuple[DataFrame, Model]:
    """Per row: `id_col`, the `keep` columns, base and added: arrays of (kind, rank, start, end); and the model.

    A null text is an empty one and has no spans. Rows are judged one by one, so repeated rows and null ids are treated like others; all
    rows count for the model. An empty table gives an empty table. Texts of any length are searched whole, in time that grows a little
    faster than their length. Other columns are not read, whatever their names; `keep` must not name base or added.

    The candidates, which hold personal data in plain text, are removed from the shared folder before this returns.
    """
    carried = [F.col(f"`{c}`") for c in dict.fromkeys([id_col, *keep])]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    both = let(text, lambda t: let(base_spans(t), lambda base: F.struct(base.alias("base"), candidates(t, base).alias("candidates"))))
    found = docs.select(F.struct(*carried).alias("own"), both.alias("found")).select("own", "found.*")
    path = new_path(docs.sparkSession, "personal")
    try:
        found.write.parquet(path)
        found = docs.sparkSession.read.schema(found.schema).parquet(path)
        model = train(found, rounds)
        spans = materialize(found.select("own", "base", added_spans(F.col("candidates"), model).alias("added")), "spans")
    finally:
        remove(docs.sparkSession, path)
    own = [F.col("own")[c].alias(c) for c in dict.fromkeys([id_col, *keep])]
    return spans.select(*own, "base", "added"), model
