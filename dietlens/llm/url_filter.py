"""URL filters: rules first, then host names cut into words and scored by naive Bayes.

Concatenated names are cut by the most likely sequence of words under unigram counts of the words of all pages (Viterbi). The
tokens of host and path are scored by a multinomial naive Bayes classifier, trained on all URLs, where a URL counts as bad if
one of its words is a seed word of an unwanted subject. So words that go along with seed words come to count as well. Both count
tables are whole and stay in Spark: names are joined with the words that occur in them, tokens with their log odds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dietlens.llm.common import fresh, identified, join_counted
from dietlens.session import materialize


@dataclass(frozen=True)
class Rule:
    """Blocks or allows the host and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed rules of the contract.
RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
# Words of unwanted subjects. Fixed values.
SEEDS = frozenset(
    "adult porn porno xxx sex nude escort webcam casino poker bet bets betting gamble gambling slots lottery jackpot roulette viagra cialis "
    "pill pills pharmacy payday loan loans spam scam phishing malware virus warez torrent crack keygen ads adserver replica fake".split()
)
#: Longest piece of a name that is no counted word, and the letters by which longer words are looked up.
LONGEST = 24
# Words of a piece that is met by very many names, up to which they are broadcast.
BROADCAST_WORDS = 1_000
_PIECES = 1 << 16


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does."""
    name, verdict = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = name.when(fits, rule.name), verdict.when(fits, rule.verdict)
    return name, verdict


def count_words(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Every word of two or more letters in all pages without tags, and how often it occurs (word, n)."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?s)<[^>]*+>|&\w+;", " "))
    word = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).filter(F.length("word") > 1)
    return word.groupBy("word").agg(F.count("*").alias("n"))


def with_seeds(counted: DataFrame, seeds: Sequence[str]) -> tuple[DataFrame, int]:
    """`counted` with every seed word at least as frequent as the word in the middle, and the sum of all counts."""
    by_count = counted.groupBy("n").agg(F.count("*").alias("words")).collect()  # few: their sum is at most all occurrences
    below, usual, middle = 0, 1, sum(r["words"] for r in by_count) // 2
    for r in sorted(by_count, key=lambda r: r["n"]):
        below += r["words"]
        if below > middle:
            usual = r["n"]
            break
    listed = list(seeds)
    own = {r["word"]: r["n"] for r in counted.filter(F.col("word").isin(listed)).collect()}
    raised = [(w, max(usual, own.get(w, 0))) for w in sorted(set(listed))]
    total = sum(r["n"] * r["words"] for r in by_count) - sum(own.values()) + sum(n for _, n in raised)
    rows = counted.sparkSession.createDataFrame(raised, "word string, n long")
    return counted.filter(~F.col("word").isin(listed)).unionByName(rows), total


class Segmenter:
    """Cuts a name into its most likely words. With `total`, `counts` are part of a table with that sum and with the seeds."""

    def __init__(self, counts: Mapping[str, int], seeds: Sequence[str] = tuple(SEEDS), total: int | None = None):
        counts = {w: n for w, n in counts.items() if len(w) > 1}
        if total is None:
            usual = max(1, sorted(counts.values())[len(counts) // 2] if counts else 1)
            counts |= {w: max(usual, counts.get(w, 0)) for w in seeds}
            total = sum(counts.values())
        self.total = total
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.long = sorted({len(w) for w in self.cost if len(w) > LONGEST}, reverse=True)

    def _cost(self, word: str) -> float:
        """Of words that are not counted, the longer the less likely."""
        known = self.cost.get(word)
        return math.log(self.total) + (len(word) + 1) * math.log(10) if known is None else known

    def cut(self, name: str) -> tuple[str, ...]:
        """Ties go to the longer last word. Names and counted words are any length; unknown words are at most LONGEST."""
        best, last = [0.0], [0]
        for end in range(1, len(name) + 1):
            starts = [end - n for n in self.long if n <= end and name[end - n : end] in self.cost]
            cost, k = min((best[k] + self._cost(name[k:end]), k) for k in (*starts, *range(max(0, end - LONGEST), end)))
            best.append(cost)
            last.append(k)
        words, end = [], len(name)
        while end:
            words.append(name[last[end] : end])
            end = last[end]
        return tuple(reversed(words))


_NAME = re.compile(r"[^\W\d_]+")


def names_of(host: str, path: str) -> list[tuple[str, str]]:
    """The host's names but the last, the last as it is, and the names of the path, each with where it stands."""
    names = host.split(":")[0].split(".")
    out = [("top", names[-1])] if len(names) > 1 else []
    out += [("host", part) for name in names[:-1] or names for part in _NAME.findall(name)]
    return out + [("path", part) for part in _NAME.findall(path.lower())]


def _all_names(urls: DataFrame, row: Sequence[str]) -> DataFrame:
    """A row per name of each URL: the `row` columns, place, kind (top, host, path), name."""
    slim = urls.select(*row, "host", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = (batch.column(k).to_pylist() for k in (2, 3))
            found = [(at, k, *x) for at, (h, p) in enumerate(zip(hosts, paths, strict=True)) for k, x in enumerate(names_of(h, p))]
            at, place, kind, name = zip(*found, strict=True) if found else ((),) * 4
            at = pa.array(at, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(place, pa.int64()), pa.array(kind, pa.string()), pa.array(name, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*row, "place", "kind", "name"])

    return slim.mapInArrow(run, f"`{row[0]}` long, `{row[1]}` long, place long, kind string, name string")


def _all_pieces(names: DataFrame, row: Sequence[str]) -> DataFrame:
    """The `row` columns of each name with its distinct substrings of 2 to LONGEST letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for k, name in enumerate(batch.column(2).to_pylist()):
                pieces = {name[i:end] for i in range(len(name)) for end in range(i + 2, min(i + LONGEST, len(name)) + 1)}
                at += [k] * len(pieces)
                found += pieces
                if len(at) >= _PIECES or k == batch.num_rows - 1:
                    rows = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found, pa.string())], names=[*row, "piece"])
                    at, found = [], []

    return names.select(*row, "name").mapInArrow(run, f"`{row[0]}` long, `{row[1]}` long, piece string")


def cut_names(names: DataFrame, counted: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """`names` (name, times; each once) with their most likely words under the counts (word, n).

    A word is met by its first LONGEST letters, so a name has few substrings to join however long the counted words are.
    """
    counted, total = with_seeds(counted, seeds)
    names, row = identified(names)
    pieces = materialize(_all_pieces(names, row), "pieces")
    keys = pieces.groupBy("piece").agg(F.count("*").alias("met"))
    met = counted.withColumn("piece", F.substring("word", 1, LONGEST)).join(keys, "piece")
    lookup = materialize(met.groupBy("piece").agg(F.first("met").alias("met"), F.collect_list(F.struct("word", "n")).alias("words")), "met-words")
    found = join_counted(pieces, lookup, ["piece"], "met", pieces.count(), F.size("words") <= BROADCAST_WORDS)
    found = found.groupBy(*row).agg(F.flatten(F.collect_list("words")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = ({m["word"]: m["n"] for m in met or ()} for met in batch.column(2).to_pylist())
            words = [list(Segmenter(k, (), total).cut(n)) for n, k in zip(batch.column(0).to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words, pa.list_(pa.string()))], names=["name", "times", "words"])

    return names.join(found, row, "left").select("name", "times", "words").mapInArrow(run, "name string, times long, words array<string>")


def segmented(urls: DataFrame, row: Sequence[str], counted: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """The `row` columns and tokens of every URL (host, path) that has any: words in order, each marked by where it stands."""
    every = materialize(_all_names(urls, row), "url-names")
    inner = every.filter("kind <> 'top'")
    names = materialize(inner.groupBy("name").agg(F.count("*").alias("times")), "names")
    cut = materialize(cut_names(names, counted, seeds), "cut-names")
    n_names = cut.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    words = join_counted(inner, cut, ["name"], "times", n_names).select(*row, "place", "kind", "words")
    words = words.unionByName(every.filter("kind = 'top'").select(*row, "place", "kind", F.array("name").alias("words")))
    marked = words.select(*row, "place", F.transform("words", lambda w: F.concat("kind", F.lit(":"), w)).alias("words"))
    return marked.groupBy(*row).agg(F.flatten(F.array_sort(F.collect_list(F.struct("place", "words")))["words"]).alias("tokens"))


def train(rows: DataFrame, n_rows: int, seeds: Sequence[str] = tuple(SEEDS)) -> tuple[float, DataFrame]:
    """Naive Bayes over `n_rows` URLs, of which `rows` have `tokens`: log odds of bad of URLs as such, and of every token (token, n, odds)."""
    marks = F.array(*[F.lit(f"{where}:{w}") for w in sorted(seeds) for where in ("host", "path")])
    labelled = rows.select("tokens", F.arrays_overlap("tokens", marks).cast("int").alias("bad"))
    n_bad = labelled.agg(F.coalesce(F.sum("bad"), F.lit(0))).first()[0]
    each = labelled.select(F.explode("tokens").alias("token"), "bad")
    counted = each.groupBy("token").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
    counted = materialize(counted, "token-counts")
    kinds, bad, good = counted.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    odds = F.log((F.col("bad") + 1) / F.lit(float(bad + kinds + 1))) - F.log((F.col("good") + 1) / F.lit(float(good + kinds + 1)))
    prior = math.log((n_bad + 1) / (n_rows - n_bad + 1))
    return prior, counted.select("token", (F.col("bad") + F.col("good")).alias("n"), odds.alias("odds"))


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    keep: Sequence[str] = (),
    rules: Sequence[Rule] = RULES,
    seeds: Sequence[str] = tuple(SEEDS),
) -> DataFrame:
    """Per row: `id_col`, the `keep` columns, host, path, rule, score, verdict (allow or block).

    The verdict is the longest fitting rule's, else block for a positive score. A null URL, or one without `://`, has empty host and
    path, fits no rule and is scored by the prior. Repeated rows count each time. An empty table gives an empty table. Names and pages of
    any length count whole; a name has about 24 pieces per letter. Other columns are not read, whatever their names; `keep` must not
    name what is returned.
    """
    host, path = parts(F.col(url_col))
    carried = list(dict.fromkeys([id_col, *keep]))
    urls, row = identified(materialize(pages.select(*carried, host.alias("host"), path.alias("path")), "urls"))
    counted = materialize(count_words(pages, html_col), "words")
    tokens = materialize(segmented(urls, row, counted, seeds), "url-tokens")
    prior, listed = train(tokens, urls.count(), seeds)
    each = tokens.select(*row, F.posexplode("tokens").alias("place", "token"))
    n_tokens = listed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = join_counted(each, listed, ["token"], "n", n_tokens)
    # Added in the order of the tokens, so that a sum is the same in every run.
    odds = F.array_sort(F.collect_list(F.struct("place", "odds")))["odds"]
    scored, out = joined.groupBy(*row).agg(odds.alias("odds")), fresh("score")
    score = F.lit(prior) + F.coalesce(F.aggregate("odds", F.lit(0.0), lambda total, x: total + x), F.lit(0.0))
    scored = urls.join(scored, row, "left").select(*carried, "host", "path", score.alias(out))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    own = F.when(F.col(out) > 0, "block").otherwise("allow")
    return scored.select(*carried, "host", "path", rule.alias("rule"), F.col(out).alias("score"), F.coalesce(verdict, own).alias("verdict"))
