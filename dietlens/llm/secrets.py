"""Secret scans with an incremental blob ledger, by DataFrame and SQL functions only.

A text is known by its SHA-256. The ledger holds for each scanned text the versions of the rules that were applied and what they
found. A scan looks at one copy of each text, and only under rule versions that the ledger lacks for it; all paths then take
their findings from the ledger. A changed rule has another version, so only that rule runs again.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dietlens.llm.common import identified, join_counted
from dietlens.llm.spans import find_all
from dietlens.session import materialize, new_path

# Most unseen texts whose ids are broadcast.
DELTA = 1_000
# Findings of a text with very many paths, up to which they are broadcast.
BROADCAST_FOUND = 1_000


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose group `group` has at least `least` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.least, self.group)).encode()).hexdigest()[:16]


#: Fixed patterns of the contract, in its order.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+"),
)
#: Formats of well-known credentials.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255})"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("slack", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}+"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}+"),
    Rule("bearer", r"\b[Bb]earer\x20[A-Za-z0-9._~+/-]{20,}+"),
    Rule("url_login", r"://[^\s/:@]{1,64}:[^\s/:@]{3,128}@"),
)

FOUND = "array<struct<version:string,start:bigint,end:bigint>>"


def _found(text: Column, rule: Rule, wanted: Column) -> Column:
    """Findings of a rule, none if its version is not wanted."""
    value = F.lit(rule.version)
    spans = find_all(text, rule.pattern)
    if rule.least:
        spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["text"], rule.pattern, rule.group)) >= rule.least)
    spans = F.transform(spans, lambda s: F.struct(value.alias("version"), s["start"].alias("start"), s["end"].alias("end")))
    return F.when(F.array_contains(wanted, rule.version), spans).otherwise(F.array().cast(FOUND))


def read_ledger(df: DataFrame, ledger: str) -> DataFrame | None:
    """(blob, versions, found) of all runs so far, or None."""
    try:
        return df.sparkSession.read.parquet(ledger).select("blob", "versions", "found")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan(
    docs: DataFrame,
    ledger: str | None = None,
    rules: Sequence[Rule] = BASE + MORE,
    path_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
) -> tuple[DataFrame, int]:
    """Per row: `path_col`, the `keep` columns, blob, found (kind, rank, start, end); and the number of texts that were scanned.

    `ledger` is a folder in shared storage, a fresh one by default; each run adds a folder to it. rank is the rule's place in
    `rules`. A null text is an empty one. Repeated rows and null paths get their findings like others. An empty table gives
    an empty table. Texts of any length are scanned whole. Other columns are not read, whatever their names; `keep` must not name
    blob or found.
    """
    spark = docs.sparkSession
    ledger = ledger or new_path(spark, "ledger")
    whole, row = identified(docs)
    whole = whole.select(*dict.fromkeys([path_col, *keep, *row]), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    carried = [c for c in whole.columns if c != "_text"]
    paths = materialize(whole.select(*carried, F.sha2(F.col("_text").cast("binary"), 256).alias("blob")), "paths")
    blobs = paths.groupBy("blob").agg(F.count("*").alias("n_paths"), F.min(F.struct(*row)).alias("first"))
    versions = F.array(*[F.lit(r.version) for r in rules])
    known = read_ledger(docs, ledger)
    if known is None:
        unseen = blobs.withColumn("wanted", versions)
    else:
        seen = known.join(blobs.select("blob"), "blob", "left_semi")
        seen = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("seen"))
        left = F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>")))
        unseen = blobs.join(seen, "blob", "left").withColumn("wanted", left).filter(F.size("wanted") > 0)
    unseen = materialize(unseen.select("blob", "wanted", *[F.col("first")[c].alias(c) for c in row]), "unseen")
    n_scanned = unseen.count()
    if n_scanned:
        # A small delta is broadcast, so that no text moves; any other meets its texts by shuffle.
        texts = whole.select(*row, "_text").join(F.broadcast(unseen) if n_scanned <= DELTA else unseen.hint("merge"), row)
        found = F.concat(*[_found(F.col("_text"), rule, F.col("wanted")) for rule in rules])
        scanned = texts.select("blob", F.col("wanted").alias("versions"), found.alias("found"))
        scanned.write.parquet(os.path.join(ledger, f"run={uuid.uuid4().hex}"))
    known = read_ledger(docs, ledger)
    order = {r.version: (r.kind, i) for i, r in enumerate(rules)}
    if known is None:  # an empty table, never scanned
        return paths.select(path_col, *keep, "blob", F.array().cast(_RANKED).alias("found")), 0
    ranked = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("rank"), F.lit(v).alias("version")) for v, (k, i) in order.items()])
    findings = F.flatten(F.transform(ranked, lambda r: F.transform(
        F.filter(F.col("found"), lambda s: s["version"] == r["version"]),
        lambda s: F.struct(r["kind"].alias("kind"), r["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end")),
    )))
    # The ledger only grows: the texts at hand are picked first. Scans side by side may have judged a text twice; it counts once.
    present = known.join(blobs.select("blob", "n_paths"), "blob")
    runs = present.groupBy("blob").agg(F.first("n_paths").alias("n_paths"), F.collect_list(F.struct("versions", "found")).alias("runs"))
    known = materialize(runs.withColumn("found", _once(F.col("runs"))).select("blob", "n_paths", findings.alias("found")), "findings")
    out = join_counted(paths, known, ["blob"], "n_paths", paths.count(), F.size("found") <= BROADCAST_FOUND)
    return out.select(path_col, *keep, "blob", "found"), n_scanned


def _once(runs: Column) -> Column:
    """The findings of runs (versions, found), of each version those of the first run that has it."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast(FOUND).alias("found"))

    def add(total: Column, run: Column) -> Column:
        new = F.filter(run["found"], lambda s: ~F.array_contains(total["seen"], s["version"]))
        return F.struct(F.array_union(total["seen"], run["versions"]).alias("seen"), F.concat(total["found"], new).alias("found"))

    return F.when(F.size(runs) == 1, F.element_at(runs, 1)["found"]).otherwise(F.aggregate(runs, start, add, lambda total: total["found"]))


_RANKED = "array<struct<kind:string,rank:int,start:bigint,end:bigint>>"
