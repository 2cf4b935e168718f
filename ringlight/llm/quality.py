"""Operator 5: a ledger of quality rules.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit for each rule
that failed. A policy is a version and a mask of rules: applying it is one bitwise AND, and an ablation (how
many more documents a policy would keep without one of its rules) is an aggregate over the stored bits.

Null and empty texts have no words: all measurements 0, and the word-count rule fails. Repeated rows each give
a row. Bytes are read once; windows and lines are counted over the whole text."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import map_texts, read_table

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_letters long"


@dataclass(frozen=True)
class Rule:
    """Fails where ``numerator`` * ``per`` > ``most`` * ``denominator``, or where n_words < ``least``."""

    name: str
    numerator: str = ""
    denominator: str = ""
    most: int = 0
    per: int = 100
    least: int = 0

    def fails(self) -> Column:
        if self.least:
            return F.col(self.numerator) < self.least
        return F.col(self.numerator) * self.per > F.col(self.denominator) * self.most


#: Bit i of the ledger is rule i. Rules are only ever added at the end, so that stored bits keep their meaning.
RULES = (
    Rule("few_words", "n_words", least=50),
    Rule("repeated_windows", "n_repeat_words", "n_words", most=50),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=35),
    Rule("long_words", "word_chars", "n_words", most=2000),
    Rule("few_letters", "n_nonletters", "word_chars", most=20),
)
#: Versioned policies: names of the rules that a version applies.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "strict-2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "long_words", "few_letters"),
}
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
#: Bytes that are no letters in ASCII; bytes of other characters count as letters.
NON_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
CONTINUATION = bytes(range(0x80, 0xC0))


def mask(version: str) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r.name in POLICIES[version])


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = dict(zip(dict.fromkeys(words), range(n)))
    if len(number) == n:
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    size = len(number)
    if size < 1 << 20:
        windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * np.int64(size) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def measure(data: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    words = data.split()
    points = len(data) if data.isascii() else len(data.translate(None, CONTINUATION))
    spaces = len(data) - len(data.translate(None, SPACES))
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = len(data.translate(None, NON_LETTERS + CONTINUATION))
    return len(words), points - spaces, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), letters


def ledger(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, the measurements, and ``failed`` with a bit for each failed rule."""

    def make():
        def f(texts, _):
            rows = list(map(measure, texts))
            return dict(zip([x.split()[0] for x in MEASURES.split(", ")], zip(*rows) if rows else repeat(()), strict=False))

        return f

    out = map_texts(df, make, MEASURES, text, keys).withColumn("n_nonletters", F.col("word_chars") - F.col("n_letters"))
    bits = [F.when(r.fails(), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return out.withColumn("failed", failed.cast("long"))


def kept(version: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(version))) == 0


def ablations(rows: DataFrame, version: str, failed: str = "failed") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects."""
    m = mask(version)
    sums = [F.sum(F.when(F.col(failed).bitwiseAND(F.lit(m)) != 0, 1).otherwise(0)).alias("rejected")]
    names = [(i, r.name) for i, r in enumerate(RULES) if m >> i & 1]
    for i, _ in names:
        sums += [F.sum(F.when(F.col(failed).bitwiseAND(F.lit(1 << i)) != 0, 1).otherwise(0)).alias(f"f{i}"), F.sum(F.when(F.col(failed).bitwiseAND(F.lit(m)) == (1 << i), 1).otherwise(0)).alias(f"o{i}")]
    one = rows.agg(*sums)
    return one.select("rejected", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f{i}").alias("failed"), F.col(f"o{i}").alias("only")) for i, n in names])).alias("x")).select(F.lit(version).alias("policy"), "x.rule", "x.failed", "x.only", "rejected")


def sole(version: str, failed: str = "failed") -> Column:
    """The rule that alone rejects a document by a policy: without the rule it would be kept. Null if there is no such rule."""
    own = F.col(failed).bitwiseAND(F.lit(mask(version)))
    out = F.lit(None).cast("string")
    for i, r in enumerate(RULES):
        out = F.when(own == 1 << i, r.name).otherwise(out)
    return out


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns by the policies base-1 and strict-2; and of the ablation of strict-2: the rule that alone rejects a
    document, and how many documents of the corpus the policy would keep without that rule (``n_sole``)."""
    rows = checkpointed(ledger(read_table(spark, sf_dir, "documents")))  # no texts; every rule evaluated once
    base = mask("base-1")
    only = F.broadcast(ablations(rows, "strict-2").select(F.col("rule").alias("sole_rule"), F.col("only").alias("n_sole")))  # a row a rule
    out = rows.withColumn("sole_rule", sole("strict-2")).join(only, "sole_rule", "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), kept("strict-2").alias("kept"), "failed", "sole_rule", "n_sole")


def _fails(rule: Rule) -> str:
    return f"{rule.numerator} < {rule.least}" if rule.least else f"{rule.numerator} * {rule.per} > {rule.denominator} * {rule.most}"


_BITS = " + ".join(f"CASE WHEN {_fails(r)} THEN {1 << i} ELSE 0 END" for i, r in enumerate(RULES))
_SOLE = " ".join(f"WHEN {1 << i} THEN '{r.name}'" for i, r in enumerate(RULES))
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
e AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS s(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_kinds FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(n_lines - n_kinds, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
      length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) - length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_nonletters
      FROM d JOIN w USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN repeats USING (doc_id)),
f AS (SELECT *, {_BITS} AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed & {mask("base-1")} <> 0 AS base_failed, failed & {mask("strict-2")} = 0 AS kept, CAST(failed AS BIGINT) AS failed, sole_rule, CASE WHEN sole_rule IS NOT NULL THEN count(*) OVER (PARTITION BY sole_rule) END AS n_sole
       FROM (SELECT *, CASE failed & {mask("strict-2")} {_SOLE} END AS sole_rule FROM f)
"""
