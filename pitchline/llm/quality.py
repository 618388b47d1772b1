"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one failure bit per rule; policies are masks over those bits, so a new
policy or an ablation never reads a text again.  DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchline.llm.common import let, words

#: Rules in bit order.  Each is true where a document FAILS, over the measurements.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_share": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "shouting": "2 * n_loud > n_words",
    "no_words": "n_words = 0",
}


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules that reject."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        order = list(RULES)
        return sum(1 << order.index(r) for r in self.rules)


BASE = Policy("base", 1, ("too_few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("standard", 1, (*BASE.rules, "symbol_share", "repeated_lines")),
    Policy("standard", 2, (*BASE.rules, "symbol_share", "repeated_lines", "short_words", "long_words", "shouting")),
    # short documents may be good ones: a corpus keeps them
    Policy("corpus", 1, ("repeated_windows", "symbol_share", "repeated_lines", "short_words", "long_words", "shouting", "no_words")),
)
CURRENT, CORPUS = POLICIES[-2:]

_START_BITS = 20
_STARTS = (1 << _START_BITS) - 1


def repeated_words(w: Column, window: int = 3) -> Column:
    """How many words of array ``w`` lie in a window of words found twice or more.

    Windows are compared by 64-bit hash; sorting (hash, start) pairs inside
    the row finds the repeats in n log n, without a shuffle.
    """
    hashed = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, window)))), F.lit(1), F.greatest(F.size(w) - (window - 1), F.lit(0)))

    def covered(p: Column) -> Column:
        fresh = F.transform(p, lambda x, j: F.when(j == 0, F.lit(window)).otherwise(F.least(F.lit(window), x - F.get(p, j - 1))))
        return F.aggregate(fresh, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def packed(h: Column) -> Column:
        """Starts of repeats: hash bits above, start below, sorted as plain longs;
        neighbours that agree in the hash bits are compared by the whole hash."""
        start = lambda x: x.bitwiseAND(F.lit(_STARTS).cast("long")).cast("int")
        hash_of = lambda x: F.get(h, start(x))
        top = lambda x: F.shiftright(x, _START_BITS)
        same = lambda s, x, j: F.coalesce((top(F.get(s, j)) == top(x)) & (hash_of(F.get(s, j)) == hash_of(x)), F.lit(False))
        keys = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~_STARTS).cast("long")).bitwiseOR(i.cast("long")))
        return let(F.sort_array(keys), lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)), start)))

    def paired(h: Column) -> Column:
        """The same for texts with more words than a start has bits for."""
        same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return let(F.sort_array(pairs), lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)), lambda x: x["i"])))

    def count(h: Column) -> Column:
        plain = F.size(F.array_distinct(h)) == F.size(h)
        starts = F.when(F.size(h) <= _STARTS, packed(h)).otherwise(paired(h))
        return F.when(plain, F.lit(0).cast("long")).otherwise(let(starts, covered))

    return let(hashed, count)


def ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, the measurements, and ``fail_bits`` for each row.

    A null or blank text has zero words and fails ``too_few_words``.  Columns
    of ``docs`` that share a measurement's name are dropped unless kept.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*keep, text.alias("_t"), words(F.col(text_col)).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = base.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit(r"!!(?=[\x20\x09-\x0D]|\z)")).cast("long").alias("n_loud"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_l"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
    )
    # a row id is not deterministic, so a filter on the ledger is not pushed
    # below it, where every rule would split the text again
    measured = measured.select(*keep, F.monotonically_increasing_id().alias("row_id"), "n_words", "word_chars", "n_symbols", "n_loud", F.col("_l.n").alias("n_lines"), F.col("_l.dup").alias("n_dup_lines"), "n_repeat_words")
    bits = [F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, rule in enumerate(RULES.values())]
    return measured.withColumn("fail_bits", sum(bits[1:], bits[0]))


def passes(policy: Policy) -> Column:
    """Whether a ledger row passes ``policy``."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each policy and rule: documents rejected, failing the rule, and
    rejected by that rule alone (kept if it were taken out)."""
    table = [(p.name, p.version, r, p.mask, 1 << list(RULES).index(r)) for p in policies for r in p.rules]
    spark = rows.sparkSession
    rules = spark.createDataFrame(table, "policy string, version int, rule string, mask long, bit long")
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))  # at most 2^rules rows
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        patterns.join(F.broadcast(rules), F.lit(True))
        .groupBy("policy", "version", "rule")
        .agg(
            F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this_rule"),
            F.bit_or(hit).alias("seen_bits"),
        )
    )


def keep_good(docs: DataFrame, policy: Policy = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass ``policy``, with their own columns only."""
    kept = ledger(docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text")), "_text", ("_row",)).where(passes(policy) & (F.col("row_id") >= 0))
    return kept.select("_row.*")
