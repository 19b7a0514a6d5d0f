"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a named failure condition over the text's measures. `measured` adds the measures, `ordered`
estimates on a sample what each rule costs and rejects, and `cascade` evaluates the rules in that order:
a CASE whose first true branch ends the evaluation, so that costly rules run on what cheap ones left. A rule costs
a unit, and one for each character that it reads of the sample's texts, which no clock has to measure.
The order changes cost alone: the verdict is the same in any order, and `rejected_by` names the first failing
rule in the order of the list, which is looked for only in rows that are rejected.

Defined results: a null text counts as empty; an empty text has zero in every measure; equal rows get equal
results, each its own row; an empty table gives no rows; further columns pass through untouched. Columns
whose names start with "_q_" are reserved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_of

WINDOW = 5  # words in a window of n_repeat_words
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measures and the text in _q_text

    @property
    def readings(self) -> int:
        """How often the rule goes over the text."""
        return self.fails.count("_q_text")


#: The method's own rules, wide enough for ordinary prose of any language.
RULES = (
    Rule("symbols", "n_symbols > 0.1D * n_words"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule("dup_lines", "n_dup_lines > 0.3D * n_lines"),
    Rule("shouting", "length(regexp_replace(_q_text, '[^A-Z]+', '')) > 0.3D * word_chars"),
    Rule("exclamations", "length(regexp_replace(_q_text, '[^!]+', '')) > 0.25D * n_words"),
    Rule("digits", "length(regexp_replace(_q_text, '[^0-9]+', '')) > 0.3D * word_chars"),
)


def repeated_words(words: Column, shingles: Column, ordered: Column) -> Column:
    """Words inside windows whose hash occurs twice or more. ordered: the sorted structs (h, i) of all windows."""
    last = F.size(ordered) - 1
    same = lambda e, j: F.get(ordered, j)["h"] == e["h"]
    found = F.filter(ordered, lambda e, j: ((j > 0) & F.coalesce(same(e, j - 1), F.lit(False))) | ((j < last) & F.coalesce(same(e, j + 1), F.lit(False))))
    starts = F.sort_array(F.transform(found, lambda e: e["i"]))
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + WINDOW - F.greatest(acc["end"] - i, F.lit(0))).alias("n"))
    return F.aggregate(starts, begin, step, lambda acc: acc["n"])


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, n_lines, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), and _q_text.

    Windows are compared by a 64-bit hash of their word sequence within one text.
    """
    df = df.withColumn("_q_text", text_of(text))
    df = df.withColumn("_q_words", F.regexp_extract_all("_q_text", F.lit(WORD), F.lit(0)))
    df = df.withColumn("_q_lines", F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_q_words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_q_hash", F.transform(starts, lambda i: F.xxhash64(F.slice("_q_words", i, WINDOW))))
    twice = F.size(F.array_distinct("_q_hash")) < F.size("_q_hash")
    pairs = F.transform("_q_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_q_sorted", F.when(twice, F.sort_array(pairs)))
    return df.select(
        *[c for c in df.columns if c not in ("_q_words", "_q_lines", "_q_hash", "_q_sorted")],
        n.cast("long").alias("n_words"),
        F.size("_q_lines").cast("long").alias("n_lines"),
        F.char_length(F.array_join("_q_words", "")).cast("long").alias("word_chars"),
        (F.octet_length("_q_text") - F.octet_length(F.regexp_replace("_q_text", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated_words(F.col("_q_words"), F.col("_q_hash"), F.col("_q_sorted")), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _failed(rule: Rule) -> Column:
    return F.coalesce(F.expr(rule.fails), F.lit(False))


def ordered(df: DataFrame, text: str = "text", rules=RULES, fraction: float = 0.01, most: int = 2_000) -> list[Rule]:
    """The rules by rejections per cost, both estimated on the same sample of at most `most` rows.

    The sample is chosen by a hash of the row, so it depends neither on the table's layout nor on the run."""
    named = df.select(F.xxhash64(text, *[c for c, kind in df.dtypes if c != text and "map<" not in kind]).alias("_q_row"), text)
    sample = named.filter(F.pmod("_q_row", F.lit(round(1 / fraction))) == 0).orderBy("_q_row").limit(most)
    counts = [F.count_if(_failed(rule)).alias(rule.name) for rule in rules]
    seen = measured(sample, text).agg(F.count("*").alias("_q_n"), F.coalesce(F.avg(F.char_length("_q_text")), F.lit(0.0)).alias("_q_length"), *counts).first()
    worth = {r.name: (seen[r.name] + 1) / (seen["_q_n"] + 2) / (1 + r.readings * seen["_q_length"]) for r in rules}
    return sorted(rules, key=lambda r: -worth[r.name])


def cascade(measures: DataFrame, rules, named=None) -> DataFrame:
    """measures with rejected_by: null for rows that fail no rule, else the first of `named` (the rules as given) that fails."""
    rejected, name = F.lit(False), F.lit(None).cast("string")
    for rule in reversed(list(rules)):
        rejected = F.when(_failed(rule), F.lit(True)).otherwise(rejected)
    for rule in reversed(list(named or rules)):
        name = F.when(_failed(rule), F.lit(rule.name)).otherwise(name)
    return measures.withColumn("rejected_by", F.when(rejected, name))


def quality_rules(df: DataFrame, text: str = "text", rules=RULES, first=(), sample_of: DataFrame | None = None) -> DataFrame:
    """df with its measures, rejected_by and kept. Rules in `first` come before all others, whatever they cost."""
    clash = {"n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "rejected_by", "kept"} - {text}
    df = df.drop(*clash)
    order = [*first, *ordered(df if sample_of is None else sample_of, text, rules)]
    return cascade(measured(df, text), order, [*first, *rules]).withColumn("kept", F.col("rejected_by").isNull()).drop("_q_text")
