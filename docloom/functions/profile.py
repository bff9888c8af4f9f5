"""Text profiling as native column expressions: metrics, quality and style flags, document families."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def micro(x: Column) -> Column:
    """Rounded to six places the same way in every engine."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def strip_all(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _count(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.regexp_count(text, F.lit(("(?i)" if ignore_case else "") + pattern)).cast("long")


def _listed(words: list[str]) -> str:
    """A pattern for the words of a list, by first letters, so that few branches are tried at a place."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{h}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for h, rest in sorted(heads.items())) + ")"


def profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the profile metrics added; a null text gives nulls.

    The words of a text are folded once into one string with a space around each, in which compiled patterns count;
    a metric that is not selected costs nothing.
    """
    raw = F.col(text)
    body = F.regexp_replace(raw, "(?i)" + fixed.STAMP, " ")
    # A pattern is tried only where a text holds what each of its matches does.
    without = lambda x, pattern, *marks: F.when(reduce(or_, [x.contains(m) for m in marks]), F.regexp_replace(x, pattern, " ")).otherwise(x)
    spread = lambda words: F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    step = docs.withColumn("_body", body).withColumn("_prose", without(F.col("_body"), fixed.URL, "http", "www."))
    step = step.withColumn("_found", F.regexp_extract_all(without(F.col("_prose"), fixed.EMAIL, "@"), F.lit(fixed.WORD), F.lit(0)))
    step = step.withColumn("_n", F.size("_found").cast("long")).withColumn("_words", F.lower(F.array_join("_found", " ")))
    step = step.withColumn("_kinds", F.when(F.col("_n") > 0, F.array_distinct(F.split("_words", " "))).otherwise(F.array().cast("array<string>")))
    step = step.withColumns({"_k": F.size("_kinds").cast("long"), "_types": spread(F.col("_kinds")), "_words": F.concat(F.lit(" "), F.replace("_words", F.lit(" "), F.lit("  ")), F.lit(" "))})
    step = step.withColumn("_solid", F.length(F.regexp_replace("_body", r"(?U)\s+", ""))).withColumn("_letters", F.length(F.regexp_replace("_body", r"\P{L}+", "")))
    words, types = F.col("_words"), F.col("_types")
    some = lambda xs, pattern: F.regexp_count(xs, F.lit(f" {pattern} ")).cast("long")
    n, k = F.col("_n"), F.col("_k")  # counted once: what stands in a branch is worked out for each
    no_vowel = f"(?!{_listed(fixed.VOWELLESS_WORDS)} )[^aeiouy ]{{3,}}"
    # A line is what is left of one between white space at its ends.
    step = step.withColumn("_lines", F.regexp_count("_body", F.lit(r"(?m)^[^\n]*\S[^\n]*$")).cast("long"))
    lines = F.col("_lines")
    in_lines = F.length(F.regexp_replace("_body", r"\r?\n", "")) - F.length(F.regexp_replace(F.regexp_replace("_body", r"(?m)^[^\n]*\S[^\n]*$", ""), r"\r?\n", ""))
    metrics = {
        "n_chars": F.length(raw).cast("long"),
        "n_words": n,
        "n_lines": lines,
        "n_unique_words": k,
        "type_token_ratio": ratio(k, n),
        "mean_word_len": ratio(F.length(words) - F.when(n > 0, 2 * n).otherwise(2), n),
        "mean_line_len": ratio(in_lines, lines),
        "alpha_ratio": ratio(F.col("_letters"), F.col("_solid")),
        "upper_ratio": ratio(F.length(F.regexp_replace("_body", r"\P{Lu}+", "")), F.col("_letters")),
        "common_word_ratio": ratio(some(words, _listed(fixed.COMMON_WORDS)), n),
        "short_token_ratio": ratio(some(words, r"\S{1,2}"), n),
        "no_vowel_ratio": ratio(some(words, no_vowel), n),
        "no_vowel_type_ratio": ratio(some(types, no_vowel), k),
        "nonword_char_ratio": ratio(F.length(F.regexp_replace("_body", r"(?U)[\p{L}\p{N}\s\p{P}\p{Sc}\p{Sm}\p{Cf}]+", "")), F.col("_solid")),
        "n_redaction_marks": _count(F.col("_body"), fixed.REDACTION, True),
        "n_emails": _count(F.col("_body"), fixed.EMAIL),
        "n_phones": _count(F.col("_body"), fixed.PHONE),
        "n_urls": _count(F.col("_body"), fixed.URL),
        "n_dates": _count(F.col("_body"), fixed.DATE),
        "n_proper_noun_spans": _count(F.col("_body"), fixed.PROPER_NOUN),
        "n_bates_stamps": _count(raw, fixed.STAMP, True),
    }
    present = {c: F.when(raw.isNotNull(), e) for c, e in metrics.items()}
    return step.withColumns(present).drop("_body", "_prose", "_found", "_n", "_words", "_kinds", "_k", "_types", "_solid", "_letters", "_lines")


def ocr_quality() -> Column:
    """empty, poor, noisy or clean, from a profiled row."""
    n, share, noise = F.coalesce("n_words", F.lit(0)), F.col("no_vowel_type_ratio"), F.col("nonword_char_ratio")
    poor, noisy = F.when(n < 100, 0.12).otherwise(0.06), F.when(n < 100, 0.06).otherwise(0.03)
    return F.when(n < 5, "empty").when((share > poor) | (noise > 0.005), "poor").when((share > noisy) | (noise > 0.001), "noisy").otherwise("clean")


def text_style() -> Column:
    """short, sparse, mixed or prose, from a profiled row."""
    share = F.col("common_word_ratio")
    return F.when(F.coalesce("n_words", F.lit(0)) < 150, "short").when(share < 0.20, "sparse").when(share < 0.33, "mixed").otherwise("prose")


def usable(quality: str = "ocr_quality") -> Column:
    return ~F.col(quality).isin("poor", "empty")


def doc_types(text: Column) -> Column:
    """All families whose pattern is found, in their fixed order."""
    hits = [F.when(text.rlike(("(?im)" if fold else "") + pattern), F.lit(name)) for name, fold, pattern in fixed.DOC_TYPES]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(fingerprint, n_docs, first_doc): texts equal but for stamps, white space and case, met more than once."""
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace("text", "(?i)" + fixed.STAMP, ""), r"\s+", " ")))
    return docs.groupBy(F.md5(plain).alias("fingerprint")).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).filter("n_docs > 1")


def histogram(rows: DataFrame, value: Column, width: float, log: bool = False) -> DataFrame:
    """(bin, n): counts in fixed-width bins of the value, or of its decimal logarithm."""
    x = F.log10(value) if log else value
    return rows.filter(value > 0 if log else value.isNotNull()).groupBy(F.floor(x / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def null_fill(rows: DataFrame) -> DataFrame:
    """(column, filled): share of non-null values per column, in one pass."""
    shares = rows.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in rows.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in rows.columns])).alias("p")
    return shares.select(pairs).select("p.column", "p.filled")
