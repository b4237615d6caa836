"""Scalar functions on text, numbers and identifiers: column expressions throughout."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stance codes and their labels.
STANCE_LABELS = {1: "PRO", -1: "CON", 0: "NEUTRAL"}
# The fields of a structured summary.
SUMMARY_FIELDS = ("STRONGEST_PRO", "STRONGEST_CON", "KEY_TENSION", "MISSING_PERSPECTIVES", "OVERALL_BALANCE")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column | str) -> Column:
    """``text`` without white space of any kind at its ends (``trim`` takes only spaces)."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def collapse_space(text: Column | str) -> Column:
    return strip(F.regexp_replace(_col(text), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def compatibility_form(text: Column | str) -> Column:
    """NFKD; only texts beyond ASCII leave the JVM."""
    text = _col(text)
    return F.coalesce(_nfkd(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def clean_text(text: Column | str, decompose: bool = True) -> Column:
    """Corpus cleaning: NFKD, no URLs, no tags, no [n] references, single spaces; NULL gives ''."""
    text = F.coalesce(_col(text), F.lit(""))
    if decompose:
        text = compatibility_form(text)
    for pattern in (r"https?://\S+", r"<.*?>", r"\[\d+\]"):
        text = F.regexp_replace(text, pattern, "")
    return collapse_space(text)


def stance_label(stance: Column | str) -> Column:
    """PRO, CON or NEUTRAL; NULL for any other value."""
    stance, out = _col(stance), None
    for code, label in STANCE_LABELS.items():
        out = F.when(stance == code, label) if out is None else out.when(stance == code, label)
    return out


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_name(text: Column | str) -> Column:
    return F.replace(F.lower(_col(text)), F.lit(" "), F.lit("_"))


def token_count(text: Column | str) -> Column:
    """Words between white space; 0 for NULL and blank texts."""
    stripped = strip(F.coalesce(_col(text), F.lit("")))
    return F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, r"(?U)\s+")))


def conciseness(text: Column | str) -> Column:
    """Sentences per hundred words: max(1, runs of . ! ?) / words * 100; NULL for blank texts."""
    sentences = F.greatest(F.lit(1), F.regexp_count(_col(text), F.lit("[.!?]+")))
    words = token_count(text)
    return F.when(words > 0, sentences / words * 100)


def acceptable_paragraph(text: Column | str, least: int = 50) -> Column:
    return token_count(strip_model_noise(text)) >= least


def strip_model_noise(raw: Column | str) -> Column:
    """A model's answer without its thinking and without code fences."""
    raw = F.regexp_replace(_col(raw), r"(?is)<think(ing)?>.*?</think(ing)?>", "")
    return strip(F.regexp_replace(raw, r"```(?:json)?", ""))


def render_summary(fields: dict[str, Column | str]) -> Column:
    """The five labelled lines of a structured summary; missing fields are empty."""
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(_col(fields[name]) if name in fields else F.lit(""), F.lit(""))) for name in SUMMARY_FIELDS]
    return F.concat_ws("\n", *lines)


def summary_field(text: Column | str, name: str) -> Column:
    """One field of a rendered summary: what stands behind its label up to the next label; NULL without the label."""
    others = "|".join(SUMMARY_FIELDS)
    found = F.regexp_extract(_col(text), rf"(?s)(?:^|\n){name}: (.*?)(?=\n(?:{others}): |$)", 1)
    return F.when(_col(text).rlike(rf"(?:^|\n){name}: "), found)


def numbered_list(items: Column | str) -> Column:
    """'1. first' and so on, one line per element."""
    return F.array_join(F.transform(_col(items), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def bulleted_list(items: Column | str) -> Column:
    return F.array_join(F.transform(_col(items), lambda x: F.concat(F.lit("- "), x)), "\n")


def config_part(name: Column | str, part: str) -> Column:
    """``pool`` or ``k`` of a configuration name such as pool100_k5."""
    pattern = {"pool": r"pool(\d+)_k\d+", "k": r"pool\d+_k(\d+)"}[part]
    return F.regexp_extract(_col(name), pattern, 1).try_cast("int")


def pair_ends(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """The ends of an unordered pair, smaller one first."""
    return F.least(_col(a), _col(b)), F.greatest(_col(a), _col(b))


def gain(grade: Column | str, exponential: bool = True) -> Column:
    grade = _col(grade).cast("double")
    return F.pow(F.lit(2.0), grade) - 1 if exponential else grade


def fmt(value: Column | str, digits: int = 3) -> Column:
    """A number as text with ``digits`` decimals, '-' for NULL."""
    return F.when(_col(value).isNull(), "-").otherwise(F.format_string(f"%.{digits}f", _col(value)))


def percent(part: Column | str, whole: Column | str) -> Column:
    """'12.5%' of two counts; '(no data)' where the whole is 0 or NULL.

    Rounded as C does: the double 100 * part / whole by its exact value, and exact halves to the even digit.  ``format_string`` rounds its shortest
    decimal form, halves up, and so differs at 6.25 and 0.15.  The digits behind the point are taken in units of 2^-57, in which doubles from 1/32 on are whole.
    """
    share = _col(part) * F.lit(100.0) / F.nullif(_col(whole), F.lit(0))
    ten = ((share - F.floor(share)) * F.lit(2.0**57)).cast("long") * 10
    tenth, rest, half = F.shiftright(ten, 57), ten.bitwiseAND(F.lit((1 << 57) - 1)), F.lit(1 << 56)
    up = (rest > half) | ((rest == half) & (tenth % 2 == 1))
    tenths = F.floor(share) * 10 + tenth + up.cast("int")
    return F.when(share.isNull(), "(no data)").otherwise(F.format_string("%d.%d%%", F.floor(tenths / 10), tenths % 10))


def range_label(low: Column | str, high: Column | str) -> Column:
    return F.format_string("%d–%d args", _col(low), _col(high))


def positive_weight(*candidates: Column | str) -> Column:
    """The first given weight, 1 where it is missing or not positive."""
    weight = F.coalesce(*[_col(c).cast("double") for c in candidates], F.lit(1.0))
    return F.when(weight > 0, weight).otherwise(F.lit(1.0))


def exact_sum(value: Column | str) -> Column:
    """Sum of a double column in decimals: the same whatever the order of the rows, so it does not depend on partitioning."""
    return F.sum(_col(value).cast("decimal(30,15)"))


def exact_mean(value: Column | str) -> Column:
    """Mean from :func:`exact_sum`; NULL without values."""
    return exact_sum(value).cast("double") / F.nullif(F.count(_col(value)), F.lit(0))


def half_up(value: Column | str) -> Column:
    """Rounded to an integer, halves upward."""
    return F.floor(_col(value) + 0.5).cast("int")
