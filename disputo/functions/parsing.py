"""Parsing of model answers: JSON objects with repairs, A/B verdicts, grade lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disputo.functions.scalars import strip, strip_model_noise

# Endings tried, in this order, to complete a JSON object that was cut inside a list.
LIST_ENDINGS = ("]}", "]\n}", "  ]\n}", "}]}", '"}]}')


def parse_json_object(raw: Column | str, schema: str, required: tuple[str, ...] = (), list_recovery: bool = False) -> Column:
    """The outermost {...} of a model's answer as a struct of ``schema``.

    With ``list_recovery`` a text that is no JSON is completed by each ending in turn.  NULL if there is no brace, nothing parses, or a required
    field is missing.  ``try_parse_json`` decides whether a candidate is JSON at all, so a broken object never becomes a struct of NULLs.
    """
    noise_free = strip_model_noise(raw)
    body = F.nullif(F.regexp_extract(noise_free, r"(?s)\{.*\}", 0), F.lit(""))
    out = None
    for ending in ("", *(LIST_ENDINGS if list_recovery else ())):
        candidate = F.concat(body, F.lit(ending))
        is_json = F.try_parse_json(candidate).isNotNull()
        out = F.when(is_json, F.from_json(candidate, schema)) if out is None else out.when(is_json, F.from_json(candidate, schema))
    for field in required:
        out = F.when(out[field].isNotNull(), out)
    return out


def parse_ab(raw: Column | str) -> Column:
    """The verdict A or B: the first line that is the letter alone or starts with it before a non-letter; else NULL."""
    lines = F.transform(F.split(strip_model_noise(raw), "\n"), lambda line: F.upper(strip(line)))
    hits = F.filter(lines, lambda line: line.rlike(r"^[AB]([^A-Z]|$)"))
    return F.substring(F.get(hits, F.lit(0)), 1, 1)


def grade_pairs(raw: Column | str) -> Column:
    """All complete ("id", "grade") pairs of a text, also of truncated ones: array of (id, grade), in order; only whole grades 0 to 3."""
    pattern = r'"id"\s*:\s*(\d+)\s*,\s*"grade"\s*:\s*([0-3])\b'
    ids = F.regexp_extract_all(raw, F.lit(pattern), F.lit(1))
    grades = F.regexp_extract_all(raw, F.lit(pattern), F.lit(2))
    return F.zip_with(ids, grades, lambda i, g: F.struct(i.try_cast("int").alias("id"), g.cast("int").alias("grade")))


def grade_entries(raw: Column | str, expected: Column | str) -> Column:
    """The (id, grade) entries of an answer: those of its JSON, or those found by :func:`grade_pairs` where the JSON has fewer than ``expected`` and they are more.

    JSON entries may have text numbers; entries without a whole id and grade do not count.
    """
    expected = F.col(expected) if isinstance(expected, str) else expected
    parsed = parse_json_object(raw, "grades array<struct<id string, grade string>>", ("grades",), list_recovery=True)["grades"]
    whole = F.transform(parsed, lambda e: F.struct(F.trim(e["id"]).try_cast("int").alias("id"), F.trim(e["grade"]).try_cast("int").alias("grade")))
    entries = F.coalesce(F.filter(whole, lambda e: e["id"].isNotNull() & e["grade"].isNotNull()), F.array().cast("array<struct<id:int,grade:int>>"))
    salvaged = grade_pairs(raw)
    return F.when((F.size(entries) < expected) & (F.size(salvaged) > F.size(entries)), salvaged).otherwise(entries)


def parse_grades(df: DataFrame, request: str, raw: str, expected: str, coverage: float = 0.9) -> DataFrame:
    """(``request``, ``id``, ``grade``) for ids 1..expected, NULL where a grade is missing; the first of several grades of an id counts.

    A request with fewer than ``coverage`` of its grades (ids in range, grades 0 to 3) is rejected: it has no rows.  Every answer is read by itself.
    """
    entries = grade_entries(strip_model_noise(raw), F.col("expected"))
    wide = df.select(F.col(request).alias("request"), F.col(expected).cast("int").alias("expected"), F.col(raw)).withColumn("entries", entries)
    fit = F.filter("entries", lambda e: e["id"].between(1, F.col("expected")) & e["grade"].between(0, 3))
    grades = F.transform(F.sequence(F.lit(1), F.col("expected")), lambda i: F.get(F.filter("entries", lambda e: e["id"] == i)["grade"], F.lit(0)))
    aligned = wide.withColumn("entries", fit).withColumn("grades", F.when(F.col("expected") > 0, grades))
    accepted = aligned.where(F.size(F.filter("grades", lambda g: g.isNotNull())) >= F.col("expected") * coverage)
    return accepted.select(F.col("request").alias(request), F.posexplode("grades").alias("id", "grade")).withColumn("id", F.col("id") + 1)
