"""Problem 1: deeply nested, changing records into flat tables that keep their parents.

One pass over each document: a depth-first visitor emits every record with the tag of its table, its key,
its parent's key and its payload.  The emitted rows are deduplicated, and may be written partitioned by tag;
each table then gets its schema from its payload.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("policy", "argument", "pro", "con", "judgment", "edge")
#: Payload schemas of the flat tables, by tag.
PAYLOADS = {
    "policy": "metapolicy string, metapolicy_id int",
    "argument": "text string, stance int, policy string, pagerank_score double, is_distractor boolean",
    "pro": "pos int",
    "con": "pos int",
    "judgment": "grade int",
    "edge": "rel string, contra_fwd double, contra_bwd double",
}
EMITTED = "export_id long, tag string, parent_key string, child_key string, kind string, at timestamp_ntz, payload string"


def _key(value: object) -> str | None:
    """A record's key as text; containers and NULL are no key."""
    if isinstance(value, str):
        return value
    return str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _named(container: object, names: tuple[str, ...]) -> Iterator[tuple[str | None, object]]:
    """(key, value) of the members of a container: of a list, a mapping from key to member, or one member by itself."""
    if isinstance(container, list):
        for member in container:
            yield None, member
    elif isinstance(container, dict) and any(n in container for n in names):
        yield None, container
    elif isinstance(container, dict):
        yield from container.items()
    elif container is not None:
        yield None, container


class Visitor:
    """Walks one export depth first and collects (tag, parent key, own key, payload), each record once."""

    def __init__(self) -> None:
        self.rows: dict[tuple[str, str, str, str], dict] = {}

    def emit(self, tag: str, parent: str, key: str, payload: dict, kind: str = "") -> None:
        """``kind`` tells records with the same ends apart: edges of different relations."""
        known = self.rows.setdefault((tag, parent, key, kind), payload)
        if known is not payload:  # the same record again: what was missing is filled in
            known.update({k: v for k, v in payload.items() if known.get(k) is None})

    def export(self, value: object) -> None:
        """An export, or wrappers around one: lists, ``export``, ``payload`` (nested or as text)."""
        while True:
            if isinstance(value, str):
                try:
                    value = json.loads(value)
                except ValueError:
                    return
            elif isinstance(value, list):
                for member in value:
                    self.export(member)
                return
            elif isinstance(value, dict) and "export" in value:
                value = value["export"]
            elif isinstance(value, dict) and "payload" in value and "arguments" not in value and "policies" not in value:
                value = value["payload"]
            else:
                break
        if not isinstance(value, dict):
            return
        for key, member in _named(value.get("arguments"), ("arg_id", "id", "text")):
            self.argument(key, member)
        for key, member in _named(value.get("policies"), ("policy", "name", "pros", "cons")):
            self.policy(key, member)
        self.edges(value.get("edges"))

    def argument(self, key: str | None, value: object) -> str | None:
        """An argument record or a bare reference; gives its id.  Only a record that holds its text counts as an argument."""
        if not isinstance(value, dict):
            return _key(value) if key is None else key
        own = _key(value.get("arg_id")) or _key(value.get("id")) or key
        if own is None:
            return None
        if value.get("text") is not None:
            self.emit("argument", "", own, {k: value.get(k) for k in ("text", "stance", "policy", "pagerank_score", "is_distractor")})
        for rater, judgment in _named(value.get("judgments"), ("annotator", "grade")):
            grade = judgment.get("grade") if isinstance(judgment, dict) else judgment
            rater = _key(judgment.get("annotator")) if isinstance(judgment, dict) and "annotator" in judgment else rater
            if rater is not None:
                self.emit("judgment", own, rater, {"grade": grade})
        for _, relation in _named(value.get("relations"), ("rel", "target")):
            if isinstance(relation, dict):
                self.edge(relation, relation.get("rel"), own)
        return own

    def policy(self, key: str | None, value: object) -> None:
        name = key
        if isinstance(value, dict):
            name = _key(value.get("policy")) or _key(value.get("name")) or key
        elif key is None:
            name = _key(value)
        if name is None:
            return
        value = value if isinstance(value, dict) else {}
        meta = value.get("metapolicy")
        meta = meta if isinstance(meta, dict) else {"name": meta}
        self.emit("policy", "", name, {"metapolicy": meta.get("name"), "metapolicy_id": meta.get("id")})
        for tag, side in (("pro", "pros"), ("con", "cons")):
            for position, (member_key, member) in enumerate(_named(value.get(side), ("arg_id", "id", "text"))):
                own = self.argument(member_key, member)
                if own is not None:
                    self.emit(tag, name, own, {"pos": position})
        self.edges(value.get("edges"))

    def edges(self, value: object) -> None:
        """Edges as a list or, by relation, as lists."""
        for rel, member in _named(value, ("source", "target", "arg1_id", "arg2_id")):
            if isinstance(member, list):
                for edge in member:
                    self.edge(edge, rel, None)
            else:
                self.edge(member, rel, None)

    def edge(self, value: object, rel: object, first: str | None) -> None:
        if not isinstance(value, dict):
            return
        for a, b in ((value.get("source"), value.get("target")), (value.get("arg1_id"), value.get("arg2_id")), (first, value.get("target"))):
            a, b = _key(a), _key(b)
            if a is not None and b is not None:
                break
        else:
            return
        scores = value.get("scores") if isinstance(value.get("scores"), dict) else {}
        contra = [s.get("contra") if isinstance(s := scores.get(way), dict) else value.get(f"contra_{way}") for way in ("fwd", "bwd")]
        name = _key(value.get("rel")) or _key(rel)
        self.emit("edge", a, b, {"rel": name, "contra_fwd": contra[0], "contra_bwd": contra[1]}, name or "")


def emit_records(df: DataFrame, key: str = "export_id", doc: str = "doc", at: str | None = None) -> DataFrame:
    """``export_id``, ``tag``, ``parent_key``, ``child_key``, ``kind`` (an edge's relation), ``at``, ``payload`` (JSON) of all records inside the documents of ``df``.

    Documents that are NULL or not valid JSON, and rows without key, give nothing.  A record that stands several times in
    one export (also in a second delivery of it) is one row.  Only the named columns are read; ``at`` is the time of a delivery.  The visitor sees one document at a
    time; only keys are shuffled to find second deliveries, payloads meet in a combined aggregate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for export, text, when in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    value = json.loads(text)
                except (ValueError, RecursionError):
                    continue
                visitor = Visitor()
                visitor.export(value)
                for (tag, parent, child, kind), payload in visitor.rows.items():
                    for column, x in zip(out, (export, tag, parent, child, kind, when, json.dumps(payload, ensure_ascii=False))):
                        column.append(x)
            types = (pa.int64(), *[pa.string()] * 4, pa.timestamp("us"), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types)], ["export_id", "tag", "parent_key", "child_key", "kind", "at", "payload"])

    when = F.col(at) if at else F.lit(None)
    rows = df.select(F.col(key).cast("long").alias("export_id"), F.col(doc).alias("doc"), when.cast("timestamp_ntz").alias("at")).where(F.col("export_id").isNotNull() & F.col("doc").isNotNull())
    return rows.mapInArrow(run, EMITTED)


def flat_records(df: DataFrame, key: str = "export_id", doc: str = "doc", at: str | None = None) -> DataFrame:
    """:func:`emit_records`, each record once per export: of several deliveries the latest counts, of the same time the one with the larger text."""
    emitted = emit_records(df, key, doc, at)
    last = F.max(F.struct("at", "payload"))["payload"].alias("payload")
    return emitted.groupBy("export_id", "tag", "parent_key", "child_key", "kind").agg(last)


def flat_table(records: DataFrame, tag: str) -> DataFrame:
    """One flat table of the emitted records: ``export_id``, ``parent_key``, ``child_key`` and the columns of its schema.

    Values that do not fit their column's type are NULL.
    """
    fields = F.from_json("payload", PAYLOADS[tag])
    return records.where(F.col("tag") == tag).select("export_id", "parent_key", "child_key", fields.alias("p")).select("export_id", "parent_key", "child_key", "p.*")


def write_tables(df: DataFrame, path: str, key: str = "export_id", doc: str = "doc", at: str | None = None) -> None:
    """Write all records in one pass, partitioned by tag, for flat_table(spark.read.parquet(path), tag)."""
    flat_records(df, key, doc, at).write.mode("overwrite").partitionBy("tag").parquet(path)
