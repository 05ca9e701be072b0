"""Maps of subjects to resources (CSV or JSON), and alias catalogs."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, paths

REQUIRED = ["subject_type", "subject_key", "predicate", "resource_type", "resource_path"]
COLUMNS = [*REQUIRED, "subject_name", "entry_id", "root_id", "override"]
MAP = "row int, subject_type string, subject_key string, predicate string, resource_type string, resource_path string, subject_name string, entry_id string, root_id string, override boolean"
_NAME = re.compile(r"[a-z][a-z0-9-]*:[A-Za-z][A-Za-z0-9]*")
#: A field: a quoted part at its very start, what follows, and the mark that ends it.
_FIELD = re.compile(r'(?:"((?:[^"]|"")*)")?([^,\r\n]*)(,|\r\n|\r|\n|\Z)')

ALIASES = "aliases array<string>, locale string, locator struct<source:struct<rootId:string,path:string>,entryId:string>, metadata struct<title:string,durationSeconds:double,codec:string,channels:int>, expected struct<sha256:string,decodedSha256:string>"


def csv_rows(text: str) -> list[list[str]]:
    """Rows of fields.  A quote opens only at a field's start; rows of empty fields are left out."""
    out, row, at = [], [], 0
    while True:
        m = _FIELD.match(text, at)
        if m[1] is None and text.startswith('"', at):
            raise ValueError("a quote that isn't closed")
        row.append((m[1] or "").replace('""', '"') + m[2])
        at = m.end()
        if m[3] != ",":
            if any(row):
                out.append(row)
            row = []
            if not m[3]:
                return out


def read_map(text: str, kind: str) -> list[dict]:
    """The rows of a map as dictionaries of COLUMNS."""
    text = text.removeprefix("﻿")
    if kind == "json":
        body = json.loads(text)
        if body.get("schemaVersion") != 1:
            raise ValueError("schemaVersion must be 1")
        snake = lambda k: re.sub("([A-Z])", lambda m: "_" + m[1].lower(), k)
        rows = [{snake(k): v for k, v in r.items()} for r in body["mappings"]]
    else:
        header, *lines = csv_rows(text) or [[]]
        names = [h.strip() for h in header]
        if missing := [c for c in REQUIRED if c not in names]:
            raise ValueError(f"columns are missing: {missing}")
        rows = [{n: v.strip() for n, v in zip(names, line, strict=False) if v.strip()} for line in lines]
    out = []
    for i, r in enumerate(rows, 1):
        if lacking := [c for c in REQUIRED if not r.get(c)]:
            raise ValueError(f"row {i} lacks {lacking}")
        if not (_NAME.fullmatch(r["subject_type"]) and _NAME.fullmatch(r["predicate"])):
            raise ValueError(f"row {i} has a name without a namespace")
        override = r.get("override")
        if override not in (None, True, False, "true", "false"):
            raise ValueError(f"row {i} has an override that is neither true nor false")
        out.append({"row": i} | {c: r.get(c) for c in COLUMNS} | {"override": None if override is None else str(override).lower() == "true"})
    return out


def map_table(spark: SparkSession, text: str, kind: str) -> DataFrame:
    return spark.createDataFrame([tuple(r[n.split()[0]] for n in MAP.split(", ")) for r in read_map(text, kind)], MAP)


def _id(prefix: str, *pairs: tuple[str, object]):
    """prefix:sha256 of the canonical JSON of an object whose keys are given in order; nested columns are JSON already."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in pairs]
    return hashing.stable_id(prefix, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def records(rows: DataFrame, root_id: str, path: str, sha256: str, namespace: str = "core") -> DataFrame:
    """kind, id and the fields of the entity, resource, evidence and relation of each row; of records with one id the last row's stays."""
    quoted = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.substring(F.to_json(F.array(c)), 2, 1 << 30))
    text = lambda c: F.regexp_replace(quoted(c), r"\]$", "")
    root, place = F.coalesce("root_id", F.lit(root_id)), paths.normalised(F.col("resource_path"))
    source = F.lit(json.dumps({"path": path, "rootId": root_id}, separators=(",", ":"), ensure_ascii=False))
    ids = rows.withColumns(
        {
            "entity_id": _id("entity", ("key", text(F.col("subject_key"))), ("type", text(F.col("subject_type")))),
            "resource_id": _id("resource", ("entryId", text(F.col("entry_id"))), ("path", text(place)), ("rootId", text(root))),
            "evidence_id": _id("evidence", ("row", F.col("row").cast("string")), ("sha256", F.lit(f'"{sha256}"')), ("source", source)),
        }
    )
    ids = ids.withColumn("relation_id", _id("relation", *((k, text(v)) for k, v in (("evidenceId", F.col("evidence_id")), ("predicate", F.col("predicate")), ("resourceId", F.col("resource_id")), ("subjectId", F.col("entity_id"))))))
    none = F.lit(None).cast("string")
    make = lambda kind, id_, **more: F.struct(F.lit(kind).alias("kind"), F.col(id_).alias("id"), *[more.get(n, none).alias(n) for n in ("type", "properties", "resource_type", "root_id", "path", "entry_id", "subject", "predicate", "object_id", "evidence_id", "status", "qualifiers")])
    entity = make("entity", "entity_id", type=F.col("subject_type"), properties=F.to_json(F.struct(F.col("subject_key").alias("key"), F.col("subject_name").alias("name"))))
    resource = make("resource", "resource_id", type=F.lit(f"{namespace}:resource"), properties=F.lit("{}"), resource_type=F.col("resource_type"), root_id=root, path=place, entry_id=F.col("entry_id"))
    evidence = make("evidence", "evidence_id", type=F.lit(f"{namespace}:userMapping"), properties=F.to_json(F.struct("row")))
    relation = make("relation", "relation_id", subject=F.col("entity_id"), predicate=F.col("predicate"), object_id=F.col("resource_id"), evidence_id=F.col("evidence_id"), status=F.lit("user-confirmed"), qualifiers=F.when(F.col("override"), F.lit('{"userOverride":true}')))
    all_ = ids.select("row", F.explode(F.array(entity, resource, evidence, relation)).alias("r")).select("row", "r.*")
    last = all_.groupBy("id").agg(F.max_by(F.struct(*[c for c in all_.columns if c != "row"]), "row").alias("r"))
    return last.select("r.*")


def alias_table(spark: SparkSession, path: str) -> DataFrame:
    """The resources of alias catalogs, with a flat column for each field that is searched."""
    raw = spark.read.schema(f"schemaVersion int, resources array<struct<{', '.join(p.replace(' ', ':', 1) for p in _split(ALIASES))}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = raw.where("schemaVersion = 1").select(F.explode("resources").alias("r")).select("r.*")
    return rows.where("locator.source.path is not null and size(aliases) > 0").select(
        "aliases", "locale", F.col("locator.source.rootId").alias("root_id"), F.col("locator.source.path").alias("path"), F.col("locator.entryId").alias("entry_id"),
        F.col("metadata.title").alias("title"), F.col("metadata.durationSeconds").alias("duration_seconds"), F.col("metadata.codec").alias("codec"), F.col("metadata.channels").alias("channels"),
        F.col("expected.sha256").alias("sha256"), F.col("expected.decodedSha256").alias("decoded_sha256"),
    )


def _split(schema: str) -> list[str]:
    out, depth, last = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(last.strip())
            last = ""
        else:
            last += c
    return [*out, last.strip()]


def alias_rows(resources: DataFrame) -> DataFrame:
    """A map row for each alias of each resource; its number follows from the resource and the alias's place, however the rows are dealt."""
    rows = resources.select("*", F.posexplode("aliases").alias("_p", "alias"))
    key = F.concat(F.coalesce("locale", F.lit("")), F.lit("\0"), F.col("alias"))
    return rows.select(F.xxhash64("root_id", "path", "entry_id", "locale", "_p", "alias").alias("row"), F.lit("core:alias").alias("subject_type"), key.alias("subject_key"), F.lit("core:aliasOf").alias("predicate"), F.lit("unknown").alias("resource_type"), F.col("path").alias("resource_path"), F.col("alias").alias("subject_name"), "entry_id", "root_id", F.lit(None).cast("boolean").alias("override"))


def search(resources: DataFrame, query: str, root_id: str | None = None, locale: str | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    """root_id, path, entry_id, matched_by, value, exact: the best match of each resource; exact ones first, then by path."""
    from ..operators.semantic import ranged

    q = query.strip().lower()
    if not q:
        raise ValueError("an empty query")
    rows = resources if root_id is None else resources.where(F.col("root_id") == root_id)
    rows = ranged(rows if locale is None else rows.where(F.col("locale") == locale), "duration_seconds", least, most)
    kinds = F.concat(F.transform("aliases", lambda a: F.struct(F.lit("alias").alias("kind"), a.alias("value"))), F.array(F.struct(F.lit("title").alias("kind"), F.col("title").alias("value")), F.struct(F.lit("path").alias("kind"), F.col("path").alias("value"))))
    # a resource's values lie in its row: the best one is found there, without a shuffle
    hits = F.filter(kinds, lambda v: F.contains(F.lower(v["value"]), F.lit(q)))
    rows = rows.withColumn("_h", hits).where(F.size("_h") > 0).withColumn("_e", F.filter("_h", lambda v: F.lower(v["value"]) == q))
    rows = rows.withColumn("_m", F.coalesce(F.get("_e", F.lit(0)), F.get("_h", F.lit(0))))
    out = rows.select("root_id", "path", "entry_id", F.col("_m.kind").alias("matched_by"), F.col("_m.value").alias("value"), (F.size("_e") > 0).alias("exact"))
    return out.orderBy(F.desc("exact"), F.collate("path", "UNICODE"))
