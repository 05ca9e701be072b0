"""Catalogs of typed records as JSON lines: read, validate, query, summarise, write.

The first record is the header; the others are entities, resources, relations, evidence and diagnostics, told apart by ``kind``."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import semantic

RECORD = (
    "kind string, id string, type string, properties string, resourceType string, locator struct<source:struct<rootId:string,path:string>,entryId:string>, subject string, predicate string, "
    "object struct<kind:string,id:string,value:string>, qualifiers string, evidenceIds array<string>, status string, source string, producer string, method string, "
    "severity string, code string, message string, relatedIds array<string>"
)


MAX_BYTES, MAX_RECORDS = 256 << 20, 1_000_000


@dataclass
class Vocabulary:
    """Registered entity types and predicates; what isn't registered is kept, and not checked."""

    types: list[str]
    #: predicate: (subject types, object types or None, whether literals are allowed)
    predicates: dict[str, tuple[list[str], list[str] | None, bool]]

    #: type or predicate: of its JSON text (properties or qualifiers) an array of struct<path, message>
    validators: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    #: namespace: version
    versions: dict[str, int] = field(default_factory=dict)

    def names(self) -> list[tuple[str, int]]:
        """The namespaces, sorted, each with its version."""
        return sorted(self.versions.items())

    def with_vocabulary(self, namespace: str, version: int, more: Vocabulary) -> Vocabulary:
        """Both together; ValueError for a bad namespace or version, names outside the namespace, and what is registered already."""
        if not re.fullmatch("[a-z][a-z0-9_-]*", namespace) or version < 1:
            raise ValueError(f"Invalid vocabulary: {namespace}@{version}")
        if namespace in self.versions:
            raise ValueError(f"Vocabulary already registered: {namespace}")
        for name in [*more.types, *more.predicates]:
            if name.split(":")[0] != namespace or name in self.types or name in self.predicates:
                raise ValueError(f"{name} is outside vocabulary {namespace} or registered already")
        return Vocabulary([*self.types, *more.types], self.predicates | more.predicates, self.validators | more.validators, self.versions | {namespace: version})

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p, s, o, lit) for p, (s, o, lit) in sorted(self.predicates.items())]
        return spark.createDataFrame(rows, "predicate string, subject_types array<string>, object_types array<string>, literal boolean")


# The default vocabulary; another may take its place.
DEFAULT = Vocabulary(
    ["core:resource", "core:alias", "vn:game", "vn:character", "vn:dialogue", "vn:scene"],
    {
        "core:aliasOf": (["core:alias"], ["core:resource"], False),
        "vn:spokenBy": (["vn:dialogue"], ["vn:character"], False),
        "vn:playsResource": (["vn:dialogue", "vn:scene"], ["core:resource"], False),
        "vn:voiceResource": (["vn:character"], ["core:resource"], False),
        "vn:appearsIn": (["vn:character"], ["vn:scene"], False),
    },
    versions={"core": 1, "vn": 1},
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The records, each with its raw line; blank lines are skipped, and a damaged one raises an error when it is read."""
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.select(F.from_json("value", RECORD, {"mode": "FAILFAST"}).alias("r"), F.col("value").alias("line"))
    return parsed.select("r.*", "line").where(F.col("kind") != "header")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1) and value of each line, blank ones included.

    A file is read in blocks; the counts of its blocks, summed in order, say where each block's lines begin, so no file is read by one task."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    blocks = text.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return text.join(starts, ["file", "_block"]).select("file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "value")


def damaged_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no and message of each line that isn't blank and holds no JSON object."""
    kept = numbered_lines(spark, path).where(F.length("value") > 0)
    parsed = F.from_json("value", "kind string, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    bad = kept.where(parsed["_broken"].isNotNull() | parsed.isNull())
    return bad.select("file", "line_no", F.concat(F.lit("Invalid catalog JSON on line "), F.col("line_no").cast("string")).alias("message"))


def load(spark: SparkSession, path: str, vocabulary: Vocabulary = DEFAULT, max_bytes: int = MAX_BYTES, max_records: int = MAX_RECORDS, check: bool = True) -> tuple[dict, Catalog]:
    """The header and the catalog of a file or folder; raises ValueError for one that is too large, empty, damaged or not valid (the first 100 issues)."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if size is None or size > max_bytes:
        raise ValueError("LIMIT_EXCEEDED: the catalog is empty or too large" if size else "INVALID_ARGUMENT: the catalog is empty")
    if bad := damaged_lines(spark, path).orderBy("file", "line_no").first():
        raise ValueError(f"INVALID_ARGUMENT: {bad.message}")
    first = numbered_lines(spark, path).where(F.length("value") > 0).orderBy("file", "line_no").first()
    header = json.loads(first.value) if first else {}
    if header.get("kind") != "header" or header.get("schemaVersion") != 1:
        raise ValueError("INVALID_ARGUMENT: the first record is no header")
    catalog = Catalog(lines(spark, path), vocabulary)
    if catalog.records.count() > max_records:
        raise ValueError("LIMIT_EXCEEDED: the catalog has too many records")
    if check and (wrong := catalog.first_issues()):
        raise ValueError("INVALID_ARGUMENT: " + "; ".join(f"{p}: {m}" for p, m in wrong))
    return header, catalog


class Catalog:
    def __init__(self, records: DataFrame, vocabulary: Vocabulary = DEFAULT) -> None:
        self.records, self.vocabulary, self.spark = records, vocabulary, records.sparkSession
        of = lambda *kinds: records.where(F.col("kind").isin(*kinds))
        self.nodes, self.relations, self.evidence, self.diagnostics = of("entity", "resource"), of("relation"), of("evidence"), of("diagnostic")

    def issues(self) -> DataFrame:
        """path, message of all that is wrong."""
        own = F.expr("""filter(array(
          if(kind = 'resource' and coalesce(resourceType, '') = '', struct(concat(id, '.resourceType') as path, 'Resource type is empty' as message), null),
          if(kind = 'resource' and (coalesce(locator.source.rootId, '') = '' or coalesce(locator.source.path, '') = ''), struct(concat(id, '.locator') as path, 'Resource locator is incomplete' as message), null)), x -> x is not null)""")
        of_nodes = self.nodes.select(F.explode(own).alias("i")).select("i.*")
        ends = self.nodes.select("id", "type")
        known = self.relations.join(F.broadcast(self.vocabulary.table(self.spark)), "predicate")
        joined = known.join(ends.select(F.col("id").alias("subject"), F.col("type").alias("_s")), "subject", "left")
        joined = joined.join(ends.select(F.col("id").alias("_o"), F.col("type").alias("_ot")), F.col("object.id") == F.col("_o"), "left")
        wrong = F.expr("""filter(array(
          case when _s is null then struct(concat(id, '.subject') as path, 'Subject entity is missing' as message)
               when not array_contains(subject_types, _s) then struct(concat(id, '.subject') as path, concat('Predicate ', predicate, ' does not accept ', _s) as message) end,
          case when object.kind = 'literal' then if(literal, null, struct(concat(id, '.object') as path, concat('Predicate ', predicate, ' does not accept literals') as message))
               when _ot is null then struct(concat(id, '.object') as path, 'Object entity is missing' as message)
               when object_types is not null and not array_contains(object_types, _ot) then struct(concat(id, '.object') as path, concat('Predicate ', predicate, ' does not accept ', _ot) as message) end), x -> x is not null)""")
        of_relations = joined.select(F.explode(wrong).alias("i")).select("i.*")
        missing = semantic.missing_evidence(self.relations, "id", F.col("evidenceIds"), self.evidence, "id")
        of_evidence = missing.select(F.concat("id", F.lit(".evidenceIds")).alias("path"), F.concat(F.lit("Evidence is missing: "), "evidence_id").alias("message"))
        doubled = semantic.duplicate_ids(self.records, "id").select(F.col("id").alias("path"), F.lit("Duplicate record ID").alias("message"))
        out = of_nodes.unionByName(of_relations).unionByName(of_evidence).unionByName(doubled)
        for name, validator in sorted(self.vocabulary.validators.items()):
            rows, key, text = (self.relations, "predicate", "qualifiers") if name in self.vocabulary.predicates else (self.nodes, "type", "properties")
            given = rows.where((F.col(key) == name) & F.col(text).isNotNull()).select("id", F.explode(validator(F.col(text))).alias("i"))
            out = out.unionByName(given.select(F.concat("id", F.lit(f".{text}"), F.when(F.col("i.path") != "", F.concat(F.lit("."), "i.path")).otherwise("")).alias("path"), "i.message"))
        return out

    def first_issues(self, n: int = 100) -> list[tuple[str, str]]:
        """The first issues, by path."""
        return [(r.path, r.message) for r in self.issues().orderBy("path", "message").limit(n).collect()]

    def query(self, entity_type: str | None = None, resource_type: str | None = None, query: str | None = None, predicate: str | None = None, statuses: list[str] = ("verified", "user-confirmed")) -> tuple[DataFrame, DataFrame]:
        """The nodes and the relations that are asked for.

        Nodes aren't filtered by predicate.  Relations must touch a node if a type or a text is asked for, even an empty one; a
        resource type alone doesn't bind them.  Relations of unregistered predicates are not found."""
        nodes = self.nodes
        if entity_type is not None:
            nodes = nodes.where(F.col("type") == entity_type)
        if resource_type is not None:
            nodes = nodes.where((F.col("kind") == "resource") & (F.col("resourceType") == resource_type))
        text = None if query is None else query.strip().lower()
        if text:
            nodes = nodes.where(F.contains(F.lower(hashing.canonical_json(F.coalesce("properties", F.lit("{}")))), F.lit(text)))
        relations = self.relations.where(F.col("status").isin(list(statuses)) & F.col("predicate").isin(list(self.vocabulary.predicates)))
        if predicate is not None:
            relations = relations.where(F.col("predicate") == predicate)
        if entity_type is not None or text is not None:
            keyed = relations.withColumn("_obj", F.when(F.col("object.kind") == "entity", F.col("object.id")))
            relations = semantic.touching(keyed, "id", ["subject", "_obj"], nodes, "id").drop("_obj")
        return nodes, relations

    def summary(self) -> DataFrame:
        """One row: records by kind, and relations by status (zeros included)."""
        kinds = {"entities": "entity", "resources": "resource", "relations": "relation", "evidence": "evidence", "diagnostics": "diagnostic"}
        counts = [F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()]
        states = [F.count_if((F.col("kind") == "relation") & (F.col("status") == s)).alias(s.replace("-", "_")) for s in semantic.RELATION_STATUSES]
        return self.records.agg(F.count("*").alias("records"), *counts, *states)
