"""The typed catalog of entities, resources, relations and evidence; aliases; imports; gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The statuses of a relation, in order; the first two are asked for by default.
RELATION_STATUSES = ["verified", "user-confirmed", "candidate", "conflicted", "rejected", "unresolved"]


def node_filter(nodes: DataFrame, entity_type: Column | None = None, query: str | None = None, properties: str = "properties") -> DataFrame:
    """Nodes of a type whose canonical properties hold a text, in any case."""
    out = nodes if entity_type is None else nodes.where(entity_type)
    return out if query is None else out.where(F.contains(F.lower(properties), F.lit(query.strip().lower())))


def touching(relations: DataFrame, key: str, ends: list[str], nodes: DataFrame, node: str) -> DataFrame:
    """Relations with an end among ``nodes``: one hash semi-join for each end, then a union of keys, in place of a nested loop for
    ``or``."""
    ids = nodes.select(F.col(node).alias("_node")).distinct()
    met = None
    for end in ends:
        one = relations.where(F.col(end).isNotNull()).join(ids, F.col(end) == F.col("_node"), "left_semi").select(key)
        met = one if met is None else met.union(one)
    return relations.join(met.distinct(), key, "left_semi")


def missing_evidence(relations: DataFrame, key: str, evidence_ids: Column, evidence: DataFrame, evidence_id: str) -> DataFrame:
    """(key, evidence_id) that relations cite and no evidence has."""
    cited = relations.select(key, F.explode(evidence_ids).alias("evidence_id")).distinct()
    return cited.join(evidence.select(F.col(evidence_id).alias("evidence_id")), "evidence_id", "left_anti")


def status_summary(relations: DataFrame, status: Column, statuses: list[str] = RELATION_STATUSES) -> DataFrame:
    """Counts by status, zeros included."""
    n = relations.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    known = relations.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return known.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def duplicate_ids(records: DataFrame, key: str) -> DataFrame:
    return records.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def alias_search(resources: DataFrame, key: str, values: list[tuple[str, Column]], query: str) -> DataFrame:
    """Resources with a value that holds the query, with their best match: an exact one first, then the kind of value in the order given.
    Sorted by exactness, then key."""
    q = query.strip().lower()
    if not q:
        raise ValueError("an empty query")
    rows = F.array(*[F.struct(F.lit(i).alias("kind_order"), F.lit(kind).alias("kind"), v.alias("value")) for i, (kind, v) in enumerate(values)])
    hits = resources.select(key, F.explode(rows).alias("m")).select(key, "m.*").where(F.contains(F.lower("value"), F.lit(q)))
    hits = hits.withColumn("exact", F.lower("value") == q)
    best = hits.groupBy(key).agg(F.min_by(F.struct("exact", "kind", "value"), F.struct((~F.col("exact")).alias("a"), "kind_order", "value")).alias("m"))
    return best.select(key, "m.*").orderBy(F.desc("exact"), key)


def ranged(rows: DataFrame, column: str, least: float | None = None, most: float | None = None) -> DataFrame:
    """Rows within the bounds; a null fails any bound."""
    out = rows if least is None else rows.where(F.col(column) >= least)
    return out if most is None else out.where(F.col(column) <= most)


def unique_types(catalog: DataFrame, ext: Column, kind: Column, order: str) -> DataFrame:
    """Extensions that all rows give one type, with the first row that does."""
    return catalog.groupBy(ext.alias("ext")).agg(F.min(kind).alias("kind"), F.max(kind).alias("_other"), F.min(order).alias("first_row")).where("kind = _other").drop("_other")


def upsert_last(rows: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """The last row of each key wins."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), order).alias("v")).select(*key, "v.*")


def gap_counts(inventory: DataFrame, tracked: DataFrame, key: list[str], status: str) -> DataFrame:
    """Rows of the inventory by tracked status; ``not-started`` where nothing is tracked."""
    return inventory.join(tracked, key, "left").groupBy(F.coalesce(status, F.lit("not-started")).alias("status")).agg(F.count("*").alias("n"))


def gap_rules(gaps: DataFrame, key: str, status: str, disposition: str) -> DataFrame:
    """(key, rule) for each rule that a record's gaps break: complete has none planned and none external, partial has one planned, blocked one external."""
    have = gaps.groupBy(key).agg(F.min(status).alias("s"), F.coalesce(F.bool_or(F.col(disposition) == "planned"), F.lit(False)).alias("planned"), F.coalesce(F.bool_or(F.col(disposition) == "external"), F.lit(False)).alias("external"))
    broken = F.expr("array_compact(array(if(s = 'complete' and planned, 'complete-has-planned', null), if(s = 'complete' and external, 'complete-has-external', null), if(s = 'partial' and not planned, 'partial-lacks-planned', null), if(s = 'blocked' and not external, 'blocked-lacks-external', null)))")
    return have.select(key, F.explode(broken).alias("rule"))


def companions(files: DataFrame, directory: str, name: str, path: str) -> DataFrame:
    """(path, companion): the other files of a file's folder whose names start with its own without the last extension, and a dot.

    A name is listed under what stands before each of its dots, so the two meet by equality."""
    before = F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda i: F.array_join(F.slice("_p", 1, i), "."))
    other = files.select(directory, F.col(path).alias("companion"), F.split(name, "[.]").alias("_p")).where("size(_p) > 1").select(directory, "companion", F.explode(before).alias("_base"))
    own = files.select(directory, path, F.regexp_replace(name, r"\.[^.]*$", "").alias("_base")).where("_base <> ''")
    return own.join(other, [directory, "_base"]).where(F.col(path) != F.col("companion")).select(path, "companion")


def companion_named(files: DataFrame, directory: str, name: str, path: str, wanted: str) -> DataFrame:
    """(path, companion): the file of a given name beside each file, or null."""
    other = files.where(F.lower(name) == wanted.lower()).select(directory, F.col(path).alias("companion"))
    return files.join(other, directory, "left").select(path, "companion")


def companions_by_extension(files: DataFrame, directory: str, ext: str, path: str, wanted: str) -> DataFrame:
    """(path, companion): the first file of an extension in a file's own folder, else in the folder above; or null."""
    parent = F.regexp_extract(directory, r"^(.*)/[^/]*$", 1)
    found = files.where(F.lower(ext) == wanted.lower()).groupBy(directory).agg(F.min(path).alias("_found"))
    own = found.select(F.col(directory).alias("_own"), F.col("_found").alias("_a"))
    above = found.select(F.col(directory).alias("_up"), F.col("_found").alias("_b"))
    out = files.join(own, F.col(directory) == F.col("_own"), "left").join(above, parent == F.col("_up"), "left")
    return out.select(path, F.coalesce("_a", "_b").alias("companion"))
