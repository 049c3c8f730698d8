"""Endpoints of signal, handler and component edges, from placeholders to the nodes they mean.

Edges have repo_path, edge_id, source, target, relation, confidence, source_file and a map
``metadata``; nodes have repo_path, node_id, kind, label, source_ref, granularity and such a map.
Every step is joins on (repository, name) or (repository, file, name); a name that several nodes
bear is never guessed.

Defined results: null ids and names match nothing; what stays unknown keeps its placeholder, handlers
and components that stay unknown are marked unverified and handlers become LOW; a connection of a
node to itself is dropped; repeated edges count once; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KEY = ["repo_path", "edge_id"]


def with_metadata(rows: DataFrame) -> DataFrame:
    """Rows with the column ``metadata`` read from their JSON text; what is no JSON object gives an empty map."""
    return rows.withColumn("metadata", F.coalesce(F.from_json("metadata_json", "map<string,string>"), F.create_map().cast("map<string,string>")))


def _meta(name: str) -> Column:
    return F.col("metadata")[name]


def declared_signals(nodes: DataFrame) -> DataFrame:
    """(repo_path, path, name, qt, node_id): signals and slots by the file that declares them; of equal names
    in one file the greatest id stands."""
    n = nodes.where(_meta("qt").isin("signal", "slot") & F.col("label").isNotNull())
    return n.groupBy("repo_path", F.col("source_ref").alias("path"), F.col("label").alias("name"), _meta("qt").alias("qt")).agg(F.max("node_id").alias("node_id"))


def class_places(nodes: DataFrame) -> DataFrame:
    """(repo_path, class, path): the first file of every class name."""
    return nodes.where("kind = 'class' AND label IS NOT NULL").groupBy("repo_path", F.col("label").alias("class")).agg(F.min("source_ref").alias("path"))


def component_exports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_path, uri, version, name, targets): files that modules export under a name."""
    x = edges.where("relation = 'exports' AND source LIKE 'export:%' AND target LIKE 'file:%'").select("repo_path", F.col("source").alias("node_id"), "target")
    n = nodes.where(_meta("qml_kind") == "export").select("repo_path", "node_id", F.coalesce(_meta("uri"), F.lit("")).alias("uri"), F.coalesce(_meta("version"), F.lit("")).alias("version"), F.col("label").alias("name"))
    files = nodes.where("source_ref IS NOT NULL").select("repo_path", F.concat(F.lit("file:"), "source_ref").alias("target")).distinct()
    j = x.join(n, ["repo_path", "node_id"]).join(files, ["repo_path", "target"], "left_semi")
    return j.groupBy("repo_path", "uri", "version", "name").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def _unique(signals: DataFrame, qt: list[str]) -> DataFrame:
    """(repo_path, name, node_id) of names that one declaration bears."""
    s = signals.where(F.col("qt").isin(qt)).groupBy("repo_path", "name").agg(F.min("node_id").alias("node_id"), F.countDistinct("node_id").alias("n"))
    return s.where("n = 1").drop("n")


def resolved_emits(edges: DataFrame, signals: DataFrame) -> DataFrame:
    """(repo_path, edge_id, new_target): through the files the emitting file imports, in their order, else by a unique name."""
    e = edges.where((F.col("relation") == "emits") & (F.col("target") == F.concat(F.lit("module:"), _meta("signal_name")))).select(*_KEY, "source_file", _meta("signal_name").alias("name"))
    i = edges.where("relation = 'imports' AND target LIKE 'file:%'").select("repo_path", F.expr("substring(source, 6)").alias("source_file"), F.expr("substring(target, 6)").alias("path"), F.col("edge_id").alias("pos"))
    s = signals.where("qt = 'signal'").select("repo_path", "path", "name", "node_id")
    via = e.join(i, ["repo_path", "source_file"]).join(s, ["repo_path", "path", "name"]).groupBy(*_KEY).agg(F.min_by("node_id", "pos").alias("_via"))
    own = _unique(signals, ["signal"]).withColumnRenamed("node_id", "_own")
    return e.join(via, _KEY, "left").join(own, ["repo_path", "name"], "left").select(*_KEY, F.coalesce("_via", "_own").alias("new_target")).where("new_target IS NOT NULL")


def _member(edges: DataFrame, end: str, name: str, owner: str, nodes: DataFrame, signals: DataFrame) -> DataFrame:
    e = edges.where((F.col("relation") == "connects") & (F.col(end) == F.concat(F.lit("module:"), _meta(name)))).select(*_KEY, _meta(name).alias("name"), _meta(owner).alias("class"))
    s = signals.groupBy("repo_path", "path", "name").agg(F.min_by("node_id", "qt").alias("_via"))  # a signal before a slot
    via = e.join(class_places(nodes), ["repo_path", "class"]).join(s, ["repo_path", "path", "name"]).select(*_KEY, "_via")
    own = _unique(signals, ["signal", "slot"]).withColumnRenamed("node_id", "_own")
    return e.join(via, _KEY, "left").join(own, ["repo_path", "name"], "left").select(*_KEY, F.coalesce("_via", "_own").alias(f"new_{end}")).where(F.col(f"new_{end}").isNotNull())


def named_members(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """(repo_path, edge_id, new): 'name:Class::member' ends: the one signal or slot of that name in the
    class's files, else the one symbol where there is no such declaration."""
    e = edges.where((F.col("relation") == "connects") & F.col(end).rlike("^name:.+?::.")).select(*_KEY, F.regexp_extract(end, "^name:(.+?)::", 1).alias("class"), F.regexp_extract(end, "^name:.+?::(.+)$", 1).alias("name"))
    sym = nodes.where("granularity = 'symbol'")
    owners = sym.where("kind = 'class'").select("repo_path", F.col("label").alias("class"), F.col("source_ref").alias("path")).unionByName(sym.where(_meta("qualifier") != "").select("repo_path", _meta("qualifier").alias("class"), F.col("source_ref").alias("path"))).distinct()
    m = sym.select("repo_path", F.col("source_ref").alias("path"), F.col("label").alias("name"), "node_id", F.coalesce(_meta("qt").isin("signal", "slot"), F.lit(False)).alias("declared"))
    j = e.join(owners, ["repo_path", "class"]).join(m, ["repo_path", "path", "name"]).groupBy(*_KEY).agg(F.collect_set(F.when(F.col("declared"), F.col("node_id"))).alias("d"), F.countDistinct("node_id").alias("n"), F.min("node_id").alias("any"))
    return j.select(*_KEY, F.when(F.size("d") == 1, F.col("d")[0]).when((F.size("d") == 0) & (F.col("n") == 1), F.col("any")).alias(f"new_{end}")).where(F.col(f"new_{end}").isNotNull())


def resolved_handlers(edges: DataFrame, signals: DataFrame) -> DataFrame:
    """(repo_path, edge_id, new_target or null) of all handlers of components: the component's signal of that
    name, or of the name with or without 'Changed'."""
    name = _meta("signal_name")
    other = F.when(name.endswith("Changed"), F.regexp_replace(name, "Changed$", "")).otherwise(F.concat(name, F.lit("Changed")))
    e = edges.where((F.col("relation") == "handles") & (F.col("target") == F.concat(F.lit("module:"), name)) & _meta("component_path").isNotNull())
    e = e.select(*_KEY, _meta("component_path").alias("path"), F.posexplode(F.array(name, other)).alias("pos", "name"))
    s = signals.where("qt = 'signal'").select("repo_path", "path", "name", "node_id")
    return e.join(s, ["repo_path", "path", "name"], "left").groupBy(*_KEY).agg(F.min_by("node_id", F.when(F.col("node_id").isNotNull(), F.col("pos"))).alias("new_target"))


def resolved_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_path, edge_id, new_target or null) of all instances: what the file's imports export under the
    type's name (any version where the import names none; a qualifier must be the import's alias,
    uri or its last part), if it is one file; where nothing exports it, the class of that name."""
    kind = F.coalesce(_meta("type_name"), F.expr("substring(target, 8)"))
    e = edges.where("relation = 'instantiates' AND target LIKE 'module:%'").select(*_KEY, "source_file", kind.alias("type"))
    e = e.withColumn("name", F.substring_index("type", ".", -1)).withColumn("qualifier", F.when(F.instr("type", ".") > 0, F.regexp_replace("type", r"\.[^.]*$", "")).otherwise(F.lit("")))
    i = edges.where("relation = 'imports' AND source LIKE 'file:%'").where(_meta("uri") != "").select("repo_path", F.expr("substring(source, 6)").alias("source_file"), _meta("uri").alias("uri"), F.coalesce(_meta("version"), F.lit("")).alias("wanted"), F.coalesce(_meta("alias"), F.lit("")).alias("alias")).distinct()
    x = component_exports(nodes, edges)
    j = e.join(i, ["repo_path", "source_file"]).where((F.col("qualifier") == "") | F.col("qualifier").isin(F.col("alias"), F.col("uri")) | (F.col("qualifier") == F.substring_index("uri", ".", -1)))
    j = j.join(x, ["repo_path", "uri", "name"]).where((F.col("wanted") == "") | (F.col("wanted") == F.col("version")))
    t = j.groupBy(*_KEY).agg(F.array_distinct(F.flatten(F.collect_list("targets"))).alias("t"))
    c = class_places(nodes).select("repo_path", F.col("class").alias("name"), F.concat_ws(":", F.lit("symbol"), "path", "class").alias("_class"))
    r = e.join(t, _KEY, "left").join(c, ["repo_path", "name"], "left")
    return r.select(*_KEY, F.when(F.size("t") == 1, F.col("t")[0]).when(F.col("t").isNull(), F.col("_class")).alias("new_target"))


def resolve_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All edges with their ends resolved, and a column ``unverified``."""
    signals = declared_signals(nodes)
    e = edges.dropDuplicates(_KEY)
    sources = _member(e, "source", "signal_name", "sender_class", nodes, signals).unionByName(named_members(e, nodes, "source"))
    targets = _member(e, "target", "slot_name", "receiver_class", nodes, signals).unionByName(named_members(e, nodes, "target")).unionByName(resolved_emits(e, signals))
    checked = resolved_handlers(e, signals).unionByName(resolved_components(e, nodes))
    found = targets.withColumn("_checked", F.lit(False)).unionByName(checked.withColumn("_checked", F.lit(True)))
    r = e.join(sources, _KEY, "left").join(found, _KEY, "left")
    lost = F.coalesce("_checked", F.lit(False)) & F.col("new_target").isNull()
    r = r.withColumn("unverified", lost).withColumn("confidence", F.when(lost & (F.col("relation") == "handles"), "LOW").otherwise(F.col("confidence")))
    r = r.withColumn("source", F.coalesce("new_source", "source")).withColumn("target", F.coalesce("new_target", "target")).drop("new_source", "new_target", "_checked")
    return r.where("NOT (relation = 'connects' AND source = target)")


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_path, edge_id, path): the file an import means: the one of exactly that path, else the only file of
    that base name, else null. ``imports`` has repo_path, edge_id, wanted; ``files`` repo_path, path."""
    f = files.select("repo_path", "path").where("repo_path IS NOT NULL AND path IS NOT NULL").distinct()
    exact = f.select("repo_path", F.col("path").alias("wanted"), F.col("path").alias("_exact"))
    base = f.groupBy("repo_path", F.substring_index("path", "/", -1).alias("_base")).agg(F.count("*").alias("n"), F.min("path").alias("_only")).where("n = 1").drop("n")
    i = imports.select("repo_path", "edge_id", "wanted").distinct().withColumn("_base", F.substring_index("wanted", "/", -1))
    return i.join(exact, ["repo_path", "wanted"], "left").join(base, ["repo_path", "_base"], "left").select("repo_path", "edge_id", F.coalesce("_exact", "_only").alias("path"))


def numbered_declarations(rows: DataFrame, base: str, order: list[str]) -> DataFrame:
    """Rows with the column ``unique_id``: equal ids get '#2', '#3' from the second on, in the given order."""
    w = Window.partitionBy("repo_path", base).orderBy(*order)
    n = F.row_number().over(w)
    return rows.withColumn("_n", n).withColumn("unique_id", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("#"), F.col("_n").cast("string")))).drop("_n")
