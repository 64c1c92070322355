"""Relations between retrieved nodes, edges between turns and tags, and the fragment topology of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels, text as X


def bright_edges(nodes: DataFrame, most: int = 50, per_node: int = 5) -> DataFrame:
    """Edges among the best ``most`` nodes: 2 per shared bucket, 1 per shared tag, 5 for one source (+10 next chunk, +3 near);
    the strongest ``per_node`` of each. The pairs are those of at most ``most`` rows, whatever the corpus."""
    n = nodes.orderBy(F.desc("score"), "id").limit(most)
    a = n.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "buckets", "tags", "source", "sequence")])
    b = n.select(*[F.col(c).alias(f"b_{c}") for c in ("id", "buckets", "tags", "source", "sequence")])
    shared = lambda c: F.size(F.array_intersect(F.coalesce(f"a_{c}", F.array().cast("array<string>")), F.coalesce(f"b_{c}", F.array().cast("array<string>"))))
    same = F.coalesce(F.col("a_source") == F.col("b_source"), F.lit(False))
    far = F.abs(F.col("a_sequence") - F.col("b_sequence"))
    near = F.when(same & (far == 1), 10).when(same & (far < 5), 3).otherwise(0)
    strength = 2 * shared("buckets") + shared("tags") + F.when(same, 5).otherwise(0) + near
    kind = F.when(same & (far == 1), "next_chunk").when(same, "same_source").otherwise("related")
    pairs = a.join(F.broadcast(b), F.col("a_id") != F.col("b_id")).select("a_id", "b_id", kind.alias("relation"), strength.alias("strength")).where("strength > 0")
    w = Window.partitionBy("a_id").orderBy(F.desc("strength"), "b_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_node).select(F.col("a_id").alias("from_id"), F.col("b_id").alias("to_id"), "relation", "strength", "rank")


def structured_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with the head of their content and their edges."""
    e = edges.groupBy("from_id").agg(F.array_sort(F.collect_list(F.struct("rank", "to_id", "relation", "strength"))).alias("edges"))  # at most per_node
    return nodes.select("id", F.substring("content", 1, 500).alias("content"), "source", "score").join(e, F.col("id") == F.col("from_id"), "left").drop("from_id")


def next_edges(turns: DataFrame, session: str, order: str, key: str) -> DataFrame:
    """Edge from each turn of a session to the following one."""
    w = Window.partitionBy(session).orderBy(order, key)
    return turns.where(F.col(session).isNotNull()).select(session, F.col(key).alias("from_id"), F.lead(key).over(w).alias("to_id")).where("to_id is not null")


def entity_search(items: DataFrame, mentions: DataFrame, entities: DataFrame, needle: str, k: int = 5) -> DataFrame:
    """Distinct union of items that hold the text and of items that mention an entity of that name, by score."""
    low = needle.lower()
    direct = items.where(F.lower("content").contains(low)).select("id", F.lit(1.0).alias("score"))
    named = entities.where(F.lower("name").contains(low)).select(F.col("id").alias("entity_id"))
    through = mentions.join(named, "entity_id").select(F.col("item_id").alias("id"), F.lit(0.8).alias("score"))
    return direct.unionByName(through).distinct().orderBy(F.desc("score"), "id").limit(k)


def fragments(docs: DataFrame, text: str = "content", path: str = "source") -> DataFrame:
    """Documents with their id, type and pieces: (.., compound_id, doc_type, sequence, fragment, start, end)."""
    kind = X.molecule_type(F.col(text), F.col(path))
    base = docs.withColumns({"doc_type": kind, "compound_id": F.concat(F.lit("mem_"), F.md5(F.concat(F.col(text), F.col(path))))})
    parts = kernels.split_text(F.col(text), F.col("doc_type"), F.col(path).endswith(".md"))
    return base.select("*", F.posexplode(parts).alias("sequence", "piece")).select("*", F.col("piece.content").alias("fragment"), F.col("piece.start").alias("start"), F.col("piece.end").alias("end")).drop("piece")


def molecules(docs: DataFrame, keywords: list[str], text: str = "content", path: str = "source") -> DataFrame:
    """Fragment rows with id, type, number and unit (of data), tags and fingerprint."""
    f = fragments(docs, text, path)
    kind = F.when((F.col("doc_type") == "prose") & F.col("fragment").rlike(r"```|\b(function|const) "), "code").otherwise(F.col("doc_type"))
    number = F.when(kind == "data", X.numeric(F.col("fragment")))
    key = F.concat(F.lit("mol_"), F.substring(F.md5(F.concat(F.expr("substring(compound_id, 5)"), F.col("sequence"), F.col("fragment"))), 1, 12))
    return f.select(
        key.alias("id"), F.col("fragment").alias("content"), "compound_id", "sequence", "start", "end", kind.alias("type"), number.value.alias("numeric_value"), number.unit.alias("numeric_unit"),
        F.array_union(X.scan_tags(F.col("fragment"), keywords), X.system_tags(F.col(path))).alias("tags"), kernels.simhash(F.col("fragment")).alias("simhash"),
    )


def atom_id(label):  # noqa: ANN001, ANN201
    return F.concat(F.lit("atom_"), F.substring(F.sha2(label, 256), 1, 12))


def topology(docs: DataFrame, keywords: list[str], text: str = "content", path: str = "source") -> dict[str, DataFrame]:
    """The five tables of documents: compounds, molecules, atoms, atom_edges, memory."""
    mol = molecules(docs, keywords, text, path)
    compounds = docs.select(
        F.concat(F.lit("mem_"), F.md5(F.concat(F.col(text), F.col(path)))).alias("id"), F.col(text).alias("compound_body"), F.col(path).alias("path"), "provenance",
        kernels.simhash(F.col(text)).alias("simhash"), F.array_union(X.scan_tags(F.col(text), keywords), X.system_tags(F.col(path))).alias("tags"),
    ).dropDuplicates(["id"])
    labels = compounds.select("id", F.explode("tags").alias("label"))
    atoms = labels.select("label").distinct().select(atom_id(F.col("label")).alias("id"), "label", F.when(F.col("label").startswith("#project:") | F.col("label").isin("#Archive", "#src", "#docs", "#test", "#code", "#doc", "#config"), "system").otherwise("concept").alias("type"), F.when(F.col("label") == "#Archive", 0.5).otherwise(1.0).alias("weight"))
    edges = labels.select(F.col("id").alias("from_id"), atom_id(F.col("label")).alias("to_id"), F.lit(1.0).alias("weight"), F.lit("has_tag").alias("relation")).distinct()
    memory = compounds.select("id", F.col("compound_body").alias("content"), F.col("path").alias("source"), F.lit("compound").alias("type"), F.lit(0).alias("sequence"), "tags").unionByName(
        mol.join(compounds.select(F.col("id").alias("compound_id"), F.col("path").alias("source")), "compound_id").select("id", "content", "source", F.lit("fragment").alias("type"), "sequence", "tags").dropDuplicates(["id"])
    )
    return {"compounds": compounds, "molecules": mol, "atoms": atoms, "atom_edges": edges, "memory": memory}
