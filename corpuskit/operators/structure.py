"""Section trees and concept graphs, as tables of nodes and edges per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskit import runtime
from corpuskit.functions import text as X
from corpuskit.operators.retrieval import hybrid_topk

UNTITLED = "未命名文档"
PREVIEW = 240
PATH = " > "


def _with_parts(chunks: DataFrame) -> DataFrame:
    """Add the breadcrumb parts of chunks (document_id, document_title, chunk_id, chunk_title, content)."""
    default = F.coalesce(F.nullif("document_title", F.lit("")), F.lit(UNTITLED))
    return chunks.withColumn("parts", X.breadcrumb_parts(F.col("chunk_title"), default))


def _path(parts, depth):
    return F.array_join(F.slice(parts, 1, depth), PATH)


def build_section_nodes(chunks: DataFrame, group_limit: int = runtime.GROUP_ROW_LIMIT) -> DataFrame:
    """One node per breadcrumb prefix of a document.

    Ids ``s1``, ``s2`` ... follow the first appearance (chunk order, then depth). ``place`` lists
    the ordinals from the root to the node: sorting by it is the pre-order of the tree. The own
    preview is the first non-blank text of chunks directly in the section.
    """
    levels = _with_parts(chunks).select(
        "document_id",
        "chunk_id",
        "parts",
        X.snippet(X.strip(F.col("content")), PREVIEW).alias("text"),
        F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"),
    )
    own = F.col("depth") == F.size("parts")
    nodes = (
        levels.withColumn("path", _path(F.col("parts"), F.col("depth")))
        .groupBy("document_id", "path")
        .agg(
            F.min(F.struct("chunk_id", "depth")).alias("first_seen"),
            F.max("depth").alias("level"),
            F.max(F.element_at("parts", F.col("depth"))).alias("title"),
            F.min(F.when(own & (F.col("text") != ""), F.struct("chunk_id", "text"))).alias("own"),
            F.count_if(own).alias("chunk_count"),
        )
        .withColumn("preview", F.coalesce("own.text", F.lit("")))
    )
    nodes = runtime.materialize(nodes)
    numbered = runtime.ranked(nodes, ["document_id"], [F.asc("first_seen")], "ordinal", group_limit)
    numbered = numbered.drop("first_seen", "own").withColumn("section_id", F.concat(F.lit("s"), "ordinal"))
    ordinals = numbered.select("document_id", F.col("path").alias("prefix"), F.col("ordinal").alias("at"))
    prefixes = numbered.select(
        "document_id", "path", F.posexplode(_prefixes(F.col("path"))).alias("depth", "prefix")
    ).join(ordinals, ["document_id", "prefix"])
    places = prefixes.groupBy("document_id", "path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("depth", "at"))), lambda s: s["at"]).alias("place")
    )
    parent = F.try_element_at("place", F.lit(-2))
    return numbered.join(places, ["document_id", "path"]).withColumn(
        "parent_id", F.when(F.size("place") > 1, F.concat(F.lit("s"), parent))
    )


def _prefixes(path):
    parts = F.split(path, PATH)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: _path(parts, d))


def chunk_sections(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Section of each chunk (its deepest node)."""
    paths = _with_parts(chunks).select("document_id", "chunk_id", F.array_join("parts", PATH).alias("path"))
    found = nodes.select("document_id", "path", "section_id", "place")
    return paths.join(found, ["document_id", "path"]).select("document_id", "chunk_id", "section_id", "path", "place")


def fill_previews(nodes: DataFrame) -> DataFrame:
    """Sections without own text take the first preview below them, in tree order."""
    below = nodes.filter("preview <> ''").select(
        "document_id", "place", "preview", F.explode(_prefixes(F.col("path"))).alias("path")
    )
    first = below.groupBy("document_id", "path").agg(F.min(F.struct("place", "preview")).alias("first"))
    own = F.nullif("preview", F.lit(""))
    return (
        nodes.join(first, ["document_id", "path"], "left")
        .withColumn("preview", F.coalesce(own, F.col("first.preview"), F.lit("")))
        .drop("first")
    )


def glossary_edges(nodes: DataFrame, glossary: DataFrame) -> DataFrame:
    """Edges between the sections that carry the titles of glossary entries (source, target, type, weight).

    The last section with a title stands for it; unknown titles and self edges give no edge.
    """
    named = nodes.groupBy("document_id", "title").agg(F.max_by("section_id", "ordinal").alias("id"))
    source = named.select("document_id", F.col("title").alias("source"), F.col("id").alias("src"))
    target = named.select("document_id", F.col("title").alias("target"), F.col("id").alias("dst"))
    return (
        glossary.join(source, "source")
        .join(target, ["document_id", "target"])
        .filter("src <> dst")
        .select(
            "document_id",
            "src",
            "dst",
            F.coalesce("type", F.lit("related")).alias("type"),
            F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"),
        )
    )


def section_graph(nodes: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Parent-child edges of weight 2, and the glossary edges."""
    edges = nodes.filter("parent_id IS NOT NULL").select(
        "document_id",
        F.col("parent_id").alias("src"),
        F.col("section_id").alias("dst"),
        F.lit("sub").alias("type"),
        F.lit(2.0).alias("weight"),
    )
    return edges if glossary is None else edges.unionByName(glossary_edges(nodes, glossary))


def undirected_edges(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def subtree_chunks(chunks: DataFrame, nodes: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Chunks in and below each section (of ``sections``: document_id, section_id; default all).

    Order within a section: ``place``, then ``chunk_id``. Each chunk is in one section, so it
    comes once per ancestor.
    """
    placed = chunk_sections(chunks, nodes).select("document_id", "chunk_id", "path", "place")
    above = placed.select("document_id", "chunk_id", "place", F.explode(_prefixes(F.col("path"))).alias("path"))
    wanted = nodes if sections is None else nodes.join(sections, ["document_id", "section_id"], "left_semi")
    found = above.join(wanted.select("document_id", "path", "section_id"), ["document_id", "path"])
    texts = chunks.select("document_id", "chunk_id", X.snippet(X.strip(F.col("content")), PREVIEW).alias("snippet"))
    return found.join(texts, ["document_id", "chunk_id"]).select(
        "document_id", "section_id", F.col("path").alias("title_path"), "chunk_id", "place", "snippet"
    )


def distinct_chunk_ids(locations: DataFrame) -> DataFrame:
    """First place of each chunk of a section."""
    first = F.min("place").alias("place")
    return locations.groupBy("document_id", "section_id", "chunk_id").agg(first)


def find_section(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Section for a name (document_id, name): by id, else the first in tree order with that title."""
    by_id = names.join(
        nodes.select("document_id", F.col("section_id").alias("name"), "section_id"), ["document_id", "name"]
    )
    left = names.join(by_id, ["document_id", "name"], "left_anti")
    titled = nodes.groupBy("document_id", F.col("title").alias("name")).agg(
        F.min_by("section_id", "place").alias("section_id")
    )
    return by_id.unionByName(left.join(titled, ["document_id", "name"]))


def concept_neighbors(
    nodes: DataFrame, edges: DataFrame, starts: DataFrame, k: int = 8, max_hops: int | None = None
) -> DataFrame:
    """Best ``k`` concepts around each start (document_id, start).

    A direct neighbour scores the weight of its edge, every further hop half of the node before.
    The best score of a node counts, with the relation of the last edge; ties go to the section
    that appears first. Runs one job per hop.

    Only the best ``k`` nodes of a start are kept after each hop: whatever a node outside them
    reaches scores less than all of them. From there a hop goes to the ``k + 1`` neighbours that
    appear first, as all neighbours of a node score the same. So a hub with many neighbours adds
    at most ``k + 1`` rows per start and hop.
    """
    nodes = runtime.materialize(nodes.select("document_id", "section_id", "ordinal", "title"))
    ordinal = nodes.select("document_id", F.col("section_id").alias("dst"), "ordinal", "title")
    links = undirected_edges(edges).select("document_id", "src", "dst", "type", "weight")
    links = runtime.materialize(links.join(ordinal.drop("title"), ["document_id", "dst"]))
    key = ["document_id", "start", "dst"]

    def best_of(rows: DataFrame) -> DataFrame:
        # highest score first, then the smallest relation name; then the best k of each start
        top = F.min(F.struct((-F.col("score")).alias("s"), F.col("type").alias("t"))).alias("b")
        merged = rows.groupBy(*key).agg(top, F.min("ordinal").alias("ordinal"))
        merged = merged.select(*key, (-F.col("b.s")).alias("score"), F.col("b.t").alias("type"), "ordinal")
        order = Window.partitionBy("document_id", "start").orderBy(F.desc("score"), F.asc("ordinal"))
        return merged.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")

    onward = links.groupBy("document_id", "src", "dst").agg(F.min("type").alias("type"), F.min("ordinal").alias("ordinal"))
    nearest = Window.partitionBy("document_id", "src").orderBy("ordinal")
    onward = onward.withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") <= k + 1).drop("_r")
    onward = runtime.materialize(onward)

    known = starts.join(nodes.select("document_id", F.col("section_id").alias("start")), ["document_id", "start"], "left_semi")
    first = known.join(links, (known["document_id"] == links["document_id"]) & (known["start"] == links["src"])).select(
        known["document_id"], "start", "dst", F.col("weight").alias("score"), "type", "ordinal"
    )
    best = runtime.cut_lineage(best_of(first.filter("dst <> start")))
    frontier, hops = best, 1
    while not frontier.isEmpty() and (max_hops is None or hops < max_hops):
        step = frontier.select("document_id", "start", F.col("dst").alias("src"), (F.col("score") * 0.5).alias("score"))
        reached = step.join(onward, ["document_id", "src"]).filter("dst <> start")
        new = runtime.cut_lineage(best_of(best.unionByName(reached.select(*key, "score", "type", "ordinal"))))
        old = best.select(*key, F.col("score").alias("old"))
        frontier = new.join(old, key, "left").filter(F.col("old").isNull() | (F.col("score") > F.col("old"))).drop("old")
        best = new
        hops += 1
    order = Window.partitionBy("document_id", "start").orderBy(F.desc("score"), F.asc("ordinal"))
    return (
        best.join(ordinal.drop("ordinal"), ["document_id", "dst"])
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(
            "document_id",
            "start",
            "rank",
            F.col("dst").alias("section_id"),
            F.col("title").alias("name"),
            F.round("score", 2).alias("weight"),
            F.col("type").alias("relation"),
        )
    )


def subgraph_1hop(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each start (document_id, start) and its direct neighbours."""
    known = starts.join(nodes.select("document_id", F.col("section_id").alias("start")), ["document_id", "start"], "left_semi")
    links = undirected_edges(edges).select("document_id", F.col("src").alias("start"), F.col("dst").alias("section_id"))
    around = known.join(links, ["document_id", "start"]).select("document_id", "start", "section_id")
    keep = around.unionByName(known.withColumn("section_id", F.col("start"))).distinct()
    found = keep.join(nodes.select("document_id", "section_id", "title", "level"), ["document_id", "section_id"])
    out = keep.withColumnRenamed("section_id", "src").join(edges, ["document_id", "src"])
    induced = out.join(keep.withColumnRenamed("section_id", "dst"), ["document_id", "start", "dst"], "left_semi")
    return found, induced.select("document_id", "start", "src", "dst", "type", "weight")


def attach_section(hits: DataFrame, sections: DataFrame) -> DataFrame:
    """Search hits with the section of their chunk (null when it has none)."""
    return hits.join(sections.select("document_id", "chunk_id", "section_id"), ["document_id", "chunk_id"], "left")


def structure_search(
    queries: DataFrame, candidates: DataFrame, sections: DataFrame, k: int = 5, vector: str = "text"
) -> DataFrame:
    """Hybrid search inside the document of each query (query_id, document_id, query_text), ``vector`` as in ``hybrid_topk``."""
    hits = hybrid_topk(queries, candidates, k, "document_id", vector).withColumn("score", F.round("score", 4))
    return attach_section(hits.withColumnRenamed("chunk_title", "title_path"), sections)
