"""Section trees and concept graphs from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import structure as S
from corpuskit.plans import model as M
from corpuskit.plans.registry import query
from corpuskit.plans.search import FINAL, sql_hits, sql_pairs

WS = M.SQL_WS

# Seven documents whose chunks are the driver documents; some chunks have no title, no part or no text.
TITLE = """CASE WHEN doc_id % 13 = 0 THEN ' > ' WHEN doc_id % 5 = 1 THEN source
  WHEN doc_id % 5 = 2 THEN source || ' > ' || lang ELSE source || ' >  ' || lang || ' > > part ' || (doc_id % 3) END"""
CLEAN_TITLE = """CASE WHEN doc_id % 13 = 0 THEN 'book ' || doc_id % 7 WHEN doc_id % 5 = 1 THEN source
  WHEN doc_id % 5 = 2 THEN source || ' > ' || lang ELSE source || ' > ' || lang || ' > part ' || (doc_id % 3) END"""
TEXT = "CASE WHEN doc_id % 5 IN (1, 2) THEN ' ' ELSE text END"
NODES_SQL = f"""
  sc AS (SELECT doc_id % 7 AS document_id, doc_id AS chunk_id, {CLEAN_TITLE} AS path, {TEXT} AS content FROM documents),
  levels AS (SELECT *, string_split(path, ' > ') AS parts FROM sc),
  prefixes AS (SELECT document_id, chunk_id, content, path AS own_path, unnest(range(1, len(parts) + 1)) AS depth, parts
               FROM levels),
  pre AS (SELECT document_id, chunk_id, content, own_path, depth, array_to_string(parts[1:depth], ' > ') AS path,
                 parts[depth] AS title FROM prefixes),
  seen AS (SELECT document_id, path, min(chunk_id * 100 + depth) AS first, any_value(title) AS title, any_value(depth) AS level,
             count(*) FILTER (own_path = path) AS chunk_count,
             arg_min(substring(trim(content, {WS}), 1, 240), chunk_id) FILTER (own_path = path AND trim(content, {WS}) <> '')
               AS own FROM pre GROUP BY 1, 2),
  ids AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY first) AS ordinal FROM seen),
  places AS (SELECT n.document_id, n.path, string_agg(lpad(a.ordinal::VARCHAR, 6, '0'), '.' ORDER BY a.level) AS place
             FROM ids n JOIN ids a ON a.document_id = n.document_id AND (n.path = a.path OR starts_with(n.path, a.path || ' > '))
             GROUP BY 1, 2),
  nodes AS (SELECT i.*, 's' || i.ordinal AS section_id, place, CASE WHEN level > 1 THEN 's' || p.ordinal END AS parent_id,
              coalesce(own, '') AS preview
            FROM ids i JOIN places USING (document_id, path)
            LEFT JOIN (SELECT document_id, path, ordinal FROM ids) p ON p.document_id = i.document_id
              AND p.path = array_to_string(string_split(i.path, ' > ')[1:level - 1], ' > '))"""
GLOSSARY_SQL = """glossary AS (SELECT DISTINCT 'part ' || doc_id % 3 AS source, source AS target, 'related' AS type, 1.5 AS weight
  FROM documents WHERE source IN ('src1', 'src4') UNION ALL SELECT DISTINCT lang, lang, 'same', 1 FROM documents)"""
EDGES_SQL = f"""{GLOSSARY_SQL},
  titled AS (SELECT document_id, title, arg_max(section_id, ordinal) AS id FROM nodes GROUP BY 1, 2),
  gedges AS (SELECT a.document_id, a.id AS src, b.id AS dst, type, weight::DOUBLE AS weight FROM glossary
    JOIN titled a ON a.title = source JOIN titled b ON b.title = target AND a.document_id = b.document_id WHERE a.id <> b.id),
  edges AS (SELECT document_id, parent_id AS src, section_id AS dst, 'sub' AS type, 2.0::DOUBLE AS weight FROM nodes
    WHERE parent_id IS NOT NULL UNION ALL SELECT * FROM gedges),
  links AS (SELECT * FROM edges UNION ALL SELECT document_id, dst, src, type, weight FROM edges)"""


def section_chunks(spark, sf):
    return M.table(spark, sf, "documents").select(
        (F.col("doc_id") % 7).alias("document_id"),
        F.concat(F.lit("book "), F.col("doc_id") % 7).alias("document_title"),
        F.col("doc_id").alias("chunk_id"),
        F.expr(TITLE).alias("chunk_title"),
        F.expr(TEXT).alias("content"),
    )


def nodes(spark, sf):
    return S.build_section_nodes(section_chunks(spark, sf))


def glossary(spark, sf):
    docs = M.table(spark, sf, "documents")
    parts = docs.filter("source IN ('src1', 'src4')").select(
        F.concat(F.lit("part "), F.col("doc_id") % 3).alias("source"),
        F.col("source").alias("target"),
        F.lit("related").alias("type"),
        F.lit(1.5).alias("weight"),
    )
    same = docs.select(
        F.col("lang").alias("source"), F.col("lang").alias("target"), F.lit("same").alias("type"), F.lit(1.0).alias("weight")
    )
    return parts.distinct().unionByName(same.distinct())


def shown_place(place):
    return F.array_join(F.transform(place, lambda o: F.lpad(o.cast("string"), 6, "0")), ".")


@query(
    "build_section_nodes",
    f"""WITH {NODES_SQL} SELECT document_id, section_id, path, title, level, parent_id, place, chunk_count, preview
        FROM nodes""",
)
def build_section_nodes(spark, sf):
    return nodes(spark, sf).select(
        "document_id", "section_id", "path", "title", F.col("level").cast("long").alias("level"), "parent_id",
        shown_place("place").alias("place"), "chunk_count", "preview",
    )


@query(
    "chunk_sections",
    f"WITH {NODES_SQL} SELECT document_id, chunk_id, section_id FROM sc JOIN nodes USING (document_id, path)",
)
def chunk_sections(spark, sf):
    chunks = section_chunks(spark, sf)
    return S.chunk_sections(chunks, S.build_section_nodes(chunks)).select("document_id", "chunk_id", "section_id")


@query(
    "fill_previews",
    f"""WITH {NODES_SQL} SELECT n.document_id, n.section_id, coalesce(nullif(n.preview, ''),
      (SELECT arg_min(b.preview, b.place) FROM nodes b WHERE b.document_id = n.document_id AND b.preview <> ''
       AND starts_with(b.path, n.path || ' > ')), '') AS preview FROM nodes n""",
)
def fill_previews(spark, sf):
    return S.fill_previews(nodes(spark, sf)).select("document_id", "section_id", "preview")


@query("glossary_edges", f"WITH {NODES_SQL}, {EDGES_SQL} SELECT document_id, src, dst, type, weight FROM gedges")
def glossary_edges(spark, sf):
    return S.glossary_edges(nodes(spark, sf), glossary(spark, sf))


@query("section_graph", f"WITH {NODES_SQL}, {EDGES_SQL} SELECT document_id, src, dst, type, weight FROM edges")
def section_graph(spark, sf):
    return S.section_graph(nodes(spark, sf), glossary(spark, sf))


@query("undirected_edges", f"WITH {NODES_SQL}, {EDGES_SQL} SELECT document_id, src, dst, type, weight FROM links")
def undirected_edges(spark, sf):
    return S.undirected_edges(S.section_graph(nodes(spark, sf), glossary(spark, sf)))


LOCATIONS_SQL = f"""located AS (SELECT n.document_id, n.section_id, n.path AS title_path, c.chunk_id, o.place,
    substring(trim(c.content, {WS}), 1, 240) AS snippet
  FROM sc c JOIN nodes o ON o.document_id = c.document_id AND o.path = c.path
  JOIN nodes n ON n.document_id = c.document_id AND (c.path = n.path OR starts_with(c.path, n.path || ' > ')))"""


@query(
    "subtree_chunks",
    f"WITH {NODES_SQL}, {LOCATIONS_SQL} SELECT document_id, section_id, title_path, chunk_id, place, snippet FROM located",
)
def subtree_chunks(spark, sf):
    chunks = section_chunks(spark, sf)
    found = S.subtree_chunks(chunks, S.build_section_nodes(chunks))
    return found.withColumn("place", shown_place("place"))


@query(
    "distinct_chunk_ids",
    f"WITH {NODES_SQL}, {LOCATIONS_SQL} SELECT document_id, section_id, chunk_id, min(place) AS place FROM located GROUP BY ALL",
)
def distinct_chunk_ids(spark, sf):
    chunks = section_chunks(spark, sf)
    found = S.subtree_chunks(chunks, S.build_section_nodes(chunks))
    return S.distinct_chunk_ids(found.unionByName(found)).withColumn("place", shown_place("place"))


@query(
    "find_section",
    f"""WITH {NODES_SQL}, names AS (SELECT DISTINCT document_id, title AS name FROM nodes
          UNION ALL SELECT document_id, section_id FROM nodes),
    titled AS (SELECT document_id, title AS name, arg_min(section_id, place) AS section_id FROM nodes GROUP BY 1, 2)
    SELECT document_id, name, coalesce(n.section_id, t.section_id) AS section_id FROM names
    LEFT JOIN (SELECT document_id, section_id AS name, section_id FROM nodes) n USING (document_id, name)
    LEFT JOIN titled t USING (document_id, name)""",
)
def find_section(spark, sf):
    tree = nodes(spark, sf)
    names = tree.select("document_id", F.col("title").alias("name")).distinct()
    names = names.unionByName(tree.select("document_id", F.col("section_id").alias("name")))
    return S.find_section(tree, names)


# Paths without repeated nodes are not needed: scores only fall, so the best score per node is a fixpoint.
NEIGHBORS_SQL = f"""
  starts AS (SELECT document_id, section_id AS start FROM nodes),
  walk(document_id, start, node, score, type, hops) AS (
    SELECT DISTINCT s.document_id, start, dst, weight, type, 1 FROM starts s JOIN links l ON l.document_id = s.document_id
      AND l.src = s.start WHERE dst <> start
    UNION
    SELECT w.document_id, w.start, l.dst, w.score * 0.5, l.type, hops + 1 FROM
      (SELECT document_id, start, node, max(score) AS score, hops FROM walk GROUP BY ALL) w
      JOIN links l ON l.document_id = w.document_id AND l.src = w.node WHERE l.dst <> w.start AND hops < 12),
  tops AS (SELECT document_id, start, node, max(score) AS score FROM walk GROUP BY ALL),
  best AS (SELECT t.document_id, t.start, t.node, t.score, min(type) AS type FROM tops t
    JOIN (SELECT *, min(hops) OVER (PARTITION BY document_id, start, node, score) AS h FROM walk) w
      ON w.document_id = t.document_id AND w.start = t.start AND w.node = t.node AND w.score = t.score AND w.hops = w.h
    GROUP BY ALL)"""


@query(
    "concept_neighbors",
    f"""WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, {NEIGHBORS_SQL}
    SELECT document_id, start, rank, node AS section_id, title AS name, round(score, 2) AS weight, type AS relation FROM (
      SELECT b.*, n.title, row_number() OVER (PARTITION BY b.document_id, start ORDER BY score DESC, n.ordinal) AS rank
      FROM best b JOIN nodes n ON n.document_id = b.document_id AND n.section_id = b.node) WHERE rank <= 8""",
)
def concept_neighbors(spark, sf):
    tree = nodes(spark, sf)
    starts = tree.select("document_id", F.col("section_id").alias("start"))
    return S.concept_neighbors(tree, S.section_graph(tree, glossary(spark, sf)), starts, 8)


SUBGRAPH_SQL = """starts AS (SELECT document_id, section_id AS start FROM nodes),
  keep AS (SELECT document_id, start, start AS node FROM starts UNION
           SELECT s.document_id, start, dst FROM starts s JOIN links l ON l.document_id = s.document_id AND l.src = s.start)"""


@query(
    "subgraph_1hop_nodes",
    f"""WITH {NODES_SQL}, {EDGES_SQL}, {SUBGRAPH_SQL} SELECT k.document_id, start, section_id, title, level::BIGINT AS level
        FROM keep k JOIN nodes n ON n.document_id = k.document_id AND n.section_id = k.node""",
)
def subgraph_nodes(spark, sf):
    tree = nodes(spark, sf)
    starts = tree.select("document_id", F.col("section_id").alias("start"))
    found = S.subgraph_1hop(tree, S.section_graph(tree, glossary(spark, sf)), starts)[0]
    return found.withColumn("level", F.col("level").cast("long"))


@query(
    "subgraph_1hop_edges",
    f"""WITH {NODES_SQL}, {EDGES_SQL}, {SUBGRAPH_SQL} SELECT e.document_id, a.start, src, dst, type, weight
        FROM edges e JOIN keep a ON a.document_id = e.document_id AND a.node = e.src
        JOIN keep b ON b.document_id = e.document_id AND b.node = e.dst AND a.start = b.start""",
)
def subgraph_edges(spark, sf):
    tree = nodes(spark, sf)
    starts = tree.select("document_id", F.col("section_id").alias("start"))
    return S.subgraph_1hop(tree, S.section_graph(tree, glossary(spark, sf)), starts)[1]


# hybrid search in the sections of a book; the benchmark items are spread over the books
BOOK_SQL = """
  books AS (SELECT document_id, chunk_id, path, 'book ' || document_id AS document_title, content, chunk_id AS newest,
              raw_title AS chunk_title,
              'book ' || document_id || chr(10) || 'summary ' || document_id || chr(10) || raw_title || chr(10) || content
                AS search_text
            FROM (SELECT s.*, t.raw_title FROM sc s JOIN (SELECT doc_id AS chunk_id, {title} AS raw_title FROM documents) t
                  USING (chunk_id))),
  candidates AS (SELECT * FROM books),
  sq AS (SELECT item_id AS query_id, item_id % 7 AS scope, text AS query_text FROM benchmark),
""".format(title=TITLE)


def books(spark, sf):
    chunks = section_chunks(spark, sf)
    summary = F.concat(F.lit("summary "), F.col("document_id"))
    text = F.concat_ws("\n", "document_title", summary, "chunk_title", "content")
    return chunks.withColumn("search_text", text).withColumn("created_at", F.timestamp_seconds("chunk_id"))


def asked_books(spark, sf):
    return M.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), (F.col("item_id") % 7).alias("document_id"), F.col("text").alias("query_text")
    )


@query(
    "structure_search",
    "WITH "
    + NODES_SQL.replace("sc AS (", "secs AS (").replace("FROM sc)", "FROM secs)")
    + ","
    + BOOK_SQL.replace("FROM sc s", "FROM secs s")
    + " sc AS (SELECT chunk_id, document_id AS scope FROM books), "
    + sql_pairs()
    + ","
    + sql_hits(FINAL, 5, "kw > 0 OR vec > 0")
    + """ SELECT query_id, rank, h.chunk_id, h.document_id, document_title, chunk_title AS title_path, snippet,
          round(score, 4) AS score, section_id
        FROM hits h JOIN (SELECT chunk_id, document_id, path FROM secs) c USING (chunk_id, document_id)
        JOIN (SELECT document_id, path, section_id FROM nodes) n ON n.document_id = h.document_id AND n.path = c.path""",
)
def structure_search(spark, sf):
    rows = books(spark, sf)
    placed = S.chunk_sections(rows, S.build_section_nodes(rows))
    return S.structure_search(asked_books(spark, sf), rows, placed, 5)


@query(
    "attach_section",
    f"""WITH {NODES_SQL} SELECT document_id, chunk_id, CASE WHEN chunk_id % 2 = 0 THEN section_id END AS section_id,
        chunk_id * 2 AS score FROM sc JOIN nodes USING (document_id, path)""",
)
def attach_section(spark, sf):
    chunks = section_chunks(spark, sf)
    placed = S.chunk_sections(chunks, S.build_section_nodes(chunks)).filter("chunk_id % 2 = 0")
    hits = chunks.select("document_id", "chunk_id", (F.col("chunk_id") * 2).alias("score"))
    return S.attach_section(hits, placed)
