"""Queries of the training-data operators, with the SQL of those SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom import queries as core
from strandloom.llm import clusters, conversations, fusion, leaks, lookalikes, markup, mixing, splitting, vectors
from strandloom.operators import retrieval
from strandloom.session import cut, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# -- 1: one ranking from several differently scaled scores -----------------------

P1_SCORES = (fusion.Score("bm25_score", True, zero_is_missing=True), fusion.Score("dense_distance", False))

P1_CTE = """
WITH c AS (
  SELECT query_id, chunk_id,
         max(CASE WHEN bm25_score IS NULL OR isnan(bm25_score) OR bm25_score = 0 THEN NULL ELSE bm25_score::DOUBLE END) AS b,
         max(CASE WHEN dense_distance IS NULL OR isnan(dense_distance) THEN NULL ELSE -dense_distance::DOUBLE END) AS d
  FROM candidates WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2),
n AS (SELECT query_id, count(*) AS n FROM c GROUP BY 1),
p AS (
  SELECT c.query_id, c.chunk_id, (c.b IS NULL)::INT + (c.d IS NULL)::INT AS missing, n.n,
         (rank() OVER (PARTITION BY c.query_id ORDER BY c.b NULLS FIRST) - 1 + count(*) OVER (PARTITION BY c.query_id, c.b) / 2.0) / n.n AS pb,
         (rank() OVER (PARTITION BY c.query_id ORDER BY c.d NULLS FIRST) - 1 + count(*) OVER (PARTITION BY c.query_id, c.d) / 2.0) / n.n AS pd
  FROM c JOIN n USING (query_id)),
f AS (
  SELECT x.query_id, x.chunk_id, x.missing, x.n,
         round(CASE WHEN x.n > 1 THEN sum(
           least(1.0, greatest(0.0, x.pb - y.pb) / 0.5) - least(1.0, greatest(0.0, y.pb - x.pb) / 0.5)
           + least(1.0, greatest(0.0, x.pd - y.pd) / 0.5) - least(1.0, greatest(0.0, y.pd - x.pd) / 0.5)) / (x.n - 1) / 2 ELSE 0.0 END, 6) AS net_flow
  FROM p x JOIN p y ON x.query_id = y.query_id GROUP BY x.query_id, x.chunk_id, x.missing, x.n)
"""


@query(P1_CTE + "SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY net_flow DESC, chunk_id) AS place FROM f WHERE missing = 0) WHERE place <= 5")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five candidates of each query that stand highest on both scores."""
    ranked = fusion.outranking(table(spark, sf_dir, "candidates"), "query_id", "chunk_id", P1_SCORES)
    return fusion.best(ranked, "query_id", "chunk_id", 5).select("query_id", "chunk_id")


@query(P1_CTE + "SELECT query_id, chunk_id, net_flow, missing FROM f")
def p1_net_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The net flow of every candidate."""
    ranked = fusion.outranking(table(spark, sf_dir, "candidates"), "query_id", "chunk_id", P1_SCORES)
    return ranked.selectExpr("query_id", "chunk_id", "round(net_flow, 6) AS net_flow", "missing")


# -- 6: rebuilding conversations -------------------------------------------------

P6_SQL = r"""
WITH m AS (
  SELECT 'session_messages' AS conv_table, session_id AS conv_id, row_id, line_no AS pos, message_id AS mid, ts,
         CASE WHEN message.role IS NULL OR regexp_replace(message.role, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') = '' THEN line_type ELSE message.role END AS role,
         coalesce(array_to_string(list_transform(list_filter(message.content, lambda b: b.type = 'text' AND b.text IS NOT NULL), lambda b: b.text), chr(10)), '') AS text
  FROM session_messages WHERE line_type IN ('user', 'assistant') AND session_id IS NOT NULL
  UNION ALL
  SELECT 'chat_messages', conv_uuid, row_id, msg_pos, message_uuid, created_at, coalesce(sender, ''), coalesce(text, '')
  FROM chat_messages WHERE conv_uuid IS NOT NULL AND lower(regexp_replace(coalesce(sender, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) NOT IN ('system', 'tool')),
r AS (
  SELECT *, CASE WHEN t IN ('user', 'human') THEN 'user' WHEN t IN ('assistant', 'model', 'ai') THEN 'assistant' ELSE 'unknown' END AS who
  FROM (SELECT *, lower(regexp_replace(role, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS t FROM m)),
u AS (
  SELECT *, last_value(ts IGNORE NULLS) OVER (PARTITION BY conv_table, conv_id ORDER BY pos, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tt
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_table, conv_id, coalesce(mid, '#' || row_id) ORDER BY row_id) AS rn FROM r) WHERE rn = 1),
o AS (
  SELECT conv_table, conv_id, row_id, who,
         row_number() OVER w - 1 AS turn_no, lag(who) OVER w AS prev
  FROM u WHERE regexp_matches(text, '[^\s\p{Z}\p{C}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}]')
  WINDOW w AS (PARTITION BY conv_table, conv_id ORDER BY tt NULLS FIRST, pos, row_id)),
k AS (
  SELECT conv_table, conv_id FROM o GROUP BY 1, 2
  HAVING bool_and(who <> 'unknown') AND arg_min(who, turn_no) = 'user' AND arg_max(who, turn_no) = 'assistant'
     AND NOT bool_or(who = 'user' AND coalesce(prev, '') = 'user'))
"""


@query(P6_SQL + "SELECT conv_table, conv_id, turn_no::INT AS turn_no, row_id FROM o JOIN k USING (conv_table, conv_id)")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of every kept conversation with its turn."""
    kept = conversations.conversations(table(spark, sf_dir, "session_messages"), table(spark, sf_dir, "chat_messages"))
    return kept.select("conv_table", "conv_id", "turn_no", "row_id")


@query(r"""
WITH m AS (
  SELECT conv_uuid AS conv_id, coalesce(export_id, '') AS fragment, msg_pos AS pos, coalesce('m' || message_uuid, 'r' || row_id) AS node
  FROM chat_messages WHERE conv_uuid IS NOT NULL AND lower(regexp_replace(coalesce(sender, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) NOT IN ('system', 'tool')),
n AS (SELECT conv_id, fragment, node, min(pos) AS pos FROM m GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, fragment ORDER BY pos, node) - 1 AS place, count(*) OVER (PARTITION BY conv_id, fragment) AS len FROM n),
l AS (SELECT conv_id, fragment AS fragment_a, lead(fragment) OVER (PARTITION BY conv_id, node ORDER BY fragment) AS fragment_b FROM p),
d AS (SELECT DISTINCT * FROM l WHERE fragment_b IS NOT NULL),
e AS (
  SELECT d.conv_id, d.fragment_a, d.fragment_b, a.place - b.place AS shift, count(*) AS shared, any_value(a.len) AS len_a, any_value(b.len) AS len_b
  FROM d JOIN p a ON a.conv_id = d.conv_id AND a.fragment = d.fragment_a JOIN p b ON b.conv_id = d.conv_id AND b.fragment = d.fragment_b AND b.node = a.node
  GROUP BY ALL)
SELECT 'chat_messages' AS conv_table, conv_id, fragment_a, fragment_b, shift, shared,
       count(*) OVER (PARTITION BY conv_id, fragment_a, fragment_b) > 1 OR shared < least(len_a - greatest(shift, 0), len_b - greatest(-shift, 0)) AS ambiguous
FROM e
""")
def p6_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap graph of the fragments of exported chats."""
    return conversations.overlaps(conversations.chat_rows(table(spark, sf_dir, "chat_messages")))


# -- 2: splitting oversized items ------------------------------------------------


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.session_blocks(table(spark, sf_dir, "session_messages")).unionByName(splitting.symbol_bodies(table(spark, sf_dir, "emits")))


# Every character start with the last boundary of each rank within the limit, by as-of joins; then the chain from 0.
P2_SQL = r"""
WITH RECURSIVE it AS (
  SELECT item_table || ':' || item_id || ':' || block_no AS key, *, strlen(text) AS size FROM (
    SELECT 'session_messages' AS item_table, row_id AS item_id, (i - 1)::INT AS block_no, b.text AS text
    FROM (SELECT row_id, unnest(message.content) AS b, generate_subscripts(message.content, 1) AS i FROM session_messages WHERE line_type IN ('user', 'assistant')) WHERE b.type = 'text'
    UNION ALL SELECT 'emits', emit_id, 0, body FROM emits)
  WHERE text IS NOT NULL AND strlen(text) > 8000),
ln AS (SELECT key, size, l, i FROM (SELECT key, size, string_split(text, chr(10)) AS a FROM it), unnest(a) WITH ORDINALITY AS u(l, i)),
lo AS (
  SELECT key, size, sum(strlen(l) + 1) OVER w - strlen(l) - 1 AS place, regexp_full_match(l, '[ 	
]*') AS blank, lag(regexp_full_match(l, '[ 	
]*')) OVER w AS after_blank,
         coalesce(sum(regexp_matches(l, '^[ 	
]*```')::INT) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced
  FROM ln WINDOW w AS (PARTITION BY key ORDER BY i)),
line AS (SELECT key, place FROM lo WHERE place > 0 AND place < size),
para AS (SELECT key, place FROM lo WHERE place > 0 AND place < size AND NOT blank AND after_blank AND NOT fenced),
ch AS (SELECT key, size, c, sum(strlen(c)) OVER (PARTITION BY key ORDER BY i) - strlen(c) AS place FROM (SELECT key, size, regexp_extract_all(text, '(?s).') AS a FROM it), unnest(a) WITH ORDINALITY AS u(c, i)),
gap AS (SELECT key, place + 1 AS place FROM ch WHERE c = ' ' AND place + 1 < size),
anyc AS (SELECT key, place FROM ch WHERE place > 0),
p AS (SELECT key, place AS s, place + 8000 AS far FROM ch WHERE place + 8000 < size),
n AS MATERIALIZED (
  SELECT p.key, s, CASE WHEN a.place > s THEN a.place WHEN b.place > s THEN b.place WHEN g.place > s THEN g.place ELSE o.place END AS cut
  FROM p ASOF LEFT JOIN para a ON p.key = a.key AND p.far >= a.place ASOF LEFT JOIN line b ON p.key = b.key AND p.far >= b.place
  ASOF LEFT JOIN gap g ON p.key = g.key AND p.far >= g.place ASOF LEFT JOIN anyc o ON p.key = o.key AND p.far >= o.place),
r AS (SELECT key, 0::HUGEINT AS s FROM it UNION SELECT n.key, n.cut FROM r JOIN n ON n.key = r.key AND n.s = r.s)
SELECT item_table, item_id, block_no, s::BIGINT AS cut_byte FROM r JOIN it USING (key) WHERE s > 0
"""


@query(P2_SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the pieces after the first begin."""
    pieces = splitting.split_items(_items(spark, sf_dir), oversized_only=True)
    return pieces.filter("piece_no > 0").select("item_table", "item_id", "block_no", "cut_byte")


@query()
def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every oversized item with its text, overlap included."""
    return splitting.split_items(_items(spark, sf_dir), oversized_only=True, with_text=True)


# -- 8: evaluation texts in training text ----------------------------------------


def _form_sql(text: str) -> str:
    """SQL of the one form of a text: what vanishes, then what one character stands
    for, then ligatures, then composed letters."""
    table = lookalikes.transducer()[1]
    quoted = lambda s: s.replace("'", "''")
    gone = "".join(f"\\x{{{ord(c):X}}}" for c, to in table.items() if to == "" and ord(c) > 127)
    single = [(c, to) for c, to in table.items() if len(to) == 1 and c != "\r"]
    out = f"replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    out = f"regexp_replace({out}, '[\\x00-\\x08\\x0E-\\x1F\\x7F{gone}]', '', 'g')"
    out = f"translate({out}, '{quoted(''.join(c for c, _ in single))}', '{quoted(''.join(to for _, to in single))}')"
    for c, to in table.items():
        if len(to) > 1 and c < "\u0590" or "\ufb00" <= c <= "\ufb06":
            out = f"replace({out}, '{quoted(c)}', '{quoted(to)}')"
    return f"nfc_normalize({out})"


def _words_sql(text: str) -> str:
    folded = f"replace(replace(replace(lower({_form_sql(text)}), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's')"
    return f"list_filter(regexp_split_to_array({folded}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


P8_SQL = f"""
WITH d AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, {_words_sql("passage")} AS w FROM eval_items WHERE passage IS NOT NULL),
dg AS (SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - 11)) AS k FROM d)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 12], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - 11)) AS k FROM e))
"""


@query(P8_SQL + """
, c AS (SELECT DISTINCT item_id, doc_id, k + n AS word FROM (SELECT item_id, doc_id, k, unnest(range(0, 13)) AS n FROM eg JOIN dg USING (gram)))
SELECT item_id, doc_id, count(*) AS covered, any_value(len(w))::INT AS n_words FROM c JOIN d USING (doc_id) GROUP BY ALL
""")
def p8_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of a document an item covers in runs of 13 or more."""
    spans = leaks.leak_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.leaks(spans).selectExpr("item AS item_id", "doc AS doc_id", "covered", "n_words")


@query(P8_SQL + "SELECT DISTINCT item_id, doc_id FROM eg JOIN dg USING (gram)")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 13 consecutive words or more of an item."""
    spans = leaks.leak_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.leaks(spans).select(leaks.F.col("item").alias("item_id"), leaks.F.col("doc").alias("doc_id"))


@query()
def p8_without_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, leaked spans cut out."""
    documents = table(spark, sf_dir, "documents")
    return leaks.without_leaks(documents, leaks.leak_spans(documents, table(spark, sf_dir, "eval_items")))


@query()
def p8_recall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank, success and hits of each passage of which documents quote any part."""
    quoted = leaks.quoting(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return retrieval.reciprocal_ranks(core._recall(spark, sf_dir), quoted)


# -- 9: mixing sources -----------------------------------------------------------

P9_SQL = """
WITH d AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1),
t AS (SELECT lower(trim(source)) AS source, max(target_share) AS share, max(max_repeats) AS repeats FROM mix_targets GROUP BY 1)
SELECT t.source FROM t LEFT JOIN d USING (source)
WHERE share / (SELECT sum(share) FROM t) * (SELECT sum(size) FROM d) > repeats * coalesce(d.size, 0)
"""


@query(P9_SQL)
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that fall short even at their most repeats."""
    sizes = mixing.token_sizes(table(spark, sf_dir, "documents"))
    return mixing.mix_plan(sizes, table(spark, sf_dir, "mix_targets")).filter("short").select("source")


@query()
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the realised mix."""
    sizes = cut(mixing.token_sizes(table(spark, sf_dir, "documents")))
    plan = mixing.mix_plan(sizes, table(spark, sf_dir, "mix_targets"))
    return mixing.mix_report(plan, mixing.realise(sizes, plan))


P9_PLAN_SQL = """
WITH d AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1),
t AS (SELECT lower(trim(source)) AS source, max(target_share) AS share, max(max_repeats) AS repeats FROM mix_targets GROUP BY 1),
n AS MATERIALIZED (
  SELECT t.source, share / (SELECT sum(share) FROM t) AS target_share, repeats::INT AS max_repeats, coalesce(size, 0)::BIGINT AS size, (SELECT sum(size) FROM d) AS total
  FROM t LEFT JOIN d USING (source))
SELECT source, round(target_share, 9) AS target_share, max_repeats, size, round(target_share * total)::BIGINT AS wanted,
       least(round(target_share * total), max_repeats * size)::BIGINT AS budget, target_share * total > max_repeats * size AS short,
       round(least(target_share, max_repeats * size / total) / sum(least(target_share, max_repeats * size / total)) OVER (), 9) AS mix_share
FROM n
"""


@query(P9_PLAN_SQL)
def p9_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets and shares of the mix where a record's size is its characters."""
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    sizes = rows.select(mixing.source_name(rows["source"]).alias("source"), mixing.F.length("text").cast("long").alias("tokens"))
    plan = mixing.mix_plan(sizes, table(spark, sf_dir, "mix_targets"))
    return plan.selectExpr("source", "round(target_share, 9) AS target_share", "max_repeats", "tokens AS size", "wanted", "budget", "short", "round(mix_share, 9) AS mix_share")


# -- 10: visually identical text -------------------------------------------------


@query(f"""
WITH f AS (SELECT doc_id, text, {_form_sql("text")} AS form FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT least(a.doc_id, b.doc_id) AS doc_id_a, greatest(a.doc_id, b.doc_id) AS doc_id_b
FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text WHERE regexp_matches(a.form, '[^\\s\\p{{Z}}\\p{{C}}]')
""")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same but are not equal."""
    return lookalikes.same_look_pairs(table(spark, sf_dir, "documents"))


@query(f"""
WITH f AS (SELECT doc_id, text, {_form_sql("text")} AS form FROM documents WHERE text IS NOT NULL),
k AS (SELECT form, min(doc_id) AS class_id, count(DISTINCT text) AS writings FROM f WHERE regexp_matches(form, '[^\\s\\p{{Z}}\\p{{C}}]') GROUP BY 1)
SELECT doc_id, class_id, writings FROM f JOIN k USING (form) WHERE writings > 1
""")
def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose form is written in several ways, with their class."""
    return lookalikes.same_look_classes(table(spark, sf_dir, "documents"))


# -- 5: markup residue -----------------------------------------------------------


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.table_texts(table(spark, sf_dir, "session_messages"), table(spark, sf_dir, "chat_messages"))


@query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text holds markup, one for each kind."""
    return markup.markup_rows(_texts(spark, sf_dir)).withColumnRenamed("host", "item_table")


@query()
def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts without markup."""
    return markup.clean_texts(_texts(spark, sf_dir)).withColumnRenamed("host", "item_table")


@query()
def p5_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equivalence classes of markup tokens of each table."""
    texts = _texts(spark, sf_dir).selectExpr("host", "xxhash64(row_id, block_no) AS page", "text")
    return markup.template_classes(markup.token_vectors(texts)).selectExpr("host", "pages", "array_join(tokens, ' ') AS tokens", "array_join(inside, ' ') AS inside")


# -- 4: most similar vectors -----------------------------------------------------

P4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(dense_embedding, lambda x: x::DOUBLE) AS e FROM candidate_vectors
  WHERE dense_embedding IS NOT NULL AND len(dense_embedding) = 64
    AND len(list_filter(dense_embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(dense_embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS x, b.vec_id AS y, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id),
k AS (SELECT x, y, c, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS nth FROM p WHERE c >= 0.82)
"""


@query(P4_SQL + "SELECT DISTINCT least(x, y) AS vec_id_a, greatest(x, y) AS vec_id_b FROM k WHERE nth <= 5")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs at cosine 0.82 or more of which one is among the other's five nearest."""
    near = vectors.nearest(table(spark, sf_dir, "candidate_vectors"), "vec_id", "dense_embedding", k=5, least=0.82)
    return vectors.similar_pairs(near, 0.82)


@query(P4_SQL + "SELECT x AS id, y AS other, c AS cosine FROM k WHERE nth <= 5 AND x % 20 = 0")
def p4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every row whose id is divisible by 20, with cosines."""
    return vectors.nearest(table(spark, sf_dir, "candidate_vectors"), "vec_id", "dense_embedding", k=5, least=0.82, asked=vectors.F.col("id") % 20 == 0)


@query(P4_SQL + "SELECT DISTINCT least(x, y) AS vec_id_a, greatest(x, y) AS vec_id_b FROM k WHERE nth <= 5")
def p4_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p4_found with 32 buckets and 6 tables at any size, so that few rows are hashed too."""
    near = vectors.nearest(table(spark, sf_dir, "candidate_vectors"), "vec_id", "dense_embedding", k=5, least=0.82, buckets=32, tables=6, cell_rows=65_536)
    return vectors.similar_pairs(near, 0.82)


# -- 3: similarity clusters ------------------------------------------------------

P3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(dense_embedding, lambda x: x::DOUBLE) AS e FROM candidate_vectors
  WHERE dense_embedding IS NOT NULL AND len(dense_embedding) = 64
    AND len(list_filter(dense_embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(dense_embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.82),
r AS (SELECT vec_id AS root, vec_id AS node FROM v UNION SELECT r.root, l.y FROM r JOIN l ON l.x = r.node),
c AS (SELECT node AS vec_id, min(root) AS cluster_id FROM r GROUP BY node),
k AS (SELECT cluster_id, vec_id FROM c WHERE cluster_id IN (SELECT cluster_id FROM c GROUP BY 1 HAVING count(*) >= 3))
"""


def _clusters(spark: SparkSession, sf_dir: str, **sizes) -> DataFrame:
    found = clusters.clusters(table(spark, sf_dir, "candidate_vectors"), "vec_id", "dense_embedding", 0.82, **sizes)
    return found.withColumnRenamed("id", "vec_id")


@query(P3_SQL + "SELECT cluster_id, vec_id FROM k")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the clusters of similar vectors."""
    return _clusters(spark, sf_dir)


@query(P3_SQL + "SELECT cluster_id, vec_id FROM k")
def p3_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p3_found with 32 buckets and 6 tables at any size, so that few rows are hashed too."""
    return _clusters(spark, sf_dir, buckets=32, tables=6, cell_rows=65_536)


@query(P3_SQL + """
, p AS (SELECT k.cluster_id, k.vec_id AS x, w.vec_id AS y, list_cosine_similarity(a.e, b.e) AS c
  FROM k JOIN k w ON k.cluster_id = w.cluster_id AND k.vec_id <> w.vec_id JOIN v a ON a.vec_id = k.vec_id JOIN v b ON b.vec_id = w.vec_id),
m AS (SELECT cluster_id, x, round(avg(c), 6) AS mean FROM p GROUP BY 1, 2),
t AS (SELECT cluster_id, string_agg(x::VARCHAR, ' ' ORDER BY mean DESC, x) AS typical FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY mean DESC, x) AS nth FROM m) WHERE nth <= 3 GROUP BY 1)
SELECT p.cluster_id, count(DISTINCT x) AS members, round(avg(c), 6) AS cohesion, any_value(typical) AS typical FROM p JOIN t USING (cluster_id) GROUP BY 1
""")
def p3_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's size, cohesion and most typical members."""
    rows = table(spark, sf_dir, "candidate_vectors")
    members = _clusters(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return clusters.describe(members, rows, "vec_id", "dense_embedding").selectExpr("cluster_id", "members", "cohesion", "array_join(transform(typical, x -> CAST(x AS STRING)), ' ') AS typical")
