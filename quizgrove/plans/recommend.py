"""Queries over embeddings: similarity, recommendation lists, recall and incremental upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizgrove.functions import text, values, vectors
from quizgrove.operators import recommend
from quizgrove.operators.similarity import top_k_similar
from quizgrove.plans.fixtures import table, with_views
from quizgrove.plans.registry import query
from quizgrove.plans.text import clean_sql

_SCORED = """unit AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings),
scored AS (SELECT a.vec_id query_id, b.vec_id item_id, round(list_dot_product(a.v, b.v), 6) score FROM unit a, unit b)"""


def _ranked_sql(name: str, k: int, where: str = "query_id<>item_id") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, item_id, score,
 row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) rank FROM scored WHERE {where}) x WHERE rank<={k})"""


def _items(spark, sf_dir):
    return table(spark, sf_dir, "f_item")


def _queries(items):
    return items.select(F.col("question_id").alias("query_id"), "embedding")


def _corpus(items):
    return items.select(F.col("question_id").alias("item_id"), "embedding")


_VECTOR = "CAST(embedding AS DOUBLE[])"


@query(
    "f6_normalize",
    f"""SELECT vec_id, round(sqrt(list_dot_product({_VECTOR}, {_VECTOR})),6) norm,
 list_transform(embedding, lambda x: round(CAST(x*3 AS DOUBLE)/sqrt(list_dot_product(
  list_transform(embedding, lambda y: CAST(y*3 AS DOUBLE)), list_transform(embedding, lambda y: CAST(y*3 AS DOUBLE)))),6))[1] head
FROM embeddings""",
)
def normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    scaled = vectors.l2_normalize(F.transform("embedding", lambda x: x * F.lit(3.0).cast("float")))
    return rows.select(
        "vec_id",
        F.round(vectors.l2_norm(F.col("embedding")), 6).alias("norm"),
        F.round(F.element_at(scaled, 1), 6).alias("head"),
    )


@query(
    "f7_dot",
    """SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])),6) next_score
FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1""",
)
def dot(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(following, "vec_id").select(
        "vec_id", F.round(vectors.dot(F.col("embedding"), F.col("other")), 6).alias("next_score")
    )


@query("j13_knn", f"WITH {_SCORED}, {_ranked_sql('top', 10)} SELECT query_id, item_id, score, rank FROM top")
def knn(spark, sf_dir):
    items = _items(spark, sf_dir)
    return top_k_similar(_queries(items), _corpus(items), 10)


@query("j13_knn_blocks", f"WITH {_SCORED}, {_ranked_sql('top', 10)} SELECT query_id, item_id, score, rank FROM top")
def knn_blocks(spark, sf_dir):
    items = _items(spark, sf_dir)
    return top_k_similar(_queries(items), _corpus(items), 10, broadcast_queries=300, corpus_block=400)


_SHOWN = """SELECT query_id, item_id, score, rank, substring(coalesce(content,''),1,120) content, options, type_id, grade_id,
 subject_id, difficulty_id FROM {source} JOIN f_item ON question_id=item_id"""
_SEARCH_COLUMNS = (
    "query_id", "item_id", "score", "rank", "content", "options", "type_id", "grade_id", "subject_id", "difficulty_id",
)


@query(
    "r2_search",
    f"""{with_views("f_item")}, {_SCORED},
{_ranked_sql("top", 10, "query_id<>item_id AND item_id IN (SELECT question_id FROM f_item WHERE subject_id=18 AND grade_id=2)")}
{_SHOWN.format(source="top")}""",
)
def search(spark, sf_dir):
    items = _items(spark, sf_dir)
    asked = recommend.queries_by_id(items.select(F.col("question_id").alias("query_id")), items)
    return recommend.search(asked, items, 10, {"subject_id": 18, "grade_id": 2, "unknown": 5}).select(*_SEARCH_COLUMNS)


@query(
    "r2_text_search",
    f"""{with_views("f_item")}, {_SCORED},
{_ranked_sql("top", 3, "query_id%100=0")}
{_SHOWN.format(source="top")}""",
)
def text_search(spark, sf_dir):
    # the vectors of f_item stand for what an embedder returns for their questions' texts
    items = _items(spark, sf_dir)
    texts = items.filter("question_id%100=0").select(F.col("question_id").alias("query_id"), F.col("embedding").alias("query_text"))
    asked = recommend.queries_by_text(texts, lambda text: text)
    return recommend.search(asked, items, 3, exclude_self=False).select(*_SEARCH_COLUMNS)


@query(
    "t5_overfetch",
    f"""{with_views("f_item")}, {_SCORED}, {_ranked_sql("wide", 30, "true")},
kept AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY wide.rank) rank
 FROM wide JOIN f_item ON question_id=item_id WHERE query_id<>item_id AND subject_id=18),
top AS (SELECT * FROM kept WHERE rank<=10)
{_SHOWN.format(source="top")}""",
)
def overfetch(spark, sf_dir):
    items = _items(spark, sf_dir)
    found = recommend.search(_queries(items), items, 10, {"subject_id": 18}, overfetch=recommend.OVERFETCH)
    return found.select(*_SEARCH_COLUMNS)


_LOCAL = f"""{with_views("f_item", "f_external")}, {_SCORED}, {_ranked_sql("wide", 15, "true")},
local AS (SELECT * FROM (SELECT w.query_id, w.item_id, w.score, i.type_id item_type, row_number() OVER (PARTITION BY w.query_id
  ORDER BY CASE WHEN i.type_id=q.type_id THEN 0 ELSE 1 END, w.rank) place
 FROM wide w JOIN f_item i ON i.question_id=w.item_id JOIN f_item q ON q.question_id=w.query_id
 WHERE w.query_id<>w.item_id) x WHERE place<=10)"""


def _local(spark, sf_dir):
    items = _items(spark, sf_dir)
    return recommend.same_type_first(_queries(items), items)


@query("t6_same_type_first", f"{_LOCAL} SELECT query_id, item_id, score, item_type, place FROM local")
def same_type_first(spark, sf_dir):
    return _local(spark, sf_dir)


@query(
    "r9_recall",
    f"""{_LOCAL},
counted AS (SELECT e.query_id, count(*) total, count(l.item_id) matched,
 coalesce(string_agg(CAST(l.item_id AS VARCHAR), ',' ORDER BY l.item_id), '') matched_ids
 FROM (SELECT DISTINCT query_id, ext_id FROM f_external) e
 LEFT JOIN local l ON l.query_id=e.query_id AND l.item_id=e.ext_id GROUP BY e.query_id)
SELECT vec_id query_id, coalesce(total,0) total, coalesce(matched,0) matched, coalesce(matched_ids,'') matched_ids,
 coalesce(round(matched/total,6),0) recall, coalesce(matched>=0.8*total, false) success
FROM embeddings LEFT JOIN counted ON query_id=vec_id""",
)
def recall(spark, sf_dir):
    items = _items(spark, sf_dir)
    return recommend.recall_against(_queries(items), _local(spark, sf_dir), table(spark, sf_dir, "f_external"))


@query(
    "u4_unmatched",
    f"""{_LOCAL} SELECT DISTINCT query_id, ext_id item_id FROM f_external e
WHERE NOT EXISTS (SELECT 1 FROM local l WHERE l.query_id=e.query_id AND l.item_id=e.ext_id)""",
)
def unmatched(spark, sf_dir):
    return recommend.unmatched(_local(spark, sf_dir), table(spark, sf_dir, "f_external"))


@query(
    "r10_mean_rank",
    f"""{with_views("f_external")}, {_SCORED}, {_ranked_sql("top", 20)}
SELECT e.query_id, count(*) total, count(t.rank) found, round(avg(t.rank),6) mean_rank,
 coalesce(string_agg(CAST(t.rank AS VARCHAR), ',' ORDER BY t.rank),'') ranks, count(t.rank)>=0.6*count(*) success
FROM (SELECT DISTINCT query_id, ext_id FROM f_external) e
LEFT JOIN top t ON t.query_id=e.query_id AND t.item_id=e.ext_id GROUP BY e.query_id""",
)
def mean_rank(spark, sf_dir):
    items = _items(spark, sf_dir)
    found = top_k_similar(_queries(items), _corpus(items), 20)
    marked = table(spark, sf_dir, "f_external").withColumnRenamed("ext_id", "item_id")
    return recommend.ranks_of_marked(found, marked)


@query(
    "a11_mean_similarity",
    f"WITH {_SCORED}, {_ranked_sql('top', 10)} SELECT query_id, round(avg(score),5) mean_score FROM top GROUP BY query_id",
)
def mean_similarity(spark, sf_dir):
    items = _items(spark, sf_dir)
    found = top_k_similar(_queries(items), _corpus(items), 10)
    return found.groupBy("query_id").agg(F.round(F.avg("score"), 5).alias("mean_score"))


@query(
    "t7_resort",
    f"""{with_views("f_item")}, {_SCORED}, {_ranked_sql("top", 3)}
SELECT query_id, item_id, score, rank, difficulty_id FROM top JOIN f_item ON question_id=item_id
ORDER BY coalesce(difficulty_id,0), query_id, rank""",
)
def resort(spark, sf_dir):
    items = _items(spark, sf_dir)
    found = recommend.search(_queries(items), items, 3)
    return recommend.resorted(found, "difficulty").select("query_id", "item_id", "score", "rank", "difficulty_id")


@query(
    "p17_labels",
    f"""{with_views("f_item")}
SELECT question_id, CASE type_id WHEN 1 THEN '单选' WHEN 2 THEN '多选' WHEN 3 THEN '填空' WHEN 4 THEN '解答' ELSE '未知' END type_name,
 CASE subject_id WHEN 17 THEN '语文' WHEN 18 THEN '数学' WHEN 19 THEN '英语' ELSE '其他' END subject_name,
 CASE grade_id WHEN 1 THEN '单选' ELSE '未知' END unknown_name FROM f_item""",
)
def labels(spark, sf_dir):
    return _items(spark, sf_dir).select(
        "question_id",
        values.label(F.col("type_id"), values.TYPE_NAMES, values.OTHER_TYPE).alias("type_name"),
        values.label(F.col("subject_id"), values.SUBJECT_NAMES, values.OTHER_SUBJECT).alias("subject_name"),
        values.label(F.col("grade_id"), {1: values.TYPE_NAMES[1]}, values.OTHER_TYPE).alias("unknown_name"),
    )


@query(
    "p16_shape",
    f"""{with_views("f_item")}, top AS (SELECT question_id query_id, question_id item_id, 1.0::DOUBLE score, 1 rank FROM f_item)
{_SHOWN.format(source="top")}""",
)
def shape(spark, sf_dir):
    items = _items(spark, sf_dir)
    found = items.select(
        F.col("question_id").alias("query_id"), F.col("question_id").alias("item_id"),
        F.lit(1.0).alias("score"), F.lit(1).alias("rank"),
    )
    return recommend.with_payload(found, items).select(*_SEARCH_COLUMNS)


@query(
    "t8_sample",
    f"""SELECT doc_id question_id, text "content" FROM documents ORDER BY CASE
 WHEN length({clean_sql("text")})>0 AND coalesce(length(trim(text)),0)>5 THEN 0 WHEN length({clean_sql("text")})>0 THEN 1 ELSE 2 END,
 md5(concat(doc_id,'/7')), doc_id LIMIT 1""",
)
def sample(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.col("text").alias("content"))
    return recommend.sample_row(documents, text.clean_html(F.col("content")), seed=7)


# --- incremental upkeep ----------------------------------------------------------------------


def _hashed_sql(source: str) -> str:
    return f"""placed AS (SELECT id, CAST('0x'||substr(md5(w),1,8) AS UBIGINT)%64 place, count(*) c
 FROM (SELECT id, unnest(string_split(lower(body),' ')) w FROM {source}) x WHERE w<>'' GROUP BY 1,2),
norms AS (SELECT id, sqrt(sum(c*c)) norm FROM placed GROUP BY id),
grid AS (SELECT id, d FROM (SELECT id, unnest(range(64)) d FROM {source}) x),
digests AS (SELECT g.id, string_agg(CAST(CAST(round(coalesce(c/norm,0)*10000) AS BIGINT) AS VARCHAR), ',' ORDER BY d) digest
 FROM grid g LEFT JOIN placed p ON p.id=g.id AND p.place=g.d LEFT JOIN norms n ON n.id=g.id GROUP BY g.id)"""


def _digest(vector):
    whole = F.transform(vector, lambda x: F.round(x * 10000).cast("bigint").cast("string"))
    return F.array_join(whole, ",")


@query(
    "r1_embed",
    f"""WITH body AS (SELECT doc_id id, {clean_sql("text")} body FROM documents),
{_hashed_sql("body")}
SELECT id doc_id, digest FROM digests""",
)
def embed(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", text.clean_html(F.col("text")).alias("body"))
    return recommend.embed(documents, "body").select("doc_id", _digest(F.col("embedding")).alias("digest"))


def _batch(spark, sf_dir):
    """Documents, and once more those with a label under the same id but a later place."""
    documents = table(spark, sf_dir, "documents")
    first = documents.select(
        F.col("doc_id").alias("question_id"), F.col("text").alias("content"), F.col("doc_id").alias("seq")
    )
    again = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("question_id"), F.lit("label").alias("content"), (F.col("doc_id") + 10**9).alias("seq")
    )
    return first.unionByName(again)


_FRESH = f"""fresh AS (SELECT doc_id id, {clean_sql("text")} body FROM documents
 WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
 UNION ALL SELECT DISTINCT doc_id, 'label' FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
  AND doc_id NOT IN (SELECT doc_id FROM documents))"""


@query(
    "r4_incremental_add",
    f"""WITH {_FRESH}, full_fresh AS (SELECT * FROM fresh WHERE length(body)>0),
{_hashed_sql("full_fresh")}
SELECT id question_id, digest FROM digests""",
)
def incremental_add(spark, sf_dir):
    added = recommend.add_questions(_items(spark, sf_dir), _batch(spark, sf_dir))
    return added.select("question_id", _digest(F.col("embedding")).alias("digest"))


_RESPONSES = """SELECT doc_id, to_json(array(named_struct('id', doc_id, 'stem', concat('<p>', text, '</p>'),
 'options', concat('A. ', lang, '&nbsp;B. ', source), 'analysis', source))) response FROM {documents}"""


@query(
    "r6_merge_external",
    f"""SELECT vec_id question_id, CAST(label%4+1 AS INT) type_id, NULL answer, NULL analysis FROM embeddings
UNION ALL
SELECT doc_id, 1, '', {clean_sql("source")} FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""",
)
def merge_external(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("seq", F.lit(0))
    responses = spark.sql(_RESPONSES, documents=table(spark, sf_dir, "documents"))
    outside = recommend.flatten_responses(responses)
    fresh = recommend.new_rows(items, outside.withColumn("seq", F.lit(1)), "seq")
    return recommend.append(items.drop("embedding"), fresh).select("question_id", "type_id", "answer", "analysis")


@query(
    "r6_flatten",
    f"""SELECT doc_id question_id, 1 type_id, {clean_sql("concat('<p>', text, '</p>')")} content,
 {clean_sql("concat('A. ', lang, '&nbsp;B. ', source)")} options, '' answer, {clean_sql("source")} analysis FROM documents""",
)
def flatten(spark, sf_dir):
    responses = spark.sql(_RESPONSES, documents=table(spark, sf_dir, "documents"))
    return recommend.flatten_responses(responses)


@query(
    "w1_keep_first",
    """WITH batch AS (SELECT doc_id question_id, text content, doc_id seq FROM documents
 UNION ALL SELECT doc_id, 'label', doc_id+1000000000 FROM labels)
SELECT question_id, content, seq FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seq) rn FROM batch) x WHERE rn=1""",
)
def keep_first(spark, sf_dir):
    return recommend.keep_first(_batch(spark, sf_dir), "question_id", "seq")


@query(
    "u1_append",
    f"""{with_views("f_item")}
SELECT question_id, type_id, NULL seq FROM f_item UNION ALL SELECT doc_id, NULL, doc_id FROM documents
UNION ALL SELECT doc_id, NULL, doc_id+1000000000 FROM labels""",
)
def append(spark, sf_dir):
    rows = recommend.append(_items(spark, sf_dir).select("question_id", "type_id"), _batch(spark, sf_dir).drop("content"))
    return rows.select("question_id", "type_id", "seq")


@query("r7_missing_vectors", "SELECT doc_id question_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"))
    return recommend.missing_vectors(items, table(spark, sf_dir, "f_item"))


@query(
    "a16_consistency",
    f"""WITH ids AS (SELECT doc_id id, count(*) n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) x GROUP BY 1),
held AS (SELECT vec_id, count(*) n FROM embeddings GROUP BY 1),
both_sides AS (SELECT coalesce(ids.id, vec_id) id, coalesce(ids.n,0) n_items, coalesce(held.n,0) n_vectors
 FROM ids FULL JOIN held ON vec_id=ids.id),
counts AS (SELECT CAST(sum(n_items) AS BIGINT) items, CAST(sum(n_vectors) AS BIGINT) vectors, count(*) FILTER (n_vectors=0) missing,
 count(*) FILTER (n_items=0) orphans, count(*) FILTER (n_items>1 OR n_vectors>1) repeated, count(*)-count(DISTINCT id) id_clashes FROM both_sides)
SELECT *, missing+orphans+repeated+id_clashes=0 consistent FROM counts""",
)
def consistency(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"))
    again = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"))
    return recommend.consistency(ids.unionByName(again), table(spark, sf_dir, "f_item"))


_GROWTH = """base AS (SELECT vec_id FROM embeddings WHERE label<5),
first AS (SELECT ext_id, min(query_id%5) iteration FROM f_external GROUP BY ext_id),
fresh AS (SELECT iteration, count(*) added FROM first WHERE ext_id NOT IN (SELECT vec_id FROM base) GROUP BY iteration),
rounds AS (SELECT DISTINCT query_id%5 iteration FROM f_external),
grown AS (SELECT r.iteration, coalesce(added,0) added, (SELECT count(*) FROM base) + sum(coalesce(added,0)) OVER (ORDER BY r.iteration) total
 FROM rounds r LEFT JOIN fresh f ON f.iteration=r.iteration)"""


def _growth(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings").filter("label < 5").select(F.col("vec_id").alias("question_id"))
    responses = table(spark, sf_dir, "f_external").select(
        (F.col("query_id") % 5).alias("iteration"), F.col("ext_id").alias("question_id")
    )
    return recommend.growth(base, responses)


@query(
    "r11_growth",
    f"""{with_views("f_external")}, {_GROWTH}
SELECT iteration, CAST(total-added AS BIGINT) before, added, CAST(total AS BIGINT) after FROM grown""",
)
def growth(spark, sf_dir):
    return _growth(spark, sf_dir).select("iteration", "before", "added", "after")


@query(
    "r11_loop",
    f"""{with_views("f_external")}, {_SCORED},
first AS (SELECT ext_id, min(query_id%3) since FROM f_external GROUP BY ext_id),
member AS (SELECT vec_id, CASE WHEN label<5 THEN -1 ELSE since END since FROM embeddings LEFT JOIN first ON ext_id=vec_id
 WHERE label<5 OR since IS NOT NULL),
round AS (SELECT unnest([0,1,2]) iteration),
ranked AS (SELECT iteration, query_id, item_id, row_number() OVER (PARTITION BY iteration, query_id ORDER BY score DESC, item_id) rank
 FROM round CROSS JOIN scored JOIN member ON vec_id=item_id WHERE since<=iteration AND query_id<>item_id),
per_query AS (SELECT r.iteration, e.query_id, count(*) total, count(t.rank) found
 FROM round r CROSS JOIN (SELECT DISTINCT query_id, ext_id FROM f_external) e
 LEFT JOIN ranked t ON t.iteration=r.iteration AND t.query_id=e.query_id AND t.item_id=e.ext_id AND t.rank<=10 GROUP BY ALL)
SELECT iteration, (SELECT count(*) FROM member WHERE since<iteration) before, (SELECT count(*) FROM member WHERE since=iteration) added,
 count(*) queries, count(*) FILTER (found>=0.6*total) successful, CAST(sum(found) AS BIGINT) found,
 round(sum(found)/sum(total),6) recall FROM per_query GROUP BY iteration""",
)
def closed_loop(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "question_id")
    external = table(spark, sf_dir, "f_external")
    marked = external.withColumnRenamed("ext_id", "item_id")
    outside = embeddings.select("question_id", "embedding", F.lit(0).alias("seq"))
    batches = [
        outside.join(external.filter(F.col("query_id") % 3 == n).select(F.col("ext_id").alias("question_id")), "question_id")
        for n in range(3)
    ]
    probes = embeddings.select(F.col("question_id").alias("query_id"), "embedding")

    def add(items, batch):
        return recommend.new_rows(items, batch, "seq").drop("seq")

    def search(items, known):
        return top_k_similar(probes, _corpus(items), recommend.LIST_LENGTH, known=known)

    def evaluate(lists):
        return recommend.ranks_of_marked(lists, marked)

    base = embeddings.filter("label < 5").select("question_id", "embedding")
    return recommend.closed_loop(base, batches, add, search, evaluate)[1]


@query(
    "a13_loop_report",
    f"""{with_views("f_external")}, {_GROWTH}
SELECT count(*) iterations, count(*) FILTER (added>0) successful, CAST(sum(added) AS BIGINT) new_questions,
 round(sum(added)/count(*),6) new_per_iteration, round(sum(iteration*1.5),6)::DOUBLE total_seconds,
 round(count(*) FILTER (added>0)/count(*),6) success_rate FROM grown""",
)
def loop_report(spark, sf_dir):
    rows = _growth(spark, sf_dir)
    outcomes = rows.select("iteration", (F.col("added") > 0).alias("success"), (F.col("iteration") * 1.5).alias("seconds"))
    return recommend.loop_report(rows, outcomes)


@query(
    "p10_candidates",
    """SELECT doc_id question_id FROM documents WHERE length(trim(text))>20000 UNION ALL
SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM documents WHERE length(trim(text))>20000)""",
)
def candidates(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.col("text").alias("content"))
    return recommend.candidates(documents, 20000).select("question_id")
