"""Vector search, hybrid search, retrieval chains."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..functions.models import HashEmbedder, RuleModel
from ..operators import retrieval, template
from ..operators.filters import compile_filter
from . import query, table

COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6)"
IP = "round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6)"
RANKED = f"""SELECT q.vec_id AS qid, e.vec_id, {COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, e.vec_id) AS rank
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q"""


def vector_of(spark, d, vec_id):
    """One query vector as a literal."""
    row = table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return F.array(*(F.lit(float(x)) for x in row[0])) if row else F.array().cast("array<double>")


@query(f"SELECT e.vec_id, {COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id <> 0 ORDER BY score DESC, e.vec_id LIMIT 3")
def vector_topk(spark, d):
    corpus = table(spark, d, "embeddings").where("vec_id <> 0")
    return retrieval.top_k(corpus, F.round(V.cosine(vector_of(spark, d, 0), F.col("embedding")), 6), "vec_id", 3).select("vec_id", "score")


@query(f"SELECT e.vec_id, {IP} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 1 AND e.vec_id <> 1 ORDER BY score DESC, e.vec_id LIMIT 5")
def vector_ip_topk(spark, d):
    corpus = table(spark, d, "embeddings").where("vec_id <> 1")
    return retrieval.top_k(corpus, F.round(V.dot(vector_of(spark, d, 1), F.col("embedding")), 6), "vec_id", 5).select("vec_id", "score")


@query(f"SELECT e.vec_id, {COS} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 2")
def similarity_sort(spark, d):
    s = F.round(V.cosine(vector_of(spark, d, 2), F.col("embedding")), 6)
    return table(spark, d, "embeddings").select("vec_id", F.nanvl(s, F.lit(None)).alias("similarity")).orderBy(F.desc_nulls_last("similarity"), "vec_id")


@query(f"SELECT e.vec_id, {COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label > 2 AND e.label < 8 ORDER BY score DESC, e.vec_id LIMIT 5")
def filtered_topk(spark, d):
    spec = {"andAll": [{"greaterThan": {"key": "label", "value": 2}}, {"lessThan": {"key": "label", "value": 8}}]}
    corpus = table(spark, d, "embeddings").where(compile_filter(spec, lambda k: F.col(k).cast("string")))
    return retrieval.top_k(corpus, F.round(V.cosine(vector_of(spark, d, 0), F.col("embedding")), 6), "vec_id", 5).select("vec_id", "score")


def _best(spark, d, k=3):
    """The k nearest rows of every vector whose id is divisible by 20, against all rows."""
    e = table(spark, d, "embeddings")
    return retrieval.top_k_each(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), e, "qid", "q", "vec_id", "embedding", k)


@query(f"""WITH r AS ({RANKED}) SELECT r.qid, string_agg(t.text, chr(10) ORDER BY r.rank) AS context, CAST(count(*) AS BIGINT) AS n
FROM r JOIN documents t ON t.doc_id = r.vec_id WHERE r.rank <= 3 GROUP BY r.qid""")
def retrieval_chain(spark, d):
    rows = _best(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    return retrieval.stuffed(rows, ["qid"], "rank", F.col("text")).join(rows.groupBy("qid").agg(F.count("*").alias("n")), "qid").select("qid", "context", "n")


@query(f"WITH r AS ({RANKED}) SELECT r.qid, r.rank, t.text AS context FROM r JOIN documents t ON t.doc_id = r.vec_id WHERE r.rank <= 5")
def contexts(spark, d):
    rows = _best(spark, d, 5).join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    results = rows.select("qid", "rank", F.array(F.struct(F.struct("text").alias("content"))).alias("results"))
    return results.select("qid", F.col("rank").cast("long").alias("rank"), F.explode(F.transform("results", lambda r: r.content.text)).alias("context"))


@query("SELECT conv_id, string_agg(text, ' | ' ORDER BY turn) AS contexts FROM conversations GROUP BY conv_id")
def citations_flatten(spark, d):
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    refs = F.transform(turns, lambda t: F.struct(F.array(F.struct(F.struct(t.text.alias("text")).alias("content"))).alias("retrievedReferences")))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(refs.alias("citations"))
    texts = F.flatten(F.transform("citations", lambda c: F.transform(c.retrievedReferences, lambda r: r.content.text)))
    return rows.select("conv_id", F.array_join(texts, " | ").alias("contexts"))


ASKED = "the ein los"


@query(f"""WITH v AS (SELECT e.vec_id AS id, row_number() OVER (ORDER BY {COS} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id = 0),
k AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n DESC, doc_id) AS rank FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+'), lambda x: x IN ('the', 'ein', 'los'))) AS n FROM documents) WHERE n > 0),
a AS (SELECT * FROM v WHERE rank <= 20 UNION ALL SELECT * FROM k WHERE rank <= 20)
SELECT id, round(sum(1.0 / (rank + 60)), 6) AS rrf FROM a GROUP BY id ORDER BY rrf DESC, id LIMIT 10""")
def hybrid_search(spark, d):
    """A vector and a query text; both lists are top 20 first, so ranks are numbered on bounded rows."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    by_vec = retrieval.top_k(e, F.round(V.cosine(vector_of(spark, d, 0), F.col("embedding")), 6), "id", 20)
    hits = table(spark, d, "documents").select(F.col("doc_id").alias("id"), retrieval.keyword_score(F.col("text"), ASKED).alias("n")).where("n > 0")
    by_word = retrieval.top_k(hits, F.col("n"), "id", 20)
    ranks = [retrieval.ranked(x, [F.desc("score"), F.col("id")]) for x in (by_vec, by_word)]
    return retrieval.fused(ranks, "id").orderBy(F.desc("rrf"), "id").limit(10)


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT doc_id, list_transform(ws, lambda x: CAST(concat('0x', substr(md5(x), 1, 8)) AS BIGINT) % 8) AS bs FROM w)
SELECT doc_id, i AS dim, CAST(len(list_filter(bs, lambda x: x = i)) AS DOUBLE) AS value FROM (SELECT *, unnest(range(8)) AS i FROM b)""")
def hash_embed(spark, d):
    v = HashEmbedder(8)(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.posexplode(v).alias("dim", "value")).withColumn("dim", F.col("dim").cast("long"))


_FLAT = "regexp_replace(t.text, '[ \\n\\t\\r]+', ' ', 'g')"


@query(f"""WITH r AS ({RANKED}), t AS (SELECT r.qid, r.rank, '<fact>' || {_FLAT} || '</fact>' AS f FROM r JOIN documents t ON t.doc_id = r.vec_id WHERE r.rank <= 3)
SELECT qid, '<facts>' || string_agg(f, '' ORDER BY rank) || '</facts>' AS prompt FROM t GROUP BY qid""")
def stuff_prompt(spark, d):
    rows = _best(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    fact = F.concat(F.lit("<fact>"), F.regexp_replace("text", T.SPACE, " "), F.lit("</fact>"))
    return retrieval.stuffed(rows, ["qid"], "rank", fact, "").select("qid", F.concat(F.lit("<facts>"), "context", F.lit("</facts>")).alias("prompt"))


_RAG = f"""WITH r AS ({RANKED}), t AS (SELECT r.qid, r.rank, r.vec_id, t.text, {_FLAT} AS f FROM r JOIN documents t ON t.doc_id = r.vec_id WHERE r.rank <= 3),
p AS (SELECT qid, 'Results: ' || string_agg(f, ' ' ORDER BY rank) AS prompt, string_agg(vec_id, ',' ORDER BY rank) AS source_ids, string_agg(text, chr(10) ORDER BY rank) AS sources FROM t GROUP BY qid),
q AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(prompt, '[ \\n\\t\\r]+'), lambda x: x <> '')[1:256], ' ') AS answer FROM p)"""


@query(f"{_RAG} SELECT qid, prompt, answer FROM q")
def rag_end_to_end(spark, d):
    """Retrieve, put the texts in a prompt, generate."""
    return _answered(spark, d).select("qid", "prompt", "answer")


@query(f"{_RAG} SELECT qid, answer, source_ids, sources FROM q")
def qa_with_sources(spark, d):
    """The answer with the rows that it was made from, in their order."""
    return _answered(spark, d).select("qid", "answer", F.array_join(F.transform("sources", lambda s: s.id.cast("string")), ",").alias("source_ids"), F.array_join(F.transform("sources", lambda s: s.text), "\n").alias("sources"))


def _answered(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    prompt = lambda context: template.with_results("Results: $search_results$", context)
    return retrieval.answered(_best(spark, d).join(docs, "vec_id"), "qid", "rank", "vec_id", "text", F.regexp_replace("text", T.SPACE, " "), prompt, RuleModel())
