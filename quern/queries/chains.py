"""Record chains, templates and routing by branches."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.models import Params, RuleModel
from ..operators import chain, template
from . import query, table


@query("SELECT p_partkey AS num, p_partkey AS passed, p_partkey * 3 AS mult, p_partkey + 1 AS modified FROM part")
def passthrough_assign(spark, d):
    c = F.col("p_partkey")
    return table(spark, d, "part").transform(chain.pipe(chain.passthrough, chain.assign(mult=c * 3), chain.parallel(num=c, passed=c, mult=F.col("mult"), modified=c + 1)))


@query("SELECT c_custkey AS id, lower(c_name) AS joke, upper(c_mktsegment) AS poem, length(c_name) AS size FROM customer")
def parallel_map(spark, d):
    return table(spark, d, "customer").transform(chain.parallel(id=F.col("c_custkey"), joke=F.lower("c_name"), poem=F.upper("c_mktsegment"), size=F.length("c_name")))


@query("SELECT c_custkey AS id, length(c_name) AS a, length(c_name) * length(c_mktsegment) AS b FROM customer")
def length_exprs(spark, d):
    foo, bar = F.col("record.foo"), F.col("record.bar")
    records = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("foo"), F.col("c_mktsegment").alias("bar")).alias("record"))
    return records.transform(chain.parallel(id=F.col("id"), a=F.length(foo), b=F.length(foo) * F.length(bar)))


@query("""SELECT c_custkey AS id, CASE WHEN contains(lower(c_mktsegment), 'auto') THEN 'first' WHEN contains(lower(c_mktsegment), 'b') THEN 'second' ELSE 'general' END AS route FROM customer""")
def route_branch(spark, d):
    low = F.lower("c_mktsegment")
    route = chain.branch([(low.contains("auto"), F.lit("first")), (low.contains("b"), F.lit("second"))], F.lit("general"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), route.alias("route"))


@query("SELECT r_regionkey AS id, lower(r_name) AS plain, upper(r_name) AS loud, length(r_name)::VARCHAR AS short FROM region")
def configurable(spark, d):
    model = chain.Configurable({"lower": F.lower, "upper": F.upper, "length": lambda c: F.length(c).cast("string")}, "lower")
    name = F.col("r_name")
    return table(spark, d, "region").select(F.col("r_regionkey").alias("id"), model(name).alias("plain"), model.with_config(model="upper")(name).alias("loud"), model.with_config(model="upper").with_config(model="length")(name).alias("short"))


@query("SELECT * FROM (VALUES ('t1', 'one tax plan', '01-02-2024', '00007'), ('t2', 'two trash', '02-03-2024', '00042'), ('t3', 'three', '03-04-2024', '12345')) v(id, text, date, token)")
def literal_table(spark, d):
    rows = [("t1", "one tax plan", "01-02-2024", 7), ("t2", "two trash", "02-03-2024", 42), ("t3", "three", "03-04-2024", 12345)]
    return spark.createDataFrame(rows, "id string, text string, date string, token int").withColumn("token", T.token_format(F.col("token")))


@query(r"""SELECT conv_id, turn, lower(list_extract(string_split(trim('Say: ' || text, e' \n\r\t'), e'\n'), -1)) AS output FROM conversations""")
def sequential_chain(spark, d):
    steps = chain.pipe(
        chain.assign(prompt=template.compiled("Say: {text}", {"text": F.col("text")})),
        chain.assign(answer=T.last_line(F.col("prompt"))),
        chain.parallel(conv_id=F.col("conv_id"), turn=F.col("turn"), output=F.lower("answer")),
    )
    return table(spark, d, "conversations").transform(steps)


@query(r"""WITH r AS (SELECT conv_id, turn, 'Review: ' || text AS review FROM conversations), s AS (SELECT *, substr(review, 1, 40) AS summary FROM r)
SELECT conv_id, turn, review, summary, length(review) AS n, summary || ' / ' || length(review) AS followup FROM s""")
def sequential_multi(spark, d):
    run = chain.sequential(
        ["conv_id", "turn", "review", "summary", "n", "followup"],
        review=lambda: F.concat(F.lit("Review: "), "text"), summary=lambda: F.substring("review", 1, 40), n=lambda: F.length("review"),
        followup=lambda: F.concat("summary", F.lit(" / "), F.col("n").cast("string")),
    )
    return table(spark, d, "conversations").transform(run)


@query("SELECT item_id, 'Answer in Spanish {once}: ' || text || ' (from item ' || item_id || ')' AS prompt FROM benchmark")
def prompt_render(spark, d):
    values = {"language": "Spanish", "question": F.col("text"), "id": F.col("item_id"), "unused": "x"}
    return table(spark, d, "benchmark").select("item_id", template.compiled("Answer in {language} {{once}}: {question} (from item {id})", values).alias("prompt"))


@query("SELECT item_id, 'system: You answer briefly.' || chr(10) || 'human: ' || text AS messages FROM benchmark")
def chat_messages(spark, d):
    m = template.messages([("system", "You answer briefly."), ("human", "{question}")], {"question": F.col("text")})
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.transform(m, lambda x: F.concat_ws(": ", x.role, x.content)), "\n").alias("messages"))


@query("SELECT item_id, 'Use these results: ' || text || ' - and cite.' AS prompt FROM benchmark")
def prompt_search_results(spark, d):
    return table(spark, d, "benchmark").select("item_id", template.with_results("Use these results: $search_results$ - and cite.", F.col("text")).alias("prompt"))


@query(r"""SELECT conv_id, turn, string_split(string_split(text, '.')[1], ',')[1] AS output FROM conversations""")
def stop_truncate(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.stop_at(F.col("text"), [".", ","]).alias("output"))


@query(r"""SELECT doc_id, list_extract(string_split(trim(text, e' \n\r\t'), e'\n'), -1) AS line FROM documents""")
def last_line(spark, d):
    return table(spark, d, "documents").select("doc_id", T.last_line(F.col("text")).alias("line"))


@query(r"""SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(string_split(list_extract(string_split(trim(text, e' \n\r\t'), e'\n'), -1), '.')[1], '[ \n\t\r]+'), lambda x: x <> '')[1:5], ' ') AS answer FROM conversations""")
def generate_bounded(spark, d):
    model = RuleModel(Params(max_tokens=5, stop=(".",)))
    return table(spark, d, "conversations").select("conv_id", "turn", model(F.col("text")).alias("answer"))
