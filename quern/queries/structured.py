"""JSON, entities and rule models."""

from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import models as M
from . import query, table


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_entities(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>")["k"].alias("k"))


@query("""SELECT event_id, event_id % 3 <> 2 AS ok, CASE WHEN event_id % 3 = 2 THEN 'Failed to parse' ELSE props END AS value FROM events""")
def json_repair(spark, d):
    """Events' properties without their quotes are mended, whole ones stay, and cut ones can't be parsed."""
    bare, third = F.replace("props", F.lit('"'), F.lit("")), F.col("event_id") % 3
    text = F.when(third == 0, bare).when(third == 1, F.col("props")).otherwise(F.rtrim(F.substring("props", 1, 4)))
    return table(spark, d, "events").withColumn("r", J.parse_or_repair(text)).select("event_id", "r.ok", "r.value")


@query("SELECT item_id, to_json(struct_pack(prompt := text, max_tokens := 256)) AS payload FROM benchmark")
def request_payload(spark, d):
    return payloads(table(spark, d, "benchmark"))


def payloads(rows):
    """item_id and request body of every row; a null text is a null prompt."""
    body = F.struct(F.col("text").alias("prompt"), F.lit(M.Params().max_tokens).alias("max_tokens"))
    return rows.select("item_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


@query("SELECT item_id, text AS answer FROM benchmark")
def response_extract(spark, d):
    body = F.to_json(F.struct(F.array(F.struct("text")).alias("content")))
    return table(spark, d, "benchmark").select("item_id", F.get_json_object(body, "$.content[0].text").alias("answer"))


@query("""SELECT nation.n_regionkey AS id, 'NATION' AS kind, n_name AS entity, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS BIGINT) AS place FROM nation""")
def entity_pairs(spark, d):
    m = F.to_json(F.create_map(F.lit("NATION"), F.sort_array(F.collect_list("n_name"))))
    rows = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(m.alias("j"))
    pairs = rows.select("id", F.posexplode(F.map_entries(F.from_json("j", J.ENTITY_MAP))).alias("o", "e"))
    return pairs.select("id", F.col("e.key").alias("kind"), F.posexplode("e.value").alias("place", "entity")).withColumn("place", F.col("place").cast("long"))


@query("SELECT n_regionkey AS id, coalesce(bool_or(n_name IN (SELECT n_name FROM nation WHERE n_nationkey IN (1, 2))), false) AS found FROM nation GROUP BY n_regionkey")
def entity_contains_any(spark, d):
    n = table(spark, d, "nation")
    names = [r[0] for r in n.where("n_nationkey IN (1, 2)").select("n_name").collect()]
    rows = n.groupBy(F.col("n_regionkey").alias("id")).agg(F.create_map(F.lit("ORGANIZATION"), F.collect_list("n_name")).alias("m"))
    return rows.select("id", J.contains_any(F.col("m"), "ORGANIZATION", names).alias("found"))


@query("""WITH n AS (SELECT r_regionkey AS id, list_slice(list_sort(list('NATION:' || n_name)), 1, r_regionkey) AS pairs FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey)
SELECT id, CASE WHEN len(pairs) = 0 THEN 'no entities' WHEN id % 2 = 1 AND len(pairs) = 1 THEN 'connections need two entities' ELSE 'ok' END AS status, array_to_string(pairs[1:2], ',') AS used, len(pairs) > 2 AS warned FROM n""")
def entity_validate(spark, d):
    """A region's first nations, as many as its key, as the entities of a question."""
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    rows = n.select("id", F.when(F.col("id") % 2 == 1, "Connections").otherwise("Inquiry").alias("kind"), F.to_json(F.create_map(F.lit("NATION"), F.expr("slice(names, 1, id)"))).alias("entities"))
    return J.validated(rows).select("id", "status", "used", "warned")


VERDICT = {"isPolitical": "boolean", "isOffensive": "boolean"}


@query("SELECT doc_id, quality = 1 AS political, toxic = 1 AS offensive, toxic <> 1 AS strict_ok FROM labels")
def typed_verdict(spark, d):
    """Labels as JSON verdicts; toxic rows carry a key more, which strict mode refuses."""
    j = F.to_json(F.struct((F.col("quality") == 1).alias("isPolitical"), (F.col("toxic") == 1).alias("isOffensive"), F.when(F.col("toxic") == 1, "x").alias("extra")))
    rows = table(spark, d, "labels").withColumn("j", j)
    return rows.select("doc_id", J.typed_verdict(F.col("j"), VERDICT).isPolitical.alias("political"), J.typed_verdict(F.col("j"), VERDICT).isOffensive.alias("offensive"), J.typed_verdict(F.col("j"), VERDICT, strict=True).isNotNull().alias("strict_ok"))


LISTS = {"positive": ("good", "great", "the", "and"), "negative": ("bad", "worse", "der", "que")}
W = r"list_filter(regexp_split_to_array(lower(text), '[ \n\t\r]+'), lambda x: x <> '')"
POL = f"len(list_filter({W}, lambda x: x IN ('good', 'great', 'the', 'and'))) - len(list_filter({W}, lambda x: x IN ('bad', 'worse', 'der', 'que')))"


@query(f"SELECT doc_id, CASE WHEN p > 0 THEN 'positive' WHEN p < 0 THEN 'negative' ELSE 'neutral' END AS sentiment FROM (SELECT doc_id, {POL} AS p FROM documents)")
def classify_sentiment(spark, d):
    return table(spark, d, "documents").select("doc_id", M.sentiment(F.col("text"), **LISTS).alias("sentiment"))


@query(r"""SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(text, '[a-z0-9._]+@[a-z0-9.]+')).list_sort(), ',') AS emails, CAST(len(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS INTEGER) AS numbers FROM documents""")
def extract_entities(spark, d):
    rules = {"EMAIL": r"[a-z0-9._]+@[a-z0-9.]+", "NUMBER": r"[0-9]+"}
    rows = table(spark, d, "documents").withColumn("e", M.entities(F.col("text"), rules))
    none = F.array().cast("array<string>")
    return rows.select("doc_id", F.array_join(F.array_sort(F.coalesce(F.col("e")["EMAIL"], none)), ",").alias("emails"), F.size(F.coalesce(F.col("e")["NUMBER"], none)).alias("numbers"))


#: A sentence with an entity of each of the nine types.
_NOTE = ("On 2024-05-17 Mr. Ann Lee, Chairman of Blue River Bank, went from ", " to Hill Airport and bought ", " shares of NYSE: BRB for $", ".")


@query(f"""SELECT s_suppkey AS id, '{{"ORGANIZATION":["Blue River Bank"],"DATE":["2024-05-17"],"PERSON":["Ann Lee"],"FACILITY":["Hill Airport"],"PERSON_TITLE":["Chairman"],"LOCATION":["' || upper(n_name[1:1]) || lower(n_name[2:]) || '"],"MONETARY_VALUE":["$' || s_suppkey || '"],"STOCK_CODE":["NYSE:BRB"],"QUANTITY":["' || (s_suppkey + 1) || ' shares"]}}' AS entities
FROM supplier JOIN (SELECT n_nationkey, regexp_replace(n_name, '[^A-Za-z]', '', 'g') AS n_name FROM nation) ON n_nationkey = s_nationkey""")
def entity_types(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    say = lambda c: c.cast("string")
    text = F.concat(F.lit(_NOTE[0]), F.initcap(F.regexp_replace("n_name", "[^A-Za-z]", "")), F.lit(_NOTE[1]), say(F.col("s_suppkey") + 1), F.lit(_NOTE[2]), say(F.col("s_suppkey")), F.lit(_NOTE[3]))
    return rows.select(F.col("s_suppkey").alias("id"), F.to_json(M.entities(text)).alias("entities"))


@query("""SELECT s_suppkey AS id, '{"questionType":"' || CASE s_suppkey % 3 WHEN 0 THEN 'Connections' WHEN 1 THEN 'Inquiry' ELSE 'Unknown' END || '","entities":{"ORGANIZATION":["Blue Bank"' || CASE WHEN s_suppkey % 3 = 0 THEN ',"Red Corp"' ELSE '' END || '],"QUANTITY":["' || s_suppkey || ' shares"]}}' AS metadata FROM supplier""")
def question_entities(spark, d):
    third, n = F.col("s_suppkey") % 3, F.col("s_suppkey").cast("string")
    text = F.when(third == 0, F.concat(F.lit("What links Blue Bank and Red Corp, between "), n, F.lit(" shares and none?"))).when(third == 1, F.concat(F.lit("Tell me of Blue Bank and its "), n, F.lit(" shares"))).otherwise(F.concat(F.lit("Blue Bank "), n, F.lit(" shares")))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), M.question_metadata(text).alias("metadata"))


@query(r"""WITH w AS (SELECT item_id, text, list_filter(list_transform(regexp_split_to_array(lower(text), '[ \n\t\r]+'), lambda x: regexp_replace(x, '[^\p{L}]', '', 'g')), lambda x: length(x) >= 4) AS ws FROM benchmark),
f AS (SELECT item_id, unnest(ws) AS x, unnest(range(len(ws))) AS pos FROM w), g AS (SELECT item_id, x, count(*) AS n, min(pos) AS pos FROM f GROUP BY ALL),
t AS (SELECT item_id, x, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, pos) AS r FROM g)
SELECT w.item_id, '{"sentiment":"' || CASE WHEN p > 0 THEN 'positive' WHEN p < 0 THEN 'negative' ELSE 'neutral' END || '","subject":"' || coalesce(t.x, '') || '"}' AS verdict
FROM (SELECT item_id, """ + POL + """ AS p FROM benchmark) w LEFT JOIN t ON t.item_id = w.item_id AND t.r = 1""")
def sentiment_subject(spark, d):
    return table(spark, d, "benchmark").select("item_id", M.sentiment_json(F.col("text"), **LISTS).alias("verdict"))


@query(r"""SELECT item_id, CASE WHEN contains(lower(text), 'between') OR contains(lower(text), 'connect') THEN 'Connections' WHEN lower(text) LIKE '%?' OR regexp_matches(lower(text), '^(what|who|where|when|how|tell)') THEN 'Inquiry' ELSE 'Unknown' END AS question_type FROM benchmark""")
def question_type(spark, d):
    return table(spark, d, "benchmark").select("item_id", M.question_type(F.col("text")).alias("question_type"))
