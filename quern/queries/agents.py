"""Routers, agents and memory."""

from pyspark.sql import functions as F

from ..functions import models as M
from ..operators.routing import listing, routed
from ..plans.tasks import crew, plan
from ..streaming.memory import monitored, with_history
from . import query, table
from .structured import LISTS, POL

REGISTRY = [("positive", "for kind words", "Thank you: {input}"), ("negative", "for unkind words", "Sorry: {input}")]


def registry(spark):
    return spark.createDataFrame(REGISTRY, "name string, description string, prompt_template string")


@query(f"SELECT doc_id, CASE WHEN p > 0 THEN 'positive' WHEN p < 0 THEN 'negative' ELSE 'DEFAULT' END AS destination, CASE WHEN p > 0 THEN 'Thank you: {{input}}' WHEN p < 0 THEN 'Sorry: {{input}}' END AS prompt_template FROM (SELECT doc_id, {POL} AS p FROM documents)")
def router_lookup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return routed(docs, M.sentiment(F.col("text"), **LISTS), registry(spark), "DEFAULT").select("doc_id", "destination", "prompt_template")


@query(f"SELECT doc_id, CASE WHEN p > 0 THEN 'Thank you' WHEN p < 0 THEN 'Sorry' ELSE 'Go on' END || ': ' || doc_id AS answer FROM (SELECT doc_id, {POL} AS p FROM documents)")
def classify_route(spark, d):
    s = F.col("s")
    reply = F.when(s == "positive", "Thank you").when(s == "negative", "Sorry").otherwise("Go on")
    return table(spark, d, "documents").select("doc_id", M.sentiment(F.col("text"), **LISTS).alias("s")).select("doc_id", F.concat_ws(": ", reply, F.col("doc_id").cast("string")).alias("answer"))


@query("SELECT 'negative: for unkind words' || chr(10) || 'positive: for kind words' AS destinations")
def destinations_listing(spark, d):
    return listing(registry(spark))


@query("SELECT conv_id, turn, coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM conversations")
def conversation_memory(spark, d):
    return with_history(table(spark, d, "conversations")).select("conv_id", "turn", "history")


AGENTS = [{"role": "analyst", "goal": "watch prices"}, {"role": "trader", "goal": "plan trades"}]
TASKS = [{"agent": "analyst", "description": "Watch {stock}.", "expected_output": "Notes"}, {"agent": "trader", "description": "Plan for {stock} at {risk} risk.", "expected_output": "A plan"}]


@query("SELECT * FROM (VALUES (0, 'analyst', 'watch prices', 'Watch ABC.' || chr(10) || 'Expected: Notes'), (1, 'trader', 'plan trades', 'Plan for ABC at low risk.' || chr(10) || 'Expected: A plan')) v(ord, role, goal, prompt)")
def task_agent_plan(spark, d):
    return plan(spark, AGENTS, TASKS, {"stock": "ABC", "risk": "low", "capital": "100"}).orderBy("ord")


#: Five destinations, each with a word by which a rule stands in for the routing model.
EXPERTS = [
    ("programmer", "for code and algorithms", "As a programmer, with examples: {input}", " code "),
    ("poet", "for verse", "In verse: {input}", " que "),
    ("encyclopaedist", "for general knowledge", "What is known: {input}", " the "),
    ("illustrator", "for pictures", "Draw: {input}", " los "),
    ("lawyer", "for questions of law", "Under the law: {input}", " der "),
]
_CASES = " ".join(f"WHEN contains(lower(text), '{w}') THEN '{n}'" for n, _, _, w in EXPERTS)
_PROMPTS = " ".join(f"WHEN '{n}' THEN '{t.removesuffix('{input}')}' || text" for n, _, t, _ in EXPERTS)


@query(f"""WITH h AS (SELECT conv_id, turn, text, role, coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM conversations),
r AS (SELECT *, CASE {_CASES} ELSE 'conversation' END AS destination FROM h)
SELECT conv_id, turn, destination, CASE destination {_PROMPTS} ELSE history || CASE WHEN history = '' THEN '' ELSE chr(10) END || role || ': ' || text END AS prompt FROM r""")
def router_with_memory(spark, d):
    """Five destinations and a default that talks on with the conversation's memory."""
    rows = with_history(table(spark, d, "conversations"))
    low, name = F.lower("text"), F
    for n, _, _, word in EXPERTS:
        name = name.when(low.contains(word), n)
    known = spark.createDataFrame([e[:3] for e in EXPERTS], "name string, description string, prompt_template string")
    rows = routed(rows, name.otherwise(None), known, "conversation")
    talk = F.concat_ws("\n", F.when(F.col("history") != "", F.col("history")), F.concat_ws(": ", "role", "text"))
    return rows.select("conv_id", "turn", "destination", F.coalesce(F.replace("prompt_template", F.lit("{input}"), F.col("text")), talk).alias("prompt"))


CREW = [
    {"role": "analyst", "goal": "watch the market", "backstory": "Knows statistics."}, {"role": "strategist", "goal": "build strategies", "backstory": "Knows markets."},
    {"role": "trader", "goal": "plan trades", "backstory": "Knows timing."}, {"role": "risk advisor", "goal": "weigh risks", "backstory": "Knows risk."},
]
WORK = [
    {"agent": "analyst", "description": "Watch {stock}.", "expected_output": "signals for {stock}"}, {"agent": "strategist", "description": "Find strategies for {stock} at {risk} risk, by {preference}.", "expected_output": "strategies for {stock}"},
    {"agent": "trader", "description": "Say when to trade {stock}.", "expected_output": "a plan for {stock}"}, {"agent": "risk advisor", "description": "Say what may go wrong with {stock}.", "expected_output": "a report on {stock}"},
]


@query("""WITH o AS (SELECT s_suppkey AS id, s_name AS n, 'Expected: signals for ' || s_name AS o0 FROM supplier),
p AS (SELECT *, 'analyst said: ' || o0 AS o1, 'strategist said: analyst said: ' || o0 AS o2, 'trader said: strategist said: analyst said: ' || o0 AS o3 FROM o)
SELECT id, 0 AS ord, 'analyst' AS role, 'analyst: watch the market Knows statistics.' || chr(10) || 'Watch ' || n || '.' || chr(10) || o0 AS prompt, o0 AS output FROM p
UNION ALL SELECT id, 1, 'strategist', 'strategist: build strategies Knows markets.' || chr(10) || 'Find strategies for ' || n || ' at Medium risk, by day trading.' || chr(10) || 'Expected: strategies for ' || n || chr(10) || o1, o1 FROM p
UNION ALL SELECT id, 2, 'trader', 'trader: plan trades Knows timing.' || chr(10) || 'Say when to trade ' || n || '.' || chr(10) || 'Expected: a plan for ' || n || chr(10) || o1 || chr(10) || o2, o2 FROM p
UNION ALL SELECT id, 3, 'risk advisor', 'risk advisor: weigh risks Knows risk.' || chr(10) || 'Say what may go wrong with ' || n || '.' || chr(10) || 'Expected: a report on ' || n || chr(10) || o1 || chr(10) || o2 || chr(10) || o3, o3 FROM p""")
def crew_run(spark, d):
    """Four agents with a task each, for every supplier's stock; outputs are handed over, and a manager looks over each."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    values = {"stock": F.col("s_name"), "risk": "Medium", "preference": "day trading", "capital": "100000"}
    done = crew(rows, CREW, WORK, values, M.RuleModel(), manager=M.RuleModel())
    # The array is never empty, and the outer form infers no filter on it, which would nest all models in one expression.
    return done.select("id", F.explode_outer("outputs").alias("o")).select("id", "o.*")


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def monitor_windows(spark, d):
    return monitored(table(spark, d, "events")).withColumn("start", F.unix_timestamp("start"))
