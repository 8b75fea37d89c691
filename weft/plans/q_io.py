"""Catalog entries: readers, converters, appends and routing, each over a
whole given table. What they write lies in a fresh folder under the shared
checkpoint folder and is read back."""

import uuid

from pyspark.sql import functions as F

from weft.functions import scalar as sc
from weft.operators import agents as ag
from weft.operators import corpus as cp
from weft.operators import metrics as mt
from weft.operators import reports as rp
from weft.operators import resources as rsc
from weft.plans.catalog import query, with_ctes
from weft.plans.q_agents import REGLOG_SQL, registration_log
from weft.session import scratch_path
from weft.sources.appendlog import read_appends
from weft.sources.tabular import convert_format, read_tabular
from weft.streaming import queries as sq
from weft.streaming.sources import run_observers


def _folder(m, name: str) -> str:
    return scratch_path(m.spark, f"io/{name}-{uuid.uuid4().hex[:12]}")


@query("read_corpus", """
SELECT CASE source WHEN 'src0' THEN 'Python' WHEN 'src1' THEN 'Go' END AS language,
       CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines,
       CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes
FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def q_read_corpus(m):
    """The documents written as text files and read as a corpus of
    whole files. Part files carry no extension of their own, so the label
    comes from the folder's name."""
    folder = _folder(m, "corpus")
    name = F.when(F.col("source") == "src0", "a.py").when(F.col("source") == "src1", "b.go").otherwise("c.unknown")
    m.raw("documents").where("text is not null").select("text", name.alias("kind")).write.partitionBy("kind").option("maxRecordsPerFile", 500).text(folder)
    files = cp.read_corpus(m.spark, folder, recursive=True)
    kind = F.regexp_extract("path", r"kind=([^/]+)/", 1)
    newlines = F.octet_length("content") - F.octet_length(F.replace("content", F.lit("\n"), F.lit("")))
    return files.groupBy(sc.language_of(kind).alias("language")).agg(
        F.sum(newlines).cast("bigint").alias("lines"), F.sum("size").cast("bigint").alias("bytes"))


@query("convert_format", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def q_convert(m):
    """Orders through csv, json and orc, read with an explicit schema."""
    rows = m.raw("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    base = _folder(m, "convert")
    rows.write.parquet(f"{base}/parquet")
    kinds = ["parquet", "csv", "json", "orc"]
    for a, b in zip(kinds, kinds[1:]):
        convert_format(m.spark, a, f"{base}/{a}", b, f"{base}/{b}", schema=rows.schema)
    return read_tabular(m.spark, "orc", f"{base}/orc", rows.schema)


@query("append_history", with_ctes(["ev"], """
SELECT seq, event_type, CAST(ts AS DATE) AS date, n AS times FROM (
  SELECT seq, event_type, ts, CASE WHEN event_type = 'task_failed' THEN 2 ELSE 1 END AS n FROM ev)"""))
def q_append_history(m):
    """All events appended, then the failures once more, by date; each
    batch tried twice under its token."""
    path = _folder(m, "history")
    e = m.events().select("seq", "event_type", "ts")
    for _ in range(2):
        rp.append_history(e, path, token="all")
        rp.append_history(e.where("event_type = 'task_failed'"), path, token="failed")
    back = read_appends(m.spark, path, e.withColumn("date", F.to_date("ts")).schema)
    return back.groupBy("seq", "event_type", "date").agg(F.count(F.lit(1)).cast("int").alias("times"))


@query("append_memory", "SELECT conv_id, turn, text AS content, role AS type FROM conversations")
def q_append_memory(m):
    """The episodes of each role appended one after the other, one batch tried twice."""
    path = _folder(m, "memory")
    episodes = rp.memory_episodes(m.raw("conversations"))
    for kind in ("user", "assistant", "system", "user"):
        rp.append_memory(rp.episodes_of_type(episodes, kind), path, token=kind)
    back = read_appends(m.spark, path, episodes.withColumn("type", F.lit("")).schema)
    return back.select("conv_id", "turn", "content", "type")


@query("append_samples", with_ctes(["sm"], """
SELECT metric, count(*) AS samples, max(seq) AS last_seq FROM sm GROUP BY metric"""))
def q_append_samples(m):
    """The samples appended in two halves, by metric."""
    path = _folder(m, "samples")
    s = m.system_metrics()
    for half in (0, 1):
        mt.append_samples(s.where(F.col("seq") % 2 == half), path, token=f"half-{half}")
    return read_appends(m.spark, path, s.schema).groupBy("metric").agg(F.count(F.lit(1)).alias("samples"), F.max("seq").alias("last_seq"))


@query("registration_events", with_ctes([], """
SELECT seq, 'agent_state_changed' AS event_type, agent_id AS source_agent, 'registered' AS new_state
FROM reglog""", [REGLOG_SQL]).replace("WITH ,", "WITH "))
def q_registration_events(m):
    """The event each registration emits."""
    return ag.registration_events(registration_log(m))


@query("register_resources", """
SELECT ps AS resource_id, arg_max(size, l) AS max_concurrent
FROM (SELECT p_partkey % 97 AS ps, p_partkey AS l, p_size AS size FROM part) GROUP BY ps""")
def q_register_resources(m):
    """S11 for resources: part sizes registered again and again under 97 ids."""
    log = m.raw("part").select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 97).alias("resource_id"),
                               F.col("p_size").alias("max_concurrent"))
    return rsc.register_resources(log)


@query("display_labels", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'C++' WHEN 2 THEN 'Rust' END AS language,
       printf('%.1f', n_chars / CAST(4 AS DOUBLE)) AS shown FROM documents""")
def q_display_labels(m):
    """F15, F16 on every document (a path made of its id)."""
    ext = F.element_at(F.array(*[F.lit(x) for x in ("py", "HPP", "rs", "txt")]), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat_ws("", F.lit("src/f"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return m.raw("documents").select("doc_id", sc.language_of(path).alias("language"),
                                     sc.fixed1(F.col("n_chars") / F.lit(4.0)).alias("shown"))


@query("routed_handlers", with_ctes(["ev"], """
SELECT event_type, count(*) AS n FROM ev WHERE event_type IN ('task_completed', 'task_assigned') GROUP BY event_type"""))
def q_routed_handlers(m):
    """A stream routed to handlers by event type; the handler of failures
    always fails, and the others' rows are all there."""
    from weft.plans.q_streaming import _events

    def keep(name):
        return lambda b, i, f: b.select("event_type").write.mode("overwrite").parquet(f"{f}/{name}/batch_id={i}")

    def broken(b, i, f):
        raise RuntimeError("handler failure")

    def route(batch, batch_id, folder):
        bound = {k: (lambda fn: lambda b, i: fn(b, i, folder))(fn) for k, fn in
                 {"task_failed": broken, "task_completed": keep("done"), "task_assigned": keep("given")}.items()}
        sq.by_event_type(bound)(batch, batch_id)

    base = run_observers(_events(m), {"routed": route}, "routed")
    out = m.spark.read.option("recursiveFileLookup", "true").schema("event_type string").parquet(f"{base}/routed")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
