"""Registry states, log analytics, sessions and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ingest, papers
from ..registry import query
from ..session import read_table, shared_folder
from ..sources import readers, sinks
from ..streaming import events as S
from ..streaming import ingestion, stages


def _events(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("registry_latest", """select c_custkey paper_id, case o_orderstatus when 'F' then 'ready' when 'O' then 'processing' when 'P' then 'failed' else 'new' end status,
case when o_orderstatus = 'F' then o_orderkey end completed_at, case when o_orderstatus = 'P' then o_orderpriority end error
from customer left join (select * from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) n from orders) where n = 1) o on o_custkey = c_custkey""")
def registry_latest(spark, sf_dir):
    records = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"), F.lit("new").alias("status"), F.lit(None).cast("long").alias("completed_at"), F.lit(None).cast("string").alias("error"))
    state = F.col("o_orderstatus")
    status = F.when(state == "F", "ready").when(state == "O", "processing").otherwise("failed")
    updates = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("at"), status.alias("status"), F.when(state == "P", F.col("o_orderpriority")).alias("error"))
    return sinks.registry_state(records, updates)


@query("log_summary", """select ts::date as day, count(*) n, count(*) filter (where value >= 50) passed, round(avg(value), 4) mean_value, round(median(value), 4) median_value from events group by 1""")
def log_summary(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events")
    return rows.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 50).alias("passed"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.median("value"), 4).alias("median_value"))


@query("provider_counts", """select provider, count(*) n from (select unnest([event_type, case when value > 50 then 'large' else 'small' end]) provider from events) group by 1""")
def provider_counts(spark, sf_dir):
    providers = F.array("event_type", F.when(F.col("value") > 50, "large").otherwise("small"))
    return read_table(spark, sf_dir, "events").select(F.explode(providers).alias("provider")).groupBy("provider").agg(F.count("*").alias("n"))


@query("running_history", """select conv_id, turn, array_to_string(list(length(text)) over (partition by conv_id order by turn rows unbounded preceding), ',') history,
count(*) over (partition by conv_id) as total, max(case when role = 'user' then turn end) over (partition by conv_id) last_user from conversations""")
def running_history(spark, sf_dir):
    w, whole = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("conv_id")
    rows = read_table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.array_join(F.collect_list(F.length("text").cast("string")).over(w), ",").alias("history"), F.count("*").over(whole).alias("total"), F.max(F.when(F.col("role") == "user", F.col("turn"))).over(whole).alias("last_user"))


@query("sparkline", """select conv_id, turn, round(case when n > 1 then (k - 1) / (n - 1)::double * 120 else 0 end, 4) x, greatest(0, least(30, 30 - length(text) // 100)) y
from (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) k, count(*) over (partition by conv_id) n from conversations)""")
def sparkline(spark, sf_dir):
    k, n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")), F.count("*").over(Window.partitionBy("conv_id"))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", k.alias("k"), n.alias("n"))
    return rows.select("conv_id", "turn", F.round(F.coalesce(F.try_divide(F.col("k") - 1, F.col("n") - 1) * 120, F.lit(0.0)), 4).alias("x"), F.greatest(F.lit(0), F.least(F.lit(30), 30 - F.floor(F.length("text") / 100))).cast("long").alias("y"))


@query("props_json", """select event_type, count(*) n, sum((props->>'$.k')::bigint)::bigint total_k from events group by 1""")
def props_json(spark, sf_dir):
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k bigint")["k"]).alias("total_k"))


@query("sse_frames", """select event_id, event_type as event, (props->>'$.k')::bigint k from events""")
def sse_frames(spark, sf_dir):
    """Each event as a frame followed by one without JSON, written and read back."""
    rows = read_table(spark, sf_dir, "events")
    body = F.concat(readers.sse_encode(F.col("event_type"), F.from_json("props", "k bigint")), F.lit("event: bad\ndata: {x\n\nevent: cut"))
    frames = rows.select("event_id", F.explode(readers.sse_frames(body)).alias("f"))
    return frames.select("event_id", "f.event", F.from_json("f.data", "k bigint")["k"].alias("k"))


TUMBLING = "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2"


@query("tumbling_windows", TUMBLING)
def tumbling_windows(spark, sf_dir):
    return S.tumbling(_events(spark, sf_dir))


@query("sliding_windows", """select b - interval (i) hour as start, event_type, count(*) n from (select time_bucket(interval '1 hour', ts) b, event_type, unnest([0, 1]) i from events) group by 1, 2""")
def sliding_windows(spark, sf_dir):
    return S.sliding(_events(spark, sf_dir))


@query("stage_sessions", """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end f from events),
s as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) k from g) select min(ts) as start, user_id, count(*) n from s group by user_id, k""")
def stage_sessions(spark, sf_dir):
    return S.sessions(_events(spark, sf_dir))


@query("last_stage", "select user_id, arg_max(event_type, event_id) last_type, count(distinct event_type) stages from events group by 1")
def last_stage(spark, sf_dir):
    return read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.countDistinct("event_type").alias("stages"))


@query("stream_tumbling", TUMBLING)
def stream_tumbling(spark, sf_dir):
    """The windows from a stream over the event file, drained into a table: the rows of the batch form."""
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = read_table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = S.tumbling(source.withColumn("ts", F.col("ts").cast("timestamp")))
    write = lambda rows, _: rows.write.mode("overwrite").parquet(f"{out}/rows")
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("landed_papers", """with w as (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') w from documents),
c as (select doc_id, count(distinct md5(array_to_string(list_slice(w, s + 1, s + 512), ' '))) n from (select doc_id, w, unnest(range(0, len(w), 412)) s from w) group by 1)
select doc_id, case when n is null then 'failed' else 'ready' end status, case when n is null then 'no text' end as error, coalesce(n, 0) n_chunks from documents left join c using (doc_id)""")
def landed_papers(spark, sf_dir):
    """Documents land as papers of a stream, are ingested batch by batch, and show how they fared."""
    out = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.write.option("maxRecordsPerFile", 5000).parquet(f"{out}/in")
    landed = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 8).parquet(f"{out}/in")
    held = papers.Collection(spark, f"{out}/papers", "doc_id")

    def read(rows):
        sections = rows.select(F.col("doc_id").alias("paper_id"), F.lit(1).alias("section_no"), F.lit("text").alias("heading"), F.lit("body").alias("type"), F.lit(1).alias("page_num"), F.col("text").alias("body"))
        chunks = ingest.ingest(sections, None, embed=lambda t: F.array(F.length(t).cast("float"))).withColumnRenamed("paper_id", "doc_id")
        return chunks, rows.limit(0).select("doc_id", F.lit("").alias("error"))

    ingestion.run(landed, held, read, f"{out}/state").awaitTermination()
    return held.papers().select("doc_id", "status", "error", "n_chunks")


@query("stage_order", """with e as (select user_id::varchar req_id, epoch_ms(ts) ms, case event_type when 'signup' then 0 when 'view' then 2 when 'click' then 4 when 'purchase' then 7 else 8 end as i, ts from events),
w as (select *, max(i) over before as so_far, count(*) filter (where i >= 7) over before as ends from e window before as (partition by req_id order by ms, i rows between unbounded preceding and 1 preceding)),
v as (select req_id, i, case when ends > 0 then 'after_end' when so_far is null or i > so_far then 'accepted' when i = so_far then 'repeated' else 'out_of_order' end verdict from w)
select req_id, case i when 0 then 'planning' when 2 then 'retrieving' when 4 then 'drafting' when 7 then 'done' else 'error' end as stage, verdict, count(*) n from v group by all""")
def stage_order(spark, sf_dir):
    """Events as stages of requests, judged in their order by a stream's state machine."""
    out = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "planning", "view", "retrieving", "click", "drafting", "purchase", "done", "error", "error")])
    said = read_table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("req_id"), F.col("ts").cast("timestamp").alias("at"), kinds[F.col("event_type")].alias("stage"))
    # a request of a later day ends the table, so that the watermark passes all others
    last = said.agg(F.max("at").alias("at")).select(F.lit(None).cast("string").alias("req_id"), (F.col("at") + F.expr("interval 1 day")).alias("at"), F.lit("planning").alias("stage"))
    said.unionByName(last).write.parquet(f"{out}/in")
    landed = spark.readStream.schema(said.schema).parquet(f"{out}/in")
    judged = stages.ordered(landed, late="1 hour", timeout=10**9).where("req_id is not null")
    judged.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stages.OUT).parquet(f"{out}/rows").groupBy("req_id", "stage", "verdict").agg(F.count("*").alias("n"))
