"""Queries of the indexing pipeline and the user functions."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from orrery.functions.exprs import metadata_rows
from orrery.operators import stats as S
from orrery.sources import fixtures as X
from orrery.sources.keyed import Files
from orrery.sources.tables import shared_dir
from orrery.streaming import contracts as C
from orrery.streaming import jobs as J
from orrery.streaming import progress as P

from .base import query
from .statistics import _ST, plugins, statuses

CH = X.CHANGES


#: For stateful queries: the state store that they need, and no batches without rows, so that timers don't keep a finished query going.
_STATE = {"spark.sql.streaming.stateStore.providerClass": J.ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.shuffle.partitions": "8"}


def _stateful(spark, stream, mode="append"):
    """Run a stateful query over what there is and read its rows."""
    path = f"{shared_dir(spark)}/rows-{J.uuid.uuid4().hex}"
    old = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        J.run_available(stream, each=lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"), mode=mode)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{path}/batch=*")


@query(f"WITH {CH} SELECT seq, uri, event FROM changes")
def s03_change_stream(spark, d):
    s = X.change_stream(spark, d).select("seq", "uri", "event")
    return spark.read.schema(s.schema).parquet(J.run_available(s))


@query(f"WITH {CH}, l AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY seq DESC) AS r FROM changes) SELECT uri, seq, hash_value FROM l WHERE r = 1 AND event <> 'delete'")
def s04_change_consumer(spark, d):
    """A consumer that upserts batches by key; delivering the last batch twice changes nothing."""
    t = J.KeyedTable(spark, "uri string, seq long, hash_value string", "uri", "seq")

    def each(df, n):
        t.merge(df)
        t.merge(df)

    J.run_available(X.change_stream(spark, d).select("uri", "seq", "hash_value", "event"), each=each)
    return t.read()


@query(f"WITH {CH}, l AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY seq DESC) AS r FROM changes) SELECT uri, seq, hash_value FROM l WHERE r = 1 AND event <> 'delete'")
def s04_durable_consumer(spark, d):
    """Two consumers one after the other over the same table and checkpoint, each with an object of its own; then fewer files and no old versions."""
    path = f"{shared_dir(spark)}/consumer-{uuid.uuid4().hex}"
    table = lambda: J.KeyedTable(spark, "uri string, seq long, hash_value string", "uri", "seq", parts=8, path=f"{path}/table")
    stream = lambda: X.change_stream(spark, d).select("uri", "seq", "hash_value", "event")
    J.consume(stream(), table(), f"{path}/checkpoint")
    J.consume(stream(), table(), f"{path}/checkpoint")
    last = table()
    last.compact(parts=4)
    last.vacuum(keep=1, older_ms=0)
    return table().read()


_Z1 = f"WITH {CH}, n AS (SELECT *, CASE WHEN event = 'delete' THEN NULL ELSE hash_value END AS now FROM changes), o AS (SELECT *, lag(now) OVER (PARTITION BY uri ORDER BY seq) AS old FROM n) SELECT uri, seq, CASE WHEN event = 'delete' THEN 'delete' ELSE 'upsert' END AS action, coalesce(now, old) AS hash_value FROM o WHERE now IS DISTINCT FROM old"


@query(_Z1)
def z01_changed_only(spark, d):
    return J.changed_only_batch(X.changes(spark, d))


@query(_Z1)
def z01_changed_only_stream(spark, d):
    return _stateful(spark, J.changed_only(X.change_stream(spark, d)))


@query(f"WITH {CH} SELECT seq, CASE WHEN event_type = 'view' THEN 'none' WHEN event = 'delete' THEN 'delete' ELSE 'upsert' END AS target, CASE source WHEN 'subscription' THEN 'priority' ELSE 'normal' END AS priority FROM changes")
def z02_route(spark, d):
    """Z2 and Z5."""
    c = X.changes(spark, d).withColumn("event", F.when(F.col("event_type") == "view", "acl_change").otherwise(F.col("event")))
    return J.with_priority(J.route(c)).select("seq", "target", "priority")


def _files(spark, d):
    return X.changes(spark, d).withColumn("uri", F.concat("uri", F.element_at(F.array(F.lit(".usd"), F.lit(".png"), F.lit(".mdl")), (F.col("seq") % 3 + 1).cast("int"))))


_JOBS = f"{CH}, f AS (SELECT *, ['usd', 'png', 'mdl'][(seq % 3 + 1)::INT] AS ext, uri || '.' || ['usd', 'png', 'mdl'][(seq % 3 + 1)::INT] AS file FROM changes), pl(plugin, ext, active) AS (VALUES ('click', 'usd', true), ('view', 'usd', true), ('purchase', 'png', true), ('thumb', 'png', true)), jobs AS (SELECT seq, plugin, file AS uri, hash_value FROM f JOIN pl USING (ext) WHERE event <> 'delete')"


@query(f"WITH {_JOBS}, done AS (SELECT * FROM jobs WHERE seq % 4 = 0) SELECT seq, plugin, uri, hash_value FROM jobs WHERE (plugin, uri, hash_value) NOT IN (SELECT (plugin, uri, hash_value) FROM done)")
def z03_fan_out(spark, d):
    f = _files(spark, d)
    done = J.fan_out(f.filter("seq % 4 = 0"), plugins(spark))
    return J.fan_out(f, plugins(spark), done).select("seq", "plugin", "uri", "hash_value")


_CUR = "cur AS (SELECT file AS uri, arg_max(hash_value, seq) AS hash_value FROM f GROUP BY 1), res AS (SELECT DISTINCT plugin, uri, hash_value FROM jobs WHERE seq % 2 = 0), v AS (SELECT plugin, hash_value, min(uri) AS src FROM res JOIN cur USING (uri, hash_value) GROUP BY 1, 2)"


@query(f"WITH {_JOBS}, {_CUR} SELECT seq, j.plugin, src, j.uri FROM jobs j JOIN v USING (plugin, hash_value) WHERE seq % 2 = 1 AND src <> j.uri")
def z04_reuse_by_content(spark, d):
    f = _files(spark, d)
    jobs = J.fan_out(f, plugins(spark)).select("seq", "plugin", "uri", "hash_value")
    current = J.latest(f.select("uri", "hash_value", "seq"), ["uri"], F.col("seq")).select("uri", "hash_value")
    todo = jobs.filter("seq % 2 = 1")
    copies, rest = J.reuse_by_content(todo, jobs.filter("seq % 2 = 0").select("plugin", "uri", "hash_value").distinct(), current)
    return todo.join(rest.select("seq", "plugin"), ["seq", "plugin"], "left_anti").join(copies.distinct(), ["plugin", "uri", "hash_value"]).select("seq", "plugin", "src", "uri")


@query(f"WITH {_JOBS}, {_CUR} SELECT plugin, uri, hash_value FROM res WHERE (uri, hash_value) NOT IN (SELECT (uri, hash_value) FROM cur)")
def z04_stale(spark, d):
    f = _files(spark, d)
    current = J.latest(f.select("uri", "hash_value", "seq"), ["uri"], F.col("seq")).select("uri", "hash_value")
    return J.stale_results(J.fan_out(f, plugins(spark)).filter("seq % 2 = 0").select("plugin", "uri", "hash_value").distinct(), current)


@query(f"WITH {CH}, c AS (SELECT 'all' AS consumer, seq, event <> 'delete' AS done FROM changes UNION ALL SELECT 'even', seq, true FROM changes WHERE seq % 2 = 0), t AS (SELECT count(*) AS total, max(seq) AS newest FROM changes) SELECT consumer, count(*) AS read, count(*) FILTER (done) AS processed, any_value(total) - count(*) AS lag, round(100.0 * count(*) FILTER (done) / any_value(total), 6) AS percent, max(seq) AS last_seq, any_value(newest) - max(seq) AS behind FROM c, t GROUP BY 1")
def a15_live_progress(spark, d):
    """Two consumers of the log as they tell of themselves while they run; one reads every other change."""
    path = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    log, stream = P.ProgressLog(spark, f"{path}/progress"), X.change_stream(spark, d)
    spark.streams.addListener(log)
    try:
        P.run_tracked(stream, "all", log, f"{path}/all", done=F.col("event") != "delete")
        P.run_tracked(stream.filter("seq % 2 = 0"), "even", log, f"{path}/even")
    finally:
        spark.streams.removeListener(log)
    return P.live_progress(X.changes(spark, d), log.rows()).drop("batches", "at").withColumn("percent", F.round("percent", 6))


@query("WITH e AS (SELECT DISTINCT ['usd', 'usda', 'png', 'jpg', 'mdl'][(doc_id % 5 + 1)::INT] AS ext FROM documents) SELECT 1 AS step, ext, 'create' AS event FROM e UNION ALL SELECT 2, ext, 'delete' FROM e WHERE ext IN ('png', 'jpg') UNION ALL SELECT 2, ext, 'create' FROM e WHERE ext = 'jpg'")
def s03_listing_stream(spark, d):
    """A folder of the assets' files by format, listed as a stream; then one format goes and another is written anew, and a second run tells what changed."""
    from orrery.sources.listing import listing_stream

    path = f"{shared_dir(spark)}/folder-{uuid.uuid4().hex}"
    assets = X.assets(spark, d).select("base_key", "size", "ext")
    assets.write.partitionBy("ext").parquet(f"{path}/files")
    rows = f"{path}/rows"

    def listed(step):
        stream = listing_stream(spark, f"{path}/files", f"{path}/state", ignore=[r"/_SUCCESS$"])
        keep = lambda df, n: df.select(F.lit(step).alias("step"), F.regexp_extract("uri", "/ext=([^/]*)/", 1).alias("ext"), "event").write.mode("overwrite").parquet(f"{rows}/batch={n}")
        J.run_available(stream, each=keep, checkpoint=f"{path}/checkpoint")

    listed(1)
    files = Files(spark, f"{path}/files")
    files.delete("ext=png")
    files.delete("ext=jpg")
    assets.filter("ext = 'jpg'").drop("ext").write.parquet(f"{path}/files/ext=jpg")
    listed(2)
    return spark.read.schema("step int, ext string, event string").parquet(f"{rows}/batch=*").distinct()


_REUSE = "e AS (SELECT event_id AS seq, ts, 'u_' || user_id AS uri, 'p' || (event_id % 2) AS plugin, props AS h, CASE WHEN event_type = 'error' THEN 'gone' WHEN event_type IN ('signup', 'purchase') THEN 'result' ELSE 'job' END AS kind FROM events), s AS (SELECT j.seq, min(r.uri) AS src FROM e j JOIN e r ON j.kind = 'job' AND r.kind = 'result' AND r.h = j.h AND r.plugin = j.plugin AND r.uri <> j.uri AND r.seq < j.seq AND epoch_ms(r.ts) > epoch_ms(j.ts) - 432000000 WHERE NOT EXISTS (SELECT 1 FROM e g WHERE g.kind = 'gone' AND g.h = r.h AND g.uri = r.uri AND g.seq > r.seq AND g.seq < j.seq) GROUP BY 1)"


@query(f"WITH {_REUSE} SELECT plugin, uri, e.seq, CASE WHEN src IS NULL THEN 'run' ELSE 'copy' END AS action, src, h AS hash_value FROM e LEFT JOIN s USING (seq) WHERE kind = 'job'")
def z04_reuse_stream(spark, d):
    """Z4 and Z9 as keyed state: results of the last five days whose path still has the content."""
    s = X.change_stream(spark, d)
    kind = F.when(F.col("event_type") == "error", "gone").when(F.col("event_type").isin("signup", "purchase"), "result").otherwise("job")
    events = s.select(kind.alias("kind"), F.concat(F.lit("p"), (F.col("seq") % 2).cast("string")).alias("plugin"), "uri", "hash_value", "seq", "ts")
    return _stateful(spark, J.reuse_stream(events, 5 * 24 * 3600 * 1000)).filter("action <> 'evict'")


@query(f"WITH {CH}, n AS (SELECT *, CASE WHEN event = 'delete' THEN NULL ELSE hash_value END AS now FROM changes), o AS (SELECT *, lag(now) OVER (PARTITION BY uri ORDER BY seq) AS old FROM n) SELECT uri, seq, old AS hash_value FROM o WHERE old IS NOT NULL AND now IS DISTINCT FROM old")
def z04_moves(spark, d):
    return _stateful(spark, J.moves(X.change_stream(spark, d)))


@query(f"WITH {_JOBS} SELECT seq, plugin, uri, hash_value FROM jobs WHERE (plugin, uri, hash_value) NOT IN (SELECT (plugin, uri, hash_value) FROM jobs WHERE seq % 5 = 0)")
def z06_still_valid(spark, d):
    jobs = J.fan_out(_files(spark, d), plugins(spark)).select("seq", "plugin", "uri", "hash_value")
    return J.still_valid(jobs, jobs.filter("seq % 5 = 0"))


_Z7 = f"WITH {CH}, x AS (SELECT uri, seq, CASE WHEN seq % 40 < 20 THEN 'a' ELSE 'b' END AS h FROM changes), g AS (SELECT *, sum(CASE WHEN h IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY uri ORDER BY seq) AS run FROM (SELECT *, lag(h) OVER (PARTITION BY uri ORDER BY seq) AS p FROM x)), n AS (SELECT *, row_number() OVER (PARTITION BY uri, run ORDER BY seq) AS n FROM g) SELECT uri, seq, CASE WHEN n <= 5 THEN 'retry' ELSE 'failed_retries_exhausted' END AS status, h AS hash_value FROM n WHERE n <= 6"


@query(_Z7)
def z07_retry_limit(spark, d):
    """Z7 and Z9 (the counters expire)."""
    s = X.change_stream(spark, d).withColumn("hash_value", F.when(F.col("seq") % 40 < 20, "a").otherwise("b"))
    return _stateful(spark, J.retry_limit(s))


@query(f"WITH {CH} SELECT uri, seq, event AS status FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY seq DESC) AS r FROM changes) WHERE r <= 5")
def z08_status_history(spark, d):
    return _stateful(spark, J.status_history(X.change_stream(spark, d).withColumnRenamed("event", "status")), "update")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def z09_live_entries(spark, d):
    e = X.table(spark, d, "events")
    now = e.agg(F.max("ts").alias("_now"))
    return J.live_entries(e.join(F.broadcast(now)), F.col("_now"), 3).select("event_id")


@query(f"WITH {_ST} SELECT plugin, uri, CASE status WHEN 'failed' THEN 'delete' ELSE 'upsert' END AS action, hash_value FROM (SELECT *, row_number() OVER (PARTITION BY plugin, uri ORDER BY ts DESC) AS r FROM st) WHERE r = 1")
def z10_write_back(spark, d):
    r = statuses(spark, d).select("plugin", "uri", F.col("processing_timestamp").alias("seq"), "hash_value", F.when(F.col("status") == "processed", "content").alias("content"))
    return J.write_back(r)[0].select("plugin", "uri", "action", "hash_value")


@query("SELECT vec_id // 2 AS asset_id, CASE WHEN (vec_id // 2) % 3 = 0 AND vec_id % 2 = 1 THEN 'new_' || (vec_id // 2) ELSE 'img_' || vec_id END AS image FROM embeddings")
def z11_replace_by_producer(spark, d):
    v = X.asset_views(spark, d)
    who = F.when(F.col("view_offset") == 0, "a").otherwise("b").alias("producer")
    assets = v.groupBy("asset_id").agg(F.collect_list(F.struct("image", who)).alias("views"))
    new = v.filter("asset_id % 3 = 0 and view_offset = 1").select("asset_id", F.lit("b").alias("plugin"), F.array(F.struct(F.concat(F.lit("new_"), F.col("asset_id").cast("string")).alias("image"), F.lit("b").alias("producer"))).alias("views"))
    return J.replace_by_producer(assets, new).select("asset_id", F.explode("views.image").alias("image"))


_Z12 = f"WITH {CH}, n AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY uri ORDER BY ts, seq) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM changes), g AS (SELECT *, sum(new) OVER (PARTITION BY uri ORDER BY ts, seq) AS s FROM n) SELECT uri, min(ts) AS start, count(*) AS n, arg_max(event, seq) AS event FROM g GROUP BY uri, s"


@query(_Z12.replace("ts <= lag", "ts < lag"))
def z12_debounce(spark, d):
    return J.debounce(X.changes(spark, d), "6 hours")


@query()
def z12_debounce_stream(spark, d):
    """Append mode: a burst comes out when the watermark has passed it."""
    s = J.debounce(X.change_stream(spark, d), "6 hours", "1 hour")
    return spark.read.schema(s.schema).parquet(J.run_available(s))


@query(f"WITH {_ST}, l AS (SELECT uri, arg_max(hash_value, ts) AS h FROM st GROUP BY 1), dn AS (SELECT plugin, uri, arg_max(hash_value, ts) AS h FROM st WHERE status = 'processed' GROUP BY 1, 2), p(plugin) AS (VALUES ('click'), ('view'), ('purchase'), ('thumb')) SELECT plugin, uri, CASE WHEN dn.h IS NULL THEN 'not_found' WHEN dn.h = l.h THEN 'in_sync' ELSE 'out_of_sync' END AS sync FROM l CROSS JOIN p LEFT JOIN dn USING (plugin, uri)")
def z13_sync_status(spark, d):
    st = statuses(spark, d)
    listing = J.latest(st, ["uri"], F.col("processing_timestamp"))
    done = J.latest(st.filter("status = 'processed'"), ["plugin", "uri"], F.col("processing_timestamp"))
    return J.sync_status(listing, done, plugins(spark))


@query(f"WITH {_ST}, l AS (SELECT plugin, uri, arg_max(status, ts) AS status FROM st GROUP BY 1, 2) SELECT uri, plugin, 'priority' AS priority FROM l WHERE status = 'failed' AND plugin IN ('click', 'view') AND regexp_matches(uri, '^u_1')")
def z14_reprocess(spark, d):
    st = statuses(spark, d)
    return J.reprocess(S.assets_by_status(st, plugins(spark), st, ["failed"]), st, "^u_1", plugins=["click", "view"])[0]


# user functions, with stand-ins that are the same everywhere


class Lengths(C.Producer):
    name = "lengths"

    def should_process(self, items: pd.DataFrame) -> pd.Series:
        return items["uri"] % 5 != 0

    def preprocess(self, items: pd.DataFrame):
        bad = items["size"] > 3000
        return items[~bad], {int(i): "too large" for i in items.index[bad]}

    def process(self, items: pd.DataFrame) -> list[str | None]:
        return [str(n) for n in items["size"]]


@query("SELECT doc_id AS uri, 'lengths' AS plugin, CASE WHEN doc_id % 5 = 0 THEN 'skipped' WHEN n_chars > 3000 THEN 'failed' ELSE 'processed' END AS status, CASE WHEN doc_id % 5 <> 0 AND n_chars <= 3000 THEN n_chars::VARCHAR END AS content, CASE WHEN doc_id % 5 <> 0 AND n_chars > 3000 THEN 'too large' END AS error FROM documents")
def e01_producer(spark, d):
    return C.run_producer(X.table(spark, d, "documents").select(F.col("doc_id").alias("uri"), F.col("n_chars").alias("size")), Lengths())


@query(f"WITH {X.ASSETS} SELECT asset_id, CASE WHEN ext IN ('usd', 'usda') THEN 6 WHEN ext IN ('png', 'jpg') THEN 2 ELSE 0 END::BIGINT AS n FROM assets")
def e02_registry(spark, d):
    a = X.assets(spark, d)
    p = C.plugin_registry(spark).filter("active").select(F.col("name").alias("plugin"), F.explode("data_types").alias("ext"))
    return a.join(p, "ext", "left").groupBy("asset_id").agg(F.count("plugin").alias("n"))


@query("SELECT doc_id AS asset_id, [strlen(lang)::FLOAT, strlen(source)::FLOAT] AS sizes FROM documents")
def e03_embed(spark, d):
    items = X.table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), F.array("lang", "source").alias("inputs"))
    e = C.embed(items, lambda xs: [[float(len(x)), 1.0] for x in xs], "inputs")
    return e.select("asset_id", F.transform("embeddings", lambda v: v[0]).alias("sizes"))


def _judge(query: str, item: str) -> dict:
    if item == "es":
        raise ValueError("no verdict")
    return {"is_match": item in query, "confidence": 1.0, "score": float(len(item)), "reasoning": item}


@query("SELECT doc_id, CASE lang WHEN 'es' THEN NULL ELSE contains('en fr', lang) END AS is_match, CASE lang WHEN 'es' THEN NULL ELSE 2.0::DOUBLE END AS score FROM documents")
def e04_judge(spark, d):
    pool = X.table(spark, d, "documents").select("doc_id", F.lit("en fr").alias("query"), F.col("lang").alias("item"))
    return C.judge(pool, _judge).select("doc_id", "is_match", "score")


def _extract(text: str) -> dict:
    if len(text) % 10 == 0:
        raise ValueError("unreadable")
    return {"long": len(text) > 1000, "parts": "a, b"}


@query("SELECT doc_id AS asset_id, name, CASE name WHEN 'long' THEN []::VARCHAR[] ELSE ['a', 'b'] END AS value_text, CASE name WHEN 'long' THEN n_chars > 1000 END AS value_bool FROM documents, (VALUES ('long'), ('parts')) v(name) WHERE n_chars % 10 <> 0")
def e05_extract_metadata(spark, d):
    items = X.table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), "text")
    return C.extract_metadata(items, _extract, "text").filter("status = 'processed'").select("asset_id", F.inline(metadata_rows(F.col("fields"))))
