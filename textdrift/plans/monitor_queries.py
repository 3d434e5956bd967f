"""Registered monitor queries over ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textdrift.plans.common import rounded
from textdrift.plans.registry import query
from textdrift.session import checkpoint_dir
from textdrift.sources.tables import (EVENTS_OBSERVATIONS_SQL, events_observations, events_observations_of,
                                      read_table)
from textdrift.streaming import monitor as mon
from textdrift.streaming.rules import COMPOSITE, RULE_SEVERITY, SUGGESTIONS, MonitorRules

# Rule thresholds used for the events-derived observations
# (Diversity = value, HighFreq = k / 100, METEOR = value / 50).
EVENT_RULES = MonitorRules(
    highfreq_threshold=0.9, diversity_threshold=2.5, meteor_threshold=0.02,
    diversity_change_threshold=20.0, highfreq_change_threshold=3.0,
    relation_residual_threshold=2.5)

OUT = ["seq", "Run", "Generation", "Diversity_change", "HighFreq_change", "relation_residual",
       "warning_count", "fired", "level", "status"]


#: Idle time after which a monitor starts afresh, in the session queries.
IDLE_SECONDS = 2 * 86_400


def _replay_sql(partition: str | None, idle_seconds: int | None = None, columns: str | None = None) -> str:
    r = EVENT_RULES
    pk = f"PARTITION BY {partition} " if partition else ""
    key_sel = f"{partition} AS monitor_id, " if partition else ""
    own = ", ".join([*([partition] if partition else []), *(["session"] if idle_seconds else [])])
    ok = f"PARTITION BY {own} " if own else ""
    opens = f"epoch_us(ts) - epoch_us(lag(ts) OVER ({pk}ORDER BY ts, event_id)) > {idle_seconds}::BIGINT * 1000000" if idle_seconds else "false"
    rule_sql = [
        f"HighFreq > {r.highfreq_threshold}",
        f"Diversity < {r.diversity_threshold}",
        f"METEOR < {r.meteor_threshold}",
        f"abs(Diversity_change) > {r.diversity_change_threshold}",
        f"abs(HighFreq_change) > {r.highfreq_change_threshold}",
        f"hist_len >= 10 AND abs(relation_residual) > {r.relation_residual_threshold}",
    ]
    flags = ", ".join(f"hist_len >= 2 AND coalesce({e}, false) AS r{i + 1}"
                      for i, e in enumerate(rule_sql))
    count = " + ".join(f"CAST(r{i} AS INTEGER)" for i in range(1, 7))
    fired = ", ".join(f"CASE WHEN r{i} THEN '{i}' END" for i in range(1, 7))
    t1, t2, t3 = r.level_thresholds
    columns = columns or """
           CASE WHEN isfinite(Diversity_change) THEN round(Diversity_change, 6) END
               AS Diversity_change,
           CASE WHEN isfinite(HighFreq_change) THEN round(HighFreq_change, 6) END
               AS HighFreq_change,
           round(relation_residual, 6) AS relation_residual, warning_count, fired, level, status"""
    return f"""
    WITH o AS ({EVENTS_OBSERVATIONS_SQL}),
    b AS (SELECT *, coalesce({opens}, false) AS opens FROM o),
    q AS (SELECT *, sum(opens::INTEGER) OVER ({pk}ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM b),
    s AS (SELECT *, row_number() OVER ({ok}ORDER BY ts, event_id) - 1 AS seq,
                 {'min(ts) OVER (' + ok + ')' if idle_seconds else 'NULL'} AS session_start FROM q),
    l AS (SELECT *, lag(seq) OVER r AS pseq, lag(Diversity) OVER r AS pD,
                 lag(HighFreq) OVER r AS pH,
                 avg(HighFreq) OVER h AS mx, avg(Diversity) OVER h AS my,
                 stddev_pop(HighFreq) OVER h AS sx, stddev_pop(Diversity) OVER h AS sy,
                 covar_pop(HighFreq, Diversity) OVER h AS cxy
          FROM s WINDOW r AS (PARTITION BY {own + ', ' if own else ''}Run ORDER BY seq),
                        h AS ({ok}ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    c AS (SELECT *, least(seq + 1, 20) AS hist_len,
                 CASE WHEN seq - pseq <= 19 THEN
                     CASE WHEN pD = 0 THEN CASE WHEN Diversity > 0 THEN 'inf'::DOUBLE
                                                WHEN Diversity < 0 THEN '-inf'::DOUBLE END
                          ELSE Diversity / pD - 1 END END AS Diversity_change,
                 CASE WHEN seq - pseq <= 19 THEN
                     CASE WHEN pH = 0 THEN CASE WHEN HighFreq > 0 THEN 'inf'::DOUBLE
                                                WHEN HighFreq < 0 THEN '-inf'::DOUBLE END
                          ELSE HighFreq / pH - 1 END END AS HighFreq_change,
                 CASE WHEN least(seq + 1, 20) >= 10 THEN
                     (Diversity - my) / (CASE WHEN sy > 0 THEN sy ELSE 1 END)
                     - coalesce(cxy / NULLIF(sx * sy, 0), 0)
                       * (HighFreq - mx) / (CASE WHEN sx > 0 THEN sx ELSE 1 END) END
                     AS relation_residual
          FROM l),
    f AS (SELECT *, {flags} FROM c),
    g AS (SELECT *, {count} AS warning_count, concat_ws(',', {fired}) AS fired FROM f),
    v AS (SELECT *, CASE WHEN warning_count >= {t3} THEN 'severe'
                         WHEN warning_count >= {t2} THEN 'warning'
                         WHEN warning_count >= {t1} THEN 'notice' END AS level FROM g),
    z AS (SELECT *, coalesce(last_value(level IGNORE NULLS) OVER ({ok}ORDER BY seq
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'normal') AS status FROM v)
    SELECT {key_sel}seq, Run, Generation, {columns}
    FROM z"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: DuckDB rows (rule, target, suggestion, priority); rule 0 is the composite.
_SUGGESTION_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({rule}, {_quoted(target)}, {_quoted(text)}, {_quoted(priority)})"
    for rules, target, text, priority in [*SUGGESTIONS, ([0], *COMPOSITE)] for rule in rules) + ") v(rule, target, suggestion, priority)"


def _number_sql(expr: str, digits: int) -> str:
    """``%.<digits>f`` of Java: half up on the shortest decimal form."""
    return (f"CASE WHEN {expr} = 'inf'::DOUBLE THEN 'Infinity' WHEN {expr} = '-inf'::DOUBLE THEN '-Infinity' "
            f"ELSE printf('%.{digits}f', round({expr}, {digits})) END")


def _description_sql() -> str:
    r = EVENT_RULES
    texts = [("high-frequency ratio (", "HighFreq", 4, f") above threshold ({r.highfreq_threshold:.4f})"),
             ("diversity (", "Diversity", 2, f") below threshold ({r.diversity_threshold:.2f})"),
             ("METEOR (", "METEOR", 4, f") below threshold ({r.meteor_threshold:.4f})"),
             ("diversity change (", "Diversity_change", 4, f") beyond threshold (+-{r.diversity_change_threshold:.4f})"),
             ("high-frequency change (", "HighFreq_change", 4, f") beyond threshold (+-{r.highfreq_change_threshold:.4f})"),
             ("relation residual (", "relation_residual", 4, f") beyond threshold (+-{r.relation_residual_threshold:.4f})")]
    whens = " ".join(f"WHEN {i + 1} THEN '{head}' || {_number_sql(column, digits)} || '{tail}'"
                     for i, (head, column, digits, tail) in enumerate(texts))
    return f"CASE rule {whens} END"


_SEVERITY_SQL = "CASE rule " + " ".join(f"WHEN {r} THEN '{v}'" for r, v in RULE_SEVERITY.items()) + " END"


def _replay(spark, sf_dir, key=None, chunk=10_000, **settings):
    obs = events_observations(spark, sf_dir)
    return mon.monitor_replay(obs, EVENT_RULES, key=key, chunk=chunk, **settings)


def _flat(df, with_key=False):
    cols = (["monitor_id"] if with_key else []) + OUT
    df = df.withColumns({"fired": mon.fired_rules(df),
                         "Diversity_change": mon.finite("Diversity_change"),
                         "HighFreq_change": mon.finite("HighFreq_change")})
    return rounded(df.select(*cols))


@query("monitor_replay", _replay_sql(None))
def q_monitor_replay(spark, sf_dir):
    """One global history over all events in arrival order (parity
    mode: a single hot key, processed in chunks with a halo)."""
    return _flat(_replay(spark, sf_dir))


@query("monitor_replay_small_chunks", _replay_sql(None))
def q_monitor_replay_small_chunks(spark, sf_dir):
    """R7 with 1,000-row chunks and blocks of 8 chunks: the halo and the scan
    of blocks across many borders must give exactly the same rows."""
    return _flat(_replay(spark, sf_dir, chunk=1000, block=8))


@query("monitor_replay_by_run", _replay_sql("Run"))
def q_monitor_replay_by_run(spark, sf_dir):
    """R7 with one monitor per Run (user): the scalable keyed form."""
    return _flat(_replay(spark, sf_dir, key=F.col("Run")), with_key=True)


@query("monitor_replay_sessions", _replay_sql("Run", IDLE_SECONDS))
def q_monitor_replay_sessions(spark, sf_dir):
    """R7 with an idle time: after two silent days a user's monitor starts
    afresh; sessions cross small chunks."""
    return _flat(_replay(spark, sf_dir, key=F.col("Run"), chunk=25, block=2, idle_seconds=IDLE_SECONDS), with_key=True)


SLICES = 3


def _event_stream(spark, sf_dir, base):
    """The events as a stream of ``SLICES`` micro-batches in time order: equal
    time slices, each written as one batch of files."""
    ev = read_table(spark, sf_dir, "events")
    low, high = ev.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    low, high = low or 0, high or 0
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = [low + (high - low) * i // SLICES for i in range(SLICES)] + [high + 1]
    for a, b in zip(edges, edges[1:]):
        events_observations_of(ev.where((at >= a) & (at < b))).coalesce(1).write.mode("append").parquet(base + "/in")
    schema = spark.read.parquet(base + "/in").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base + "/in")


def _streamed(spark, sf_dir, **settings):
    """The monitor's rows after all micro-batches, from its parquet sink."""
    base = checkpoint_dir(spark).rstrip("/") + f"/monitor-stream-{uuid.uuid4().hex}"
    out = mon.monitor_stream(_event_stream(spark, sf_dir, base), EVENT_RULES, key=F.col("Run"), **settings)
    (out.writeStream.format("parquet").option("path", base + "/out").option("checkpointLocation", base + "/ckpt")
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(out.schema).parquet(base + "/out")


@query("monitor_stream_by_run", _replay_sql("Run"))
def q_monitor_stream_by_run(spark, sf_dir):
    """The same monitor as a Structured Streaming query with keyed
    state, over the events in three micro-batches; returns the sink."""
    return _flat(_streamed(spark, sf_dir), with_key=True)


@query("monitor_stream_sessions", _replay_sql("Run", IDLE_SECONDS))
def q_monitor_stream_sessions(spark, sf_dir):
    """R2 with expiry: the stream has a watermark, and a user's state leaves
    after two silent days; equal to the replay with the same idle time."""
    return _flat(_streamed(spark, sf_dir, idle_seconds=IDLE_SECONDS, delay="6 hours"), with_key=True)


@query("monitor_stream_cycle", f"""
    WITH x AS ({_replay_sql("Run")}),
    f AS (SELECT monitor_id, seq, Run, warning_count, level, fired FROM x WHERE warning_count > 0),
    r AS (SELECT *, CAST(unnest(string_split(fired, ',')) AS INTEGER) AS rule FROM f
          UNION ALL SELECT *, 0 FROM f WHERE warning_count >= 3),
    t AS ({_SUGGESTION_SQL}),
    d AS (SELECT DISTINCT monitor_id, seq, target, suggestion, priority FROM r JOIN t USING (rule)),
    a AS (SELECT monitor_id, seq, string_agg(target || '/' || priority || '/' || suggestion, '; ' ORDER BY target) AS actions
          FROM d GROUP BY monitor_id, seq)
    SELECT monitor_id, seq, Run, warning_count, level, fired, actions FROM f JOIN a USING (monitor_id, seq)""")
def q_monitor_stream_cycle(spark, sf_dir):
    """The whole cycle as a stream (rules, level, suggestions with
    the composite one, sinks); one row per observation with warnings, put
    together from the two sinks."""
    base = checkpoint_dir(spark).rstrip("/") + f"/monitor-cycle-{uuid.uuid4().hex}"
    mon.run_monitor(_event_stream(spark, sf_dir, base), EVENT_RULES, base + "/sink", base + "/ckpt", key=F.col("Run"),
                    available_now=True).awaitTermination()
    alerts = spark.read.parquet(base + "/sink/alerts").groupBy("monitor_id", "seq", "Run", "warning_count", "level").agg(
        F.concat_ws(",", F.array_sort(F.collect_list(F.col("rule").cast("string")))).alias("fired"))
    action = F.concat_ws("/", "target", "priority", "suggestion")
    actions = spark.read.parquet(base + "/sink/suggestions").groupBy("monitor_id", "seq").agg(
        F.array_sort(F.collect_list(F.struct("target", action.alias("text")))).alias("a"))
    actions = actions.select("monitor_id", "seq", F.concat_ws("; ", "a.text").alias("actions"))
    return alerts.join(actions, ["monitor_id", "seq"]).select(
        "monitor_id", "seq", "Run", "warning_count", "level", "fired", "actions")


_ALERT_COLUMNS = "HighFreq, Diversity, METEOR, Diversity_change, HighFreq_change, relation_residual, warning_count, fired, level"


@query("monitor_alerts", f"""
    WITH x AS ({_replay_sql(None, columns=_ALERT_COLUMNS)}),
    r AS (SELECT *, CAST(unnest(string_split(fired, ',')) AS INTEGER) AS rule FROM x WHERE warning_count > 0)
    SELECT seq, Run, rule, level, {_SEVERITY_SQL} AS severity, {_description_sql()} AS description FROM r""")
def q_monitor_alerts(spark, sf_dir):
    """One row per fired warning with its text."""
    return mon.flat_alerts(_replay(spark, sf_dir)).select("seq", "Run", "rule", "level", "severity", "description")


@query("monitor_suggestions", f"""
    WITH x AS ({_replay_sql(None)}),
    r AS (SELECT seq, Run, CAST(unnest(string_split(fired, ',')) AS INTEGER) AS rule FROM x WHERE warning_count > 0
          UNION ALL SELECT seq, Run, 0 FROM x WHERE warning_count >= 3),
    t AS ({_SUGGESTION_SQL})
    SELECT DISTINCT seq, Run, target, suggestion, priority FROM r JOIN t USING (rule)""")
def q_monitor_suggestions(spark, sf_dir):
    """Suggestions for every row with warnings, the composite one
    included."""
    return mon.suggest_actions(_replay(spark, sf_dir)).select("seq", "Run", "target", "suggestion", "priority")


@query("monitor_latest", f"""
    WITH x AS ({_replay_sql('Run')})
    SELECT monitor_id, seq, warning_count, status FROM x
    QUALIFY seq = max(seq) OVER (PARTITION BY monitor_id)""")
def q_monitor_latest(spark, sf_dir):
    """L3: newest observation and status of every per-user monitor."""
    r = _replay(spark, sf_dir, key=F.col("Run"))
    return mon.latest(r).select("monitor_id", "seq", "warning_count", "status")


@query("warning_counts", f"""
    WITH x AS ({_replay_sql(None)}),
    firsts AS (SELECT Generation, arg_min(warning_count, seq) AS w FROM x
               WHERE warning_count > 0 GROUP BY Generation),
    hist AS (SELECT Generation, count(*) AS n_obs FROM x GROUP BY Generation)
    SELECT Generation, n_obs, coalesce(w, 0) AS warnings_at_generation
    FROM hist LEFT JOIN firsts USING (Generation)""")
def q_warning_counts(spark, sf_dir):
    """Per generation, the warning count of its first alert."""
    r = _replay(spark, sf_dir)
    hist = r.groupBy("Generation").agg(F.count(F.lit(1)).alias("n_obs"))
    return mon.warning_counts(hist, r).select("Generation", "n_obs", "warnings_at_generation")
