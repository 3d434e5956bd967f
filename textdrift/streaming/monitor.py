"""Rule monitor over a stream of metric observations.

Semantics (per monitor key, in arrival order): the history is the last
``W`` observations (count based, all runs mixed).  A row is evaluated when
the history holds at least 2 rows.  The percent change of a metric is taken
against the previous row of the same Run *inside* the history.  Rule 6 needs
at least 10 rows: both metrics are z-scored inside the history (population
std, a zero std scales by 1), Diversity is regressed on HighFreq and the
newest row's residual ``z_y - rho * z_x`` is tested.  The level follows the
number of fired rules; the status is sticky and changes only when a rule
fires.

Missing values (NULL or NaN) fire no rule; window statistics skip them.

Sessions.  With ``idle_seconds`` a key that is silent for longer than that
starts afresh: its next observation opens a new session with an empty history,
status ``normal`` and numbers from 0 on.

Batch replay (:func:`monitor_replay`) computes this with windows; a key that
holds a large share of all rows is split into fixed-size chunks, each carrying
the last ``W - 1`` rows of the previous chunk (a halo), so no window partition
grows with the data.  Sequence numbers come from range-partition offsets,
not from a single-partition ``row_number``; the status and the session are
carried from chunk to chunk by a scan of blocks (``streaming.carry``).

:func:`monitor_stream` keeps the last ``W - 1`` rows per key in
``applyInPandasWithState`` state, evaluates a micro-batch's rows by array
operations (``streaming.rolling``) and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textdrift.session import materialize
from textdrift.streaming.carry import BLOCK, carried
from textdrift.streaming.rolling import evaluate, sticky
from textdrift.streaming.rules import (COMPOSITE, COMPOSITE_MIN_WARNINGS, LEVELS,
                                       RULE_SEVERITY, SUGGESTIONS, MonitorRules, suggestion_table)

REQUIRED = ["Run", "Generation", "Perplexity", "Diversity", "HighFreq", "METEOR"]
#: Columns that order observations; the stream needs both.
ORDER = ("ts", "event_id")
METRIC_COLUMNS = ("HighFreq", "Diversity", "METEOR")
KEY = "monitor_id"


def require_observation_fields(df: DataFrame, order_cols: Sequence[str] = ()) -> DataFrame:
    """Every observation needs the six fields and those that order it."""
    missing = [c for c in [*REQUIRED, *order_cols] if c not in df.columns]
    if missing:
        raise ValueError(f"missing required fields: {', '.join(missing)}")
    return df


def _without_nan(df: DataFrame) -> DataFrame:
    """NaN metrics become NULL, so that a comparison with them is never true."""
    return df.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in METRIC_COLUMNS})


# ---------------------------------------------------------------------------
# Sequence numbers per key without a single-partition window
# ---------------------------------------------------------------------------

def assign_sequence(obs: DataFrame, order_cols: Sequence[str], key: Column | None = None,
                    partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    """Add ``monitor_id`` and ``seq`` (0-based arrival index within the key).

    Rows are range-partitioned and sorted by ``(key, order)``; a hot key spans
    many partitions.  ``monotonically_increasing_id`` numbers rows inside each
    sorted partition; a small table of per-(partition, key) counts, at most
    one row per partition and key, turns these into per-key offsets.  The
    numbered rows are written once to the shared checkpoint folder, so both
    uses read the same numbers even after a lost executor.
    """
    spark = obs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    k = key if key is not None else F.lit(0).cast("long")
    keyed = obs.withColumn(KEY, k)
    order = [KEY, *order_cols]
    ranged = (keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mono", F.monotonically_increasing_id()))
    if checkpoint:
        # _pid and _mono are stored as values, so a parquet table in the
        # shared checkpoint folder fixes them as well as an RDD checkpoint
        # would, and is much cheaper to write and read.
        ranged = materialize(ranged)
    counts = ranged.groupBy("_pid", KEY).agg(F.count(F.lit(1)).alias("_cnt"),
                                            F.min("_mono").alias("_first"))
    w = Window.partitionBy(KEY).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    seq = ranged.join(offsets.select("_pid", KEY, "_off", "_first"), on=["_pid", KEY])
    return seq.withColumn("seq", F.col("_off") + F.col("_mono") - F.col("_first")).drop(
        "_pid", "_mono", "_off", "_first")


# ---------------------------------------------------------------------------
# Batch replay
# ---------------------------------------------------------------------------

def _with_halo(seqd: DataFrame, window: int, chunk: int) -> DataFrame:
    c = F.floor(F.col("seq") / chunk)
    own = F.struct(c.alias("chunk"), F.lit(False).alias("halo"))
    nxt = F.struct((c + 1).alias("chunk"), F.lit(True).alias("halo"))
    in_halo = F.pmod(F.col("seq"), F.lit(chunk)) >= chunk - max(window - 1, 1)
    tags = F.when(in_halo, F.array(own, nxt)).otherwise(F.array(own))
    return seqd.withColumn("_t", F.explode(tags)).select("*", "_t.chunk", "_t.halo").drop("_t")


def _rule_columns(rules: MonitorRules) -> dict[str, Column]:
    ev = F.col("evaluated")
    r6 = F.col("hist_len") >= 10
    return {
        "r1": ev & F.coalesce(F.col("HighFreq") > rules.highfreq_threshold, F.lit(False)),
        "r2": ev & F.coalesce(F.col("Diversity") < rules.diversity_threshold, F.lit(False)),
        "r3": ev & F.coalesce(F.col("METEOR") < rules.meteor_threshold, F.lit(False)),
        "r4": ev & F.coalesce(F.abs("Diversity_change") > rules.diversity_change_threshold,
                              F.lit(False)),
        "r5": ev & F.coalesce(F.abs("HighFreq_change") > rules.highfreq_change_threshold,
                              F.lit(False)),
        "r6": ev & r6 & F.coalesce(F.abs("relation_residual") > rules.relation_residual_threshold,
                                   F.lit(False)),
    }


def _warnings(rules: MonitorRules) -> Column:
    """Array of (rule, description, severity) for the fired rules."""
    desc = {
        1: F.format_string("high-frequency ratio (%.4f) above threshold (%.4f)",
                           F.col("HighFreq"), F.lit(rules.highfreq_threshold)),
        2: F.format_string("diversity (%.2f) below threshold (%.2f)",
                           F.col("Diversity"), F.lit(rules.diversity_threshold)),
        3: F.format_string("METEOR (%.4f) below threshold (%.4f)",
                           F.col("METEOR"), F.lit(rules.meteor_threshold)),
        4: F.format_string("diversity change (%.4f) beyond threshold (+-%.4f)",
                           F.col("Diversity_change"), F.lit(rules.diversity_change_threshold)),
        5: F.format_string("high-frequency change (%.4f) beyond threshold (+-%.4f)",
                           F.col("HighFreq_change"), F.lit(rules.highfreq_change_threshold)),
        6: F.format_string("relation residual (%.4f) beyond threshold (+-%.4f)",
                           F.col("relation_residual"), F.lit(rules.relation_residual_threshold)),
    }
    items = [F.when(F.col(f"r{i}"), F.struct(F.lit(i).alias("rule"), desc[i].alias("description"),
                                              F.lit(RULE_SEVERITY[i]).alias("severity")))
             for i in range(1, 7)]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def level_expr(count: Column, thresholds: Sequence[int]) -> Column:
    """Level from the number of fired rules (NULL when none fired)."""
    t1, t2, t3 = thresholds
    return (F.when(count >= t3, F.lit(LEVELS[2])).when(count >= t2, F.lit(LEVELS[1]))
            .when(count >= t1, F.lit(LEVELS[0])))


def _sessions(x: DataFrame, idle_seconds: float, time_col: str, block: int) -> DataFrame:
    """Adds ``session_start`` and ``_first``, the number of the session's first
    row, to rows with ``chunk`` and ``halo``."""
    part = [KEY, "chunk"]
    order = Window.partitionBy(*part).orderBy("_number")
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    gap = micros - F.lag(micros).over(order)
    opens = (F.col("_number") == 0) | F.coalesce(gap > F.lit(int(idle_seconds * 1_000_000)), F.lit(False))
    start = F.when(opens, F.struct(F.col(time_col).cast("timestamp").alias("at"), F.col("_number").alias("number")))
    x = materialize(x.withColumn("_start", start))
    lasts = x.where(~F.col("halo")).groupBy(*part).agg(F.max_by("_start", F.when(F.col("_start").isNotNull(), F.col("_number"))).alias("_last"))
    before = carried(materialize(lasts), [KEY], "chunk", "_last", "_before", block)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(before, part, "left")
    seen = F.last("_start", ignorenulls=True).over(upto)
    # a halo row before the last start of the earlier chunks is of an older session, whichever
    older = F.struct(F.lit(None).cast("timestamp").alias("at"), F.lit(-1).cast("long").alias("number"))
    session = F.coalesce(seen, F.when(F.col("_before.number") <= F.col("_number"), F.col("_before")), older)
    return (x.withColumn("_session", session)
            .withColumn("session_start", F.col("_session.at")).withColumn("_first", F.col("_session.number"))
            .drop("_start", "_before", "_session"))


def monitor_replay(obs: DataFrame, rules: MonitorRules | None = None,
                   order_cols: Sequence[str] = ORDER, key: Column | None = None,
                   chunk: int = 10_000, checkpoint: bool = True, idle_seconds: float | None = None,
                   block: int = BLOCK) -> DataFrame:
    """Run the six rules over a stored observation table, row by row.

    Output: one row per observation with ``monitor_id, seq``, the inputs, the
    changes, ``relation_residual``, flags ``r1..r6``, ``warnings`` (array of
    structs), ``warning_count``, ``level`` and sticky ``status``.  With
    ``idle_seconds`` (over the first order column) there is ``session_start``
    as well, and ``seq`` counts within the session.
    """
    rules = rules or MonitorRules()
    W = rules.history_window
    if chunk < W:
        raise ValueError("chunk must be at least the history window")
    require_observation_fields(obs, order_cols)
    seqd = assign_sequence(_without_nan(obs), order_cols, key, checkpoint=checkpoint)
    x = _with_halo(seqd, W, chunk)

    part = [KEY, "chunk"]
    if idle_seconds is None:
        x = x.withColumns({"_number": F.col("seq"), "_first": F.lit(0).cast("long")})
    else:
        x = _sessions(x.withColumn("_number", F.col("seq")), idle_seconds, order_cols[0], block)
    own = [*part, "_first"] if idle_seconds is not None else part
    x = x.withColumn("seq", F.col("_number") - F.col("_first"))
    roll = Window.partitionBy(*own).orderBy("_number").rowsBetween(-(W - 1), 0)
    by_run = Window.partitionBy(*own, "Run").orderBy("_number")
    hf, dv = F.col("HighFreq"), F.col("Diversity")
    x = x.withColumns({
        "_mx": F.avg(hf).over(roll), "_my": F.avg(dv).over(roll),
        "_sx": F.stddev_pop(hf).over(roll), "_sy": F.stddev_pop(dv).over(roll),
        "_cxy": F.covar_pop(hf, dv).over(roll),
        "_pseq": F.lag("_number").over(by_run), "_pD": F.lag("Diversity").over(by_run),
        "_pH": F.lag("HighFreq").over(by_run), "_pM": F.lag("METEOR").over(by_run),
    })
    x = x.filter(~F.col("halo"))
    in_window = (F.col("_number") - F.col("_pseq")) <= W - 1

    def change(cur: str, prev: str) -> Column:
        # x / 0 is +-inf (the rule fires), 0 / 0 has no change, as in pandas.
        c, p = F.col(cur), F.col(prev)
        inf = F.when(c > 0, F.lit(float("inf"))).when(c < 0, F.lit(float("-inf")))
        return F.when(in_window, F.when(p == 0, inf).otherwise(c / p - F.lit(1.0)))

    def scale(s: str) -> Column:
        return F.when(F.col(s) > 0, F.col(s)).otherwise(F.lit(1.0))
    zx = (hf - F.col("_mx")) / scale("_sx")
    zy = (dv - F.col("_my")) / scale("_sy")
    rho = F.coalesce(F.try_divide(F.col("_cxy"), F.col("_sx") * F.col("_sy")), F.lit(0.0))
    hist_len = F.least(F.col("seq") + 1, F.lit(W)).cast("int")
    x = x.withColumns({
        "hist_len": hist_len,
        "evaluated": hist_len >= 2,
        "Diversity_change": change("Diversity", "_pD"),
        "HighFreq_change": change("HighFreq", "_pH"),
        "METEOR_change": change("METEOR", "_pM"),
        "relation_residual": F.when(hist_len >= 10, zy - rho * zx),
    })
    x = x.withColumns(_rule_columns(rules))
    x = x.withColumn("warnings", _warnings(rules))
    x = x.withColumn("warning_count", F.size("warnings"))
    x = x.withColumn("level", level_expr(F.col("warning_count"), rules.level_thresholds))
    # W8 sticky status: the last level of the same session inside the chunk
    # (same partitions and order as the windows above: no further exchange) ...
    upto = Window.partitionBy(*own).orderBy("_number").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_in_chunk", F.last("level", ignorenulls=True).over(upto))
    x = materialize(x.drop("_mx", "_my", "_sx", "_sy", "_cxy", "_pseq", "_pD", "_pH", "_pM"))
    # ... else what earlier chunks left behind, if it is of the same session.
    lasts = x.groupBy(*part).agg(F.max_by(F.struct("_first", "level"), F.when(F.col("level").isNotNull(), F.col("_number"))).alias("_last"))
    carry = carried(materialize(lasts), [KEY], "chunk", "_last", "_carry", block)
    x = x.join(carry, on=part, how="left")
    same = F.when(F.col("_carry._first") == F.col("_first"), F.col("_carry.level"))
    x = x.withColumn("status", F.coalesce("_in_chunk", same, F.lit("normal")))
    drop = [c for c in x.columns if c.startswith("_")] + ["halo", "chunk"]
    return x.drop(*drop)


def _targets() -> dict[int, str]:
    """Target of every rule, the composite's (rule 0) included."""
    return {r: target for rules, target, _, _ in SUGGESTIONS for r in rules} | {0: COMPOSITE[0]}


def any_warning_in(rules: Sequence[int], col: str = "warnings") -> Column:
    """True when any fired warning belongs to ``rules``."""
    return F.coalesce(F.arrays_overlap(F.col(f"{col}.rule"),
                                       F.array(*[F.lit(int(r)) for r in rules])), F.lit(False))


def finite(c: str) -> Column:
    """NULL for an infinite value (for fixed-precision output)."""
    return F.when(F.abs(F.col(c)) == F.lit(float("inf")), F.lit(None)).otherwise(F.col(c))


def fired_rules(df: DataFrame) -> Column:
    """Comma list of fired rule numbers, e.g. ``"2,3"``."""
    return F.concat_ws(",", *[F.when(F.col(f"r{i}"), F.lit(str(i))) for i in range(1, 7)])


def flat_alerts(replayed: DataFrame, further: Sequence[str] = ()) -> DataFrame:
    """One row per fired warning (``explode`` of the warning array)."""
    names = [KEY, "seq", *further, "Run", "Generation", "warning_count", "level"]
    return (replayed.filter(F.col("warning_count") > 0)
            .select(*names, F.explode("warnings").alias("w")).select(*names, "w.*"))


def suggest_actions(replayed: DataFrame, further: Sequence[str] = ()) -> DataFrame:
    """Suggestions for the fired rules of every evaluated row.

    One pass: the fired rule numbers plus a composite marker (rule 0, when
    at least three rules fired) are exploded and joined to a 7-row fixed
    table (broadcast, size known); each target appears once per row.
    """
    names = [KEY, "seq", *further, "Run", "Generation"]
    spark = replayed.sparkSession
    marker = F.when(F.col("warning_count") >= COMPOSITE_MIN_WARNINGS, F.array(F.lit(0))) \
        .otherwise(F.array().cast("array<int>"))
    rules = F.concat(F.col("warnings.rule"), marker)
    table = suggestion_table(spark).unionByName(spark.createDataFrame(
        [(0, *COMPOSITE)], "rule int, target string, suggestion string, priority string"))
    # rules that share a target are told apart here, inside the row, so that
    # each target appears once without a shuffle
    first_of = {r: min(q for q, t in _targets().items() if t == target) for r, target in _targets().items()}
    mapping = F.create_map(*[F.lit(v) for pair in first_of.items() for v in pair])
    fired = replayed.select(*names, F.explode(F.array_distinct(F.transform(rules, lambda r: mapping[r]))).alias("rule"))
    return fired.join(F.broadcast(table), on="rule").select(*names, "target", "suggestion", "priority")


def warning_counts(history: DataFrame, replayed: DataFrame,
                   on: str = "Generation") -> DataFrame:
    """Attach to each history row the warning count of the first alert
    (in arrival order) with the same generation, 0 when there is none."""
    first = (replayed.filter(F.col("warning_count") > 0).groupBy(on)
             .agg(F.min_by("warning_count", "seq").alias("warnings_at_generation")))
    return (history.join(first, on=on, how="left")
            .withColumn("warnings_at_generation", F.coalesce("warnings_at_generation", F.lit(0))))


def latest(replayed: DataFrame) -> DataFrame:
    """L3: newest observation of every monitor key."""
    return replayed.groupBy(KEY).agg(F.max_by(F.struct(*replayed.columns), "seq").alias("row")) \
        .select("row.*")


# ---------------------------------------------------------------------------
# Structured Streaming
# ---------------------------------------------------------------------------

# What goes through the stateful function.  A call has a price, and one per
# column, so keys are dealt into buckets and rows travel as two arrays, decoded
# by JVM expressions after it.
BUCKETS = 1024
_IN_LONGS = ["event_id", "at_micros", "arrived_micros", "Run", "Generation", KEY]
_IN_DOUBLES = ["Perplexity", *METRIC_COLUMNS]
_OUT_LONGS = [*_IN_LONGS, "session_micros", "seq", "hist_len", "fired_mask", "status_code", "late"]
_OUT_DOUBLES = [*_IN_DOUBLES, "Diversity_change", "HighFreq_change", "METEOR_change", "relation_residual"]
STREAM_OUT = "longs array<long>, doubles array<double>"
#: Of a bucket: a record for each key, and the keys' last rows one after another.
STATE_SCHEMA = "records binary, run binary, metrics binary"
_RECORD = np.dtype([(c, np.int64) for c in ("key", "next_seq", "session", "last_at", "last_event", "status", "rows")])
STATUS = ("normal", *LEVELS)
#: Stands for a missing whole number in these arrays; NaN is a missing metric.
NONE = -2 ** 63


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _stream_fn(rules: MonitorRules, idle_micros: int | None):
    W = rules.history_window
    level_of = np.searchsorted(np.array(rules.level_thresholds), np.arange(7), side="right")
    bits = np.array([bin(i).count("1") for i in range(64)])
    n_in, n_out, n_metrics = len(_IN_LONGS), len(_OUT_LONGS), len(METRIC_COLUMNS)
    spot = {c: i for i, c in enumerate(_OUT_LONGS)}

    def store(state, records, run, metrics, seen):
        """Keeps the records of the bucket; those of keys that are not ``seen`` in
        this micro-batch go once the watermark is past the idle time."""
        if idle_micros is not None:
            now = state.getCurrentWatermarkMs()
            leaves = (records["last_at"] + idle_micros) // 1000 + 1
            stay = seen | (leaves >= now)
            if not stay.all():
                held = np.repeat(stay, records["rows"])
                records, run, metrics, leaves = records[stay], run[held], metrics[held], leaves[stay]
            if not len(records):
                state.remove()
                return
        state.update((records.tobytes(), run.tobytes(), metrics.tobytes()))
        if idle_micros is not None:
            state.setTimeoutTimestamp(max(int(leaves.min()), now + 1))  # not before the present watermark

    def fn(bucket, pdfs, state):
        old, old_run, old_metrics = np.empty(0, _RECORD), np.empty(0, np.int64), np.empty((0, n_metrics))
        if state.exists:
            records, run, metrics = state.get
            old, old_run = np.frombuffer(records, _RECORD), np.frombuffer(run, np.int64)
            old_metrics = np.frombuffer(metrics, float).reshape(-1, n_metrics)
        if state.hasTimedOut:  # a key without an observation for longer than the idle time
            store(state, old, old_run, old_metrics, np.zeros(len(old), bool))
            return
        parts = [(np.stack(p["longs"].to_numpy()), np.stack(p["doubles"].to_numpy())) for p in pdfs if len(p)]
        whole = np.concatenate([a for a, _ in parts]).astype(np.int64)
        real = np.concatenate([b for _, b in parts]).astype(float)
        order = np.lexsort((whole[:, 0], whole[:, 1], whole[:, n_in - 1]))
        whole, real = whole[order], real[order]
        event, at, key = whole[:, 0], whole[:, 1], whole[:, n_in - 1]
        # the keys of the bucket, those of the micro-batch with new records
        keys = np.union1d(old["key"], key)
        known = np.isin(keys, old["key"])
        records = np.zeros(len(keys), _RECORD)
        records["key"] = keys
        records[known] = old
        mine = np.searchsorted(keys, key)
        was, had = records[mine], known[mine]
        # not after the newest row already evaluated: no part of the history any more
        late = had & ((at < was["last_at"]) | ((at == was["last_at"]) & (event <= was["last_event"])))
        longs = np.zeros((len(at), n_out), np.int64)
        longs[:, :n_in] = whole
        longs[:, spot["late"]], longs[:, spot["seq"]] = late, -1
        longs[:, spot["status_code"]], longs[:, spot["session_micros"]] = was["status"], was["session"]
        doubles = np.full((len(at), len(_OUT_DOUBLES)), np.nan)
        doubles[:, :len(_IN_DOUBLES)] = real
        pool_run, pool_metrics = old_run, old_metrics
        start = np.cumsum(records["rows"]) - records["rows"]  # of a key's last rows
        seen = np.zeros(len(keys), bool)
        seen[mine] = True
        rows = np.flatnonzero(~late)
        if len(rows):
            at, event, run, metrics, mine, was, had = (v[rows] for v in (at, event, whole[:, 3], real[:, 1:], mine, was, had))
            first = np.diff(mine, prepend=-1) != 0  # of its key
            gap = at - np.where(first, was["last_at"], np.roll(at, 1))
            opens = (first & ~had) | (False if idle_micros is None else (gap > idle_micros) & (had | ~first))
            # a history: what a key has kept, if its session goes on, and the new rows of one session
            begin = np.flatnonzero(first | opens)
            history = np.cumsum(first | opens) - 1
            kept = np.where(opens[begin], 0, was["rows"][begin])
            added = np.cumsum(kept)
            place = np.arange(len(rows)) + added[history]
            past = _spans(begin + added - kept, kept)
            source = _spans(start[mine[begin]], kept)
            total = len(rows) + len(past)
            all_run, all_metrics, all_history = np.empty(total, np.int64), np.empty((total, n_metrics)), np.empty(total, np.int64)
            all_run[place], all_metrics[place], all_history[place] = run, metrics, history
            all_run[past], all_metrics[past] = old_run[source], old_metrics[source]
            all_history[past] = np.repeat(np.arange(len(begin)), kept)
            fresh = opens[begin]
            number = np.where(fresh, 0, was["next_seq"][begin])[history] + np.arange(len(rows)) - begin[history]
            session = np.where(fresh, at[begin], was["session"][begin])[history]
            got = evaluate(all_run, all_metrics[:, 0], all_metrics[:, 1], all_metrics[:, 2], all_history, place, number, rules)
            codes = sticky(level_of[bits[got["fired"]]], begin[history], np.where(fresh, 0, was["status"][begin])[history])
            for c, v in (("seq", got["seq"]), ("hist_len", got["hist_len"]), ("fired_mask", got["fired"]),
                         ("status_code", codes), ("session_micros", session)):
                longs[rows, spot[c]] = v
            for i, c in enumerate(_OUT_DOUBLES[len(_IN_DOUBLES):], len(_IN_DOUBLES)):
                doubles[rows, i] = got[c]
            # a key's record is that after its last row
            last = np.flatnonzero(np.append(first[1:], True))
            own = mine[last]
            held = np.minimum(place[last] - np.searchsorted(all_history, history[last]) + 1, W - 1)
            for c, v in (("next_seq", number + 1), ("session", session), ("last_at", at), ("last_event", event), ("status", codes)):
                records[c][own] = v[last]
            records["rows"][own] = held
            start[own] = len(old_run) + place[last] - held + 1
            pool_run, pool_metrics = np.concatenate([old_run, all_run]), np.concatenate([old_metrics, all_metrics])
        taken = _spans(start, records["rows"])
        store(state, records, pool_run[taken], pool_metrics[taken], seen)
        yield pd.DataFrame({"longs": list(longs), "doubles": list(doubles)})
    return fn


def monitor_stream(stream: DataFrame, rules: MonitorRules | None = None, key: Column | None = None,
                   idle_seconds: float | None = None, delay: str = "1 hour") -> DataFrame:
    """The monitor as a stateful streaming transformation; the columns
    are those of :func:`monitor_replay` plus ``session_start``, ``arrived``
    (R1, the time of the micro-batch) and ``late``.

    State per ``monitor_id``: the last ``W - 1`` observations, the sticky status
    and the newest ``(ts, event_id)``.  Keys are dealt into BUCKETS by hash, and
    one call evaluates a bucket's rows of a micro-batch by array operations.
    They are held together, about ten numbers a row, and taken in ``(ts,
    event_id)`` order; the source's rate limit bounds them.

    With ``idle_seconds``, ``ts`` gets a watermark that lags by ``delay``, and
    a key whose newest row is older than the watermark by more than the idle
    time leaves the state.  Sessions do not depend on when that happens, as a
    longer gap opens a new one in any case.

    Late rows.  A row that is not after the newest one of its key comes out
    with ``late = true``, number -1, no rules and the present status, and leaves
    the history alone.  With ``idle_seconds`` a row older than the watermark
    that Spark holds late rows against (that of the micro-batch before) is
    dropped and counted by the query's progress (rows dropped by watermark).
    """
    rules = rules or MonitorRules()
    require_observation_fields(stream, ORDER)
    k = key if key is not None else F.lit(0)
    arrived = F.col("arrived") if "arrived" in stream.columns else F.current_timestamp()
    rows = _without_nan(stream.withColumn("ts", F.col("ts").cast("timestamp"))).withColumns({
        "at_micros": F.unix_micros("ts"), "arrived_micros": F.unix_micros(arrived)})
    rows = rows.withColumn(KEY, k.cast("long")).select(
        F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).alias("bucket"), "ts",
        F.array(*[F.coalesce(F.col(c).cast("long"), F.lit(NONE)) for c in _IN_LONGS]).alias("longs"),
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in _IN_DOUBLES]).alias("doubles"))
    if idle_seconds is None:
        rows = rows.drop("ts")
    else:
        rows = rows.withWatermark("ts", delay)
    out = rows.groupBy("bucket").applyInPandasWithState(
        _stream_fn(rules, None if idle_seconds is None else int(idle_seconds * 1_000_000)), STREAM_OUT, STATE_SCHEMA, "append",
        "NoTimeout" if idle_seconds is None else "EventTimeTimeout")

    def whole(c: str) -> Column:
        value = F.col("longs")[_OUT_LONGS.index(c)]
        return F.when(value != NONE, value)

    def real(c: str) -> Column:
        value = F.col("doubles")[_OUT_DOUBLES.index(c)]
        return F.when(~F.isnan(value), value)
    out = out.select(
        whole(KEY).alias(KEY), F.timestamp_micros(whole("session_micros")).alias("session_start"), whole("seq").alias("seq"),
        whole("event_id").alias("event_id"), F.timestamp_micros(whole("at_micros")).alias("ts"),
        F.timestamp_micros(whole("arrived_micros")).alias("arrived"), whole("Run").alias("Run"),
        whole("Generation").cast("int").alias("Generation"), *[real(c).alias(c) for c in _OUT_DOUBLES],
        whole("hist_len").cast("int").alias("hist_len"), (whole("hist_len") >= 2).alias("evaluated"),
        *[(whole("fired_mask").bitwiseAND(1 << i) != 0).alias(f"r{i + 1}") for i in range(6)],
        F.element_at(F.array(*[F.lit(c) for c in STATUS]), (whole("status_code") + 1).cast("int")).alias("status"),
        (whole("late") == 1).alias("late"))
    out = out.withColumns({"fired": fired_rules(out), "warnings": _warnings(rules)}).withColumn("warning_count", F.size("warnings"))
    out = out.withColumn("level", level_expr(F.col("warning_count"), rules.level_thresholds))
    return out


def with_arrival_time(stream: DataFrame, col: str = "arrived") -> DataFrame:
    """Stamp each observation with its arrival time."""
    return stream.withColumn(col, F.current_timestamp())


def write_cycle(batch: DataFrame, path: str, epoch: int) -> None:
    """R5 + R8 + R9: one cycle's output below ``path``, a folder per epoch, so
    that a replayed epoch replaces its own rows: ``alerts`` (one row per fired
    rule) and ``suggestions`` (the micro-batch joined with the table of
    suggestions, the composite one included)."""
    fired = materialize(batch.where("warning_count > 0"))
    where = path.rstrip("/")
    flat_alerts(fired, ["session_start", "ts", "arrived"]).write.mode("overwrite").parquet(f"{where}/alerts/epoch={epoch}")
    suggest_actions(fired, ["session_start", "ts"]).write.mode("overwrite").parquet(f"{where}/suggestions/epoch={epoch}")


def run_monitor(stream: DataFrame, rules: MonitorRules, alerts_path: str, checkpoint: str,
                key: Column | None = None, interval_seconds: int | None = None,
                available_now: bool = False, idle_seconds: float | None = None, delay: str = "1 hour"):
    """R6 + R8 + R9: start the monitoring query.  Every micro-batch's rows are
    stamped with their arrival, evaluated, and go through ``foreachBatch`` into
    :func:`write_cycle`.  The trigger polls every ``interval_seconds`` (the
    rule config's check interval by default) or processes what is available
    and stops."""
    out = monitor_stream(with_arrival_time(stream), rules, key, idle_seconds, delay)
    writer = (out.writeStream.foreachBatch(lambda batch, epoch: write_cycle(batch, alerts_path, epoch))
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{interval_seconds or rules.check_interval} seconds")
    return writer.start()
