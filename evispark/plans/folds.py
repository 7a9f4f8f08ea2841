"""Queries with state that is carried from event to event; their SQL walks each key's events with a recursive CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.operators import rates
from evispark.operators import stateful as st
from evispark.plans.registry import query, table

DAY = 86_400


def _walk(key: str, begin: str, step: str, out: str, *, given: str = "") -> str:
    """SQL of a fold: ``begin`` is the state before a key's first event, ``step`` the state after event e from state s."""
    return f"""
WITH RECURSIVE e AS (SELECT {key} AS k, event_id, event_type, value, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i{given} FROM events),
f AS (SELECT DISTINCT k, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BIGINT AS user_id, {begin} FROM e
  UNION ALL SELECT e.k, e.i, e.event_id, e.user_id, {step} FROM f AS s JOIN e ON e.k = s.k AND e.i = s.i + 1)
SELECT {out} FROM f WHERE i > 0"""


_NEW = f"s.begin IS NULL OR e.t - s.begin >= {2 * DAY}000000"


@query(_walk("user_id", "NULL::BIGINT AS begin, 0 AS used", f"CASE WHEN {_NEW} THEN e.t ELSE s.begin END, CASE WHEN {_NEW} THEN 1 ELSE s.used + 1 END", "user_id, event_id, begin AS window_start, used <= 5 AS accepted"))
def s_frame_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five events a user in windows of two days that start at the first event in them; the rest is refused."""
    return st.quota(table(spark, sf_dir, "events"), ["user_id"], "ts", ["event_id"], seconds=2 * DAY, most=5)


_USED = f"CASE WHEN {_NEW} THEN 0 ELSE s.used END"
_FITS = f"{_USED} + floor(e.value * 10)::BIGINT <= 900"


@query(_walk("user_id", "NULL::BIGINT AS begin, 0::BIGINT AS used, false AS accepted", f"CASE WHEN {_NEW} THEN e.t ELSE s.begin END, {_USED} + CASE WHEN {_FITS} THEN floor(e.value * 10)::BIGINT ELSE 0 END, {_FITS}", "user_id, event_id, accepted"))
def s_byte_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """900 bytes (ten times an event's value) a user in windows of two days; what doesn't fit is refused and counts nothing."""
    return st.byte_quota(table(spark, sf_dir, "events"), ["user_id"], "ts", ["event_id"], F.floor(F.col("value") * 10), seconds=2 * DAY, most=900)


_UNITS, _INVALID = "(e.value - 5)", "e.value - 5 < 0"
_SPENT = f"CASE WHEN {_NEW} THEN 0 ELSE s.used END"
_OVER = f"{_SPENT} + {_UNITS} > 60"


@query(_walk("user_id", "NULL::BIGINT AS begin, 0::DOUBLE AS used, '' AS status",
    f"CASE WHEN {_INVALID} OR {_OVER} THEN s.begin WHEN {_NEW} THEN e.t ELSE s.begin END, CASE WHEN {_INVALID} OR {_OVER} THEN s.used ELSE {_SPENT} + {_UNITS} END, CASE WHEN {_INVALID} THEN 'invalid' WHEN {_OVER} THEN 'exhausted' ELSE 'ok' END",
    "user_id, event_id, status, CASE WHEN status = 'ok' THEN round(60 - used, 4) END AS remaining"))
def s_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 units a user in windows of two days; only accepted events start a window; negative units are invalid."""
    found = st.budget(table(spark, sf_dir, "events"), ["user_id"], "ts", ["event_id"], F.col("value") - 5, seconds=2 * DAY, most=60.0)
    return found.select("user_id", "event_id", "status", F.round("remaining", 4).alias("remaining"))


_FRESH = f"s.seen IS NULL OR e.t - s.seen > {2 * DAY}000000"


@query(_walk("(user_id, event_type)", "NULL::BIGINT AS seen, false AS fresh", f"CASE WHEN {_FRESH} THEN e.t ELSE s.seen END, {_FRESH}", "event_id, fresh"))
def s_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a replay if the same user and kind was accepted within two days; a replay is not remembered."""
    return st.replays(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", seconds=2 * DAY)


_CUT = f"list_filter(s.seen, lambda x: x.seen_at >= e.t - {2 * DAY}000000)"
_NAME = "(e.value::BIGINT % 7)::VARCHAR"
_TAKEN = f"len({_CUT}) < 4 AND NOT list_contains(list_transform({_CUT}, lambda x: x.name), {_NAME})"


@query(_walk("user_id", "[]::STRUCT(name VARCHAR, seen_at BIGINT)[] AS seen, false AS fresh", f"CASE WHEN {_TAKEN} THEN list_append({_CUT}, {{'name': {_NAME}, 'seen_at': e.t}}) ELSE {_CUT} END, {_TAKEN}", "event_id, fresh"))
def s_replay_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``s_replay``, with four names (here: a digit of the value) remembered for each user at most; full is refused."""
    events = table(spark, sf_dir, "events").withColumn("name", F.bround("value", 0).cast("long") % 7)
    return st.replays_capped(events, ["user_id"], "name", "ts", "event_id", seconds=2 * DAY, most=4)


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY ts, event_id) = 1 AS claimed FROM events")
def s_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of a user and kind claims the pair for good."""
    return st.claims(table(spark, sf_dir, "events"), [F.col("user_id"), F.lower("event_type")], "ts", "event_id")


@query("""
WITH a AS (SELECT event_id, user_id, event_type, ts + INTERVAL 1 MINUTE * (event_id % 8) AS received, event_type <> 'error' AND event_id % 8 <= 5 AS fit FROM events),
r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY received, event_id) = 1 AS accepted FROM a WHERE fit)
SELECT event_id, coalesce(accepted, false) AS accepted FROM a LEFT JOIN r USING (event_id)""")
def s_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted: sound, at most five minutes old when received, and the first such one of its nonce."""
    events = table(spark, sf_dir, "events").withColumn("received", F.timestamp_micros(st.micros("ts") + (F.col("event_id") % 8) * 60_000_000))
    return st.announcements(events, ["user_id", "event_type"], "ts", "received", "event_id", F.col("event_type") != "error", seconds=300)


_MOVES = {("new", "signup"): "member", ("new", "view"): "visitor", ("visitor", "click"): "active", ("visitor", "purchase"): "customer", ("active", "purchase"): "customer", ("customer", "error"): "lost", ("active", "error"): "visitor", ("lost", "view"): "visitor"}
_TO = "CASE " + " ".join(f"WHEN s.state = '{a}' AND e.event_type = '{b}' THEN '{c}'" for (a, b), c in _MOVES.items()) + " END"


@query(f"SELECT user_id, state, n_moves FROM ({_walk('user_id', chr(39) + 'new' + chr(39) + ' AS state, 0::BIGINT AS n_moves', f'coalesce({_TO}, s.state), s.n_moves + ({_TO} IS NOT NULL)::BIGINT', 'user_id, state, n_moves, i')}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1")
def s_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that a user's events lead to, by a table of transitions."""
    return st.final_state(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "event_type", _MOVES, "new")


_HELD = f"CASE WHEN s.acc IS NOT NULL AND e.t - s.at <= {2 * DAY}000000 THEN s.acc END"
_WAIT = f"s.acc IS NOT NULL AND e.t - s.at <= {4 * DAY}000000 AND (abs(e.x - s.acc * 0.5::DOUBLE) <= 0.12::DOUBLE * s.acc * 0.5::DOUBLE OR abs(e.x - s.acc * 2) <= 0.12::DOUBLE * s.acc * 2) AND s.run < 2"
_AGREE = f"NOT coalesce({_WAIT}, false) AND s.last IS NOT NULL AND abs(e.x - s.last) <= 8"


@query(_walk("user_id", "NULL::DOUBLE AS last, NULL::DOUBLE AS acc, 0::BIGINT AS at, 0 AS run, NULL::DOUBLE AS shown",
    f"e.x, CASE WHEN {_AGREE} THEN floor((e.x + s.last) / 2 + 0.5) ELSE s.acc END, CASE WHEN {_AGREE} THEN e.t ELSE s.at END, CASE WHEN {_WAIT} THEN s.run + 1 ELSE 0 END, CASE WHEN {_AGREE} THEN floor((e.x + s.last) / 2 + 0.5) ELSE {_HELD} END",
    "event_id, shown", given=", CASE WHEN event_type <> 'error' THEN value END AS x"))
def s_tracked_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings in a row must agree within 8; octave jumps wait for a third; errors are missing readings."""
    reading = F.when(F.col("event_type") != "error", F.col("value"))
    return st.track_rate(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", reading, hold=2.0 * DAY, memory=4.0 * DAY)


_THREE = "e.v = s.one AND e.v = s.two"
_DUE = f"coalesce({_THREE} AND (s.said IS DISTINCT FROM e.v OR e.t - s.at >= CASE WHEN e.v = 'good' THEN {30 * DAY}000000 ELSE {8 * DAY}000000 END), false)"


@query(_walk("user_id", "NULL::VARCHAR AS one, NULL::VARCHAR AS two, NULL::VARCHAR AS said, 0::BIGINT AS at, NULL::VARCHAR AS cue",
    f"CASE WHEN e.v IS NOT NULL THEN s.two END, e.v, CASE WHEN {_DUE} THEN e.v ELSE s.said END, CASE WHEN {_DUE} THEN e.t ELSE s.at END, CASE WHEN {_DUE} THEN e.v END",
    "event_id, cue", given=", CASE WHEN event_type = 'error' THEN NULL WHEN value < 10 THEN 'faster' WHEN value > 25 THEN 'slower' ELSE 'good' END AS v"))
def s_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to say after each reading: three in a row, new ones at once, the same again after 8 days, 'good' after 30."""
    value = F.col("value")
    verdict = F.when(F.col("event_type") == "error", F.lit(None)).when(value < 10, "faster").when(value > 25, "slower").otherwise("good")
    return st.cues(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", verdict, repeat={"good": 30.0 * DAY}, usual=8.0 * DAY)


#: Ten days of a user's events on a grid of six hours; rhythms of one to three days. Two channels: the value, and the value of odd ids.
_RHYTHM = rates.Rhythm(window=10 * DAY * 1_000_000, span=6 * DAY * 1_000_000, grid=DAY * 250_000.0, share=0.4, half=6, lags=(4, 12), least_move=0.35, confidence=0.3)


@query(f"""
WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS t, unnest([0, 1]) AS channel, unnest([value - 20, CASE WHEN event_id % 2 = 1 THEN value - 20 ELSE 0 END]) AS d FROM events),
w AS (SELECT user_id, event_id, channel, list(t) OVER win AS ts, list(d) OVER win AS ds FROM c
  WINDOW win AS (PARTITION BY user_id, channel ORDER BY t RANGE BETWEEN {10 * DAY}000000 PRECEDING AND CURRENT ROW)),
p AS (SELECT *, list_transform(range(1, len(ds) + 1), lambda i: list_sum(ds[1:i])) AS pos FROM w
  WHERE len(ts) >= {0.4 * 24} AND ts[-1] - ts[1] >= {6 * DAY}000000 AND len(list_distinct(ts)) = len(ts)),
u AS (SELECT *, list_transform(range(0, floor((ts[-1] - ts[1]) / {DAY * 250_000}.0::DOUBLE)::BIGINT + 1), lambda k: ts[1] + k * {DAY * 250_000}) AS grid FROM p),
f AS (SELECT *, list_transform(grid, lambda g: least(len(list_filter(ts, lambda x: x <= g)), len(ts) - 1)) AS js FROM u WHERE len(grid) >= 24),
l AS (SELECT *, list_transform(range(1, len(grid) + 1), lambda k: pos[js[k]] + (pos[js[k] + 1] - pos[js[k]]) * ((grid[k] - ts[js[k]]) / (ts[js[k] + 1] - ts[js[k]]))) AS lev FROM f),
x AS (SELECT user_id, event_id, channel, len(lev) AS n, list_transform(range(1, len(lev) + 1), lambda i: lev[i] - list_avg(lev[greatest(1, i - 6):least(len(lev), i + 6)])) AS x FROM l),
r AS (SELECT *, list_transform(range(3, 14), lambda g: CASE WHEN sqrt(list_sum(list_transform(range(1, n - g + 1), lambda i: x[i] * x[i])) * list_sum(list_transform(range(1, n - g + 1), lambda i: x[i + g] * x[i + g])))
      > {rates.FAINT} * list_sum(list_transform(x, lambda v: v * v)) THEN list_sum(list_transform(range(1, n - g + 1), lambda i: x[i] * x[i + g]))
    / sqrt(list_sum(list_transform(range(1, n - g + 1), lambda i: x[i] * x[i])) * list_sum(list_transform(range(1, n - g + 1), lambda i: x[i + g] * x[i + g]))) ELSE 0 END) AS r
  FROM x WHERE list_stddev_pop(x) >= 0.35),
k AS (SELECT *, list_filter(range(4, 13), lambda g: r[g - 2] >= r[g - 3] AND r[g - 2] >= r[g - 1] AND r[g - 2] > 0) AS peaks FROM r),
b AS (SELECT *, list_filter(peaks, lambda g: r[g - 2] >= 0.85 * list_max(list_transform(peaks, lambda h: r[h - 2])))[1] AS l0 FROM k WHERE len(peaks) > 0),
h1 AS (SELECT *, coalesce(list_filter(peaks, lambda g: g < l0 AND abs(g - l0 / 2) <= 3 AND r[g - 2] >= 0.25)[1], l0) AS l1 FROM b),
h2 AS (SELECT *, coalesce(list_filter(peaks, lambda g: g < l1 AND abs(g - l1 / 2) <= 3 AND r[g - 2] >= 0.25)[1], l1) AS l2 FROM h1),
h3 AS (SELECT *, coalesce(list_filter(peaks, lambda g: g < l2 AND abs(g - l2 / 2) <= 3 AND r[g - 2] >= 0.25)[1], l2) AS lag FROM h2),
z AS (SELECT *, r[lag - 3] - 2 * r[lag - 2] + r[lag - 1] AS bend FROM h3),
e AS (SELECT user_id, event_id, channel, lag + CASE WHEN bend < 0 THEN 0.5 * (r[lag - 3] - r[lag - 1]) / bend ELSE 0 END AS lag, least(1, r[lag - 2]) AS confidence FROM z),
one AS (SELECT * FROM e WHERE confidence >= 0.3 QUALIFY row_number() OVER (PARTITION BY user_id, event_id ORDER BY confidence DESC, channel) = 1)
SELECT v.user_id, v.event_id, round({DAY}000000 / ({DAY * 250_000}.0 * lag), 4) AS rate, round(confidence, 4) AS confidence, channel::BIGINT AS channel FROM events v LEFT JOIN one USING (user_id, event_id)""")
def s_sliding_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a day a user's values go up and down, from the ten days before each event."""
    value = F.col("value") - 20
    found = rates.sliding_rates(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", [value, F.when(F.col("event_id") % 2 == 1, value).otherwise(0.0)], how=_RHYTHM, minute=DAY * 1e6)
    return found.select("user_id", "event_id", F.round("rate", 4).alias("rate"), F.round("confidence", 4).alias("confidence"), "channel")
