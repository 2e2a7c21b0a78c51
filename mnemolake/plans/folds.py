"""Stateful folds over interactions, and state machines that are windows or expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.folds import AXES, fold
from ..operators.timed import fold_timed
from .catalog import query, sql_of


def _rounded(df, *fields):
    return df.select("user_id", *(F.round(f, 4).alias(f) for f in fields))


_E = "e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM interactions), c AS (SELECT user_id, max(n) AS last FROM e GROUP BY user_id)"
_D = "CASE event_type WHEN 'purchase' THEN {} WHEN 'error' THEN {} WHEN 'signup' THEN {} WHEN 'view' THEN {} ELSE {} END"
_DELTAS = [(0.25, -0.3, 0.2, 0.0, 0.05), (-0.05, 0.1, 0.15, 0.10, 0.0), (0.0, -0.2, 0.0, 0.0, 0.0), (0.15, 0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0), (0.2, 0.0, 0.15, 0.0, 0.0)]
_NAMES = [("pleasure", 0.2, 120), ("arousal", 0.0, 60), ("dominance", -0.1, 90), ("trust", 0.5, 180), ("loneliness", 0.1, 45), ("satisfaction", 0.2, 90)]


def _affect_sql() -> str:
    delta = lambda i: "CAST(" + _D.format(*_DELTAS[i]) + " AS DOUBLE)"
    first = ", ".join(f"greatest(-1.0, least(1.0, CAST({r} AS DOUBLE) + {delta(i)})) AS {n}" for i, (n, r, _) in enumerate(_NAMES))
    move = ", ".join(f"greatest(-1.0, least(1.0, greatest(-1.0, least(1.0, CASE WHEN e.ts > s.ts THEN {r} + (s.{n} - {r}) * pow(0.5, (e.ts - s.ts) / 60 / {h}) ELSE s.{n} END)) + {delta(i)}))" for i, (n, r, h) in enumerate(_NAMES))
    return f"WITH RECURSIVE {_E}, s AS (SELECT user_id, n, ts, {first} FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.ts, {move.replace('event_type', 'e.event_type')} FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1) SELECT s.user_id, {', '.join(f'round(s.{n}, 4) AS {n}' for n, _, _ in _NAMES)} FROM s JOIN c ON c.user_id = s.user_id AND c.last = s.n"


@query("st_affect", _affect_sql())
def st_affect(t):
    return _rounded(fold(t["interactions"], "affect"), *(n for n, _, _ in _NAMES))


@query("st_relationship", f"""WITH RECURSIVE {_E}, s AS (SELECT user_id, n, ts, CAST(0.15 + 0.008 * CASE WHEN 0.85 * 0.3 + 0.15 * intensity > 0.6 THEN 1.5 ELSE 1 END AS DOUBLE) AS depth, CAST(0.85 * 0.3 + 0.15 * intensity AS DOUBLE) AS warmth, 1 AS meetings FROM e WHERE n = 1
 UNION ALL SELECT user_id, n, ts, least(0.95, d0 + 0.008 * CASE WHEN w1 > 0.6 THEN 1.5 ELSE 1 END * CASE WHEN gap > 3 THEN 1.3 ELSE 1 END), w1, meetings + 1 FROM (SELECT *, 0.85 * w0 + 0.15 * intensity AS w1 FROM (SELECT e.user_id, e.n, e.ts, e.intensity, s.meetings, (e.ts - s.ts) / 86400 AS gap,
  CASE WHEN e.ts > s.ts THEN greatest(0.05, s.depth * (0.7 + 0.3 * pow(0.5, (e.ts - s.ts) / 86400 / 14))) ELSE s.depth END AS d0, CASE WHEN e.ts > s.ts THEN s.warmth * greatest(0.1, pow(0.5, (e.ts - s.ts) / 86400 / 14)) ELSE s.warmth END AS w0 FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)))
 SELECT s.user_id, round(depth, 4) AS depth, round(warmth, 4) AS warmth, CAST(meetings AS DOUBLE) AS meetings FROM s JOIN c ON c.user_id = s.user_id AND c.last = s.n""")
def st_relationship(t):
    out = fold(t["interactions"], "relationship")
    return _rounded(out.withColumn("meetings", F.col("meetings").cast("double")), "depth", "warmth", "meetings")


_NIGHT = "(CAST(floor(e.ts / 3600) AS BIGINT) % 24 >= 22 OR CAST(floor(e.ts / 3600) AS BIGINT) % 24 < 6)"


@query("st_vitality", f"""WITH RECURSIVE {_E}, s AS (SELECT user_id, n, ts, CAST(0.75 AS DOUBLE) AS vitality FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.ts, CASE WHEN e.ts > s.ts THEN greatest(0.0, least(1.0, s.vitality - (0.003 * (e.ts - s.ts) / 60 + CASE WHEN event_type = 'purchase' THEN 0.04 ELSE 0 END + CASE WHEN {_NIGHT} THEN 0.15 * (e.ts - s.ts) / 3600 ELSE 0 END)
 + CASE WHEN event_type = 'purchase' THEN 0 ELSE 0.08 * (e.ts - s.ts) / 60 * (1 - s.vitality) END)) ELSE s.vitality END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1) SELECT s.user_id, round(vitality, 4) AS vitality FROM s JOIN c ON c.user_id = s.user_id AND c.last = s.n""")
def st_vitality(t):
    return _rounded(fold(t["interactions"], "vitality"), "vitality")


@query("st_curiosity", f"""WITH RECURSIVE {_E}, s AS (SELECT user_id, n, ts, CAST(CASE WHEN event_type = 'purchase' THEN 0.25 ELSE 0.5 END AS DOUBLE) AS curiosity FROM e WHERE n = 1 UNION ALL SELECT user_id, n, ts, CASE WHEN event_type = 'purchase' THEN greatest(0.15, x - 0.25) ELSE x END FROM (SELECT e.user_id, e.n, e.ts, e.event_type, CASE WHEN e.ts - s.ts >= 600 THEN least(1.0, s.curiosity + 0.06) ELSE s.curiosity END AS x FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
 SELECT s.user_id, round(curiosity, 4) AS curiosity FROM s JOIN c ON c.user_id = s.user_id AND c.last = s.n""")
def st_curiosity(t):
    return _rounded(fold(t["interactions"], "curiosity"), "curiosity")


_KINDS = {"coding": ("click", 5400), "gaming": ("view", 7200), "focused": ("purchase", 7200)}
_MOVE = ", ".join(f"CASE WHEN e.event_type = '{kind}' THEN s.{name} + e.intensity * 3600 WHEN e.event_type IN ('click', 'view', 'purchase') THEN 0 ELSE greatest(0, s.{name} - e.intensity * 1800) END AS {name}" for name, (kind, _) in _KINDS.items())
_DUE = "ts - reminded >= 3600 AND ((CAST(floor(ts / 3600) AS BIGINT) % 24 IN (23, 0, 1, 2, 3, 4) AND coding >= 3600) OR coding >= 5400 OR gaming >= 7200 OR focused >= 7200)"


@query("st_care", f"""WITH RECURSIVE {_E}, s AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS coding, CAST(0 AS DOUBLE) AS gaming, CAST(0 AS DOUBLE) AS focused, CAST(0 AS DOUBLE) AS reminded, CAST(0 AS BIGINT) AS reminders FROM c
 UNION ALL SELECT user_id, n, coding, gaming, focused, CASE WHEN {_DUE} THEN ts ELSE reminded END, reminders + CASE WHEN {_DUE} THEN 1 ELSE 0 END FROM (SELECT e.user_id, e.n, e.ts, s.reminded, s.reminders, {_MOVE} FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
 SELECT s.user_id, round(coding, 3) AS coding, round(gaming, 3) AS gaming, round(focused, 3) AS focused, reminders FROM s JOIN c ON c.user_id = s.user_id AND c.last = s.n""")
def st_care(t):
    """Counters on end by activity and the reminders so far."""
    return fold(t["interactions"], "care").select("user_id", *(F.round(c, 3).alias(c) for c in ("coding", "gaming", "focused")), "reminders")


@query("st_emotion_event", """WITH x AS (SELECT id, character, pad_p, pad_a, pad_d, abs(pad_p - lag(pad_p) OVER w) + abs(pad_a - lag(pad_a) OVER w) + abs(pad_d - lag(pad_d) OVER w) AS d FROM memory WINDOW w AS (PARTITION BY character ORDER BY id))
 SELECT id, round(least(1.0, d / 0.6), 6) AS intensity, round(least(0.95, 0.5 + 0.45 * least(1.0, d / 0.6)), 6) AS weight FROM x WHERE d >= 0.12""")
def st_emotion_event(t):
    """An event where the state moves by 0.12 and more."""
    w = Window.partitionBy("character").orderBy("id")
    d = sum((F.abs(F.col(c) - F.lag(c).over(w)) for c in ("pad_p", "pad_a", "pad_d")), F.lit(0.0))
    i = F.least(F.lit(1.0), F.col("d") / 0.6)
    return t["memory"].select("id", d.alias("d")).where("d >= 0.12").select("id", F.round(i, 6).alias("intensity"), F.round(F.least(F.lit(0.95), 0.5 + 0.45 * i), 6).alias("weight"))


_MOOD = "CASE WHEN pad_p > 0.15 AND pad_a > 0.1 THEN '开心' WHEN pad_p > 0.15 THEN '愉悦' WHEN pad_p < -0.15 THEN '低落' WHEN pad_a > 0.25 THEN '专注' ELSE '平静' END"


@query("st_emotion_diff", f"""WITH m AS (SELECT id, character, pad_p, pad_a, pad_d, {_MOOD} AS mood FROM memory), x AS (SELECT id, mood, lag(mood) OVER w AS was, abs(pad_p - lag(pad_p) OVER w) + abs(pad_a - lag(pad_a) OVER w) + abs(pad_d - lag(pad_d) OVER w) AS d FROM m WINDOW w AS (PARTITION BY character ORDER BY id)) SELECT id, was, mood FROM x WHERE d >= 0.3 AND mood <> was""")
def st_emotion_diff(t):
    w = Window.partitionBy("character").orderBy("id")
    x = t["memory"].withColumn("mood", F.expr(_MOOD)).withColumn("was", F.lag("mood").over(w)).withColumn("d", sum((F.abs(F.col(c) - F.lag(c).over(w)) for c in ("pad_p", "pad_a", "pad_d")), F.lit(0.0)))
    return x.where("d >= 0.3 AND mood <> was").select("id", "was", "mood")


@query("st_summary", f"""WITH RECURSIVE {_E}, s AS (SELECT user_id, event_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS last_round, 'none' AS action FROM e WHERE n = 1
 UNION ALL SELECT user_id, event_id, n, CASE WHEN asks AND action = 'make' THEN n // 2 WHEN asks AND cached >= 0 AND n // 2 - cached > 30 THEN -1 ELSE cached END, CASE WHEN asks THEN action ELSE 'none' END
  FROM (SELECT e.user_id, e.event_id, e.n, s.last_round AS cached, e.event_type IN ('purchase', 'signup', 'error') AS asks,
   CASE WHEN s.last_round >= 0 AND e.n // 2 - s.last_round < 10 THEN 'reuse' WHEN e.n >= 20 AND e.intensity > 0.1 THEN 'make' WHEN s.last_round >= 0 AND e.n // 2 - s.last_round <= 30 THEN 'keep' ELSE 'none' END AS action FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
 SELECT user_id, event_id, n AS turns, last_round, action FROM s WHERE n > 0""")
def st_summary(t):
    """What is done at each turn: a summary is reused for 10 rounds, made from 20 turns on, dropped after 30 rounds."""
    return fold(t["interactions"], "summary", last_only=False).select("user_id", "event_id", "turns", "last_round", "action")


@query("st_exec_state", "WITH e AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) SELECT event_id, user_id, was, event_type AS now FROM e WHERE was IS NULL OR was <> event_type")
def st_exec_state(t):
    e = t["events"].select("event_id", "user_id", F.col("event_type").alias("now"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("was"))
    return e.where("was IS NULL OR was <> now")


@query("st_turn_context", "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS turn, last_value(CASE WHEN event_type IN ('purchase', 'signup') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS topic FROM events")
def st_turn_context(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    topic = F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type"))
    return t["events"].select("event_id", "user_id", F.row_number().over(w).alias("turn"), F.last(topic, ignorenulls=True).over(w).alias("topic"))


#: Seconds of silence after a talk, after the last own words, and of activity until the user counts as away; least arousal, loneliness and curiosity.
GATES = {"talk": 300, "spoke": 300, "away": 300, "arousal": -0.3, "loneliness": 0.2, "curiosity": 0.4}


def gates(x):
    """speak and the reason of rows (talk, spoke, idle: seconds since the last talk, own words, activity; pending; arousal, loneliness, curiosity): the first gate that closes decides.

    Null seconds stand for never, which opens the first two gates and leaves the last one open; what is not known of the mood closes nothing.
    """
    g = {k: F.lit(v) for k, v in GATES.items()}
    order = [(F.col("talk") < g["talk"], "just talked"), (F.col("spoke") < g["spoke"], "just spoke"), (F.col("pending"), "task pending"), (F.col("arousal") < g["arousal"], "sleepy"), (F.col("loneliness") < g["loneliness"], "not lonely"), (F.col("curiosity") < g["curiosity"], "not curious"), (F.col("idle") > g["away"], "away")]
    reason = F.coalesce(*(F.when(closed, why) for closed, why in order), F.lit("ok"))
    return x.withColumn("reason", reason).withColumn("speak", F.col("reason") == "ok")


@query("st_proactive", f"""SELECT user_id, reason = 'ok' AS speak, reason FROM (SELECT user_id, CASE WHEN talk < 300 THEN 'just talked' WHEN spoke < 300 THEN 'just spoke' WHEN pending THEN 'task pending' WHEN arousal < -0.3 THEN 'sleepy' WHEN loneliness < 0.2 THEN 'not lonely' WHEN curiosity < 0.4 THEN 'not curious' WHEN idle > 300 THEN 'away' ELSE 'ok' END AS reason
 FROM (SELECT user_id, now - talk AS talk, now - spoke AS spoke, now - last AS idle, pending, CASE WHEN now > last THEN arousal * pow(0.5, (now - last) / 60 / 60) ELSE arousal END AS arousal, CASE WHEN now > last THEN 0.1 + (loneliness - 0.1) * pow(0.5, (now - last) / 60 / 45) ELSE loneliness END AS loneliness, curiosity
  FROM (SELECT user_id, max(ts) AS last, max(ts) + 60 * (user_id % 10) AS now, max(CASE WHEN event_type = 'purchase' THEN ts END) AS talk, max(CASE WHEN event_type = 'signup' THEN ts END) AS spoke, arg_max(event_type, [ts, event_id]) = 'error' AS pending FROM interactions GROUP BY user_id)
  JOIN ({_affect_sql()}) USING (user_id) JOIN ({sql_of("st_curiosity")}) USING (user_id)))""")
def st_proactive(t):
    """The gates for each user, asked `user_id % 10` minutes after the last event, with the mood and the curiosity that the folds give.

    Purchases stand for talks, signups for own words, an error at the end for a pending task.
    """
    x = t["interactions"]
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    seen = x.groupBy("user_id").agg(F.max("ts").alias("last"), at("purchase").alias("talk"), at("signup").alias("spoke"), (F.max_by("event_type", F.struct("ts", "event_id")) == "error").alias("pending"))
    now = F.col("last") + 60 * (F.col("user_id") % 10)
    seen = seen.withColumn("idle", now - F.col("last")).withColumn("talk", now - F.col("talk")).withColumn("spoke", now - F.col("spoke")).join(st_affect(t), "user_id").join(st_curiosity(t), "user_id")
    for name, rest, half in AXES:
        if name in ("arousal", "loneliness"):
            seen = seen.withColumn(name, F.when(F.col("idle") > 0, rest + (F.col(name) - rest) * F.pow(F.lit(0.5), F.col("idle") / 60 / half)).otherwise(F.col(name)))
    return gates(seen).select("user_id", "speak", "reason")


@query("st_windows", "SELECT event_type, CAST(floor(ts / 3600) * 3600 AS BIGINT) AS hour, CAST(count(*) AS BIGINT) AS n FROM interactions GROUP BY 1, 2")
def st_windows(t):
    return t["interactions"].groupBy("event_type", (F.floor(F.col("ts") / 3600) * 3600).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("st_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800 THEN 1 ELSE 0 END AS cut, event_id FROM interactions), s AS (SELECT user_id, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, CAST(k AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k")
def st_sessions(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = t["interactions"].select("user_id", "ts", "event_id", F.when(F.col("ts") - F.lag("ts").over(w) > 1800, 1).otherwise(0).alias("cut"))
    return g.select("user_id", F.sum("cut").over(w).alias("session")).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


@query("st_activation", """WITH u AS (SELECT max(ts) + 1 AS until FROM interactions), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1200 THEN 1 ELSE 0 END AS cut, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM interactions),
 s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g), a AS (SELECT *, least(1.0, sum(intensity) OVER (PARTITION BY user_id, k ORDER BY ts, event_id)) AS activation, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS seen FROM s)
 SELECT user_id, event_id, round(ts, 3) AS ts, 'event' AS kind, round(activation, 6) AS activation, CAST(seen AS BIGINT) AS seen FROM a
 UNION ALL SELECT user_id, NULL, round(ts + 1200, 3), 'expired', NULL, NULL FROM a, u WHERE ts + 1200 < coalesce(next, until)""")
def st_activation(t):
    """Activation of each key, event by event, and its end after twenty silent minutes; the stream does the same by timers."""
    x = t["interactions"]
    until = x.agg(F.max("ts")).first()[0]
    out = fold_timed(x, "activation", 0.0 if until is None else until + 1)
    return out.select("user_id", "event_id", F.round("ts", 3).alias("ts"), "kind", F.round("activation", 6).alias("activation"), "seen")
