"""Registered queries over recognised words, typed texts, keys and lifecycle logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from readtrace.catalog.common import rounded
from readtrace.catalog.sql import r
from readtrace.functions import text as tx
from readtrace.operators import align as al
from readtrace.operators import keys as ke
from readtrace.operators import lifecycle as lc
from readtrace.sources import texts, warehouse

QUERIES, SQL = {}, {}


def query(name, statement=None):
    def add(fn):
        QUERIES[name] = fn
        if statement:
            SQL[name] = statement
        return fn
    return add


_SPLIT = r"list_filter(string_split_regex({x}, '[\s\p{{Z}}]+'), lambda w: w <> '')"
_ALNUM = r"regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g')"
DOCS = f"""docw AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS seq FROM (
  SELECT doc_id, {_SPLIT.format(x='text')} AS ws FROM documents)),
doct AS (SELECT d.doc_id, {_SPLIT.format(x='b.text')} AS words FROM documents d
  JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""
PAIRS = f"""{DOCS}, pairs AS (SELECT DISTINCT {_ALNUM.format(x='lower(w.word)')} AS said, {_ALNUM.format(x='lower(t.words[w.seq + 1])')} AS target
  FROM docw w JOIN doct t ON t.doc_id = w.doc_id WHERE w.seq < len(t.words))"""


@query("s_normalise", f"""WITH {DOCS} SELECT DISTINCT word, trim(lower(word), '.,!?;:"''') AS clean FROM docw""")
def s_normalise(spark, d):
    return texts.document_words(spark, d).select("word").distinct().select(
        "word", tx.normalise(F.col("word")).alias("clean"))


@query("s_alnum", f"WITH {DOCS} SELECT DISTINCT word, {_ALNUM.format(x='word')} AS clean FROM docw")
def s_alnum(spark, d):
    return texts.document_words(spark, d).select("word").distinct().select(
        "word", tx.alnum(F.col("word")).alias("clean"))


@query("s_prefix_fallback", f"""WITH {PAIRS} SELECT said, target, CASE WHEN said = target THEN 100.0::DOUBLE
WHEN starts_with(said, target) OR starts_with(target, said) THEN 80.0 ELSE 0.0 END AS score FROM pairs""")
def s_prefix_fallback(spark, d):
    return texts.word_pairs(spark, d).select(
        "said", "target", tx.prefix_score(F.col("said"), F.col("target")).alias("score"))


@query("s_indel_ratio")
def s_indel_ratio(spark, d):
    """No subsequence length in the comparison engine; tested by brute force."""
    return rounded(texts.word_pairs(spark, d).select(
        "said", "target", tx.indel_ratio(F.col("said"), F.col("target")).alias("score")))


@query("s_ro_ratio")
def s_ro_ratio(spark, d):
    return rounded(texts.word_pairs(spark, d).select(
        "said", "target", tx.block_ratio(F.col("said"), F.col("target")).alias("ratio")))


@query("s_length_rule")
def s_length_rule(spark, d):
    rated = texts.word_pairs(spark, d).withColumn("ratio", tx.block_ratio(F.col("said"), F.col("target")))
    return rounded(rated.select("said", "target", "ratio", tx.accepts(
        F.col("said"), F.col("target"), F.col("ratio")).alias("accepted")))


def _cand(i):
    w = f"t.words[w.seq + {i + 1}]"
    return (f"CASE WHEN w.seq + {i} < len(t.words) THEN CASE WHEN w.word = {w} THEN 100.0 "
            f"WHEN starts_with(w.word, {w}) OR starts_with({w}, w.word) THEN 80.0 ELSE 0.0 END END")


@query("t_best_candidate", f"""WITH {DOCS}, c AS (SELECT w.doc_id, w.seq, w.word, {', '.join(f'{_cand(i)} AS s{i}' for i in range(4))}
FROM docw w JOIN doct t ON t.doc_id = w.doc_id WHERE w.seq < len(t.words))
SELECT doc_id AS sentence_id, seq AS ordinal, word, CAST(greatest(s0, s1, s2, s3) AS DOUBLE) AS score,
CASE greatest(s0, s1, s2, s3) WHEN s0 THEN seq WHEN s1 THEN seq + 1 WHEN s2 THEN seq + 2 ELSE seq + 3 END AS word_index FROM c""")
def t_best_candidate(spark, d):
    said = texts.document_words(spark, d).withColumnRenamed("seq", "ordinal")
    return rounded(al.best_candidates(said, texts.document_sentences(spark, d), tx.prefix_score))


@query("j7_lookahead_match_indel")
def j7(spark, d):
    """Whole documents as recognised texts, one row each."""
    return rounded(al.align_texts(texts.document_readings(spark, d)))


@query("j7_word_stream")
def j7_word_stream(spark, d):
    """The same from single recognised words in arrival order."""
    return rounded(al.align_lookahead(texts.document_words(spark, d), texts.document_sentences(spark, d)))


@query("j8_lookahead_match_ro")
def j8(spark, d):
    return rounded(al.align_live(texts.conversation_texts(spark, d), texts.conversation_sentences(spark, d)))


def _coded(spark, d):
    return texts.typed_pairs(spark, d).withColumn(
        "ops", tx.opcodes(F.col("reference"), F.col("typed")))


@query("s_opcodes")
def s_opcodes(spark, d):
    return rounded(_coded(spark, d).select("conv_id", "turn", "part", F.posexplode("ops").alias("n", "op")).select(
        "conv_id", "turn", "part", "n", "op.*"))


@query("s_transpositions")
def s_transpositions(spark, d):
    return rounded(_coded(spark, d).select("conv_id", "turn", "part", tx.transpositions(
        F.col("ops"), F.col("reference"), F.col("typed")).alias("transpositions")))


@query("s_mirror")
def s_mirror(spark, d):
    return rounded(_coded(spark, d).select("conv_id", "turn", "part", tx.mirrored(
        F.col("ops"), F.col("reference"), F.col("typed")).alias("mirrored")))


@query("s_typing_errors")
def s_typing_errors(spark, d):
    cols = tx.typing_errors(F.col("reference"), F.col("typed"), F.col("ops"))
    return rounded(_coded(spark, d).select("conv_id", "turn", "part", *[c.alias(n) for n, c in cols.items()]))


KEYS = """keys AS (SELECT user_id AS session_id, event_id AS key_id, epoch_us(ts) // 360 AS ts_ns,
  CASE event_type WHEN 'signup' THEN 'delimiter' WHEN 'error' THEN 'backspace' ELSE 'char' END AS kind,
  CASE WHEN event_type NOT IN ('signup', 'error') THEN event_type[1] END AS char,
  CASE WHEN event_type = 'error' THEN 'Backspace' ELSE event_type END AS key,
  CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 AS is_down FROM events)"""
_O = "ORDER BY ts_ns, key_id"
_S = f"OVER (PARTITION BY session_id {_O})"
_SEG = f"OVER (PARTITION BY session_id, seg {_O})"
STROKES = f"""{KEYS},
k1 AS (SELECT *, sum(CAST(kind = 'delimiter' AS INT)) {_S} - CAST(kind = 'delimiter' AS INT) AS seg FROM keys),
k2 AS (SELECT *, sum(CASE kind WHEN 'char' THEN 1 WHEN 'backspace' THEN -1 ELSE 0 END) {_SEG} AS s FROM k1),
k3 AS (SELECT *, s - least(0, min(s) {_SEG}) AS depth FROM k2),
k4 AS (SELECT *, kind = 'delimiter' AND depth > 0 AS submits, kind = 'char' AND
  min(depth) OVER (PARTITION BY session_id, seg {_O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= depth AS survives FROM k3),
k5 AS (SELECT *, CAST(sum(CAST(submits AS INT)) {_S} - CAST(submits AS INT) AS BIGINT) AS word_index FROM k4),
strokes AS (SELECT *, (ts_ns - lag(ts_ns) OVER (PARTITION BY session_id, word_index {_O})) / 1e6 AS iki_ms FROM k5)"""


@query("w_typed_words", f"""WITH {STROKES} SELECT session_id, word_index, string_agg(char, '' {_O}) FILTER (WHERE survives) AS submitted_word,
max(ts_ns) FILTER (WHERE submits) AS typing_timestamp_ns, {r("(max(ts_ns) FILTER (WHERE submits) - min(ts_ns) FILTER (WHERE kind = 'char')) / 1e6")} AS latency_ms,
count(*) FILTER (WHERE kind = 'backspace') AS correction_count, {r('avg(iki_ms)', 3)} AS mean_iki_ms
FROM strokes GROUP BY session_id, word_index HAVING bool_or(submits)""")
def w_typed_words(spark, d):
    words = ke.typed_words(ke.keystrokes(texts.key_events(spark, d)))
    return rounded(words.select(
        "session_id", "word_index", "submitted_word", "typing_timestamp_ns", "latency_ms",
        "correction_count", F.round("mean_iki_ms", 3).alias("mean_iki_ms")))


@query("w_iki", f"WITH {STROKES} SELECT session_id, key_id, word_index, {r('iki_ms')} AS iki_ms FROM strokes")
def w_iki(spark, d):
    return rounded(ke.keystrokes(texts.key_events(spark, d)).select("session_id", "key_id", "word_index", "iki_ms"))


@query("w_typed_ordinal", f"""WITH {KEYS}, e AS (SELECT *, lag(kind) {_S} AS before FROM keys) SELECT session_id, key_id,
row_number() {_S} AS word_number FROM e WHERE kind = 'delimiter' AND coalesce(before, 'delimiter') <> 'delimiter'""")
def w_typed_ordinal(spark, d):
    """Words of a plain input box: a delimiter after text ends the next word."""
    from readtrace.operators.ordered import OrderedFrame
    keys = texts.key_events(spark, d).select("session_id", "ts_ns", "key_id", "kind")
    ends = OrderedFrame(keys, ["session_id"], ["ts_ns", "key_id"]).lag({"before": "kind"}).df.filter(
        (F.col("kind") == "delimiter") & (F.coalesce("before", F.lit("delimiter")) != "delimiter"))
    return OrderedFrame(ends, ["session_id"], ["ts_ns", "key_id"]).row_number("word_number").df.select(
        "session_id", "key_id", "word_number")


_TIMES = f"""{KEYS}, tm0 AS (SELECT *,
  last_value(CASE WHEN is_down THEN ts_ns END IGNORE NULLS) OVER (PARTITION BY session_id, key {_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pressed,
  last_value(CASE WHEN NOT is_down THEN ts_ns END IGNORE NULLS) OVER (PARTITION BY session_id {_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS released FROM keys),
times AS (SELECT *, CASE WHEN NOT is_down THEN (ts_ns - pressed) / 1e6 END AS hold_ms,
  CASE WHEN is_down AND (ts_ns - released) / 1e6 < 2000 THEN (ts_ns - released) / 1e6 END AS flight_ms FROM tm0)"""


@query("w_key_times", f"WITH {_TIMES} SELECT session_id, key_id, is_down, {r('hold_ms')} AS hold_ms, {r('flight_ms')} AS flight_ms FROM times")
def w_key_times(spark, d):
    return rounded(ke.key_times(texts.key_events(spark, d)).select("session_id", "key_id", "is_down", "hold_ms", "flight_ms"))


@query("agg_key_dynamics", f"""WITH {_TIMES}, c AS (SELECT session_id, count(*) FILTER (WHERE kind = 'char') AS chars FROM keys GROUP BY 1),
a AS (SELECT session_id, coalesce(avg(hold_ms), 0) AS h, coalesce(avg(flight_ms), 0) AS f, coalesce(sum(flight_ms), 0) / 1000 AS fl,
 count(*) FILTER (WHERE is_down AND key = 'Backspace') AS b, count(*) FILTER (WHERE is_down) AS n FROM times GROUP BY 1)
SELECT a.session_id, {r('h', 3)} AS avg_hold_time_ms, {r('f', 3)} AS avg_flight_time_ms,
{r('CASE WHEN fl > 0 THEN c.chars / (fl + 1) * 60 ELSE 0 END', 3)} AS typing_speed_cpm, b AS backspace_count, n AS total_keystrokes
FROM a JOIN c ON c.session_id = a.session_id""")
def agg_key_dynamics(spark, d):
    keys = texts.key_events(spark, d)
    chars = keys.groupBy("session_id").agg(F.count_if(F.col("kind") == "char").alias("typed_chars"))
    return rounded(ke.key_dynamics(ke.key_times(keys), chars), 3)


def _advances(spark, d):
    return warehouse.samples(spark, d).select("session_id", "ts_ns", F.col("sample_id").alias("event_id"), "event_type", "k")


_ADVANCES = """advances AS (SELECT user_id AS session_id, event_id, epoch_us(ts) // 360 AS ts_ns,
  CAST(json_extract_string(props, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 360, event_id) AS n FROM events)"""
_MOVED = ", ".join(f"('{a}', '{e}', '{b}')" for a, e, b in lc.MOVES)
_EVENTS = ", ".join(f"'{e}'" for _, e, _ in lc.MOVES)


@query("st_lifecycle", f"""WITH RECURSIVE {_ADVANCES}, moves(a, e, b) AS (VALUES {_MOVED}),
named AS (SELECT *, ([{_EVENTS}])[k % {len(lc.MOVES)} + 1] AS event FROM advances),
walk AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ts_ns, '' AS event, '' AS from_state, 'IDLE' AS to_state, FALSE AS performed
    FROM (SELECT DISTINCT session_id FROM named)
  UNION ALL SELECT w.session_id, s.n, s.ts_ns, s.event, w.to_state, coalesce(m.b, w.to_state), m.b IS NOT NULL
  FROM walk w JOIN named s ON s.session_id = w.session_id AND s.n = w.n + 1 LEFT JOIN moves m ON m.a = w.to_state AND m.e = s.event)
SELECT * EXCLUDE (n) FROM walk WHERE n > 0""")
def st_lifecycle(spark, d):
    """State after an ignored event depends on all events before it."""
    names = [event for _, event, _ in lc.MOVES]
    event = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("k") % len(names) + 1).cast("int"))
    events = _advances(spark, d).withColumn("event", event)
    return rounded(lc.lifecycle_history(events.select("session_id", "ts_ns", "event_id", "event")))


@query("w_debounce", f"""WITH RECURSIVE {_ADVANCES},
walk AS (SELECT session_id, ts_ns, event_id FROM advances WHERE n = 1
  UNION ALL SELECT session_id, next.ts_ns, next.event_id FROM (
    SELECT w.session_id, min({{'ts_ns': a.ts_ns, 'event_id': a.event_id}}) AS next FROM walk w
    JOIN advances a ON a.session_id = w.session_id AND a.ts_ns - w.ts_ns >= 600000000 GROUP BY w.session_id))
SELECT * FROM walk""")
def w_debounce(spark, d):
    """A kept advance restarts the clock, so each decision needs the one before."""
    return rounded(lc.debounced(_advances(spark, d).select("session_id", "ts_ns", "event_id")))


@query("s_math", f"""SELECT event_id, {r('greatest(least(value, 100.0), 5.0)')} AS clipped, {r('abs(value - 50)')} AS distance,
{r("sqrt(power(value, 2) + power(CAST(json_extract_string(props, '$.k') AS DOUBLE), 2))")} AS radius, {r('sqrt(value)')} AS root FROM events""")
def s_math(spark, d):
    from readtrace.functions.temporal import clip
    k = F.get_json_object("props", "$.k").cast("double")
    return rounded(warehouse.table(spark, d, "events").select(
        "event_id", clip(F.col("value"), 5.0, 100.0).alias("clipped"), F.abs(F.col("value") - 50).alias("distance"),
        F.hypot("value", k).alias("radius"), F.sqrt("value").alias("root")))
