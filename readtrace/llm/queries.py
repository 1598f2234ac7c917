"""Registered queries of the corpus operators, with their comparison SQL."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import functions as F

from readtrace.llm import (audit_repair, context_mixing, curriculum, fixed_blocks, language, line_crf, minmax_dedup, notices, spelling, templates,
                           token_counts, toxicity, weak_rules)
from readtrace.llm.common import WORD, fold, prepared, table


QUERIES = {}
SQL = {}


def query(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        return fn(prepared(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_language_codes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    coder = language.learn(docs, ~fold("doc_id", 4))
    return language.identified(docs, coder).select("doc_id", fold("doc_id", 4).alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op2_context_mixing(spark, sf_dir):
    return context_mixing.scored(table(spark, sf_dir, "documents"), ~fold("doc_id", 7))


@query
def op3_token_counts(spark, sf_dir):
    return token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op4_curriculum_mix(spark, sf_dir):
    plan = curriculum.in_order(curriculum.mixed(table(spark, sf_dir, "documents")))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("position", 9).alias("position"))


@query
def op5_weak_rules(spark, sf_dir):
    return weak_rules.judged(table(spark, sf_dir, "documents"))


@query
def op6_minmax_dedup(spark, sf_dir):
    return minmax_dedup.deduplicated(table(spark, sf_dir, "documents"), width=3, percent=85)


@query
def op7_line_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = line_crf.learn(docs, labels, ~fold("doc_id", 4))
    return line_crf.scored(docs, model).select("doc_id", fold("doc_id", 4).alias("held_out"), "score", "predicted", "n_lines", "bad_share")


@query
def op8_toxic_sentences(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, ~fold("doc_id", 4))
    return toxicity.scored(docs, model).select(
        "doc_id", fold("doc_id", 4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("places").alias("n_places"), F.to_json("places").alias("places"))


@query
def op9_template_decontamination(spark, sf_dir):
    return templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_license_notices(spark, sf_dir):
    return notices.scanned(table(spark, sf_dir, "documents")).withColumn("spans", F.to_json("spans"))


@query
def op11_fixed_blocks(spark, sf_dir):
    return fixed_blocks.deduplicated(table(spark, sf_dir, "documents")).withColumn("n_repeats", F.size("repeats").cast("long")).drop("repeats")


@query
def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op13_audit_repair(spark, sf_dir):
    return audit_repair.repaired(audit_repair.damaged(table(spark, sf_dir, "conversations")))


def _mix_sql() -> str:
    """Shares by water filling, supply in the order of a hash, positions by the inverted schedules."""
    def at(kind: int, epoch: int) -> str:
        knots = curriculum.SCHEDULES[kind]
        share = f"least((start + size / 2 + source_size * {epoch}) / target, 1.0)"
        text, done = "1.0", 0.0
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
        for (t0, w0), (t1, w1) in reversed(list(zip(knots, knots[1:], strict=False))):
            done = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False) if b[0] <= t0)
            upto = (done + (t1 - t0) * (w0 + w1) / 2) / area
            need, slope = f"({share} * {area} - {done})", (w1 - w0) / (t1 - t0)
            text = (f"CASE WHEN {share} <= {upto} THEN {t0} + CASE WHEN {need} <= 0 THEN 0.0 ELSE 2 * {need} / "
                    f"({w0} + sqrt(greatest({w0 * w0} + 2 * {slope} * {need}, 0.0))) END ELSE {text} END")
        return text

    part = [f"greatest(0, least(size, upto - source_size * {e} - start))" for e in range(3)]
    first = " ".join(f"WHEN kind = {k} AND taken > 0 THEN {at(k, 0)}" for k in range(3))
    return f"""
WITH docs AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM docs GROUP BY source),
ordered AS (SELECT *, kind + 1 AS weight, source_size * 3 / (kind + 1) AS ratio FROM sources),
levels AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT)
           - coalesce(CAST(sum(source_size * 3) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
           / CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM ordered),
free AS (SELECT ratio AS free_ratio, level AS free_level FROM levels WHERE ratio >= level ORDER BY ratio, level LIMIT 1),
targets AS (SELECT source, source_size, kind, CASE WHEN ratio < free_ratio THEN CAST(source_size * 3 AS DOUBLE)
           ELSE least(CAST(source_size * 3 AS DOUBLE), free_level * weight) END AS target FROM levels, free),
placed AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.kind, CAST(floor(t.target + 0.5) AS BIGINT) AS upto,
           coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
           FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
taken AS (SELECT *, {' + '.join(part)} AS taken, {' + '.join(f'CAST({p} > 0 AS BIGINT)' for p in part)} AS copies FROM placed)
SELECT doc_id, size, source_size, target, taken, copies, round(CASE {first} END, 9) AS position FROM taken"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL["op4_curriculum_mix"] = _mix_sql()
SQL["op6_minmax_dedup"] = f"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(words) - 1), lambda i: concat_ws(' ', words[i], words[i + 1], words[i + 2]))) AS shingle
    FROM texts WHERE len(words) >= 3
    UNION ALL SELECT doc_id, concat_ws(' ', '', array_to_string(words, ' ')) FROM texts WHERE len(words) BETWEEN 1 AND 2)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS to_id FROM both_ways UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON l.a = r.to_id),
components AS (SELECT id, min(to_id) AS c FROM reach GROUP BY id)
SELECT t.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, t.doc_id) AS component_id,
       t.doc_id = coalesce(c.c, t.doc_id) AS kept
FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id LEFT JOIN components c ON c.id = t.doc_id"""


def _crc_sql(text: str) -> str:
    """CRC-32 of a string, four bits at a time, lowest first."""
    steps = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        steps.append(c)
    digits = f"hex(encode({text}))"
    nibbles = f"list_transform(range(0, len({digits})), lambda i: instr('123456789ABCDEF', substr({digits}, i + 2 - 2 * (i % 2), 1)))"
    return (f"xor(4294967295, list_reduce({nibbles}, lambda c, x: xor(c >> 4, list_extract({steps}::BIGINT[], CAST(xor(c & 15, x) AS BIGINT) + 1)), "
            "CAST(4294967295 AS BIGINT)))")


SQL["op11_fixed_blocks"] = f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + 20], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS pos FROM texts)),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos + unnest(range(0, 20)) AS pos FROM again),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM texts),
left_over AS (SELECT a.doc_id, count(*) AS k, string_agg(word, ' ' ORDER BY pos) AS s FROM words a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.pos = g.pos GROUP BY a.doc_id),
spans AS (SELECT doc_id, count(*) AS k FROM gone a ANTI JOIN (SELECT doc_id, pos + 1 AS pos FROM gone) b ON a.doc_id = b.doc_id AND a.pos = b.pos GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(len(t.w) - coalesce(l.k, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(l.s, '')) AS kept_sha256, CAST(coalesce(s.k, 0) AS BIGINT) AS n_repeats
FROM texts t LEFT JOIN left_over l ON l.doc_id = t.doc_id LEFT JOIN spans s ON s.doc_id = t.doc_id"""
SQL["op12_spelling_variants"] = f"""
WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents) GROUP BY 1, 2),
hashed AS (SELECT run, n, {_crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs),
vocabulary AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS (SELECT word, pos, substr(word, 1, pos) || substr(word, pos + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS pos FROM vocabulary)),
pairs AS (SELECT a.word AS a, b.word AS b FROM shorter a JOIN shorter b ON a.pos = b.pos AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT s.word, v.word FROM shorter s JOIN vocabulary v ON s.rest = v.word
    UNION SELECT v.word, s.word FROM shorter s JOIN vocabulary v ON s.rest = v.word),
near AS (SELECT a AS word, count(*) AS n_near, min((-v.n, b)) AS best FROM pairs JOIN vocabulary v ON v.word = b GROUP BY a),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * v.n THEN best[2] END AS form,
    CASE WHEN -best[1] >= 2 * v.n THEN -best[1] END AS form_n FROM vocabulary v LEFT JOIN near ON near.word = v.word),
walk AS (SELECT word, word AS pos FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.pos WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.pos AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word JOIN forms e ON e.word = w.pos AND e.form IS NULL"""


def _repair_sql() -> str:
    """Edits state by state: the least (cost, audit) of each state after each row, with the lines of its repair."""
    moves = [(q, to, cost, label, kind, c) for (c, kind), found in audit_repair._MOVES.items() for q, to, cost, label in found]
    table_ = ", ".join(f"({q}, {to}, {cost}, '{label}', {kind}, '{c}')" for q, to, cost, label, kind, c in moves)
    role = "CASE WHEN {} = 2 THEN 'assistant' ELSE 'user' END"
    after = "CASE WHEN m.q = 2 THEN 3 ELSE 2 END"
    line = (f"list_concat(s.lines, CASE WHEN m.label LIKE 'I%' THEN [{role.format('m.q')} || ':'] ELSE [] END, CASE right(m.label, 1) WHEN 'D' THEN [] "
            f"WHEN 'K' THEN [r.role || ':' || r.text] ELSE [CASE WHEN m.label = 'IR' THEN {role.format(after)} ELSE {role.format('m.q')} END || ':' || r.text] END)")
    return f"""
WITH RECURSIVE hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
    FROM hashed WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
marked AS (SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before,
    CASE WHEN NOT regexp_matches(text, '{WORD}') THEN 'b' WHEN nth > 1 THEN 'd'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM placed),
rows_ AS (SELECT conv_id, k, role, text, CASE WHEN fault IN ('b', 'd') THEN 2 WHEN fault = 't' THEN 1 ELSE 0 END AS kind,
    CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE '' END AS c FROM marked),
moves(q, next, cost, label, kind, c) AS (VALUES {table_}),
cells AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS q, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT DISTINCT conv_id FROM damaged)
    UNION ALL SELECT conv_id, k, q, best.cost, best.audit, best.lines FROM (
        SELECT r.conv_id, r.k, m.next AS q, min({{'cost': s.cost + m.cost, 'audit': s.audit || m.label, 'lines': {line}}}) AS best
        FROM cells s JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.k = s.k + 1 JOIN moves m ON m.q = s.q AND m.kind = r.kind AND m.c = r.c
        GROUP BY r.conv_id, r.k, m.next)),
ends AS (SELECT conv_id, min({{'cost': cost + CASE q WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'audit': audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'lines': list_concat(lines, CASE q WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)}}) AS best
    FROM (SELECT *, max(k) OVER (PARTITION BY conv_id) AS last FROM cells) WHERE k = last GROUP BY conv_id),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit,
    sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


SQL["op13_audit_repair"] = _repair_sql()
