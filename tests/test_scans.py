"""Path-dependent rules against plain Python, whole and cut."""

import math
import pickle
import random
import tracemalloc
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F
from readtrace.operators import fixations as fx
from readtrace.operators import gaze as gz
from readtrace.operators import keys as ke
from readtrace.operators import lifecycle as lc
from readtrace.operators.align import (
    Lookahead, align_live, align_lookahead, align_texts, candidates, char_masks, common_subsequence, read_text, required)
from readtrace.session import tune

TARGETS = [10_000_000, 50]


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(3)
    data = []
    for session, n in ((1, 500), (2, 40)):
        x, y, ts = 0.0, 0.0, 0
        for i in range(n):
            ts += rng.choice([20, 33, 60, 90]) * 1_000_000
            if rng.random() < 0.2:
                x, y = rng.random() * 300, rng.random() * 60
            word = None if rng.random() < 0.1 else int(x // 60)
            data.append((session, ts, i, x + rng.random() * 10, y + rng.random() * 10, word))
    return spark.createDataFrame(
        data, "session_id long, ts_ns long, sample_id long, x double, y double, word_index int").cache()


def by_session(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.session_id, r.ts_ns, r.sample_id)):
        out.setdefault(r.session_id, []).append(r)
    return out


def plain_idt(rows, limit=40.0):
    buffer, onset, word, out = [], None, None, []
    for r in rows:
        buffer.append(r)
        if len(buffer) < 3:
            continue
        xs, ys = [b.x for b in buffer], [b.y for b in buffer]
        if math.hypot(max(xs) - min(xs), max(ys) - min(ys)) <= limit and r.word_index is not None:
            if onset is None:
                onset, word = buffer[0].ts_ns, r.word_index
        else:
            if onset is not None and buffer[-2].ts_ns > onset:
                k = len(buffer) - 1
                out.append((word, onset, buffer[-2].ts_ns, round(sum(xs[:-1]) / k, 6), round(sum(ys[:-1]) / k, 6), k))
            onset, word, buffer = None, None, []
    return out


@pytest.mark.parametrize("target", TARGETS)
def test_idt(samples, target):
    got = gz.idt_fixations(samples, target_rows=target).collect()
    for session, rows in by_session(samples).items():
        mine = sorted((r.word_index, r.onset_ns, r.offset_ns, round(r.centroid_x, 6), round(r.centroid_y, 6), r.sample_count)
                      for r in got if r.session_id == session)
        assert mine == sorted(plain_idt(rows))
        assert mine


def plain_dwell(rows, need=150_000_000):
    current, start, logged, last, out = None, None, set(), -1, []
    for r in rows:
        if r.word_index != current:
            if r.word_index is not None and last >= 0 and r.word_index < last:
                logged.discard(r.word_index)
            current, start = r.word_index, r.ts_ns
        elif current is not None and r.ts_ns - start >= need and current not in logged:
            logged.add(current)
            out.append((current, start, r.ts_ns, last >= 0 and current < last))
            last = current
    return out


@pytest.mark.parametrize("target", TARGETS)
def test_dwell(samples, target):
    got = gz.dwell_fixations(samples, target_rows=target).collect()
    for session, rows in by_session(samples).items():
        assert sorted((r.word_index, r.start_ns, r.confirmed_ns, r.regression)
                      for r in got if r.session_id == session) == sorted(plain_dwell(rows))


@pytest.mark.parametrize("target", TARGETS)
def test_dwell_islands_cover_first_visits(samples, target):
    exact = {(r.session_id, r.word_index, r.start_ns) for r in gz.dwell_fixations(samples).collect()}
    islands = {(r.session_id, r.word_index, r.start_ns) for r in gz.dwell_islands(samples, target_rows=target).collect()}
    assert exact <= islands


@pytest.mark.parametrize("target", TARGETS)
def test_lifecycle_and_debounce(spark, target):
    rng = random.Random(5)
    moves = lc.MOVES
    data = [(1, i, i, rng.choice(moves)[1]) for i in range(300)]
    df = spark.createDataFrame(data, "session_id long, ts_ns long, event_id long, event string")
    got = sorted(lc.lifecycle_history(df, target_rows=target).collect(), key=lambda r: r.ts_ns)
    table, state = {(a, b): c for a, b, c in moves}, "IDLE"
    for r, (_, _, _, event) in zip(got, data):
        after = table.get((state, event))
        assert (r.from_state, r.to_state, r.performed) == (state, after or state, after is not None)
        state = after or state
    times = spark.createDataFrame([(1, i * 170_000_000, i) for i in range(200)], "session_id long, ts_ns long, event_id long")
    kept = sorted(r.event_id for r in lc.debounced(times, target_rows=target).collect())
    assert kept == list(range(0, 200, 4))


def states_by_chunks(step, start, rows, transfer, cuts):
    """(state after these rows one by one, state after the chunks' transfers)."""
    state, after = start(), start()
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        chunk = transfer()
        for row in rows[a:b]:
            step(state, row)
            chunk.add(row)
        if b > a:
            after = pickle.loads(pickle.dumps(chunk.result())).after(after)
            yield state, after


def test_transfers_equal_steps():
    rng = random.Random(9)
    for _ in range(1500):
        rows, ts, x, word = [], 0, 0.0, 0
        for i in range(rng.randint(1, 60)):
            ts += rng.choice([0, 20, 50, 100, 200]) * 10 ** 6
            x = rng.random() * 100 if rng.random() < 0.3 else x
            word = rng.choice([None, 0, 1, 2, 3, 4]) if rng.random() < 0.4 else word
            rows.append((ts, x + rng.random() * 20, rng.random() * 20, word))
        cuts = sorted(rng.choices(range(len(rows) + 1), k=rng.randint(0, 6)))
        dwell, debounce, life, idt = fx.Dwell(rng.choice([60.0, 150.0])), lc.Debounce(rng.choice([1.0, 100.0, 300.0])), lc.Lifecycle(), fx.Idt(40.0)
        events = [(i, rng.choice(lc.MOVES)[1]) for i in range(len(rows))]
        for step, start, inputs, transfer in (
                (dwell, fx.Dwell.start, [(r[0], r[3]) for r in rows], lambda: fx.DwellTransfer(dwell.need)),
                (debounce, lc.Debounce.start, [(r[0], i) for i, r in enumerate(rows)], lambda: lc.DebounceTransfer(debounce.need)),
                (life, lc.Lifecycle.start, events, lambda: lc.LifecycleTransfer(life.moves)),
                (idt, fx.Idt.start, rows, lambda: fx.IdtTransfer(idt))):
            for one, other in states_by_chunks(step, start, inputs, transfer, cuts):
                assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in one.items()} == other


def test_transfers_stay_small():
    """A long recording leaves few cases, steps and ways behind."""
    rng = random.Random(2)
    dwell, idt, debounce = fx.DwellTransfer(100), fx.IdtTransfer(fx.Idt(40.0)), lc.DebounceTransfer(600)
    for i in range(20_000):
        dwell.add((i * 30, rng.choice([None, *range(12)]) if i % 5 == 0 else dwell.word))
        idt.add((i, rng.random() * 60, rng.random() * 20, 1))
        debounce.add((i * 170, i))
    assert len(dwell.result().nodes) < 2_000 and len(dwell.cases) < 60
    assert len(idt.ends) < 60 and len(idt.states) < 30
    assert len(debounce.result().steps) < 10


def test_two_passes_however_many_chunks(spark, samples, monkeypatch):
    from readtrace.operators import scan
    passes = []
    plain = scan._seeded
    monkeypatch.setattr(scan, "_seeded", lambda *a: passes.append(1) or plain(*a))
    events = spark.createDataFrame([(1, i, i, rng_event(i)) for i in range(400)], "session_id long, ts_ns long, event_id long, event string")
    for run in (lambda: gz.dwell_fixations(samples, target_rows=25), lambda: gz.idt_fixations(samples, target_rows=25),
                lambda: lc.lifecycle_history(events, target_rows=20), lambda: lc.debounced(events.drop("event"), min_ms=1e-5, target_rows=20)):
        passes.clear()
        run().collect()
        assert len(passes) == 2  # 20 chunks of the hot key


def rng_event(i):
    return lc.MOVES[i * 7 % len(lc.MOVES)][1]


def test_subsequence_bits():
    rng = random.Random(1)

    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert common_subsequence(char_masks(a), len(a), b) == plain(a, b)


SENTENCE = "One dog dug by one den".split()


def align(spark, said, target=10_000_000, **options):
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate(said)], "sentence_id long, seq long, word string")
    sentence = spark.createDataFrame([(1, SENTENCE)], "sentence_id long, words array<string>")
    return sorted((r.seq, r.word_index, r.fuzzy_score) for r in
                  align_lookahead(words, sentence, target_rows=target, **options).collect())


def test_lookahead(spark):
    assert align(spark, ["one", "dog", "dug"]) == [(0, 0, 100), (1, 1, 100), (2, 2, 100)]
    assert align(spark, ["ONE!", "xyz", "dog,"]) == [(0, 0, 100), (2, 1, 100)]
    assert align(spark, ["by"]) == [(0, 3, 100)]
    assert align(spark, ["den"]) == []           # beyond the lookahead
    assert align(spark, ["den"], lookahead=5) == [(0, 5, 100)]
    assert align(spark, ["one", "one"]) == [(0, 0, 100), (1, 4, 100)]
    assert align(spark, ["dogs"]) == [(0, 1, 85)]
    assert align(spark, ["dogs"], threshold=90.0) == []


def test_texts_in_rows_equal_words_in_rows(spark):
    said = "a one dog den one dug byy one den dog".split()
    texts = spark.createDataFrame([(1, said, SENTENCE)], "sentence_id long, said array<string>, words array<string>")
    got = sorted((r.seq, r.word_index, r.fuzzy_score) for r in align_texts(texts).collect())
    assert got == align(spark, said) and got


def test_lookahead_cut(spark):
    said = ["x", "one", "y", "dog", "z", "dug", "by", "q", "one", "den"] * 30
    assert align(spark, said, target=20) == align(spark, said)


def test_live(spark):
    texts = spark.createDataFrame(
        [(1, 0, "one", 3_000_000_000, False), (1, 1, "one dog", 3_500_000_000, False),
         (1, 2, "by one denn", 4_000_000_000, True), (1, 3, "dug", 100_000_000, False)],
        "sentence_id long, seq long, text string, ts_ns long, is_final boolean")
    sentence = spark.createDataFrame([(1, SENTENCE, 2_000_000_000)], "sentence_id long, words array<string>, start_ns long")
    got = sorted((r.seq, r.word_index, r.matched_word, r.speech_timestamp_ns) for r in align_live(texts, sentence).collect())
    # A token is used once ("one" again is skipped); "denn" is a short word and must be equal;
    # the last text lies before the fence.
    assert got == [(0, 0, "One", 2_900_000_000), (1, 1, "dog", 3_400_000_000), (2, 3, "by", 3_900_000_000)]


def test_null_texts_match_nothing(spark):
    texts = spark.createDataFrame([(1, 0, None, 3_000_000_000, False), (1, 1, "dog", 3_500_000_000, False), (2, 0, "dog", 3_500_000_000, False)],
                                  "sentence_id long, seq long, text string, ts_ns long, is_final boolean")
    sentences = spark.createDataFrame([(1, SENTENCE, 2_000_000_000), (2, None, 2_000_000_000)], "sentence_id long, words array<string>, start_ns long")
    assert [(r.sentence_id, r.seq) for r in align_live(texts, sentences).collect()] == [(1, 1)]
    said = spark.createDataFrame([(1, None, ["dog"]), (2, ["dog"], None), (3, ["dog"], ["dog"])], "sentence_id long, said array<string>, words array<string>")
    assert [r.sentence_id for r in align_texts(said).collect()] == [3]


def test_candidates_equal_pair_by_pair():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["a" * 300, "a" * 260 + "b", "Mixed", "mixed"]
    for _ in range(40):
        tokens, sentence = (rng.choices(words, k=rng.randint(0, 25)) for _ in range(2))
        tokens = [t.lower() for t in tokens]
        expected = []
        for t in tokens:
            own = []
            for i, w in enumerate(sentence):
                low, need = w.lower(), required(min(len(t), len(w)))
                begins = need < 1 and (low.startswith(t) or t.startswith(low))
                ratio = SequenceMatcher(None, t, low).ratio()
                if t == low or begins or need < 1 and ratio >= need:
                    own.append({"index": i, "word": w, "ratio": ratio})
            expected.append(own)
        assert candidates(tokens, sentence) == expected


def test_candidates_are_found_in_bounded_memory(spark):
    # Before, all pairs of a text were compared at once, at over 60 bytes a pair.
    rng = random.Random(5)
    spoken, read = (["".join(rng.choices(letters, k=8)) for _ in range(2000)] for letters in ("abcdefgh", "mnopqrst"))
    spoken[7] = read[11]
    tracemalloc.start()
    found = candidates(spoken, read)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[7][0]["index"] == 11 and peak < 60e6
    # A batch of wide rows is bounded in bytes, not only in rows.
    tune(spark)  # the corpus tests leave settings of their own
    size = F.pandas_udf(lambda x: x.str.len() * 0 + len(x), "long")
    wide = spark.range(0, 5000, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("x"))
    assert wide.select(size("x").alias("n")).agg(F.max("n")).first()[0] < 1000


def test_a_text_compares_a_word_once_at_a_position():
    class Counting(Lookahead):
        calls = 0

        def __call__(self, s, row):
            self.calls += 1
            return super().__call__(s, row)

    step = Counting()
    spoken = ["zzz"] * 500 + ["one"] + ["zzz", "yyy"] * 500 + ["dog"]
    assert [m[0] for m in read_text(step, spoken, ["One", "dog", "tail"])] == [500, 1501] and step.calls == 1 + 1 + 1 + 2 + 1


def plain_words(rows):
    buffer, first, back, ikis, before, out, n = [], None, 0, [], None, [], 0
    for r in rows:
        if before is not None:
            ikis.append((r.ts_ns - before) / 1e6)
        before = r.ts_ns
        if r.kind == "delimiter":
            if buffer:
                out.append((n, "".join(buffer), r.ts_ns, (r.ts_ns - first) / 1e6, back, ikis))
                buffer, first, back, ikis, before, n = [], None, 0, [], None, n + 1
        elif r.kind == "backspace":
            if buffer:
                buffer.pop()
            back += 1
        elif r.kind == "char":
            first = r.ts_ns if first is None else first
            buffer.append(r.char)
    return out


@pytest.mark.parametrize("target", TARGETS)
def test_typed_words(spark, target):
    rng = random.Random(11)
    data, ts = [], 0
    for i in range(400):
        ts += rng.randint(1, 200) * 1_000_000
        kind = rng.choice(["char"] * 5 + ["backspace"] * 3 + ["delimiter", "other"])
        data.append((1, ts, i, kind, rng.choice("abcxyz") if kind == "char" else None))
    df = spark.createDataFrame(data, "session_id long, ts_ns long, key_id long, kind string, char string")
    got = ke.typed_words(ke.keystrokes(df, target_rows=target)).orderBy("word_index").collect()
    want = plain_words(sorted(df.collect(), key=lambda r: r.ts_ns))
    assert [(r.word_index, r.submitted_word, r.typing_timestamp_ns, r.latency_ms, r.correction_count, r.iki_list)
            for r in got] == want
    assert len(want) > 10


def test_words_under_gaze_takes_lowest_index(spark):
    boxes = spark.createDataFrame([(1, 0, 0., 0., 10., 10.), (1, 1, 8., 0., 20., 10.)],
                                  "sentence_id long, word_index int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 1, 9., 5.), (2, 1, 15., 5.), (3, 1, 50., 5.), (4, 9, 9., 5.)],
                                   "sample_id long, sentence_id long, x double, y double")
    got = {r.sample_id: r.word_index for r in gz.words_under_gaze(points, boxes).collect()}
    assert got == {1: 0, 2: 1, 3: None, 4: None}
