"""The corpus operators against brute force, planted cases and edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from readtrace.llm import (context_mixing, curriculum, language, line_crf, minmax_dedup, notices, templates, token_counts,
                           toxicity, weak_rules)
from readtrace.llm.common import fold, prepared

SMALL = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, TEXT2 string, score double, n long, kept boolean"
ODD = [None, "", " \n\t ", "one", "7 %", "word " * 3000, "a\nb\n\na", "x" * 5000]


@pytest.fixture(scope="module")
def session(spark):
    return prepared(spark)


def odd_docs(session, rows=None):
    """Null ids and texts, blanks, very long words, repeated rows, extra columns with the operators' own names."""
    texts = ODD if rows is None else rows
    data = [(i, t, "en" if i % 2 else None, None if i % 3 else "b", "z", 0.5, 1, True) for i, t in enumerate(texts)]
    return session.createDataFrame(data + data[:2] + ([(None, "null id here", "de", "a", None, None, None, None)] if rows is None else []), DOCS)


def words_of(text):
    return (text or "").encode().lower().split()


def test_repeated_words_and_rules(session):
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        times = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        covered = {i + k for i in range(len(words) - 7) if times[tuple(words[i:i + 8])] > 1 for k in range(8)}
        assert weak_rules.repeated_words(words) == len(covered)
    rows = weak_rules.judged(odd_docs(session)).collect()
    assert len(rows) == len(ODD) + 3
    assert {r.kept for r in rows if r.n_words < 20} == {False}
    assert weak_rules.judged(odd_docs(session, [])).count() == 0
    docs = session.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id for r in weak_rules.judged(docs).where("kept").collect()}
    assert kept == {r.doc_id for r in weak_rules.kept(docs).select("doc_id").collect()}
    assert weak_rules.kept(odd_docs(session)).columns == odd_docs(session).columns


def _votes(**bad):
    return "".join(bad.get(rule, "+") for rule in weak_rules.RULES)


def test_em_finds_rare_failures():
    pair = {"symbols": "-", "marks": "-"}
    model = weak_rules.fit({_votes(): 900, _votes(symbols="-"): 10, _votes(**pair): 30, _votes(**pair, letters="-"): 30, _votes(lines="-"): 10})
    share, _ = model
    assert 0.8 < share[0] < 0.98 and weak_rules.posterior(_votes(), model) > 0.9
    assert weak_rules.posterior(_votes(**pair), model) < 0.5


def test_em_recovers_known_accuracies():
    """Votes drawn from known rates, one class good and each kind of bad: the estimates come within 0.02."""
    rng = np.random.default_rng(5)
    share, rates = np.array([0.7, 0.09, 0.08, 0.07, 0.06]), weak_rules.start()[1][:, :, 0]
    rates = np.clip(rates + rng.uniform(-0.03, 0.2, rates.shape) * (rates < 0.5), 0.01, 0.95)
    kinds = rng.choice(5, 200_000, p=share)
    cast = np.where(rng.random((200_000, len(weak_rules.RULES))) < rates[kinds], "-", "+")
    cast[rng.random(cast.shape) < 0.1] = "0"
    model = weak_rules.fit(Counter(map("".join, cast)))
    assert np.abs(model[0] - share).max() < 0.02
    assert np.abs(model[1][0, :, 0] - rates[0]).max() < 0.02
    overall = np.einsum("c,cr->r", share[1:], rates[1:]) / share[1:].sum()
    found = np.einsum("c,cr->r", model[0][1:], model[1][1:, :, 0]) / model[0][1:].sum()
    assert np.abs(found - overall).max() < 0.02


def test_one_bad_vote_is_not_a_verdict(session):
    docs = session.read.parquet(f"{SMALL}/documents.parquet")
    rows = weak_rules.judged(docs).collect()
    single = [r for r in rows if r.pattern.count("-") == 1 and not r.base_failed]
    assert any(r.kept for r in single)
    assert any(not r.kept and not r.base_failed for r in rows)
    assert all(r.quality > 0.9 and r.kept for r in rows if "-" not in r.pattern and not r.base_failed)


def test_base_measures(session):
    """The base columns against a plain count over characters, words and lines."""
    texts = ["a # b", "x\ny\nx\n\n \nx", "\u00c9t\u00e9 *|* \u2003 end\x0b<>", "  ", "", None, "same same\n" * 30]
    docs = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in weak_rules.judged(docs).collect():
        text, seen, dup = texts[r.doc_id] or "", set(), 0
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        covered = {i + k for i in range(len(words) - 7) for k in range(8)
                   if sum(words[j:j + 8] == words[i:i + 8] for j in range(len(words) - 7)) > 1}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))
        assert want == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_letters_and_ties(session):
    assert [language.has_letter(t) for t in (None, "", "\u00bd \u2460 \u2167 7_", "\u00bd \u00e9", "\u4e2d")] == [False, False, False, True, True]
    same = [(i, "one two three four", lang, "s") for i, lang in enumerate(["b", "a", "b", "a"])]
    docs = session.createDataFrame(same, "doc_id long, text string, lang string, lang_pred string")
    coder = language.learn(docs, F.lit(True))
    assert {(r.lang_pred, r.ambiguous) for r in language.identified(docs, coder).collect()} == {("a", True)}


def test_language_against_plain_counts(session):
    """Trigram counts, bit weights and the nearest codeword, computed once more without Spark."""
    docs = session.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", fold("doc_id", 4).alias("held")).collect()
    counts = defaultdict(lambda: np.full(language.BUCKETS, 0.5))
    for r in rows:
        if not r.held and r.lang is not None and language.has_letter(r.text):
            np.add.at(counts[r.lang], language.grams(r.text), 1)
    names = sorted(counts)
    p = np.stack([counts[n] / counts[n].sum() for n in names])
    code = language.codewords(len(names))
    weights = np.stack([np.log(p[code[:, b] > 0].mean(0) / p[code[:, b] < 0].mean(0)) for b in range(code.shape[1])], 1)
    worth = np.clip((p @ weights) * code, 1e-3, None)
    worth /= worth.sum(1, keepdims=True)
    got = {r.doc_id: r for r in language.identified(docs, language.learn(docs, ~fold("doc_id", 4))).collect()}
    for r in rows:
        want = "und"
        if language.has_letter(r.text):
            margin = weights[language.grams(r.text)].mean(0)
            want = names[int(np.argmin((worth * np.log1p(np.exp(-language.SLOPE * margin * code))).sum(1)))]
        assert got[r.doc_id].lang_pred == want


def test_language(session):
    docs = session.read.parquet(f"{SMALL}/documents.parquet")
    coder = language.learn(docs, ~fold("doc_id", 4))
    rows = language.identified(docs, coder).join(docs.select("doc_id", "lang"), "doc_id").where(fold("doc_id", 4)).collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98
    found = language.identified(odd_docs(session), coder).collect()
    assert {r.lang_pred for r in found if r.doc_id in (0, 1, 2, 4)} == {"und"} and len(found) == len(ODD) + 3
    empty = language.learn(odd_docs(session, []), ~fold("doc_id", 4))
    assert {r.lang_pred for r in language.identified(odd_docs(session), empty).collect()} == {"und"}
    for n in (2, 4, 7, 20):
        code = language.codewords(n)
        assert len({tuple(c) for c in code}) == n


def test_spliced_token_counts(session):
    path = public_tokenizers.path("piece_bpe_32k.model")
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    small = token_counts.Counter(path, chunk=200, overlap=8)
    rng = random.Random(1)
    alphabets = ["abcdefgh    ", "的一是不了 在人有", "aàéü😀\n\t  ", "x", "thehean", " "]
    for alphabet in alphabets:
        for size in (401, 999, 3000):
            text = "".join(rng.choice(alphabet) for _ in range(size))
            assert small.counts([text]) == [len(whole.encode(text))], (alphabet, size)
    assert small.widened > 0
    rows = token_counts.counted(odd_docs(session), path).collect()
    assert {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (0, 1)} == {(0, 0)}
    assert token_counts.counted(odd_docs(session, []), path).count() == 0


def test_spliced_runs_inside_words():
    path = public_tokenizers.path("piece_bpe_32k.model")
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    small = token_counts.Counter(path, chunk=200, overlap=8)
    for c in ["a", "A", "=", "-", " ", "的", "ab", "\n", "é"]:
        for before in (1, 25, 26, 27, 40, 61):
            for run in (450, 1000, 1003):
                text = "some words " * before + c * run + " and more words" * 30
                assert small.counts([text]) == [len(whole.encode(text))], (c, before, run)


def test_mix(session):
    docs = odd_docs(session)
    rows = curriculum.mixed(docs).collect()
    assert len(rows) == docs.count()
    sizes = {True: 0}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    assert curriculum.mixed(odd_docs(session, [])).count() == 0
    # Water filling, step by step.
    source_sizes = {"a": 10, "b": 1000, "c": 5, "d": 400, None: 60}
    data = [(i, "w " * n, s) for i, (s, n) in enumerate(source_sizes.items())]
    got = curriculum.mixed(session.createDataFrame(data, "doc_id long, text string, source string")).collect()
    left, want, free = sum(source_sizes.values()), {}, dict(zip(source_sizes, (1, 2, 3, 1, 2), strict=True))
    while True:
        level = left / sum(free.values())
        over = [s for s, w in free.items() if level * w > 3 * source_sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * source_sizes[s]
            left -= want[s]
            del free[s]
    want |= {s: level * w for s, w in free.items()}
    assert {r.source: round(r.target, 6) for r in got} == {s: round(v, 6) for s, v in want.items()}
    for r in got:
        assert abs(r.taken - r.target) <= 1


def test_inverted_schedules(session):
    share = np.linspace(0, 1, 11)
    rows = session.createDataFrame([(float(s), k) for s in share for k in range(3)], "share double, kind int")
    for r in rows.withColumn("t", curriculum.inverted(F.col("share"), F.col("kind"))).collect():
        knots = curriculum.SCHEDULES[r.kind]
        grid = np.linspace(0, r.t, 2001)
        assert abs(np.trapezoid(np.interp(grid, *zip(*knots, strict=True)), grid) - r.share) < 1e-5


def brute_components(texts, width, percent):
    sets = {i: {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
            for i, w in ((i, words_of(t)) for i, t in texts.items())}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for a, b in {(a, b) for ids in where.values() for a in ids for b in ids if a < b}:
        k = len(sets[a] & sets[b])
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def test_text_ids(session):
    """Ids that are no numbers, in the operators that order or learn by them."""
    docs, labels = (session.read.parquet(f"{SMALL}/{t}.parquet").withColumn("doc_id", F.format_string("d%06d", "doc_id")) for t in ("documents", "labels"))
    got = {r.doc_id: r.component_id for r in minmax_dedup.deduplicated(docs).collect()}
    plain = session.read.parquet(f"{SMALL}/documents.parquet")
    assert got == {f"d{r.doc_id:06d}": f"d{r.component_id:06d}" for r in minmax_dedup.deduplicated(plain).collect()}
    for operator in (line_crf, toxicity):
        model = operator.learn(docs, labels, ~fold("doc_id", 4))
        assert operator.scored(docs, model).where("score BETWEEN 0 AND 1").count() == docs.count()


def test_near_duplicates(session):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, base = {}, [rng.choice(vocabulary) for _ in range(150)]
    for i in range(160):  # a large group of near copies, some too far, some only linked through others
        t = list(base if i % 4 or not i else texts[rng.choice(list(texts))].split())
        for _ in range(rng.choice([0, 1, 2, 3, 5, 7, 9])):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        texts[1000 - i] = " ".join(t)
    texts |= {i: t for i, t in enumerate(ODD)} | {20: "one", 21: "ONE"}
    docs = session.createDataFrame(list(texts.items()), "doc_id long, text string")
    for width, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: r for r in minmax_dedup.deduplicated(docs, width, percent).collect()}
        assert {i: r.component_id for i, r in got.items()} == brute_components(texts, width, percent)
        assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert minmax_dedup.deduplicated(odd_docs(session)).count() == len(ODD) + 3
    assert minmax_dedup.deduplicated(odd_docs(session, [])).count() == 0


@pytest.mark.parametrize("operator, label, least", [(line_crf, "quality", 0.9), (toxicity, "toxic", 0.9)])
def test_classifiers(session, operator, label, least):
    docs, labels = (session.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = operator.learn(docs, labels, ~fold("doc_id", 4))
    limit = 0.7 if label == "quality" else 0.3
    rows = operator.scored(docs, model).join(labels, "doc_id").where(fold("doc_id", 4)).collect()
    assert np.mean([(r.score >= limit) == r[label] for r in rows]) > least
    odd = operator.scored(odd_docs(session), model).collect()
    assert len(odd) == len(ODD) + 3 and all(0 <= r.score <= 1 for r in odd)
    nothing = operator.learn(docs, labels.limit(0), ~fold("doc_id", 4))
    assert all(0 <= r.score <= 1 for r in operator.scored(odd_docs(session), nothing).collect())
    assert operator.scored(odd_docs(session, []), model).count() == 0


def test_toxic_places(session):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        sentences = [" ".join(rng.choices(plain, k=8)) for _ in range(5)]
        if i % 5 == 0:
            sentences[3] += " vileness"
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(i % 5 == 0)))
    docs = session.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, session.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    for r in toxicity.scored(docs, model).collect():
        assert [p.sentence for p in r.places] == ([rows[r.doc_id][1].split(".")[3]] if r.doc_id % 5 == 0 else [])


def test_toxic_places_in_the_original(session):
    """Characters whose lower case is longer do not move the places."""
    weights = np.zeros(toxicity.BUCKETS)
    weights[list(toxicity._Buckets()["vile"])] = 5.0
    model = toxicity.Bags(weights, -5.0, (0.0, 1.0))
    texts = ["\u0130\u0130\u0130\u0130 here. A VILE word", "\u0130. \u00bd 7. Vile!\nnone", "fine. here"]
    docs = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(p.start, p.end, p.sentence) for p in r.places] for r in toxicity.scored(docs, model).collect()}
    assert got == {0: [(10, 22, " A VILE word")], 1: [(7, 12, " Vile")], 2: []}


def test_noisy_or_against_plain_sums(session):
    """Scores of a fitted model: sums over the features of each sentence, then noisy-or."""
    docs, labels = (session.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels, ~fold("doc_id", 4))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in toxicity.scored(docs, model).collect():
        clean, n = 1.0, 0
        for part in re.split(r"[.!?\n]", texts[r.doc_id] or ""):
            words = re.findall(r"[^\W\d_]+", part.lower())
            features = {b for w in words for b in toxicity._Buckets()[w]}
            if words:
                n += 1
                clean *= 1 - 1 / (1 + math.exp(-model.bias - sum(model.weights[b] for b in features)))
        odds = math.log(max(1 - clean, 1e-12) / max(clean, 1e-300)) if n else 0
        want = 1 / (1 + math.exp(-model.gain[0] - model.gain[1] * max(-20, min(20, odds)))) if n else 0.0
        assert abs(r.score - want) < 1e-6


def test_chain_marginals():
    """Forward-backward against the sum over all labellings."""
    rng = np.random.default_rng(0)
    model = line_crf.Chain(rng.normal(size=(3, line_crf.FEATURES + 1)), 0.2, (0.7, -0.3), (0, 1, 0))
    rows, _ = line_crf.lines_of("a b c\nTHE BIG ONE\n### 12\nwords here, again. words")
    z, total, bad = model.odds(rows), 0.0, np.zeros(len(rows))
    for code in range(1 << len(rows)):
        y = [(code >> i) & 1 for i in range(len(rows))]
        w = math.exp(sum(z[i] for i in range(len(y)) if y[i])
                     + sum(model.stay[a] for a, b in zip(y, y[1:], strict=False) if a == b))
        total += w
        bad += w * np.array(y)
    assert np.allclose(model.marginals(rows), bad / total)


def test_templates(session):
    items = [(1, "A train from Paris travels 120 km in 2 hours; how many km does the train travel in 5 hours at 120 km per leg?"),
             (2, "This sentence holds no values at all but is long enough to fill several windows of words."), (3, None), (4, "ok")]
    docs = [(1, "Before. A train from Paris travels 120 km in 2 hours; how many km does the train travel in 5 hours at 120 km per leg? After"),
            (2, "A train from Lyon travels 300 miles in 4 hours; how many miles does the train travel in 9 hours at 300 miles per leg?"),
            (3, "A train from Lyon travels 300 km in 4 hours; how many miles does the train travel in 4 hours at 777 km per leg?"),
            (4, "Clean words about the weather and the sea and nothing else that a question could ask for."),
            (5, "so this sentence holds no values at all but is long enough to fill several windows of words ok"), (6, None), (6, "")]
    bench = session.createDataFrame(items, "item_id long, text string")
    table = session.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in templates.contaminated(table, bench, consistency=0.9).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 2)}
    assert got[1, 1].replaced == 0 and got[2, 1].replaced > 0
    assert templates.contaminated(table.limit(0), bench).count() == 0
    assert templates.contaminated(table, bench.limit(0)).count() == 0
    assert templates.contaminated(odd_docs(session), bench).count() == 0


def test_templates_by_occurrence(session):
    train = "A train from Paris travels {} km in {} hours; how far does the same train travel in {} hours at that speed?"
    weeks = "In week 1 the shop sold {} kg of fresh apples to people. In week 2 the shop sold {} kg of fresh apples to people."
    bench = session.createDataFrame([(1, train.format(120, 2, 5)), (2, weeks.format(30, 45))], "item_id long, text string")
    split = train.replace("how far", "so please tell me now how far")
    docs = [(1, train.format(120, 2, 5) + " Or: " + train.format(300, 4, 9)),
            (2, train.format(300, 4, 9) + " Or: " + train.format(70, 3, 8)),
            (3, "Seen: " + weeks.format(30, 45)), (4, weeks.format(31, 77) + " And then. " + weeks.format(12, 13)),
            (5, split.format(300, 4, 9) + " Or: " + split.format(70, 3, 8))]
    table = session.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.replaced for r in templates.contaminated(table, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 1)}
    assert got[1, 1] == got[3, 2] == 0 and got[2, 1] == got[5, 1] == 3 and got[4, 2] == 2


def test_templates_short_items_and_runs(session):
    long = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400))
    named = "Every day Anna and Bert walk with Carl to see Dora while old Emil and young Fritz stay at home with Greta " * 2
    items = [(1, "What is 12 kg plus 7 kg?"), (2, "Who discovered penicillin?"), (3, "小明有三个苹果，他吃了一个。"), (4, long), (5, "ok"),
             (6, "1 + 2 + 3 + 4 + 5 + 6 + 7 + 9 + 11"), (7, named + long.replace("word", "term"))]
    part = long.split()
    docs = [(1, "Quiz: what is 12 kg plus 7 kg? Easy."), (2, "What is 12 kg plus 8 kg? And who discovered gravity?"),
            (3, "they asked who discovered penicillin and left"), (4, "问题小明有三个苹果，他吃了一个。答案"), (5, "小明有三个苹果"),
            (6, "so " + " ".join(part[100:113]) + " then"), (7, "so " + " ".join(part[100:112]) + " then"), (8, "fine\n ok.\nbye"), (9, "all is ok"),
            (10, "1 2 3 4 5 6 7 9 11"), (11, "1 2 3 4 5 6 7 9 12"),
            (12, named.replace("Anna", "Zoe").replace("Bert", "Yan").replace("Carl", "Xaver"))]
    got = templates.contaminated(session.createDataFrame(docs, "doc_id long, text string"),
                                 session.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 2), (4, 3), (6, 4), (8, 5), (10, 6), (12, 7)}


def test_notices(session):
    texts = ["Released under the MIT License.", "relesed undr the MIT licence", "Apache-License, Version 2 and CC-BY-NC!",
             "licensed under the gnu general public license version 3", "a mitten under the table", None, "cc by nc cc by nc"]
    got = [notices.Scanner().scan(t) for t in texts]
    assert [g[5] for g in got] == ["mit", "mit", "apache-2,cc-by-nc", "gpl-3", "", "", "cc-by-nc"]
    assert [g[1] for g in got] == [1, 0, 2, 0, 0, 0, 2] and got[6][2:4] == (0, 3) and got[2][2:4] == (0, 5)
    assert got[1][6] < 1 and got[1][7][0]["edits"] == 3
    # Notices side by side: the exact one does not hide those around it, and many of them take no longer each.
    near, exact = "relesed undr the mit licence", "released under the mit license"
    spans = notices.Scanner().scan(" ".join([near, exact, near, near]))[7]
    assert [(s["first_word"], s["last_word"], s["edits"]) for s in spans] == [(0, 4, 3), (5, 9, 0), (10, 14, 3), (15, 19, 3)]
    many = notices.Scanner().scan(" ".join([near, "and"] * 3000))
    assert len(many[7]) == 3000 and many[1] == 0
    assert notices.scanned(odd_docs(session)).count() == len(ODD) + 3
    assert notices.scanned(odd_docs(session, [])).count() == 0


def test_base_phrases_against_plain_search(session):
    rng = random.Random(8)
    pool = "under the mit license apache version 2 cc by nc x".split()
    texts = [rng.choice([" ", "-", "\n"]).join(rng.choice([w, w.upper()]) for w in rng.choices(pool, k=rng.randint(0, 80))) for _ in range(60)]
    texts += ["cc by nc cc by nc", "under the mit license under the mit license", None, "", "\u00e9cc by nc"]
    docs = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in notices.scanned(docs).collect():
        words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[r.doc_id] or "").encode().lower())]
        places = [(i, label) for phrase, label in notices.PHRASES.items() for i in range(len(words))
                  if words[i:i + len(phrase.split())] == phrase.split()]
        at, labels = [i for i, _ in places], {label for _, label in places}
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(at), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        assert labels <= set(r.labels.split(",")) | {""}


def test_seeds_lose_no_edited_notice():
    """An unseeded search of every pattern finds no label that the scan misses."""
    rng, scanner = random.Random(4), notices.Scanner()
    for n, label, k, pattern in scanner.notices:
        for _ in range(12):
            text = list(n)
            for _ in range(rng.randint(0, k)):
                at = rng.randrange(len(text))
                text[at:at + 1] = rng.choice([[], [rng.choice("abcxyz")], [text[at], "q"]])
            line = " ".join(f"see {''.join(text)} here".split())
            if any(m.end() == len(line) or line[m.end()] == " " for m in pattern.finditer(line)):
                assert scanner.scan(line)[7], line


def test_language_model(session):
    docs = session.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 150").unionByName(
        odd_docs(session).select("doc_id", "text", "lang", "source", F.lit(0).cast("long").alias("n_chars")))
    rows = context_mixing.scored(docs, ~fold("doc_id", 7), mixed_on=60).collect()
    data = docs.select("doc_id", "text", fold("doc_id", 7).alias("held")).collect()
    counts = Counter(w for r in data if not r.held for w in [*words_of(r.text), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted(round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words_of(r.text), None]), 5) for r in data)
    assert sorted(round(r.base_score, 5) for r in rows) == want and {r.train_tokens for r in rows} == {n}
    joined = context_mixing.scored(docs, ~fold("doc_id", 7), mixed_on=60, held_words=50).collect()
    assert sorted((round(r.base_score, 5), r.n_known, round(r.score, 4)) for r in joined) == sorted(
        (round(r.base_score, 5), r.n_known, round(r.score, 4)) for r in rows)
    assert context_mixing.scored(odd_docs(session, []), F.lit(True)).count() == 0


def test_language_model_sums_to_one():
    texts = ["the cat sat on the mat. " * 4, "a dog and a cat sat. "] * 20
    tally = context_mixing._Tally({})
    for t in texts:
        tally.add(t)
    tally.flush(0)
    model = context_mixing.mixer(tally.n, texts, {})
    for begin in (b" ", b" ca", b" the"):
        parts = [begin + bytes([b]) for b in range(256)]
        whole = model.costs(parts, 0) - model.costs([begin], 0)
        assert abs((10 ** whole).sum() - 1) < 1e-3


def test_pipeline(session):
    import corpus_pipeline
    rows = corpus_pipeline.run(session, "/root/testdata/sf0.001").collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows) and all(r.taken > 0 for r in rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = odd_docs(session)
        assert stage(session, docs, "/root/testdata/sf0.001").columns == docs.columns
