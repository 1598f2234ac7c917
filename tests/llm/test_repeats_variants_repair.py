"""Fixed-block repeats, spelling variants and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from readtrace.llm import audit_repair, fixed_blocks, queries, spelling, word_hash
from readtrace.llm.common import prepared

SPACE = " \t\n\r\x0b\x0c"


@pytest.fixture(scope="module")
def session(spark):
    return prepared(spark)


def words_of(text):
    return (text or "").encode().split()


# ---- repeats


def repeats_by_force(docs, window):
    """doc -> (n_words, n_removed, digest); docs: distinct ids to texts."""
    seen, out = set(), {}
    for key in sorted(docs, key=lambda k: (k is not None, k)):
        words = words_of(docs[key])
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i:i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        left = [w for i, w in enumerate(words) if i not in gone]
        out[key] = (len(words), len(gone), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


@pytest.mark.parametrize("map_bits", [1 << 29, 1 << 12])
def test_repeats(session, map_bits):
    rng = random.Random(map_bits)
    passages = [[rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.randint(5, 60))] for _ in range(6)]
    docs = {None: "a b c d " * 9, 1: None, 2: "", 3: " \n\t", 4: "one", 5: "x " * 70, 6: "Word x word " * 20}
    for i in range(7, 60):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            words += p[a:a + rng.randint(1, 60)] if rng.random() < 0.7 else [rng.choice("ab") for _ in range(rng.randint(1, 30))]
        docs[i * 3] = " ".join(words)
    for window in (20, 6):
        rows = [(k, t, -1, "clash") for k, t in docs.items()]
        df = session.createDataFrame(rows + rows[5:6], "doc_id long, text string, n_words long, first string").repartition(5)
        found = fixed_blocks.deduplicated(df, window, map_bits=map_bits).collect()
        expected = repeats_by_force(docs, window)
        assert len(found) == len(rows) + 1
        for r in found:
            assert (r.n_words, r.n_removed, r.kept_sha256) == expected[r.doc_id]
            assert sum(s.last_word - s.first_word + 1 for s in r.repeats) == r.n_removed
    assert fixed_blocks.deduplicated(df.limit(0)).count() == 0
    named = fixed_blocks.deduplicated(df.where("doc_id > 6").select(F.format_string("d%05d", "doc_id").alias("key"), F.col("text").alias("body")),
                                      id_col="key", text_col="body").collect()
    expected = repeats_by_force({f"d{k:05}": t for k, t in docs.items() if k is not None and k > 6}, 20)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in named} == expected


def test_steps_of_long_texts(monkeypatch):
    monkeypatch.setattr(fixed_blocks, "_CHARS", 7)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \né") for _ in range(n)) for n in (0, 5, 40, 300)]
    assert [sum(fixed_blocks.words(t), []) for t in texts] == [t.encode().split() for t in texts]
    whole = fixed_blocks._Steps(texts, [fixed_blocks.Base(0)], 6)
    anchors = [h[w & a] for _, n, h, w, a in whole]
    held = fixed_blocks.np.zeros(1 << 9, fixed_blocks.np.uint8)
    for h in anchors[0].tolist()[::2]:
        b = h & ((1 << 12) - 1)
        held[b >> 3] |= 1 << (b & 7)
    at_once = fixed_blocks.np.concatenate(list(whole.candidates(held)))
    monkeypatch.setattr(fixed_blocks, "_STEP", 13)
    assert fixed_blocks.np.concatenate(list(whole.candidates(held))).tolist() == at_once.tolist()
    for size in (1, 3, 10, 20):
        h = fixed_blocks.rolling(whole.ids, size)
        assert len(h) == max(0, len(whole.ids) - size + 1)
        same = defaultdict(set)
        for i, v in enumerate(h.tolist()):
            same[v].add(tuple(whole.ids[i:i + size].tolist()))
        assert all(len(s) == 1 for s in same.values()) and len(same) == len({tuple(whole.ids[i:i + size].tolist()) for i in range(len(h))})


def test_word_hashes(monkeypatch):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcé日") for _ in range(n)) for n in (*range(1, 40), 22, 64, 65, 66, 200, 5000)]
    texts = [None, "", " ", *(rng.choice(" \n\t").join(rng.choices(vocabulary, k=rng.randint(0, 300))) for _ in range(40)), "é" * 9000 + " a " + "b" * 7000]
    bases = [word_hash.Base(0), word_hash.Base(1)]
    (a, b), counts = word_hash.word_hashes(texts, bases)
    every = [w for t in texts for w in words_of(t)]
    assert counts.tolist() == [len(words_of(t)) for t in texts] and len(a) == len(b) == len(every)
    for h in (a, b):
        known = dict(zip(every, h.tolist(), strict=True))
        assert [known[w] for w in every] == h.tolist() and len(set(known.values())) == len(known)
    assert (a != b).all()
    monkeypatch.setattr(word_hash, "STRETCH", 100)
    (again, _), counts_again = word_hash.word_hashes(texts, bases)
    assert again.tolist() == a.tolist() and counts_again.tolist() == counts.tolist()


# ---- spelling


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    if len(x) > len(y):
        x, y = y, x
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def forms_by_force(times):
    links = {w: [v for v in times if near(w, v)] for w in times}
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda v: (-times[v], v), default=None)
        form[w] = best if best and times[best] >= 2 * times[w] else None
    out = {}
    for w in times:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, times[w], len(links[w]), times[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("most", [20_000, 3])
def test_spelling_pairs(session, most):
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(260)}
    words |= {"samebeginning" + "".join(rng.choice("xyz") for _ in range(3)) for _ in range(25)} | {"aaaaa", "aaaaaa", "aaaaaaa"}
    times = {w: rng.choice((3, 4, 7, 15, 31, 64, 130)) for w in words}
    df = session.createDataFrame(list(times.items()), "word string, n long")
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.grouped(df, most=most).collect()}
    assert found == forms_by_force(times)
    assert any(f[0] and f[1] != f[0] for f in found.values())


def test_spelling_of_texts(session, monkeypatch):
    rng = random.Random(5)
    base = ["house", "houses", "mouse", "straße", "Étoile", "Maison", "maisons", "tiny", "x"]
    texts = [None, "", "...", "x" * 4000, *(" ".join(rng.choices(base, k=rng.randint(1, 300))) for _ in range(60))]
    rows = [(i if i != 9 else None, t, 1, "w") for i, t in enumerate(texts)]
    rows += rows[7:8]
    times = Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "")):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            times[run] += 1
    expected = forms_by_force({w: n for w, n in times.items() if len(w) >= 5 and n >= 3})
    df = session.createDataFrame(rows, "doc_id long, text string, n long, word string")
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect()} == expected
    assert spelling.variants(df.limit(0)).count() == 0
    whole = list(spelling.runs(texts[10]))
    monkeypatch.setattr(spelling, "_CHARS", 3)
    assert sum(spelling.runs(texts[10]), []) == sum(whole, [])


# ---- conversations


def told(rows):
    """Faults of rows (turn, role, text), sorted as the operator sorts them."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
    seen, out = set(), []
    for turn, role, text in rows:
        kind = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "" if text.rstrip(SPACE)[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((turn, role, text, kind))
    return out


def repaired_by_force(rows, inserts=2):
    """Cheapest edits by trying all of them, at most ``inserts`` in each gap."""
    rows = told(rows)
    best = [(3 * len(rows), "D" * len(rows), "")]

    def consider(i, roles, cost, audit, lines, put):
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (cost, audit) < best[0][:2]:
            best[0] = (cost, audit, "\n".join(lines))
        if cost > best[0][0]:
            return
        if put < inserts:
            for role in ("user", "assistant"):
                consider(i, roles + role[0], cost + 2, audit + "I", [*lines, f"{role}:"], put + 1)
        if i < len(rows):
            _, role, text, kind = rows[i]
            consider(i + 1, roles, cost + 3, audit + "D", lines, 0)
            if kind not in ("blank", "duplicate"):
                late = kind == "truncated"
                if role:
                    consider(i + 1, roles + role[0], cost + late, audit + "K", [*lines, f"{role}:{text}"], 0)
                for other in ("user", "assistant"):
                    consider(i + 1, roles + other[0], cost + 2 + late, audit + "R", [*lines, f"{other}:{text}"], 0)

    consider(0, "", 0, "", [], 0)
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    kinds = Counter(r[3] for r in rows)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds["blank"], kinds["duplicate"], kinds["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), best[0][0], best[0][1],
            hashlib.sha256(best[0][2].encode()).hexdigest())


def result(r):
    return r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256


@pytest.mark.parametrize("piece_rows", [20_000, 1, 2])
def test_repair(session, piece_rows):
    rng = random.Random(piece_rows)
    texts = ["a.", "b!", "cut", "", " \n", "d?\n", "line\nbreak."]
    data, groups = [], {}
    for c in range(90):
        groups[c] = [(rng.choice((None, *range(6))), rng.choice(("user", "assistant", "system", "tool", "", "u")), rng.choice(texts))
                     for _ in range(rng.randint(0, 5))]
        data += [(f"c{c}", c, *r) for r in groups[c]] + [(f"c{c}", c, None, None, None)]
    df = session.createDataFrame(data, "conv string, conv_id long, turn long, role string, text string").repartition(7)
    found = audit_repair.repaired(df, piece_rows).collect()
    assert {r.conv_id: result(r) for r in found} == {c: repaired_by_force(rows) for c, rows in groups.items()}
    assert len(found) == len(groups)


def test_long_conversations_in_pieces(session):
    rng = random.Random(8)
    rows = [("c1", "one", i // 3 if i % 50 else None, rng.choice(("user", "assistant", "assistant", "system")), rng.choice(("a.", "b", "")) + f"{rng.randint(0, 400)}.")
            for i in range(3000)]
    rows += [("c2", "two", 7, "user", "same.")] * 500  # one row many times
    df = session.createDataFrame(rows, "conv string, conv_id string, turn long, role string, text string")
    whole = sorted(result(r) for r in audit_repair.repaired(df.coalesce(1)).collect())
    cut = sorted(result(r) for r in audit_repair.repaired(df.repartition(9), 37).collect())
    assert whole == cut and len(whole) == 2 and {len(w[6].replace("I", "")) for w in whole} == {3000, 500}


def test_ties_survive_hash_collisions():
    rng = random.Random(4)
    for modulus in (1, 2, 7, audit_repair._MODULUS):
        for _ in range(300):
            rows = [(rng.choice(("s", "u", "a", "")), rng.choice((0, 1, 2))) for _ in range(rng.randint(0, 30))]
            trails = audit_repair.Trails(modulus)
            cells, plain = [(0, 0), None, None, None], [(0, ""), None, None, None]
            for c, kind in rows:
                moves = audit_repair._MOVES[c, kind]
                cells = audit_repair.advance(trails, cells, moves)
                plain = [min(((plain[q][0] + cost, plain[q][1] + label) for q, to, cost, label in moves if to == s and plain[q]), default=None)
                         for s in range(4)]
            assert [c and (c[0], trails.text(c[1])) for c in cells] == plain


def test_damage_and_odd_values(session):
    rows = [(c, t, r, x, "clash", 1) for c in (None, 0, 1, 2, 3) for t in (None, *range(9)) for r, x in (("user", "Hi. You?"), (None, None))]
    df = session.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, n long")
    found = {r.conv_id: r for r in audit_repair.repaired(audit_repair.damaged(df)).collect()}
    assert set(found) == {None, 0, 1, 2, 3}
    for conv, r in found.items():
        left = []
        for c, t, role, text, *_ in rows:
            if c != conv:
                continue
            role, text = role or " ", text or " "
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if h:
                text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
                left += [(t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
        marks = told(left)
        assert (r.blank, r.duplicate, r.truncated) == tuple(sum(m[3] == k for m in marks) for k in ("blank", "duplicate", "truncated"))
        assert len(r.audit.replace("I", "")) == len(left)
    gone = [(c, t, "user", "x.") for c in range(200) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    empty = audit_repair.repaired(audit_repair.damaged(session.createDataFrame(gone, "conv_id long, turn long, role string, text string"))).collect()
    assert len(empty) == len({c for c, *_ in gone}) and {result(r) for r in empty} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert audit_repair.repaired(audit_repair.damaged(df.limit(0))).count() == 0


def test_checksum_in_sql():
    import duckdb
    texts = ["", "a", "5:été", " : ", "x" * 50]
    for t in texts:
        sql = f"SELECT {queries._crc_sql('t')} FROM (SELECT '{t}' AS t)"
        assert duckdb.connect().execute(sql).fetchall()[0][0] == (zlib.crc32(t.encode()) if t else 0)
