import random

import numpy as np

from tomeforge.llm import neardup as D
from tomeforge.runtime import written


def aligned(a, b):
    """Most distinct words of a, each where it stands first, that an alignment with b puts together."""
    first = {x: i for i, x in reversed(list(enumerate(a)))}
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[-1], row[j] + (x == y and first[x] == i)))
        row = new
    return row[-1]


def test_alignment():
    r = random.Random(3)
    a = [[r.randrange(9) for _ in range(r.randrange(1, 14))] for _ in range(300)]
    b = [[r.randrange(9) for _ in range(r.randrange(1, 14))] for _ in range(300)]
    b[0], a[0], b[1], a[1] = list(range(2)), list(range(40)), list(range(30)), list(range(3))
    got = D.banded_matches(a, b, 14)
    assert got.tolist() == [aligned(x, y) for x, y in zip(a, b)]
    assert all(n <= len(set(x) & set(y)) for n, x, y in zip(D.banded_matches(a, b, 1), a, b))


def test_alignment_accepts_edits_and_the_count_only_what_moved(monkeypatch):
    r = random.Random(4)
    vocab = range(5000)
    a, b, c = [], [], []
    for _ in range(40):
        w = r.sample(vocab, 60)
        a.append(w)
        b.append([x for x in w if r.random() > 0.05] + r.sample(vocab, 3))
        c.append(w[45:] + w[:45])
    assert D.verify(a, b, 0.6)[1].all()
    share, accepted = D.verify(a, c, 0.9)
    assert not accepted.any() and (share == 1).all()


def corpus(seed=5, n=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)]
    rows, i = [], 0
    for book in range(n // 8):
        for _ in range(8):
            rows.append([i, book, " ".join(r.choice(vocab) for _ in range(40))])
            i += 1
    for src in range(40):  # edited copies: words changed, a block moved
        w = rows[src][2].split()
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = r.choice(vocab)
        cut = r.randrange(len(w))
        rows.append([i, 100 + src // 8, " ".join(w[cut:] + w[:cut])])
        i += 1
    rows += [[i, 200, rows[0][2].upper()], [i + 1, 200, None], [i + 2, 200, " .. "], [i + 3, None, rows[1][2]], [i + 4, 200, "one"], [i + 5, 200, "One!"]]
    return [tuple(x) for x in rows]


def brute(rows, least=0.6):
    sets = [(i, set(D.WORD.findall(t.lower()))) for i, _, t in rows if t and D.WORD.findall(t.lower())]
    return {(min(i, j), max(i, j)) for n, (i, x) in enumerate(sets) for j, y in sets[:n] if i != j and len(x & y) >= least * len(x | y)}


def members(rec):
    return rec.groupBy("book_id", "class").agg(D.F.count(D.F.lit(1)).alias("n"))


def test_pairs_against_brute_force(spark, monkeypatch):
    rows = corpus()
    for heavy in (D.HEAVY, 3):
        monkeypatch.setattr(D, "HEAVY", heavy)
        data = rows + ([(5000 + i, 300 + i, f"a b c d e f g h x{i} y{i}") for i in range(12)] if heavy == 3 else [])
        df = spark.createDataFrame(data, "id long, book_id long, raw_text string")
        rec = written(D.records(df, "id", "raw_text", ["book_id"]), "t")
        classes = written(D.similar_classes(rec), "l")
        found = D.pairs(rec.select("id", "book_id", "class").distinct(), classes, "book_id")
        got = {(r.id_a, r.id_b) for r in found.collect()}
        want = brute(data)
        assert got <= want and len(got) >= 0.99 * len(want)
        books = {(r.a, r.b) for r in D.similar_groups(members(rec), classes, "book_id").collect()}
        of = {i: (book, t) for i, book, t in data if t and D.WORD.findall(t.lower())}
        partners = {}
        for x, y in want:
            for i, j in ((x, y), (y, x)):
                if of[i][0] is not None and of[j][0] is not None and of[i][0] != of[j][0]:
                    partners.setdefault((of[i][0], of[j][0]), set()).add(i)
        size = {k: sum(book == k for book, _ in of.values()) for k, _ in of.values()}
        assert books == {(k, m) for k, m in partners if k < m and 2 * len(partners[k, m]) >= size[k] and 2 * len(partners.get((m, k), ())) >= size[m]} and {(k, 100 + k) for k in range(5)} & books


def test_empty(spark):
    df = spark.createDataFrame([], "id long, book_id long, raw_text string")
    rec = written(D.records(df, "id", "raw_text", ["book_id"]), "t")
    assert D.similar_classes(rec).count() == 0


def linked(spark, texts, label="t"):
    """Pairs of texts, by number, that similar_classes() links."""
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "id long, book_id long, raw_text string").repartition(4)
    rec = written(D.records(df, "id", "raw_text", ["book_id"]), label)
    number = {D.class_of(D.word_hashes(t)): i for i, t in enumerate(texts)}
    return {tuple(sorted((number[r.a], number[r.b]))) for r in D.similar_classes(rec).select("a", "b").collect()}


def test_edited_group_of_a_third(spark, monkeypatch):
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [r.choice(vocab) for _ in range(50)]
    for n in (600, 1500):
        texts = []
        for i in range(n // 3):  # two new words each, so no two are equal
            w = list(passage)
            for j, at in enumerate(r.sample(range(50), 2)):
                w[at] = f"edit{i}x{j}"
            texts.append(" ".join(w))
        texts += [" ".join(r.choice(vocab) for _ in range(50)) for _ in range(n - len(texts))]
        want = brute([(i, 0, t) for i, t in enumerate(texts)])
        assert len(want) == (n // 3) * (n // 3 - 1) // 2
        found = linked(spark, texts)
        assert found <= want and len(found) >= 0.9995 * len(want)
    monkeypatch.setattr(D, "HEAVY", 100)
    assert linked(spark, texts) == found


def test_scattered_edits_and_short_texts(spark):
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(2000)]
    texts = []
    for step in (4, 5, 6):  # every 4th, 5th, 6th of 60 words changed: 0.60, 0.67, 0.71
        for i in range(20):
            w = r.sample(vocab, 60)
            texts += [" ".join(w), " ".join(f"e{step}x{i}x{k}" if k % step == 1 else x for k, x in enumerate(w))]
    for n in range(3, 13):
        for i in range(5):
            w = r.sample(vocab, n)
            v = [*w[: n // 2], f"s{n}x{i}", *w[n // 2 :]]  # a word added, the rest in another order
            texts += [" ".join(w), " ".join(v[::-1])]
    found = linked(spark, texts)
    for least, part in ((0.599, 0.8), (0.66, 0.95), (0.7, 0.98)):
        want = {(i, j) for i, j in brute([(i, 0, t) for i, t in enumerate(texts)], least) if j < 120}
        assert len(want & found) >= part * len(want), least
    short = {(i, j) for i, j in brute([(i, 0, t) for i, t in enumerate(texts)]) if i >= 120}
    assert len(short) >= 40 and short <= found
