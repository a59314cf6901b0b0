import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tomeforge.llm import scans as S

COUNTS = {w: 100 for w in "старый переплёт хранит печатную книгу рядом с окном роман сравнивает словарь егжей тегжейлі the humble legend sharp bread door".split()}


def known(counts, words):
    """What readings() tells of words, by brute force."""
    return {w: (counts.get(w, 0), [(p, n, S.glyph_edits(w, p)) for p, n in counts.items() if n > counts.get(w, 0) and p != w and S.glyph_edits(w, p)]) for w in words}


def mend(text, header=frozenset(), vectors=None, counts=COUNTS):
    joined, kinds = S.body(text, set(header))
    r = S.Reader(known(counts, S.asked(joined) | set(counts)), vectors or {}, sum(counts.values()))
    return S.repair(joined, kinds, r)


def test_repair():
    text, kinds = mend("— 12 —\r\nСтарый пере-\r\nплёт хранит печатну10 книгу\r\nрядом с 0кном. Рома¬\r\nн сравниваег словарь.")
    assert text == "Старый переплёт хранит печатную книгу рядом с окном. Роман сравнивает словарь." and kinds == {"page_number", "hyphenation", "misread"}
    text, kinds = mend("Глава 1. Роман\nегжей-\nтегжейлі словарь, шифр К13-97, 1999 год")
    assert kinds == set() and "егжей-тегжейлі" in text
    assert mend("1) Старый роман.\n2) Старый словарь.") == ("1) Старый роман.\n2) Старый словарь.", set())
    text, kinds = mend("BOOK   7\nthe hum6|e legend, cloor", {0})
    assert text == "the humble legend, door" and kinds == {"header", "page_number", "misread"}


@settings(max_examples=300, deadline=None)
@given(st.text("сегтплцниыью0ш1l|iшdmrvw6бabв", min_size=2, max_size=9), st.data())
def test_glyph_edits_keep_the_skeleton(printed, data):
    word, at, edits = "", 0, 0
    while at < len(printed):
        options = [(wrong, right) for wrong, rights in S.GLYPHS.items() for right in rights if printed.startswith(right, at)]
        if options and edits < 3 and data.draw(st.booleans()):
            wrong, right = data.draw(st.sampled_from(options))
            word, at, edits = word + wrong, at + len(right), edits + 1
        else:
            word, at = word + printed[at], at + 1
    assert S.skeleton(word) == S.skeleton(printed)
    assert (S.glyph_edits(word, printed, 3) or 0) <= edits


def test_readings_against_brute_force(spark):
    counts = {"рост": 3000, "роет": 900, "рое": 5, "door": 40, "ю": 9, "печатную": 50, "ст": 4, "ет": 6}
    asked = [*counts, "печатну10", "cloor", "10", "x" * 3000, "гост", "роот"]
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n, sorted(tuple(o) for o in r.options or ())) for r in S.readings(spark.createDataFrame([(w,) for w in asked], "word string"), table).collect()}
    want = {w: (n, sorted(o) if sum(c.isalpha() for c in w) > 1 else []) for w, (n, o) in known(counts, asked).items()}
    assert got == want


def test_a_lawful_word_stays_at_every_size():
    """900 against 3000 occurrences is no misreading, nor is it with a hundred or a million times as many."""
    for times in (1, 100, 10**6):
        counts = {"рост": 900 * times, "роет": 3000 * times, "стол": 10**6 * times}
        r = S.Reader(known(counts, counts), {}, sum(counts.values()))
        assert r.read(["рост"], 0) is None
        counts = {"рост": 3 * times, "роет": 3000 * times, "стол": 10**6 * times}
        assert S.Reader(known(counts, counts), {}, sum(counts.values())).read(["рост"], 0) == "роет"


def test_context_decides():
    v = {k: np.array(x) for k, x in {"тень": [1.0, 0.0], "пень": [0.0, 1.0], "лень": [0.0, 1.0], "слово": [-1.0, 0.0], "дом": [1.0, 0.0], "лес": [0.0, 1.0]}.items()}
    counts = {"тень": 1000, "гень": 9, "дом": 50, "слово": 50, "лес": 50, "лень": 400, "цень": 400, "пень": 2}
    r = S.Reader(known(counts, counts), v, sum(counts.values()))
    assert r.read(["дом", "гень"], 1) == "тень" and r.read(["слово", "гень"], 1) is None
    # of two words as frequent the one that fits is chosen; without vectors only the spelling would
    v |= {"цень": np.array([1.0, 0.0])}
    r = S.Reader(known(counts, counts), v, sum(counts.values()))
    assert r.read(["лес", "пень"], 1) == "лень" and r.read(["дом", "пень"], 1) == "цень"
    blind = S.Reader(known(counts, counts), {}, sum(counts.values()))
    assert blind.read(["лес", "пень"], 1) == blind.read(["дом", "пень"], 1)


def tables(spark, times=1):
    books = spark.createDataFrame([(1, "Слово о саде", "Иван Листов", 0), (2, None, None, 0)], "id long, title string, author string, page int")
    body = "Старый роман сравнивает словарь и хранит\nпечатную книгу рядом с окном."
    rows = [(500 + i, 9, body.replace("\n", " "), None) for i in range(400)]
    rows += [(1, 1, f"Слово о садде\n{body}", 1), (2, 1, f"12   ИВАН ЛИСТОВ\n{body}", 2), (3, 1, f"Глава 1. Старый роман\n{body}", 3), (4, 2, f"{body}\nстр. 4", 4), (5, 2, None, 5), (6, 2, "", 6), (7, 2, body.replace("роман", "р0ман"), 7), (7, 2, body.replace("роман", "р0ман"), 7), (8, 3, body.replace("печатную", "псчатную"), 8)]
    return spark.createDataFrame([(i + 1000 * t, book + 10 * t, *r) for t in range(times) for i, book, *r in rows], "id long, book_id long, raw_text string, page int"), books


@pytest.mark.parametrize("times", [1, 20])
def test_chunks(spark, times):
    chunks, books = tables(spark, times)
    got = {r.id: set(r.noise) for r in S.repaired(chunks, books).collect() if r.id < 1000}
    assert got == {1: {"header"}, 2: {"header", "page_number"}, 3: set(), 4: {"page_number"}, 5: set(), 6: set(), 7: {"misread"}, 8: {"misread"}}
    assert S.repaired(chunks.limit(0), books).count() == 0
