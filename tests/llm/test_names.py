from collections import Counter
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from tomeforge.llm import names as N

AUTH = [
    (1, "person", "Сергей Климович Дромматенко"), (2, "person", "Татьяна Львовна Яснарина"), (3, "person", "Gilbert Pellwenham"), (4, "person", "Жандос Есенңғаров"),
    (5, "organisation", "Типография Кедровый мост"), (6, "organisation", "Copper Quill Press"), (7, "organisation", "Якты бит Җәмгыять"),
    (8, "work", "The Worn Report of the Silver Grove"), (9, "work", "Спорное руководство весенней воды"), (10, "work", "Заметки о счёте, II"), (11, "person", "Сергей Львович Дромматенко"),
]


def osa(a, b):
    d = {}
    for i in range(-1, len(a)):
        for j in range(-1, len(b)):
            if i < 0 or j < 0:
                d[i, j] = max(i, j) + 1
                continue
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=12), st.text("abc", min_size=1, max_size=6), st.integers(0, 2))
def test_trie_against_brute_force(words, word, most):
    t = N.Trie()
    for w in words:
        t.add(w)
    assert t.near(word, most) == {w: osa(word, w) for w in set(words) if osa(word, w) <= most}


def test_variants():
    linker = N.Linker(AUTH)

    def link(field, name):
        found = linker.link(field, name)
        return found[2].pop() if found and len(found[2]) == 1 else None

    for name, want in {
        "дромматенко, сергей климович": 1, "С.К. Дромматенко": 1, "Дромматенок С. К.": 1, "Сергей Дромматенко": None, "Яснарина Т.": 2, "Таня Яснарина": 2, "Yasnarina, T.L.": 2, "Tatyana Yasnarina": 2, "Татьяна Ясчанина": None,
        "PELLWENHAM GILBERT": 3, "Dr Gilbert Pelwenham": 3, "Esenngarov, Zh.": 4, "тип. Кедрофый мост": 5, "«Кедровый мост», Типогр.": 5, "Кедровый мост": 5, "Pr. Copper Quill": 6, "Yakty bit Jamgyyat": 7, "Институт Кедровый мост": None, "": None, " ": None, None: None, "Иван": None,
    }.items():
        assert link("author", name) == want, name
    for name, want in {
        "the_worn_report_of_the_silver_grove": 8, "Worn Report of Silver Grove": 8, "The Wron Report of the Silver Grove, abridged": 8, "The Worn. Report of the Silver Grove": 8, "весенней воды Спорное руководство [скан]": 9, "Spornoe rukovodstvo vesenney vody": 9,
        "Спорное руководство весенней воды (2-е изд., испр.)": 9, "Спорное руководство": None, "Заметки о счёте, III": None, "Заметки о счете,  II": 10, "x" * 5000: None,
    }.items():
        assert link("title", name) == want, name


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=6), st.lists(st.dictionaries(st.sampled_from("abcd"), st.integers(0, 2), max_size=3), min_size=1, max_size=5), st.integers(0, 3))
def test_orders_against_permutations(target, options, n_must):
    must = target[:n_must]
    best = None
    for places in permutations(range(len(target)), len(options)) if len(options) <= len(target) else ():
        if all(target[p] in o for p, o in zip(places, options)) and not Counter(must) - Counter(target[p] for p in places):
            cost = sum(o[target[p]] for p, o in zip(places, options))
            best = cost if cost <= N.MOST_EDITS and (best is None or cost < best) else best
    assert N.fewest_edits(target, options, must) == best


def test_names_of_any_length():
    long = "Анна Мария Луиза Шарлотта Августа Вильгельмина Зальцбургская"
    linker = N.Linker([(1, "person", long), (2, "person", "Иван Иван Иван Иван Иван Иван Иван Иван Иван Иван Иван Петров")])
    assert linker.link("author", "Зальцбургская, Мария Анна Луиза Августа Шарлотта В.") == (N.OWN, 0, {1})
    assert linker.link("author", "Петров " + "Иван " * 11)[2] == {2} and linker.link("author", "Петров " + "Иван " * 12) is None


def test_table(spark):
    auth = spark.createDataFrame([(*a, "x") for a in AUTH] + [(12, "person", None, "x")], "entity_id long, kind string, name string, field string")
    names = spark.createDataFrame([("author", "Gilbert Pellwenham"), ("author", "Pellwenham G."), ("author", "Pellwenham G."), ("author", None), ("title", "")], "field string, name string")
    got = {(r.name, r.entity_id, r.edits, r.variant) for r in N.link_names(names, auth).collect()}
    assert got == {("Gilbert Pellwenham", 3, 0, False), ("Pellwenham G.", 3, 0, True)}
    assert {(r.name, r.entity_id, r.edits, r.variant) for r in N.link_names(names, auth, shard_entities=3).collect()} == got
    # a tie between entities of different shards links to none
    twins = spark.createDataFrame([(k, "person", f"Ann Gray{c}") for k, c in ((1, "son"), (2, "sen"))], "entity_id long, kind string, name string")
    typed = spark.createDataFrame([("author", "Ann Graysin"), ("author", "Ann Grayson")], "field string, name string")
    assert all({(r.name, r.entity_id) for r in N.link_names(typed, twins, shard_entities=n).collect()} == {("Ann Grayson", 1)} for n in (1, 2))
    assert N.link_names(names.limit(0), auth).count() == 0 and N.link_names(names, auth.limit(0)).count() == 0
