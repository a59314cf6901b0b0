from tomeforge.llm import privacy as P


def kinds(text):
    return [(k, text[a:b]) for a, b, k in P.protected(text) if k != "link"]


def test_patterns():
    assert kinds("Пишите: a.b+c@post.knigochey.test. или x_y [at] inbox [dot] test, v.k (собака) lib-friends.example, p @ reader.test; бот @open_bot") == [
        ("email", "a.b+c@post.knigochey.test"), ("email", "x_y [at] inbox [dot] test"), ("email", "v.k (собака) lib-friends.example"), ("email", "p @ reader.test"),
    ]
    for phone in ("+7 (146) 661-85-67", "8(143)0690983", "8-103-658-14-23", "+71746739069", "+7.117.362.37.05", "8 142 456 37 90", "+1-246-555-0131", "(281) 555-0101", "07700 900 896", "020 7946 0086", "+44 7700 900245", "+7 143 7013901"):
        assert kinds(f"Звонили ({phone}, доб. 12), обещали") == [("phone", phone)], phone
    for other in ("ISBN 978-5-1416-8515-4, УДК 94(47).043.", "Заказ 644-542-31 закрыт, сумма 3650 р.", "Счёт 7739 5609 оплачен", "Инвентарный номер 4386632034, шкаф 21", "https://catalog.example/books/4095218", "1917–1922, листы 77-347", "Лунный Переплёт в Заозёрске, 1999"):
        assert kinds(other) == [], other
    for label, number in (("паспорт серии ", "00 51 336816"), ("ИНН ", "007595685443"), ("снилс: ", "001-992-780 72"), ("удостоверение ", "КН-534018"), ("NI number ", "QQ 33 22 75 D"), ("ID card ", "Z6877829L"), ("passport no ", "005048958"), ("жеке куәлік ", "9815 6451 4119")):
        assert kinds(f"указан {label}{number}. Далее") == [("id_number", number)], number
    for street in ("ул. Паромная, д. 16, кв. 9", "ул.Мельничная 7-64", "Глухой Брод ул., 47, кв. 6", "пер. Глухой Брод, дом 75 корп. 2", "наб. Старая Пристань 28к1, оф. 30", "пр-т Камышовая, д.98", "Жиделі көшесі, 137-үй, 70-пәтер", "Жиделі к-сі 80/7", "Зәңгәр урамы, 120 йорт, 15 фатир", "Кичү ур., 39-92", "Flat 34, 123 Lantern Lane", "47B Ferryman's Road, Apt 2"):
        assert kinds(f"000610, г. Заозёрск, {street}. Далее")[-1] == ("address", street), street


def corpus():
    names = [(g, s) for g in ("Талғат", "Зөфәр", "Ирина", "Gilbert") for s in ("Есенов", "Юлдашев", "Мергенов", "Pellwick")]
    rows = [f"Читатель {g[0]}. {s} просит, {g} {s} ждёт, тел 8 142 456 37 9{i % 10}. Старый том лежит." for i, (g, s) in enumerate(names * 3)]
    rows += ["Старый том лежит в зале. Мастерская «Лунный Переплёт» открыта."] * 40
    return rows


def test_names_learned(spark):
    texts = corpus() + ["меня зовут талғат юлдашев. Жду", "спросить ЗӨФӘР МЕРГЕНОВ", "Ждёт Есенов Талғат Старый том", "Передайте книгу Ирине Крыловой, если", None, "", "Старый том " * 20_000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "id long, text string, name int").select("id", "text")
    out = {r.id: r for r in P.sanitised(df).collect()}
    n = len(corpus())
    assert [f.pii_text for f in out[0].found] == ["Т. Есенов", "Талғат Есенов", "8 142 456 37 90"]
    assert out[0].text == "Читатель [NAME] просит, [NAME] ждёт, тел [PHONE]. Старый том лежит."
    assert [[f.pii_text for f in out[n + k].found] for k in range(4)] == [["талғат юлдашев"], ["ЗӨФӘР МЕРГЕНОВ"], ["Есенов Талғат"], ["Ирине Крыловой"]]
    assert out[n + 4].text is None and out[n + 5].text == "" and out[n + 6].text == texts[-1] and not out[n - 1].found
    assert P.sanitised(df.limit(0)).count() == 0


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r.id: [f.pii_text for f in r.found if f.pii_type == "name"] for r in P.sanitised(df).collect()}


def test_protected_entities_reveal_the_names(spark):
    """The same sentences with and without what reveals: terms that go with nothing protected disclose nobody."""
    pairs = [(g, s) for g in ("Анвур", "Белиз", "Вестор") for s in ("Крол", "Мошт", "Дарн", "Фелс")] * 4
    dull = ["Старый том лежит в зале и ждёт, а новый том стоит рядом."] * 60
    assert not any(found(spark, [f"Том взяли {g} {s} вчера." for g, s in pairs] + dull).values())
    got = found(spark, [f"Том взяли {g} {s} вчера, тел 8 142 456 37 90." for g, s in pairs] + dull)
    assert [got[i] for i in range(len(pairs))] == [[f"{g} {s}"] for g, s in pairs]


def test_same_names_in_a_corpus_repeated(spark):
    texts = corpus() + ["меня зовут талғат юлдашев. Жду", "спросить ЗӨФӘР МЕРГЕНОВ", "Ждёт Есенов Талғат Старый том"]
    once, often = found(spark, texts), found(spark, texts * 20)
    assert all(often[i] == once[i % len(texts)] for i in often)


def test_rare_terms_reach_their_documents_by_joins(spark, monkeypatch):
    texts = corpus() + ["спросить ЗӨФӘР МЕРГЕНОВ"]
    want = found(spark, texts)
    monkeypatch.setattr(P, "FREQUENT_SHARE", 1.0)  # nothing is frequent
    assert found(spark, texts) == want
