from tomeforge.llm import confusables as C


def test_forms():
    for bad in ("В １９ году", "светлый\xa0альманах", "тихую азбу‍ку", "scientiﬁc", "полный", "café", "a　b", "\xadслово", "𝐀lpha"):
        assert C.disguised(bad), bad
    for good in ("«слово» — XIX век\r\nстрока", "café naïveté", "ёж йод", "", "слóво"[:2], "а́"):
        assert not C.disguised(good), good
    assert C.tidy("В １９ году​\r\nполный") == "В 19 году\r\nполный"


def test_find_and_normalise(spark):
    rows = [
        (1, "Рядом c ящиком", "рядом с ящик", 0),
        (2, "Рядом с ящиком", "рядом с ящик", 0),
        (3, "Pядoм с ящикoм XIX века, IV", "xix век iv", 0),
        (4, None, "", 0),
        (5, "In the case a letter", "in the case a letter", 0),
        (6, "In the cаse а letter", "in the case a letter", 0),
        (7, "рядом с ящиком ябвгд абвгдx", "рядом с ящик", 0),
        (8, "«A Case» рядом с ящиком DVD-диск", "рядом", 0),
        (8, "«A Case» рядом с ящиком DVD-диск", "рядом", 0),
        (9, "Рядом с​ ящиком " * 3000, "рядом", 0),
    ]
    df = spark.createDataFrame(rows, "id long, raw_text string, lemma_text string, n int")
    got = {tuple(r) for r in C.find(df, "id", ["raw_text", "lemma_text"]).collect()}
    assert got == {(1, "raw_text"), (3, "raw_text"), (6, "raw_text"), (9, "raw_text")}
    out = {r.id: r.raw_text for r in C.normalise(df, "id", ["raw_text"]).collect()}
    assert out[1] == out[2] == "Рядом с ящиком" and out[3] == "Рядом с ящиком XIX века, IV" and out[6] == out[5] and out[4] is None
    assert C.normalise(df, "id", ["raw_text"]).count() == len(rows)
    assert C.find(df.limit(0), "id", ["raw_text"]).count() == 0
