import numpy as np
import pytest

from tests.conftest import SF
from tomeforge.llm import language as L

TEXT = {
    "ru": "Рукописная заметка накануне ярмарки сравнивает старый словарь с новой хроникой.",
    "kk": "Тыныш өмірбаян тозған кітапты дәптердің шетінде безендіреді және ұсынады.",
    "tt": "Таулы сүзлек өске киштәдә төгәл хикәяне яшерә һәм җыйнак китапны ача.",
    "en": "The quiet ledger quotes the rural footnote by the light of a lamp.",
}


@pytest.fixture(scope="module")
def model(spark):
    d = SF.replace("0.001", "0.01")
    return L.fit_on_sample(L.table(spark, d, "chunks"), L.table(spark, d, "books"), limit=1500)


def test_sentences_and_mixture(model):
    w, t = model
    assert (w != 0).mean() < 0.2
    text = " ".join(TEXT[x] for x in ("ru", "ru", "en", "kk"))
    segs = L.segments_of([text, "", "1234 ?!", TEXT["tt"] + " «The Forgotten Cover».", "x" * 50_000], w, t)
    assert [L.LANGUAGES[s[2]] for s in segs[0]] == ["ru", "en", "kk"] and all(s[4] and s[3] > 0.9 for s in segs[0])
    assert segs[1] == segs[2] == [] and [L.LANGUAGES[s[2]] for s in segs[3]] == ["tt"] and len(segs[4]) == 1


def test_held_out_accuracy(spark, model):
    """Against the labels of books the model has not seen; a few of those labels are wrong."""
    chunks, books = L.table(spark, SF, "chunks"), L.table(spark, SF, "books")
    found = L.book_languages(L.segments(chunks, model)).join(books.select(L.F.col("id").alias("book_id"), L.label_language(L.F.col("language")).alias("label")), "book_id").where("label is not null").toPandas()
    assert (found.label == found.language).mean() > 0.8


def test_sample_has_one_size_at_every_scale():
    hashes = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 2_000_000)
    for total in (10**5, 10**6, 10**7, 6 * 10**9, 10**12):
        share = (hashes < L.sample_bound(total)).mean()
        assert abs(share * total - L.SAMPLE_CHUNKS) < 6 * (L.SAMPLE_CHUNKS / total / len(hashes)) ** 0.5 * total + 1
    assert L.sample_bound(6000) is None and all((L.sample_bound(n) + (1 << 63)) * n >> 64 in (5999, 6000) for n in (10**5, 6 * 10**9, 7 * 10**9, 15 * 10**10, 10**12))


def test_nothing_to_learn_from(spark):
    chunks = spark.createDataFrame([(1, 1, TEXT["ru"])], "id long, book_id long, raw_text string")
    books = spark.createDataFrame([(1, None)], "id long, language string")
    assert L.fit_on_sample(chunks, books) is None and L.segments(chunks, None).count() == 0
    assert L.fit_on_sample(chunks.limit(0), books.limit(0)) is None


def test_labels(spark):
    rows = [("RU",), ("ru-RU",), ("русский",), (" Kazakh ",), ("tat",), ("en_GB",), ("mul",), ("??",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "l string").select(L.label_language(L.F.col("l"))).collect()]
    assert got == ["ru", "ru", "ru", "kk", "tt", "en", None, None, None, None]


def test_calibration_and_empty(spark, model):
    score = np.array([[4.0, 0.0]] * 80 + [[0.0, 4.0]] * 20)
    t = L.temperature(score, np.zeros(100, int))
    assert 2 < t < 4  # 80 % right: confidence about 0.8
    df = spark.createDataFrame([], "id long, book_id long, raw_text string")
    assert L.segments(df, model).count() == 0
    df = spark.createDataFrame([(1, None, None, 0), (2, 5, TEXT["en"], 0), (2, 5, TEXT["en"], 0)], "id long, book_id long, raw_text string, language int")
    assert [tuple(r) for r in L.book_languages(L.segments(df, model)).select("book_id", "language").collect()] == [(5, "en")]
