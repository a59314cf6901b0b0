from hypothesis import given, settings
from hypothesis import strategies as st

from tomeforge.llm.packing import pack
from tomeforge.llm.tokens import concatenate, cut_points, encode_documents, encoder


def tree(text, leaf):
    e, sizes = encoder()
    p = cut_points(text, leaf)
    parts = [text[a:b] for a, b in zip(p, p[1:])]
    return concatenate(parts, [e.encode_ordinary(x) for x in parts], e, sizes)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'stTre  \n\t1290.,!-éяЖқ漢😀‍")), max_size=400), st.integers(8, 40))
def test_tree_equals_direct(text, leaf):
    assert tree(text, leaf) == encoder()[0].encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("аоие")), min_size=50, max_size=900), st.integers(16, 60))
def test_unsplit_letters(text, leaf):
    assert tree(text, leaf) == encoder()[0].encode_ordinary(text)


def test_documents(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "Привет, world <|endoftext|>", 9), (4, "слово без конца " * 4000, 9), (5, "x" * 40000, 9), (5, "x" * 40000, 9), (None, " ", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r.doc_id or 0, r.ids) for r in encode_documents(df, leaf=2000).collect())
    e = encoder()[0]
    assert got == sorted((r[0] or 0, e.encode_ordinary(r[1] or "")) for r in rows)
    assert encode_documents(df.limit(0)).count() == 0


def test_packing(spark):
    sizes = [(i, (i * 37) % 900) for i in range(3000)] + [(9001, 5000), (9002, 2048), (9003, None), (9003, None), (9004, 4096)]
    df = spark.createDataFrame(sizes, "id long, size long")
    out = pack(df, 2048, windows=16, per_partition=500).toPandas()
    total = out.groupby("container_id").n_tokens.sum()
    assert total.max() <= 2048
    assert out.n_tokens.sum() == sum(s or 0 for _, s in sizes)
    assert set(out.id) == {i for i, _ in sizes} and (out.id == 9003).sum() == 2
    assert (out[out.id < 9000].groupby("id").size() == 1).all() and (out.id == 9001).sum() == 3
    assert len(total) <= 1.03 * -(-out.n_tokens.sum() // 2048)
    assert pack(df.limit(0)).count() == 0
