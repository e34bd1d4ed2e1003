from pyspark.sql import functions as F

from quillstream.functions import text as T


def apply(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_strip_takes_unicode_space(spark):
    assert apply(spark, T.strip, "　a b　", " \n", None) == ["a b", "", None]


def test_escape_query(spark):
    assert apply(spark, T.escape_query, "a && b || c & d", "(x+y)*[1]?:\\/", "금융 상품") == ["a \\&& b \\|| c & d", "\\(x\\+y\\)\\*\\[1\\]\\?\\:\\\\\\/", "금융 상품"]


def test_standard_id(spark):
    forms = ["1109", "KIFRS1109", "제1109호", " k-ifrs 제 1032 호 ", "１１０９", "", None, "110", "IFRS 9"]
    assert apply(spark, T.standard_id, *forms) == ["1109", "1109", "1109", "1032", "１１０９", None, None, None, None]
    assert apply(spark, T.standard_id_invalid, *forms) == [False] * 7 + [True, True]


def test_analyze_makes_bigrams_of_cjk_runs(spark):
    got = apply(spark, T.analyze, "금융상품 회계 ABC", "자", "복합K금융상", "ＡＢ１", "")
    assert got == [["금융", "융상", "상품", "회계", "abc"], ["자"], ["복합", "k", "금융", "융상"], ["ab1"], []]


def test_widths_and_stop_words(spark):
    import unicodedata

    texts = ["ｶﾞｷﾞﾊﾟ･ｱ", "ＡＢ１ ｶ", "The cat and THE dog www", "ＴＨＥ end", "a ｶﾀｶﾅ b", "plain", "naïve “quoted” — text", "𠀀𠀁𠀂"]
    folded = apply(spark, T.fold_width, *texts)
    assert folded == [unicodedata.normalize("NFKC", t) for t in texts]
    got = apply(spark, T.analyze, *texts)
    assert got[2:4] == [["cat", "dog"], ["end"]] and got[5:] == [["plain"], ["naïve", "quoted", "text"], ["𠀀", "𠀁", "𠀂"]]
    assert got[4] == ["カタ", "タカ", "カナ", "b"]


def test_citation_order(spark):
    rows = [("문단 1", "x", "1109", "2", "C"), (" ", "x", "1109", "2", "C"), (None, " 부록 ", "1109", "2", "C"), (None, None, "1109", "", "C"), ("", "", None, None, "C")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, s string, p string, c string")
    got = [r.x for r in df.select("i", T.citation(*map(F.col, "abspc")).alias("x")).orderBy("i").collect()]
    assert got == ["문단 1", "K-IFRS 제1109호 2", "부록", "K-IFRS 제1109호 (C)", "C"]


def test_small_renderers(spark):
    assert apply(spark, T.chat_title, "a\n b", "x" * 33, "", None) == ["a b", "x" * 32 + "…", T.DEFAULT_TITLE, T.DEFAULT_TITLE]
    assert apply(spark, T.strip_tag, "[tag]\nbody", "[a]x[b]", "none", None) == ["body", "x[b]", "none", ""]
    assert apply(spark, T.markers, "[E1] and [E12][E1] [X1]") == [["E1", "E12", "E1"]]
    assert apply(spark, T.split_list, " a,, b ,") == [["a", "b"]]
