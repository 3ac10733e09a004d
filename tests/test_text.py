from pyspark.sql import functions as F

from conftest import one_column
from waymark.functions import names as N
from waymark.functions import text as X
from waymark.functions import tokens as T


def strings(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").orderBy("i")


def test_null_tokens_handles_every_white_space(spark):
    df = strings(spark, ["NA", "na", "<NA>", "n/a", "\tnan\t", " none ", " x ", None])
    assert one_column(df, X.null_tokens("s", T.LABEL)) == [None] * 6 + ["x", None]
    assert one_column(df, X.null_tokens("s", T.POOL)) == [None, None, None, "n/a", None, None, "x", None]
    assert one_column(df, X.null_tokens("s", T.SCREEN, keep=T.SCREEN_KEEP_NA))[:4] == ["NA", "na", "<NA>", "n/a"]


def test_exact_case_tokens(spark):
    df = strings(spark, ["NA", "na", "null", "None"])
    assert one_column(df, X.null_tokens("s", T.VALID_EXACT, fold=False)) == [None, "na", "null", None]


def test_fold_key(spark):
    df = strings(spark, ["Côte d’Ivoire", "São Tomé & Príncipe", "Straße", "unknown", None, "ﬁne  x"])
    out = {r["i"]: r["k"] for r in X.fold_key(df, "s", "k").collect()}
    assert [out[i] for i in range(6)] == ["cote d ivoire", "sao tome and principe", "strasse", "", "", "fine x"]


def test_relaxed_key_never_empty(spark):
    df = strings(
        spark, ["province of x", "state province", "x state region", "province", "x autonomous region", "state of state"]
    )
    assert one_column(df, X.relaxed_key("s")) == ["x", "state", "x", "province", "x autonomous", "state"]


def test_clean_place_query(spark):
    df = strings(spark, ["Mt. Hood, 10 km N of Site A12", "approx 5 miles SW of Blue Ck; light trap", "10 km", "R Alpha", None])
    assert one_column(df, X.clean_place_query("s")) == ["Mount. Hood", "Blue Creek", "", "River Alpha", ""]


def test_audit_treats_missing_as_changed(spark):
    df = strings(spark, ["10 km", None]).withColumn("c", X.clean_place_query("s"))
    rows = X.audit_clean(df, "s", "c").orderBy("i").collect()
    assert [(r["c"], r["clean_query_changed"], r["clean_query_empty"]) for r in rows] == [("10 km", True, True), (None, True, True)]


def test_canonical_labels(spark):
    df = strings(spark, ["Indo-Malayan", "palaearctic", "OCEAN", "middle  east", "n/a", "<NA>", "they're new"])
    assert one_column(df, X.canonical_label("s")) == ["Indomalayan", "Palearctic", None, "Middle East", "N/A", None, "They'Re New"]


def test_name_classes(spark):
    names = [
        "Genus species", "Genus species Author, 1900", "genus species", "Genus sp", "Genus cf. alpha", "Genus",
        "Genus épithète", "Clerinae gen", None, "Genus Species",
    ]
    df = strings(spark, names)
    assert one_column(df, N.screen_name("s")) == [
        "placeholder_or_higher_taxon", "placeholder_or_higher_taxon", "placeholder_or_higher_taxon",
        "placeholder_or_higher_taxon", "uncertain_identification", "placeholder_or_higher_taxon",
        "placeholder_or_higher_taxon", "placeholder_or_higher_taxon", "missing_name", "placeholder_or_higher_taxon",
    ]
    real = strings(spark, ["Carabus auratus", "Carabus auratus Linnaeus", "carabus auratus", "Carabus Auratus", "Carabus épithète", "Carabus"])
    assert one_column(real, N.screen_name("s")) == [
        "clean_binomial", "additional_name_tokens", "unusual_name_format", "unusual_name_format",
        "unusual_name_format", "not_binomial",
    ]
    assert one_column(real, N.name_class("s")) == [
        "clean_binomial", "not_two_word_binomial", "invalid_genus_format", "invalid_specific_epithet_format",
        "invalid_specific_epithet_format", "not_two_word_binomial",
    ]


def test_explode_names(spark):
    df = strings(spark, ["['Genus a', 'Genus b']", "Genus c | Genus d;nan", None, "[]", "Genus e, 1900"])
    out = [(r["i"], r["name"]) for r in N.explode_names(df, "s").orderBy("i", "name").collect()]
    assert out == [(0, "Genus a"), (0, "Genus b"), (1, "Genus c"), (1, "Genus d"), (2, None), (3, "[]"), (4, "Genus e, 1900")]


def test_zero_key_counts_as_absent(spark):
    df = spark.createDataFrame([(0, 5), (7, 5), (None, 0)], "a long, b long")
    assert one_column(df, N.preferred_key("a", "b")) == [5, 7, 0]


def test_parse_bool(spark):
    df = strings(spark, ["True", " yes ", "0", "maybe", None])
    assert one_column(df, X.parse_bool("s", T.TRUE_FLAG, T.FALSE_FLAG)) == [True, True, False, None, None]
    assert one_column(df, X.parse_bool("s", T.TRUE_LOOKUP)) == [True, True, False, False, False]


def test_first_code_and_abbreviation(spark):
    df = spark.createDataFrame([("-99", "usa"), (None, "x"), ("FRA", "DEU")], "a string, b string")
    assert one_column(df, X.first_code("a", "b")) == ["USA", "", "FRA"]
    assert one_column(df, X.is_abbreviation(F.col("b"))) == [True, True, True]


def test_fold_key_equals_the_unicode_tables(spark):
    import re
    import unicodedata

    def key(text):
        text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip()
        if text.lower() in X.T.ADMIN:
            return ""
        bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return " ".join(re.findall("[a-z0-9]+", bare.casefold().replace("&", " and ")))

    texts = ["ＮＡ", "ｎ／ａ", "Ｎａｍｅ", "Đắk Lắk", "Thừa Thiên–Huế", "ﬁn & ﬂat", "Straße", "İstanbul", "Á b̧",
             "½ km²", "㎏", "𝐁𝐨𝐥𝐝", "Åland", "x y", "", " ", "ÆØ", "Ⅳ", "⑴", "東京 Tokyo", "🄀", "ΑΒ", "plain NAME-1", "c​d"]
    texts += ["a" + "".join(map(chr, range(i, i + 64))) + "z" for i in range(0xA0, 0x3000, 64)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    out = X.fold_key(df, "s", "k")
    got = {r["i"]: r["k"] for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == [key(t) for t in texts]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_strict_flags_stop_at_unknown_words(spark):
    import pytest

    from waymark.functions.text import strict_bool

    flags = spark.createDataFrame([(" Yes",), ("0",), (None,)], "w string")
    assert [r[0] for r in flags.select(strict_bool("w", ("yes", "1"), ("no", "0"))).collect()] == [True, False, False]
    bad = spark.createDataFrame([("maybe",)], "w string")
    with pytest.raises(Exception, match="not a flag: 'maybe'"):
        bad.select(strict_bool("w", ("yes",), ("no",)).alias("x")).collect()
