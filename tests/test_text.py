from pyspark.sql import functions as F

from lodestone.functions import ids, numeric
from lodestone.functions import text as tx


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_normalize(spark):
    assert one(spark, tx.normalize("t"), t="  Ёлка\t  ЗЕЛЁНАЯ \n") == "елка зеленая"
    assert one(spark, tx.normalize("t"), t=None) == ""
    assert one(spark, tx.normalize("t", max_chars=5), t="abcd efgh") == "abcd"
    assert one(spark, tx.normalize("t", compatibility=True), t="ﬁx") == "fix"


def test_tokens(spark):
    assert one(spark, tx.tokens("t"), t="Привет Ёлка x_1, a") == ["Привет", "Ёлка", "x_1", "a"]
    assert one(spark, tx.tokens("t", 2), t="a bc") == ["bc"]


def test_canonical_numbers(spark):
    assert set(one(spark, tx.canonical_numbers("t"), t="Год 2,0 и 10 кг")) == {"2.0", "10кг"}
    assert set(one(spark, tx.canonical_numbers("t"), t="iphone 12 128 гб")) == {"12", "128gb"}
    assert set(one(spark, tx.canonical_numbers("t"), t="квартира 45,5 кв.м 2 комн")) == {"45.5кв", "2"}


def test_numbers_stand_apart(spark):
    """No number inside a word; units after none or one blank; other spellings of one unit; nothing of nothing."""
    for text, want in {
        "модель12 12abc _7 7_": set(),
        "лампа 100 Вт на 5 лет": {"100вт", "5лет"},
        "полка 30см, 30 мм и 2  м": {"30см", "30мм", "2м"},
        "диск 1ТБ или 1 tb": {"1tb"},
        "дом 3 года 1 час 2 часа 8 часов": {"3года", "1час", "2часа", "8часов"},
        "версия 1.2.3": {"1.2", "3"},
        "7 kg": {"7"},
        "１２ гб": {"12gb"},
        None: set(),
    }.items():
        assert set(one(spark, tx.canonical_numbers("t"), t=text)) == want, text


def test_char_wb(spark):
    assert one(spark, tx.char_wb_ngrams(F.col("t")), t="ab x") == [" ab", "ab ", " ab ", " x "]
    assert one(spark, tx.char_wb_ngrams(F.col("t")), t="") == []


def test_word_ngrams(spark):
    assert one(spark, tx.word_ngrams(tx.tokens("t")), t="a b c") == ["a", "b", "c", "a b", "b c"]
    assert one(spark, tx.word_ngrams(tx.tokens("t")), t="") == []


def test_compose(spark):
    assert one(spark, tx.compose("a", "b"), a="x", b="") == "x"
    assert one(spark, tx.compose_collapsed("a", "b"), a=" x  y", b=None) == "x y"


def test_haversine(spark):
    moscow_spb = one(spark, numeric.haversine_km(F.lit(55.75), F.lit(37.62), F.lit(59.93), F.lit(30.33)), a="")
    assert 620 < moscow_spb < 650
    assert one(spark, numeric.haversine_km(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)), a="") == 0


def test_hashes(spark):
    import hashlib

    for key in ("42:q1", "Привет"):
        n = int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big")
        assert one(spark, ids.hash_bucket(F.col("k"), 5), k=key) == n % 5
        assert one(spark, ids.hash_uniform(F.col("k")), k=key) == n / 2**64


def test_context_id(spark):
    import hashlib

    want = hashlib.sha256(("data-contract-v1\x1e" + "\x1f".join(["a=x", "b=<NULL>"])).encode()).hexdigest()
    assert one(spark, ids.context_id(["a", "b"]), a="x", b=None) == want
