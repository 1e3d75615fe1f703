import hashlib
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from linkspan.functions import similarity as sim
from linkspan.functions import text
from linkspan.operators.keys import SEP, keys
from linkspan.sources.records import prepare


def values(spark, data, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


CASES = ["शिवम सिस्टम्स", "ଗୁରୁ ସଲ୍ୟୁସନ୍ସ୍", "Société Française", "Straße & Söhne", "", None, "A_b-C  d", "ÅNGSTRÖM ø", "½ ²", "ﬁn", "Ⅷ", "éa ́b"]


@pytest.mark.parametrize("version", [1, 2])
def test_native_and_full_rules_agree(spark, version):
    got = values(spark, CASES, lambda c: text.normalize(c, version))
    assert got == [text.normalize_python(c or "", version) for c in CASES]


GOLDEN = {
    "a＆b": ("a and b", "a b"), "a﹠b": ("a and b", "a b"), "Ärger&Co": ("arger and co", "arger and co"), "कि ति": ("क त", "कि ति"), "e\u0301\u0302x": ("ex", "ex"), "ж\u0301": ("ж", "ж\u0301"),
    "x² Ⅳ": ("x2 iv", "x2 iv"), "a_b·c": ("a b c", "a b c"), "1\u0301": ("1", "1\u0301"), "İx": ("ix", "ix"),
}


def test_golden_cases():
    for raw, (one, two) in GOLDEN.items():
        assert text.normalize_python(raw, 2) == two, raw
        if raw != "कि ति":  # vowel signs that do not combine part words in version 1
            assert text.normalize_python(raw, 1) == one, raw
    assert text.normalize_python("कि ति", 1) == "क त"


def test_marks_of_other_scripts_stay_and_accents_go(spark):
    got = values(spark, CASES[:3], text.normalize)
    assert got == [CASES[0], CASES[1], "societe francaise"]
    assert values(spark, CASES[:1], lambda c: text.normalize(c, 1)) != [CASES[0]]


def test_domain_is_stripped(spark):
    assert values(spark, [" rootinstitute.COM/about ", "a.company", "x.in", "b.fr/"], text.strip_domain) == ["rootinstitute", "a.company", "x", "b"]


def test_grams(spark):
    assert [sorted(x) for x in values(spark, ["abcab", "ab", ""], lambda c: text.grams(c, 3))] == [["abc", "bca", "cab"], [], []]


def test_list_codec(spark):
    assert values(spark, ["a,b", "", "a"], text.list_decode) == [["a", "b"], [], ["a"]]


def test_sha_number(spark):
    assert values(spark, ["matcher:2026:S1-a"], text.sha_number) == [int(hashlib.sha256(b"matcher:2026:S1-a").hexdigest()[:8], 16)] == [3100431120]


def test_sequence_ratio_keeps_the_order_of_its_arguments(spark):
    rng = random.Random(1)
    pairs = [("tide", "diet"), ("diet", "tide"), ("", "a"), ("", "")] + [("".join(rng.choices("abc", k=rng.randint(1, 12))), "".join(rng.choices("abc", k=rng.randint(1, 12)))) for _ in range(200)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(sim.sequence_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0 for a, b in pairs]
    assert got[0] == 0.25 and got[1] == 0.5


def record_keys(spark, records):
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(records)], "entity_id string, business_name string, business_address string, country string")
    p = prepare(df)
    return [set(r.k) for r in p.orderBy("entity_id").select(keys(p).alias("k")).collect()]


def test_web_address_and_company_share_a_key(spark):
    a, b = record_keys(spark, [("Root Institute Ltd", "", "India"), ("rootinstitute.com", "", "India")])
    assert SEP.join(["compact", "india", "rootinstitute"]) in a & b


def test_changed_name_or_script_shares_an_address_key(spark):
    address = "E-122 Site No.2 Patel Nagar City Centre Gwalior"
    a, b, c = record_keys(spark, [("AC Hardware Private Limited", address, "India"), ("Ectocalovio", address, "India"), ("शिवम सिस्टम्स", address, "India")])
    assert any(k.startswith("address_pair") for k in a & b) and any(k.startswith("address_pair") for k in a & c)


def test_countries_share_no_key(spark):
    a, b = record_keys(spark, [("Same Name", "1 Same Road Paris", "France"), ("Same Name", "1 Same Road Paris", "US")])
    assert a and not a & b


def test_empty_name_after_company_words(spark):
    (a,) = record_keys(spark, [("Company Ltd", "", "US")])
    assert a == {SEP.join(["exact", "us", "company ltd"]), SEP.join(["compact", "us", ""])}
