from pyspark.sql import functions as F

from braidwork.functions import dates, phones, places, skills, text
from braidwork.functions.similarity import lcs, token_set
from braidwork.operators import score


def column(spark, values, rule):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


def test_dates(spark):
    given = ["2020-01", "2020", "Jan 2020", "September 2019", "2020 Sept", "1/2020", "01-2020", "2020/3", "2020.11", "since 2018 or so", "Present", "-", "", None, "n/a", "13/2020"]
    want = ["2020-01", "2020-01", "2020-01", "2019-09", "2020-09", "2020-01", "2020-01", "2020-03", "2020-11", "2018-01", None, None, None, None, None, "2020-13"]
    assert column(spark, given, dates.normalize_date) == want


def test_phones(spark):
    given = ["9876543210", "+91 98765 43210", "(415) 555-2671", "+1 415 555 2671", "+44 7911 123456", "07911123456", "call me", "123", "", None, "0091 98765 43210"]
    want = ["+919876543210", "+919876543210", "+14155552671", "+14155552671", "+447911123456", "+447911123456", None, None, None, None, "+919876543210"]
    assert column(spark, given, phones.normalize_phone) == want


def test_places(spark):
    assert column(spark, ["India", "usa", "FRA", "中国", "de", "Atlantis", "", None], places.normalize_country) == ["IN", "US", "FR", "CN", "DE", None, None, None]
    got = column(spark, ["Bangalore, Karnataka, India", "San Francisco, CA", "India", "Pune", " , "], lambda c: F.to_json(places.parse_location(c)))
    assert got == ['{"city":"Bangalore","region":"Karnataka","country":"IN"}', '{"city":"San Francisco","country":"CA"}', '{"country":"IN"}', '{"city":"Pune"}', "{}"]


def test_text(spark):
    assert column(spark, [" Ada \t Lovelace ", None], text.person_name) == ["Ada Lovelace", None]
    assert column(spark, ["Acme Pvt. Ltd.", "The Co. of Inc", None], text.company_key) == ["acme", "the of", ""]
    assert column(spark, ["node.js", "o'neil db"], text.title_case) == ["Node.Js", "O'Neil Db"]
    assert column(spark, ["a; b,c ;", "", "a,,b"], lambda c: F.array_join(text.split_list(c), "|")) == ["a|b|c", "", "a|b"]


def test_similarity():
    assert lcs("abcde", "ace") == 3
    assert token_set("sneha patel", "sneha s patel") == 100
    assert round(token_set("karan malhotra", "karan m."), 2) == 76.92
    assert round(token_set("robert james", "bob james"), 2) == 76.19
    assert round(token_set("rajesh kumar", "christine wong"), 1) == 15.4
    assert token_set("", "x") == 0


def test_skills(spark):
    df = spark.createDataFrame([(x,) for x in ["js", "ReactJS", "React Native", "Spring Security", "underwater basketry", "Underwater", "py"]], "s string")
    got = {r.raw: r.skill for r in skills.skill_table(df, "s").collect()}
    assert got == {"js": "JavaScript", "ReactJS": "React", "React Native": "React", "Spring Security": "Spring", "underwater basketry": "Underwater Basketry", "Underwater": "Underwater", "py": "Python"}


def test_severities(spark):
    df = spark.createDataFrame([("Ann Lee", "ann lee"), ("Rajesh Kumar", "Christine Wong"), ("Robert James", "Bob James"), (None, "x")], "a string, b string")
    got = [tuple(r) for r in df.select(score.scalar_severity(F.col("a"), F.col("b")), score.name_severity(F.col("a"), F.col("b"))).collect()]
    assert got == [("LOW", "LOW"), ("HIGH", "HIGH"), ("MEDIUM", "MEDIUM"), (None, "HIGH")]
