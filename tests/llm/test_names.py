import pytest

from ballotlens.llm.names import canonicalise, choice_words, distance, map_values, title_words

CANON = [
    (1, "choice", "Yes/For", None), (2, "choice", "No/Against", None), (10, "contest", "City of Brandelwick Council, Ward 1", None), (11, "contest", "City of Brandelwick Council, Ward 2", None), (12, "contest", "City of Brandelwick Mayor", None),
    (13, "contest", "State Senate, District 3", None), (14, "contest", "State Senate, District 13", None), (15, "contest", "Brandelwick School District Director, Seat A", None), (16, "contest", "Brandelwick School District Director, Seat B", None),
    (17, "contest", "Hartenford County Clerk and Recorder", None), (18, "contest", "Hartenford County Assessor", None), (19, "contest", "Hartenford Fire Protection District Ballot Issue 6B", None), (20, "contest", "Proposition 256: Seasonal Clocks", None),
    (30, "choice", "Marla Q. Ventersholm", 10), (31, "choice", "Tobin Ventersholm", 11), (32, "choice", "Ursel Quandermoss", 10), (33, "choice", "Wendal Quandermoss", 12), (34, "choice", "Pell Ostrander", 13),
]
C = "canon_id int, name_kind string, canonical_name string, contest_canon_id int"
TITLES = {
    "CITY OF BRANDELWICK COUNCIL, WARD 2": 11, "Brandelwick City Council, Ward No. 2 (Vote For=1)": 11, "Council, Ward Two - C. of Brandelwick": 11, "City of Brandelwick Cncl, Ward #3": 0, "City of Brandelwikc Mayr [amended]": 12, "Mayor": 0,
    "Dist. 3: State Sen.": 13, "state  senate (district XIII) *": 14, "State Senate, District 33": 0, "State\xa0Senate,_District 03": 13, "Seat B: Brandelwick Sch. Dist. Dir.": 16, "Brandelwick School District Director, Seat C": 0, "Brandelwick School District Director": 0,
    "Hartenford County Clerk & Reco": 17, "Hartenford Cnty Clerk and...": 17, "Assessor, Hartenf0rd County": 18, "Wexcombe County Assessor": 0, "Hartenford Fire Prot. Dist. Issue 6B": 19, "Prop. 256: Seasonal C1ocks": 20, "Proposition 265: Seasonal Clocks": 0, "see sheet 2": 0, "": 0, "???": 0,
}
CHOICES = {
    ("VENTERSHOLM Marla", 10): 30, ("Ventersholm, Marla", None): 30, ("M. Ventersholm", 10): 30, ("T. Ventersholm", 10): 0, ("Ventersholm", 11): 31, ("Ventersholm", None): 0, ('Ms. Ursel "Ursie" Quandermoss (IND)', 10): 32, ("Ursel Quandermos", 10): 32, ("U. Quandermoss", 12): 0, ("Wendal T. Quandermoss", 12): 33,
    ("Rolf Quandermoss", 10): 0, ("Marla X. Ventersholm", 10): 0, ("Pell Ostrander / Someone Else", 13): 34, ("YES", 20): 1, ("Against the Measure", 20): 2, ("no / agianst", None): 2, ("Write-in", 10): 0, ("-", 10): 0, ("Tobin Ventersholm ", 10): 31,
}


def canon(spark):
    return spark.createDataFrame(CANON, C)


def test_words():
    assert title_words("Dist. No. 07, Ward II (NP) - Vote for One")[0] == ["dist", "no", "7", "ward", "2"] and title_words("A Clerk and Rec~")[1]
    assert choice_words('Dr. Zoé "Z" O\'Neil (W)') == ["zoe", "oneil"]
    assert (distance("abcd", "abdc", 2), distance("modern", "modem", 2), distance("abc", "xyz", 2)) == (1, 1, 3)


@pytest.mark.parametrize("block", [20_000, 5])
def test_titles(spark, block):
    rows = [(v, "contest", None, "x") for v in TITLES for _ in range(2)] + [(None, "contest", None, "x")]
    got = {r.value: r.canon_id for r in map_values(spark.createDataFrame(rows, "value string, name_kind string, context int, canon_id string"), canon(spark), block=block).collect()}
    assert {k: v for k, v in got.items() if k is not None} == TITLES and got[None] == 0


def test_choices(spark):
    rows = [(v, "choice", c) for v, c in CHOICES]
    got = {(r.value, r.context): r.canon_id for r in map_values(spark.createDataFrame(rows, "value string, name_kind string, context int"), canon(spark)).collect()}
    assert got == CHOICES


def test_records(spark):
    titles = spark.createDataFrame([("t", 1, "f", "City of Brandelwick Mayor"), ("t", 2, "f", "city of brandelwick mayor"), ("t", 2, "f", "city of brandelwick mayor"), ("t", 3, "f", None)], "source_table string, record_id bigint, field_name string, value string")
    choices = spark.createDataFrame([("t", 1, "c", "Ventersholm", "c. of Brandelwick council, ward 1"), ("t", 2, "c", "Pell Ostrander", "x"), ("t", 3, "c", None, None), ("t", 4, "c", "Ventersholm", None), ("t", 5, "c", "ventersholm", "City of Brandelwick Council, Ward 2")], "source_table string, record_id bigint, field_name string, value string, title string")
    got = {(r.record_id, r.field_name, r.canon_id) for r in canonicalise(titles, choices, canon(spark)).collect()}
    assert got == {(2, "f", 12), (1, "c", 30), (4, "c", 0), (5, "c", 31)}


def test_empty(spark):
    none = lambda df: df.limit(0)
    values = spark.createDataFrame([("x", "contest", None)], "value string, name_kind string, context int")
    assert map_values(none(values), canon(spark)).count() == 0
    assert [r.canon_id for r in map_values(values, none(canon(spark))).collect()] == [0]
    long = spark.createDataFrame([("City of " + "x" * 200_000 + " Mayor", "contest", None)], "value string, name_kind string, context int")
    assert [r.canon_id for r in map_values(long, canon(spark)).collect()] == [0]
