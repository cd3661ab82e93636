"""Golden cases for file names, identifiers, author names and scores."""

from pyspark.sql import functions as F

from scholia.functions.names import authors_match, compose, normalize_author
from scholia.functions.text import doi_to_file, strip_supplement
from scholia.operators.identifiers import classify_identifiers, filename_clues
from scholia.operators.linkage import clue_score, clue_stage, confidence_band
from scholia.operators.titles import plain_title, scored_title

# fixed values: file name | author | year | keywords (in any order)
CLUES = """
Smith_2023_Quantum.pdf|Smith|2023|Quantum
Chen_2022_Graphene.pdf|Chen|2022|Graphene
Kim_2021_MOF.pdf|Kim|2021|MOF
Smith_2023.pdf|Smith|2023|
2023_Smith_Quantum.pdf|Smith|2023|Quantum
2022_Wang_Nature.pdf|Wang|2022|Nature
2021_Chen_ACS_Applied.pdf|Chen|2021|ACS Applied
Smith_Nature_2023.pdf|Smith|2023|Nature
Wang_Advanced_Materials_2023.pdf|Wang|2023|Advanced Materials
Smith-2023-Quantum.pdf|Smith|2023|Quantum
Li-2021.pdf|Li|2021|
Zhang_2023_Deep_Learning.pdf|Zhang|2023|Deep Learning
Chen_2022_Single_Cell_RNA.pdf|Chen|2022|Single Cell RNA
Smith_Quantum.pdf|Smith||Quantum
2023_Quantum.pdf||2023|Quantum
paper.pdf|||
manuscript.pdf|||
Gonzalez-Cabaleiro_2023_Biofilm.pdf|Gonzalez-Cabaleiro|2023|Biofilm
Smith_2023_Smith.pdf|Smith|2023|
Wang_2022_Wang_Research.pdf|Wang|2022|
Smith_1999_Old.pdf|Smith|1999|Old
Smith_2099_Future.pdf|Smith|2099|Future
Smith_1899_Ancient.pdf|Smith||Ancient
Smith_2023_3D_Printing.pdf|Smith|2023|3D Printing
.pdf|||
Smith_2023_|Smith|2023|
_2023_Smith.pdf||2023|Smith
Smith_2023-Nature.pdf|Smith|2023|Nature
Smith-2023_Quantum.pdf|Smith|2023|Quantum
SMITH_2023_Quantum.pdf|SMITH|2023|Quantum
smith_2023_quantum.pdf|smith|2023|quantum
the_2023_Quantum.pdf||2023|Quantum
study_2023_Quantum.pdf||2023|Quantum
manuscript_2023_Quantum.pdf||2023|Quantum
""".strip().splitlines()

# fixed values: least confidence of a file name
CONFIDENCE = {
    "Smith_2023_Quantum.pdf": 0.8, "Smith_2023.pdf": 0.5, "2023_Smith_Quantum.pdf": 0.8,
    "Smith_Quantum.pdf": 0.3, "2023_Quantum.pdf": 0.3, "paper.pdf": 0.0,
}

# fixed values: left name, right name, match
AUTHORS = [
    ("Kutalek", "Kutálek", True), ("Kalahdaran", "Kaladharan", True),
    ("Lara González-Cabaleiro", "Lara González‐Cabaleiro", True), ("Yi Yang", "Yi Yang", True),
    ("Jae- Eul Shim", "Jae-Eul Shim", True),
    ("Seyed Mohammad Taghi Gharibzadeh", "Seyed Mohammad Taghi Ghar", True),
    ("Wei Zhou", "Wonil Nam", False), ("Peng Zheng", "Peng Zheng", True),
    ("", "Test", False), ("Test", "", False), ("Xiang-Yu Meng", "Xiangyu Meng", True),
]

# fixed values: author, year, keywords | work author, title, year | score
SCORES = [
    ("Smith", 2023, ["Quantum"], "John Smith", "Quantum Computing Advances", "2023", 100),
    ("Smith", 2023, ["Unrelated"], "John Smith", "Something Completely Different", "2023", 80),
    ("Smith", None, [], "John Smith", "Anything", "2019", 50),
    ("", 2023, [], "Stranger", "Unrelated", "2023", 30),
    ("Smith", 2022, [], "John Smith", "Anything", "2023", 70),
    ("Smith", None, ["Quantum"], "John Smith", "Quantum Computing", "2019", 70),
    ("", None, ["Quantum", "Computing"], "Someone", "Quantum Mechanics Today", "2020", 10),
    ("", None, [], "Someone", "Anything", "2020", 0),
    ("Wrong", 2023, ["Quantum"], "John Smith", "Quantum Computing Advances", "2023", 50),
    ("", 2022, [], "Someone Else", "Unrelated", "2023", 20),
]


def test_filename_clues(spark):
    names = spark.createDataFrame([(line.split("|")[0],) for line in CLUES], "name string")
    got = {r["name"]: r for r in filename_clues(names, "name").collect()}
    for line in CLUES:
        name, author, year, keywords = line.split("|")
        row = got[name]
        assert (row["author"], row["year"]) == (author, int(year) if year else None), line
        assert set(row["keywords"]) == set(keywords.split()), line


def test_confidence(spark):
    names = spark.createDataFrame([(n,) for n in CONFIDENCE], "name string")
    for row in filename_clues(names, "name").collect():
        assert row["confidence"] >= CONFIDENCE[row["name"]]


def test_authors(spark):
    df = spark.createDataFrame(AUTHORS, "a string, b string, want boolean")
    wrong = df.filter(authors_match(F.col("a"), F.col("b")) != F.col("want"))
    assert wrong.collect() == []


def test_composed_author(spark):
    df = spark.createDataFrame([("Kuta\u0301lek  A.",)], "a string")
    assert df.select(normalize_author(F.col("a"))).first()[0] == "kutáleka"


def test_scores_and_bands(spark):
    schema = "a string, y int, k array<string>, wa string, wt string, wy string, want int"
    df = spark.createDataFrame(SCORES, schema)
    score = clue_score(F.col("a"), F.col("y"), F.col("k"), F.col("wa"), F.col("wt"), F.col("wy"))
    assert df.filter(score != F.col("want")).collect() == []
    bands = [r[0] for r in spark.createDataFrame([(70,), (69,), (40,), (39,)], "s int").select(confidence_band(F.col("s"))).collect()]
    assert bands == ["auto", "review", "review", "skip"]


def test_identifier_parts(spark):
    names = ["1-s2.0-S0956566324010431-main.pdf", "10.1021_acs_analchem_2c01450.pdf", "9.pdf", "1-s2.0-S12-main.pdf"]
    df = classify_identifiers(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    rows = {r["name"]: r for r in df.collect()}
    first = rows[names[0]]
    assert (first["pii"], first["issn"], first["pub_year"], first["seq"]) == ("S0956566324010431", "09565663", "2024", "010431")
    assert [rows[n]["name_class"] for n in names] == ["publisher", "doi", "other", "publisher"]
    assert rows[names[3]]["description"].endswith("(malformed)")


def test_doi_forms(spark):
    df = spark.createDataFrame([("10.1021/acs.5c01686.s001",), ("10.1016/j.bios.2024.117036",)], "d string")
    got = df.select(strip_supplement(F.col("d")), doi_to_file(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [
        ("10.1021/acs.5c01686", "10.1021_acs.5c01686.s001"),
        ("10.1016/j.bios.2024.117036", "10.1016_j.bios.2024.117036"),
    ]


def test_titles(spark):
    texts = [
        ("# Quantum Computing\n\nReceived: 12 January 2024\n", None, "Quantum Computing"),
        ("Quantum Computing Advances in 2024\n\n## Abstract\nThis paper discusses it.", "Quantum Computing Advances in 2024", "Quantum Computing Advances in 2024"),
        ("![](images/p0_0.jpg)\n\nQuantum Computing Advances", "Quantum Computing Advances", "Quantum Computing Advances"),
        ("", None, None),
        ("A plain first line of text\nA survey of everything\n1.2 Methods for all purposes", "A plain first line of text", "Methods for all purposes"),
        ("Some opening text line\n## A heading that is long\nlearning for all", "Some opening text line", "A heading that is long"),
    ]
    df = spark.createDataFrame(texts, "t string, plain string, scored string")
    for row in df.select("*", plain_title(F.col("t")).alias("p"), scored_title(F.col("t")).alias("s")).collect():
        assert (row["p"], row["s"]) == (row["plain"], row["scored"]), row["t"]


def test_no_clues(spark):
    works = spark.createDataFrame([("10.1/a", "Quantum things", "John Smith", 2023)], "doi string, title string, first_author string, year int")
    names = spark.createDataFrame([(1, "paper.pdf"), (2, "Smith_2023_Quantum.pdf"), (3, "2023.pdf"), (4, "Zzz_1950.pdf")], "id int, pdf_name string")
    rows = {r["id"]: r for r in clue_stage(filename_clues(names, "pdf_name"), works, "id").collect()}
    assert rows[1]["note"] == "clue: insufficient_clues"
    assert (rows[2]["cr_doi"], rows[2]["clue_score"], rows[2]["match"]) == ("10.1/a", 100, True)
    assert (rows[3]["cr_doi"], rows[3]["clue_score"]) == ("10.1/a", 30)
    assert rows[4]["note"] == "clue: no_results"


def test_composed_and_decomposed_names_match(spark):
    import unicodedata

    names = ["Müller", "Ñandú, José", "Nguyễn Thị Ấn", "Čapek", "Ångström", "Smith", "", "e\u0301", "\u0301x", "x\u0301\u0302", "Ωμέγα ᾧ", None]
    apart = [unicodedata.normalize("NFD", n) if n else n for n in names]
    df = spark.createDataFrame(list(zip(names, apart)), "whole string, apart string")
    got = df.select(compose(F.col("apart")).alias("c"), authors_match(F.col("whole"), F.col("apart")).alias("m"), authors_match(F.col("apart"), F.col("whole")).alias("n")).collect()
    assert [r["c"] for r in got] == [unicodedata.normalize("NFC", n) if n else n for n in names]
    assert all(r["m"] == r["n"] == bool(n) for r, n in zip(got, names))
