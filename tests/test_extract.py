from pagemill.operators import cards, categories, layout, tables
from pagemill.plans import ingest

PAGE = "document_id bigint, page_number int, raw_text string"
CARDS = [("1", "ABC1234567", "राम कुमार", "पिता", "मोहन लाल", "12", "45", "पुरुष"), ("2", "ABC1234568", "श्याम सिंह", "पिता", "सोहन सिंह", "14", "32", "पुरुष"), ("3", "XYZ9876543", "गीता देवी", "पति", "राम कुमार", "12", "40", "महिला")]


def lines(c):
    return [f"{c[0]}  {c[1]}", f"निर्वाचक का नाम : {c[2]} फोटो उपलब्ध है", f"{c[3]} का नाम : {c[4]}", f"मकान संख्या : {c[5]}", f"उम्र : {c[6]}  लिंग : {c[7]}"]


def pages(spark, *texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], PAGE)


def found(rows):
    return sorted((tuple(r.data.get(k) for k in ("serial_no", "voter_id", "name", "relation_type", "relation_name", "house_no", "age", "gender"))) for r in rows.collect())


def test_cards_one_after_another(spark):
    assert found(cards.extract(pages(spark, "\n".join("\n".join(lines(c)) for c in CARDS)))) == CARDS


def test_cards_side_by_side(spark):
    text = "\n".join("     ".join(row) for row in zip(*[[x.replace("  ", " ") for x in lines(c)] for c in CARDS]))
    assert [r[1] for r in found(cards.extract(pages(spark, text)))] == [c[1] for c in CARDS]


def test_cards_by_position(spark):
    blocks = spark.createDataFrame([(1, 1, "\n".join(lines(c)), 20.0 + 200 * i, 100.0, 180.0 + 200 * i, 200.0) for i, c in enumerate(CARDS)], "document_id bigint, page_number int, text string, x0 double, y0 double, x1 double, y1 double")
    rows = cards.spatial(blocks)
    assert found(rows) == CARDS and {r.bbox.w for r in rows.collect()} == {160.0}


def test_tables(spark):
    tab = "Name\tAge\tCity\nJohn\t30\tNew York\nJane\t25\tLondon"
    pipe = "| Name | Age | City |\n|---|---|---|\n| John | 30 | New York |\n| Jane | 25 | London |"
    aligned = "S.No  Student Name  Roll No\n1  Rahul Kumar  1041\n2  Neha Kumari  1042"
    got = {r.page_number: r for r in tables.detect(pages(spark, tab, pipe, aligned, "Just prose. Nothing here.\nMore.", "", "1\t2\t3\n4\t5\t6\n7\t8\t9\n\nName\tAge\tCity\nx\ty\tz")).collect()}
    assert sorted(got) == [1, 2, 3, 6]
    assert got[1].headers == ["Name", "Age", "City"] and got[1].rows[0] == ["John", "30", "New York"] and got[2].confidence == 0.8
    assert len(got[3].rows) == 2 and got[6].headers == ["Column_1", "Column_2", "Column_3"] and len(got[6].rows) == 3


def test_forms_and_routing(spark):
    text = "Result sheet\nName: Ramesh Kumar\nFather Name: Mohan Lal\nRoll No: 12345\nName: Last Wins"
    rows = ingest.records(pages(spark, text, "\n".join(lines(CARDS[0])))).collect()
    assert {(r.page_number, r.origin) for r in rows} == {(1, "form"), (2, "card")}
    form = next(r for r in rows if r.origin == "form")
    assert form.data["roll_no"] == "12345" and form.data["name"] == "Last Wins"


def test_categories(spark):
    got = {r.name: r.pages for r in categories.detect(pages(spark, "Intro\nClass 10 - Section A\nrows", "class 10\nSummary Report", "one plain sentence")).collect()}
    assert got["Class 10"] == [1, 2] and got["Class 10 - Section A"] == [1] and got["Summary Report"] == [2]


def test_layout(spark):
    rows = layout.blocks(pages(spark, "Title\n\nbody " + "x" * 70)).collect()
    assert [(r.y0, r.block_type) for r in rows] == [(50.0, "heading"), (85.0, "text")]


def test_the_fields_of_a_card_are_worked_out_once(spark):
    pages = spark.createDataFrame([(1, 1, "Elector's Name : A\nHouse No : 1\nAge : 30 Gender : Male")], "document_id bigint, page_number int, raw_text string")
    found = cards.sequential(pages)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("map_filter(" in line for line in plan.splitlines()) == 1 and found.first()["data"]["name"] == "A"
