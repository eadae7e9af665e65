import pytest
from pyspark.sql import functions as F

from pagewarden.functions import boxes, text, values


def one(spark, make):
    return spark.range(1).select(make.alias("x") if not callable(make) else make().alias("x")).first()["x"]


def b(*v):
    return boxes.box(*(F.lit(float(x)) for x in v))


@pytest.mark.parametrize(
    "exact,box,size,want",
    [
        (False, (100.4, 50.6, 80, 100), (1000, 1000), (88, 35, 105, 131)), (False, (2, 3, 10, 10), (640, 480), (0, 0, 16, 17)), (False, (630, 470, 20, 20), (640, 480), (626, 466, 14, 14)), (False, (700, 10, 20, 20), (640, 480), None),
        (True, (100, 100, 240, 300), (1000, 1000), (92, 92, 256, 316)), (True, (10, 10, 120, 18), (1000, 1000), (6, 6, 128, 26)),
    ],
)
def test_padding(spark, exact, box, size, want):
    got = one(spark, lambda: (boxes.pad_exact if exact else boxes.pad)(b(*box), F.lit(size[0]), F.lit(size[1])))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(
    "x,y,word",
    [(0, 0, "top-left"), (600, 20, "top"), (1200, 20, "top-right"), (20, 350, "left"), (600, 350, "center"), (1200, 350, "right"), (20, 700, "bottom-left"), (600, 700, "bottom"), (1200, 700, "bottom-right")],
)
def test_grid_words(spark, x, y, word):
    assert one(spark, lambda: boxes.grid_word(b(x, y, 10, 10), F.lit(1280), F.lit(720))) == word
    assert one(spark, lambda: boxes.grid_word(b(x, y, 10, 10), F.lit(0), F.lit(720))) == "unknown"


def test_geometry(spark):
    assert one(spark, lambda: boxes.iou(b(0, 0, 10, 10), b(5, 0, 10, 10))) == 50 / 150
    assert one(spark, lambda: boxes.iou(b(0, 0, 10, 10), b(10, 0, 10, 10))) == 0
    assert one(spark, lambda: boxes.round1(F.lit(-0.25))) == -0.2
    assert tuple(one(spark, lambda: boxes.to_css(b(3, 3, 3, 3), F.lit(2.0)))) == (1.5, 1.5, 1.5, 1.5)
    assert one(spark, lambda: boxes.norm_line(F.lit(1), b(10, 20, 30, 40), F.lit(100.0), F.lit(200.0))) == "1 0.250000 0.200000 0.300000 0.200000"
    lb = one(spark, lambda: boxes.letterbox(F.lit(1280.0), F.lit(720.0), 640))
    assert tuple(lb) == (0.5, 0.0, 140.0)
    assert one(spark, lambda: boxes.label_clip(b(-30, 0, 40, 40), F.lit(100), F.lit(100))) is None
    assert one(spark, lambda: boxes.element_visible(b(100, 0, 5, 5), F.lit(100), F.lit(100))) and not one(spark, lambda: boxes.in_viewport(b(100, 0, 5, 5), F.lit(100), F.lit(100)))


@pytest.mark.parametrize(
    "s,want",
    [
        ("analyze this page", True), ("what does this form ask for?", True), ("Can you tell me what this page is about", True), ("I want Clean Code and Deep Work. Would a third book make it cheaper? Show the numbers.", True),
        ("Can you fill the form with name John", False), ("Log in", False), ("Search for cheap flights", False), ("Type How are you? into the message box", False),
    ],
)
def test_questions(spark, s, want):
    assert one(spark, lambda: text.is_question(F.lit(s))) is want


def test_text(spark):
    assert one(spark, lambda: text.comes_from(F.lit("John Doe"), F.lit("Fill name John Doe")))
    assert not one(spark, lambda: text.comes_from(F.lit("user123"), F.lit("log in")))
    assert one(spark, lambda: text.comes_from(F.lit(" '' "), F.lit("x")))
    assert one(spark, lambda: text.slug(F.lit("  Full Name (legal)! "))) == "full_name_legal"
    assert one(spark, lambda: text.ellipsis(F.lit("a  b c d e f"), 5)) == "a b …"
    assert one(spark, lambda: text.page_text(F.lit(" a\t b \n\n\n\n c "))) == "a b\n\nc"
    assert one(spark, lambda: text.clean_label(F.lit("Phone (optional) *"))) == "Phone" and one(spark, lambda: text.clean_label(F.lit("*"))) == "*"
    assert one(spark, lambda: text.hidden_summary(F.lit(1), F.lit(2), F.lit(0), F.lit(0))) == "Hidden before sending: 1 face, 2 photos"
    assert one(spark, lambda: text.hidden_summary(F.lit(0), F.lit(None).cast("int"), F.lit(0), F.lit(0))) == "Nothing sensitive found"


def test_values(spark):
    assert [one(spark, lambda v=v: values.confidence(F.lit(v))) for v in ("0.5", "85", "-1", "x", "101")] == [0.5, 0.85, None, None, None]
    assert [one(spark, lambda v=v, s=s: values.milliseconds(F.lit(v), F.lit(s))) for v, s in (("2.5", False), ("1.5", True), ("x", True))] == [2, 1500, None]
    assert [one(spark, lambda v=v: values.boolean(F.lit(v))) for v in (" Yes", "off", "", "maybe")] == [True, False, False, None]
    assert tuple(one(spark, lambda: values.argmax(F.array(F.lit(0.2), F.lit(0.7), F.lit(0.7))))) == (1, 0.7)
    assert tuple(one(spark, lambda: values.argmax(F.array(F.lit(-0.2), F.lit(-0.7))))) == (0, 0.0)
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("filled"), F.lit("yes"))
    assert one(spark, lambda: values.override(m, "filled", F.lit("skipped"))) == {"a": "1", "filled": "skipped"}
    assert one(spark, lambda: values.whitelist(m, ["a"], 100)) == {"a": "1"} and one(spark, lambda: values.whitelist(m, ["z"])) is None
