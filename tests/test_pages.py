"""Structure pages of small documents: each way to be accepted, each way to end, and content without place."""

from docrecon.operators import structure_pages as P

COLUMNS = "doc string, page int, idx int, y0 double, text string, size double, color int, is_title boolean, marked boolean, bold boolean"
BLUE, GREEN, GREY = 0x0000FF, 0x00FF00, 0x333333


def title(doc, page, text="1. TEMA: A", size=20.0, color=BLUE, idx=0):
    return (doc, page, idx, 0.0, text, size, color, True, True, True)


def words(doc, page, text="metin", size=10.0, idx=5, bold=False):
    return (doc, page, idx, 50.0, text, size, GREY, False, bold, bold)


def hint(doc, page, size=18.0):
    return words(doc, page, "Programın Yapısı", size, 1, True)


def found(spark, rows):
    made = P.structure_pages(spark.createDataFrame(rows, COLUMNS))
    return {r.doc: (r.heading_page, r.title_page, r.why, r.last_page, r.code) for r in made.collect()}


def test_acceptance(spark):
    rows = [
        # a line of the contents on page 1 and the heading on page 3, where the sample stands; page 4 ends at a large text
        hint("a", 1), hint("a", 3), title("a", 3, "1. TEMA: Örnek"), words("a", 4), words("a", 5, "Başlık", 18.0), title("a", 6),
        # the heading two pages earlier, and the next title reads the same; a code in large letters does not end the pages
        hint("b", 1), title("b", 3), words("b", 4, "EBRU.I.1.1. kod", 40.0), title("b", 5, "1. Tema: a"), title("b", 7, "2. TEMA: B"),
        # the same heading eleven pages earlier does not reach
        hint("c", 1), title("c", 12), title("c", 13), title("c", 14, "2. TEMA: B"),
        # a small first title without any heading; an empty page 3 ends its pages
        title("d", 1, size=12.0), words("d", 2), words("d", 3, "  "), words("d", 4), title("d", 5, "2. TEMA: B"), title("d", 6, "3. TEMA: C"),
        # a title in another colour counts for nothing
        hint("f", 1), title("f", 1, color=GREEN), title("f", 2), title("f", 4, "2. TEMA: B"), title("f", 5, "3. TEMA: C"),
        # no title at all, and content without a place
        words("g", 1), (None, 1, 0, 0.0, "x", 1.0, GREY, True, True, True), ("g", None, 0, 0.0, "x", 1.0, GREY, True, True, True), ("h", 1, 0, 0.0, None, None, None, None, None, None),
    ]
    rows += [title("e", 1)] + [words("e", 1, "Etiket", 8.0, i, True) for i in range(2, 7)] + [title("e", 3, "2. TEMA: B")] + [words("e", 3, "Etiket", 10.0, i, True) for i in range(2, 7)]
    missing = "STRUCTURE_PAGE_NOT_FOUND"
    assert found(spark, rows) == {
        "a": (3, 3, "heading_page", 4, None), "b": (1, 3, "repeated", 4, None), "c": (1, None, None, None, missing), "d": (None, 1, "small", 2, None), "e": (None, 1, "scaled", 1, None),
        "f": (1, None, None, None, missing), "g": (None, None, None, None, missing), "h": (None, None, None, None, missing),
    }


def test_ties_and_nothing(spark):
    assert found(spark, []) == {}
    # repeated rows change nothing; of two colours as frequent the one seen first is that of titles
    rows = [title("a", 1, color=GREEN), hint("a", 1), title("a", 2, "2. TEMA: B")]
    assert found(spark, rows + rows[1:2]) == {"a": (1, 1, "heading_page", 1, None)}
