import pytest

from clausework.operators import layout


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([("d", 1, 100.0, 200.0), ("d", 2, 100.0, 200.0)], "contract_id string, page int, width double, height double")


def test_box_geometry(spark, pages):
    boxes = spark.createDataFrame(
        [
            (1, "d", 2, 10.0, 5.0, 20.0, 6.0, 50.0, 100.0),
            (2, "d", 0, 10.0, 5.0, 20.0, 6.0, None, 0.0),
            (3, "d", 3, 10.0, 5.0, 20.0, 6.0, 50.0, 100.0),
            (4, "d", None, None, None, None, None, None, None),
            (5, "d", 1, None, 5.0, 20.0, 6.0, None, None),
            (6, "d", None, 10.0, 5.0, 20.0, 6.0, None, None),
        ],
        "n int, contract_id string, page int, x_min double, y_min double, x_max double, y_max double, page_width double, page_height double",
    )
    got = {r.n: r for r in layout.box_geometry(boxes, layout.page_offsets(pages)).collect()}
    assert set(got) == {1, 2}
    assert (got[1].left, got[1].top, got[1].width, got[1].height) == (20.0, 226.0, 20.0, 6.0)
    assert (got[2].page, got[2].left, got[2].top, got[2].width, got[2].height) == (1, 10.0, 5.0, 10.0, 6.0)


def test_heights(pages):
    assert layout.document_heights(pages).first().document_height == 416.0


def test_offsets_of_a_hot_document(spark):
    many = spark.range(1, 501).selectExpr("'d' contract_id", "cast(id as int) page", "1.0D width", "cast(id % 7 as double) height")
    plain = {r.page: r.page_offset for r in layout.page_offsets(many).collect()}
    split = {r.page: r.page_offset for r in layout.page_offsets(many, rows_per_task=60).collect()}
    assert plain == split and plain[1] == 0 and plain[3] == 1 + 16 + 2 + 16


def test_offsets_do_not_depend_on_the_split(spark):
    many = spark.range(1, 2001).selectExpr("'d' contract_id", "cast(id as int) page", "1.0D width", "0.1D * id height")
    plain = {r.page: r.page_offset for r in layout.page_offsets(many).collect()}
    split = {r.page: r.page_offset for r in layout.page_offsets(many, rows_per_task=60).collect()}
    assert plain == split and plain[4] == 48.6


def test_assembly(spark):
    pieces = spark.createDataFrame(
        [("d", 2, 0, "c"), ("d", 1, 1, "b"), ("d", 1, 0, "a"), ("d", 10, 0, "e"), ("x", 1, 0, "")],
        "contract_id string, page int, pos int, piece string",
    )
    got = {r.contract_id: r.text for r in layout.assemble_documents(pieces).collect()}
    assert got == {"d": "a b\n\nc\n\ne\n\n", "x": "\n\n"}
