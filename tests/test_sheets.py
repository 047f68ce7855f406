"""Headers and columns of sheets, as cases."""

import random

from mercadia.sources.sheets import base_table, header_row, price_table
from mercadia.sources.sinks import first_empty_cells


def cells(spark, rows):
    return spark.createDataFrame([("f", "s", r, c, str(v)) for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None], "file string, sheet string, row int, col int, value string")


def test_a_price_table_takes_the_first_header_that_fits(spark):
    # the second header would score higher: it has a barcode column too
    rows = [["TABELA"], ["DESCRICAO", "PRECO"], ["CAFE", "3,50"], ["DESCRICAO", "EAN", "PRECO"], ["ARROZ", "7891000000001", "9,00"]]
    c = cells(spark, rows)
    assert header_row(c).first()["row"] == 3 and header_row(c, first_of=12).first()["row"] == 1
    assert {(r["name"], r["price"]) for r in price_table(c).collect()} >= {("CAFE", 3.5)}
    late = cells(spark, [["x"]] * 12 + [["DESCRICAO", "PRECO"], ["CAFE", "3,50"]])
    assert price_table(late).count() == 0


def test_base_prices_come_from_the_last_column_of_numbers(spark):
    rows = [["PRODUTO", "X", "Y", "OBS"], ["CAFE", "1", "3,50", "a"], ["ARROZ", "2", "9,00", "b"], ["FEIJAO", "3", "8,00", "c"], ["SAL", "4", "2,00", None]]
    got = {r["name"]: r["price"] for r in base_table(cells(spark, rows)).collect()}
    assert got == {"CAFE": 3.5, "ARROZ": 9.0, "FEIJAO": 8.0, "SAL": 2.0}
    # two numbers are too few: then the last column counts, which has none
    assert base_table(cells(spark, [["PRODUTO", "X", "OBS"], ["CAFE", "1", "a"], ["SAL", "2", "b"]])).count() == 0


def test_first_empty_cells_of_random_sheets(spark):
    rng = random.Random(2)
    cells = {(f, r, c): rng.choice(["x", "x", "x", " ", "", None]) for f in range(3) for r in range(30) for c in range(12) if rng.random() < 0.8}
    rows = [(f, 1, r, rng.choice([None, None, 4]), rng.randrange(1, 9)) for f in range(3) for r in range(32)]

    def brute(f, r, preferred, col):
        while preferred is None and (cells.get((f, r, col)) or "").strip():
            col += 1
        return col if preferred is None else preferred

    sheet = spark.createDataFrame([(f, 1, r, c, v) for (f, r, c), v in cells.items()] + [(0, 1, 0, 3, "twice"), (0, 1, 0, 3, "twice")], "file int, sheet int, row int, col int, value string")
    cells[0, 0, 3] = "twice"
    got = first_empty_cells(spark.createDataFrame(rows, "file int, sheet int, row int, price_col int, start_col int"), sheet)
    assert sorted((r.file, r.row, r.col) for r in got.collect()) == sorted((f, r, brute(f, r, p, s)) for f, _, r, p, s in rows)
