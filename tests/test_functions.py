"""Cases of the Column functions."""

import random

import pytest
from pyspark.sql import functions as F

from mercadia.functions import codes, names, prices, text
from mercadia.functions.similarity import token_set_ratio, token_sort_ratio
from mercadia.sources import sheets


def run(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (codes.clean_ean, {"7891234567895": "7891234567895", "7.891234567895E12": "7891234567895", "'789-123-456-789-5'": "7891234567895", "0012345670": "12345670", "123": "", "cod 7891234567895 x": "7891234567895", None: "", "NaN": "", "1234567890123456": "", " 7891234567895﻿": "7891234567895"}),
        (codes.clean_ean_page, {"123": "", "7891234567895": "7891234567895", "abc": ""}),
        (codes.clean_ean_offer, {"00012345670": "00012345670", "1-2": ""}),
        (codes.clean_ean_photo, {"00012345670": "12345670", "0001": ""}),
        (codes.unit_ean_of_dun14, {"17891234567892": "7891234567895", "07891234567892": "", "7891234567895": ""}),
        (codes.tax_document_kind, {"529.982.247-25": "cpf", "111.111.111-11": None, "529.982.247-24": None, "11.222.333/0001-81": "cnpj", "11222333000180": None, "": None, None: None}),
        (codes.clean_phone, {"(11) 91234-5678": "5511912345678", "1.1997501798E+10": "5511997501798", "123 ::: 011 91234-5678": "5511912345678", "nan": None, "": None, None: None, "12345": None}),
        (prices.table_price, {"R$ 1,99": 1.99, "1.234,56": None, "-1": None, "0": None, "x": None, None: None}),
        (prices.page_price, {"1.234,56": 1234.56, "3.121": 3.121, "1.234.567": 1234.567, "12.5": 12.5, "": None}),
        (prices.merge_price, {"R$ 1.234,56": 1234.56, "3.121": 3121.0, "-2": None, "2,5": 2.5}),
        (prices.typed_price, {"R$ 3.121": 3121.0, "2,50 cada": 2.5, "x": 0.0, None: 0.0}),
        (prices.package_units, {"12": "12", "12,5": "12,5", "0": None, "10000": None, "x": None, "6.0": "6"}),
        (prices.package_quantity, {"CX-12": 12, "12X750GR": 12, "C/ 24": 24, "24UN": 24, "380G": None, "UN": None, "EV-6": 6}),
        (sheets.column_index, {"A": 0, "D": 3, "4": 3, "AA": 26, "XFD": 16383, "XFE": None, "16385": None, "": None, "0": None}),
        (text.word_key, {"INDÚSTRIA M. Dias": "dias|m", "Turbinado": "", None: ""}),
        (text.offer_key, {"  Água  CX 12 UN ": "agua caixa 12 unidade"}),
        (text.description_key, {"Suco Pó 1,5 Litros & Cia": "ref po 1.5l e cia", "100 gr": "100g"}),
        (text.redact_detail, {"a@b.co 123456789 access_token=xyz&k": "[email] [number] access_token=[redacted]&k", None: ""}),
        (text.escape_csv, {'a;"b"': '"a;""b"""', "ab": "ab"}),
        (text.escape_html, {"<a & 'b'>": "&lt;a &amp; &#039;b&#039;&gt;"}),
        (text.slug, {" Oferta São João! ": "oferta-sao-joao"}),
        (names.normal_name, {"Sabão em Pó Omo 1,6 kg": "LAVA ROUPA PO OMO 1.6KG", "BISCOITO X C/4": "BISC X C4", "SHAMPOO SEDA 325 ml 12 unidades": "SH SEDA 325ML C12", "AGUA 500M": "AGUA 500ML", "PAPEL ALUMINIO 45X4": "PAPEL ALUM 45X4", None: "", "nan": ""}),
        (names.measures, {"CAFE 500G": ["500G"], "KIT 2X500G": ["500G"], "X": []}),
        (names.foil_sizes, {"PAPEL ALUM 45X7.5": ["7.5X45.0"], "FILME 45X7.5": []}),
        (names.package_counts, {"X C12 CX 3": ["C:12", "CX:3"]}),
    ],
    ids=lambda x: getattr(x, "__name__", ""),
)
def test_cases(spark, function, cases):
    assert dict(zip(cases, run(spark, function, list(cases)))) == cases


def test_unit_code_is_found_again_in_any_package_code(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(f"789{rng.randrange(10**9):09d}",) for _ in range(200)], "core string")
    package = F.concat(F.lit("1"), F.col("core"))
    df = df.withColumn("ean", F.concat("core", codes.ean13_check(F.col("core")))).withColumn("dun", F.concat(package, codes.dun14_check(package)))
    assert df.where(codes.unit_ean_of_dun14(F.col("dun")) != F.col("ean")).count() == 0


def test_ratios():
    assert token_sort_ratio("B A", "A B") == 100
    assert token_set_ratio("A B", "A B C") == 100
    assert token_set_ratio("", "A") == 0
    assert token_sort_ratio("ABCD", "ABXD") == 75
    assert 0 < token_set_ratio("CAFE PILAO", "CAFE UNIAO") < 100


def test_barcode_in_a_name(spark):
    out = run(spark, sheets.ean_in_name, ["7891234567895 - Café", "Café 7891234567895", "123 - x"])
    assert [(r["ean"], r["name"]) for r in out] == [("7891234567895", "Café"), ("", "Café 7891234567895"), ("", "123 - x")]
