"""Golden cases of the declaration extractors, all in one table."""

import pytest

from labelscan.operators import extract as ex
from labelscan.operators import words as word_ops
from labelscan.operators.extract import FOUND, NOT_FOUND, UNCERTAIN
from layouts import words

MAKER, PRODUCT, NET, MRP, DATE, CARE = ex.FIELDS

CASES = [
    (("Marketed by Example Foods Ltd", "BISCUITS NET WEIGHT 100 g", "FOR MRP", "45.00", "PKD 22/07/26", "Customer Care 1800123456"),
     {MAKER: (FOUND, None), PRODUCT: (FOUND, "BISCUITS"), NET: (FOUND, "100g"), MRP: (FOUND, "45.00"), DATE: (FOUND, "22/07/26"), CARE: (FOUND, "1800123456")}),
    (("Marketed@76 Example Products", "0.45/g 123456789012"), {MAKER: (UNCERTAIN, None), MRP: (NOT_FOUND, None), CARE: (NOT_FOUND, None)}),
    (("Nutrition Facts Serving size 28g", "Net Weight 250g"), {NET: (FOUND, "250g")}),
    (("Net Weight 2509@78",), {NET: (FOUND, "250g")}),
    (("Batch 2509",), {NET: (NOT_FOUND, None)}),
    (("PISTACHIOS@72", "Nutrition Facts Total SUGAR@96"), {PRODUCT: (FOUND, "PISTACHIOS")}),
    (("CHOCOLATE@96 ICE@90 CREAM@90",), {PRODUCT: (FOUND, "ICE CREAM")}),
    (("CHOCOLATE@96",), {PRODUCT: (FOUND, "CHOCOLATE")}),
    (("MRP", "Date of Packing", "Quality Care info@example@57 74330@65"), {MRP: (UNCERTAIN, None), DATE: (UNCERTAIN, None), CARE: (UNCERTAIN, None)}),
    (("BISCUMTSNETWeIGHT@88 2009@82",), {PRODUCT: (FOUND, "BISCUITS"), NET: (FOUND, "200g")}),
    (("MRP 50.00 0.25 per g",), {MRP: (FOUND, "50.00")}),
    (("PKD 16/44/23",), {DATE: (UNCERTAIN, None)}),
    (("04-33@33",), {DATE: (UNCERTAIN, None)}),
    (("MFD 04/2024",), {DATE: (FOUND, "04/2024")}),
    (("₹300.00 ₹0.40 / ml",), {MRP: (UNCERTAIN, "₹300.00")}),
    (("MRP ₹300.00 ₹0.40 / ml",), {MRP: (FOUND, "₹300.00")}),
    (("Customer Care 1800 123 456",), {CARE: (FOUND, "1800123456")}),
    (("Energy 160 kcal Net Weight 250g MRP Rs.600.00", "Fat 1.5g"), {NET: (FOUND, "250g"), MRP: (FOUND, "Rs.600.00")}),
    (("CALIFORNIA PISTACHIOS@79", "Ingredients: Pistachios,@95 Salt@99"), {PRODUCT: (FOUND, "PISTACHIOS")}),
    (("250g",), {NET: (UNCERTAIN, "250g")}),
    (("PKD 04/2025", "MRP FSSAI Licence"), {PRODUCT: (NOT_FOUND, None)}),
    (("Recommended average adult",), {PRODUCT: (NOT_FOUND, None)}),
    (("Customer Care", "9014600363"), {CARE: (UNCERTAIN, None)}),
    (("NET QUANTITY 450g", "DRAINED QUANTITY 212g@98"), {NET: (FOUND, "450g")}),
    (("NET QUANTITY 450g", "DRAINED", "212g@98"), {NET: (FOUND, "450g")}),
    (("Mfg Date 04/225",), {DATE: (UNCERTAIN, None)}),
    (("Customer Care", "Bharuch Road Gujarat"), {CARE: (UNCERTAIN, None)}),
]


SCHEMA = "id long, words array<struct<text:string,conf:double,left:int,top:int,width:int,height:int,provider:string,original_text:string>>"
MORE = [("Packed and Marketed By", "Example Foods Pvt Ltd"), ("Nutrition Energy 20", "MARKETED BY:", "Nutri Being Pvt Ltd."), ("Marketed By", "Nutrition Foods Pvt Ltd", "Acme Foods Pvt Ltd"), ("Net Weight 2509@78",), ("FOR MRP", "45.00"), ()]


@pytest.fixture(scope="module")
def found(spark):
    """(number of the case, field) -> record, of one job over all cases."""
    rows = [(k, words(*lines)) for k, lines in enumerate([c for c, _ in CASES] + MORE)] + [(900, None)]
    out = {}
    for r in ex.declarations(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect():
        out[r["id"], r["field_key"]] = r
    assert len(out) == 6 * len(rows)
    return out


@pytest.mark.parametrize("case", range(len(CASES)))
def test_golden(found, case):
    for key, (status, value) in CASES[case][1].items():
        own = found[case, key]
        assert (key, own["status"]) == (key, status), own
        if value is not None or status != FOUND:
            assert own["value"] == value, own


def test_maker_names(found):
    n = len(CASES)
    assert "Foods" in found[n, MAKER]["value"] and found[n + 1, MAKER]["value"] == "Nutri Being Pvt"
    assert "Acme" in found[n + 2, MAKER]["value"] and "Nutrition" not in found[n + 2, MAKER]["value"]


def test_evidence(found):
    n = len(CASES)
    net, price = found[n + 3, NET], found[n + 4, MRP]
    assert "2509" in net["evidence_text"] and "Normalized" in net["reason"] and "'250g'" in net["reason"]
    assert price["bbox"]["top"] == 200 and price["matched_marker"] == "MRP"
    assert {found[k, key]["status"] for k in (n + 5, 900) for key in ex.FIELDS} == {NOT_FOUND}


def test_merge_and_rebuild(spark):
    box = lambda text, conf, left: {"text": text, "conf": conf, "left": left, "top": 100, "width": 40, "height": 12}
    rows = [(1, 0, [box("Weight", 55.0, 100)]), (1, 1, [box("Weight", 91.0, 102), box("Weight", 80.0, 300)]), (2, 0, []), (3, 0, None)]
    df = spark.createDataFrame(rows, "id long, pass int, words array<struct<text:string,conf:double,left:int,top:int,width:int,height:int>>")
    out = {r["id"]: r for r in word_ops.merged(df, ["id"], "pass").collect()}
    assert [w["conf"] for w in out[1]["words"]] == [91, 80] and out[2]["words"] == [] and out[3]["words"] == []
    lines = spark.createDataFrame([(1, words("a b", "c")), (2, [])], SCHEMA)
    assert {r["id"]: r["text"] for r in word_ops.rebuilt(lines).collect()} == {1: "a b\nc", 2: ""}
