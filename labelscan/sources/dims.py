"""Small fixed dimensions: rules, field mapping, corrective actions, vocabulary, status domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Rule key, field key, rule id, description, severity.
RULES = [
    ("manufacturer_info", "manufacturer_or_packer", "Rule 6(1)(a)", "Name & address of manufacturer/packer/importer (Rule 6(1)(a))", "critical"),
    ("product_name", "generic_product_name", "Rule 6(1)(b)", "Common/generic name of the commodity (Rule 6(1)(b))", "critical"),
    ("net_quantity", "net_quantity", "Rule 6(1)(c)", "Net quantity in standard units (Rule 6(1)(c))", "critical"),
    ("mrp", "mrp", "Rule 6(1)(e)", "Maximum Retail Price, inclusive of all taxes (Rule 6(1)(e))", "critical"),
    ("mfg_date", "manufacture_or_packing_date", "Rule 6(1)(d)", "Month & year of manufacture/pre-packing/import (Rule 6(1)(d))", "critical"),
    ("customer_care", "consumer_care", "Rule 6(2)", "Consumer care / complaint contact details (Rule 6(2))", "moderate"),
]
# Rule key, corrective action.
ACTIONS = [
    ("manufacturer_info", "Add the manufacturer's, packer's, or importer's full name and address, prefixed with 'Mfd by' / 'Packed by' / 'Marketed by' as applicable."),
    ("product_name", "Print the common or generic name of the product clearly on the principal display panel."),
    ("net_quantity", "Declare the net quantity in standard units (g, kg, ml, l) in a clearly visible position."),
    ("mrp", "Print the Maximum Retail Price, inclusive of all taxes, prefixed with 'MRP' or the ₹ symbol."),
    ("mfg_date", "Add the month and year of manufacture, packing, or import in MM/YYYY or Month YYYY format."),
    ("customer_care", "Include a customer care contact - phone number, email, or helpline - for consumer complaints."),
]
OTHER_ACTION = "Review the Legal Metrology Rules for this declaration."
# Commodity terms.
VOCABULARY = (
    "biscuit", "biscuits", "cookie", "cookies", "cracker", "crackers", "noodles", "pasta", "soap", "shampoo", "toothpaste",
    "detergent", "tea", "coffee", "ice cream", "flour", "rice", "salt", "sugar", "oil", "juice", "beverage", "snack", "cereal",
    "chocolate", "olive", "olives", "chikki", "almond", "almonds", "cashew", "cashews", "pistachio", "pistachios", "walnut",
    "walnuts", "raisin", "raisins", "peanut", "peanuts", "hazelnut", "hazelnuts", "pecan", "pecans", "fig", "figs",
)
FIELDS = tuple(r[1] for r in RULES)
STATUSES = ("PASS", "REVIEW", "VIOLATION")
LABELS = ("front", "back", "side")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_key string, field_key string, rule_id string, description string, severity string")


def actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACTIONS, "rule_key string, action string")


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(VOCABULARY)], "term string, term_no int")
