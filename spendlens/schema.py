"""Column names, types and the mapping to the original CSV header."""

from __future__ import annotations

from pyspark.sql import types as T

# The CSV header of the customer file and our column names, in file order.
CSV_TO_COLUMN = {
    "CustomerID": "customer_id",
    "Gender": "gender",
    "Age": "age",
    "Annual Income (k$)": "annual_income_k",
    "Spending Score (1-100)": "spending_score",
}
COLUMN_TO_CSV = {v: k for k, v in CSV_TO_COLUMN.items()}

KEY = "customer_id"
GENDER = "gender"
AGE = "age"
INCOME = "annual_income_k"
TARGET = "spending_score"

BASE_SCHEMA = T.StructType([
    T.StructField(KEY, T.LongType()),
    T.StructField(GENDER, T.StringType()),
    T.StructField(AGE, T.LongType()),
    T.StructField(INCOME, T.LongType()),
    T.StructField(TARGET, T.LongType()),
])
CSV_SCHEMA = T.StructType([T.StructField(COLUMN_TO_CSV[f.name], f.dataType) for f in BASE_SCHEMA])

# Columns required to score a batch (the other base columns are optional).
REQUIRED_FOR_SCORING = (GENDER, AGE, INCOME)

# Derived feature names, in the order they are added.
AGE_GROUP = "age_group"
INCOME_GROUP = "income_group"
DERIVED = (
    AGE_GROUP, INCOME_GROUP, "income_age_ratio", "age_squared", "income_squared",
    "age_income_interaction", "spending_capacity", "young_high_income", "senior_low_income",
)

# The twelve model inputs in training column order.
MODEL_FEATURES = (GENDER, AGE, INCOME) + DERIVED
