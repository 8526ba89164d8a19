"""Physician, payment and company tables derived from the test tables.

The three SELECTs are the adapter specification: one text that Spark and an ANSI
SQL engine both run, so queries and their checks start from equal rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

PHYS_SQL = """
SELECT c_custkey AS id,
 CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split_set,
 concat('F', CAST(c_custkey AS VARCHAR(20))) AS First_Name,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'M' END AS Middle_Name,
 c_name AS Last_Name,
 CASE WHEN c_custkey % 20 = 0 THEN 'JR' ELSE NULL END AS Name_Suffix,
 concat('City', CAST(c_custkey % 50 AS VARCHAR(20))) AS City,
 concat('S', CAST(c_nationkey AS VARCHAR(20))) AS State,
 CAST(10000 + c_custkey AS VARCHAR(20)) AS Zipcode,
 'UNITED STATES' AS Country, CAST(NULL AS VARCHAR(20)) AS Province,
 CASE WHEN c_custkey % 12 = 3 THEN NULL WHEN c_custkey % 4 = 0 THEN c_mktsegment
      WHEN c_custkey % 4 = 1 THEN concat(c_mktsegment, '|Sub', CAST(c_custkey % 7 AS VARCHAR(20)))
      WHEN c_custkey % 4 = 2 THEN concat(c_mktsegment, '|Sub', CAST(c_custkey % 7 AS VARCHAR(20)), '|Focus', CAST(c_custkey % 3 AS VARCHAR(20)))
      ELSE concat(c_mktsegment, '|Sub1|Focus1|Extra') END AS Primary_Specialty,
 CASE WHEN c_custkey % 50 = 49 THEN NULL ELSE concat('S', CAST(c_nationkey AS VARCHAR(20))) END AS License_State_1,
 CASE WHEN c_custkey % 2 = 0 AND c_custkey % 50 <> 49 THEN concat('S', CAST((c_nationkey + 1) % 25 AS VARCHAR(20))) END AS License_State_2,
 CASE WHEN c_custkey % 6 = 0 THEN concat('S', CAST((c_nationkey + 2) % 25 AS VARCHAR(20))) END AS License_State_3,
 CASE WHEN c_custkey % 12 = 0 THEN concat('S', CAST((c_nationkey + 3) % 25 AS VARCHAR(20))) END AS License_State_4,
 CASE WHEN c_custkey % 24 = 0 THEN concat('S', CAST((c_nationkey + 4) % 25 AS VARCHAR(20))) END AS License_State_5
FROM {customer}
"""

PAY_SQL = """
SELECT o_orderkey AS Record_ID, o_custkey AS Physician_ID,
 CASE WHEN o_orderkey % 97 = 0 THEN -1 ELSE o_orderkey % 10 END AS Company_ID,
 CAST(CASE WHEN o_orderkey % 211 = 0 OR o_custkey % 90 = 88 THEN 0 WHEN o_orderkey % 4 = 0 THEN o_totalprice ELSE floor(o_totalprice) / 4096 END AS DECIMAL(18,2)) AS Total_Amount_of_Payment_USDollars,
 concat(substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)),6,2),'/',substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)),9,2),'/',substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)),1,4)) AS Date,
 CASE WHEN o_orderkey % 3 = 0 THEN 1 + o_orderkey % 25 ELSE 1 END AS Number_of_Payments,
 CASE WHEN (o_custkey % 39 = 7 AND o_orderkey % 3 = 0) OR (o_orderpriority = '2-HIGH' AND o_orderkey % 20 = 0) THEN 'Stock, stock option, or any other ownership interest' WHEN o_orderpriority = '1-URGENT' THEN 'Cash or cash equivalent' ELSE 'In-kind items and services' END AS Form_of_Payment_or_Transfer_of_Value,
 CASE o_orderkey % 5 WHEN 0 THEN 'Food and Beverage' WHEN 1 THEN 'Travel and Lodging' WHEN 2 THEN 'Consulting Fee' WHEN 3 THEN 'Education' ELSE 'Food and Beverage' END AS Nature_of_Payment_or_Transfer_of_Value,
 CASE WHEN o_orderkey % 5 = 1 THEN 'City' END AS City_of_Travel, CASE WHEN o_orderkey % 5 = 1 THEN 'S1' END AS State_of_Travel, CASE WHEN o_orderkey % 5 = 1 THEN 'United States' END AS Country_of_Travel,
 CASE WHEN (o_custkey % 39 = 7 AND o_orderkey % 3 = 0) OR o_orderkey % 1009 = 8 THEN 'Yes' ELSE 'No' END AS Ownership_Indicator,
 CASE WHEN o_orderkey % 11 = 0 THEN 'Entity' WHEN o_orderkey % 11 = 1 THEN 'Individual' ELSE 'No Third Party Payment' END AS Third_Party_Recipient,
 CASE WHEN o_orderkey % 2 = 0 THEN 'No' END AS Charity,
 CASE WHEN o_orderkey % 11 = 0 THEN 'No' END AS Third_Party_Covered,
 CASE WHEN o_orderkey % 17 = 0 THEN 'context' END AS Contextual_Information,
 CASE WHEN o_orderkey % 16 = 0 THEN 'No' ELSE 'Yes' END AS Related_Product_Indicator,
 CASE WHEN o_orderkey % 16 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'Device' WHEN o_orderkey % 7 = 0 THEN 'Biological' ELSE 'Drug' END AS Product_Type_1,
 CASE WHEN o_orderkey % 16 <> 0 AND o_orderkey % 4 = 0 THEN 'Drug' END AS Product_Type_2,
 CASE WHEN o_orderkey % 16 <> 0 AND o_orderkey % 8 = 0 THEN 'Medical Supply' END AS Product_Type_3,
 CASE WHEN o_orderkey % 16 = 0 THEN NULL ELSE concat('P', CAST(o_orderkey % 40 AS VARCHAR(20))) END AS Product_Name_1,
 CASE WHEN o_orderkey % 16 <> 0 AND o_orderkey % 4 = 0 THEN concat('P', CAST(o_orderkey % 41 AS VARCHAR(20))) END AS Product_Name_2,
 CASE WHEN o_orderkey % 16 <> 0 AND o_orderkey % 8 = 0 THEN concat('P', CAST(o_orderkey % 43 AS VARCHAR(20))) END AS Product_Name_3,
 CASE WHEN o_orderkey % 16 <> 0 AND o_orderkey % 9 = 0 THEN concat('NDC', CAST(o_orderkey % 40 AS VARCHAR(20))) END AS Product_Code_1,
 CAST(NULL AS VARCHAR(20)) AS Product_Code_2, CAST(NULL AS VARCHAR(20)) AS Product_Code_3,
 CASE WHEN o_orderkey % 16 = 0 THEN NULL ELSE concat('Cat', CAST(o_orderkey % 6 AS VARCHAR(20))) END AS Product_Category_1,
 CASE WHEN o_orderkey % 16 <> 0 AND o_orderkey % 4 = 0 THEN 'Cat1' END AS Product_Category_2,
 CASE WHEN o_orderkey % 16 <> 0 AND o_orderkey % 8 = 0 THEN 'Cat2' END AS Product_Category_3
FROM {orders} WHERE o_custkey % 70 <> 69
"""

COMP_SQL = """
SELECT s_suppkey AS Company_ID, s_name AS Name, CASE WHEN s_suppkey % 9 = 8 THEN NULL ELSE concat('S', CAST(s_nationkey AS VARCHAR(20))) END AS State,
 CASE WHEN s_suppkey % 4 = 3 THEN 'Ireland' ELSE 'United States' END AS Country FROM {supplier}
"""


# Declared, so that a scan reads no footers before it runs.
SOURCES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
}


@dataclass(frozen=True)
class Tables:
    """Lazily derived inputs of one test folder."""

    spark: SparkSession
    folder: str

    def _derive(self, text: str, source: str) -> DataFrame:
        path = f"{self.folder}/{source}.parquet"
        table = self.spark.read.schema(SOURCES[source]).parquet(path)
        return self.spark.sql(text, **{source: table})

    @cached_property
    def phys(self) -> DataFrame:
        return self._derive(PHYS_SQL, "customer")

    @cached_property
    def pay(self) -> DataFrame:
        return self._derive(PAY_SQL, "orders")

    @cached_property
    def comp(self) -> DataFrame:
        return self._derive(COMP_SQL, "supplier")


def oracle_ctes() -> str:
    return ", ".join(
        f"{name} AS ({text.strip().format(**{source: source})})"
        for name, text, source in (
            ("phys", PHYS_SQL, "customer"),
            ("pay", PAY_SQL, "orders"),
            ("comp", COMP_SQL, "supplier"),
        )
    )
