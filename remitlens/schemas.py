"""Table schemas and the column registry used to select by name."""

from pyspark.sql import types as T

ID = "Physician_ID"
RECORD = "Record_ID"
COMPANY = "Company_ID"
LABEL = "Ownership_Indicator"
AMOUNT = "Total_Amount_of_Payment_USDollars"
N_PAYMENTS = "Number_of_Payments"
NATURE = "Nature_of_Payment_or_Transfer_of_Value"
FORM = "Form_of_Payment_or_Transfer_of_Value"

LICENSES = [f"License_State_{i}" for i in range(1, 6)]
SPECIALTIES = [f"Specialty{i}" for i in range(1, 4)]
PRODUCT_GROUPS = ["Code", "Name", "Category", "Type"]
PRODUCT_TYPES = [f"Product_Type_{i}" for i in range(1, 4)]
PRODUCT_COLUMNS = [f"Product_{g}_{i}" for g in PRODUCT_GROUPS for i in range(1, 4)]

MONEY = T.DecimalType(18, 2)
STRING = T.StringType()


def _fields(names, kind=STRING):
    return [T.StructField(n, kind) for n in names]


PHYSICIANS = T.StructType(
    _fields(["id"], T.LongType())
    + _fields(["split_set", "First_Name", "Middle_Name", "Last_Name", "Name_Suffix"])
    + _fields(["City", "State", "Zipcode", "Country", "Province", "Primary_Specialty"])
    + _fields(LICENSES)
)

PAYMENTS = T.StructType(
    _fields([RECORD, ID, COMPANY], T.LongType())
    + _fields([AMOUNT], MONEY)
    + _fields(["Date"])
    + _fields([N_PAYMENTS], T.IntegerType())
    + _fields([FORM, NATURE, "City_of_Travel", "State_of_Travel", "Country_of_Travel"])
    + _fields([LABEL, "Third_Party_Recipient", "Charity", "Third_Party_Covered"])
    + _fields(["Contextual_Information", "Related_Product_Indicator"])
    + _fields(PRODUCT_COLUMNS)
)

COMPANIES = T.StructType(_fields([COMPANY], T.LongType()) + _fields(["Name", "State", "Country"]))

SUBMISSION = T.StructType(_fields(["id"], T.LongType()) + _fields(["prediction"], T.IntegerType()))
