"""Reshaping, encoding and feature tables."""

from pyspark.sql import functions as F

from remitlens.catalog.registry import query
from remitlens.functions.values import percent, prefixed, split_parts
from remitlens.operators.aggregates import share_of_total
from remitlens.operators.joins import join_skewed
from remitlens.operators.ordering import with_row_index
from remitlens.operators.reshape import (
    compact_array,
    one_hot,
    pivot_values,
    slot_counts,
    unpivot_groups,
    unpivot_slots,
)
from remitlens.plans import blocks
from remitlens.plans.clean import split_specialties, transactions_of_all
from remitlens.plans.features import align, labels, long_features, one_side
from remitlens.plans.jobs import transaction_entries
from remitlens.schemas import (
    AMOUNT,
    FORM,
    ID,
    LICENSES,
    NATURE,
    PRODUCT_GROUPS,
    PRODUCT_TYPES,
    RECORD,
    SPECIALTIES,
)


def _slots(columns, value):
    return " UNION ALL ".join(
        f"SELECT id, {i} AS slot, {c} AS {value} FROM phys WHERE {c} IS NOT NULL"
        for i, c in enumerate(columns, 1)
    )


@query(_slots(LICENSES, "licensed_in"))
def unpivot_drop_null(t):
    return unpivot_slots(
        t.phys.select("id", *LICENSES), ["id"], "License_State_", "slot", "licensed_in"
    )


@query(
    " UNION ALL ".join(
        f"""SELECT Record_ID, {i} AS slot, Product_Code_{i} AS Code, Product_Name_{i} AS Name,
        Product_Category_{i} AS Category, Product_Type_{i} AS Type FROM pay WHERE
        coalesce(Product_Code_{i}, Product_Name_{i}, Product_Category_{i}, Product_Type_{i})
        IS NOT NULL"""
        for i in (1, 2, 3)
    )
)
def unpivot_multi_value(t):
    return unpivot_groups(t.pay, [RECORD], "Product_", PRODUCT_GROUPS, 3, "slot")


PARTS = "nullif(split_part(Primary_Specialty, '|', {i}), '')"


@query(
    """SELECT l.id, l.slot AS license_slot, l.licensed_in, s.slot AS specialty_slot,
    s.specialty_in FROM lic l JOIN spec s ON l.id = s.id""",
    f"lic AS ({_slots(LICENSES, 'licensed_in')}), spec AS ("
    + " UNION ALL ".join(
        f"SELECT id, {i} AS slot, {PARTS.format(i=i)} AS specialty_in FROM phys "
        f"WHERE {PARTS.format(i=i)} IS NOT NULL"
        for i in (1, 2, 3)
    )
    + ")",
)
def unpivot_two_groups(t):
    """Every license of a recipient with every specialty part."""

    def slots(columns, value):
        filled = [
            F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("slot"), F.col(c).alias("v")))
            for i, c in enumerate(columns, 1)
        ]
        return F.explode(compact_array(filled)).alias(value)

    people = split_specialties(t.phys)
    one = people.select("id", *SPECIALTIES, slots(LICENSES, "l"))
    both = one.select("id", "l", slots(SPECIALTIES, "s"))
    return both.select(
        "id",
        F.col("l.slot").alias("license_slot"),
        F.col("l.v").alias("licensed_in"),
        F.col("s.slot").alias("specialty_slot"),
        F.col("s.v").alias("specialty_in"),
    )


@query(
    "SELECT id, "
    + ", ".join(f"{PARTS.format(i=i)} AS Specialty{i}" for i in (1, 2, 3))
    + " FROM phys"
)
def split_to_columns(t):
    return t.phys.select("id", *split_parts(F.col("Primary_Specialty"), SPECIALTIES))


# Fixed values of the SQL checks: the natures, states and one-hot levels of the test tables.
NATURES = ["Consulting Fee", "Education", "Food and Beverage", "Travel and Lodging"]


@query(
    "SELECT Physician_ID AS id, "
    + ", ".join(
        f"""coalesce(round(CAST(sum(CASE WHEN {NATURE} = '{n}' THEN {AMOUNT} END) AS DOUBLE)
        / nullif(CAST(sum({AMOUNT}) AS DOUBLE), 0) * 100, 6), 0) AS "NATURE_ {n}" """
        for n in NATURES
    )
    + "FROM pay GROUP BY 1"
)
def pivot_share_wide(t):
    shares = share_of_total(t.pay, ID, [NATURE], AMOUNT).select(
        F.col(ID).alias("id"),
        prefixed("NATURE_", F.col(NATURE)).alias("feature"),
        F.round("pct", 6).alias("value"),
    )
    return pivot_values(shares, "id", "feature", "value")


STATES = [f"S{i}" for i in range(25)]


@query(
    "SELECT id, "
    + ", ".join(
        f"CAST(max(CASE WHEN licensed_in = '{s}' THEN 1 ELSE 0 END) AS INTEGER) AS lic_{s}"
        for s in STATES
    )
    + " FROM lic GROUP BY id",
    f"lic AS ({_slots(LICENSES, 'licensed_in')})",
)
def pivot_indicator_wide(t):
    owned = t.phys.select("id", F.explode(compact_array(LICENSES)).alias("state")).distinct()
    long = owned.select(
        "id", F.concat(F.lit("lic_"), "state").alias("feature"), F.lit(1).alias("value")
    )
    return pivot_values(long, "id", "feature", "value")


ENCODED = {
    "tp_": ("Third_Party_Recipient", ["Entity", "Individual", "No Third Party Payment"]),
    "nature_": (NATURE, NATURES),
    "related_": ("Related_Product_Indicator", ["No", "Yes"]),
    "form_": (
        FORM,
        [
            "Cash or cash equivalent",
            "In-kind items and services",
            "Stock, stock option, or any other ownership interest",
        ],
    ),
}


@query(
    "SELECT Record_ID, "
    + ", ".join(
        f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{prefix}{v}\""
        for prefix, (c, values) in ENCODED.items()
        for v in values
    )
    + " FROM pay"
)
def onehot_encode(t):
    columns = {prefix: c for prefix, (c, _) in ENCODED.items()}
    rows = t.pay.select(RECORD, *columns.values())
    for prefix, column in columns.items():
        rows = one_hot(rows, column, prefix)
    return rows.drop(*columns.values())


SLOTTED = {"TYPE_": PRODUCT_TYPES, "SPEC_": SPECIALTIES, "LICENSE_": LICENSES}
JOINED = f"""joined AS (SELECT pay.*, {', '.join(LICENSES)}, split_set, {', '.join(
        f"{PARTS.format(i=i)} AS Specialty{i}" for i in (1, 2, 3)
    )}, comp.Country AS Company_Country FROM pay JOIN phys ON pay.Physician_ID = phys.id
    LEFT JOIN comp ON pay.Company_ID = comp.Company_ID)"""
SLOT_LEVELS = " UNION ALL ".join(
    f"SELECT Record_ID, concat('{prefix} ', {c}) AS level FROM joined WHERE {c} IS NOT NULL"
    for prefix, columns in SLOTTED.items()
    for c in columns
)


@query(f"SELECT Record_ID, level, count(*) AS n FROM ({SLOT_LEVELS}) GROUP BY 1, 2", JOINED)
def multihot_sum(t):
    """How often each product type, specialty and license state fills a slot of a payment."""

    def tagged(prefix):
        def named(p):
            level = prefixed(prefix, p["level"])
            return F.struct(level.alias("level"), p["n"].cast("bigint").alias("n"))

        return F.transform(slot_counts(SLOTTED[prefix]), named)

    # specialties and licenses are counted once per recipient, before the join
    owned = F.concat(tagged("SPEC_"), tagged("LICENSE_")).alias("owned")
    people = split_specialties(t.phys).select(F.col("id").alias(ID), owned)
    facts = t.pay.select(RECORD, ID, *PRODUCT_TYPES)
    joined = join_skewed(facts, people, ID, RECORD, "inner")
    return joined.select(RECORD, F.inline(F.concat(tagged("TYPE_"), "owned")))


FEATURES = f"""tot AS (SELECT Physician_ID AS id, CAST(sum({AMOUNT}) AS DOUBLE) AS w FROM pay
    GROUP BY 1), feats AS (
    """ + " UNION ALL ".join(
    [
        f"""SELECT p.id, p.feature, coalesce(round(p.s / nullif(w, 0) * 100, 6), 0) AS value
        FROM (SELECT Physician_ID AS id, concat('{tag} ', {c}) AS feature,
        CAST(sum({AMOUNT}) AS DOUBLE) AS s FROM pay WHERE {c} IS NOT NULL GROUP BY 1, 2) p
        JOIN tot ON p.id = tot.id"""
        for tag, c in (("NATURE_", NATURE), ("FORM_", FORM), ("TYPE_", "Product_Type_1"))
    ]
    + [
        f"""SELECT Physician_ID, concat('COMP_ ', CAST(Company_ID AS VARCHAR)),
        round(CAST(sum({AMOUNT}) AS DOUBLE), 6) FROM pay GROUP BY 1, 2""",
        "SELECT DISTINCT id, concat('LICENSE_ ', v), 1.0 FROM ("
        + " UNION ALL ".join(f"SELECT id, {c} AS v FROM phys" for c in LICENSES)
        + ") WHERE v IS NOT NULL AND id IN (SELECT Physician_ID FROM pay)",
        "SELECT DISTINCT id, concat('SPEC_ ', v), 1.0 FROM ("
        + " UNION ALL ".join(f"SELECT id, {PARTS.format(i=i)} AS v FROM phys" for i in (1, 2, 3))
        + ") WHERE v IS NOT NULL AND id IN (SELECT Physician_ID FROM pay)",
    ]
) + ")"

@query("SELECT id, feature, CAST(value AS DOUBLE) AS value FROM feats", FEATURES)
def long_feature_table(t):
    """All share, amount and indicator features of recipients."""
    return long_features(t.phys, t.pay).withColumn("value", F.round("value", 6))


@query(
    """SELECT id, feature, CAST(value AS DOUBLE) AS value FROM feats UNION ALL
    SELECT id, feature, coalesce(value, 0) FROM (
    SELECT Physician_ID AS id, 'TOTAL_AMOUNT' AS feature, round(CAST(sum(a) AS DOUBLE), 6) AS value
    FROM p GROUP BY 1
    UNION ALL SELECT Physician_ID, 'TOTAL_PAYMENTS', CAST(sum(n) AS DOUBLE) FROM p GROUP BY 1
    UNION ALL SELECT Physician_ID, 'MEAN_AMOUNT', round(CAST(sum(a) AS DOUBLE)
    / nullif(CAST(sum(n) AS DOUBLE), 0), 6) FROM p GROUP BY 1
    UNION ALL SELECT Physician_ID, 'MEDIAN_AMOUNT', round(median(CAST(a AS DOUBLE)), 6)
    FROM p GROUP BY 1)""",
    FEATURES + f", p AS (SELECT Physician_ID, {AMOUNT} AS a, Number_of_Payments AS n FROM pay)",
)
def long_feature_table_with_summary(t):
    """The feature table with totals, counts, means and medians."""
    return long_features(t.phys, t.pay, summary=True).withColumn("value", F.round("value", 6))


SINGLE = {
    "COUNTRY_": "Company_Country",
    "FORM_": FORM,
    "NATURE_": NATURE,
    "RELATED_": "Related_Product_Indicator",
}


def _filled(columns) -> str:
    return " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in columns)


@query(
    "SELECT Record_ID, level AS feature, CAST(count(*) AS DOUBLE) AS value FROM ("
    + " UNION ALL ".join(
        f"SELECT Record_ID, concat('{prefix} ', {c}) AS level FROM joined WHERE {c} IS NOT NULL"
        for prefix, c in SINGLE.items()
    )
    + f""" UNION ALL {SLOT_LEVELS}) GROUP BY 1, 2
    UNION ALL SELECT Record_ID, 'AMOUNT', CAST({AMOUNT} AS DOUBLE) FROM joined
    UNION ALL SELECT Record_ID, 'N_LICENSES', CAST({_filled(LICENSES)} AS DOUBLE) FROM joined
    UNION ALL SELECT Record_ID, 'N_PRODUCTS', CAST({_filled(PRODUCT_TYPES)} AS DOUBLE)
    FROM joined""",
    JOINED,
)
def assemble_matrix(t):
    """Design matrix of payments in long form: the ten blocks of the transaction model."""
    rows = transactions_of_all(t.phys, t.pay, t.comp).filter(F.col(RECORD).isNotNull())
    return rows.select(RECORD, F.inline(transaction_entries()))


# Block of a feature, told by its prefix.
BLOCK = "CASE split_part(feature, '_', 1) " + " ".join(
    f"WHEN '{prefix}' THEN '{block}'"
    for prefix, block in zip(("NATURE", "FORM", "TYPE", "COMP", "LICENSE", "SPEC"), blocks.BLOCKS)
) + " END"


def _entries_sql(block: str) -> str:
    entry = "concat(feature, '=', printf('%.6f', CAST(value AS DOUBLE)))"
    listed = f"string_agg(CASE WHEN block = '{block}' THEN {entry} END, ';' ORDER BY feature)"
    return f"coalesce({listed}, '') AS {block}"


@query(
    "SELECT s.id, any_value(s.label) AS label, "
    + ", ".join(map(_entries_sql, blocks.BLOCKS))
    + f""" FROM (SELECT Physician_ID AS id, max(CASE WHEN Ownership_Indicator = 'Yes' THEN 1
    ELSE 0 END) AS label FROM pay GROUP BY 1) s
    LEFT JOIN (SELECT *, {BLOCK} AS block FROM feats) f ON s.id = f.id GROUP BY 1""",
    FEATURES,
)
def join_feature_blocks(t):
    """One row per paid recipient: its label and the features of all six blocks, joined by id."""
    all_blocks = blocks.recipient_blocks(t.phys, t.pay)
    joined = blocks.join_blocks(labels(t.pay).na.fill(0, ["label"]), all_blocks)

    def listed(block):
        entry = lambda e: F.format_string("%s=%.6f", e["feature"], F.round(e["value"], 6))
        return F.array_join(F.transform(block, entry), ";").alias(block)

    return joined.select("id", "label", *[listed(b) for b in all_blocks])


@query(
    f"""SELECT block, CASE WHEN n_test = 0 THEN 'train' ELSE 'test' END AS only_in, feature FROM
    (SELECT block, feature, count(CASE WHEN split_set = 'train' THEN 1 END) AS n_train,
    count(CASE WHEN split_set = 'test' THEN 1 END) AS n_test FROM
    (SELECT id, feature, {BLOCK} AS block FROM feats
    UNION ALL SELECT id, concat('CITY_ ', City), 'city' FROM phys WHERE City IS NOT NULL) f
    JOIN phys ON f.id = phys.id GROUP BY 1, 2) WHERE n_train = 0 OR n_test = 0""",
    FEATURES,
)
def levels_difference(t):
    """Features of all six blocks, and cities, that one side of the predefined split lacks."""
    paid = t.pay.select(F.col(ID).alias("id")).distinct()
    known = blocks.recipient_blocks(t.phys.join(paid, "id", "left_semi"), t.pay)
    city = t.phys.filter(F.col("City").isNotNull())
    named = prefixed("CITY_", F.col("City")).alias("feature")
    known["city"] = city.select("id", named, F.lit(1.0).alias("value"))
    found = blocks.block_dictionary(known, t.phys, F.col("split_set") == "test")
    return found.select("block", one_side(), "feature").filter(F.col("only_in").isNotNull())


@query(
    """SELECT feature, count(CASE WHEN split_set = 'train' THEN 1 END) AS n_train,
    count(CASE WHEN split_set = 'test' THEN 1 END) AS n_test,
    row_number() OVER (ORDER BY feature) - 1 AS idx
    FROM feats JOIN phys ON feats.id = phys.id GROUP BY feature""",
    FEATURES,
)
def align_feature_space(t):
    """Features of both sides with one shared index; counts show where each occurs."""
    sides = t.phys.select("id", "split_set")
    long = long_features(t.phys, t.pay).join(sides, "id")
    both = align(long, F.col("split_set") == "test")
    indexed = with_row_index(both, "feature", name="idx")
    return indexed.withColumn("idx", F.col("idx") - 1)


@query(
    f"""SELECT Physician_ID AS id, coalesce(round(CAST(sum(CASE WHEN Product_Type_1 = 'Device'
    THEN {AMOUNT} END) AS DOUBLE) / nullif(CAST(sum({AMOUNT}) AS DOUBLE), 0) * 100, 6), 0)
    AS device_pct FROM pay GROUP BY 1"""
)
def fill_missing_features_zero(t):
    device = F.sum(F.when(F.col("Product_Type_1") == "Device", F.col(AMOUNT)))
    share = F.round(percent(device, F.sum(AMOUNT)), 6).alias("device_pct")
    return t.pay.groupBy(F.col(ID).alias("id")).agg(share).na.fill(0)
