"""Fixed values that results depend on."""

N_FOLD = 5
SEED = 42
TARGET = "target"
ROW_ID = "row_id"
IS_TEST = "is_test"
FOLD = "fold"
MIN_RATING = 0
MAX_RATING = 20
N_CLASS = MAX_RATING - MIN_RATING + 1

# The start of the cutoff search, also the default cutoffs.
DEFAULT_CUTOFFS = (
    1.5, 2.2, 3.0, 3.8, 4.5, 5.2, 6.0, 6.8, 7.5, 8.3, 9.1, 9.9, 10.7, 11.6, 12.4, 13.2,
)

# How often each rating 0..20 occurs in the population to match.
RATING_COUNTS = (
    62275, 845738, 720948, 595514, 474290, 675938, 437149, 512782, 281732, 279409,
    127267, 66303, 70271, 35746, 16683, 901, 589, 270, 122, 0, 28,
)

# Column roles of the h1 feature set.
H1_CATEGORICAL = (
    "market", "month", "year", "f_1", "f_7", "f_9", "f_16", "f_20", "f_23", "f_24", "f_29",
    "f_31", "f_33",
)
H1_NUMERIC = (
    "customer_id", "customer_id_2", "customer_id_3", "customer_id_4", "f_0", "f_2", "f_3", "f_4",
    "f_5", "f_6", "f_8", "f_11", "f_12", "f_13", "f_14", "f_15", "f_17", "f_18", "f_21", "f_22",
    "f_25", "f_26", "f_27", "f_28", "f_30", "f_32", "f_34", "f_35", "f_36", "f_37", "f_38",
    "f_40", "f_41",
)

# Columns each feature set leaves out, and its interaction columns.
DROP_BASIC = ("date", "f_19")
DROP_WIDE = ("date", "f_10", "f_19", "f_39")
J1_INTERACTIONS = ("f_13", "f_21", "f_15", "f_26")
J4_INTERACTIONS = ("f_8", "f_12", "f_18", "f_11")
J8_INTERACTIONS = ("f_8", "f_12", "f_18", "f_11", "f_13", "f_21", "f_15", "f_26")

# Names of the row statistics and of the composite keys.
STATS = ("min_target_encoding", "max_target_encoding", "median_target_encoding")
COMPOSITE = ("cid_5_month_market", "cid_3_month_market")
