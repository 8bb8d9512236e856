"""Names, levels, formats and parameters that results depend on."""

# Column names of the two input tables, by position.
LOAD_COLUMNS = ["datetime", "puissance"]
WEATHER_COLUMNS = [
    "datetime", "temp", "pression", "hr", "p_rosee", "visi", "vt_moy",
    "vt_raf", "vt_dir", "rr_3h", "neige", "nebul",
]

# Factor levels, in their order.
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
MONTHS = [
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
]
DIRECTIONS = ["North", "East", "South", "West"]
SEASONS = ["summer", "winter"]
HOUR_LABELS = ["H0", "H3", "H6", "H9", "H12", "H15", "H18", "H21"]
LEVELS = {
    "Weekday": WEEKDAYS,
    "Month": MONTHS,
    "rose_vt": DIRECTIONS,
    "f_season": SEASONS,
    "f_hour": HOUR_LABELS,
}

# Calendar rules.
HOLIDAYS = ["01/01", "01/05", "08/05", "14/07", "15/08", "01/11", "25/12"]  # dd/MM
SUMMER_FIRST_MONTH, SUMMER_LAST_MONTH = 4, 10
EVENING_HOUR = {"summer": 21, "winter": 18}
MIDNIGHT_LAST_HOUR = 2
DIRECTION_EDGES = [0, 45, 135, 225, 315]

# Hours per slot and the targets of a slot.
SLOT_HOURS = 3
TARGETS = ["P0", "DP1", "DP2"]
FORECAST_END = "2016-09-20 23:00:00"

# The eight feature sets (factors, numerics, others).
FEATURE_SETS = {
    1: (
        ["Month", "Weekday"],
        ["temp", "pression", "hr", "p_rosee", "visi", "vt_moy", "vt_raf", "vt_dir", "rr_3h", "nebul"],
        ["Hour"],
    ),
    2: (
        ["Month", "Weekday"],
        ["temp", "pression", "hr", "p_rosee", "visi", "vt_moy", "vt_raf", "vt_dir", "rr_3h"],
        ["Hour"],
    ),
    3: (
        ["Month"],
        ["temp", "pression", "hr", "p_rosee", "visi", "vt_moy", "vt_raf", "vt_dir", "rr_3h"],
        ["Hour"],
    ),
    4: (
        ["Month", "Weekday"],
        ["temp", "pression", "hr", "p_rosee", "visi", "vt_moy", "vt_raf", "vt_dir", "rr_3h", "nebul"],
        ["Hour", "f_weekend"],
    ),
    5: (
        ["Month", "Weekday"],
        ["temp", "pression", "hr", "p_rosee", "visi", "vt_moy", "vt_raf", "vt_dir", "rr_3h", "nebul"],
        ["Hour", "f_weekend", "f_evening"],
    ),
    6: (
        ["Month", "Weekday", "rose_vt"],
        ["temp", "pression", "hr", "p_rosee", "visi", "vt_moy", "vt_raf", "rr_3h", "nebul"],
        ["Hour", "f_weekend", "f_evening"],
    ),
    7: (
        ["Month", "rose_vt", "Weekday", "f_season"],
        ["temp", "pression", "hr", "p_rosee", "visi", "vt_raf", "rr_3h", "nebul"],
        ["Hour", "f_weekend"],
    ),
    8: (
        ["Month", "rose_vt", "f_weekend", "Hour"],
        ["temp", "pression", "hr", "p_rosee", "visi", "vt_raf", "rr_3h", "nebul"],
        [],
    ),
}

# Boosting parameters per preparation and feature set:
# (rounds, step size, minimum rows per child, row subsample). Depth is 15 everywhere.
BOOST_DEPTH = 15
BOOSTING = {
    ("impute_global_scale_global", 1): (1000, 0.01, 1, 1.0),
    ("impute_global_scale_global", 2): (1000, 0.01, 1, 1.0),
    ("impute_group", 2): (2000, 0.01, 1, 1.0),
    ("impute_group_scale_global", 1): (2000, 0.1, 1, 1.0),
    ("impute_group_scale_global", 2): (2000, 0.1, 1, 1.0),
    ("impute_group_scale_global", 3): (2000, 0.1, 1, 1.0),
    ("impute_group_scale_global", 4): (2000, 0.1, 1, 1.0),
    ("impute_group_scale_global", 5): (2000, 0.1, 1, 1.0),
    ("impute_group_scale_global", 6): (2000, 0.1, 1, 1.0),
    ("impute_group_scale_global", 7): (300, 0.01, 5, 1.0),
    ("impute_group_scale_global", 8): (2000, 0.1, 1, 1.0),
    ("scale_group", 1): (300, 0.01, 3, 1.0),
    ("scale_group", 2): (300, 0.01, 3, 1.0),
    ("scale_group", 3): (500, 0.01, 3, 0.8),
    ("scale_group", 4): (300, 0.01, 3, 1.0),
    ("scale_group", 5): (300, 0.01, 3, 1.0),
    ("scale_group", 6): (300, 0.01, 3, 1.0),
    ("scale_group", 7): (300, 0.01, 5, 1.0),
    ("scale_group", 8): (300, 0.01, 3, 1.0),
}
HOLDOUT_TRAIN_SHARE = 0.79
SPLIT_TRAIN_SHARE = 0.75
HOLDOUT_REPEATS = 70
