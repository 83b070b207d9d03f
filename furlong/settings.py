"""Values the whole library shares.

lists the choices (D1-D17) and this module holds their numbers.
"""

# The odds band of the bet-selection strategy, both ends included.
ODDS_BAND = (10.0, 50.0)

# Share of the evaluation set that counts as "top".
TOP_SHARE = 0.10

# Chronological train / valid shares; the rest is the test split.
TRAIN_SHARE = 0.60
VALID_SHARE = 0.20

# Floor under a probability before its logarithm is taken.
PROB_FLOOR = 1e-15

# Bootstrap replicates and interval ends.
REPLICATES = 1000
INTERVAL = (0.025, 0.975)

# Odds from which a win counts as an upset.
UPSET_ODDS = 10.0

# Winsorisation quantiles.
WINSOR = (0.01, 0.99)

# Upset types.
VETERAN_STARTS = 10
VETERAN_REST_DAYS = 60

# Cross-validation folds.
FOLDS = 5

# Identifier columns that must stay strings.
ID_COLUMNS = ("hrNo", "jkNo", "trNo", "owNo")

# The two dataset versions whose recipe is known, and the
# versions that must not be used for new training.
NAMED_VERSIONS = ("v1_base", "v2_standard")
RETIRED_FOR_TRAINING = ("v5", "v6", "v7", "v8")
