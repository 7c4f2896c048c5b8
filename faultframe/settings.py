"""Default parameters. The workload's published configuration."""

TARGET_FS = 100.0
WIN_SEC = 1.0
STEP_SEC = 0.5

LOSS_WEIGHTS = {"fault": 2.0, "type": 1.0, "sev": 1.0}

BOOST_TREES, BOOST_DEPTH, BOOST_RATE, BOOST_ROWS, BOOST_COLUMNS = 300, 8, 0.1, 0.8, 0.8
FOREST_TREES = 200
ISOLATION_TREES = 200
KNN_K = 5
DEMO_WINDOWS = 200
TABLE_WINDOWS = 30
TOP_CHANNELS = 6

# Largest number of rows a side may have, by schema or parameter, to be broadcast.
BROADCAST_ROWS = 100_000
