"""Parameters of the registered queries, shared with their check in SQL."""

LABELS = 2
TOP_LABELS = 10
YEAR_SAMPLES = {"1995": 300, "1996": 300, "1997": 300, "1998": 300, "1999": 100, "2000": 100, "2001": 100}
YEAR_SPLITS = {"train": ["1995", "1996", "1997", "1998"], "dev": ["1999"], "test": ["2000", "2001"]}
N_TRAIN_GROUPS = 12
N_VALIDATION_GROUPS = 4
FIRST_WORDS = 50
SEGMENT_PATTERN = r"\n+"
SEGMENTS = 64
SEGMENT_WORDS = 128
SEQUENCE = 512
TOKEN_VOCABULARY = 1_000
PAIR_BUDGET = 128
MAX_FEATURES = 1_000
MODELS = tuple(range(8))
TASKS = tuple(range(7))
SEEDS = tuple(range(1, 6))
TOP_SEEDS = 3
PATIENCE = 3
CAP = 100
SVM_VOCABULARY_SIZES = (1_000, 2_000)
#: Share of the train rows that each seed of a baseline draws.
SVM_TRAIN_SHARE = 0.9
