"""Constants that results depend on, stated once.

All of them are defaults; every operator takes them as a parameter.
"""

# Link, tag and mention patterns. \s in the source data means
# Unicode white space, written out so that it reads the same in any engine.
SPACE = r"\s\p{Z}\x{1c}-\x{1f}\x{85}"
URL_PATTERN = r"https?://[^" + SPACE + r"]+"
HASHTAG_PATTERN = r"#[A-Za-z]+[A-Za-z0-9\-_]+"
MENTION_PATTERN = r"@[A-Za-z]+[A-Za-z0-9\-_]+"

# Subject keywords deleted before tags are read, in match order.
TAG_KEYWORDS = (
    "coronavirus", "covid19", "covid-19", "covid19italia", "coronavid19",
    "pandemia", "corona", "virus", "covid", "covid_19",
)
# Keywords deleted from post text, and the one rewrite.
TEXT_KEYWORDS = (
    "coronavirus", "covid19", "covid-19", "covid19italia", "coronavid19",
    "pandemia", "corona", "virus", "covid",
)
TEXT_REWRITES = (("vaccino", "vaccinare"),)

# Punctuation replaced by a space (backslash and '#' are not in it).
PUNCTUATION_CLASS = r"""[!"$%&'()*+,\-./:;<=>?\[\]^_`{|}~•@]+"""

# Score bins. Right-closed edges for the training cut and the
# three-way leaning; thresholds for the asymmetric five-way bin.
TRAIN_EDGES = (-1.01, -0.6, -0.2, 0.2, 0.6, 1.01)
BIN_LABELS = ("far_left", "center_left", "center", "center_right", "far_right")
LEANING_EDGES = (-1.01, -0.1, 0.1, 1.01)
LEANING_LABELS = ("left", "center", "right")
SCORE_LIMITS = (-0.5, -0.1, 0.1, 0.5)
BIN_CODES = {"far_left": 0, "center_left": 1, "center": 2, "center_right": 3, "far_right": 4}

# Dates.
EVENT_DATE = "2020-02-24"
ACTIVE_SPLIT_DATE = "2020-02-18"

# Minimum weekly link count of a training user-week.
MIN_WEEKLY_DOMAINS = 3

# Named month sets; sets overlap.
TOPIC_PERIODS = {
    "second_all": (7, 8, 9, 10, 11, 12),
    "middle": (5, 6, 7, 8, 9),
    "all": (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12),
    "end_lock": (5, 6),
    "summer": (7, 8, 9),
    "second_lockdown": (10, 11, 12),
    "first_lockdown": (2, 3, 4),
}
AUTHOR_PERIODS = {
    "first_lock": (3, 4),
    "post_lock": (5, 6),
    "summer": (7, 8, 9),
    "second_lockdown": (10, 11, 12),
}
PERIOD_TITLES = {
    "first_lock": "First Lockdown",
    "post_lock": "End of Lockdown",
    "summer": "Summer",
    "second_lockdown": "Second Lockdown",
}

# Topic number to macro topic.
MACRO_TOPICS = {
    "Xenophobia": (0, 1, 14, 16),
    "Anti-Government": (2, 5, 10, 11, 12, 13, 15, 18),
    "Conspiracies": (3, 6, 8, 9, 17, 19),
    "Other": (4, 7),
}

# Tag groups. A tag belongs to a group when any rule holds; a
# rule holds when all its 'all' patterns are found and its 'no' pattern is not.
TAG_GROUPS = {
    "anti-gov": (
        {"all": ("governo|conte|speranza|pd|m5s|euro|ue|eu",
                 "criminal|vergogn|dimett|irresp|merd|infam|acasa|cazzo|c4zz0")},
        {"all": ("pdiot|pidiot",)},
        {"all": ("dittatura",)},
    ),
    "pro-lock": (
        {"all": ("casa", "stare|sto|stiamo|resto|restare|restiamo|rimanere|rimango|rimaniamo"),
         "no": "cazzo|non|rotto|odio|accidenti|beata|nn|c4zz0|mah"},
        {"all": ("andra|andare", "bene"),
         "no": "sega|cazzo|non|accidenti|beata|nn|c4zz0|mah"},
        {"all": ("uniti", "distanti|restiamo|restare")},
    ),
    "immuni": (
        {"all": ("immuni",), "no": "immuniz|immunit"},
        {"all": ("privacy|tracing|tracciamento",)},
    ),
    "lombardia": (
        {"all": ("lombardia|fontana|gallera",)},
    ),
}

# Region names merged before the join with the population.
REGION_RENAMES = {
    "Friuli Venezia Giulia": "Friuli-Venezia Giulia",
    "P.A. Trento": "Trentino-Alto Adige",
    "P.A. Bolzano": "Trentino-Alto Adige",
}

# Token chunks (marker and padding ids, size, kept share).
CHUNK_SIZE = 256
CHUNK_KEEP = 0.4
CLS_ID, SEP_ID, PAD_ID = 101, 102, 0
TRUNCATE_TOKENS = 128

# Bag-of-words limits and phrase limits.
MAX_FEATURES = 10_000
MIN_DF = 5
MAX_DF = 0.8
DICT_NO_BELOW = 50
PHRASE_MIN_COUNT = 20
PHRASE_THRESHOLD = 10.0
TOKEN_MIN, TOKEN_MAX = 3, 15

# Split shares. Stratified: kept, test, validation; grouped:
# train, validation, test after three halvings.
KEPT_SHARE, TEST_SHARE, VAL_SHARE = 0.005, 0.1, 0.1
GROUPED_SHARES = (("train", 0.625), ("val", 0.125), ("test", 0.25))
SEED = 42

# Posts kept per user by the fetch loop; error markers.
POSTS_PER_USER = 501
LINK_ERROR = "Error"

# Correlation network and decomposition.
CORR_THRESHOLD = 0.49
STL_PERIOD, STL_SEASONAL = 2, 7

# Model table names and order.
METHOD_TITLES = {"frequency": "TF", "onehot": "BIN", "tf_idf": "TF-IDF"}
MODEL_TITLES = {"lasso": "Lasso", "rand_for": "Random Forest",
                "xgboost": "XGBoost", "catboost": "CatBoost"}
MODEL_ORDER = ("Lasso", "Random Forest", "XGBoost", "CatBoost", "AlBERTo")

# Rounding of validation curves per outcome.
CURVE_ROUNDING = {"anger": 3, "pro_lock": 4, "anti_gov": 4, "immuni": 5, "lombardia": 4}

# Multi-part public suffixes (a small part of the public list).
MULTI_SUFFIXES = (
    "ac.uk", "co.at", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz",
    "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co",
    "com.es", "com.hk", "com.mx", "com.my", "com.pl", "com.pt", "com.sg",
    "com.tr", "com.tw", "com.ua", "edu.au", "edu.it", "gov.au", "gov.br",
    "gov.it", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
)
