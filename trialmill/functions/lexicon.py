"""Word lists, patterns and constants that fix the meaning of the text operators."""

# The words and patterns below define the published feature set, so
# results depend on every entry.

FRACTION_WORDS = ["half", "quarter", "third", "fourth", "fifth", "fraction", "divided by"]
MONEY_WORDS = ["dollar", "cent", "price", "cost", "pay", "paid"]
COMPARISON_WORDS = ["more", "less", "fewer", "greater", "smaller", "times", "twice", "triple", "double"]
TIME_PATTERN = "hours?|minutes?|seconds?|days?|weeks?|months?|years?|morning|afternoon|evening"
QUESTION_PHRASES = [("how many", "how_many"), ("how much", "how_much"), ("what is", "what_is")]

NEGATION_WORDS = ["no", "not", "never", "neither", "none", "nobody", "nothing", "nowhere", "without"]
LOGIC_WORDS = ["if", "then", "implies", "therefore", "thus", "hence", "because", "since", "when", "unless"]
QUANTIFIER_WORDS = ["all", "every", "each", "some", "any", "most", "few", "many", "several", "none"]

TOPIC_WORDS = {
    "agriculture": [
        "eat", "bake", "fruit", "cook", "slice", "apple", "orange", "vegetable", "farm", "harvest", "plant", "grow",
        "food", "banana", "tomato", "potato", "carrot", "lettuce", "berry", "grape", "melon", "peach", "pear",
        "cherry", "lemon", "kiwi",
    ],
    "commerce": [
        "buy", "sell", "cost", "price", "dollar", "pay", "money", "store", "shop", "discount", "spend", "earn",
        "profit", "purchase", "sale", "market", "customer", "cashier", "receipt",
    ],
    "inventory": [
        "book", "toy", "card", "stamp", "collect", "item", "box", "container", "stack", "pile", "shelf", "marble",
        "sticker", "comic", "coin", "figurine", "doll", "game", "puzzle",
    ],
    "travel": [
        "drive", "mile", "speed", "trip", "travel", "distance", "car", "train", "plane", "walk", "run", "bike",
        "road", "highway", "route", "destination", "journey", "commute",
    ],
    "time": [
        "day", "week", "month", "hour", "minute", "year", "schedule", "calendar", "morning", "evening", "night",
        "afternoon", "deadline", "appointment", "shift", "period",
    ],
    "nature": [
        "fog", "rain", "weather", "ocean", "river", "lake", "mountain", "forest", "animal", "fish", "bird", "tree",
        "flower", "storm", "wind", "cloud", "sun", "snow", "desert", "beach",
    ],
    "education": [
        "student", "teacher", "class", "school", "grade", "exam", "homework", "study", "learn", "read", "write",
        "test", "lecture", "professor", "university", "college", "course",
    ],
    "construction": [
        "build", "house", "room", "wall", "floor", "area", "perimeter", "length", "width", "height", "square",
        "feet", "meter", "yard", "inch", "building", "apartment",
    ],
}

TEMPLATE_TOPIC_WORDS = {
    "agriculture": [
        "eat", "bake", "fruit", "cook", "slice", "apple", "orange", "vegetable", "farm", "harvest", "plant", "grow",
        "food",
    ],
    "commerce": [
        "buy", "sell", "cost", "price", "dollar", "pay", "money", "store", "shop", "discount", "spend", "earn",
        "profit",
    ],
    "inventory": ["book", "toy", "card", "stamp", "collect", "item", "box", "container", "stack", "pile", "shelf"],
    "travel": [
        "drive", "mile", "speed", "hour", "trip", "travel", "distance", "car", "train", "plane", "walk", "run",
        "bike",
    ],
    "time": [
        "day", "week", "month", "hour", "minute", "year", "schedule", "calendar", "morning", "evening", "night",
    ],
    "nature": ["fog", "rain", "weather", "ocean", "river", "lake", "mountain", "forest", "animal", "fish", "bird"],
    "education": [
        "student", "teacher", "class", "school", "grade", "exam", "homework", "study", "learn", "read", "write",
    ],
    "construction": [
        "build", "house", "room", "wall", "floor", "area", "perimeter", "length", "width", "height",
    ],
}

FALLBACK_TOPIC = "general"

OBJECT_STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "minutes", "hours", "days", "dollars", "feet", "miles", "percent",
    "times",
]

CREDENTIAL_PATTERNS = [
    r"sk-[a-zA-Z0-9]{32,}",
    r"sk-ant-[a-zA-Z0-9-]+",
    r"anthropic-[a-zA-Z0-9]+",
    r"key-[a-zA-Z0-9]{32,}",
]
REDACTED = "[REDACTED]"

# Words by which solver messages are told apart, and fence tags.
SYNTAX_HINTS = ["syntax error", "unexpected", "parsing failed", "parse error"]
GROUNDING_HINTS = ["unsafe", "global variable", "grounding stopped"]

CODE_TAGS = ["asp", "prolog", "clingo", ""]

ERROR_CATEGORIES = [
    "SYNTAX", "GROUNDING", "TIMEOUT", "UNSAT", "NO_ANSWER", "AMBIGUOUS", "RUNTIME", "cycle_detected",
    "max_iterations",
]
WRONG_ANSWER = "INCORRECT_ANSWER"
UNKNOWN_ERROR = "UNKNOWN"

# dollars per million tokens: (input, output)
PRICES = {"large": (2.50, 10.00), "small": (0.15, 0.60)}
DEFAULT_MODEL = "large"

VARIANTS = ["base", "p1", "p2", "noop"]
SYSTEMS = ["baseline_large", "baseline_small", "fixed_slow", "bandit", "random"]

UNIT_FACTORS = [
    ("feet", "inches", 12),
    ("yards", "feet", 3),
    ("miles", "feet", 5280),
    ("meters", "centimeters", 100),
    ("kilometers", "meters", 1000),
    ("pounds", "ounces", 16),
    ("kilograms", "grams", 1000),
    ("tons", "pounds", 2000),
    ("hours", "minutes", 60),
    ("minutes", "seconds", 60),
    ("days", "hours", 24),
    ("weeks", "days", 7),
    ("dollars", "cents", 100),
]

SAMPLE_COLLECTIONS = {
    "fractions": {
        "half": 0.5,
        "one-third": 1 / 3,
        "two-thirds": 2 / 3,
        "one-fourth": 0.25,
        "three-fourths": 0.75,
        "one-fifth": 0.2,
        "two-fifths": 0.4,
        "three-fifths": 0.6,
        "four-fifths": 0.8,
    },
    "fraction_decimals": [0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.75, 0.8, 0.9],
    "currencies_sym": ["$", "€", "£", "¥"],
    "currencies_word": ["dollars", "euros", "pounds", "yen"],
    "time_units": ["minutes", "hours", "days", "weeks"],
    "distance_units": ["miles", "kilometers", "meters", "feet"],
    "weight_units": ["pounds", "kilograms", "grams", "ounces"],
}

LITERATURE_RRR = 0.35
TARGET_RRR = 0.98
# end of fixed values
