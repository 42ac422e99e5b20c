"""Fixed lookup values.

Everything in this module is a constant that results depend on. Values are
listed in their natural order, unchanged, so they can be checked by eye.
"""

from __future__ import annotations

# --- fixed values: form factor (trimmed, lower-cased) -> product category ---
FORM_FACTOR_TO_CATEGORY = {
    "bar": "Smartphone",
    "touchscreen phone": "Smartphone",
    "smartphone": "Smartphone",
    "dual sim": "Smartphone",
    "tablet": "Tablet",
    "laptop": "Laptop",
    "portable speaker": "Bluetooth Speaker",
    "in-ear": "TWS Earbuds",
    "neckband": "Neckband",
    "in-ear wired": "Wired Earphone",
    "smartwatch": "Smartwatch",
    "power bank": "Power Bank",
    "adapter": "Charger & Cable",
    "gaming peripheral": "Gaming Accessory",
    "console": "Gaming Console",
    "flat panel monitor": "Monitor",
    "flat panel": "Monitor",
    "keyboard/mouse": "Keyboard & Mouse",
    "desktop printer": "Printer & Scanner",
    "flatbed scanner": "Printer & Scanner",
    "webcam": "Webcam",
    "smart tv": "Smart TV",
    "streaming stick": "Streaming Device",
    "smart plug": "Smart Plug",
    "ip camera": "CCTV Camera",
    "storage drive": "SSD & HDD",
    "ram module": "RAM",
    "pcie graphics card": "Graphics Card",
    "atx motherboard": "Motherboard",
    "atx / matx": "Motherboard",
    "m.2 / 2.5 inch ssd": "SSD & HDD",
    "3.5 inch hdd": "SSD & HDD",
    "dimm / so-dimm": "RAM",
}

DEFAULT_CATEGORY = "Other"

# --- fixed values: category -> icon ---
CATEGORY_ICON = {
    "Smartphone": "📱",
    "Tablet": "📟",
    "Laptop": "💻",
    "Bluetooth Speaker": "🔊",
    "TWS Earbuds": "🎧",
    "Neckband": "🎵",
    "Wired Earphone": "🎙️",
    "Smartwatch": "⌚",
    "Power Bank": "🔋",
    "Charger & Cable": "🔌",
    "Gaming Accessory": "🎮",
    "Gaming Console": "🕹️",
    "Monitor": "🖥️",
    "Keyboard & Mouse": "⌨️",
    "Printer & Scanner": "🖨️",
    "Webcam": "📷",
    "Smart TV": "📺",
    "Streaming Device": "📡",
    "Smart Plug": "🔌",
    "CCTV Camera": "📹",
    "SSD & HDD": "💾",
    "RAM": "🧠",
    "Graphics Card": "🎴",
    "Motherboard": "🔧",
    "Other": "⚙️",
}

DEFAULT_ICON = "⚙️"

# --- fixed values: pandas' default missing-value tokens for read_csv ---
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# --- fixed values: sentiment labels and thresholds ---
POSITIVE, NEUTRAL, NEGATIVE = "Positive", "Neutral", "Negative"
SENTIMENT_LABELS = [POSITIVE, NEUTRAL, NEGATIVE]
LABEL_THRESHOLD = 0.05

# --- fixed values: canonical model names, in the order a target is scored ---
REGRESSION_MODELS = [
    "Linear Regression (Ridge)",
    "Content-Based Recommendation",
    "Collaborative Filtering",
    "Hybrid Recommendation",
    "GBM Regressor",
]
CLASSIFICATION_MODELS = [
    "Linear (Logistic) Regression",
    "Content-Based Recommendation",
    "Collaborative Filtering",
    "Hybrid Recommendation",
    "Random Forest",
]
REVIEW_NLP_MODELS = [
    "Logistic Regression (Linear)",
    "Content-Based Recommendation",
    "Collaborative Filtering",
    "Hybrid Recommendation",
    "SVM (LinearSVC)",
]

# --- fixed values: feature columns used when a product column is the target ---
NUMERIC_FEATURES = ["_price", "_rating", "_revn", "_weight", "_batt", "_ravg", "_rcnt"]
CATEGORICAL_FEATURES = [
    "availability_status", "manufacturer", "country_of_origin",
    "os", "form_factor", "colour", "ram",
]
REGRESSION_TARGETS = ["price", "total_reviews", "weight", "battery_power_rating"]
RATING_TARGETS = ["rating", "reviews_rating"]

# --- fixed values: English stop words (the list that Apache Spark ML ships, in its order) ---
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()
