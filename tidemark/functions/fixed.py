"""Fixed values.

These values must equal the defaults of the system being re-implemented for
results to match; they are listed plainly, in their natural order.
"""

# --- FIXED VALUES (defaults that results depend on) -------------------------

# Aspect categories and their seed terms; a trailing or inner "*" is a wildcard.
DEFAULT_LEXICON = {
    "liquidity": [
        "liquid*", "cash flow", "working capital", "debt", "credit facility",
        "loan", "borrowing", "financing", "capital structure",
    ],
    "guidance": [
        "guidance", "forecast", "outlook", "projection", "estimate",
        "expect*", "anticipate", "target", "goal",
    ],
    "management_change": [
        "resignation", "appoint*", "retire*", "successor", "interim",
        "chief executive", "president", "director", "board",
    ],
    "risk": [
        "risk factor*", "uncertainty", "litigation", "regulatory",
        "compliance", "investigation", "material weakness",
    ],
    "operations": [
        "acquisition", "merger", "divestiture", "restructur*", "consolidat*",
        "expansion", "capacity", "facility", "manufacturing",
    ],
    "financial_performance": [
        "revenue", "earnings", "profit", "margin", "cost", "expense",
        "impairment", "write-down", "charge", "gain", "loss",
    ],
}

# Keyword polarity lists (substring semantics).
POSITIVE_KEYWORDS = [
    "gains", "up", "rises", "surge", "rally", "bullish", "positive",
    "growth", "beat", "exceeds", "outperforms", "upgrade", "buy",
]
NEGATIVE_KEYWORDS = [
    "falls", "down", "drops", "decline", "crash", "bearish", "negative",
    "loss", "miss", "disappoints", "underperforms", "downgrade", "sell",
]

# Allow-list used for ticker mentions in news.
TARGET_TICKERS = [
    "AAPL", "MSFT", "GOOGL", "AMZN", "TSLA", "META", "NVDA", "NFLX",
    "JPM", "JNJ", "V", "PG", "UNH", "HD", "DIS", "MA", "PYPL", "ADBE",
    "CRM", "INTC", "CMCSA", "VZ", "KO", "PFE", "PEP", "WMT", "BAC", "XOM",
]

# Score row returned for blank or unscorable text.
NEUTRAL_SCORES = {"label": "neutral", "positive": 0.33, "negative": 0.33,
                  "neutral": 0.34, "compound": 0.0}

# Filing items cut out of 8-K text.
SECTION_ITEMS = ["1.01", "1.02", "2.02", "7.01", "8.01"]

# Text of an item up to the next "Item <digit>" or the end; {item} is the escaped number.
SECTION_PATTERN = r"(?is)Item\s+{item}[^0-9]*?(.*?)(?=Item\s+[0-9]|$)"

# Prefix of filing URLs built from index file names.
FILING_URL_BASE = "https://www.sec.gov/Archives"

NOVELTY_WINDOW_DAYS = 30
NOVELTY_MIN_HISTORY = 5
SIMILARITY_THRESHOLD = 0.4
MAX_ARTICLES_PER_SOURCE = 50
TRADING_DAYS_PER_YEAR = 252
SMA_WINDOWS = [5, 10, 20, 50]
RETURN_PERIODS = [1, 5, 20]
MIN_PARAGRAPH_LENGTH = 50

# --- end of fixed values ----------------------------------------------------
