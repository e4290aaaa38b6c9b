"""Values every stage shares."""

# Features handed to the models, in this order.
MODEL_FEATURES = [
    "log_total_volume",
    "log_max_bet",
    "log_trade_count",
    "avg_bet_usdc",
    "bet_size_ratio",
    "direction_bias",
    "unique_markets",
    "market_concentration_hhi",
    "time_to_news_min",
    "time_span_hours",
]

# All profile features.
PROFILE_FEATURES = [
    "total_volume_usdc",
    "avg_bet_usdc",
    "max_bet_usdc",
    "bet_size_ratio",
    "direction_bias",
    "unique_markets",
    "market_concentration_hhi",
    "trade_count",
    "time_to_news_min",
    "time_span_hours",
    "log_total_volume",
    "log_max_bet",
    "log_trade_count",
]

# Market tags that count as one inventory category, and the tags of any other category.
CATEGORY_TAGS = {
    "regulatory_decision": ["Politics", "Trump", "pardon", "court cases", "Bitcoin", "Crypto", "SEC"],
    "military_geopolitics": ["World", "Geopolitics", "Iran", "Middle East", "Israel", "Venezuela",
                             "Ukraine", "maduro"],
    "corporate_disclosure": ["Business", "AI", "Science", "Google", "Tech", "Pop Culture", "Music"],
}
DEFAULT_TAGS = ["World", "Politics", "Business"]

# Sizes and periods.
DAY_SECONDS = 86_400
PREFIX_LENGTH = 10          # "0x" and eight hex digits
CONTROL_MULTIPLIER = 3      # controls wanted per leaked market
BAND_DAYS = 30              # controls resolve within this many days of a leaked market
K_VALUES = [10, 20, 50, 100, 200]
EPS = 1e-9

LABEL = "is_leaked_market"
