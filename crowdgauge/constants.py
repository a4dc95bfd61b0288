"""Fixed values of the domain: thresholds, windows, weights, markers, enumerations."""

HOUR_MS = 3_600_000
DAY_MS = 86_400_000

# Windows.
FRESH_HOURS = 24
CONTEXT_HOURS = 72

# fixed values: deduplication
HAMMING_MAX = 6
MIN_COMMENT_DEDUP_LEN = 8

# fixed values: substance floors
MIN_NOTE_SUBSTANCE = 15
MIN_COMMENT_SUBSTANCE = 6
QUOTE_MIN_SUBSTANCE = 20
BOT_HANDLES = ("问一问",)

# fixed values: matching
STRENGTH = {"safe_alias": 4, "ticker_symbol": 3, "alias+context": 2, "targeted_search": 1}
INDEX_SECTOR = "ETF指数"
INVESTMENT_CLASSES = ("commodity", "bond", "fund", "crypto", "forex")
OTHER_SECTOR = "其他"
QUERY_QUALIFIER = "美股"
TICKER_PATTERN = "^[A-Z]{1,5}$"
SYMBOL_OVERRIDES = {"BRK": "BRK-B", "SKHY": "SKHYV"}

# fixed values: scoring
ASIDE_MAX_HITS = 1
ASIDE_MIN_LEN = 300
ASIDE_WEIGHT = 0.3
FOCUS_MAX_FANOUT = 3
W_NOTE, W_COMMENT, W_NOTE_LIKES, W_COMMENT_LIKES = 3.0, 1.0, 2.0, 0.5
TOP_QUOTE_LEN = 100
MIN_MENTIONS = 2

# fixed values: trend
TREND_PCT = 25
TREND_MIN_ABS_DELTA = 2.0
TREND_PCT_BASE_MIN = 5.0
HISTORY_CYCLES = 30

# fixed values: evidence
MAX_ITEMS = 60
NOTE_TRUNC = 300
COMMENT_TRUNC = 150
HEAD_KEEP = 60
MENTION_TAIL = 40
THREAD_FANOUT_MAX = 2
THREAD_PER_NOTE = 5
FANOUT_ROUNDUP = 4
PARENT_SNIPPET = 30
TITLE_SNIPPET = 20
PREV_SUMMARY_MAX_AGE_MS = 48 * HOUR_MS
PREV_SUMMARY_TRUNC = 300
MAX_POINTS = 4
MAX_QUOTES = 3

# fixed values: budgets per asset class
MAX_STOCKS, MAX_INDEXES, MAX_INVESTMENTS = 15, 3, 5

# fixed values: cost, USD per million tokens
COST_IN_PER_M, COST_OUT_PER_M = 0.14, 0.28

# fixed values: scoreboard
LEAN_MIN = 2
SCOREBOARD_DAYS = 30
MAX_CALLS_SHOWN = 50

# fixed values: retention
RETAIN_CONTENT_DAYS = 7
RETAIN_RUNS_DAYS = 30
PRICE_KEEP_DAYS = 60

# fixed values: crawl-log markers
CAPTCHA_MARKER = "CAPTCHA appeared"
VERIFY_MARKER = "KeyError: 'Verifytype'"
NETWORK_MARKERS = ("ConnectError", "ConnectTimeout", "ReadTimeout", "ProxyError", "SSLError")
RETRY_MARKER = "RetryError"
KEYWORD_MARKER = "Current search keyword"
COMMENT_PHASE_MARKER = "Begin get note id comments"
PHASE_MARKERS = (
    ("Begin get note id comments", "comments"),
    ("update_xhs_note]", "note_details"),
    ("Note details:", "note_details"),
    ("Current search keyword", "search"),
    ("INFO - pausing", "paused"),
)
LOGIN_HINTS = ("扫码", "二维码", "请扫码", "未登录", "登录已过期", "login expired", "login failed")
EXPIRED_MARKERS = (
    "登录已过期",
    "login expired",
    "Login xiaohongshu failed by qrcode login method",
    "have not found qrcode",
)
UNAUTHORIZED_MARKERS = ("没有权限访问",)
CAPTCHA_ALARM = 10
