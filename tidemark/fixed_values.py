"""Names, tables, patterns, thresholds and texts that results must agree on.

Everything here is data. The rules that use it live next to the operators.
"""

# --- fixed values: ticker universes -----------------------------------------------------------
TICKERS = ["IONQ", "RGTI", "QBTS", "QUBT", "QNT", "IBM", "GOOGL", "MSFT", "HON", "NVDA"]
PURE_PLAY_TICKERS = ["IONQ", "RGTI", "QBTS", "QUBT", "QNT"]

# --- fixed values: evaluation parameters ------------------------------------------------------
HORIZONS = [1, 2, 5, 10, 20]
ABNORMAL_DIRECTION_HORIZONS = [1, 5, 10]
MIN_SCORE = 0.3
MIN_PAIRS_RAW = 10
MIN_PAIRS_ABNORMAL = 20
EPISODE_HORIZON = 5
BATCH_SIZE = 50
PRICE_WINDOW_ROWS = 21
SIGNIFICANCE_STARS = [(0.01, "***"), (0.05, "**"), (0.10, "*")]
GRID_MODELS = ["base", "fine_tuned"]
GRID_TEMPERATURES = [0.5, 0.7, 1.0]

# --- fixed values: score words (order matters for the substring match) ------------------------
SCORE_WORDS = [
    ("strongly bullish", 2.0),
    ("very bullish", 2.0),
    ("bullish", 1.5),
    ("moderately bullish", 1.0),
    ("slightly bullish", 0.5),
    ("mildly bullish", 0.5),
    ("marginally bullish", 0.3),
    ("neutral", 0.0),
    ("none", 0.0),
    ("n/a", 0.0),
    ("negligible", 0.0),
    ("slightly bearish", -0.5),
    ("mildly bearish", -0.5),
    ("marginally bearish", -0.3),
    ("bearish", -1.5),
    ("moderately bearish", -1.0),
    ("strongly bearish", -2.0),
    ("very bearish", -2.0),
    ("moderate", 0.8),
    ("significant", 1.5),
    ("minor", 0.3),
    ("positive", 1.0),
    ("negative", -1.0),
]
NUMBER_PATTERN = r"[-+]?\d*\.?\d+"
FLOAT_ERROR_TEXT = "could not convert string to float"
PARSE_FAILURE_TEXT = "Failed to parse JSON (output may have been truncated)"
INVALID_RESPONSE_TEXT = "Qwen response was not valid JSON"

# --- fixed values: text patterns --------------------------------------------------------------
TOKEN_PATTERN = r"[A-Za-z0-9$._-]+"
TAG_PATTERN = r"<[^>]+>"

# --- fixed values: company names that stand for a ticker --------------------------------------
NAME_ALIASES = [
    ("rigetti", "RGTI"),
    ("d-wave", "QBTS"),
    ("quantinuum", "QNT"),
    ("honeywell", "HON"),
]
# The misspelt entry that substring mode keeps for compatible results.
SUBSTRING_NAME_ALIASES = [("ionq", "IonQ"), *NAME_ALIASES]
TICKER_KEYWORDS = [
    (["ionq", "trapped ion"], "IONQ"),
    (["rigetti", "superconducting"], "RGTI"),
    (["d-wave", "annealing"], "QBTS"),
    (["quantinuum", "honeywell"], "QNT"),
    (["ibm", "qiskit"], "IBM"),
    (["google", "cirq"], "GOOGL"),
]
DEFAULT_TICKER = "IONQ"
REPO_ORG_TICKERS = [
    ("Qiskit", "IBM"),
    ("quantumlib", "GOOGL"),
    ("PennyLaneAI", "QNT"),
    ("CQCL", "QNT"),
    ("rigetti", "RGTI"),
    ("dwavesystems", "QBTS"),
    ("microsoft", "MSFT"),
    ("NVIDIA", "NVDA"),
]

# --- fixed values: significance keywords ------------------------------------------------------
PAPER_HIGH_WORDS = ["logical qubit", "fault-tolerant", "error correction", "breakthrough"]
PAPER_MEDIUM_WORDS = ["scalable", "milestone", "record", "novel"]
NEWS_HIGH_WORDS = ["earnings", "revenue", "contract", "partnership", "breakthrough"]
JOB_WORDS = ["hiring", "job", "layoff", "workforce", "engineer", "recruit"]
JOB_HIGH_WORD = "layoff"
COMMITS_HIGH = 50
COMMITS_MEDIUM = 10
SIGNIFICANCE_CONFIDENCE = [("high", 1.0), ("medium", 0.7), ("low", 0.4)]
SIGNIFICANCE_TTL_DAYS = [("high", 90), ("medium", 60), ("low", 30)]

# --- fixed values: company dimension ----------------------------------------------------------
COMPANIES = [
    ("IONQ", "IonQ", "0001812364", ["ionq-samples"], "IonQ"),
    ("RGTI", "Rigetti", "0001838359", ["rigetti"], "Rigetti"),
    ("QBTS", "D-Wave", "0001907982", ["dwavesystems"], "D-Wave"),
    ("QUBT", "Quantum Computing Inc", "0001758009", [], "Quantum Computing"),
    ("QNT", "Quantinuum", "", ["CQCL"], "Quantinuum"),
    ("IBM", "IBM", "0000051143", ["Qiskit"], "International Business Machines"),
    ("GOOGL", "Google", "0001652044", ["quantumlib"], "Google"),
    ("MSFT", "Microsoft", "0000789019", ["microsoft"], "Microsoft"),
    ("HON", "Honeywell", "0000773840", [], "Honeywell"),
    ("NVDA", "NVIDIA", "0001045810", ["NVIDIA"], "NVIDIA"),
]

# --- fixed values: sector map -----------------------------------------------------------------
SECTOR_TICKERS = [
    ("IONQ", "IonQ", "Trapped Ion", 1.0, "Trapped Ion"),
    ("RGTI", "Rigetti", "Superconducting", 1.0, "Superconducting"),
    ("QBTS", "D-Wave", "Annealing", 1.0, "Annealing"),
    ("QUBT", "QCi", "Neutral Atom", 1.0, "Neutral Atom"),
    ("QNT", "Quantinuum", "Trapped Ion", 1.0, "Trapped Ion"),
    ("IBM", "IBM", "Superconducting", 0.15, "Superconducting"),
    ("GOOGL", "Google", "Superconducting", 0.0, "Superconducting"),
    ("MSFT", "Microsoft", "Topological", 0.0, "Topological"),
    ("HON", "Honeywell", "Trapped Ion", 0.30, "Trapped Ion"),
    ("NVDA", "NVIDIA", "Adjacent", 0.0, "Adjacent"),
]
SECTOR_TRIGGERS = [
    ("Trapped-ion breakthrough", ["IONQ", "HON"], ["RGTI", "IBM", "GOOGL"]),
    ("Superconducting breakthrough", ["RGTI", "IBM", "GOOGL"], ["IONQ", "HON"]),
    ("Error correction advance", ["IONQ", "RGTI", "HON", "IBM", "GOOGL", "MSFT"], []),
    ("Government funding", ["IONQ", "RGTI", "QBTS", "QUBT", "IBM", "HON"], []),
]

# --- fixed values: sector text block ----------------------------------------------------------
ACTIVE_PROFILES = [
    ("IONQ", "IonQ", "trapped ion", 2.0),
    ("RGTI", "Rigetti Computing", "superconducting", 2.0),
    ("QBTS", "D-Wave Quantum", "quantum annealing", 2.0),
    ("QUBT", "Quantum Computing Inc.", "photonic/quantum optimization", 2.0),
    ("QNT", "Quantinuum", "trapped ion", 2.0),
]
ADJACENT_PROFILES = [
    ("IBM", "IBM", "superconducting", 0.15),
    ("HON", "Honeywell", "trapped ion exposure", 0.30),
]
INACTIVE_PROFILES = [
    ("MSFT", "Quantum exposure is too small relative to total business."),
    ("GOOGL", "Quantum exposure is too small relative to total business."),
    ("NVDA", "Moves primarily on AI/GPU demand, not quantum news."),
]
TECHNOLOGY_DYNAMICS = [
    (
        "trapped ion",
        "Bullish for IONQ/QNT/HON when the event validates trapped-ion hardware; company-specific wins can be competitive.",
    ),
    (
        "superconducting",
        "Bullish for RGTI/IBM when the event validates superconducting hardware; broad validation can help smaller pure plays.",
    ),
    ("quantum annealing", "Most relevant to QBTS and optimization workflows."),
    (
        "error correction",
        "Usually validates gate-based approaches broadly, but score magnitude depends on commercial proximity.",
    ),
    ("government funding", "Usually sector-positive unless funding is explicitly zero-sum."),
]

# --- fixed values: seed facts -----------------------------------------------------------------
SEED_FACTS = [
    ("IONQ", "technology", "IonQ uses trapped-ion quantum computing approach. Current system: Forte Enterprise with 36 algorithmic qubits."),
    ("IONQ", "roadmap", "IonQ targets 1024 qubits by 2028. Key milestone: achieve broad quantum advantage."),
    ("RGTI", "technology", "Rigetti uses superconducting transmon qubits. Current system: Ankaa-3 with 84 qubits."),
    ("RGTI", "roadmap", "Rigetti targets 4000 qubits by 2026. Focus on modular architecture."),
    ("QBTS", "technology", "D-Wave uses quantum annealing (not gate-based). Current system: Advantage2 with 1200+ qubits."),
    ("QBTS", "competitive", "D-Wave is the only commercial quantum annealing company. Limited to optimization problems."),
    ("QNT", "technology", "Quantinuum (Honeywell subsidiary) uses trapped-ion approach. Highest quantum volume in industry."),
    ("QNT", "milestone", "Quantinuum demonstrated first fault-tolerant quantum computation in 2024."),
    ("IBM", "technology", "IBM uses superconducting qubits. Current system: Heron with 133 qubits. Roadmap targets 100K qubits by 2033."),
    ("HON", "exposure", "Honeywell owns majority stake in Quantinuum. Quantum is ~5% of Honeywell's strategic focus."),
    ("IONQ", "competitive", "Trapped-ion vs superconducting is the primary technology rivalry. Trapped-ion has higher fidelity but slower gate speeds."),
    ("RGTI", "competitive", "Superconducting approach benefits from semiconductor manufacturing expertise. Faster gates but lower coherence times."),
]

# --- fixed values: rule thresholds and texts --------------------------------------------------
# family, fires when, bound, least observations, rule id, confidence cap, category, text
RULE_FAMILIES = [
    (
        "source", "at_least", 0.65, 10, "source_strong_{key}", 0.95, "source_bias",
        "Predictions from {key} articles have been {pct}% accurate ({n} observations). Assign HIGH conviction when analyzing {key} content.",
    ),
    (
        "source", "at_most", 0.45, 10, "source_weak_{key}", 0.95, "source_bias",
        "Predictions from {key} articles have been only {pct}% accurate ({n} observations). Be CONSERVATIVE and cap conviction at 0.5 when analyzing {key} content.",
    ),
    (
        "ticker", "at_least", 0.65, 10, "ticker_strong_{key}", 0.95, "ticker_bias",
        "Predictions for {key} have been {pct}% accurate. The model has good signal for this ticker.",
    ),
    (
        "ticker", "at_most", 0.40, 10, "ticker_weak_{key}", 0.95, "ticker_bias",
        "Predictions for {key} have been only {pct}% accurate. Reduce conviction for this ticker or consider that the stock may be driven by factors not captured in news.",
    ),
    (
        "bullish", "at_least", 0.60, 15, "direction_bullish_reliable", 1.0, "calibration",
        "Bullish predictions have been {pct}% accurate. The model is better at identifying positive catalysts than negative ones.",
    ),
    (
        "bearish", "at_most", 0.40, 15, "direction_bearish_unreliable", 1.0, "calibration",
        "Bearish predictions have been only {pct}% accurate. Be cautious with negative signals. Consider that bad news may already be priced in.",
    ),
]
OVERALL_RULE_ID = "overall_calibration"
OVERALL_RULE_MIN = 20
OVERALL_RULE_CONFIDENCE = 0.9
OVERALL_RULE_CATEGORY = "calibration"
OVERALL_RULE_TEXT = "Overall prediction accuracy is {pct}% across {n} predictions. {verdict}"
OVERALL_WELL_CALIBRATED = (0.55, 0.70, "Model is well-calibrated.")
OVERALL_OVERCONFIDENT = (0.50, "Model tends to be overconfident.")
OVERALL_STRONG = "Model has strong predictive power."
MODEL_RULE_DEFAULTS = {"confidence": 0.6, "category": "pattern"}

# --- fixed values: context texts --------------------------------------------------------------
RULES_HEADER = "[BEHAVIORAL RULES LEARNED FROM EXPERIENCE]"
EXPERIENCES_HEADER = "[PAST EXPERIENCES]"
TRACK_RECORD = "[YOUR TRACK RECORD] Accuracy: {percent} ({correct}/{total} correct predictions)"
OVERALL_TRACK_RECORD = "[YOUR TRACK RECORD] Overall accuracy: {percent}% ({correct}/{total} correct)"
TRUNCATION_SUFFIX = "\n[... memory truncated to fit context window]"
NO_MEMORY_TEXT = "No related memory found."
PROMPT = """Source type: {source}

Retrieved memory:
{memory}

Current input:
{text}

Analyze the current input using the retrieved memory only where relevant."""
CHARS_PER_TOKEN = 4
RULE_CONFIDENCE_LABELS = [(0.8, "HIGH"), (0.6, "MEDIUM")]
RULE_CONFIDENCE_LOW = "LOW"

# --- fixed values: ledger ---------------------------------------------------------------------
TRADE_SIDES = ["buy", "sell", "short", "cover"]
EVAL_STATUSES = ["pass", "fail", "warn", "skip"]
COLLECTIONS = {"trades": "trade", "evals": "eval", "backtests": "backtest"}
LEDGER_LIST_LIMIT = 20
BAD_SIDE = "side must be one of: buy, sell, short, cover"
BAD_QUANTITY = "quantity must be positive"
BAD_PRICE = "price must be non-negative"
BAD_STATUS = "status must be one of: pass, fail, warn, skip"
BAD_METRICS = "metrics must be a JSON object"
EMPTY_METRICS = "metrics must not be empty"
UNKNOWN_COLLECTION = "Unknown collection: "

# --- fixed values: event texts and addresses --------------------------------------------------
PATENT_TITLE = "Patent: "
PATENT_URL = "https://patents.google.com/patent/US"
FILING_TITLE = "Insider transaction: "
FILING_CONTENT = "Form 4 filing by "
FILING_URL = "https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK="
JOB_TITLE = "Hiring signal: "
REPOSITORY_TITLE = "GitHub: "
REPOSITORY_URL = "https://github.com/"
RELEASE_TEXT = "Latest release: "
CONFERENCE_TITLE = "Conference paper ("
ARXIV_TITLE = "arXiv: "

#: Items per payload and widths of texts that a reader of feeds may ask for.
FEED_LIMITS = {
    "patent": {"per_page": 25, "abstract_chars": 500},
    "insider": {"first": 10},
    "rss": {"first": 5},
    "job": {"first": 5, "title_chars": 80},
    "news": {"first": 10, "title_chars": 100},
    "conference": {"first": 5, "title_chars": 80, "summary_chars": 300},
    "arxiv": {"first": 20, "title_chars": 80, "summary_chars": 400},
}
