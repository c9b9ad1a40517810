"""Word lists and keyword tables.

Fixed values: scores only agree with earlier results when these lists are the
same, so they are stated in full.
"""

# --- live article scorer -------------------------------------------------
LIVE_POSITIVE = [
    "adoption", "approved", "approval", "beat", "bull", "bullish", "clarity", "cuts", "denies", "growth", "inflow",
    "partnership", "rally", "record", "surge", "upgrade",
]
LIVE_NEGATIVE = [
    "ban", "bear", "bearish", "bankruptcy", "crash", "decline", "depeg", "delayed", "drop", "exploit", "hack", "halts",
    "lawsuit", "liquidation", "outflow", "probe", "selloff", "sues",
]
LIVE_RISK = [
    "bankruptcy", "ban", "breach", "contagion", "crash", "default", "depeg", "exploit", "fed", "hack", "inflation",
    "lawsuit", "liquidation", "regulation", "sanction", "sec", "war",
]
LIVE_RISK_PHRASES = [
    "bridge drained", "etf delayed", "fed hikes", "liquidation cascade", "sec lawsuit", "stablecoin depeg",
    "withdrawal halt", "withdrawals halted",
]
LIVE_POSITIVE_PHRASES = ["etf approved", "fed cuts", "regulatory clarity", "spot etf approved"]
LIVE_NEGATIVE_PHRASES = ["bankruptcy filing", "bridge exploit", "exchange hack", "sec sues"]
LIVE_REDUCING_PHRASES = ["denies hack", "false rumor", "hack rumor denied", "no hack", "not hacked"]
LIVE_TOPICS = {
    "regulation": ["sec", "etf", "regulation", "lawsuit", "court", "ban"],
    "security": ["hack", "exploit", "breach", "wallet", "bridge"],
    "macro": ["fed", "inflation", "rates", "jobs", "dollar", "war"],
    "market": ["rally", "selloff", "liquidation", "volume", "volatility"],
}
LIVE_SYMBOLS = {
    "BTCUSDT": ["btc", "bitcoin"],
    "ETHUSDT": ["eth", "ethereum", "ether"],
    "SOLUSDT": ["sol", "solana"],
    "BNBUSDT": ["bnb", "binance"],
    "XRPUSDT": ["xrp", "ripple"],
}

# --- offline article scorer (substring matches) --------------------------
OFFLINE_POSITIVE = [
    "approve", "approved", "etf inflow", "inflow", "bullish", "surge", "rally", "record high", "adoption", "partnership",
]
OFFLINE_NEGATIVE = [
    "hack", "exploit", "lawsuit", "ban", "crackdown", "outflow", "liquidation", "war", "default", "collapse", "fraud",
]
OFFLINE_RISK = [
    "risk", "hack", "exploit", "war", "sec", "lawsuit", "inflation", "federal reserve", "interest rate", "ban", "crackdown",
]
OFFLINE_SYMBOLS = {
    "BTCUSDT": ["bitcoin", "btc"],
    "ETHUSDT": ["ethereum", "ether", "eth"],
    "SOLUSDT": ["solana", "sol"],
    "BNBUSDT": ["binance", "bnb"],
    "XRPUSDT": ["xrp", "ripple"],
}
OFFLINE_MACRO = ["fed", "federal reserve", "inflation", "interest rate", "war", "oil", "dollar", "jobs report"]
OFFLINE_REGULATION = ["sec", "cftc", "regulation", "lawsuit", "court", "ban", "compliance"]
OFFLINE_SECURITY = ["hack", "exploit", "breach", "phishing", "stolen"]
OFFLINE_ETF = ["etf", "spot bitcoin", "blackrock", "fidelity"]
OFFLINE_FED = ["fed", "federal reserve", "interest rate", "rate hike"]
OFFLINE_WAR = ["war", "missile", "attack", "sanction"]
OFFLINE_EXCHANGE = ["exchange", "binance", "okx", "coinbase"]

# --- structured event rules ----------------------------------------------
EVENT_ASSETS = {
    "BTC": ["bitcoin", "btc"],
    "ETH": ["ethereum", "ether", "eth"],
    "SOL": ["solana", "sol"],
    "BNB": ["binance", "bnb"],
    "XRP": ["ripple", "xrp"],
    "ADA": ["cardano", "ada"],
    "DOGE": ["dogecoin", "doge"],
    "AVAX": ["avalanche", "avax"],
    "LINK": ["chainlink", "link"],
    "USDT": ["tether", "usdt"],
    "USDC": ["usd coin", "usdc", "circle"],
}
EVENT_POSITIVE = [
    "adoption", "approval", "approved", "bullish", "buyback", "cuts", "growth", "inflow", "launch", "partnership", "rally",
    "record", "recovery", "surge", "upgrade",
]
EVENT_NEGATIVE = [
    "ban", "bankruptcy", "bearish", "crash", "depeg", "decline", "drop", "exploit", "hack", "halt", "lawsuit", "liquidation",
    "outflow", "selloff", "sues",
]
EVENT_SEVERE = [
    "bankruptcy", "breach", "crash", "default", "depeg", "exploit", "hack", "liquidation", "sanction", "war",
]
EVENT_TYPES = {
    "security_incident": ["exploit", "hack", "breach", "drained", "vulnerability"],
    "stablecoin": ["depeg", "stablecoin", "tether", "usdc", "reserve"],
    "liquidation": ["liquidation", "liquidated", "cascade"],
    "regulatory": ["sec", "regulation", "regulatory", "lawsuit", "court", "ban", "etf"],
    "macro": ["fed", "inflation", "rates", "payroll", "dollar", "tariff"],
    "funding": ["funding", "fundraise", "raises", "raised", "investment"],
    "partnership": ["partnership", "partners", "collaboration", "integrates"],
    "protocol": ["upgrade", "fork", "mainnet", "validator", "staking"],
    "tokenomics": ["unlock", "vesting", "burn", "airdrop", "supply"],
    "exchange": ["exchange", "listing", "delisting", "withdrawals"],
    "market_move": ["rally", "selloff", "surge", "plunge", "volatility"],
}

# --- keyword risk feed ----------------------------------------------------
RISK_FEED = {
    "macro_risk_score": ["fed", "federal reserve", "cpi", "rate hike", "rate cut", "inflation", "recession", "bank crisis"],
    "regulation_risk_score": ["sec", "lawsuit", "regulation", "regulatory", "ban", "enforcement"],
    "fed_risk_score": ["fed", "federal reserve", "cpi", "rate hike", "rate cut", "inflation"],
    "war_risk_score": ["war", "geopolitical", "sanction", "missile", "conflict"],
    "exchange_hack_risk_score": ["hack", "exploit", "bridge attack", "exchange hack", "stolen", "drain"],
    "security_risk_score": ["hack", "exploit", "bridge attack", "stolen", "drain", "vulnerability"],
    "etf_positive_score": ["etf approval", "spot etf", "etf inflow", "approval"],
    "etf_bullish_score": ["etf approval", "spot etf", "etf inflow", "approval"],
    "world_risk_score": ["war", "geopolitical", "bank crisis", "recession", "sanction"],
}
MACRO_TERMS = ["fed", "federal reserve", "inflation", "interest rate", "rates", "war", "sec"]
QUOTE_SUFFIXES = ["USDT", "USDC", "BUSD", "USD", "BTC", "ETH"]

NUMBER_PATTERN = r"(?<![A-Za-z0-9_])[-+]?\d+(?:,\d{3})*(?:\.\d+)?%?"
