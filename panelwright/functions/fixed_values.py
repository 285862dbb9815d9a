"""Reference data and default parameters. Results depend on them being exactly these."""

# Source code of each monthly or daily macro series -> column label.
MACRO_SERIES = {
    "INTGSTZAM193N": "tbill_rate",
    "INTGSBZAM193N": "govt_bond_10y",
    "ZAFCPIALLMINMEI": "cpi_all",
    "ZAFCPICORMINMEI": "cpi_core",
    "DEXSFUS": "zar_usd",
    "DEXUSEU": "usd_eur",
    "XTEXVA01ZAM664S": "exports_value",
    "XTIMVA01ZAM664S": "imports_value",
}

# Source code of each annual indicator -> column label.
ANNUAL_INDICATORS = {
    "NY.GDP.MKTP.KD.ZG": "gdp_growth_pct",
    "FP.CPI.TOTL.ZG": "inflation_cpi_pct",
    "SL.UEM.TOTL.ZS": "unemployment_pct",
    "BN.CAB.XOKA.GD.ZS": "current_account_gdp",
    "GC.DOD.TOTL.GD.ZS": "govt_debt_gdp",
    "NE.EXP.GNFS.ZS": "exports_gdp",
    "NE.IMP.GNFS.ZS": "imports_gdp",
}

# Default ticker of the index every series is measured against.
INDEX_TICKER = "^J203.JO"

# Price table columns and raw quote field names.
QUOTE_FIELDS = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}
PRICE_COLUMNS = ("open", "high", "low", "close", "volume")
FX_COLUMNS = ("zar_usd", "usd_eur")

# Rolling windows in rows and the non-null inputs each needs.
PRICE_FILL_LIMIT = 5
MACRO_FILL_LIMIT = 3
TRADING_DAYS_PER_YEAR = 252
VOLATILITY_ROWS, VOLATILITY_MIN = 21, 10
YEAR_ROWS, YEAR_MIN = 252, 50
MOMENTUM_ROWS = {"mom_1m": 21, "mom_3m": 63, "mom_6m": 126, "mom_12m": 252}
MOMENTUM_WEIGHTS = {"mom_1m_z": 0.20, "mom_3m_z": 0.30, "mom_6m_z": 0.50}
PRICE_Z_ROWS, PRICE_Z_MIN = 20, 10
FAST_MA_ROWS, FAST_MA_MIN = 50, 30
SLOW_MA_ROWS, SLOW_MA_MIN = 200, 100
RSI_ROWS = 14
CORRELATION_ROWS, CORRELATION_MIN = 90, 30
CORRELATION_VARIABLES = (
    "zar_usd_mom_pct",
    "tbill_rate",
    "cpi_yoy_pct",
    "real_tbill_rate",
    "exports_value",
    "imports_value",
)
FORWARD_ROWS = 21

# Regime thresholds and labels.
INFLATION_LOW, INFLATION_HIGH = 3.0, 6.0
CURRENCY_MOVE_PCT = 2.0
REGIME_ORDER = (
    "HIKING_HIGH_INFLATION",
    "HIKING_TARGET_INFLATION",
    "HIKING_LOW_INFLATION",
    "CUTTING_HIGH_INFLATION",
    "CUTTING_TARGET_INFLATION",
    "CUTTING_LOW_INFLATION",
)

# Sample-size rules.
MIN_OBSERVATIONS = 20
MIN_SPELLS = 2
MIN_RANKED_OBSERVATIONS = 10
MIN_TRANSITIONS = 10

# Model and backtest defaults.
MODEL_FEATURES = ("momentum_score", "rsi_14", "trend_signal")
TOP_PICKS = 5
REBALANCE_COST_BPS = 15.0
MIN_TRAIN_MONTHS = 12
THIN_SAMPLE_PERIODS = 24

# Quality thresholds.
MAX_MISSING_PCT = 5.0
FROZEN_ROWS = 30
MIN_MACRO_OBSERVATIONS = 10
MAX_ROW_DROP_PCT = 10.0
STALE_AFTER_DAYS = 3
