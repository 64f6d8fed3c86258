"""The standard configuration of 99 output columns."""

from __future__ import annotations

from tickloom.operators.registry import Spec

# Output names, classes, parameters and categories of the standard set.
STANDARD = [
    Spec("SMA_5", "SMA", {"window": 5}, "trend"),
    Spec("SMA_10", "SMA", {"window": 10}, "trend"),
    Spec("SMA_20", "SMA", {"window": 20}, "trend"),
    Spec("SMA_50", "SMA", {"window": 50}, "trend"),
    Spec("SMA_100", "SMA", {"window": 100}, "trend"),
    Spec("SMA_200", "SMA", {"window": 200}, "trend"),
    Spec("EMA_5", "EMA", {"window": 5}, "trend"),
    Spec("EMA_10", "EMA", {"window": 10}, "trend"),
    Spec("EMA_20", "EMA", {"window": 20}, "trend"),
    Spec("EMA_50", "EMA", {"window": 50}, "trend"),
    Spec("EMA_100", "EMA", {"window": 100}, "trend"),
    Spec("EMA_200", "EMA", {"window": 200}, "trend"),
    Spec("WMA_10", "WMA", {"window": 10}, "trend"),
    Spec("WMA_20", "WMA", {"window": 20}, "trend"),
    Spec("HMA_9", "HMA", {"window": 9}, "trend"),
    Spec("HMA_21", "HMA", {"window": 21}, "trend"),
    Spec("TEMA_20", "TEMA", {"window": 20}, "trend"),
    Spec("DEMA_20", "DEMA", {"window": 20}, "trend"),
    Spec("KAMA_10", "KAMA", {"window": 10}, "trend"),
    Spec("ICHIMOKU_TENKAN", "IchimokuTenkan", {"window": 9}, "trend"),
    Spec("ICHIMOKU_KIJUN", "IchimokuKijun", {"window": 26}, "trend"),
    Spec("ICHIMOKU_SENKOU_A", "IchimokuSenkouA", {"tenkan": 9, "kijun": 26}, "trend"),
    Spec("ICHIMOKU_SENKOU_B", "IchimokuSenkouB", {"window": 52}, "trend"),
    Spec("RSI_7", "RSI", {"window": 7}, "momentum"),
    Spec("RSI_14", "RSI", {"window": 14}, "momentum"),
    Spec("RSI_21", "RSI", {"window": 21}, "momentum"),
    Spec("STOCH_K", "StochasticK", {"window": 14, "smooth": 3}, "momentum"),
    Spec("STOCH_D", "StochasticD", {"window": 14, "smooth_k": 3, "smooth_d": 3}, "momentum"),
    Spec("STOCHRSI_K", "StochRSIK", {"window": 14, "smooth": 3}, "momentum"),
    Spec("STOCHRSI_D", "StochRSID", {"window": 14, "smooth_k": 3, "smooth_d": 3}, "momentum"),
    Spec("MACD", "MACD", {"fast": 12, "slow": 26, "signal": 9}, "momentum"),
    Spec("MACD_SIGNAL", "MACDSignal", {"fast": 12, "slow": 26, "signal": 9}, "momentum"),
    Spec("MACD_HIST", "MACDHist", {"fast": 12, "slow": 26, "signal": 9}, "momentum"),
    Spec("CCI_14", "CCI", {"window": 14}, "momentum"),
    Spec("CCI_20", "CCI", {"window": 20}, "momentum"),
    Spec("WILLIAMS_R", "WilliamsR", {"window": 14}, "momentum"),
    Spec("ROC_10", "ROC", {"window": 10}, "momentum"),
    Spec("ROC_20", "ROC", {"window": 20}, "momentum"),
    Spec("MOM_10", "Momentum", {"window": 10}, "momentum"),
    Spec("MOM_20", "Momentum", {"window": 20}, "momentum"),
    Spec("TSI", "TSI", {"slow": 25, "fast": 13}, "momentum"),
    Spec("UO", "UltimateOscillator", {"fast": 7, "medium": 14, "slow": 28}, "momentum"),
    Spec("AO", "AwesomeOscillator", {"fast": 5, "slow": 34}, "momentum"),
    Spec("ATR_14", "ATR", {"window": 14}, "volatility"),
    Spec("ATR_20", "ATR", {"window": 20}, "volatility"),
    Spec("NATR_14", "NATR", {"window": 14}, "volatility"),
    Spec("BB_UPPER", "BollingerUpper", {"window": 20, "std": 2}, "volatility"),
    Spec("BB_MIDDLE", "BollingerMiddle", {"window": 20}, "volatility"),
    Spec("BB_LOWER", "BollingerLower", {"window": 20, "std": 2}, "volatility"),
    Spec("BB_WIDTH", "BollingerWidth", {"window": 20, "std": 2}, "volatility"),
    Spec("BB_PERCENT", "BollingerPercent", {"window": 20, "std": 2}, "volatility"),
    Spec("KC_UPPER", "KeltnerUpper", {"window": 20, "atr_window": 10, "mult": 2}, "volatility"),
    Spec("KC_MIDDLE", "KeltnerMiddle", {"window": 20}, "volatility"),
    Spec("KC_LOWER", "KeltnerLower", {"window": 20, "atr_window": 10, "mult": 2}, "volatility"),
    Spec("DC_UPPER", "DonchianUpper", {"window": 20}, "volatility"),
    Spec("DC_LOWER", "DonchianLower", {"window": 20}, "volatility"),
    Spec("ULCER_INDEX", "UlcerIndex", {"window": 14}, "volatility"),
    Spec("MASS_INDEX", "MassIndex", {"window": 25}, "volatility"),
    Spec("OBV", "OBV", {}, "volume"),
    Spec("AD", "AD", {}, "volume"),
    Spec("ADL", "ADL", {}, "volume"),
    Spec("CMF_20", "CMF", {"window": 20}, "volume"),
    Spec("EMV_14", "EMV", {"window": 14}, "volume"),
    Spec("FI_13", "ForceIndex", {"window": 13}, "volume"),
    Spec("MFI_14", "MFI", {"window": 14}, "volume"),
    Spec("NVI", "NVI", {}, "volume"),
    Spec("PVI", "PVI", {}, "volume"),
    Spec("VWAP", "VWAP", {}, "volume"),
    Spec("VPT", "VPT", {}, "volume"),
    Spec("VWMA_20", "VWMA", {"window": 20}, "volume"),
    Spec("ADX_14", "ADX", {"window": 14}, "trend_strength"),
    Spec("ADX_20", "ADX", {"window": 20}, "trend_strength"),
    Spec("DI_PLUS_14", "DIPlus", {"window": 14}, "trend_strength"),
    Spec("DI_MINUS_14", "DIMinus", {"window": 14}, "trend_strength"),
    Spec("AROON_UP_25", "AroonUp", {"window": 25}, "trend_strength"),
    Spec("AROON_DOWN_25", "AroonDown", {"window": 25}, "trend_strength"),
    Spec("AROON_OSC_25", "AroonOsc", {"window": 25}, "trend_strength"),
    Spec("VI_PLUS_14", "VortexPlus", {"window": 14}, "trend_strength"),
    Spec("VI_MINUS_14", "VortexMinus", {"window": 14}, "trend_strength"),
    Spec("TRIX_14", "TRIX", {"window": 14}, "trend_strength"),
    Spec("MI_9", "MassIndex", {"window": 9}, "trend_strength"),
    Spec("PSAR", "PSAR", {"af": 0.02, "max_af": 0.2}, "pattern"),
    Spec("PSAR_TREND", "PSARTrend", {"af": 0.02, "max_af": 0.2}, "pattern"),
    Spec("SUPERTREND_7_3", "SuperTrend", {"window": 7, "mult": 3}, "pattern"),
    Spec("SUPERTREND_10_3", "SuperTrend", {"window": 10, "mult": 3}, "pattern"),
    Spec("ZIG_ZAG_5", "ZigZag", {"pct": 5}, "pattern"),
    Spec("PIVOT_HIGH", "PivotHigh", {"window": 5}, "pattern"),
    Spec("PIVOT_LOW", "PivotLow", {"window": 5}, "pattern"),
    Spec("STDDEV_20", "StdDev", {"window": 20}, "statistical"),
    Spec("VAR_20", "Variance", {"window": 20}, "statistical"),
    Spec("SEM_20", "SEM", {"window": 20}, "statistical"),
    Spec("SKEW_20", "Skew", {"window": 20}, "statistical"),
    Spec("KURT_20", "Kurtosis", {"window": 20}, "statistical"),
    Spec("CORREL_20", "Correlation", {"window": 20}, "statistical"),
    Spec("BETA_20", "Beta", {"window": 20}, "statistical"),
    Spec("LINEARREG_20", "LinearReg", {"window": 20}, "statistical"),
    Spec("LINEARREG_SLOPE_20", "LinearRegSlope", {"window": 20}, "statistical"),
    Spec("LINEARREG_ANGLE_20", "LinearRegAngle", {"window": 20}, "statistical"),
    Spec("TSF_20", "TSF", {"window": 20}, "statistical"),
]


def standard_specs() -> list[Spec]:
    return list(STANDARD)
