"""Fixed values of the telemetry formats. All of these must stay as they are for results to match."""

# Wire sentinels (fixed values): "not received", radio default, v0 radio defaults, "no channel".
NOT_RECEIVED = 999999
RADIO_UNSET = -99
V0_TEMP_UNSET = -127
V0_OTHER_UNSET = -1
NO_CHANNEL = 99

# Capability bits (fixed values).
CAPABILITY_BITS = {
    "TempA": 1,
    "TempB": 2,
    "Volt": 4,
    "Humi": 8,
    "Light": 16,
    "Atmo": 32,
    "RGB": 64,
    "Opt2": 128,
    "Opt3": 256,
}

# Wide reading columns, in wire order (fixed values). All are integers; the first six are scaled by 100.
SCALED_FIELDS = ["iTempA", "iTempB", "iHumi", "iVolt", "iLight", "iAtmo"]
COLOUR_FIELDS = ["nLux", "nRed", "nGreen", "nBlue", "nClear", "nColor"]
VALUE_FIELDS = SCALED_FIELDS + COLOUR_FIELDS
FRAME_FIELDS = ["sensor", "time", "SensCap"] + VALUE_FIELDS + ["iCSum"]

# Capability that gates a reading column (fixed values).
FIELD_CAPABILITY = {
    "iTempA": "TempA",
    "iTempB": "TempB",
    "iHumi": "Humi",
    "iVolt": "Volt",
    "iLight": "Light",
    "iAtmo": "Atmo",
    "nLux": "RGB",
    "nRed": "RGB",
    "nGreen": "RGB",
    "nBlue": "RGB",
    "nClear": "RGB",
    "nColor": "RGB",
}

# Plausibility limits in wire units, (low, low is inclusive, high); the high end is exclusive (fixed values).
LIMITS = {
    "iTempA": (-4000, False, 4000),
    "iTempB": (-4000, False, 4000),
    "iHumi": (300, False, 10500),
    "iVolt": (100, False, 500),
    "iLight": (0, True, 800000),
    "iAtmo": (80000, False, 120000),
}

# Message topic field of a reading column (fixed values).
TOPIC_FIELD = {
    "iTempA": "fTempA",
    "iTempB": "fTempB",
    "iVolt": "fVolt",
    "iHumi": "fHumi",
    "iLight": "iLight",
    "iAtmo": "iAtmo",
    "nLux": "nLux",
    "nRed": "nRed",
    "nGreen": "nGreen",
    "nBlue": "nBlue",
    "nClear": "nClear",
    "nColor": "nColor",
}

# Per-channel registry: channel, static capabilities, battery, temperature A and B corrections, room (fixed values).
SENSORS = [
    (0, 48, 0.0, 0.0, 0.0, "Lokal"),
    (1, 13, -0.11, 0.15, 0.0, "Aussen"),
    (2, 5, -0.018, -0.12, 0.0, "Schlafzimmer"),
    (3, 5, -0.018, 0.0, 0.0, None),
    (4, 3, -0.018, 0.0, 0.0, None),
    (5, 13, -0.21, 0.0, 0.0, "Arbeitszimmer"),
    (6, 0, 0.0, 0.0, 0.0, "Breadboard"),
    (7, 0, 0.0, 0.0, 0.0, None),
    (8, 0, 0.0, 0.0, 0.0, None),
    (9, 0, 0.0, 0.0, 0.0, None),
]

# LoRa data sources by enum number (fixed values).
LORA_SOURCES = ["rain", "temp", "humi", "battery"]

# Unit conversions (fixed values).
ADC_VOLT = 0.01076923073
SEA_LEVEL_PA = 3400
LEGACY_LUX_DIVISOR = 1.2

# Stale limits in seconds: hub display, bridge alarm, remote display (fixed values).
STALE_HUB_S = 240
STALE_BRIDGE_S = 180
STALE_DISPLAY_S = 120

# Valve control defaults (fixed values).
TICK_S = 60
DEFAULT_ON_TICKS = 4
DEFAULT_SET_POINT = 5
AUTO_MODE = 6
PULSE_POSITION = 3
DAC_MAX = 4095
MAX_POSITION = 5
ERR_CLEARED_BY_RECONNECT = 4
ERR_CLEARED_BY_DAC = 6

# What a valve reports for an error code, blanks included (fixed values).
ERROR_TEXTS = {
    1: "1 DACnotFound ",
    2: "2 No TempSens1   ",
    3: "3 No TempSens2  ",
    4: "4 MQTTFailure   ",
    5: "5 No WLAN         ",
    6: "6 DACnotFound",
}

PLACEHOLDER = "----------"

# Retention tiers: tier, duration in hours (None keeps for ever), shard width in hours (fixed values).
TIERS = [
    ("autogen", None, 168),
    ("two_years", 17472, 24),
    ("one_year", 8736, 1),
    ("forever", None, 168),
    ("half_year", 4368, 168),
    ("two_month", 1344, 24),
]

# Active rollup definitions (fixed values):
# name, aggregate, source field, target field, source tier, target tier, measurement, bucket width in seconds.
ROLLUP_SPECS = [
    ("cq_1_hour_S1_fVolt", "mean", "fVolt", "fVolt", "half_year", "one_year", "sSens1", 3600),
    ("cq_1_day_S1_fVolt", "mean", "fVolt", "fVolt", "one_year", "forever", "sSens1", 86400),
    ("cq_5min_S2_fTempA", "mean", "fTempA", "fTempA", "two_month", "one_year", "sSens2", 300),
    ("cq_1hour_S2_fTempA", "mean", "fTempA", "fTempA", "one_year", "forever", "sSens2", 3600),
    ("cq_1_day_S2_fVolt", "mean", "fVolt", "fVolt", "half_year", "forever", "sSens2", 86400),
    ("cq_5min_S3_fTempA", "mean", "fTempA", "fTempA", "two_month", "one_year", "sSens3", 300),
    ("cq_1hour_S3_fTempA", "mean", "fTempA", "fTempA", "one_year", "forever", "sSens3", 3600),
    ("cq_1_day_S3_fVolt", "mean", "fVolt", "fVolt", "half_year", "forever", "sSens3", 86400),
    ("cq_5min_S5_fHumi", "mean", "fHumi", "fHumi", "two_month", "one_year", "sSens5", 300),
    ("cq_1hour_S5_fHumi", "mean", "fHumi", "fHumi", "one_year", "forever", "sSens5", 3600),
    ("cq_1_day_S5_fVolt", "mean", "fVolt", "fVolt", "half_year", "forever", "sSens5", 86400),
    ("cq_5min_SLoc_iLight", "mean", "iLight", "iLight", "two_month", "one_year", "SensorLoc", 300),
    ("cq_1hour_SLoc_iLight", "mean", "iLight", "iLight", "one_year", "forever", "SensorLoc", 3600),
    ("cq_5min_SLoc_fAtmo", "mean", "fAtmo", "fAtmo", "two_month", "one_year", "SensorLoc", 1800),
    ("cq_1hour_SLoc_fAtmo", "mean", "fAtmo", "fAtmo", "one_year", "forever", "SensorLoc", 7200),
    ("cq_5min_ValveControl_TempOut", "mean", "TempOut", "TempOut", "two_month", "one_year", "ValveControl", 300),
    ("cq_1hour_ValveControl_TempOut", "mean", "TempOut", "TempOut", "one_year", "forever", "ValveControl", 3600),
    ("cq_5min_ValveControl_TempIn", "mean", "TempIn", "TempIn", "two_month", "one_year", "ValveControl", 300),
    ("cq_1hour_ValveControl_TempIn", "mean", "TempIn", "TempIn", "one_year", "forever", "ValveControl", 3600),
    ("cq_5min_S1_fTempA", "mean", "fTempA", "fTempA", "two_month", "one_year", "sSens1", 300),
    ("cq_1hour_S1_fTempA", "mean", "fTempA", "fTempA", "one_year", "forever", "sSens1", 3600),
    ("cq_5min_S5_fTempA", "mean", "fTempA", "fTempA", "two_month", "one_year", "sSens5", 300),
    ("cq_1hour_S5_fTempA", "mean", "fTempA", "fTempA", "one_year", "forever", "sSens5", 3600),
    ("cq_1hour_Humi", "mean", "fHumi", "fHumi", "one_year", "forever", "sSens1", 3600),
    ("cq_5min_Humi", "mean", "fHumi", "fHumi", "two_month", "one_year", "sSens1", 300),
]

# Definitions that skip a tier (fixed values), columns as above.
LONG_HOP_SPECS = [
    ("cq_1_hour_LG_S1_fTempA", "mean", "fTempA", "fTempA", "two_years", "forever", "sSens1", 3600),
    ("cq_1_hour_LG_S2_fTempA", "mean", "fTempA", "fTempA", "two_years", "forever", "sSens2", 3600),
    ("cq_1_hour_LG_S3_fTempA", "mean", "fTempA", "fTempA", "two_years", "forever", "sSens3", 3600),
    ("cq_5min_LG_S5_fTempA", "mean", "fTempA", "fTempA", "autogen", "two_month", "sSens5", 300),
    ("cq_5min_LG_S5_fHumi", "mean", "fHumi", "fHumi", "autogen", "two_month", "sSens5", 300),
]
