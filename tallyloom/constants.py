"""Class lists, lookup rows, thresholds, histogram bounds, alert rules and routes."""

from __future__ import annotations

# --- fixed values: classes and what is shown for each --------------------------------------------
CLASS_NAMES = ["akiec", "bcc", "bkl", "df", "mel", "nv", "vasc"]

# code, display name, risk level, advisory, symptoms, source name, source url
CLASS_DETAILS = [
    ("mel", "Melanoma", "HIGH",
     "Melanoma is the most dangerous skin cancer. Immediate dermatologist consultation recommended.",
     ["Asymmetric mole", "Irregular border", "Multiple colors", "Diameter > 6mm", "Evolving shape"],
     "AAD — Melanoma", "https://www.aad.org/public/diseases/skin-cancer/types/common/melanoma"),
    ("nv", "Melanocytic Nevi", "LOW",
     "Usually benign. Monitor for changes in size or color.",
     ["Round or oval shape", "Uniform color", "Smooth border", "< 6mm"],
     "AAD — Moles", "https://www.aad.org/public/diseases/a-z/moles-overview"),
    ("bcc", "Basal Cell Carcinoma", "MEDIUM",
     "Rarely spreads but requires treatment. Consult dermatologist promptly.",
     ["Pearly or waxy bump", "Flat flesh-colored lesion", "Bleeding sore"],
     "AAD — BCC", "https://www.aad.org/public/diseases/skin-cancer/types/common/bcc"),
    ("akiec", "Actinic Keratosis", "MEDIUM",
     "Precancerous. Treatment recommended to prevent progression.",
     ["Rough scaly patch", "Itching or burning", "Flat to slightly raised"],
     "AAD — Actinic Keratosis", "https://www.aad.org/public/diseases/a-z/actinic-keratosis-overview"),
    ("bkl", "Benign Keratosis", "LOW",
     "Non-cancerous. Treatment for cosmetic reasons only.",
     ["Waxy scaly growth", "Brown or tan color", "Stuck-on appearance"],
     "AAD — Seborrheic Keratosis", "https://www.aad.org/public/diseases/a-z/seborrheic-keratoses-overview"),
    ("df", "Dermatofibroma", "LOW",
     "Benign. Usually no treatment needed.",
     ["Small hard bump", "Brown to pink", "Dimples when pinched"],
     "AAD — Dermatofibroma", "https://www.aad.org/public/diseases/a-z/dermatofibroma-overview"),
    ("vasc", "Vascular Lesion", "LOW",
     "Usually benign. See dermatologist if lesion grows rapidly.",
     ["Red purple or blue discoloration", "Flat or raised"],
     "AAD — Vascular Lesions", "https://www.aad.org/public/diseases/a-z/birthmarks-vascular"),
]

GENDERS = ["male", "female", "other", "prefer_not_to_say"]
VOTES = ["thumbs_up", "thumbs_down"]
SPLIT_COLUMNS = ["image_id", "image_path", "label", "lesion_id"]

# --- fixed values: drift thresholds, acceptance gate, split and training settings ------------------
DRIFT_THRESHOLDS = {
    "relative_shift": 0.05,
    "total_psi": 0.1,
    "js_divergence": 0.02,
    "total_variation": 0.12,
    "sample_ratio": 0.2,
}
SHARE_FLOOR = 1e-6
VAL_SIZE = 0.15
SPLIT_SEED = 42
ACCEPTANCE_MACRO_F1 = 0.75
PATIENCE = 15
MIXUP_ALPHA = 0.1
MIXUP_SHARE = 0.3
RATE_LIMIT = 3
RETRAIN_ACTION = "Review drift and run DVC repro on a GPU-capable training environment."
RETRAIN_COMMAND = "dvc repro"

# --- fixed values: histogram bounds by metric -------------------------------------------------------
HISTOGRAM_BOUNDS = {
    "inference_latency_seconds": [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0],
    "image_processing_duration_seconds": [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0],
    "prediction_confidence": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0],
    "request_memory_usage_mb": [10.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0],
    "request_cpu_usage_percent": [5.0, 10.0, 20.0, 30.0, 50.0, 70.0, 90.0],
}

# --- fixed values: alert rules (durations in seconds) -----------------------------------------------
_IDLE = {"job": "node_exporter", "mode": "idle"}
_NODE = {"job": "node_exporter"}
_LATENCY = {"kind": "quantile", "metric": "inference_latency_seconds", "q": 0.95, "window": 120}
_MEMORY = {"kind": "quantile", "metric": "request_memory_usage_mb", "q": 0.95, "window": 300}
_FREE = {"kind": "used_percent", "metric": "node_memory_MemAvailable_bytes",
         "total": "node_memory_MemTotal_bytes", "match": _NODE}
_CPU = {"kind": "busy_percent", "metric": "node_cpu_seconds_total", "match": _IDLE, "window": 120}
_DB = {"kind": "gauge", "metric": "mongodb_up", "match": {"job": "mongodb_exporter"}}

ALERT_RULES = [
    {"alert": "HighInferenceLatency_Critical", "signal": _LATENCY, "op": ">", "threshold": 4.0,
     "hold": 45, "severity": "critical", "category": "inference"},
    {"alert": "HighInferenceLatency_Warning", "signal": _LATENCY, "op": ">", "threshold": 2.0,
     "hold": 45, "severity": "warning", "category": "inference"},
    {"alert": "ModelNotLoaded", "signal": {"kind": "gauge", "metric": "model_loaded", "match": {}},
     "op": "==", "threshold": 0.0, "hold": 20, "severity": "critical", "category": "api"},
    {"alert": "HighErrorRate",
     "signal": {"kind": "ratio", "metric": "api_requests_total", "window": 120,
                "match": {"status_code": "4..|5.."}, "over": {}, "floor": 0.001, "floor_mode": "clamp"},
     "op": ">", "threshold": 0.05, "hold": 30, "severity": "critical", "category": "api"},
    {"alert": "LowPredictionConfidence",
     "signal": {"kind": "quantile", "metric": "prediction_confidence", "q": 0.50, "window": 300},
     "op": "<", "threshold": 0.50, "hold": 120, "severity": "warning", "category": "inference"},
    {"alert": "HighRiskPredictionSpike",
     "signal": {"kind": "rate", "metric": "high_risk_predictions_total", "window": 300, "match": {}},
     "op": ">", "threshold": 0.1, "hold": 60, "severity": "warning", "category": "inference"},
    {"alert": "SystemMemory_Critical", "signal": _FREE, "op": ">", "threshold": 90.0,
     "hold": 45, "severity": "critical", "category": "memory"},
    {"alert": "SystemMemory_Warning", "signal": _FREE, "op": ">", "threshold": 70.0,
     "hold": 45, "severity": "warning", "category": "memory"},
    {"alert": "RequestMemory_Critical", "signal": _MEMORY, "op": ">", "threshold": 1000.0,
     "hold": 45, "severity": "critical", "category": "memory"},
    {"alert": "RequestMemory_Warning", "signal": _MEMORY, "op": ">", "threshold": 500.0,
     "hold": 60, "severity": "warning", "category": "memory"},
    {"alert": "SystemCPU_Critical", "signal": _CPU, "op": ">", "threshold": 70.0,
     "hold": 45, "severity": "critical", "category": "cpu"},
    {"alert": "SystemCPU_Warning", "signal": _CPU, "op": ">", "threshold": 50.0,
     "hold": 45, "severity": "warning", "category": "cpu"},
    {"alert": "APIDown", "signal": {"kind": "gauge", "metric": "up", "match": {"job": "fastapi_backend"}},
     "op": "==", "threshold": 0.0, "hold": 45, "severity": "critical", "category": "api"},
    {"alert": "HighActiveRequests",
     "signal": {"kind": "rate", "metric": "api_requests_total", "window": 60, "by": [],
                "match": {"endpoint": "/predict", "method": "POST", "status_code": "200"}},
     "op": ">", "threshold": 1.0, "hold": 45, "severity": "warning", "category": "api"},
    {"alert": "NegativeFeedbackSpike",
     "signal": {"kind": "ratio", "metric": "feedback_total", "window": 300,
                "match": {"vote": "thumbs_down"}, "over": {"vote": "thumbs_up"},
                "floor": 0.001, "floor_mode": "add"},
     "op": ">", "threshold": 1.2, "hold": 60, "severity": "warning", "category": "api"},
    {"alert": "HighRequestVolume",
     "signal": {"kind": "rate", "metric": "api_requests_total", "window": 60, "by": [], "match": {}},
     "op": ">", "threshold": 8.0, "hold": 45, "severity": "warning", "category": "api"},
    {"alert": "UserRateLimitBreach",
     "signal": {"kind": "increase", "metric": "user_rate_limit_breach_total", "window": 300,
                "by": ["username"], "match": {}},
     "op": ">", "threshold": 10.0, "hold": 30, "severity": "warning", "category": "abuse"},
    {"alert": "RegistrationSpike",
     "signal": {"kind": "sample_increase", "metric": "users_registered_total", "window": 300, "match": {}},
     "op": ">", "threshold": 10.0, "hold": 60, "severity": "warning", "category": "abuse"},
    {"alert": "MongoDBDown", "signal": _DB, "op": "==", "threshold": 0.0,
     "hold": 45, "severity": "critical", "category": "database"},
    {"alert": "MongoDBDown_Sustained", "signal": _DB, "op": "==", "threshold": 0.0,
     "hold": 120, "severity": "critical", "category": "database"},
]

EVALUATION_STEP = 15
LOOKBACK = 300

# --- fixed values: notification routes (first match wins) and mute rules ------------------------------
DEFAULT_ROUTE = {"receiver": "default", "group_wait": 30, "group_interval": 300, "repeat_interval": 3600}
ROUTES = [
    {"match": {"severity": "critical"}, "receiver": "critical_alerts", "group_wait": 10, "repeat_interval": 1800},
    {"match": {"severity": "warning"}, "receiver": "warning_alerts", "group_wait": 60, "repeat_interval": 7200},
    {"match": {"category": "database"}, "receiver": "database_alerts", "group_wait": 15, "repeat_interval": 1800},
]
GROUP_BY = ["alertname", "category"]
INHIBIT_RULES = [
    {"source": {"severity": "critical"}, "target": {"severity": "warning"}, "equal": ["alertname", "category"]},
]
