"""Fixed values of the domain."""

# Ports.
STANDARD_PORTS = (8332, 8333, 8334, 18332, 18333, 18444, 38332, 38333)
ZERO_RISK_PORTS = (*STANDARD_PORTS, 80, 443)
ANON_PORTS = (9050, 9051, 9150, 4444)
FUSION_ANON_PORTS = (*ANON_PORTS, 4445)
TOR_PORTS = (9050, 9051, 9150)
PROXY_PORTS = (3128, 8080, 1080)
I2P_PORTS = (4444, 4445)

# Thresholds.
MICRO_TX = 0.006
DEFAULT_FEE = 0.0001
MIN_CHAIN = 2
FANOUT_OUTPUTS = 5
FANOUT_INPUTS = 2
FEE_URGENCY = 0.01
PEEL_DISPARITY = 0.5
MIXER_PARTICIPANTS = 10
MIXER_RATIO = 0.5
MIXER_TOLERANCE = 0.01
CONTAMINATION = 0.05
ONE_SIDED_DISCOUNT = 0.15
TAINT_ALPHA = 0.85

# Weights of the fused score, scores of the structural types, lower bounds of the tiers.
WEIGHTS = {"ml": 0.50, "pattern": 0.25, "network": 0.15, "graph": 0.10}
PATTERN_SCORES = {"CoinJoin_Mixer": 100.0, "Peel_Chain": 100.0, "FanOut_Dispersal": 70.0, "Fee_Spike": 70.0}
TIERS = (("Critical", 80), ("High", 60), ("Medium", 40))

# Reserved IPv4 ranges (first address, last address, country label, organisation).
RESERVED = (
    ("10.0.0.0", "10.255.255.255", "PRIVATE", "RFC-1918 Private Network"),
    ("172.16.0.0", "172.31.255.255", "PRIVATE", "RFC-1918 Private Network"),
    ("192.168.0.0", "192.168.255.255", "PRIVATE", "RFC-1918 Private Network"),
    ("127.0.0.0", "127.255.255.255", "LOCAL", "Loopback"),
    ("169.254.0.0", "169.254.255.255", "LOCAL", "Link-Local / APIPA"),
    ("192.0.2.0", "192.0.2.255", "DOC", "RFC-5737 TEST-NET-1"),
    ("198.51.100.0", "198.51.100.255", "DOC", "RFC-5737 TEST-NET-2"),
    ("203.0.113.0", "203.0.113.255", "DOC", "RFC-5737 TEST-NET-3"),
    ("100.64.0.0", "100.127.255.255", "CGNAT", "RFC-6598 CGNAT"),
    ("240.0.0.0", "255.255.255.255", "RESERVED", "RFC-1112 Reserved"),
)

# Label and score columns that no model may read.
LABEL_COLUMNS = frozenset(
    {
        "attack_type", "is_labeled_suspicious", "detected_type", "label", "is_anomaly", "watchlist_label", "watchlist_hit", "watchlist_indicator", "risk_score",
        "score_ml", "score_pattern", "score_network", "score_graph", "whitelist_factor", "ml_probability", "y", "target",
    }
)
