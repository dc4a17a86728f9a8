"""Fixed values of the service-desk domain (closed lists, targets, labels, centroids).

They are part of the result contract and are stated plainly, in their natural order.
"""

from __future__ import annotations

# Closed domains.
TIERS = ["platinum", "gold", "silver", "bronze"]
SEVERITIES = ["critical", "major", "minor", "low"]
TICKET_TYPES = ["incident", "service_request", "query", "complaint"]
CHANNELS = ["phone", "email", "web_portal", "chat", "api", "monitoring"]
STATUSES = ["acknowledged", "in_progress", "pending", "held", "resolved", "closed", "cancelled"]
RISK_BANDS = ["low", "medium", "high"]
SPLITS = ["train", "validation", "test", "unlabelled"]
AGE_BANDS = ["0-24h", "1-3d", "3-7d", "7-30d", "30d+"]
# Upper bounds of the first four age bands, in hours.
AGE_BOUNDS_HOURS = [24, 72, 168, 720]

TICKET_DOMAINS = {
    "ticket_type": TICKET_TYPES,
    "severity": SEVERITIES,
    "status": STATUSES,
    "channel": CHANNELS,
}
TICKET_TIMESTAMPS = [
    "creation_date",
    "last_update",
    "expected_resolution_date",
    "requested_resolution_date",
    "resolution_date",
]
TEXT_COLUMNS = [
    "id",
    "customer_id",
    "site_id",
    "service_id",
    "assignment_group",
    "active_outage_id",
    "name",
    "description",
]

# Resolution targets in hours by tier and severity.
SLA_TARGET_HOURS = {
    "platinum": {"critical": 4, "major": 8, "minor": 24, "low": 72},
    "gold": {"critical": 6, "major": 12, "minor": 48, "low": 96},
    "silver": {"critical": 8, "major": 24, "minor": 72, "low": 120},
    "bronze": {"critical": 12, "major": 36, "minor": 96, "low": 168},
}

# Local business hours [start, end) and the zone used when a site has none.
BUSINESS_START_HOUR = 8
BUSINESS_END_HOUR = 18
DEFAULT_TIMEZONE = "America/Toronto"

# Outage baseline window and the at-risk report rules.
BASELINE_DAYS = 28
AT_RISK_MIN_TICKETS = 20
AT_RISK_ROWS = 10
TREND_THRESHOLD_PP = 2

# Review policy shares and the time split (inclusive month bounds).
TOP_SHARE = (1, 10)
MEDIUM_SHARE = (3, 10)
TRAIN_END = "1999-12"
VALIDATION_END = "2000-12"

# Display labels.
SERVICE_LABELS = {
    "dedicated_internet": "Dedicated Internet",
    "sd_wan": "SD-WAN",
    "business_voice_sip": "Business Voice (SIP)",
    "managed_cloud": "Managed Cloud",
    "managed_security": "Managed Security",
    "mpls_wan": "MPLS WAN",
}
CHANNEL_LABELS = {
    "phone": "Phone",
    "email": "Email",
    "web_portal": "Web Portal",
    "chat": "Chat",
    "api": "API",
    "monitoring": "Monitoring",
}
GROUP_LABELS = {
    "cloud_ops": "Cloud Ops",
    "security_ops": "Security Ops",
    "voice_ops": "Voice Ops",
    "field_ontario": "Field - Ontario",
    "field_quebec": "Field - Quebec",
    "field_west": "Field - West",
    "field_prairies": "Field - Prairies",
    "field_atlantic": "Field - Atlantic",
}
SPLIT_LABELS = {
    "train": "Train",
    "validation": "Validation",
    "test": "Test",
    "unlabelled": "Unlabelled (open or cancelled)",
}
RISK_LABELS = {"low": "Low", "medium": "Medium", "high": "High"}
ACRONYMS = {
    "Sbc": "SBC",
    "Ddos": "DDoS",
    "Sip": "SIP",
    "Api": "API",
    "Hq": "HQ",
    "Mpls": "MPLS",
    "Cpe": "CPE",
    "Vpn": "VPN",
    "Dns": "DNS",
    "Bgp": "BGP",
    "Wan": "WAN",
    "Sd": "SD",
}

# City centroids (city, province, latitude, longitude) and province names.
CITY_CENTROIDS = [
    ("Toronto", "ON", 43.6532, -79.3832),
    ("Ottawa", "ON", 45.4215, -75.6972),
    ("Mississauga", "ON", 43.5890, -79.6441),
    ("Hamilton", "ON", 43.2557, -79.8711),
    ("London", "ON", 42.9849, -81.2453),
    ("Kitchener", "ON", 43.4516, -80.4925),
    ("Windsor", "ON", 42.3149, -83.0364),
    ("Kingston", "ON", 44.2312, -76.4860),
    ("Sudbury", "ON", 46.4917, -80.9930),
    ("Montreal", "QC", 45.5017, -73.5673),
    ("Quebec City", "QC", 46.8139, -71.2080),
    ("Laval", "QC", 45.6066, -73.7124),
    ("Gatineau", "QC", 45.4765, -75.7013),
    ("Sherbrooke", "QC", 45.4042, -71.8929),
    ("Vancouver", "BC", 49.2827, -123.1207),
    ("Surrey", "BC", 49.1913, -122.8490),
    ("Victoria", "BC", 48.4284, -123.3656),
    ("Kelowna", "BC", 49.8880, -119.4960),
    ("Calgary", "AB", 51.0447, -114.0719),
    ("Edmonton", "AB", 53.5461, -113.4938),
    ("Red Deer", "AB", 52.2681, -113.8112),
    ("Winnipeg", "MB", 49.8951, -97.1384),
    ("Regina", "SK", 50.4452, -104.6189),
    ("Saskatoon", "SK", 52.1332, -106.6700),
    ("Halifax", "NS", 44.6488, -63.5752),
    ("Moncton", "NB", 46.0878, -64.7782),
    ("Fredericton", "NB", 45.9636, -66.6431),
    ("St. John's", "NL", 47.5615, -52.7126),
    ("Charlottetown", "PE", 46.2382, -63.1311),
]
PROVINCE_NAMES = {
    "ON": "Ontario",
    "QC": "Quebec",
    "BC": "British Columbia",
    "AB": "Alberta",
    "SK": "Saskatchewan",
    "MB": "Manitoba",
    "NS": "Nova Scotia",
    "NB": "New Brunswick",
    "NL": "Newfoundland and Labrador",
    "PE": "Prince Edward Island",
}
